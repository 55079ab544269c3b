"""The registered queries as DuckDB SQL, for comparing results.

The SQL computes everything again from the test tables, by other means where there are any: itemsets from all subsets
of all rows' items, rules by joining itemsets with themselves, the split by one global ranking.
"""

from __future__ import annotations

from querysieve.functions.features import SLOTS
from querysieve.functions.items import BENIGN, MALICIOUS
from querysieve.functions.sqltext import COMMENTS, LEFT_OPEN, OPENINGS, TEXTS
from querysieve.plans.corpus import corpus_sql

BLANKS = r"[ \t\n\x0B\f\r]+"


def normalized(x: str) -> str:
    malformed = "'%($|[^0-9A-Fa-f]|[0-9A-Fa-f]($|[^0-9A-Fa-f]))'"
    decoded = f"CASE WHEN regexp_matches(coalesce({x}, ''), {malformed}) THEN {x} ELSE url_decode(replace(coalesce({x}, ''), '+', ' ')) END"
    upper = f"replace(upper({decoded}), 'ẞ', 'SS')"
    return rf"regexp_replace(regexp_replace(regexp_replace({upper}, '{BLANKS}', ' ', 'g'), '^[\x00-\x20]+', ''), '[\x00-\x20]+$', '')"


def words(p: str, word: str) -> str:
    return rf"len(regexp_extract_all({p}, '\b{word}\b'))::DOUBLE"


def signs(p: str, literal: bool) -> tuple[str, str]:
    limit = "" if literal else r"\b"
    count = lambda s: f"len(regexp_extract_all({p}, '{limit}{s}{limit}'))"
    return f"{count(chr(39) * 2)}::DOUBLE", f"({count('--')} + {count('#')})::DOUBLE"


def equals(p: str) -> str:
    return f"(length({p}) - length(replace({p}, '=', '')))::DOUBLE"


def slots(p: str = "p") -> dict[str, str]:
    quote, comment = signs(p, literal=False)
    return {
        "f0": rf"(length({p}) + length(regexp_replace({p}, '[^\x{{10000}}-\x{{10FFFF}}]', '', 'g')))::DOUBLE",
        "f1": equals(p),
        "f2": words(p, "WHERE"),
        "f3": words(p, "SELECT"),
        "f4": words(p, "UNION"),
        "f5": quote,
        "f6": comment,
        "f7": f"{words(p, 'OR')} / len(regexp_split_to_array({p}, '{BLANKS}'))",
    }


def listed(which: dict[str, str]) -> str:
    return ", ".join(f"{sql} AS {name}" for name, sql in which.items())


ROUNDED = ", ".join([*SLOTS[:7], "round(f7, 6) AS f7"])
CORPUS = f"WITH RECURSIVE corpus AS ({corpus_sql('varchar(20)')})"
NORMAL = f"{CORPUS}, normal AS (SELECT id, raw_sql, label, {normalized('raw_sql')} AS p FROM corpus)"
FEATURES = f"{NORMAL}, featured AS (SELECT *, {listed(slots())} FROM normal)"
ITEMS = (
    "list_filter([CASE WHEN f0 > 100 THEN 1 END, CASE WHEN f1 > 3 THEN 2 END, CASE WHEN f2 = 1 THEN 3 WHEN f2 > 1 THEN 33 END,"
    " CASE WHEN f3 = 1 THEN 4 WHEN f3 > 1 THEN 44 END, CASE WHEN f4 = 1 THEN 5 WHEN f4 > 1 THEN 55 END, CASE WHEN f5 > 2 THEN 6 END,"
    " CASE WHEN f6 > 0 THEN 7 END, CASE WHEN f7 > 0.2 THEN 8 END], lambda x: x IS NOT NULL)"
)


def rows_with_items(stage: int) -> str:
    label = f" || [CASE WHEN label = 1 THEN {MALICIOUS} ELSE {BENIGN} END]" if stage == 3 else ""
    return f"{FEATURES}, tx AS (SELECT *, {ITEMS}{label} AS items FROM featured)"


def mined(source: str, min_support: float, to: str = "found") -> str:
    """CTEs: itemsets (items, freq) of the non-empty rows of ``source``."""
    return (
        f", {to}_tx AS (SELECT list_sort(items) AS items FROM {source} WHERE len(items) > 0)"
        f", {to}_sub AS (SELECT list_filter(items, lambda x, i: (m >> (i - 1)) & 1 = 1) AS items FROM (SELECT items, unnest(range(1, 1 << len(items))) AS m FROM {to}_tx))"
        f", {to} AS (SELECT items, count(*)::BIGINT AS freq FROM {to}_sub GROUP BY 1 HAVING count(*) >= ceil({min_support} * (SELECT count(*) FROM {to}_tx) - 1e-9))"
    )


def ruled(found: str, min_confidence: float, to: str = "rules") -> str:
    """CTE: antecedent, consequent, support, confidence."""
    return (
        f", {to} AS (SELECT a.items AS antecedent, list_filter(b.items, lambda x: NOT list_contains(a.items, x)) AS consequent, b.freq AS support, b.freq::DOUBLE / a.freq AS confidence"
        f" FROM {found} a JOIN {found} b ON len(a.items) < len(b.items) AND list_has_all(b.items, a.items) WHERE b.freq::DOUBLE / a.freq >= {min_confidence})"
    )


def text_of(items: str, separator: str = ",") -> str:
    return f"array_to_string(list_transform({items}, lambda x: x::VARCHAR), '{separator}')"


SPLIT = (
    ", ranked AS (SELECT *, row_number() OVER (ORDER BY md5(raw_sql || '|' || id)) <= floor(0.8 * (SELECT count(*) FROM tx)) AS is_train FROM tx)"
    ", train AS (SELECT * FROM ranked WHERE is_train)"
)
SHOWN_RULES = f"{text_of('antecedent')} AS antecedent, {text_of('consequent')} AS consequent, support, round(confidence, 6) AS confidence"


def itemsets(stage: int, support: float) -> str:
    return f"{rows_with_items(stage)}{mined('tx', support)} SELECT {text_of('items')} AS itemset, freq FROM found"


def rules(stage: int, support: float, confidence: float) -> str:
    return f"{rows_with_items(stage)}{mined('tx', support)}{ruled('found', confidence)} SELECT {SHOWN_RULES} FROM rules"


def expansion(uses: str | None, support: float | None, confidence: float | None) -> str:
    start = f"{rows_with_items(4)}{SPLIT}"
    if uses is None:
        return f"{start} SELECT id, is_train, 8::BIGINT AS dims, '' AS extra FROM ranked"
    if uses == "patterns":
        columns = f"{mined('train', support)}, columns AS (SELECT items, row_number() OVER (ORDER BY len(items), items) AS at FROM found)"
        value = "CASE WHEN list_has_all(r.items, c.items) THEN 1000000 ELSE 0 END"
    else:
        columns = f"{mined('train', support)}{ruled('found', confidence)}, columns AS (SELECT *, row_number() OVER (ORDER BY len(antecedent), antecedent, consequent) AS at FROM rules)"
        value = "CASE WHEN list_has_all(r.items, c.antecedent) AND list_contains(r.items, c.consequent[1]) THEN round(c.confidence::FLOAT::DOUBLE * 1000000)::BIGINT ELSE 0 END"
    return (
        f"{start}{columns} SELECT r.id, r.is_train, (8 + count(c.at))::BIGINT AS dims, coalesce(string_agg(({value})::VARCHAR, ',' ORDER BY c.at), '') AS extra"
        " FROM ranked r LEFT JOIN columns c ON true GROUP BY r.id, r.is_train"
    )


def safe(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} = 0 THEN 0 ELSE ({part})::DOUBLE / ({whole}) END"


def metrics_of(said: str) -> str:
    """CTE ``metrics``: counts and metrics of the predictions in ``said`` (label, prediction)."""
    return (
        ", c AS (SELECT count(*) FILTER (label = 1 AND prediction = 1) AS tp, count(*) FILTER (label <> 1 AND prediction = 1) AS fp,"
        f" count(*) FILTER (label = 1 AND prediction <> 1) AS fn, count(*) FILTER (label <> 1 AND prediction <> 1) AS tn FROM {said})"
        f", m AS (SELECT *, 100 * {safe('tp + tn', 'tp + fp + fn + tn')} AS accuracy, {safe('tp', 'tp + fp')} AS p1, {safe('tp', 'tp + fn')} AS r1, {safe('tn', 'tn + fn')} AS p0, {safe('tn', 'tn + fp')} AS r0 FROM c)"
        f", f AS (SELECT *, {safe('2 * p1 * r1', 'p1 + r1')} AS f1, {safe('2 * p0 * r0', 'p0 + r0')} AS f0 FROM m)"
        ", metrics AS (SELECT tp, fp, fn, tn, round(accuracy, 6) AS accuracy, round(p1, 6) AS p1, round(r1, 6) AS r1, round(f1, 6) AS f1, round(p0, 6) AS p0, round(r0, 6) AS r0, round(f0, 6) AS f0, round((f1 + f0) / 2, 6) AS macro_f1 FROM f)"
    )


METRICS = f"{FEATURES}, said AS (SELECT label, CASE WHEN f7 > 0.2 OR f4 > 1 THEN 1 ELSE 0 END AS prediction FROM featured){metrics_of('said')} SELECT * FROM metrics"


def naive_bayes(support: float = 0.05) -> str:
    """The Gaussian model of scenario 2, fitted and applied in SQL; a hair of the largest variance is added to each."""
    return (
        f"{rows_with_items(4)}{SPLIT}{mined('train', support)}, columns AS (SELECT items, row_number() OVER () AS at FROM found)"
        f", long AS (SELECT id, label, is_train, slot, x::FLOAT::DOUBLE AS x FROM ranked CROSS JOIN LATERAL (SELECT unnest({SLOTS!r}) AS slot, unnest([{', '.join(SLOTS)}]) AS x)"
        " UNION ALL SELECT r.id, r.label, r.is_train, 'p' || c.at, list_has_all(r.items, c.items)::INT::DOUBLE FROM ranked r, columns c)"
        ", hair AS (SELECT 1e-9 * max(v) AS e FROM (SELECT var_samp(x) AS v FROM long WHERE is_train GROUP BY slot))"
        ", fitted AS (SELECT label AS class, slot, avg(x) AS mean, avg(x * x) - avg(x) * avg(x) + (SELECT e FROM hair) AS v FROM long WHERE is_train GROUP BY label, slot)"
        ", prior AS (SELECT label AS class, ln(count(*)) AS p FROM ranked WHERE is_train GROUP BY label)"
        ", scored AS (SELECT id, label, class, any_value(p) - 0.5 * sum(ln(2 * pi() * v) + (x - mean) ** 2 / v) AS s FROM long JOIN fitted USING (slot) JOIN prior USING (class) WHERE NOT is_train GROUP BY id, label, class)"
        ", said AS (SELECT id, any_value(label) AS label, arg_max(class, s) AS prediction FROM scored GROUP BY id)"
        f"{metrics_of('said')} SELECT 2 AS scenario, 'naive_bayes' AS model, * FROM metrics"
    )


def precise_bayes(support: float = 0.05) -> str:
    """The Gaussian model with precisions: values rounded to the mean gap of a slot's distinct values, deviations of a sixth of it at least."""
    return (
        f"{rows_with_items(4)}{SPLIT}{mined('train', support)}, columns AS (SELECT items, row_number() OVER () AS at FROM found)"
        f", long AS (SELECT id, label, is_train, slot, x::FLOAT::DOUBLE AS x FROM ranked CROSS JOIN LATERAL (SELECT unnest({SLOTS!r}) AS slot, unnest([{', '.join(SLOTS)}]) AS x)"
        " UNION ALL SELECT r.id, r.label, r.is_train, 'p' || c.at, list_has_all(r.items, c.items)::INT::DOUBLE FROM ranked r, columns c)"
        ", gaps AS (SELECT slot, CASE WHEN count(DISTINCT x) > 1 THEN (max(x) - min(x)) / (count(DISTINCT x) - 1) ELSE 0.01 END AS p FROM long WHERE is_train GROUP BY slot)"
        ", near AS (SELECT long.*, p, round_even(x / p, 0) * p AS r FROM long JOIN gaps USING (slot))"
        ", fitted AS (SELECT label AS class, slot, avg(r) AS mean, greatest(stddev_pop(r), any_value(p) / 6) AS sd FROM near WHERE is_train GROUP BY label, slot)"
        ", prior AS (SELECT label AS class, ln((count(*) + 1) / (sum(count(*)) OVER () + 2)) AS p FROM ranked WHERE is_train GROUP BY label)"
        ", scored AS (SELECT id, label, class, any_value(prior.p) + sum(-ln(sd) - (r - mean) ** 2 / (2 * sd * sd)) AS s FROM near JOIN fitted USING (slot) JOIN prior USING (class) WHERE NOT is_train GROUP BY id, label, class)"
        ", said AS (SELECT id, any_value(label) AS label, arg_max(class, s) AS prediction FROM scored GROUP BY id)"
        f"{metrics_of('said')} SELECT 2 AS scenario, 'precise_bayes' AS model, * FROM metrics"
    )


LEVELS = 7  # more than any itemset of the baskets has at that support


def baskets(support: float) -> str:
    """CTEs: brands of each customer as a bit mask, and ``found`` (items, freq): every candidate counted on all of them."""
    first = (
        "WITH bought AS (SELECT DISTINCT o_custkey, regexp_extract(p_brand, '[0-9]+$')::INT AS brand FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"
        ", tx AS (SELECT o_custkey, bit_or(1::BIGINT << brand) AS mask FROM bought GROUP BY 1), brands AS (SELECT DISTINCT brand FROM bought)"
        f", least AS (SELECT ceil({support} * count(*) - 1e-9) AS n FROM tx)"
        ", l1 AS (SELECT 1::BIGINT << brand AS m, brand AS last, [brand] AS items, count(*)::BIGINT AS freq FROM bought GROUP BY ALL HAVING count(*) >= (SELECT n FROM least))"
    )
    for k in range(2, LEVELS + 1):
        first += (
            f", l{k} AS (SELECT l.m | (1::BIGINT << brand) AS m, brand AS last, list_append(l.items, brand) AS items, count(*)::BIGINT AS freq FROM l{k - 1} l JOIN brands ON brand > l.last"
            " JOIN tx ON tx.mask & (l.m | (1::BIGINT << brand)) = l.m | (1::BIGINT << brand) GROUP BY ALL HAVING count(*) >= (SELECT n FROM least))"
        )
    return f"{first}, found AS ({' UNION ALL '.join(f'SELECT items, freq FROM l{k}' for k in range(1, LEVELS + 1))})"


def features_of(table: str, key: str, text: str) -> str:
    return f"WITH normal AS (SELECT {key} AS id, {normalized(text)} AS p FROM {table}), featured AS (SELECT *, {listed(slots())} FROM normal) SELECT id, {ROUNDED} FROM featured"


def recognised() -> str:
    """CTE ``parsed``: the normalised rows with their canonical text (``text``) and whether it is a statement (``accepted``)."""
    quoted = lambda pattern: "'" + pattern.replace("'", "''") + "'"
    kept = rf"regexp_replace(p, {quoted(COMMENTS)}, '\1', 'g')"
    text = f"regexp_replace(trim(regexp_replace({kept}, ' +', ' ', 'g'), ' '), ' ?;$', '')"
    count = lambda what: f"len(regexp_extract_all(bare, {quoted(what)}))"
    closed = rf"NOT contains(bare, {quoted(chr(39))}) AND {count('[(]')} = {count('[)]')} AND NOT contains(bare, ';')"
    ends = rf"NOT regexp_matches(bare, {quoted(LEFT_OPEN)}) AND {count(chr(92) + 'bWHERE' + chr(92) + 'b')} <= greatest({count(chr(92) + 'bSELECT' + chr(92) + 'b')}, 1)"
    return (
        f"{NORMAL}, plain AS (SELECT *, {text} AS text FROM normal), bared AS (SELECT *, regexp_replace(text, {quoted(TEXTS)}, '?', 'g') AS bare FROM plain)"
        f", parsed AS (SELECT *, regexp_matches(bare, {quoted(OPENINGS)}) AND {closed} AND {ends} AS accepted FROM bared)"
    )


def features_parsed() -> str:
    own, known = slots(), {"f1": equals("text"), "f2": "contains(text, 'WHERE')::INT::DOUBLE", "f3": words("text", "SELECT"), "f4": "contains(text, 'UNION')::INT::DOUBLE"}
    both = {s: f"CASE WHEN accepted THEN {known[s]} ELSE {own[s]} END" if s in known else own[s] for s in SLOTS}
    return f"{recognised()}, featured AS (SELECT id, accepted, {listed(both)} FROM parsed) SELECT id, accepted, {ROUNDED} FROM featured"


_LITERAL = signs("p", literal=True)
ACCEPTED = "regexp_matches(p, '^SELECT .* FROM ')"
BAD_LABELS = "CASE id % 5 WHEN 0 THEN label::VARCHAR WHEN 1 THEN ' ' || label WHEN 2 THEN 'x' || label WHEN 3 THEN '+' || label ELSE '' END"
SQL = {
    "dedup_insert": f"{CORPUS} SELECT raw_sql, arg_min(label, id) AS label, count(*)::BIGINT AS n_dups FROM corpus GROUP BY raw_sql",
    "bad_row_skip": f"{CORPUS} SELECT id, raw_sql, label FROM corpus WHERE id % 5 IN (0, 3)",
    "reimport": f"{CORPUS} SELECT raw_sql, arg_min(label, id) AS label FROM corpus WHERE raw_sql NOT IN (SELECT raw_sql FROM corpus WHERE id % 3 = 0) GROUP BY raw_sql",
    "pending_scan": f"{CORPUS} SELECT id, raw_sql FROM corpus WHERE id % 3 <> 0",
    "feature_fill": f"{FEATURES} SELECT id, {ROUNDED} FROM featured",
    "normalize": f"{NORMAL} SELECT id, p FROM normal",
    "features_lexical": f"{FEATURES} SELECT id, {ROUNDED} FROM featured",
    "features_documents": features_of("documents", "doc_id", "text"),
    "features_urls": features_of("pages", "page_id", "url"),
    "features_conversations": features_of("conversations", "conv_id * 1000 + turn", "text"),
    "features_branching": (
        f"{NORMAL} SELECT id, {ACCEPTED} AS accepted, {equals('p')} AS f1,"
        f" CASE WHEN {ACCEPTED} THEN contains(p, 'WHERE')::INT::DOUBLE ELSE {words('p', 'WHERE')} END AS f2, {words('p', 'SELECT')} AS f3,"
        f" CASE WHEN {ACCEPTED} THEN contains(p, 'UNION')::INT::DOUBLE ELSE {words('p', 'UNION')} END AS f4 FROM normal"
    ),
    "features_parsed": features_parsed(),
    "features_literal": f"{NORMAL} SELECT id, {_LITERAL[0]} AS f5, {_LITERAL[1]} AS f6 FROM normal",
    "vector_codec": f"{FEATURES} SELECT id, {ROUNDED} FROM featured",
    "items_stage3": f"{rows_with_items(3)} SELECT id, {text_of('items', ' ')} AS items FROM tx",
    "items_stage4": f"{rows_with_items(4)} SELECT id, {text_of('items', ' ')} AS items FROM tx",
    "transaction_lines": f"{rows_with_items(4)} SELECT id, CASE WHEN len(items) > 0 THEN {text_of('items', ' ')} || ' ' ELSE '' END AS line FROM tx",
    "item_support": f"{rows_with_items(4)} SELECT item, count(*)::BIGINT AS freq FROM (SELECT unnest(items) AS item FROM tx) GROUP BY item",
    "itemsets_s3_05": itemsets(3, 0.05),
    "itemsets_s3_10": itemsets(3, 0.1),
    "itemsets_s4_05": itemsets(4, 0.05),
    "itemsets_s4_10": itemsets(4, 0.1),
    "eclat_s4_05": itemsets(4, 0.05),
    "fpgrowth_s4_05": itemsets(4, 0.05),
    "itemset_lines": f"{rows_with_items(3)}{mined('tx', 0.1)} SELECT {text_of('items', ' ')} || ' #SUP: ' || freq AS line FROM found",
    "frequent_patterns": f"{rows_with_items(4)}{mined('tx', 0.1)} SELECT {text_of('items')} AS itemset FROM found",
    "basket_itemsets": f"{baskets(0.45)} SELECT {text_of('items')} AS itemset, freq FROM found",
    "basket_eclat": f"{baskets(0.45)} SELECT {text_of('items')} AS itemset, freq FROM found",
    "basket_rules": f"{baskets(0.45)}{ruled('found', 0.8)} SELECT {SHOWN_RULES} FROM rules",
    "rules_s3_05_60": rules(3, 0.05, 0.6),
    "rules_s3_05_80": rules(3, 0.05, 0.8),
    "rules_s4_10_60": rules(4, 0.1, 0.6),
    "eclat_rules": rules(4, 0.05, 0.6),
    "fpgrowth_rules": rules(4, 0.05, 0.6),
    "rules_single_consequent": f"{rows_with_items(4)}{mined('tx', 0.1)}{ruled('found', 0.6)} SELECT {text_of('antecedent')} AS antecedent, consequent[1] AS consequent, round(confidence, 6) AS confidence FROM rules",
    "split": f"{rows_with_items(4)}{SPLIT} SELECT id, is_train FROM ranked",
    "expand_1": expansion(None, None, None),
    "expand_2": expansion("patterns", 0.05, None),
    "expand_3": expansion("patterns", 0.1, None),
    "expand_4": expansion("rules", 0.1, 0.6),
    "expand_5": expansion("rules", 0.05, 0.6),
    "expand_6": expansion(None, None, None),
    "expand_7": expansion(None, None, None),
    "confusion_metrics": METRICS,
    "nb_params": (
        f"{FEATURES} SELECT label, slot, round(avg(x), 6) AS mean, round(var_pop(x), 6) AS variance FROM featured"
        f" CROSS JOIN LATERAL (SELECT unnest({SLOTS!r}) AS slot, unnest([{', '.join(SLOTS)}]) AS x) GROUP BY label, slot"
    ),
    "model_naive_bayes": naive_bayes(),
    "model_precise_bayes": precise_bayes(),
    "count_all": f"{CORPUS} SELECT count(*)::BIGINT AS n FROM corpus",
    "count_malicious": f"{CORPUS} SELECT count(*)::BIGINT AS n FROM corpus WHERE label = 1",
    "count_benign": f"{CORPUS} SELECT count(*)::BIGINT AS n FROM corpus WHERE label = 0",
    "head_10": f"{CORPUS} SELECT id, raw_sql, label FROM corpus ORDER BY id LIMIT 10",
}
