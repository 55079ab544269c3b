"""One query per training-data operator, with production parameters, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from querysieve.llm import audit, bpe, collocations, debruijn, decontaminate, htmltext, langid, mpegts, packing, quality, runindex, simhash, toxicity
from querysieve.llm.common import table

BYTE_BPE = "byte_bpe_50k.tiktoken"
MANY_LANGUAGES = "byte_bpe_multi_50k.tiktoken"


def crc_is(modulus: int, remainder: int) -> Column:
    """Whether crc32 of doc_id as text leaves the remainder; a null doc_id doesn't."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == remainder, F.lit(False))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN)


def op2_debruijn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn.digests(table(spark, sf_dir, "documents"))


def op3_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(BYTE_BPE)
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op4_mpegts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpegts.digests(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, vocabulary = table(spark, sf_dir, "documents"), public_tokenizers.path(MANY_LANGUAGES)
    model = langid.fit(docs, vocabulary, use=~crc_is(3, 1))
    found = langid.predict(docs, model, vocabulary)
    return found.select("doc_id", crc_is(3, 1).alias("held_out"), "lang_pred", "score")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_runindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runindex.digests(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(~crc_is(4, 2)).select("doc_id", F.col("quality").alias("label"))
    found = quality.quality_scores(table(spark, sf_dir, "documents"), labels)
    return found.select("doc_id", crc_is(4, 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    rounded = [F.round(c, 6).alias(c) for c in ("overlap", "question_overlap", "answer_overlap")]
    return found.select("doc_id", "item_id", *rounded, "start_word")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(~crc_is(4, 2)).select("doc_id", F.col("toxic").alias("label"))
    found = toxicity.toxicity_scores(table(spark, sf_dir, "documents"), labels)
    return found.select("doc_id", crc_is(4, 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "neighbours", "terms")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_blockrules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_debruijn": op2_debruijn,
    "op3_bpe_codec": op3_bpe_codec,
    "op4_mpegts": op4_mpegts,
    "op5_language_id": op5_language_id,
    "op6_simhash": op6_simhash,
    "op7_runindex": op7_runindex,
    "op8_quality": op8_quality,
    "op9_decontaminate": op9_decontaminate,
    "op10_toxicity": op10_toxicity,
    "op11_filter_audit": op11_filter_audit,
    "op12_blockrules": op12_blockrules,
    "op13_collocations": op13_collocations,
}

#: DuckDB SQL for the results that SQL can express on whole tables.
ORACLE: dict[str, str] = {
    "op2_debruijn": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d WHERE len(ws) >= 13),
k AS (SELECT doc_id, i, md5(array_to_string(list_slice(ws, i, i + 12), ' ')) AS h FROM p),
m AS (SELECT h, min(doc_id) AS first FROM k GROUP BY h),
gone AS (SELECT DISTINCT k.doc_id, k.i + j.j AS at FROM k JOIN m USING (h), (SELECT unnest(range(0, 13)) AS j) j WHERE k.doc_id > m.first),
words AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS at FROM d),
kept AS (SELECT words.doc_id, count(*) AS n, string_agg(w, ' ' ORDER BY words.at) AS t FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.at = words.at WHERE gone.at IS NULL GROUP BY words.doc_id)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, (len(d.ws) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
""",
    # Shingles of items and documents joined, counted by passage; a part of fewer than five words is one shingle.
    "op9_decontaminate": r"""
WITH items AS (SELECT item_id, text, regexp_extract(trim(text), '(?s)^(.*[.!?])\s+(\S.*)$', ['q', 'a']) AS p FROM benchmark WHERE text IS NOT NULL),
parts AS (SELECT item_id, part, regexp_extract_all(lower(t), '[\p{L}\p{N}_]+') AS ws FROM (
  SELECT item_id, 'w' AS part, text AS t FROM items UNION ALL SELECT item_id, 'q', CASE WHEN p.a = '' THEN text ELSE p.q END FROM items UNION ALL SELECT item_id, 'a', p.a FROM items)),
sized AS (SELECT item_id, part, len(ws) AS words, least(len(ws), 5) AS size, ws FROM parts WHERE len(ws) > 0),
own AS (SELECT DISTINCT item_id, part, size, array_to_string(list_slice(ws, i, i + size - 1), ' ') AS s FROM (SELECT *, unnest(range(1, words - size + 2)) AS i FROM sized)),
n AS (SELECT item_id, part, count(*) AS n FROM own GROUP BY ALL),
strides AS (SELECT item_id, greatest(64, 1 << ceil(log2(words))::INT) AS stride FROM sized WHERE part = 'w'),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS ws FROM documents WHERE text IS NOT NULL),
spots AS (SELECT r, doc_id, i - 1 AS i, size, array_to_string(list_slice(ws, i, i + size - 1), ' ') AS s FROM (SELECT *, unnest(range(1, len(ws) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM own))),
hits AS (SELECT r, doc_id, item_id, part, s, i, size, stride FROM spots JOIN own USING (s, size) JOIN strides USING (item_id)),
placed AS (SELECT *, i // stride AS k FROM hits UNION ALL SELECT *, i // stride - 1 FROM hits WHERE i >= stride),
counted AS (SELECT r, doc_id, item_id, part, k, stride, count(DISTINCT s) AS c FROM placed WHERE i + size <= (k + 2) * stride GROUP BY ALL),
shares AS (SELECT r, doc_id, item_id, k, any_value(stride) AS stride, max(c / n) FILTER (part = 'w') AS o, max(c / n) FILTER (part = 'q') AS q, max(c / n) FILTER (part = 'a') AS a FROM counted JOIN n USING (item_id, part) GROUP BY ALL),
asks AS (SELECT item_id, max(words) FILTER (part = 'q') >= 13 AS asks, count(*) FILTER (part = 'q') AS has_q, count(*) FILTER (part = 'a') AS has_a FROM sized GROUP BY 1),
good AS (SELECT *, CASE WHEN has_q > 0 THEN coalesce(q, 0) END AS qo, CASE WHEN has_a > 0 THEN coalesce(a, 0) END AS ao FROM shares JOIN asks USING (item_id) WHERE o >= 0.8 - 1e-9 OR asks AND q >= 0.8 - 1e-9),
best AS (SELECT *, row_number() OVER (PARTITION BY r, item_id ORDER BY o DESC, qo DESC NULLS LAST, k) AS rank FROM good)
SELECT doc_id, item_id, round(o, 6) AS overlap, round(qo, 6) AS question_overlap, round(ao, 6) AS answer_overlap, (k * stride)::BIGINT AS start_word FROM best WHERE rank = 1
""",
    # Copies by comparing whole texts, then every order applied to every document's failures.
    "op11_filter_audit": r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, doc_id, [CASE WHEN len(ws) < 200 THEN 'A' END, CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' END, CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t) THEN 'C' END,
  CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END, CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' END] AS failed FROM w),
m AS (SELECT part, list_filter(failed, lambda x: x IS NOT NULL) AS failed, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT [a.x, b.x, c.x, d.x, e.x] AS o FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT o, unnest([1, 2, 3, 4, 5]) AS step FROM o),
r AS (SELECT part, o, step, n, good, toxic, failed, list_contains(failed, o[step]) AS fails, list_has_any(failed, list_slice(o, 1, step - 1)) AS gone FROM m, s),
shares AS (SELECT part, o[step] AS x, sum(n) FILTER (fails AND NOT gone) AS shapley FROM r GROUP BY ALL)
SELECT r.part, array_to_string(o, '') AS filter_order, step::INT AS step, coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (fails AND NOT gone), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (fails AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (failed = [o[step]]), 0)::BIGINT AS unique_fails, coalesce(sum(n) FILTER (fails AND NOT gone AND good), 0)::BIGINT AS good_lost,
  coalesce(sum(n) FILTER (fails AND NOT gone AND toxic), 0)::BIGINT AS toxic_lost, coalesce(any_value(shapley), 0)::BIGINT AS shapley
FROM r JOIN shares ON shares.part = r.part AND shares.x = o[step] GROUP BY r.part, o, step
""",
    # All runs of one to four words counted as text; every cut and every longer phrase compared.
    "op13_collocations": r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
n AS (SELECT lang, sum(len(ws)) AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, array_to_string(list_slice(ws, i, i + k - 1), ' ') AS phrase, count(*) AS f FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(ws) >= k) GROUP BY ALL),
c AS (SELECT *, string_split(phrase, ' ') AS ws FROM g WHERE k >= 2 AND f >= 30),
cuts AS (SELECT lang, phrase, f AS a, j, array_to_string(list_slice(ws, 1, j), ' ') AS head, array_to_string(list_slice(ws, j + 1, k), ' ') AS tail FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
scored AS (SELECT cuts.lang, cuts.phrase, a, j, h.f AS l, t.f AS r, (2000000::HUGEINT * a) // (h.f + t.f) AS score FROM cuts JOIN g h ON h.lang = cuts.lang AND h.phrase = cuts.head JOIN g t ON t.lang = cuts.lang AND t.phrase = cuts.tail),
lowest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS o FROM scored) WHERE o = 1),
kept AS (SELECT * FROM lowest x WHERE NOT EXISTS (SELECT 1 FROM c y WHERE y.lang = x.lang AND y.phrase <> x.phrase AND contains(' ' || y.phrase || ' ', ' ' || x.phrase || ' ') AND 100 * y.f >= 80 * x.a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
""",
}
