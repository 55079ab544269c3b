"""Every query of the library's own operators, with the SQL it must agree with.

All run on the log that ``corpus`` derives from ``orders``, unless they name another table.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from querysieve.functions.features import SLOTS, count_sign, features
from querysieve.functions.text import normalized
from querysieve.functions.vectors import text_to_vector, vector_to_text
from querysieve.operators import importing, metrics, mining, models, rules
from querysieve.operators.expand import SCENARIOS
from querysieve.operators.split import split
from querysieve.plans import oracle, scenarios
from querysieve.plans.corpus import corpus, featured, transactions
from querysieve.sources.textfiles import itemset_line, parse_rules, rule_line, transaction_line

Query = Callable[[SparkSession, str], DataFrame]


def _slots(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.select(*keys, *SLOTS[:7], F.round("f7", 6).alias("f7"))


def _text(items: str | Column, separator: str = ",") -> Column:
    return F.array_join((F.col(items) if isinstance(items, str) else items).cast("array<string>"), separator)


def _tx(spark: SparkSession, sf_dir: str, stage: int = 4) -> DataFrame:
    return transactions(featured(corpus(spark, sf_dir)), stage)


def dedup_insert(spark, sf_dir):
    return importing.first_of_each(corpus(spark, sf_dir), "raw_sql", ["id"]).select("raw_sql", "label", "n_dups")


def bad_row_skip(spark, sf_dir):
    text = F.col("label").cast("string")
    kind = F.col("id") % 5
    log = corpus(spark, sf_dir).withColumn("label", F.when(kind == 0, text).when(kind == 1, F.concat(F.lit(" "), text)).when(kind == 2, F.concat(F.lit("x"), text)).when(kind == 3, F.concat(F.lit("+"), text)).otherwise(""))
    return importing.skip_bad_rows(log).select("id", "raw_sql", "label")


def reimport(spark, sf_dir):
    rows = corpus(spark, sf_dir)
    first = importing.first_of_each(rows, "raw_sql", ["id"]).select("raw_sql", "label")
    return importing.new_only(first, rows.where("id % 3 = 0"))


def pending_scan(spark, sf_dir):
    rows = corpus(spark, sf_dir)
    return importing.pending(rows, rows.where("id % 3 = 0")).select("id", "raw_sql")


def feature_fill(spark, sf_dir):
    rows = corpus(spark, sf_dir)
    return _slots(importing.fill_features(rows, featured(rows.where("id % 3 = 0"))), "id")


def normalize(spark, sf_dir):
    return corpus(spark, sf_dir).select("id", normalized(F.col("raw_sql")).alias("p"))


def features_lexical(spark, sf_dir):
    return _slots(featured(corpus(spark, sf_dir)), "id")


def _features_of(table: str, key: str, text: str, spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(F.expr(key).alias("id"), text)
    return _slots(featured(rows, text), "id")


def features_branching(spark, sf_dir):
    rows = corpus(spark, sf_dir).select("id", normalized(F.col("raw_sql")).alias("p"))
    accepted = F.col("p").rlike("^SELECT .* FROM ")
    slots = features(F.col("p"), F.when(accepted, F.col("p")))
    return rows.select("id", accepted.alias("accepted"), *[slots[s].alias(s) for s in ("f1", "f2", "f3", "f4")])


def features_parsed(spark, sf_dir):
    return _slots(featured(corpus(spark, sf_dir), parsed=True), "id", "accepted")


def features_literal(spark, sf_dir):
    p = normalized(F.col("raw_sql"))
    return corpus(spark, sf_dir).select("id", p.alias("p")).select("id", count_sign(F.col("p"), "'", "literal").alias("f5"), (count_sign(F.col("p"), "--", "literal") + count_sign(F.col("p"), "#", "literal")).alias("f6"))


def vector_codec(spark, sf_dir):
    rows = featured(corpus(spark, sf_dir)).select("id", vector_to_text(F.array(*SLOTS)).alias("text")).select("id", text_to_vector(F.col("text")).alias("v"))
    return _slots(rows.select("id", *[F.col("v")[k].alias(s) for k, s in enumerate(SLOTS)]), "id")


def items_of(stage, spark, sf_dir):
    return _tx(spark, sf_dir, stage).select("id", _text("items", " ").alias("items"))


def transaction_lines(spark, sf_dir):
    return _tx(spark, sf_dir).select("id", transaction_line(F.col("items")).alias("line"))


def item_support(spark, sf_dir):
    return mining.item_support(_tx(spark, sf_dir))


def itemsets_of(stage, min_support, miner, spark, sf_dir):
    return miner(_tx(spark, sf_dir, stage), min_support).select(_text("items").alias("itemset"), "freq")


def itemset_lines(spark, sf_dir):
    return mining.itemsets(_tx(spark, sf_dir, 3), 0.1).select(itemset_line().alias("line"))


def frequent_patterns(spark, sf_dir):
    return mining.patterns(_tx(spark, sf_dir), 0.1).select(_text("items").alias("itemset"))


def rules_of(stage, min_support, min_confidence, miner, spark, sf_dir):
    found = rules.mine_rules(_tx(spark, sf_dir, stage), min_support, min_confidence, miner)
    return found.select(_text("antecedent").alias("antecedent"), _text("consequent").alias("consequent"), "support", F.round("confidence", 6).alias("confidence"))


def rules_single_consequent(spark, sf_dir):
    lines = rules.mine_rules(_tx(spark, sf_dir), 0.1, 0.6).select(rule_line().alias("value"))
    return parse_rules(lines).select(_text("antecedent").alias("antecedent"), "consequent", F.round("confidence", 6).alias("confidence"))


def split_rows(spark, sf_dir):
    return split(corpus(spark, sf_dir)).select("id", "is_train")


def expand_in(scenario, spark, sf_dir):
    text = _text(F.transform("extra", lambda x: F.round(x.cast("double") * 1_000_000).cast("long")))
    rows = scenarios.expanded(scenarios.prepared(corpus(spark, sf_dir)), scenario, {"shown": text})
    return rows.select("id", "is_train", F.size("expanded").cast("long").alias("dims"), F.col("shown").alias("extra"))


def _rounded(found: DataFrame) -> DataFrame:
    return found.select(*[F.round(c, 6).alias(c) if c in metrics.METRICS[4:] else c for c in found.columns])


def confusion_metrics(spark, sf_dir):
    rows = featured(corpus(spark, sf_dir)).select("label", F.when((F.col("f7") > 0.2) | (F.col("f4") > 1), 1).otherwise(0).alias("prediction"))
    found = metrics.confusion_metrics(rows)
    return _rounded(found)


def nb_params(spark, sf_dir):
    found = models.gaussian_parameters(featured(corpus(spark, sf_dir)), SLOTS)
    return found.select("label", "slot", F.round("mean", 6).alias("mean"), F.round("variance", 6).alias("variance"))


def model(name, spark, sf_dir, scenario: int = 2):
    return _rounded(scenarios.run_scenario(scenarios.prepared(corpus(spark, sf_dir)), scenario, [name]))


def _baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``items``: the brands (25 at most) that each customer has bought."""
    read = lambda name, *columns: spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)
    bought = read("lineitem", "l_orderkey", "l_partkey").join(read("orders", F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    brands = bought.join(read("part", F.col("p_partkey").alias("l_partkey"), F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int").alias("brand")), "l_partkey")
    return brands.groupBy("o_custkey").agg(F.collect_set("brand").alias("items"))


def basket_itemsets(miner, spark, sf_dir):
    return miner(_baskets(spark, sf_dir), 0.45).select(_text("items").alias("itemset"), "freq")


def basket_rules(spark, sf_dir):
    found = rules.mine_rules(_baskets(spark, sf_dir), 0.45, 0.8)
    return found.select(_text("antecedent").alias("antecedent"), _text("consequent").alias("consequent"), "support", F.round("confidence", 6).alias("confidence"))


def scenario_grid(spark, sf_dir):
    """All seven scenarios with all six models."""
    return _rounded(scenarios.run_all(corpus(spark, sf_dir)))


def count_rows(label, spark, sf_dir):
    rows = corpus(spark, sf_dir)
    return (rows if label is None else rows.where(F.col("label") == label)).agg(F.count("*").alias("n"))


def head_10(spark, sf_dir):
    return corpus(spark, sf_dir).orderBy("id").limit(10)


QUERIES: dict[str, Query] = {
    "dedup_insert": dedup_insert,
    "bad_row_skip": bad_row_skip,
    "reimport": reimport,
    "pending_scan": pending_scan,
    "feature_fill": feature_fill,
    "normalize": normalize,
    "features_lexical": features_lexical,
    "features_documents": partial(_features_of, "documents", "doc_id", "text"),
    "features_urls": partial(_features_of, "pages", "page_id", "url"),
    "features_conversations": partial(_features_of, "conversations", "conv_id * 1000 + turn", "text"),
    "features_branching": features_branching,
    "features_parsed": features_parsed,
    "features_literal": features_literal,
    "vector_codec": vector_codec,
    "items_stage3": partial(items_of, 3),
    "items_stage4": partial(items_of, 4),
    "transaction_lines": transaction_lines,
    "item_support": item_support,
    "itemsets_s3_05": partial(itemsets_of, 3, 0.05, mining.itemsets),
    "itemsets_s3_10": partial(itemsets_of, 3, 0.1, mining.itemsets),
    "itemsets_s4_05": partial(itemsets_of, 4, 0.05, mining.itemsets),
    "itemsets_s4_10": partial(itemsets_of, 4, 0.1, mining.itemsets),
    "eclat_s4_05": partial(itemsets_of, 4, 0.05, mining.eclat),
    "fpgrowth_s4_05": partial(itemsets_of, 4, 0.05, mining.fp_growth),
    "itemset_lines": itemset_lines,
    "basket_itemsets": partial(basket_itemsets, mining.itemsets),
    "basket_eclat": partial(basket_itemsets, mining.eclat),
    "basket_rules": basket_rules,
    "frequent_patterns": frequent_patterns,
    "rules_s3_05_60": partial(rules_of, 3, 0.05, 0.6, mining.itemsets),
    "rules_s3_05_80": partial(rules_of, 3, 0.05, 0.8, mining.itemsets),
    "rules_s4_10_60": partial(rules_of, 4, 0.1, 0.6, mining.itemsets),
    "eclat_rules": partial(rules_of, 4, 0.05, 0.6, mining.eclat),
    "fpgrowth_rules": partial(rules_of, 4, 0.05, 0.6, mining.fp_growth),
    "rules_single_consequent": rules_single_consequent,
    "split": split_rows,
    **{f"expand_{k}": partial(expand_in, k) for k in SCENARIOS},
    "confusion_metrics": confusion_metrics,
    "nb_params": nb_params,
    **{f"model_{name}": partial(model, name) for name in [*models.MODELS, *models.OTHERS]},
    "scenario_grid": scenario_grid,
    "count_all": partial(count_rows, None),
    "count_malicious": partial(count_rows, 1),
    "count_benign": partial(count_rows, 0),
    "head_10": head_10,
}

ORACLE: dict[str, str] = dict(oracle.SQL)
