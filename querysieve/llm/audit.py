"""How the filters of a corpus act on each other: what each removes, in every order.

Five filters look at a document: A too few words, B too few distinct ones, C too many capitals, D signs that prose lacks,
E a copy of a document of smaller id.  A document's failures are a mask of five bits; once masks are counted, by part of the
corpus and label, all 120 orders follow from those few counts.

Copies are found by refining a partition: documents are split by their number of code points, then by hashes of one block
of text after another, and at each step those that are alone in their class drop out.  Of the rest the full texts are
compared, by grouping on them, and all but those of the least id are marked.  Texts that differ in spite of equal hashes are
told apart there.

At scale: one scan computes masks, lengths and hashes and writes them (some 60 bytes a document); refining reads these
alone.  Counts are combined before each shuffle, so a text that fills a third of the corpus is a row per task.  The list of
classes that hold several documents is broadcast up to ``BROADCAST`` rows, and joined by a shuffle beyond; a second scan of
the texts compares those of the classes that are left.

Edge cases: a null text is empty, and empty texts are copies of each other; a row without a doc_id is a copy of none and
makes none; rows of one doc_id and text aren't copies of each other; a null lang is the part ""; labels that repeat a
doc_id count once, as 1 if any of them is 1; rows that repeat a doc_id take its label each; no documents, no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querysieve.llm.common import ensure_checkpoint_dir, store

FILTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, CAPITALS_PERCENT = 200, 50, 3
BLOCKS = (256, 8_192)  # code points of the first blocks; the last one is the rest
BROADCAST = 500_000  # rows of four numbers
CLASS = ["size", *(f"h{k}" for k in range(len(BLOCKS) + 1))]
BIT = {name: 1 << k for k, name in enumerate(FILTERS)}


def text_mask(text: Column) -> Column:
    """Failures of A to D as bits; ``text`` isn't null."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    fails = {
        "A": n < LEAST_WORDS,
        "B": distinct * 100 < n * DISTINCT_PERCENT,
        "C": F.regexp_count(text, F.lit("[A-Z]")).cast("long") * 100 > F.length(text).cast("long") * CAPITALS_PERCENT,
        "D": text.rlike(r"[#$%&*|]"),
    }
    mask = F.lit(0)
    for name, failed in fails.items():
        mask = mask + F.when(failed, BIT[name]).otherwise(0)
    return mask


def classes(text: Column, block_hash: Callable[[Column], Column] = F.xxhash64) -> dict[str, Column]:
    """The number of code points and the hash of each block."""
    found, at = {"size": F.length(text)}, 1
    for k, size in enumerate((*BLOCKS, None)):
        found[f"h{k}"] = block_hash(F.substring(text, at, size) if size else F.substring(text, at, 1 << 30))
        at += size or 0
    return found


def _among(rows: DataFrame, chosen: DataFrame, by: list[str], how: str, broadcast: int) -> DataFrame:
    """Joined with a stored table on ``by``; the table is broadcast if it is short enough."""
    return rows.join(F.broadcast(chosen) if chosen.count() <= broadcast else chosen, by, how)


def refine(rows: DataFrame, folder: str, broadcast: int = BROADCAST) -> DataFrame:
    """``rows`` (the columns of ``CLASS``) -> the classes that hold several rows after all steps."""
    alive, several = rows.select(*CLASS), None
    for k in range(len(CLASS)):
        by = CLASS[: k + 1]
        several = store(alive.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1").select(*by), f"{folder}/classes-{k}")
        if k + 1 < len(CLASS):
            alive = _among(alive, several, by, "left_semi", broadcast)
    return several


def marked(docs: DataFrame, columns: dict[str, Column], block_hash: Callable[[Column], Column] = F.xxhash64, broadcast: int = BROADCAST) -> DataFrame:
    """doc_id, ``columns`` (computed from the rows of ``docs``, ``text`` never null) and is_copy of every row."""
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/copies-{uuid.uuid4().hex}"
    own = docs.withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.coalesce(F.col("text").cast("string"), F.lit(""))})
    texts = own.select("doc_id", "text", *[c.alias(name) for name, c in {**columns, **classes(F.col("text"), block_hash)}.items()])
    rows = store(texts.drop("text"), f"{folder}/rows")
    several = refine(rows, folder, broadcast)
    # Equal texts meet in one group; a task sends each of its texts once.
    compared = _among(texts.select("doc_id", "text", *CLASS), several, CLASS, "left_semi", broadcast)
    firsts = compared.groupBy(*CLASS, "text").agg(F.min("doc_id").alias("first"))
    settled = store(firsts.groupBy(*CLASS).agg(F.min("first").alias("first"), F.count("*").alias("n_texts")), f"{folder}/firsts")
    is_copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).alias("is_copy")
    known = _among(rows, settled, CLASS, "left", broadcast)
    found = known.where(F.coalesce(F.col("n_texts"), F.lit(1)) == 1).select("doc_id", *columns, is_copy)
    mixed = settled.where("n_texts > 1").select(*CLASS)
    if mixed.isEmpty():
        return found
    # Classes whose texts differ in spite of equal hashes: decided by the text itself.
    unlike = _among(texts, store(mixed, f"{folder}/mixed"), CLASS, "left_semi", broadcast)
    by_text = store(unlike.groupBy("text").agg(F.min("doc_id").alias("first")), f"{folder}/texts")
    return found.unionByName(unlike.join(by_text, "text").select("doc_id", *columns, is_copy))


def effects(counts: DataFrame) -> DataFrame:
    """``counts`` (part, mask, good, toxic, n) -> what each filter does at each step of every order, per part."""
    orders = F.split(F.lit(",".join(map("".join, permutations(FILTERS)))), ",")
    steps = counts.select("*", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    bits = lambda letters: sum((F.when(F.contains(letters, F.lit(f)), BIT[f]).otherwise(0) for f in FILTERS), F.lit(0))
    steps = steps.withColumns({"own": bits(F.substr("filter_order", F.col("step"), F.lit(1))), "earlier": bits(F.substr("filter_order", F.lit(1), F.col("step") - 1))})
    fails, gone = F.col("mask").bitwiseAND(F.col("own")) != 0, F.col("mask").bitwiseAND(F.col("earlier")) != 0
    # Of all orders, a share of one in so many as the document has failures puts this filter before its other ones.
    n_orders = len(list(permutations(FILTERS)))
    total = lambda which, n=F.col("n"): F.sum(F.when(which, n).otherwise(0)).cast("long")
    return steps.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~gone).alias("kept"),
        total(fails & ~gone).alias("removed"),
        total(fails & gone).alias("redundant"),
        total(F.col("mask") == F.col("own")).alias("unique_fails"),
        total(fails & ~gone & F.col("good")).alias("good_lost"),
        total(fails & ~gone & F.col("toxic")).alias("toxic_lost"),
        total(fails, F.col("n") * F.expr(f"{n_orders} div greatest(bit_count(mask), 1)")).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, block_hash: Callable[[Column], Column] = F.xxhash64, broadcast: int = BROADCAST) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    ``docs`` (doc_id, text, lang) in parts by lang, ``labels`` (doc_id, quality, toxic).
    """
    own = docs.select("doc_id", "text", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"))
    found = marked(own, {"part": F.col("part"), "mask": text_mask(F.col("text"))}, block_hash, broadcast)
    mask = F.col("mask") + F.when(F.col("is_copy"), BIT["E"]).otherwise(0)
    by_id = found.select("doc_id", "part", mask.alias("mask")).groupBy("doc_id", "part", "mask").agg(F.count("*").alias("n"))
    said = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    said = said.groupBy("doc_id").agg(*[F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in ("good", "toxic")])
    labelled = by_id.join(said, "doc_id", "left").select("part", "mask", "n", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])
    return effects(labelled.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n")))
