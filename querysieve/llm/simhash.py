"""SimHash near-duplicates with deletion-variant signatures.

A fingerprint has a bit for each bit position that is set in more than half of the hashes of a text's word
shingles.  Two fingerprints link when at most ``MOST_BITS`` = 3 bits differ.  Cut into two halves, they then
agree in one half but for one bit at most.  So every distinct fingerprint is filed under each half with each
single bit left out (64 keys), fingerprints under one key are compared, and links join into components.

Scale: fingerprints are made without a shuffle and checkpointed; only distinct ones are filed, so copies cost
nothing; keys of more than ``CROWDED`` fingerprints are filed again under the quarters of their other half (the
same argument: of the remaining 3 bits one quarter sees at most one), which leaves groups of a bounded size.

Edge cases: a null or wordless text has fingerprint zero, which links like any other; fewer words than a
shingle make one shingle; rows that repeat a doc_id are documents of their own, each with its fingerprint and component;
a null doc_id gets a fingerprint and joins components but never names one (a component of such rows only has a null id).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querysieve.llm import nearcopies
from querysieve.llm.common import as_bytes, cut, id_and_text, let_go, shuffle_partitions, slices
from querysieve.llm.components import components

SHINGLE, SEED, MOST_BITS = 3, 42, 3
CROWDED = 512


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    words = text.lower().split()  # bytes: A-Z only, and splits at the six ASCII blanks
    if not words:
        return 0
    parts = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    h = np.fromiter((xxhash.xxh64_intdigest(p, seed) for p in parts), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        part = h[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, fp (64 bits in a long); one row per input row."""

    def run(batches):
        let_go()
        for batch in slices(batches, 1000):
            found = np.array([fingerprint(t, shingle, seed) for t in as_bytes(batch["text"])], np.uint64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(found.view(np.int64), pa.int64())], ["doc_id", "fp"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, fp long")


def _without_bit(value: Column, width: int, bit: Column) -> Column:
    """A key from part ``bit // width`` of the value with that bit left out, and from which bit it was."""
    part = F.floor(bit / width).cast("int")
    piece = F.call_function("shiftrightunsigned", value, part * width).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
    mask = F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), bit % width))
    return F.call_function("shiftleft", bit.cast("long"), F.lit(width)).bitwiseOR(piece.bitwiseAND(mask))


def _linked(filed: DataFrame, keys: list[str], most_bits: int) -> DataFrame:
    """Verified links between fingerprints filed under equal keys."""
    a, b = filed.alias("a"), filed.alias("b")
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    close = (F.col("a.fp") < F.col("b.fp")) & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= most_bits)
    return a.join(b.hint("merge"), [*same, close]).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))


def links(distinct: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """``distinct`` (fp) -> a, b: all pairs that differ in at most three bits (a pair may come more than once).

    Spark takes rows of an explode for as few as went in, so by size it would broadcast 64 rows for each of up to some 600,000
    fingerprints from the driver: the joins are told to be merge joins.
    """
    bits = F.explode(F.sequence(F.lit(0), F.lit(63)))
    # Dealt out by number: by size Spark would make one or two tasks of them, each of which would write 64 rows for one.  By a
    # hash of its own: it drops a repartition by the column by which an aggregate has just dealt the rows.
    distinct = distinct.repartition(shuffle_partitions(distinct.sparkSession), F.xxhash64("fp"))
    filed = distinct.select("fp", bits.alias("bit")).select("fp", _without_bit(F.col("fp"), 32, F.col("bit")).alias("key"))
    # An aggregate and a join, not a window: counts combine before the shuffle, and Spark can split a crowded key.
    filed = filed.join(filed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").hint("merge"), "key")
    few = _linked(filed.where(F.col("n") <= crowded).select("key", "fp"), ["key"], MOST_BITS)
    # The other half of a crowded key (above its 32 bits it holds which bit is left out), by its two quarters.
    other = F.call_function("shiftrightunsigned", F.col("fp"), F.when(F.col("key") < 1 << 37, 32).otherwise(0)).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    many = filed.where(F.col("n") > crowded).select("key", "fp", other.alias("other"), F.explode(F.sequence(F.lit(0), F.lit(31))).alias("bit2"))
    many = many.select("key", "fp", _without_bit(F.col("other"), 16, F.col("bit2")).alias("key2"))
    return few.union(_linked(many, ["key", "key2"], MOST_BITS))


def near_duplicates(docs: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, fingerprint (16 hex digits), component_id; one row per input row."""
    prints = cut(fingerprints(docs))
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = components(links(distinct.select("fp"), crowded))
    nodes = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = nodes.join(ids, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """What the pipeline keeps: links of five-word fingerprints, and by shingles what else is 0.8 alike (see ``nearcopies``)."""
    return nearcopies.keep_first(docs, links)
