"""Near copies by content: all pairs of documents whose five-word shingles have a Jaccard similarity of 0.8 or more.

No 64-bit fingerprint can promise that (0.8 is ten differing bits on average, twenty now and then), so documents
meet in keys made from the shingles themselves, and every pair that meets is confirmed on whole shingle sets.

Keys: sort the hashes of a set of ``a`` shingles and take every three neighbours as one gram.  With x shingles only in
A and y only in B, a similarity of 0.8 means 5x + 4y <= a.  A shingle that B lacks breaks at most three grams of A, one
that only B has at most two, so at most 3a/5 grams break.  Of any global order of grams the first 3a/5 + 1 of A and
3b/5 + 1 of B then have one in common (prefix filter): no pair is lost, and documents that share a passage only
seldom share three neighbours.  Sets of at most ``FEW`` shingles (``LEAST`` to ``FEW``: also) meet in single shingles,
the first a/5 + 1; a pair is always in reach of one of the two kinds.

Order: what many documents of a sample share (a license, a common line) comes last, so that it is a key only of
documents that consist of it.  The order only decides who is compared, never what is found.

SimHash comes first, where its links are given (``simhash.keep_first``): documents of equal fingerprints, or of fingerprints of
three differing bits at most, are confirmed and joined, and keys only bring together what three bits can't.

Large groups: who meets in a key is first compared with the least of them only, which then leaves the key; this goes on while
all pairs in keys are more than the documents, at most ``MOST_STARS`` times.  After that only documents of different components
are compared, so a group of near copies costs about its size and not its square.  Keys in which the same documents are left
are one key.  Only pairs whose parities (a lower bound of what they differ in) allow 0.8 are compared at all.

Crowded keys: where more than ``CROWD`` documents of different components are left in a key (pages of one template, say),
they are filed again, by single shingles in order of how many of them have each: the a/5 + 1 rarest of every set (the prefix
filter of Vernica, Carey and Li 2010).  What the template gives comes last there, and only documents that are alike in what
is their own meet.  Keys fill up as a corpus grows; the limit is low, so that about the same share of all documents is filed again
at any size (with 64, five times the documents had 16 times the shingles to file), each once.

Rows are told apart by doc_id and a 64-bit hash of the text, sets of shingles by one of the set; such hashes are taken as
equal without comparing texts.

Edge cases: fewer words than a shingle make one shingle; null and wordless texts are copies of each other; rows that
repeat a doc_id are documents of their own; a null doc_id ranks after every other, so such a row stays only where no
other of its component has an id; of rows equal in id and text one stays.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from querysieve.llm.common import as_bytes, cut, let_go, slices
from querysieve.llm.components import components

SHINGLE, SEED = 5, 42
LEAST, FEW = 8, 12
SAMPLE, COMMON = 8_000, 6  # documents looked at for common keys, and of how many of them a key is common
CROWD = 4  # documents in a key in which different components are left; beyond they are filed again
MOST_STARS = 3  # rounds in which who meets in a key is compared with the least only
MOST_SENT = 500_000  # ids of documents to compare that are broadcast
Links = Callable[[DataFrame], DataFrame]  # fp -> a, b: linked fingerprints, a < b
BINS = [f"p{k}" for k in range(32)]  # 2,048 bins
LAST = (1 << 63) - 1  # in place of a null doc_id
NONE = np.empty(0, np.uint64)
ODD = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD)]


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of the word shingles."""
    words = text.lower().split()  # bytes: A-Z only, and splits at the six ASCII blanks
    if not words:
        return NONE
    parts = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)))) if len(words) >= SHINGLE else [b" ".join(words)]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(p, SEED) for p in parts), np.uint64))


def node_of(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes(), SEED)


def _mixed(found: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """All single shingles or grams of a set, each kind with how many of it are enough."""
    a = len(found)
    kinds = [(found * ODD[3], a // 5 + 1)] if 0 < a <= FEW else []
    if a >= LEAST:
        grams = found[:-2] * ODD[0] + (found[1:-1] ^ found[1:-1] >> np.uint64(31)) * ODD[1] + (found[2:] ^ found[2:] >> np.uint64(29)) * ODD[2]
        kinds.append(((grams ^ grams >> np.uint64(33)) * ODD[3], 3 * a // 5 + 1))
    return kinds


def keys(found: np.ndarray, common: np.ndarray = NONE) -> np.ndarray:
    """The keys in which a set meets every set of similarity 0.8 or more; ``common`` ones (sorted) only if need be."""
    made = [NONE]
    for all_of, enough in _mixed(found):
        rare = all_of
        if len(common):
            often = common[np.minimum(np.searchsorted(common, all_of), len(common) - 1)] == all_of
            rare = all_of[~often]
            if len(rare) < enough:
                made.append(np.sort(all_of[often])[: enough - len(rare)])
        made.append(np.partition(rare, enough - 1)[:enough] if enough < len(rare) else rare)
    return np.concatenate(made)


def parity(found: np.ndarray) -> np.ndarray:
    """Shingles counted in 64 x ``BINS`` bins, each modulo 2: two sets differ in at least as many shingles as their bins do."""
    return np.packbits(np.bincount((found & np.uint64(64 * len(BINS) - 1)).astype(np.int64), minlength=64 * len(BINS)) & 1 == 1).view(np.int64)


def majority(found: np.ndarray) -> int:
    """The SimHash fingerprint of a set of shingles: a bit is 1 if it is in over half of the hashes."""
    ones = np.unpackbits(found.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(found), bitorder="little").view(np.int64)[0])


def _keyed(docs: DataFrame, *carried: Column) -> DataFrame:
    """id (what ranks), th (the text's hash) and the text; and what else is to be carried."""
    text = F.col("text").cast("string")
    return docs.select(*carried, F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))


def _nodes(docs: DataFrame) -> DataFrame:
    """id, th, node, fp (fingerprint), n (shingles) and their parity; equal sets of shingles are one node."""

    def run(batches):
        let_go()
        for batch in slices(batches, 1000):
            found = [shingles(t) for t in as_bytes(batch["text"])]
            nodes = np.array([node_of(f) for f in found], np.uint64).view(np.int64)
            bins = np.array([parity(f) for f in found]).reshape(-1, len(BINS))
            columns = [nodes, np.array([majority(f) for f in found], np.int64), np.array([len(f) for f in found], np.int32), *np.ascontiguousarray(bins.T)]
            yield pa.RecordBatch.from_arrays([batch["id"], batch["th"], *(pa.array(c) for c in columns)], ["id", "th", "node", "fp", "n", *BINS])

    return docs.mapInArrow(run, f"id long, th long, node long, fp long, n int, {' long, '.join(BINS)} long")


def _common(docs: DataFrame, rows: int) -> np.ndarray:
    """Keys of many documents, found in about ``SAMPLE`` of them; there are at most keys of the sample / ``COMMON``."""
    share = min(1.0, SAMPLE / max(rows, 1))

    def run(batches):
        for batch in slices(batches, 1000):
            made = [all_of for text in as_bytes(batch["text"]) for all_of, _ in _mixed(shingles(text))]
            found, times = np.unique(np.concatenate([NONE, *made]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(times)], ["key", "n"])

    counted = docs.where(F.pmod(F.xxhash64("id", "th"), F.lit(1 << 20)) < share * (1 << 20)).mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return np.sort(np.array([r["key"] for r in cut(counted.where(F.col("n") >= COMMON).select("key")).collect()], np.int64).view(np.uint64))


def _filed(docs: DataFrame, common: np.ndarray) -> DataFrame:
    """key, node; copies within a task are filed once."""

    sent = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches):
        seen: set[int] = set()
        for batch in slices(batches, 200):
            made, nodes = [NONE], []
            for text in as_bytes(batch["text"]):
                found = shingles(text)
                node = node_of(found)
                if node not in seen:
                    seen.add(node)
                    made.append(keys(found, sent.value))
                    nodes.append(node)
            times = [len(k) for k in made[1:]]
            columns = [np.concatenate(made).view(np.int64), np.repeat(np.array(nodes, np.uint64), times).view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "node"])

    return docs.mapInArrow(run, "key long, node long")


def _sets(docs: DataFrame) -> DataFrame:
    """node, hashes."""

    def run(batches):
        for batch in slices(batches, 200):
            found = [shingles(t) for t in as_bytes(batch["text"])]
            nodes = np.array([node_of(f) for f in found], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array([f.view(np.int64) for f in found], pa.list_(pa.int64()))], ["node", "hashes"])

    return docs.mapInArrow(run, "node long, hashes array<long>")


def _possible(x: str, y: str) -> Column:
    """Whether sizes and parities allow two nodes a similarity of 0.8."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    differ = [F.bit_count(F.col(f"{x}.{p}").bitwiseXOR(F.col(f"{y}.{p}"))) for p in BINS]
    return (5 * F.least(n, m) >= 4 * F.greatest(n, m)) & (9 * sum(differ[1:], differ[0]) <= n + m)


def _sets_of(wanted: DataFrame, docs: DataFrame, each: DataFrame, most_sent: int) -> DataFrame:
    """node, hashes of the wanted nodes; up to ``most_sent`` ids are broadcast, beyond the texts are shuffled."""
    ids = cut(each.join(wanted, "node", "left_semi").select("id", "th"))
    ids = F.broadcast(ids) if ids.count() <= most_sent else ids
    return _sets(docs.join(ids, ["id", "th"], "left_semi")).dropDuplicates(["node"])


def _confirmed(pairs: DataFrame, docs: DataFrame, each: DataFrame, most_sent: int) -> DataFrame:
    """The pairs (a, b) of similarity 0.8 or more."""
    sets = _sets_of(pairs.select(F.col("a").alias("node")).union(pairs.select("b")), docs, each, most_sent)
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("ha")), "a").join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("hb")), "b")
    return cut(both.where(9 * F.size(F.array_intersect("ha", "hb")) >= 4 * (F.size("ha") + F.size("hb"))).select("a", "b"))


def _refiled(sets: DataFrame) -> DataFrame:
    """key, node: the rarest a/5 + 1 shingles of every set, by how many of these sets have each."""
    single = sets.select("node", F.explode("hashes").alias("key"))
    counts = single.groupBy("key").agg(F.count("*").alias("times"))
    # A merge join by name: Spark sizes exploded rows as the sets they come from, which could be few enough to broadcast.
    ranked = single.join(counts.hint("merge"), "key").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("times", "key"))).alias("ranked"))
    return ranked.select("node", F.explode(F.expr("slice(ranked, 1, size(ranked) div 5 + 1)")).alias("x")).select(F.col("x.key").alias("key"), "node")


def _close(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of rows (key, node, root, n, parity) of one key and different roots that can be 0.8 alike."""
    x, y = rows.alias("x"), rows.alias("y")
    close = (F.col("x.node") < F.col("y.node")) & (F.col("x.root") != F.col("y.root")) & _possible("x", "y")
    return x.join(y, [F.col("x.key") == F.col("y.key"), close]).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def _close_in_keys(apart: DataFrame, docs: DataFrame, each: DataFrame, crowd: int, most_sent: int) -> DataFrame:
    """Pairs that meet in a key; who meets in a crowded one is filed again first."""
    crowded = cut(apart.groupBy("key").agg(F.count("*").alias("members")).where(F.col("members") > crowd).select("key"))
    if crowded.isEmpty():
        return _close(apart)
    again = cut(apart.join(crowded, "key", "left_semi").drop("key").dropDuplicates(["node"]))
    sets = cut(_sets_of(again.select("node"), docs, each, most_sent))
    refiled = _distinct_keys(_refiled(sets).join(again.select("node", "root"), "node"))
    return _close(apart.join(crowded, "key", "left_anti")).union(_close(cut(refiled.drop("root").join(again, "node")))).distinct()


def _by_fingerprint(each: DataFrame, links: Links, docs: DataFrame, most_sent: int) -> DataFrame:
    """Confirmed pairs (a, b) whose SimHash fingerprints are equal or linked: one for each node that has any."""
    named = cut(each.groupBy("fp").agg(F.min("node").alias("least")))
    same = each.join(named, "fp").where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    near = links(named.select("fp")).groupBy("b").agg(F.min("a").alias("a"))  # ``a`` is the smaller of a link
    near = near.join(named.select(F.col("fp").alias("a"), F.col("least").alias("x")), "a").join(named.select(F.col("fp").alias("b"), F.col("least").alias("y")), "b")
    pairs = same.union(near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))).distinct()
    return _confirmed(_possible_pairs(pairs, each), docs, each, most_sent)


def _possible_pairs(pairs: DataFrame, each: DataFrame) -> DataFrame:
    both = pairs.join(each.alias("x"), F.col("a") == F.col("x.node")).join(each.alias("y"), F.col("b") == F.col("y.node"))
    return cut(both.where(_possible("x", "y")).select("a", "b"))


def _joined(roots: DataFrame, pairs: DataFrame) -> DataFrame:
    """Components ``roots`` (node, root) joined by ``pairs`` (a, b) -> node, root; held."""
    return cut(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(pairs)))


def _apart(met: DataFrame, roots: DataFrame, most_sent: int) -> DataFrame:
    """``met`` (key, node) -> key, node, root: keys in which different components meet, see ``_distinct_keys``."""
    roots = F.broadcast(roots) if roots.count() <= most_sent else roots
    return _distinct_keys(met.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")))


def _distinct_keys(rooted: DataFrame) -> DataFrame:
    """Of (key, node, root) the keys in which roots differ, and of keys with the same nodes one.

    Documents that share a passage share all its keys: they are to be compared once.  Sets of nodes are told apart by 128 bits.
    """
    members = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"m{k}") for k in range(2)]
    told = rooted.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most"), *members)
    one = told.where("least < most").groupBy("m0", "m1").agg(F.min("key").alias("key")).select("key")
    return cut(rooted.join(one, "key", "left_semi"))


def _rooted(docs: DataFrame, crowd: int = CROWD, most_sent: int = MOST_SENT, links: Links | None = None) -> DataFrame:
    """``docs`` from ``_keyed`` -> id, th and root (of the component); one row per row."""
    prints = cut(_nodes(docs))
    n = prints.count()
    each = cut(prints.dropDuplicates(["node"]))  # with the id and hash of a row of each
    roots = each.select("node", F.col("node").alias("root")).limit(0)
    if links:
        roots = _joined(roots, _by_fingerprint(each, links, docs, most_sent))
    bare, by_key = each.drop("id", "th", "fp"), Window.partitionBy("key")
    met = _filed(docs, _common(docs, n)).withColumn("least", F.min("node").over(by_key)).withColumn("most", F.max("node").over(by_key))
    met = cut(met.where("least < most").select("key", "node"))
    for _ in range(MOST_STARS):
        apart = _apart(met, roots, most_sent)
        pairs = apart.groupBy("key").agg(F.count("*").cast("double").alias("m")).agg(F.sum(F.expr("m * (m - 1) / 2"))).first()[0] or 0
        if pairs <= n:
            break
        first = apart.withColumn("first", F.min(F.struct("node", "root")).over(by_key)).where("node <> first.node")
        star = first.where("root <> first.root").select(F.col("first.node").alias("a"), F.col("node").alias("b")).distinct()
        roots = _joined(roots, _confirmed(_possible_pairs(star, bare), docs, each, most_sent))
        met = cut(first.select("key", "node"))  # the first of a key has been compared with all others
    else:
        apart = _apart(met, roots, most_sent)
    # Who met in a key and is still in different components.
    apart = cut(apart.join(bare, "node"))
    second = cut(_close_in_keys(apart, docs, each, crowd, most_sent))
    roots = _joined(roots, _confirmed(second, docs, each, most_sent))
    rows = prints.select("id", "th", "node").join(F.broadcast(roots) if roots.count() <= most_sent else roots, "node", "left")
    return cut(rows.select("id", "th", F.coalesce("root", "node").alias("root")))


def near_copies(docs: DataFrame, crowd: int = CROWD, most_sent: int = MOST_SENT) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, component_id (its smallest doc_id; null if no row has one); one row per row."""
    rows = _rooted(_keyed(docs), crowd, most_sent)
    found = rows.join(rows.groupBy("root").agg(F.min("id").alias("component_id")), "root")
    return found.select(*[F.nullif(F.col(c), F.lit(LAST)).alias(name) for c, name in (("id", "doc_id"), ("component_id", "component_id"))])


def keep_first(docs: DataFrame, links: Links | None = None) -> DataFrame:
    """One row of every component of ``docs``, that of the smallest doc_id; all columns stay.  ``links``: see above."""
    keyed = _keyed(docs, F.struct(*[f"`{c}`" for c in docs.columns]).alias("doc"))
    rows = _rooted(keyed.select("id", "th", "text"), links=links)
    first = rows.groupBy("root").agg(F.min(F.struct("id", "th")).alias("first"))
    told = cut(rows.join(first, "root").groupBy("id", "th").agg(F.min(F.struct("id", "th") == F.col("first")).alias("stays"), F.count("*").alias("times")))
    kept = keyed.join(told.where("not stays").select("id", "th"), ["id", "th"], "left_anti")
    again = told.where("stays and times > 1").select("id", "th")
    if not again.isEmpty():
        once = kept.join(again, ["id", "th"], "left_semi").dropDuplicates(["id", "th"])
        kept = kept.join(again, ["id", "th"], "left_anti").unionByName(once)
    return kept.select("doc.*")
