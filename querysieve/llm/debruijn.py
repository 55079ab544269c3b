"""Substring dedup on a de Bruijn graph of words.

Every ``K`` = 13 consecutive words of a document are an edge between two nodes of 12 words.  A document is a walk;
an edge that starts in several documents is repeated, and its *source* is where it starts in the one of smallest
doc_id.  While a walk's next edge has the next place of the same source document as its source, the path has not
branched: such a run of edges compacts into one row (document, start, source, source start).  The words at both
coordinates are then compared, and the later copy of every confirmed path is removed.

How it runs:

1. ``segments``: the edges of a document are cut into runs that share their least 4-word hash (a minimiser).  Such a
   segment is a stretch of the graph that is compact from the start.  Equal edges share the minimiser, so segments
   meet by it.  Of equal segments the one of smallest id is the source of the others.
2. Segments go to their document.  Those with a source compact where the sources go on in step.  Where one minimiser
   has different segments, the first copy of each is spelled out into single edges, which meet by edge; each gets
   the source of smallest id.
3. Within each document, segments and edges whose sources go on in step compact into paths.
4. The words of every path are compared with those at its source coordinates (a join on the source document).

Skew: before rows leave a batch of documents, of equal segments and of equal edges one goes on and the others have
their source at once; of a minimiser with more than ``VARIANTS`` different segments one row goes on to tell the
others.  What a document repeats within itself goes on once; whatever comes of it holds for its other places, which are
found again in the text at the end.  So what very many documents share sends ``VARIANTS`` rows per batch of documents at
most, not one per document.  A row is known by 87 bits of the SHA-256 of its doc_id and text, so that rows of one
doc_id, or without any, stay apart; only equal rows are one.  The text is shuffled once, compressed.  Words are removed
only where they were compared with those at a source, or with such words of the same document.

Nodes have no rows of their own: a branch shows as a change of source along the walk, and degrees aren't counted.

Edge cases: a null text has no words; fewer words than a window are all kept; words are split at the six ASCII
blanks; a null doc_id ranks after every other, so such rows lose what others have and take nothing; rows that
repeat a doc_id are separate texts neither of which is smaller; equal rows get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from querysieve.llm.common import as_bytes, cut

K, SEED_WORDS = 13, 4
VARIANTS = 4
REMEMBERED = 300_000
LAST = (1 << 63) - 1  # in place of a null doc_id
PLACE_BITS = 40  # a place: 23 bits of the row's hash (64 more are its ``doc``) and a word number
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes) -> list[bytes]:
    return text.split()


class WordHashes(dict):
    """word -> 64-bit hash, for recent words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def runs_hash(h: np.ndarray, width: int, salt: int) -> np.ndarray:
    """A hash of every ``width`` consecutive word hashes."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    factor = np.uint64(salt | 1)
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out *= factor
        out += h[j : j + n]
    out ^= out >> np.uint64(32)
    out *= _MIX
    out ^= out >> np.uint64(29)
    return out


def edges_of(h: np.ndarray, k: int = K) -> np.ndarray:
    return runs_hash(h, k, 0xD1342543DE82EF95)


def seed_runs(h: np.ndarray, k: int = K, seed_words: int = SEED_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one least seed: seed, first window, number of windows."""
    if len(h) < k:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    least, span, want = runs_hash(h, seed_words, 0xA0761D6478BD642F), 1, k - seed_words + 1
    while span < want:
        step = min(span, want - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    starts = np.concatenate(([0], np.flatnonzero(least[1:] != least[:-1]) + 1))
    return least[starts], starts, np.diff(np.concatenate((starts, [len(least)])))


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id as given, the id that ranks, who the row is (doc, and tag as the upper bits of its places), and the text."""
    text, key = F.col("text").cast("string"), F.col("doc_id").cast("long")
    own = docs.select(key.alias("doc_id"), F.coalesce(key, F.lit(LAST)).alias("id"), F.sha2(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))).cast("binary"), 256).alias("digits"), text.alias("text"))
    bits = lambda start, n: F.conv(F.substring("digits", start, n), 16, 10).cast("long")
    low = bits(16, 7)
    doc = F.shiftleft(bits(1, 15), 4).bitwiseOR(F.shiftrightunsigned(low, 24))
    return own.select("doc_id", "id", doc.alias("doc"), F.shiftleft(low.bitwiseAND(F.lit(0x7FFFFF)), PLACE_BITS).alias("tag"), "text")


def _compressed(rows: DataFrame) -> DataFrame:
    """The text as zstd: it is shuffled, and read three times from there."""

    def run(batches):
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            packed = pa.array([packer.compress(t) for t in as_bytes(batch["text"])], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("doc_id", "id", "doc", "tag")), packed], ["doc_id", "id", "doc", "tag", "text"])

    return rows.mapInArrow(run, "doc_id long, id long, doc long, tag long, text binary")


def _texts(column: pa.Array) -> Iterator[bytes]:
    unpacker = zstandard.ZstdDecompressor()
    return (unpacker.decompress(t) for t in column.to_pylist())


ASKS, PATH, OPEN = 0, 1, 2  # what a segment row is: looks for equals; has its source; needs its edges spelled out
SEGMENT_COLUMNS = ["key", "content", "id", "doc", "place", "n", "variants", "kind", "source", "source_place"]


def segments(rows: DataFrame, k: int) -> DataFrame:
    """The segments of all documents (``SEGMENT_COLUMNS``), those of a batch compared with each other already.

    ``key`` is the minimiser, or a hash of its own for a row that needn't meet others; ``content`` a hash of the
    segment's edges; ``variants`` 1 if the batch holds more different segments of the minimiser than it sends.
    """

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            parts = []
            for i, doc, tag, text in zip(*(batch[c].to_pylist() for c in ("id", "doc", "tag")), as_bytes(batch["text"])):
                h = hashes.of(words_of(text))
                seed, at, n = seed_runs(h, k)
                if len(seed):
                    content = np.add.reduceat(edges_of(h, k), at) * _MIX + n.astype(np.uint64)
                    parts.append((seed, content, np.full(len(seed), i, np.int64), np.full(len(seed), doc, np.int64), at + tag, n))
            if parts:
                yield _compared(*(np.concatenate(c) for c in zip(*parts)))

    return rows.select("id", "doc", "tag", "text").mapInArrow(run, ", ".join(f"{c} {'int' if c in ('n', 'variants', 'kind') else 'long'}" for c in SEGMENT_COLUMNS))


def _compared(seed: np.ndarray, content: np.ndarray, ids: np.ndarray, doc: np.ndarray, place: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    order = np.lexsort((place, doc, ids, content, seed))
    seed, content, ids, doc, place, n = (c[order] for c in (seed, content, ids, doc, place, n))
    again = np.concatenate(([False], (seed[1:] == seed[:-1]) & (content[1:] == content[:-1]) & (doc[1:] == doc[:-1]) & (place[1:] >> PLACE_BITS == place[:-1] >> PLACE_BITS)))
    seed, content, ids, doc, place, n = (c[~again] for c in (seed, content, ids, doc, place, n))
    new_seed = np.concatenate(([True], seed[1:] != seed[:-1]))
    new_content = new_seed | np.concatenate(([True], content[1:] != content[:-1]))
    first = np.maximum.accumulate(np.where(new_content, np.arange(len(seed)), 0))  # of equal segments
    group = np.cumsum(new_seed) - 1
    variant = np.cumsum(new_content) - np.cumsum(new_content)[np.flatnonzero(new_seed)][group]  # 0, 1, .. within the seed
    crowded = (np.maximum.reduceat(variant, np.flatnonzero(new_seed)) >= VARIANTS)[group]
    later = ids > ids[first]
    kind = np.where(later, PATH, np.where(crowded & (variant > 0), OPEN, ASKS)).astype(np.int32)
    key = np.where(kind == ASKS, seed, (doc * 31 + place).astype(np.uint64) * _MIX).view(np.int64)
    source, there = (pa.array(c[first], mask=~later) for c in (doc, place))
    columns = [pa.array(key), pa.array(content.view(np.int64)), pa.array(ids), pa.array(doc), pa.array(place), pa.array(n.astype(np.int32)), pa.array((crowded & (kind == ASKS)).astype(np.int32)), pa.array(kind), source, there]
    return pa.RecordBatch.from_arrays(columns, SEGMENT_COLUMNS)


def _tag_of(place: str) -> Column:
    return F.col(place).bitwiseAND(F.lit(-1 << PLACE_BITS)).alias("tag")


def _with_found(rows: DataFrame, found: DataFrame, *columns: str) -> DataFrame:
    """All rows, each with the list of what was found in its text (null: nothing).

    Every use keeps the same columns of the documents, so that the shuffled texts are reused.
    """
    lists = found.groupBy("doc", _tag_of("place")).agg(F.collect_list(F.struct(*columns)).alias("found"))
    return rows.join(lists.hint("shuffle_hash"), ["doc", "tag"], "left").select("doc_id", "id", "doc", "tag", "text", "found")


def _spelled_out(texts: DataFrame, met: DataFrame, k: int) -> DataFrame:
    """Segments that met -> id, doc, place, n and a source (compacted paths), or the edge (those that are still open).

    Of equal edges in a batch the first one stays open, the others have it as their source.
    """

    def run(batches):
        hashes, unpack = WordHashes(), zstandard.ZstdDecompressor().decompress
        for batch in batches:
            order = np.argsort(batch["id"].to_numpy(), kind="stable")
            edge, ids, doc, place, paths = [], [], [], [], []
            lists, all_ids, all_docs, tags, texts = batch["found"], batch["id"].to_pylist(), batch["doc"].to_pylist(), batch["tag"].to_pylist(), batch["text"]
            for row in order.tolist():
                if not lists[row].is_valid:
                    continue
                text, tag = unpack(texts[row].as_py()), tags[row]
                found = lists[row].values
                at, n = found.field("place").to_numpy(), found.field("n").to_numpy().astype(np.int64)
                left = found.field("source").is_null().to_numpy(zero_copy_only=False)
                if (known := ~left).any():
                    source, there = (found.field(c).fill_null(0).to_numpy()[known] for c in ("source", "source_place"))
                    turn = np.argsort(at[known], kind="stable")
                    own = (np.full(len(turn), x[row], np.int64) for x in (all_ids, all_docs))
                    paths.append(_runs(*own, at[known][turn], source[turn], there[turn], n[known][turn]))
                if left.any():
                    e = edges_of(hashes.of(words_of(text)), k)
                    single = np.concatenate([np.arange(a, a + m) for a, m in zip((at[left] - tag).tolist(), n[left].tolist())])
                    single = single[np.sort(np.unique(e[single], return_index=True)[1])]
                    edge.append(e[single])
                    ids.append(np.full(len(single), all_ids[row], np.int64))
                    doc.append(np.full(len(single), all_docs[row], np.int64))
                    place.append(single + tag)
            if edge:
                edge, ids, doc, place = (np.concatenate(c) for c in (edge, ids, doc, place))
                first, inverse = np.unique(edge, return_index=True, return_inverse=True)[1:]
                source = first[inverse]  # ids ascend within the batch
                opened = ids[source] == ids
                none = pa.nulls(int(opened.sum()), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(edge[opened].view(np.int64)), pa.array(ids[opened]), pa.array(doc[opened]), pa.array(place[opened]), pa.array(np.ones(len(none), np.int64)), none, none], EDGE_COLUMNS)
                turn = np.lexsort((place[~opened], doc[~opened]))
                paths.append(_runs(*(c[~opened][turn] for c in (ids, doc, place, doc[source], place[source]))))
            if paths:
                columns = [np.concatenate(c) for c in zip(*paths)]
                yield pa.RecordBatch.from_arrays([pa.nulls(len(columns[0]), pa.int64()), *map(pa.array, columns)], EDGE_COLUMNS)

    return _with_found(texts, met, "place", "n", "source", "source_place").mapInArrow(run, ", ".join(f"{c} long" for c in EDGE_COLUMNS))


EDGE_COLUMNS = ["edge", "id", "doc", "place", "n", "source", "source_place"]


def _runs(ids: np.ndarray, doc: np.ndarray, place: np.ndarray, source: np.ndarray, there: np.ndarray, n: np.ndarray | None = None) -> list[np.ndarray]:
    """Edges (or paths of n) in order of doc and place, compacted where the walk and its source go on in step."""
    n = np.ones(len(ids), np.int64) if n is None else n
    if not len(ids):
        return [ids, doc, place, n, source, there]
    goes_on = (doc[1:] == doc[:-1]) & (place[1:] == place[:-1] + n[:-1]) & (source[1:] == source[:-1]) & (there[1:] == there[:-1] + n[:-1])
    starts = np.concatenate(([0], np.flatnonzero(~goes_on) + 1))
    return [ids[starts], doc[starts], place[starts], np.add.reduceat(n, starts), source[starts], there[starts]]


def _compact(sourced: DataFrame) -> DataFrame:
    """Edges and paths of later documents with their sources -> paths: id, doc, place, n (edges), source, source_place."""
    columns = ["place", "n", "source", "source_place"]
    lists = sourced.groupBy("id", "doc", _tag_of("place")).agg(F.collect_list(F.struct(*columns)).alias("edges"))

    def run(batches):
        for batch in batches:
            for i, doc, edges in zip(batch["id"].to_pylist(), batch["doc"].to_pylist(), batch["edges"]):
                place, n, source, there = (edges.values.field(c).to_numpy() for c in columns)
                order = np.argsort(place, kind="stable")
                paths = _runs(np.full(len(order), i), np.full(len(order), doc), place[order], source[order], there[order], n[order])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in paths], ["id", "doc", *columns])

    return lists.mapInArrow(run, "id long, doc long, place long, n long, source long, source_place long")


def _spelled(texts: DataFrame, paths: DataFrame, k: int) -> DataFrame:
    """The paths with strong hashes of the words that stand at their source coordinates.

    However many documents have a path from one place, its source is asked once.
    """
    paths, at = cut(paths), ["source", "source_place", "n"]
    asked = paths.select(F.col("source").alias("doc"), F.col("source_place").alias("place"), "n").distinct()

    def run(batches):
        for batch in batches:
            out = [[], [], [], []]
            for doc, tag, text, found in zip(batch["doc"].to_pylist(), batch["tag"].to_pylist(), _texts(batch["text"]), batch["found"]):
                if not found.is_valid:
                    continue
                words = words_of(text)
                for f in found.as_py():
                    start = f["place"] - tag
                    for column, value in zip(out, (doc, f["place"], f["n"], spelling(words[start : start + f["n"] + k - 1]))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.binary())], [*at, "spelled"])

    told = _with_found(texts, asked, "place", "n").mapInArrow(run, "source long, source_place long, n long, spelled binary")
    return paths.join(told.groupBy(*at).agg(F.collect_set("spelled").alias("spelled")), at).select("doc", "place", "n", "spelled")


def spelling(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


def repeated_paths(docs: DataFrame, k: int = K) -> DataFrame:
    """``docs`` (doc_id, text) -> the compacted paths of later documents: id, doc, place, n, source (the doc of it), source_place."""
    return _paths(_rows(docs), _compressed(_rows(docs)), k)


def _told(window: WindowSpec) -> Column:
    """Whether the row before has the same place: equal rows of different batches say the same."""
    return F.coalesce((F.lag("doc").over(window) == F.col("doc")) & (F.lag("place").over(window) == F.col("place")), F.lit(False))


def _paths(rows: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    same_seed, equal = Window.partitionBy("key"), Window.partitionBy("key", "content").orderBy("id", "doc", "place")
    met = segments(rows, k).withColumns({"first": F.first("id").over(equal), "first_doc": F.first("doc").over(equal), "first_place": F.first("place").over(equal), "told": _told(equal)})
    met = met.withColumn("several", (F.min("content").over(same_seed) < F.max("content").over(same_seed)) | (F.max("variants").over(same_seed) > 0))
    asks, has_source = F.col("kind") == ASKS, F.col("id") > F.col("first")
    source = F.when(F.col("kind") == PATH, F.col("source")).when(asks & has_source, F.col("first_doc"))
    there = F.when(F.col("kind") == PATH, F.col("source_place")).when(asks & has_source, F.col("first_place"))
    # Held: of all segments, the largest shuffle by far, few are left, and its files go before the texts are shuffled.
    met = cut(met.where((~asks | has_source | F.col("several")) & ~F.col("told")).select("id", "doc", "place", "n", source.alias("source"), there.alias("source_place")))
    # Paths that have their source already are alone under a key of their own.
    meet = Window.partitionBy("key").orderBy("id", "doc", "place")
    edges = _spelled_out(texts, met, k).withColumn("key", F.coalesce("edge", F.xxhash64("doc", "place")))
    edges = edges.withColumns({"first": F.first("id").over(meet), "first_doc": F.first("doc").over(meet), "first_place": F.first("place").over(meet), "told": _told(meet)})
    later = edges.where(~F.col("told") & (F.col("source").isNotNull() | (F.col("id") > F.col("first"))))
    return _compact(later.select("id", "doc", "place", "n", F.coalesce("source", "first_doc").alias("source"), F.coalesce("source_place", "first_place").alias("source_place")))


def deduplicate(docs: DataFrame, k: int = K) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, n_words, n_removed, kept (words joined by a space), spans.

    ``spans``: maximal removed runs as (start, n) in words.
    """
    rows = _rows(docs)
    texts = _compressed(rows)
    confirmed = _spelled(texts, _paths(rows, texts, k), k)

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            n_words, n_removed, kept, spans = [], [], [], []
            for tag, text, found in zip(batch["tag"].to_pylist(), _texts(batch["text"]), batch["found"]):
                words = words_of(text)
                windows = np.zeros(max(0, len(words) - k + 1), bool)
                for f in found.as_py() or []:
                    at = f["place"] - tag
                    if spelling(words[at : at + f["n"] + k - 1]) in f["spelled"]:
                        windows[at : at + f["n"]] = True
                gone = np.zeros(len(words) + 1, np.int8)
                if windows.any():
                    e = edges_of(hashes.of(words), k)
                    starts = _everywhere(words, e, windows, k)
                    steps = np.bincount(starts, minlength=len(words) + 1) - np.bincount(starts + k, minlength=len(words) + 1)
                    gone[:-1] = np.cumsum(steps)[:-1] > 0
                edges = np.flatnonzero(np.diff(gone, prepend=0))
                spans.append([{"start": a, "n": b - a} for a, b in edges.reshape(-1, 2).tolist()])
                n_words.append(len(words))
                n_removed.append(int(gone.sum()))
                kept.append(b" ".join(w for w, g in zip(words, gone.tolist()) if not g) if n_removed[-1] else b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("n", pa.int64())])))],
                ["doc_id", "n_words", "n_removed", "kept", "spans"],
            )

    return _with_found(texts, confirmed, "place", "n", "spelled").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string, spans array<struct<start:long,n:long>>")


def _everywhere(words: list[bytes], e: np.ndarray, windows: np.ndarray, k: int) -> np.ndarray:
    """Confirmed windows, and those of the same words elsewhere in the document (found by hash, then compared)."""
    confirmed = np.flatnonzero(windows)
    known, first = np.unique(e[confirmed], return_index=True)
    other = np.flatnonzero(np.isin(e, known) & ~windows)
    like = confirmed[first[np.searchsorted(known, e[other])]]
    same = [words[a : a + k] == words[b : b + k] for a, b in zip(other.tolist(), like.tolist())]
    return np.concatenate((confirmed, other[np.array(same, bool)]))


def digests(docs: DataFrame, k: int = K) -> DataFrame:
    return deduplicate(docs, k).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
