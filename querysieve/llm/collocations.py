"""Phrases whose words occur together, by naming pairs level by level.

Texts are cut into chunks of a few megabytes, each of one language: the words as numbers of the chunk's own list, with
breaks where a phrase may not go on.  A level counts what all chunks hold, keeps what is frequent in the whole language and
gives it an id; the ids are joined back to the chunks that hold it.  The next level pairs neighbours there: a phrase of k+1
words is the pair of its first and its last k words, both frequent themselves.  So every phrase points to two parents, and a
few joins along these pointers give the frequencies of all parts at all cuts, and what longer phrase covers a shorter one.

Counting is dealt by ranges of a hash, as many as keep a range at ``PAIRS`` words of the corpus.  A chunk sends each range its
distinct words or pairs as one compressed message, a task counts a range with numpy, and answers each chunk with the places
and ids of what is frequent.  An entry is in one message of a chunk at most, so even a phrase that every text holds is a
small part of its range.  The text itself is never shuffled after the first step, its numbers once a level.

Edge cases: a null text counts as empty, a null language as ``und``; repeated rows count each; doc_ids aren't read, nor are
other columns; an empty table gives no rows; a text of any length is cut into chunks at breaks between pieces (a single
piece longer than a chunk is a chunk of its own).
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querysieve.llm.common import ensure_checkpoint_dir, remove, slices, store

CHUNK = 4_000_000  # bytes of text
LEAST, COVERED, TOP, LONGEST = 30, 80, 2000, 4
SCALE = 2_000_000
SALTS = 32  # groups per language in which phrases are ranked first
PAIRS = 2_000_000  # words of the corpus per range: a task counts what falls into one range
RANGES = 64  # at least
CHUNKS = "chunk long, lang string, ids binary, words binary, counts binary, total long"
MESSAGES = "range int, chunk long, lang string, first long, names binary, counts binary"
COUNTED = "chunk long, places binary, ids binary, id long, f long, lang string, word string, left long, right long"

BREAKS = (b".", b",", b";", b":", b"!", b"?", b"\n", b"\x0b", b"\x0c", b"\r")
# A-Z to a-z, signs that end a piece to line feeds, tabs to blanks.
_PLAIN = bytes(10 if bytes([b]) in BREAKS else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))


def packed(numbers: np.ndarray) -> bytes:
    """Whole numbers in few bytes: count, then the first bytes of all, the second bytes of all and so on, compressed."""
    planes = np.ascontiguousarray(numbers, np.int64).view(np.uint8).reshape(-1, 8).T
    return len(numbers).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], 8 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view(np.int64).ravel()


def packed_words(words: list[bytes]) -> bytes:
    """Words hold no line feed."""
    text = b"\n".join(words)
    return len(text).to_bytes(8, "little") + pa.compress(text, codec="zstd", asbytes=True)


def unpacked_words(data: bytes) -> list[bytes]:
    size = int.from_bytes(data[:8], "little")
    return pa.decompress(data[8:], size, codec="zstd", asbytes=True).split(b"\n") if size else []


def framed(ids: np.ndarray) -> bytes:
    """Runs of breaks become one."""
    gap = ids < 0
    keep = np.ones(len(ids), bool)
    keep[1:] = ~(gap[1:] & gap[:-1])
    return packed(ids[keep])


def encoded(texts: list[bytes]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Word numbers in order (-1 for a break), the words, and how often each occurs."""
    data = b"\n".join(texts).translate(_PLAIN).replace(b"\n", b" \n ")
    tokens = pc.split_pattern(pa.array([data], pa.large_binary()), b" ").flatten().dictionary_encode()
    ids, words = tokens.indices.to_numpy(zero_copy_only=False), tokens.dictionary
    blank, gap = (np.asarray(pc.equal(words, pa.scalar(x, words.type)).to_numpy(zero_copy_only=False), bool) for x in (b"", b"\n"))
    number = np.cumsum(~(blank | gap)) - 1
    number[gap] = -1
    ids = number[ids[~blank[ids]]]
    real = words.filter(pa.array(~(blank | gap))).to_pylist()
    return ids, real, np.bincount(ids[ids >= 0], minlength=len(real))


def spread(words: list[bytes], lang: str) -> np.ndarray:
    """32-bit hashes of words, other ones in each language."""
    salt = zlib.crc32(lang.encode())
    return np.array([zlib.crc32(w, salt) for w in words], np.int64)


def _segments(text: bytes, size: int) -> Iterator[bytes]:
    """The text in parts of about ``size`` bytes at most, cut at breaks."""
    at = 0
    while len(text) - at > size:
        cut = max(text.rfind(sign, at, at + size) for sign in BREAKS)
        if cut < 0:
            cut = min((e for sign in BREAKS if (e := text.find(sign, at + size)) >= 0), default=len(text))
        yield text[at : cut + 1]
        at = cut + 1
    if at < len(text):
        yield text[at:]


def _chunk(batches: Iterator[pa.RecordBatch], size: int = CHUNK) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}

    def flush(lang: str) -> pa.RecordBatch:
        sizes.pop(lang)
        ids, words, counts = encoded(held.pop(lang))
        order = np.argsort(spread(words, lang), kind="stable")  # the order of ranges, whatever their number
        place = np.empty(len(order) + 1, np.int64)
        place[order], place[-1] = np.arange(len(order)), -1
        ids, words, counts = place[ids], [words[k] for k in order], counts[order]
        row = [uuid.uuid4().int & (1 << 62) - 1, lang, framed(ids), packed_words(words), packed(counts), int(counts.sum())]
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, _types(CHUNKS))], names=_names(CHUNKS))

    for batch in slices(batches, 256):
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].cast(pa.large_binary())):
            for part in _segments(text.as_py() or b"", size):
                if sizes.get(lang, 0) + len(part) > size and sizes.get(lang):
                    yield flush(lang)
                held.setdefault(lang, []).append(part)
                sizes[lang] = sizes.get(lang, 0) + len(part)
                if sum(sizes.values()) > 4 * size:
                    yield flush(max(sizes, key=sizes.get))
    for lang in list(held):
        yield flush(lang)


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _types(schema: str) -> list[pa.DataType]:
    known = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    return [known[x.split()[1]] for x in schema.split(", ")]


def _batch(schema: str, columns: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _types(schema))], names=_names(schema))


def _by_range(of: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Ranges in ascending order -> range, start and end of its entries."""
    starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.empty(0, np.int64)
    yield from zip(of[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(of)])


def _word_messages(batches: Iterator[pa.RecordBatch], ranges: int) -> Iterator[pa.RecordBatch]:
    """Chunks -> their words and counts, a row per range; ``first`` is the number of its first word."""
    for batch in slices(batches, 1):
        chunk, lang, words, counts = (batch[c][0].as_py() for c in ("chunk", "lang", "words", "counts"))
        words, counts = unpacked_words(words), unpacked(counts)
        of = spread(words, lang) * ranges >> 32
        rows = [(r, chunk, lang, a, packed_words(words[a:b]), packed(counts[a:b])) for r, a, b in _by_range(of)]
        yield _batch(MESSAGES, [list(c) for c in zip(*rows)] if rows else [[] for _ in range(6)])


def _paired(batch: pa.RecordBatch, ranges: int) -> tuple[np.ndarray, ...]:
    """One chunk: its pairs of frequent neighbours by range, parents and number, and the pair that starts at each place.

    The order is that of range and parents, so that both passes over a chunk number its pairs alike.
    """
    ids, known = unpacked(batch["ids"][0].as_py()), batch["known"].flatten()
    places = [unpacked(x) for x in known.field(0).to_pylist()]
    names = np.concatenate([unpacked(x) for x in known.field(1).to_pylist()] or [np.empty(0, np.int64)])
    at = np.concatenate(places or [np.empty(0, np.int64)])
    named = np.full(max(int(ids.max(initial=-1)), int(at.max(initial=-1))) + 2, -1, np.int64)  # the last place is that of breaks
    named[at] = names
    here = named[ids]
    both = (here[:-1] >= 0) & (here[1:] >= 0)
    left, right = here[:-1][both], here[1:][both]
    mixed = (left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (right.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    of = ((mixed ^ (mixed >> np.uint64(32))) % np.uint64(ranges)).astype(np.int64)
    order = np.lexsort((right, left, of))
    left, right, of = left[order], right[order], of[order]
    new = np.ones(len(order), bool)
    new[1:] = (left[1:] != left[:-1]) | (right[1:] != right[:-1])
    starts = np.flatnonzero(new)
    after = np.full(len(both), -1, np.int64)
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    after[both] = number
    return of[starts], left[starts], right[starts], np.diff(np.r_[starts, len(order)]), after


def _pair_messages(batches: Iterator[pa.RecordBatch], ranges: int) -> Iterator[pa.RecordBatch]:
    """Chunks with the ids of what is frequent in them -> their pairs of neighbours with counts, a row per range."""
    for batch in slices(batches, 1):
        of, left, right, counts, _ = _paired(batch, ranges)
        chunk, lang = batch["chunk"][0].as_py(), batch["lang"][0].as_py()
        rows = [(r, chunk, lang, a, packed(np.r_[left[a:b], right[a:b]]), packed(counts[a:b])) for r, a, b in _by_range(of)]
        yield _batch(MESSAGES, [list(c) for c in zip(*rows)] if rows else [[] for _ in range(6)])


def _pair_chunks(batches: Iterator[pa.RecordBatch], ranges: int) -> Iterator[pa.RecordBatch]:
    """The same chunks with pairs in place of what they were made of."""
    for batch in slices(batches, 1):
        after = framed(_paired(batch, ranges)[-1])
        yield pa.RecordBatch.from_arrays([batch["chunk"], batch["lang"], pa.array([after], pa.binary())], names=["chunk", "lang", "ids"])


def _count(table: pa.Table, least: int, ranges: int, words: bool) -> pa.Table:
    """All messages of one range: what is frequent, a row each, and to each chunk the places and ids of what it holds of that."""
    table = table.combine_chunks().sort_by("chunk")
    langs, chunks, first, spread = (table[c].to_pylist() for c in ("lang", "chunk", "first", "range"))
    counts = [unpacked(x) for x in table["counts"].to_pylist()]
    sizes = np.array([len(c) for c in counts], np.int64)
    number, n = {x: k for k, x in enumerate(sorted(set(langs)))}, np.concatenate(counts)
    lang = np.repeat([number[x] for x in langs], sizes)
    if words:
        tokens = pa.array([w for x in table["names"].to_pylist() for w in unpacked_words(x)], pa.large_binary())
        names = pc.unique(tokens)
        order = pc.array_sort_indices(names).to_numpy()
        place = np.empty(len(names), np.int64)
        place[order] = np.arange(len(names))
        key, other = place[pc.index_in(tokens, names).to_numpy()], lang
    else:
        halves = [unpacked(x).reshape(2, -1) for x in table["names"].to_pylist()]
        key, other = (np.concatenate([h[k] for h in halves]) for k in (0, 1))
    by = np.lexsort((other, key))
    new = np.ones(len(by), bool)
    new[1:] = (key[by][1:] != key[by][:-1]) | (other[by][1:] != other[by][:-1])
    starts = np.flatnonzero(new)
    total = np.add.reduceat(n[by], starts) if len(by) else np.empty(0, np.int64)
    kept = np.flatnonzero(total >= least)
    named = np.full(len(starts), -1, np.int64)
    named[kept] = np.arange(len(kept)) * ranges + spread[0]
    ids = np.empty(len(by), np.int64)
    ids[by] = named[np.cumsum(new) - 1]
    some = by[starts[kept]]
    spoken = sorted(number)
    empty = [None] * len(kept)
    text = [names[int(order[k])].as_py().decode() for k in key[some]] if words else empty
    pairs = [empty, empty] if words else [key[some].tolist(), other[some].tolist()]
    rows = [(None, None, None, *x) for x in zip(named[kept].tolist(), total[kept].tolist(), [spoken[k] for k in lang[some]], text, *pairs)]
    ends = np.cumsum(sizes)
    for k, (end, size) in enumerate(zip(ends.tolist(), sizes.tolist())):
        own = ids[end - size : end]
        if len(at := np.flatnonzero(own >= 0)):
            rows.append((chunks[k], packed(at + first[k]), packed(own[at]), *[None] * 6))
    return pa.Table.from_batches([_batch(COUNTED, [list(c) for c in zip(*rows)] if rows else [[] for _ in range(9)])])


def _counted(messages: DataFrame, least: int, ranges: int, words: bool, folder: str) -> tuple[DataFrame, DataFrame]:
    """What is frequent, and per chunk the ids of what it holds of that (``known``)."""

    def count(table: pa.Table) -> pa.Table:
        return _count(table, least, ranges, words)

    found = store(messages.groupBy("range").applyInArrow(count, COUNTED), folder)
    known = found.where("chunk is not null").groupBy("chunk").agg(F.collect_list(F.struct("places", "ids")).alias("known"))
    return found.where("chunk is null").select("id", "f", "lang", "word", "left", "right"), known


def _longer(pairs: DataFrame, shorter: DataFrame) -> DataFrame:
    """Pairs -> id, f, lang, phrase, last, the frequencies of all proper starts and ends, and the parents."""
    left = shorter.select(F.col("id").alias("left"), F.col("phrase").alias("start"), F.concat("starts", F.array("f")).alias("starts"))
    right = shorter.select(F.col("id").alias("right"), "last", F.concat(F.array("f"), "ends").alias("ends"))
    joined = pairs.join(left, "left").join(right, "right")
    return joined.select("id", "f", "lang", F.concat_ws(" ", "start", "last").alias("phrase"), "last", "starts", "ends", "left", "right")


def lowest_cut(a: Column, starts: Column, ends: Column) -> Column:
    """The cut of least score, of equal ones the first: struct of score, k, l and r; exact for any 64-bit counts."""

    def cut(left: Column, k: Column) -> Column:
        right = F.element_at(ends, k + 1)
        wide = lambda x: x.cast("decimal(20,0)")
        product, whole = wide(a) * F.lit(SCALE).cast("decimal(8,0)"), wide(left) + wide(right)
        return F.struct(F.call_function("div", product, whole).alias("score"), k.alias("k"), left.alias("l"), right.alias("r"))

    return F.array_min(F.transform(starts, cut))


def collocations(docs: DataFrame, least: int = LEAST, covered: int = COVERED, top: int = TOP, longest: int = LONGEST, chunk: int = CHUNK, pairs: int = PAIRS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of 2 to ``longest`` words.

    A candidate occurs ``least`` times or more; its score is that of its lowest cut; one that lies in a longer candidate
    with at least ``covered`` percent of its frequency goes.
    """
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/collocations-{uuid.uuid4().hex}"
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")).where("text <> ''")
    chunks = store(texts.mapInArrow(partial(_chunk, size=chunk), CHUNKS), f"{folder}/1/chunks")
    totals = store(chunks.groupBy("lang").agg(F.sum("total").alias("n")), f"{folder}/totals")
    ranges = max(RANGES, -(-(totals.agg(F.sum("n")).first()[0] or 0) // pairs))
    words = chunks.select("chunk", "lang", "words", "counts").mapInArrow(partial(_word_messages, ranges=ranges), MESSAGES)
    frequent, known = _counted(words, least, ranges, True, f"{folder}/1/counted")
    level = frequent.select("id", "f", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), *[F.array().cast("array<long>").alias(c) for c in ("starts", "ends")])
    numbered, levels = chunks.select("chunk", "lang", "ids"), []
    for k in range(2, longest + 1):
        joined = numbered.join(known, "chunk").select("chunk", "lang", "ids", "known")
        frequent, known_next = _counted(joined.mapInArrow(partial(_pair_messages, ranges=ranges), MESSAGES), least, ranges, False, f"{folder}/{k}/counted")
        if k < longest:
            numbered = store(joined.mapInArrow(partial(_pair_chunks, ranges=ranges), "chunk long, lang string, ids binary"), f"{folder}/{k}/chunks")
        remove(spark, f"{folder}/{k - 1}/chunks")
        known, level = known_next, store(_longer(frequent, level), f"{folder}/{k}/phrases")
        levels.append(level)
    found = None
    for shorter, longer in zip(levels, [*levels[1:], None]):
        kept = shorter
        if longer is not None:  # a phrase of two words more is in one of one word more that is as frequent at least
            inside = longer.select(F.explode(F.array("left", "right")).alias("id"), F.col("f").alias("most")).groupBy("id").agg(F.max("most").alias("most"))
            kept = shorter.join(inside, "id", "left").where(F.coalesce(F.col("most") * 100 < F.col("f") * covered, F.lit(True)))
        rows = kept.select("lang", "phrase", F.col("f").alias("a"), lowest_cut(F.col("f"), F.col("starts"), F.col("ends")).alias("cut"))
        found = rows if found is None else found.unionByName(rows)
    found = found.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # Ranked in parts first, so that no task sorts all phrases of a language.
    parts = found.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    first = parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    best = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
