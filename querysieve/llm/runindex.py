"""Suffix-array dedup of bytes on a run-length index.

Every byte covered by a ``LENGTH`` = 200 byte string that also starts anywhere else is removed.

The index.  ``RunIndex`` sorts the suffixes of a set of byte strings, keeps their Burrows-Wheeler transform as
runs of equal bytes and the text positions at both ends of every run.  Only at those ends is a match with the
neighbouring suffix measured; along the text between them a match is one byte shorter per step, so the longest
match of every position streams from the samples.  The more repetitive the strings, the fewer the runs.

How it runs:

1. ``windows``: each text's 200-byte windows are cut into runs of windows with one least 32-byte hash (an anchor), of
   ``RUN`` windows at most.  Equal windows share it.  Anchors that occur once are dropped (counted before the shuffle).
2. The bytes of a run of windows (its *content*) are hashed.  Of equal contents two copies from different places are
   fetched, of any other one; the index of their anchor decides on the bytes which windows start elsewhere too.
3. An index takes the contents of whole anchors, half a MB of bytes at most.  Contents of an anchor with more than
   ``GROUP_BYTES`` (a line in very many surroundings) are dealt out anew: they are texts of their own, whose windows meet
   by longer anchors (``ANCHORS``; the last is the whole window), so any number of tasks shares them.  Whole windows are
   counted by 128-bit hashes, once per ``PART_BYTES`` of these texts (``_counted``); they have no rows of their own.
   Contents no window of which has its hash again in the index don't enter the suffix order (``_may_repeat``).
4. Marks go back to all copies of the content whose 128-bit hash is that of the indexed bytes, and to the texts.

Identity.  A text is known by 88 bits of its SHA-256, whatever its doc_id: equal texts are copies of each other
throughout, and rows without a doc_id, or with one doc_id, are told apart by what they say.  Nothing is grouped by doc_id.

Edge cases: a null text has no bytes; texts under 200 bytes are kept whole; matches never cross documents; equal
rows are copies of each other; rows that share a doc_id, or have none, are separate documents.  Removal can cut a
character: ``kept`` is binary.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from querysieve.llm.common import as_bytes, cut, let_go, shuffle_partitions, slices

LENGTH, ANCHORS = 200, (32, 128, 200)
SLICE = 1 << 19  # bytes hashed at once
RUN = 4096  # windows of one content at most
INDEX_BYTES = GROUP_BYTES = 1 << 18
PART_BYTES = 1 << 21  # of texts whose whole windows are counted together
PLACE_BITS = 32  # a place: 28 bits of the text's hash and a byte number


def _mixed(x: np.ndarray, factor: int) -> np.ndarray:
    x = x * np.uint64(factor)
    x ^= x >> np.uint64(29)
    return x


def anchor_hashes(b: np.ndarray, anchor: int = ANCHORS[0]) -> np.ndarray:
    """A hash of the ``anchor`` bytes (8 at least) from each position on."""
    w = b.astype(np.uint64)
    for step in (1, 2, 4):
        w = w[:-step] << np.uint64(8 * step) | w[step:]
    size = 8
    while size < anchor:
        step = min(size, anchor - size)
        w = _mixed(w, 0x9E3779B97F4A7C15)
        w = w[:-step] * np.uint64(0x165667B19E3779F9) + w[step:]
        size += step
    return _mixed(_mixed(w, 0xD6E8FEB86659FD93), 0xA0761D6478BD642F)


def sliding_least(h: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span < width:
        step = min(span, width - span)
        h = np.minimum(h[:-step], h[step:])
        span += step
    return h


def _served_twice(h: np.ndarray, least: np.ndarray) -> np.ndarray:
    """The anchor hashes that stand at two places of which both are the least of some window."""
    width = len(h) - len(least) + 1
    most, span = np.concatenate((np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64))), 1
    while span < width:
        step = min(span, width - span)
        most = np.maximum(most[:-step], most[step:])
        span += step
    served = h[h == most]
    return served[1:][served[1:] == served[:-1]]


def window_runs(text: bytes, length: int = LENGTH, anchor: int = ANCHORS[0], run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one least anchor: anchor hash, first window, number of windows, whether it may repeat itself."""
    n, width = len(text) - length + 1, length - anchor + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    b, parts = np.frombuffer(text, np.uint8), []
    for at in range(0, n, SLICE):
        h = anchor_hashes(b[at : at + SLICE + length - 1], anchor)
        least = sliding_least(h, width)
        starts = np.concatenate(([0], np.flatnonzero(least[1:] != least[:-1]) + 1))
        sizes = np.diff(np.concatenate((starts, [len(least)])))
        twice = np.isin(least[starts], _served_twice(h, least)) | (sizes > width)
        pieces = -(-sizes // run)
        which = np.repeat(np.arange(len(sizes)), pieces)
        skipped = run * (np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        starts, sizes, twice = starts[which] + skipped, np.minimum(sizes[which] - skipped, run), twice[which]
        parts.append((least[starts], starts + at, sizes, twice))
    return tuple(np.concatenate(c) for c in zip(*parts))


def _in_order(first: np.ndarray, second: np.ndarray, at: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The three, all of 0..most, in their common order."""
    bits = int(most).bit_length()
    if 3 * bits > 64:
        turn = np.lexsort((at, second, first))
        return first[turn], second[turn], at[turn]
    # One number holds all three, and plain numbers sort fastest.
    mask = np.uint64((1 << bits) - 1)
    packed = first.astype(np.uint64) << np.uint64(2 * bits) | second.astype(np.uint64) << np.uint64(bits) | at.astype(np.uint64)
    packed.sort()
    return tuple(c.astype(np.int64) for c in (packed >> np.uint64(2 * bits), packed >> np.uint64(bits) & mask, packed & mask))


class RunIndex:
    """Run-compressed Burrows-Wheeler transform of byte strings, with text positions sampled at run ends."""

    def __init__(self, strings: list[bytes]):
        self.sizes = np.array([len(s) for s in strings], np.int64)
        self.text = np.frombuffer(b"".join(strings) + bytes(8), np.uint8)
        self.n = n = int(self.sizes.sum())
        ends = np.cumsum(self.sizes)
        self.left = np.repeat(ends, self.sizes) - np.arange(n)  # bytes to the end of the own string
        self.firsts = (ends - self.sizes)[self.sizes > 0]
        w = self.text.astype(np.uint64)
        for step in (1, 2, 4):
            w = w[:-step] << np.uint64(8 * step) | w[step:]
        self.eight = w[:n]
        short = np.minimum(self.left, 8).astype(np.uint64)
        self.eight &= ~((np.uint64(1) << (np.uint64(8) * (np.uint64(8) - short)) ) - np.uint64(1)) if n else np.uint64(0)
        order = self._suffixes(short)
        before = np.where(np.isin(order, self.firsts), -1, self.text[order - 1].astype(np.int16)) if n else np.empty(0, np.int16)
        # Each string's first position ends a run on both sides: nothing precedes it.
        changes = (before[1:] != before[:-1]) | (before[1:] < 0)
        heads, tails = np.concatenate(([True], changes))[:n], np.concatenate((changes, [True]))[:n]
        self.run_bytes = before[heads]
        self.run_sizes = np.diff(np.concatenate((np.flatnonzero(heads), [n])))
        at_head, at_tail = np.flatnonzero(heads), np.flatnonzero(tails)
        self.head_at, self.tail_at = order[at_head], order[at_tail]
        self.head_match = self._common(self.head_at, order[np.maximum(at_head - 1, 0)], at_head > 0)
        self.tail_match = self._common(self.tail_at, order[np.minimum(at_tail + 1, n - 1)], at_tail < n - 1) if n else np.empty(0, np.int64)

    def _suffixes(self, short: np.ndarray) -> np.ndarray:
        """Suffix order by prefix doubling of what isn't settled yet; equal suffixes of different strings keep the strings' order."""
        n = self.n
        if not n:
            return np.empty(0, np.int64)
        order = np.argsort(self.eight)
        key = self.eight[order]
        new = np.concatenate(([True], key[1:] != key[:-1]))
        rank = np.empty(n, np.int64)  # where the group of equal beginnings starts in the order
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        unsettled = order[~(new & np.append(new[1:], True))]  # in groups of several
        span, split = 8, True
        # Zero padding isn't zero bytes: of equal eight bytes fewer sort first.
        second = short.astype(np.int64)[unsettled]
        while split and len(unsettled):
            own, second, unsettled = _in_order(rank[unsettled], second, unsettled, n)
            first = np.concatenate(([True], own[1:] != own[:-1]))
            new = first | np.concatenate(([True], second[1:] != second[:-1]))
            count = np.arange(len(own))
            slot = own + count - np.maximum.accumulate(np.where(first, count, 0))
            order[slot] = unsettled
            rank[unsettled] = np.maximum.accumulate(np.where(new, slot, 0))
            split = new.sum() > first.sum() or span == 8
            unsettled = unsettled[~(new & np.append(new[1:], True))]
            second = np.where(self.left[unsettled] <= span, 0, rank[np.minimum(unsettled + span, n - 1)] + 1)
            span *= 2
        return order

    def _common(self, p: np.ndarray, q: np.ndarray, real: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at p and q."""
        most = np.where(real, np.minimum(self.left[p], self.left[q]), 0)
        found = np.zeros(len(p), np.int64)
        active = np.flatnonzero(most > 0)
        while len(active):
            at = found[active]
            a, b = self.eight[p[active] + at], self.eight[q[active] + at]
            differ = a ^ b
            same = differ == 0
            # Leading equal bytes of the first unequal eight.
            first = np.where(same, 8, 7 - np.floor(np.log2(np.maximum(differ, 1).astype(np.float64))).astype(np.int64) // 8)
            first = np.clip(first, 0, 8)
            found[active] = np.minimum(at + first, most[active])
            active = active[same & (found[active] < most[active])]
        return found

    def longest_matches(self) -> np.ndarray:
        """For every text position the longest match of what follows in its string with any other position."""
        best = np.zeros(self.n, np.int64)
        for at, match in ((self.head_at, self.head_match), (self.tail_at, self.tail_match)):
            sampled = np.zeros(self.n, np.int64)
            sampled[at] = at
            value = np.zeros(self.n, np.int64)
            value[at] = match
            last = np.maximum.accumulate(sampled)
            best = np.maximum(best, value[last] - (np.arange(self.n) - last))
        return np.minimum(best, self.left)


def _rows(docs: DataFrame, carried: Column) -> DataFrame:
    """doc (what ``carried`` says), text as bytes, and id and tag: 60 and 28 bits of the text's SHA-256."""
    docs = docs.select(carried.alias("doc"), F.col("text").cast("string").cast("binary").alias("text"))
    return _known(docs)


def _known(rows: DataFrame) -> DataFrame:
    digits = rows.select("*", F.sha2(F.coalesce("text", F.lit(b"")), 256).alias("digits"))
    bits = lambda start, n: F.conv(F.substring("digits", start, n), 16, 10).cast("long")
    return digits.select("doc", bits(1, 15).alias("id"), F.shiftleft(bits(16, 7), PLACE_BITS).alias("tag"), "text")


def _content(text: bytes) -> int:
    return xxhash.xxh3_64_intdigest(text)


def _check(text: bytes) -> bytes:
    return xxhash.xxh3_128_digest(text)


def anchors_again(rows: DataFrame, length: int, anchor: int) -> DataFrame:
    """The anchors of several runs of windows, or of one that may repeat itself."""

    def run(batches):
        let_go()
        for batch in slices(batches, 1000):
            out = [window_runs(text, length, anchor) for text in as_bytes(batch["text"])]
            least, twice = (np.concatenate([np.empty(0, np.uint64), *(o[k].astype(np.uint64) for o in out)]) for k in (0, 3))
            found, at = np.unique(least, return_inverse=True)
            times = np.bincount(at, weights=1.0 + twice, minlength=len(found)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(times)], ["anchor", "times"])

    return rows.select("text").mapInArrow(run, "anchor long, times long").groupBy("anchor").agg(F.sum("times").alias("times")).where("times > 1").select("anchor")


def windows(rows: DataFrame, length: int, anchor: int) -> DataFrame:
    """anchor, content (64-bit hash), id, place, n, twice for all runs of windows."""
    names = ["anchor", "content", "id", "place", "n", "twice"]

    def run(batches):
        let_go()
        for batch in slices(batches, 1000):
            out = [[], [], [], [], [], []]
            for i, tag, text in zip(batch["id"].to_pylist(), batch["tag"].to_pylist(), as_bytes(batch["text"])):
                least, at, n, twice = window_runs(text, length, anchor)
                content = np.fromiter((_content(text[a : a + m + length - 1]) for a, m in zip(at.tolist(), n.tolist())), np.uint64, len(at))
                for column, values in zip(out, (least.view(np.int64), content.view(np.int64), np.full(len(at), i, np.int64), at + tag, n, twice)):
                    column.append(values)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in out], names)

    return rows.select("id", "tag", "text").mapInArrow(run, " long, ".join(names) + " long")


def _with_found(rows: DataFrame, found: DataFrame, columns: list[str]) -> DataFrame:
    """All rows, each with the list of what was found in its text (null: nothing).

    Every use keeps the same columns of the rows, so that the shuffled texts are reused.
    """
    lists = found.groupBy("id").agg(F.collect_list(F.struct(*columns)).alias("found"))
    return rows.join(lists.hint("shuffle_hash"), "id", "left").select("doc", "id", "tag", "text", "found")


COPY = ["anchor", "content", "id", "place", "bytes", "large"]


def _contents(rows: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """anchor, content, id, place, the bytes there, and large; of equal texts in a task one is read."""

    def run(batches):
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            out = [[], [], [], [], [], []]
            for i, tag, text, found in zip(batch["id"].to_pylist(), batch["tag"].to_pylist(), batch["text"], batch["found"]):
                if not found.is_valid or (i, tag) in seen:
                    continue
                seen.add((i, tag))
                text = text.as_py()
                for f in found.as_py():
                    if (at := f["place"] - tag) >> PLACE_BITS == 0:
                        for column, value in zip(out, (f["anchor"], f["content"], i, f["place"], text[at : at + f["n"] + length - 1], f["large"])):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:4]), pa.array(out[4], pa.binary()), pa.array(out[5], pa.bool_())], COPY)

    joined = _with_found(rows, wanted, ["anchor", "content", "place", "n", "large"])
    return joined.mapInArrow(run, "anchor long, content long, id long, place long, bytes binary, large boolean")


def _intervals(marked: np.ndarray) -> list[dict[str, int]]:
    edges = np.flatnonzero(np.diff(marked.view(np.int8), prepend=np.int8(0), append=np.int8(0))).reshape(-1, 2)
    return [{"start": a, "stop": b} for a, b in edges.tolist()]


MARKS = "array<struct<start:long,stop:long>>"
_MARKS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
MARKED = f"anchor long, content long, check binary, marks {MARKS}, bytes binary"


def _marked(found: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*found)) or [[]] * 5
    types = [pa.int64(), pa.int64(), pa.binary(), _MARKS, pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["anchor", "content", "check", "marks", "bytes"])


def _window_hashes(texts: list[bytes], length: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every window of every text, and which text it is of."""
    sizes = np.array([len(t) for t in texts], np.int64)
    b = np.frombuffer(b"".join(texts), np.uint8)
    if len(b) < length:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(b))
    at = np.flatnonzero(left >= length)
    return anchor_hashes(b ^ np.uint8(salt), length)[at], np.repeat(np.arange(len(texts)), sizes)[at]


def _may_repeat(texts: list[bytes], length: int) -> np.ndarray:
    """Which texts have a window whose hash stands at another place too: no other one has a match of ``length`` bytes."""
    h, of = _window_hashes(texts, length) if length >= 8 else (np.zeros(len(texts), np.uint64), np.arange(len(texts)))
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    found = np.zeros(len(texts), bool)
    found[of[order[np.concatenate((same, [False])) | np.concatenate(([False], same))]] if len(h) else []] = True
    return found


def _indexed(copies: DataFrame, length: int, index_bytes: int) -> DataFrame:
    """anchor, content, check, marks: the windows of each content that match ``length`` bytes of another place.

    Contents of large anchors only pass through, with their ``bytes``; they are dealt singly, so no task gets an anchor.
    """

    def mark(group: list[tuple]) -> pa.RecordBatch:
        group = [g for g, may in zip(group, _may_repeat([g[4] for g in group], length)) if may]
        long = RunIndex([g[4] for g in group]).longest_matches() >= length
        ends = np.cumsum([len(g[4]) for g in group])
        found, before = [], None
        for (anchor, content, _, _, b, _), end in zip(group, ends.tolist()):
            if before != (anchor, content, b) and (marks := _intervals(long[end - len(b) : end])):
                found.append((anchor, content, _check(b), marks, None))
            before = anchor, content, b
        return _marked(found)

    def run(batches):
        group, size, before = [], 0, None
        for batch in slices(batches, 1000):
            large = []
            for one in zip(*(batch[c].to_pylist() for c in COPY)):
                # Equal texts that different tasks read offer the same copy twice.
                if before == one[:4]:
                    continue
                before = one[:4]
                if one[5]:
                    large.append((one[0], one[1], None, None, one[4]))
                    continue
                if size >= index_bytes and one[0] != group[-1][0]:
                    yield mark(group)
                    group, size = [], 0
                group.append(one)
                size += len(one[4])
            if large:
                yield _marked(large)
        if group:
            yield mark(group)

    parts = shuffle_partitions(copies.sparkSession)
    dealt = copies.repartition(parts, F.when(F.col("large"), F.xxhash64("anchor", "content")).otherwise(F.col("anchor")))
    return dealt.sortWithinPartitions(*COPY[:4]).mapInArrow(run, MARKED)


def _finer(large: DataFrame, length: int, anchors: tuple[int, ...], **sizes) -> DataFrame:
    """The same for the contents of large anchors: each is a text, and windows meet by the next longer anchor."""
    if len(anchors) == 1 and length >= 8:
        return _counted(large, length)
    texts = cut(_known(large.select(F.struct("anchor", "content").alias("doc"), F.col("bytes").alias("text"))))
    found = repeats(texts, length, anchors, **sizes)

    def run(batches):
        for batch in batches:
            out = []
            for doc, tag, text, found in zip(batch["doc"].to_pylist(), batch["tag"].to_pylist(), as_bytes(batch["text"]), batch["found"]):
                if marks := _intervals(_repeated(text, tag, found.as_py(), length)):
                    out.append((doc["anchor"], doc["content"], _check(text), marks, None))
            yield _marked(out)

    return _with_found(texts, found, FOUND).mapInArrow(run, MARKED).dropDuplicates(["anchor", "content", "check"])


def _counted(large: DataFrame, length: int, part_bytes: int = PART_BYTES) -> DataFrame:
    """The same by counting whole windows: each part of the contents tells every window once, and is told which start elsewhere."""
    size = large.agg(F.coalesce(F.sum(F.length("bytes")), F.lit(0))).first()[0]
    parts = F.pmod(F.xxhash64("anchor", "content", "bytes"), F.lit(1 + size // part_bytes)).alias("part")
    dealt = cut(large.select(parts, "anchor", "content", "bytes"))

    def told(batches):
        let_go()
        for batch in slices(batches, 4000):
            part, texts = batch["part"].to_numpy(), batch["bytes"].to_pylist()
            for p in np.unique(part).tolist():
                own = [texts[k] for k in np.flatnonzero(part == p).tolist()]
                h, again = (_window_hashes(own, length, salt)[0] for salt in (0, 0xA5))
                order = np.lexsort((again, h))
                starts = np.flatnonzero(np.concatenate((np.ones(min(len(h), 1), bool), (h[order][1:] != h[order][:-1]) | (again[order][1:] != again[order][:-1]))))
                times = np.diff(np.append(starts, len(h)))
                first = order[starts]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), p)), pa.array(h[first].view(np.int64)), pa.array(again[first].view(np.int64)), pa.array(times)], ["part", "h", "again", "times"])

    each = cut(dealt.select("part", "bytes").mapInArrow(told, "part long, h long, again long, times long").groupBy("part", "h", "again").agg(F.sum("times").alias("times")))
    several = each.groupBy("h", "again").agg(F.sum("times").alias("times"), F.collect_list("part").alias("parts")).where("times > 1")
    several = several.select(F.explode("parts").alias("part"), "h", "again")

    def run(texts: pa.Table, several: pa.Table) -> pa.Table:
        known = set(zip(several["h"].to_pylist(), several["again"].to_pylist()))
        found, data = [], texts["bytes"].to_pylist()
        (h, of), (again, _) = (_window_hashes(data, length, salt) for salt in (0, 0xA5))
        hit = np.fromiter((x in known for x in zip(h.view(np.int64).tolist(), again.view(np.int64).tolist())), bool, len(h))
        ends = np.searchsorted(of, np.arange(len(data) + 1))
        for k, (anchor, content, b) in enumerate(zip(texts["anchor"].to_pylist(), texts["content"].to_pylist(), data)):
            if marks := _intervals(hit[ends[k] : ends[k + 1]]):
                found.append((anchor, content, _check(b), marks, None))
        return pa.Table.from_batches([_marked(found)])

    marked = dealt.groupBy("part").cogroup(several.groupBy("part")).applyInArrow(run, MARKED)
    return marked.dropDuplicates(["anchor", "content", "check"])


FOUND = ["place", "n", "check", "marks"]


def repeats(rows: DataFrame, length: int = LENGTH, anchors: tuple[int, ...] = ANCHORS, group_bytes: int = GROUP_BYTES, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """``rows`` -> id, place, n, check, marks: per run of windows, the windows that start elsewhere too.

    ``check`` is the hash of the bytes for which the marks hold; null if all texts with the run are equal.
    """
    # Checkpointed, so that the join stands on two plain shuffles, whose large partitions Spark can split.
    again = cut(anchors_again(rows, length, anchors[0]))
    kept = cut(windows(rows, length, anchors[0]).join(again, "anchor", "left_semi"))
    where = F.struct("id", "place", "n")
    contents = kept.groupBy("anchor", "content").agg(F.count("*").alias("copies"), F.max("twice").alias("twice"), F.min(where).alias("one"), F.max(where).alias("two"))
    contents = contents.withColumn("several", F.col("one") != F.col("two"))
    size = (F.col("one.n") + length - 1) * F.when(F.col("several"), 2).otherwise(1)
    groups = cut(contents.groupBy("anchor").agg(F.count("*").alias("contents"), F.sum(size).alias("bytes")))
    contents = cut(contents.join(groups, "anchor").select("anchor", "content", "copies", "contents", "twice", "several", "one", "two", "bytes"))
    # In equal texts only: all windows of such a run start elsewhere.
    equal = contents.where("copies > 1 and not several")
    whole = equal.select("anchor", "content", F.lit(None).cast("binary").alias("check"), F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("one.n").alias("stop"))).alias("marks"))
    wanted = contents.where("contents > 1 or twice > 0 or several").select("anchor", "content", "bytes", F.explode(F.when(F.col("several"), F.array("one", "two")).otherwise(F.array("one"))).alias("at"))
    # Under the longest anchor, whole windows, an anchor's contents are equal but for what repeats within them.
    large = (F.col("bytes") > group_bytes) & F.lit(len(anchors) > 1)
    wanted = wanted.select("anchor", "content", large.alias("large"), "at.*")
    marks = cut(_indexed(_contents(rows, wanted, length), length, index_bytes))
    large = marks.where("bytes is not null")
    marks = marks.where("bytes is null")
    if not large.isEmpty():
        marks = marks.unionByName(_finer(large, length, anchors[1:], group_bytes=group_bytes, index_bytes=index_bytes))
    marks = marks.drop("bytes")
    marks = marks.join(equal.select("anchor", "content"), ["anchor", "content"], "left_anti").union(whole)
    # Equal texts have equal runs: each is told once.
    found = kept.select("anchor", "content", "id", "place", "n").join(marks, ["anchor", "content"])
    return found.groupBy("id", "place", "n", F.coalesce("check", F.lit(b"")).alias("check")).agg(F.first("marks").alias("marks"))


def _repeated(text: bytes, tag: int, found: list[dict] | None, length: int) -> np.ndarray:
    """Which windows are marked."""
    marked = np.zeros(max(0, len(text) - length + 1), bool)
    for f in found or []:
        if (at := f["place"] - tag) >> PLACE_BITS == 0 and (not f["check"] or _check(text[at : at + f["n"] + length - 1]) == f["check"]):
            for m in f["marks"]:
                marked[at + m["start"] : at + m["stop"]] = True
    return marked


def _gone(text: bytes, tag: int, found: list[dict] | None, length: int) -> np.ndarray:
    """Which bytes the marked windows cover."""
    gone = np.zeros(len(text), bool)
    for m in _intervals(_repeated(text, tag, found, length)) if found else []:
        gone[m["start"] : m["stop"] + length - 1] = True
    return gone


def deduplicate(docs: DataFrame, length: int = LENGTH, **parameters) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, n_bytes, n_removed, kept binary, spans (maximal removed runs: start, stop)."""
    rows = _rows(docs, F.col("doc_id").cast("long"))
    found = repeats(rows, length, **parameters)

    def run(batches):
        for batch in batches:
            n_bytes, n_removed, kept, spans = [], [], [], []
            for tag, text, found in zip(batch["tag"].to_pylist(), as_bytes(batch["text"]), batch["found"]):
                gone = _gone(text, tag, found.as_py(), length)
                spans.append(_intervals(gone))
                n_bytes.append(len(text))
                n_removed.append(int(gone.sum()))
                kept.append(np.frombuffer(text, np.uint8)[~gone].tobytes() if n_removed[-1] else text)
            yield pa.RecordBatch.from_arrays(
                [batch["doc"], pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, _MARKS)], ["doc_id", "n_bytes", "n_removed", "kept", "spans"]
            )

    return _with_found(rows, found, FOUND).mapInArrow(run, f"doc_id long, n_bytes long, n_removed long, kept binary, spans {MARKS}")


def strip_repeats(docs: DataFrame, length: int = LENGTH, **parameters) -> DataFrame:
    """``docs`` with repeated bytes taken out of ``text``; all rows and columns stay, ``n_chars`` follows the text.

    Bytes of a character that was cut are dropped with it.  A text that repeats elsewhere throughout becomes empty; a
    null text stays null.
    """
    rows = _rows(docs, F.struct(*[f"`{c}`" for c in docs.columns if c != "text"]))
    found = repeats(rows, length, **parameters)

    def run(batches):
        for batch in slices(batches, 1000):
            kept = []
            for tag, text, there, found in zip(batch["tag"].to_pylist(), as_bytes(batch["text"]), batch["text"].is_valid().to_pylist(), batch["found"]):
                gone = _gone(text, tag, found.as_py(), length)
                left = np.frombuffer(text, np.uint8)[~gone].tobytes().decode("utf-8", "ignore") if gone.any() else text.decode("utf-8", "replace")
                kept.append(left if there else None)
            yield pa.RecordBatch.from_arrays([batch["doc"], pa.array(kept, pa.string())], ["doc", "kept"])

    out = _with_found(rows, found, FOUND).mapInArrow(run, T.StructType([T.StructField("doc", rows.schema["doc"].dataType), T.StructField("kept", T.StringType())]))
    changed = {"text": F.col("kept"), "n_chars": F.length("kept")}
    return out.select(*[(changed[f.name] if f.name in changed else F.col("doc")[f.name]).cast(f.dataType).alias(f.name) for f in docs.schema])


def digests(docs: DataFrame) -> DataFrame:
    return deduplicate(docs).select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


__all__ = ["RunIndex", "deduplicate", "digests", "repeats", "window_runs"]
