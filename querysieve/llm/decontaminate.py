"""Benchmark decontamination: BM25 over the test items with block-max WAND.

The test items are indexed by term; postings carry BM25 impacts relative to the item's score for its own text, and
each block of postings its largest impact.  Every passage of every document queries the index; block-max WAND
retrieves all entries at or above their threshold, and the words of question and answer are compared to confirm.

An item's answer is its last sentence, its question what comes before (an item of one sentence is all question).  A
passage holds an item if it has ``SIMILARITY`` = 0.8 of the five-word shingles of the item, or of its question alone
where that has ``QUESTION_WORDS`` or more.  Such a question is an entry of the index beside its item.  The threshold of an
entry is not a tuning value: it is the least score that a passage can have which holds 0.8 of the entry's shingles.  So
retrieval loses nothing that the comparison would confirm.

Passages are ``2 x stride`` words long and start every ``stride`` words.  Items are indexed by length class (up to 64
words, up to 128, and so on doubling), each with its class as stride, so every copy of an item lies whole in some
passage and one very long item doesn't widen the passages of the others.  Copies that are torn further apart than
that are not one passage, and not found.

Documents are read once, in place, without a shuffle.  Items are dealt into shards of at most about ``SHARD_BYTES`` of text;
every shard's index is built in a task and kept in the checkpoint folder; one at a time passes through the driver to be
broadcast.  A task takes ``ROWS`` documents through all shards, one after another, and lets go of each: what a worker holds
doesn't grow with the benchmark, what lies on the executors' disks does.

Edge cases: null or empty documents match nothing; items without a word are left out; items of fewer than five
words are one shingle; words are runs of letters, digits and underscores, lower-cased; repeated rows give repeated
results; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querysieve.llm.common import cut, id_and_text, let_go, slices

SHINGLE, SIMILARITY = 5, 0.8
K1, B = 1.2, 0.75
BLOCK = 64
RANGES, LEAST_RANGE = 128, 4
LEAST_STRIDE = 64
QUESTION_WORDS = 13
SHARD_BYTES = 2 << 20
ROWS = 2000  # documents a worker holds at once
WORD = re.compile(r"\w+")
SENTENCE_END = re.compile(r"(?<=[.!?])\s+(?=\S)")
ROUNDING = 1e-9


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def shingles(w: list[str]) -> set[tuple[str, ...]]:
    return {tuple(w[k : k + SHINGLE]) for k in range(max(1, len(w) - SHINGLE + 1))} if w else set()


def question_and_answer(text: str) -> tuple[str, str]:
    parts = SENTENCE_END.split(text.strip())
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (text, "")


@dataclass
class Item:
    item_id: int
    shingles: set
    question: set
    answer: set
    asks: bool  # whether the question alone decides


def length_class(n: int) -> int:
    return max(LEAST_STRIDE, 1 << (n - 1).bit_length())


class Index:
    """Items of one length class: terms with postings of (entry, impact) in blocks of at most ``BLOCK``.

    An entry is a whole item or its question; ``items`` and ``thresholds`` go by entry.
    """

    def __init__(self, items: list[tuple[int, str]]):
        spelled = [(i, t, words(t)) for i, t in sorted(items, key=lambda x: (x[0] is None, x[0] or 0, x[1]))]
        spelled = [x for x in spelled if x[2]]
        n, mean = len(spelled), sum(len(w) for _, _, w in spelled) / max(1, len(spelled))
        frequency = Counter(term for _, _, w in spelled for term in set(w))
        postings: dict[str, list[tuple[int, float]]] = {}
        self.items: list[Item] = []
        self.thresholds: list[float] = []
        for item_id, text, w in spelled:
            question, answer = (words(part) for part in question_and_answer(text))
            asks = bool(answer) and len(question) >= QUESTION_WORDS
            item = Item(item_id, shingles(w), shingles(question), shingles(answer), asks)
            for part, own in [(w, item.shingles), (question, item.question)][: 1 + asks]:
                raw = {}
                for term, tf in Counter(part).items():
                    idf = math.log(1 + (n - frequency[term] + 0.5) / (frequency[term] + 0.5))
                    raw[term] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(part) / mean))
                total = sum(raw.values())
                impacts = {term: x / total for term, x in raw.items()}
                for term, x in impacts.items():
                    postings.setdefault(term, []).append((len(self.items), x))
                # A lost word costs a shingle at least, so no more words than shingles can be missing.
                missing = int(len(own) * (1 - SIMILARITY) + ROUNDING)
                self.thresholds.append(1 - sum(sorted(impacts.values())[-missing:] if missing else []) - ROUNDING)
                self.items.append(item)
        self.term = {t: k for k, t in enumerate(sorted(postings))}
        self.postings = [postings[t] for t in sorted(postings)]
        self.most = [max(x for _, x in p) for p in self.postings]
        self.blocks = [[(p[at : at + BLOCK][-1][0], max(x for _, x in p[at : at + BLOCK])) for at in range(0, len(p), BLOCK)] for p in self.postings]
        # The same bounds by range of entries, for many passages at once.
        width = max(LEAST_RANGE, -(-len(self.items) // RANGES))
        self.range_most = np.zeros((len(self.postings), -(-len(self.items) // width)), np.float32)
        for t, p in enumerate(self.postings):
            for k, x in p:
                self.range_most[t, k // width] = max(self.range_most[t, k // width], x)
        self.range_least = np.array([min(self.thresholds[at : at + width]) for at in range(0, len(self.items), width)]) - 1e-5
        self.least = min(self.thresholds, default=math.inf)
        self.stride = length_class(max((len(w) for _, _, w in spelled), default=1))

    def retrieve(self, terms: list[int]) -> list[tuple[int, float]]:
        """Block-max WAND: all (entry, score) at or above the entry's threshold, for a passage's distinct terms."""
        least, found, end = self.least, [], len(self.items)
        cursors = [[self.postings[t][0][0], 0, t] for t in terms]  # item, place in the postings, term
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for k, (_, _, t) in enumerate(cursors):
                bound += self.most[t]
                if bound >= least:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            # What the blocks that would hold this item can add up to, and where the first of them ends.
            bound, block_end = 0.0, end
            for _, at, t in cursors[: pivot + 1]:
                blocks, b = self.blocks[t], at // BLOCK
                while b < len(blocks) and blocks[b][0] < item:
                    b += 1
                if b < len(blocks):
                    bound += blocks[b][1]
                    block_end = min(block_end, blocks[b][0])
            if bound < least:
                following = cursors[pivot + 1][0] if pivot + 1 < len(cursors) else end
                to, moved = min(block_end + 1, following), cursors[: pivot + 1]
            elif cursors[0][0] == item:
                score = sum(self.postings[t][at][1] for _, at, t in cursors[: pivot + 1])
                if score >= self.thresholds[item]:
                    found.append((item, score))
                to, moved = item + 1, cursors[: pivot + 1]
            else:
                to, moved = item, [c for c in cursors[:pivot] if c[0] < item]
            for c in moved:
                own, at = self.postings[c[2]], c[1]
                while at < len(own) and own[at][0] < to:
                    at = min((at // BLOCK + 1) * BLOCK, len(own)) if self.blocks[c[2]][at // BLOCK][0] < to else at + 1
                c[1], c[0] = at, own[at][0] if at < len(own) else end
            cursors = [c for c in cursors if c[0] < end]
        return found

    def _hopeful(self, w: list[str]) -> list[tuple[int, list[int]]]:
        """Passages (number, distinct terms) in which the block maxima of some range of items reach its threshold."""
        find = self.term.get
        ids = np.fromiter((find(x, -1) for x in w), np.int64, len(w))
        at = np.flatnonzero(ids >= 0)
        if not len(at):
            return []
        part, size = at // self.stride, len(self.term)
        keys = np.unique(np.concatenate((part * size + ids[at], (part - 1) * size + ids[at])))
        passage, term = keys // size, keys % size
        starts = np.flatnonzero(np.diff(passage, prepend=-2))
        bounds = np.add.reduceat(self.range_most[term], starts, axis=0)
        ends = np.append(starts[1:], len(keys))
        # The passage before the first has only a first half that the first passage has too.
        return [(int(passage[starts[k]]), term[starts[k] : ends[k]].tolist()) for k in np.flatnonzero((bounds >= self.range_least).any(axis=1)).tolist() if passage[starts[k]] >= 0]

    def matches(self, w: list[str]) -> list[dict]:
        """The confirmed items of one document's words, each at its best passage."""
        best: dict[int, tuple] = {}  # by the item's first entry
        for k, terms in self._hopeful(w):
            at, hits = k * self.stride, self.retrieve(terms)
            if not hits:
                continue
            spelled = w[at : at + 2 * self.stride]
            there = {tuple(spelled[j : j + SHINGLE]) for j in range(max(1, len(spelled) - SHINGLE + 1))}
            for number, score in hits:
                item = self.items[number]
                number -= number > 0 and self.items[number - 1] is item
                part = lambda s: _overlap(s, spelled, there)
                whole, question = part(item.shingles), part(item.question)
                if whole + ROUNDING < SIMILARITY and not (item.asks and question + ROUNDING >= SIMILARITY):
                    continue
                rank = (whole, question, -at)
                if number not in best or rank > best[number][0]:
                    found = {"item_id": item.item_id, "score": float(score), "overlap": whole, "question_overlap": question, "answer_overlap": part(item.answer), "start_word": at}
                    best[number] = (rank, found)
        return [best[k][1] for k in sorted(best)]


def _overlap(own: set, spelled: list[str], there: set) -> float | None:
    if not own:
        return None
    short = next(iter(own))
    if len(short) < SHINGLE:  # fewer words than a shingle: the only one
        return float(any(tuple(spelled[j : j + len(short)]) == short for j in range(len(spelled))))
    return len(own & there) / len(own)


def matches(indexes: list[Index], text: str | None) -> list[dict]:
    """The confirmed items of one text, of all length classes."""
    w = words(text)
    return [m for index in indexes for m in index.matches(w)] if w else []


def indexes(benchmark: DataFrame, shard_bytes: int = SHARD_BYTES) -> Iterator[bytes]:
    """Shard by shard the pickled indexes of its length classes, built in tasks."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, math.ceil(total / shard_bytes))

    def run(batches):
        by_shard: dict[int, list] = {}
        for batch in batches:
            for shard, item, text in zip(*(batch[c].to_pylist() for c in ("shard", "item_id", "text"))):
                by_shard.setdefault(shard, []).append((item, text))
        for shard, own in by_shard.items():
            classes: dict[int, list] = {}
            for item, text in own:
                if n := len(words(text)):
                    classes.setdefault(length_class(n), []).append((item, text))
            made = pickle.dumps([Index(classes[k]) for k in sorted(classes)], protocol=5)
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([made], pa.binary())], ["shard", "made"])

    dealt = items.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)).cast("int"))
    built = cut(dealt.repartitionById(shards, "shard").mapInArrow(run, "shard int, made binary"))
    for k in range(shards):
        for row in built.where(F.col("shard") == k).select("made").collect():  # one at most
            yield bytes(row["made"])


MATCH = "item_id long, score double, overlap double, question_overlap double, answer_overlap double, start_word long"


class Shards:
    """The broadcast indexes; a worker has one of them in memory."""

    def __init__(self, docs: DataFrame, benchmark: DataFrame, shard_bytes: int):
        self.sent = [docs.sparkSession.sparkContext.broadcast(made) for made in indexes(benchmark, shard_bytes)]
        self.only: list[Index] | None = None

    def opened(self) -> Iterator[list[Index]]:
        for sent in self.sent:
            if self.only is not None:
                yield self.only
                continue
            own = pickle.loads(sent.value)
            vars(sent).pop("_value", None)  # the next use reads it from disk again
            if len(self.sent) == 1:
                self.only = own
            yield own

    def matches(self, texts: list[str | None]) -> list[list[dict]]:
        """By text the confirmed items."""
        found: list[list[dict]] = [[] for _ in texts]
        for own in self.opened():
            for out, text in zip(found, texts):
                out += matches(own, text)
        return found

    def clean(self, texts: list[str | None]) -> list[bool]:
        """Whether a text holds no item; one that holds one is looked at no further."""
        good = [True] * len(texts)
        for own in self.opened():
            good = [g and not matches(own, text) for g, text in zip(good, texts)]
        return good


def contaminated(docs: DataFrame, benchmark: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id and the confirmed item, score, overlaps and passage start: a row per document and item."""
    shards = Shards(docs, benchmark, shard_bytes)

    def run(batches):
        let_go()
        for batch in slices(batches, ROWS):
            found = zip(batch["doc_id"].to_pylist(), shards.matches(batch["text"].to_pylist()))
            yield pa.RecordBatch.from_pylist([{"doc_id": i, **m} for i, own in found for m in own], schema=schema)

    return id_and_text(docs).mapInArrow(run, f"doc_id long, {MATCH}")


schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), *((c, pa.float64()) for c in ("score", "overlap", "question_overlap", "answer_overlap")), ("start_word", pa.int64())])


def keep_clean(docs: DataFrame, benchmark: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``docs`` without the rows whose text holds a test item; all columns stay."""
    at, shards = docs.columns.index("text"), Shards(docs, benchmark, shard_bytes)

    def run(batches):
        let_go()
        for batch in slices(batches, ROWS):
            yield batch.filter(pa.array(shards.clean(batch.column(at).to_pylist()), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
