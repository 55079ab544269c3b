"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

``fit`` takes a sample of the labelled rows of both labels as examples.  The vector space holds every word that an
example has.  A word's weight in a text is (1 + ln times) x idf x relevance: idf counts all documents of the corpus,
relevance is log2(2 + toxic / max(1, clean)) over the examples that have the word (1 for a word that clean ones have;
the supervised factor of Lan et al. 2009, without which chance words outweigh the telling ones).  Vectors have length
one; words that no example has count in a text's length only.

Every document is compared with all examples: the ``NEIGHBOURS`` most similar ones vote, each with the inverse of its
distance, and a monotone curve fitted on the examples themselves (each without its own vote) turns the vote into a
probability.  The ``SHOWN`` nearest of them and the words that stand out in toxic examples are returned as evidence.

The index.  Postings of rare words are short and read whole.  Those of common words lie in blocks of ``BLOCK``
examples, with the largest weight per word and block.  A query adds up what each block could reach at most (its best
sum of rare words, plus the block maxima of the common ones), opens the ``FIRST`` most hopeful blocks, and then only those
that can still beat the neighbours it has: exact, however long the query.  Queries go in batches, so that a block is
opened once for all that want it.

Bounds: about ``SAMPLE`` labelled rows (by a hash of doc_id, of repeated ones and their texts) teach, whatever the corpus; the vocabulary and the index,
which are broadcast, hold those rows' words.  Documents are read in place; only word counts are shuffled.

Edge cases: null and empty texts have no words and get the toxic share of such examples, drawn to the base rate; so
do texts that share no word with any example get the base rate's place on the curve; rows with a null label, or whose
doc_id has no text, teach nothing; a doc_id that is labelled both ways is clean; of equal texts the row with the smallest doc_id teaches; without any label every
score is 0; of equally similar examples the one with the smaller doc_id counts as nearer.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querysieve.llm.common import cut, id_and_text, let_go, slices

SAMPLE = 4_000
NEIGHBOURS, BLOCK = 50, 64
SHOWN = 15  # nearest voters returned as evidence
COMMON = 1 / 16  # of the examples: words of more are common
FIRST = 4  # blocks opened to begin with
QUERIES = 32  # that go together
PRIOR_WEIGHT = 0.5  # of the base rate among the votes
NEAR = 0.05  # distances below this weigh alike
TELLING = 2.0  # relevance from which a word is evidence
MOST_TERMS = 10  # words of evidence
WORD = re.compile(r"[^\W\d_]+")
DIGITS = 10  # to which similarities are compared


def terms_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


class BlockMaxIndex:
    """Unit vectors of examples (``ends`` of each in ``terms`` and ``weights``) by term and block.

    Only the vectors are sent, in 32 bits; blocks and postings are laid out where the index arrives.
    """

    def __init__(self, ends: np.ndarray, terms: np.ndarray, weights: np.ndarray, size: int, common: float = COMMON):
        self.vectors = ends.astype(np.int32), terms.astype(np.int32), weights.astype(np.float32), size, common
        self._lay_out(*self.vectors)

    def __getstate__(self) -> tuple:
        return self.vectors

    def __setstate__(self, vectors: tuple) -> None:
        self.vectors = vectors
        self._lay_out(*vectors)

    def _lay_out(self, ends: np.ndarray, terms: np.ndarray, weights: np.ndarray, size: int, common: float) -> None:
        n, weights = len(ends), weights.astype(np.float64)
        self.blocks = -(-n // BLOCK)
        example = np.repeat(np.arange(n), np.diff(ends, prepend=0))
        is_common = np.bincount(terms, minlength=size) > common * n
        self.slot = np.where(is_common, np.cumsum(is_common) - 1, -1).astype(np.int32)
        often = is_common[terms]
        # Examples with the same strongest common term share blocks, which keeps the block maxima tight.
        strongest = np.full(n, -1, np.int64)
        rising = np.argsort(weights[often], kind="stable")
        strongest[example[often][rising]] = terms[often][rising]
        self.order = np.lexsort((np.diff(ends, prepend=0), strongest))
        self.place = np.empty(n, np.int64)
        self.place[self.order] = np.arange(n)
        at = self.place[example]
        self.tiles = np.zeros((self.blocks, int(is_common.sum()), BLOCK))
        self.tiles[at[often] // BLOCK, self.slot[terms[often]], at[often] % BLOCK] = weights[often]
        self.most = self.tiles.max(axis=2).T.copy()
        rare = np.flatnonzero(~often)
        rare = rare[np.argsort(terms[rare], kind="stable")]
        self.places, self.rare = at[rare].astype(np.int32), weights[rare]
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(terms[rare], minlength=size))))

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, skip: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """By query (terms and weights) the k largest cosines and their examples, ties to the smaller example.

        Only examples that share a term count; ``skip`` names one for each query that doesn't.
        """
        n, size = len(queries), self.blocks * BLOCK
        common, rare = np.zeros((n, self.tiles.shape[1])), np.zeros((n, size))
        for q, (terms, weights) in enumerate(queries):
            slots = self.slot[terms]
            own, alone = slots >= 0, terms[slots < 0]
            common[q, slots[own]] = weights[own]
            first, times = self.starts[alone], self.starts[alone + 1] - self.starts[alone]
            read = np.repeat(first - np.cumsum(times) + times, times) + np.arange(times.sum())
            rare[q] = np.bincount(self.places[read], self.rare[read] * np.repeat(weights[~own], times), size)
        tiled = rare.reshape(n, self.blocks, BLOCK)
        bounds = tiled.max(axis=2) + common @ self.most
        scores = np.zeros((n, self.blocks, BLOCK))
        flat = scores.reshape(n, size)
        rows = np.arange(n)[:, None]

        def opened(wanted: np.ndarray) -> np.ndarray:
            """Scores in the wanted blocks; returns each query's k-th best so far."""
            for block in np.flatnonzero(wanted.any(axis=0)).tolist():
                own = np.flatnonzero(wanted[:, block])
                scores[own, block] = np.round(tiled[own, block] + common[own] @ self.tiles[block], DIGITS)
            if skip is not None:
                flat[rows[:, 0], self.place[skip]] = 0
            return np.partition(flat, size - k, axis=1)[:, size - k]

        begin = np.zeros((n, self.blocks), bool)
        begin[rows, np.argsort(-bounds, axis=1)[:, :FIRST]] = True
        floor = opened(begin & (bounds > 0))
        floor = opened(~begin & (bounds > 0) & (bounds + 10**-DIGITS >= floor[:, None]))
        found = []
        for q in range(n):
            at = np.flatnonzero((flat[q] > 0) & (flat[q] >= floor[q]))
            at = at[np.lexsort((self.order[at], -flat[q, at]))[:k]]
            found.append((flat[q, at], self.order[at]))
        return found


@dataclass
class Space:
    """Terms with their numbers; by number the weight of one occurrence (at the end: of an unknown term) and the relevance."""

    terms: dict[str, int]
    weights: np.ndarray
    relevance: np.ndarray

    def vector(self, words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Known terms among a text's words, their numbers, and their weights in its unit vector."""
        counts = Counter(words)
        names = list(counts)
        at = np.fromiter(map(self.terms.get, names, repeat(-1)), np.int64, len(names))
        weights = (1 + np.log(np.fromiter(counts.values(), np.float64, len(names)))) * self.weights[at]
        known = np.flatnonzero(at >= 0)
        return [names[k] for k in known.tolist()], at[known], weights[known] / math.sqrt(weights @ weights) if len(known) else weights[:0]


@dataclass
class Model:
    space: Space
    doc_ids: np.ndarray  # of the examples
    labels: np.ndarray
    index: BlockMaxIndex | None
    base: float  # share of toxic examples, and of those without terms
    silent: float
    knots: tuple[np.ndarray, np.ndarray]

    def votes(self, queries: list[tuple[np.ndarray, np.ndarray]], skip: list[int] | None = None) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """By query the vote, the similarities and the neighbours."""
        out = []
        for at in range(0, len(queries), QUERIES):
            for similar, near in self.index.nearest(queries[at : at + QUERIES], NEIGHBOURS, skip and skip[at : at + QUERIES]):
                weights = NEAR / (NEAR + 1 - similar)
                vote = (weights @ self.labels[near] + PRIOR_WEIGHT * self.base) / (weights.sum() + PRIOR_WEIGHT)
                out.append((float(vote), similar, near))
        return out

    def scores(self, texts: list[str | None]) -> list[tuple[float, np.ndarray, np.ndarray, list[str]]]:
        """By text the score, the similarities, the neighbours and the telling words."""
        spelled = list(map(terms_of, texts))
        asked = [k for k, w in enumerate(spelled) if w and self.index is not None]
        vectors = [self.space.vector(spelled[k]) for k in asked]
        out = [(self.silent, np.empty(0), np.empty(0, np.int64), [])] * len(texts)
        for k, (names, terms, weights), (vote, similar, near) in zip(asked, vectors, self.votes([v[1:] for v in vectors])):
            telling = np.flatnonzero(self.space.relevance[terms] >= TELLING)
            telling = telling[np.lexsort((terms[telling], -weights[telling]))[:MOST_TERMS]]
            out[k] = float(np.interp(vote, *self.knots)), similar[:SHOWN], near[:SHOWN], [names[t] for t in telling.tolist()]
        return out


def monotone(x: np.ndarray, y: np.ndarray, weight: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the best rising step curve through (x, y) (pooled violators), each pool drawn a little to the mean."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # sum of y, n, sum of x
    for k in order.tolist():
        pools.append([float(y[k]), 1.0, float(x[k])])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    mean = float(y.mean())
    return np.array([p[2] / p[1] for p in pools]), np.array([(p[0] + weight * mean) / (p[1] + weight) for p in pools])


def _sampled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """doc_id, text, label of about ``sample`` labelled rows at most; equal texts teach once, by their smallest doc_id.

    Drawn by doc_id first, so that few labels are sent; where documents repeat a doc_id, again by doc_id and text.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    own = cut(own.groupBy("doc_id").agg(F.min("label").alias("label")))
    drawn = own.where(_falls_below(["doc_id"], sample, own.count()))
    rows = id_and_text(docs).join(F.broadcast(drawn), "doc_id").where("text is not null")
    rows = rows.where(_falls_below(["doc_id", "text"], sample, rows.count(), 1.5))
    return rows.groupBy("text").agg(F.min(F.struct("doc_id", "label")).alias("one")).select("one.doc_id", "text", "one.label")


def _falls_below(columns: list[str], sample: int, n: int, spare: float = 1.0) -> Column:
    """Whether a row is drawn so that about ``sample`` of ``n`` are; all are if there are few enough."""
    share = sample / n if n > sample * spare else 1.0
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 20)) < share * (1 << 20)


def _term_counts(rows: DataFrame) -> DataFrame:
    """term, toxic and clean examples; counted in each batch first."""

    def run(batches):
        for batch in batches:
            counts = {0: Counter(), 1: Counter()}
            for text, label in zip(batch["text"].to_pylist(), batch["label"].to_pylist()):
                counts[label].update(set(terms_of(text)))
            terms = sorted(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *(pa.array([counts[k][t] for t in terms], pa.int64()) for k in (1, 0))], ["term", "toxic", "clean"])

    return rows.select("text", "label").mapInArrow(run, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _document_counts(docs: DataFrame, terms: dict[str, int]) -> tuple[np.ndarray, int]:
    """In how many of all documents each term is, and how many documents there are."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        let_go()
        known, counts, n = sent.value, np.zeros(len(terms), np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for text in batch["text"].to_pylist():
                found = {known[t] for t in set(terms_of(text)) if t in known}
                counts[np.fromiter(found, np.int64, len(found))] += 1
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(counts[at], n))], ["term", "n"])

    found = id_and_text(docs).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    sent.destroy()
    counts = np.zeros(len(terms) + 1, np.int64)
    counts[found["term"].to_numpy()] = found["n"].to_numpy()  # the number of documents comes last
    return counts[:-1], int(counts[-1])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """``docs`` (doc_id, text), ``labels`` (doc_id, label 0/1; those that may teach)."""
    rows = cut(_sampled(docs, labels, sample))
    totals = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    n = sum(totals.values())
    base = totals.get(1, 0) / n if n else 0.0
    flat = np.full(1, base)
    nothing = Model(Space({}, np.ones(1), np.empty(0)), np.empty(0, np.int64), np.empty(0), None, base, base, (flat, flat))
    found = _term_counts(rows).orderBy("term").toArrow() if n else None
    if found is None or not found.num_rows:
        return nothing
    terms = {t: k for k, t in enumerate(found["term"].to_pylist())}
    in_documents, documents = _document_counts(docs, terms)
    relevance = np.log2(2 + found["toxic"].to_numpy() / np.maximum(1, found["clean"].to_numpy()))
    idf = np.log((1 + documents) / (1 + np.append(in_documents, 1))) + 1
    space = Space(terms, idf * np.append(relevance, 1.0), relevance)
    sent = docs.sparkSession.sparkContext.broadcast(space)

    def vectors(batches):
        let_go()
        for batch in batches:
            made = [sent.value.vector(terms_of(t))[1:] for t in batch["text"].to_pylist()]
            at, weights = (pa.array([m[k] for m in made], t) for k, t in ((0, pa.list_(pa.int64())), (1, pa.list_(pa.float64()))))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["label"], at, weights], ["doc_id", "label", "at", "weights"])

    made = rows.mapInArrow(vectors, "doc_id long, label int, at array<long>, weights array<double>")
    made = cut(made.where("size(at) > 0").withColumn("number", F.monotonically_increasing_id()))
    sent.destroy()
    own = made.toArrow().sort_by([("doc_id", "ascending"), ("number", "ascending")]).combine_chunks()  # at most the sample
    label = own["label"].to_numpy().astype(float)
    ends = np.cumsum(np.array([len(a) for a in own["at"]], np.int64))
    index = BlockMaxIndex(ends, *(own[c].combine_chunks().flatten().to_numpy() for c in ("at", "weights")), len(terms))
    silent = (totals.get(1, 0) - label.sum() + base) / (n - len(label) + 1)
    model = Model(space, own["doc_id"].to_numpy(), label, index, base, float(silent), (flat, flat))
    by_number = np.argsort(own["number"].to_numpy())
    sent_model = docs.sparkSession.sparkContext.broadcast((model, own["number"].to_numpy()[by_number], by_number))

    def votes(batches):
        let_go()
        model, numbers, examples = sent_model.value
        for batch in slices(batches, 1000):
            skip = examples[np.searchsorted(numbers, batch["number"].to_numpy())].tolist()
            found = [v[0] for v in model.votes([(at.values.to_numpy(), w.values.to_numpy()) for at, w in zip(batch["at"], batch["weights"])], skip)]
            yield pa.RecordBatch.from_arrays([pa.array(skip, pa.int64()), pa.array(found, pa.float64())], ["example", "vote"])

    voted = made.mapInArrow(votes, "example long, vote double").toArrow()  # at most the sample
    sent_model.destroy()
    model.knots = monotone(voted["vote"].to_numpy(), label[voted["example"].to_numpy()])
    return model


EVIDENCE = "doc_id long, score double, neighbours array<struct<doc_id:long,similarity:double,toxic:int>>, terms array<string>"


def toxicity_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, score, neighbours (nearest first) and telling terms (heaviest first); one row per input row."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))

    def run(batches):
        let_go()
        model = sent.value
        for batch in slices(batches, 1000):
            scores, similar, near, terms = zip(*model.scores(batch["text"].to_pylist()))
            ends = np.concatenate(([0], np.cumsum(list(map(len, near)))))
            near = np.concatenate(near)
            voters = [pa.array(c) for c in (model.doc_ids[near], np.concatenate(similar), model.labels[near].astype(np.int32))]
            neighbours = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(voters, ["doc_id", "similarity", "toxic"]))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(scores, pa.float64()), neighbours, pa.array(terms, pa.list_(pa.string()))], ["doc_id", "score", "neighbours", "terms"])

    return id_and_text(docs).mapInArrow(run, EVIDENCE)
