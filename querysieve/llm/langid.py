"""Language ID by unigram pieces with the segmentation summed out.

``fit`` learns, for every language, a probability for each piece of a fixed public vocabulary; ``predict`` scores
a text in a language by the forward algorithm, which sums the probabilities of all ways to cut each of its words
into pieces, and returns the best language with its tempered posterior.

Words are the runs of letters of the lower-cased text, each with a space before it, as UTF-8.  Fitting is
expectation maximisation over word counts: expected piece counts over all segmentations, in Spark tasks, with the
current probabilities (vocabulary x languages, a fixed size) sent along.

Fitting uses at most about ``per_language`` documents of each language, taken by a hash of doc_id, so its cost
does not grow with the corpus; of those it uses every word, however long (both passes are scaled, so a run of letters
without blanks can't underflow).  Languages are a closed set of names: vocabulary x languages numbers come to the driver
in every round, and twice as many are sent.  Prediction reads every text whole, without a shuffle.

Edge cases: a null text, an empty one and one without a letter are ``und`` with score 0, as is every text when
there is nothing to learn from; rows with a null language, or none allowed by ``use``, teach nothing; of equally
likely languages the first in alphabetical order wins.
"""

from __future__ import annotations

import base64
import math
import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querysieve.llm.common import cut, id_and_text, let_go, slices

UNKNOWN = "und"
PER_LANGUAGE = 1500
ROUNDS = 3
PRIOR_WEIGHT = 200.0  # pieces' worth of background in each language's counts
LEAST = 1e-9  # of a piece's probability
SCALE = 1e120
CELLS = 200_000
REMEMBERED = 300_000
ROWS = 500  # texts scored together
LETTERS = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    return LETTERS.findall(text.lower()) if text else []


def has_letter(word: str) -> bool:
    return any(map(str.isalpha, word))


@lru_cache(maxsize=4)
def read_pieces(path: str) -> dict[bytes, int]:
    """Piece -> number, from a rank file with a base64 token and its rank per line."""
    with open(path, "rb") as f:
        tokens = [base64.b64decode(line.split()[0]) for line in f if line.strip()]
    return {t: i for i, t in enumerate(tokens)}


class Lattice:
    """All cuts of words into vocabulary pieces."""

    def __init__(self, pieces: dict[bytes, int]):
        self.size, self.longest = len(pieces), max(map(len, pieces), default=0)
        self.arrays = None
        self.root: dict = {}  # byte -> node; at -1 the piece that ends here
        for piece, k in pieces.items():
            node = self.root
            for byte in piece:
                node = node.setdefault(byte, {})
            node[-1] = k

    def arcs(self, word: str) -> tuple[int, list[tuple[int, int, int]]]:
        """Length in bytes, and (start, end, piece) in order of start."""
        b, found, root = b" " + word.encode("utf-8", "replace"), [], self.root
        for i in range(len(b)):
            node, j = root, i
            for byte in b[i:]:
                node = node.get(byte)
                if node is None:
                    break
                j += 1
                if -1 in node:
                    found.append((i, j, node[-1]))
        return len(b), found

    def _arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same trie as sorted (node, byte) keys, the nodes they lead to, and by node the piece that ends there."""
        keys, nodes, pieces, queue = [], [], [self.root.get(-1, -1)], [(0, self.root)]
        for number, node in queue:
            for byte, below in node.items():
                if byte >= 0:
                    keys.append(number << 8 | byte)
                    nodes.append(len(pieces))
                    queue.append((len(pieces), below))
                    pieces.append(below.get(-1, -1))
        order = np.argsort(keys)
        return np.array(keys, np.int64)[order], np.array(nodes, np.int64)[order], np.array(pieces, np.int64)

    def log_likelihoods(self, words: list[str], probabilities: np.ndarray) -> np.ndarray:
        """Forward algorithm for many words and every language at once: words x languages."""
        out = np.zeros((len(words), probabilities.shape[1]))
        spelled = [b" " + w.encode("utf-8", "replace") for w in words]
        by_length: dict[int, list[int]] = {}
        for k, b in enumerate(spelled):
            by_length.setdefault(len(b), []).append(k)
        for n, group in by_length.items():
            for at in range(0, len(group), max(1, CELLS // n)):
                part = group[at : at + max(1, CELLS // n)]
                out[part] = self._forward(np.frombuffer(b"".join(spelled[k] for k in part), np.uint8).reshape(-1, n), probabilities)
        return out

    def _forward(self, letters: np.ndarray, probabilities: np.ndarray) -> np.ndarray:
        """For words of one length, in step: ways to reach each byte, weighted by their probability."""
        if self.arrays is None:
            self.arrays = self._arrays()
        keys, nodes, piece_at = self.arrays
        count, n = letters.shape
        ways = np.zeros((n + 1, count, probabilities.shape[1]))
        ways[0] = 1.0
        lifted = np.zeros(ways.shape[1:])
        for start in range(n):
            if start % 8 == 7:  # keep long words in range
                small = (ways[start] > 0) & (ways[start] < 1 / SCALE)
                if small.any():
                    lifted += small
                    ways[start : start + self.longest + 1] *= np.where(small, SCALE, 1.0)
            word, node = np.arange(count), np.zeros(count, np.int64)
            for at in range(start, min(n, start + self.longest)):
                key = node << 8 | letters[word, at]
                found = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                alive = keys[found] == key
                word, node = word[alive], nodes[found[alive]]
                if not len(word):
                    break
                ends = piece_at[node] >= 0
                own = word[ends]
                ways[at + 1, own] += ways[start, own] * probabilities[piece_at[node[ends]]]
        return np.log(np.maximum(ways[n], 1e-300)) - lifted * math.log(SCALE)

    def expected_counts(self, word: str, p: np.ndarray) -> list[tuple[int, float]]:
        """(piece, expected uses) under one language's probabilities."""
        n, arcs = self.arcs(word)
        forward, up = _sums(n, [(i, j, p[k]) for i, j, k in arcs], self.longest)
        backward, down = _sums(n, sorted((n - j, n - i, p[k]) for i, j, k in arcs), self.longest)
        total = forward[n]
        if not total > 0:
            return []
        return [(k, forward[i] * p[k] * backward[n - j] / total * SCALE ** (up[n] - up[i] - down[n - j])) for i, j, k in arcs]


def _sums(n: int, arcs: list[tuple[int, int, float]], longest: int) -> tuple[list[float], list[int]]:
    """Weighted ways to reach 0..n by arcs in order of start, and how often each has been multiplied by ``SCALE``."""
    ways, lifts, lifted, here = [1.0] + [0.0] * n, [0] * (n + 1), 0, -1
    for i, j, weight in arcs:
        if i != here:
            lifts[here + 1 : i] = [lifted] * (i - here - 1)
            if 0 < ways[i] < 1 / SCALE:  # all that is reached so far lies within the longest arc
                ways[i : i + longest + 1] = [w * SCALE for w in ways[i : i + longest + 1]]
                lifted += 1
            here, lifts[i] = i, lifted
        ways[j] += ways[i] * weight
    lifts[here + 1 :] = [lifted] * (n - here)
    return ways, lifts


@dataclass(frozen=True)
class Model:
    """Languages in order, and by piece the probabilities in each."""

    languages: tuple[str, ...]
    probabilities: np.ndarray


def _training_rows(docs: DataFrame, use: Column, per_language: int) -> tuple[list[str], DataFrame]:
    """The languages, and about ``per_language`` documents of each: those whose hash falls below the language's share.

    The hash is of doc_id and text, so rows of one doc_id, or of none, are drawn like others; only equal rows go together.
    """
    rows = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where(use & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = cut(rows.groupBy("lang").agg((per_language / F.count("*")).alias("share")))  # a row a language
    below = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < F.col("share") * (1 << 20)
    return sorted(r["lang"] for r in counts.select("lang").collect()), rows.join(F.broadcast(counts), "lang").where(below).select("text", "lang")


def _word_counts(rows: DataFrame) -> DataFrame:
    """lang, word, n: counted in each batch first."""

    def run(batches):
        let_go()
        for batch in batches:
            counts: Counter = Counter()
            for text, lang in zip(batch["text"].to_pylist(), batch["lang"].to_pylist()):
                for word, n in Counter(words(text)).items():
                    counts[lang, word] += n
            kept = [(lang, word, n) for (lang, word), n in counts.items() if has_letter(word)]
            columns = list(zip(*kept)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64())], ["lang", "word", "n"])

    return rows.select("text", "lang").mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, vocabulary_path: str, use: Column | None = None, per_language: int = PER_LANGUAGE, rounds: int = ROUNDS) -> Model:
    """``docs`` (doc_id, text, lang); ``use`` says which rows may teach.  The vocabulary file must be on every node."""
    languages, rows = _training_rows(docs, F.lit(True) if use is None else use, per_language)
    pieces = read_pieces(vocabulary_path)
    p = np.full((len(pieces), max(1, len(languages))), 1.0 / len(pieces))
    if not languages:
        return Model((), p)
    counts = _word_counts(rows).persist()
    spark = docs.sparkSession
    try:
        for _ in range(rounds):
            sent = spark.sparkContext.broadcast(p)

            def expect(batches, sent=sent):
                let_go()
                lattice = Lattice(read_pieces(vocabulary_path))
                by_language = {lang: sent.value[:, k].tolist() for k, lang in enumerate(languages)}
                sums = {lang: np.zeros(lattice.size) for lang in languages}
                for batch in batches:
                    for lang, word, n in zip(*(batch[c].to_pylist() for c in ("lang", "word", "n"))):
                        for piece, uses in lattice.expected_counts(word, by_language[lang]):
                            sums[lang][piece] += uses * n
                for k, lang in enumerate(languages):
                    used = np.flatnonzero(sums[lang])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), k), pa.int32()), pa.array(used, pa.int32()), pa.array(sums[lang][used])], ["lang", "piece", "uses"])

            # At most vocabulary x languages rows come back.
            found = counts.mapInArrow(expect, "lang int, piece int, uses double").groupBy("lang", "piece").agg(F.sum("uses").alias("uses")).toPandas()
            c = np.zeros_like(p)
            c[found["piece"].to_numpy(), found["lang"].to_numpy()] = found["uses"].to_numpy()
            background = (c.sum(axis=1) + 0.01) / (c.sum() + 0.01 * len(pieces))
            c += PRIOR_WEIGHT * background[:, None]
            p = np.maximum(c / c.sum(axis=0), LEAST)
    finally:
        counts.unpersist()
    return Model(tuple(languages), p)


class Scorer:
    """Texts in, (language, score) out; the likelihoods of recent words are remembered."""

    def __init__(self, model: Model, pieces: dict[bytes, int]):
        self.model, self.lattice = model, Lattice(pieces)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.table = np.zeros((1 << 12, len(self.model.languages)))

    def _learn(self, new: list[str]) -> None:
        at = len(self.known)
        while at + len(new) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        spelled = [w for w in new if has_letter(w)]
        other = [w for w in new if not has_letter(w)]
        self.table[at : at + len(spelled)] = self.lattice.log_likelihoods(spelled, self.model.probabilities)
        self.known.update(zip(spelled + other, range(at, at + len(new))))

    def score(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if not self.model.languages:
            return [(UNKNOWN, 0.0)] * len(texts)
        found = [words(t) for t in texts]
        new = set().union(*found) - self.known.keys()
        if len(self.known) + len(new) > REMEMBERED:
            self._forget()
            new = set().union(*found)
        self._learn(list(new))
        out = []
        for own in found:
            if not any(map(has_letter, own)):
                out.append((UNKNOWN, 0.0))
                continue
            total = self.table[np.fromiter(map(self.known.__getitem__, own), np.int64, len(own))].sum(axis=0)
            odds = np.exp((total - total.max()) / math.sqrt(len(own)))
            best = int(odds.argmax())
            out.append((self.model.languages[best], float(odds[best] / odds.sum())))
        return out


def predict(docs: DataFrame, model: Model, vocabulary_path: str) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, lang_pred, score; one row per input row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        let_go()
        scorer = Scorer(sent.value, read_pieces(vocabulary_path))
        for batch in slices(batches, ROWS):
            found = scorer.score(batch["text"].to_pylist())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_known(docs: DataFrame, model: Model, vocabulary_path: str, least_score: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose language is ``und`` or scores below ``least_score``; all columns stay."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        let_go()
        scorer = Scorer(sent.value, read_pieces(vocabulary_path))
        for batch in slices(batches, ROWS):
            found = scorer.score(batch.column(at).to_pylist())
            yield batch.filter(pa.array([lang != UNKNOWN and score >= least_score for lang, score in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
