"""Boosted models fitted from histograms: additive logistic regression by stumps, and second-order trees.

Both work on kinds of rows (``expanded``, ``label``, ``weight``).  Values become bin numbers once: a bin per distinct value
of a column, or per quantile where there are more than ``MOST_BINS``; kinds that fall together are one.  A round is then one
aggregate over the kinds (for a tree one per level): every task adds two statistics by node, column and bin, and the sums,
as many as the model has bins, decide on the driver.  No row leaves the cluster.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querysieve.operators.held import held

MOST_BINS = 64
TIE = 1e-9  # gains that differ by less, relatively, count as equal: the first column and bin is taken
CUT_EVERY = 10  # rounds after which the margins are written
IN_A_TASK = 20_000  # kinds; fewer than that many a core are dealt over fewer tasks
DIRECT = 4  # tasks whose sums are added up on the driver, without a shuffle


@dataclass(frozen=True)
class Bins:
    """By column its ascending upper limits: a value is in bin ``k`` if it is over limit ``k - 1`` and at most limit ``k``.

    The bin after those of all values is that of missing ones (NaN).
    """

    limits: list[np.ndarray]

    @property
    def width(self) -> int:
        return max(map(len, self.limits), default=0) + 2

    def missing(self, column: int) -> int:
        return len(self.limits[column]) + 1

    def of(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(x.shape, np.uint8)
        for k, limits in enumerate(self.limits):
            out[:, k] = np.where(np.isnan(x[:, k]), len(limits) + 1, np.searchsorted(limits, x[:, k]))
        return out


def find_bins(kinds: DataFrame, most: int = MOST_BINS) -> Bins:
    """Limits half-way between neighbouring values; ``most`` values a column at most come to the driver."""
    size = kinds.agg(F.coalesce(F.max(F.size("expanded")), F.lit(0))).first()[0]
    values = held(kinds.select(F.posexplode(F.col("expanded").cast("array<double>")).alias("at", "x")).where(~F.isnan("x") & F.col("x").isNotNull()).distinct())
    counts = held(values.groupBy("at").agg(F.count("*").alias("n"), F.percentile_approx("x", [k / most for k in range(1, most)], F.lit(10_000)).alias("cuts")))
    few = values.join(F.broadcast(counts.where(F.col("n") <= most).select("at")), "at", "left_semi")  # a row a column
    own: dict[int, list[float]] = {}
    for r in few.collect():
        own.setdefault(r["at"], []).append(r["x"])
    limits = [np.empty(0)] * size
    for at, found in own.items():
        found = np.sort(np.array(found))
        limits[at] = (found[1:] + found[:-1]) / 2
    for r in counts.where(F.col("n") > most).collect():
        limits[r["at"]] = np.unique(r["cuts"])
    return Bins(limits)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of lists of equal length; nulls are missing."""
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(-1, width)


def binned(kinds: DataFrame, bins: Bins) -> DataFrame:
    """Kinds -> bins (a byte a column), label, weight; those in the same bins are one kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = bins.of(_matrix(batch["expanded"].cast(pa.list_(pa.float64())), len(bins.limits)))
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in found], pa.binary()), batch["label"].cast(pa.float64()), batch["weight"]], names=["bins", "label", "weight"])

    rows = kinds.select("expanded", "label", "weight").mapInArrow(run, "bins binary, label double, weight double")
    return rows.groupBy("bins", "label").agg(F.sum("weight").alias("weight"))


Statistics = Callable[[np.ndarray, pa.RecordBatch], tuple[np.ndarray, np.ndarray, np.ndarray]]


def dealt(rows: DataFrame) -> tuple[DataFrame, int]:
    """Held rows over as many partitions as they are worth, and that number: a round is a job, and its tasks cost more than few kinds."""
    tasks = -(-rows.count() // IN_A_TASK) or 1
    return (rows.coalesce(tasks) if tasks <= DIRECT else rows), tasks


def histograms(rows: DataFrame, bins: Bins, nodes: int, statistics: Statistics, tasks: int = DIRECT + 1) -> np.ndarray:
    """Sums of two statistics by (node, column, bin).

    ``statistics`` gives, for the bins of a batch of rows and the batch itself, each row's node (-1: none) and its two
    values.  A task adds up its rows first; what is shuffled and collected is at most nodes x columns x bins sums, of up to
    ``DIRECT`` ``tasks`` as many each and without a shuffle.
    """
    d, width = len(bins.limits), bins.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, nodes * d * width))
        for batch in batches:
            found = np.frombuffer(b"".join(batch["bins"].to_pylist()), np.uint8).reshape(-1, d)
            node, *values = statistics(found, batch)
            inside = node >= 0
            base = node[inside] * d * width
            for k in range(d):
                at = base + k * width + found[inside, k]
                for t, v in zip(total, values):
                    t += np.bincount(at, v[inside], len(t))
        at = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), *(pa.array(t[at]) for t in total)], names=["at", "a", "b"])

    sums = rows.mapInArrow(run, "at long, a double, b double")
    sums = (sums if tasks <= DIRECT else sums.groupBy("at").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))).toArrow()
    out = np.zeros((2, nodes * d * width))
    for k, c in enumerate("ab"):
        np.add.at(out[k], sums["at"].to_numpy(), sums[c].to_numpy())
    return out.reshape(2, nodes, d, width)


def _best(gain: np.ndarray) -> tuple[int, ...] | None:
    """The first place of the largest gain; places that aren't allowed are -inf."""
    most = gain.max(initial=-np.inf)
    if not np.isfinite(most):
        return None
    return tuple(int(k) for k in np.argwhere(gain >= most - TIE * max(1.0, abs(most)))[0])


# --- additive logistic regression


LARGEST_RESPONSE = 3.0  # working responses are cut off there
LEAST_CHANCE = 1e-10  # weights p(1 - p) don't go below


@dataclass(frozen=True)
class Stump:
    column: int
    limit: float
    low: float  # what is added to the score up to the limit
    high: float  # and beyond; a missing value counts as beyond


@dataclass
class Stumps:
    """The sum of stumps; a row is of class 1 if it is over 0."""

    stumps: list[Stump] = field(default_factory=list)

    def score(self, expanded: Column) -> Column:
        total = F.lit(0.0)
        for s in self.stumps:
            total = total + F.when(F.get(expanded, F.lit(s.column)).cast("double") <= s.limit, s.low).otherwise(s.high)
        return total

    def transform(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("prediction", (self.score(F.col("expanded")) > 0).cast("double"))


def logit_boost(kinds: DataFrame, rounds: int = 50) -> Stumps:
    """Newton steps for the logistic likelihood (Friedman, Hastie, Tibshirani 2000), each a weighted least-squares stump.

    With score S and chance p = 1 / (1 + exp(-2 S)) a row's working response is z = (y - p) / (p (1 - p)) with weight
    p (1 - p); half of the stump that fits z best is added.  As all stumps look at one column, the score is a sum of one
    number per column and bin: a round reads the kinds once and keeps nothing on them.
    """
    bins = find_bins(kinds)
    d, width = len(bins.limits), bins.width
    rows, tasks = dealt(held(binned(kinds, bins)))
    rows, model = rows.persist(), Stumps()
    parts = np.zeros((d, width))
    try:
        for _ in range(rounds if d else 0):

            def statistics(found: np.ndarray, batch: pa.RecordBatch, parts: np.ndarray = parts.copy()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                p = 1 / (1 + np.exp(-2 * parts[np.arange(d), found].sum(axis=1)))
                chance = np.maximum(p * (1 - p), LEAST_CHANCE)
                z = np.clip((batch["label"].to_numpy() - p) / chance, -LARGEST_RESPONSE, LARGEST_RESPONSE)
                w = batch["weight"].to_numpy() * chance
                return np.zeros(len(w), np.int64), w, w * z

            w, wz = histograms(rows, bins, 1, statistics, tasks)[:, 0]
            low = np.cumsum(np.stack([w, wz]), axis=2)
            high = low[:, :, -1:] - low
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where((low[0] > 0) & (high[0] > 1e-12 * low[0, :, -1:]), low[1] ** 2 / low[0] + high[1] ** 2 / high[0], -np.inf)
            for k, limits in enumerate(bins.limits):
                gain[k, len(limits) :] = -np.inf
            at = _best(gain)
            if at is None:
                break
            k, b = at
            values = [0.5 * float(side[1, k, b] / side[0, k, b]) for side in (low, high)]
            model.stumps.append(Stump(k, float(bins.limits[k][b]), *values))
            parts[k, : b + 1] += values[0]
            parts[k, b + 1 :] += values[1]
    finally:
        rows.unpersist()
    return model


# --- second-order trees


RATE, DEPTH, PENALTY, LEAST_HESSIAN = 0.1, 6, 1.0, 1.0


@dataclass(frozen=True)
class Node:
    """A leaf's value, or a split: bins up to ``bin`` go left, missing ones where ``missing_left`` says."""

    value: float
    column: int = -1
    bin: int = 0
    missing_left: bool = False
    left: int = -1
    right: int = -1


@dataclass
class Trees:
    """Trees over bins; a row is of class 1 if the sum of their leaves is over 0."""

    bins: Bins
    trees: list[list[Node]] = field(default_factory=list)

    def margins(self, x: np.ndarray) -> np.ndarray:
        found = self.bins.of(x)
        return sum((np.array([n.value for n in t])[place(t, found, self.bins)] for t in self.trees), np.zeros(len(x)))

    def transform(self, rows: DataFrame) -> DataFrame:
        @F.pandas_udf("double")
        def prediction(expanded: pd.Series) -> pd.Series:
            x = np.stack(expanded.to_numpy()).astype(float) if len(expanded) else np.empty((0, len(self.bins.limits)))
            return pd.Series((self.margins(x) > 0).astype(float))

        return rows.withColumn("prediction", prediction(F.col("expanded").cast("array<double>")))


def place(tree: list[Node], found: np.ndarray, bins: Bins) -> np.ndarray:
    """The leaf (or not yet split node) of each row."""
    column, limit, missing, left, right = (np.array([getattr(n, c) for n in tree]) for c in ("column", "bin", "missing_left", "left", "right"))
    absent = np.array([bins.missing(k) for k in range(len(bins.limits))])
    at, rows = np.zeros(len(found), np.int64), np.arange(len(found))
    while (inner := column[at] >= 0).any():
        r, n = rows[inner], at[inner]
        own = found[r, column[n]]
        goes_left = np.where(own == absent[column[n]], missing[n], own <= limit[n])
        at[inner] = np.where(goes_left, left[n], right[n])
    return at


def _leaf(g: float, h: float) -> Node:
    return Node(-RATE * float(g / (h + PENALTY)))


def _sides(g: np.ndarray, h: np.ndarray, bins: Bins, split: tuple[int, int, bool]) -> list[tuple[float, float]]:
    """Gradient and hessian of both sides of a split."""
    k, limit, missing_left = split
    left = np.arange(g.shape[1]) <= limit
    left[bins.missing(k)] = missing_left
    return [(float(g[k, side].sum()), float(h[k, side].sum())) for side in (left, ~left)]


def _split(g: np.ndarray, h: np.ndarray, bins: Bins) -> tuple[int, int, bool] | None:
    """Column, bin and side of missing values of the best split of a node's histogram (column, bin), if any gains."""
    total_g, total_h = g[0].sum(), h[0].sum()
    d, width = g.shape
    gain = np.full((d, width, 2), -np.inf)
    for k, limits in enumerate(bins.limits):
        n, absent = len(limits), bins.missing(k)
        for side in (0, 1):  # missing values go right, left
            if side and not h[k, absent]:
                continue
            left_g, left_h = np.cumsum(g[k, :n]) + side * g[k, absent], np.cumsum(h[k, :n]) + side * h[k, absent]
            right_g, right_h = total_g - left_g, total_h - left_h
            allowed = (left_h >= LEAST_HESSIAN - 1e-12) & (right_h >= LEAST_HESSIAN - 1e-12)
            gain[k, :n, side] = np.where(allowed, left_g**2 / (left_h + PENALTY) + right_g**2 / (right_h + PENALTY) - total_g**2 / (total_h + PENALTY), -np.inf)
    at = _best(gain)
    return None if at is None or gain[at] <= 1e-6 else (at[0], at[1], bool(at[2]))


def second_order_trees(kinds: DataFrame, rounds: int = 50, depth: int = DEPTH) -> Trees:
    """Trees on gradients and hessians of the logistic loss, grown level by level (Chen and Guestrin 2016).

    A split gains GL^2/(HL + 1) + GR^2/(HR + 1) - G^2/(H + 1), each side needs a hessian of 1, missing values go to the side
    that gains more, and a leaf adds -0.1 G/(H + 1).  What both sides of a split add is known from it, so only nodes that may be
    split once more are looked at again.  Rows keep their margin from round to round; it is written every ``CUT_EVERY`` rounds,
    so that no plan grows.
    """
    bins = find_bins(kinds)
    model = Trees(bins)
    rows, tasks = dealt(held(binned(kinds, bins).withColumn("margin", F.lit(0.0))))
    cached = [rows := rows.persist()]
    try:
        for done in range(rounds):
            tree, open_nodes = [Node(0.0)], [0]
            for level in range(max(depth, 1)):

                def statistics(found: np.ndarray, batch: pa.RecordBatch, tree: list[Node] = list(tree), open_nodes: list[int] = list(open_nodes)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                    number = np.full(len(tree), -1)
                    number[open_nodes] = np.arange(len(open_nodes))
                    p, w = 1 / (1 + np.exp(-batch["margin"].to_numpy())), batch["weight"].to_numpy()
                    return number[place(tree, found, bins)], w * (p - batch["label"].to_numpy()), w * p * (1 - p)

                g, h = histograms(rows, bins, len(open_nodes), statistics, tasks)
                further = []
                for k, node in enumerate(open_nodes if len(bins.limits) else []):
                    value = _leaf(g[k, 0].sum(), h[k, 0].sum()).value
                    split = _split(g[k], h[k], bins) if level < depth else None
                    tree[node] = Node(value, *split, len(tree), len(tree) + 1) if split else Node(value)
                    for own in _sides(g[k], h[k], bins, split) if split else []:
                        if level + 1 < depth and own[1] >= 2 * LEAST_HESSIAN - 1e-9:  # less can't give a hessian of 1 to both sides
                            further.append(len(tree))
                        tree.append(_leaf(*own))
                if not further:
                    break
                open_nodes = further
            model.trees.append(tree)

            def add(batches: Iterator[pa.RecordBatch], tree: list[Node] = tree) -> Iterator[pa.RecordBatch]:
                values = np.array([n.value for n in tree])
                for batch in batches:
                    found = np.frombuffer(b"".join(batch["bins"].to_pylist()), np.uint8).reshape(-1, len(bins.limits))
                    margin = batch["margin"].to_numpy() + values[place(tree, found, bins)]
                    yield pa.RecordBatch.from_arrays([batch["bins"], batch["label"], batch["weight"], pa.array(margin)], names=["bins", "label", "weight", "margin"])

            new = rows.mapInArrow(add, "bins binary, label double, weight double, margin double")
            cached.append((held(new) if done % CUT_EVERY == CUT_EVERY - 1 else new).persist())
            rows = cached[-1]
            while len(cached) > 2:  # the one before is still read when the next round fills the cache
                cached.pop(0).unpersist()
    finally:
        for c in cached:
            c.unpersist()
    return model
