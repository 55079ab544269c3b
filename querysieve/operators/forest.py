"""A random forest on kinds of rows: trees on bootstrap draws, every node on a random choice of columns.

A forest draws each row Poisson(1) times for a tree, so it draws a kind of ``w`` equal rows Poisson(w) times: kinds get a
number of draws for every tree, and no row is needed singly.  Draws follow from the kind, its weight and the seed, whatever the partitions.

All trees grow side by side, level by level.  A level is one aggregate over the kinds for every ``CELLS`` sums: of the columns
that an open node has drawn, the draws by bin and class.  The split that lowers the Gini impurity most is taken; missing values
go right.  Leaves vote with their shares of the classes; where both sides of a split say the same, the split is taken back.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querysieve.operators.boosting import DIRECT, Bins, Node, _best, binned, dealt, find_bins, place
from querysieve.operators.held import held

CELLS = 2_000_000  # sums of a class that a task keeps at once
SLICE = 1000  # kinds that are looked at together


@dataclass
class Forest:
    """Trees over bins; the value of a leaf is its share of class 1, a row is of class 1 if the mean is over a half."""

    bins: Bins
    trees: list[list[Node]] = field(default_factory=list)

    def shares(self, x: np.ndarray) -> np.ndarray:
        found = self.bins.of(x)
        return sum((np.array([n.value for n in t])[place(t, found, self.bins)] for t in self.trees), np.zeros(len(x))) / max(len(self.trees), 1)

    def transform(self, rows: DataFrame) -> DataFrame:
        @F.pandas_udf("double")
        def prediction(expanded: pd.Series) -> pd.Series:
            x = np.stack(expanded.to_numpy()).astype(float) if len(expanded) else np.empty((0, len(self.bins.limits)))
            return pd.Series((self.shares(x) > 0.5 + 1e-9).astype(float))

        return rows.withColumn("prediction", prediction(F.col("expanded").cast("array<double>")))


def draws(kind: bytes, label: float, weight: float, trees: int, seed: int) -> np.ndarray:
    """How often a kind is drawn for each tree."""
    return np.random.default_rng([seed, int(label), *kind]).poisson(weight, trees)


def drawn(kinds: DataFrame, trees: int, seed: int) -> DataFrame:
    """bins, label, weight -> bins, label, drawn (a long a tree)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                times = [draws(*kind, trees, seed).astype("<i8").tobytes() for kind in zip(*(part[c].to_pylist() for c in ("bins", "label", "weight")))]
                yield pa.RecordBatch.from_arrays([part["bins"], part["label"], pa.array(times, pa.binary())], names=["bins", "label", "drawn"])

    return kinds.mapInArrow(run, "bins binary, label double, drawn binary")


def columns_of(tree: int, node: int, d: int, seed: int) -> np.ndarray:
    """The columns that a node looks at: as many as the root of their number, rounded up."""
    return np.sort(np.random.default_rng((seed, tree, node)).choice(d, int(np.ceil(np.sqrt(d))), replace=False))


def _counts(rows: DataFrame, bins: Bins, trees: list[list[Node]], open_nodes: list[tuple[int, int]], columns: np.ndarray, tasks: int) -> np.ndarray:
    """Draws by class, open node (tree, node), column it looks at, and bin."""
    d, width, m = len(bins.limits), bins.width, columns.shape[1]
    size = len(open_nodes) * m * width
    wanted = {t: trees[t] for t, _ in open_nodes}
    numbers = {t: np.full(len(tree), -1) for t, tree in wanted.items()}
    for k, (t, node) in enumerate(open_nodes):
        numbers[t][node] = k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, size))
        for batch in batches:
            for first in range(0, batch.num_rows, SLICE):
                part = batch.slice(first, SLICE)
                found = np.frombuffer(b"".join(part["bins"].to_pylist()), np.uint8).reshape(-1, d)
                times = np.frombuffer(b"".join(part["drawn"].to_pylist()), "<i8").reshape(len(found), -1)
                of = part["label"].to_numpy().astype(int)
                for t, tree in wanted.items():
                    number = numbers[t][place(tree, found, bins)]
                    r = np.flatnonzero((number >= 0) & (times[:, t] > 0))
                    own = number[r, None]
                    at = (own * m + np.arange(m)) * width + found[r[:, None], columns[number[r]]]
                    np.add.at(total, (of[r, None], at), times[r, t, None].astype(float))
        at = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), *(pa.array(t[at]) for t in total)], names=["at", "a", "b"])

    sums = rows.mapInArrow(run, "at long, a double, b double")
    sums = (sums if tasks <= DIRECT else sums.groupBy("at").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))).toArrow()
    out = np.zeros((2, size))
    for k, c in enumerate("ab"):
        np.add.at(out[k], sums["at"].to_numpy(), sums[c].to_numpy())
    return out.reshape(2, len(open_nodes), m, width)


def split_of(counts: np.ndarray, limits: list[int]) -> tuple[int, int, np.ndarray, np.ndarray] | None:
    """Of draws by (class, column, bin) the place of the column and the bin that lower the Gini impurity most, and the classes of both sides."""
    left = np.cumsum(counts, axis=2)
    right = left[:, :, -1:] - left
    n, m = left.sum(axis=0), right.sum(axis=0)
    total = counts[:, 0].sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        # Weighted impurity that goes: sums of squares by side, less those of the node.
        gain = np.where((n > 0) & (m > 0), (left**2).sum(axis=0) / n + (right**2).sum(axis=0) / m - (total**2).sum() / total.sum(), -np.inf)
    for k, most in enumerate(limits):
        gain[k, most:] = -np.inf
    at = _best(gain)
    return None if at is None or gain[at] <= 1e-9 * total.sum() else (*at, left[:, at[0], at[1]], right[:, at[0], at[1]])


def _leaf(counts: np.ndarray) -> Node:
    return Node(float(counts[1] / counts.sum()) if counts.sum() else 0.5)


def merged(tree: list[Node], totals: list[np.ndarray]) -> list[Node]:
    """Splits whose sides are leaves of one prediction become leaves, from below; children stand behind their parents."""
    tree = list(tree)
    for k in range(len(tree) - 1, -1, -1):
        if (n := tree[k]).column >= 0:
            sides = [tree[n.left], tree[n.right]]
            if all(s.column < 0 for s in sides) and (sides[0].value > 0.5) == (sides[1].value > 0.5):
                tree[k] = _leaf(totals[k])
    return tree


def fit(kinds: DataFrame, trees: int = 100, depth: int = 20, seed: int = 1) -> Forest:
    bins = find_bins(kinds)
    d = len(bins.limits)
    rows, tasks = dealt(held(drawn(binned(kinds, bins), trees, seed)))
    grown, totals = [[Node(0.5)] for _ in range(trees)], [[np.zeros(2)] for _ in range(trees)]
    open_nodes, rows = [(t, 0) for t in range(trees)] if d else [], rows.persist()
    try:
        for level in range(depth):
            further, before = [], [list(tree) for tree in grown]
            together = max(1, CELLS // (int(np.ceil(np.sqrt(d))) * bins.width)) if d else 1
            for first in range(0, len(open_nodes), together):
                some = open_nodes[first : first + together]
                columns = np.stack([columns_of(t, node, d, seed) for t, node in some])
                counts = _counts(rows, bins, before, some, columns, tasks)
                for k, (t, node) in enumerate(some):
                    if level == 0:
                        totals[t][0] = counts[:, k, 0].sum(axis=1)
                        grown[t][0] = _leaf(totals[t][0])
                    found = split_of(counts[:, k], [len(bins.limits[c]) for c in columns[k]])
                    if found is None:
                        continue
                    at, limit, *sides = found
                    grown[t][node] = replace(grown[t][node], column=int(columns[k][at]), bin=limit, left=len(grown[t]), right=len(grown[t]) + 1)
                    for side in sides:
                        if side.all():  # of both classes
                            further.append((t, len(grown[t])))
                        grown[t].append(_leaf(side))
                        totals[t].append(side)
            if not (open_nodes := further):
                break
    finally:
        rows.unpersist()
    return Forest(bins, [merged(tree, own) for tree, own in zip(grown, totals)])
