"""The linear support vector machine in its dual, over kinds of rows with weights.

Minimises |w|^2 / 2 + C x sum of weight x max(0, 1 - y (w . x)), every column of x brought to 0..1 and one column of ones
added for the offset.  The dual has one number per kind, between 0 and C x weight.

Blocks of kinds are worked on side by side (Ma et al. 2015): each task goes over its own numbers again and again, as if w
changed ``blocks`` times as fast as it alone makes it, and the changes of all blocks are added to w.  Every round deals the
kinds anew (the same blocks again and again come to no end).  Only w goes out and comes back; a round also gives both
objectives, whose distance bounds the error and ends the work.  A single block has nobody to wait for: its task looks at
the objectives itself and goes on from round to round, up to ``VISITS`` of kinds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querysieve.operators.held import held

C = 1.0
GAP = 1e-3  # of the primal objective
PASSES, MOST_ROUNDS = 30, 200
IN_A_BLOCK = 50_000  # kinds
VISITS = 3_000_000  # of kinds, in a row of rounds that one task works on when there is one block
STATE = "number long, x array<double>, y double, upper double, dual double, change array<double>, loss double"
STATE_COLUMNS = [c.split()[0] for c in STATE.split(", ")]


@dataclass(frozen=True)
class LinearMachine:
    """``weights`` for the columns as they are, and the offset; a row is of class 1 if it is over 0."""

    weights: list[float]
    offset: float
    gap: float  # of the objectives, relative to the primal one
    rounds: int

    def transform(self, rows: DataFrame) -> DataFrame:
        products = F.zip_with(F.col("expanded").cast("array<double>"), F.lit(self.weights).cast("array<double>"), lambda x, w: x * w)
        score = F.aggregate(products, F.lit(float(self.offset)), lambda s, x: s + x)
        return rows.withColumn("prediction", (score > 0).cast("double"))


def ranges(kinds: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The least value and the spread of every column (1 where all are equal)."""
    own = kinds.select(F.posexplode(F.col("expanded").cast("array<double>")).alias("at", "x")).groupBy("at").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    found = own.orderBy("at").toArrow()  # a row a column
    low, high = found["low"].to_numpy(), found["high"].to_numpy()
    return low, np.where(high > low, high - low, 1.0)


def _ascend(x: np.ndarray, y: np.ndarray, upper: np.ndarray, dual: np.ndarray, w: np.ndarray, blocks: int, passes: int) -> tuple[np.ndarray, np.ndarray]:
    """One block: new duals, and the change of w they make."""
    start, dual, at = w, dual.copy(), w.copy()
    size = np.einsum("ij,ij->i", x, x) * blocks
    draw = np.random.default_rng(len(x))
    for _ in range(passes):
        moved = 0.0
        for i in draw.permutation(len(x)).tolist():
            new = min(max(dual[i] + (1 - y[i] * (x[i] @ at)) / size[i], 0.0), upper[i])
            if step := new - dual[i]:
                dual[i] = new
                at += blocks * step * y[i] * x[i]
                moved = max(moved, abs(step) / upper[i])
        if moved < 1e-6:
            break
    return dual, (at - start) / blocks


def fit(kinds: DataFrame, c: float = C, gap: float = GAP, in_a_block: int = IN_A_BLOCK, passes: int = PASSES, most_rounds: int = MOST_ROUNDS) -> LinearMachine:
    """``kinds``: expanded, label, weight."""
    kinds = held(kinds.select("expanded", "label", "weight"))
    n = kinds.count()
    if not n:
        return LinearMachine([], 0.0, 0.0, 0)
    low, spread = ranges(kinds)
    blocks = -(-n // in_a_block)

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = (np.asarray(batch["expanded"].flatten(), float).reshape(-1, len(low)) - low) / spread
            lists = pa.array(np.c_[x, np.ones(len(x))].tolist(), pa.list_(pa.float64()))
            y, upper = 2 * batch["label"].cast(pa.float64()).to_numpy() - 1, c * batch["weight"].to_numpy()
            yield pa.RecordBatch.from_arrays([lists, pa.array(y), pa.array(upper)], names=["x", "y", "upper"])

    made = kinds.mapInArrow(scaled, "x array<double>, y double, upper double")
    state = held(made.select(F.monotonically_increasing_id().alias("number"), "*", F.lit(0.0).alias("dual"), F.lit(None).cast("array<double>").alias("change"), F.lit(None).cast("double").alias("loss")))
    w = np.zeros(len(low) + 1)
    for done in range(1, most_rounds + 1):
        dealt = state.where("y is not null").groupBy(F.pmod(F.xxhash64("number", F.lit(done)), F.lit(blocks)).alias("block"))
        together = max(1, min(most_rounds, VISITS // (n * passes))) if blocks == 1 else 1
        state = held(dealt.applyInArrow(_round(w, blocks, passes, together, gap), STATE))
        told = state.where("y is null").select("dual", "change", "loss").collect()  # a row a block
        # Both objectives at the w that the round began with, which is the sum of dual x y x of all kinds.
        size = float(w @ w) / 2
        primal, dual = size + sum(r["loss"] for r in told), sum(r["dual"] for r in told) - size
        if primal - dual <= gap * primal:
            break
        w = w + np.sum([r["change"] for r in told], axis=0)
    weights = w[:-1] / spread
    return LinearMachine(weights.tolist(), float(w[-1] - weights @ low), (primal - dual) / primal, done)


def _round(w: np.ndarray, blocks: int, passes: int, together: int = 1, gap: float = GAP) -> Callable[[pa.Table], pa.Table]:
    def ascend(own: pa.Table) -> pa.Table:
        """A block with new duals, and a row of what it changes and its part of the objectives."""
        own = own.select(STATE_COLUMNS).sort_by("number").combine_chunks()
        x = np.asarray(own["x"].combine_chunks().flatten(), float).reshape(-1, len(w))
        y, upper, before = (own[k].to_numpy() for k in ("y", "upper", "dual"))
        loss = float((upper * np.maximum(0, 1 - y * (x @ w))).sum())
        dual, change = before, np.zeros(len(w))
        for k in range(together):
            if k:  # one block: both objectives are its own
                at = w + change
                size = float(at @ at) / 2
                primal = size + float((upper * np.maximum(0, 1 - y * (x @ at))).sum())
                if primal - (dual.sum() - size) <= gap * primal:
                    break
            dual, more = _ascend(x, y, upper, dual, w + change, blocks, passes)
            change = change + more
        rows = own.set_column(STATE_COLUMNS.index("dual"), "dual", pa.array(dual))
        told = [None, None, None, None, float(before.sum()), change.tolist(), loss]
        return pa.concat_tables([rows, pa.table([pa.array([v], f.type) for v, f in zip(told, rows.schema)], schema=rows.schema)])

    return ascend
