"""The boosted models, the forest and the linear machine against plain numpy on the rows themselves."""

import numpy as np
import pytest

from querysieve.operators import bayes, boosting, dualmachine, forest


def made(seed, n=160, missing=False):
    draw = np.random.default_rng(seed)
    x = np.c_[draw.integers(0, 6, n), draw.integers(0, 2, n), np.round(draw.normal(size=n), 1), np.zeros(n)].astype(np.float32)
    y = ((x[:, 0] > 2) ^ (x[:, 2] > 0.3) ^ (draw.random(n) < 0.1)).astype(int)
    if missing:
        x[draw.random(n) < 0.2, 0] = np.nan
    weight = draw.integers(1, 5, n).astype(float)
    return x, y, weight


def kinds(spark, x, y, weight):
    rows = [([float(v) for v in r], float(t), float(w)) for r, t, w in zip(x, y, weight)]
    return spark.createDataFrame(rows, "expanded array<float>, label double, weight double").repartition(3)


def limits(x):
    out = []
    for column in x.T.astype(float):
        v = np.unique(column[~np.isnan(column)])
        out.append((v[1:] + v[:-1]) / 2)
    return out


def stumps_by_rows(x, y, weight, rounds):
    score, out = np.zeros(len(x)), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-2 * score))
        chance = np.maximum(p * (1 - p), 1e-10)
        z, w = np.clip((y - p) / chance, -3, 3), weight * chance
        best = None
        for k, own in enumerate(limits(x)):
            for t in own:
                low = x[:, k] <= t
                means = [np.average(z[s], weights=w[s]) for s in (low, ~low)]
                error = (w * (z - np.where(low, *means)) ** 2).sum()
                if best is None or error < best[0] - 1e-9 * (w * z * z).sum():
                    best = error, k, t, means[0] / 2, means[1] / 2
        out.append(best[1:])
        score += np.where(x[:, best[1]] <= best[2], best[3], best[4])
    return out, score


@pytest.mark.parametrize("seed", range(2))
def test_every_stump(spark, seed):
    x, y, weight = made(seed)
    model = boosting.logit_boost(kinds(spark, x, y, weight), 12)
    want, score = stumps_by_rows(x.astype(float), y, weight, 12)
    assert [(s.column, s.limit) for s in model.stumps] == [pytest.approx(w[:2]) for w in want]
    np.testing.assert_allclose([(s.low, s.high) for s in model.stumps], [w[2:] for w in want], atol=1e-9)
    rows = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "id int, expanded array<float>")
    got = {r.id: r.prediction for r in model.transform(rows).collect()}
    assert [got[k] for k in range(len(x))] == [float(s > 0) for s in score]


def tree_by_rows(x, g, h, rows, depth, splits):
    """Leaf values of the rows of one node, by trying every limit and both sides for missing values."""
    G, H = g[rows].sum(), h[rows].sum()
    best = None
    for k, own in enumerate(splits if depth else []):
        for t in own:
            for missing_left in (False, True):
                absent = np.isnan(x[rows, k])
                if missing_left and not absent.any():
                    continue
                left = np.where(absent, missing_left, x[rows, k] <= t)
                gl, hl = g[rows][left].sum(), h[rows][left].sum()
                if hl < 1 or H - hl < 1:
                    continue
                gain = gl**2 / (hl + 1) + (G - gl) ** 2 / (H - hl + 1) - G**2 / (H + 1)
                if best is None or gain > best[0] + 1e-9 * max(1, abs(gain)):
                    best = gain, left
    if best is None or best[0] <= 1e-6:
        return {int(r): -0.1 * G / (H + 1) for r in rows}
    return tree_by_rows(x, g, h, rows[best[1]], depth - 1, splits) | tree_by_rows(x, g, h, rows[~best[1]], depth - 1, splits)


@pytest.mark.parametrize("seed, missing", [(1, False), (2, True)])
def test_whole_rounds_of_trees(spark, seed, missing):
    x, y, weight = made(seed, missing=missing)
    model = boosting.second_order_trees(kinds(spark, x, y, weight), 5, depth=4)
    x = x.astype(float)
    margin, splits = np.zeros(len(x)), limits(x)
    for _ in range(5):
        p = 1 / (1 + np.exp(-margin))
        leaf = tree_by_rows(x, weight * (p - y), weight * p * (1 - p), np.arange(len(x)), 4, splits)
        margin += [leaf[k] for k in range(len(x))]
    np.testing.assert_allclose(model.margins(x), margin, atol=1e-9)
    assert any(n.column >= 0 for n in model.trees[0])


def test_margins_are_written_between_rounds(spark):
    x, y, weight = made(4, 60)
    model = boosting.second_order_trees(kinds(spark, x, y, weight), 12, depth=1)
    rows = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "id int, expanded array<float>")
    got = {r.id: r.prediction for r in model.transform(rows).collect()}
    assert len(model.trees) == 12 and [got[k] for k in range(len(x))] == (model.margins(x.astype(float)) > 0).astype(float).tolist()


def test_columns_of_many_values(spark):
    """Limits are quantiles then: the largest bin holds few of the values."""
    x = np.arange(5000, dtype=float)[:, None]
    bins = boosting.find_bins(kinds(spark, x, x[:, 0] > 2000, np.ones(5000)))
    assert 60 <= len(bins.limits[0]) <= 63 and np.bincount(bins.of(x)[:, 0]).max() < 200
    model = boosting.logit_boost(kinds(spark, x, x[:, 0] > 2000, np.ones(5000)), 5)
    assert abs(model.stumps[0].limit - 2000) < 90


def objectives(x, y, upper, weights, offset, low, spread):
    w = np.r_[weights * spread, offset + weights @ low]
    return w @ w / 2 + (upper * np.maximum(0, 1 - (2 * y - 1) * (x @ weights + offset))).sum()


@pytest.mark.parametrize("in_a_block", [50_000, 40])
def test_dual_machine_is_near_its_optimum(spark, in_a_block):
    """The primal objective of what is found, computed from the rows, is within the gap of a long run in one block."""
    x, y, weight = made(6)
    x = x.astype(float)
    low, spread = x.min(axis=0), np.where(np.ptp(x, axis=0) > 0, np.ptp(x, axis=0), 1.0)
    model = dualmachine.fit(kinds(spark, x, y, weight), in_a_block=in_a_block)
    assert model.gap <= 1e-3
    mine = objectives(x, y, weight, np.array(model.weights), model.offset, low, spread)
    z = np.c_[(x - low) / spread, np.ones(len(x))]
    dual, w = np.zeros(len(x)), np.zeros(z.shape[1])
    for k in range(400_000):
        i = k % len(x)
        t = 2 * y[i] - 1
        new = min(max(dual[i] + (1 - t * (z[i] @ w)) / (z[i] @ z[i]), 0), weight[i])
        w, dual[i] = w + (new - dual[i]) * t * z[i], new
    best = dual.sum() - w @ w / 2  # no solution is below
    assert best <= mine * (1 + 1e-9) and mine - best <= 1e-3 * mine
    rows = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "id int, expanded array<float>")
    got = {r.id: r.prediction for r in model.transform(rows).collect()}
    assert [got[k] for k in range(len(x))] == (x.astype(np.float32) @ np.array(model.weights) + model.offset > 0).astype(float).tolist()


def test_nothing_to_learn(spark):
    none = spark.createDataFrame([], "expanded array<float>, label double, weight double")
    assert boosting.logit_boost(none).stumps == []
    assert dualmachine.fit(none).weights == []
    one = spark.createDataFrame([([1.0, 2.0], 1.0, 3.0)], "expanded array<float>, label double, weight double")
    assert boosting.logit_boost(one).stumps == []
    assert dualmachine.fit(one).transform(one).first().prediction == 1.0
    assert boosting.second_order_trees(one, 2).transform(one).first().prediction == 1.0


def test_precise_bayes(spark):
    x, y, weight = made(9)
    x, own = x.astype(float), np.repeat(np.arange(len(x)), weight.astype(int))
    model = bayes.fit(kinds(spark, x, y, weight))
    rounded, precision = x.copy(), []
    for k in range(x.shape[1]):
        v = np.unique(x[:, k])
        precision.append(np.diff(v).mean() if len(v) > 1 else 0.01)
        rounded[:, k] = np.rint(x[:, k] / precision[k]) * precision[k]
    np.testing.assert_allclose(model.precision, precision)
    scores = []
    for label in (0, 1):
        rows = rounded[own][y[own] == label]
        mean, deviation = rows.mean(axis=0), np.maximum(rows.std(axis=0), np.array(precision) / 6)
        np.testing.assert_allclose(model.classes[label][1:], [mean, deviation])
        scores.append(np.log((len(rows) + 1) / (len(own) + 2)) + (-np.log(deviation) - ((rounded - mean) / deviation) ** 2 / 2).sum(axis=1))
    rows = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "id int, expanded array<double>")
    got = {r.id: r.prediction for r in model.transform(rows).collect()}
    assert [got[k] for k in range(len(x))] == (scores[1] > scores[0]).astype(float).tolist()
    one = spark.createDataFrame([([1.0], 1.0, 2.0)], "expanded array<float>, label double, weight double")
    assert bayes.fit(one).transform(one).first().prediction == 1.0
    assert bayes.fit(one.limit(0)).transform(one).first().prediction == 0.0


def test_one_block_takes_few_rounds(spark, monkeypatch):
    """A single block goes on within its task until the gap is reached; the driver only looks whether it is."""
    x, y, weight = made(6)
    started, real = [], dualmachine._round
    monkeypatch.setattr(dualmachine, "_round", lambda *a: started.append(a[1]) or real(*a))
    assert dualmachine.fit(kinds(spark, x, y, weight), passes=1).gap <= 1e-3
    assert len(started) <= 3


@pytest.mark.parametrize("direct", [boosting.DIRECT, 0])
def test_levels_that_cannot_split_are_not_read(spark, monkeypatch, direct):
    """What the last level's leaves add is known from the splits above; sums are added with a shuffle or without one."""
    monkeypatch.setattr(boosting, "DIRECT", direct)
    x, y, weight = made(1)
    read, real = [], boosting.histograms
    monkeypatch.setattr(boosting, "histograms", lambda *a: read.append(a[2]) or real(*a))
    model = boosting.second_order_trees(kinds(spark, x, y, weight), 2, depth=2)
    assert read == [1, 2, 1, 2] and all(len(t) == 7 for t in model.trees)
    margin, splits = np.zeros(len(x)), limits(x)
    for _ in range(2):
        p = 1 / (1 + np.exp(-margin))
        leaf = tree_by_rows(x.astype(float), weight * (p - y), weight * p * (1 - p), np.arange(len(x)), 2, splits)
        margin += [leaf[k] for k in range(len(x))]
    np.testing.assert_allclose(model.margins(x.astype(float)), margin, atol=1e-9)


@pytest.mark.parametrize("cells, direct, missing", [(2_000_000, 4, False), (60, 0, True)])
def test_forest_grows_as_by_rows(spark, monkeypatch, cells, direct, missing):
    """Every split is the best of the columns drawn; all nodes of a level at once or few, sums with a shuffle or without."""
    monkeypatch.setattr(forest, "CELLS", cells)
    monkeypatch.setattr(forest, "DIRECT", direct)
    monkeypatch.setattr(forest, "merged", lambda tree, totals: tree)
    x, y, weight = made(4, missing=missing)
    x, depth, seed = x.astype(float), 3, 5
    model = forest.fit(kinds(spark, x, y, weight), 3, depth, seed)
    of, number = model.bins.of(x), {}
    for k in range(len(x)):
        number[of[k].tobytes(), float(y[k])] = number.get((of[k].tobytes(), float(y[k])), 0.0) + weight[k]
    found, label = np.array([list(b) for b, _ in number]), np.array([c for _, c in number])
    drawn = np.array([forest.draws(b, c, w, 3, seed) for (b, c), w in number.items()])

    def impurity(times):
        n = times.sum()
        return 2 * times[label == 1].sum() * times[label == 0].sum() / n if n else 0.0

    def check(tree, at, t, times, level):
        node, n = tree[at], times.sum()
        gains = {}
        for c in forest.columns_of(t, at, x.shape[1], seed):
            for b in range(len(model.bins.limits[c])):
                left = times * (found[:, c] <= b)
                if 0 < left.sum() < n:
                    gains[c, b] = impurity(times) - impurity(left) - impurity(times - left)
        if node.column < 0:
            assert level == depth or max(gains.values(), default=0) <= 1e-9 * n
            assert node.value == pytest.approx(times[label == 1].sum() / n)
            return 1
        assert gains[node.column, node.bin] == pytest.approx(max(gains.values()))
        left = times * (found[:, node.column] <= node.bin)
        return check(tree, node.left, t, left, level + 1) + check(tree, node.right, t, times - left, level + 1)

    leaves = [check(tree, 0, t, drawn[:, t], 0) for t, tree in enumerate(model.trees)]
    assert min(leaves) > 2 and len(set(leaves)) + len({tree[0].column for tree in model.trees}) > 2
    assert ((model.shares(x) > 0.5) == y).mean() > 0.6


def test_forest_draws_kinds_as_rows():
    """A kind of w rows is drawn as the sum of w rows would be: mean and variance are w."""
    got = forest.draws(b"\1\2", 1.0, 40.0, 20_000, 1)
    assert got.mean() == pytest.approx(40, rel=0.01) and got.var() == pytest.approx(40, rel=0.05)
    assert (forest.draws(b"\1\2", 0.0, 40.0, 100, 1) != got[:100]).any()


def test_forest_takes_back_splits_that_say_the_same():
    tree = [boosting.Node(0.7, 0, 0, left=1, right=2), boosting.Node(0.6, 1, 0, left=3, right=4), boosting.Node(1.0), boosting.Node(0.9), boosting.Node(0.1)]
    assert forest.merged(tree, [np.array([3, 7])] * 5) == tree
    tree[4] = boosting.Node(0.8)
    assert forest.merged(tree, [np.array([3, 7])] * 5)[0] == boosting.Node(0.7)


def test_forest_of_little(spark):
    one = kinds(spark, np.ones((3, 2), np.float32), np.ones(3), np.ones(3))
    assert {r.prediction for r in forest.fit(one, 5).transform(one).collect()} == {1.0}
    assert forest.fit(one.limit(0), 5).transform(one.limit(0)).count() == 0
