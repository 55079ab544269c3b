import math
import random
from collections import Counter

import numpy as np
import pytest

from querysieve.llm import quality, toxicity


def documents(seed, n=300):
    """Prose, shouting, and prose with an insult."""
    draw = random.Random(seed)
    names = [f"{a}{b}" for a in "bcdfgh" for b in ("al", "em", "in", "or", "us")]
    docs, labels = [], []
    for k in range(n):
        w = [draw.choice(names) for _ in range(draw.randint(20, 120))]
        junk, rude = draw.random() < 0.25, draw.random() < 0.25
        if rude:
            for _ in range(4):
                w[draw.randrange(len(w))] = draw.choice(["oaf", "lout"])
        docs.append((k, " ".join(x.upper() + "!!" if junk else x for x in w)))
        labels.append((k, int(not junk), int(rude)))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = documents(1)
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def accuracy(scores, labels, column, limit):
    rows = scores.join(labels, "doc_id").where("doc_id % 4 = 2").collect()
    return sum((r.score >= limit) == (r[column] == 1) for r in rows) / len(rows)


def test_quality_on_held_out_rows(tables):
    docs, labels = tables
    scores = quality.quality_scores(docs, labels.where("doc_id % 4 <> 2").selectExpr("doc_id", "quality label"))
    assert accuracy(scores, labels, "quality", 0.7) > 0.95


def test_toxicity_on_held_out_rows(tables):
    docs, labels = tables
    scores = toxicity.toxicity_scores(docs, labels.where("doc_id % 4 <> 2").selectExpr("doc_id", "toxic label"))
    assert accuracy(scores, labels, "toxic", 0.3) > 0.95
    row = scores.where("array_contains(terms, 'oaf')").first()
    assert set(row.terms) <= {"oaf", "lout"} and row.neighbours[0].similarity >= row.neighbours[-1].similarity
    assert scores.where("size(neighbours) = 0").count() == 0


def by_definition(docs, labels):
    """Vectors, neighbours, votes and curve of every document by loops over whole texts."""
    words = [(i, toxicity.terms_of(t)) for i, t in docs]
    texts, known = {}, dict(labels)
    for i, t in docs:
        if i in known and t is not None and (t not in texts or i < texts[t]):
            texts[t] = i
    examples = sorted((i, known[i], Counter(toxicity.terms_of(t))) for t, i in texts.items())
    n, base = len(examples), sum(y for _, y, _ in examples) / len(examples)
    vocabulary = set().union(*(c for _, _, c in examples))
    df = {t: sum(t in w for _, w in words) for t in vocabulary}
    relevance = {t: math.log2(2 + sum(y for _, y, c in examples if t in c) / max(1, sum(1 - y for _, y, c in examples if t in c))) for t in vocabulary}
    one = lambda t: (math.log((1 + len(docs)) / (1 + df[t])) + 1) * relevance[t] if t in vocabulary else math.log((1 + len(docs)) / 2) + 1

    def unit(counts):
        v = {t: (1 + math.log(k)) * one(t) for t, k in counts.items()}
        return {t: x / math.sqrt(sum(y * y for y in v.values())) for t, x in v.items()}

    vectors = [unit(c) for _, _, c in examples if c]
    kept = [(i, y) for i, y, c in examples if c]
    silent = (sum(y for _, y, c in examples if not c) + base) / (n - len(kept) + 1)

    def vote(v, skip=-1):
        near = sorted((-round(sum(x * vectors[k].get(t, 0) for t, x in v.items()), 9), k) for k in range(len(kept)) if k != skip)
        near = [(-s, k) for s, k in near if s < 0][: toxicity.NEIGHBOURS]
        w = [toxicity.NEAR / (toxicity.NEAR + 1 - s) for s, _ in near]
        return (sum(x * kept[k][1] for x, (_, k) in zip(w, near)) + toxicity.PRIOR_WEIGHT * base) / (sum(w) + toxicity.PRIOR_WEIGHT), near

    knots = toxicity.monotone(np.array([vote(v, k)[0] for k, v in enumerate(vectors)]), np.array([y for _, y in kept], float))
    out = {}
    for i, w in words:
        v = unit(Counter(w)) if w else {}
        near = vote(v)[1] if w else []
        out[i] = (float(np.interp(vote(v)[0], *knots)) if w else silent, [(kept[k][0], s) for s, k in near])
    return out


def test_toxicity_by_definition(spark):
    """Scores and neighbours of the whole query against loops: vectors, top-k, vote and curve; copies and unseen words too."""
    docs, labels = documents(5, n=160)
    docs += [(200, docs[3][1]), (201, docs[4][1]), (202, ""), (203, None), (204, "words nobody has"), (205, "!!!"), (206, "bal oaf unseen")]
    own = [(i, y) for i, _, y in labels if i % 4 != 2] + [(200, 1), (202, 0), (205, 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in toxicity.toxicity_scores(frame, spark.createDataFrame(own, "doc_id long, label int")).collect()}
    want = by_definition(docs, own)
    assert got.keys() == want.keys()
    for i, (score, near) in want.items():
        assert got[i].score == pytest.approx(score, abs=1e-6), i
        near = near[: toxicity.SHOWN]
        assert [n.similarity for n in got[i].neighbours] == pytest.approx([s for _, s in near], abs=1e-6)
        clear = {k for k, s in near if s > near[-1][1] + 1e-6}
        assert clear <= {n.doc_id for n in got[i].neighbours}


def test_discriminant_is_the_density_ratio():
    draw = np.random.default_rng(0)
    d = len(quality.FEATURES)
    parts = []
    for _ in range(2):
        root = draw.normal(size=(d, d)) * 0.3 + np.eye(d)
        parts.append((draw.normal(size=d), root @ root.T))
    factors = [np.linalg.inv(np.linalg.cholesky(c)) for _, c in parts]
    model = quality.Model(np.zeros(d), np.ones(d), [m for m, _ in parts], factors, [float(np.log(np.diag(f)).sum()) for f in factors])
    x = draw.normal(size=(5, d))
    density = [-0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m) for m, c in parts]
    assert model.difference(x).tolist() == pytest.approx((density[1] - density[0]).tolist())


def test_quality_fit_by_definition(spark):
    """The whole query against plain numpy: moments, cut-off, shrinkage, factors and the curve over a histogram."""
    docs, labels = documents(3, n=200)
    docs += [(300, None), (301, ""), (302, docs[0][1])]
    own = [(i, q) for i, q, _ in labels if i % 4 != 2] + [(301, 0)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.score for r in quality.quality_scores(frame, spark.createDataFrame(own, "doc_id long, label int")).collect()}
    x = {i: np.array(quality.describe((t or "").encode())) for i, t in docs}
    taught, y = np.array([x[i] for i, _ in own]), np.array([q for _, q in own])
    centre, scale = taught.mean(axis=0), np.sqrt(np.maximum(taught.var(axis=0), 1e-6))
    z = np.clip((taught - centre) / scale, -quality.LIMIT, quality.LIMIT)
    covariances = [np.cov(z[y == k].T, bias=True) for k in (0, 1)]
    pooled = sum((y == k).mean() * covariances[k] for k in (0, 1))
    d = z.shape[1]

    def log_density(points, k):
        c = (1 - quality.SHRINK_TO_POOLED) * covariances[k] + quality.SHRINK_TO_POOLED * pooled
        c = (1 - quality.SHRINK_TO_DIAGONAL) * c + quality.SHRINK_TO_DIAGONAL * np.diag(np.diag(c)) + quality.RIDGE * np.eye(d)
        away = points - z[y == k].mean(axis=0)
        return np.log((y == k).mean()) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->i", away, np.linalg.inv(c), away)

    apart = lambda points: log_density(points, 1) - log_density(points, 0)
    at = np.clip((np.clip(apart(z), -quality.SPREAD, quality.SPREAD) + quality.SPREAD) / (2 * quality.SPREAD) * quality.BINS, 0, quality.BINS - 1).astype(int)
    middle = ((at + 0.5) / quality.BINS * 2 - 1) * quality.SPREAD / 20
    best = np.zeros(2)
    for _ in range(200):  # the curve's own optimum, by damped Newton steps on single rows
        p = 1 / (1 + np.exp(-np.clip(best[0] * middle + best[1], -30, 30)))
        design = np.stack([middle, np.ones_like(middle)], axis=1)
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2), design.T @ (y - p) - 1e-3 * best)
        best += np.clip(step, -2, 2)
    slope, offset = best[0] / 20, best[1]
    points = np.clip((np.array([x[i] for i, _ in docs]) - centre) / scale, -quality.LIMIT, quality.LIMIT)
    want = 1 / (1 + np.exp(-(slope * apart(points) + offset)))
    assert [got[i] for i, _ in docs] == pytest.approx(want.tolist(), abs=1e-3)


def test_statistics_by_hand():
    found = dict(zip(quality.FEATURES, quality.describe(b"AB ab!! ab!!\nx\nx")))
    assert found["log_words"] == pytest.approx(np.log1p(5)) and found["log_lines"] == pytest.approx(np.log1p(3))
    assert found["upper"] == pytest.approx(np.log(2.5 / (16 - 2 + 0.5)))
    assert found["repeated_neighbours"] == pytest.approx(np.log(2.5 / 3.5)) and found["repeated_lines"] == pytest.approx(np.log(1.5 / 2.5))
    assert all(np.isfinite(quality.describe(t)).all() for t in (b"", b" ", b"\x00", b"!" * 100_000))


@pytest.mark.parametrize("seed, common", [(k, c) for k in range(5) for c in (1 / 16, 0.3, 2.0, -1.0)])
def test_index_is_exact(seed, common):
    """With some, few, no and all terms common."""
    draw = random.Random(seed)

    def made():
        v = {draw.randrange(40) if draw.random() < 0.5 else draw.randrange(6): draw.random() + 0.1 for _ in range(draw.randint(1, 8))}
        terms = np.array(sorted(v))
        weights = np.array([v[t] for t in sorted(v)])
        return terms, weights / np.sqrt((weights**2).sum())

    vectors = [made() for _ in range(1500)]
    index = toxicity.BlockMaxIndex(np.cumsum([len(t) for t, _ in vectors]), *(np.concatenate(c) for c in zip(*vectors)), 40, common)
    queries = [made() if k % 2 else vectors[k] for k in range(30)]
    for k, ((terms, weights), (found, examples)) in enumerate(zip(queries, index.nearest(queries, 15, list(range(30))))):
        dense = np.zeros(40)
        dense[terms] = weights
        scores = [(round(float(dense[t] @ w.astype(np.float32)), 10), j) for j, (t, w) in enumerate(vectors) if j != k]
        want = sorted(((s, j) for s, j in scores if s > 0), key=lambda x: (-x[0], x[1]))[:15]
        assert found.tolist() == pytest.approx([s for s, _ in want])
        assert {j for s, j in want if s > want[-1][0] + 1e-9} <= set(examples.tolist())


def test_curve_rises():
    draw = np.random.default_rng(1)
    x = draw.random(200)
    at, value = toxicity.monotone(x, (draw.random(200) < x).astype(float))
    assert (np.diff(at) > 0).all() and (np.diff(value) >= -1e-9).all()


def test_odd_documents(spark, odd, none, tables):
    docs, labels = tables
    quality_labels, toxic_labels = labels.selectExpr("doc_id", "quality label"), labels.selectExpr("doc_id", "toxic label")
    for scores in (quality.quality_scores, toxicity.toxicity_scores):
        for own in (quality_labels, toxic_labels, quality_labels.where("false"), quality_labels.where("label = 1"), quality_labels.selectExpr("doc_id", "cast(null as int) label")):
            got = scores(odd, own)
            assert got.count() == odd.count() and got.where("score is null or score < 0 or score > 1").count() == 0
        assert scores(none, quality_labels).count() == 0


def test_labels_and_documents_that_repeat_an_id(spark):
    docs = spark.range(6000).selectExpr("7L as doc_id", "concat('text ', id) as text")
    one = spark.createDataFrame([(7, 1)] * 3000 + [(8, 1)], "doc_id long, label int")
    assert 1300 < toxicity._sampled(docs, one, 1500).count() < 1700
    many = spark.range(6000).selectExpr("id as doc_id", "concat('text ', id) as text", "cast(id % 2 as int) as label")
    assert 1300 < toxicity._sampled(many, many.select("doc_id", "label"), 1500).count() < 1700
    both = spark.createDataFrame([(1, "a b c"), (2, "d e f")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (None, 1)], "doc_id long, label int")
    assert sorted((r.doc_id, r.label) for r in toxicity._sampled(both, labels, 10).collect()) == [(1, 0), (2, 1)]
