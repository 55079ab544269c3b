import itertools
import random

import pytest
from pyspark.sql import functions as F

from querysieve.operators import mining, rules
from querysieve.operators.expand import SCENARIOS, expand

# Published supports of two mined logs (fixed values): itemset and support, and which are frequent at 0.1 too.
STAGE3 = {
    (1,): 4939, (3,): 8387, (4,): 13810, (100,): 19527, (101,): 11378, (5,): 2493, (44,): 3660, (5, 101): 1929, (4, 5): 1762, (44, 101): 1813,
    (44, 100): 1847, (1, 101): 4049, (1, 4): 2625, (1, 4, 101): 1969, (3, 101): 3994, (3, 4, 101): 1689, (3, 4): 5424, (3, 4, 100): 3735,
    (3, 100): 4393, (4, 101): 4735, (4, 100): 9075,
}
STAGE4 = {(1,): 4939, (3,): 8387, (4,): 13810, (5,): 2493, (44,): 3660, (4, 5): 1762, (1, 44): 1168, (3, 44): 1206, (1, 3): 1420, (1, 4): 2625, (3, 4): 5424}
STAGE3_AT_10 = {(1,), (3,), (4,), (100,), (101,), (44,), (1, 101), (3, 101), (3, 4), (3, 4, 100), (3, 100), (4, 101), (4, 100)}
R = {
    1: ((1,), (101,), 4049, 0.8198015792670581), 2: ((3,), (4,), 5424, 0.6467151544056278), 3: ((4,), (100,), 9075, 0.6571325126719768),
    4: ((5,), (4,), 1762, 0.7067789811472122), 5: ((5,), (101,), 1929, 0.7737665463297232), 6: ((1, 4), (101,), 1969, 0.7500952380952381),
    7: ((3, 100), (4,), 3735, 0.8502162531299795), 8: ((3, 4), (100,), 3735, 0.6886061946902655),
}


def table(spark, found):
    return spark.createDataFrame([(list(k), v) for k, v in found.items()], "items array<int>, freq long")


def ruled(df):
    return {(tuple(r.antecedent), tuple(r.consequent), r.support, r.confidence) for r in df.collect()}


@pytest.mark.parametrize(
    "found, confidence, expected",
    [
        (STAGE3, 0.6, [1, 2, 3, 4, 5, 6, 7, 8]),
        (STAGE3, 0.8, [1, 7]),
        ({k: STAGE3[k] for k in STAGE3_AT_10}, 0.6, [1, 2, 3, 7, 8]),
        ({k: STAGE3[k] for k in STAGE3_AT_10}, 0.8, [1, 7]),
        (STAGE4, 0.6, [2, 4]),
        (STAGE4, 0.8, []),
    ],
)
def test_published_rules(spark, found, confidence, expected):
    assert ruled(rules.association_rules(table(spark, found), confidence)) == {R[k] for k in expected}


def brute(rows, support):
    rows = [frozenset(r) for r in rows if r]
    least = -(-int(round(support * len(rows) * 1e9)) // 10**9)
    items = sorted(set().union(*rows)) if rows else []
    out = {}
    for n in range(1, len(items) + 1):
        for s in itertools.combinations(items, n):
            if (c := sum(set(s) <= r for r in rows)) >= max(1, least):
                out[s] = c
    return out


@pytest.mark.parametrize("seed", range(3))
def test_miners_agree_with_brute_force(spark, seed):
    draw = random.Random(seed)
    rows = [draw.sample(range(1, 7), draw.randint(0, 5)) for _ in range(40)]
    tx = spark.createDataFrame([(r,) for r in rows], "items array<int>")
    expected = brute(rows, 0.1)
    for miner in (mining.itemsets, mining.eclat, mining.fp_growth):
        assert {tuple(r["items"]): r.freq for r in miner(tx, 0.1).collect()} == expected, miner.__name__


@pytest.mark.parametrize("in_one_task", [10**6, 60, 0])
@pytest.mark.parametrize("seed", range(2))
def test_projected_tables_agree_with_brute_force(spark, seed, in_one_task):
    """All tables in one task each, some split, and all split down to the end."""
    draw = random.Random(seed)
    rows = [draw.sample(range(1, 9), draw.randint(0, 7)) for _ in range(40)] * 3
    tx = spark.createDataFrame([(r,) for r in rows], "items array<int>")
    got = mining.itemsets(tx, 0.1, subsets_up_to=2, in_one_task=in_one_task).collect()
    assert len(got) == len({tuple(r["items"]) for r in got})
    assert {tuple(r["items"]): r.freq for r in got} == brute(rows, 0.1)


def long_transactions(seed, n=60, length=200):
    """Transactions of 200 items of a thousand; each also holds one of two sets of six items."""
    draw = random.Random(seed)
    common = [draw.sample(range(1000), 6) for _ in range(2)]
    rows = []
    for k in range(n):
        own = set(common[k % 2])
        rows.append(sorted(own | set(draw.sample(range(1000), length - len(own)))))
    return rows


def grown(rows, support):
    """Frequent itemsets level by level."""
    rows, found = [frozenset(r) for r in rows], {}
    least = mining.least_count(support, len(rows))
    level = [(i,) for i in sorted(set().union(*rows))]
    while level:
        counts = {s: sum(set(s) <= r for r in rows) for s in level}
        kept = sorted(s for s in level if counts[s] >= least)
        found |= {s: counts[s] for s in kept}
        level = [(*a, b[-1]) for a in kept for b in kept if a[:-1] == b[:-1] and a[-1] < b[-1]]
    return found


@pytest.mark.parametrize("in_one_task", [10**6, 500])
def test_transactions_of_200_items(spark, in_one_task):
    rows = long_transactions(1)
    tx = spark.createDataFrame([(r,) for r in rows], "items array<int>")
    want = grown(rows, 0.32)
    assert max(map(len, want)) >= 6
    for got in (mining.itemsets(tx, 0.32, in_one_task=in_one_task), mining.eclat(tx, 0.32)):
        assert {tuple(r["items"]): r.freq for r in got.collect()} == want


def test_bitmaps_count_weights_over_chunks(spark):
    """More kinds of transactions than a chunk holds, some of them repeated very often."""
    draw = random.Random(4)
    kinds = [[1, 2, 10 + k] for k in range(1500)] + [[1, 3, 10 + k] for k in range(1500)]
    rows = spark.createDataFrame([(k, draw.choice([1, 5, 70_000])) for k in kinds], "items array<int>, n long").coalesce(1)
    level, weights = mining.vertical(rows)
    assert level.select("chunk").distinct().count() == weights.count() == 3
    got = level.join(weights, "chunk").groupBy("items").agg(F.sum(mining.weight(F.col("bits"), F.col("planes"))).alias("n"))
    want = {1: 0, 2: 0, 3: 0}
    for r in rows.collect():
        for i in r["items"][:2]:
            want[i] += r.n
    assert {r["items"][0]: r.n for r in got.collect() if r["items"][0] < 10} == want


def test_no_join_on_transactions(spark):
    """The bitmaps are joined by chunk: nothing in the plan of a level knows a transaction."""
    tx = spark.createDataFrame([([1, 2, 3],)] * 4, "items array<int>")
    plan = mining.eclat(tx, 0.5)._jdf.queryExecution().toString()
    assert "tid" not in plan and "place" not in plan


def test_no_transactions(spark):
    for rows in ([], [([],)]):
        tx = spark.createDataFrame(rows, "items array<int>")
        assert mining.itemsets(tx, 0.1).count() == mining.eclat(tx, 0.1).count() == 0


def test_rules_of_any_consequent(spark):
    tx = spark.createDataFrame([([1, 2, 3],)] * 3 + [([1],)], "items array<int>")
    got = ruled(rules.mine_rules(tx, 0.5, 0.7))
    assert ((1,), (2, 3), 3, 0.75) in got and ((2, 3), (1,), 3, 1.0) in got
    first = rules.first_consequent(rules.mine_rules(tx, 0.5, 0.7))
    assert first.where("consequent = 2 and antecedent = array(1)").count() == 2  # repeats stay


def test_rules_of_a_25_item_set(spark):
    """Its 33 million splits aren't listed: only what holds grows."""
    whole = tuple(range(1, 26))
    found = {whole: 100, whole[1:]: 100} | {whole[:k] + whole[k + 1 :]: 200 for k in range(1, 25)}
    got = ruled(rules.association_rules(table(spark, found), 0.6))
    assert got == {(whole[1:], (1,), 100, 1.0)}


@pytest.mark.parametrize("seed, confidence", [(1, 0.5), (2, 0.8), (3, 0.0)])
def test_rules_agree_with_all_splits(spark, seed, confidence):
    draw = random.Random(seed)
    found = brute([draw.sample(range(1, 7), draw.randint(0, 6)) for _ in range(40)], 0.1)
    want = set()
    for s, freq in found.items():
        for n in range(1, len(s)):
            for left in itertools.combinations(s, n):
                if freq / found[left] >= confidence:
                    want.add((left, tuple(i for i in s if i not in left), freq, freq / found[left]))
    got = rules.association_rules(table(spark, found), confidence)
    assert got.count() == len(want) and ruled(got) == want


def test_no_rules(spark):
    assert rules.association_rules(table(spark, {(1,): 3}), 0.5).count() == 0
    assert rules.association_rules(table(spark, {(1,): 3}).limit(0), 0.5).count() == 0


def test_expansion(spark):
    slots = {f"f{k}": F.lit(float(k)) for k in range(8)}
    rows = spark.createDataFrame([(1, [1, 2]), (2, [1]), (3, [2]), (4, [1, 2])], "id int, items array<int>").withColumns(slots)
    by = lambda k: {r.id: list(r.expanded) for r in expand(rows, rows, k).collect()}
    assert by(1)[1] == by(6)[1] == by(7)[1] == [float(k) for k in range(8)]
    assert by(2)[2][8:] == [1.0, 0.0, 0.0] and by(2)[1][8:] == [1.0, 1.0, 1.0]
    assert by(5)[3][8:] == [0.0, 0.0] and by(5)[4][8:] == pytest.approx([2 / 3, 2 / 3])
    assert len(SCENARIOS) == 7


def test_extra_text_is_made_once_a_kind(spark):
    """``per_kind`` columns come from the kinds' side of the join, not from the rows."""
    rows = spark.createDataFrame([(k, *[float(k % 2)] * 8, [1, 2] if k % 2 else [3]) for k in range(20)], "id long, f0 double, f1 double, f2 double, f3 double, f4 double, f5 double, f6 double, f7 double, items array<int>")
    for scenario in (1, 2, 4):
        found = expand(rows, rows, scenario, {"shown": F.array_join(F.col("extra").cast("array<string>"), " ")})
        assert all(r.shown == " ".join(str(v) for v in r.expanded[8:]) for r in found.collect())
        top = found.select("id", "shown")._jdf.queryExecution().optimizedPlan().toString()
        assert scenario == 1 or "array_join" not in top


def test_items_do_not_gather_rows(spark):
    """Rows meet frequent items and suffixes by broadcast: a shuffle by item would send all rows with one to a task."""
    rows = spark.createDataFrame([([k for k in range(14) if (k * n) % 5 != 1],) for n in range(60)], "items array<int>")
    plans, real = [], mining.held
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(mining, "held", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df))
        found = mining.itemsets(rows, 0.5, subsets_up_to=2, in_one_task=50).collect()
    assert found and not any("SortMergeJoin" in p or "ShuffledHashJoin" in p for p in plans)
