import random

import pytest
import xxhash
from pyspark.sql import functions as F

from querysieve.llm import simhash
from querysieve.llm.components import components


def by_definition(text):
    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def reach(prints, ids):
    """Smallest id that each row reaches over prints with at most three bits between them."""
    n, parent = len(prints), list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(n):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                parent[find(a)] = find(b)
    least = {}
    for k in range(n):
        if ids[k] is not None:
            least[find(k)] = min(least.get(find(k), ids[k]), ids[k])
    return [least.get(find(k)) for k in range(n)]


@pytest.mark.parametrize("crowded", [512, 1])
def test_links_are_complete(spark, crowded):
    draw, prints = random.Random(3), set()
    for _ in range(25):
        base = draw.getrandbits(64)
        for _ in range(8):
            flips = draw.sample(range(64), draw.randint(0, 4))
            prints.add(base ^ sum(1 << f for f in flips))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), crowded)
    got = {tuple(sorted((r.a % (1 << 64), r.b % (1 << 64)))) for r in found.collect()}
    assert got == {(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 3}


def test_documents(spark, odd, none):
    rows = odd.select("doc_id", "text").collect()
    got = simhash.near_duplicates(odd).collect()
    want = [by_definition(r.text) for r in rows]
    assert sorted(int(r.fingerprint, 16) for r in got) == sorted(want)
    least = reach(want, [r.doc_id for r in rows])
    assert sorted((r.doc_id or -1, r.fingerprint, r.component_id or -1) for r in got) == sorted((r.doc_id or -1, f"{w:016x}", c or -1) for r, w, c in zip(rows, want, least))
    assert simhash.near_duplicates(none).count() == 0


def test_random_corpus(spark, make, small_batches):
    rows = make(5, words=(0, 12), vocabulary=3)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    prints = [by_definition(t) for _, t in rows]
    assert got == {i: (f"{p:016x}", c) for (i, _), p, c in zip(rows, prints, reach(prints, [i for i, _ in rows]))}


def test_one_of_each_group_stays(spark, odd):
    kept = simhash.keep_first(odd)
    assert kept.schema == odd.schema
    assert kept.where("doc_id in (6, 10)").count() == 0 and kept.where("doc_id in (5, 9)").count() == 2
    assert [r.text for r in kept.where("doc_id is null").collect()] == ["some text without an id that goes on for a while"]  # the others are copies


@pytest.mark.parametrize("seed", range(2))
def test_components_of_random_graphs(spark, seed):
    draw = random.Random(seed)
    links = [(draw.randrange(80), draw.randrange(80)) for _ in range(60)] + [(100 + k, 101 + k) for k in range(30)]
    parent = list(range(200))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame([*links, (None, 3)], "a long, b long")).collect()}
    assert got == {x: find(x) for pair in links for x in pair if pair[0] != pair[1]}


def test_no_links(spark):
    assert components(spark.range(0).select(F.col("id").alias("a"), F.col("id").alias("b"))).count() == 0


def test_filing_is_dealt_over_all_partitions(spark):
    """64 rows are made of each fingerprint: small as the fingerprints are, they aren't left to one or two tasks."""
    found = simhash.links(spark.createDataFrame([(k * k,) for k in range(50)], "fp long"))
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()


def test_filed_fingerprints_are_not_broadcast(spark):
    """Spark sizes 64 rows of a fingerprint as one, so that it would take the filed ones for small enough to send out."""
    prints = spark.range(1000).groupBy(F.xxhash64("id").alias("fp")).agg(F.count("*").alias("n")).select("fp")
    found = simhash.links(prints)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and "BroadcastExchange" not in plan
    assert "REPARTITION_BY_NUM" in plan  # also of what an aggregate has dealt by fingerprint
