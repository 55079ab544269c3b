import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from querysieve.llm import nearcopies, simhash
from querysieve.llm.components import components


def sets(text):
    w = text.lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}


def similar(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def edited(draw, words, changes):
    words = list(words)
    for _ in range(changes):
        at = draw.randrange(len(words))
        words[at : at + draw.randint(0, 1)] = [f"n{draw.random()}"] * draw.randint(0, 1)
    return words


def corpus(seed, lengths, changes):
    draw, texts = random.Random(seed), []
    for n in lengths:
        base = [f"w{draw.randrange(500)}" for _ in range(n)]
        texts += [" ".join(edited(draw, base, draw.randint(0, changes(n)))) for _ in range(6)]
    return list(enumerate(texts))


def test_every_similar_pair_shares_a_key():
    for n in range(1, 120):
        rows = [t for _, t in corpus(n, [n], lambda n: n // 20 + 1)]
        found = [nearcopies.shingles(t.encode()) for t in rows]
        common = np.unique(np.concatenate([all_of[: len(all_of) * (n % 4) // 3] for f in found for all_of, _ in nearcopies._mixed(f)]))
        made = [set(nearcopies.keys(f, common).tolist()) for f in found]
        for a in range(len(rows)):
            for b in range(a):
                if len(found[a]) and len(found[b]) and similar(sets(rows[a]), sets(rows[b])):
                    assert made[a] & made[b], (n, rows[a], rows[b])


@pytest.mark.parametrize("crowd, most_sent", [(nearcopies.CROWD, nearcopies.MOST_SENT), (1, 0)])
def test_components_of_five_word_similarity(spark, crowd, most_sent):
    """Pairs of 0.8 differ in far more than three bits of a fingerprint; near misses and bridges stay apart or join."""
    rows = corpus(1, [*range(5, 30, 3), *range(30, 400, 37)], lambda n: n // 25 + 1)
    own = [sets(t) for _, t in rows]
    least = list(range(len(rows)))
    for _ in rows:  # labels spread until nothing changes
        for a in range(len(rows)):
            for b in range(a):
                if least[a] != least[b] and similar(own[a], own[b]):
                    least[a] = least[b] = min(least[a], least[b])
    wide = [(a, b) for a in range(len(rows)) for b in range(a) if similar(own[a], own[b]) and (simhash.fingerprint(rows[a][1].encode()) ^ simhash.fingerprint(rows[b][1].encode())).bit_count() > 3]
    assert len(wide) > 20
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in nearcopies.near_copies(docs, crowd, most_sent).collect()} == dict(enumerate(least))
    assert sorted(r.doc_id for r in simhash.keep_first(docs).collect()) == [k for k, c in enumerate(least) if c == k]


def test_parity_is_a_lower_bound():
    draw = np.random.default_rng(0)
    for _ in range(200):
        a, b = (np.unique(draw.integers(0, 400, draw.integers(0, 300)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(2))
        assert sum((int(x) ^ int(y)).bit_count() for x, y in zip(nearcopies.parity(a).view(np.uint64), nearcopies.parity(b).view(np.uint64))) <= len(np.setxor1d(a, b))


def test_one_of_every_group_stays(spark):
    """Rows without an id, repeated ids and repeated rows; columns that are named like the operator's own."""
    a, b, c = ("a b c d e f g h i j k", "completely other words stand in this text here now", "third text of its own with words enough to tell")
    rows = [(3, a, 1), (None, a, 2), (5, a, 3), (5, b, 4), (5, b, 4), (None, c, 5), (None, c, 6), (7, "", 7), (None, None, 8), (9, " ", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, root int").withColumnsRenamed({"root": "id"}).selectExpr("doc_id", "text", "id", "id th", "id __gone", "id doc")
    kept = simhash.keep_first(docs)
    assert kept.schema == docs.schema
    got = sorted((r.doc_id or 0, r.text) for r in kept.collect())
    assert got == [(0, c), (3, a), (5, b), (7, "")]
    by = sorted((r.doc_id or 0, r.component_id or 0) for r in nearcopies.near_copies(docs).collect())
    assert by == [(0, 0), (0, 0), (0, 3), (0, 7), (3, 3), (5, 3), (5, 5), (5, 5), (7, 7), (9, 7)]


def test_pages_of_one_template(spark, monkeypatch):
    """600 pages share three quarters of their shingles, and two of them each differ little: those are found, without all pairs."""
    draw = random.Random(2)
    template = [f"t{k}" for k in range(150)]
    rows = []
    for k in range(300):
        own = [f"o{draw.randrange(10**9)}" for _ in range(45)]
        rows += [(2 * k, " ".join(template + own)), (2 * k + 1, " ".join(template + own[:44] + ["other"]))]
    assert not similar(sets(rows[0][1]), sets(rows[2][1])) and similar(sets(rows[0][1]), sets(rows[1][1]))
    counted, real = [], nearcopies._close

    def close(frame):
        counted.append(frame.groupBy("key").count().selectExpr("sum(count * count)").first()[0] or 0)
        return real(frame)

    monkeypatch.setattr(nearcopies, "_close", close)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in nearcopies.near_copies(docs, crowd=64).collect()} == {i: i - i % 2 for i, _ in rows}
    assert sum(counted) < 100 * len(rows)  # 38 keys a page and two pages a key; one key of all pages alone would be 600 a page


def test_fingerprints_link_first(spark, monkeypatch):
    """The stage's SimHash step: near copies of close fingerprints are joined by their links, confirmed, before any key is."""
    draw = random.Random(5)
    base = [f"w{draw.randrange(10**6)}" for _ in range(900)]
    rows = [(0, " ".join(base)), (1, " ".join(base[:-1])), (2, " ".join(base[1:])), (3, " ".join(f"v{k}" for k in range(300)))]
    prints = [nearcopies.majority(nearcopies.shingles(t.encode())) % (1 << 64) for _, t in rows]
    assert all((p ^ prints[0]).bit_count() <= 3 for p in prints[1:3]) and (prints[3] ^ prints[0]).bit_count() > 3
    linked, confirmed, real, check = [], [], simhash.links, nearcopies._confirmed
    monkeypatch.setattr(simhash, "links", lambda frame: linked.append(frame.count()) or real(frame))
    monkeypatch.setattr(nearcopies, "_confirmed", lambda pairs, *a: confirmed.append(pairs.count()) or check(pairs, *a))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_first(docs).collect()) == [0, 3]
    assert linked == [len(set(prints))] and confirmed[0] >= 1 and sum(confirmed[1:]) == 0


def test_a_shared_passage_is_one_key(spark, monkeypatch):
    """Long documents that share most of a long passage, but aren't alike, meet once and not in each of its keys."""
    draw = random.Random(6)
    passage = [f"p{k}" for k in range(400)]
    docs = spark.createDataFrame([(k, " ".join(passage + [f"o{draw.random()}" for _ in range(250)])) for k in range(12)], "doc_id long, text string")
    rows, real = [], nearcopies._close
    monkeypatch.setattr(nearcopies, "_close", lambda frame: rows.append(frame.count()) or real(frame))
    monkeypatch.setattr(nearcopies, "MOST_STARS", 0)
    assert simhash.keep_first(docs).count() == 12
    assert sum(rows) < 3 * 12 * 12


def test_refiling_grows_with_the_documents(spark, monkeypatch):
    """Passages that 20 of 160 documents share, and 100 of 800: five times the documents, no more than that to file again."""
    monkeypatch.setattr(nearcopies, "MOST_STARS", 0)
    filed, real = [], nearcopies._refiled

    def refiled(sets):
        filed[-1] += sets.selectExpr("sum(size(hashes))").first()[0] or 0
        return real(sets)

    monkeypatch.setattr(nearcopies, "_refiled", refiled)
    for members in (20, 100):
        draw = random.Random(7)
        texts = [" ".join([f"p{group}_{k}" for k in range(60)] + [f"o{draw.randrange(10**9)}" for _ in range(30)]) for group in range(8) for _ in range(members)]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        filed.append(0)
        assert simhash.keep_first(docs).count() == len(texts)
    assert 0 < filed[1] <= 6 * filed[0]


def test_few_links_make_few_tasks(spark):
    """A round of components has a dozen shuffles: of few links each must not make a task for every shuffle partition."""
    key, tracker = "spark.sql.shuffle.partitions", spark.sparkContext.statusTracker()
    before = spark.conf.get(key)
    links = spark.createDataFrame([(k, k + 1) for k in range(60)], "a long, b long").coalesce(1)
    spark.conf.set(key, "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.sparkContext.setJobGroup("few", "few links")
    try:
        found = components(links).collect()
        stages = {s for job in tracker.getJobIdsForGroup("few") for s in tracker.getJobInfo(job).stageIds}
        made = sum(info.numCompletedTasks for s in stages if (info := tracker.getStageInfo(s)))
    finally:
        spark.conf.set(key, before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(tuple(r) for r in found) == [(k, 0) for k in range(61)]
    assert made < 400


def test_shingles_filed_again_are_not_broadcast(spark):
    sets = spark.range(100).select(F.col("id").alias("node"), F.sequence("id", F.col("id") + 50).alias("hashes"))
    found = nearcopies._refiled(sets)
    assert found.count() == 100 * 11
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and "BroadcastExchange" not in plan
