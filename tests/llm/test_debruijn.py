import hashlib
import random

import numpy as np
import pytest

from querysieve.llm import debruijn

LAST = 1 << 63


def by_definition(rows, k):
    """rows of (id or None, text) -> (id, n_words, n_removed, sha) in order."""
    first = {}
    words = [(LAST if i is None else i, (t or "").encode().split()) for i, t in rows]
    for i, w in words:
        for p in range(len(w) - k + 1):
            x = tuple(w[p : p + k])
            first[x] = min(first.get(x, i), i)
    out = []
    for (own, _), (i, w) in zip(rows, words):
        gone = [False] * len(w)
        for p in range(len(w) - k + 1):
            if first[tuple(w[p : p + k])] < i:
                gone[p : p + k] = [True] * k
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((own, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def ours(df, k):
    return sorted(map(tuple, debruijn.digests(df, k).collect()), key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_random_corpora(spark, make, small_batches, seed):
    rows = make(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert ours(df, 13) == by_definition(rows, 13)
    assert debruijn.repeated_paths(df).count() > 0


def test_few_words_and_many_variants(spark, make, small_batches, monkeypatch):
    monkeypatch.setattr(debruijn, "VARIANTS", 1)
    rows = make(9, vocabulary=2, words=(0, 40))
    assert ours(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 5) == by_definition(rows, 5)


def test_many_rows_without_an_id(spark, make, small_batches):
    """They lose what rows with an id have, and rows of one id nothing to each other."""
    rows = [(None if k % 3 else i, t) for k, (i, t) in enumerate(make(5, n=90))]
    rows += [(None, rows[0][1])] * 9 + [(5, rows[3][1])] * 4
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert ours(df, 13) == by_definition(rows, 13)


def test_thousands_of_rows_of_one_id(spark):
    """Hundreds of pairs of them agree in the 23 bits of their places; all lose the passage of document 1, whole."""
    passage = " ".join(f"p{k}" for k in range(60))
    draw = random.Random(8)
    rows = [(1, passage)]
    for own in (None, 7):
        for _ in range(4000):
            before = [f"w{draw.randrange(10**9)}" for _ in range(draw.randint(0, 9))]
            rows.append((own, " ".join([*before, passage, *(f"w{draw.randrange(10**9)}" for _ in range(draw.randint(0, 9)))])))
    rows.append((None, rows[1][1]))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert ours(df, 13) == by_definition(rows, 13)


def test_an_id_within_a_text_is_no_id(spark):
    text = " ".join(f"v{k}" for k in range(20))
    rows = [(1, text), (5, "x " + text), (None, "5:x " + text), (None, text), (6, ":" + text), (6, None)]
    assert ours(spark.createDataFrame(rows, "doc_id long, text string"), 13) == by_definition(rows, 13)


def test_places_found_by_hash_are_compared():
    words = b"a b c a b d a b c".split()
    e = np.array([5, 6, 7, 5, 8, 9, 5], np.uint64)[: len(words) - 2]
    windows = np.array([True] + [False] * 6)
    assert sorted(debruijn._everywhere(words, e, windows, 3)) == [0, 6]


def test_odd_documents(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert ours(odd, 13) == by_definition(rows, 13)
    assert ours(none, 13) == []


def test_paths_follow_their_source(spark):
    text = " ".join(f"v{k}" for k in range(40))
    df = spark.createDataFrame([(1, "a b " + text + " c d"), (2, text), (3, "z " + text[:100])], "doc_id long, text string")
    paths = debruijn.repeated_paths(df).where("id = 2").collect()
    first = debruijn._rows(df).where("doc_id = 1").first().doc
    assert [(p.n, p.source, p.source_place & ((1 << 40) - 1)) for p in paths] == [(28, first, 2)]
    spans = {r.doc_id: [tuple(s) for s in r.spans] for r in debruijn.deduplicate(df).collect()}
    assert spans[1] == [] and spans[2] == [(0, 40)] and spans[3][0][0] == 1


def test_query_against_sql(spark, sf_dir):
    import duckdb

    from querysieve.llm import queries

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    theirs = con.execute(queries.ORACLE["op2_debruijn"]).fetchall()
    assert sorted(map(tuple, queries.op2_debruijn(spark, sf_dir).collect())) == sorted(theirs)


def test_the_shuffle_of_all_segments_is_over_before_texts_are_shuffled(spark, make):
    paths = debruijn.repeated_paths(spark.createDataFrame(make(1), "doc_id long, text string"))
    plan = paths._jdf.queryExecution().analyzed().toString()
    assert "source_place" in plan and "variants" not in plan and "content" not in plan
