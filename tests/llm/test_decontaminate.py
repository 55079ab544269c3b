import pickle
import random

import pytest

from querysieve.llm import decontaminate as d


def items(seed, n=30):
    draw = random.Random(seed)
    names = [f"t{k}" for k in range(120)]
    return [(k, " ".join(draw.choice(names) for _ in range(draw.randint(1, 30))) + draw.choice(["?", ". ", ""]) + " ".join(draw.choice(names) for _ in range(draw.randint(0, 6)))) for k in range(n)]


def by_definition(item, text):
    w, own = d.words(text), d.words(item)
    n = min(5, len(own))
    shingles = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)}
    there = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    return len(shingles & there) / len(shingles)


def holds(item, text):
    question = d.question_and_answer(item)[0]
    return by_definition(item, text) >= 0.8 or len(d.words(question)) >= d.QUESTION_WORDS and by_definition(question, text) >= 0.8


@pytest.mark.parametrize("seed", range(3))
def test_wand_equals_scoring_everything(seed):
    index, draw = d.Index(items(seed, 150)), random.Random(seed)
    for _ in range(60):
        terms = sorted(draw.sample(range(len(index.term)), draw.randint(1, len(index.term))))
        scores = {}
        for t in terms:
            for k, x in index.postings[t]:
                scores[k] = scores.get(k, 0) + x
        assert {k for k, _ in index.retrieve(terms)} == {k for k, s in scores.items() if s >= index.thresholds[k]}


def test_finds_whole_and_edited_copies(spark):
    bench, draw = items(7), random.Random(8)
    docs = []
    for k in range(120):
        text = [f"n{draw.randrange(300)}" for _ in range(draw.randint(0, 400))]
        if k % 2:
            own = d.words(draw.choice(bench)[1])
            for _ in range(draw.randint(0, 2)):
                own[draw.randrange(len(own))] = "zzz"
            at = draw.randint(0, len(text))
            text[at:at] = own
        docs.append((k, " ".join(text)))
    rows, bench_df = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    want = {(i, k) for i, t in docs for k, item in bench if holds(item, t)}
    assert want and {(r.doc_id, r.item_id) for r in d.contaminated(rows, bench_df).collect()} == want
    # In shards the same comes out.
    assert {(r.doc_id, r.item_id) for r in d.contaminated(rows, bench_df, shard_bytes=1000).collect()} == want
    many = d.Shards(rows, bench_df, 100)
    assert len(many.sent) > 5
    for found in (d.contaminated(rows, bench_df, 100), d.keep_clean(rows, bench_df, 100)):  # one pass, however many shards
        assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert {(r.doc_id, r.item_id) for r in d.contaminated(rows, bench_df, 100).collect()} == want
    assert {r.doc_id for r in d.keep_clean(rows, bench_df, 100).collect()} == {r.doc_id for r in rows.collect()} - {i for i, _ in want}
    assert {r.doc_id for r in d.keep_clean(rows, bench_df, 1000).collect()} == {i for i, _ in docs} - {i for i, _ in want}


def test_a_question_alone_is_enough(spark):
    question = "how many of the seven bridges does one cross on the shortest walk through the town?"
    bench = spark.createDataFrame([(1, question + " None of them, for the walk that was asked for is known not to exist at all."), (2, "Why? " + "so " * 30)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "some text. " + question + " Nobody knows."), (2, "why? because"), (3, question[:40])], "doc_id long, text string")
    row, = d.contaminated(docs, bench).collect()
    assert (row.doc_id, row.item_id, row.question_overlap, row.answer_overlap) == (1, 1, 1.0, 0.0) and row.overlap < 0.8


def test_a_long_item_leaves_the_others_their_passages(spark):
    bench = items(9) + [(99, " ".join(f"long{k}" for k in range(700)))]
    made = [index for blob in d.indexes(spark.createDataFrame(bench, "item_id long, text string")) for index in pickle.loads(blob)]
    assert sorted((i.stride, len({id(x) for x in i.items})) for i in made) == [(64, 30), (1024, 1)]
    docs = spark.createDataFrame([(1, "x " * 500 + bench[-1][1]), (2, bench[3][1])], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in d.contaminated(docs, spark.createDataFrame(bench, "item_id long, text string")).collect()} == {(1, 99), (2, 3)}


def test_question_and_answer():
    assert d.question_and_answer("Is it so? It is.") == ("Is it so?", "It is.")
    assert d.question_and_answer("One sentence") == ("One sentence", "")


def test_odd_documents(spark, odd, none):
    bench = spark.createDataFrame([(1, "word3 word4 word5 word6 word7"), (2, None), (3, ""), (None, "漢字 end")], "item_id long, text string")
    got = d.contaminated(odd, bench)
    assert sorted((r.doc_id, r.item_id or 0) for r in got.collect()) == [(5, 1), (6, 1), (7, 0)]
    kept = d.keep_clean(odd, bench)
    assert kept.schema == odd.schema and kept.count() == odd.count() - 3
    assert d.contaminated(none, bench).count() == d.keep_clean(none, bench).count() == 0
    empty = bench.where("false")
    assert d.contaminated(odd, empty).count() == 0 and d.keep_clean(odd, empty).count() == odd.count()
