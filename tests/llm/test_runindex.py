import hashlib
import random

import pytest

from querysieve.llm import runindex

SIZE, ANCHORS = 40, (8, 24, 40)  # window length and anchors in tests


def by_definition(rows, length):
    from collections import Counter

    data = [(t or "").encode() for _, t in rows]
    count = Counter(b[p : p + length] for b in data for p in range(len(b) - length + 1))
    out = []
    for (i, _), b in zip(rows, data):
        gone = [False] * len(b)
        for p in range(len(b) - length + 1):
            if count[b[p : p + length]] > 1:
                gone[p : p + length] = [True] * length
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


def ours(df, length, **parameters):
    found = runindex.deduplicate(df, length, anchors=ANCHORS, **parameters)
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in found.collect()), key=repr)


@pytest.mark.parametrize("seed", range(40))
def test_index_streams_longest_matches(seed):
    draw = random.Random(seed)
    letters = draw.choice([b"ab", b"abc\x00", bytes([0, 1, 254, 255])])
    base = bytes(draw.choice(letters) for _ in range(60))
    strings = []
    for _ in range(draw.randint(1, 6)):
        at = draw.randint(0, 50)
        strings.append(base[at : at + draw.randint(0, 40)] + bytes(draw.choice(letters) for _ in range(draw.randint(0, 10))))
    places = [(k, p) for k, s in enumerate(strings) for p in range(len(s))]

    def common(a, b):
        x, y = strings[a[0]][a[1] :], strings[b[0]][b[1] :]
        return next((n for n, (c, d) in enumerate(zip(x, y)) if c != d), min(len(x), len(y)))

    index = runindex.RunIndex(strings)
    assert index.longest_matches().tolist() == [max((common(p, q) for q in places if q != p), default=0) for p in places]
    assert index.run_sizes.sum() == len(places)


def test_repetitive_texts_have_few_runs():
    copies = runindex.RunIndex([b"the quick brown fox jumps over the lazy dog" * 2] * 50)
    assert len(copies.run_sizes) < len(b"the quick brown fox jumps over the lazy dog") * 4


@pytest.mark.parametrize("group_bytes", [1 << 20, 300, 0])
def test_random_corpora(spark, make, small_batches, group_bytes):
    """Small groups make anchors go through all three lengths."""
    rows = make(4, n=50)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert ours(df, SIZE, group_bytes=group_bytes, index_bytes=500) == by_definition(rows, SIZE)


def test_rows_are_known_by_their_text(spark, make, small_batches):
    """No doc_id, or one for all: copies, shared passages and unique texts are told apart all the same."""
    texts = [t for _, t in make(7, n=40)] + ["unique " + str(k) * 60 for k in range(5)] + ["copied throughout " * 5] * 7
    for i in (None, 3):
        rows = [(i, t) for t in texts]
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        assert ours(df, SIZE) == by_definition(rows, SIZE)


def test_long_periodic_texts_are_cut():
    text = b"-" * 3_000_000
    least, at, n, twice = runindex.window_runs(text)
    assert n.sum() == len(text) - 199 and n.max() == runindex.RUN and (at[1:] == (at + n)[:-1]).all() and twice.all()
    assert len({text[a : a + m + 199] for a, m in zip(at.tolist(), n.tolist())}) <= 2 + len(text) // runindex.SLICE


def test_repeats_within_one_document(spark):
    line = "the same line again and again, "
    rows = [(1, line * 9), (2, "x" * 500), (3, "start " + line * 2 + "end"), (4, "ab" * 30 + "c" * 45), (5, "unlike any other text here " * 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert ours(df, SIZE) == by_definition(rows, SIZE)


def test_production_sizes(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = sorted(map(tuple, runindex.digests(odd).collect()), key=repr)
    assert got == by_definition(rows, 200)
    assert runindex.digests(none).count() == 0


def test_strip_keeps_rows_and_columns(spark, odd, none):
    got = runindex.strip_repeats(odd)
    assert [(f.name, f.dataType) for f in got.schema] == [(f.name, f.dataType) for f in odd.schema] and got.count() == odd.count()
    by = {r.doc_id: r for r in got.where("doc_id in (1, 5, 6, 7, 9)").collect()}
    assert by[5].text == by[6].text == "" and by[5].n_chars == 0 and by[1].text is None and by[7].text == "Ünïcödé 😀 漢字 \x00 end"
    assert runindex.strip_repeats(none).count() == 0


def test_common_lines_have_no_row_per_window(spark, monkeypatch):
    """Under the longest anchor windows are counted by part: no join makes a row of each."""
    draw = random.Random(5)
    line = "".join(draw.choice("abcdefgh ") for _ in range(3 * SIZE))
    rows = [(k, f"{draw.random()} {line} {draw.random()}") for k in range(60)] + [(99, line[:SIZE] + "x" * 30), (100, None)]
    levels, real = [], runindex.repeats

    def repeats(texts, length, anchors, **sizes):
        levels.append(anchors)
        return real(texts, length, anchors, **sizes)

    monkeypatch.setattr(runindex, "repeats", repeats)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert ours(df, SIZE, group_bytes=0) == by_definition(rows, SIZE)
    assert levels == [ANCHORS, ANCHORS[1:]]


def test_only_texts_with_a_window_of_equal_hash_are_indexed():
    shared = bytes(range(60))
    texts = [b"\xff" * 3 + shared, shared + b"tail", b"no window of this text is found anywhere else, it says", b"short"]
    assert runindex._may_repeat(texts, SIZE).tolist() == [True, True, False, False]
    assert runindex._may_repeat([], SIZE).tolist() == []
