import base64
import math
import random

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from querysieve.llm import langid

PATH = P.path("byte_bpe_multi_50k.tiktoken")


def texts(seed):
    draw = random.Random(seed)
    words = {"xx": ["kala", "meri", "talo", "puu", "vesi"], "yy": ["strom", "voda", "hrad", "vlk", "krk"]}
    rows = []
    for k in range(60):
        lang = draw.choice(["xx", "yy"])
        rows.append((k, " ".join(draw.choice(words[lang]) for _ in range(draw.randint(3, 30))), lang))
    return rows


def test_forward_sums_all_segmentations():
    pieces = {b" ": 0, b"a": 1, b"b": 2, b"ab": 3, b" a": 4, b"aba": 5}
    p = np.random.default_rng(0).random((6, 3))

    def ways(b, col):
        return 1.0 if not b else sum(p[k, col] * ways(b[len(t) :], col) for t, k in pieces.items() if b.startswith(t))

    found = langid.Lattice(pieces).log_likelihoods(["abab", "a", "baba", "abab"], p)
    for row, word in zip(found, ["abab", "a", "baba", "abab"]):
        assert row.tolist() == pytest.approx([math.log(ways(b" " + word.encode(), c)) for c in range(3)])


def test_long_words_stay_in_range():
    pieces = {bytes([b]): b for b in range(256)}
    p = np.full((256, 2), 1e-7)
    found = langid.Lattice(pieces).log_likelihoods(["q" * 500, "q"], p)
    assert found[0].tolist() == pytest.approx([501 * math.log(1e-7)] * 2)


def test_expected_counts_add_up():
    pieces = {b" ": 0, b"a": 1, b"b": 2, b"ab": 3, b" a": 4}
    counts = langid.Lattice(pieces).expected_counts("ab", [0.2] * 5)
    sizes = {v: len(k) for k, v in pieces.items()}
    assert sum(sizes[k] * c for k, c in counts) == pytest.approx(3)  # every byte is in one piece


def test_expected_counts_of_long_words():
    """Scaled sums: every byte is still in one piece, and short words count as the plain sums do."""
    pieces = {b" ": 0, b"a": 1, b"b": 2, b"ab": 3, b" a": 4, b"bab": 5}
    sizes, p = {v: len(k) for k, v in pieces.items()}, [1e-7, 2e-7, 1e-8, 3e-7, 1e-7, 2e-8]
    lattice = langid.Lattice(pieces)
    for word in ("ab", "abab" * 5, "ab" * 400, "a" * 999):
        counts = lattice.expected_counts(word, p)
        assert sum(sizes[k] * c for k, c in counts) == pytest.approx(len(word) + 1)

    def cuts(b):
        return [[]] if not b else [[k, *rest] for t, k in pieces.items() if b.startswith(t) for rest in cuts(b[len(t) :])]

    ways = [(np.prod([p[k] for k in c]), c) for c in cuts(b" ababab")]
    want = sum(w * c.count(3) for w, c in ways) / sum(w for w, _ in ways)
    assert sum(c for k, c in lattice.expected_counts("ababab", p) if k == 3) == pytest.approx(want)


def test_scripts_without_blanks_teach(spark):
    """Every word is longer than any limit one might set."""
    draw = random.Random(3)
    syllables = {"xx": ["ka", "la", "me", "ri"], "yy": ["str", "vlk", "hra", "dom"]}
    rows = [(k, "".join(draw.choice(syllables[lang]) for _ in range(70)), lang) for k, lang in enumerate(["xx", "yy"] * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.predict(docs, langid.fit(docs, PATH), PATH).join(docs, "doc_id")
    assert got.where("lang = lang_pred and score > 0.9").count() == 40


def test_learns_and_holds_out(spark):
    rows = spark.createDataFrame(texts(1), "doc_id long, text string, lang string")
    model = langid.fit(rows, PATH, use=F.col("doc_id") % 3 != 1)
    assert model.languages == ("xx", "yy")
    got = langid.predict(rows, model, PATH).join(rows, "doc_id")
    assert got.where("lang = lang_pred and score between 0.5 and 1").count() == 60


def test_odd_documents(spark, odd, none):
    model = langid.fit(spark.createDataFrame(texts(2), "doc_id long, text string, lang string"), PATH)
    got = langid.predict(odd, model, PATH)
    assert got.count() == odd.count()
    und = {r.doc_id for r in got.where("lang_pred = 'und'").collect()}
    assert und == {None, 1, 2, 3, 8} and got.where("lang_pred = 'und' and score <> 0").count() == 0
    assert langid.predict(none, model, PATH).count() == 0
    kept = langid.keep_known(odd, model, PATH)
    assert kept.schema == odd.schema and kept.where("doc_id in (1, 2, 3, 8)").count() == 0 and kept.where("doc_id = 4").count() == 3


def test_nothing_to_learn(spark, odd, none):
    model = langid.fit(none, PATH)
    assert model.languages == () and {r.lang_pred for r in langid.predict(odd, model, PATH).collect()} == {"und"}


@pytest.mark.parametrize("doc_id", ["7L", "cast(null as long)", "id"])
def test_rows_of_one_id_are_drawn_like_others(spark, doc_id):
    rows = spark.range(6000).selectExpr(f"{doc_id} as doc_id", "concat('text ', id) as text", "'en' as lang")
    languages, drawn = langid._training_rows(rows, F.lit(True), 1500)
    assert languages == ["en"] and 1300 < drawn.count() < 1700


def test_fit_and_score_by_definition(spark, tmp_path):
    """Every round over all cuts of every word, and every text's score from its words' sums: no lattice, no trie."""
    tokens = [b" ", b"a", b"b", b"c", b"ab", b" a", b"bc", b" ab", b"ca"]
    (tmp_path / "pieces").write_text("".join(f"{base64.b64encode(t).decode()} {k}\n" for k, t in enumerate(tokens)))
    draw = random.Random(3)
    rows = [(k, " ".join("".join(draw.choice("ab" if k % 3 else "bca") for _ in range(draw.randint(1, 5))) for _ in range(draw.randint(0, 9))), "xx" if k % 3 else "yy") for k in range(40)]
    rows += [(50, None, "xx"), (51, "123 !", "yy"), (52, "abc", None)]

    def cuts(b):
        return [[]] if not b else [[k, *rest] for k, t in enumerate(tokens) if b.startswith(t) for rest in cuts(b[len(t) :])]

    ways = {w: cuts(b" " + w.encode()) for _, t, _ in rows for w in langid.words(t)}
    languages, n = ["xx", "yy"], len(tokens)
    p = np.full((n, 2), 1 / n)
    for _ in range(langid.ROUNDS):
        c = np.zeros((n, 2))
        for _, text, lang in rows:
            for w in langid.words(text) if lang else []:
                col = languages.index(lang)
                chances = [np.prod([p[k, col] for k in cut]) for cut in ways[w]]
                for cut, chance in zip(ways[w], chances):
                    for k in cut:
                        c[k, col] += chance / sum(chances)
        background = (c.sum(axis=1) + 0.01) / (c.sum() + 0.01 * n)
        c += langid.PRIOR_WEIGHT * background[:, None]
        p = np.maximum(c / c.sum(axis=0), langid.LEAST)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = langid.fit(docs, str(tmp_path / "pieces"))
    assert model.languages == ("xx", "yy")
    np.testing.assert_allclose(model.probabilities, p, rtol=1e-9)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, model, str(tmp_path / "pieces")).collect()}
    for i, text, _ in rows:
        own = langid.words(text)
        if not own:
            assert got[i] == ("und", 0.0)
            continue
        total = np.array([sum(math.log(sum(np.prod([p[k, col] for k in cut]) for cut in ways[w])) for w in own) for col in (0, 1)])
        odds = np.exp((total - total.max()) / math.sqrt(len(own)))
        best = int(odds.argmax())
        assert got[i] == (languages[best], pytest.approx(odds[best] / odds.sum()))
