"""Phrases by naming pairs, against counting all runs of words."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from querysieve.llm import queries
from querysieve.llm.collocations import collocations, encoded, framed, lowest_cut, packed, packed_words, unpacked, unpacked_words


def by_definition(rows, least, covered=80, top=2000, longest=4):
    counts, totals = {}, Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts.setdefault(lang or "und", Counter())[tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        frequent = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        ranked = []
        for p, a in frequent.items():
            inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: B023, E731
            if any(len(q) > len(p) and inside(q) and 100 * b >= covered * a for q, b in frequent.items()):
                continue
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            ranked.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, n + 1, p.decode(), -a, l, r, totals[lang], -s) for n, (s, a, p, l, r) in enumerate(sorted(ranked)[:top])]
    return sorted(out)


def found(frame):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in frame.collect())


@pytest.mark.parametrize("chunk, least, covered, top, pairs", [(4_000_000, 3, 80, 2000, 2_000_000), (300, 3, 80, 2000, 20), (1, 4, 50, 5, 2_000_000)])
def test_against_counting(spark, make, small_batches, chunk, least, covered, top, pairs):
    draw = random.Random(chunk)
    rows = [(draw.choice(["en", "fr", None, "und"]), re.sub(" ", lambda m: draw.choice([" ", " ", " ", "\t", ". ", ",", "\n", "  "]), t).replace("w1", draw.choice(["W1", "É1", "w1"]))) for _, t in make(5, 80, 6)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert found(collocations(docs, least, covered, top, chunk=chunk, pairs=pairs)) == by_definition(rows, least, covered, top)


def test_odd_rows(spark, odd, none):
    rows = [(r.lang, r.text) for r in odd.select("lang", "text").collect()]
    assert found(collocations(odd, least=2)) == by_definition(rows, 2)
    assert collocations(none).count() == 0
    assert collocations(odd.where("text is null")).count() == 0


def test_words_and_breaks():
    ids, words, counts = encoded([b"A b\x00\tB. a", b"", b"\xc3\x89 , a"])
    assert [words[int(k)] if k >= 0 else None for k in ids] == [b"a", b"b\x00", b"b", None, b"a", None, None, "É".encode(), None, b"a"]
    assert unpacked_words(packed_words(words)) == words and unpacked_words(packed_words([])) == [] and list(unpacked(packed(np.array([], int)))) == []
    assert counts.sum() == 6 and list(unpacked(framed(ids))) == [k for k, before in zip(ids, [0, *ids]) if k >= 0 or before >= 0]


def test_products_beyond_64_bits(spark):
    big = 9_000_000_000_000_000_000
    row = spark.createDataFrame([(big, [big, big - 1], [big - 3, big])], "a long, l array<long>, r array<long>")
    cut = row.select(lowest_cut(F.col("a"), F.col("l"), F.col("r")).alias("c")).first().c
    want = min((2_000_000 * big // (l + r), k, l, r) for k, (l, r) in enumerate([(big, big - 3), (big - 1, big)]))
    assert (cut.score, cut.k, cut.l, cut.r) == want


def test_against_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    names = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = con.execute(f"SELECT {', '.join(names)} FROM ({queries.ORACLE['op13_collocations']})").fetchall()
    assert found(queries.QUERIES["op13_collocations"](spark, sf_dir)) == sorted(want)
