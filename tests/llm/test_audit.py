"""The audit of five filters against trying every order on every document."""

import random
import re
from collections import defaultdict
from itertools import permutations

import duckdb
import pytest
from pyspark.sql import functions as F

from querysieve.llm import audit, queries

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def failures(rows):
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    for i, t, _ in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        yield "".join(
            f for f, failed in zip("ABCDE", (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and i > least[t])) if failed
        )


def by_definition(rows, labels):
    good, toxic = ({i for i, *x in labels if x[k] == 1 and i is not None} for k in (0, 1))
    out = defaultdict(lambda: [0] * 6)
    shapley = defaultdict(int)
    for (i, _, lang), failed in zip(rows, failures(rows)):
        for order in map("".join, permutations("ABCDE")):
            gone = False
            for step, f in enumerate(order, 1):
                hit = f in failed
                out[lang or "", order, step][:] = [a + b for a, b in zip(out[lang or "", order, step], (
                    not hit and not gone, hit and not gone, hit and gone, failed == f, hit and not gone and i in good, hit and not gone and i in toxic))]
                shapley[lang or "", f] += hit and not gone
                gone |= hit
    return sorted((*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items())


def found(frame):
    return sorted(tuple(r[c] for c in COLUMNS) for r in frame.collect())


def made(seed):
    draw = random.Random(seed)
    texts = [
        None, "", "a b", "A B", "x" * 300, "x" * 299 + "y", "é" * 300, " ".join(f"w{k}" for k in range(250)), " ".join(f"w{k}" for k in range(249)) + " w2$9",
        " ".join(f"w{k % 90}" for k in range(250)), "y" * 9_000 + "a", "y" * 9_000 + "b", "SHOUT " * 300, "# sign",
    ]
    rows = [(draw.choice([None, *range(40)]), draw.choice(texts), draw.choice(["en", "fr", None, ""])) for _ in range(90)]
    labels = [(draw.choice([None, *range(50)]), draw.choice([0, 1, None]), draw.choice([0, 1])) for _ in range(40)]
    return rows, labels


@pytest.mark.parametrize("weak, broadcast", [(None, 1000), (None, 0), ("nothing", 1000), ("first", 0)])
def test_every_order(spark, weak, broadcast):
    rows, labels = made(broadcast)
    hashes = {"nothing": lambda c: F.lit(0), "first": lambda c: F.ascii(c)}
    docs, said = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = audit.audit(docs, said, broadcast=broadcast, **({"block_hash": hashes[weak]} if weak else {}))
    assert found(got) == by_definition(rows, labels)


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = [(r.doc_id, r.text, r.lang) for r in odd.collect()]
    assert found(audit.audit(odd, labels)) == by_definition(rows, [(4, 1, 0), (4, 0, 1), (None, 1, 1)])
    assert audit.audit(none, labels).count() == 0
    assert found(audit.audit(odd, labels.limit(0))) == by_definition(rows, [])


def test_marks(spark):
    rows = [(3, "a"), (1, "a"), (1, "a"), (None, "a"), (2, None), (9, ""), (5, "b")]
    got = audit.marked(spark.createDataFrame(rows, "doc_id long, text string"), {})
    assert sorted((r.doc_id or 0, r.is_copy) for r in got.collect()) == [(0, False), (1, False), (1, False), (2, False), (3, True), (5, False), (9, True)]


def test_against_sql(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    assert found(queries.QUERIES["op11_filter_audit"](spark, sf_dir)) == sorted(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({queries.ORACLE['op11_filter_audit']})").fetchall())
