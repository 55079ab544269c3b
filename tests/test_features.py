import pytest
from pyspark.sql import functions as F

from querysieve.functions.features import SLOTS, count_sign, count_where, features, with_features
from querysieve.functions.items import items, with_label_item
from querysieve.functions.sqltext import recognised
from querysieve.functions.text import normalized
from querysieve.functions.vectors import text_to_vector, vector_to_text

# raw string, f0..f6, items: what the eight features must be (fixed values).
CASES = [
    ("select * from orders where o_orderkey = 0", 41, 1, 1, 1, 0, 0, 0, [3, 4]),
    ("1' or '1'='1", 12, 1, 0, 0, 0, 0, 0, [8]),
    ("select%20a%20from%20b%20where%20id%3D1", 26, 1, 1, 1, 0, 0, 0, [3, 4]),
    ("o'r'e'i1", 8, 0, 0, 0, 0, 3, 0, [6]),
    ("x=1 or a=2 or b=3 or c=4", 24, 4, 0, 0, 0, 0, 0, [2, 8]),
    ("select 1 where 1=1 where 2=3", 28, 2, 2, 1, 0, 0, 0, [33, 4]),
    ("a--b1#c", 7, 0, 0, 0, 0, 0, 2, [7]),
    ("hello+world+1", 13, 0, 0, 0, 0, 0, 0, []),
    ("select a union select b union select c", 38, 0, 0, 3, 2, 0, 0, [44, 55]),
    ("select%2", 8, 0, 0, 1, 0, 0, 0, [4]),  # malformed escape: nothing is decoded
    (None, 0, 0, 0, 0, 0, 0, 0, []),
    ("", 0, 0, 0, 0, 0, 0, 0, []),
    ("ß😀É", 5, 0, 0, 0, 0, 0, 0, []),  # SS, two UTF-16 units, É
    ("a\x0b\x0b b", 3, 0, 0, 0, 0, 0, 0, []),
    ("\x01 a \x1f", 1, 0, 0, 0, 0, 0, 0, []),
    (" a", 2, 0, 0, 0, 0, 0, 0, []),  # a wide blank stays
    ("ÉSELECT SELECT", 14, 0, 0, 2, 0, 0, 0, [44]),  # word limits are ASCII
    ("É'A A'B 'X' O'R'Z", 17, 0, 0, 0, 0, 3, 0, [6]),
]


def test_micro_cases(spark):
    rows = spark.createDataFrame([(k, c[0]) for k, c in enumerate(CASES)], "k int, raw_sql string")
    got = with_features(rows).withColumn("items", items()).orderBy("k").collect()
    for case, row in zip(CASES, got):
        assert [row[s] for s in SLOTS[:7]] == list(map(float, case[1:8])), case[0]
        assert row["items"] == case[8], case[0]


def test_or_share_counts_words(spark):
    p = F.lit("A OR B")
    assert spark.range(1).select(features(p)["f7"]).first()[0] == pytest.approx(1 / 3)


def test_limits_are_strict(spark):
    at = {"f0": 100.0, "f1": 3.0, "f2": 0.0, "f3": 0.0, "f4": 0.0, "f5": 2.0, "f6": 0.0, "f7": 0.2}
    assert spark.range(1).withColumns({k: F.lit(v) for k, v in at.items()}).select(items()).first()[0] == []


def test_parsed_branch_asks_for_substrings(spark):
    slots = features(F.lit("P WHERE WHERE UNION"), F.lit("SELECT NOWHERE = REUNION SELECT"))
    assert list(spark.range(1).select(slots["f1"], slots["f2"], slots["f3"], slots["f4"]).first()) == [1.0, 1.0, 2.0, 1.0]
    slots = features(F.lit("P WHERE WHERE UNION"), F.lit(None).cast("string"))
    assert list(spark.range(1).select(slots["f1"], slots["f2"], slots["f3"], slots["f4"]).first()) == [0.0, 2.0, 0.0, 1.0]


def test_literal_signs(spark):
    assert spark.range(1).select(count_sign(F.lit("'a' -- b"), "'", "literal")).first()[0] == 2
    with pytest.raises(ValueError):
        count_sign(F.lit(""), "'", "other")


def test_label_item_only_in_stage_three(spark):
    own, label = F.array(F.lit(1)), F.lit(1)
    row = spark.range(1).select(with_label_item(own, label, 3).alias("a"), with_label_item(own, label, 4).alias("b"), with_label_item(own, F.lit(7), 3).alias("c")).first()
    assert (row.a, row.b, row.c) == ([1, 101], [1], [1, 100])


def test_vector_text(spark):
    v = F.array(F.lit(34.0), F.lit(1.0), F.lit(0.25))
    row = spark.range(1).select(vector_to_text(v).alias("t"), text_to_vector(vector_to_text(v)).alias("v"), text_to_vector(F.lit("")).alias("e")).first()
    assert row.t == "[34.0, 1.0, 0.25]" and row.v == [34.0, 1.0, 0.25] and row.e is None


@pytest.mark.parametrize(
    "text, expected",
    [
        ("SELECT * FROM T WHERE A = 1", "SELECT * FROM T WHERE A = 1"),
        ("SELECT A , B FROM T -- NOTE", "SELECT A , B FROM T"),
        ("SELECT A FROM (SELECT B FROM C) X UNION ALL SELECT 1", "SELECT A FROM (SELECT B FROM C) X UNION ALL SELECT 1"),
        ("INSERT INTO T VALUES (1, 'A''B')", "INSERT INTO T VALUES (1, 'A''B')"),
        ("UPDATE T SET A = 1", "UPDATE T SET A = 1"),
        ("DELETE FROM T;", "DELETE FROM T"),
        ("1' OR '1'='1", None),
        ("SELECT", None),
        ("SELECT A FROM", None),
        ("SELECT A FROM B WHERE", None),
        ("SELECT (A FROM B", None),
        ("ADMIN'--", None),
        ("SELECT 1; SELECT 2", None),
        ("SELECT A = FROM B", None),
        ("HELLO WORLD", None),
        ("", None),
        (None, None),
    ],
)
def test_recogniser(spark, text, expected):
    assert spark.createDataFrame([(text,)], "p string").select(recognised(F.col("p")).alias("s")).first().s == expected


def test_recogniser_in_spark(spark):
    rows = spark.createDataFrame([("select 1",), ("x'",), (None,)], "raw string").select(recognised(normalized(F.col("raw"))).alias("s"))
    assert [r.s for r in rows.collect()] == ["SELECT 1", None, None]


def test_patterns_run_only_where_they_can_match(spark):
    """The same counts as by the pattern alone, nulls included; the plan looks for the fixed part first."""
    texts = [None, "", "OR", "xOR OR,OR or", "FORM", "a'b 'c", "--", "a--b#c#d", "SELECTéSELECT", "1OR1"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    word = "[A-Za-z0-9_]"
    for part, pattern in [("OR", f"(?<!{word})OR(?!{word})"), ("SELECT", f"(?<!{word})SELECT(?!{word})"), ("'", f"(?<={word})'(?={word})"), ("--", "--"), ("#", f"(?<={word})#(?={word})")]:
        both = rows.select(count_where(F.col("t"), part, pattern).alias("a"), F.regexp_count("t", F.lit(pattern)).cast("double").alias("b"))
        assert both.where("not a <=> b").count() == 0
        assert "Contains" in both._jdf.queryExecution().optimizedPlan().toString()
