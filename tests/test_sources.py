import pytest
from pyspark.sql import functions as F

from querysieve.operators import importing
from querysieve.operators.split import java_shuffled, java_split, split
from querysieve.sources import csvlog, layout, tables, textfiles

LOG = 'Query,Label\r\n"select ""a"", b\nfrom t",1\r\n\r\nx, 1\r\nx,0\r\nx,1\r\ny,abc\r\nz,\r\n,0\r\nbig,99999999999\r\nplus,+1\r\n'


def test_csv_import(spark, tmp_path):
    (tmp_path / "log.csv").write_bytes(LOG.encode())
    log = csvlog.read_log(spark, str(tmp_path / "log.csv"))
    assert log.count() == 9
    got = {r.raw_sql: (r.label, r.n_dups) for r in csvlog.import_log(log).collect()}
    # Labels with blanks, words or too many digits are skipped; the first of equal strings wins.
    assert got == {'select "a", b\nfrom t': (1, 1), "x": (0, 2), "": (0, 1), "plus": (1, 1)}
    again = csvlog.import_log(log, spark.createDataFrame([("x",)], "raw_sql string"))
    assert {r.raw_sql for r in again.collect()} == set(got) - {"x"}


def test_first_of_each_breaks_ties_by_order(spark):
    rows = spark.createDataFrame([(3, "a", 0), (1, "a", 1), (2, "b", 0), (4, None, 1)], "id int, raw_sql string, label int")
    got = {r.raw_sql: (r.label, r.n_dups) for r in importing.first_of_each(rows, "raw_sql", ["id"]).collect()}
    assert got == {"a": (1, 2), "b": (0, 1), None: (1, 1)}


def test_table(spark):
    spark.sql("DROP TABLE IF EXISTS training_data")
    tables.create(spark)
    tables.create(spark)
    rows = spark.createDataFrame([(1, "select 1", 0), (2, "a", 1), (3, "a", 0)], "id long, raw_sql string, label int")
    assert tables.append(rows) == {"attempted": 3, "inserted": 2}
    assert tables.append(rows.where("id > 1").unionByName(spark.createDataFrame([(4, "b", 1)], rows.schema))) == {"attempted": 3, "inserted": 1}
    got = {r.raw_sql: r for r in tables.read(spark).collect()}
    assert set(got) == {"select 1", "a", "b"} and got["a"].id == 2
    assert all(r.is_trained == 0 and r.created_at is not None and r.feature_vector is None for r in got.values())
    assert "training_data" in tables.names(spark)
    spark.sql("INSERT INTO training_data (id, raw_sql, label) VALUES (9, 'c', 1)")
    assert tables.read(spark).where("id = 9 and is_trained = 0 and created_at is not null").count() == 1
    spark.sql("DROP TABLE training_data")


def test_large_logs_can_be_split(spark, tmp_path):
    lines = ["Query,Label"] + [f'"select {k}, ""x""",{k % 2}' for k in range(3000)]
    (tmp_path / "log.csv").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        log = csvlog.read_log(spark, str(tmp_path / "log.csv"), line_breaks=False)
        assert log.rdd.getNumPartitions() > 2 and csvlog.read_log(spark, str(tmp_path / "log.csv")).rdd.getNumPartitions() > 2
        rows = sorted(log.collect(), key=lambda r: r.ord)
        assert [r.raw_sql for r in rows] == [f'select {k}, "x"' for k in range(3000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_fill_is_idempotent(spark):
    rows = spark.createDataFrame([(1, "select 1"), (2, "a=b")], "id long, raw_sql string")
    none = importing.fill_features(rows, rows.where("false").selectExpr("id", *[f"0d f{k}" for k in range(8)]))
    once = {tuple(r) for r in none.collect()}
    assert {tuple(r) for r in importing.fill_features(rows, none).collect()} == once and len(once) == 2


def test_text_round_trips(spark, tmp_path):
    tx = spark.createDataFrame([([1, 3, 4],), ([],), ([101],)], "items array<int>")
    textfiles.write_transactions(tx, str(tmp_path / "tx"))
    lines = sorted(r.value for r in spark.read.text(str(tmp_path / "tx")).collect())
    assert lines == ["", "1 3 4 ", "101 "]
    assert sorted(r["items"] for r in textfiles.read_transactions(spark, str(tmp_path / "tx")).collect()) == [[1, 3, 4], [101]]
    textfiles.write_itemsets(spark.createDataFrame([([3, 4, 100], 3735), ([1], 9)], "items array<int>, freq long"), str(tmp_path / "sets"))
    assert [r.value for r in spark.read.text(str(tmp_path / "sets")).collect()] == ["1 #SUP: 9", "3 4 100 #SUP: 3735"]
    found = spark.createDataFrame([([3, 100], [4, 5], 3735, 0.8502162531299795)], "antecedent array<int>, consequent array<int>, support long, confidence double")
    textfiles.write_rules(found, str(tmp_path / "rules"))
    assert spark.read.text(str(tmp_path / "rules")).first().value == "3 100 ==> 4 5 #SUP: 3735 #CONF: 0.8502162531299795"
    row = textfiles.read_rules(spark, str(tmp_path / "rules")).first()
    assert (row.antecedent, row.consequent, row.confidence) == ([3, 100], 4, 0.8502162531299795)


def test_comment_lines_hold_no_transaction(spark, tmp_path):
    (tmp_path / "t").write_text("# note\n%x\n@y\n\n1 2 \n")
    assert [r["items"] for r in textfiles.read_transactions(spark, str(tmp_path / "t")).collect()] == [[1, 2]]


def test_layout():
    assert layout.output_folder(3, 1) == "data/processed/Stage3/Version1"
    assert layout.output_folder(9, 1) == layout.output_folder(3, 9) == "data/processed"
    assert layout.output_name("Eclat", 0.05) == "Eclat_output_minSup_0.05.txt"
    assert layout.output_name("FPGrowth", 0.1, 0.6) == "FPGrowth_output_minSup_0.1_minConf_0.6.txt"


@pytest.mark.parametrize("n", [0, 1, 7, 100])
def test_split_sizes(spark, n):
    rows = spark.range(n).select("id", F.concat(F.lit("q"), (F.col("id") % 5).cast("string")).alias("raw_sql"))
    got = split(rows)
    assert got.where("is_train").count() == int(0.8 * n) and got.count() == n


def test_split_of_one_text(spark):
    """Rows of one text lie all over the order, so none of them meet in one task."""
    got = split(spark.range(3000).selectExpr("id", "'same' raw_sql"))
    assert got.where("is_train").count() == 2400
    assert split(spark.range(50).selectExpr("id", "cast(null as string) raw_sql"), share=1.0).where("not is_train").count() == 0


def test_shuffle_of_the_jvm(spark):
    jvm = spark._jvm
    for n in (10, 64, 1000):
        order = jvm.java.util.ArrayList()
        for k in range(n):
            order.add(k)
        jvm.java.util.Collections.shuffle(order, jvm.java.util.Random(42))
        assert java_shuffled(n, 42) == list(order)
    rows = java_split(spark.range(10), "id")
    assert {r.id for r in rows.where("is_train").collect()} == set(java_shuffled(10, 42)[:8])
    with pytest.raises(ValueError):
        java_split(spark.range(10), "id", most=5)


def test_fill_in_place(spark, monkeypatch):
    """A run that stops between batches is finished by the next; finished batches aren't written again."""
    from querysieve.sources import filling

    spark.sql("DROP TABLE IF EXISTS filled")
    filling.create(spark, "filled")
    filling.create(spark, "filled")
    log = spark.range(100).selectExpr("id", "concat('select ', id, ' where a=', id % 7) raw_sql")
    written, real = [], filling.write_batches

    def failing(rows, *more):
        if len(written) == 2:
            raise OSError("lost")
        real(rows, *more)
        written.append(sorted(r.batch for r in rows.select("batch").distinct().collect()))

    monkeypatch.setattr(filling, "write_batches", failing)
    with pytest.raises(OSError, match="lost"):
        filling.fill(log, "filled", batch_rows=10, at_once=2)
    assert written == [[0, 1], [2, 3]] and spark.table("filled").count() == 40
    monkeypatch.setattr(filling, "write_batches", real)
    assert filling.pending_batches(log, "filled", 10) == [4, 5, 6, 7, 8, 9]
    assert filling.fill(log, "filled", batch_rows=10, at_once=4) == 6
    assert filling.fill(log, "filled", batch_rows=10) == 0
    more = log.unionByName(spark.createDataFrame([(95_000, "x"), (5, "again")], "id long, raw_sql string"))
    assert filling.pending_batches(more, "filled", 10) == [9500] and filling.fill(more, "filled", batch_rows=10) == 1
    want = importing.fill_features(log, spark.table("filled").where("false"))
    got = spark.table("filled").where("id < 100").select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    spark.sql("DROP TABLE filled")


def test_import_into_buckets_leaves_the_table_in_place(spark):
    spark.sql("DROP TABLE IF EXISTS bucketed")
    tables.create(spark, "bucketed", buckets=6)
    rows = spark.range(1000).selectExpr("id", "concat('q', id % 300) raw_sql", "cast(id % 2 as int) label")
    assert tables.append(rows, "bucketed") == {"attempted": 1000, "inserted": 300}
    more = spark.range(1000).selectExpr("id + 5000 id", "concat('q', id % 500) raw_sql", "cast(1 as int) label")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ready = more.selectExpr("id", "raw_sql", "cast(null as array<double>) feature_vector", "label", "0 is_trained", "current_timestamp() created_at")
        plan = tables.fresh_rows(ready, "bucketed")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Bucketed: true" in plan
        scan = plan[: plan.index("Bucketed: true")].splitlines()[-4:]
        assert not any("Exchange" in line for line in scan)
        assert tables.append(more, "bucketed") == {"attempted": 1000, "inserted": 200}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    got = tables.read(spark, "bucketed")
    assert got.count() == got.select("raw_sql").distinct().count() == 500
    spark.sql("DROP TABLE bucketed")
