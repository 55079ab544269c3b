"""Registered queries against DuckDB, models and the stream."""

import duckdb
import pytest

from querysieve.operators.metrics import METRICS, confusion_metrics, report
from querysieve.plans import registry, scenarios
from querysieve.plans.corpus import corpus
from querysieve.streaming import scorer

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows_of(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(map(repr, frame.itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_against_sql(spark, sf_dir, duck, name):
    ours, theirs = registry.QUERIES[name](spark, sf_dir).toPandas(), duck.execute(registry.ORACLE[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows_of(ours) == rows_of(theirs)


def test_every_query_has_sql_or_cannot():
    without = set(registry.QUERIES) - set(registry.ORACLE)
    assert without == {"scenario_grid"} | {f"model_{m}" for m in scenarios.MODELS} - {"model_naive_bayes"}


def test_parsed_accepts_statements_only(spark, sf_dir):
    got = registry.QUERIES["features_parsed"](spark, sf_dir)
    accepted = got.where("accepted").selectExpr("id % 12 kind").distinct().collect()
    assert {r.kind for r in accepted} == {0, 2, 3, 6}


@pytest.mark.parametrize("name", ["tree", "naive_bayes", "linear_svm", "precise_bayes"])
def test_models_learn(spark, sf_dir, name):
    row = scenarios.run_scenario(scenarios.prepared(corpus(spark, sf_dir)), 2, [name]).first()
    assert row.tp + row.fp + row.fn + row.tn == 300 and row.accuracy > 70


@pytest.mark.parametrize("name", ["random_forest", "boosted_trees", "boosted_stumps"])
def test_ensembles_learn(spark, sf_dir, name):
    from querysieve.operators import models

    rows = models.vectors(scenarios.expanded(scenarios.prepared(corpus(spark, sf_dir)), 1)).persist()
    size = {"random_forest": {"trees": 30}}.get(name, {"rounds": 20})
    fitted = models.MODELS[name](rows.where("is_train"), **size)
    row = confusion_metrics(models.predictions(fitted, rows.where("not is_train"))).first()
    assert row.accuracy > 70


def test_grid_covers_all_scenarios(spark, sf_dir):
    """With the two quickest models; the query runs all six the same way."""
    quick = ["tree", "naive_bayes"]
    rows = scenarios.run_all(corpus(spark, sf_dir), quick).collect()
    assert sorted((r.scenario, r.model) for r in rows) == sorted((k, m) for k in range(1, 8) for m in quick)
    same = {(r.scenario, r.model): r.accuracy for r in rows}
    assert all(same[1, m] == same[6, m] == same[7, m] > 70 for m in quick)


def test_models_work_on_kinds_of_rows(spark, sf_dir, monkeypatch):
    """Equal rows are one weighted row, in mining, fits and scores; metrics are those of the rows."""
    from querysieve.operators import models

    ready, seen, real = scenarios.prepared(corpus(spark, sf_dir)), [], models.MODELS["tree"]
    monkeypatch.setitem(models.MODELS, "tree", lambda train: seen.append(train) or real(train))
    found = scenarios.run_scenario(ready, 2, ["tree"]).first()
    assert seen[0].agg({"weight": "sum"}).first()[0] == ready.where("is_train").count() > 10 * seen[0].count()
    rows = models.vectors(scenarios.expanded(ready, 2))
    want = confusion_metrics(models.predictions(real(rows.where("is_train")), rows.where("not is_train"))).first()
    assert [found[c] for c in METRICS] == pytest.approx(list(want))


def test_forest_works_on_kinds_of_rows_too(spark, sf_dir, monkeypatch):
    from querysieve.operators import models

    ready, seen, real = scenarios.prepared(corpus(spark, sf_dir)), [], models.MODELS["random_forest"]
    monkeypatch.setitem(models.MODELS, "random_forest", lambda train: seen.append((train.count(), train.columns)) or real(train, 10))
    found = scenarios.run_scenario(ready, 2, ["random_forest"]).first()
    assert "weight" in seen[0][1] and seen[0][0] < ready.where("is_train").count() / 10
    assert found.tp + found.fp + found.fn + found.tn == 300 and found.accuracy > 70


def test_other_labels_are_refused(spark):
    from querysieve.operators import models

    rows = spark.createDataFrame([([1.0], 0), ([2.0], 2)], "expanded array<float>, label int")
    with pytest.raises(Exception, match="labels are 0 or 1"):
        models.vectors(rows).collect()
    assert models.vectors(rows.where("label = 0")).count() == 1


def test_pruning_takes_back_what_the_held_rows_deny(spark):
    from pyspark.ml.classification import DecisionTreeClassifier

    from querysieve.operators import models

    rule = models.vectors(spark.createDataFrame([([float(k)], int(k > 120)) for k in range(300)], "expanded array<float>, label int"))
    grown = DecisionTreeClassifier(maxDepth=3, maxBins=300).fit(rule)
    assert models.pruned(grown, {}) == [1.0, 1.0]  # nothing speaks for the branch
    assert models.pruned(grown, {(0, 0): 40, (1, 1): 60}) == [0.0, 1.0]
    assert models.pruned(grown, {(0, 1): 50, (1, 0): 10}) == [1.0, 1.0]
    fitted = models.tree(rule)
    assert models.predictions(fitted, rule).where("label = prediction").count() > 280


def test_feature_time(spark, sf_dir):
    seconds, dims = scenarios.feature_time(scenarios.prepared(corpus(spark, sf_dir)), 1)
    assert seconds > 0 and dims == 8


def test_metrics_without_rows_are_zero(spark):
    rows = spark.createDataFrame([], "label int, prediction int")
    assert list(confusion_metrics(rows).first()) == [0] * 4 + [0.0] * 8


def test_metrics_by_hand(spark):
    rows = spark.createDataFrame([(1, 1), (1, 1), (1, 0), (0, 1), (0, 0), (2, 0), (None, 0)], "label int, prediction int")
    row = confusion_metrics(rows.where("label is not null")).first().asDict()
    assert [row[k] for k in METRICS[:4]] == [2, 1, 1, 2]
    assert row["p1"] == pytest.approx(2 / 3) and row["accuracy"] == pytest.approx(400 / 6)
    assert "Accuracy: 66.67%" in report(row, "any")


def test_stream(spark, tmp_path):
    for k, text in enumerate(["select 1", "a=b=c=d=e"]):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / f"in/{k}.json").write_text('{"raw_sql": "%s"}\n' % text)
    stream = spark.readStream.schema("raw_sql string").json(str(tmp_path / "in"))
    q = scorer.to_table(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    q.processAllAvailable()
    q.stop()
    assert {r.raw_sql: r["items"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"select 1": [4], "a=b=c=d=e": [2]}


def test_first_seen_is_a_stream_too(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"raw_sql": "x", "ts": "2024-01-01T00:00:00"}\n{"raw_sql": "x", "ts": "2024-01-01T00:01:00"}\n')
    stream = spark.readStream.schema("raw_sql string, ts timestamp").json(str(tmp_path / "in"))
    q = scorer.first_seen(stream).writeStream.format("memory").queryName("seen").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("seen").count() == 1


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(registry.QUERIES) <= set(e.queries())
