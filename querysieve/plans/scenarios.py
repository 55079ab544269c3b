"""Training and evaluating the six classifiers in the seven scenarios."""

from __future__ import annotations

import time
from collections.abc import Iterable
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querysieve.functions.features import SLOTS
from querysieve.operators.expand import SCENARIOS, expand
from querysieve.operators.held import held
from querysieve.operators.metrics import confusion_metrics
from querysieve.operators.models import MODELS, OTHERS, predictions, vectors
from querysieve.operators.split import split_by_place, with_place
from querysieve.plans.corpus import featured, transactions


def prepared(rows: DataFrame, parsed: bool = False) -> DataFrame:
    """``rows`` (id, raw_sql, label) -> id, label, slots, items and is_train, computed once for all that reads them."""
    ready = transactions(featured(with_place(rows), parsed=parsed))
    return split_by_place(held(ready.select("id", "label", *SLOTS, "items", "place")))


def expanded(ready: DataFrame, scenario: int, per_kind: dict[str, Column] | None = None) -> DataFrame:
    """``ready`` from ``prepared`` -> ``expanded`` (and ``per_kind``) added; patterns and rules come from the training part only."""
    return expand(ready, ready.where("is_train"), scenario, per_kind)


def kinds_of(ready: DataFrame) -> DataFrame:
    """``ready`` -> equal rows as one, with their number as ``weight``: one shuffle, combined before it."""
    return held(ready.groupBy("label", *SLOTS, "items", "is_train").agg(F.count("*").alias("weight")))


def run_scenario(ready: DataFrame, scenario: int, models: Iterable[str] = MODELS, kinds: DataFrame | None = None) -> DataFrame:
    """scenario, model and the confusion metrics on the test part, a row per model.

    ``kinds`` are those of ``ready`` (``kinds_of``), made here unless given.  Mining, expansion, fits and scores work on them; none
    sees rows singly.  Models are fitted side by side: each is a long row of small jobs, which leave most
    of a cluster idle.
    """
    kinds = kinds_of(ready) if kinds is None else kinds
    known = kinds.where("is_train")
    rows = vectors(expand(kinds, known, scenario)).persist()
    train, test = rows.where("is_train"), rows.where("not is_train")

    def one(name: str) -> DataFrame:
        scored = predictions((MODELS | OTHERS)[name](train), test).withColumns({"scenario": F.lit(scenario), "model": F.lit(name)})
        found = confusion_metrics(scored, ["scenario", "model"])
        return found.sparkSession.createDataFrame(found.collect(), found.schema)  # one row; the cached vectors go

    try:
        rows.count()
        with ThreadPool(len(MODELS)) as pool:
            return reduce(DataFrame.unionByName, pool.map(inheritable_thread_target(rows.sparkSession)(one), list(models)))
    finally:
        rows.unpersist()


def feature_time(ready: DataFrame, scenario: int) -> tuple[float, int]:
    """Seconds that mining and expansion take, and the number of columns they give."""
    began = time.perf_counter()
    rows = expanded(ready, scenario)
    dims = rows.agg(F.max(F.size("expanded"))).first()[0] or 0
    return time.perf_counter() - began, dims


def run_all(rows: DataFrame, models: Iterable[str] = MODELS) -> DataFrame:
    """Every scenario with every model, side by side; scenarios that add nothing have the same rows, so they are run once."""
    ready, models = prepared(rows), list(models)
    kinds = kinds_of(ready)
    plain = [number for number, scenario in SCENARIOS.items() if scenario.uses is None]
    own = [number for number in SCENARIOS if number not in plain[1:]]

    def one(number: int) -> DataFrame:
        return run_scenario(ready, number, models, kinds)

    with ThreadPool(len(own)) as pool:
        found = dict(zip(own, pool.map(inheritable_thread_target(ready.sparkSession)(one), own)))
    found |= {number: found[plain[0]].withColumn("scenario", F.lit(number)) for number in plain[1:]}
    return reduce(DataFrame.unionByName, [found[number] for number in SCENARIOS])
