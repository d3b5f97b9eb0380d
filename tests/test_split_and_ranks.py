import math
import random
from datetime import date, datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pressloom.operators import clean, report
from pressloom.operators.order_stats import exact_medians, select_ranks
from pressloom.operators.split import time_based_split


def brute_split(rows, train=0.70, val=0.15):
    ordered = sorted(rows, key=lambda r: (r[1] is None, r[1] or rows[0][1] or 0, r[0]))
    a = math.floor(len(rows) * train)
    b = a + math.floor(len(rows) * val)
    return {r[0]: "train" if i < a else "val" if i < b else "test" for i, r in enumerate(ordered)}


def check(spark, rows, kind):
    df = spark.createDataFrame(rows, f"doc_id long, date {kind}")
    got = {r["doc_id"]: r["split"] for r in time_based_split(df).collect()}
    assert got == brute_split(rows)


def test_split_with_ties_and_nulls(spark):
    rng = random.Random(1)
    days = [date(2020, 1, 1) + timedelta(days=rng.choice([0, 0, 0, 1, 2, 30])) for _ in range(200)]
    check(spark, [(i * 7919 % 1009, None if i % 9 == 0 else d) for i, d in enumerate(days)], "date")


def test_split_where_one_day_holds_everything(spark):
    check(spark, [(i, date(2020, 5, 5)) for i in range(101)], "date")


def test_split_where_most_dates_are_missing(spark):
    check(spark, [(i, date(2020, 5, 5) if i % 10 == 0 else None) for i in range(60)], "date")


def test_split_on_timestamps(spark):
    rng = random.Random(2)
    check(spark, [(i, datetime(2020, 1, 1) + timedelta(microseconds=rng.randrange(10**13))) for i in range(80)], "timestamp")


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7])
def test_split_of_few_rows(spark, n):
    check(spark, [(i, date(2020, 1, 1 + i)) for i in range(n)], "date")


def test_split_without_a_date_follows_the_ids(spark):
    df = spark.createDataFrame([(i,) for i in range(20)], "doc_id long")
    got = [r["split"] for r in time_based_split(df).orderBy("doc_id").collect()]
    assert got == ["train"] * 14 + ["val"] * 3 + ["test"] * 3


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.integers(-(2**63), 2**63 - 1), st.integers(-5, 5)), min_size=1, max_size=40))
def test_ranks_of_any_longs(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v long")
    found = select_ranks(df, F.col("v"), lambda n, _: list(range(1, n + 1)))[0]
    ordered = sorted(values)
    assert {k: v for k, v in found.items()} == {
        i + 1: (v, sum(x < v for x in values)) for i, v in enumerate(ordered)
    }


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6).map(lambda x: x + 0.0), min_size=1, max_size=40))
def test_medians_of_any_doubles(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = exact_medians(df, F.col("v"), F.lit("all"))["all"]
    expected = df.agg(F.median("v")).first()[0]
    assert got == pytest.approx(expected, rel=1e-12, abs=1e-12)


def test_a_group_with_a_third_of_all_rows(spark):
    df = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 5)).alias("g"),
        (F.xxhash64("id") % 1000 / 999.0).alias("v"),
    )
    expected = {r["g"]: r["m"] for r in df.groupBy("g").agg(F.median("v").alias("m")).collect()}
    assert exact_medians(df, F.col("v"), F.col("g")) == pytest.approx(expected)


def test_summary_medians_equal_the_built_in_ones(spark):
    df = spark.createDataFrame(
        [("val" if i % 2 else "test", None if i % 7 == 0 else f"s{i % 3}", float("nan") if i % 11 == 0 else (i * 37 % 101) / 101,
          None if i % 5 == 0 else (i * 53 % 97) / 97) for i in range(500)],
        "split string, prompt_strategy string, rouge1 double, rouge2 double",
    )
    found = {(r.split, r.prompt_strategy): (r.rouge1_median, r.rouge2_median) for r in report.summary_by_strategy(df).collect()}
    number = F.nanvl("rouge1", F.lit(None).cast("double"))
    built_in = df.where("prompt_strategy is not null").groupBy("split", "prompt_strategy").agg(F.median(number), F.median("rouge2"))
    assert found == {(r[0], r[1]): (r[2], r[3]) for r in built_in.collect()}


def test_keep_first_treats_null_as_a_key(spark):
    df = spark.createDataFrame([(3, "a", 1), (1, "a", 2), (2, None, 3), (5, None, 4), (4, "A ", 5)], "doc_id int, headline string, x int")
    exact = sorted(r["doc_id"] for r in clean.remove_duplicates(df).collect())
    near = sorted(r["doc_id"] for r in clean.remove_near_duplicates(df).collect())
    assert (exact, near) == ([1, 2, 4], [1, 2])


def test_medians_with_infinities(spark):
    from pressloom.operators.order_stats import exact_medians

    inf = float("inf")
    groups = {"a": [1.0, inf, 3.0], "b": [-inf, -inf, 2.0], "c": [inf], "d": [1.0, 2.0, inf, -inf]}
    rows = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double")
    assert exact_medians(rows, F.col("v"), F.col("g")) == {"a": 3.0, "b": -inf, "c": inf, "d": 1.5}
