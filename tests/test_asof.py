"""As-of joins against brute force: a hot key, long spans, ties, nulls, rows before and after all facts, an empty right side."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from panelforge.operators import asof

RIGHT = "k long, since date, v long"


def day_of(rng, first, last):
    return dt.date(first, 1, 1) + dt.timedelta(days=rng.randrange(365 * (last - first)))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    left = [(i, 1 if i % 2 else rng.choice([None, 2, 3, 4, 5]), None if i % 50 == 0 else day_of(rng, 1960, 2040)) for i in range(1500)]
    right = [(k, day_of(rng, 1970, 2005), v) for v, k in enumerate([1] * 40 + [2] * 3 + [3] + [None] * 4)]
    right += [(2, right[40][1], 100), (2, right[40][1], 101), (2, None, 102), (5, dt.date(1971, 12, 31), 103), (5, dt.date(1972, 1, 1), 104), (5, dt.date(2005, 1, 1), 105)]
    return left, right


def joined(spark, left, right, **more):
    df = spark.createDataFrame(left, "id long, k long, t date")
    out = asof.latest_before(df, spark.createDataFrame(right, RIGHT).withColumnRenamed("k", "rk"), "k", "t", "rk", "since", [F.col("v").desc()], {"v": "v", "since": "since"}, **more)
    assert out.columns == ["id", "k", "t", "v", "since"]
    return out


@pytest.mark.parametrize("years", [1, 2, 7, 10_000])
def test_rows_are_those_of_brute_force(spark, rows, years):
    left, right = rows

    def want(k, t):
        mine = [(s, v) for key, s, v in right if None not in (k, t, s) and key == k and s <= t]
        return max(mine) if mine else (None, None)

    got = joined(spark, left, right, bucket_years=years).collect()
    assert sorted(r.id for r in got) == list(range(len(left)))
    assert all((r.since, r.v) == want(r.k, r.t) for r in got)
    assert sum(r.v is not None for r in got) > 600


def test_a_hot_key_spreads_over_its_years(spark, rows):
    left, right = rows
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "40"}
    before = {c: spark.conf.get(c) for c in conf}
    try:
        for c, v in conf.items():
            spark.conf.set(c, v)
        hot = joined(spark, left, right).where("k = 1 and t is not null")
        tasks = hot.groupBy(F.spark_partition_id().alias("p")).count().toPandas()["count"]
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert len(tasks) >= 8 and tasks.drop(tasks.idxmax()).sum() > 0.4 * tasks.sum()  # the years after the newest fact are one bucket


def test_nothing_on_the_right(spark, rows):
    left, right = rows
    for some in ([], [(None, dt.date(2000, 1, 1), 1), (1, None, 2)]):
        got = joined(spark, left, some).collect()
        assert len(got) == len(left) and all(r.v is None and r.since is None for r in got)
    assert joined(spark, [], right).count() == 0
