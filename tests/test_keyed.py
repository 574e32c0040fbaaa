"""Cutting hot keys must not change any result."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetlens.functions.keyed import _cut, hot_keys, one_row_per, slice_numbers, with_previous, with_running_counts
from fleetlens.operators.ranking import transitions
from fleetlens.operators.telemetry import gap_report, plugin_runs


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most rows; times repeat and have holes; the flag is data-driven."""
    n = 6000
    rows = spark.range(n).select(
        F.when(F.col("id") % 10 < 7, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 5)).alias("key"),
        F.timestamp_seconds(F.floor(F.col("id") / 3) * 40 + F.when(F.col("id") > 3000, 500_000).otherwise(0)).cast("timestamp_ntz").alias("ts"),
        F.col("id"), (F.xxhash64("id") % 4).cast("string").alias("state"),
    )
    return rows.persist()


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_only_hot_keys_are_cut(skewed):
    assert hot_keys(skewed, ["key"], ["ts", "id"], 10_000_000) is None
    hot = hot_keys(skewed, ["key"], ["ts", "id"], 2000)
    assert [r.key for r in hot.collect()] == ["hot"]
    parts, by = _cut(skewed, ["key"], ["ts", "id"], hot_keys(skewed, ["key"], ["ts", "id"], 200))
    sizes = parts.groupBy(*by, "_slice").count()
    assert sizes.count() > 20
    assert sizes.agg(F.max("count")).first()[0] < 1000


@pytest.mark.parametrize("split", [10_000_000, 500, 7])
def test_previous_equals_plain_lag(skewed, split):
    w = Window.partitionBy("key").orderBy("ts", "id")
    want = skewed.select("*", F.lag("state").over(w).alias("was"), F.lag("ts").over(w).alias("before"))
    got = with_previous(skewed, ["key"], ["ts", "id"], {"was": "state", "before": "ts"}, hot_keys(skewed, ["key"], ["ts", "id"], split))
    assert rows(got) == rows(want)


@pytest.mark.parametrize("split", [10_000_000, 300])
def test_running_counts_equal_plain_sums(skewed, split):
    w = Window.partitionBy("key").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = skewed.select("*", F.sum(F.when(F.col("state") == "1", 1).otherwise(0)).over(w).alias("n"))
    assert rows(with_running_counts(skewed, ["key"], ["ts", "id"], {"n": F.col("state") == "1"}, hot_keys(skewed, ["key"], ["ts", "id"], split))) == rows(want)


def test_operators_give_the_same_when_cut(skewed):
    for build in (
        lambda s: transitions(skewed, ["key"], "ts", "state", "id", s),
        lambda s: gap_report(skewed, ["key"], "ts", "id", 40, 2, s),
        lambda s: plugin_runs(skewed, ["key"], ["ts", "id"], F.col("state") == "1", F.col("state") == "2", split=s),
    ):
        plain = rows(build(10_000_000))
        assert plain and plain == rows(build(250))


def test_null_state_is_a_value(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, None), ("a", 3, "x"), ("a", 4, None)], "key string, n bigint, state string")
    got = with_previous(df, ["key"], ["n"], {"was": "state", "at": "n"}, hot_keys(df, ["key"], ["n"], 1))
    assert rows(got.select("n", "was", "at")) == [(1, None, None), (2, None, 1), (3, None, 2), (4, "x", 3)]


def test_one_row_per_keeps_whole_rows(spark):
    df = spark.createDataFrame([("a", 1, "z"), ("a", 2, None), ("b", 5, "q")], "key string, n int, v string")
    assert rows(one_row_per(df, ["key"], ["n"])) == [("a", 2, None), ("b", 5, "q")]
    assert rows(one_row_per(df, ["key"], ["n"], last=False)) == [("a", 1, "z"), ("b", 5, "q")]
    assert rows(one_row_per(df, [], ["n"])) == [("b", 5, "q")]


def test_rows_without_a_key_keep_together(spark):
    df = spark.createDataFrame([(None, i, i % 2 == 0) for i in range(20)], "key string, n bigint, even boolean")
    for split in (100, 3):
        got = with_previous(df, ["key"], ["n"], {"was": "n"}, hot_keys(df, ["key"], ["n"], split))
        assert rows(got.select("n", "was")) == sorted([(i, i - 1 if i else None) for i in range(20)], key=repr)
        counted = with_running_counts(df, ["key"], ["n"], {"c": F.col("even")}, hot_keys(df, ["key"], ["n"], split))
        assert sorted(map(tuple, counted.select("n", "c").collect())) == [(i, i // 2 + 1) for i in range(20)]


def test_text_places_are_cut(spark):
    df = spark.range(2000).select(F.lit("a").alias("key"), F.sha2(F.col("id").cast("string"), 256).alias("at"), "id")
    w = Window.partitionBy("key").orderBy("at")
    hot = hot_keys(df, ["key"], ["at"], 100)
    assert rows(with_previous(df, ["key"], ["at"], {"was": "id"}, hot)) == rows(df.withColumn("was", F.lag("id").over(w)))
    sizes = slice_numbers(df, ["key"], ["at"], 100, "part").groupBy("part").count()
    assert sizes.count() >= 15 and sizes.agg(F.max("count")).first()[0] <= 200


def test_null_places_bursts_and_single_instants_give_the_same_when_cut(spark):
    n = 3000
    at = F.when(F.col("id") % 50 == 0, F.lit(None)).when(F.col("id") % 100 < 2, F.col("id") * 1000 - 900_000).otherwise(-F.col("id") % 300)
    bursty = spark.range(n).select(F.lit("burst").alias("key"), at.cast("long").alias("at"), "id", (F.xxhash64("id") % 3).cast("string").alias("state"))
    single = spark.range(n).select(F.lit("one").alias("key"), F.lit(7).cast("long").alias("at"), "id", F.lit("x").alias("state"))
    nameless = bursty.withColumn("key", F.lit(None).cast("string"))
    df = bursty.unionByName(single).unionByName(nameless).persist()
    w = Window.partitionBy("key").orderBy("at", "id")
    want = rows(df.select("*", F.lag("state").over(w).alias("was")))
    hot = hot_keys(df, ["key"], ["at", "id"], 200)
    assert {r.key for r in hot.collect()} == {"burst", "one", None}
    assert rows(with_previous(df, ["key"], ["at", "id"], {"was": "state"}, hot)) == want
    parts, by = _cut(df, ["key"], ["at", "id"], hot)
    sizes = parts.where("key = 'burst'").groupBy("_slice").count()
    assert sizes.agg(F.max("count")).first()[0] <= 400
    # rows of one instant are cut along their tie
    of_one = parts.where("key = 'one'").groupBy("_slice").count()
    assert of_one.count() >= 10 and of_one.agg(F.max("count")).first()[0] <= 400


def test_what_a_task_joins_does_not_grow_with_the_tables(spark):
    """Merged partitions of a large join stay small, where there are enough tasks to fill all cores."""
    from fleetlens.operators.matching import existence_check, request_results
    from fleetlens.session import tune

    tune(spark)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    some = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for key, value in some.items():
        spark.conf.set(key, value)
    try:
        requests = spark.range(3_000_000).select(F.col("id").alias("uuid"), F.xxhash64("id").alias("a"), F.xxhash64("id", F.lit(1)).alias("b"))
        joined = request_results(requests, requests.select(F.col("uuid").alias("request_uuid"), F.col("a").alias("part")))
        assert joined.rdd.getNumPartitions() >= 6 and joined.count() == 3_000_000
        asked = existence_check(requests.drop("uuid"), requests.select("a", "b"), ["a", "b"])
        assert asked.rdd.getNumPartitions() >= 6
    finally:
        for key in some:
            spark.conf.unset(key)
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert int(spark.conf.get("spark.sql.files.maxPartitionBytes").rstrip("m")) <= 32
