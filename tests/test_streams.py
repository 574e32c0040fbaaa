"""Streams fed in several files against the same question asked of the whole table."""

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetlens.functions.keyed import day_bucket
from fleetlens.functions.values import is_blank
from fleetlens.operators.matching import reconcile_plan
from fleetlens.operators.worker import worker_map, worker_outcomes, worker_slices
from fleetlens.streaming import jobs
from fleetlens.streaming.sinks import append_run, counted, kept_and_late, on_clock, read_stream, run_append, run_update, update_run

EVENTS = "/root/testdata/sf0.001/events.parquet"


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)


@pytest.fixture(scope="module")
def events(spark):
    return spark.read.parquet(EVENTS).persist()


@pytest.fixture(scope="module")
def parts(spark, events, tmp_path_factory):
    """The events in six files that follow each other in time, one written after the other."""
    folder = str(tmp_path_factory.mktemp("events"))
    bounds = [f"2024-01-{d:02d}" for d in (1, 6, 11, 16, 21, 26)] + ["2024-02-02"]
    for low, high in zip(bounds, bounds[1:]):
        events.where((F.col("ts") >= low) & (F.col("ts") < high)).coalesce(1).write.mode("append").parquet(folder)
    return folder


def stream(spark, parts):
    return spark.readStream.schema(spark.read.parquet(parts).schema).option("maxFilesPerTrigger", 1).parquet(parts)


@pytest.mark.parametrize("split", [10_000_000, 3])
def test_changes_over_batches(spark, events, parts, split):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    seen = events.withColumn("was", F.lag("event_type").over(w))
    want = seen.where(F.col("was").isNull() | (F.col("was") != F.col("event_type")))
    got = jobs.desired_changes(stream(spark, parts), "user_id", ["ts", "event_id"], ["event_type"], split)
    assert rows(got, "event_id") == rows(want, "event_id")


def test_unchanged_rows_without_a_key_pass_once(spark, tmp_path):
    for i in range(3):
        df = spark.createDataFrame([(i, None, "x"), (i, "k", "ab"[i % 2])], "at long, key string, state string")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    from fleetlens.streaming.sinks import read_stream

    got = jobs.desired_changes(read_stream(spark, str(tmp_path / "in"), 1), "key", ["at"], ["state"])
    assert sorted(map(repr, got.select("key", "state").collect())) == sorted(
        map(repr, spark.createDataFrame([(None, "x"), ("k", "a"), ("k", "b"), ("k", "a")], "key string, state string").collect()))


def test_drift_over_batches(spark, events, parts):
    desired = spark.range(0, 200).select(F.col("id").alias("user_id"), F.lit("view").alias("event_type")).where("user_id % 3 != 0")
    plan = jobs.drift_stream(stream(spark, parts), desired, "user_id", ["ts", "event_id"], ["event_type"])
    assert plan.select("batch").distinct().count() == 6
    last = plan.groupBy("user_id").agg(F.max_by(F.struct("action", "changed"), "batch").alias("p")).select("user_id", "p.*")
    newest = events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"))
    whole = reconcile_plan(desired, newest, ["user_id"], ["event_type"])
    assert rows(last) == rows(whole.where("action != 'create'"))
    assert rows(jobs.never_observed(plan, desired, "user_id"), "user_id") == rows(whole.where("action = 'create'"), "user_id")


def test_windows_over_batches_hold_open_ones_too(spark, events, parts):
    clock = on_clock(stream(spark, parts), "ts", "1 day")
    got = run_update(jobs.telemetry_windows(clock, ["event_type"], "ts", "value", "2 days"), ["event_type", "window_start"], "w")
    want = jobs.telemetry_windows(events.withColumn("ts", F.col("ts").cast("timestamp")), ["event_type"], "ts", "value", "2 days")
    assert rows(got) == rows(want)


def spans_of(spark, source, key="user_id", width=3600):
    return jobs.activity_spans(source.select(key, "ts"), key, "ts", width)


def plain_presence(events, silence, carried=()):
    """(key, state, at, open) and the last states, from (key, instant) pairs; `carried` are periods of an earlier run."""
    out, states, by = [], [], {}
    for key, at in sorted(events):
        by.setdefault(key, []).append(at)
    old = {k: (since, last) for k, since, last in carried}
    end = max([a for _, a in events] + [last for _, last in old.values()], default=None)
    for key in {*by, *old}:
        since, last = old.get(key, (None, None))
        for at in by.get(key, []):
            if last is not None and at - last <= silence:
                last = max(at, last)
                continue
            if last is not None:
                out.append((key, "offline", last + silence, False))
            out.append((key, "online", at, False))
            since = last = at
        if last + silence < end:
            out.append((key, "offline", last + silence, False))
        else:
            out = [r for r in out if r[:3] != (key, "online", since)] + [(key, "online", since, True)]
            states.append((key, since, last))
    return sorted(out, key=repr), sorted(states, key=repr)


def pairs_of(df):
    return [(r.user_id, r.us) for r in df.select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).collect()]


def presence_rows(table):
    return sorted(map(tuple, table.select("user_id", "state", F.unix_micros("at"), "open").collect()), key=repr)


def test_presence_over_batches_with_its_open_end(spark, events, parts):
    got, states = jobs.presence(spans_of(spark, stream(spark, parts)), "user_id", 12 * 3600)
    want, last = plain_presence(pairs_of(events), 12 * 3600 * 10**6)
    assert presence_rows(got) == want and any(r[3] for r in want)
    assert rows(states) == last


def test_presence_goes_on_from_last_states(spark, events, tmp_path):
    silence, carried = 12 * 3600, None
    cuts = ["2024-01-01", "2024-01-12", "2024-01-20", "2024-02-02"]
    for low, high in zip(cuts, cuts[1:]):
        part = events.where((F.col("ts") >= low) & (F.col("ts") < high)).select("user_id", "ts")
        part.write.parquet(str(tmp_path / low))
        got, states = jobs.presence(spans_of(spark, read_stream(spark, str(tmp_path / low))), "user_id", silence, last_states=carried)
        before = [tuple(r) for r in carried.collect()] if carried is not None else []
        want, last = plain_presence(pairs_of(part), silence * 10**6, before)
        assert presence_rows(got) == want and rows(states) == last
        carried = states


def test_boards_without_a_name_are_one_board(spark, tmp_path):
    data = [(None, "2024-01-01 00:00:00"), (None, "2024-01-01 00:30:00"), ("a", "2024-01-01 05:00:00"), ("b", None)]
    spark.createDataFrame(data, "user_id string, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(str(tmp_path / "in"))
    got, _ = jobs.presence(spans_of(spark, read_stream(spark, str(tmp_path / "in"))), "user_id", 3600)
    assert [(k, s, o) for k, s, _, o in presence_rows(got)] == [("a", "online", True), (None, "offline", False), (None, "online", False)]


def odd_keys(spark, events, folder):
    """Events in three files, under names that a bucket must keep apart."""
    name = F.when(F.col("user_id") % 5 == 0, F.concat(F.lit('"q\\ü\n'), F.col("user_id"))).when(F.col("user_id") % 5 > 1, F.col("user_id").cast("string"))
    named = events.select(name.alias("user_id"), "ts")
    for low, high in (("2024-01-01", "2024-01-09"), ("2024-01-09", "2024-01-20"), ("2024-01-20", "2024-02-02")):
        named.where((F.col("ts") >= low) & (F.col("ts") < high)).coalesce(1).write.mode("append").parquet(folder)
    return [(repr(k), at) for k, at in pairs_of(named)]


@pytest.mark.parametrize("buckets", [1, 3])
def test_many_boards_share_a_bucket_of_state(spark, events, tmp_path, buckets):
    pairs = odd_keys(spark, events, str(tmp_path / "in"))
    source = lambda: spans_of(spark, read_stream(spark, str(tmp_path / "in"), 1))
    got, states = jobs.presence(source(), "user_id", 12 * 3600, buckets=buckets)
    want, last = plain_presence(pairs, 12 * 3600 * 10**6)
    assert sorted(((repr(k), *r) for k, *r in presence_rows(got)), key=repr) == want
    assert sorted(((repr(k), *r) for k, *r in rows(states)), key=repr) == last
    found = jobs.activity_sessions(source(), "user_id", 3600, buckets=buckets)
    assert sorted(((repr(k), *r) for k, *r in session_rows(found)), key=repr) == plain_sessions(pairs, 3600 * 10**6)


def test_numbers_beyond_a_double_stay_apart_in_a_bucket(spark, tmp_path):
    big = 2**53
    data = [(big, "2024-01-01 00:00:00"), (big + 1, "2024-01-01 00:30:00"), (None, "2024-01-01 00:40:00")]
    spark.createDataFrame(data, "user_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(str(tmp_path / "in"))
    got = jobs.activity_sessions(spans_of(spark, read_stream(spark, str(tmp_path / "in"))), "user_id", 3600, buckets=1)
    assert sorted((r[0] or 0, r[3]) for r in session_rows(got)) == [(0, 1), (big, 1), (big + 1, 1)]


def plain_sessions(events, gap):
    out, by = [], {}
    for key, at in sorted(events):
        runs = by.setdefault(key, [])
        if runs and at - runs[-1][1] <= gap:
            runs[-1][1:] = at, runs[-1][2] + 1
        else:
            runs.append([at, at, 1])
    end = max((at for _, at in events), default=0)
    for key, runs in by.items():
        out += [(key, first, last + gap, n, last + gap >= end) for first, last, n in runs]
    return sorted(out, key=repr)


def session_rows(table):
    return sorted(map(tuple, table.select("user_id", F.unix_micros("session_start"), F.unix_micros("session_end"), "events", "open").collect()), key=repr)


def test_sessions_over_batches_with_their_open_end(spark, events, parts):
    got = jobs.activity_sessions(spans_of(spark, stream(spark, parts), width=6 * 3600), "user_id", 6 * 3600, "1 day")
    want = plain_sessions(pairs_of(events), 6 * 3600 * 10**6)
    assert session_rows(got) == want and any(r[4] for r in want)


def test_an_event_out_of_order_joins_two_sessions(spark, tmp_path):
    batches = [
        [("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 01:30:00"), ("b", "2024-01-01 01:00:00")],
        [("a", "2024-01-01 03:00:00"), ("b", "2024-01-01 01:59:00")],
        [("a", "2024-01-01 00:50:00")],  # between the first two, within the delay
        [("a", "2024-01-01 02:10:00")],  # and now to the third
    ]
    for batch in batches:
        spark.createDataFrame(batch, "user_id string, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.mode(
            "append").parquet(str(tmp_path / "in"))
    got = jobs.activity_sessions(spans_of(spark, read_stream(spark, str(tmp_path / "in"), 1)), "user_id", 3600, "1 day")
    every = [(k, int(pd.Timestamp(t).timestamp() * 10**6)) for b in batches for k, t in b]
    assert session_rows(got) == plain_sessions(every, 3600 * 10**6)
    assert [(r[0], r[3]) for r in session_rows(got)] == [("a", 5), ("b", 2)]


def test_repeats_are_dropped_across_batches(spark, events, tmp_path):
    folder = str(tmp_path / "twice")
    for _ in range(2):
        events.coalesce(1).write.mode("append").parquet(folder)
    clock = on_clock(stream(spark, folder), "ts", "60 days")
    assert rows(run_append(jobs.event_dedup(clock, ["event_id"]), "dedup"), "event_id") == rows(events, "event_id")


def test_unanswered_requests_come_once_with_nulls(spark, tmp_path):
    def stamped(values, schema, name):
        path = str(tmp_path / name)
        spark.createDataFrame(values, schema).withColumn("t", F.col("t").cast("timestamp")).coalesce(1).write.parquet(path)
        return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)

    asks = stamped([("a", "2026-01-01"), ("b", "2026-01-01"), ("z", "2026-03-01")], "id string, t string", "asks")
    replies = stamped([("a", "2026-01-05"), ("a", "2026-02-20"), ("z", "2026-03-01")], "id string, t string", "replies")
    joined = jobs.request_result_stream(
        on_clock(asks.withColumnRenamed("t", "asked"), "asked", "0 seconds"), on_clock(replies.withColumnRenamed("t", "at"), "at", "0 seconds"),
        "id", "asked", "at", "10 DAYS",
    )
    got = run_append(joined, "answers").select("id", F.col("at").cast("date").cast("string"))
    assert rows(got) == [("a", "2026-01-05"), ("b", None), ("z", "2026-03-01")]


def test_open_requests_are_added(spark, tmp_path):
    joined = spark.createDataFrame([("a", 1, 5), ("a", 1, 6), ("b", 2, None)], "id string, asked int, at int")
    asked = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), (None, 4), ("d", None)], "id string, asked int")
    got = jobs.with_open(joined, asked, "id", "asked")
    assert rows(got) == sorted([("a", 1, 5), ("a", 1, 6), ("b", 2, None), ("c", 3, None), (None, 4, None), ("d", None, None)], key=repr)


@pytest.mark.parametrize("files", [1, 100])
def test_every_request_is_given_once(spark, tmp_path, files):
    import random

    r = random.Random(11)
    day = lambda n: f"2026-01-{1 + n:02d}"
    asks = [[(f"k{r.randrange(25)}", day(b * 5 + r.randrange(5))) for _ in range(12)] for b in range(5)]
    answers = [[(f"k{r.randrange(25)}", day(min(28, b * 5 + r.randrange(7)))) for _ in range(15)] for b in range(5)]
    asks[0] += [asks[0][0], (None, day(0)), ("x", None)]
    for name, batches in (("asks", asks), ("answers", answers)):
        for batch in batches:
            spark.createDataFrame(batch, "id string, t string").withColumn("t", F.col("t").cast("timestamp")).coalesce(1).write.mode(
                "append").parquet(str(tmp_path / name))
    left, right = (read_stream(spark, str(tmp_path / n), files) for n in ("asks", "answers"))
    got = jobs.request_states(left.withColumnRenamed("t", "asked"), right.withColumnRenamed("t", "at"), "id", "asked", "at", 3 * 86400, "8 days")
    number = lambda t: int(t[-2:])
    sound = [(k, number(t)) for b in asks for k, t in b if k and t]
    every = [(k, number(t)) for b in answers for k, t in b]
    clock = min(max(t for _, t in sound), max(t for _, t in every))
    want = []
    for k, t in sound:
        met = sorted(u for j, u in every if j == k and t <= u <= t + 3)
        want.append((k, t, "answered" if met else "expired" if t + 3 < clock else "open", met[0] if met else None, len(met)))
    found = got.select("id", F.dayofmonth("asked"), "state", F.dayofmonth("first_answer"), "answers")
    assert rows(found) == sorted(want, key=repr)
    assert {"answered", "expired", "open"} == {w[2] for w in want}


LATE = [["2024-01-10", "2024-01-20"], ["2024-01-21"], ["2024-01-03", "2024-01-04", "2024-01-19", "2024-01-22"]]


@pytest.fixture()
def late_files(spark, tmp_path):
    """Three batches of one key; in the third two rows come after the watermark of the first (20 January less two days)."""
    for n, days in enumerate(LATE):
        data = [("k", f"{n}-{d}", d, 0.1) for d in days]
        spark.createDataFrame(data, "k string, id string, ts string, v double").withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.mode(
            "append").parquet(str(tmp_path / "late"))
    return on_clock(counted(read_stream(spark, str(tmp_path / "late"), 1)), "ts", "2 days")


def test_late_rows_of_windows_are_counted(late_files):
    table, ended = update_run(jobs.telemetry_windows(late_files, ["k"], "ts", "v", "1 day"), ["k", "window_start"], "late-windows")
    assert tuple(kept_and_late(table, ended, "n").first()) == (7, 5, 2)
    assert ended.late == 2


def test_late_rows_of_alarms_are_counted(late_files):
    table, ended = update_run(jobs.rate_counts(late_files, ["k"], "ts", "1 day"), ["k", "window_start"], "late-rates")
    assert jobs.rate_alarm(table, 0).count() == 5
    assert tuple(kept_and_late(table, ended, "n").first()) == (7, 5, 2)


def test_late_rows_of_dedup_are_counted(spark, late_files):
    deduped = jobs.event_dedup(late_files, ["id"])
    ended = append_run(deduped, "late-dedup")
    assert spark.read.schema(deduped.schema).parquet(ended.path).count() == 5 and (ended.read, ended.late) == (7, 2)


def test_sums_do_not_depend_on_order(spark, events):
    many = events.where("user_id < 40").withColumn("ts", F.lit("2024-01-01").cast("timestamp")).withColumn("value", F.col("value") / 7)
    sums = lambda df: rows(jobs.telemetry_windows(df, ["event_type"], "ts", "value", "1 day"), "event_type", "total")
    want = sums(many.coalesce(1))
    for order in ("event_id", "value", "user_id"):
        assert sums(many.orderBy(order).repartition(5)) == want
    huge = spark.createDataFrame([("a", 1e300), ("a", 1.0), ("b", None), ("b", 2.0)], "event_type string, value double")
    assert sums(huge.withColumn("ts", F.lit("2024-01-01").cast("timestamp"))) == [("a", 1.0), ("b", 2.0)]


def test_sources_without_rows_give_empty_tables(spark, events, tmp_path):
    empty = lambda n: (tmp_path / n).mkdir() or read_stream(spark, str(tmp_path / n), schema=events.schema)
    assert jobs.desired_changes(empty("a"), "user_id", ["ts", "event_id"], ["event_type"]).count() == 0
    wanted = spark.createDataFrame([(1, "x")], "user_id long, event_type string")
    assert jobs.drift_stream(empty("b"), wanted, "user_id", ["ts", "event_id"], ["event_type"]).count() == 0
    clock = on_clock(empty("c"), "ts", "1 day")
    assert run_update(jobs.rate_counts(clock, ["event_type"], "ts", "1 day"), ["event_type", "window_start"], "none").count() == 0
    assert run_append(jobs.event_dedup(on_clock(empty("d"), "ts", "1 day"), ["event_id"]), "none").count() == 0
    got, states = jobs.presence(spans_of(spark, empty("e")), "user_id", 3600)
    assert got.count() == 0 and states.count() == 0
    assert jobs.activity_sessions(spans_of(spark, empty("f")), "user_id", 3600).count() == 0
    asked, answered = empty("g").withColumnRenamed("ts", "asked"), empty("h").withColumnRenamed("ts", "at")
    assert jobs.request_states(asked, answered, "user_id", "asked", "at", 3600).count() == 0


def test_rate_alarm(spark, events, parts):
    counts = run_update(jobs.rate_counts(on_clock(stream(spark, parts), "ts", "1 day"), ["event_type"], "ts", "1 day"), ["event_type", "window_start"], "r")
    daily = events.groupBy("event_type", F.date_trunc("day", "ts").alias("d")).count().where("count > 8")
    assert rows(jobs.rate_alarm(counts, 8), "event_type", "n") == rows(daily, "event_type", "count")


def test_single_file_stream(spark, events):
    assert run_append(read_stream(spark, EVENTS).select("event_id"), "copy").count() == events.count()


def test_worker_errors_are_results(spark, events):
    def summing(frames, params):
        total = 0.0
        for frame in frames:
            if (frame["value"] > params["limit"]).any():
                raise ValueError("over limit")
            total += float(frame["value"].sum())
            yield pd.DataFrame({"part": [len(frame)], "total": [round(total, 2)]})

    limit = 150.0
    out = worker_map(events, ["user_id"], ["ts"], summing, {"limit": limit}, "part bigint, total double", day_bucket("ts")).persist()
    groups = events.groupBy("user_id", day_bucket("ts").alias("bucket")).agg(F.max("value").alias("top"), F.count("*").alias("n"))
    assert out.where("message IS NOT NULL").count() == groups.count()
    failed = out.where("message = 'ERROR: over limit'")
    assert rows(failed, "user_id", "bucket") == rows(groups.where(F.col("top") > limit), "user_id", "bucket")
    assert out.agg(F.sum("part")).first()[0] == groups.where(F.col("top") <= limit).agg(F.sum("n")).first()[0]
    outcome = worker_outcomes(out, ["user_id"]).agg(F.sum("completed"), F.sum("failed")).first()
    assert tuple(outcome) == (groups.where(F.col("top") <= limit).count(), groups.where(F.col("top") > limit).count())
    assert out.where(is_blank("message") & F.col("part").isNull()).count() == 0


@pytest.mark.parametrize("carry", [False, True])
def test_calls_are_bounded_by_rows(spark, carry):
    n = 3000
    at = F.when(F.col("id") < 2500, 7).otherwise(F.col("id")).cast("long")  # most readings at one instant
    df = spark.range(n).select(F.when(F.col("id") % 10 < 8, "burst").otherwise(F.concat(F.lit("k"), F.col("id") % 3)).alias("key"), at.alias("at"), "id")

    def work(frames, params, state=None):
        for frame in frames:
            yield pd.DataFrame({"id": frame["id"], "before": (state or {}).get("n", 0)})
            if state is not None:
                state["n"] = state.get("n", 0) + len(frame)

    out = worker_slices(df, ["key"], ["at", "id"], work, {}, "id bigint, before bigint", 100, carry).persist()
    assert rows(out.where("message is null"), "key", "id") == rows(df, "key", "id")
    calls = out.where("message is null").groupBy("key", "slice", "call").agg(
        F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high"), F.max("before").alias("before"))
    assert calls.agg(F.max("n")).first()[0] <= 100
    mine = calls.where("key = 'burst'").orderBy("slice", "call").collect()
    assert len(mine) >= 24 and all(a.high < b.low for a, b in zip(mine, mine[1:]))
    if carry:
        assert {r.slice for r in mine} == {0} and [r.before for r in mine] == [100 * i for i in range(24)]
    else:
        assert len({r.slice for r in mine}) > 10
    assert out.where("message like 'Completed%'").count() == calls.count()
