"""The streaming forms of the fleet jobs. Each takes a stream and gives a stream, or runs it batch by batch."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import TimerValues

from fleetlens.functions.keyed import SPLIT_ROWS, hot_keys, join_same, one_row_per, with_previous
from fleetlens.functions.values import changed_columns
from fleetlens.session import stage
from fleetlens.streaming.sinks import ROCKS, Ended, append_run, made, read_batches, run_append, run_batches, state_store, state_table, write_batch

#: What a bucket of keys holds of its runs.
_HELD = "key array<string>, first array<bigint>, last array<bigint>, n array<bigint>"
_HELD_STRUCT = ", ".join(f.replace(" ", ": ") for f in _HELD.split(", "))
#: A key as JSON and back keeps the microseconds of an instant.
_KEY_FORMAT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def desired_changes(
    stream: DataFrame, key: str, order: Sequence[str], watched: Sequence[str], split: int = SPLIT_ROWS, name: str = "changes",
) -> DataFrame:
    """Events whose watched fields differ from the key's event before; the first event of a key counts.

    Inside a micro-batch events are compared with `with_previous`, so a key owning most of a batch is cut over tasks.
    Of every batch and key the first and last fingerprint are left, one row. A second stream follows these with the
    engine's keyed state, which holds the last fingerprint, and tells whether the first event of a batch is a change.
    Rows without a key are one key.
    """
    spark = stream.sparkSession
    order = list(order)
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("\x1e")) for c in watched]
    mark = F.sha2(F.concat_ws("\x1f", *fields), 256)
    key_type = stream.schema[key].dataType.simpleString()
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields)
    kept = f"{columns}, mark string, opens boolean"

    def work(rows: DataFrame, batch: int, path: str) -> None:
        marked = rows.withColumn("mark", mark)
        seen = with_previous(marked, [key], order, {"_was": "mark"}, hot_keys(marked, [key], order, split))
        changed = seen.where(F.col("_was").isNull() | (F.col("_was") != F.col("mark")))
        write_batch(changed.withColumn("opens", F.col("_was").isNull()).drop("_was"), batch, f"{path}/rows")
        # the last change of a batch carries its last fingerprint
        back = rows.sparkSession.read.schema(kept).parquet(f"{path}/rows/batch={batch}")
        at = F.struct(*order)
        write_batch(back.groupBy(key).agg(F.min_by("mark", at).alias("first"), F.max_by("mark", at).alias("last")), batch, f"{path}/ends")

    def follow(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ends = sorted((int(b), f, t) for frame in frames for b, f, t in zip(frame["batch"], frame["first"], frame["last"]))
        last, out = state.get[0] if state.exists else None, []
        for batch, first, to in ends:
            out.append((name[0], batch, first != last))
            last = to
        state.update((last,))
        yield pd.DataFrame(out, columns=[key, "batch", "changes"])

    path = run_batches(stream, name, work)
    ends = spark.readStream.schema(f"`{key}` {key_type}, first string, last string, batch int").parquet(made(spark, f"{path}/ends"))
    verdicts = run_append(ends.groupBy(key).applyInPandasWithState(
        follow, f"`{key}` {key_type}, batch int, changes boolean", "last string", "append", GroupStateTimeout.NoTimeout), f"{name}-ends")
    rows = read_batches(spark, f"{path}/rows", kept)
    opening = join_same(rows.where("opens"), verdicts.where("changes").select(key, "batch"), [key, "batch"], "left_semi")
    return rows.where("not opens").unionByName(opening).select(*stream.columns)


def drift_stream(
    observed: DataFrame, desired: DataFrame, key: str, order: Sequence[str], compare: Sequence[str], name: str = "drift"
) -> DataFrame:
    """Reconcile every micro-batch of observations with the desired table and append the plan.

    A batch's newest observation of each resource gives update, noop, or delete where nobody wants it. Resources
    that were never observed are not in any batch; `never_observed` lists them.
    """
    spark = observed.sparkSession
    compare = list(compare)
    want = desired.select(key, *[F.col(c).alias(f"_want_{c}") for c in compare], F.lit(True).alias("_wanted"))

    def work(rows: DataFrame, batch: int, path: str) -> None:
        newest = one_row_per(rows, [key], list(order)).select(key, *compare)
        changed = changed_columns(
            {c: F.col(f"_want_{c}") for c in compare}, {c: F.col(c) for c in compare}
        )
        both = newest.join(want, key, "left").withColumn("_changed", changed)
        action = (
            F.when(F.col("_wanted").isNull(), "delete").when(F.size("_changed") > 0, "update").otherwise("noop")
        )
        plan = both.withColumn("action", action).select(
            key, "action", F.when(F.col("action") == "update", F.array_join("_changed", ",")).otherwise("").alias("changed")
        )
        write_batch(plan, batch, path)

    path = run_batches(observed, name, work)
    return read_batches(spark, path, f"`{key}` {desired.schema[key].dataType.simpleString()}, action string, changed string")


def never_observed(plan: DataFrame, desired: DataFrame, key: str) -> DataFrame:
    """Desired resources that no batch of the plan has seen: they are to be created."""
    return desired.select(key).join(plan.select(key).distinct(), key, "left_anti").withColumn("action", F.lit("create"))


def activity_spans(stream: DataFrame, key: str, ts: str, width_s: int, name: str = "spans") -> DataFrame:
    """(key, first, last, n) of every batch, key and slot of `width_s` seconds, as a stream of its own.

    This is the compacted form of an activity stream: partial sums, so a very busy board costs one row per slot, and no
    state, so every row is in it, however late.
    """
    fields = f"`{key}` {stream.schema[key].dataType.simpleString()}, first timestamp, last timestamp, n bigint"

    def work(rows: DataFrame, batch: int, path: str) -> None:
        spans = rows.where(F.col(ts).isNotNull()).groupBy(key, F.window(F.col(ts).cast("timestamp"), f"{width_s} seconds").alias("_w")).agg(
            F.min(ts).cast("timestamp").alias("first"), F.max(ts).cast("timestamp").alias("last"), F.count(F.lit(1)).alias("n"))
        write_batch(spans.drop("_w"), batch, path)

    path = run_batches(stream, name, work)
    return stream.sparkSession.readStream.schema(f"{fields}, batch int").option("maxFilesPerTrigger", 10_000).parquet(path).drop("batch")


def _bucketed(spans: DataFrame, key: str, delay: str, buckets: int) -> DataFrame:
    """Spans on the clock of their ends, by buckets of keys; a key travels as JSON, which also names the null key."""
    marked = spans.withWatermark("last", delay)
    return marked.select(
        _bucket(key, buckets), _key_text(key), F.unix_micros("first").alias("first"), "last", F.unix_micros("last").alias("to"), "n")


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket")


def _key_text(key: str) -> Column:
    return F.to_json(F.struct(F.col(key).alias("key")), _KEY_FORMAT).alias("key")


def _key_back(kind: str, key: str) -> Column:
    return F.from_json("key", f"key {kind}", _KEY_FORMAT)["key"].alias(key)


def _state_buckets(spark: SparkSession, buckets: int | None) -> int:
    """Eight for each partition of a shuffle, unless told."""
    return buckets or 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def _in_order(frames: list[pd.DataFrame]) -> pd.DataFrame:
    """Runs (key, first, last, n) by key and begin: `opens` at a key's first one, `upto` the latest end before a run in its key."""
    rows = pd.concat(frames, ignore_index=True)
    rows["code"] = rows["key"].factorize()[0]
    # held runs are in front, and stay in front of others of their key if they are marked so
    rows = rows.sort_values(["code", "place", "first"], kind="stable", ignore_index=True) if "place" in rows else rows.sort_values(
        ["code", "first"], kind="stable", ignore_index=True)
    rows["end"] = rows.groupby("code")["last"].cummax()
    code = rows["code"].to_numpy()
    rows["opens"] = np.append(True, code[1:] != code[:-1])[:len(code)]
    rows["upto"] = np.append(0, rows["end"].to_numpy()[:-1])[:len(code)]
    return rows


class _Buckets(StatefulProcessor):
    """State of a bucket of keys as one value of lists, with one timer for the next key that ends."""

    def __init__(self, gap: int) -> None:
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("held", _HELD)

    def _held(self) -> pd.DataFrame:
        held = self.state.get() if self.state.exists() else [[]] * 4
        return pd.DataFrame({"key": pd.Series(list(held[0]), dtype="object"), **{
            c: np.array(held[i], "i8") for i, c in enumerate(("first", "last", "n"), 1)}})

    def _keep(self, runs: pd.DataFrame) -> None:
        if len(runs):
            self.state.update(tuple(runs[c].tolist() for c in ("key", "first", "last", "n")))
            self.handle.registerTimer((int(runs["last"].min()) + self.gap) // 1000 + 1)
        else:
            self.state.clear()

    def _expired(self, timerValues: TimerValues) -> pd.DataFrame:
        """Held runs that the watermark has passed; the others stay."""
        runs = self._held()
        over = (runs["last"] + self.gap) // 1000 + 1 <= timerValues.getCurrentWatermarkInMs()
        self._keep(runs[~over])
        return runs[over]

    def _new(self, rows: Iterator[pd.DataFrame]) -> list[pd.DataFrame]:
        return [frame[["key", "first", "to", "n"]].rename(columns={"to": "last"}) for frame in rows]

    def close(self) -> None:
        pass


def _held_runs(spark: SparkSession, ended: Ended) -> DataFrame:
    """(key, first, last, n) of all runs that a stream's buckets hold at the end of its input."""
    held = state_table(spark, ended, f"key struct<bucket: int>, value struct<{_HELD_STRUCT}>", "held")
    return held.select(F.inline(F.arrays_zip(*[F.col(f"value.{c}").alias(c) for c in ("key", "first", "last", "n")])))


class _Presence(_Buckets):
    """The open periods of a bucket's boards; a board that has been silent for too long goes offline."""

    def _out(self, keys: pd.Series, state: str, at: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"key": keys.to_numpy(), "state": state, "at_us": at.to_numpy()})

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: TimerValues) -> None:
        held = initialState.rename(columns={"since": "first"}).assign(n=1)
        old = self._held()  # a bucket's rows may come in several frames
        self._keep(pd.concat([old, held[["key", "first", "last", "n"]]], ignore_index=True))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        # a run from before the period's start has been told of already or comes late: it moves nothing but the end
        runs = _in_order([self._held().assign(place=0), *(frame.assign(place=1) for frame in self._new(rows))])
        after = ~runs["opens"] & (runs["first"] - runs["upto"] > self.gap)
        online = runs[after | (runs["opens"] & (runs["place"] == 1))]
        offline = runs[after]
        starts = runs[after | runs["opens"]].drop_duplicates("code", keep="last")
        ends = runs.drop_duplicates("code", keep="last")
        self._keep(pd.DataFrame({"key": starts["key"].to_numpy(), "first": starts["first"].to_numpy(), "last": ends["end"].to_numpy(), "n": 1}))
        out = pd.concat([self._out(offline["key"], "offline", offline["upto"] + self.gap), self._out(online["key"], "online", online["first"])])
        if len(out):
            yield out

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        over = self._expired(timerValues)
        if len(over):
            yield self._out(over["key"], "offline", over["last"] + self.gap)


def presence(
    spans: DataFrame, key: str, timeout_s: int, delay: str = "0 seconds", last_states: DataFrame | None = None, name: str = "presence",
    buckets: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """What became of every board, and the boards' last states.

    The first table is (key, state, at, open): online when a board is first heard, offline once it has been silent for
    longer than the timeout. At the end of the input a board's silence is counted up to the last instant that any board
    was heard; the online row of a period that still lasts is marked `open`, and given again if it began in an earlier run.
    The second is (key, since, last) in microseconds, one row per open period: as `last_states` it starts a next run.

    Works on `activity_spans` no wider than the timeout. Spans that come later than `delay` are dropped and counted by
    the engine like any late row; a late span inside a period moves nothing but its end. State is kept by buckets of keys
    (eight for each partition of a shuffle, unless told), so that a board costs no call and no timer of its own.
    """
    spark, silence = spans.sparkSession, timeout_s * 1_000_000
    kind = spans.schema[key].dataType.simpleString()
    buckets = _state_buckets(spark, buckets)
    start = None if last_states is None else stage(
        last_states.select(_bucket(key, buckets), _key_text(key), "since", "last"), f"{name}-start").groupBy("bucket")
    followed = _bucketed(spans, key, delay, buckets).groupBy("bucket").transformWithStateInPandas(
        _Presence(silence), "key string, state string, at_us bigint", "Append", "EventTime", start)
    with state_store(spark, ROCKS):
        ended = append_run(followed, name)
    told = spark.read.schema(followed.schema).parquet(ended.path).select(_key_back(kind, key), "state", "at_us")
    held = _held_runs(spark, ended).select(_key_back(kind, key), F.col("first").alias("since"), "last")
    # the last instant is that of a board's last run: of an open period, or before an offline row
    held = stage(held, "presence-open")
    heard = held.select("last").union(told.where("state = 'offline'").select(F.col("at_us") - silence)).agg(F.max("last")).scalar()
    over = held.where(F.col("last") + silence < heard)
    lasting = held.where(F.col("last") + silence >= heard)
    offline = over.select(key, F.lit("offline").alias("state"), (F.col("last") + silence).alias("at_us"))
    online = lasting.select(key, F.lit("online").alias("state"), F.col("since").alias("at_us"))
    closed = join_same(told, online, [key, "state", "at_us"], "left_anti").unionByName(offline)
    rows = closed.withColumn("open", F.lit(False)).unionByName(online.withColumn("open", F.lit(True)))
    return rows.select(key, "state", F.timestamp_micros("at_us").alias("at"), "open"), lasting


def telemetry_windows(
    stream: DataFrame, by: Sequence[str], ts: str, value: str, width: str, slide: str | None = None, places: int = 6,
) -> DataFrame:
    """Count, min, max and sum per group and window; tumbling, or sliding with a slide.

    The sum is of values rounded to so many decimal places and exact in these, so it does not depend on the order in
    which rows, tasks or batches are added up; NULL beyond 32 digits.
    """
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    return stream.groupBy(*by, window.alias("_w")).agg(
        F.count(value).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"),
        F.try_sum(F.col(value).try_cast(f"decimal({38 - places},{places})")).alias("total"),
    ).select(
        *by, F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), "n", "low", "high",
        F.col("total").cast("double").alias("total"))


class _Sessions(_Buckets):
    """The sessions of a bucket's boards that the watermark has not passed."""

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        runs = _in_order([self._held(), *self._new(rows)])
        session = (runs["opens"] | (runs["first"] - runs["upto"] > self.gap)).cumsum()
        self._keep(runs.groupby(session).agg({"key": "first", "first": "first", "last": "max", "n": "sum"}))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        over = self._expired(timerValues)
        if len(over):
            yield over


def activity_sessions(
    spans: DataFrame, key: str, gap_s: int, delay: str = "0 seconds", name: str = "sessions", buckets: int | None = None,
) -> DataFrame:
    """(key, session_start, session_end, events, open): runs of events no further apart than the gap.

    Sessions that the watermark has passed come from the stream, the others from its state at the end of the input;
    those that an event after the last one could still join are marked `open`. An event between two sessions makes them
    one. Works on `activity_spans` no wider than the gap. State is kept by buckets of keys, as for `presence`.
    """
    spark, gap = spans.sparkSession, gap_s * 1_000_000
    kind = spans.schema[key].dataType.simpleString()
    followed = _bucketed(spans, key, delay, _state_buckets(spark, buckets)).groupBy("bucket").transformWithStateInPandas(
        _Sessions(gap), "key string, first bigint, last bigint, n bigint", "Append", "EventTime")
    with state_store(spark, ROCKS):
        ended = append_run(followed, name)
    closed, held = spark.read.schema(followed.schema).parquet(ended.path), _held_runs(spark, ended)
    closed, held = (rows.select(_key_back(kind, key), "first", "last", "n") for rows in (closed, held))
    every = stage(closed.unionByName(held), "sessions-all")
    return every.select(
        key, F.timestamp_micros("first").alias("session_start"), F.timestamp_micros(F.col("last") + gap).alias("session_end"),
        F.col("n").alias("events"), (F.col("last") + gap >= every.agg(F.max("last")).scalar()).alias("open"))


def event_dedup(stream: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Drop repeats of an event that arrive within the lateness bound of the stream's watermark."""
    return stream.dropDuplicatesWithinWatermark(list(keys))


def request_result_stream(
    requests: DataFrame, results: DataFrame, key: str, asked: str, answered: str, bound: str
) -> DataFrame:
    """Requests with the results that arrive within the bound; a request without one comes once, with NULLs.

    Both streams need watermarks. Unanswered requests come out when no result can reach them any more; `with_open` adds
    those that the end of the input leaves waiting.
    """
    right = results.withColumnRenamed(key, "_result_key")
    near = (
        (F.col(key) == F.col("_result_key"))
        & (F.col(answered) >= F.col(asked))
        & (F.col(answered) <= F.col(asked) + F.expr(f"INTERVAL {bound}"))
    )
    return requests.join(right, near, "leftOuter").drop("_result_key")


def with_open(joined: DataFrame, requests: DataFrame, key: str, asked: str) -> DataFrame:
    """The output table of `request_result_stream`, and each request that is not in it, with NULLs.

    A request without key or time meets no result and no watermark, so it is one of these.
    """
    waiting = join_same(requests, joined.select(key, asked), [key, asked], "left_anti")
    return joined.unionByName(waiting, allowMissingColumns=True).select(*joined.columns)


def _answers_met(keys: np.ndarray, asks: np.ndarray, us: np.ndarray, n: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """Of every request among rows of (key number, side, instant, copies): its first answer's instant, and its answers."""
    answers = np.flatnonzero(~asks)
    answers = answers[np.lexsort((us[answers], keys[answers]))]
    instants = np.unique(us[answers])
    # one number orders rows by key and instant
    width = len(instants) + 1
    places = keys[answers] * width + np.searchsorted(instants, us[answers])
    since = np.searchsorted(places, keys[asks] * width + np.searchsorted(instants, us[asks]))
    until = np.searchsorted(places, keys[asks] * width + np.searchsorted(instants, us[asks] + bound, "right"))
    total = np.concatenate((np.zeros(1, "i8"), np.cumsum(n[answers])))
    some = until > since
    first = np.full(len(since), -1, "i8")
    first[some] = us[answers][since[some]]
    return first, total[until] - total[since]


def request_states(
    requests: DataFrame, results: DataFrame, key: str, asked: str, answered: str, bound_s: int, delay: str = "0 seconds",
    name: str = "request-states", buckets: int | None = None,
) -> DataFrame:
    """(key, asked, state, first_answer, answers): each request once, as answered, expired or open.

    A request is answered by results of its key from its own instant up to the bound after it; results may be read
    before their request. Once the watermark has passed the bound the stream gives the request; those it leaves come
    from its state at the end of the input, where the clock is the earlier of the last request and the last result: a
    request without an answer is open until that clock has passed its bound. Results without a request are forgotten
    when none can come any more. Rows without key or time are left out.

    Both sides are counted per key and instant in every batch before they meet, so copies of a request or result are one
    entry with a count; of equal requests each is given. State is kept by buckets of keys (eight for each partition of a
    shuffle, unless told), each with the open requests and early results of its keys, so that short-lived keys cost no
    call each.
    """
    spark, bound = requests.sparkSession, bound_s * 1_000_000
    kind = requests.schema[key].dataType.simpleString()
    buckets = _state_buckets(spark, buckets)
    sides = []
    for side, stream, ts in (("ask", requests, asked), ("answer", results, answered)):
        def work(rows: DataFrame, batch: int, path: str, ts: str = ts) -> None:
            sound = rows.where(F.col(key).isNotNull() & F.col(ts).isNotNull())
            write_batch(sound.groupBy(key, F.col(ts).cast("timestamp").alias("at")).agg(F.count(F.lit(1)).alias("n")), batch, path)

        path = run_batches(stream, f"{name}-{side}", work)
        sides.append((side, path, spark.readStream.schema(f"`{key}` {kind}, at timestamp, n bigint, batch int").parquet(path)))
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket")
    marked = [
        rows.withWatermark("at", delay).select(bucket, F.col(key).alias("key"), F.lit(side == "ask").alias("asks"), "at", F.unix_micros("at").alias("us"), "n")
        for side, _, rows in sides]
    names = ["key", "asks", "us", "n"]

    def given(rows: pd.DataFrame, first: np.ndarray, answers: np.ndarray, which: np.ndarray, waiting: np.ndarray) -> pd.DataFrame:
        """The requests `which`, each as often as it was made; `waiting` are those that are still open without an answer."""
        state = np.where(answers > 0, "answered", np.where(waiting, "open", "expired"))
        out = pd.DataFrame({
            "key": rows["key"], "asked_us": rows["us"], "state": state, "first_us": pd.array(np.maximum(first, 0), "Int64"), "answers": answers})
        out.loc[answers == 0, "first_us"] = pd.NA
        return out.loc[np.repeat(np.flatnonzero(which), rows["n"].to_numpy("i8")[which])]

    def follow(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        parts = [frame[names] for frame in frames]
        if state.exists:
            parts.append(pd.DataFrame(dict(zip(names, state.get))))
        rows = pd.concat(parts, ignore_index=True).groupby(["key", "asks", "us"], as_index=False)["n"].sum()
        codes, asks, us, n = rows["key"].factorize()[0], rows["asks"].to_numpy(bool), rows["us"].to_numpy("i8"), rows["n"].to_numpy("i8")
        passed = state.getCurrentWatermarkMs() * 1000
        over = us[asks] + bound < passed
        if over.any():
            first, answers = _answers_met(codes, asks, us, n, bound)
            yield given(rows[asks].reset_index(drop=True), first, answers, over, np.zeros(len(over), bool))
        # an answer is kept while a request of its key waits that it may meet, or one may still come
        least = np.full(codes.max(initial=-1) + 1, passed)
        pending = np.zeros(len(rows), bool)
        pending[np.flatnonzero(asks)[~over]] = True
        np.minimum.at(least, codes[pending], us[pending])
        left = rows[pending | (~asks & (us >= least[codes]))]
        if len(left):
            state.update(tuple(left[c].tolist() for c in names))
            until = int(us[pending].min()) + bound if pending.any() else int(left["us"].max())
            state.setTimeoutTimestamp(max(until // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()

    held_type = f"`key` array<{kind}>, asks array<boolean>, us array<bigint>, n array<bigint>"
    out_type = f"`key` {kind}, asked_us bigint, state string, first_us bigint, answers bigint"
    followed = marked[0].union(marked[1]).groupBy("bucket").applyInPandasWithState(
        follow, out_type, held_type, "append", GroupStateTimeout.EventTimeTimeout)
    ended = append_run(followed, name)
    told = spark.read.schema(followed.schema).parquet(ended.path)
    held = state_table(spark, ended, f"key struct<bucket: int>, value struct<groupState: struct<{held_type}>>")
    ends = [spark.read.schema("at timestamp").parquet(path).agg(F.max(F.unix_micros("at"))).first()[0] for _, path, _ in sides]
    clock = min(ends) if None not in ends else None  # without any result it has not moved

    def waiting(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for one in batch.itertuples(index=False):
                rows = pd.DataFrame({c: list(getattr(one, c)) for c in names})
                asks, us = rows["asks"].to_numpy(bool), rows["us"].to_numpy("i8")
                if asks.any():
                    first, answers = _answers_met(rows["key"].factorize()[0], asks, us, rows["n"].to_numpy("i8"), bound)
                    still = np.full(len(first), True) if clock is None else us[asks] + bound >= clock
                    yield given(rows[asks].reset_index(drop=True), first, answers, np.ones(len(first), bool), still)

    inner = "value.groupState" if "groupState" in held.schema["value"].dataType.names else "value"
    open_ = held.select(*[F.col(f"{inner}.{c}").alias(c) for c in names]).mapInPandas(waiting, out_type)
    return told.unionByName(open_).select(
        F.col("key").alias(key), F.timestamp_micros("asked_us").alias(asked), "state", F.timestamp_micros("first_us").alias("first_answer"), "answers")


def rate_counts(stream: DataFrame, by: Sequence[str], ts: str, width: str) -> DataFrame:
    """Events per group and window."""
    return stream.groupBy(*by, F.window(ts, width).alias("_w")).agg(F.count(F.lit(1)).alias("n")).select(
        *by, F.col("_w.start").alias("window_start"), "n"
    )


def rate_alarm(counts: DataFrame, allowed: int) -> DataFrame:
    """Windows with more events than allowed."""
    return counts.where(F.col("n") > allowed)

