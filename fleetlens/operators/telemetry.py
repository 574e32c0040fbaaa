"""Readings: extraction, rollups, ranges, gaps, directions and plugin runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.keyed import SPLIT_ROWS, hot_keys, with_previous, with_running_counts
from fleetlens.functions.values import parsed_rows
from fleetlens.sources.schemas import TELEMETRY

# The range each metric is declared to stay in, and the shape of a reading's log line.
BOUNDS = {
    "temperature": (16.0, 23.0),
    "humidity": (65.0, 90.0),
    "pressure": (1003.0, 1023.0),
    "wind_speed": (0.0, 10.0),
    "wind_direction": (0.0, 360.0),
}
READING = "#([0-9]+): (\\{.*\\})"


def telemetry_extract(lines: DataFrame, keep: Sequence[str] = ("run_id", "line_no"), col: str = "line") -> DataFrame:
    """Typed readings with their sequence number out of log lines; broken JSON gives NULL fields."""
    reading = F.when(F.col(col).rlike(READING), F.struct(
        F.regexp_extract(col, READING, 1).try_cast("bigint").alias("seq"),
        F.from_json(F.regexp_extract(col, READING, 2), TELEMETRY).alias("_r"),
    ))
    return parsed_rows(lines, list(keep), reading).select(*keep, "seq", "_r.*")


def sensor_rollup(t: DataFrame, by: Sequence[str], metrics: Sequence[str], ts: str, width: str) -> DataFrame:
    """Count, min, max and mean per group, time bucket and metric.

    All metrics are aggregated in one pass and only the results are turned into rows. Means are doubles at full
    scale; their last digits may depend on the order in which partitions arrive, so round them to compare runs.
    """
    aggs = [
        F.struct(
            F.lit(m).alias("metric"), F.count(m).alias("n"), F.min(m).alias("low"), F.max(m).alias("high"),
            F.avg(F.col(m).cast("double")).alias("mean"),
        )
        for m in metrics
    ]
    wide = t.groupBy(*by, F.window(ts, width).alias("_w")).agg(F.array(*aggs).alias("_m"))
    return wide.select(*by, F.col("_w.start").alias("bucket"), F.explode("_m").alias("_m")).select(
        *by, "bucket", "_m.*"
    )


def range_check(t: DataFrame, keep: Sequence[str], bounds: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """(keep, metric, value, low, high) for every reading outside its bounds."""
    bounds = BOUNDS if bounds is None else bounds
    outside = [
        F.when((F.col(m) < low) | (F.col(m) > high), F.struct(
            F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"),
            F.lit(float(low)).alias("low"), F.lit(float(high)).alias("high"),
        ))
        for m, (low, high) in bounds.items()
    ]
    return t.select(*keep, F.explode(F.array_compact(F.array(*outside))).alias("_o")).select(*keep, "_o.*")


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def gap_report(
    t: DataFrame, keys: Sequence[str], ts: str, tie: str, interval_s: int, k: float, split: int = SPLIT_ROWS
) -> DataFrame:
    """(keys, gap_from, gap_to, gap_seconds) where a key was silent for more than k intervals."""
    seen = with_previous(t.select(*keys, ts, tie), keys, [ts, tie], {"gap_from": ts}, hot_keys(t, keys, [ts, tie], split))
    gap = _micros(ts) - _micros("gap_from")
    return seen.where(gap > F.lit(int(k * interval_s * 1_000_000))).select(
        *keys, "gap_from", F.col(ts).alias("gap_to"), F.floor(gap / 1_000_000).alias("gap_seconds")
    )


def gap_counts(t: DataFrame, keys: Sequence[str], ts: str, interval_s: int) -> DataFrame:
    """Readings expected at the interval between a key's first and last reading, and readings received."""
    span = F.max(_micros(ts)) - F.min(_micros(ts))
    return t.groupBy(*keys).agg(
        (F.floor(span / (interval_s * 1_000_000)) + 1).alias("expected"), F.count(F.lit(1)).alias("received")
    )


def circular_mean(t: DataFrame, by: Sequence[str], degrees: Column) -> DataFrame:
    """Mean direction in degrees, 0 to 360, and how strongly the directions agree (0 to 1).

    Sine and cosine are summed as decimals, so the result does not depend on partition order.
    """
    rad = F.radians(degrees)
    sin, cos = [F.sum(f(rad).cast("decimal(20,12)")).cast("double") for f in (F.sin, F.cos)]
    n = F.count(degrees)
    sums = t.groupBy(*by).agg(sin.alias("_s"), cos.alias("_c"), n.alias("n"))
    angle = F.degrees(F.atan2("_s", "_c"))
    return sums.select(
        *by, "n",
        F.pmod(angle + F.lit(360.0), F.lit(360.0)).alias("direction"),
        (F.sqrt(F.col("_s") * F.col("_s") + F.col("_c") * F.col("_c")) / F.col("n")).alias("agreement"),
    )


def plugin_runs(
    t: DataFrame, keys: Sequence[str], order: Sequence[str], starts: Column, stops: Column,
    reported: str | None = None, split: int = SPLIT_ROWS,
) -> DataFrame:
    """One row per start: run number, first and last order value, readings up to the first stop, and a state.

    A run that meets another start (or the end) before a stop is unfinished. `reported` names a column whose
    value on the stop row is the total the plugin claims, to compare with the readings seen.
    """
    keys, order = list(keys), list(order)
    claim = F.col(reported) if reported else F.lit(None).cast("bigint")
    marked = t.select(*keys, *order, starts.alias("_start"), stops.alias("_stop"), claim.alias("_claim"))
    numbered = with_running_counts(
        marked, keys, order, {"run_no": F.col("_start"), "_part": F.col("_start") | F.col("_stop")}, hot_keys(t, keys, order, split)
    ).where(F.col("run_no") > 0)
    # A part runs from one start or stop to the next; the first part of a run is the one its start opened.
    parts = numbered.groupBy(*keys, "run_no", "_part").agg(
        F.min(F.when(F.col("_start"), F.struct(*order))).alias("_from"),
        F.min(F.when(F.col("_stop"), F.struct(*order))).alias("_to"),
        F.max(F.when(F.col("_stop"), F.col("_claim"))).alias("_claim"),
        F.count_if(~F.col("_start") & ~F.col("_stop")).alias("_readings"),
    )
    first_stop = F.min_by("_claim", F.when(F.col("_to").isNotNull(), F.col("_part")))
    runs = parts.groupBy(*keys, "run_no").agg(
        F.min("_from").alias("_from"), F.min("_to").alias("_to"),
        F.min_by("_readings", "_part").alias("readings"), first_stop.alias("reported"),
    )
    lead = order[0]
    return runs.select(
        *keys, "run_no", F.col(f"_from.{lead}").alias("started"), F.col(f"_to.{lead}").alias("stopped"), "readings",
        "reported", F.when(F.col("_to").isNull(), "unfinished").otherwise("finished").alias("state"),
    )

