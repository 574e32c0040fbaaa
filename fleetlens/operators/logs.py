"""Jobs over log lines (run_id, line_no, line) and over text that names images or addresses."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.keyed import SPLIT_ROWS, hot_keys, with_running_counts
from fleetlens.functions.names import age_seconds, reference_repo, reference_tag, url_host, url_scheme
from fleetlens.functions.values import parsed_rows
from fleetlens.operators.ranking import first_per_key
from fleetlens.session import stage

# The texts the run logs use.
ANSI = "\\x1b\\[[0-9;]*m"
LEVEL = "^\\s*\\[(INFO|OK|WARN|ERR|ERROR)\\]"
STEP_START = "^\\s*\\[INFO\\] === (.+) ===\\s*$"
STEP_DONE = "^\\s*\\[OK\\] (.+) completato\\s*$"
SUITE_DONE = "^\\s*\\[OK\\] Suite .* completata\\s*$"
BOARDS_TOTAL = "Board totali: ([0-9]+)"
BOARDS_ONLINE = "Board online: ([0-9]+)"
SETTINGS_COMPILED = "compilati: ([0-9]+)"
POLL = "\\[([0-9]+)/([0-9]+)\\] Ready: ([A-Za-z]+), Synced: ([A-Za-z]+)"
AGE = "\\s{2,}((?:[0-9]+[dhms])+)(?:\\s{2,}|\\s*$)"
DEFAULT_ENDPOINT = "http://keystone.default.svc.cluster.local:5000/v3"
IMAGE_LINE = "image:\\s*(\\S+)"
FROM_LINE = "(?m)^FROM\\s+(\\S+)"


def plain(line: Column) -> Column:
    """The line without terminal colours."""
    return F.regexp_replace(line, ANSI, "")


def _clean(lines: DataFrame) -> DataFrame:
    return lines.withColumn("line", plain(F.col("line")))


def classify_lines(lines: DataFrame) -> DataFrame:
    """Strip colours and tag each line with its level; lines without a tag are 'plain'."""
    return _clean(lines).withColumn("level", _level(F.col("line")))


def _level(line: Column) -> Column:
    tag = F.regexp_extract(line, LEVEL, 1)
    return F.coalesce(F.nullif(tag, F.lit("")), F.when(line.rlike("^\\s*ERROR\\b"), "ERROR"), F.lit("plain"))


def step_outcomes(
    lines: DataFrame, start: str = STEP_START, done: str = STEP_DONE, split: int = SPLIT_ROWS
) -> DataFrame:
    """(run_id, title, occurrence, start_line, end_line, finished) for every started step.

    A start is paired with the first end of the same title before the next start of that title. The few marking
    lines are written out first, so the logs themselves are read and searched once.
    """
    def mark(pattern: str, is_open: bool) -> Column:
        return F.when(F.col("line").rlike(pattern), F.struct(
            F.lit(is_open).alias("_is_open"), F.regexp_extract("line", pattern, 1).alias("title")
        ))

    marks = parsed_rows(_clean(lines), ["run_id", "line_no"], F.coalesce(mark(start, True), mark(done, False)))
    marks = stage(marks, "marks")
    numbered = with_running_counts(
        marks, ["run_id", "title"], ["line_no"], {"occurrence": F.col("_is_open")}, hot_keys(marks, ["run_id", "title"], ["line_no"], split)
    )
    return numbered.where(F.col("occurrence") > 0).groupBy("run_id", "title", "occurrence").agg(
        F.min(F.when(F.col("_is_open"), F.col("line_no"))).alias("start_line"),
        F.min(F.when(~F.col("_is_open"), F.col("line_no"))).alias("end_line"),
    ).withColumn("finished", F.col("end_line").isNotNull())


def run_summary(lines: DataFrame) -> DataFrame:
    """Per run: steps started and finished, boards total and online, settings compiled, suite completed, and of the rows
    of resource listings, which carry an age, how many and the oldest in seconds."""
    def reported(pattern: str) -> Column:
        return F.nullif(F.regexp_extract("line", pattern, 1), F.lit("")).try_cast("int")

    read = _clean(lines).select(
        "run_id",
        F.col("line").rlike(STEP_START).alias("started"),
        F.col("line").rlike(STEP_DONE).alias("finished"),
        reported(BOARDS_TOTAL).alias("boards_total"),
        reported(BOARDS_ONLINE).alias("boards_online"),
        reported(SETTINGS_COMPILED).alias("compiled"),
        F.col("line").rlike(SUITE_DONE).alias("completed"),
        age_seconds(F.regexp_extract("line", AGE, 1)).alias("age_s"),
    )
    return read.groupBy("run_id").agg(
        F.count_if("started").alias("started"), F.count_if("finished").alias("finished"),
        F.max("boards_total").alias("boards_total"), F.max("boards_online").alias("boards_online"),
        F.max("compiled").alias("compiled"), F.bool_or("completed").alias("completed"),
        F.count("age_s").alias("listed"), F.max("age_s").alias("oldest_s"),
    )


def poll_attempts(lines: DataFrame) -> DataFrame:
    """(run_id, line_no, attempt, attempts, ready, synced) out of the polling lines."""
    poll = F.when(F.col("line").rlike(POLL), F.struct(
        F.regexp_extract("line", POLL, 1).try_cast("int").alias("attempt"),
        F.regexp_extract("line", POLL, 2).try_cast("int").alias("attempts"),
        (F.regexp_extract("line", POLL, 3) == "True").alias("ready"),
        (F.regexp_extract("line", POLL, 4) == "True").alias("synced"),
    ))
    return parsed_rows(_clean(lines), ["run_id", "line_no"], poll)


def signature(text: Column) -> Column:
    """Text with ids and numbers masked."""
    step = F.regexp_replace(text, "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "<id>")
    return F.regexp_replace(step, "[0-9]+", "<n>")


def error_signatures(lines: DataFrame) -> DataFrame:
    """Error lines by masked text: how many lines, in how many runs."""
    clean = _clean(lines)
    masked = F.when(_level(F.col("line")).isin("ERR", "ERROR"), F.struct(signature(F.trim("line")).alias("signature")))
    return _signatures(parsed_rows(clean, ["run_id"], masked), "run_id")


def signature_counts(df: DataFrame, text: str, run: str) -> DataFrame:
    """All lines by masked text: how many lines, in how many runs."""
    return _signatures(df.select(signature(F.trim(F.col(text))).alias("signature"), run), run)


def _signatures(masked: DataFrame, run: str) -> DataFrame:
    per_run = masked.groupBy("signature", run).agg(F.count(F.lit(1)).alias("_n"))
    return per_run.groupBy("signature").agg(F.sum("_n").alias("lines"), F.count(F.lit(1)).alias("runs"))


def line_filter(lines: DataFrame, words: Sequence[str], col: str = "line") -> DataFrame:
    """Lines that contain any of the words, whatever the case."""
    return lines.where(F.lower(F.col(col)).rlike("|".join(re.escape(w.lower()) for w in words)))


def extract_references(texts: DataFrame, col: str, patterns: Sequence[str] = (IMAGE_LINE, FROM_LINE)) -> DataFrame:
    """Distinct references that the patterns' first group finds anywhere in the texts."""
    found = F.concat(*[F.regexp_extract_all(F.col(col), F.lit(p), F.lit(1)) for p in patterns])
    refs = texts.select(F.explode(found).alias("source"))
    bare = F.regexp_replace(F.regexp_replace("source", "[\"',]$", ""), "^\\s+|\\s+$", "")
    return refs.select(bare.alias("source")).where(F.col("source") != "").distinct()


def reference_inventory(references: DataFrame, namespace: str, owners: Sequence[str] = ()) -> DataFrame:
    """Target name of each reference of the allowed owners; in sorted order the first per target is kept."""
    refs = references.select(F.trim(F.col("source")).alias("source")).where(F.col("source") != "").distinct()
    if owners:
        names = "|".join(re.escape(o) for o in owners)
        refs = refs.where(F.col("source").rlike(f"^((index\\.)?docker\\.io/)?({names})/"))
    target = F.concat(F.lit(f"docker.io/{namespace}/"), reference_repo(F.col("source")), F.lit(":"), reference_tag(F.col("source")))
    return first_per_key(refs.withColumn("target", target), "target", ["source"])


def endpoint_inventory(df: DataFrame, url: str, default: str = DEFAULT_ENDPOINT) -> DataFrame:
    """(scheme, host, endpoints): rows per address without port and path; empty addresses take the default."""
    given = F.when(F.coalesce(F.trim(F.col(url)), F.lit("")) == "", F.lit(default)).otherwise(F.trim(F.col(url)))
    return df.groupBy(url_scheme(given).alias("scheme"), url_host(given).alias("host")).agg(
        F.count(F.lit(1)).alias("endpoints")
    )
