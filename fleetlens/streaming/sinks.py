"""Running a stream over what is available and keeping its result as a table in the shared folder.

Results never pass through the driver: every micro-batch is written by the executors. A batch that is run
again after a failure overwrites its own folder, so no row is kept twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from fleetlens.functions.keyed import one_row_per
from fleetlens.session import fresh_path

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Ended(NamedTuple):
    """A stream that has read what was there: where its output and its progress are, and what became of its rows."""

    path: str
    progress: str
    #: rows that `counted` streams have read
    read: int
    #: rows that reached an operator after the watermark had passed them; a windowed aggregate gets partial sums, so
    #: there a row stands for all late rows of one task, group and window
    late: int


def read_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None, schema: StructType | str | None = None) -> DataFrame:
    """Stream a parquet table: a folder of files, or one file by its name in its folder. An empty folder needs a schema."""
    schema = schema or spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if path.endswith(".parquet") and not _is_folder(spark, path):
        folder, name = path.rsplit("/", 1)
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def _is_folder(spark: SparkSession, path: str) -> bool:
    """Whether a table is a folder of files: then the first file listed for it has another name than the table."""
    first = spark.read.format("binaryFile").load(path).select("path").first()
    return first is None or first["path"].rsplit("/", 1)[1] != path.rsplit("/", 1)[1]


def on_clock(stream: DataFrame, ts: str, delay: str) -> DataFrame:
    """Event time as a zoned timestamp, which watermarks need, with the lateness allowed."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def counted(stream: DataFrame) -> DataFrame:
    """The stream, whose rows `Ended.read` tells."""
    return stream.observe("rows_read", F.count(F.lit(1)).alias("n"))


@contextmanager
def state_store(spark: SparkSession, provider: str) -> Iterator[None]:
    """Streams that are started inside keep their state in this kind of store."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, provider)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _ended(query: StreamingQuery, path: str) -> Ended:
    query.awaitTermination()
    read = late = 0
    for progress in query.recentProgress:  # as many as `session.RUNTIME` keeps
        read += sum(int(m["n"]) for name, m in progress.observedMetrics.items() if name == "rows_read")
        late += sum(s.numRowsDroppedByWatermark for s in progress.stateOperators)
    return Ended(path, path + "-progress", read, late)


def made(spark: SparkSession, path: str) -> str:
    """The folder, made: a source without rows writes no batch, and its result is an empty table."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(place)
    return path


def append_run(stream: DataFrame, name: str) -> Ended:
    """Run an append-mode stream over the available data, its output written by the engine."""
    path = made(stream.sparkSession, fresh_path(stream.sparkSession, name))
    query = (
        stream.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
        .option("checkpointLocation", path + "-progress").start(path)
    )
    return _ended(query, path)


def append_table(stream: DataFrame, name: str) -> str:
    """Run an append-mode stream over the available data; gives the folder its output was written to."""
    return append_run(stream, name).path


def run_append(stream: DataFrame, name: str) -> DataFrame:
    """Run an append-mode stream over the available data and return its output table."""
    return stream.sparkSession.read.schema(stream.schema).parquet(append_table(stream, name))


def batches_run(stream: DataFrame, name: str, work: Callable[[DataFrame, int, str], None], mode: str = "append") -> Ended:
    """Run `work(rows, batch_id, path)` on every micro-batch."""
    spark = stream.sparkSession
    path = made(spark, fresh_path(spark, name))
    query = (
        stream.writeStream.outputMode(mode).trigger(availableNow=True)
        .option("checkpointLocation", path + "-progress")
        .foreachBatch(lambda rows, batch: work(rows, batch, path)).start()
    )
    return _ended(query, path)


def run_batches(stream: DataFrame, name: str, work: Callable[[DataFrame, int, str], None], mode: str = "append") -> str:
    """Run `work(rows, batch_id, path)` on every micro-batch; gives the folder the batches were written under."""
    return batches_run(stream, name, work, mode).path


def write_batch(rows: DataFrame, batch: int, path: str) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def read_batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All batches written under a folder, with their number as `batch`; none, if there was none."""
    return spark.read.schema(f"{schema}, batch int").option("basePath", path).parquet(made(spark, path))


def state_table(spark: SparkSession, ended: Ended, schema: str, variable: str | None = None) -> DataFrame:
    """What the keyed operator of a stream holds at the end of its input, one row per key: `key` and `value`.

    `schema` is that of both, for a stream that has had no batch. A processor with state variables names one.
    """
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{ended.progress}/state")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], schema)
    reader = spark.read.format("statestore")
    if variable:
        reader = reader.option("stateVarName", variable)
    return reader.load(ended.progress)


def update_run(stream: DataFrame, keys: Sequence[str], name: str) -> tuple[DataFrame, Ended]:
    """Run an aggregation in update mode: the newest result of every key, open windows included, and how it ended."""
    ended = batches_run(stream, name, write_batch, "update")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields)
    rows = read_batches(stream.sparkSession, ended.path, fields)
    return one_row_per(rows, list(keys), ["batch"]).drop("batch"), ended


def run_update(stream: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Run an aggregation in update mode and return the newest result of every key, open windows included."""
    return update_run(stream, keys, name)[0]


def kept_and_late(rows: DataFrame, ended: Ended, counts: str) -> DataFrame:
    """(read, kept, late): of the rows of a `counted` stream, how many are in the counts of its windows, and how many came
    after the watermark had closed theirs."""
    kept = F.coalesce(F.sum(counts), F.lit(0)).alias("kept")
    return rows.agg(kept).select(F.lit(ended.read).cast("long").alias("read"), "kept", (F.lit(ended.read) - F.col("kept")).alias("late"))
