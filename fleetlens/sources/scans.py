"""Readers: resource documents, registry tables, saved API payloads and run logs."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.session import stage
from fleetlens.sources.lists import SPLITS_TO_SEND, list_items
from fleetlens.sources.schemas import CONDITION, PLAIN_SPEC_FIELDS, REGISTRY, TOP_FIELDS, resource_schema

EXTERNAL_NAME = "crossplane.io/external-name"


def _yaml_loader() -> type:
    """The safe loader, to which dates are text: no value of a manifest is refused for being no date."""
    import yaml

    class Loader(getattr(yaml, "CSafeLoader", yaml.SafeLoader)):
        pass

    Loader.yaml_implicit_resolvers = {
        sign: [(tag, pattern) for tag, pattern in found if tag != "tag:yaml.org,2002:timestamp"]
        for sign, found in Loader.yaml_implicit_resolvers.items()}
    return Loader


def _documents(text: str, kind: type) -> Iterator[tuple[object, Exception | None]]:
    """The documents of a text; one that cannot be read is its error, and what cannot be parsed ends the text."""
    loader = None
    try:
        loader = kind(text)
        while loader.check_node():
            node = loader.get_node()
            try:
                yield loader.construct_document(node), None
            except Exception as error:  # any value may refuse its own type
                yield None, error
    except Exception as error:
        yield None, error
    finally:
        if loader is not None:
            loader.dispose()


def _yaml_to_json(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per document, and per item of a list; one row with the error for a document that is no resource."""
    kind = _yaml_loader()
    for frame in frames:
        rows: list[tuple[str | None, str | None, str]] = []
        for text, file in zip(frame["value"], frame["file"]):
            for doc, error in _documents(text, kind):
                if error is not None:
                    rows.append((None, f"{type(error).__name__}: {error} in: {text[:200]}", file))
                    continue
                items = doc.get("items") if isinstance(doc, dict) else None
                for one in items if isinstance(items, list) else [doc]:
                    if isinstance(one, dict):
                        try:
                            rows.append((json.dumps(one, default=str), None, file))
                        except Exception as wrong:  # keys that are no text, or nested beyond all measure
                            rows.append((None, f"{type(wrong).__name__}: {wrong} in: {text[:200]}", file))
                    elif one is not None:
                        rows.append((None, f"no resource: {str(one)[:200]}", file))
        yield pd.DataFrame(rows, columns=["body", "error", "file"], dtype="object")


def _typed(docs: DataFrame, kind: str) -> DataFrame:
    """Rows (doc, error, file) as one row per resource of the kind; those with an error stay, with nothing but it."""
    doc, meta = F.col("doc"), F.col("doc.metadata")
    core, name = kind.startswith("v1/"), kind.removeprefix("v1/")
    wanted = doc["kind"] == name
    if name == "Service":  # two kinds share this name
        wanted &= F.coalesce(doc["apiVersion"] == "v1", F.lit(False)) == core
    nothing = F.lit(None)
    if kind in TOP_FIELDS:
        fields = T._parse_datatype_string(f"struct<{TOP_FIELDS[kind]}>").names
        spec, policy, observed, conditions = F.struct(*[doc[f].alias(f) for f in fields]), nothing, nothing, nothing
    elif kind in PLAIN_SPEC_FIELDS:
        spec, policy, observed, conditions = doc["spec"], nothing, doc["status"].dropFields("conditions"), doc["status"]["conditions"]
    else:
        spec, policy = doc["spec"]["forProvider"], doc["spec"]["deletionPolicy"]
        observed, conditions = doc["status"]["atProvider"], doc["status"]["conditions"]
    none = F.array().cast(f"array<{CONDITION}>")
    return docs.where(wanted | F.col("error").isNotNull()).select(
        meta["name"].alias("name"),
        meta["namespace"].alias("namespace"),
        meta["generation"].alias("generation"),
        meta["creationTimestamp"].alias("created"),
        meta["labels"].alias("labels"),
        meta["annotations"].alias("annotations"),
        F.try_element_at(meta["annotations"], F.lit(EXTERNAL_NAME)).alias("external_name"),
        spec.alias("spec"),
        policy.cast("string").alias("deletion_policy"),
        observed.alias("observed"),
        F.coalesce(conditions.cast(f"array<{CONDITION}>"), none).alias("conditions"),
        "error", "file",
    )


def resource_scan(spark: SparkSession, path: str, kind: str, fmt: str = "json") -> DataFrame:
    """One typed row per resource of a kind, and one row with `error` and `file` per document that cannot be read.

    json: list exports or single documents, any layout, one file per task.
    jsonl: one document or list per line; files split between tasks.
    list: large list exports, any layout; files split between tasks at the items, see `list_items`.
    yaml: manifests, lists included; files split between tasks at the document separator. Dates stay text.
    A core service is the kind v1/Service; Service alone is the device service.
    """
    doc = resource_schema(kind)
    if fmt == "yaml":
        texts = spark.read.option("lineSep", "\n---\n").text(path).select("value", F.col("_metadata.file_path").alias("file"))
        bodies = texts.mapInPandas(_yaml_to_json, "body string, error string, file string")
        return _typed(bodies.select(F.from_json("body", T._parse_datatype_string(doc)).alias("doc"), "error", "file"), kind)
    top = T._parse_datatype_string(doc)
    if fmt == "list":
        whole = T.StructType([*top.fields, T.StructField("_corrupt_record", T.StringType())])
        read = list_items(spark, path).select(F.from_json("body", whole).alias("doc"), "file")
        bad_item = F.when(F.col("doc._corrupt_record").isNotNull(), F.concat(F.lit("no JSON: "), F.substring("doc._corrupt_record", 1, 200)))
        return _typed(read.select("doc", bad_item.alias("error"), "file"), kind)
    bad = T.StructField("_corrupt_record", T.StringType())
    schema = T.StructType([*top.fields, T.StructField("items", T.ArrayType(top)), bad])
    raw = spark.read.schema(schema).option("multiLine", fmt == "json").json(path)
    alone = F.array(F.struct(*[f.name for f in top.fields]))
    error = F.when(F.col("_corrupt_record").isNotNull(), F.concat(F.lit("no JSON: "), F.substring("_corrupt_record", 1, 200)))
    docs = raw.select(F.explode_outer(F.coalesce("items", alone)).alias("doc"), error.alias("error"), F.col("_metadata.file_path").alias("file"))
    return _typed(docs, kind)


def registry_scan(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A registry table kept as parquet; columns a file lacks read as NULL."""
    return spark.read.schema(REGISTRY[table]).parquet(f"{folder}/{table}.parquet")


def registry_query(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """The same table read from the live database over JDBC.

    Pass partitionColumn, lowerBound, upperBound and numPartitions to read a large table in parallel.
    """
    rows = spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
    wanted = T._parse_datatype_string(REGISTRY[table])
    return rows.select(*[F.col(f.name).cast(f.dataType) for f in wanted.fields])


def api_capture_scan(df: DataFrame, body: str, item: str, envelope: str | None = None) -> DataFrame:
    """Rows out of saved payloads: an object, an array, or an array wrapped in an envelope key.

    `item` is the schema of one object. A payload that is no JSON, or holds no object, gives one row with NULL
    fields so that nothing disappears unseen.
    """
    one = T._parse_datatype_string(f"struct<{item}>")
    text = F.trim(F.col(body))
    bare = F.when(text.startswith("["), F.from_json(text, T.ArrayType(one)))
    alone = F.when(text.startswith("{"), F.array(F.from_json(text, one)))
    if envelope:
        wrapped = F.from_json(text, T.StructType([T.StructField(envelope, T.ArrayType(one))]))[envelope]
        items = F.coalesce(bare, wrapped, alone)
    else:
        items = F.coalesce(bare, alone)
    kept = [c for c in df.columns if c != body]
    return df.select(*kept, F.explode_outer(items).alias("_item")).select(*kept, "_item.*")


def log_scan(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, line_no, line) from a folder of run logs, without reading a whole file into one row.

    A run is named by its file's path below the folder, without the encoding that file addresses have. Files are read in splits. A line's number is its place inside
    its split plus the lines of the earlier splits of the same file, which a table with one row per split tells; so no
    line is shuffled, and even one very long log is numbered in parallel.
    """
    root = re.sub("^[a-z0-9]+:(//[^/]*)?", "", path.rstrip("/")) + "/"
    # a plus sign stands for itself in a path, in a form's value it would be a blank
    file = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    below = F.locate(root, file)
    run = F.when(below > 0, F.substr(file, below + len(root))).otherwise(F.substring_index(file, "/", -1))
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select(
        F.regexp_replace(run, "\\.log$", "").alias("run_id"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_pos"),
        F.col("value").alias("line"),
    )
    sizes = lines.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_first"))
    earlier = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first") + 1
    offsets = stage(sizes.select("_file", "_block", offset.alias("_offset")), "splits")
    if offsets.count() <= SPLITS_TO_SEND:
        offsets = F.broadcast(offsets)
    placed = lines.join(offsets, ["_file", "_block"])
    return placed.select("run_id", (F.col("_offset") + F.col("_pos")).alias("line_no"), "line")


def text_lines(df: DataFrame, run: str, text: str) -> DataFrame:
    """(run_id, line_no, line) from a table that holds one whole text per row."""
    return df.select(F.col(run).alias("run_id"), F.posexplode(F.split(F.col(text), "\n")).alias("_at", "line")).select(
        "run_id", (F.col("_at") + 1).alias("line_no"), "line"
    )
