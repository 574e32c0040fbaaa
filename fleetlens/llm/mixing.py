"""Operator 6: mixing sources to target weights.

Words are summed per source before anything is shuffled. The targets are filled like vessels: a source that would
pass its cap stands at the cap, and the rest is shared anew by weight. From a source's target follows its repetition
rate; a document is emitted floor(rate) times and once more if a hash of its id falls below the fraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.shared import partitions_of, word_count, written

WEIGHTS = (1, 2, 3)
MOST_REPEATS = 3


def draw(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts alone: 52 bits of an MD5."""
    key = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def _ranked(sources: DataFrame) -> DataFrame:
    """Sources with their place by code point, nulls last, from 0.

    Sources are sorted over all tasks; a place is the rows of the partitions before plus the place inside. Only one
    count per partition meets in a task.
    """
    spread = sources.repartitionByRange(partitions_of(sources), F.col("source").asc_nulls_last())
    parts = written(spread.sortWithinPartitions(F.col("source").asc_nulls_last()).withColumn("_part", F.spark_partition_id()), "sources")
    counts = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(
        Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_part").orderBy(F.col("source").asc_nulls_last())
    return parts.join(before, "_part").withColumn("place", F.col("_before") + F.row_number().over(inside) - 1).drop("_part", "_before")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """(source, source_size, weight, target) for rows of (source, size).

    All but the scalars of a round stay in tables: a round sums what the capped sources take and what the others
    weigh. Rounds end when no further source passes its cap, which takes at most one round per source and few in
    practice. Sources without words have the target 0.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = _ranked(per)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("long")
    table = written(ranked.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * most).alias("_cap")), "targets")
    # a source is capped in a level (rest, heft) if its cap is below its share weight * rest / heft
    first = table.agg(F.sum("source_size"), F.sum("weight")).first()
    total, heft = first[0] or 0, first[1] or 0
    rest, free, capped = total, heft, F.lit(False)
    while free:
        capped = F.col("_cap").cast("decimal(38,0)") * F.lit(free) < F.col("weight").cast("decimal(38,0)") * F.lit(rest)
        found = table.where(capped).agg(F.coalesce(F.sum("_cap"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
        if (total - found[0], heft - found[1]) == (rest, free):
            break
        rest, free = total - found[0], heft - found[1]
    share = (F.col("weight") * F.lit(rest)).cast("double") / F.lit(float(free or 1))
    return table.select("source", "source_size", "weight", F.when(capped, F.col("_cap").cast("double")).otherwise(share).alias("target"))


def mixed(
    docs: DataFrame, seed: int = 0, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS,
    doc_id: str = "doc_id", text: str = "text", source: str = "source",
) -> DataFrame:
    """The rows of `docs` with `mix`: a struct of size, source_size, target and copies.

    Null and empty texts have size 0; a null source is a source of its own and comes last; rows with the same id and
    text are drawn alike; a rerun draws alike; an empty table stays empty. A column named `mix` is replaced.
    """
    docs = docs.drop("mix")
    drawn = draw(seed, F.col(doc_id), F.md5(F.coalesce(F.col(text), F.lit(""))))
    # the columns of `docs` are in a struct of their own, so that none meets a name of these
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), word_count(F.col(text)).alias("size"), drawn.alias("drawn"),
        F.coalesce(F.col(source), F.lit("")).alias("key"), F.col(source).isNull().alias("none"), F.col(source).alias("source"))
    targets = source_targets(keyed.select("source", "size"), weights, most)
    # A source may hold a third of all rows: documents stand on the side of a join that adaptive execution may split,
    # and where the sources are few Spark broadcasts their table by its written size.
    per = targets.select(F.coalesce(F.col("source"), F.lit("")).alias("key"), F.col("source").isNull().alias("none"), "source_size", "target")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    joined = keyed.drop("source").join(per, ["key", "none"], "left").withColumn("rate", rate)
    copies = F.floor("rate") + F.when(F.col("drawn") < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    mix = F.struct("size", "source_size", "target", copies.cast("long").alias("copies"))
    return joined.select(*[F.col(f"row.`{c}`") for c in docs.columns], mix.alias("mix"))


def emitted(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: every row of `docs` as often as it is taken, in the columns of `docs`."""
    kept = [c for c in docs.columns if c != "mix"]
    rows = mixed(docs, **how).where("mix.copies > 0").select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), "mix")
    return rows.select("row", F.explode(F.expr("sequence(1L, mix.copies)"))).select(*[F.col(f"row.`{c}`") for c in kept])
