"""Numbers without a single task: places in a global order, and ids by first appearance."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import saved, shared_dir


def numbered(rows, *order, name="n", folder=None):
    """rows with their place in `order`, from 0, as `name`; rows of one order key stand in any order.

    Rows are dealt by ranges, so places are those in a task and what earlier tasks hold before it; only one row a task is
    ever put in line. The dealt rows are written to folder, as their places must not change.
    """
    folder = folder or shared_dir(rows.sparkSession, "numbers")
    placed = saved(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), folder, "placed")
    part = F.shiftright("_at", 33).alias("_part")
    parts = placed.groupBy(part).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_from"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("_part", (before - F.col("_from")).alias("_shift"))
    out = placed.withColumn("_part", part).join(F.broadcast(parts), "_part")  # as many rows as partitions
    return out.withColumn(name, F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def first_seen(rows, key, order, name="id", start=1, none=None):
    """key and its id: keys are numbered from `start` in the order of their first row; none: a key that gets 0 instead."""
    firsts = rows.groupBy(key).agg(F.min(order).alias("_first"))
    zero = firsts.where(F.col(key) == none) if none is not None else None
    out = numbered(firsts if none is None else firsts.where(~F.col(key).eqNullSafe(none)), "_first", key, name="_n").select(key, (F.col("_n") + start).alias(name))
    return out if zero is None else out.unionByName(zero.select(key, F.lit(0).cast("long").alias(name)))


def region_names(rows, order, given="name"):
    """rows with the given names, those missing filled by R and the row's number in `order`, seven digits, from 1."""
    out = numbered(rows, order, name="_n")
    return out.withColumn(given, F.coalesce(F.nullif(given, F.lit("")), F.format_string("R%07d", F.col("_n") + 1))).drop("_n")


def within(regions, most=100_000_000):
    """regions, whose lengths add up to `most` at most; else the job fails with what they come to."""
    total = regions.agg(F.coalesce(F.sum("len"), F.lit(0)).alias("_total"))
    checked = total.select(F.when(F.col("_total") <= most, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("regions of "), F.col("_total").cast("string"), F.lit(f" bases: more than {most}")))).alias("_fits"))
    return regions.crossJoin(F.broadcast(checked)).where("_fits").drop("_fits")  # one row
