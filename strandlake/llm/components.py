"""Connected components of a graph of links, by alternating large and small stars."""

from pyspark.sql import functions as F


def saved(df, folder, name):
    """df written to the shared folder and read again: its lineage ends there."""
    df.write.parquet(f"{folder}/{name}")
    return df.sparkSession.read.parquet(f"{folder}/{name}")


def components(links, folder):
    """(node, root) of every node that has a link: root is the least node of its component.

    links: columns a and b, without nulls; loops and repeats are ignored. Each turn hands a node's larger neighbours,
    then its smaller ones, to the least of them, until nothing changes; a chain of n takes about log n turns. All of it
    is joins and grouped minima, and what each turn comes to is written to folder. Without links there are no rows.
    """
    edges = saved(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), folder, "links-0")
    mark, turn = None, 0
    state = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    while (now := state(edges)) != mark:
        mark, turn = now, turn + 1
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("k")).agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, both.u == least.k).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))
        small = large.join(least, large.u == least.k).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = saved(small.unionByName(least.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct(), folder, f"links-{turn}")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
