"""Over-representation of words in test against control."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import seq


def lengths(seqs, test="test", control="ctrl"):
    """One row: clean bases and sequences of either group."""
    clean = F.length(F.translate("u", "N", "")).cast("long")
    of = lambda g, x: F.coalesce(F.sum(F.when(F.col("grp") == g, x)), F.lit(0)).cast("long")
    return seqs.agg(of(test, clean).alias("len1"), of(control, clean).alias("len2"), of(test, F.lit(1)).alias("n1"), of(control, F.lit(1)).alias("n2"))


def statistics(folded, totals, spans, length=8, presence=False):
    """gap, word, x, y, z, ratio, diff, total of folded counts (gap, word, x, y); totals: the row of lengths().

    y is floored by what chance gives; z compares the shares of both groups, ratio and diff the counts scaled to the
    test's size. spans: {gap: span}. totals is one row, so joining it is a projection.
    """
    words = 4**length
    span = F.element_at(F.create_map(*(F.lit(x) for kv in spans.items() for x in kv)), F.col("gap").cast("int"))
    rows = folded.crossJoin(F.broadcast(totals))
    own = F.when(F.col("word") == seq.revcomp(F.col("word")), 1.0).otherwise(2.0)
    if presence:
        floor = F.col("n2") * (1 - F.exp(-F.col("len2") / F.col("n2") / words))
        rows = rows.withColumn("N1", F.col("n1").cast("double")).withColumn("N2", F.col("n2").cast("double")).withColumn("scale", F.col("n1") / F.col("n2"))
    else:
        floor = F.col("len2") / words
        rows = rows.withColumn("N1", F.floor(F.col("len1") / span).cast("double")).withColumn("N2", F.floor(F.col("len2") / span).cast("double")).withColumn("scale", F.col("len1") / F.col("len2"))
    rows = rows.withColumn("a", F.least(F.col("x").cast("double"), F.col("N1") - 1)).withColumn("b", F.least(F.greatest(F.col("y").cast("double"), own * floor), F.col("N2") - 1))
    share = (F.col("a") + F.col("b")) / (F.col("N1") + F.col("N2"))
    rows = rows.withColumn("share", share)
    z = F.when(F.col("share") > 0, (F.col("a") / F.col("N1") - F.col("share")) / F.sqrt(F.col("share") * (1 - F.col("share")) * F.col("N2") / (F.col("N1") + F.col("N2") - 1) / F.col("N1"))).otherwise(0.0)
    scaled = F.col("b") * F.col("scale")
    return rows.select("gap", "word", "x", "y", z.alias("z"), ((F.col("a") + 5) / (scaled + 5)).alias("ratio"), (F.col("a") - scaled).alias("diff"), (F.col("a") + scaled).alias("total"), "len1")


def considered(stats, length=8, min_ratio=1.5):
    """Words frequent enough to count as hypotheses."""
    own = F.when(F.col("word") == seq.revcomp(F.col("word")), 1.0).otherwise(2.0)
    return stats.where(F.col("total") >= own * 0.25 * (1 + min_ratio) * F.col("len1") / 4**length)


def candidates(stats, length=8, min_ratio=1.5):
    return considered(stats, length, min_ratio).where((F.col("ratio") >= min_ratio) & (F.col("z") >= 1.643) & (F.col("diff") >= 8))


def fold(counts):
    """Counts (gap, word, x, y) of both strands under the lesser word."""
    return counts.groupBy("gap", seq.canonical(F.col("word")).alias("word")).agg(F.sum("x").alias("x"), F.sum("y").alias("y"))


def false_discovery(tests, p="p", hypotheses="n_hyp", by="gap"):
    """Benjamini-Hochberg: fdr of each test, never above that of a larger p; ties by word.

    by bounds what a window sorts: the tests of one template, of which there are at most 4**length.
    """
    up = Window.partitionBy(by).orderBy(F.col(p), F.col("word"))
    down = Window.partitionBy(by).orderBy(F.col(p).desc(), F.col("word").desc())
    return tests.withColumn("rank", F.row_number().over(up)).withColumn("fdr", F.least(F.lit(1.0), F.min(F.col(p) / F.col("rank") * F.col(hypotheses)).over(down)))
