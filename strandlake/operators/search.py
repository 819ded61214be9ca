"""Searches given as rows: what hits a sequence must have, how they are combined, and what the sequence itself must be."""

from pyspark.sql import functions as F

from .hits import near_pairs

#: k: number of the condition; missing values ask for nothing; least: hits that a sequence must have.
CONDITIONS = "k long, motif string, low long, high long, strand string, score double, conservation long, least long"
MOST = 1000  # conditions of one search


def meeting(hits, conditions):
    """hits with the number k of each condition that they meet; hits: motif, seq_id, strand, len, start, score, conservation."""
    if (n := conditions.count()) > MOST:
        raise ValueError(f"{n} conditions: at most {MOST} at once")
    c = conditions.select(F.col("k"), F.col("motif").alias("_motif"), *(F.col(x).alias(f"_{x}") for x in ("low", "high", "strand", "score", "conservation")))
    asks = lambda own, met: F.col(own).isNull() | met
    good = (
        (F.col("motif") == F.col("_motif")) & asks("_low", F.col("start") >= F.col("_low")) & asks("_high", F.col("start") + F.col("len") <= F.col("_high"))
        & asks("_strand", F.col("strand") == F.col("_strand")) & asks("_score", F.col("score") >= F.col("_score"))
        & asks("_conservation", F.coalesce(F.col("conservation") >= F.col("_conservation"), F.lit(False)))
    )
    return hits.join(F.broadcast(c), good).select(*hits.columns, "k")


def combined(hits, conditions, how="and"):
    """seq_id, met, n of sequences that meet all conditions ("and") or one at least ("or"); n: hits that meet any."""
    if how not in ("and", "or"):
        raise ValueError("how must be 'and' or 'or'")
    counts = meeting(hits, conditions).groupBy("seq_id", "k").agg(F.count(F.lit(1)).alias("n"))
    enough = counts.join(F.broadcast(conditions.select("k", F.coalesce("least", F.lit(1)).alias("least"))), "k").where("n >= least")
    rows = enough.groupBy("seq_id").agg(F.count(F.lit(1)).alias("met"), F.sum("n").alias("n"))
    return rows.where(F.col("met") >= (conditions.count() if how == "and" else 1))


def apart(hits, conditions, distance):
    """seq_id, n, nearest: sequences with hits of conditions 1 and 2 whose starts are at most `distance` apart, either first."""
    met = meeting(hits, conditions)
    one, two = (met.where(F.col("k") == k).select("seq_id", "start") for k in (1, 2))
    gap = lambda pairs: pairs.select("seq_id", (F.col("b_start") - F.col("a_start")).alias("gap"))
    both = gap(near_pairs(one, two, distance)).unionByName(gap(near_pairs(two, one, distance)).where("gap > 0"))
    return both.groupBy("seq_id").agg(F.count(F.lit(1)).alias("n"), F.min("gap").alias("nearest"))


def described(sequences, name=None, symbol=None, nearest=None):
    """seq_id of sequences by what is known of them: name matches a pattern (in any case), symbol is among the listed symbols,
    and nearest (low, high) holds one of the listed distances. sequences: seq_id, name, symbols, distances; lists are
    parted by commas or semicolons. Nulls meet nothing that is asked."""
    rows = sequences
    if name is not None:
        rows = rows.where(F.col("name").rlike(f"(?i){name}"))
    if symbol is not None:
        rows = rows.where(F.array_contains(F.split(F.upper("symbols"), r"\s*[,;]\s*"), symbol.upper()))
    if nearest is not None:
        low, high = nearest
        rows = rows.where(F.exists(F.split("distances", r"\s*[,;]\s*"), lambda d: F.coalesce(d.try_cast("long").between(low, high), F.lit(False))))
    return rows.select("seq_id")
