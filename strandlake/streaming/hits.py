"""Motif hits as a stream. An extra of this engine: counts over windows of event time, with a bound on lateness."""

from pyspark.sql import functions as F


def windowed_counts(stream, window="1 hour", late="10 minutes", ts="ts", motif="event_type", score="value"):
    """window_start, motif, n, best: hits of each motif in windows of event time; rows later than `late` are not counted.

    The state is one row a motif and open window.
    """
    return stream.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), F.col(motif).alias("motif")).agg(F.count(F.lit(1)).alias("n"), F.max(score).alias("best")).select(F.col("w.start").alias("window_start"), "motif", "n", "best")
