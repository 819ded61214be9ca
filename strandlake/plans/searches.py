"""Searches over the given tables, each from rows of conditions."""

from pyspark.sql import functions as F

from ..operators import search
from .scans import track_mean
from .tables import HITS, SEQ, hits, sequences, table

QUERIES, SQL = {}, {}


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


ALL = [(1, "click", 0, 3000, None, 0.2, None, 1), (2, "error", None, None, "+", None, 4, 1), (3, "view", None, 2500, None, None, 2, 2)]
ANY = [(1, "purchase", 100, None, "-", None, 5, 1), (2, "error", None, 400, None, 0.5, None, 2)]
NEAR = [(1, "click", None, None, None, 0.1, 3, 1), (2, "view", None, None, "+", None, None, 1)]


def values(rows):
    """SQL: the conditions."""
    kinds = ("BIGINT", "VARCHAR", "BIGINT", "BIGINT", "VARCHAR", "DOUBLE", "BIGINT", "BIGINT")
    one = lambda x, t: f"NULL::{t}" if x is None else f"'{x}'" if t == "VARCHAR" else f"{x}::{t}"
    return "c(k, motif, low, high, strand, score, conservation, least) AS (VALUES " + ", ".join("(" + ", ".join(one(x, t) for x, t in zip(r, kinds, strict=True)) + ")" for r in rows) + ")"


TRACKED = "WITH " + SEQ + ", " + HITS + """, tr AS (SELECT event_id, substr(u, ((start // 10) * 10 + 1)::BIGINT, (((start + 7) // 10 - start // 10 + 1) * 10)::BIGINT) AS t FROM hits JOIN seq USING (seq_id)),
th AS (SELECT hits.*, CASE WHEN length(t) > 0 THEN (10 * (length(t) - length(translate(t, 'CG', ''))) // ((length(t) + 9) // 10))::BIGINT END AS conservation FROM hits LEFT JOIN tr USING (event_id))"""
MET = ", met AS (SELECT th.*, k FROM th JOIN c ON th.motif = c.motif AND (low IS NULL OR start >= low) AND (high IS NULL OR start + len <= high) AND (c.strand IS NULL OR th.strand = c.strand) AND (c.score IS NULL OR th.score >= c.score) AND (c.conservation IS NULL OR coalesce(th.conservation >= c.conservation, false)))"
COMBINED = MET + ", g AS (SELECT seq_id, k, count(*) AS n FROM met GROUP BY 1, 2), ok AS (SELECT seq_id, count(*) AS met, sum(n)::BIGINT AS n FROM g JOIN c USING (k) WHERE n >= least GROUP BY 1)"


def tracked(spark, sf_dir):
    """Hits with the mean of the track that they touch; null beyond a sequence's end."""
    rows = hits(spark, sf_dir)
    track = track_mean(rows, sequences(spark, sf_dir), "event_id", 8).select("event_id", "conservation")
    return rows.join(track, "event_id", "left")


def conditions(spark, rows):
    return spark.createDataFrame(rows, search.CONDITIONS)


@query(TRACKED + ", " + values(ALL) + COMBINED + """, de AS (SELECT doc_id FROM documents WHERE regexp_matches(source, '(?i)^SRC') AND list_contains(string_split(upper(source || ',' || coalesce(lang, '')), ','), 'EN') AND (doc_id % 5000 - 100 BETWEEN -50 AND 2000 OR n_chars - 2000 BETWEEN -50 AND 2000))
SELECT seq_id, met, n FROM ok WHERE met = 3 AND seq_id IN (SELECT doc_id FROM de)""")
def search_all(spark, sf_dir):
    """Sequences that meet all conditions, by name, symbol and distance as well."""
    docs = table(spark, sf_dir, "documents")
    known = docs.select(F.col("doc_id").alias("seq_id"), F.col("source").alias("name"), F.concat_ws(",", "source", F.coalesce("lang", F.lit(""))).alias("symbols"), F.concat_ws(";", (F.col("doc_id") % 5000 - 100).cast("string"), (F.col("n_chars") - 2000).cast("string")).alias("distances"))
    found = search.combined(tracked(spark, sf_dir), conditions(spark, ALL))
    return found.join(search.described(known, "^SRC", "en", (-50, 2000)), "seq_id", "left_semi").select("seq_id", "met", "n")


@query(TRACKED + ", " + values(ANY) + COMBINED + " SELECT seq_id, met, n FROM ok")
def search_any(spark, sf_dir):
    """Sequences that meet one condition at least."""
    return search.combined(tracked(spark, sf_dir), conditions(spark, ANY), "or").select("seq_id", "met", "n")


@query(TRACKED + ", " + values(NEAR) + MET + ", pr AS (SELECT a.seq_id, abs(b.start - a.start) AS gap FROM met a JOIN met b ON a.seq_id = b.seq_id AND a.k = 1 AND b.k = 2 AND abs(b.start - a.start) <= 40) SELECT seq_id, count(*) AS n, min(gap)::BIGINT AS nearest FROM pr GROUP BY 1")
def search_near(spark, sf_dir):
    """Sequences with hits of two conditions near each other."""
    return search.apart(tracked(spark, sf_dir), conditions(spark, NEAR), 40)
