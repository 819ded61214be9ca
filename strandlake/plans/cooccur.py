"""Queries over words that stand at fixed distances: their pairs, clusters aligned by them, and what these don't explain."""

from pyspark.sql import functions as F

from ..operators import cooccur, enrich
from ..session import saved, shared_dir
from .hits import FRAMED
from .tables import CANDIDATE, rc, sequences, windows
from .words import STATS0, stats

QUERIES, SQL = {}, {}
REPORT = 100  # words of the report whose positions are compared


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


OFFSETS = STATS0.rstrip().replace("WITH ", "WITH RECURSIVE ", 1) + f""", cand AS (SELECT word FROM st WHERE {CANDIDATE} ORDER BY z DESC, word LIMIT {REPORT}),
hits AS (SELECT c.word AS motif, w.seq_id, CASE WHEN w.word = c.word THEN '+' ELSE '-' END AS strand, 8::BIGINT AS len, i - 1 AS start, i - 1 AS event_id FROM ({windows(0, 8, ((0, 8),))}) w JOIN cand c ON c.word = least(w.word, {rc('w.word')})),
{FRAMED}, hc AS (SELECT motif, count(*) AS c FROM hits GROUP BY motif), fn AS (SELECT m1, m2, dir, gap, count(*) AS n FROM fp GROUP BY ALL HAVING count(*) >= 5),
off AS (SELECT m1, m2, dir, gap, n, n / least(a.c, b.c) AS share FROM fn JOIN hc a ON a.motif = m1 JOIN hc b ON b.motif = m2 WHERE n >= 0.05 * least(a.c, b.c))"""
# strongest links first; a link is left out if better ones join its ends already
ALIGNED = OFFSETS + """, e AS (SELECT *, row_number() OVER (ORDER BY share DESC, m1, m2, dir, gap) AS r FROM off WHERE m1 <> m2),
one AS (SELECT m1, m2, arg_min(dir, r) AS dir, arg_min(gap, r) AS gap, min(r) AS r FROM e GROUP BY m1, m2),
reach(r, motif) AS (SELECT r, m1 FROM one UNION SELECT a.r, CASE WHEN b.m1 = a.motif THEN b.m2 ELSE b.m1 END FROM reach a JOIN one b ON b.r < a.r AND (b.m1 = a.motif OR b.m2 = a.motif)),
tree AS (SELECT * FROM one WHERE NOT EXISTS (SELECT 1 FROM reach WHERE reach.r = one.r AND reach.motif = one.m2)),
arc AS (SELECT m1 AS a, m2 AS b, dir, gap, true AS ahead FROM tree UNION ALL SELECT m2, m1, dir, gap, false FROM tree),
net(a, b) AS (SELECT a, a FROM (SELECT DISTINCT a FROM arc) UNION SELECT net.a, arc.b FROM net JOIN arc ON arc.a = net.b),
head AS (SELECT b AS motif, min(a) AS cluster FROM net GROUP BY b),
walk(cluster, motif, dir, place) AS (SELECT cluster, cluster, 1::BIGINT, 0::BIGINT FROM (SELECT DISTINCT cluster FROM head)
 UNION SELECT cluster, b, w.dir * arc.dir, CASE WHEN ahead THEN CASE WHEN w.dir = 1 THEN place + gap ELSE place + 8 - 8 - gap END ELSE CASE WHEN w.dir * arc.dir = 1 THEN place - gap ELSE place + 8 - 8 + gap END END FROM walk w JOIN arc ON arc.a = w.motif),
al AS (SELECT cluster, motif, dir, place - min(place) OVER (PARTITION BY cluster) AS place FROM walk)"""


def positions(spark, sf_dir):
    """Hits of the report's words, the best by z, in all sequences."""
    words = [r["word"] for r in enrich.candidates(stats(spark, sf_dir)).orderBy(F.desc("z"), "word").limit(REPORT).select("word").collect()]
    return cooccur.word_hits(sequences(spark, sf_dir), words)


def links(spark, sf_dir):
    return saved(cooccur.offsets(positions(spark, sf_dir)), shared_dir(spark, "links"), "offsets")


@query(OFFSETS + " SELECT m1, m2, dir, gap, n, round(share, 6) AS share FROM off")
def word_offsets(spark, sf_dir):
    """Distances of the report's words that make up a twentieth of the rarer one's hits."""
    return cooccur.offsets(positions(spark, sf_dir)).withColumn("share", F.round("share", 6))


def aligned(rows):
    motifs = rows.select(F.explode(F.array("m1", "m2")).alias("motif")).distinct()
    return cooccur.align(rows, motifs.select("motif", F.length("motif").cast("long").alias("len")))


@query(ALIGNED + " SELECT cluster, motif, dir, place FROM al")
def align_cooccur(spark, sf_dir):
    """The report's words in clusters, each at the place where the strongest links put it."""
    return aligned(links(spark, sf_dir)).select("cluster", "motif", "dir", "place")


@query(ALIGNED + """ SELECT m1, m2, a.cluster AS cluster1, b.cluster AS cluster2, off.dir, gap, n, round(share, 6) AS share FROM off JOIN al a ON a.motif = m1 JOIN al b ON b.motif = m2
WHERE m1 <> m2 AND NOT (a.cluster = b.cluster AND a.dir * b.dir = off.dir AND CASE WHEN a.dir = 1 THEN b.place - a.place ELSE a.place - b.place END = gap) AND CASE WHEN off.dir > 0 THEN 8 - gap ELSE 8 + gap END < 6""")
def intercluster_links(spark, sf_dir):
    """Distances that the clusters don't explain, of words that hardly overlap."""
    rows = links(spark, sf_dir)
    return cooccur.unexplained(rows, aligned(rows)).withColumn("share", F.round("share", 6))
