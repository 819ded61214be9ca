"""Queries that cluster motifs: trees, alignments from seeds, k-means over alignments, and thresholds by chance."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import pfm
from ..operators import clusters as ops
from ..operators.motifs import similar_pairs
from ..session import saved, shared_dir
from .motifs import BITS, LOGODDS, M, by_row, flat, motifs, scan_core, scan_threshold
from .tables import table

QUERIES, SQL = {}, {}
MATCH = 0.5


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def percents(spark, sf_dir):
    """id, flat (percent)."""
    return flat(spark, sf_dir).select("id", F.col("pfm").alias("flat"))


def pairs(spark, sf_dir):
    rows = flat(spark, sf_dir).select("id", "flat")
    return rows, saved(similar_pairs(rows, None, MATCH), shared_dir(spark, "pairs"), "pairs")


@query()
def hierarchy(spark, sf_dir):
    """Root and path of every motif in trees of weighted average linkage, and its place in the order for reading; alike leaves
    are neighbours."""
    rows, alike = pairs(spark, sf_dir)
    return ops.linkage(alike, rows.select("id"))[1].select(F.col("id").alias("vec_id"), "root", "path", "place")


@query()
def hierarchy_merges(spark, sf_dir):
    """The merges of those trees, with the similarity and the distance that each is made at."""
    rows, alike = pairs(spark, sf_dir)
    merges = ops.linkage(alike, rows.select("id"))[0]
    return merges.select("a", "b", F.round("r", 6).alias("r"), F.round(1 / (F.col("r") * ops.WIDTH + 1), 6).alias("distance"), "turn")


@query()
def seed_extend(spark, sf_dir):
    """Cluster, direction and offset of every motif, aligned from seeds."""
    rows, alike = pairs(spark, sf_dir)
    return ops.seed_extend(rows, alike, MATCH).select("cluster", F.col("id").alias("vec_id"), "dir", "offset")


def cluster_matrices(spark, sf_dir):
    """cluster, p (from 0 at the first column that a member covers), f (percent), members, bits of the best member.

    Members' columns are weighted by the mean information of the column and its neighbours.
    """
    members = seed_extend(spark, sf_dir)
    rows = motifs(spark, sf_dir).select("vec_id", "pfm", pfm.information(F.col("pfm")).alias("bits"))
    near = F.transform("bits", lambda b, i: pfm.total(F.slice("bits", F.greatest(i, F.lit(1)), F.least(i + 2, F.size("bits")) - F.greatest(i, F.lit(1)) + 1)) / (F.least(i + 2, F.size("bits")) - F.greatest(i, F.lit(1)) + 1))
    rows = members.join(rows.withColumn("w", near).withColumn("best", pfm.total(F.col("bits"))), "vec_id")
    turn = lambda c, r: F.when(F.col("dir") == 1, c).otherwise(r)
    cells = rows.select("cluster", "vec_id", "offset", "best", F.posexplode(F.arrays_zip(turn(F.col("pfm"), pfm.reverse(F.col("pfm"))).alias("f"), turn(F.col("w"), F.reverse("w")).alias("w"))).alias("i", "z"))
    cells = cells.select("cluster", "vec_id", "best", (F.col("offset") + F.col("i")).alias("at"), F.col("z.f").alias("f"), F.greatest(F.col("z.w"), F.lit(1e-9)).alias("w"))
    sums = cells.groupBy("cluster", "at").agg(*(F.sum(F.col("f")[k] * F.col("w")).alias(f"s{k}") for k in range(4)), F.sum("w").alias("w"))
    of = cells.groupBy("cluster").agg(F.min("at").alias("low"), F.count_distinct("vec_id").alias("members"), F.max("best").alias("best"))
    return sums.join(of, "cluster").select("cluster", (F.col("at") - F.col("low")).alias("p"), F.array(*(F.col(f"s{k}") / F.col("w") for k in range(4))).alias("f"), "members", "best")


@query()
def cluster_motifs(spark, sf_dir):
    """The matrix of each cluster that seed_extend finds."""
    return cluster_matrices(spark, sf_dir).select("cluster", (F.col("p") + 1).cast("long").alias("p"), *(F.round(F.col("f")[k], 5).alias(n) for k, n in enumerate("acgt")), "members")


@query()
def cluster_rank_found(spark, sf_dir):
    """Found clusters by their best member's information times the root of their size; ties: the least cluster."""
    rows = cluster_matrices(spark, sf_dir).groupBy("cluster").agg(F.first("members").alias("members"), F.max("best").alias("best"), F.count(F.lit(1)).alias("width"))
    return rows.select("cluster", "members", "width", F.round(F.col("best") * F.sqrt("members"), 6).alias("score"))


# Half a base's weight, in natural and in decimal logarithms.
NATURAL, DECIMAL = 0.6931, 0.301
# The background of a column that no motif covers, in percent.
FILL = "[21.86, 29.75, 26.26, 22.22]"


def filled(n):
    return f"flatten(list_transform(range(0, {n}), lambda i: {FILL}))"


LONG = "lambda v: CASE WHEN v > 75 THEN 75 + 3 * (v - 75) ELSE v END"
CORR = "(list_dot_product(x, y) - list_sum(x) * list_sum(y) / len(x)) / sqrt((list_dot_product(x, x) - list_sum(x) * list_sum(x) / len(x)) * (list_dot_product(y, y) - list_sum(y) * list_sum(y) / len(y)))"


@query(M + f""", v AS (SELECT vec_id, label, flatten(pfm) AS raw FROM m), c0 AS (SELECT label, i, avg(raw[i]) AS y FROM v, range(1, 65) t(i) GROUP BY ALL), c AS (SELECT label AS cluster, list_transform(list(y ORDER BY i), {LONG}) AS c FROM c0 GROUP BY label),
s AS (SELECT vec_id, list_transform(raw, {LONG}) AS z FROM v), d AS (SELECT vec_id, cluster, o, dir, c, CASE WHEN dir = 0 THEN z ELSE list_reverse(z) END AS z FROM s, c, range(-10, 11) t(o), (VALUES (0), (1)) w(dir)),
x AS (SELECT vec_id, cluster, o, dir, {filled('greatest(0, -o)')} || c || {filled('greatest(0, o)')} AS x, {filled('greatest(0, o)')} || z || {filled('greatest(0, -o)')} AS y FROM d),
r AS (SELECT vec_id, cluster, o, dir, 100 * (1 - {CORR}) AS distance FROM x)
SELECT vec_id, cluster, round(greatest(min(distance), 0), 4) AS distance FROM r GROUP BY vec_id, cluster""")
def kmeans_distance(spark, sf_dir):
    """Distance of every motif to every family's mean at the best offset and direction."""
    rows = flat(spark, sf_dir)
    means = rows.select("label", F.posexplode("pfm").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x")).groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"))
    shared = spark.sparkContext.broadcast([(r["label"], np.array(r["v"]).reshape(-1, 4)) for r in means.orderBy("label").collect()])  # one matrix a family

    def run(batches):
        for b in batches:
            x = np.array(b.column("flat").to_pylist(), float).reshape(b.num_rows, -1, 4)
            for label, centre in shared.value if len(x) else ():
                yield pa.record_batch([b.column("id"), pa.array(np.full(len(x), label)), pa.array(np.round(ops.distances(x, centre)[0], 4))], names=["vec_id", "cluster", "distance"])

    return percents(spark, sf_dir).mapInArrow(run, "vec_id long, cluster long, distance double")


@query()
def kmeans_full(spark, sf_dir):
    """k-means over alignments, with merged, trimmed and renewed centroids; tested against plain code."""
    return ops.kmeans_aligned(percents(spark, sf_dir), 10).select(F.col("id").alias("vec_id"), "cluster", F.round("distance", 4).alias("distance"), "offset", "dir")


@query()
def core_threshold_mc(spark, sf_dir, draws=10_000):
    """Score that a motif's core has to reach: the threshold less what the other columns give by chance in 99.9 of 100 draws,
    and 0.1; draws hang on the motif's id alone."""
    rows = motifs(spark, sf_dir).select("vec_id", pfm.logodds(F.col("pfm")).alias("m")).join(scan_core(spark, sf_dir), "vec_id").join(scan_threshold(spark, sf_dir), "vec_id")

    def run(batches):
        for b in batches:
            out = []
            for vec_id, m, core, threshold in zip(*(b.column(x).to_pylist() for x in ("vec_id", "m", "core_start", "threshold")), strict=True):
                rest = np.delete(np.array(m), np.s_[core - 1 : core + 7], axis=0)
                bases = np.random.default_rng([5, vec_id & 0xFFFFFFFF]).integers(0, 4, (draws, len(rest)))
                out.append(round(threshold - float(np.quantile(rest[np.arange(len(rest)), bases].sum(axis=1), 0.999)) - 0.1, 6))
            yield pa.record_batch([b.column("vec_id"), pa.array(out, pa.float64())], names=["vec_id", "core_threshold"])

    return rows.select("vec_id", "m", "core_start", "threshold").mapInArrow(run, "vec_id long, core_threshold double")


@query("SELECT vec_id FROM embeddings ORDER BY vec_id LIMIT 400")
def motif_cap(spark, sf_dir, most=400):
    """The first motifs of the file, as many as a search takes unless told otherwise."""
    return table(spark, sf_dir, "embeddings").select("vec_id").orderBy("vec_id").limit(most)


NATS = "(list_sum(list_transform(f, lambda x: CASE WHEN x > 0 THEN x / list_sum(f) * ln(x / list_sum(f)) ELSE 0 END)) + ln(4.0::DOUBLE))"


@query(M + f"SELECT vec_id, round(sum({NATS}), 6) AS nats FROM pos GROUP BY vec_id")
def pfm_info_nats(spark, sf_dir):
    """Information in nats."""
    return motifs(spark, sf_dir).select("vec_id", F.round(pfm.total(pfm.information(F.col("pfm"))) * float(np.log(2)), 6).alias("nats"))


def weight_letter(cell, drop):
    return f"substr('OACMGRSVTWYHKDBN', 1 + list_sum(list_transform(range(0, 4), lambda k: CASE WHEN {cell}[k + 1] >= list_max({cell}) - {drop} THEN (2 ** k)::INT ELSE 0 END))::INT, 1)"


@query(M + f", z AS (SELECT vec_id, p, l, {LOGODDS} AS z FROM pos) SELECT vec_id, string_agg({weight_letter('l', NATURAL)}, '' ORDER BY p) AS natural, string_agg({weight_letter('z', DECIMAL)}, '' ORDER BY p) AS decimal FROM z GROUP BY vec_id")
def pwm_consensus(spark, sf_dir):
    """Consensus from weights: bases within a factor of two of the best, in natural and in decimal logarithms."""
    rows = motifs(spark, sf_dir).select("vec_id", "logs", pfm.logodds(F.col("pfm")).alias("z"))
    return rows.select("vec_id", pfm.weight_consensus(F.col("logs"), NATURAL).alias("natural"), pfm.weight_consensus(F.col("z"), DECIMAL).alias("decimal"))


@query(M + """, c AS (SELECT vec_id, flatten(list_transform(pfm, lambda r: list_transform(r, lambda x: ln(x + 1) - list_sum(list_transform(r, lambda y: ln(y + 1))) / 4))) AS z FROM m),
o AS (SELECT vec_id, o, z[1:4 * (16 - o)] AS a, z[4 * o + 1:64] AS b FROM c, range(1, 5) t(o))
SELECT vec_id, round(greatest(0, max(list_dot_product(a, b) / sqrt(list_dot_product(a, a) * list_dot_product(b, b)))), 6) AS r FROM o GROUP BY vec_id""")
def self_similarity_cluster(spark, sf_dir):
    """Self-similarity as clusters are told by: shifts of up to four columns."""
    return motifs(spark, sf_dir).select("vec_id", F.round(pfm.self_similarity(F.col("pfm"), offsets=(1, 2, 3, 4)), 6).alias("r"))


@query(M + """, e AS (SELECT 'M' || vec_id AS name, pfm FROM m WHERE label < 5 AND vec_id % 7 <> 0 UNION ALL SELECT 'R' || vec_id, list_reverse(list_transform(pfm, lambda r: list_reverse(r))) FROM m WHERE label >= 5
UNION ALL SELECT 'M' || vec_id, pfm FROM m WHERE label >= 3 AND NOT (label < 5 AND vec_id % 7 <> 0))
SELECT name, round(pfm[1][1], 6) AS first, round(pfm[16][4], 6) AS last FROM e""")
def motif_edit(spark, sf_dir):
    """A library edited: some motifs deleted by exact name, some reversed under new names, others appended unless the name
    is there already."""
    rows = motifs(spark, sf_dir)
    named = lambda p, df: df.select(F.concat(F.lit(p), F.col("vec_id").cast("string")).alias("name"), "pfm")
    gone = named("M", rows.where("vec_id % 7 = 0")).select("name")
    kept = named("M", rows.where("label < 5")).join(gone, "name", "left_anti")
    turned = named("R", rows.where("label >= 5")).withColumn("pfm", pfm.reverse(F.col("pfm")))
    more = named("M", rows.where("label >= 3")).join(kept.select("name"), "name", "left_anti")
    out = kept.unionByName(turned).unionByName(more)
    return out.select("name", F.round(F.col("pfm")[0][0], 6).alias("first"), F.round(F.col("pfm")[15][3], 6).alias("last"))


@query("""WITH r AS (SELECT vec_id, p, embedding[4 * p + 1:4 * p + 4] AS r FROM embeddings, range(0, 16) t(p)), v AS (SELECT vec_id, p + 1 AS p, CASE WHEN list_min(r) < 0 THEN 'negative cell' WHEN list_max(r) <= 0 THEN 'empty row' ELSE '' END AS problem FROM r)
SELECT vec_id, problem, count(*) AS n_rows, min(p) AS first_row FROM v WHERE problem <> '' GROUP BY ALL""")
def validate_motifs(spark, sf_dir):
    """Rows of raw matrices that an upload is refused for: cells below zero, or none above; told by motif."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("p"), "embedding")
    rows = rows.withColumn("r", F.slice("embedding", 4 * F.col("p") + 1, F.lit(4)))
    problem = F.when(F.array_min("r") < 0, "negative cell").when(F.array_max("r") <= 0, "empty row")
    return rows.withColumn("problem", problem).where("problem is not null").groupBy("vec_id", "problem").agg(F.count(F.lit(1)).alias("n_rows"), (F.min("p") + 1).cast("long").alias("first_row"))
