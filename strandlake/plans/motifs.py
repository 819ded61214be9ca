"""Queries over motifs: the vectors as 16 x 4 matrices, and the consensus library."""

from pyspark.sql import functions as F

from ..functions import pfm, seq
from ..operators import motifs as ops
from .tables import LIBRARY, library, table

QUERIES, SQL = {}, {}

M = """WITH m0 AS (SELECT vec_id, label, list_transform(range(0, 16), lambda p: list_transform(range(1, 5), lambda k: 8.0::DOUBLE * embedding[4 * p + k]::DOUBLE)) AS raw FROM embeddings),
m1 AS (SELECT vec_id, label, list_transform(raw, lambda r: list_transform(r, lambda x: x - list_sum(r) / 4)) AS logs FROM m0),
m AS (SELECT vec_id, label, logs, list_transform(logs, lambda r: list_transform(r, lambda x: 100 * exp(x) / list_sum(list_transform(r, lambda y: exp(y))))) AS pfm FROM m1),
pos AS (SELECT vec_id, label, p, logs[p] AS l, pfm[p] AS f FROM m, range(1, 17) t(p)) """
BITS = "(2 + list_sum(list_transform(f, lambda x: CASE WHEN x > 0 THEN x / list_sum(f) * log2(x / list_sum(f)) ELSE 0 END)))"


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def motifs(spark, sf_dir):
    """vec_id, label, logs, pfm."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"), pfm.from_vector(F.col("embedding")).alias("logs"))
    return rows.withColumn("pfm", pfm.percent(F.col("logs")))


def by_row(rows, matrix, digits=6):
    """vec_id, p, a, c, g, t of a matrix column."""
    return rows.select("vec_id", F.posexplode(matrix).alias("p", "r")).select("vec_id", (F.col("p") + 1).cast("long").alias("p"), *(F.round(F.col("r")[k], digits).alias(n) for k, n in enumerate("acgt")))


def cells(row):
    return ", ".join(f"round({row}[{k + 1}], 6) AS {n}" for k, n in enumerate("acgt"))


@query(M + f"SELECT vec_id, p, {cells('f')} FROM pos")
def pwm_percent(spark, sf_dir):
    return by_row(motifs(spark, sf_dir), F.col("pfm"))


@query(M + f", c AS (SELECT vec_id, p, list_transform(f, lambda x: ln(x + 1)) AS g FROM pos) SELECT vec_id, p, {cells('list_transform(g, lambda x: x - list_sum(g) / 4)')} FROM c")
def pwm_centered(spark, sf_dir):
    return by_row(motifs(spark, sf_dir), pfm.centred(F.col("pfm")))


LOGODDS = "list_transform(f, lambda x: log10(4 * (x + CASE WHEN list_sum(f) / 100 > 1 THEN 1 ELSE list_sum(f) / 100 END) / (list_sum(f) + 4 * CASE WHEN list_sum(f) / 100 > 1 THEN 1 ELSE list_sum(f) / 100 END)))"


@query(M + f"SELECT vec_id, p, {cells(LOGODDS)} FROM (SELECT vec_id, p, list_transform(f, lambda x: round(x, 3)) AS f FROM pos)")
def pwm_logodds(spark, sf_dir):
    rounded = F.transform("pfm", lambda r: F.transform(r, lambda x: F.round(x, 3)))
    return by_row(motifs(spark, sf_dir).withColumn("pfm", rounded), pfm.logodds(F.col("pfm")))


@query(M + f"SELECT vec_id, p, {cells('list_reverse(f)')} FROM (SELECT vec_id, 17 - p AS p, f FROM pos)")
def pfm_reverse(spark, sf_dir):
    return by_row(motifs(spark, sf_dir), pfm.reverse(F.col("pfm")))


@query(M + f"SELECT vec_id, round(sum({BITS}), 6) AS bits, round(max({BITS}), 6) AS most FROM pos GROUP BY vec_id")
def pfm_info(spark, sf_dir):
    rows = motifs(spark, sf_dir).select("vec_id", pfm.information(F.col("pfm")).alias("b"))
    return rows.select("vec_id", F.round(pfm.total(F.col("b")), 6).alias("bits"), F.round(F.array_max("b"), 6).alias("most"))


def letter(test):
    return f"substr('{seq.IUPAC}', 1 + list_sum(list_transform(range(0, 4), lambda k: CASE WHEN {test} THEN (2 ** k)::INT ELSE 0 END))::INT, 1)"


@query(M + f""", l AS (SELECT vec_id, string_agg({letter('f[k + 1] > list_max(f) * 0.5')}, '' ORDER BY p) AS pattern, string_agg({letter('f[k + 1] >= list_max(f) * 0.25')}, '' ORDER BY p) AS loose FROM pos GROUP BY vec_id)
SELECT vec_id, pattern, loose, reverse(translate(pattern, '{seq.IUPAC_FROM}', '{seq.IUPAC_TO}')) AS backward FROM l""")
def pfm_consensus(spark, sf_dir):
    m = F.col("pfm")
    rows = motifs(spark, sf_dir).select("vec_id", pfm.consensus(m).alias("pattern"), pfm.consensus(m, 0.25, strict=False).alias("loose"))
    return rows.withColumn("backward", seq.revcomp_consensus(F.col("pattern")))


@query(M + """, s AS (SELECT vec_id, p, list_reverse_sort(list_transform(range(1, 5), lambda k: {'x': f[k], 'i': -k})) AS s FROM pos),
l AS (SELECT vec_id, p, CASE WHEN s[1].x >= 2 * s[2].x THEN substr('ACGT', -s[1].i, 1) WHEN s[1].x >= 1.3 * s[2].x THEN substr('acgt', -s[1].i, 1)
  WHEN s[2].x >= 2 * s[3].x THEN CASE least(-s[1].i, -s[2].i) * 10 + greatest(-s[1].i, -s[2].i) WHEN 12 THEN 'm' WHEN 13 THEN 'r' WHEN 14 THEN 'w' WHEN 23 THEN 's' WHEN 24 THEN 'y' ELSE 'k' END ELSE '_' END AS c FROM s)
SELECT vec_id, string_agg(c, '' ORDER BY p) AS shown FROM l GROUP BY vec_id""")
def display_consensus(spark, sf_dir):
    return motifs(spark, sf_dir).select("vec_id", pfm.display(F.col("pfm")).alias("shown"))


@query(M + "SELECT vec_id, p, round(list_max(f) / greatest(list_min(f), 1), 6) AS ratio FROM pos")
def row_ratio(spark, sf_dir):
    rows = motifs(spark, sf_dir).select("vec_id", F.posexplode("pfm").alias("p", "r"))
    return rows.select("vec_id", (F.col("p") + 1).cast("long").alias("p"), F.round(pfm.row_ratio(F.col("r")), 6).alias("ratio"))


@query(M + f"SELECT vec_id, p, {cells(f'list_transform(f, lambda x: x / 100 * {BITS} * 32)').replace('6)', '4)')} FROM pos")
def logo_heights(spark, sf_dir):
    """Height of each letter of a logo in pixels."""
    m = F.zip_with("pfm", pfm.information(F.col("pfm")), lambda r, b: F.transform(r, lambda x: x / 100 * b * 32))
    return by_row(motifs(spark, sf_dir), m, 4)


@query(M + """, c AS (SELECT vec_id, flatten(list_transform(pfm, lambda r: list_transform(r, lambda x: ln(x + 1) - list_sum(list_transform(r, lambda y: ln(y + 1))) / 4))) AS z FROM m),
o AS (SELECT vec_id, o, z[1:4 * (16 - o)] AS a, z[4 * o + 1:64] AS b FROM c, range(1, 4) t(o))
SELECT vec_id, round(greatest(0, max(list_dot_product(a, b) / sqrt(list_dot_product(a, a) * list_dot_product(b, b)))), 6) AS r FROM o GROUP BY vec_id""")
def self_similarity(spark, sf_dir):
    return motifs(spark, sf_dir).select("vec_id", F.round(pfm.self_similarity(F.col("pfm")), 6).alias("r"))


@query(M + f"SELECT vec_id, p - 2 AS p, {cells('f')} FROM pos WHERE p BETWEEN 3 AND 12")
def motif_trim(spark, sf_dir):
    return by_row(motifs(spark, sf_dir), F.slice("pfm", 3, 10))


@query("WITH " + LIBRARY + " SELECT motif, i AS p, " + ", ".join(f"CASE WHEN substr(pattern, i, 1) = '{b}' THEN 100 ELSE 0 END::BIGINT AS {b.lower()}" for b in "ACGT") + " FROM lib, range(1, 9) t(i)")
def consensus_to_pfm(spark, sf_dir):
    rows = library(spark, sf_dir).select("motif", F.posexplode(pfm.from_consensus(F.col("pattern"))).alias("p", "r"))
    return rows.select("motif", (F.col("p") + 1).cast("long").alias("p"), *(F.col("r")[k].alias(n) for k, n in enumerate("acgt")))


@query(M + f""", i AS (SELECT vec_id, list({BITS} ORDER BY p) AS b FROM pos GROUP BY vec_id), w AS (SELECT vec_id, s, round(list_sum(b[s:s + 7]), 6) AS bits FROM i, range(1, 10) t(s))
SELECT vec_id, min_by(s, (-bits, s)) AS core_start, max(bits) AS core_bits FROM w GROUP BY vec_id""")
def scan_core(spark, sf_dir):
    """The 8 columns in a row with the most information; ties: the first."""
    rows = motifs(spark, sf_dir).select("vec_id", pfm.information(F.col("pfm")).alias("b"))
    sums = F.transform(F.sequence(F.lit(1), F.lit(9)), lambda s: F.struct(F.round(pfm.total(F.slice("b", s, F.lit(8))), 6).alias("bits"), (-s).alias("s")))
    best = F.array_max(sums)
    return rows.select("vec_id", (-best["s"]).cast("long").alias("core_start"), best["bits"].alias("core_bits"))


@query(M + f""", z AS (SELECT vec_id, {LOGODDS} AS z FROM pos), v AS (SELECT vec_id, sum(list_sum(z)) / 4 AS mean, sum((list_dot_product(z, z) - list_sum(z) * list_sum(z) / 4) / 3) AS var, sum(list_max(z)) AS most FROM z GROUP BY vec_id)
SELECT vec_id, round(greatest(least(mean + (0.968 - 0.3235 * ln(4 * 5 / 10000) - 0.0037336 * ln(4 * 5 / 10000) * ln(4 * 5 / 10000)) * sqrt(var), most * 0.75), 1.301), 6) AS threshold FROM v""")
def scan_threshold(spark, sf_dir):
    """Score that about five hits in 10,000 bases of chance reach, from the mean and variance of the matrix."""
    z = F.transform(pfm.logodds(F.col("pfm")), lambda r: F.struct((pfm.total(r) / 4).alias("m"), ((pfm.dot(r, r) - pfm.total(r) * pfm.total(r) / 4) / 3).alias("v"), F.array_max(r).alias("x")))
    rows = motifs(spark, sf_dir).select("vec_id", z.alias("z"))
    of = lambda k: pfm.total(F.transform("z", lambda r: r[k]))
    share = F.log(F.lit((2 + 10 / 5) * 5 / 10000))
    limit = of("m") + (0.968 - 0.3235 * share - 0.0037336 * share * share) * F.sqrt(of("v"))
    return rows.select("vec_id", F.round(F.greatest(F.least(limit, of("x") * 0.75), F.lit(1.301)), 6).alias("threshold"))


def flat(spark, sf_dir):
    return motifs(spark, sf_dir).select(F.col("vec_id").alias("id"), "label", F.flatten("logs").alias("flat"), F.flatten("pfm").alias("pfm"))


def similar_sql(a, b, on, match):
    """SQL of similar_pairs; backward motifs are whole lists reversed."""
    prefix = " OR ".join(f"(n >= {k} AND list_dot_product(x[1:{4 * k}], y[1:{4 * k}]) < 0)" for k in range(4, 17))
    return f""", z AS (SELECT vec_id AS id, label, flatten(logs) AS z FROM m), d AS (SELECT a.id AS a, b.id AS b, v.dir, o.o AS o, 16 - abs(o.o) AS n, a.z AS az, CASE WHEN v.dir = 1 THEN b.z ELSE list_reverse(b.z) END AS bz
  FROM z a JOIN z b ON {on}, (VALUES (1), (-1)) v(dir), (VALUES (-2), (-1), (0), (1)) o(o)),
x AS (SELECT a, b, dir, o, n, az[4 * greatest(0, o) + 1:4 * (greatest(0, o) + n)] AS x, bz[4 * greatest(0, -o) + 1:4 * (greatest(0, -o) + n)] AS y FROM d),
r AS (SELECT a, b, dir, o, n, list_dot_product(x, y) / sqrt(list_dot_product(x, x) * list_dot_product(y, y)) AS r FROM x WHERE NOT ({prefix})),
w AS (SELECT *, CASE WHEN r >= {match} THEN r + (1 - r) * 0.5 * (1 - 6 / n) + 10 ELSE r END AS w FROM r),
k AS (SELECT a, b, dir, max_by(r, (w, -o)) AS r, max_by(o, (w, -o)) AS o FROM w GROUP BY a, b, dir),
pairs AS (SELECT a, b, max_by(r, (r, dir)) AS r, max_by(dir, (r, dir))::BIGINT AS dir, max_by(o, (r, dir))::BIGINT AS "offset" FROM k GROUP BY a, b HAVING max(r) >= {match})"""


@query(M + similar_sql("a", "b", "a.id < b.id", 0.5) + " SELECT a, b, round(r, 6) AS r, dir FROM pairs")
def motif_pairs(spark, sf_dir):
    """All pairs of motifs that are alike at 0.5 or more, at their best offset and direction."""
    return ops.similar_pairs(flat(spark, sf_dir).select("id", "flat"), None, 0.5).select("a", "b", F.round("r", 6).alias("r"), "dir")


@query(M + similar_sql("a", "b", "a.label < 5 AND b.label >= 5", 0.5) + ' SELECT a, b, round(r, 6) AS r, dir, "offset", row_number() OVER (PARTITION BY a ORDER BY round(r, 6) DESC, b) AS place FROM pairs')
def motif_compare(spark, sf_dir):
    """One library against another, best matches of each motif first."""
    from pyspark.sql import Window

    rows = flat(spark, sf_dir)
    pairs = ops.similar_pairs(rows.where("label < 5").select("id", "flat"), rows.where("label >= 5").select("id", "flat"), 0.5).withColumn("r", F.round("r", 6))
    return pairs.withColumn("place", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("r"), "b")).cast("long"))


@query(M + """, z AS (SELECT vec_id, flatten(logs) AS z FROM m), o AS (SELECT vec_id, 16 - abs(o) AS n, z[4 * greatest(0, o) + 1:4 * (greatest(0, o) + 16 - abs(o))] AS x, list_reverse(z)[4 * greatest(0, -o) + 1:4 * (greatest(0, -o) + 16 - abs(o))] AS y FROM z, range(-2, 2) t(o))
SELECT vec_id, round(max(list_dot_product(x, y) / sqrt(list_dot_product(x, x) * list_dot_product(y, y))), 6) AS r, round(max(list_dot_product(x, y) / sqrt(list_dot_product(x, x) * list_dot_product(y, y))), 6) > 0.7 AS palindrome FROM o GROUP BY vec_id""")
def palindromes(spark, sf_dir):
    """How like its own reverse complement each motif is, at the best offset."""
    rows, best = flat(spark, sf_dir), None
    for o in (-2, -1, 0, 1):
        n = 4 * (16 - abs(o))
        a, b = F.slice("flat", 4 * max(0, o) + 1, n), F.slice(F.reverse("flat"), 4 * max(0, -o) + 1, n)
        r = pfm.dot(a, b) / F.sqrt(pfm.dot(a, a) * pfm.dot(b, b))
        best = r if best is None else F.greatest(best, r)
    return rows.select(F.col("id").alias("vec_id"), F.round(best, 6).alias("r")).withColumn("palindrome", F.col("r") > 0.7)


@query(M.replace("WITH m0", "WITH RECURSIVE m0") + similar_sql("a", "b", "a.id < b.id", 0.5) + """, e AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), reach(id, other) AS (SELECT vec_id, vec_id FROM m UNION SELECT r.id, e.b FROM reach r JOIN e ON e.a = r.other)
SELECT id AS vec_id, min(other) AS cluster FROM reach GROUP BY id""")
def motif_components(spark, sf_dir):
    rows = flat(spark, sf_dir).select("id", "flat")
    return ops.groups(rows, ops.similar_pairs(rows, None, 0.5)).select(F.col("id").alias("vec_id"), F.col("group").alias("cluster"))


@query(M + f", w AS (SELECT label, p, f, {BITS} AS b FROM pos) SELECT label, p, " + ", ".join(f"round(sum(f[{k + 1}] * b) / sum(b), 5) AS {n}" for k, n in enumerate("acgt")) + ", count(*) AS members FROM w GROUP BY label, p")
def cluster_consensus(spark, sf_dir):
    """Matrix of each cluster: its members' columns weighted by their information."""
    rows = motifs(spark, sf_dir).select("label", F.posexplode(F.arrays_zip("pfm", pfm.information(F.col("pfm")).alias("b"))).alias("p", "z")).select("label", "p", F.col("z.pfm").alias("f"), F.col("z.b").alias("b"))
    return rows.groupBy("label", (F.col("p") + 1).cast("long").alias("p")).agg(*(F.round(F.sum(F.col("f")[k] * F.col("b")) / F.sum("b"), 5).alias(n) for k, n in enumerate("acgt")), F.count(F.lit(1)).alias("members"))


@query(M + ", t AS (SELECT label, vec_id, CASE WHEN vec_id % 2 = 0 THEN p + vec_id % 3 ELSE 17 - p + vec_id % 3 END AS p, CASE WHEN vec_id % 2 = 0 THEN f ELSE list_reverse(f) END AS f FROM pos) SELECT label, p, " + ", ".join(f"round(sum(f[{k + 1}]), 5) AS {n}" for k, n in enumerate("acgt")) + " FROM t GROUP BY label, p")
def member_merge(spark, sf_dir):
    """Members added up at their own offset (id mod 3) and direction (odd ids reversed)."""
    m = F.when(F.col("vec_id") % 2 == 0, F.col("pfm")).otherwise(pfm.reverse(F.col("pfm")))
    rows = motifs(spark, sf_dir).select("label", "vec_id", F.posexplode(m).alias("p", "f"))
    return rows.groupBy("label", (F.col("p") + 1 + F.col("vec_id") % 3).alias("p")).agg(*(F.round(F.sum(F.col("f")[k]), 5).alias(n) for k, n in enumerate("acgt")))


@query(M + """, v AS (SELECT vec_id, label, flatten(pfm) AS x FROM m), c0 AS (SELECT label, i, avg(x[i]) AS y FROM v, range(1, 65) t(i) GROUP BY ALL), c AS (SELECT label, list(y ORDER BY i) AS y FROM c0 GROUP BY label),
d AS (SELECT vec_id, c.label, round(100 * (1 - list_dot_product(list_transform(x, lambda u: u - list_sum(x) / 64), list_transform(y, lambda u: u - list_sum(y) / 64)) / sqrt(list_dot_product(list_transform(x, lambda u: u - list_sum(x) / 64), list_transform(x, lambda u: u - list_sum(x) / 64)) * list_dot_product(list_transform(y, lambda u: u - list_sum(y) / 64), list_transform(y, lambda u: u - list_sum(y) / 64)))), 5) AS dist FROM v, c)
SELECT vec_id, min_by(label, (dist, label))::BIGINT AS cluster, min(dist) AS distance FROM d GROUP BY vec_id""")
def kmeans_step(spark, sf_dir):
    """Every motif to the nearest of its families' means."""
    import numpy as np

    rows = flat(spark, sf_dir)
    means = rows.select("label", F.posexplode("pfm").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x")).groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v")).orderBy("label").collect()
    labels = F.array(*(F.lit(r["label"]) for r in means))
    found = ops.assign(rows.select("id", F.col("pfm").alias("flat")), np.array([[c["x"] for c in r["v"]] for r in means]))
    return found.select(F.col("id").alias("vec_id"), F.element_at(labels, (F.col("cluster") + 1).cast("int")).alias("cluster"), F.round("distance", 5).alias("distance"))


@query()
def kmeans(spark, sf_dir):
    """Full k-means; its result hangs on the seeds, so only its invariants are tested."""
    rows = flat(spark, sf_dir).select("id", F.col("pfm").alias("flat"))
    return ops.kmeans(rows, 10).select(F.col("id").alias("vec_id"), "cluster", F.round("distance", 4).alias("distance"))


@query(M + f", b AS (SELECT label, vec_id, sum({BITS}) AS bits FROM pos GROUP BY ALL), r AS (SELECT label, count(*) AS n, round(max(bits) * sqrt(count(*)), 6) AS score FROM b GROUP BY label) SELECT label, n, score, row_number() OVER (ORDER BY score DESC, label) AS place FROM r")
def cluster_rank(spark, sf_dir):
    """Families by the information of their best member times the root of their size."""
    from pyspark.sql import Window

    rows = motifs(spark, sf_dir).select("label", pfm.total(pfm.information(F.col("pfm"))).alias("bits"))
    rows = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("bits") * F.sqrt(F.count(F.lit(1))), 6).alias("score"))
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "label")).cast("long"))


@query(M + f", z AS (SELECT vec_id, {LOGODDS} AS z FROM pos) SELECT vec_id, round(least(1.301 + 1.5, 0.9 * sum(list_max(z))), 6) AS threshold FROM z GROUP BY vec_id")
def threshold_shift(spark, sf_dir):
    """A threshold raised by 1.5, at most nine tenths of the best score."""
    best = pfm.total(F.transform(pfm.logodds(F.col("pfm")), lambda r: F.array_max(r)))
    return motifs(spark, sf_dir).select("vec_id", F.round(F.least(F.lit(1.301 + 1.5), 0.9 * best), 6).alias("threshold"))
