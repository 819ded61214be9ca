"""Queries over motif hits, regions and attributes."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import seq, stats
from ..operators import hits as ops
from .tables import HITS, LIBRARY, SEQ, hits, library, rc, sequences, spread, table

QUERIES, SQL = {}, {}
H = "WITH " + HITS + " "


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def erfc_sql(x):
    poly = "0.17087277"
    for c in ("-0.82215223", "1.48851587", "-1.13520398", "0.27886807", "-0.18628806", "0.09678418", "0.37409196", "1.00002368", "-1.26551223"):
        poly = f"(({poly})::DOUBLE * t + {c}::DOUBLE)"
    return f"(SELECT CASE WHEN q >= 0 THEN r ELSE 2 - r END FROM (SELECT q, t * exp(-q * q + {poly}) AS r FROM (SELECT q, 1 / (1 + 0.5::DOUBLE * abs(q)) AS t FROM (SELECT ({x})::DOUBLE AS q))))"


@query(H + "SELECT motif, strand AS series, (floor((start + len + 0.5) / 100) * 100 + 50)::BIGINT AS bin_mid, count(*) AS n FROM hits GROUP BY ALL")
def distrib_histogram(spark, sf_dir):
    return ops.bins(hits(spark, sf_dir)).groupBy("motif", F.col("strand").alias("series"), "bin_mid").agg(F.count(F.lit(1)).alias("n"))


@query(H + """, r AS (SELECT *, row_number() OVER (PARTITION BY motif ORDER BY score DESC, event_id) AS k, count(*) OVER (PARTITION BY motif) AS c FROM hits)
SELECT motif, '1/' || d AS series, (floor((start + len + 0.5) / 100) * 100 + 50)::BIGINT AS bin_mid, count(*) AS n FROM r, (VALUES (2), (4), (8)) v(d) WHERE k <= c // d + 1 GROUP BY ALL""")
def distrib_quantiles(spark, sf_dir):
    rows, out = hits(spark, sf_dir), None
    for d in (2, 4, 8):
        one = ops.bins(ops.best_share(rows, d)).groupBy("motif", F.lit(f"1/{d}").alias("series"), "bin_mid").agg(F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


MOTIFS = ("click", "error", "purchase", "signup", "view")


@query(H + "SELECT seq_id, " + ", ".join(f"count(*) FILTER (WHERE motif = '{m}') AS \"{m}\"" for m in MOTIFS) + " FROM hits GROUP BY seq_id")
def abundance(spark, sf_dir):
    return hits(spark, sf_dir).groupBy("seq_id").pivot("motif", list(MOTIFS)).count().na.fill(0)


@query(H + "SELECT motif, count(*) FILTER (WHERE strand = '+') AS forward, count(*) FILTER (WHERE strand = '-') AS backward, count(*) AS n, round(max(score), 6) AS best FROM hits GROUP BY motif")
def motif_totals(spark, sf_dir):
    of = lambda s: F.count(F.when(F.col("strand") == s, 1))
    return hits(spark, sf_dir).groupBy("motif").agg(of("+").alias("forward"), of("-").alias("backward"), F.count(F.lit(1)).alias("n"), F.round(F.max("score"), 6).alias("best"))


@query(H + "SELECT event_id, seq_id, start, strand, score, floor(100000 * pow(10, -score)) / 100000 AS p FROM hits WHERE motif = 'click' ORDER BY score DESC, event_id LIMIT 2000")
def motif_hits_topn(spark, sf_dir):
    """The best 2,000 hits of a motif, as its page shows them, with the p-value of the score."""
    rows = hits(spark, sf_dir).where("motif = 'click'").orderBy(F.desc("score"), "event_id").limit(2000)
    return rows.select("event_id", "seq_id", "start", "strand", "score", (F.floor(100000 * F.pow(F.lit(10.0), -F.col("score"))) / 100000).alias("p"))


@query(H + "SELECT seq_id, row_number() OVER (PARTITION BY seq_id ORDER BY start, motif, event_id) AS n, motif, start, strand, score FROM hits")
def hits_of_sequence(spark, sf_dir):
    w = Window.partitionBy("seq_id").orderBy("start", "motif", "event_id")
    return hits(spark, sf_dir).select("seq_id", F.row_number().over(w).cast("long").alias("n"), "motif", "start", "strand", "score")


@query(H + """, m AS (SELECT *, max(start + len) OVER (PARTITION BY seq_id ORDER BY start, len ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM hits),
g AS (SELECT *, sum(CASE WHEN before IS NULL OR start > before THEN 1 ELSE 0 END) OVER (PARTITION BY seq_id ORDER BY start, len ROWS UNBOUNDED PRECEDING) AS span FROM m)
SELECT seq_id, min(start) AS start, max(start + len) AS "end", count(*) AS n FROM g GROUP BY seq_id, span""")
def hit_spans(spark, sf_dir):
    return ops.spans(hits(spark, sf_dir))


ORDERS = "coord AS (SELECT o_custkey AS seq_id, count(*) AS n_regions, min(o_orderkey) AS first_region FROM orders GROUP BY 1)"


@query(H + f", {ORDERS} SELECT h.seq_id, h.n, coalesce(n_regions, 0) AS n_regions, coalesce(first_region, -1) AS first_region, coalesce(quality, -1)::BIGINT AS quality, coalesce(toxic, -1)::BIGINT AS toxic FROM (SELECT seq_id, count(*) AS n FROM hits GROUP BY 1) h LEFT JOIN coord c USING (seq_id) LEFT JOIN labels l ON l.doc_id = h.seq_id")
def sequence_summary(spark, sf_dir):
    """Hits of each sequence with its regions and attributes, where it has any."""
    n = hits(spark, sf_dir).groupBy("seq_id").agg(F.count(F.lit(1)).alias("n"))
    regions = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("seq_id")).agg(F.count(F.lit(1)).alias("n_regions"), F.min("o_orderkey").alias("first_region"))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("seq_id"), "quality", "toxic")
    fill = lambda c, v: F.coalesce(F.col(c).cast("long"), F.lit(v).cast("long")).alias(c)
    return n.join(regions, "seq_id", "left").join(labels, "seq_id", "left").select("seq_id", "n", fill("n_regions", 0), fill("first_region", -1), fill("quality", -1), fill("toxic", -1))


def predicates(rows):
    """Per sequence: hits of two motifs that meet their conditions."""
    return rows.groupBy("seq_id").agg(
        F.count(F.when((F.col("motif") == "click") & (F.col("score") >= 2) & (F.col("start") < 1000), 1)).alias("a"),
        F.count(F.when((F.col("motif") == "error") & (F.col("strand") == "+"), 1)).alias("b"),
    )


PREDICATES = "pred AS (SELECT seq_id, count(*) FILTER (WHERE motif = 'click' AND score >= 2 AND start < 1000) AS a, count(*) FILTER (WHERE motif = 'error' AND strand = '+') AS b FROM hits GROUP BY 1)"


@query(H + f", {PREDICATES} SELECT * FROM pred WHERE a >= 4 AND b >= 5")
def search_and(spark, sf_dir):
    return predicates(hits(spark, sf_dir)).where("a >= 4 AND b >= 5")


@query(H + f", {PREDICATES} SELECT * FROM pred WHERE a >= 6 OR b >= 10")
def search_or(spark, sf_dir):
    return predicates(hits(spark, sf_dir)).where("a >= 6 OR b >= 10")


@query(H + "SELECT a.seq_id, count(*) AS n, min(abs(a.start - b.start)) AS nearest FROM hits a JOIN hits b ON a.seq_id = b.seq_id AND a.motif = 'click' AND b.motif = 'error' AND abs(a.start - b.start) <= 30 GROUP BY 1")
def search_dist(spark, sf_dir):
    """Sequences with hits of two motifs within 30 bases, in either order."""
    rows = hits(spark, sf_dir).select("seq_id", "motif", "start")
    a, b = (rows.where(F.col("motif") == m) for m in ("click", "error"))
    gap = lambda x: x.select("seq_id", (F.col("b_start") - F.col("a_start")).alias("gap"))
    both = gap(ops.near_pairs(a, b, 30)).unionByName(gap(ops.near_pairs(b, a, 30)).where("gap > 0"))
    return both.groupBy("seq_id").agg(F.count(F.lit(1)).alias("n"), F.min("gap").alias("nearest"))


PAIRS = "p AS (SELECT a.seq_id, least(a.motif, b.motif) AS m1, greatest(a.motif, b.motif) AS m2, a.strand AS s1, b.strand AS s2, b.start - a.start AS gap FROM hits a JOIN hits b ON a.seq_id = b.seq_id AND b.start - a.start BETWEEN 0 AND 50 AND (a.start < b.start OR a.event_id < b.event_id))"


@query(H + f", {PAIRS} SELECT m1, m2, count(*) AS n FROM p GROUP BY 1, 2 HAVING count(*) >= 5")
def hit_pairs(spark, sf_dir):
    """Pairs of motifs whose hits lie within 50 bases at least 5 times."""
    m = F.col("a_motif"), F.col("b_motif")
    return ops.later_pairs(hits(spark, sf_dir)).groupBy(F.least(*m).alias("m1"), F.greatest(*m).alias("m2")).agg(F.count(F.lit(1)).alias("n")).where("n >= 5")


@query(H + f", {PAIRS}, f AS (SELECT motif, count(*) AS c FROM hits GROUP BY 1), g AS (SELECT m1, m2, s1 = s2 AS same_strand, gap, count(*) AS n FROM p GROUP BY ALL) SELECT m1, m2, same_strand, gap, n, round(n / least(a.c, b.c), 6) AS share FROM g JOIN f a ON a.motif = m1 JOIN f b ON b.motif = m2 WHERE n >= 5 AND n >= 0.01 * least(a.c, b.c)")
def pair_offsets(spark, sf_dir):
    """How often two motifs stand at one distance, against the rarer of them."""
    rows = hits(spark, sf_dir)
    f = rows.groupBy("motif").agg(F.count(F.lit(1)).alias("c"))
    m = F.col("a_motif"), F.col("b_motif")
    g = ops.later_pairs(rows).groupBy(F.least(*m).alias("m1"), F.greatest(*m).alias("m2"), (F.col("a_strand") == F.col("b_strand")).alias("same_strand"), (F.col("b_start") - F.col("a_start")).alias("gap")).agg(F.count(F.lit(1)).alias("n"))
    g = g.join(f.select(F.col("motif").alias("m1"), F.col("c").alias("c1")), "m1").join(f.select(F.col("motif").alias("m2"), F.col("c").alias("c2")), "m2")
    rare = F.least("c1", "c2")
    return g.where((F.col("n") >= 5) & (F.col("n") >= 0.01 * rare)).select("m1", "m2", "same_strand", "gap", "n", F.round(F.col("n") / rare, 6).alias("share"))


CLASH = "(a.score > b.score OR a.score = b.score AND (a.start < b.start OR a.start = b.start AND (a.motif < b.motif OR a.motif = b.motif AND a.event_id < b.event_id)))"


@query(H + f"""SELECT event_id, motif, seq_id, start, score FROM hits b WHERE NOT EXISTS (SELECT 1 FROM hits a WHERE a.seq_id = b.seq_id AND a.event_id <> b.event_id AND {CLASH}
AND least(a.start + a.len, b.start + b.len) > greatest(a.start, b.start) AND (a.motif = b.motif OR 4 * (least(a.start + a.len, b.start + b.len) - greatest(a.start, b.start)) > least(a.len, b.len)))""")
def hits_resolved(spark, sf_dir):
    return ops.resolve(hits(spark, sf_dir)).select("event_id", "motif", "seq_id", "start", "score")


@query(H + "SELECT d.doc_id AS seq_id, coalesce(h.motif, 'NONE') AS motif, coalesce(h.n, 0) AS n FROM documents d LEFT JOIN (SELECT seq_id, motif, count(*) AS n FROM hits GROUP BY 1, 2) h ON h.seq_id = d.doc_id")
def hits_none(spark, sf_dir):
    """Hits of every sequence by motif, with a NONE row where there is no hit."""
    n = hits(spark, sf_dir).groupBy("seq_id", "motif").agg(F.count(F.lit(1)).alias("n"))
    ids = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq_id"))
    return ids.join(n, "seq_id", "left").select("seq_id", F.coalesce("motif", F.lit("NONE")).alias("motif"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query("SELECT d.doc_id AS seq_id, d.source, length(d.text) AS n FROM documents d WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def subset_semi(spark, sf_dir):
    names = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return table(spark, sf_dir, "documents").join(names, "doc_id", "left_semi").select(F.col("doc_id").alias("seq_id"), "source", F.length("text").cast("long").alias("n"))


REGIONS = ((0, 100), (100, 300), (250, 1000))


@query("WITH " + SEQ + ", reg(a, b) AS (VALUES " + ", ".join(map(str, REGIONS)) + ") SELECT seq_id, seq_id || '-' || a || '-' || b AS name, least(b, length(s)) - a AS n, md5(substr(s, a + 1, least(b, length(s)) - a)) AS digest FROM seq, reg WHERE length(s) > a")
def region_split(spark, sf_dir):
    """Every sequence cut into the given regions, clipped to its length; empty ones drop out."""
    regions = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in REGIONS)))
    rows = sequences(spark, sf_dir).select("seq_id", "s", regions.alias("r")).where(F.length("s") > F.col("r.a"))
    n = F.least(F.col("r.b"), F.length("s")) - F.col("r.a")
    return rows.select("seq_id", F.concat_ws("-", "seq_id", "r.a", "r.b").alias("name"), n.cast("long").alias("n"), F.md5(F.substring(F.col("s"), F.col("r.a") + 1, n).cast("binary")).alias("digest"))


@query("WITH " + SEQ + f""", c AS (SELECT count(*) AS k FROM seq), r AS (SELECT o_orderkey AS region, o_orderkey % k AS seq_id, o_custkey % 1000 AS a, o_orderkey % 2 = 0 AS forward FROM orders, c)
SELECT region, seq_id, a AS start, length(t) AS n, CASE WHEN forward THEN t ELSE {rc('t')} END AS bases FROM (SELECT region, r.seq_id, a, forward, substr(s, a + 1, 60) AS t FROM r JOIN seq USING (seq_id)) WHERE length(t) > 0""")
def extract_regions(spark, sf_dir):
    """Bases of coordinates: regions meet their sequence by name; - is the reverse complement."""
    seqs = sequences(spark, sf_dir).select("seq_id", "s")
    k = seqs.agg(F.count(F.lit(1)).alias("k"))
    r = table(spark, sf_dir, "orders").crossJoin(F.broadcast(k)).select(F.col("o_orderkey").alias("region"), (F.col("o_orderkey") % F.col("k")).alias("seq_id"), (F.col("o_custkey") % 1000).alias("start"), (F.col("o_orderkey") % 2 == 0).alias("forward"))
    rows = r.join(seqs, "seq_id").withColumn("t", F.substring(F.col("s"), (F.col("start") + 1).cast("int"), F.lit(60))).where(F.length("t") > 0)
    return rows.select("region", "seq_id", "start", F.length("t").cast("long").alias("n"), F.when(F.col("forward"), F.col("t")).otherwise(seq.revcomp(F.col("t"))).alias("bases"))


@query("WITH " + SEQ + """, v AS (SELECT seq_id, 'too short' AS problem FROM seq WHERE length(s) < 200 UNION ALL SELECT seq_id, 'mostly missing' FROM seq WHERE 2 * (length(s) - length(replace(s, 'N', ''))) > length(s)
UNION ALL SELECT seq_id, 'long stretch missing' FROM seq WHERE strpos(s, 'NNNNNNNN') > 0 UNION ALL SELECT min(seq_id), 'same sequence' FROM seq GROUP BY s HAVING count(*) > 1) SELECT * FROM v""")
def validate_upload(spark, sf_dir):
    """Violations that an upload is told about, one row each."""
    s = sequences(spark, sf_dir).select("seq_id", "s")
    n = F.length("s")
    rules = {"too short": n < 200, "mostly missing": 2 * (n - F.length(F.translate("s", "N", ""))) > n, "long stretch missing": F.instr("s", "NNNNNNNN") > 0}
    found = F.explode(F.filter(F.array(*(F.when(c, F.lit(p)) for p, c in rules.items())), lambda x: x.isNotNull()))
    same = s.groupBy(F.sha2(F.col("s").cast("binary"), 256).alias("h")).agg(F.min("seq_id").alias("seq_id"), F.count(F.lit(1)).alias("c")).where("c > 1").select("seq_id", F.lit("same sequence").alias("problem"))
    return s.select("seq_id", found.alias("problem")).unionByName(same)


@query("SELECT doc_id AS seq_id, source FROM documents WHERE regexp_matches(source, '(?i)^SRC1')")
def name_search(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(F.col("source").rlike("(?i)^SRC1")).select(F.col("doc_id").alias("seq_id"), "source")


@query("SELECT page_id, url, list_extract(string_split(url, '/'), 3) AS host, list_extract(string_split(url, '/'), -1) AS last, url_decode(replace(url, '+', ' ')) AS decoded FROM pages")
def name_parts(spark, sf_dir):
    parts = F.split("url", "/")
    return table(spark, sf_dir, "pages").select("page_id", "url", F.element_at(parts, 3).alias("host"), F.element_at(parts, -1).alias("last"), F.url_decode("url").alias("decoded"))


@query(H + "SELECT event_id, (row_number() OVER (PARTITION BY motif ORDER BY score DESC, event_id) - 1) // 100 + 1 AS page, motif FROM hits")
def paged(spark, sf_dir):
    """The page of 100 that each hit of a motif is shown on, best first.

    Hits are counted by score first; only counts are added up along a motif, and only hits of one score put in order.
    """
    rows = hits(spark, sf_dir)
    scores = rows.groupBy("motif", "score").agg(F.count(F.lit(1)).alias("c"))
    ahead = F.sum("c").over(Window.partitionBy("motif").orderBy(F.desc("score"))) - F.col("c")
    rows = rows.join(scores.withColumn("ahead", ahead), ["motif", "score"])
    n = F.col("ahead") + F.row_number().over(Window.partitionBy("motif", "score").orderBy("event_id"))
    return rows.select("event_id", (F.floor((n - 1) / 100) + 1).cast("long").alias("page"), "motif")


@query(H + f"SELECT event_id, round(1 - 0.5 * {erfc_sql('score / sqrt(2.0::DOUBLE)')}, 6) AS cdf FROM hits")
def normal_cdf(spark, sf_dir):
    return hits(spark, sf_dir).select("event_id", F.round(stats.normal_cdf(F.col("score")), 6).alias("cdf"))


@query(H + f"""SELECT event_id, round(exp(-score) * (1 + score), 6) AS q4, round(exp(-score) * (1 + score + score * score / 2), 6) AS q6,
round({erfc_sql('sqrt(score)')} + exp(-score) * (sqrt(score) / (sqrt(pi()) / 2) * (1 + score / 1.5)), 6) AS q5, round(2 * exp(ln(greatest(pow(10, -score) * 0.5, 1e-30))) * (1 - ln(greatest(pow(10, -score) * 0.5, 1e-30))), 6) AS fisher FROM hits""")
def gamma_q(spark, sf_dir):
    x = F.col("score")
    return hits(spark, sf_dir).select("event_id", F.round(stats.gamma_q(4, x), 6).alias("q4"), F.round(stats.gamma_q(6, x), 6).alias("q6"), F.round(stats.gamma_q(5, x), 6).alias("q5"), F.round(stats.fisher(F.pow(F.lit(10.0), -x), F.lit(0.5)), 6).alias("fisher"))


@query("WITH " + HITS + ", e AS (SELECT event_id, seq_id, start FROM hits WHERE motif = 'error') SELECT c.event_id, coalesce((SELECT min(e.start) FROM e WHERE e.seq_id = c.seq_id AND e.start >= c.start), -1) AS next_start FROM hits c WHERE c.motif = 'click'")
def lower_bound(spark, sf_dir):
    """The first error hit at or after each click hit of a sequence, by one pass over both in order."""
    rows = hits(spark, sf_dir).where("motif IN ('click', 'error')").select("event_id", "seq_id", "start", "motif")
    w = Window.partitionBy("seq_id").orderBy("start", F.when(F.col("motif") == "click", 0).otherwise(1)).rowsBetween(0, Window.unboundedFollowing)
    nearest = F.min(F.when(F.col("motif") == "error", F.col("start"))).over(w)
    return rows.withColumn("next_start", F.coalesce(nearest, F.lit(-1).cast("long"))).where("motif = 'click'").select("event_id", "next_start")


@query(H + f""", kept AS (SELECT event_id FROM hits b WHERE NOT EXISTS (SELECT 1 FROM hits a WHERE a.seq_id = b.seq_id AND a.event_id <> b.event_id AND {CLASH}
AND least(a.start + a.len, b.start + b.len) > greatest(a.start, b.start) AND (a.motif = b.motif OR 4 * (least(a.start + a.len, b.start + b.len) - greatest(a.start, b.start)) > least(a.len, b.len))))
SELECT motif, count(*) AS n, count(kept.event_id) AS resolved FROM hits LEFT JOIN kept USING (event_id) GROUP BY motif""")
def hits_redundant(spark, sf_dir):
    """Hits of each motif with and without overlap resolution."""
    rows = hits(spark, sf_dir)
    kept = ops.resolve(rows).select("event_id", F.lit(1).alias("kept"))
    return rows.join(kept, "event_id", "left").groupBy("motif").agg(F.count(F.lit(1)).alias("n"), F.count("kept").alias("resolved"))


NEARBY = "nb AS (SELECT a.event_id AS a, b.event_id AS b FROM hits a JOIN hits b ON a.seq_id = b.seq_id AND b.start - a.start BETWEEN 0 AND 15 AND a.event_id <> b.event_id AND (a.start < b.start OR a.event_id < b.event_id) AND (a.motif = b.motif OR NOT (4 * (b.start - a.start) >= 3 * a.len AND 4 * (a.start + a.len - b.start) < 3 * b.len)))"


@query()
def hits_greedy(spark, sf_dir):
    """Hits that are left when the best is kept first, then the best that is in conflict with none kept, and so on."""
    return ops.resolve_greedy(hits(spark, sf_dir)).select("event_id", "motif", "seq_id", "start", "score")


@query(H + f", {NEARBY} SELECT b AS event_id, count(*) AS n FROM (SELECT a, b FROM nb UNION ALL SELECT b, a FROM nb) GROUP BY 1")
def hit_conflicts(spark, sf_dir):
    """How many hits each hit is in conflict with: one motif within 15 bases, or two that share too much."""
    pairs = ops.conflicts(hits(spark, sf_dir))
    return pairs.select(F.explode(F.array("a", "b")).alias("event_id")).groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))


FRAMED = "fp AS (SELECT CASE WHEN a.motif <= b.motif THEN a.motif ELSE b.motif END AS m1, CASE WHEN a.motif <= b.motif THEN b.motif ELSE a.motif END AS m2, CASE WHEN a.strand = b.strand THEN 1 ELSE -1 END::BIGINT AS dir, CASE WHEN a.motif <= b.motif THEN CASE WHEN a.strand = '+' THEN b.start - a.start ELSE a.start + a.len - b.start - b.len END ELSE CASE WHEN b.strand = '+' THEN a.start - b.start ELSE b.start + b.len - a.start - a.len END END AS gap FROM hits a JOIN hits b ON a.seq_id = b.seq_id AND b.start - a.start BETWEEN 0 AND 50 AND (a.start < b.start OR a.event_id < b.event_id))"


def framed(rows):
    """m1, m2, dir, gap of hits within 50 bases: where the second motif stands as seen along the first, the lesser name."""
    p = ops.later_pairs(rows)
    ahead = F.col("a_motif") <= F.col("b_motif")
    seen = lambda x, y: F.when(F.col(f"{x}_strand") == "+", F.col(f"{y}_start") - F.col(f"{x}_start")).otherwise(F.col(f"{x}_start") + F.col(f"{x}_len") - F.col(f"{y}_start") - F.col(f"{y}_len"))
    same = F.when(F.col("a_strand") == F.col("b_strand"), 1).otherwise(-1).cast("long")
    return p.select(F.least("a_motif", "b_motif").alias("m1"), F.greatest("a_motif", "b_motif").alias("m2"), same.alias("dir"), F.when(ahead, seen("a", "b")).otherwise(seen("b", "a")).alias("gap"))


@query(H + f", {FRAMED} SELECT m1, m2, dir, gap, count(*) AS n FROM fp GROUP BY ALL HAVING count(*) >= 5")
def pair_frames(spark, sf_dir):
    """How often two motifs stand at one distance and in one direction, as seen along the first."""
    return framed(hits(spark, sf_dir)).groupBy("m1", "m2", "dir", "gap").agg(F.count(F.lit(1)).alias("n")).where("n >= 5")


@query(H + f", {FRAMED}, f AS (SELECT motif, count(*) AS c FROM hits GROUP BY 1), g AS (SELECT m1, m2, dir, gap, count(*) AS n FROM fp GROUP BY ALL) SELECT m1, m2, dir, gap, n, round(n / least(a.c, b.c), 6) AS share FROM g JOIN f a ON a.motif = m1 JOIN f b ON b.motif = m2 WHERE n >= 5 AND n >= 0.05 * least(a.c, b.c)")
def pair_offsets_framed(spark, sf_dir, share=0.05):
    """Of those, what makes up at least a twentieth of the rarer motif's hits."""
    rows = hits(spark, sf_dir)
    f = rows.groupBy("motif").agg(F.count(F.lit(1)).alias("c"))
    g = framed(rows).groupBy("m1", "m2", "dir", "gap").agg(F.count(F.lit(1)).alias("n"))
    g = g.join(f.select(F.col("motif").alias("m1"), F.col("c").alias("c1")), "m1").join(f.select(F.col("motif").alias("m2"), F.col("c").alias("c2")), "m2")
    rare = F.least("c1", "c2")
    return g.where((F.col("n") >= 5) & (F.col("n") >= share * rare)).select("m1", "m2", "dir", "gap", "n", F.round(F.col("n") / rare, 6).alias("share"))


@query(H + """, nm AS (SELECT doc_id AS seq_id FROM documents LEFT JOIN labels USING (doc_id) WHERE regexp_matches(source, '(?i)^SRC') AND coalesce(quality, 1) = 1),
p AS (SELECT seq_id, count(*) FILTER (WHERE motif = 'click' AND score >= 1) AS a, count(*) FILTER (WHERE motif = 'error' AND strand = '+') AS b, count(*) FILTER (WHERE motif = 'view' AND start BETWEEN 100 AND 3000) AS c FROM hits GROUP BY 1)
SELECT seq_id, a, b, c FROM p SEMI JOIN nm USING (seq_id) WHERE a >= 2 AND b >= 2 AND c >= 2""")
def search_names(spark, sf_dir):
    """Sequences of certain names and attributes with at least two hits of each of three motifs."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    names = docs.where(F.col("source").rlike("(?i)^SRC") & (F.coalesce("quality", F.lit(1)) == 1)).select(F.col("doc_id").alias("seq_id"))
    of = lambda m, c, n: F.count(F.when((F.col("motif") == m) & c, 1)).alias(n)
    p = hits(spark, sf_dir).groupBy("seq_id").agg(of("click", F.col("score") >= 1, "a"), of("error", F.col("strand") == "+", "b"), of("view", F.col("start").between(100, 3000), "c"))
    return p.where("a >= 2 and b >= 2 and c >= 2").join(names, "seq_id", "left_semi")


@query("WITH c AS (SELECT 'R' || o_orderkey AS name, o_custkey * 10 AS start, 300 + o_orderkey % 500 AS len, o_orderkey % 2 = 0 AS forward FROM orders), reg(a, b) AS (VALUES " + ", ".join(map(str, REGIONS)) + ") SELECT name || '-' || a || '-' || least(b, len) AS name, CASE WHEN forward THEN '+' ELSE '-' END AS strand, (least(b, len) - a)::BIGINT AS len, (CASE WHEN forward THEN start + a ELSE start + len - least(b, len) END)::BIGINT AS start FROM c, reg WHERE len > a")
def region_coordinates(spark, sf_dir):
    """Coordinates of the regions that sequences are cut into: on the other strand they count from the end."""
    c = table(spark, sf_dir, "orders").select(F.concat(F.lit("R"), F.col("o_orderkey").cast("string")).alias("of"), (F.col("o_custkey") * 10).alias("at"), (300 + F.col("o_orderkey") % 500).alias("n"), (F.col("o_orderkey") % 2 == 0).alias("forward"))
    regions = F.explode(F.array(*(F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for a, b in REGIONS)))
    rows = c.withColumn("r", regions).select("of", "at", "n", "forward", F.col("r.a").alias("a"), F.least("r.b", "n").alias("e")).where("n > a")
    return rows.select(F.concat_ws("-", "of", "a", "e").alias("name"), F.when(F.col("forward"), "+").otherwise("-").alias("strand"), (F.col("e") - F.col("a")).alias("len"), F.when(F.col("forward"), F.col("at") + F.col("a")).otherwise(F.col("at") + F.col("n") - F.col("e")).alias("start"))
