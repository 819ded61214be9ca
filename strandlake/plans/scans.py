"""Queries that scan sequences for motifs, refine motifs, and finish the matrices of enriched words."""

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import pfm, seq, stats
from ..operators import background, enrich, kmers, scan
from ..operators import refine as refining
from ..session import saved, shared_dir
from ..sources import text
from . import words
from .hits import erfc_sql
from .motifs import BITS, LOGODDS, M, motifs, scan_core, scan_threshold
from .tables import CANDIDATE, CONSIDERED, COUNTS, LENGTHS, LIBRARY, SEQ, library, occurrences, rc, sequences, windows

QUERIES, SQL = {}, {}
THRESHOLD = 3.0
TEMPLATE = kmers.templates(8)[0]
GAPS = tuple(words.SPANS)


#: SQL that takes minutes on whole tables: for tests on small ones.
SLOW_SQL = {}


def query(sql=None, slow=False):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            (SLOW_SQL if slow else SQL)[f.__name__] = sql
        return f

    return add


def family_cores(spark, sf_dir):
    """[(family, 8 x 4 log-odds)]: columns 5 to 12 of each label's member with the most information; ties: the least id."""
    rows = motifs(spark, sf_dir).select("label", "vec_id", F.slice("pfm", 5, 8).alias("f"))
    bits = F.round(pfm.total(pfm.information(F.col("f"))), 6)
    best = rows.groupBy("label").agg(F.max_by("f", F.struct(bits, -F.col("vec_id"))).alias("f"))
    return [(f"F{r['label']}", r["m"]) for r in best.select("label", pfm.logodds(F.col("f")).alias("m")).orderBy("label").collect()]


FAMILY = M + f""", fb AS (SELECT label, vec_id, round(sum({BITS}), 6) AS bits FROM pos WHERE p BETWEEN 5 AND 12 GROUP BY ALL), fr AS (SELECT label, max_by(vec_id, (bits, -vec_id)) AS vec_id FROM fb GROUP BY label),
fz AS (SELECT 'F' || label AS motif, p - 4 AS p, {LOGODDS} AS z FROM pos JOIN fr USING (label, vec_id) WHERE p BETWEEN 5 AND 12), """
DICTIONARY = """w8 AS (SELECT c, array_to_string(list_transform(range(0, 8), lambda j: substr('ACGT', 1 + ((c >> (2 * j)) & 3)::INT, 1)), '') AS word FROM range(0, 65536) t(c)),
fl AS (SELECT motif, list(z ORDER BY p) AS m FROM fz GROUP BY motif),
dict AS (SELECT motif, word, round(list_sum(list_transform(range(0, 8), lambda j: m[j + 1][1 + ((c >> (2 * j)) & 3)])), 6) AS score FROM w8, fl)"""
SCAN = FAMILY + DICTIONARY + ", " + SEQ + ", win AS (" + windows(*TEMPLATE) + f"), good AS (SELECT * FROM dict WHERE score >= {THRESHOLD}), hit AS (SELECT motif, seq_id, grp, '+' AS strand, i - 1 AS start, score, win.word AS match FROM win JOIN good USING (word) UNION ALL SELECT motif, seq_id, grp, '-', i - 1, score, good.word FROM win JOIN good ON good.word = {rc('win.word')}) "


def found(spark, sf_dir):
    return scan.scan(sequences(spark, sf_dir), scan.word_scores(family_cores(spark, sf_dir)), THRESHOLD)


def with_match(rows, seqs, width=8):
    """Hits with the text they match, along the motif."""
    text = F.substring(F.col("u"), (F.col("start") + 1).cast("int"), F.lit(width))
    return rows.join(seqs.select("seq_id", "u"), "seq_id").withColumn("match", F.when(F.col("strand") == "+", text).otherwise(seq.revcomp(text))).drop("u")


@query(SCAN + "SELECT motif, seq_id, strand, start, score, match FROM hit")
def scan_hits(spark, sf_dir):
    return with_match(found(spark, sf_dir), sequences(spark, sf_dir)).select("motif", "seq_id", "strand", "start", "score", "match")


def whole_motifs(spark, sf_dir):
    """(vec_id, 16 x 4 log-odds, first core column from 0, threshold) of every row of embeddings, as they are read."""
    rows = motifs(spark, sf_dir).select("vec_id", pfm.logodds(F.col("pfm")).alias("m"))
    rows = rows.join(scan_core(spark, sf_dir), "vec_id").join(scan_threshold(spark, sf_dir), "vec_id")
    for r in rows.select("vec_id", "m", (F.col("core_start") - 1).cast("int").alias("core"), "threshold").toLocalIterator():
        yield r["vec_id"], r["m"], r["core"], r["threshold"]


WIDTH = 16
# either half of a hit has at least half of its score
WHOLE = M + f""", zz AS (SELECT vec_id, p, {LOGODDS} AS z FROM pos), v AS (SELECT vec_id, sum(list_sum(z)) / 4 AS mean, sum((list_dot_product(z, z) - list_sum(z) * list_sum(z) / 4) / 3) AS var, sum(list_max(z)) AS most, list(z ORDER BY p) AS m FROM zz GROUP BY vec_id),
lim AS (SELECT vec_id, m, round(greatest(least(mean + (0.968 - 0.3235 * ln(4 * 5 / 10000) - 0.0037336 * ln(4 * 5 / 10000) * ln(4 * 5 / 10000)) * sqrt(var), most * 0.75), 1.301), 6) AS least FROM v),
turned AS (SELECT vec_id, '+' AS strand, least, m FROM lim UNION ALL SELECT vec_id, '-', least, list_transform(list_reverse(m), lambda r: list_reverse(r)) FROM lim),
four AS (SELECT c, array_to_string(list_transform(range(0, 4), lambda j: substr('ACGT', 1 + ((c >> (2 * j)) & 3)::INT, 1)), '') AS w FROM range(0, 256) t(c)),
quad AS (SELECT vec_id, strand, least, q, w, list_sum(list_transform(range(0, 4), lambda j: m[4 * q + j + 1][1 + ((c >> (2 * j)) & 3)])) AS s FROM turned, four, range(0, 4) t(q)),
part AS (SELECT a.vec_id, a.strand, a.q // 2 AS half, a.w || b.w AS word FROM quad a JOIN quad b ON a.vec_id = b.vec_id AND a.strand = b.strand AND a.q + 1 = b.q AND a.q % 2 = 0 WHERE a.s + b.s >= a.least / 2 - 1e-6),
""" + SEQ + """, win AS (SELECT seq_id, grp, i, substr(u, i, 16) AS f FROM (SELECT seq_id, grp, u, unnest(range(1, length(u) - 14)) AS i FROM seq WHERE length(u) >= 16)), clean AS (SELECT * FROM win WHERE strpos(f, 'N') = 0),
cand AS (SELECT vec_id, strand, seq_id, grp, i, f FROM clean JOIN part ON half = 0 AND word = substr(f, 1, 8) UNION SELECT vec_id, strand, seq_id, grp, i, f FROM clean JOIN part ON half = 1 AND word = substr(f, 9, 8)),
scored AS (SELECT vec_id, seq_id, grp, c.strand, i - 1 AS start, f, least, round(list_sum(list_transform(range(1, 17), lambda j: m[j][strpos('ACGT', substr(f, j, 1))])), 6) AS score FROM cand c JOIN turned USING (vec_id, strand)),
hit AS (SELECT vec_id, seq_id, grp, strand, start, score, CASE WHEN strand = '+' THEN f ELSE """ + rc("f") + """ END AS match FROM scored WHERE score >= least) """


def whole_found(spark, sf_dir):
    return scan.wide_scan(sequences(spark, sf_dir), whole_motifs(spark, sf_dir)).withColumnRenamed("motif", "vec_id")


@query(WHOLE + "SELECT vec_id, seq_id, grp, strand, start, score, match FROM hit")
def scan_whole(spark, sf_dir):
    """Hits of every motif over all of its 16 columns, at the motif's own threshold."""
    return with_match(whole_found(spark, sf_dir), sequences(spark, sf_dir), WIDTH).select("vec_id", "seq_id", "grp", "strand", "start", "score", "match")


@query(WHOLE + f""", {LENGTHS}, s AS (SELECT vec_id, count(*) FILTER (WHERE grp = 'test') AS n1, count(*) FILTER (WHERE grp = 'ctrl') AS n2 FROM hit GROUP BY vec_id)
SELECT vec_id, s.n1, s.n2, round(s.n2 * len1 / len2, 4) AS scaled, round(s.n1 - s.n2 * len1 / len2, 4) AS freq, round(s.n1 / nullif(s.n2 * len1 / len2, 0), 6) AS ratio FROM s, tot""")
def fp_whole(spark, sf_dir):
    """As fp_threshold, for every motif over all of its columns; a motif without hits has no row."""
    of = lambda g: F.count(F.when(F.col("grp") == g, 1)).alias("n1" if g == "test" else "n2")
    s = whole_found(spark, sf_dir).groupBy("vec_id").agg(of("test"), of("ctrl")).crossJoin(F.broadcast(enrich.lengths(sequences(spark, sf_dir)).drop("n1", "n2")))
    scaled = F.col("n2") * F.col("len1") / F.col("len2")
    return s.select("vec_id", "n1", "n2", F.round(scaled, 4).alias("scaled"), F.round(F.col("n1") - scaled, 4).alias("freq"), F.round(F.when(scaled != 0, F.col("n1") / scaled), 6).alias("ratio"))


@query("WITH " + SEQ + ", " + LIBRARY + ", win AS (" + windows(*TEMPLATE) + f") SELECT motif, seq_id, '+' AS strand, i - 1 AS start FROM win JOIN lib ON word = pattern UNION ALL SELECT motif, seq_id, '-', i - 1 FROM win JOIN lib ON {rc('word')} = pattern")
def scan_consensus(spark, sf_dir):
    """Exact occurrences of the consensus library on either strand, in one scan for whatever number of motifs.

    The driver sees only which of the 4**8 words occur in the library; the words found are joined with it.
    """
    import numpy as np

    lib = library(spark, sf_dir)
    score = np.zeros(4**8)
    for r in lib.select(seq.word_code(F.col("pattern")).alias("code")).distinct().collect():  # at most 65,536
        score[r["code"]] = 1.0
    seqs = sequences(spark, sf_dir)
    hits = with_match(scan.scan(seqs, {"word": score}, 1.0), seqs).drop("motif")
    return hits.join(lib, hits.match == lib.pattern).select("motif", "seq_id", "strand", "start")


@query(FAMILY + DICTIONARY + ", " + SEQ + ", win AS (" + windows(*TEMPLATE) + f"""), n AS (SELECT word, count(*) AS n FROM win WHERE grp = 'ctrl' GROUP BY word), bs AS (SELECT word, n FROM n UNION ALL SELECT {rc('word')}, n FROM n),
c AS (SELECT motif, score, sum(n) AS n FROM bs JOIN dict USING (word) GROUP BY ALL), r AS (SELECT motif, score, sum(n) OVER (PARTITION BY motif ORDER BY score DESC) AS upto FROM c), {LENGTHS}
SELECT motif, greatest(max(score), 1.301) AS threshold, any_value(floor(len2 / 10000 * 5))::BIGINT AS k FROM r, tot WHERE upto >= floor(len2 / 10000 * 5) GROUP BY motif""")
def calibrate_threshold(spark, sf_dir):
    """Score of the k-th best window of the control on both strands, for five hits in 10,000 bases; at least 1.301.

    Windows are counted by word first, so what is ordered are the scores of at most 65,536 words a motif.
    """
    import numpy as np

    seqs = sequences(spark, sf_dir)
    n = kmers.count_words(seqs.where("grp = 'ctrl'")).select("word", F.col("n_all").alias("n"))
    both = n.unionByName(n.select(seq.revcomp(F.col("word")).alias("word"), "n")).withColumn("code", seq.word_code(F.col("word")))
    scores = scan.word_scores(family_cores(spark, sf_dir))
    shared = spark.sparkContext.broadcast(scores)

    def score(batches):
        import pyarrow as pa

        for b in batches:
            codes = np.array(b.column("code"))
            for motif, s in shared.value.items():
                yield pa.record_batch([pa.array([motif] * len(codes)), pa.array(s[codes]), b.column("n")], names=["motif", "score", "n"])

    c = both.select("code", "n").mapInArrow(score, "motif string, score double, n long").groupBy("motif", "score").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("motif").orderBy(F.desc("score")))
    k = F.floor(F.col("len2") / 10000 * 5)
    rows = c.withColumn("upto", upto).crossJoin(F.broadcast(enrich.lengths(seqs))).withColumn("k", k).where("upto >= k")
    return rows.groupBy("motif").agg(F.greatest(F.max("score"), F.lit(1.301)).alias("threshold"), F.first("k").alias("k"))


@query(SCAN + f""", {LENGTHS}, s AS (SELECT motif, count(*) FILTER (WHERE grp = 'test') AS n1, count(*) FILTER (WHERE grp = 'ctrl') AS n2 FROM hit GROUP BY motif)
SELECT motif, s.n1, s.n2, round(s.n2 * len1 / len2, 4) AS scaled, round(s.n1 - s.n2 * len1 / len2, 4) AS freq, round(s.n1 / nullif(s.n2 * len1 / len2, 0), 6) AS ratio FROM s, tot""")
def fp_threshold(spark, sf_dir):
    """Hits in test against hits in control scaled to the test's length."""
    of = lambda g: F.count(F.when(F.col("grp") == g, 1)).alias("n1" if g == "test" else "n2")
    s = found(spark, sf_dir).groupBy("motif").agg(of("test"), of("ctrl")).crossJoin(F.broadcast(enrich.lengths(sequences(spark, sf_dir)).drop("n1", "n2")))
    scaled = F.col("n2") * F.col("len1") / F.col("len2")
    return s.select("motif", "n1", "n2", F.round(scaled, 4).alias("scaled"), F.round(F.col("n1") - scaled, 4).alias("freq"), F.round(F.when(scaled != 0, F.col("n1") / scaled), 6).alias("ratio"))


CELLS = SCAN + ", ch AS (SELECT motif, grp, j AS p, substr(match, j, 1) AS base FROM hit, range(1, 9) t(j)), cell AS (SELECT motif, p, base, count(*) FILTER (WHERE grp = 'test') AS f1, count(*) FILTER (WHERE grp = 'ctrl') AS f2 FROM ch GROUP BY ALL)"


def cells(spark, sf_dir):
    return cell_counts(with_match(found(spark, sf_dir), sequences(spark, sf_dir)), "motif")


def cell_counts(matched, key):
    rows = matched.select(key, "grp", F.posexplode(F.split("match", "")).alias("p", "base"))
    of = lambda g, n: F.count(F.when(F.col("grp") == g, 1)).alias(n)
    return rows.groupBy(key, (F.col("p") + 1).cast("long").alias("p"), "base").agg(of("test", "f1"), of("ctrl", "f2"))


@query(CELLS + " SELECT * FROM cell")
def refine_counts(spark, sf_dir):
    """Bases at each place of the hits."""
    return cells(spark, sf_dir)


@query(CELLS + ", l AS (SELECT *, log10(f1 + 1) AS y, log10(f2 + 1) AS x FROM cell), g AS (SELECT motif, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM l GROUP BY motif) SELECT motif, p, base, round(0.5 * (y - CASE WHEN b IS NULL OR isnan(b) THEN 0 ELSE b * x + a END), 5) + 0.0 AS step FROM l JOIN g USING (motif)")
def refine_regression(spark, sf_dir):
    """Step of each cell: half of what its log count lies above the line through all cells of the motif."""
    return regression(cells(spark, sf_dir), "motif")


def regression(counts, key):
    rows = counts.select(key, "p", "base", F.log10(F.col("f1") + 1).alias("y"), F.log10(F.col("f2") + 1).alias("x"))
    line = rows.groupBy(key).agg(F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return rows.join(line, key).select(key, "p", "base", (F.round(0.5 * (F.col("y") - (zero("b") * F.col("x") + zero("a"))), 5) + 0.0).alias("step"))


@query(CELLS + f", {LENGTHS}, d AS (SELECT motif, p, base, greatest(1, f1 - len1 / len2 * f2) AS v FROM cell, tot) SELECT motif, p, base, round(log10(4 * v / sum(v) OVER (PARTITION BY motif, p)), 6) AS weight FROM d")
def refine_difference(spark, sf_dir):
    """New log-odds of each cell from its count in test less the scaled count in control, renormalised by place."""
    return difference(cells(spark, sf_dir), sequences(spark, sf_dir), "motif")


def difference(counts, seqs, key):
    rows = counts.crossJoin(F.broadcast(enrich.lengths(seqs)))
    rows = rows.withColumn("v", F.greatest(F.lit(1.0), F.col("f1") - F.col("len1") / F.col("len2") * F.col("f2")))
    return rows.select(key, "p", "base", F.round(F.log10(4 * F.col("v") / F.sum("v").over(Window.partitionBy(key, "p"))), 6).alias("weight"))


def whole_cells(spark, sf_dir):
    return cell_counts(scan_whole(spark, sf_dir), "vec_id")


WHOLE_CELLS = WHOLE + ", ch AS (SELECT vec_id, grp, j AS p, substr(match, j, 1) AS base FROM hit, range(1, 17) t(j)), cell AS (SELECT vec_id, p, base, count(*) FILTER (WHERE grp = 'test') AS f1, count(*) FILTER (WHERE grp = 'ctrl') AS f2 FROM ch GROUP BY ALL)"


@query(WHOLE_CELLS + " SELECT * FROM cell")
def refine_counts_whole(spark, sf_dir):
    """As refine_counts, over the hits of scan_whole."""
    return whole_cells(spark, sf_dir)


@query(WHOLE_CELLS + ", l AS (SELECT *, log10(f1 + 1) AS y, log10(f2 + 1) AS x FROM cell), g AS (SELECT vec_id, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM l GROUP BY vec_id) SELECT vec_id, p, base, round(0.5 * (y - CASE WHEN b IS NULL OR isnan(b) THEN 0 ELSE b * x + a END), 5) + 0.0 AS step FROM l JOIN g USING (vec_id)")
def refine_regression_whole(spark, sf_dir):
    return regression(whole_cells(spark, sf_dir), "vec_id")


@query(WHOLE_CELLS + f", {LENGTHS}, d AS (SELECT vec_id, p, base, greatest(1, f1 - len1 / len2 * f2) AS v FROM cell, tot) SELECT vec_id, p, base, round(log10(4 * v / sum(v) OVER (PARTITION BY vec_id, p)), 6) AS weight FROM d")
def refine_difference_whole(spark, sf_dir):
    return difference(whole_cells(spark, sf_dir), sequences(spark, sf_dir), "vec_id")


@query(WHOLE + "SELECT vec_id, seq_id, strand, start, round(list_sum(list_transform(range(1, 17), lambda j: m[j][strpos('ACGT', substr(match, j, 1))])), 4) AS again FROM hit JOIN lim USING (vec_id)")
def rescore_whole(spark, sf_dir):
    """As rescore, over the hits of scan_whole; the matrices are joined by motif."""
    m = motifs(spark, sf_dir).select("vec_id", pfm.logodds(F.col("pfm")).alias("m"))
    rows = scan_whole(spark, sf_dir).join(m, "vec_id")
    cell = F.transform(F.split("match", ""), lambda c, j: F.col("m")[j][F.instr(F.lit("ACGT"), c) - 1])
    return rows.select("vec_id", "seq_id", "strand", "start", F.round(pfm.total(cell), 4).alias("again"))


@query(SCAN + ", k AS (SELECT motif, seq_id, start, strand, substr(u, (start // 10) * 10 + 1, ((start + 7) // 10 - start // 10 + 1) * 10) AS t FROM hit JOIN seq USING (seq_id)) SELECT motif, seq_id, start, strand, (10 * (length(t) - length(translate(t, 'CG', ''))) // ((length(t) + 9) // 10))::BIGINT AS conservation FROM k")
def hits_conservation(spark, sf_dir):
    """Whole mean of the track's cells of 10 bases that a hit touches; the track here counts C and G, tenfold."""
    return track_mean(found(spark, sf_dir), sequences(spark, sf_dir), "motif", 8)


@query(WHOLE + ", k AS (SELECT vec_id, seq_id, start, strand, substr(u, (start // 10) * 10 + 1, ((start + 15) // 10 - start // 10 + 1) * 10) AS t FROM hit JOIN seq USING (seq_id)) SELECT vec_id, seq_id, start, strand, (10 * (length(t) - length(translate(t, 'CG', ''))) // ((length(t) + 9) // 10))::BIGINT AS conservation FROM k")
def hits_conservation_whole(spark, sf_dir):
    return track_mean(whole_found(spark, sf_dir), sequences(spark, sf_dir), "vec_id", WIDTH)


def track_mean(hits, seqs, key, width):
    rows = hits.join(seqs.select("seq_id", "u"), "seq_id")
    first, last = F.floor(F.col("start") / 10), F.floor((F.col("start") + width - 1) / 10)
    rows = rows.withColumn("t", F.substring(F.col("u"), (first * 10 + 1).cast("int"), ((last - first + 1) * 10).cast("int")))
    return rows.select(key, "seq_id", "start", "strand", F.floor(10 * seq.count_cg(F.col("t")) / F.nullif(F.floor((F.length("t") + 9) / 10), F.lit(0))).cast("long").alias("conservation"))


@query("WITH " + SEQ + ", " + occurrences([TEMPLATE]) + ", " + COUNTS + " SELECT grp, word, n_all - n AS n_close, n_all FROM cnt WHERE n_all > n")
def clump_counts(spark, sf_dir):
    """Occurrences that overlap one counted before."""
    return kmers.count_words(sequences(spark, sf_dir)).where("n_all > n").select("grp", "word", (F.col("n_all") - F.col("n")).alias("n_close"), "n_all")


def counted(spark, sf_dir, gaps=(0,)):
    """words.stats as a stored table, at most 4**8 words a template, so that what reads it again doesn't count again."""
    return saved(words.stats(spark, sf_dir, gaps), shared_dir(spark, "stats"), "stats")


NEIGHBOURS = words.STATS0.rstrip() + f""", cand AS (SELECT word, z, ratio, diff, x FROM st WHERE {CANDIDATE}), nb AS (SELECT c.word, k AS p, b, substr(c.word, 1, k - 1) || b || substr(c.word, k + 1) AS w FROM cand c, range(1, 9) t(k), (VALUES ('A'), ('C'), ('G'), ('T')) v(b)),
core AS (SELECT nb.word, p, b, greatest(coalesce(st.diff, 0), 0) AS v FROM nb LEFT JOIN st ON st.word = least(w, {rc('w')}))"""


# The same over all templates: words of one template are compared with each other.
NEIGHBOURS9 = words.STATS.rstrip() + f""", cand AS (SELECT gap, word, z, ratio, diff, x FROM st WHERE {CANDIDATE}), nb AS (SELECT c.gap, c.word, k AS p, b, substr(c.word, 1, k - 1) || b || substr(c.word, k + 1) AS w FROM cand c, range(1, 9) t(k), (VALUES ('A'), ('C'), ('G'), ('T')) v(b)),
core AS (SELECT nb.gap, nb.word, p, b, greatest(coalesce(st.diff, 0), 0) AS v FROM nb LEFT JOIN st ON st.gap = nb.gap AND st.word = least(w, {rc('w')}))"""
PLACES = ", ".join(f"({g}, {span}, {p}, {o})" for g, span, parts in kmers.templates(8) for p, o in [(-2, -2), (-1, -1), (1, span), (2, span + 1), *((k, k - scan.INSIDE) for k in scan.between(span, parts))])
FLANKS9 = NEIGHBOURS9 + ", win AS (" + " UNION ALL ".join(f"({windows(*t)})" for t in kmers.templates(8)) + f"""), plc(gap, span, place, o) AS (VALUES {PLACES}),
occ2 AS (SELECT c.gap, c.word, seq_id, grp, i, FALSE AS turned FROM win JOIN cand c ON c.gap = win.gap AND c.word = win.word UNION ALL SELECT c.gap, c.word, seq_id, grp, i, TRUE FROM win JOIN cand c ON c.gap = win.gap AND c.word = {rc('win.word')} AND c.word <> win.word),
fl AS (SELECT gap, word, q.grp, place, CASE WHEN turned THEN translate(substr(u, spot, 1), 'ACGT', 'TGCA') ELSE substr(u, spot, 1) END AS base FROM (SELECT occ2.*, place, CASE WHEN turned THEN i + span - 1 - o ELSE i + o END AS spot FROM occ2 JOIN plc USING (gap)) q JOIN seq USING (seq_id) WHERE spot >= 1 AND substr(u, spot, 1) IN ('A', 'C', 'G', 'T')),
flank AS (SELECT gap, word, place::BIGINT AS place, base, count(*) FILTER (WHERE grp = 'test') AS f1, count(*) FILTER (WHERE grp = 'ctrl') AS f2 FROM fl GROUP BY ALL)"""


def gamma_q_sql(doubled, x):
    """SQL of stats.gamma_q."""
    if doubled % 2 == 0:
        return f"exp(-({x})) * (" + " + ".join(f"pow({x}, {i}) / {math.factorial(i)}" for i in range(doubled // 2)) + ")"
    return f"{erfc_sql(f'sqrt({x})')} + exp(-({x})) * (" + " + ".join(f"pow({x}, {i + 0.5}::DOUBLE) / {math.gamma(i + 1.5)!r}::DOUBLE" for i in range(doubled // 2)) + ")"


GTEST9 = """, grid AS (SELECT cand.gap, word, place::BIGINT AS place, base FROM cand JOIN plc USING (gap), (VALUES ('A'), ('C'), ('G'), ('T')) b(base)), full_flank AS (SELECT g.gap, g.word, g.place, g.base, coalesce(f1, 0) + (g.place IN (1, 2))::INT AS f1, coalesce(f2, 0) + (g.place IN (1, 2))::INT AS f2 FROM grid g LEFT JOIN flank USING (gap, word, place, base)),
col AS (SELECT gap, word, place, sum(f1) AS t, sum(f2) AS c, sum(CASE WHEN f1 > 0 THEN f1 * ln(f1) ELSE 0 END + CASE WHEN f2 > 0 THEN f2 * ln(f2) ELSE 0 END - CASE WHEN f1 + f2 > 0 THEN (f1 + f2) * ln(f1 + f2) ELSE 0 END) AS s FROM full_flank GROUP BY ALL),
gt AS (SELECT gap, word, greatest(sum(CASE WHEN t + c > 0 THEN 2 * (s - CASE WHEN t > 0 THEN t * ln(t) ELSE 0 END - CASE WHEN c > 0 THEN c * ln(c) ELSE 0 END + (t + c) * ln(t + c)) / (1 + 5.0::DOUBLE / 6 / (t + c)) ELSE 0 END), 0) AS g FROM col GROUP BY gap, word),
gp AS (""" + " UNION ALL ".join(f"(SELECT gap, word, g, least(2 * ({gamma_q_sql(12 + 3 * len(scan.between(span, parts)), 'g / 2')}), 1) AS p FROM gt WHERE gap = {g})" for g, span, parts in kmers.templates(8)) + ")"
FISHER9 = FLANKS9 + GTEST9 + f", fp AS (SELECT gap, word, z, ratio, x, gp.p AS p_flank, greatest(gp.p * (0.5 * {erfc_sql('z / sqrt(2.0::DOUBLE)')}), 1e-30) AS prod FROM cand JOIN gp USING (gap, word)), pp AS (SELECT *, 2 * prod * (1 - ln(prod)) AS p FROM fp)"
FDR9 = FISHER9 + f", nh AS (SELECT gap, count(*) AS n FROM st WHERE {CONSIDERED} GROUP BY gap), bh AS (SELECT gap, word, z, ratio, p, row_number() OVER (PARTITION BY gap ORDER BY p, word) AS r, n FROM pp JOIN nh USING (gap)), fd AS (SELECT gap, word, z, ratio, least(1, min(p / r * n) OVER (PARTITION BY gap ORDER BY p DESC, word DESC)) AS fdr FROM bh)"


def core_cells(st, cand):
    """gap, word, p, b, v: what the words of the same template that differ from a candidate in one place have more in test, by place and base."""
    bases = F.explode(F.array(*(F.lit(b) for b in "ACGT"))).alias("b")
    nb = cand.select("gap", "word", F.explode(F.sequence(F.lit(1), F.lit(8))).alias("p")).select("gap", "word", "p", bases)
    w = F.concat(F.expr("substring(word, 1, p - 1)"), F.col("b"), F.expr("substring(word, p + 1, 8)"))
    nb = nb.withColumn("w", w).withColumn("key", seq.canonical(F.col("w")))
    diffs = st.select("gap", F.col("word").alias("key"), "diff")
    return nb.join(diffs, ["gap", "key"], "left").select("gap", "word", F.col("p").cast("long").alias("p"), "b", F.greatest(F.coalesce("diff", F.lit(0.0)), F.lit(0.0)).alias("v"))


@query(NEIGHBOURS + " SELECT word, p, b, round(v, 4) AS v FROM core")
def neighbor_pfm(spark, sf_dir):
    st = counted(spark, sf_dir)
    return core_cells(st, enrich.candidates(st)).select("word", "p", "b", F.round("v", 4).alias("v"))


@query(NEIGHBOURS9 + " SELECT gap, word, p, b, round(v, 4) AS v FROM core")
def neighbor_pfm_gapped(spark, sf_dir):
    """As neighbor_pfm, for the candidates of all templates."""
    st = counted(spark, sf_dir, GAPS)
    return core_cells(st, enrich.candidates(st)).withColumn("v", F.round("v", 4))


FLANKS = NEIGHBOURS + ", win AS (" + windows(*TEMPLATE) + f"""), occ2 AS (SELECT c.word, seq_id, grp, i, FALSE AS turned FROM win JOIN cand c ON c.word = win.word UNION ALL SELECT c.word, seq_id, grp, i, TRUE FROM win JOIN cand c ON c.word = {rc('win.word')} AND c.word <> win.word),
fl AS (SELECT o.word, o.grp, o.d AS place, CASE WHEN turned THEN translate(x, 'ACGT', 'TGCA') ELSE x END AS base FROM (SELECT o.*, d.d, substr(u, i + CASE WHEN turned THEN CASE WHEN d.d < 0 THEN 7 - d.d ELSE -d.d END ELSE CASE WHEN d.d < 0 THEN d.d ELSE 7 + d.d END END, 1) AS x, i + CASE WHEN turned THEN CASE WHEN d.d < 0 THEN 7 - d.d ELSE -d.d END ELSE CASE WHEN d.d < 0 THEN d.d ELSE 7 + d.d END END AS spot
   FROM occ2 o JOIN seq USING (seq_id), (VALUES (-2), (-1), (1), (2)) d(d)) o WHERE spot >= 1 AND x IN ('A', 'C', 'G', 'T')),
flank AS (SELECT word, place::BIGINT AS place, base, count(*) FILTER (WHERE grp = 'test') AS f1, count(*) FILTER (WHERE grp = 'ctrl') AS f2 FROM fl GROUP BY ALL)"""


def flank_counts(seqs, cand):
    names = {}
    for r in cand.select("gap", "word").orderBy("gap", "word").collect():  # at most 4**8 words a template
        names.setdefault(r["gap"], []).append(r["word"])
    of = lambda g: F.coalesce(F.sum(F.when(F.col("grp") == g, F.col("n"))), F.lit(0)).cast("long")
    return scan.flanks(seqs, names).groupBy("gap", "word", "place", "base").agg(of("test").alias("f1"), of("ctrl").alias("f2"))


@query(FLANKS + " SELECT word, place, base, f1, f2 FROM flank")
def flank_pfm(spark, sf_dir):
    """Bases around the candidates in test and control."""
    return flank_counts(sequences(spark, sf_dir), enrich.candidates(counted(spark, sf_dir))).drop("gap")


@query(FLANKS9 + " SELECT gap, word, place, base, f1, f2 FROM flank", slow=True)
def flank_pfm_gapped(spark, sf_dir):
    """Bases before and after the whole span of the candidates of all templates."""
    return flank_counts(sequences(spark, sf_dir), enrich.candidates(counted(spark, sf_dir, GAPS)))


GRID = ", grid AS (SELECT word, place::BIGINT AS place, base FROM cand, (VALUES (-2), (-1), (1), (2)) v(place), (VALUES ('A'), ('C'), ('G'), ('T')) b(base)), full_flank AS (SELECT g.word, g.place, g.base, coalesce(f1, 0) + (g.place > 0)::INT AS f1, coalesce(f2, 0) + (g.place > 0)::INT AS f2 FROM grid g LEFT JOIN flank USING (word, place, base))"
GTEST = GRID + """, col AS (SELECT word, place, sum(f1) AS t, sum(f2) AS c, sum(CASE WHEN f1 > 0 THEN f1 * ln(f1) ELSE 0 END + CASE WHEN f2 > 0 THEN f2 * ln(f2) ELSE 0 END - CASE WHEN f1 + f2 > 0 THEN (f1 + f2) * ln(f1 + f2) ELSE 0 END) AS s FROM full_flank GROUP BY ALL),
gt AS (SELECT word, greatest(sum(CASE WHEN t + c > 0 THEN 2 * (s - CASE WHEN t > 0 THEN t * ln(t) ELSE 0 END - CASE WHEN c > 0 THEN c * ln(c) ELSE 0 END + (t + c) * ln(t + c)) / (1 + 5.0::DOUBLE / 6 / (t + c)) ELSE 0 END), 0) AS g FROM col GROUP BY word),
gp AS (SELECT word, g, least(2 * exp(-g / 2) * (1 + g / 2 + (g / 2) ** 2 / 2 + (g / 2) ** 3 / 6 + (g / 2) ** 4 / 24 + (g / 2) ** 5 / 120), 1) AS p FROM gt)"""


def full_flanks(cand, flank):
    """Every place and base of every candidate, those its template skips included; after the word each count is 1 higher."""
    every = lambda xs: F.explode(F.array(*(F.lit(x) for x in xs)))
    places = F.create_map(*(x for g, span, parts in kmers.templates(8) for x in (F.lit(g).cast("long"), F.array(*(F.lit(k).cast("long") for k in (-2, -1, 1, 2, *scan.between(span, parts)))))))
    grid = cand.select("gap", "word", F.explode(places[F.col("gap")]).alias("place")).select("gap", "word", "place", every("ACGT").alias("base"))
    more = F.when(F.col("place").isin(1, 2), 1).otherwise(0)
    fill = lambda c: (F.coalesce(c, F.lit(0)) + more).cast("long").alias(c)
    return grid.join(flank, ["gap", "word", "place", "base"], "left").select("gap", "word", "place", "base", fill("f1"), fill("f2"))


def g_test(flanks):
    """gap, word, g, p: whether the bases around a word are dealt in test as in control, over four places and those its template skips."""
    xlogx = lambda x: F.when(x > 0, x * F.log(x)).otherwise(0.0)
    f1, f2 = F.col("f1"), F.col("f2")
    col = flanks.groupBy("gap", "word", "place").agg(F.sum("f1").alias("t"), F.sum("f2").alias("c"), F.sum(xlogx(f1) + xlogx(f2) - xlogx(f1 + f2)).alias("s"))
    n = F.col("t") + F.col("c")
    g = F.when(n > 0, 2 * (F.col("s") - xlogx(F.col("t")) - xlogx(F.col("c")) + xlogx(n)) / (1 + 5.0 / 6 / n)).otherwise(0.0)
    rows = col.groupBy("gap", "word").agg(F.greatest(F.sum(g), F.lit(0.0)).alias("g"))
    q = stats.gamma_q(12, F.col("g") / 2)
    for gap, span, parts in kmers.templates(8)[1:]:  # 3 degrees of freedom for each column, skipped ones as well
        q = F.when(F.col("gap") == gap, stats.gamma_q(12 + 3 * len(scan.between(span, parts)), F.col("g") / 2)).otherwise(q)
    return rows.withColumn("p", F.least(2 * q, F.lit(1.0)))


@query(FLANKS + GTEST + " SELECT word, round(g, 4) AS g, round(p, 6) AS p FROM gp")
def flank_gtest(spark, sf_dir):
    cand = enrich.candidates(counted(spark, sf_dir))
    rows = g_test(full_flanks(cand, flank_counts(sequences(spark, sf_dir), cand)))
    return rows.select("word", F.round("g", 4).alias("g"), F.round("p", 6).alias("p"))


@query(FLANKS9 + GTEST9 + " SELECT gap, word, round(g, 4) AS g, round(p, 6) AS p FROM gp", slow=True)
def flank_gtest_gapped(spark, sf_dir):
    cand = enrich.candidates(counted(spark, sf_dir, GAPS))
    rows = g_test(full_flanks(cand, flank_counts(sequences(spark, sf_dir), cand)))
    return rows.select("gap", "word", F.round("g", 4).alias("g"), F.round("p", 6).alias("p"))


FISHER = FLANKS + GTEST + f", fp AS (SELECT word, z, ratio, x, gp.p AS p_flank, greatest(gp.p * (0.5 * {erfc_sql('z / sqrt(2.0::DOUBLE)')}), 1e-30) AS prod FROM cand JOIN gp USING (word)), pp AS (SELECT *, 2 * prod * (1 - ln(prod)) AS p FROM fp)"


def combined(spark, sf_dir, gaps=(0,)):
    st = counted(spark, sf_dir, gaps)
    cand = enrich.candidates(st)
    g = g_test(full_flanks(cand, flank_counts(sequences(spark, sf_dir), cand)))
    rows = cand.select("gap", "word", "z", "ratio", "x").join(g.select("gap", "word", F.col("p").alias("p_flank")), ["gap", "word"])
    return st, rows.withColumn("p", stats.fisher(F.col("p_flank"), 0.5 * stats.erfc(F.col("z") / F.sqrt(F.lit(2.0)))))


@query(FISHER + " SELECT word, round(p, 6) AS p FROM pp")
def fisher_p(spark, sf_dir):
    """Evidence of the count and of the flanks in one p-value."""
    return combined(spark, sf_dir)[1].select("word", F.round("p", 6).alias("p"))


@query(FISHER9 + " SELECT gap, word, round(p, 6) AS p FROM pp", slow=True)
def fisher_p_gapped(spark, sf_dir):
    return combined(spark, sf_dir, GAPS)[1].select("gap", "word", F.round("p", 6).alias("p"))


def discovered(spark, sf_dir):
    """The candidates of all templates with fdr, by the hypotheses of their own template."""
    st, rows = combined(spark, sf_dir, GAPS)
    n = enrich.considered(st).groupBy("gap").agg(F.count(F.lit(1)).alias("n_hyp"))  # 9 rows
    return enrich.false_discovery(rows.join(F.broadcast(n), "gap"))


@query(FDR9 + " SELECT gap, word, round(fdr, 6) AS fdr FROM fd", slow=True)
def fdr_bh_gapped(spark, sf_dir):
    return discovered(spark, sf_dir).select("gap", "word", F.round("fdr", 6).alias("fdr"))


@query(FISHER + f", nh AS (SELECT count(*) AS n FROM st WHERE {CONSIDERED}), bh AS (SELECT word, p, row_number() OVER (ORDER BY p, word) AS r, n FROM pp, nh) SELECT word, round(least(1, min(p / r * n) OVER (ORDER BY p DESC, word DESC)), 6) AS fdr FROM bh")
def fdr_bh(spark, sf_dir):
    st, rows = combined(spark, sf_dir)
    n = enrich.considered(st).agg(F.count(F.lit(1)).alias("n_hyp"))
    return enrich.false_discovery(rows.crossJoin(F.broadcast(n))).select("word", F.round("fdr", 6).alias("fdr"))


@query(NEIGHBOURS + " SELECT word, round(z, 4) AS plain, round(z * (ratio - 1), 4) AS by_ratio, row_number() OVER (ORDER BY round(z * (ratio - 1), 6) DESC, word) AS place FROM cand")
def score_options(spark, sf_dir):
    """Scores of the candidates, alone and weighted by their ratio; candidates are at most the words of one length."""
    c = enrich.candidates(counted(spark, sf_dir))
    by = F.col("z") * (F.col("ratio") - 1)
    return c.select("word", F.round("z", 4).alias("plain"), F.round(by, 4).alias("by_ratio"), F.row_number().over(Window.orderBy(F.round(by, 6).desc(), "word")).cast("long").alias("place"))


@query(NEIGHBOURS9 + " SELECT gap, word, round(z, 4) AS plain, round(z * (ratio - 1), 4) AS by_ratio, row_number() OVER (ORDER BY round(z * (ratio - 1), 6) DESC, gap, word) AS place FROM cand")
def score_options_gapped(spark, sf_dir):
    """As score_options, with the candidates of all templates in one order; at most the words of nine templates."""
    c = enrich.candidates(counted(spark, sf_dir, GAPS))
    by = F.col("z") * (F.col("ratio") - 1)
    return c.select("gap", "word", F.round("z", 4).alias("plain"), F.round(by, 4).alias("by_ratio"), F.row_number().over(Window.orderBy(F.round(by, 6).desc(), "gap", "word")).cast("long").alias("place"))


@query(NEIGHBOURS + """, r AS (SELECT word, p, list(v ORDER BY b) AS r, sum(v) AS s FROM core GROUP BY word, p), q AS (SELECT word, p, list_transform(r, lambda x: CASE WHEN s = 0 THEN 25 ELSE 100 * x / s END) AS r FROM r),
m AS (SELECT word, list_sort(list(list_min(r)))[5] AS med FROM q GROUP BY word), c AS (SELECT word, p, list_transform(r, lambda x: greatest(x - med, 0)) AS r FROM q JOIN m USING (word)),
n AS (SELECT word, p, list_transform(r, lambda x: CASE WHEN list_sum(r) = 0 THEN 25 ELSE 100 * x / list_sum(r) END) AS r FROM c)
SELECT word, p, round(r[1], 4) AS a, round(r[2], 4) AS c, round(r[3], 4) AS g, round(r[4], 4) AS t FROM n""")
def pfm_contrast(spark, sf_dir):
    """Core matrices in percent, less the median of their rows' least cells."""
    return contrast(counted(spark, sf_dir)).drop("gap")


@query(NEIGHBOURS9 + """, r AS (SELECT gap, word, p, list(v ORDER BY b) AS r, sum(v) AS s FROM core GROUP BY gap, word, p), q AS (SELECT gap, word, p, list_transform(r, lambda x: CASE WHEN s = 0 THEN 25 ELSE 100 * x / s END) AS r FROM r),
m AS (SELECT gap, word, list_sort(list(list_min(r)))[5] AS med FROM q GROUP BY gap, word), c AS (SELECT gap, word, p, list_transform(r, lambda x: greatest(x - med, 0)) AS r FROM q JOIN m USING (gap, word)),
n AS (SELECT gap, word, p, list_transform(r, lambda x: CASE WHEN list_sum(r) = 0 THEN 25 ELSE 100 * x / list_sum(r) END) AS r FROM c)
SELECT gap, word, p, round(r[1], 4) AS a, round(r[2], 4) AS c, round(r[3], 4) AS g, round(r[4], 4) AS t FROM n""")
def pfm_contrast_gapped(spark, sf_dir):
    """As pfm_contrast, for the candidates of all templates."""
    return contrast(counted(spark, sf_dir, GAPS))


def contrast(st):
    rows = core_cells(st, enrich.candidates(st)).groupBy("gap", "word", "p").agg(F.transform(F.sort_array(F.collect_list(F.struct("b", "v"))), lambda s: s["v"]).alias("r"))
    share = lambda r: F.transform(r, lambda x: F.when(pfm.total(r) == 0, 25.0).otherwise(100 * x / pfm.total(r)))
    rows = rows.select("gap", "word", "p", share(F.col("r")).alias("r"))
    med = rows.groupBy("gap", "word").agg(F.sort_array(F.collect_list(F.array_min("r")))[4].alias("med"))
    rows = rows.join(med, ["gap", "word"]).withColumn("r", F.transform("r", lambda x: F.greatest(x - F.col("med"), F.lit(0.0))))
    out = share(F.col("r"))
    return rows.select("gap", "word", "p", *(F.round(out[k], 4).alias(n) for k, n in enumerate("acgt")))


@query(SCAN + ", c AS (SELECT h.motif, h.seq_id, h.strand, h.start, h.score, j, substr(match, j, 1) AS b FROM hit h, range(1, 9) t(j)) SELECT c.motif, seq_id, strand, start, round(sum(z[strpos('ACGT', b)]), 4) AS again FROM c JOIN fz ON fz.motif = c.motif AND fz.p = c.j GROUP BY ALL")
def rescore(spark, sf_dir):
    """Scores of stored hits under the matrix, cell by cell."""
    cells_ = [(m, j + 1, b, row[k]) for m, rows in family_cores(spark, sf_dir) for j, row in enumerate(rows) for k, b in enumerate("ACGT")]
    table = F.broadcast(spark.createDataFrame(cells_, "motif string, p int, base string, w double"))  # 32 rows a motif
    rows = with_match(found(spark, sf_dir), sequences(spark, sf_dir)).select("motif", "seq_id", "strand", "start", F.posexplode(F.split("match", "")).alias("i", "base"))
    rows = rows.withColumn("p", F.col("i") + 1).join(table, ["motif", "p", "base"])
    return rows.groupBy("motif", "seq_id", "strand", "start").agg(F.round(F.sum("w"), 4).alias("again"))


@query(FISHER + f""", nh AS (SELECT count(*) AS n FROM st WHERE {CONSIDERED}), bh AS (SELECT word, z, ratio, p, row_number() OVER (ORDER BY p, word) AS r, n FROM pp, nh),
fd AS (SELECT word, z, ratio, least(1, min(p / r * n) OVER (ORDER BY p DESC, word DESC)) AS fdr FROM bh), pl AS (SELECT *, row_number() OVER (ORDER BY round(z, 6) DESC, word) AS place, count(*) FILTER (WHERE fdr <= 0.1) OVER () AS good FROM fd)
SELECT word, round(z, 6) AS z, round(fdr, 6) AS fdr FROM pl WHERE ratio >= 1.5 AND (fdr <= 0.1 OR good < 100 AND place <= 100) ORDER BY round(z, 6) DESC, word LIMIT 500""")
def top_motifs(spark, sf_dir, most=500, limit=0.1):
    """The report: significant words best first, at least the best hundred, at most 500."""
    st, rows = combined(spark, sf_dir)
    n = enrich.considered(st).agg(F.count(F.lit(1)).alias("n_hyp"))
    return report(enrich.false_discovery(rows.crossJoin(F.broadcast(n))), ["word"], most, limit)


@query(FDR9 + """, pl AS (SELECT gap, word, z, ratio, fdr, row_number() OVER (ORDER BY round(z, 6) DESC, gap, word) AS place, count(*) FILTER (WHERE fdr <= 0.1) OVER () AS good FROM fd)
SELECT gap, word, round(z, 6) AS z, round(fdr, 6) AS fdr FROM pl WHERE ratio >= 1.5 AND (fdr <= 0.1 OR good < 100 AND place <= 100) ORDER BY round(z, 6) DESC, gap, word LIMIT 500""", slow=True)
def top_motifs_gapped(spark, sf_dir, most=500, limit=0.1):
    """The report over all nine templates, ranked together."""
    return report(discovered(spark, sf_dir), ["gap", "word"], most, limit)


def report(rows, key, most, limit):
    rows = rows.withColumn("z", F.round("z", 6))
    rows = rows.withColumn("place", F.row_number().over(Window.orderBy(F.desc("z"), *key)))  # at most the words of each template
    good = rows.agg(F.count(F.when(F.col("fdr") <= limit, 1)).alias("good"))
    rows = rows.crossJoin(F.broadcast(good)).where((F.col("ratio") >= 1.5) & ((F.col("fdr") <= limit) | ((F.col("good") < 100) & (F.col("place") <= 100))))
    return rows.orderBy(F.desc("z"), *key).limit(most).select(*key, "z", F.round("fdr", 6).alias("fdr"))


@query()
def background_sequences(spark, sf_dir):
    """A random control: sequences as long as the test's, from its own third-order transitions."""
    seqs = sequences(spark, sf_dir).where("grp = 'test'")
    table = [tuple(r) for r in words.markov3_transitions(spark, sf_dir).select("context", "next", "n").collect()]
    return background.markov(seqs, table).select("seq_id", F.length("u").cast("long").alias("n"), F.md5(F.col("u").cast("binary")).alias("digest"))


@query()
def refine(spark, sf_dir, turns=3):
    """Matrices after some turns of: scan, count bases of the hits, subtract the scaled control, renormalise.

    What passes the driver each turn is one matrix a motif; a motif without hits keeps the one it has.
    """
    seqs = sequences(spark, sf_dir)
    totals = enrich.lengths(seqs).first()
    share, matrices = totals["len1"] / max(1, totals["len2"]), dict(family_cores(spark, sf_dir))
    for _ in range(turns):
        rows = with_match(scan.scan(seqs, scan.word_scores(list(matrices.items())), THRESHOLD), seqs).select("motif", "grp", F.posexplode(F.split("match", "")).alias("p", "base"))
        of = lambda g: F.count(F.when(F.col("grp") == g, 1))
        counts = {(r["motif"], r["p"], r["base"]): r["v"] for r in rows.groupBy("motif", "p", "base").agg(F.greatest(F.lit(1.0), of("test") - share * of("ctrl")).alias("v")).collect()}
        for motif in {k[0] for k in counts}:
            v = [[counts.get((motif, p, b), 1.0) for b in "ACGT"] for p in range(8)]
            matrices[motif] = [[math.log10(4 * x / sum(row)) for x in row] for row in v]
    cells_ = [(m, p + 1, *(round(x, 6) for x in row)) for m, rows in sorted(matrices.items()) for p, row in enumerate(rows)]
    return spark.createDataFrame(cells_, "motif string, p long, a double, c double, g double, t double")


@query(CELLS + " SELECT motif, p, base, round(log10(4 * greatest(1, f1) / sum(greatest(1, f1)) OVER (PARTITION BY motif, p)), 6) AS weight FROM cell")
def refine_resample(spark, sf_dir):
    """New log-odds of each cell from its count in test alone."""
    rows = cells(spark, sf_dir).withColumn("v", F.greatest(F.lit(1.0), F.col("f1").cast("double")))
    return rows.select("motif", "p", "base", F.round(F.log10(4 * F.col("v") / F.sum("v").over(Window.partitionBy("motif", "p"))), 6).alias("weight"))


@query(SCAN + f""", {LENGTHS}, s AS (SELECT motif, count(*) FILTER (WHERE grp = 'test') AS n1, count(*) FILTER (WHERE grp = 'ctrl') AS n2 FROM hit GROUP BY motif)
SELECT motif, round((s.n1 - s.n2 * len1 / len2) / sqrt(nullif(s.n2 * len1 / len2, 0)), 6) AS score FROM s, tot""")
def refine_score(spark, sf_dir):
    """Hits above those of the scaled control, in roots of the latter; null without any in control."""
    s = fp_threshold(spark, sf_dir)
    seqs = enrich.lengths(sequences(spark, sf_dir)).select("len1", "len2")
    scaled = F.col("n2") * F.col("len1") / F.col("len2")
    return s.select("motif", "n1", "n2").crossJoin(F.broadcast(seqs)).select("motif", F.round(F.when(scaled != 0, (F.col("n1") - scaled) / F.sqrt(scaled)), 6).alias("score"))


@query()
def background_uniform(spark, sf_dir):
    """A control of random bases, all equally likely, as long as the test's sequences."""
    seqs = sequences(spark, sf_dir).where("grp = 'test'")
    return background.markov(seqs, [], seed=2).select("seq_id", F.length("u").cast("long").alias("n"), F.md5(F.col("u").cast("binary")).alias("digest"))


@query()
def enriched_markov(spark, sf_dir):
    """Candidates of the test's sequences against a random control from their own transitions: what is done when no control
    is given."""
    seqs = sequences(spark, sf_dir).where("grp = 'test'").select("seq_id", "grp", "u")
    table = [tuple(r) for r in words.markov3_transitions(spark, sf_dir).select("context", "next", "n").collect()]  # at most 256
    both = seqs.unionByName(background.markov(seqs, table).select("seq_id", F.lit("ctrl").alias("grp"), "u"))
    st = enrich.statistics(enrich.fold(kmers.pivot_groups(kmers.count_words(both))), enrich.lengths(both), words.SPANS)
    return enrich.candidates(st).select("word", "x", "y", F.round("z", 6).alias("z"), F.round("ratio", 6).alias("ratio"))


@query(words.GAP0 + f""", {words.PIVOT}, {words.FOLD}, {words.PROFILE}, {LENGTHS}, sh AS (SELECT *, n / sum(n) OVER (PARTITION BY grp) AS share FROM pro),
b AS (SELECT a.n_cg, a.share / c.share AS f, a.cpg / nullif(c.cpg, 0) AS g FROM sh a JOIN sh c USING (n_cg) WHERE a.grp = 'test' AND c.grp = 'ctrl')
SELECT word, x, y, round((x + 5) / (y * (len1 / len2 * f * pow(coalesce(g, 1), {words.CPG})) + 5), 6) AS ratio FROM folded JOIN b ON {words.CG} = b.n_cg, tot""")
def enrichment_cg(spark, sf_dir):
    """Enrichment ratio with the control's counts adjusted to the test's share of C and G and of CG in a row."""
    seqs = sequences(spark, sf_dir)
    counts = kmers.count_words(seqs)
    folded = enrich.fold(kmers.pivot_groups(counts)).withColumn("n_cg", seq.count_cg(F.col("word"))).withColumn("n_cpg", seq.count_cpg(F.col("word")))
    factor = words.composition(counts, seqs)  # at most 9 rows
    rows = folded.join(F.broadcast(factor), "n_cg")
    return rows.select("word", "x", "y", F.round((F.col("x") + 5) / (F.col("y") * F.col("f") * F.pow("g", F.col("n_cpg")) + 5), 6).alias("ratio"))


def family_best(spark, sf_dir):
    """motif (the vec_id), m: all 16 columns of each label's member with the most information; ties: the least id."""
    rows = motifs(spark, sf_dir).select("label", "vec_id", "pfm", F.round(pfm.total(pfm.information(F.col("pfm"))), 6).alias("bits"))
    best = rows.groupBy("label").agg(F.max_by(F.struct("vec_id", "pfm"), F.struct("bits", -F.col("vec_id"))).alias("x"))
    return best.select(F.col("x.vec_id").alias("motif"), pfm.logodds(F.col("x.pfm")).alias("m"))


BEST = WHOLE.replace("turned AS (SELECT vec_id, '+' AS strand, least, m FROM lim UNION ALL SELECT vec_id, '-', least, list_transform(list_reverse(m), lambda r: list_reverse(r)) FROM lim)", f"""bits AS (SELECT vec_id, label, round(sum({BITS}), 6) AS bits FROM pos GROUP BY ALL), chosen AS (SELECT max_by(vec_id, (bits, -vec_id)) AS vec_id FROM bits GROUP BY label), own AS (SELECT lim.* FROM lim JOIN chosen USING (vec_id)),
turned AS (SELECT vec_id, '+' AS strand, least, m FROM own UNION ALL SELECT vec_id, '-', least, list_transform(list_reverse(m), lambda r: list_reverse(r)) FROM own)""")
TURN = BEST.replace(" (SELECT vec_id, strand, least, q, w,", " (SELECT vec_id, strand, least, q, w,") + f""", {LENGTHS}, k AS (SELECT floor(len2 * 5 / 10000)::BIGINT AS rank, len1, len2 FROM tot),
ranked AS (SELECT vec_id, score, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC) - 1 AS r, count(*) OVER (PARTITION BY vec_id) AS total FROM hit WHERE grp = 'ctrl'),
lm AS (SELECT vec_id, any_value(score) AS threshold, any_value(least(rank, total - 1)) AS rank FROM ranked, k WHERE r = least(rank, total - 1) GROUP BY vec_id),
up AS (SELECT hit.*, threshold FROM hit JOIN lm USING (vec_id) WHERE score >= threshold),
nn AS (SELECT vec_id, any_value(threshold) AS threshold, count(*) FILTER (WHERE grp = 'test') AS n1, count(*) FILTER (WHERE grp = 'ctrl') AS n2 FROM up GROUP BY vec_id),
fr AS (SELECT vec_id, j AS p, b, count(*) FILTER (WHERE grp = 'test' AND substr(match, j, 1) = b) AS f1, count(*) FILTER (WHERE grp = 'ctrl' AND substr(match, j, 1) = b) AS f2 FROM up, range(1, 17) t(j), (VALUES ('A'), ('C'), ('G'), ('T')) v(b) GROUP BY ALL),
ce AS (SELECT vec_id, p, b, f1, f2, n1, n2, m[p][strpos('ACGT', b)] AS v, log10(f1 / n1 + 0.01) AS y, log10(f2 / n2 + 0.01) AS x FROM fr JOIN nn USING (vec_id) JOIN own USING (vec_id)),
li AS (SELECT vec_id, coalesce(regr_slope(y, x), 0) AS slope, avg(y) AS my, avg(x) AS mx FROM ce GROUP BY vec_id),
nw AS (SELECT vec_id, p, b, 'regression' AS method, pow(10, v + 0.5 * (y - (my + slope * (x - mx)))) AS w FROM ce JOIN li USING (vec_id) UNION ALL SELECT vec_id, p, b, 'resample', greatest(1, f1)::DOUBLE FROM ce UNION ALL SELECT vec_id, p, b, 'difference', greatest(1, f1 - len1 / len2 * f2) FROM ce, k)
SELECT method, vec_id AS motif, p, b AS base, round(log10(4 * w / sum(w) OVER (PARTITION BY method, vec_id, p)), 6) AS weight, round(threshold, 6) AS threshold, (n1 - floor(rank * len1 / len2))::BIGINT AS freq FROM nw JOIN nn USING (vec_id) JOIN (SELECT vec_id, lm.rank, len1, len2 FROM lm, k) USING (vec_id)"""


@query(TURN)
def refine_turn(spark, sf_dir):
    """One turn of each method over one motif a family: threshold by rank in the control, matrix from the bases above it."""
    seqs = sequences(spark, sf_dir)
    totals, rows = enrich.lengths(seqs).first(), family_best(spark, sf_dir)
    folder = shared_dir(spark, "turn")
    found = saved(refining.texts(seqs, rows, 5.0), folder, "texts")
    scored, limits = refining.thresholds(found, rows, totals, 5.0)
    limits = saved(limits, folder, "limits")
    out = None
    for method in refining.METHODS:
        new = refining.changed(scored, limits, rows, totals, method).select(F.lit(method).alias("method"), "motif", F.posexplode("m").alias("p", "r"))
        out = new if out is None else out.unionByName(new)
    out = out.select("method", "motif", (F.col("p") + 1).cast("long").alias("p"), F.posexplode("r").alias("b", "x")).join(limits, "motif")
    base = F.element_at(F.array(*map(F.lit, "ACGT")), F.col("b") + 1)
    return out.select("method", "motif", "p", base.alias("base"), F.round("x", 6).alias("weight"), "threshold", F.col("freq").cast("long").alias("freq"))


@query()
def refine_loop(spark, sf_dir):
    """Three turns of three sub-turns, and thresholds at the end, over one motif a family; the progress as written to a file
    and read back."""
    seqs = sequences(spark, sf_dir)
    _, progress = refining.refine(seqs, family_best(spark, sf_dir), enrich.lengths(seqs).first(), "regression")
    path = f"{shared_dir(spark, 'progress')}/progress"
    text.write_progress(progress, path, text.PROGRESS)
    return text.read_progress(spark, path)
