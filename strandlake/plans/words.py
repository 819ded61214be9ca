"""Queries over sequences and their words."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import seq
from ..operators import enrich, kmers
from .tables import CANDIDATE, CONSIDERED, COUNTS, FOLD, LENGTHS, PIVOT, SEQ, occurrences, rc, sequences, stats_sql

QUERIES, SQL = {}, {}
TEMPLATES = kmers.templates(8)
SPANS = {g: s for g, s, _ in TEMPLATES}
BY_GAP = "WITH " + SEQ + ", " + occurrences(TEMPLATES) + ", " + COUNTS + " "
GAP0 = "WITH " + SEQ + ", " + occurrences(TEMPLATES[:1]) + ", " + COUNTS + " "


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("WITH " + SEQ + " SELECT seq_id, length(s) AS n, length(s) - length(replace(s, 'N', '')) AS n_missing, md5(s) AS digest FROM seq")
def seq_normalize(spark, sf_dir):
    s = F.col("s")
    return sequences(spark, sf_dir).select("seq_id", F.length(s).cast("long").alias("n"), (F.length(s) - F.length(F.translate(s, "N", ""))).cast("long").alias("n_missing"), F.md5(s.cast("binary")).alias("digest"))


@query("WITH " + SEQ + """ SELECT grp, count(*) AS n_seqs, sum(length(replace(u, 'N', '')))::BIGINT AS bases, sum(length(s) - length(translate(s, 'acgt', '')))::BIGINT AS n_masked,
sum(length(u) - length(replace(u, 'N', '')))::BIGINT AS n_missing, min(length(u)) AS shortest, max(length(u)) AS longest, round(avg(length(u)), 6) AS mean FROM seq GROUP BY grp""")
def seq_stats(spark, sf_dir):
    gone = lambda x, c: F.length(x) - F.length(F.translate(x, c, ""))
    return sequences(spark, sf_dir).groupBy("grp").agg(
        F.count(F.lit(1)).alias("n_seqs"), F.sum(F.length(F.translate("u", "N", ""))).alias("bases"), F.sum(gone("s", "acgt")).alias("n_masked"), F.sum(gone("u", "N")).alias("n_missing"),
        F.min(F.length("u")).cast("long").alias("shortest"), F.max(F.length("u")).cast("long").alias("longest"), F.round(F.avg(F.length("u")), 6).alias("mean"),
    )


@query("WITH " + SEQ + " SELECT seq_id, md5(translate(s, 'acgt', 'NNNN')) AS unmasked, md5(upper(s)) AS both, md5(translate(s, 'ACGTacgt', 'NNNNACGT')) AS masked FROM seq")
def mask_modes(spark, sf_dir):
    return sequences(spark, sf_dir).select("seq_id", *(F.md5(seq.masked(F.col("s"), m).cast("binary")).alias(n) for m, n in enumerate(("unmasked", "both", "masked"))))


@query("WITH " + SEQ + f" SELECT seq_id, md5({rc('s')}) AS digest, {rc(rc('s'))} = s AS same_again FROM seq")
def revcomp(spark, sf_dir):
    r = seq.revcomp(F.col("s"))
    return sequences(spark, sf_dir).select("seq_id", F.md5(r.cast("binary")).alias("digest"), (seq.revcomp(r) == F.col("s")).alias("same_again"))


@query(GAP0 + "SELECT grp, word, n, docs, n_all FROM cnt")
def kmer_count_gap0(spark, sf_dir):
    return kmers.count_words(sequences(spark, sf_dir)).select("grp", "word", "n", "docs", "n_all")


@query(BY_GAP + "SELECT gap, word, sum(n)::BIGINT AS n FROM cnt GROUP BY ALL")
def kmer_count_gapped(spark, sf_dir):
    return kmers.count_words(sequences(spark, sf_dir), gaps=tuple(SPANS)).groupBy("gap", "word").agg(F.sum("n").alias("n"))


@query(GAP0 + "SELECT word, coalesce(sum(docs) FILTER (WHERE grp = 'test'), 0)::BIGINT AS in_test, coalesce(sum(docs) FILTER (WHERE grp = 'ctrl'), 0)::BIGINT AS in_control FROM cnt GROUP BY word")
def kmer_presence(spark, sf_dir):
    return kmers.pivot_groups(kmers.count_words(sequences(spark, sf_dir)), measure="docs").select("word", F.col("x").alias("in_test"), F.col("y").alias("in_control"))


@query(GAP0 + f", {PIVOT}, {FOLD} SELECT word, x, y, word = {rc('word')} AS palindrome FROM folded")
def kmer_canonical(spark, sf_dir):
    folded = enrich.fold(kmers.pivot_groups(kmers.count_words(sequences(spark, sf_dir))))
    return folded.select("word", "x", "y", (F.col("word") == seq.revcomp(F.col("word"))).alias("palindrome"))


@query(GAP0 + f", {PIVOT} SELECT a.word, a.x, coalesce(b.x, 0) AS y FROM xy a LEFT JOIN xy b ON b.word = {rc('a.word')} WHERE a.x > 0")
def kmer_other_strand(spark, sf_dir):
    """Each strand against the other: the control of a word is its reverse complement in the same sequences."""
    x = kmers.pivot_groups(kmers.count_words(sequences(spark, sf_dir))).where("x > 0").select("word", "x")
    other = x.select(seq.revcomp(F.col("word")).alias("word"), F.col("x").alias("y"))
    return x.join(other, "word", "left").select("word", "x", F.coalesce("y", F.lit(0).cast("long")).alias("y"))


@query("WITH " + SEQ + ", " + occurrences(TEMPLATES[:1]) + f""", one AS (SELECT seq_id, least(word, {rc('word')}) AS word, sum(n) AS f FROM occ GROUP BY ALL), c AS (SELECT count(*)::DOUBLE AS n1 FROM seq)
SELECT word, round(sum(f) / n1, 6) AS mean, round(sum(f * f)::DOUBLE - sum(f)::DOUBLE * sum(f)::DOUBLE / n1, 6) AS ss FROM one, c GROUP BY word, n1""")
def kmer_mean_ss(spark, sf_dir):
    """Mean and sum of squares about it of each folded word over all sequences."""
    seqs = sequences(spark, sf_dir)
    n = seqs.agg(F.count(F.lit(1)).cast("double").alias("n1"))
    sums = kmers.count_words(seqs, fold=True).groupBy("word").agg(F.sum("n").cast("double").alias("f"), F.sum("nn").cast("double").alias("ff"))
    return sums.crossJoin(F.broadcast(n)).select("word", F.round(F.col("f") / F.col("n1"), 6).alias("mean"), F.round(F.col("ff") - F.col("f") * F.col("f") / F.col("n1"), 6).alias("ss"))


def profile(counts):
    """n_cg, n, cpg of each group: occurrences by the number of C and G, and their mean number of CG."""
    return counts.groupBy("grp", seq.count_cg(F.col("word")).alias("n_cg")).agg(F.sum("n").alias("n"), (F.sum(F.col("n") * seq.count_cpg(F.col("word"))) / F.sum("n")).alias("cpg"))


CG = "length(word) - length(translate(word, 'CG', ''))"
CPG = "((length(word) - length(replace(word, 'CG', ''))) // 2)"
PROFILE = f"pro AS (SELECT grp, {CG} AS n_cg, sum(n)::BIGINT AS n, sum(n * {CPG}) / sum(n) AS cpg FROM cnt GROUP BY ALL)"


@query(GAP0 + f", {PROFILE} SELECT grp, n_cg, n, round(cpg, 6) AS cpg FROM pro")
def cg_profile(spark, sf_dir):
    return profile(kmers.count_words(sequences(spark, sf_dir))).select("grp", "n_cg", "n", F.round("cpg", 6).alias("cpg"))


@query(GAP0 + f""", {PROFILE}, {LENGTHS}, sh AS (SELECT *, n / sum(n) OVER (PARTITION BY grp) AS share FROM pro),
b AS (SELECT a.n_cg, a.share / c.share AS f, a.cpg / nullif(c.cpg, 0) AS g FROM sh a JOIN sh c USING (n_cg) WHERE a.grp = 'test' AND c.grp = 'ctrl')
SELECT DISTINCT b.n_cg, {CPG} AS n_cpg, round(len1 / len2 * f * pow(coalesce(g, 1), {CPG}), 6) AS adjust FROM (SELECT DISTINCT word FROM cnt), b, tot WHERE {CG} = b.n_cg""")
def cg_adjust(spark, sf_dir):
    """Factor of a control count by the composition of its word; there are at most 9 x 5 compositions."""
    seqs = sequences(spark, sf_dir)
    counts = kmers.count_words(seqs)
    kinds = counts.select(seq.count_cg(F.col("word")).alias("n_cg"), seq.count_cpg(F.col("word")).alias("n_cpg")).distinct()
    return kinds.join(composition(counts, seqs), "n_cg").select("n_cg", "n_cpg", F.round(F.col("f") * F.pow("g", F.col("n_cpg")), 6).alias("adjust"))


def composition(counts, seqs):
    """n_cg, f, g: a control count's factor is f * g ** (CG in a row), by the number of C and G."""
    w = Window.partitionBy("grp")
    pro = profile(counts).withColumn("share", F.col("n") / F.sum("n").over(w))
    a, c = (pro.where(F.col("grp") == g).select("n_cg", F.col("share").alias(f"s_{g}"), F.col("cpg").alias(f"c_{g}")) for g in ("test", "ctrl"))
    both = a.join(c, "n_cg").crossJoin(F.broadcast(enrich.lengths(seqs)))
    g = F.when(F.col("c_ctrl") != 0, F.col("c_test") / F.col("c_ctrl")).otherwise(1.0)
    return both.select("n_cg", (F.col("len1") / F.col("len2") * F.col("s_test") / F.col("s_ctrl")).alias("f"), g.alias("g"))


MARKOV = kmers.templates(4)[:1]


@query("WITH " + SEQ + ", " + occurrences(MARKOV) + ", " + COUNTS + " SELECT substr(word, 1, 3) AS context, substr(word, 4, 1) AS next, sum(n_all)::BIGINT AS n, round(sum(n_all) / sum(sum(n_all)) OVER (PARTITION BY substr(word, 1, 3)), 6) AS p FROM cnt WHERE grp = 'test' GROUP BY 1, 2")
def markov3_transitions(spark, sf_dir):
    words = kmers.count_words(sequences(spark, sf_dir).where("grp = 'test'"), length=4)
    rows = words.groupBy(F.substring("word", 1, 3).alias("context"), F.substring("word", 4, 1).alias("next")).agg(F.sum("n_all").alias("n"))
    return rows.withColumn("p", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("context")), 6))


@query("WITH " + SEQ + ", m AS (SELECT floor(avg(length(u)))::BIGINT AS n FROM seq WHERE grp = 'test') SELECT seq_id, least(length(u), n) AS n, md5(substr(s, 1, n)) AS digest FROM seq, m WHERE grp = 'ctrl'")
def control_trim(spark, sf_dir):
    """Control sequences cut to the mean length of the test's."""
    seqs = sequences(spark, sf_dir)
    m = seqs.where("grp = 'test'").agg(F.floor(F.avg(F.length("u"))).cast("int").alias("m"))
    rows = seqs.where("grp = 'ctrl'").crossJoin(F.broadcast(m)).withColumn("t", F.substring(F.col("s"), F.lit(1), F.col("m")))
    return rows.select("seq_id", F.length("t").cast("long").alias("n"), F.md5(F.col("t").cast("binary")).alias("digest"))


def stats(spark, sf_dir, gaps=(0,)):
    seqs = sequences(spark, sf_dir)
    folded = enrich.fold(kmers.pivot_groups(kmers.count_words(seqs, gaps=gaps)))
    return enrich.statistics(folded, enrich.lengths(seqs), SPANS)


STATS0 = GAP0 + f", {PIVOT}, {FOLD}, {LENGTHS}, {stats_sql(SPANS)} "
STATS = BY_GAP + f", {PIVOT}, {FOLD}, {LENGTHS}, {stats_sql(SPANS)} "


@query(STATS0 + "SELECT word, x, y, round(z, 6) AS z, round(ratio, 6) AS ratio, round(diff, 6) AS diff, round(total, 6) AS total FROM st")
def enrichment_z(spark, sf_dir):
    r = lambda c: F.round(c, 6).alias(c)
    return stats(spark, sf_dir).select("word", "x", "y", r("z"), r("ratio"), r("diff"), r("total"))


@query(STATS + "SELECT gap, word, x, y, round(z, 6) AS z, round(ratio, 6) AS ratio, round(diff, 6) AS diff, round(total, 6) AS total FROM st")
def enrichment_z_gapped(spark, sf_dir):
    r = lambda c: F.round(c, 6).alias(c)
    return stats(spark, sf_dir, tuple(SPANS)).select("gap", "word", "x", "y", r("z"), r("ratio"), r("diff"), r("total"))


@query(STATS0 + f"SELECT row_number() OVER (ORDER BY z DESC, word) AS rank, word, x, y, round(z, 6) AS z, round(ratio, 6) AS ratio FROM st WHERE {CANDIDATE} ORDER BY z DESC, word LIMIT 50")
def enriched_words(spark, sf_dir, top=50):
    """The top of the candidates by z; the report's length is what it asks for."""
    best = enrich.candidates(stats(spark, sf_dir)).orderBy(F.desc("z"), "word").limit(top)
    return best.select(F.row_number().over(Window.orderBy(F.desc("z"), "word")).cast("long").alias("rank"), "word", "x", "y", F.round("z", 6).alias("z"), F.round("ratio", 6).alias("ratio"))


@query(STATS + f"SELECT row_number() OVER (ORDER BY z DESC, gap, word) AS rank, gap, word, x, y, round(z, 6) AS z, round(ratio, 6) AS ratio FROM st WHERE {CANDIDATE} ORDER BY z DESC, gap, word LIMIT 50")
def enriched_words_gapped(spark, sf_dir, top=50):
    """As enriched_words, with the words of all templates ranked together."""
    order = (F.desc("z"), "gap", "word")
    best = enrich.candidates(stats(spark, sf_dir, tuple(SPANS))).orderBy(*order).limit(top)
    return best.select(F.row_number().over(Window.orderBy(*order)).cast("long").alias("rank"), "gap", "word", "x", "y", F.round("z", 6).alias("z"), F.round("ratio", 6).alias("ratio"))


@query(STATS + f"SELECT gap, count(*) AS n_hyp, count(*) FILTER (WHERE {CANDIDATE}) AS n_candidates FROM st WHERE {CONSIDERED} GROUP BY gap")
def hypothesis_count(spark, sf_dir):
    kept = enrich.considered(stats(spark, sf_dir, tuple(SPANS)))
    return kept.groupBy("gap").agg(F.count(F.lit(1)).alias("n_hyp"), F.count(F.when((F.col("ratio") >= 1.5) & (F.col("z") >= 1.643) & (F.col("diff") >= 8), 1)).alias("n_candidates"))


@query(GAP0 + f""", {LENGTHS}, f AS (SELECT least(word, {rc('word')}) AS word, coalesce(sum(docs) FILTER (WHERE grp = 'test'), 0)::BIGINT AS x, coalesce(sum(docs) FILTER (WHERE grp = 'ctrl'), 0)::BIGINT AS y FROM cnt GROUP BY 1),
p0 AS (SELECT word, x, y, n1, n2, least(x::DOUBLE, n1 - 1) AS a, least(greatest(y::DOUBLE, CASE WHEN word = {rc('word')} THEN 1.0 ELSE 2.0 END * (n2 * (1 - exp(-len2 / n2 / 65536)))), n2 - 1) AS b FROM f, tot),
p1 AS (SELECT *, (a + b) / (n1 + n2) AS share FROM p0)
SELECT word, x, y, round(CASE WHEN share > 0 THEN (a / n1 - share) / sqrt(share * (1 - share) * n2 / (n1 + n2 - 1) / n1) ELSE 0 END, 6) AS z, round((a + 5) / (b * (n1 / n2) + 5), 6) AS ratio FROM p1""")
def enrichment_presence(spark, sf_dir):
    """At most one occurrence a sequence and strand."""
    seqs = sequences(spark, sf_dir)
    folded = enrich.fold(kmers.pivot_groups(kmers.count_words(seqs), measure="docs"))
    out = enrich.statistics(folded, enrich.lengths(seqs), SPANS, presence=True)
    return out.select("word", "x", "y", F.round("z", 6).alias("z"), F.round("ratio", 6).alias("ratio"))


@query(GAP0 + "SELECT DISTINCT word, list_sum(list_transform(range(0, 8), lambda i: (strpos('ACGT', substr(word, i + 1, 1)) - 1) * (4 ** i)::BIGINT))::BIGINT AS code, word AS back FROM cnt")
def word_codec(spark, sf_dir):
    words = kmers.count_words(sequences(spark, sf_dir)).select("word").distinct().withColumn("code", seq.word_code(F.col("word")))
    return words.withColumn("back", seq.code_word(F.col("code"), 8))


@query(GAP0 + f"SELECT DISTINCT word, {CG} AS n_cg, {CPG} AS n_cpg FROM cnt")
def word_cg(spark, sf_dir):
    return kmers.count_words(sequences(spark, sf_dir)).select("word").distinct().select("word", seq.count_cg(F.col("word")).alias("n_cg"), seq.count_cpg(F.col("word")).alias("n_cpg"))
