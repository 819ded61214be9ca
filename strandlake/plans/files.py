"""Queries that write the given tables in the field's text formats and read them back, and SQL functions over sequences."""

from pyspark.sql import functions as F

from ..functions import seq, surface
from ..operators import numbering, validate
from ..session import shared_dir
from ..sources import formats, text
from .finish import REPEATS, core_cells, repeat_stats, repeat_words
from .motifs import M, by_row, cells, motifs
from .tables import HITS, SEQ, hits, rc, sequences, table

QUERIES, SQL = {}, {}
PART = 2000


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def named(c, p):
    return F.concat(F.lit(p), F.col(c).cast("string"))


@query("WITH " + SEQ + f""", p AS (SELECT 'S' || seq_id AS name, s, unnest(range(0, (length(s) - 1) // {PART} + 1)) AS k FROM seq WHERE length(s) > 0),
q AS (SELECT CASE WHEN length(s) > {PART} THEN name || '-' || (k + 1) ELSE name END AS name, substr(s, k * {PART} + 1, {PART}) AS t FROM p) SELECT name, length(t) AS n, md5(t) AS digest FROM q WHERE length(t) >= 10""")
def fasta_file(spark, sf_dir):
    """Sequences as FASTA and back, long ones in parts."""
    path = f"{shared_dir(spark, 'fasta')}/sequences"
    text.write_fasta(sequences(spark, sf_dir).select(named("seq_id", "S").alias("name"), F.col("s").alias("seq")), path)
    return text.read_fasta(spark, path, part=PART).select("name", F.length("seq").cast("long").alias("n"), F.md5(F.col("seq").cast("binary")).alias("digest"))


@query("WITH " + SEQ + f""", p AS (SELECT 'S' || seq_id || ' a>b' AS name, s, unnest(range(0, (length(s) - 1) // {PART} + 1)) * {PART} AS start FROM seq WHERE length(s) >= 10)
SELECT name, start::BIGINT AS start, length(substr(s, start + 1, {PART})) AS n, md5(substr(s, start + 1, {PART})) AS digest FROM p""")
def fasta_source(spark, sf_dir):
    """Sequences through the fasta data source and back: long ones in parts with their place, ranges that end anywhere, and
    the sign of a record inside names."""
    formats.register(spark)
    path = f"{shared_dir(spark, 'fasta')}/sequences"
    sequences(spark, sf_dir).select(F.concat(named("seq_id", "S"), F.lit(" a>b")).alias("name"), F.lit(0).cast("long").alias("start"), F.col("s").alias("seq")).write.format("fasta").mode("append").save(path)
    back = spark.read.format("fasta").option("partLetters", PART).option("rangeBytes", 1 << 22).load(path)
    return back.select("name", "start", F.length("seq").cast("long").alias("n"), F.md5(F.col("seq").cast("binary")).alias("digest"))


@query(M + f"SELECT 'M' || vec_id AS name, label AS freq, p, {cells('list_transform(f, lambda x: round(x, 4))').replace('], 6)', '], 4)')} FROM pos JOIN m USING (vec_id, label)")
def pfm_source(spark, sf_dir):
    """Motifs through the pfm data source and back: two folders whose files name their columns in another order."""
    formats.register(spark)
    path = shared_dir(spark, "pfm")
    rows = motifs(spark, sf_dir).select("vec_id", named("vec_id", "M").alias("name"), F.col("label").alias("freq"), F.transform("pfm", lambda r: F.transform(r, lambda x: F.round(x, 4))).alias("pfm"))
    for k, names in enumerate(("name\tfreq", "Freq\tname")):
        rows.where(F.col("vec_id") % 2 == k).drop("vec_id").write.format("pfm").option("Headers", names).mode("append").save(f"{path}/{k}")
    back = spark.read.format("pfm").load(path)
    return back.select("name", "freq", F.posexplode("pfm").alias("p", "r")).select("name", "freq", (F.col("p") + 1).cast("long").alias("p"), *(F.round(F.col("r")[k], 4).alias(n) for k, n in enumerate("acgt")))


@query(M + f"SELECT 'M' || vec_id AS name, p, {cells('list_transform(f, lambda x: 100 * round(x / 100, 6))').replace('], 6)', '], 4)')} FROM pos")
def meme_source(spark, sf_dir):
    """Motifs through the meme data source and back."""
    formats.register(spark)
    path = f"{shared_dir(spark, 'meme')}/motifs"
    motifs(spark, sf_dir).select(named("vec_id", "M").alias("name"), F.lit(100).cast("long").alias("nsites"), "pfm").write.format("meme").mode("append").save(path)
    return by_row(spark.read.format("meme").option("rangeBytes", 1 << 16).load(path).withColumnRenamed("name", "vec_id"), F.col("pfm"), 4).withColumnRenamed("vec_id", "name")


@query("WITH " + SEQ + ", t AS (SELECT seq_id, 5 * (1 + seq_id % 2) AS w, u FROM seq WHERE length(u) > 0) SELECT 'S' || seq_id AS name, w::BIGINT AS interval, ((length(u) + w - 1) // w)::BIGINT AS n, (10 * (length(u) - length(translate(u, 'CG', ''))))::BIGINT AS total FROM t")
def consv_source(spark, sf_dir):
    """Tracks of 5 and of 10 bases a value in one folder: each file goes by its own interval."""
    formats.register(spark)
    path = shared_dir(spark, "track")
    s = sequences(spark, sf_dir).where(F.length("u") > 0)
    for k, w in enumerate((5, 10)):
        values = F.transform(F.sequence(F.lit(0), F.floor((F.length("u") - 1) / w).cast("int")), lambda j: (10 * seq.count_cg(F.substring(F.col("u"), w * j + 1, F.lit(w)))).cast("int"))  # noqa: B023
        rows = s.where(F.col("seq_id") % 2 == k).select(named("seq_id", "S").alias("name"), F.lit(w).cast("long").alias("interval"), values.alias("values"))
        rows.write.format("consv").option("Parameters", f"interval={w}").mode("append").save(f"{path}/{k}")
    back = spark.read.format("consv").load(f"{path}/*")
    return back.select("name", "interval", F.size("values").cast("long").alias("n"), F.aggregate("values", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query(M + f"SELECT 'M' || vec_id AS name, p, {cells('f').replace('6)', '4)')} FROM pos")
def pfm_file(spark, sf_dir):
    """Motifs as text and back, by their head columns."""
    path = f"{shared_dir(spark, 'pfm')}/motifs"
    rows = motifs(spark, sf_dir).select(named("vec_id", "M").alias("name"), F.lit(100).alias("freq"), F.transform("pfm", lambda r: F.transform(r, lambda x: F.round(x, 4))).alias("pfm"))
    text.write_pfm(rows, path, columns=("name", "freq"))
    back = text.read_pfm(spark, path, columns=("name", "freq")).withColumnRenamed("name", "vec_id")
    return by_row(back, F.col("pfm"), 4).withColumnRenamed("vec_id", "name")


@query(M + f"SELECT 'M' || vec_id AS name, p, {cells('list_transform(f, lambda x: 100 * round(x / 100, 6))').replace('], 6)', '], 4)')} FROM pos")
def meme_file(spark, sf_dir):
    path = f"{shared_dir(spark, 'meme')}/motifs"
    text.write_meme(motifs(spark, sf_dir).select(named("vec_id", "M").alias("name"), F.lit(100).alias("nsites"), "pfm"), path)
    return by_row(text.read_meme(spark, path).withColumnRenamed("name", "vec_id"), F.col("pfm"), 4).withColumnRenamed("vec_id", "name")


@query("WITH " + HITS + """, d AS (SELECT doc_id FROM documents), n AS (SELECT 'S' || doc_id AS seq_name, 'NONE' AS motif FROM d WHERE doc_id NOT IN (SELECT seq_id FROM hits))
SELECT motif, seq_name, count(*) AS n, coalesce(sum(start), -1)::BIGINT AS starts, round(coalesce(max(score), -1), 6) AS best FROM (SELECT motif, 'S' || seq_id AS seq_name, start, score FROM hits UNION ALL SELECT motif, seq_name, NULL, NULL FROM n) GROUP BY 1, 2""")
def hits_file(spark, sf_dir):
    """Hits as text and back, with NONE rows of sequences without any."""
    path = f"{shared_dir(spark, 'hits')}/hits"
    names = table(spark, sf_dir, "documents").select(named("doc_id", "S").alias("seq_name"))
    text.write_hits(hits(spark, sf_dir).select("motif", named("seq_id", "S").alias("seq_name"), "strand", "len", "start", "score", F.lit("").alias("match")), path, names)
    back = text.read_hits(spark, path)
    fill = lambda c: F.coalesce(c, F.lit(-1))
    return back.groupBy("motif", "seq_name").agg(F.count(F.lit(1)).alias("n"), fill(F.sum("start")).cast("long").alias("starts"), F.round(fill(F.max("score")), 6).alias("best"))


@query("WITH " + HITS + " SELECT motif, seq_id AS seq_no, 'S' || seq_id AS seq_name, CASE WHEN strand = '+' THEN 1 ELSE -1 END::BIGINT AS dir, start AS pos, (SELECT count(*) FROM documents) AS n_seqs FROM hits WHERE motif IN ('click', 'error', 'view')")
def positions_file(spark, sf_dir):
    """Positions as text and back; those of motifs that aren't wanted drop out."""
    path = f"{shared_dir(spark, 'positions')}/positions"
    rows = hits(spark, sf_dir).select("motif", F.col("seq_id").alias("seq_no"), named("seq_id", "S").alias("seq_name"), F.when(F.col("strand") == "+", 1).otherwise(-1).alias("dir"), F.col("start").alias("pos"))
    text.write_positions(rows, path, table(spark, sf_dir, "documents").count())
    return text.read_positions(spark, path, spark.createDataFrame([("click",), ("error",), ("view",)], "motif string"))


@query(REPEATS + f""", rn AS (SELECT c.word, k AS p, b, substr(c.word, 1, k - 1) || b || substr(c.word, k + 1) AS w FROM rep c, range(1, 9) t(k), (VALUES ('A'), ('C'), ('G'), ('T')) v(b)),
rv AS (SELECT rn.word, floor(greatest(coalesce(st_r.diff, 0), 0))::BIGINT AS v FROM rn LEFT JOIN st_r ON st_r.word = least(w, {rc('w')}))
SELECT 0::BIGINT AS gap, list_sum(list_transform(range(0, 8), lambda i: (strpos('ACGT', substr(rep.word, i + 1, 1)) - 1) * (4 ** i)::BIGINT))::BIGINT AS code, round(any_value(ratio), 4) AS ratio, 8::BIGINT AS len, rep.word AS name, sum(v)::BIGINT AS total FROM rep JOIN rv USING (word) GROUP BY rep.word""")
def repeats_file(spark, sf_dir):
    """The table of repeats as text and back."""
    path = f"{shared_dir(spark, 'repeats')}/repeats"
    st = repeat_stats(spark, sf_dir)
    rep = repeat_words(st)
    rows = core_cells(st, rep.withColumn("gap", F.lit(0).cast("long"))).groupBy("word", "p").agg(F.transform(F.sort_array(F.collect_list(F.struct("b", F.floor("v").alias("v")))), lambda s: s["v"]).alias("r"))
    rows = rows.groupBy("word").agg(F.transform(F.sort_array(F.collect_list(F.struct("p", "r"))), lambda s: s["r"]).alias("pfm")).join(rep, "word")
    text.write_repeats(rows.select(F.lit(0).alias("gap"), seq.word_code(F.col("word")).alias("code"), F.round("ratio", 4).alias("ratio"), F.lit(8).alias("len"), F.col("word").alias("name"), "pfm"), path)
    back = text.read_repeats(spark, path)
    return back.select("gap", "code", "ratio", "len", "name", F.aggregate(F.flatten("pfm"), F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("WITH " + SEQ + " SELECT seq_id, 10::BIGINT AS interval, ((length(u) + 9) // 10)::BIGINT AS n, (10 * (length(u) - length(translate(u, 'CG', ''))))::BIGINT AS total FROM seq WHERE length(u) > 0")
def conservation_file(spark, sf_dir):
    """A track of one value for ten bases as text and back, joined to its sequence by name."""
    path = f"{shared_dir(spark, 'track')}/track"
    s = sequences(spark, sf_dir).where(F.length("u") > 0)
    cells_ = F.transform(F.sequence(F.lit(0), F.floor((F.length("u") - 1) / 10).cast("int")), lambda k: (10 * seq.count_cg(F.substring(F.col("u"), 10 * k + 1, F.lit(10)))).cast("string"))
    spark.createDataFrame([("Parameters: interval=10",)], "value string").coalesce(1).write.text(path)
    s.select(F.concat(F.lit(">"), named("seq_id", "S"), F.lit("\n"), F.array_join(cells_, ",")).alias("value")).write.mode("append").text(path)
    back = text.read_conservation(spark, path)
    rows = s.select("seq_id", named("seq_id", "S").alias("name")).join(back, "name")
    return rows.select("seq_id", "interval", F.size("values").cast("long").alias("n"), F.aggregate("values", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("SELECT 'R' || o_orderkey AS name, 'chr' || (o_custkey % 20) AS chr, CASE WHEN o_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand, o_custkey AS start, (100 + o_orderkey % 50)::BIGINT AS len FROM orders")
def bed_file(spark, sf_dir):
    path = f"{shared_dir(spark, 'bed')}/regions"
    o = table(spark, sf_dir, "orders")
    end = F.col("o_custkey") + 100 + F.col("o_orderkey") % 50
    strand = F.when(F.col("o_orderkey") % 2 == 0, "+").otherwise("-")
    o.select(F.concat_ws("\t", F.concat(F.lit("chr"), (F.col("o_custkey") % 20).cast("string")), F.col("o_custkey").cast("string"), end.cast("string"), named("o_orderkey", "R"), F.lit("0"), strand).alias("value")).write.text(path)
    return text.read_bed(spark, path).select("name", "chr", "strand", "start", "len")


@query("SELECT 'R' || o_orderkey AS name, 'chr' || (o_custkey % 20) AS chr, CASE WHEN o_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand, (o_orderkey % 50)::BIGINT AS len, o_custkey AS start FROM orders WHERE o_orderkey % 50 > 0 AND o_orderkey % 3 <> 0")
def coordinates_file(spark, sf_dir):
    """Coordinates of five columns as text and back; rows without a size or a proper strand are refused."""
    path = f"{shared_dir(spark, 'coordinates')}/regions"
    strand = F.when(F.col("o_orderkey") % 3 == 0, "?").when(F.col("o_orderkey") % 2 == 0, "+").otherwise("-")
    o = table(spark, sf_dir, "orders").select(F.concat_ws("\t", named("o_orderkey", "R"), F.concat(F.lit("chr"), (F.col("o_custkey") % 20).cast("string")), strand, (F.col("o_orderkey") % 50).cast("string"), F.col("o_custkey").cast("string")).alias("value"))
    o.write.text(path)
    return text.read_coordinates(spark, path)


@query("WITH " + SEQ + f", h AS (SELECT seq_id, substr(u, 1, 8) AS w FROM seq WHERE length(u) >= 8 AND strpos(substr(u, 1, 8), 'N') = 0) SELECT seq_id, w AS word, least(w, {rc('w')}) AS canonical, list_sum(list_transform(range(0, 8), lambda i: (strpos('ACGT', substr(w, i + 1, 1)) - 1) * (4 ** i)::BIGINT))::BIGINT AS code, {rc('w')} AS other FROM h")
def sql_functions(spark, sf_dir):
    """The SQL functions of the engine over the first word of each sequence."""
    surface.register(spark)
    sequences(spark, sf_dir).select("seq_id", F.substring("u", 1, 8).alias("w")).where("w rlike '^[ACGT]{8}$'").createOrReplaceTempView("first_words")
    return spark.sql("SELECT seq_id, w AS word, canonical_word(w) AS canonical, word_code(w) AS code, revcomp(w) AS other FROM first_words")


@query("WITH " + HITS + ", a AS (SELECT motif, event_id FROM hits UNION ALL SELECT 'NONE', -1), f AS (SELECT motif, min(event_id) AS first FROM a GROUP BY motif), i AS (SELECT motif, CASE WHEN motif = 'NONE' THEN 0 ELSE row_number() OVER (PARTITION BY motif = 'NONE' ORDER BY first) END AS id FROM f) SELECT id, motif, event_id FROM a JOIN i USING (motif)")
def motif_ids(spark, sf_dir):
    """Hits with a number for their motif, in the order in which motifs first appear; NONE is 0."""
    rows = hits(spark, sf_dir).select("motif", "event_id")
    rows = rows.unionByName(spark.createDataFrame([("NONE", -1)], "motif string, event_id long"))
    return rows.join(numbering.first_seen(rows, "motif", "event_id", none="NONE"), "motif").select("id", "motif", "event_id")


@query("SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'own' || o_orderkey ELSE printf('R%07d', row_number() OVER (ORDER BY o_orderkey)) END AS name, 'chr' || (o_custkey % 20) AS chr, o_custkey AS start, (100 + o_orderkey % 50)::BIGINT AS len FROM orders")
def region_ids(spark, sf_dir):
    """Regions with names, those without one named by their number among all."""
    o = table(spark, sf_dir, "orders")
    own = F.when(F.col("o_orderkey") % 3 == 0, named("o_orderkey", "own"))
    rows = o.select("o_orderkey", own.alias("name"), F.concat(F.lit("chr"), (F.col("o_custkey") % 20).cast("string")).alias("chr"), F.col("o_custkey").alias("start"), (100 + F.col("o_orderkey") % 50).cast("long").alias("len"))
    return numbering.region_names(numbering.within(rows, 1 << 40), "o_orderkey").select("name", "chr", "start", "len")


@query("WITH " + SEQ + """, r AS (SELECT CASE WHEN seq_id % 11 = 0 THEN '' ELSE 'S_' || (seq_id % 400) END AS name, translate(CASE WHEN seq_id % 7 = 0 THEN substr(s, 1, 50) || 'X' ELSE s END, 'Uu', 'Tt') AS seq FROM seq)
SELECT name, 'no name' AS problem, count(*) AS n FROM r WHERE name = '' GROUP BY 1 UNION ALL SELECT name, 'wrong letter', count(*) FROM r WHERE NOT regexp_full_match(seq, '[ACGTNacgtn]*') GROUP BY 1 UNION ALL SELECT name, 'name taken', count(*) FROM r WHERE name <> '' GROUP BY 1 HAVING count(*) > 1""")
def fasta_problems(spark, sf_dir):
    """What the rules for sequences say of rows with missing and repeated names, U in place of T, and some wrong letters."""
    s = sequences(spark, sf_dir)
    name = F.when(F.col("seq_id") % 11 == 0, "").otherwise(F.concat(F.lit("S "), (F.col("seq_id") % 400).cast("string")))
    given = F.when(F.col("seq_id") % 7 == 0, F.concat(F.substring("s", 1, 50), F.lit("X"))).otherwise(F.translate("s", "Tt", "Uu"))
    return validate.fasta_problems(validate.clean_fasta(s.select(name.alias("name"), given.alias("seq"))))


@query("""WITH r AS (SELECT 'R' || o_orderkey AS name, CASE WHEN o_orderkey % 5 = 0 THEN 'x' ELSE 'chr' || (o_custkey % 20) END AS chr, CASE WHEN o_orderkey % 3 = 0 THEN '?' WHEN o_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand, o_orderkey % 4 AS len, o_custkey % 9 AS start FROM orders)
SELECT name, problem, count(*) AS n FROM (SELECT name, 'chromosome' AS problem FROM r WHERE chr = 'x' UNION ALL SELECT name, 'strand' FROM r WHERE strand = '?' UNION ALL SELECT name, 'size' FROM r WHERE len = 0 UNION ALL SELECT name, 'place' FROM r WHERE start = 0) GROUP BY 1, 2""")
def coordinate_problems(spark, sf_dir):
    """What the rules for coordinates say."""
    o = table(spark, sf_dir, "orders")
    strand = F.when(F.col("o_orderkey") % 3 == 0, "?").when(F.col("o_orderkey") % 2 == 0, "+").otherwise("-")
    chr_ = F.when(F.col("o_orderkey") % 5 == 0, "x").otherwise(F.concat(F.lit("chr"), (F.col("o_custkey") % 20).cast("string")))
    return validate.coordinate_problems(o.select(named("o_orderkey", "R").alias("name"), chr_.alias("chr"), strand.alias("strand"), (F.col("o_orderkey") % 4).alias("len"), (F.col("o_custkey") % 9).alias("start")))
