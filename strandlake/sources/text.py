"""Readers and writers of the field's text formats, as DataFrames over Spark's own text source.

Records start with '>', so files are split at that sign and a record may be as long as a line of Spark's may be. All
readers take whatever path Spark reads; nothing passes the driver.
"""

from pyspark.sql import functions as F

from ..functions.seq import revcomp


def records(spark, path):
    """head, body, file of each record that a line led by '>' begins; what stands before a file's first record drops out."""
    rows = spark.read.option("lineSep", "\n>").text(path).select("value", F.col("_metadata.file_path").alias("file"))
    rows = rows.withColumn("value", F.regexp_replace(F.regexp_replace("value", "\r", ""), "^>", "")).where(F.trim("value") != "")
    parts = F.split("value", "\n", 2)
    return rows.where(~F.col("value").rlike("^(Parameters|Headers):")).select(F.trim(parts[0]).alias("head"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("body"), "file")


def parameters_of(spark, path):
    """file, known ({key: value}) of each file that has a Parameters: line."""
    rows = spark.read.text(path).where(F.col("value").startswith("Parameters:")).select(F.col("_metadata.file_path").alias("file"), F.substring("value", len("Parameters:") + 1, 1 << 20).alias("value"))
    words = rows.select("file", F.explode(F.split(F.trim("value"), r"\s+")).alias("w")).where("instr(w, '=') > 0")
    pairs = words.groupBy("file", F.substring_index("w", "=", 1).alias("k")).agg(F.min(F.expr("substr(w, instr(w, '=') + 1)")).alias("v"))
    return pairs.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("known"))


def with_parameter(rows, spark, path, key, name):
    """rows (with file) and `name`: key of the file's Parameters: line; the files of one folder that Spark has written
    (part-...) share what one of them has."""
    known = parameters_of(spark, path).select("file", F.try_element_at("known", F.lit(key)).cast("long").alias(name))
    folder = F.when(F.col("file").rlike("/part-[^/]*$"), F.regexp_replace("file", "/[^/]*$", "")).alias("folder")
    shared = known.groupBy(folder).agg(F.min_by(name, "file").alias("_shared")).where("folder is not null")
    rows = rows.join(known, "file", "left").withColumn("folder", folder).join(shared, "folder", "left")
    return rows.withColumn(name, F.coalesce(name, "_shared")).drop("folder", "_shared")


def headers_of(spark, path):
    """file, names of each file that has a Headers: line."""
    rows = spark.read.text(path).where(F.col("value").startswith("Headers:")).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace(F.substring("value", len("Headers:") + 1, 1 << 20), r"^\s+|\s+$", "").alias("value"))
    return rows.groupBy("file").agg(F.min("value").alias("value")).select("file", F.transform(F.split("value", "\t"), lambda x: F.trim(x)).alias("names"))


def parameters(spark, path):
    """{key: value} of the Parameters: line at the start of a file, {} without one; of a folder, those of its first file."""
    row = parameters_of(spark, path).orderBy("file").first()
    return row["known"] if row else {}


def read_fasta(spark, path, least=10, part=None):
    """name, seq: lines of a record joined; sequences with fewer than `least` letters drop out.

    part: longer sequences come in rows of `part` letters, named name-1, name-2 and so on.
    """
    rows = records(spark, path).select(F.element_at(F.split("head", r"\s+"), 1).alias("name"), F.regexp_replace("body", r"\s", "").alias("seq"))
    if part:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.length("seq") - 1) / part)), lambda k: F.substring(F.col("seq"), (k * part + 1).cast("int"), F.lit(part)))
        long = F.length("seq") > part
        rows = rows.where(F.length("seq") > 0).select("name", long.alias("long"), F.posexplode(cut).alias("k", "seq"))
        rows = rows.select(F.when(F.col("long"), F.concat_ws("-", "name", (F.col("k") + 1).cast("string"))).otherwise(F.col("name")).alias("name"), "seq")
    return rows.where(F.length("seq") >= least)


def write_fasta(seqs, path, width=100):
    """name, seq as FASTA text, `width` letters a line."""
    lines = F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n")
    seqs.select(F.concat(F.lit(">"), "name", F.lit("\n"), lines).alias("value")).write.text(path)


def rows_of(body):
    """Rows of four numbers after a position, as an array of arrays; lines of another form drop out."""
    lines = F.filter(F.split(body, "\n"), lambda x: F.trim(x).rlike(r"^-?\d+(\s+-?[\d.eE+-]+){4}$"))
    return F.transform(lines, lambda x: F.transform(F.slice(F.split(F.trim(x), r"\s+"), 2, 4), lambda v: v.cast("double")))


MOTIF = ("name", "pattern", "patternRev", "freq", "ratio", "info", "score", "p", "fdr")


def read_pfm(spark, path, columns=None):
    """The columns of the head line, tab-separated, and pfm; missing columns are null, freq 100 and ratio 2.

    The names are those given, else those of the file's Headers: line (in any case); columns beyond it go by MOTIF.
    """
    rows, parts = records(spark, path), F.split("head", "\t")
    kinds = {"freq": "long", "ratio": "double", "info": "double", "score": "double", "p": "double", "fdr": "double"}
    default = {"freq": 100, "ratio": 2.0}
    if columns is None:
        named = headers_of(spark, path)
        known = {c.lower(): c for c in MOTIF}
        heads = [r["names"] for r in named.select("names").distinct().orderBy("names").collect()]  # as many as the kinds of files
        columns = [*dict.fromkeys([*(known.get(h.lower(), h) for names in heads for h in names), *MOTIF])]
        rows = rows.join(named, "file", "left").withColumn("lower", F.transform(F.coalesce("names", F.array().cast("array<string>")), lambda x: F.lower(x)))
        usual = lambda c: F.when(F.lit(MOTIF.index(c)) >= F.size("lower"), F.get(parts, F.lit(MOTIF.index(c)))) if c in MOTIF else F.lit(None)
        at = {c: F.array_position("lower", c.lower()) for c in columns}
        value = {c: F.when(at[c] > 0, F.get(parts, (at[c] - 1).cast("int"))).otherwise(usual(c)) for c in columns}
    else:
        value = {c: F.get(parts, F.lit(k)) for k, c in enumerate(columns)}
    cols = [F.coalesce(F.nullif(value[c], F.lit("")).try_cast(kinds.get(c, "string")), F.lit(default.get(c)).cast(kinds.get(c, "string"))).alias(c) for c in columns]
    return rows.select(*cols, rows_of(F.col("body")).alias("pfm"))


def write_pfm(motifs, path, columns=MOTIF, brief=False):
    """Motifs as text; brief leaves the matrices out."""
    head = F.concat(F.lit(">"), F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)))
    body = F.array_join(F.transform("pfm", lambda r, i: F.concat_ws("\t", i.cast("string"), *(r[k].cast("string") for k in range(4)))), "\n")
    motifs.select((head if brief else F.concat(head, F.lit("\n"), body, F.lit("\n"))).alias("value")).write.text(path)


def read_meme(spark, path, least=6):
    """name, nsites, pfm in percent of each MOTIF; those with fewer than `least` rows drop out."""
    rows = spark.read.option("lineSep", "MOTIF").text(path).where(F.col("value").contains("letter-probability matrix"))
    name = F.element_at(F.split(F.trim(F.element_at(F.split("value", "\n"), 1)), r"\s+"), 1)
    lines = F.filter(F.split("value", "\n"), lambda x: F.trim(x).rlike(r"^[\d.eE+-]+(\s+[\d.eE+-]+){3}$"))
    pfm = F.transform(lines, lambda x: F.transform(F.split(F.trim(x), r"\s+"), lambda v: v.cast("double") * 100))
    out = rows.select(name.alias("name"), F.nullif(F.regexp_extract("value", r"nsites=\s*(\d+)", 1), F.lit("")).cast("long").alias("nsites"), pfm.alias("pfm"))
    return out.where(F.size("pfm") >= least)


def read_hits(spark, path):
    """motif, seq_name, strand, len, start, score, match, conservation; head lines drop out."""
    rows = spark.read.text(path).where(~F.col("value").rlike(r"^(Headers|Parameters):|^\s*$")).select(F.split("value", "\t").alias("v"))
    kinds = (("motif", "string"), ("seq_name", "string"), ("strand", "string"), ("len", "long"), ("start", "long"), ("score", "double"), ("match", "string"), ("conservation", "long"))
    return rows.select(*(F.get("v", F.lit(k)).try_cast(t).alias(n) for k, (n, t) in enumerate(kinds)))


def write_hits(hits, path, names=None):
    """Hits as text, with the conservation if there is one; names: seq_name of all sequences, those without a hit get a
    NONE row."""
    cols = [c for c in ("motif", "seq_name", "strand", "len", "start", "score", "match", "conservation") if c != "conservation" or c in hits.columns]
    if names is not None:
        none = names.join(hits, "seq_name", "left_anti").select("seq_name", F.lit("NONE").alias("motif"))
        hits = hits.select(cols).unionByName(none, allowMissingColumns=True)
    hits.select(F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols)).alias("value")).write.text(path)


def read_conservation(spark, path):
    """name, interval, values of each record: whole numbers parted by commas or spaces, one for `interval` bases (1 unless the
    file's Parameters: line says otherwise)."""
    values = F.transform(F.filter(F.split("body", r"[,\s]+"), lambda x: x != ""), lambda x: x.cast("int"))
    rows = with_parameter(records(spark, path), spark, path, "interval", "interval")
    interval = F.coalesce("interval", F.lit(1).cast("long"))
    return rows.select(F.element_at(F.split("head", r"\s+"), 1).alias("name"), interval.alias("interval"), values.alias("values"))


def read_bed(spark, path):
    """name, chr, strand (+ unless given), start, len; the start counts from 0, unnamed rows are named by place."""
    rows = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("v")).where(F.size("v") >= 3)
    start, end = F.col("v")[1].cast("long"), F.col("v")[2].cast("long")
    name = F.coalesce(F.get("v", F.lit(3)), F.concat_ws(":", F.col("v")[0], F.col("v")[1]))
    strand = F.when(F.get("v", F.lit(5)) == "-", "-").otherwise("+")
    return rows.where(start.isNotNull() & end.isNotNull()).select(name.alias("name"), F.col("v")[0].alias("chr"), strand.alias("strand"), start.alias("start"), (end - start).alias("len"))


def extract(regions, chromosomes, width=1 << 20):
    """name, seq of regions (name, chr, strand, start, len) in chromosomes (chr, seq).

    Chromosomes are cut into parts of `width`; a region meets only the parts that it touches, whose pieces are joined.
    """
    parts = chromosomes.select("chr", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.length("seq") - 1) / width)), lambda k: F.substring(F.col("seq"), (k * width + 1).cast("int"), F.lit(width)))).alias("part", "piece"))
    first, last = F.floor(F.col("start") / width), F.floor((F.col("start") + F.col("len") - 1) / width)
    wanted = regions.where("len > 0").select("*", F.explode(F.sequence(first, last)).alias("part"))
    at = F.greatest(F.col("start") - F.col("part") * width, F.lit(0))
    n = F.least(F.col("start") + F.col("len") - F.col("part") * width, F.lit(width)) - at
    got = wanted.join(parts, ["chr", "part"]).select("name", "chr", "strand", "start", "len", "part", F.substring(F.col("piece"), (at + 1).cast("int"), n.cast("int")).alias("t"))
    seqs = got.groupBy("name", "chr", "strand", "start", "len").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "t"))), lambda s: s["t"]), "").alias("seq"))
    return seqs.select("name", F.when(F.col("strand") == "-", revcomp(F.col("seq"))).otherwise(F.col("seq")).alias("seq"))


def write_meme(motifs, path):
    """name, nsites, pfm (percent) in MEME's form."""
    body = F.array_join(F.transform("pfm", lambda r: F.concat_ws(" ", *(F.round(r[k] / 100, 6).cast("decimal(10,6)").cast("string") for k in range(4)))), "\n")
    head = F.format_string("MOTIF %s\nletter-probability matrix: alength= 4 w= %d nsites= %d", "name", F.size("pfm"), "nsites")
    motifs.select(F.concat(head, F.lit("\n"), body, F.lit("\n")).alias("value")).write.text(path)


def write_positions(hits, path, sequences):
    """motif, seq_no, seq_name, dir, pos of hits, one line each, after the number of sequences."""
    spark = hits.sparkSession
    spark.createDataFrame([(f"Parameters: Nseq={sequences}",)], "value string").coalesce(1).write.text(path)
    cols = ("motif", "seq_no", "seq_name", "dir", "pos")
    hits.select(F.concat_ws("\t", *(F.col(c).cast("string") for c in cols)).alias("value")).write.mode("append").text(path)


def read_positions(spark, path, motifs=None):
    """motif, seq_no, seq_name, dir, pos, n_seqs (Nseq= of its file, null without any); only of the given motifs (column motif), if any."""
    rows = spark.read.text(path).where(~F.col("value").rlike(r"^(Headers|Parameters):|^\s*$")).select(F.split("value", "\t").alias("v"), F.col("_metadata.file_path").alias("file"))
    rows = with_parameter(rows, spark, path, "Nseq", "n_seqs")
    kinds = (("motif", "string"), ("seq_no", "long"), ("seq_name", "string"), ("dir", "long"), ("pos", "long"))
    rows = rows.select(*(F.get("v", F.lit(k)).try_cast(t).alias(c) for k, (c, t) in enumerate(kinds)), "n_seqs")
    return rows if motifs is None else rows.join(motifs.select("motif"), "motif", "left_semi")


def write_repeats(repeats, path):
    """gap, code, ratio, len, name and pfm (len x 4 whole numbers) as records of two lines."""
    head = F.concat_ws("\t", *(F.col(c).cast("string") for c in ("gap", "code", "ratio", "len", "name")))
    cells = F.concat_ws("\t", F.transform(F.flatten("pfm"), lambda x: x.cast("string")))
    repeats.select(F.concat(F.lit(">"), head, F.lit("\n"), cells).alias("value")).write.text(path)


def read_repeats(spark, path):
    """gap, code, ratio, len, name, pfm of each record of two lines; the first may start with '>'."""
    v = F.split("head", r"\s+")
    cells = F.transform(F.filter(F.split("body", r"\s+"), lambda x: x != ""), lambda x: x.cast("long"))
    rows = records(spark, path).select(v.alias("v"), cells.alias("c"))
    pfm = F.transform(F.sequence(F.lit(0), F.floor(F.size("c") / 4).cast("int") - 1), lambda k: F.slice("c", 4 * k + 1, F.lit(4)))
    kinds = (("gap", "long"), ("code", "long"), ("ratio", "double"), ("len", "long"), ("name", "string"))
    return rows.where(F.size("c") >= 4).select(*(F.get("v", F.lit(k)).try_cast(t).alias(c) for k, (c, t) in enumerate(kinds)), pfm.alias("pfm"))


def write_clusters(clusters, members, path):
    """Clusters (name, pfm in percent) with their members (name, motif, dir, offset): head, rows, members by name, links
    left to the caller. A cluster is a record, so its members are gathered for it."""
    own = members.groupBy("name").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("motif", "dir", "offset"))), lambda m: F.concat_ws("\t", m["motif"], m["dir"].cast("string"), m["offset"].cast("string"))), "\n").alias("members"), F.count(F.lit(1)).alias("n"))
    body = F.array_join(F.transform("pfm", lambda r, i: F.concat_ws("\t", i.cast("string"), *(F.round(r[k], 4).cast("string") for k in range(4)))), "\n")
    rows = clusters.join(own, "name", "left")
    rows.select(F.concat(F.lit(">"), F.col("name"), F.lit("\t"), F.coalesce("n", F.lit(0)).cast("string"), F.lit("\n"), body, F.lit("\nmembers\n"), F.coalesce("members", F.lit("")), F.lit("\n")).alias("value")).write.text(path)


def read_clusters(spark, path):
    """name, n, pfm, members (motif, dir, offset) of each cluster."""
    parts, head = F.split("body", "\nmembers\n"), F.split("head", "\t")
    lines = F.filter(F.split(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), "\n"), lambda x: F.trim(x) != "")
    members = F.transform(lines, lambda x: F.struct(F.split(x, "\t")[0].alias("motif"), F.split(x, "\t")[1].cast("long").alias("dir"), F.split(x, "\t")[2].cast("long").alias("offset")))
    return records(spark, path).select(head[0].alias("name"), F.get(head, F.lit(1)).cast("long").alias("n"), rows_of(parts[0]).alias("pfm"), members.alias("members"))


def write_compare(pairs, path):
    """query, target, match, dir, offset as text: each query, then its matches, indented, best first."""
    line = lambda m: F.concat(F.lit("    "), F.concat_ws("\t", m["target"], F.format_number(m["match"], 4), m["dir"].cast("string"), m["offset"].cast("string")))
    own = pairs.groupBy("query").agg(F.sort_array(F.collect_list(F.struct((-F.col("match")).alias("k"), "target", "match", "dir", "offset"))).alias("m"))
    own.select(F.concat(F.col("query"), F.lit("\n"), F.array_join(F.transform("m", line), "\n")).alias("value")).write.text(path)


PROGRESS = ("motif", "turn", "sub_turn", "n1", "n2", "all1", "all2", "threshold")


def write_progress(turns, path, columns=("motif", "turn", "n1", "n2", "threshold")):
    """The columns of a refinement's turns, in the order of motif and turn (and sub-turn, if there are any)."""
    order = [c for c in ("motif", "turn", "sub_turn") if c in columns]
    rows = turns.repartitionByRange(*order).sortWithinPartitions(*order)
    rows.select(F.concat_ws("\t", *(F.col(c).cast("string") for c in columns)).alias("value")).write.text(path)


def read_progress(spark, path, columns=PROGRESS):
    """The columns of a written progress: counts as whole numbers, motif as text, threshold as a number."""
    kinds = {"motif": "string", "threshold": "double"}
    rows = spark.read.text(path).where("value <> ''").select(F.split("value", "\t").alias("v"))
    return rows.select(*(F.get("v", F.lit(k)).try_cast(kinds.get(c, "long")).alias(c) for k, c in enumerate(columns)))


def read_coordinates(spark, path):
    """name, chr, strand, len, start of rows of five columns; rows with a strand other than + or -, or no size, drop out."""
    rows = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("v")).where(F.size("v") == 5)
    rows = rows.select(F.col("v")[0].alias("name"), F.col("v")[1].alias("chr"), F.col("v")[2].alias("strand"), F.col("v")[3].try_cast("long").alias("len"), F.col("v")[4].try_cast("long").alias("start"))
    return rows.where("strand in ('+', '-') and len > 0 and start >= 0")
