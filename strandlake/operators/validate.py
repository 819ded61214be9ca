"""Rules for uploaded rows: what they are turned into, and what is wrong with them."""

from pyspark.sql import functions as F


def clean_fasta(rows):
    """name, seq with blanks of names as _, white space left out of sequences, and U as T in either case."""
    return rows.select(F.regexp_replace(F.trim("name"), " ", "_").alias("name"), F.translate(F.regexp_replace("seq", r"\s", ""), "Uu", "Tt").alias("seq"))


def problems(rows, rules, key="name"):
    """key, problem, n: rows that break a rule; rules: {problem: boolean column, true where it is broken}."""
    broken = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(True)), F.lit(k)) for k, c in rules.items())))
    return rows.select(F.col(key), F.explode(broken).alias("problem")).groupBy(key, "problem").agg(F.count(F.lit(1)).alias("n"))


def fasta_problems(rows):
    """Of clean rows: no name, a name that more than one row has, letters other than A, C, G, T, N in either case."""
    found = problems(rows, {"no name": F.coalesce("name", F.lit("")) == "", "wrong letter": ~F.coalesce("seq", F.lit("")).rlike("^[ACGTNacgtn]*$")})
    twice = rows.where("name <> ''").groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return found.unionByName(twice.select("name", F.lit("name taken").alias("problem"), "n"))


def coordinate_problems(rows):
    """name, chr, strand, len, start: a chromosome without chr in its name, a strand other than + and -, no size, no place."""
    return problems(rows, {"chromosome": ~F.col("chr").contains("chr"), "strand": ~F.col("strand").isin("+", "-"), "size": ~(F.col("len") > 0), "place": ~(F.col("start") > 0)})


def hit_problems(rows):
    """motif, strand, len, score of hits: no score, no length, a strand other than + and -; NONE rows may lack them."""
    real = rows.where(~F.col("motif").eqNullSafe("NONE"))
    return problems(real, {"score": F.coalesce("score", F.lit(0.0)) == 0, "size": F.coalesce("len", F.lit(0)) == 0, "strand": ~F.col("strand").isin("+", "-")}, "motif")


def conservation_problems(rows):
    """name, interval, values: an interval below 1, values below 0 or above 100, or none at all."""
    outside = F.exists("values", lambda x: x.isNull() | ~x.between(0, 100))
    return problems(rows, {"interval": ~(F.col("interval") >= 1), "value": outside, "no values": F.size("values") <= 0})
