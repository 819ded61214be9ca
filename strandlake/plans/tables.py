"""The given tables as sequences, motifs and hits; the same in SQL."""

from pyspark.sql import functions as F

from ..functions import seq


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df):
    """A table in one file is one task; deal it out before work that grows with the rows."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if len(df.inputFiles()) < 4 else df


def sequences(spark, sf_dir):
    """seq_id, grp (test: English, else control), s (masked bases), u (upper case) of every document."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    s = seq.from_text(F.col("text"))
    rows = docs.select(F.col("doc_id").alias("seq_id"), F.when(F.col("lang") == "en", "test").otherwise("ctrl").alias("grp"), s.alias("s"))
    return rows.withColumn("u", F.upper("s"))


def library(spark, sf_dir):
    """motif, pattern: the first 8 bases of every benchmark item, if none is missing."""
    s = F.substring(F.upper(seq.from_text(F.col("text"))), 1, 8)
    rows = table(spark, sf_dir, "benchmark").select(F.format_string("B%03d", "item_id").alias("motif"), s.alias("pattern"))
    return rows.where((F.length("pattern") == 8) & (F.instr("pattern", "N") == 0))


def hits(spark, sf_dir):
    """motif, seq_id, strand, len, start, score of every event."""
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("event_type").alias("motif"), F.col("user_id").alias("seq_id"), F.when(k % 2 == 0, "+").otherwise("-").alias("strand"),
        F.lit(8).cast("long").alias("len"), F.floor(F.col("value") * 4).cast("long").alias("start"), F.round(F.col("value") / 50, 6).alias("score"),
    )


SEQ = r"""seq AS (SELECT seq_id, grp, s, upper(s) AS u FROM (SELECT doc_id AS seq_id, CASE WHEN lang = 'en' THEN 'test' ELSE 'ctrl' END AS grp,
  regexp_replace(translate(regexp_replace(coalesce(text, ''), '[ -@\[-`{-~\n\r\t]', '', 'g'), '@FROM@', '@TO@'), '[^ACGTacgt]', 'N', 'g') AS s FROM documents))""".replace("@FROM@", seq.LETTERS).replace("@TO@", seq.AS_BASES)

LIBRARY = r"""lib AS (SELECT motif, pattern FROM (SELECT printf('B%03d', item_id) AS motif,
  substr(upper(regexp_replace(translate(regexp_replace(coalesce(text, ''), '[ -@\[-`{-~\n\r\t]', '', 'g'), '@FROM@', '@TO@'), '[^ACGTacgt]', 'N', 'g')), 1, 8) AS pattern FROM benchmark)
  WHERE length(pattern) = 8 AND strpos(pattern, 'N') = 0)""".replace("@FROM@", seq.LETTERS).replace("@TO@", seq.AS_BASES)

HITS = """hits AS (SELECT event_id, event_type AS motif, user_id AS seq_id, CASE WHEN json_extract_string(props, '$.k')::BIGINT % 2 = 0 THEN '+' ELSE '-' END AS strand,
  8::BIGINT AS len, floor(value * 4)::BIGINT AS start, round(value / 50, 6) AS score FROM events)"""


def rc(x):
    return f"reverse(translate({x}, 'ACGTacgt', 'TGCAtgca'))"


def windows(gap, span, parts):
    """SQL: every clean window of a template."""
    word = " || ".join(f"substr(f, {s + 1}, {n})" for s, n in parts)
    return f"""SELECT seq_id, grp, {gap}::BIGINT AS gap, i, f, {word} AS word FROM (SELECT seq_id, grp, i, substr(u, i, {span}) AS f
      FROM (SELECT seq_id, grp, u, unnest(range(1, length(u) - {span - 2})) AS i FROM seq WHERE length(u) >= {span})) WHERE strpos(f, 'N') = 0"""


def occurrences(chosen):
    """SQL: occ(seq_id, grp, gap, word, n, n_all) with n counted left to right without overlap."""
    one = " UNION ALL ".join(
        f"""SELECT seq_id, grp, gap, word, count(*) AS n_all, CASE WHEN count(*) = 1 THEN 1 ELSE
        (list_reduce(list_prepend({{'n': 0::BIGINT, 'p': -1000::BIGINT}}, list_transform(list(i ORDER BY i), lambda p: {{'n': 0::BIGINT, 'p': p::BIGINT}})),
        lambda a, b: CASE WHEN b.p >= a.p + {span} THEN {{'n': a.n + 1, 'p': b.p}} ELSE a END)).n END AS n FROM ({windows(gap, span, parts)}) GROUP BY ALL"""
        for gap, span, parts in chosen
    )
    return f"occ AS ({one})"


COUNTS = "cnt AS (SELECT grp, gap, word, sum(n)::BIGINT AS n, sum(n * n)::BIGINT AS nn, count(*) AS docs, sum(n_all)::BIGINT AS n_all FROM occ GROUP BY ALL)"
PIVOT = "xy AS (SELECT gap, word, coalesce(sum(n) FILTER (WHERE grp = 'test'), 0)::BIGINT AS x, coalesce(sum(n) FILTER (WHERE grp = 'ctrl'), 0)::BIGINT AS y FROM cnt GROUP BY ALL)"
FOLD = f"folded AS (SELECT gap, least(word, {rc('word')}) AS word, sum(x)::BIGINT AS x, sum(y)::BIGINT AS y FROM xy GROUP BY ALL)"
LENGTHS = "tot AS (SELECT sum(length(replace(u, 'N', ''))) FILTER (WHERE grp = 'test')::DOUBLE AS len1, sum(length(replace(u, 'N', ''))) FILTER (WHERE grp = 'ctrl')::DOUBLE AS len2, count(*) FILTER (WHERE grp = 'test')::DOUBLE AS n1, count(*) FILTER (WHERE grp = 'ctrl')::DOUBLE AS n2 FROM seq)"


def stats_sql(spans, length=8):
    """SQL: st(gap, word, x, y, z, ratio, diff, total, own, len1) over folded and tot."""
    span = "CASE gap " + " ".join(f"WHEN {g} THEN {s}" for g, s in spans.items()) + " END"
    w = 4**length
    return f"""s0 AS (SELECT gap, word, x, y, len1, len2, CASE WHEN word = {rc('word')} THEN 1.0 ELSE 2.0 END AS own, floor(len1 / {span}) AS n1, floor(len2 / {span}) AS n2 FROM folded, tot),
s1 AS (SELECT *, least(x::DOUBLE, n1 - 1) AS a, least(greatest(y::DOUBLE, own * len2 / {w}), n2 - 1) AS b FROM s0),
s2 AS (SELECT *, (a + b) / (n1 + n2) AS share, b * (len1 / len2) AS scaled FROM s1),
st AS (SELECT gap, word, x, y, CASE WHEN share > 0 THEN (a / n1 - share) / sqrt(share * (1 - share) * n2 / (n1 + n2 - 1) / n1) ELSE 0 END AS z,
  (a + 5) / (scaled + 5) AS ratio, a - scaled AS diff, a + scaled AS total, own, len1 FROM s2)"""


CONSIDERED = "total >= own * 0.25 * 2.5 * len1 / 65536"
CANDIDATE = f"{CONSIDERED} AND ratio >= 1.5 AND z >= 1.643 AND diff >= 8"
