"""Line deduplication: explode normalised lines, hash, count documents per hash, drop, reassemble by position."""

import hashlib

import pyarrow as pa
from pyspark.sql import functions as F

from . import common as C
from .components import saved


def line_key(line, least):
    """16-byte hash of the stripped line with A-Z in lower case; None when it has fewer than `least` code points."""
    line = line.strip(C.SPACE)
    return hashlib.blake2b(C.lower_key(line), digest_size=16).digest() if len(line) >= least else None


def explode_keys(least):
    def run(batches):
        for b in C.slices(batches):
            ids, at, keys = b.column("_id"), [], []
            for i, text in enumerate(C.strings(b.column("_text"))):
                own = {line_key(x, least) for x in text.split("\n")} - {None}
                at += [i] * len(own)
                keys += own
            yield pa.record_batch([ids.take(pa.array(at, pa.int64())), pa.array(keys, pa.binary())], names=["_id", "_key"])

    return run


def reassemble(least):
    def run(batches):
        for b in C.slices(batches):
            kept, lines, dropped = [], [], []
            for text, drop in zip(C.strings(b.column("_text")), b.column("_drop").to_pylist(), strict=True):
                parts = text.split("\n")
                lines.append(len(parts))
                if drop:
                    drop = set(drop)
                    parts = [x for x in parts if line_key(x, least) not in drop]
                dropped.append(lines[-1] - len(parts))
                kept.append("\n".join(parts))
            rest = [b.column(i) for i in range(b.num_columns) if b.schema.names[i] not in ("_text", "_drop")]
            names = [x for x in b.schema.names if x not in ("_text", "_drop")]
            yield pa.record_batch([*rest, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())], names=[*names, "n_lines", "n_dropped", "kept_text"])

    return run


def line_dedup(docs, id_col="doc_id", text_col="text", least_chars=40, least_docs=5, extra=(), folder=None):
    """One row per input row: id, the extra columns, n_lines, n_dropped, kept_text.

    Lines end at \\n. A line's key is the line stripped of [\\x20\\x09-\\x0D] with A-Z in lower case. A key of at
    least `least_chars` code points found under at least `least_docs` ids loses all its lines except those under the
    largest id that holds it; the other lines stay, in their places.

    Null or empty text is one empty line. Rows that share an id count as one document and are each reassembled; rows
    with a null id count as one document, smaller than any other. Extra columns pass through, as x_<name> where
    a result column has the name. No rows give no rows.

    Keys travel as 16-byte hashes, once per document; counting combines on the map side; texts are shuffled once, to
    meet the list of keys that their document loses. The keys over the threshold are written to folder (below
    spark.checkpoint.dir by default), so that Spark knows their size when it joins: small, they are broadcast; else a
    line that very many documents share is a skewed key that it splits.
    """
    keys = C.pick(docs, _id=id_col, _text=text_col).mapInArrow(explode_keys(least_chars), f"_id {docs.schema[id_col].dataType.simpleString()}, _key binary")
    common = keys.distinct().groupBy("_key").agg(F.count(F.lit(1)).alias("_n"), F.max("_id").alias("_keep")).where(F.col("_n") >= least_docs)
    common = saved(common.select("_key", "_keep"), folder or C.shared_dir(docs.sparkSession, "lines"), "common")
    lost = keys.join(common, "_key").where(~F.col("_id").eqNullSafe(F.col("_keep")))
    lost = lost.groupBy("_id").agg(F.collect_set("_key").alias("_drop")).withColumnRenamed("_id", "_lost")
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), *(F.col(f"`{c}`").alias(f"_x_{c}") for c in extra), F.col(f"`{text_col}`").alias("_text"))
    rows = rows.join(lost, F.col("_id").eqNullSafe(F.col("_lost")), "left").drop("_lost")
    kinds = "".join(f"`_x_{c}` {docs.schema[c].dataType.simpleString()}, " for c in extra)
    out = rows.mapInArrow(reassemble(least_chars), f"_id {docs.schema[id_col].dataType.simpleString()}, {kinds}n_lines long, n_dropped long, kept_text string")
    names = (id_col, "n_lines", "n_dropped", "kept_text")
    return out.select(F.col("_id").alias(id_col), *(F.col(f"`_x_{c}`").alias(C.beside(c, names)) for c in extra), "n_lines", "n_dropped", "kept_text")


def op3_line_dedup(spark, sf_dir):
    out = line_dedup(C.read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS keep FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, c.keep IS NOT NULL AND c.keep <> k.doc_id AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
