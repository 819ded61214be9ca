"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash."""

import hashlib

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C
from .components import saved


@F.arrow_udf(T.BinaryType())
def text_digest(text: pa.Array) -> pa.Array:
    """SHA-256 of the text with A-Z in lower case; null stays null."""
    raw = text.cast(pa.binary()).to_pylist()
    return pa.array([None if x is None else hashlib.sha256(x.lower()).digest() for x in raw], pa.binary())


def exact_dedup(docs, id_col="doc_id", text_col="text", prefix=64, bits=None, carry=None, folder=None):
    """One row per input row: id, keep_id, group_size, kept, and the carried columns.

    Texts are equal when identical after lower-casing A-Z. The row with the largest id stays.
    Every step reads narrower evidence first: byte lengths that two rows share, then the hash of the first `prefix`
    characters, and only rows that still have a possible twin are hashed in full. The steps are handed on as bitmaps
    of 2**bits places, so no text is shuffled. By default bits follow the number of rows, 16 places for each, between
    2**20 and 2**25 (some 20 MB, the most that is broadcast); beyond that a crowded bitmap costs time, never a row. Rows
    hashed in full and their groups are written to folder (below spark.checkpoint.dir by default), so that a large
    group is a skewed key that Spark splits when they are joined.

    Null text counts as empty. A null id counts as smaller than any other. Rows that repeat an id and a text
    are all returned, and only one of those with the kept id has kept = true. No rows give no rows.
    carry: {name: function of the text column} of further columns that depend on the text alone.
    """
    rows = C.pick(docs, _id=id_col, _text=text_col).withColumn("_text", C.whole(F.col("_text")))
    rows = rows.withColumn("_n", F.octet_length("_text").cast("long"))
    folder = folder or C.shared_dir(docs.sparkSession, "exact")
    bits = bits or min(25, max(20, (16 * docs.count()).bit_length()))
    shared = rows.groupBy("_n").count().where("count > 1").select("_n")
    rows = C.maybe_in(rows, F.col("_n"), C.bit_filter(shared, bits), "_again", bits)

    start = F.xxhash64("_n", C.ascii_lower(F.substring("_text", 1, prefix)))
    rows = rows.withColumn("_start", F.when(F.col("_again"), start))
    shared = rows.where("_again").groupBy("_start").count().where("count > 1").select("_start")
    rows = C.maybe_in(rows, F.col("_start"), C.bit_filter(shared, bits), "_twin", bits)

    rows = rows.withColumn("_full", text_digest(F.when(F.col("_again") & F.col("_twin"), F.col("_text"))))
    extra = {k: f(F.col("_text")) for k, f in (carry or {}).items()}
    rows = rows.select("_id", "_full", *(v.alias(k) for k, v in extra.items()))

    alone = rows.where("_full is null").select(
        F.col("_id").alias(id_col), F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), *extra
    )
    some = rows.where("_full is not null").groupBy("_full", "_id").agg(
        F.count(F.lit(1)).alias("_copies"), *(F.first(k).alias(k) for k in extra)
    )
    some = saved(some, folder, "hashed")
    groups = some.groupBy("_full").agg(F.sum("_copies").alias("group_size"), F.max("_id").alias("keep_id"))
    some = some.join(saved(groups, folder, "groups"), "_full").withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    return alone.unionByName(some.select(
        F.col("_id").alias(id_col), "keep_id", "group_size", ((F.col("_i") == 1) & F.col("_id").eqNullSafe(F.col("keep_id"))).alias("kept"), *extra
    ))


def op4_exact_dedup(spark, sf_dir):
    digest = lambda text: F.lower(F.hex(text_digest(text)))
    return exact_dedup(C.read(spark, sf_dir, "documents"), carry={"text_sha256": digest}).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256"
    )


OP4_SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY x) AS keep_id, count(*) OVER (PARTITION BY x) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY x) AS kept, sha256(x) AS text_sha256 FROM t
"""
