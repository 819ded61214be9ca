"""Helpers that the text operators share."""

import ctypes
import re
import tempfile
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

LIBRARY = ctypes.CDLL(None)
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACE = " \t\n\x0b\x0c\r"  # \x20 and \x09-\x0D


def read(spark, sf_dir, table):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def pick(df, **columns):
    """Only the named columns, under fixed internal names, so that others of the same names can't clash."""
    return df.select(*(F.col(f"`{source}`").alias(name) for name, source in columns.items()))


def beside(name, results):
    """The name under which an extra column goes beside the result columns: x_<name> where one of them has it."""
    return f"x_{name}" if name.lower() in {r.lower() for r in results} else name


def whole(column):
    """Null texts count as empty."""
    return F.coalesce(column, F.lit(""))


def ascii_lower(column):
    """A-Z only; other letters keep their case."""
    return F.translate(column, UPPER, UPPER.lower())


def strings(array):
    """Python strings of an Arrow column, null as empty."""
    return pc.fill_null(array, "").to_pylist()


def raw(array):
    """UTF-8 bytes of an Arrow string column, null as empty."""
    return pc.fill_null(array, "").cast(pa.binary()).to_pylist()


def slices(batches, most=1 << 22):
    """Arrow batches in slices of some `most` bytes, so that what is made of one is small. At the end, memory that a
    worker doesn't use goes back to the system: workers wait for further tasks beside those that run."""
    try:
        for b in batches:
            step = max(1, b.num_rows * most // max(1, b.nbytes))
            for at in range(0, b.num_rows, step):
                yield b.slice(at, step)
            if not b.num_rows:
                yield b
            del b
    finally:
        pa.default_memory_pool().release_unused()
        if hasattr(LIBRARY, "malloc_trim"):
            LIBRARY.malloc_trim(0)


def lower_key(text):
    """UTF-8 bytes with A-Z in lower case."""
    return text.encode().lower()


def shared_dir(spark, name, path=None):
    """A new folder that driver and executors can reach: below path, else below spark.checkpoint.dir.

    Where neither is given, as in tests, one Spark process alone gets a folder of its own; a cluster needs the setting.
    """
    base = path or spark.conf.get("spark.checkpoint.dir", None)
    if not base and re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        base = f"file://{tempfile.mkdtemp(prefix='strandlake-')}"
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share, or give a path")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def places(n, most=26):
    """Bits of a place in a bitmap for n keys: 16 places a key, 2**most at most, beyond which it passes more rows."""
    return min(most, max(10, (16 * n).bit_length()))


def frequent_from(counted, column, most, least=1):
    """The least number, `least` or above, that at most `most` rows of counted reach in column; exact to an eighth of a
    power of two."""
    limit, room = least, most
    sizes = counted.where(F.col(column) >= least).groupBy(F.floor(8 * F.log2(column)).alias("size")).agg(F.count(F.lit(1)).alias("n"), F.max(column).alias("top"))
    for r in sizes.orderBy(F.desc("size")).collect():  # at most 64 * 8
        room -= r["n"]
        if room < 0:
            return max(limit, r["top"] + 1)
    return limit


def bit_filter(keys, bits=22):
    """(word, mask) rows of a bitmap of 2**bits places for the non-null longs in the only column of keys.

    It never has more than 2**bits / 64 rows whatever the input, so it may be broadcast.
    """
    place = F.pmod(F.xxhash64(F.col(keys.columns[0])), F.lit(1 << bits))
    return keys.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, int(pmod(p, 64)))")).alias("mask")
    )


def maybe_in(df, key, bitmap, name, bits=22):
    """df with the boolean column name: false only where key isn't among the bitmap's keys."""
    place = F.pmod(F.xxhash64(key), F.lit(1 << bits))
    bitmap = bitmap.select(F.col("word").alias("_word"), F.col("mask").alias("_mask"))
    out = df.withColumn("_place", place).join(F.broadcast(bitmap), F.shiftright("_place", 6) == F.col("_word"), "left")
    hit = F.col("_mask").bitwiseAND(F.expr("shiftleft(1L, int(pmod(_place, 64)))")) != 0
    return out.withColumn(name, F.coalesce(hit, F.lit(False))).drop("_place", "_word", "_mask")
