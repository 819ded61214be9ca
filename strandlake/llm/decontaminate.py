"""Benchmark decontamination: broadcast hash set of normalised test n-grams, scanned against training windows."""

import hashlib
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from . import common as C

#: Bytes of UTF-8 that end a word, and A-Z in lower case; all others stay.
FOLD = bytes(0x20 if x < 0x30 or 0x3A <= x < 0x41 or 0x5B <= x < 0x61 or 0x7B <= x < 0x80 else x + 32 * (0x41 <= x <= 0x5A) for x in range(256))


def words_of(raw):
    return raw.translate(FOLD).split()


def item_windows(words, n):
    """The distinct windows of an item; a shorter item is one window, one without words none."""
    if not words:
        return set()
    return {b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}


class Windows:
    """Hash set of the benchmark's windows: window -> item ids, and the words that occur in them."""

    def __init__(self, rows):
        self.items, self.words = {}, {}
        for item, window in rows:
            self.items.setdefault(window, []).append(item)
        self.lengths = sorted({w.count(b" ") + 1 for w in self.items})
        for window in self.items:
            self.words.update(dict.fromkeys(window.split(b" "), 1))

    def hits(self, words):
        """[(first word, length, item ids)]: only windows all of whose words occur in the benchmark are looked up."""
        known = np.zeros(len(words) + 1, np.int64)
        np.cumsum(np.fromiter(map(self.words.get, words, repeat(0)), np.int8, len(words)), out=known[1:])
        out = []
        for n in self.lengths:
            for i in np.flatnonzero(known[n:] - known[:-n] == n).tolist() if len(words) >= n else ():
                if (items := self.items.get(b" ".join(words[i : i + n]))) is not None:
                    out.append((i, n, items))
        return out


def verdict(raw, words, hits):
    """n_words, n_hit, items, [(start, end)] in bytes, and the text without those spans (None if there are none)."""
    if not hits:
        return len(words), 0, [], [], None
    covered = np.zeros(len(words) + 1, np.int8)
    for i, n, _ in hits:
        covered[i : i + n] = 1
    edges = np.flatnonzero(np.diff(covered, prepend=np.int8(0))).reshape(-1, 2)
    at = [m.span() for m in re.finditer(rb"[^ ]+", raw.translate(FOLD))]
    spans = [(at[a][0], at[b - 1][1]) for a, b in edges.tolist()]
    starts, ends = [0, *(e for _, e in spans)], [*(s for s, _ in spans), len(raw)]
    clean = b"".join(raw[a:b] for a, b in zip(starts, ends, strict=True)).decode()
    items = sorted({"" if x is None else str(x) for _, _, found in hits for x in found})
    return len(words), int(covered.sum()), items, spans, clean


RESULT = "n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>, clean_text string"
RESULT_TYPES = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string()]


def result(batch, rows):
    cols = list(zip(*rows, strict=True)) or [()] * 5
    cols[3] = [[{"start": a, "end": b} for a, b in x] for x in cols[3]]
    rest = [n for n in batch.schema.names if n not in ("_text", "_hits")]
    arrays = [batch.column(n) for n in rest] + [pa.array(c, t) for c, t in zip(cols, RESULT_TYPES, strict=True)]
    return pa.record_batch(arrays, names=[*rest, "n_words", "n_hit", "items", "spans", "clean_text"])


def scan(shared):
    def run(batches):
        table = None
        for b in C.slices(batches):
            table = table or Windows(shared.value)
            out = []
            for raw in C.raw(b.column("_text")):
                words = words_of(raw)
                out.append(verdict(raw, words, table.hits(words)))
            yield result(b, out)

    return run


def window_keys(lengths):
    """(_id, _digest, _at, _n, _window) for every window of the lengths in demand."""

    def run(batches):
        for b in C.slices(batches):
            rows, at, n_, key = [], [], [], []
            for r, raw in enumerate(C.raw(b.column("_text"))):
                words = words_of(raw)
                for n in lengths:
                    for i in range(len(words) - n + 1):
                        rows.append(r)
                        at.append(i)
                        n_.append(n)
                        key.append(hashlib.blake2b(b" ".join(words[i : i + n]), digest_size=16).digest())
            take = pa.array(rows, pa.int64())
            yield pa.record_batch([b.column("_id").take(take), b.column("_digest").take(take), pa.array(at, pa.int64()), pa.array(n_, pa.int64()), pa.array(key, pa.binary())], names=["_id", "_digest", "_at", "_n", "_window"])

    return run


def from_hits(batches):
    for b in C.slices(batches):
        out = []
        for raw, hits in zip(C.raw(b.column("_text")), b.column("_hits").to_pylist(), strict=True):
            found = {}
            for h in hits or []:
                found.setdefault((h["_at"], h["_n"]), []).append(h["_item"])
            out.append(verdict(raw, words_of(raw), [(i, n, x) for (i, n), x in found.items()]))
        yield result(b, out)


def decontaminate(docs, benchmark, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text", n=10, broadcast_bytes=32 << 20, extra=()):
    """One row per input row: id, the extra columns, n_words, n_hit, items, spans, clean_text.

    Words are runs of 0-9, a-z and non-ASCII after lower-casing A-Z. A window is n consecutive words of an item, or the
    whole item when it has fewer (but some). A word of the text inside any occurrence of a window is hit; items are the
    ids (as strings, sorted) whose windows occur, spans the hit stretches in bytes of UTF-8, clean_text the text
    without them (null where nothing is hit).

    The windows are broadcast only if they take at most `broadcast_bytes`, which is counted first; a larger benchmark
    meets the texts in a shuffled join on the windows' hashes, with the same result.
    Null text has no words; items of null or wordless text have no windows; a null item id shows as ''. Rows that
    repeat an id are each judged by their own text. Extra columns pass through, as x_<name> where a result column has the
    name. No rows give no rows; without a benchmark nothing is hit.
    """
    spark = docs.sparkSession

    def windows(batches):
        for b in C.slices(batches):
            found = [(i, w) for i, raw in enumerate(C.raw(b.column("_text"))) for w in item_windows(words_of(raw), n)]
            ids = b.column("_item").take(pa.array([i for i, _ in found], pa.int64()))
            yield pa.record_batch([ids, pa.array([w for _, w in found], pa.binary())], names=["_item", "_window"])

    kind = benchmark.schema[item_col].dataType.simpleString()
    items = C.pick(benchmark, _item=item_col, _text=item_text_col).mapInArrow(windows, f"_item {kind}, _window binary").distinct()
    size = items.agg(F.coalesce(F.sum(F.length("_window") + 80), F.lit(0))).first()[0]

    id_kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), *(F.col(f"`{c}`").alias(f"_x_{c}") for c in extra), F.col(f"`{text_col}`").alias("_text"))
    kinds = "".join(f"`_x_{c}` {docs.schema[c].dataType.simpleString()}, " for c in extra)
    schema = f"_id {id_kind}, {kinds}{RESULT}"
    if size <= broadcast_bytes:
        out = rows.mapInArrow(scan(spark.sparkContext.broadcast([tuple(r) for r in items.collect()])), schema)
    else:
        lengths = [r[0] for r in items.select((F.size(F.split(F.col("_window").cast("string"), " "))).alias("n")).distinct().collect()]
        keyed = rows.withColumn("_digest", F.md5(C.whole(F.col("_text")).cast("binary")))
        own = keyed.select("_id", "_digest", "_text").dropDuplicates(["_id", "_digest"]).mapInArrow(window_keys(lengths), f"_id {id_kind}, _digest string, _at long, _n long, _window binary")
        hashed = items.mapInArrow(lambda batches: (pa.record_batch([b.column("_item"), pa.array([hashlib.blake2b(w, digest_size=16).digest() for w in b.column("_window").to_pylist()], pa.binary())], names=["_item", "_window"]) for b in batches), f"_item {kind}, _window binary")
        hits = own.join(hashed, "_window").groupBy(F.col("_id").alias("_i"), F.col("_digest").alias("_d")).agg(F.collect_list(F.struct("_at", "_n", "_item")).alias("_hits"))
        out = keyed.join(hits, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_digest") == F.col("_d")), "left")
        out = out.select("_id", *(f"`_x_{c}`" for c in extra), "_text", "_hits").mapInArrow(from_hits, schema)
    names = (id_col, "n_words", "n_hit", "items", "spans", "clean_text")
    return out.select(F.col("_id").alias(id_col), *(F.col(f"`_x_{c}`").alias(C.beside(c, names)) for c in extra), "n_words", "n_hit", "items", "spans", "clean_text")


def op7_decontaminate(spark, sf_dir):
    out = decontaminate(C.read(spark, sf_dir, "documents"), C.read(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


OP7_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, len(x) AS n, array_to_string(x, ' ') AS k
       FROM (SELECT item_id, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: w[i:i + 9])) AS x FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)),
h AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, k)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM h GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""
