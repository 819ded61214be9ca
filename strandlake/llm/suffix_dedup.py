"""Repeated passages by a depth-limited radix sort of suffixes.

Suffixes are sorted only through their first `width` bytes, and only as far as groups need it: each pass splits groups by
the next digit, groups of one drop out, and groups that the last pass leaves are exactly the repeated windows. Suffixes
move in bundles: neighbours of one text whose windows overlap. A bundle's core is what all its windows have in common,
its hull all that they cover. A pass groups bundles by core; those with equal hulls are settled at once, since all their
windows are repeated; one bundle for each different hull of a core goes on, cut into finer bundles, whose cores are
longer: the depth to which a group's suffixes are known to agree grows from pass to pass.

1. bundles by anchor: of a window's `gram`-byte strings the one with the least hash, leftmost first. Equal windows have
   equal anchors at equal places, so a bundle stands for all windows of an anchor's occurrence, some 75 of them.
2. bundles of `fine` suffixes, aligned to the anchor, with cores of width - fine + 1 bytes.
3. single suffixes, through all `width` bytes.

Digits are compared as 64-bit hashes and hulls by 64 more bits within a core, since the order inside a group is of no use.
"""

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from . import common as C
from .components import saved
from .shingles import mix

#: An odd base and its inverse modulo 2**64, for hashes of substrings by differences of prefix sums.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
CHUNK = 1 << 22  # bytes looked at together
PLACE = np.uint64((1 << 23) - 1)  # places in a chunk and its overlap
LONGEST = 1 << 15  # suffixes of one bundle, or of one row of a settled run

_powers = {}


def powers(base, n):
    if len(_powers.get(base, ())) < n:
        _powers[base] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, base, np.uint64)]), dtype=np.uint64)
    return _powers[base][:n]


def gram_hashes(raw, gram):
    """Hash of each `gram`-byte string of an array of bytes."""
    table = mix(np.arange(1, 257, dtype=np.uint64))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(table[raw] * powers(BASE, len(raw)), out=sums[1:])
    return mix((sums[gram:] - sums[:-gram]) * powers(INVERSE, len(raw) - gram + 1))


def least_in(x, n):
    """Minimum of each n neighbours in a row, by doubling."""
    done = 1
    while 2 * done <= n:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return x if done == n else np.minimum(x[: len(x) - (n - done)], x[n - done :])


def anchors(raw, width, gram):
    """(first window, last window, anchor's place, anchor's hash) of each occurrence; raw: the bytes of one text."""
    out, n = [], len(raw)
    for at in range(0, max(0, n - width + 1), CHUNK):
        part = raw[at : at + CHUNK + width - 1]
        hashes = gram_hashes(part, gram)
        key = (hashes & ~PLACE) | np.arange(len(hashes), dtype=np.uint64)
        least = least_in(key, width - gram + 1)
        edge = np.flatnonzero(least[1:] != least[:-1]) + 1
        first = np.concatenate([[0], edge])
        last = np.concatenate([edge - 1, [len(least) - 1]])
        place = (least[first] & PLACE).astype(np.int64)
        out.append((first + at, last + at, place + at, hashes[place].view(np.int64)))
    if not out:
        return (np.empty(0, np.int64),) * 4
    first, last, place, hashes = (np.concatenate(x) for x in zip(*out, strict=True))
    # an occurrence that two chunks share is one again
    same = np.append(False, place[1:] == place[:-1])
    start = np.flatnonzero(~same)
    return first[start], last[np.append(start[1:], len(first)) - 1], place[start], hashes[start]


def packed(first, last, place):
    """Where a bundle is in its text: first suffix, suffixes after it, distance from the last to the anchor."""
    return (first << 32) | ((last - first) << 16) | (place - last)


BUNDLES = ("core", "hull", "times", "at")


def bundle_batch(batch, rows, cols):
    """An Arrow batch of bundles: rows of the batch that they belong to, and core, hull, times and place of each."""
    none = [np.empty(0, np.int64)]
    take = pa.array(np.concatenate(rows or none))
    arrays = [pa.array(np.concatenate([np.asarray(x, np.int64) for x in c] or none)) for c in cols]
    return pa.record_batch([batch.column("_id").take(take), batch.column("_row").take(take), *arrays], names=["_id", "_row", *BUNDLES])


def by_anchor(width, gram):
    """Bundles of whole texts by anchor. What occurs several times in one text is one bundle with that count; all its
    places are told as settled runs besides (times = 0), so that a text of one short period has few bundles."""

    def run(batches):
        for b in batches:
            rows, cols = [], ([], [], [], [])
            for i, raw in enumerate(C.raw(b.column("_text"))):
                if len(raw) < width:
                    continue
                first, last, place, core = anchors(np.frombuffer(raw, np.uint8), width, gram)
                digest = xxhash.xxh3_64_intdigest
                # the anchor's place belongs to the hull
                hull = np.array([digest(raw[f : t + width], p - f) for f, t, p in zip(first.tolist(), last.tolist(), place.tolist(), strict=True)], np.uint64).view(np.int64)
                times = np.ones(len(core), np.int64)
                at = packed(first, last, place)
                _, index, inverse, count = np.unique(np.stack([core, hull]), axis=1, return_index=True, return_inverse=True, return_counts=True)
                if len(index) < len(core):
                    many = count[inverse.ravel()] > 1
                    edge = np.diff(np.concatenate([[0], many.astype(np.int8), [0]]))
                    for x, y in zip(first[np.flatnonzero(edge == 1)].tolist(), last[np.flatnonzero(edge == -1) - 1].tolist(), strict=True):
                        start = np.arange(x, y + 1, LONGEST)
                        rows.append(np.full(len(start), i))
                        for c, v in zip(cols, (np.zeros(len(start)), np.zeros(len(start)), np.zeros(len(start)), packed(start, np.minimum(start + LONGEST - 1, y), np.minimum(start + LONGEST - 1, y))), strict=True):
                            c.append(v)
                    core, hull, at, times = core[index], hull[index], at[index], count
                rows.append(np.full(len(core), i))
                for c, v in zip(cols, (core, hull, times, at), strict=True):
                    c.append(v)
            yield bundle_batch(b, rows, cols)

    return run


def finer(width, size):
    """The bundles in demand, cut into such of at most `size` suffixes, aligned to the anchor."""

    def run(batches):
        digest = xxhash.xxh3_64_intdigest
        for b in batches:
            rows, cols = [], ([], [], [], [])
            for i, (raw, wanted) in enumerate(zip(C.raw(b.column("_text")), b.column("wanted").to_pylist(), strict=True)):
                core, hull, times, at = [], [], [], []
                for w in wanted:
                    first, more, left = w["at"] >> 32, (w["at"] >> 16) & 0xFFFF, w["at"] & 0xFFFF
                    last = first + more
                    place = last + left
                    for k in range(left // size, (place - first) // size + 1):
                        late = place - k * size  # the last suffix of the bundle, and the first, if they are all here
                        early = late - size + 1
                        x, y = max(first, early), min(last, late)
                        core.append(digest(raw[late : early + width], k))
                        hull.append(digest(raw[x : y + width], late - y))
                        times.append(w["times"])
                        at.append((x << 32) | ((y - x) << 16) | (place - y))
                rows.append(np.full(len(at), i))
                for c, v in zip(cols, (np.array(core, np.uint64).view(np.int64), np.array(hull, np.uint64).view(np.int64), times, at), strict=True):
                    c.append(v)
            yield bundle_batch(b, rows, cols)

    return run


def cut(width):
    """Texts and their repeated windows -> the bytes that stay."""

    def run(batches):
        for b in batches:
            out = []
            for raw, runs in zip(C.raw(b.column("_text")), b.column("runs").to_pylist(), strict=True):
                spans = []
                for at in sorted(runs or []):
                    start, end = at >> 32, (at >> 32) + ((at >> 16) & 0xFFFF) + width
                    if spans and start <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], end)
                    else:
                        spans.append([start, end])
                starts, ends = [0, *(e for _, e in spans)], [*(s for s, _ in spans), len(raw)]
                kept = b"".join(raw[s:e] for s, e in zip(starts, ends, strict=True)) if spans else raw
                out.append((len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), [{"start": s, "end": e} for s, e in spans]))
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            cols = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), span)
            yield pa.record_batch([b.column("_id"), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=["_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return run


def suffix_dedup(docs, id_col="doc_id", text_col="text", width=200, gram=48, fine=12, folder=None):
    """One row per input row: id, n_bytes, n_removed, n_spans, kept_sha256, spans (start and end of removed runs).

    Texts are UTF-8 bytes. A byte is removed if a string of `width` bytes covers it that also starts anywhere else, in
    the same text or another; strings don't cross texts, may overlap, and are judged on the input.

    Null and empty texts, and those below `width` bytes, lose nothing. Rows that repeat an id, or have none, are texts
    of their own. No rows give no rows. A core, a hull or a window may be as frequent as it likes: each is only ever
    counted, with partial sums on the map side, and met by a join of two stored tables, whose skewed side Spark splits;
    no task has to hold a group. A bundle that a pass hands on becomes a bounded number of finer ones, so that rows grow
    with the input. `width` is less than 32,768. What a pass counts is written to folder (below spark.checkpoint.dir by default).
    """
    folder = folder or C.shared_dir(docs.sparkSession, "suffixes")
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"_id {kind}, _row long, core long, hull long, times long, at long"
    # rows of one id are told apart by their text; those of equal text too fare alike, whichever is which
    docs = C.pick(docs, _id=id_col, _text=text_col).withColumn("_row", F.xxhash64(C.whole(F.col("_text"))))
    settled = []

    def sort(bundles, name, last=False):
        """Settles bundles of equal hulls; returns those that go on, one for each hull of a core that has several."""
        bundles = saved(bundles, folder, name)
        counted = bundles.where("times > 0").groupBy("core", "hull").agg(F.sum("times").alias("times"), *([] if last else [F.min(F.struct("_id", "_row", "at")).alias("one")]))
        counted = saved(counted.where("times > 1") if last else counted, folder, f"{name}-counted")
        fresh = bundles.where("times = 1" if name != "anchors" else "times > 0")
        again = fresh.join(counted.where("times > 1").select("core", "hull"), ["core", "hull"], "left_semi")
        settled.append(again.select("_id", "_row", "at"))
        if name == "anchors":
            settled.append(bundles.where("times = 0").select("_id", "_row", "at"))
        if last:
            return None
        several = saved(counted.groupBy("core").count().where("count > 1").select("core"), folder, f"{name}-several")
        return counted.join(several, "core", "left_semi").select("one.*", "times")

    def cut_finer(bundles, name, size):
        wanted = bundles.groupBy(F.col("_id").alias("_i"), F.col("_row").alias("_r")).agg(F.collect_list(F.struct("at", "times")).alias("wanted"))
        wanted = saved(wanted, folder, f"{name}-wanted")
        near = C.maybe_in(docs, F.col("_row"), C.bit_filter(wanted.select("_r")), "_in").where("_in").drop("_in")
        texts = near.join(wanted, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_row") == F.col("_r"))).select("_id", "_row", "_text", "wanted").dropDuplicates(["_id", "_row"])
        return texts.mapInArrow(finer(width, size), schema)

    going = sort(docs.mapInArrow(by_anchor(width, gram), schema), "anchors")
    going = sort(cut_finer(going, "bundles", fine), "bundles")
    sort(cut_finer(going, "windows", 1), "windows", last=True)

    runs = settled[0]
    for more in settled[1:]:
        runs = runs.unionByName(more)
    runs = saved(runs.groupBy(F.col("_id").alias("_i"), F.col("_row").alias("_r")).agg(F.collect_list("at").alias("runs")), folder, "runs")

    # texts without any run are cut where they are read; only the others are shuffled
    marked = C.maybe_in(docs, F.col("_row"), C.bit_filter(runs.select("_r")), "_in")
    some = marked.where("_in").join(runs, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_row") == F.col("_r")), "left").select("_id", "_text", "runs")
    none = marked.where("not _in").select("_id", "_text", F.lit(None).cast("array<bigint>").alias("runs"))
    result = f"_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>"
    return some.unionByName(none).mapInArrow(cut(width), result).withColumnRenamed("_id", id_col)


def op6_suffix_dedup(spark, sf_dir):
    return suffix_dedup(C.read(spark, sf_dir, "documents")).drop("spans")


OP6_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
t AS (SELECT doc_id, o, substr(h, 2 * o + 1, 2398) AS t FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2, 1000)) AS o FROM d)),
w AS (SELECT doc_id, o + i AS i, md5(substr(t, 2 * i + 1, 400)) AS k FROM (SELECT doc_id, o, t, unnest(range(0, least(1000, length(t) // 2 - 199))) AS i FROM t WHERE length(t) >= 400)),
r AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
m AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM w SEMI JOIN r USING (k)),
g AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM m),
sp AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM g GROUP BY doc_id, g),
pc AS (SELECT doc_id, a, b, substr(h, 2 * before + 1, 2 * (a - before)) AS piece FROM (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM sp) JOIN d USING (doc_id)),
c AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(piece, '' ORDER BY a) AS head FROM pc GROUP BY doc_id)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(head || substr(h, 2 * last + 1), h))) AS kept_sha256 FROM d LEFT JOIN c USING (doc_id)
"""
