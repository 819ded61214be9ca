"""Repeated passages by super-k-mers of words.

A window is `width` words; its minimiser is the `gram`-word string in it with the least hash, the leftmost if there are
several. Neighbouring windows with the same minimiser are a super-k-mer: they travel as one packed string of words to
the minimiser's bucket, where all windows are sorted, and so counted exactly, word by word. Equal windows have equal
minimisers, so they always meet.

1. Minimisers are counted. A window whose minimiser occurs once has no equal; a bitmap leaves such super-k-mers at home.
2. The others travel. Of equal strings in a task only the earliest does; the later ones are repeats already.
3. Buckets mark each window but the earliest of its kind; texts are cut where they have marks.
"""

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from . import common as C
from .components import saved
from .shingles import MULTIPLY, mix
from .suffix_dedup import least_in

PIECE = 1 << 22  # bytes of a text that are split into words at once
CHUNK = 1 << 18  # words looked at together
PLACE = np.uint64((1 << 23) - 1)  # places in a chunk with its last piece
CROWDED = 4096  # super-k-mers of a minimiser, beyond which its windows get buckets of their own
MOST_CROWDED = 1 << 20  # such minimisers, at most
HELD = 1 << 17  # strings that a task remembers to find equal ones


def pieces(raw, width):
    """(number of the first word, words) of a text, in pieces that share width - 1 words, so that each window is in one."""
    if len(raw) <= PIECE:
        yield 0, raw.split()
        return
    at, first, tail = 0, 0, []
    while at < len(raw):
        end = at + PIECE
        while end < len(raw) and not raw[end : end + 1].isspace():
            end += 1
        words = tail + raw[at:end].split()
        yield first, words
        tail = words[max(0, len(words) - width + 1) :]
        first, at = first + len(words) - len(tail), end


def chunks(texts, width):
    """(words, owner of each, [(text, number of its first word, its place in words)]) of many pieces together."""
    words, owner, parts = [], [], []
    for i, raw in enumerate(texts):
        for first, found in pieces(raw, width):
            if len(found) < width:
                continue
            parts.append((i, first, len(words)))
            owner.append(len(found))
            words += found
            if len(words) >= CHUNK:
                yield words, np.repeat(np.arange(len(parts)), owner), parts
                words, owner, parts = [], [], []
    if words:
        yield words, np.repeat(np.arange(len(parts)), owner), parts


def gram_hashes(own, gram):
    """Hashes of `gram` neighbours in a row, by doubling."""
    done = 1
    while 2 * done <= gram:
        own = mix(own[:-done] * MULTIPLY + own[done:])
        done *= 2
    return own if done == gram else mix(own[: len(own) - (gram - done)] * MULTIPLY + own[gram - done :])


def superkmers(words, owner, width, gram):
    """First and last window and minimiser of each super-k-mer; windows count from the first word."""
    hashes = gram_hashes(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)), gram)
    key = (hashes & ~PLACE) | np.arange(len(hashes), dtype=np.uint64)
    least = least_in(key, width - gram + 1)
    at = np.flatnonzero(owner[: len(least)] == owner[width - 1 :])
    least = least[at]
    edge = np.flatnonzero(least[1:] != least[:-1]) + 1
    starts = np.concatenate([[0], edge])
    return at[starts], at[np.append(edge, len(at)) - 1], hashes[(least[starts] & PLACE).astype(np.int64)].view(np.int64)


def counts(width, gram):
    """Minimisers of texts and how many super-k-mers each has, added up by chunk."""

    def run(batches):
        for b in batches:
            for words, owner, _ in chunks(C.raw(b.column("_text")), width):
                found, times = np.unique(superkmers(words, owner, width, gram)[2], return_counts=True)
                yield pa.record_batch([pa.array(found), pa.array(times)], names=["minimiser", "times"])

    return run


def filtered(counted, most_bits=26):
    """(bitmap of the minimisers that occur more than once, sorted array of the crowded ones).

    The bitmap has 16 places for each of them and 2**most_bits at most; beyond that it lets more super-k-mers travel.
    Crowded are those with more than CROWDED super-k-mers, or, if these are too many, the MOST_CROWDED most frequent ones.
    """
    sizes = counted.groupBy(F.floor(8 * F.log2("times")).alias("size")).agg(F.count(F.lit(1)).alias("n"), F.max("times").alias("most")).orderBy(F.desc("size")).collect()
    n, limit, room = sum(r["n"] for r in sizes), CROWDED + 1, MOST_CROWDED
    for r in sizes:  # from the largest; there are at most 64 * 8
        room -= r["n"]
        if room < 0:
            limit = max(limit, r["most"] + 1)
            break
    bits = C.places(n, most_bits)
    place = F.col("minimiser").bitwiseAND(F.lit((1 << bits) - 1))
    rows = counted.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(p & 63))")).alias("mask")).toArrow()
    bitmap = np.zeros(1 << (bits - 6), np.uint64)
    bitmap[rows.column("word").to_numpy()] = rows.column("mask").to_numpy().view(np.uint64)
    crowded = counted.where(F.col("times") >= limit).select("minimiser").toArrow().column(0).to_numpy()
    return bitmap, np.sort(crowded)


TRAVEL = ("bucket", "string", "_id", "_row", "start", "n")


def travel(width, gram, shared):
    """Super-k-mers whose minimiser the bitmap knows, with a string; later ones of equal strings without it."""

    def run(batches):
        bitmap, crowded = shared.value
        mask = np.uint64(len(bitmap) * 64 - 1)
        held, rows, kind = {}, [], pa.null()

        def met(bucket, string, place, n):
            before = held.get(string)
            if before is None:
                held[string] = (bucket, place, n)
            elif before[1] != place:
                if place < before[1]:
                    held[string] = (bucket, place, n)
                    place = before[1]
                rows.append((place[3] * 0x9E3779B1 + place[2] & 0x7FFFFFFFFFFFFFFF, None, place, n))

        def told():
            out = [*rows, *((bucket, string, place, n) for string, (bucket, place, n) in held.items())]
            rows.clear()
            held.clear()
            bucket, string, place, n = zip(*out, strict=True) if out else ((),) * 4
            cols = (pa.array(bucket, pa.int64()), pa.array(string, pa.binary()), pa.array([p[1] for p in place], kind), pa.array([p[2] for p in place], pa.int64()), pa.array([p[3] for p in place], pa.int64()), pa.array(n, pa.int32()))
            return pa.record_batch([*cols], names=list(TRAVEL))

        for b in batches:
            ids, own, kind = b.column("_id").to_pylist(), b.column("_row").to_pylist(), b.schema.field("_id").type
            for words, owner, parts in chunks(C.raw(b.column("_text")), width):
                first, last, mini = superkmers(words, owner, width, gram)
                low = mini.view(np.uint64) & mask
                go = np.flatnonzero((bitmap[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63))) & np.uint64(1))
                first, last, mini = first[go], last[go], mini[go]
                alone = np.isin(mini, crowded)
                for f, t, m, p, each in zip(first.tolist(), last.tolist(), mini.tolist(), owner[first].tolist(), alone.tolist(), strict=True):
                    i, number, at = parts[p]
                    number += f - at
                    if not each:
                        met(m, b" ".join(words[f : t + width]), (ids[i] is not None, ids[i], own[i], number), t - f + 1)
                        continue
                    for k in range(f, t + 1):  # each window in a bucket of its own
                        string = b" ".join(words[k : k + width])
                        met(xxhash.xxh3_64_intdigest(string) >> 1, string, (ids[i] is not None, ids[i], own[i], number + k - f), 1)
                if len(held) >= HELD or len(rows) >= HELD:
                    yield told()
        if held or rows:
            yield told()

    return run


def repeats(group, width):
    """(string, place, number of windows) of one bucket -> (place, number) of runs of windows that have an earlier equal."""
    group.sort()
    heads, later = [], []
    for string, place, n in group:
        if not heads or heads[-1][0] != string:
            heads.append((string, place, n))
        elif place != heads[-1][1]:
            later.append((place, n))
    if len(heads) > 1:
        windows = []
        for string, (known, own, row, start), n in heads:
            edge, at = [0], -1
            while (at := string.find(b" ", at + 1)) >= 0:
                edge.append(at + 1)
            edge.append(len(string) + 1)
            windows += [(string[edge[k] : edge[k + width] - 1], (known, own, row, start + k)) for k in range(n)]
        windows.sort()
        head = (None, None)
        for window in windows:
            if window[0] != head[0]:
                head = window
            elif window[1] != head[1]:
                later.append((window[1], 1))
    later.sort()
    runs = []
    for place, n in later:
        if runs and runs[-1][0][:3] == place[:3] and place[3] <= runs[-1][0][3] + runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], place[3] + n - runs[-1][0][3])
        else:
            runs.append([place, n])
    return runs


def count_windows(width):
    """Rows sorted by bucket -> windows with an earlier equal, as start * 2**16 + number."""

    def told(runs, kind):
        cols = (pa.array([p[1] for p, _ in runs], kind), pa.array([p[2] for p, _ in runs], pa.int64()), pa.array([(p[3] << 16) + n for p, n in runs], pa.int64()))
        return pa.record_batch([*cols], names=["_id", "_row", "at"])

    def run(batches):
        bucket, group, kind = None, [], None
        for b in batches:
            kind, runs = b.schema.field("_id").type, []
            for k, string, own, row, start, n in zip(*(b.column(c).to_pylist() for c in TRAVEL), strict=True):
                if k != bucket:
                    if len(group) > 1:
                        runs += repeats(group, width)
                    bucket, group = k, []
                place = (own is not None, own, row, start)
                if string is None:
                    runs.append((place, n))
                else:
                    group.append((string, place, n))
            yield told(runs, kind)
        if len(group) > 1:
            yield told(repeats(group, width), kind)

    return run


def cut(width):
    """Texts and runs of their repeated windows -> the words that stay."""

    def run(batches):
        for b in batches:
            out = []
            for raw, runs in zip(C.raw(b.column("_text")), b.column("runs").to_pylist(), strict=True):
                words, spans = raw.split(), []
                for at in sorted(runs or []):
                    start, end = at >> 16, (at >> 16) + (at & 0xFFFF) + width - 1
                    if spans and start <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], end)
                    else:
                        spans.append([start, end])
                kept = []
                for start, end in zip([0, *(e for _, e in spans)], [*(s for s, _ in spans), len(words)], strict=True):
                    kept += words[start:end]
                text = b" ".join(kept)
                out.append((len(words), len(words) - len(kept), hashlib.sha256(text).hexdigest(), text.decode(), [{"start": s, "end": e} for s, e in spans]))
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            cols = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), span)
            yield pa.record_batch([b.column("_id"), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=["_id", "n_words", "n_removed", "kept_sha256", "kept_text", "spans"])

    return run


def without_repeats(docs, id_col="doc_id", text_col="text", width=20, gram=8, folder=None):
    """One row per input row: id, n_words, n_removed, kept_sha256, kept_text (kept words, one space between them) and
    spans (first and last + 1 of removed words).

    Words are runs without [\\x20\\x09-\\x0D]. A word is removed if a window of `width` words covers it whose words also
    start earlier: at a smaller id, or earlier in the same text. Windows don't cross texts and are judged on the input.

    Null and empty texts, and those below `width` words, lose nothing. Rows of the same id and text are one document and
    fare alike; rows of one id with different texts are ordered by a hash of the text; null ids come first. No rows give
    no rows. A minimiser may have any number of super-k-mers: beyond CROWDED each of its windows has its own bucket, where
    equal ones are told apart from at most one a task (or one in HELD), so that no task has to hold a passage that all
    texts share. Minimisers that more than MOST_CROWDED others exceed have at most that share of all super-k-mers each.
    What is counted is written to folder (below spark.checkpoint.dir by default).
    """
    if not 0 < gram <= width <= 1 << 12:
        raise ValueError("0 < gram <= width <= 4096")
    spark = docs.sparkSession
    folder = folder or C.shared_dir(spark, "superkmers")
    kind = docs.schema[id_col].dataType.simpleString()
    # rows of one id are told apart by their text
    docs = C.pick(docs, _id=id_col, _text=text_col).withColumn("_row", F.xxhash64(C.whole(F.col("_text"))))
    counted = docs.select("_text").mapInArrow(counts(width, gram), "minimiser long, times long").groupBy("minimiser").agg(F.sum("times").alias("times"))
    shared = spark.sparkContext.broadcast(filtered(saved(counted.where("times > 1"), folder, "minimisers")))
    going = docs.mapInArrow(travel(width, gram, shared), f"bucket long, string binary, _id {kind}, _row long, start long, n int")
    marks = going.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(count_windows(width), f"_id {kind}, _row long, at long")
    runs = saved(marks.groupBy(F.col("_id").alias("_i"), F.col("_row").alias("_r")).agg(F.collect_list("at").alias("runs")), folder, "runs")

    # texts without any run are cut where they are read; only the others are shuffled
    bits = C.places(runs.count())
    marked = C.maybe_in(docs, F.col("_row"), C.bit_filter(runs.select("_r"), bits), "_in", bits)
    some = marked.where("_in").join(runs, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_row") == F.col("_r")), "left").select("_id", "_text", "runs")
    none = marked.where("not _in").select("_id", "_text", F.lit(None).cast("array<bigint>").alias("runs"))
    result = f"_id {kind}, n_words long, n_removed long, kept_sha256 string, kept_text string, spans array<struct<start:long,end:long>>"
    return some.unionByName(none).mapInArrow(cut(width), result).withColumnRenamed("_id", id_col)


def op11_superkmers(spark, sf_dir):
    return without_repeats(C.read(spark, sf_dir, "documents")).drop("kept_text", "spans")


OP11_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
k AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, unnest(list_transform(range(1, len(w) - 18), lambda i: md5(array_to_string(w[i:i + 19], ' ')))) AS k FROM d WHERE len(w) >= 20),
m AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM k) WHERE r > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM m),
e AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
s AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS kept FROM e ANTI JOIN c USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN s USING (doc_id)
"""
