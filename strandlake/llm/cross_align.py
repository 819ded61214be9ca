"""Alignment of two tokenizers' tokens by lockstep vectorised merging.

Both tokenizations spell the same bytes, so tokens that overlap are found by a merge of their ends. One state vector
holds the A and B pointers of all documents of a batch: each step links every document's current pair, cuts where both
tokens end, advances the pointer that ends first (both at a cut), and compacts the vector to those not yet finished.
Long documents take several places in the vector, from one common end to another, so that steps stay few.

1. Texts are encoded and merged once: ids, groups and how often each pair of ids is linked in the task.
2. Counts of pairs are added up over all documents.
3. Stored ids are merged again and the links' counts summed. Those of the most frequent pairs, `most` at most, are in
   every task; links of other pairs are joined with their counts.
"""

import hashlib
import re
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from . import common as C
from .components import saved
from .tokens import ByteLevel

BYTES = 1 << 20  # text that is merged together
LANE = 128  # A tokens after which a long document may take a further place in the vector
NEAR = 64  # tokens among which a common end is looked for there
HELD = 1 << 19  # pairs whose counts a task holds before it hands them on
ROW = 100_000  # pairs in one row of counts

SPACED = re.compile(" +[^ ]*")

_sides = {}


def sides(a_path, b_path):
    """The encoders of a worker, kept from task to task, and the lengths of their tokens."""
    key = a_path, b_path
    if key not in _sides:
        a, b = ByteLevel(a_path, plain=True), Pieces(b_path)
        _sides[key] = a, b, a.sizes(), b.sizes()
    return _sides[key]


class Pieces(dict):
    """B: word -> ids as bytes of a sentencepiece vocabulary, for words led by a space, or by a line feed.

    No piece has a space behind another sign or holds a line feed, and text is not normalised (both are checked), so
    nothing merges across the words' edges: a text's ids are those of its words in a row. `keep` words are remembered.
    """

    def __init__(self, path, keep=300_000):
        import sentencepiece

        self.library, self.keep = sentencepiece.SentencePieceProcessor(model_file=path), keep
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        self.pieces = [bytes([int(p[3:5], 16)]) if self.library.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        feed, self.space = self.library.piece_to_id("<0x0A>"), self.library.piece_to_id("▁")
        ends = self.library.encode(["  a  b ", "", " ", "\na"])
        self.apart = (
            len(pieces) <= 1 << 16 and not any(" " in p.decode(errors="replace").lstrip(" ") or (b"\n" in p and i != feed) for i, p in enumerate(self.pieces))
            and b"".join(self.pieces[i] for i in ends[0]) == b"   a  b " and ends[3][:2] == [self.space, feed]
        )
        if len(pieces) > 1 << 16:
            raise ValueError("ids must fit into 16 bits")

    def sizes(self):
        out = np.zeros(1 << 16, np.int64)
        out[: len(self.pieces)] = [0 if self.library.is_control(i) or self.library.is_unknown(i) else len(p) for i, p in enumerate(self.pieces)]
        return out

    @staticmethod
    def words(text):
        """Words of a space and the text: spaces and what follows up to the next, or a line feed and what follows. The
        space that the library adds before each is left out."""
        if "  " not in text and text[0] != " ":
            return text.replace("\n", " \n").split(" ")
        out = []
        for k, line in enumerate(text.split("\n")):
            spaced = line if k else " " + line
            head = spaced.split(" ", 1)[0]
            if k:
                out.append("\n" + head)
            out += [w[1:] for w in SPACED.findall(spaced, len(head))]  # of several spaces, all go with the word after them
        return out

    def encode(self, texts):
        """Ids of each text, as bytes."""
        if not self.apart:
            return [np.array(x, "<u2").tobytes() for x in self.library.encode(texts, num_threads=1)]
        if len(self) > self.keep:
            self.clear()
        found = [[] if "▁" in t else self.words(t) for t in texts]  # that sign becomes a space, so the text isn't spelled
        fresh = [*set(chain.from_iterable(found)).difference(self)]
        for w, ids in zip(fresh, self.library.encode(fresh, num_threads=1), strict=True):
            self[w] = array("H", [self.space] if not w else ids[1:] if w[0] == "\n" else ids).tobytes()  # a space alone was added before the line feed
        return [b"".join(map(self.__getitem__, ws)) for ws in found]


def lanes(a_end, b_end, starts):
    """Places of the state vector: first A and B token of each, and the A token after its last.

    starts: first A token of each document. A long document is divided at common ends, if there is one near.
    """
    ends = np.append(starts[1:], len(a_end))
    long = np.flatnonzero(ends - starts > 2 * LANE)
    at = np.concatenate([starts, *(np.arange(starts[d] + LANE, ends[d] - LANE, LANE) for d in long)])
    more = at[len(starts) :]
    if len(more):
        near = np.minimum(more[:, None] + np.arange(NEAR), len(a_end) - 1)
        common = b_end[np.minimum(np.searchsorted(b_end, a_end[near]), len(b_end) - 1)] == a_end[near]
        some = common.any(axis=1)
        at = np.unique(np.concatenate([starts, near[some, common[some].argmax(axis=1)] + 1]))
        at = at[at < len(a_end)]
    a = at
    begin = np.where(a > 0, a_end[a - 1], 0)
    return a, np.where(begin > 0, np.searchsorted(b_end, begin) + 1, 0), np.append(a[1:], len(a_end))


def merge(a_end, b_end, starts):
    """Links (A token, B token) in no order, and cuts (A token, B token) that end together, in order.

    a_end, b_end: last byte + 1 of each token, documents one after another; starts: first A token of each document.
    """
    a, b, stop = lanes(a_end, b_end, starts)
    a_links, b_links, a_cuts, b_cuts = [], [], [], []
    while len(a):
        a_links.append(a)
        b_links.append(b)
        x, y = a_end[a], b_end[b]
        cut = x == y
        a_cuts.append(a[cut])
        b_cuts.append(b[cut])
        a, b = a + (x <= y), b + (y <= x)
        go = a < stop
        if not go.all():
            a, b, stop = a[go], b[go], stop[go]
    none = [np.empty(0, np.int64)]
    a_links, b_links, a_cuts, b_cuts = (np.concatenate(x or none) for x in (a_links, b_links, a_cuts, b_cuts))
    order = np.argsort(a_cuts)
    return a_links, b_links, a_cuts[order], b_cuts[order]


class Batch:
    """Tokens of some documents in a row, aligned. Documents have tokens on both sides."""

    def __init__(self, a_ids, b_ids, a_size, b_size):
        """a_ids, b_ids: ids of each document as bytes."""
        self.a, self.b = (np.frombuffer(b"".join(x), "<u2") for x in (a_ids, b_ids))
        self.n_a, self.n_b = (np.array([len(x) // 2 for x in ids], np.int64) for ids in (a_ids, b_ids))
        starts = np.concatenate([[0], np.cumsum(self.n_a)[:-1]]).astype(np.int64) if len(self.n_a) else np.empty(0, np.int64)
        self.a_link, self.b_link, self.a_cut, self.b_cut = merge(np.cumsum(a_size[self.a]), np.cumsum(b_size[self.b]), starts)
        owner = np.repeat(np.arange(len(self.n_a)), self.n_a)
        self.doc = owner[self.a_link]
        self.n_links = np.bincount(self.doc, minlength=len(self.n_a))
        self.n_groups = np.bincount(owner[self.a_cut], minlength=len(self.n_a))
        self.pairs = (self.a[self.a_link].astype(np.int64) << 16) | self.b[self.b_link]

    def groups(self):
        """`a1,a2|b1;a3|b2,b3` of each document, as bytes."""
        a_n, b_n = np.diff(self.a_cut, prepend=-1), np.diff(self.b_cut, prepend=-1)
        group_a, group_b = np.repeat(np.arange(len(a_n)), a_n), np.repeat(np.arange(len(b_n)), b_n)
        out = np.empty(len(self.a) + len(self.b), np.int64)
        at_a = np.arange(len(self.a)) + (self.b_cut - b_n + 1)[group_a]
        at_b = np.arange(len(self.b)) + (self.a_cut + 1)[group_b]
        out[at_a], out[at_b] = self.a, self.b
        out[at_a[self.a_cut]] += 1 << 16  # a bar behind
        out[at_b[self.b_cut]] += 2 << 16  # a semicolon behind
        signs, length = spelled()
        found = signs[out]
        text, ends = found[found > 0].tobytes(), np.append(0, np.cumsum(length[out]))[np.append(0, np.cumsum(self.n_a + self.n_b))].tolist()
        return [text[x : y - 1] for x, y in zip(ends[:-1], ends[1:], strict=True)]


_spelled = []


def spelled():
    """Decimal ids and what may follow them, as rows of signs filled up with zeros, and their lengths."""
    if not _spelled:
        words = [b"%d%c" % (i, sign) for sign in b",|;" for i in range(1 << 16)]
        _spelled.extend((np.array(words, "S6").view(np.uint8).reshape(-1, 6), np.array([*map(len, words)])))
    return _spelled


def portions(sizes, most):
    """Ranges of rows that have about `most` bytes together."""
    at, total = 0, 0
    for i, n in enumerate(sizes):
        total += n
        if total >= most:
            yield at, i + 1
            at, total = i + 1, 0
    if at < len(sizes):
        yield at, len(sizes)


ENCODED = ("_id", "_row", "a", "b", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times")
KINDS = (pa.int64(), pa.binary(), pa.binary(), *[pa.int64()] * 4, pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()))


def encode(a_path, b_path):
    """Texts -> rows of their ids and groups, and rows (without _row) of the counts of linked pairs."""

    def usable(texts, encoder_a, encoder_b, a_size, b_size):
        """Ids of both sides; none where the bytes that a side spells aren't those of a space and the text."""
        some = [i for i, t in enumerate(texts) if t]
        a_ids, b_ids = [b""] * len(texts), [b""] * len(texts)
        for i, b in zip(some, encoder_b.encode([texts[i] for i in some]), strict=True):
            a, n = encoder_a.encode(" " + texts[i]), len(texts[i].encode()) + 1
            same = a_size[np.frombuffer(a, "<u2")].sum() == n == b_size[np.frombuffer(b, "<u2")].sum()
            if same and (encoder_b.apart or b"".join(encoder_b.pieces[x] for x in np.frombuffer(b, "<u2").tolist()) == f" {texts[i]}".encode()):
                a_ids[i], b_ids[i] = a, b
        return a_ids, b_ids

    def counted(held):
        pairs, times = np.concatenate([p for p, _ in held]), np.concatenate([t for _, t in held])
        found, at = np.unique(pairs, return_inverse=True)
        total = np.zeros(len(found), np.int64)
        np.add.at(total, at, times)
        return found, total

    def told(held, kind):
        found, times = counted(held) if held else ((), ())
        for at in range(0, len(found), ROW):
            row = [None] * 9 + [[found[at : at + ROW]], [times[at : at + ROW]]]
            yield pa.record_batch([pa.array(c or [None], t) for c, t in zip(row, (kind, *KINDS), strict=True)], names=list(ENCODED))

    def run(batches):
        encoder_a, encoder_b, a_size, b_size = sides(a_path, b_path)
        held, kind = [], None
        for batch in batches:
            kind, every = batch.schema.field("_id").type, C.strings(batch.column("_text"))
            for x, y in portions([len(t) for t in every], BYTES):
                texts = every[x:y]
                a_ids, b_ids = usable(texts, encoder_a, encoder_b, a_size, b_size)
                some = [i for i, a in enumerate(a_ids) if a]
                found = Batch([a_ids[i] for i in some], [b_ids[i] for i in some], a_size, b_size)
                cols = np.zeros((4, len(texts)), np.int64)
                cols[:, some] = found.n_a, found.n_b, found.n_groups, found.n_links
                digests = [""] * len(texts)
                for i, g in zip(some, found.groups(), strict=True):
                    digests[i] = hashlib.sha256(g).hexdigest()
                rest = [[None] * len(texts)] * 2
                rows = zip((a_ids, b_ids, *cols, digests, *rest), KINDS[1:], strict=True)
                yield pa.record_batch([batch.column("_id").slice(x, y - x), batch.column("_row").slice(x, y - x), *(pa.array(c, t) for c, t in rows)], names=list(ENCODED))
                held.append(np.unique(found.pairs, return_counts=True))
                if sum(len(p) for p, _ in held) > 2 * HELD:
                    held = [counted(held)]
                    if len(held[0][0]) > HELD:
                        yield from told(held, kind)
                        held = []
                del found  # before the next one is made
        yield from told(held, kind)

    return run


def added(values, docs, n):
    """Exact sums of longs by document."""
    low, high = values & 0x3FFFFFF, values >> 26
    return (np.bincount(docs, low, n).astype(np.int64)) + (np.bincount(docs, high, n).astype(np.int64) << 26)


def sums(a_path, b_path, shared, groups):
    """Stored ids -> n_best and count_sum over links of frequent pairs, and the other links by pair."""

    def run(batches):
        _, _, a_size, b_size = sides(a_path, b_path)
        pairs, times, best = shared.value
        for batch in batches:
            every_a, every_b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            for x, y in portions([2 * len(a) for a in every_a], BYTES):
                n, some = y - x, [i for i in range(x, y) if every_a[i]]
                found = Batch([every_a[i] for i in some], [every_b[i] for i in some], a_size, b_size)
                docs = np.array([i - x for i in some], np.int64)[found.doc]
                at = np.minimum(np.searchsorted(pairs, found.pairs), max(0, len(pairs) - 1))
                known = pairs[at] == found.pairs if len(pairs) else np.zeros(len(docs), bool)
                count = times[at[known]]
                top = count == best[found.pairs[known] & 0xFFFF]
                n_best, count_sum = np.bincount(docs[known], top, n).astype(np.int64), added(count, docs[known], n)
                order = np.lexsort((found.pairs[~known], docs[~known]))
                owner, rare = docs[~known][order], found.pairs[~known][order]
                edge = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (rare[1:] != rare[:-1])])) if len(rare) else np.empty(0, np.int64)
                times_here = np.diff(np.append(edge, len(rare)))
                offsets = np.searchsorted(owner[edge], np.arange(n + 1)).astype(np.int32)
                rest = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(rare[edge], pa.int64()), pa.array(times_here, pa.int64())], names=["pair", "k"]))
                cols = [batch.column(c).slice(x, n) for c in ("_id", "_row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")]
                text = [None] * n
                if groups:
                    for i, g in zip(some, found.groups(), strict=True):
                        text[i - x] = g.decode()
                yield pa.record_batch([*cols, pa.array(n_best), pa.array(count_sum), rest, pa.array(text, pa.string())], names=[*SUMS, "rest", "groups"])
                del found

    return run


SUMS = ("_id", "_row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum")


def cross_align(docs, a_path, b_path, id_col="doc_id", text_col="text", groups=False, most=1 << 19, folder=None):
    """One row per input row: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, and groups if asked for.

    a_path: byte-level vocabulary file, which encodes a space and the text; b_path: sentencepiece model, which adds the
    space. Tokens that both end at one byte close a group; tokens whose bytes overlap are linked. A pair of ids counts as
    many links as hold it in all documents; n_best links have the highest count of their B id (ties included), count_sum
    adds up the counts of all links. groups are `a1,a2|b1;a3|b2,b3`, decimal ids in order.

    Null and empty texts, and those that a side doesn't spell byte for byte, have no tokens: zeros and ''. Rows that
    repeat are each counted; null ids stay. No rows give no rows. Other columns have no effect. Tasks hold some BYTES of
    text at once. At most `most` pairs (their counts 16 bytes each) and one number for each B id are broadcast; the rest
    is joined. Ids and counts are written to folder (below spark.checkpoint.dir by default).
    """
    spark = docs.sparkSession
    folder = folder or C.shared_dir(spark, "align")
    kind = docs.schema[id_col].dataType.simpleString()
    rows = C.pick(docs, _id=id_col, _text=text_col).withColumn("_row", F.monotonically_increasing_id())
    schema = f"_id {kind}, _row long, a binary, b binary, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"
    rows.mapInArrow(encode(a_path, b_path), schema).write.option("compression", "zstd").parquet(f"{folder}/encoded")
    encoded = spark.read.parquet(f"{folder}/encoded")
    counts = encoded.where("pairs is not null").select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("times"))
    counts = saved(counts, folder, "counts")
    b_id = F.col("pair").bitwiseAND(F.lit(0xFFFF))
    highest = counts.groupBy(b_id.alias("b_id")).agg(F.max("times").alias("best"))  # a row for each B id
    top = highest.toArrow()
    best = np.zeros(1 << 16, np.int64)
    best[top.column("b_id").to_numpy()] = top.column("best").to_numpy()
    frequent = counts.where(F.col("times") >= C.frequent_from(counts, "times", most)).toArrow()
    pairs, times = frequent.column("pair").to_numpy(), frequent.column("times").to_numpy()
    order = np.argsort(pairs)
    shared = spark.sparkContext.broadcast((pairs[order], times[order], best))

    found = encoded.where("_row is not null").drop("pairs", "times").mapInArrow(sums(a_path, b_path, shared, groups), f"_id {kind}, _row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, rest array<struct<pair:long,k:long>>, groups string")
    found = saved(found, folder, "sums")
    rare = found.select("_row", F.explode("rest").alias("x")).select("_row", "x.pair", "x.k")
    rare = rare.join(counts, "pair").withColumn("b_id", b_id).join(F.broadcast(highest), "b_id")  # at most 65,536 rows
    rare = rare.groupBy("_row").agg(F.sum(F.when(F.col("times") == F.col("best"), F.col("k")).otherwise(0)).alias("_best"), F.sum(F.col("k") * F.col("times")).alias("_sum"))
    out = found.join(rare, "_row", "left")
    out = out.select(F.col("_id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.coalesce("_best", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("_sum", F.lit(0))).alias("count_sum"), "groups_sha256", "groups")
    return out if groups else out.drop("groups")


def op12_cross_align(spark, sf_dir):
    import public_tokenizers

    return cross_align(C.read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
