"""Best-fit packing of documents into training sequences of several permitted lengths."""

import pyarrow as pa
from pyspark.sql import functions as F

from . import common as C
from .tokens import counter

CAPACITIES = (512, 1024, 2048, 4096)


def cost(capacity, overhead, attention):
    """Of a sequence: its places, what any sequence costs besides, and attention, which grows with the square."""
    return capacity + overhead + capacity * capacity / attention


def opening(capacities, overhead, attention):
    """For each size of a piece, the permitted length of least cost a place that holds it; ties: the shorter."""
    by_price = sorted(capacities, key=lambda c: (cost(c, overhead, attention) / c, c))
    return [next(c for c in by_price if c >= n) for n in range(max(capacities) + 1)]


class Bins:
    """Open bins by the room that is left, so that the tightest that fits is found by one scan of a bit mask."""

    def __init__(self, capacities, overhead, attention):
        self.capacities, self.open = sorted(capacities), opening(capacities, overhead, attention)
        self.room, self.mask, self.used, self.count = {}, 0, {}, 0

    def put(self, size):
        """(bin, offset) of a piece: in the open bin with the least room that holds it, of those the last to
        come to that room, or in a new one."""
        if fitting := self.mask >> size:
            left = size + (fitting & -fitting).bit_length() - 1
            at = self.room[left].pop()
            if not self.room[left]:
                self.mask &= ~(1 << left)
        else:
            at, left = self.count, self.open[size]
            self.count += 1
            self.used[at] = 0
        offset = self.used[at]
        self.used[at] += size
        left -= size
        if left:
            self.room.setdefault(left, []).append(at)
            self.mask |= 1 << left
        return at, offset

    def downsized(self, at):
        """The least permitted length that holds what the bin came to hold."""
        return next(c for c in self.capacities if c >= self.used[at])


def measure(vocabulary, extra):
    def run(batches):
        ids = counter(vocabulary).ids
        for b in C.slices(batches):
            n = [len(ids(x)) + extra if x else extra for x in C.strings(b.column("_text"))]
            yield pa.record_batch([b.column("_id"), pa.array(n, pa.int64())], names=["_id", "n"])

    return run


def fill(capacities, overhead, attention):
    """Pieces sorted by shard, longest first -> their places. A shard's bins are kept until its last piece is placed."""

    def run(batches):
        held, shard, schema = [], None, None

        def close():
            bins = Bins(capacities, overhead, attention)
            at = [bins.put(size) if size else (None, 0) for _, _, _, size in held]
            cols = ([r[0] for r in held], [r[1] for r in held], [r[2] for r in held], [r[3] for r in held], [None if k is None else f"{shard}-{k}" for k, _ in at], [o for _, o in at], [None if k is None else bins.downsized(k) for k, _ in at])
            kinds = (schema.field("_id").type, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            return pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["_id", "piece", "start", "length", "bin", "offset", "capacity"])

        for b in C.slices(batches):
            schema = schema or b.schema
            for s, *row in zip(*(b.column(x).to_pylist() for x in ("shard", "_id", "piece", "start", "length")), strict=True):
                if s != shard and held:
                    yield close()
                    held = []
                shard = s
                held.append(row)
        if held:
            yield close()

    return run


def best_fit(sizes, id_col="doc_id", size_col="n_tokens", capacities=CAPACITIES, overhead=64, attention=32768, shard_pieces=50_000):
    """One row per piece: id, piece, start, length, bin, offset, capacity.

    A document longer than the longest permitted length is cut into pieces of that length and a rest; every place of
    every document is in exactly one piece. Pieces are dealt into shards of about `shard_pieces` by hash, and each
    shard is packed on its own, longest piece first: into the open bin with the least room left that holds it, else
    into a new bin of the length with the least cost a place (`cost`). At the end each bin shrinks to the least
    permitted length that holds its contents. A shard's state is sizes and ids, never texts.

    Null and zero sizes are one piece of length 0 without a bin. Rows that repeat an id are packed as they come; ids
    may be null. Ties go by id, then piece. No rows give no rows.
    """
    most = max(capacities)
    kind = sizes.schema[id_col].dataType.simpleString()
    rows = C.pick(sizes, _id=id_col, n=size_col).withColumn("n", F.greatest(F.coalesce(F.col("n").cast("long"), F.lit(0)), F.lit(0)))
    pieces = F.greatest(F.ceil(F.col("n") / most), F.lit(1))
    rows = rows.select("_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1)).alias("piece"))
    rows = rows.select("_id", "piece", (F.col("piece") * most).alias("start"), F.least(F.lit(most), F.col("n") - F.col("piece") * most).alias("length"))
    shards = max(1, -(-rows.count() // shard_pieces))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("_id", "piece", "length"), F.lit(shards)))
    rows = rows.repartition("shard").sortWithinPartitions("shard", F.desc("length"), "_id", "piece")
    schema = f"_id {kind}, piece long, start long, length long, bin string, offset long, capacity long"
    return rows.mapInArrow(fill(tuple(capacities), overhead, attention), schema).withColumnRenamed("_id", id_col)


def pack_documents(docs, vocabulary=None, id_col="doc_id", text_col="text", end=1, folder=None, **options):
    """best_fit of the token counts of whole texts, and `end` places more for each document's end; null is empty.

    The counts (one short row a document) are written to folder, below spark.checkpoint.dir by default.
    """
    import public_tokenizers

    from .components import saved

    kind = docs.schema[id_col].dataType.simpleString()
    sizes = C.pick(docs, _id=id_col, _text=text_col).mapInArrow(measure(vocabulary or public_tokenizers.path("byte_bpe_50k.json"), end), f"_id {kind}, n long")
    sizes = saved(sizes, folder or C.shared_dir(docs.sparkSession, "packing"), "sizes")
    return best_fit(sizes.select(F.col("_id").alias(id_col), F.col("n").alias("n_tokens")), id_col, **options)


def op8_packing(spark, sf_dir):
    return pack_documents(C.read(spark, sf_dir, "documents"))
