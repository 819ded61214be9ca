"""Token ids in length-delimited binary records with masked checksums, and a separate offset index.

A file is a row of records, each: length of the payload (u64), masked checksum of those 8 bytes (u32), payload, masked
checksum of the payload (u32); little-endian. The payload: width of an id in bytes (u8, 2 or 4), whether there is a
document id (u8), the document id (i64), then the token ids. A checksum is CRC-32, rotated right by 15 bits plus
0xA282EAD8, so that checksums of data that hold checksums stay sound. The index is a Parquet table of
(file, doc_id, offset, length, n_tokens), one row a record, so that a shuffled reader can seek to any of them.
"""

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import functions as F

from . import common as C
from .tokens import encoder

HEAD, MARK, META = struct.Struct("<QI"), struct.Struct("<I"), struct.Struct("<BBq")
INDEX = "file string, first boolean, doc_id long, offset long, length long, n_tokens long"
#: Bytes of text that a task encodes at once: more repeat more of their words, but take more memory.
AT_ONCE = 8 << 20
READ = "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<int>"


def masked(data):
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload):
    size = struct.pack("<Q", len(payload))
    return b"".join((size, MARK.pack(masked(size)), payload, MARK.pack(masked(payload))))


def pack(doc_id, ids, width):
    return META.pack(width, doc_id is not None, doc_id or 0) + ids


def unpack(payload):
    width, known, doc_id = META.unpack_from(payload)
    return (doc_id if known else None), np.frombuffer(payload, f"<u{width}", offset=META.size)


def read_frame(stream):
    """The next payload, None at the end; a broken record raises ValueError."""
    head = stream.read(HEAD.size)
    if not head:
        return None
    if len(head) < HEAD.size:
        raise ValueError("record cut off")
    size, crc = HEAD.unpack(head)
    if masked(head[:8]) != crc:
        raise ValueError("length doesn't match its checksum")
    payload = stream.read(size)
    end = stream.read(MARK.size)
    if len(payload) < size or len(end) < MARK.size or MARK.unpack(end)[0] != masked(payload):
        raise ValueError("record doesn't match its checksum")
    return payload


def write_files(folder, vocabulary, end_id):
    def run(batches):
        task = TaskContext.get()
        store, base = fs.FileSystem.from_uri(folder)
        # another attempt at the task writes another file; only those that the index names are ever read
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.rec"
        out, offset, encode = None, 0, encoder(vocabulary)
        end = np.array([end_id], encode.kind).tobytes()
        try:
            for b in C.slices(batches, AT_ONCE):
                if out is None:
                    store.create_dir(base, recursive=True)
                    out = store.open_output_stream(f"{base}/{name}", compression=None, buffer_size=1 << 20)
                rows = []
                for doc_id, ids in zip(b.column("_id").to_pylist(), encode.encode_all(b.column("_text")), strict=True):
                    ids += end
                    record = frame(pack(doc_id, ids, encode.kind.itemsize))
                    out.write(record)
                    rows.append((name, offset == 0, doc_id, offset, len(record), len(ids) // encode.kind.itemsize))
                    offset += len(record)
                kinds = (pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                cols = list(zip(*rows, strict=True)) or [()] * 6
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["file", "first", "doc_id", "offset", "length", "n_tokens"])
        finally:
            if out is not None:
                out.close()

    return run


def write_records(docs, folder, vocabulary, id_col="doc_id", text_col="text", end_id=0):
    """Writes the token ids of every whole text, and end_id after each, in ascending order of id; returns folder.

    Files are in folder/records, the index in folder/index. Files don't overlap in id: rows are dealt by ranges of id
    and sorted in each. Null text counts as empty: its record holds only end_id. Null ids come first; rows that repeat
    an id are ordered by text. Ids must be integers. No rows give an empty index and no file.
    """
    rows = C.pick(docs, _id=id_col, _text=text_col).withColumn("_id", F.col("_id").cast("long"))
    rows = rows.repartitionByRange(F.col("_id").asc_nulls_first()).sortWithinPartitions(F.col("_id").asc_nulls_first(), F.col("_text").asc_nulls_first())
    rows.mapInArrow(write_files(f"{folder}/records", vocabulary, end_id), INDEX).write.parquet(f"{folder}/index")
    return folder


def read_files(folder, with_ids):
    def run(batches):
        store, base = fs.FileSystem.from_uri(folder)
        for b in batches:
            for name, start in zip(b.column("file").to_pylist(), b.column("start").to_pylist(), strict=True):
                with store.open_input_stream(f"{base}/{name}", compression=None, buffer_size=1 << 20) as stream:
                    rows, held, more = [], 0, True
                    while more:
                        if more := (payload := read_frame(stream)) is not None:
                            doc_id, ids = unpack(payload)
                            rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), ids.astype(np.int32) if with_ids else None))
                            start += len(ids)
                            held += len(ids)
                        if rows and (held > 4_000_000 or not more):
                            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
                            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])
                            rows, held = [], 0

    return run


def read_records(spark, folder, with_ids=True):
    """doc_id, start, n_tokens, ids_crc32, ids of every record; start counts the ids before it in ascending order of id.

    One task reads one file at a time, front to back. What passes the driver is one row for each file.
    """
    index = spark.read.parquet(f"{folder}/index")
    files = index.groupBy("file").agg(F.sum("n_tokens").alias("n"), F.min(F.when(F.col("first"), F.struct(F.col("doc_id").isNotNull().alias("a"), "doc_id"))).alias("at"))
    start, todo = 0, []
    for r in files.orderBy("at").collect():
        todo.append((r["file"], start))
        start += r["n"]
    if not todo:
        return spark.createDataFrame([], READ)
    todo = spark.createDataFrame(todo, "file string, start long").repartition(len(todo))
    return todo.mapInArrow(read_files(f"{folder}/records", with_ids), READ)


def read_at(folder, file, offset):
    """(doc id, token ids) of one record, by its place in the index."""
    store, base = fs.FileSystem.from_uri(f"{folder}/records")
    with store.open_input_file(f"{base}/{file}") as f:
        f.seek(offset)
        return unpack(read_frame(f))


def op2_token_records(spark, sf_dir, vocabulary=None):
    import public_tokenizers

    folder = C.shared_dir(spark, "token-records")
    write_records(C.read(spark, sf_dir, "documents"), folder, vocabulary or public_tokenizers.path("byte_bpe_50k.json"))
    return read_records(spark, folder, with_ids=False).drop("ids")
