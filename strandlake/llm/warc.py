"""WARC archives with a two-level capture index.

Archives are gzip members, one a record. The index holds one JSON line a capture, `key page_id {...}`, sorted by the
URL's reversed-host key, in compressed blocks of some thousand lines; a sparse directory keeps each block's first and
last key and its place, sorted by key. A look-up binary-searches the directory, reads one block by range, then the record
by range. Reading everything back deals the directory's blocks over tasks instead, so that a key that very many captures
share is spread.
"""

import base64
import gzip
import hashlib
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C
from .components import saved

CAPTURES = "key string, page_id long, file string, offset long, length long, record_type string, refers_to long"
DIRECTORY = "file string, block long, first_key string, last_key string, offset long, length long, n long"
RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
SAFE = ":/?#[]@!$&()*+,;=%~"  # stay as they are in a Target-URI
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


@F.arrow_udf(T.BinaryType())
def sha1(text: pa.Array) -> pa.Array:
    return pa.array([hashlib.sha1(x).digest() for x in C.raw(text)], pa.binary())


def reversed_host(url):
    """com,example,blog)/path?query of a URL, in lower case up to the path; '' for none."""
    try:
        parts = urlsplit(url or "")
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return f"){url}"
    if not host:
        return f"){url}" if url else ""
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "")
    return f"{key}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def record(page_id, url, payload, digest, refers_to, date, place):
    """One WARC/1.1 record: response with its payload, or revisit of the response of page refers_to without.

    place (file and offset) makes its record id. Page ids are in fields of our own; a null URL is told by urn:page:.
    """
    block = b"" if refers_to is not None else HTTP % len(payload) + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, place)}>", f"WARC-Date: {date}", f"Page-ID: {'' if page_id is None else page_id}",
        f"WARC-Target-URI: {f'urn:page:{page_id}' if url is None else quote(url, safe=SAFE)}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}", f"Content-Length: {len(block)}",
    ]
    if refers_to is None:
        head.append("Content-Type: application/http; msgtype=response")
    else:
        head += [f"Refers-To-Page-ID: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 1, mtime=0)


def parse(member):
    """(page_id, url, record_type, payload or None, digest in base32, refers_to) of a record's gzip member."""
    head, _, rest = zlib.decompress(member, 31).partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    number = lambda x: int(x) if x else None
    url = fields["WARC-Target-URI"]
    revisit = fields["WARC-Type"] == "revisit"
    payload = None if revisit else rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")[2]
    return number(fields["Page-ID"]), None if url.startswith("urn:page:") else url, fields["WARC-Type"], payload, fields["WARC-Payload-Digest"][5:], number(fields["Refers-To-Page-ID"]) if revisit else None


def write_archives(folder, date):
    def run(batches):
        task = TaskContext.get()
        store, base = fs.FileSystem.from_uri(folder)
        # another attempt at the task writes another file; only those that the index names are ever read
        name, out, offset = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz", None, 0
        try:
            for b in batches:
                if out is None:
                    store.create_dir(base, recursive=True)
                    out = store.open_output_stream(f"{base}/{name}", compression=None, buffer_size=1 << 20)
                rows = []
                cols = (b.column(x).to_pylist() for x in ("_id", "_url", "_digest", "_refers"))
                for page_id, url, digest, refers, payload in zip(*cols, C.raw(b.column("_html")), strict=True):
                    member = record(page_id, url, payload, digest, refers, date, f"{name}:{offset}")
                    out.write(member)
                    rows.append((reversed_host(url), page_id, name, offset, len(member), "response" if refers is None else "revisit", refers))
                    offset += len(member)
                kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64())
                got = list(zip(*rows, strict=True)) or [()] * 7
                yield pa.record_batch([pa.array(c, t) for c, t in zip(got, kinds, strict=True)], names=["key", "page_id", "file", "offset", "length", "record_type", "refers_to"])
        finally:
            if out is not None:
                out.close()

    return run


def write_blocks(folder, lines):
    def run(batches):
        task = TaskContext.get()
        store, base = fs.FileSystem.from_uri(folder)
        name, out, offset, block, held = f"index-{task.partitionId():06d}-{task.taskAttemptId()}.gz", None, 0, 0, []

        def flush():
            nonlocal offset, block, held
            data = gzip.compress("".join(f"{json.dumps(x)}\n" for x in held).encode(), mtime=0)
            out.write(data)
            row = (name, block, held[0][0], held[-1][0], offset, len(data), len(held))
            offset, block, held = offset + len(data), block + 1, []
            return row

        def told(rows):
            kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["file", "block", "first_key", "last_key", "offset", "length", "n"])

        try:
            for b in batches:
                if out is None:
                    store.create_dir(base, recursive=True)
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    held.append(row)
                    if len(held) == lines:
                        yield told([flush()])
            if held:
                yield told([flush()])
        finally:
            if out is not None:
                out.close()

    return run


def write_warc(pages, folder, id_col="page_id", url_col="url", html_col="html", least_bytes=0, lines=1000, date="1970-01-01T00:00:00Z"):
    """Writes a record for every row, and the two-level index; returns folder.

    Of rows with equal payloads of at least least_bytes bytes, those with the smallest id are responses and the others
    revisit it; smaller payloads are all responses. The payload is the html in UTF-8; null counts as empty.
    A null id is larger than any other; if all ids of a group are null, all are responses. Rows that repeat an id and a
    payload are all responses or all revisits. A null URL has a Target-URI of urn:page: and the key ''. Columns besides the
    three don't matter. No rows give no archive.
    Folder: archives in archive, index blocks in index, the sparse directory as a Parquet table in directory.
    """
    rows = C.pick(pages, _id=id_col, _url=url_col, _html=html_col).withColumn("_id", F.col("_id").cast("long")).withColumn("_digest", sha1("_html"))
    groups = rows.where(F.coalesce(F.octet_length("_html"), F.lit(0)) >= least_bytes).groupBy(F.col("_digest").alias("_group")).agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    # stored, so that Spark knows their size: few are broadcast; else a very common page is a skewed key that it splits
    groups = saved(groups.where("_n > 1").drop("_n"), folder, "groups")
    rows = rows.join(groups, F.col("_digest") == F.col("_group"), "left").withColumn("_refers", F.when(~F.col("_id").eqNullSafe(F.col("_first")), F.col("_first")))
    captures = rows.mapInArrow(write_archives(f"{folder}/archive", date), CAPTURES)
    captures.write.parquet(f"{folder}/captures")  # the files are written once, whatever is read of their places
    order = ["key", F.col("page_id").asc_nulls_first(), "file", "offset"]
    captures = pages.sparkSession.read.parquet(f"{folder}/captures").repartitionByRange(*order).sortWithinPartitions(*order)
    captures.mapInArrow(write_blocks(f"{folder}/index", lines), DIRECTORY).write.parquet(f"{folder}/directory")
    return folder


def read_block(store, base, file, offset, length):
    with store.open_input_file(f"{base}/{file}") as f:
        return [json.loads(x) for x in gzip.decompress(f.read_at(length, offset)).decode().splitlines()]


def expand_blocks(folder):
    def run(batches):
        store, base = fs.FileSystem.from_uri(folder)
        for b in batches:
            for file, offset, length in zip(*(b.column(x).to_pylist() for x in ("file", "offset", "length")), strict=True):
                got = zip(*read_block(store, base, file, offset, length), strict=True)
                kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(got, kinds, strict=True)], names=["key", "page_id", "file", "offset", "length", "record_type", "refers_to"])

    return run


def read_members(folder, with_payload, gap=1 << 16, most=8 << 20):
    """Records by range; ranges of a file that lie close together are read at once."""

    def spans(places):
        held = []
        for file, offset, length in places:
            if held and (file != held[0][0] or offset > held[-1][1] + held[-1][2] + gap or offset + length - held[0][1] > most):
                yield held
                held = []
            held.append((file, offset, length))
        if held:
            yield held

    def run(batches):
        store, base = fs.FileSystem.from_uri(folder)
        for b in batches:
            places = zip(*(b.column(x).to_pylist() for x in ("file", "offset", "length")), strict=True)
            for held in spans(places):
                rows = []
                with store.open_input_file(f"{base}/{held[0][0]}") as f:
                    first, last = held[0][1], held[-1][1] + held[-1][2]
                    data = f.read_at(last - first, first)
                for _, offset, length in held:
                    page_id, url, kind, payload, digest, refers = parse(data[offset - first : offset - first + length])
                    if payload is not None and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise ValueError(f"payload of page {page_id} doesn't match its digest")
                    rows.append((page_id, url, kind, None if payload is None else len(payload), digest, refers, payload if with_payload else None))
                kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"])

    return run


def read_warc(spark, folder, with_payload=True):
    """Every record, by way of the index; payload and payload_bytes are null for revisits.

    Index blocks are spread over the tasks, their captures dealt by archive and place, so that reads run forward.
    """
    blocks = spark.read.parquet(f"{folder}/directory").repartition("file", "block")
    captures = blocks.mapInArrow(expand_blocks(f"{folder}/index"), CAPTURES)
    places = captures.repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    return places.mapInArrow(read_members(f"{folder}/archive", with_payload), RECORDS)


def blocks_of(directory, keys):
    """{row: [key]} of a batch of the directory: blocks that may hold a key, by binary search in each index file's rows."""
    file, first, last = (directory.column(x) for x in ("file", "first_key", "last_key"))
    names = file.to_pylist()
    edges = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
    out = {}
    for start, end in zip(edges, edges[1:], strict=False):
        for k in keys:
            at = bisect_left(range(end), k, lo=start, key=lambda i: last[i].as_py())
            while at < end and first[at].as_py() <= k:  # a key may fill several blocks
                out.setdefault(at, []).append(k)
                at += 1
    return out


def find(spark, folder, urls):
    """Records of the given URLs (a list, of at most some thousands): directory, block, record, each by range.

    The scan of the directory skips row groups outside the keys' range; the rest of it is binary-searched for each key,
    and only blocks that may hold one are read.
    """
    keys = sorted({reversed_host(u) for u in urls})
    if not keys:
        return spark.createDataFrame([], RECORDS)
    directory = spark.read.parquet(f"{folder}/directory").where((F.col("first_key") <= keys[-1]) & (F.col("last_key") >= keys[0]))

    def search(batches):
        store, base = fs.FileSystem.from_uri(f"{folder}/index")
        for b in batches:
            for at, wanted in blocks_of(b, keys).items():
                lines = read_block(store, base, *(b.column(x)[at].as_py() for x in ("file", "offset", "length")))
                own = [x[0] for x in lines]
                got = [x for k in wanted for x in lines[bisect_left(own, k) : bisect_right(own, k)]]
                if got:
                    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64())
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*got, strict=True), kinds, strict=True)], names=["key", "page_id", "file", "offset", "length", "record_type", "refers_to"])

    return directory.mapInArrow(search, CAPTURES).mapInArrow(read_members(f"{folder}/archive", True), RECORDS)


def op10_warc(spark, sf_dir):
    folder = C.shared_dir(spark, "warc")
    write_warc(C.read(spark, sf_dir, "pages"), folder)
    records = saved(read_warc(spark, folder, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), folder, "read")
    first = records.where("record_type = 'response'").select(F.col("page_id").alias("_page"), F.col("payload_bytes").alias("_bytes"))
    first = first.join(records.where("record_type = 'revisit'").select(F.col("refers_to").alias("_page")).distinct(), "_page", "left_semi").groupBy("_page").agg(F.max("_bytes").alias("_bytes"))
    first = saved(first, folder, "referred")
    # a revisit has the payload of the response that it refers to
    return records.join(first, records.refers_to == first._page, "left").select("page_id", F.coalesce("payload_bytes", "_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


OP10_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
g AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS hex, min(page_id) OVER (PARTITION BY b) AS first FROM p),
d AS (SELECT page_id, payload_bytes, first, list_reduce(list_transform(range(1, 41), lambda i: printf('%04b', strpos('0123456789abcdef', hex[i:i]) - 1)), lambda x, y: x || y) AS z FROM g)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda k: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + list_sum(list_transform(range(0, 5), lambda j: z[5 * k + j + 1:5 * k + j + 1]::INT * (16 >> j)))::INT]), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to FROM d
"""
