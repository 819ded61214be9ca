"""Near-duplicates by one-permutation MinHash with optimal densification, banded buckets and star-shaped candidates."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from . import common as C
from . import shingles as S
from .components import components, saved

BLOCK = 512  # members of a bucket that are compared at once
SMALL = 16  # buckets up to this size are compared as they are


def sign(k, bins, rows):
    def run(batches):
        table = S.probes(bins)
        for b in C.slices(batches):
            out = []
            for raw in C.raw(b.column("_text")):
                own = S.shingles(raw, k)
                if len(own):
                    signature = S.signature(own, bins, table)
                    out.append((len(own), S.digest(own), S.bands(signature, rows), (S.mix(signature) & np.uint64(0xFF)).astype(np.uint8).tobytes()))
                else:
                    out.append((0, None, None, None))
            kinds = (pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary())
            cols = list(zip(*out, strict=True)) or [()] * 4
            yield pa.record_batch([b.column("_id"), b.column("_row"), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=["_id", "_row", "n", "digest", "bands", "sketch"])

    return run


def confirm(k, percent):
    """Candidate pairs with their texts -> those that the full sets link."""

    def run(batches):
        held = {}

        def own(raw, digest):
            if digest in held:
                return held[digest]
            found = S.shingles(raw, k)
            if S.digest(found) != digest:
                return None
            if len(held) > 256:
                held.clear()
            held[digest] = found
            return found

        for b in C.slices(batches):
            out = []
            rows = zip(b.column("a").to_pylist(), b.column("b").to_pylist(), C.raw(b.column("a_text")), C.raw(b.column("b_text")), b.column("a_digest").to_pylist(), b.column("b_digest").to_pylist(), strict=True)
            for x, y, x_raw, y_raw, x_digest, y_digest in rows:
                # an id may have other texts as well: the digest tells which one was meant
                first, second = own(x_raw, x_digest), own(y_raw, y_digest)
                if first is not None and second is not None and S.linked(first, second, percent):
                    out.append((x, y))
            yield pa.record_batch([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])

    return run


def confirmed(pairs, docs, k, percent):
    """Links among pairs (a, a_digest, b, b_digest). Only texts that may be in a pair are shuffled."""
    ids = pairs.select(F.col("a").alias("x")).unionByName(pairs.select(F.col("b").alias("x")))
    texts = C.maybe_in(docs, F.col("_id"), C.bit_filter(ids), "_in").where("_in").select("_id", "_text")
    rows = pairs.join(texts.select(F.col("_id").alias("a"), F.col("_text").alias("a_text")), "a")
    rows = rows.join(texts.select(F.col("_id").alias("b"), F.col("_text").alias("b_text")), "b")
    return rows.select("a", "b", "a_text", "b_text", "a_digest", "b_digest").mapInArrow(confirm(k, percent), "a long, b long")


def sets_of(k):
    """(digest, set in 32 bits) of texts with their digests."""

    def run(batches):
        for b in C.slices(batches):
            digests, sets = [], []
            for raw, digest in zip(C.raw(b.column("_text")), b.column("digest").to_pylist(), strict=True):
                digests.append(digest)
                sets.append(np.unique((S.shingles(raw, k) >> np.uint64(32)).astype(np.uint32)).tobytes())
            yield pa.record_batch([pa.array(digests, pa.binary()), pa.array(sets, pa.binary())], names=["digest", "own"])

    return run


def spell(k):
    """(digest, shingle) of texts with their digests."""

    def run(batches):
        for b in C.slices(batches):
            own = [S.shingles(raw, k).view(np.int64) for raw in C.raw(b.column("_text"))]
            at = np.repeat(np.arange(len(own)), [len(x) for x in own])
            yield pa.record_batch([b.column("digest").take(pa.array(at)), pa.array(np.concatenate([*own, np.empty(0, np.int64)]))], names=["digest", "shingle"])

    return run


UNIT = ("band", "x", "y", "rep", "digest", "root", "n", "shared", "sketch", "block", "bands", "own")


def together(u, v):
    """Number of hashes in common of two sorted sets."""
    both = np.concatenate([u, v])
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum())


def compare(least, percent):
    """Rows sorted by unit -> candidate pairs. A unit holds one block of a bucket, or two: pairs across components
    whose sketches agree in `least` places.

    shared bounds how many of its n shingles a set can have in common with any other here, and so a pair's similarity.
    Members of large buckets also bring their sets in 32 bits, and all their bands: a pair is looked at in the first
    band that it shares. What the intersection may have lost to equal 32-bit values (at most what the set that lost
    fewer has lost) is added, so that a pair is only ever overrated.
    """

    def pairs(unit):
        rep, root, block, n, shared = (np.array([r[k] for r in unit], np.int64) for k in (3, 5, 9, 6, 7))
        sketch = np.frombuffer(b"".join(r[8] for r in unit), np.uint8).reshape(len(unit), -1)
        large = unit[0][11] is not None
        own = [np.frombuffer(r[11], np.uint32) for r in unit] if large else None
        bands = np.array([r[10] for r in unit], np.int64) if large else None
        for i in range(len(unit) - 1):
            most = np.minimum(shared[i + 1 :], shared[i])
            near = (root[i + 1 :] != root[i]) & (100 * most >= percent * (n[i + 1 :] + n[i] - most))
            if unit[0][1] != unit[0][2]:
                near &= block[i + 1 :] != block[i]
            at = i + 1 + np.flatnonzero(near)
            at = at[(sketch[at] == sketch[i]).sum(axis=1) >= least]
            if large and len(at):
                at = at[bands[i][(bands[at] == bands[i]).argmax(axis=1)] == unit[0][0]]
            for j in at.tolist():
                if large and 100 * (k := together(own[i], own[j]) + min(n[i] - len(own[i]), n[j] - len(own[j]))) < percent * (n[i] + n[j] - k):
                    continue
                u, v = (i, j) if rep[i] <= rep[j] else (j, i)
                yield unit[u][3], unit[u][4], unit[v][3], unit[v][4]

    def told(found):
        kinds = (pa.int64(), pa.binary(), pa.int64(), pa.binary())
        return pa.record_batch([pa.array(c, t) for c, t in zip(list(zip(*found, strict=True)) or [()] * 4, kinds, strict=True)], names=["a", "a_digest", "b", "b_digest"])

    def run(batches):
        unit = []
        for b in C.slices(batches):
            found = []
            for row in zip(*(b.column(x).to_pylist() for x in UNIT), strict=True):
                if unit and row[:3] != unit[0][:3]:
                    found += pairs(unit)
                    unit = []
                unit.append(row)
            yield told(found)
        if unit:
            yield told([*pairs(unit)])

    return run


def near_dedup(docs, id_col="doc_id", text_col="text", words=5, percent=80, bins=128, rows=4, folder=None):
    """One row per input row: id, n_shingles, component_id, kept.

    Documents are linked when 100 * intersection >= percent * union of their sets of distinct `words`-word shingles
    (fewer words are one shingle; none are the empty set, linked with nothing). component_id is the least id that can
    be reached by links, kept tells whether it is the row's own.

    1. One scan signs every whole text. Equal sets become one representative, so copies are never paired.
    2. Each of bins / rows bands puts a representative into a bucket; its star pairs the bucket's least id with the
       others, so a bucket of m proposes m - 1 pairs. Full sets confirm them.
    3. A star can miss a link between two leaves. Where a bucket still spans several components, its members are
       compared across them, in blocks, by sketches of `bins` bytes, and full sets confirm what is left. In buckets of
       more than SMALL, members first drop out whose own shingles (in no other member of such buckets) alone rule out
       any link, and pairs whose sets in 32 bits do. No bucket is capped.
    A link of similarity s is missed only if no band agrees: (1 - s^rows)^(bins/rows), 6e-11 at 0.85 by default.

    Ids must be integers. Null and empty texts have empty sets. Rows with a null id are linked with nothing, have a
    null component_id and are kept. Rows that share an id are one node: links of any of them count for all. No rows give no
    rows. What steps 1 to 3 gather is written to folder (below spark.checkpoint.dir by default).
    """
    spark = docs.sparkSession
    folder = folder or C.shared_dir(spark, "near")
    # rows of one id are told apart by their text
    docs = C.pick(docs, _id=id_col, _text=text_col).withColumn("_id", F.col("_id").cast("long")).withColumn("_row", F.xxhash64(C.whole(F.col("_text"))))
    signed = saved(docs.mapInArrow(sign(words, bins, rows), "_id long, _row long, n long, digest binary, bands array<long>, sketch binary"), folder, "signed")
    reps = signed.where("_id is not null and digest is not null").groupBy("digest").agg(F.min(F.struct("_id", "_row")).alias("least"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    reps = saved(reps.select("digest", F.col("least._id").alias("rep"), F.col("least._row").alias("row"), "n", "bands", "sketch"), folder, "representatives")

    each = reps.select("rep", "digest", F.explode("bands").alias("band"))
    stars = each.groupBy("band").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("rep", "digest")).alias("centre")).where("size > 1")
    members = saved(each.join(stars, "band"), folder, "members")
    pairs = members.where(F.col("digest") != F.col("centre.digest")).select(F.col("centre.rep").alias("a"), F.col("centre.digest").alias("a_digest"), F.col("rep").alias("b"), F.col("digest").alias("b_digest")).distinct()
    pairs = saved(pairs, folder, "star-pairs")
    links = saved(confirmed(pairs, docs, words, percent), folder, "stars")
    roots = components(links, f"{folder}/first")

    rooted = members.join(roots, members.rep == roots.node, "left").select("band", "rep", "digest", F.coalesce("root", "rep").alias("root"))
    mixed = rooted.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("size")).where("low <> high")
    open_ = saved(rooted.join(mixed.select("band", "size"), "band"), folder, "open")
    pairs = saved(left_over(open_, reps, docs, words, percent, bins), folder, "rest-pairs")
    more = saved(confirmed(pairs, docs, words, percent), folder, "rest")
    if not more.isEmpty():
        links = links.unionByName(more)
        roots = components(links, f"{folder}/all")

    same = signed.join(reps.select("digest", "rep"), "digest", "left")
    # rows that share an id are one node, by whichever text it is linked
    own = same.where("_id is not null and rep is not null and rep <> _id").select(F.col("_id").alias("a"), F.col("rep").alias("b"))
    shared = own.join(signed.where("_id is not null").groupBy(F.col("_id").alias("a")).count().where("count > 1"), "a", "left_semi")
    if not shared.isEmpty():
        roots = components(links.unionByName(shared), f"{folder}/shared")
    out = same.join(roots.select(F.col("node").alias("_n1"), F.col("root").alias("_r1")), F.col("rep") == F.col("_n1"), "left")
    component = F.when(F.col("_id").isNotNull(), F.least("_id", F.coalesce("_r1", "rep", "_id")))
    return out.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("_id")).alias("kept"))


def left_over(open_, reps, docs, words, percent, bins):
    """Pairs across components that share a bucket and whose sketches agree far enough."""
    crowd = open_.where(F.col("size") > SMALL).select("rep", "digest").distinct()
    crowd = crowd.join(reps.select("digest", "row"), "digest")
    texts = C.maybe_in(docs, F.col("_id"), C.bit_filter(crowd.select("rep")), "_in").where("_in").select("_id", "_row", "_text").dropDuplicates(["_id", "_row"])
    texts = texts.join(crowd, (F.col("_id") == F.col("rep")) & (F.col("_row") == F.col("row"))).select("_text", "digest")
    spelled = texts.mapInArrow(spell(words), "digest binary, shingle long")
    alone = spelled.groupBy("shingle").agg(F.count(F.lit(1)).alias("c"), F.min("digest").alias("digest")).where("c = 1").groupBy("digest").agg(F.count(F.lit(1)).alias("mine"))
    sized = open_.join(reps.select("digest", "n", "sketch", "bands"), "digest")
    big = sized.where(F.col("size") > SMALL).join(alone, "digest", "left").withColumn("shared", F.col("n") - F.coalesce("mine", F.lit(0)))
    big = big.where(100 * F.col("shared") >= percent * F.col("n")).join(texts.mapInArrow(sets_of(words), "digest binary, own binary").dropDuplicates(["digest"]), "digest").drop("mine")
    small = sized.where(F.col("size") <= SMALL).withColumn("shared", F.col("n")).withColumn("bands", F.lit(None).cast("array<long>")).withColumn("own", F.lit(None).cast("binary"))
    left = small.unionByName(big)
    # once more: what is left of a bucket may be of one component
    mixed = left.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("now")).where("low <> high")
    left = left.join(mixed.select("band", "now"), "band")
    blocks = F.ceil(F.col("now") / BLOCK).cast("int")
    left = left.withColumn("block", F.pmod(F.xxhash64("rep"), blocks).cast("int"))
    units = left.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumn("x", F.least("block", "other")).withColumn("y", F.greatest("block", "other"))
    # far below what linked sets agree in: 7 standard deviations
    least = max(1, int(bins * (percent / 100) - 7 * (bins * percent / 100 * (1 - percent / 100)) ** 0.5))
    units = units.select(*UNIT).repartition("band", "x", "y").sortWithinPartitions("band", "x", "y")
    return units.mapInArrow(compare(least, percent), "a long, a_digest binary, b long, b_digest binary").distinct()


def op9_near_dedup(spark, sf_dir):
    return near_dedup(C.read(spark, sf_dir, "documents"), words=3, percent=85)


OP9_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS g FROM d),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k, any_value(a.n) AS na, any_value(b.n) AS nb FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * k >= 85 * (na + nb - k)),
u AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach(id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.id, u.b FROM reach r JOIN u ON u.a = r.other),
c AS (SELECT id AS doc_id, min(other) AS component_id FROM reach GROUP BY id)
SELECT doc_id, len(g)::BIGINT AS n_shingles, component_id, component_id = doc_id AS kept FROM s JOIN c USING (doc_id)
"""
