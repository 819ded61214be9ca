"""Merkle manifest of a data set: incremental witnesses by streaming aligned append.

The leaves of a tree come in order. An Appender keeps one open subtree a level; a node that joins it starts with the
witness of its elder siblings, and extends theirs by itself. A full run of `arity` nodes closes: its hash is appended
one level up. Leaves are dealt over tasks in aligned blocks of arity**height of them, so that no run is cut; each task
appends its blocks leaf by leaf, and the roots of the blocks are further appends, in blocks again, until one is left.
Witnesses come down the same way: what a block's root gathered above is handed to its nodes.
"""

import hashlib
from itertools import chain

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C
from .components import saved

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def joined(nodes):
    """H of nodes in a row; digests are lowercase hex."""
    return hashlib.sha256(b"".join(nodes)).hexdigest().encode()


class Appender:
    """A subtree that grows by appended nodes.

    open[k] holds level k's open run: its nodes, their witnesses of that level (elder siblings and, as they come, later
    ones) and, for each node above level 0, the members that it closed over. close() ends short runs up to `height`
    levels, or up to the one node that is left if the subtree is the whole tree.
    """

    def __init__(self, arity):
        self.arity, self.open = arity, []

    def append(self, node, member, level=0):
        """member: what is handed back with its steps, at level 0; above, the closed run below."""
        if level == len(self.open):
            self.open.append(([], [], []))
        nodes, witness, members = self.open[level]
        for w in witness:
            w.append(node)
        witness.append(list(nodes))
        nodes.append(node)
        members.append(member)
        if len(nodes) == self.arity:
            self.close_run(level)

    def close_run(self, level):
        nodes, witness, members = self.open[level]
        self.open[level] = ([], [], [])
        self.append(joined(nodes), list(zip(witness, members, strict=True)), level + 1)

    def close(self, height, whole):
        """(root, [(member, steps)]); a step is (place among its siblings, their joined digests), level by level."""
        level = 0
        while level < len(self.open) if whole else level < height:
            above = any(x[0] for x in self.open[level + 1 :])
            nodes = self.open[level][0] if level < len(self.open) else []
            if whole and len(nodes) == 1 and not above:
                break
            if nodes:
                self.close_run(level)
            level += 1
        (root,), _, (member,) = self.open[level]
        return root, [*self.unfolded(member, level, ())]

    def unfolded(self, member, level, above):
        if not level:
            yield member, above
            return
        for i, (witness, below) in enumerate(member):
            yield from self.unfolded(below, level - 1, ((i, b"".join(witness)), *above))


def folded(node, steps):
    """The root that a node and its siblings come to."""
    for i, others in steps:
        node = joined((others[: 64 * i], node, others[64 * i :]))
    return node


STEPS = pa.list_(pa.struct([("i", pa.int32()), ("others", pa.binary())]))


def runs(batches, columns):
    """Rows of sorted batches by (tree, block): lists of tuples, one for each block."""
    key, rows = None, []
    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in ("tree", "block", *columns)), strict=True):
            if row[:2] != key:
                if rows:
                    yield key, rows
                key, rows = row[:2], []
            rows.append(row[2:])
    if rows:
        yield key, rows


def roots(arity, height):
    """Sorted nodes -> the root of each block."""

    def run(batches):
        out = []
        for (tree, block), rows in runs(batches, ("digest", "n")):
            top = Appender(arity)
            for digest, _ in rows:
                top.append(digest, None)
            n = rows[0][1]
            out.append((tree, block, top.close(height, n <= arity**height)[0], -(-n // arity**height)))
            if len(out) >= 1000:
                yield told(out)
                out = []
        yield told(out)

    def told(out):
        cols = list(zip(*out, strict=True)) or [()] * 4
        return pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.binary(), pa.int64()), strict=True)], names=["tree", "rank", "digest", "n"])

    return run


def witnesses(arity, height, told):
    """Sorted nodes of blocks, each block led by the row (rank -1) with its root's steps -> told() of their steps."""

    def run(batches):
        first = next(batches, None)
        if first is None:
            return
        kind = first.schema.field("id").type
        for (tree, _), rows in runs(chain([first], batches), ("rank", "digest", "n", "steps", "other", "top", "id")):
            top = Appender(arity)
            for row in rows[1:]:
                top.append(row[1], row)
            _, _, n, steps, _, root, _ = rows[0]
            above = tuple((s["i"], s["others"]) for s in steps or ())
            yield told(tree, root, [(row, own + above) for row, own in top.close(height, n <= arity**height)[1]], kind)

    return run


def below_steps(tree, root, found, _):
    """Steps of nodes that are block roots themselves."""
    rows = [(tree, row[0], [{"i": i, "others": o} for i, o in steps], root) for row, steps in found]
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), STEPS, pa.binary()), strict=True)], names=["tree", "rank", "steps", "top"])


def proofs(tree, root, found, kind):
    """Proof and folded root of leaves; steps end with those from the tree's root to the root of all."""
    rows = []
    for (_, digest, _, _, other, _, own), steps in found:
        proof = hashlib.sha256(b"".join(o for _, o in steps)).hexdigest()
        rows.append((own, digest.decode(), proof, folded(other or digest, steps).decode(), root.decode()))
    ids, *rest = zip(*rows, strict=True)
    return pa.record_batch([pa.array(ids, kind), *(pa.array(c, pa.string()) for c in rest)], names=["id", "leaf", "proof_sha256", "folded_root", "subroot"])


def ranked(df, order):
    """df with rank, its place in its tree by `order`, and n, the size of the tree.

    Rows are dealt by ranges of (tree, order), so that one tree may fill many tasks; ranks are places in a task, moved
    by what earlier tasks hold of the tree. df should be a stored table, as ranges are found by a sample of it.
    """
    placed = df.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    return placed.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33))


def with_ranks(placed):
    """What ranked() gives, once it is stored: placed rows -> rows with rank and n."""
    parts = placed.groupBy("tree", "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_from"))
    whole = Window.partitionBy("tree")
    before = F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("tree", "_part", "_from", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("n"))
    return placed.join(parts, ["tree", "_part"]).withColumn("rank", F.col("_at") - F.col("_from") + F.col("_before")).drop("_at", "_part", "_from", "_before")


def levels(nodes, folder, name, arity, height):
    """Nodes (tree, rank, digest, n), the roots of their blocks, theirs, and so on until each tree has one."""
    out, block = [nodes], arity**height
    while (nodes.agg(F.max("n")).first()[0] or 0) > 1:
        dealt = nodes.withColumn("block", F.expr(f"rank div {block}")).select("tree", "block", "rank", "digest", "n").repartition("tree", "block").sortWithinPartitions("tree", "block", "rank")
        nodes = saved(dealt.mapInArrow(roots(arity, height), "tree string, rank long, digest binary, n long"), folder, f"{name}-{len(out)}")
        out.append(nodes)
    return out


def handed_down(nodes, above, arity, height, told, schema):
    """above: (tree, rank, steps, top) of the roots of nodes' blocks."""
    block = arity**height
    own = nodes.select("tree", F.expr(f"rank div {block}").alias("block"), "rank", "digest", "n", F.lit(None).cast("array<struct<i:int,others:binary>>").alias("steps"), *(F.col(c) if c in nodes.columns else F.lit(None).cast("binary").alias(c) for c in ("other", "top")), F.col("id") if "id" in nodes.columns else F.lit(None).cast("long").alias("id"))
    sizes = nodes.where(f"rank % {block} = 0").select("tree", F.expr(f"rank div {block}").alias("block"), "n")
    lead = sizes.join(above.select("tree", F.col("rank").alias("block"), "steps", "top"), ["tree", "block"])
    kind = own.schema["id"].dataType
    lead = lead.select("tree", "block", F.lit(-1).cast("long").alias("rank"), F.lit(None).cast("binary").alias("digest"), "n", "steps", F.lit(None).cast("binary").alias("other"), "top", F.lit(None).cast(kind).alias("id"))
    return own.unionByName(lead).repartition("tree", "block").sortWithinPartitions("tree", "block", "rank").mapInArrow(witnesses(arity, height, told), schema)


def leaf(fields, changed=None):
    """H over fields, each `-` if null, else its UTF-8 byte count, a colon and its value; changed: new columns by name."""
    parts = []
    for f in fields:
        value = (changed or {}).get(f, F.col(f"_{f}")).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256).cast("binary")


def manifest(docs, fields=FIELDS, id_col="doc_id", tree_col="source", text_col="text", tampered=None, arity=16, height=3, folder=None):
    """One row per input row: id, leaf, subroot (of its tree), root, proof_sha256, folded_root, verified.

    Leaves are H (lowercase hex of sha256) of the fields. In each tree they ascend by id; every `arity` nodes in a row,
    the last run may be shorter, become their H, until one is left: the subroot. Subroots, ordered by tree, null first,
    likewise give root. proof_sha256 is H of the siblings of all levels up to root. tampered (a boolean column of docs)
    tells whose leaf is folded with A-Z of the text in lower case, else folded_root comes from the leaf itself.

    A null field is `-` in the leaf; null ids come first in their tree, null trees are one tree. Rows that repeat an id
    are leaves of their own, ordered by leaf; equal rows are neighbours. No rows give no rows. Other columns of docs
    are of no effect, whatever their names. A tree may hold all rows: its leaves are dealt by ranges, and no task holds
    more than a block of arity**height of them. Tables of all levels are written to folder (below spark.checkpoint.dir by default).
    """
    spark = docs.sparkSession
    folder = folder or C.shared_dir(spark, "merkle")
    lower = {text_col: C.ascii_lower(F.col(f"_{text_col}"))}
    tampered = F.lit(False) if tampered is None else F.coalesce(tampered, F.lit(False))
    rows = docs.select(*(F.col(f"`{c}`").alias(f"_{c}") for c in dict.fromkeys([*fields, id_col, tree_col, text_col])), tampered.alias("_tampered"))
    tree = F.coalesce(F.concat(F.lit("="), F.col(f"_{tree_col}").cast("string")), F.lit(""))  # "" is null's
    leaves = rows.select(tree.alias("tree"), F.col(f"_{id_col}").alias("id"), leaf(fields).alias("digest"), F.when(F.col("_tampered"), leaf(fields, lower)).alias("other"), F.monotonically_increasing_id().alias("row"))
    leaves = saved(leaves, folder, "leaves")
    leaves = saved(with_ranks(saved(ranked(leaves, ("id", "digest", "row")), folder, "ranges")), folder, "ranked")

    trees = levels(leaves, folder, "tree", arity, height)
    subroots = saved(ranked(trees[-1].where("n = 1").select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), ("name",)), folder, "subroots")
    subroots = saved(with_ranks(subroots), folder, "subroots-ranked")
    tops = levels(subroots, folder, "top", arity, height)

    schema = "tree string, rank long, steps array<struct<i:int,others:binary>>, top binary"
    none = F.array().cast("array<struct<i:int,others:binary>>")
    above = tops[-1].select("tree", "rank", none.alias("steps"), F.col("digest").alias("top"))
    for nodes in tops[-2::-1]:
        above = handed_down(nodes, above, arity, height, below_steps, schema)
    above = saved(above, folder, "top-steps")
    root = (above.select("top").first() or [b""])[0].decode()
    above = subroots.join(above.drop("tree"), "rank").select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("rank"), "steps", F.col("digest").alias("top"))
    for nodes in trees[:0:-1]:
        if nodes is not trees[-1]:
            above = saved(handed_down(nodes, above, arity, height, below_steps, schema), folder, f"steps-{trees.index(nodes)}")
    schema = f"id {leaves.schema['id'].dataType.simpleString()}, leaf string, proof_sha256 string, folded_root string, subroot string"
    found = handed_down(leaves, above, arity, height, proofs, schema)
    return found.select(F.col("id").alias(id_col), "leaf", "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))


def op13_merkle(spark, sf_dir):
    docs = C.read(spark, sf_dir, "documents")
    return manifest(docs, tampered=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)


OP13_SQL = """
WITH RECURSIVE f AS (SELECT *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
 coalesce('=' || source, '') AS tree, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
 xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, x: list_reduce(list_prepend(xor(c, x), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295) AS crc FROM documents),
l AS (SELECT doc_id, tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(low) || ':' || low, '-')) AS low_leaf, crc % 5 = 0 AS bad, row_number() OVER (PARTITION BY tree ORDER BY doc_id) - 1 AS rank, count(*) OVER (PARTITION BY tree) AS n FROM f),
a AS (SELECT tree, 0 AS level, rank, n, leaf AS digest FROM l UNION ALL SELECT tree, level + 1, rank // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY rank)) FROM a WHERE n > 1 GROUP BY tree, level, rank // 16, n),
s AS (SELECT tree, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS trees FROM a WHERE n = 1),
b AS (SELECT 0 AS level, place AS rank, trees AS n, subroot AS digest FROM s UNION ALL SELECT level + 1, rank // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY rank)) FROM b WHERE n > 1 GROUP BY level, rank // 16, n),
ga AS (SELECT tree, level, rank // 16 AS run, list(digest ORDER BY rank) AS nodes FROM a WHERE n > 1 GROUP BY ALL),
gb AS (SELECT level, rank // 16 AS run, list(digest ORDER BY rank) AS nodes FROM b WHERE n > 1 GROUP BY ALL),
st AS (SELECT doc_id, level, nodes, (l.rank // (16 ** level)::BIGINT) % 16 AS i FROM l JOIN ga ON ga.tree = l.tree AND run = l.rank // (16 ** (level + 1))::BIGINT
 UNION ALL SELECT doc_id, 100 + level, nodes, (place // (16 ** level)::BIGINT) % 16 FROM l JOIN s USING (tree) JOIN gb ON run = place // (16 ** (level + 1))::BIGINT),
p AS (SELECT doc_id, list({'l': array_to_string(nodes[1:i], ''), 'r': array_to_string(nodes[i + 2:], '')} ORDER BY level) AS steps FROM st GROUP BY doc_id),
w AS (SELECT doc_id, leaf, low_leaf, bad, tree, coalesce(steps, []) AS steps FROM l LEFT JOIN p USING (doc_id)),
r AS (SELECT doc_id, 0 AS k, CASE WHEN bad THEN low_leaf ELSE leaf END AS node, steps FROM w UNION ALL SELECT doc_id, k + 1, sha256(steps[k + 1].l || node || steps[k + 1].r), steps FROM r WHERE k < len(steps)),
t AS (SELECT digest AS root FROM b WHERE n = 1)
SELECT w.doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(w.steps, lambda x: x.l || x.r), '')) AS proof_sha256, node AS folded_root, node = root AS verified
FROM w JOIN s USING (tree) JOIN r ON r.doc_id = w.doc_id AND r.k = len(w.steps) CROSS JOIN t
"""
