"""Comparing and clustering motifs: id, logs (rows of centred log weights), all of one width."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..session import saved, shared_dir

BLOCK, DEALT, STRIP = 8192, 16, 512  # most motifs of a block; blocks that few motifs are dealt into, for tasks; rows compared at once
PORTION = 1 << 14  # pairs whose exact similarity is taken at once


def similarity(a, b, width, offsets=(-2, -1, 0, 1), overlap=6, match=0.85, paired=False):
    """(r, offset) for each pair of flat motifs: uncentred correlation over the overlap at the best offset.

    An offset is out if the products of the first four, or any more, columns sum below 0. Below `match` the best is the
    largest r, above it the largest r + (1 - r) / 2 * (1 - 6 / n) of n columns; ties: the first offset. No offset: r = -2.
    paired: each row of a with the same row of b only.
    """
    shape, products = ((len(a),), "ipk,ipk->ip") if paired else ((len(a), len(b)), "ipk,jpk->ijp")
    best, chosen, weight = np.full(shape, -2.0), np.zeros(shape, np.int64), np.full(shape, -2.0)
    for o in offsets:
        n = width - abs(o)
        if n < overlap:
            continue
        x = a.reshape(len(a), width, 4)[:, max(0, o) : max(0, o) + n]
        y = b.reshape(len(b), width, 4)[:, max(0, -o) : max(0, -o) + n]
        sums = np.cumsum(np.einsum(products, x, y), axis=-1)
        xx, yy = (x**2).sum(axis=(1, 2)), (y**2).sum(axis=(1, 2))
        size = np.sqrt(xx * yy if paired else xx[:, None] * yy[None])
        r = np.where(size > 0, sums[..., -1] / np.where(size > 0, size, 1), 0)
        r = np.where((sums[..., 3:] < 0).any(axis=-1), -2, r)
        w = np.where(r >= match, r + (1 - r) * 0.5 * (1 - 6 / n) + 10, r)  # any offset above match before those below
        better = w > weight
        best, chosen, weight = np.where(better, r, best), np.where(better, o, chosen), np.where(better, w, weight)
    return best, chosen


def backward(flat):
    """Reverse complements of flat motifs: rows and cells both reversed."""
    return flat[:, ::-1]


def unit(x):
    """Flat parts of motifs at length 1, for products in single precision."""
    x = x.reshape(len(x), -1)
    size = np.sqrt((x**2).sum(axis=1, keepdims=True))
    return (x / np.where(size > 0, size, 1)).astype(np.float32)


def near(a, b, width, match, offsets=(-2, -1, 0, 1), overlap=6):
    """(i, j) of the pairs of flat motifs that reach match in either order, at some offset and direction, by portions.

    Matrix products at each offset tell it to some 1e-6; pairs down to 1e-4 below match are told, so that none is missed.
    """
    x, views = a.reshape(len(a), width, 4), []
    for y, tried in ((b, {*offsets, *(-o for o in offsets)}), (backward(b), offsets)):  # swapped, backward motifs meet at the same offset
        y = y.reshape(len(b), width, 4)
        for o in tried:
            if (n := width - abs(o)) >= overlap:
                views.append((unit(x[:, max(0, o) : max(0, o) + n]), np.ascontiguousarray(unit(y[:, max(0, -o) : max(0, -o) + n]))))
    for i in range(0, len(a), STRIP):
        for j in range(0, len(b), 4 * STRIP):
            good = np.zeros((len(a[i : i + STRIP]), len(b[j : j + 4 * STRIP])), bool)
            for u, v in views:
                good |= u[i : i + STRIP] @ v[j : j + 4 * STRIP].T >= match - 1e-4
            p, q = np.nonzero(good)
            for k in range(0, len(p), PORTION):
                yield p[k : k + PORTION] + i, q[k : k + PORTION] + j


def similar_pairs(left, right, match, width=16):
    """(a, b, r, dir, offset) with r >= match: each motif of left against each of right, forward and reversed.

    left, right: id, flat (array of width x 4 centred log weights). Both are dealt into blocks, a task holds one block
    of each at a time, and only pairs that match leave it. Matrix products find the pairs that may match; the similarity
    is taken of those alone. right None: left against itself, each pair once (a < b). Ties of direction go to forward.
    """
    own = right is None
    n = left.count()
    m = n if own else right.count()
    rows, cols = (max(1, -(-k // BLOCK), min(DEALT, -(-k // 256))) for k in (n, m))
    place = lambda df, k: df.select("id", "flat", F.pmod(F.xxhash64("id"), F.lit(k)).cast("int").alias("block"))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    a = place(left, rows).select("id", "flat", F.col("block").alias("x"), every(cols).alias("y"), F.lit(0).alias("side"))
    b = place(left if own else right, cols).select("id", "flat", every(rows).alias("x"), F.col("block").alias("y"), F.lit(1).alias("side"))
    units = a.unionByName(b)
    if own:
        units = units.where("x <= y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        side, ids = np.array(table["side"]), np.array(table["id"])
        flat = np.asarray(table["flat"].combine_chunks().flatten(), float).reshape(len(ids), -1)
        u, v = side == 0, side == 1
        if not u.any() or not v.any():
            return
        same = own and table["x"][0].as_py() == table["y"][0].as_py()
        p, x, q, y = ids[u], flat[u], ids[v], flat[v]
        for i, j in near(x, y, width, match):
            yield pa.record_batch([pa.array(c) for c in matched(p[i], x[i], q[j], y[j], same)], names=["a", "b", "r", "dir", "offset"])

    def matched(p, x, q, y, same):
        if own:
            keep = p < q if same else p != q  # the lesser id may be on either side of two blocks
            p, x, q, y = p[keep], x[keep], q[keep], y[keep]
            turn = p > q
            p, q = np.where(turn, q, p), np.where(turn, p, q)
            x, y = np.where(turn[:, None], y, x), np.where(turn[:, None], x, y)
        ahead, o1 = similarity(x, y, width, match=match, paired=True)
        back, o2 = similarity(x, backward(y), width, match=match, paired=True)
        turned = back > ahead
        r, o = np.where(turned, back, ahead), np.where(turned, o2, o1)
        keep = r >= match
        return p[keep], q[keep], r[keep], np.where(turned, -1, 1)[keep], o[keep]

    return units.groupBy("x", "y").applyInArrow(run, "a long, b long, r double, dir long, offset long")


def forest(batches, most=1 << 20):
    """Pairs a, b -> (a, b): a portion's ids, each with the least id that the portion's pairs reach from it, if that is another."""
    held, n = [], 0

    def told():
        ends, at = np.unique(np.concatenate([np.concatenate([np.asarray(b.column(c), np.int64) for b in held]) for c in ("a", "b")]), return_inverse=True)
        p, q = at.reshape(2, -1)
        label = np.arange(len(ends))
        while len(p):
            one, two = label[p], label[q]  # only groups' least ids are moved, and what is below them follows
            np.minimum.at(label, np.maximum(one, two), np.minimum(one, two))
            while ((up := label[label]) != label).any():
                label = up
            open_ = label[p] != label[q]
            p, q = p[open_], q[open_]
        moved = label != np.arange(len(ends))
        return pa.record_batch([pa.array(ends[moved]), pa.array(ends[label[moved]])], names=["a", "b"])

    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= most:
            yield told()
            held, n = [], 0
    if held:
        yield told()


def groups(ids, links):
    """(id, group): the least id that links reach; a few rounds of grouped minima, each cutting the distance by half.

    Tasks first replace their portions of the links by forests of as many links as ids, at most. What each round comes to
    is written to the shared folder, so that nothing is held and no lineage grows.
    """
    folder, turn = shared_dir(ids.sparkSession, "groups"), 0

    def cut(df):
        nonlocal turn
        turn += 1
        return saved(df, folder, f"turn-{turn}")

    links = links.select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(forest, "a long, b long")
    ways = F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))
    both = cut(links.select(F.explode(ways).alias("w")).select("w.u", "w.v").distinct())
    labels = cut(ids.select(F.col("id"), F.col("id").alias("group")))
    while True:
        near = both.join(labels, both.v == labels.id).groupBy("u").agg(F.min("group").alias("least"))
        step = labels.join(near, labels.id == near.u, "left").select("id", F.least("group", F.coalesce("least", "group")).alias("group"))
        # a label's own label: pointers are jumped
        up = step.select(F.col("id").alias("k"), F.col("group").alias("up"))
        new = cut(step.join(up, step.group == up.k, "left").select("id", F.least("group", F.coalesce("up", "group")).alias("group")))
        changed = new.join(labels.withColumnRenamed("group", "was"), "id").where("group <> was").isEmpty()
        labels = new
        if changed:
            return labels


def kmeans(motifs, k, turns=30, seed=1, width=16):
    """(id, cluster, distance) by k-means over flat percent matrices with distance 100 (1 - Pearson).

    Seeds are the k motifs least by hash. Each turn broadcasts k centroids (k x width x 4 numbers), assigns every motif
    where it is, and averages cells by cluster; it ends when no motif changes, or after `turns`. Empty clusters drop out.
    """
    start = [r["flat"] for r in motifs.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(k).collect()]
    centres, before = np.array(start), None
    for _ in range(turns):
        found = assign(motifs, centres)
        cells = found.select("id", "cluster", F.posexplode("flat").alias("i", "x")).groupBy("cluster", "i").agg(F.avg("x").alias("x"))
        rows = cells.groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v")).orderBy("cluster").collect()
        new = np.array([[c["x"] for c in r["v"]] for r in rows])
        state = found.agg(F.sum(F.xxhash64("id", "cluster").cast("decimal(38,0)"))).first()[0]
        if state == before:
            break
        before, centres = state, new
    return assign(motifs, centres).select("id", "cluster", "distance")


def assign(motifs, centres):
    """(id, flat, cluster, distance): the nearest centre of each motif; ties: the first."""
    shared = motifs.sparkSession.sparkContext.broadcast(centres)

    def run(batches):
        c = shared.value - shared.value.mean(axis=1, keepdims=True)
        c = c / np.maximum(np.sqrt((c**2).sum(axis=1, keepdims=True)), 1e-300)
        for b in batches:
            x = np.array(b.column("flat").to_pylist()).reshape(b.num_rows, -1)
            if not len(x):
                continue
            x = x - x.mean(axis=1, keepdims=True)
            x = x / np.maximum(np.sqrt((x**2).sum(axis=1, keepdims=True)), 1e-300)
            d = 100 * (1 - x @ c.T)
            at = np.round(d, 9).argmin(axis=1)
            yield pa.record_batch([b.column("id"), b.column("flat"), pa.array(at.astype(np.int64)), pa.array(d[np.arange(len(d)), at])], names=["id", "flat", "cluster", "distance"])

    return motifs.select("id", "flat").mapInArrow(run, "id long, flat array<double>, cluster long, distance double")
