"""Clusters, conflicts and files of motifs against plain code."""

import inspect
import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandlake.operators import clusters as ops
from strandlake.operators import hits as hit_ops
from strandlake.plans import finish
from strandlake.sources import text


def plain_linkage(pairs, ids):
    """One merge at a time: the most similar pair, of equals that of the least ids."""
    sim = {(a, b): r for a, b, r in pairs}
    merges, path, root = [], dict.fromkeys(ids, ""), {i: i for i in ids}
    while sim:
        a, b = max(sim, key=lambda k: (sim[k], -k[0], -k[1]))
        merges.append((a, b, round(sim[a, b], 9)))
        new = {}
        for (x, y), r in sim.items():
            p, q = sorted(a if k == b else k for k in (x, y))
            if p != q:
                weight = 0.5 if {x, y} & {a, b} else 1.0
                new[p, q] = new.get((p, q), 0) + r * weight
        sim = new
        for i in ids:
            if root[i] in (a, b):
                path[i] = ("0" if root[i] == a else "1") + path[i]
                root[i] = a
    return merges, {i: (root[i], path[i]) for i in ids}


def plain_places(merges, ids):
    """Leaves of each tree in order: of two sides the one with more leaves first, then the one with the least id."""
    order = {i: [i] for i in ids}
    for a, b, _ in merges:
        one, two = order[a], order.pop(b)
        order[a] = two + one if len(two) > len(one) else one + two
    return {i: k for leaves in order.values() for k, i in enumerate(leaves)}


@pytest.mark.parametrize("most", [20_000, 0])
def test_linkage_against_one_merge_at_a_time(spark, most):
    """In a task, and by a job for each turn."""
    rng = random.Random(1)
    pairs = [(a, b, rng.random()) for a, b in itertools.combinations(range(24), 2) if rng.random() < 0.15 and (a < 18) == (b < 18)]
    merges, leaves = ops.linkage(spark.createDataFrame(pairs, "a long, b long, r double"), spark.range(26), most)
    want_merges, want_leaves = plain_linkage(pairs, range(26))
    assert sorted((r["a"], r["b"], round(r["r"], 9)) for r in merges.collect()) == sorted(want_merges)
    assert {r["id"]: (r["root"], r["path"]) for r in leaves.collect()} == want_leaves
    assert {r["id"]: r["place"] for r in leaves.collect()} == plain_places(want_merges, range(26))
    merges, leaves = ops.linkage(spark.createDataFrame([], "a long, b long, r double"), spark.range(2), most)
    assert merges.count() == 0 and {r["root"] for r in leaves.collect()} == {0, 1}


def test_a_star_is_merged_in_a_task():
    """One leaf a turn, whatever the number of turns."""
    got = ops.tree([(0, k, 0.2 + k / 1e5) for k in range(1, 601)]).to_pylist()
    merges = [(r["a"], r["b"], r["turn"]) for r in got if r["a"] is not None]
    assert len(merges) == 600 and {a for a, _, _ in merges} == {0} and sorted(t for _, _, t in merges) == list(range(1, 601))
    assert sorted(r["place"] for r in got if r["id"] is not None) == list(range(601))


def test_trees_of_many_pairs_are_merged_in_a_task():
    """A part of 30,000 pairs, with ties, as one merge at a time; groups of a task go on from batch to batch."""
    rng = random.Random(7)
    pairs = [(a, b, rng.choice((0.25, 0.5, 0.75)) if a % 2 else rng.random()) for a, b in itertools.combinations(range(40), 2) if rng.random() < 0.4]
    want, leaves = plain_linkage(pairs, range(40))
    got = ops.tree(pairs).to_pylist()
    assert sorted((r["a"], r["b"], round(r["r"], 9)) for r in got if r["a"] is not None) == sorted(want)
    assert {r["id"]: (r["root"], r["path"]) for r in got if r["id"] is not None} == {k: v for k, v in leaves.items() if any(k in p[:2] for p in pairs)}
    rows = [(g, 100 * g + a, 100 * g + b, r) for g in range(5) for a, b, r in pairs]
    batches = [pa.record_batch([pa.array(c) for c in zip(*rows[k : k + 97], strict=True)], names=["group", "a", "b", "r"]) for k in range(0, len(rows), 97)]
    for least in (1, 10**9):
        told = [r for b in ops.in_tasks(iter(batches), least) for r in b.to_pylist()]
        for g in range(5):
            assert sorted((r["a"] - 100 * g, r["b"] - 100 * g, round(r["r"], 9)) for r in told if r["a"] is not None and r["a"] // 100 == g) == sorted(want)
    assert inspect.signature(ops.linkage).parameters["most"].default > 10**7
    edges = np.unique(np.sort(np.random.default_rng(1).integers(0, 2000, (30_000, 2)), axis=1), axis=0)
    edges = edges[edges[:, 0] < edges[:, 1]]
    r = np.random.default_rng(2).random(len(edges))
    made = [b for b in ops.trees(edges[:, 0], edges[:, 1], r, room=1 << 12)]
    assert sum(len(b) - b.column("a").null_count for b in made) == 1999 and len([b for b in made if b.column("id").null_count == 0]) > 10


def test_motifs_of_one_family_align(spark):
    """Shifted and reversed copies of two matrices fall into two clusters, at the places where they were cut."""
    rng = np.random.default_rng(2)
    base = [rng.normal(size=(20, 4)) * 2 for _ in range(2)]
    base = [m - m.mean(axis=1, keepdims=True) for m in base]
    rows, truth = [], {}
    for i in range(24):
        family, shift, turn = i % 2, int(rng.integers(0, 3)), int(rng.integers(0, 2))
        m = base[family][shift : shift + 16] + rng.normal(size=(16, 4)) * 0.05
        m = m - m.mean(axis=1, keepdims=True)
        truth[i] = (family, shift, turn)
        rows.append((i, (m[::-1, ::-1] if turn else m).ravel().tolist()))
    rows.append((99, rng.normal(size=64).tolist()))
    motifs = spark.createDataFrame(rows, "id long, flat array<double>")
    from strandlake.operators.motifs import similar_pairs

    pairs = similar_pairs(motifs, None, 0.8)
    got = {r["id"]: r for r in ops.seed_extend(motifs, pairs, 0.8).collect()}
    assert len(got) == 25 and got[99]["cluster"] == 99
    for family in (0, 1):
        own = [i for i in truth if truth[i][0] == family]
        assert len({got[i]["cluster"] for i in own}) == 1
        seed = got[own[0]]["cluster"]
        for i in own:
            same = truth[i][2] == truth[seed][2]
            assert got[i]["dir"] == (1 if same else -1)
            shift = truth[i][1] - truth[seed][1]
            assert got[i]["offset"] == (shift if truth[seed][2] == 0 else -shift)
    alone = ops.seed_extend(motifs, pairs.limit(0), 0.8)
    assert alone.where("cluster = id").count() == 25


def plain_place(covered, values, flat, match):
    """The best place of one motif in one frame."""
    best = (-2.0, -2.0, 1, 0)
    for turn, own in ((1, flat.reshape(16, 4)), (-1, flat.reshape(16, 4)[::-1, ::-1])):
        for at in range(33):
            on = covered[at : at + 16]
            if (n := on.sum()) < 6:
                continue
            x, y = values[at : at + 16][on], own[on]
            r = (x * y).sum() / np.sqrt((x * x).sum() * (y * y).sum())
            w = r + (1 - r) * 0.5 * (1 - 6 / n) + 10 if r >= match else r
            if round(w, 9) > round(best[0], 9):
                best = (w, r, turn, at - 16)
    return best[1:]


def test_places_in_frames_at_once():
    rng = np.random.default_rng(2)
    covered, values = np.zeros((12, 48), bool), np.zeros((12, 48, 4))
    for k in range(12):
        a = int(rng.integers(8, 17))
        b = a + 16 + int(rng.integers(0, 8))
        covered[k, a:b], values[k, a:b] = True, rng.normal(size=(b - a, 4)) * 2
    covered[::5, 20], values[::5, 20] = False, 0
    which, flats = rng.integers(0, 12, 60), rng.normal(size=(60, 64))
    for i in range(40):
        a = 16 + int(rng.integers(-3, 4))
        z = (values[which[i], a : a + 16] + rng.normal(size=(16, 4)) * 0.5).ravel()
        flats[i] = z if i % 2 else z[::-1]
    for r, way, offset, k, x in zip(*ops.aligned((covered, values), which, flats, match=0.5), which, flats, strict=True):
        want = plain_place(covered[k], values[k], x, 0.5)
        assert abs(r - want[0]) < 1e-12 and (way, offset) == want[1:]


def test_clusters_grown_in_a_task_or_in_rounds(spark):
    """The same clusters either way; groups in portions of whatever size."""
    from strandlake.operators.motifs import similar_pairs

    rng = np.random.default_rng(6)
    base = rng.normal(size=(9, 64)) * 2
    flat = np.concatenate([base[rng.integers(0, 9, 70)] + rng.normal(size=(70, 64)) * 1.6, rng.normal(size=(20, 64))])
    flat[::3] = flat[::3, ::-1]
    motifs = spark.createDataFrame([(1000 - 7 * k, x.tolist()) for k, x in enumerate(flat)], "id long, flat array<double>")
    pairs = similar_pairs(motifs, None, 0.42).localCheckpoint()
    told = lambda most: sorted(tuple(r) for r in ops.seed_extend(motifs, pairs, 0.42, most).select("cluster", "id", "dir", "offset").collect())
    whole = told(12_000_000)
    assert whole == told(0) and len(whole) == 90 and 9 <= len({r[0] for r in whole}) < 80


def plain_distance(point, centre):
    """Distance of two matrices cell by cell."""
    fill, best = np.array(ops.BACKGROUND), None
    for o in range(6 - len(point), len(centre) - 6 + 1):
        for way, own in ((0, point), (1, point[::-1, ::-1])):
            x, y = [], []
            for at in range(min(0, o), max(len(centre), o + len(point))):
                x += list(centre[at] if 0 <= at < len(centre) else fill)
                y += list(own[at - o] if 0 <= at - o < len(point) else fill)
            x, y = ([75 + 3 * (v - 75) if v > 75 else v for v in z] for z in (x, y))
            d = 100 * (1 - np.corrcoef(x, y)[0, 1])
            if best is None or round(d, 7) < round(best[0], 7):
                best = (d, o, way)
    return best


def test_distances_and_kmeans(spark):
    rng = np.random.default_rng(3)
    m = rng.dirichlet([0.3] * 4, size=(30, 16)) * 100
    for width in (16, 9):
        found = ops.distances(m[:6], m[7][:width])
        for i in range(6):
            d, o, way = plain_distance(m[i], m[7][:width])
            assert abs(found[0][i] - d) < 1e-6 and (found[1][i], found[2][i]) == (o, way)
    assert ops.distances(m[:1], m[0])[0][0] < 1e-9
    base = rng.dirichlet([0.2] * 4, size=(3, 20)) * 100
    rows, family = [], {}
    for i in range(45):
        k, shift, turn = i % 3, int(rng.integers(0, 4)), int(rng.integers(0, 2))
        own = base[k][shift : shift + 16]
        family[i] = k
        rows.append((i, (own[::-1, ::-1] if turn else own).ravel().tolist()))
    got = ops.kmeans_aligned(spark.createDataFrame(rows, "id long, flat array<double>"), 6).collect()
    by = {}
    for r in got:
        by.setdefault(r["cluster"], set()).add(family[r["id"]])
    assert len(got) == 45 and all(len(v) == 1 for v in by.values()) and all(r["distance"] < 30 for r in got)
    assert ops.trimmed([1, 1, 1], np.ones((3, 4))) is None


def test_greedy_resolution(spark):
    rng = random.Random(4)
    rows = [(k, rng.choice("ab"), k % 3, "+", 8, rng.randrange(120), float(rng.randrange(30))) for k in range(150)]
    table = spark.createDataFrame(rows, "event_id long, motif string, seq_id long, strand string, len long, start long, score double")

    def clash(x, y):
        x, y = sorted((x, y), key=lambda r: r[5])
        shift = y[5] - x[5]
        return x[2] == y[2] and shift <= 15 and (x[1] == y[1] or not (4 * shift >= 3 * x[4] and 4 * (x[4] - shift) < 3 * y[4]))

    kept = []
    for r in sorted(rows, key=lambda r: (-r[6], r[5], r[1], r[0])):
        if not any(clash(r, k) for k in kept):
            kept.append(r)
    assert {r["event_id"] for r in hit_ops.resolve_greedy(table).collect()} == {r[0] for r in kept}
    pairs = {tuple(sorted((r["a"], r["b"]))) for r in hit_ops.conflicts(table).collect()}
    assert pairs == {(x[0], y[0]) for x, y in itertools.combinations(rows, 2) if clash(x, y)}
    assert hit_ops.resolve_greedy(table.limit(0)).count() == 0


def test_greedy_sweep_of_a_long_chain(spark):
    """A falling chain, each hit in conflict with its neighbours alone, is one pass; what waits is let go as soon as it can."""
    n = 20_000
    table = spark.range(n).select(F.col("id").alias("event_id"), F.lit("a").alias("motif"), F.lit(1).cast("long").alias("seq_id"), F.lit("+").alias("strand"), F.lit(8).cast("long").alias("len"), (F.col("id") * 10).alias("start"), (-F.col("id")).cast("double").alias("score"))
    assert [r[0] for r in hit_ops.resolve_greedy(table).select("event_id").orderBy("event_id").collect()] == list(range(0, n, 2))
    rising = table.withColumn("score", F.col("event_id").cast("double"))
    assert [r[0] for r in hit_ops.resolve_greedy(rising).select("event_id").orderBy("event_id").collect()] == list(range(1, n, 2))
    state, most = hit_ops.Sweep(15), 0
    for k in range(3000):
        state.add((k, k * 10, "a", k), k * 10, 8, "a", k)
        most = max(most, len(state.waiting))
    assert most < 5 and len(state.near) < 5


def test_finished_matrices_of_spaced_words():
    """Columns of a template stand in the order of its span, between two flanks."""
    own, other = finish.columns_of((0, 2))[2]
    assert own == [3, 4, 5, 6, 9, 10, 11, 12] and sorted([*own, *other.values()]) == list(range(1, 15))
    m = finish.in_percent(np.array([[1.0, 3, 0, 0], [0, 0, 0, 0]]))
    assert m.tolist() == [[25, 75, 0, 0], [25, 25, 25, 25]]


def test_formats_of_clusters_and_comparisons(spark, tmp_path):
    clusters = spark.createDataFrame([("C1", [[10.0, 20.0, 30.0, 40.0], [100.0, 0.0, 0.0, 0.0]]), ("C2", [[25.0] * 4])], "name string, pfm array<array<double>>")
    members = spark.createDataFrame([("C1", "m2", -1, 3), ("C1", "m1", 1, 0)], "name string, motif string, dir long, offset long")
    text.write_clusters(clusters, members, f"{tmp_path}/c")
    got = {r["name"]: r for r in text.read_clusters(spark, f"{tmp_path}/c").collect()}
    assert got["C1"]["n"] == 2 and got["C1"]["pfm"] == [[10.0, 20.0, 30.0, 40.0], [100.0, 0.0, 0.0, 0.0]] and got["C2"]["members"] == []
    assert [tuple(m) for m in got["C1"]["members"]] == [("m1", 1, 0), ("m2", -1, 3)]
    text.write_compare(spark.createDataFrame([("q", "a", 0.7, 1, 0), ("q", "b", 0.9, -1, 2)], "query string, target string, match double, dir long, offset long"), f"{tmp_path}/m")
    assert [r["value"] for r in spark.read.text(f"{tmp_path}/m").collect()] == ["q", "    b\t0.9000\t-1\t2", "    a\t0.7000\t1\t0"]
    text.write_progress(spark.createDataFrame([("m", 2, 5, 1, 3.5), ("m", 1, 4, 2, 3.0)], "motif string, turn long, n1 long, n2 long, threshold double"), f"{tmp_path}/p")
    assert [r["value"] for r in spark.read.text(f"{tmp_path}/p").collect()] == ["m\t1\t4\t2\t3.0", "m\t2\t5\t1\t3.5"]
    (tmp_path / "h.txt").write_text("Parameters: interval=5 genome=x\nHeaders:\tname\tratio\n>A\t2.5\n0\t1\t2\t3\t4\n")
    assert text.parameters(spark, str(tmp_path / "h.txt")) == {"interval": "5", "genome": "x"}
    got = text.read_pfm(spark, str(tmp_path / "h.txt")).collect()
    assert [(r["name"], r["ratio"], r["pfm"]) for r in got] == [("A", 2.5, [[1.0, 2.0, 3.0, 4.0]])]


def test_sql_table_function(spark):
    from strandlake.functions import surface

    surface.register(spark)
    got = spark.sql("SELECT * FROM kmers('ACGTNACGT', 0, 4)").collect()
    assert [tuple(r) for r in got] == [(0, "ACGT"), (5, "ACGT")]
    assert spark.sql("SELECT hit_p(2.0D) AS p, count_cg('ACGC') AS n").first() == (0.01, 3)
