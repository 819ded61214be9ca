"""Motifs that stand at fixed distances: positions of words, their pairs, and clusters aligned by them."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..session import saved, shared_dir
from .hits import later_pairs
from .kmers import ranks, templates, window_codes


def word_hits(seqs, words, length=8):
    """(motif, seq_id, strand, len, start, event_id) of each occurrence of the words; - is the other strand, a palindrome
    is one occurrence. words: strings, at most 4**length; event_id is the start, as a place has one hit."""
    shared = seqs.sparkSession.sparkContext.broadcast([(w, sum("ACGT".index(c) * 4**j for j, c in enumerate(w))) for w in words])
    _, span, parts = templates(length)[0]

    def run(batches):
        other, index = ranks(length)[1], np.full(4**length, -1, np.int64)
        names = pa.array([w for w, _ in shared.value], pa.string())
        index[[c for _, c in shared.value]] = np.arange(len(names))
        for b in batches:
            for seq_id, u in zip(b.column("seq_id"), b.column("u").to_pylist(), strict=True):
                at, codes = window_codes(u or "", span, parts)
                own, turned = index[codes], index[other[codes]]
                good = np.flatnonzero((own >= 0) | (turned >= 0))
                forward = own[good] >= 0
                motif = names.take(pa.array(np.where(forward, own[good], turned[good])))
                n, start = len(good), pa.array(at[good])
                yield pa.record_batch([motif, pa.array([seq_id.as_py()] * n, pa.int64()), pa.array(np.where(forward, "+", "-").tolist(), pa.string()), pa.array([length] * n, pa.int64()), start, start], names=["motif", "seq_id", "strand", "len", "start", "event_id"])

    return seqs.select("seq_id", "u").mapInArrow(run, "motif string, seq_id long, strand string, len long, start long, event_id long")


def framed(hits):
    """m1, m2, dir, gap of hits within 50 bases: where the second motif stands as seen along the first, the lesser name."""
    p = later_pairs(hits)
    ahead = F.col("a_motif") <= F.col("b_motif")
    seen = lambda x, y: F.when(F.col(f"{x}_strand") == "+", F.col(f"{y}_start") - F.col(f"{x}_start")).otherwise(F.col(f"{x}_start") + F.col(f"{x}_len") - F.col(f"{y}_start") - F.col(f"{y}_len"))
    same = F.when(F.col("a_strand") == F.col("b_strand"), 1).otherwise(-1).cast("long")
    return p.select(F.least("a_motif", "b_motif").alias("m1"), F.greatest("a_motif", "b_motif").alias("m2"), same.alias("dir"), F.when(ahead, seen("a", "b")).otherwise(seen("b", "a")).alias("gap"))


def offsets(hits, least=5, share=0.05):
    """m1, m2, dir, gap, n, share: distances of two motifs that make up `share` of the rarer one's hits and `least` in number."""
    f = hits.groupBy("motif").agg(F.count(F.lit(1)).alias("c"))
    g = framed(hits).groupBy("m1", "m2", "dir", "gap").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    g = g.join(f.select(F.col("motif").alias("m1"), F.col("c").alias("c1")), "m1").join(f.select(F.col("motif").alias("m2"), F.col("c").alias("c2")), "m2")
    rare = F.least("c1", "c2")
    return g.where(F.col("n") >= share * rare).select("m1", "m2", "dir", "gap", "n", (F.col("n") / rare).alias("share"))


# A frame is moved into another by (turn, move): a place x becomes move + x, or move - x if turn is -1. A motif that stands
# at `place` in direction `dir` covers its length from there on.


def placed(turn, move, place, length):
    return F.when(turn == 1, move + place).otherwise(move - place - length)


def joined(turn1, move1, turn2, move2):
    """(turn, move) of the first, then the second."""
    return turn1 * turn2, turn2 * move1 + move2


def align(links, lengths, folder=None):
    """(cluster, motif, dir, place): motifs aligned by the links between them, from the strongest on.

    links: m1, m2, dir, gap (m2 as seen along m1) and share, of different motifs; lengths: motif, len. Of links that would
    close a circle the weakest is left out (share, then m1, m2, dir, gap decide), so that a cluster is a tree of its
    strongest links, and each motif has one place. Each turn, every cluster takes its strongest link to another, and
    chains of clusters are followed by doubling: n motifs take about log n turns of log n steps, all joins; state is
    written to folder. A cluster is named by its least motif, which stands forward; places count from the cluster's
    first. Motifs without links have no row; no links give no rows.
    """
    folder = folder or shared_dir(links.sparkSession, "align")
    key = F.struct((-F.col("share")).alias("s"), "m1", "m2", "dir", "gap").alias("key")
    ends = links.where("m1 <> m2").select("m1", "m2", "dir", "gap", key)
    ends = saved(ends.join(lengths.select(F.col("motif").alias("m1"), F.col("len").alias("l1")), "m1").join(lengths.select(F.col("motif").alias("m2"), F.col("len").alias("l2")), "m2"), folder, "links")
    motifs = ends.select(F.col("m1").alias("motif"), F.col("l1").alias("len")).unionByName(ends.select(F.col("m2").alias("motif"), F.col("l2").alias("len"))).distinct()
    state = saved(motifs.select("motif", "len", F.col("motif").alias("root"), F.lit(1).cast("long").alias("turn"), F.lit(0).cast("long").alias("place")), folder, "state-0")
    turn = 0
    while True:
        at = lambda k: state.select(F.col("motif").alias(f"m{k}"), F.col("root").alias(f"r{k}"), F.col("turn").alias(f"d{k}"), F.col("place").alias(f"p{k}"))  # noqa: B023, E731
        cross = ends.join(at(1), "m1").join(at(2), "m2").where("r1 <> r2")
        # where the link puts each motif in the frame of the other's cluster
        two = F.when(F.col("d1") == 1, F.col("p1") + F.col("gap")).otherwise(F.col("p1") + F.col("l1") - F.col("l2") - F.col("gap"))
        first = F.col("d2") * F.col("dir")
        one = F.when(first == 1, F.col("p2") - F.col("gap")).otherwise(F.col("p2") + F.col("l2") - F.col("l1") + F.col("gap"))

        def hook(own, to, own_dir, own_place, length, new_dir, new_place):
            t = own_dir * new_dir
            return F.struct("key", F.col(own).alias("root"), F.col(to).alias("to"), t.alias("t"), F.when(t == 1, new_place - own_place).otherwise(new_place + own_place + length).alias("m"))

        both = F.array(hook("r2", "r1", F.col("d2"), F.col("p2"), F.col("l2"), F.col("d1") * F.col("dir"), two), hook("r1", "r2", F.col("d1"), F.col("p1"), F.col("l1"), first, one))
        best = cross.select(F.explode(both).alias("h")).groupBy("h.root").agg(F.min("h").alias("h")).select("h.*")
        best = saved(best, folder, f"best-{turn}")
        if best.isEmpty():
            break
        # two that chose each other chose one link: the lesser name stays where it is
        back = best.select(F.col("root").alias("to"), F.col("to").alias("root"), F.lit(True).alias("mutual"))
        hooks = best.join(back, ["root", "to"], "left").where("mutual is null or root > to").select("root", "to", "t", "m")
        step = 0
        while True:
            hooks = saved(hooks, folder, f"hooks-{turn}-{step}")
            further = hooks.select(F.col("root").alias("to"), F.col("to").alias("to2"), F.col("t").alias("t2"), F.col("m").alias("m2"))
            if hooks.join(further, "to", "left_semi").isEmpty():
                break
            t, m = joined(F.col("t"), F.col("m"), F.coalesce("t2", F.lit(1)), F.coalesce("m2", F.lit(0)))
            hooks = hooks.join(further, "to", "left").select("root", F.coalesce("to2", "to").alias("to"), t.alias("t"), m.alias("m"))
            step += 1
        moved = state.join(hooks, "root", "left")
        t, m = F.coalesce("t", F.lit(1)), F.coalesce("m", F.lit(0))
        turn += 1
        state = saved(moved.select("motif", "len", F.coalesce("to", "root").alias("root"), (F.col("turn") * t).alias("turn"), placed(t, m, F.col("place"), F.col("len")).alias("place")), folder, f"state-{turn}")
    heads = state.groupBy("root").agg(F.min(F.struct("motif", "turn")).alias("head")).select("root", F.col("head.motif").alias("cluster"), F.col("head.turn").alias("t"))
    rows = state.join(heads, "root").select("cluster", "motif", "len", (F.col("turn") * F.col("t")).alias("dir"), placed(F.col("t"), F.lit(0), F.col("place"), F.col("len")).alias("place"))
    low = rows.groupBy("cluster").agg(F.min("place").alias("low"))
    return rows.join(low, "cluster").select("cluster", "motif", "len", "dir", (F.col("place") - F.col("low")).alias("place"))


def unexplained(links, aligned, overlay=6):
    """Links that the alignment doesn't explain, with the columns cluster1, cluster2: the motifs stand in two clusters, or
    in one but elsewhere. Only those that share less than `overlay` columns, by the first motif's end, or, if they are
    turned, by the second's end from its place on."""
    at = lambda k: aligned.select(F.col("motif").alias(f"m{k}"), F.col("cluster").alias(f"cluster{k}"), F.col("dir").alias(f"d{k}"), F.col("place").alias(f"p{k}"), F.col("len").alias(f"l{k}"))
    rows = links.where("m1 <> m2").join(at(1), "m1").join(at(2), "m2")
    stands = F.when(F.col("d1") == 1, F.col("p2") - F.col("p1")).otherwise(F.col("p1") + F.col("l1") - F.col("p2") - F.col("l2"))
    same = (F.col("cluster1") == F.col("cluster2")) & (F.col("d1") * F.col("d2") == F.col("dir")) & (stands == F.col("gap"))
    shared = F.when(F.col("dir") > 0, F.col("l1") - F.col("gap")).otherwise(F.col("l2") + F.col("gap"))
    return rows.where(~same & (shared < overlay)).select("m1", "m2", "cluster1", "cluster2", "dir", "gap", "n", "share")
