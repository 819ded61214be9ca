"""Questions about motif hits: motif, seq_id, strand, len, start, score, and an id that breaks ties."""

from collections import deque

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

PART = 64  # width of the parts of a sequence that range joins meet in


def bins(hits, interval=100):
    """Middle of the bin that a hit's end lies in."""
    at = F.floor((F.col("start") + F.col("len") + 0.5) / interval)
    return hits.withColumn("bin_mid", (at * interval + interval // 2).cast("long"))


def best_share(hits, parts, id_col="event_id"):
    """Hits of each motif up to the (k + 1)-th best, where k is the motif's count div parts.

    Equal scores are counted first, so that only hits of the boundary score are ever put in order.
    """
    scores = hits.groupBy("motif", "score").agg(F.count(F.lit(1)).alias("c"))
    totals = scores.groupBy("motif").agg((F.floor(F.sum("c") / parts) + 1).alias("most"))
    ahead = F.sum("c").over(Window.partitionBy("motif").orderBy(F.desc("score"))) - F.col("c")
    scores = scores.withColumn("ahead", ahead).join(F.broadcast(totals), "motif").where("ahead < most")
    kept = hits.join(scores, ["motif", "score"])
    inside = kept.where(F.col("ahead") + F.col("c") <= F.col("most"))
    edge = kept.where(F.col("ahead") + F.col("c") > F.col("most"))
    edge = edge.withColumn("_n", F.row_number().over(Window.partitionBy("motif", "score").orderBy(id_col))).where(F.col("ahead") + F.col("_n") <= F.col("most"))
    return inside.select(hits.columns).unionByName(edge.select(hits.columns))


def near_pairs(a, b, distance, on="seq_id"):
    """Rows of a joined to rows of b of one sequence, b starting 0 to distance later: an equi-join on parts of the
    sequence, each a meeting the part it starts in and those up to the distance."""
    a = a.select(on, *(F.col(c).alias(f"a_{c}") for c in a.columns if c != on))
    b = b.select(on, *(F.col(c).alias(f"b_{c}") for c in b.columns if c != on)).withColumn("_part", F.floor(F.col("b_start") / PART))
    a = a.withColumn("_part", F.explode(F.sequence(F.floor(F.col("a_start") / PART), F.floor((F.col("a_start") + distance) / PART))))
    return a.join(b, [on, "_part"]).where((F.col("b_start") >= F.col("a_start")) & (F.col("b_start") - F.col("a_start") <= distance)).drop("_part")


def later_pairs(hits, distance=50, id_col="event_id"):
    """Each pair of hits of one sequence once: the earlier start first, then the lesser id."""
    rows = near_pairs(hits, hits, distance)
    return rows.where((F.col("a_start") < F.col("b_start")) | (F.col(f"a_{id_col}") < F.col(f"b_{id_col}")))


def spans(hits):
    """Stretches of each sequence that hits cover, joined where they meet: seq_id, start, end, n."""
    w = Window.partitionBy("seq_id").orderBy("start", "len")
    before = F.max(F.col("start") + F.col("len")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = hits.withColumn("_new", (before.isNull() | (F.col("start") > before)).cast("int"))
    rows = rows.withColumn("_span", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("seq_id", "_span").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("len")).alias("end"), F.count(F.lit(1)).alias("n")).drop("_span")


def resolve(hits, id_col="event_id"):
    """Hits that no better one of the sequence is in conflict with.

    Better: higher score, then earlier start, motif and id. Two hits conflict when they overlap and either are of one
    motif, or share more than a quarter of the shorter.
    """
    key = lambda p: F.struct(-F.col(f"{p}_score"), F.col(f"{p}_start"), F.col(f"{p}_motif"), F.col(f"{p}_{id_col}"))
    longest = hits.agg(F.coalesce(F.max("len"), F.lit(0))).first()[0]
    both = near_pairs(hits, hits, int(longest)).where(f"a_{id_col} <> b_{id_col}")
    shared = F.least(F.col("a_start") + F.col("a_len"), F.col("b_start") + F.col("b_len")) - F.col("b_start")
    clash = both.where((shared > 0) & ((F.col("a_motif") == F.col("b_motif")) | (4 * shared > F.least("a_len", "b_len"))))
    lost = clash.select(F.when(key("a") < key("b"), F.col(f"b_{id_col}")).otherwise(F.col(f"a_{id_col}")).alias(id_col)).distinct()
    return hits.join(lost, id_col, "left_anti")


def conflicts(hits, id_col="event_id", reach=15):
    """a, b: pairs of hits of one sequence that can't both stay, a starting first; the start of one is at most `reach` before
    the other's. Two of one motif can't; two motifs can if the second starts in the last quarter of the first, or after
    it, and shares less than three quarters of its own length."""
    both = near_pairs(hits, hits, reach).where(F.col(f"a_{id_col}") != F.col(f"b_{id_col}"))
    both = both.where((F.col("a_start") < F.col("b_start")) | (F.col(f"a_{id_col}") < F.col(f"b_{id_col}")))
    shift = F.col("b_start") - F.col("a_start")
    apart = (4 * shift >= 3 * F.col("a_len")) & (4 * (F.col("a_len") - shift) < 3 * F.col("b_len"))
    return both.where((F.col("a_motif") == F.col("b_motif")) | ~apart).select(F.col(f"a_{id_col}").alias("a"), F.col(f"b_{id_col}").alias("b"))


class Sweep:
    """Hits of one sequence in the order of their starts -> those that the greedy choice keeps.

    A hit that all better ones in conflict with have lost to is kept, once no more can come (none starts within reach);
    what it is in conflict with is lost, which may free others, and so on down the chain. Only hits that still wait, and
    those within reach, are held.
    """

    def __init__(self, reach):
        self.reach, self.near, self.waiting = reach, deque(), deque()

    @staticmethod
    def clash(a, b):
        """As conflicts(): a starts first. A hit is [rank, start, len, motif, row, kept or not, worse hits, better hits waiting, whether all have come]."""
        shift = b[1] - a[1]
        return a[3] == b[3] or not (4 * shift >= 3 * a[2] and 4 * (a[2] - shift) < 3 * b[2])

    def add(self, rank, start, length, motif, row):
        """Rows that are decided to stay by now."""
        out, hit = self.upto(start - self.reach), [rank, start, length, motif, row, None, [], 0, False]
        while self.near and self.near[0][1] < start - self.reach:
            self.near.popleft()
        for other in self.near:
            if other[5] is None and self.clash(other, hit):
                better, worse = (other, hit) if other[0] < hit[0] else (hit, other)
                better[6].append(worse)
                worse[7] += 1
        self.near.append(hit)
        self.waiting.append(hit)
        return out

    def upto(self, start):
        """Decides what starts before `start`, as far as it can."""
        out = []
        while self.waiting and self.waiting[0][1] < start:
            hit = self.waiting.popleft()
            hit[8] = True  # no more can come
            if hit[5] is None and not hit[7]:
                self.keep(hit, out)
        return out

    def keep(self, first, out):
        todo = [first]
        while todo:
            hit = todo.pop()
            if hit[5] is not None:
                continue
            hit[5] = True
            out.append(hit[4])
            for worse in hit[6]:
                if worse[5] is None:
                    worse[5] = False
                    for freed in worse[6]:
                        freed[7] -= 1
                        if not freed[7] and freed[8] and freed[5] is None:
                            todo.append(freed)
            hit[6] = []

    def close(self):
        return self.upto(float("inf"))


def sweep(id_col, reach):
    """Hits sorted by sequence, part and start -> those that stay."""

    def run(batches):
        part, state, schema = None, Sweep(reach), None
        for b in batches:
            schema, kept = b.schema, []
            names = [f.name for f in schema]
            at = {n: names.index(n) for n in ("seq_id", "_part", "score", "start", "motif", "len", id_col)}
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                key = row[at["seq_id"]], row[at["_part"]]
                if key != part:
                    kept += state.close()
                    part, state = key, Sweep(reach)
                rank = (-row[at["score"]], row[at["start"]], row[at["motif"]], row[at[id_col]])
                kept += state.add(rank, row[at["start"]], row[at["len"]], row[at["motif"]], row)
            yield told(kept, schema)
        if schema is not None:
            yield told(state.close(), schema)

    def told(rows, schema):
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [()] * len(schema), schema, strict=True)], schema=schema)

    return run


def resolve_greedy(hits, id_col="event_id", reach=15, tile=256):
    """Hits kept one after the other, best first (score, earlier start, motif, id), each unless it conflicts with one kept.

    Sequences are cut at tile borders that no conflict can cross; each part is swept once in the order of starts, in one
    shuffle of the hits. A task holds what is within reach and what still waits for a decision, so that a long chain takes
    one pass.
    """
    tiles = hits.groupBy("seq_id", F.floor(F.col("start") / tile).alias("_tile")).agg(F.min("start").alias("low"), F.max("start").alias("high"))
    w = Window.partitionBy("seq_id").orderBy("_tile")  # tiles, not hits
    cut = F.coalesce(F.col("low") - F.lag("high").over(w) > reach, F.lit(True))
    parts = tiles.withColumn("cut", F.when(cut, F.col("_tile"))).select("seq_id", "_tile", F.max("cut").over(w).alias("_part"))
    rows = hits.withColumn("_tile", F.floor(F.col("start") / tile)).join(parts, ["seq_id", "_tile"]).drop("_tile")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.repartition("seq_id", "_part").sortWithinPartitions("seq_id", "_part", "start").mapInArrow(sweep(id_col, reach), kinds).select(hits.columns)
