"""Refinement of matrices by the bases of their hits, as a loop over tables of states.

A turn scans all motifs that still change, once, at thresholds that the matrices themselves give, and keeps how often each
matched text occurs in either group. Sub-turns score these texts again: the threshold is the score of a rank in the
control, the bases above it change the matrix. After the last turn only thresholds are taken. Each state of a motif is a
row; those of all turns are the progress.
"""

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import pfm, seq
from ..session import saved, shared_dir
from .scan import wide_scan

METHODS = ("regression", "resample", "difference")
STATE = ("motif", "m", "threshold", "freq", "ratio", "score")


def chance_threshold(m, fp):
    """Score that about 2 fp + 10 of 10,000 windows of chance reach, from a matrix's mean and variance; at least 1.301."""
    share = math.log((2 + 10 / fp) * fp / 10000)
    means = [sum(r) / 4 for r in m]
    spread = math.sqrt(sum(sum((x - a) ** 2 for x in r) / 3 for r, a in zip(m, means, strict=True)))
    most = sum(max(r) for r in m)
    return max(min(sum(means) + (0.968 - 0.3235 * share - 0.0037336 * share * share) * spread, 0.75 * most), 1.301)


def best_core(m, length=8):
    """First of the columns in a row with the most information."""
    bits = []
    for r in m:
        p = [10**x for x in r]
        bits.append(2 + sum(x / sum(p) * math.log2(x / sum(p)) for x in p))
    return max(range(len(m) - length + 1), key=lambda k: (round(sum(bits[k : k + length]), 6), -k))


def texts(seqs, state, fp):
    """motif, grp, match, n: matched texts of all motifs, along the motif."""
    rows = ((r["motif"], r["m"], best_core(r["m"]), chance_threshold(r["m"], fp)) for r in state.select("motif", "m").toLocalIterator())
    hits = wide_scan(seqs, rows).join(seqs.select("seq_id", "u"), "seq_id").join(state.select("motif", F.size("m").alias("width")), "motif")
    text = F.substring(F.col("u"), (F.col("start") + 1).cast("int"), F.col("width"))
    return hits.select("motif", "grp", F.when(F.col("strand") == "+", text).otherwise(seq.revcomp(text)).alias("match")).groupBy("motif", "grp", "match").agg(F.count(F.lit(1)).alias("n"))


def thresholds(found, state, totals, fp):
    """(scored texts, one row a motif: threshold, freq, ratio, score, and n1, n2, all1, all2 of the progress).

    The threshold is the score of rank floor(len2 * fp / 10,000) in the control, counted from 0, or of its last hit. A motif
    without hits in the control has no row.
    """
    cell = F.transform(F.split("match", ""), lambda c, j: F.col("m")[j][F.instr(F.lit("ACGT"), c) - 1])
    scored = found.join(state.select("motif", "m"), "motif").select("motif", "grp", "match", "n", F.round(pfm.total(cell), 6).alias("s"))
    rank = math.floor(totals["len2"] * fp / 10000)
    c = scored.where("grp = 'ctrl'").groupBy("motif", "s").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("motif")
    c = c.withColumn("upto", F.sum("n").over(w.orderBy(F.desc("s")))).withColumn("total", F.sum("n").over(w))
    limit = c.where(F.col("upto") > F.least(F.lit(rank), F.col("total") - 1)).groupBy("motif").agg(F.max("s").alias("threshold"), F.first("total").alias("total"))
    limit = limit.select("motif", "threshold", F.least(F.lit(rank), F.col("total") - 1).alias("rank"))
    of = lambda g, c, n: F.coalesce(F.sum(F.when((F.col("grp") == g) & c, F.col("n"))), F.lit(0)).alias(n)
    good = F.col("s") >= F.col("threshold")
    rows = scored.join(limit, "motif").groupBy("motif", "threshold", "rank").agg(of("test", good, "n1"), of("ctrl", good, "n2"), of("test", F.lit(True), "all1"), of("ctrl", F.lit(True), "all2"))
    scaled = F.floor(F.col("rank") * totals["len1"] / totals["len2"])
    freq = F.col("n1") - scaled
    return scored, rows.select("motif", "threshold", freq.alias("freq"), F.when(scaled > 0, F.col("n1") / scaled).alias("ratio"), F.when(scaled > 0, freq / F.sqrt(scaled)).alias("score"), "n1", "n2", "all1", "all2")


def changed(scored, limits, state, totals, method):
    """motif, m: matrices from the bases of the texts at the threshold or above; motifs without such texts in test and
    control aren't among them."""
    share = totals["len1"] / totals["len2"]
    kept = scored.join(limits.where("n1 > 0 and n2 > 0").select("motif", "threshold", "n1", "n2"), "motif").where("s >= threshold")
    base = kept.select("motif", "grp", "n", F.posexplode(F.split("match", "")).alias("p", "base"))
    of = lambda g, n: F.coalesce(F.sum(F.when(F.col("grp") == g, F.col("n"))), F.lit(0)).alias(n)
    counts = base.groupBy("motif", "p", (F.instr(F.lit("ACGT"), F.col("base")) - 1).alias("b")).agg(of("test", "f1"), of("ctrl", "f2"))
    grid = state.join(limits.where("n1 > 0 and n2 > 0").select("motif", "n1", "n2"), "motif").select("motif", "n1", "n2", F.posexplode("m").alias("p", "r")).select("motif", "n1", "n2", "p", F.posexplode("r").alias("b", "v"))
    cells = grid.join(counts, ["motif", "p", "b"], "left").fillna(0, ["f1", "f2"])
    if method == "regression":
        cells = cells.withColumn("y", F.log10(F.col("f1") / F.col("n1") + 0.01)).withColumn("x", F.log10(F.col("f2") / F.col("n2") + 0.01))
        line = cells.groupBy("motif").agg(F.coalesce(F.regr_slope("y", "x"), F.lit(0.0)).alias("slope"), F.avg("y").alias("my"), F.avg("x").alias("mx"))
        left = F.col("y") - (F.col("my") + F.col("slope") * (F.col("x") - F.col("mx")))
        cells = cells.join(line, "motif").withColumn("w", F.pow(F.lit(10.0), F.col("v") + 0.5 * left))
    else:
        lost = share * F.col("f2") if method == "difference" else F.lit(0.0)
        cells = cells.withColumn("w", F.greatest(F.lit(1.0), F.col("f1") - lost))
    weight = F.log10(4 * F.col("w") / F.sum("w").over(Window.partitionBy("motif", "p")))
    rows = cells.select("motif", "p", F.struct("b", weight.alias("x")).alias("c")).groupBy("motif", "p").agg(F.transform(F.sort_array(F.collect_list("c")), lambda c: c["x"]).alias("r"))
    return rows.groupBy("motif").agg(F.transform(F.sort_array(F.collect_list(F.struct("p", "r"))), lambda c: c["r"]).alias("m"))


def refine(seqs, motifs, totals, method="regression", turns=3, sub_turns=3, fp=5.0, settled=1e-6, folder=None):
    """(motifs, progress). motifs: motif, m (matrix of log-odds, at least 8 columns); totals: len1, len2 of enrich.lengths().

    motifs come back with threshold, freq, ratio and score; progress is motif, turn, sub_turn (from 1), n1, n2 (control
    scaled to the test's length), all1, all2, threshold. `turns` turns of `sub_turns` sub-turns, and one more turn for the
    thresholds alone. A motif without hits in test or control keeps its matrix, and one whose matrix moves by no more
    than `settled` in a turn isn't scanned again but at the end; no motifs give no rows. Matrices pass the driver in
    blocks, as wide_scan broadcasts them; each state is written to folder (below spark.checkpoint.dir by default).
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    folder = folder or shared_dir(seqs.sparkSession, "refine")
    seqs = seqs.select("seq_id", "grp", "u")
    none = F.lit(None).cast("double")
    state = saved(motifs.select("motif", "m", none.alias("threshold"), none.alias("freq"), none.alias("ratio"), none.alias("score"), F.lit(True).alias("moving")), folder, "state-0-0")
    progress, share = [], totals["len1"] / totals["len2"]
    for turn in range(1, turns + 2):
        last = turn == turns + 1
        before = state
        moving = state if last else state.where("moving")
        if moving.isEmpty():
            continue
        found = saved(texts(seqs, moving, fp), folder, f"texts-{turn}")
        for sub in range(1, 2 if last else sub_turns + 1):
            scored, limits = thresholds(found, state, totals, fp)
            limits = saved(limits, folder, f"limits-{turn}-{sub}")
            scaled = lambda c: F.floor(F.col(c) * share).cast("long").alias(c)
            progress.append(limits.select("motif", F.lit(turn).cast("long").alias("turn"), F.lit(sub).cast("long").alias("sub_turn"), "n1", scaled("n2"), "all1", scaled("all2"), "threshold"))
            new = limits.select("motif", *(F.col(c).cast("double").alias(f"_{c}") for c in STATE[2:]))
            rows = state.join(new, "motif", "left")
            if not last:
                rows = rows.join(changed(scored, limits, state, totals, method).withColumnRenamed("m", "_m"), "motif", "left")
            else:
                rows = rows.withColumn("_m", F.col("m"))
            # a row of this turn replaces the threshold and what goes with it, nulls included
            own = F.col("_threshold").isNotNull()
            state = saved(rows.select("motif", F.coalesce("_m", "m").alias("m"), *(F.when(own, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in STATE[2:]), "moving"), folder, f"state-{turn}-{sub}")
        if not last:
            old = before.select("motif", F.flatten("m").alias("_old"))
            shift = F.aggregate(F.zip_with(F.flatten("m"), "_old", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda a, x: F.greatest(a, x))
            state = saved(state.join(old, "motif").withColumn("moving", F.col("moving") & (shift > settled)).drop("_old"), folder, f"state-{turn}")
    kind = state.schema["motif"].dataType.simpleString()
    told = seqs.sparkSession.createDataFrame([], f"motif {kind}, turn long, sub_turn long, n1 long, n2 long, all1 long, all2 long, threshold double")
    for p in progress:
        told = told.unionByName(p)
    return state.select(*STATE), told
