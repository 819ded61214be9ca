"""The refinement loop against plain code."""

import math

import numpy as np
import pytest

from strandlake.operators import refine

COMPLEMENT = str.maketrans("ACGT", "TGCA")


def scanned(rows, m, least):
    """[(group, text along the motif)]."""
    out, width = [], len(m)
    for grp, s in rows:
        for i in range(len(s) - width + 1):
            w = s[i : i + width]
            if "N" not in w:
                for t in (w, w[::-1].translate(COMPLEMENT)):
                    if round(sum(m[j]["ACGT".index(c)] for j, c in enumerate(t)), 6) >= least:
                        out.append((grp, t))
    return out


def plain(rows, motifs, len1, len2, method, turns, sub_turns, fp):
    m = {k: np.array(v) for k, v in motifs.items()}
    rank, progress, moving, told = math.floor(len2 * fp / 10000), [], set(m), {}
    for turn in range(1, turns + 2):
        last = turn == turns + 1
        for k in sorted(m if last else moving):
            old, hits = m[k].copy(), scanned(rows, m[k].tolist(), refine.chance_threshold(m[k].tolist(), fp))
            for sub in range(1, 2 if last else sub_turns + 1):
                scores = [round(sum(m[k][j]["ACGT".index(c)] for j, c in enumerate(t)), 6) for _, t in hits]
                control = sorted((s for s, (g, _) in zip(scores, hits, strict=True) if g == "ctrl"), reverse=True)
                if not control:
                    break
                r = min(rank, len(control) - 1)
                least = control[r]
                up = [(g, t) for s, (g, t) in zip(scores, hits, strict=True) if s >= least]
                n1, n2 = sum(g == "test" for g, _ in up), sum(g == "ctrl" for g, _ in up)
                all1 = len(hits) - len(control)
                progress.append((k, turn, sub, n1, math.floor(n2 * len1 / len2), all1, math.floor(len(control) * len1 / len2), least))
                scaled = math.floor(r * len1 / len2)
                told[k] = (least, float(n1 - scaled), n1 / scaled if scaled else None, (n1 - scaled) / math.sqrt(scaled) if scaled else None)
                if last or not n1:
                    continue
                f1, f2 = np.zeros_like(m[k]), np.zeros_like(m[k])
                for g, t in up:
                    for j, c in enumerate(t):
                        (f1 if g == "test" else f2)[j, "ACGT".index(c)] += 1
                if method == "regression":
                    y, x = np.log10(f1 / n1 + 0.01), np.log10(f2 / n2 + 0.01)
                    spread = ((x - x.mean()) ** 2).sum()
                    slope = ((x - x.mean()) * (y - y.mean())).sum() / spread if spread else 0.0
                    w = 10 ** (m[k] + 0.5 * (y - (y.mean() + slope * (x - x.mean()))))
                else:
                    w = np.maximum(1, f1 - (len1 / len2 * f2 if method == "difference" else 0))
                m[k] = np.log10(4 * w / w.sum(axis=1, keepdims=True))
            if not last and abs(m[k] - old).max() <= 1e-6:
                moving.discard(k)
    return m, told, progress


@pytest.mark.parametrize("method", refine.METHODS)
def test_the_loop_is_plain_code(spark, method):
    """A planted motif, one that is in no sequence, and one that finds nothing in the control."""
    rng = np.random.default_rng(8)
    site, rows = "ACGGTTCAAG", []
    for k in range(40):
        s = "".join(rng.choice(list("ACGTN"), 90, p=[0.25, 0.24, 0.24, 0.25, 0.02]))
        if k % 2 == 0:
            own = "".join(c if rng.random() > 0.15 else rng.choice(list("ACGT")) for c in site)
            s = s[:30] + (own if k % 4 else own[::-1].translate(COMPLEMENT)) + s[40:]
        rows.append(("test" if k % 2 == 0 else "ctrl", s))
    motif = lambda t, x: [[math.log10(4 * (x if c == b else (1 - x) / 3)) for b in "ACGT"] for c in t]
    motifs = {"planted": motif(site, 0.5), "chance": motif("TTTTGCGCA", 0.45), "none": motif("ACGT" * 6, 0.97)}
    len1, len2 = (sum(len(s.replace("N", "")) for g, s in rows if g == x) for x in ("test", "ctrl"))
    seqs = spark.createDataFrame([(k, g, s) for k, (g, s) in enumerate(rows)], "seq_id long, grp string, u string")
    table = spark.createDataFrame([*motifs.items()], "motif string, m array<array<double>>").selectExpr("cast(case motif when 'planted' then 1 when 'chance' then 2 else 3 end as long) as motif", "m")
    named = {1: motifs["planted"], 2: motifs["chance"], 3: motifs["none"]}
    want, told, progress = plain(rows, named, len1, len2, method, 2, 2, 20.0)
    got, seen = refine.refine(seqs, table, {"len1": len1, "len2": len2}, method, turns=2, sub_turns=2, fp=20.0)
    assert sorted((*tuple(r)[:-1], pytest.approx(r["threshold"], abs=2e-6)) for r in seen.collect()) == sorted(progress)
    rows_ = {r["motif"]: r for r in got.collect()}
    assert len(rows_) == 3 and 1 in told
    for k, r in rows_.items():
        assert np.allclose(r["m"], want[k], atol=1e-6)
        assert (r["threshold"] is None) == (k not in told)
        if k in told:
            assert [r["freq"], r["ratio"], r["score"]] == [x if x is None else pytest.approx(x) for x in told[k][1:]]
    if method == "difference":  # the planted site comes out
        assert "".join("ACGT"[int(np.argmax(c))] for c in rows_[1]["m"]) == site


def test_no_motifs_and_unknown_methods(spark):
    seqs = spark.createDataFrame([(0, "test", "ACGTACGTACGT")], "seq_id long, grp string, u string")
    none = spark.createDataFrame([], "motif long, m array<array<double>>")
    got, progress = refine.refine(seqs, none, {"len1": 12, "len2": 12}, turns=1)
    assert got.collect() == [] and progress.collect() == []
    with pytest.raises(ValueError, match="method"):
        refine.refine(seqs, none, {"len1": 1, "len2": 1}, "other")
