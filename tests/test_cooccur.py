"""Alignment by co-occurrence against Kruskal's forest in memory, and planted clusters of hits."""

import random

import pytest

from strandlake.operators import cooccur

LINKS = "m1 string, m2 string, dir long, gap long, n long, share double"


def put(d, p, own, other, dir_, gap, ahead):
    """Direction and place of the other end of a link."""
    if ahead:
        return d * dir_, p + gap if d == 1 else p + own - other - gap
    new = d * dir_
    return new, p - gap if new == 1 else p + own - other + gap


def plain(links, lengths):
    part, tree = {m: m for x in links for m in x[:2]}, {}
    for m1, m2, dir_, gap, _, _ in sorted((x for x in links if x[0] != x[1]), key=lambda x: (-x[5], *x[:4])):
        if part[m1] != part[m2]:
            old = part[m2]
            part = {k: part[m1] if v == old else v for k, v in part.items()}
            tree.setdefault(m1, []).append((m2, dir_, gap, True))
            tree.setdefault(m2, []).append((m1, dir_, gap, False))
    out = set()
    for name in {min(k for k, v in part.items() if v == r) for r in part.values()}:
        seen, todo = {name: (1, 0)}, [name]
        while todo:
            a = todo.pop()
            for b, dir_, gap, ahead in tree.get(a, ()):
                if b not in seen:
                    seen[b] = put(*seen[a], lengths[a], lengths[b], dir_, gap, ahead)
                    todo.append(b)
        low = min(p for _, p in seen.values())
        if len(seen) > 1:
            out |= {(name, m, d, p - low) for m, (d, p) in seen.items()}
    return out


@pytest.mark.parametrize(("n", "m"), [(40, 50), (60, 300), (64, 0)])
def test_alignment_is_the_strongest_forest(spark, n, m):
    """Random links that disagree, ties of share, motifs of different lengths; or one long chain (m = 0)."""
    rng = random.Random(n)
    names = [f"m{k:02d}" for k in range(n)]
    rng.shuffle(names)
    lengths = {x: rng.choice([6, 8, 11]) for x in names}
    pairs = [tuple(sorted(rng.sample(names, 2))) for _ in range(m)] or [tuple(sorted(x)) for x in zip(names, names[1:], strict=False)]
    links = [(a, b, rng.choice([1, -1]), rng.randrange(-20, 20), 5, rng.choice([0.1, 0.2, 0.5, rng.random()])) for a, b in pairs] + [("m00", "m00", 1, 3, 9, 1.0)]
    links = list({x[:4]: x for x in links}.values())
    got = cooccur.align(spark.createDataFrame(links, LINKS), spark.createDataFrame([*lengths.items()], "motif string, len long"))
    assert {(r["cluster"], r["motif"], r["dir"], r["place"]) for r in got.collect()} == plain(links, lengths)


def test_planted_clusters_are_recovered(spark):
    """Motifs at fixed places on either strand, with others at random: places, and the one distance that they don't explain."""
    rng, rows = random.Random(5), []
    parts = [("a", 0, 1, 8), ("b", 11, -1, 8), ("c", 23, 1, 8)]
    for k in range(60):
        at, turned = rng.randrange(100, 3000), k % 2
        for motif, place, dir_, n in parts if k % 5 else [("a", 0, 1, 8), ("c", 40, 1, 8)]:
            strand = dir_ if not turned else -dir_
            rows.append((motif, k, "+" if strand == 1 else "-", n, at + place if not turned else at + 60 - place - n))
        rows.append((rng.choice("xyz"), k, rng.choice("+-"), 8, rng.randrange(5000)))
    hits = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "motif string, seq_id long, strand string, len long, start long, event_id long")
    found = cooccur.offsets(hits)
    got = cooccur.align(found, spark.createDataFrame([(m, 8) for m in "abcxyz"], "motif string, len long"))
    assert {(r["cluster"], r["motif"], r["dir"], r["place"]) for r in got.collect()} == {("a", "a", 1, 0), ("a", "b", -1, 11), ("a", "c", 1, 23)}
    left = cooccur.unexplained(found, got).collect()
    assert [(r["m1"], r["m2"], r["dir"], r["gap"], r["n"]) for r in left] == [("a", "c", 1, 40, 12)]


def test_no_links(spark):
    none = spark.createDataFrame([], LINKS)
    lengths = spark.createDataFrame([("a", 8)], "motif string, len long")
    assert cooccur.align(none, lengths).collect() == [] and cooccur.unexplained(none, cooccur.align(none, lengths)).collect() == []


def test_word_hits_on_both_strands(spark):
    seqs = spark.createDataFrame([(7, "GATTACAGNCTGTAATCACGTACGT"), (8, None)], "seq_id long, u string")
    got = cooccur.word_hits(seqs, ["CTGTAATC", "ACGTACGT"])
    assert sorted((r["motif"], r["seq_id"], r["strand"], r["start"]) for r in got.collect()) == [("ACGTACGT", 7, "+", 17), ("CTGTAATC", 7, "+", 9), ("CTGTAATC", 7, "-", 0)]
