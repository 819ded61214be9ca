"""The Merkle manifest against a plain tree in memory."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from strandlake.llm import merkle


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(nodes, arity):
    """(root, steps of each leaf: (elder siblings, younger siblings))."""
    steps, places = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, held = [], []
        for at in range(0, len(nodes), arity):
            run = nodes[at : at + arity]
            for i in range(len(run)):
                for leaf in places[at + i]:
                    steps[leaf].append((run[:i], run[i + 1 :]))
            up.append(h(run))
            held.append([x for p in places[at : at + arity] for x in p])
        nodes, places = up, held
    return (nodes[0] if nodes else None), steps


def leaf(row, lower=False):
    text = row["text"]
    if lower and text is not None:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return h("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def plain(rows, arity, bad):
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append(r)
    out, subs, own = [], [], []
    for s in sorted(groups, key=lambda s: (s is not None, (s or "").encode())):
        g = sorted(groups[s], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        root, steps = tree([leaf(r) for r in g], arity)
        subs.append(root)
        own.append((g, steps))
    root, above = tree(subs, arity)
    for (g, steps), sub, up in zip(own, subs, above, strict=True):
        for r, path in zip(g, steps, strict=True):
            node, proof = leaf(r, bad(r)), []
            for left, right in path + up:
                proof += left + right
                node = h([*left, node, *right])
            out.append((r["doc_id"], leaf(r), sub, root, h(proof), node, node == root))
    return sorted(map(repr, out))


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, digest string, tree int, rank int"


def rows(n, sources, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        text = rng.choice([None, "", "Aé " * rng.randrange(5), "THE end", "x" * rng.randrange(300)])
        out.append({"doc_id": rng.choice([None, i, i, i, 7]), "source": rng.choice(sources), "lang": rng.choice([None, "en"]), "n_chars": rng.choice([None, 3]), "text": text, "digest": "d", "tree": 1, "rank": 2})
    return out + out[:3]


@pytest.mark.parametrize(("n", "sources", "arity", "height"), [(150, [None, "", "a", "é", "b"], 3, 2), (90, ["a"], 2, 1), (65, ["a", "a", "a", None], 16, 1), (1, ["a"], 16, 3), (40, [str(x) for x in range(30)], 3, 2)])
def test_manifest_is_the_plain_tree(spark, n, sources, arity, height):
    """Nulls, repeated ids and rows, clashing columns, blocks that end inside runs."""
    given = rows(n, sources, n)
    df = spark.createDataFrame([tuple(r.values()) for r in given], SCHEMA).repartition(5)
    bad = F.col("doc_id") % 2 == 0
    got = merkle.manifest(df, tampered=bad, arity=arity, height=height)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(repr(tuple(r)) for r in got.collect()) == plain(given, arity, lambda r: r["doc_id"] is not None and r["doc_id"] % 2 == 0)


def test_no_rows(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_string_ids_and_own_fields(spark):
    df = spark.createDataFrame([("b", "x", "s"), ("a", "y", "s")], "k string, body string, site string")
    got = {r["k"]: r for r in merkle.manifest(df, fields=("k", "body"), id_col="k", tree_col="site", text_col="body").collect()}
    a, b = h(["1:a", "1:y"]), h(["1:b", "1:x"])
    assert got["a"]["leaf"] == a and got["b"]["root"] == h([a, b]) and got["a"]["proof_sha256"] == h([b]) and got["b"]["verified"]


def test_any_later_sibling_extends_a_witness():
    """A partial witness folds to the root only once all later siblings have come."""
    top = merkle.Appender(4)
    for i in range(3):
        top.append(h([str(i)]).encode(), i)
    assert [len(w) for w in top.open[0][1]] == [2, 2, 2]
    top.append(h(["3"]).encode(), 3)
    root, found = top.close(1, True)
    assert [m for m, _ in found] == [0, 1, 2, 3]
    assert all(merkle.folded(h([str(m)]).encode(), steps) == root for m, steps in found)
