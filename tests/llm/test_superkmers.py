"""Super-k-mers against all windows in memory."""

import hashlib
import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from strandlake.llm import superkmers

SCHEMA = "doc_id long, text string, runs int, _row int, bucket string"


def plain(rows, width):
    """rows: distinct (doc_id, text) in order of rank."""
    first, out = {}, {}
    texts = [(d, t, (t or "").encode().split()) for d, t in rows]
    for rank, (_, _, w) in enumerate(texts):
        for i in range(len(w) - width + 1):
            first.setdefault(tuple(w[i : i + width]), (rank, i))
    for rank, (d, t, w) in enumerate(texts):
        gone = set()
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] != (rank, i):
                gone.update(range(i, i + width))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out[d, t] = (d, len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def texts(seed, n=60):
    rng = random.Random(seed)
    words = ["a", "b", "é", "ß", "x.", " ", "c\x00d", "long" * 5]
    passage = [rng.choice(words) for _ in range(40)]
    out = [None, "", " \t", "a", "la " * 50, "la " * 51, " ".join(["a b"] * 30)]
    for _ in range(n):
        w = [rng.choice(words) for _ in range(rng.randrange(60))]
        at, cut = rng.randrange(len(w) + 1), sorted(rng.sample(range(41), 2))
        out.append(rng.choice([" ", "\n", "  "]).join([*w[:at], *passage[cut[0] : cut[1]], *w[at:]]))
    return out


@pytest.mark.parametrize(("width", "gram", "crowded"), [(5, 2, 4096), (5, 3, 3), (4, 4, 1), (6, 1, 2)])
def test_whole_query_is_all_windows(spark, monkeypatch, width, gram, crowded):
    """With and without buckets of single windows, repeated rows, clashing columns, hot passages."""
    monkeypatch.setattr(superkmers, "CROWDED", crowded)
    rows = [(i, t) for i, t in enumerate(texts(width * 10 + gram))]
    given = [(d, t, 1, 2, "x") for d, t in [*rows, *rows[::7]]]
    df = spark.createDataFrame(given, SCHEMA).repartition(6)
    want = plain(rows, width)
    got = superkmers.without_repeats(df, width=width, gram=gram)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", "spans"]
    assert sorted(tuple(r)[:4] for r in got.collect()) == sorted(want[r[:2]] for r in given)


def test_null_ids_come_first_and_texts_of_one_id_have_an_order(spark):
    same = " ".join(map(str, range(10)))
    df = spark.createDataFrame([(None, same), (1, same), (2, same + " x"), (2, "y " + same)], "doc_id long, text string")
    got = {(r["doc_id"], r["n_words"]): r["n_removed"] for r in superkmers.without_repeats(df, width=5, gram=2).where("doc_id is null or doc_id = 1").collect()}
    assert got == {(None, 10): 0, (1, 10): 10}
    again = [r["n_removed"] for r in superkmers.without_repeats(df, width=5, gram=2).where("doc_id = 2").collect()]
    assert again == [10, 10]


def test_no_rows_and_string_ids(spark):
    assert superkmers.without_repeats(spark.createDataFrame([], SCHEMA)).collect() == []
    df = spark.createDataFrame([("b", "1 2 3 4 5"), ("a", "0 1 2 3 4 5")], "doc_id string, text string")
    assert {r["doc_id"]: r["kept_text"] for r in superkmers.without_repeats(df, width=4, gram=2).collect()} == {"a": "0 1 2 3 4 5", "b": ""}


def test_pieces_of_long_texts_hold_each_window_once(monkeypatch):
    monkeypatch.setattr(superkmers, "PIECE", 50)
    words = [str(i).encode() for i in range(300)]
    raw, width = b"  ".join(words), 7
    seen = [(first + i, tuple(found[i : i + width])) for first, found in superkmers.pieces(raw, width) for i in range(len(found) - width + 1)]
    assert seen == [(i, tuple(words[i : i + width])) for i in range(300 - width + 1)]


def test_equal_windows_have_equal_minimisers():
    rng = random.Random(3)
    words = [rng.choice([b"a", b"b", b"c"]) for _ in range(3000)]
    first, last, mini = superkmers.superkmers(words, np.zeros(len(words), int), 6, 2)
    by = {}
    for f, t, m in zip(first.tolist(), last.tolist(), mini.tolist(), strict=True):
        for i in range(f, t + 1):
            assert by.setdefault(tuple(words[i : i + 6]), m) == m
    assert sum(last - first + 1) == 2995


def test_crowded_minimisers_are_few(spark, monkeypatch):
    monkeypatch.setattr(superkmers, "CROWDED", 3)
    monkeypatch.setattr(superkmers, "MOST_CROWDED", 5)
    df = spark.createDataFrame([(i, i) for i in range(2, 40)], "minimiser long, times long")
    bitmap, crowded = superkmers.filtered(df)
    assert 0 < len(crowded) <= 5 and set(crowded.tolist()) == set(range(40 - len(crowded), 40))
    assert all(int(bitmap[i >> 6]) >> (i & 63) & 1 for i in range(2, 40))


@pytest.mark.parametrize("crowd", [False, True])
def test_small_chunks_and_little_memory_change_nothing(monkeypatch, crowd):
    monkeypatch.setattr(superkmers, "HELD", 3)
    monkeypatch.setattr(superkmers, "CHUNK", 10)
    width, gram, rows = 5, 2, [(i, t) for i, t in enumerate(texts(9))]
    batch = pa.record_batch([pa.array([d for d, _ in rows]), pa.array([t for _, t in rows]), pa.array([0] * len(rows))], names=["_id", "_text", "_row"])
    mini = np.unique(np.concatenate([x.column(0).to_numpy() for x in superkmers.counts(width, gram)([batch])]))
    shared = SimpleNamespace(value=(np.full(16, ~np.uint64(0)), mini[::2] if crowd else mini[:0]))
    going = pa.Table.from_batches(superkmers.travel(width, gram, shared)([batch])).sort_by("bucket")
    runs = {}
    for b in superkmers.count_windows(width)(going.to_batches(max_chunksize=7)):
        for i, at in zip(b.column("_id").to_pylist(), b.column("at").to_pylist(), strict=True):
            runs.setdefault(i, []).append(at)
    cut = pa.record_batch([batch.column("_id"), batch.column("_text"), pa.array([runs.get(d) for d, _ in rows], pa.list_(pa.int64()))], names=["_id", "_text", "runs"])
    (out,) = superkmers.cut(width)([cut])
    want = plain(rows, width)
    assert [*zip(*(out.column(c).to_pylist() for c in ("_id", "n_words", "n_removed", "kept_sha256")), strict=True)] == [want[r] for r in rows]
