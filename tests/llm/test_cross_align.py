"""Alignment of two tokenizers against plain code over the untouched libraries."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from strandlake.llm import cross_align, tokens

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def spelled(text):
    """Ids and bytes of both sides, by the libraries."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    letters = {v: k for k, v in tokens.byte_letters().items()}
    a_ids, b_ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    a_bytes = [bytes(letters[c] for c in a.id_to_token(i)) for i in a_ids]
    b_bytes = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in b_ids]
    return a_ids, a_bytes, b_ids, b_bytes


def aligned(text):
    """(A ids, B ids, groups, linked pairs) or None."""
    if not text:
        return None
    a_ids, a_bytes, b_ids, b_bytes = spelled(text)
    if not b"".join(a_bytes) == b"".join(b_bytes) == f" {text}".encode():
        return None
    spans = []
    for parts in (a_bytes, b_bytes):
        ends = np.cumsum([len(x) for x in parts]).tolist()
        spans.append([*zip([0, *ends[:-1]], ends, strict=True)])
    links = [(a, b) for a, (s, e) in zip(a_ids, spans[0], strict=True) for b, (x, y) in zip(b_ids, spans[1], strict=True) if s < y and x < e]
    cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
    groups = []
    for low, high in zip([0, *cuts[:-1]], cuts, strict=True):
        sides = [",".join(str(i) for i, (s, e) in zip(ids, own, strict=True) if low <= s and e <= high) for ids, own in ((a_ids, spans[0]), (b_ids, spans[1]))]
        groups.append("|".join(sides))
    return a_ids, b_ids, groups, links


def plain(rows):
    found = [(d, aligned(t)) for d, t in rows]
    counts = Counter(x for _, f in found if f for x in f[3])
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    out = []
    for d, f in found:
        if f is None:
            out.append((d, 0, 0, 0, 0, 0, 0, ""))
            continue
        a_ids, b_ids, groups, links = f
        n_best = sum(counts[x] == best[x[1]] for x in links)
        out.append((d, len(a_ids), len(b_ids), len(groups), len(links), n_best, sum(counts[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return sorted(map(repr, out))


def texts(n, seed):
    rng = random.Random(seed)
    parts = ["the", " of", "ing", "  ", "\n", "\n ", "\t", "é", "漢字", "😀", "<|endoftext|>", "<s>", "</s>", "1", "234", "x", "'s", "’", "\x00", "\r\n", " a ", "straße", "Überflüssig", ".", "-----", "    "]
    return [None, "", " ", "\n", "▁a", "a▁", *("".join(rng.choice(parts) for _ in range(rng.randrange(1, 30))) for _ in range(n)), "word another " * 300]


SCHEMA = "doc_id long, text string, n_a int, pairs int, _row int"
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("most", [1 << 19, 20, 0])
def test_whole_query_is_plain_code(spark, most):
    """All counts in every task, some of them, none; repeated rows, null ids, clashing columns."""
    rows = [(i if i % 9 else None, t) for i, t in enumerate(texts(80, 1))]
    rows += rows[:5]
    df = spark.createDataFrame([(d, t, 1, 2, 3) for d, t in rows], SCHEMA).repartition(4)
    got = cross_align.cross_align(df, A, B, most=most)
    assert got.columns == COLUMNS
    assert sorted(repr(tuple(r)) for r in got.collect()) == plain(rows)


def test_groups_are_told_if_asked_for(spark):
    df = spark.createDataFrame([(1, "unbelievable things, naïve"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["groups"] for r in cross_align.cross_align(df, A, B, groups=True).collect()}
    assert got == {1: ";".join(aligned("unbelievable things, naïve")[2]), 2: None}


def test_no_rows(spark):
    assert cross_align.cross_align(spark.createDataFrame([], SCHEMA), A, B).collect() == []


def test_words_are_encoded_as_whole_texts():
    own, library = cross_align.Pieces(B, keep=50), sentencepiece.SentencePieceProcessor(model_file=B)
    assert own.apart
    for at in range(0, 400, 40):
        some = [t for t in texts(400, 2)[at : at + 40] if t and "▁" not in t]
        assert [np.frombuffer(x, "<u2").tolist() for x in own.encode(some)] == library.encode(some)


@pytest.mark.parametrize("lane", [1, 3, 256])
def test_lanes_change_nothing(monkeypatch, lane):
    monkeypatch.setattr(cross_align, "LANE", lane)
    monkeypatch.setattr(cross_align, "NEAR", 2)
    rng = np.random.default_rng(lane)
    for _ in range(30):
        lengths, a_end, b_end, starts = rng.integers(1, 60, 5), [], [], []
        for n in lengths:
            base = a_end[-1] if a_end else 0
            starts.append(len(a_end))
            for ends in (a_end, b_end):
                ends += [base + x for x in sorted({n, *rng.integers(1, n + 1, 25).tolist()})]
        a_end, b_end = np.array(a_end), np.array(b_end)
        a_link, b_link, a_cut, b_cut = cross_align.merge(a_end, b_end, np.array(starts))
        a_begin, b_begin = np.append(0, a_end[:-1]), np.append(0, b_end[:-1])
        want = {(i, j) for i in range(len(a_end)) for j in range(len(b_end)) if a_begin[i] < b_end[j] and b_begin[j] < a_end[i]}
        assert len(a_link) == len(want) and {*zip(a_link.tolist(), b_link.tolist(), strict=True)} == want
        assert a_end[a_cut].tolist() == b_end[b_cut].tolist() == sorted({*a_end.tolist()} & {*b_end.tolist()})


@pytest.mark.parametrize("plain", [True, False])
def test_byte_level_ids_are_the_librarys(plain):
    own, library = tokens.ByteLevel(A, plain), Tokenizer.from_file(A)
    library.encode_special_tokens = plain
    some = [t for t in texts(2000, 3) if t] + [" " * 200_000, "a" * 100_000, "x" + "\n" * 50_000 + "y"]
    assert [np.frombuffer(own.encode(" " + t), "<u2").tolist() for t in some] == [x.ids for x in library.encode_batch([" " + t for t in some], add_special_tokens=False)]
    assert [own.ids(t) for t in some[:500]] == [x.ids for x in library.encode_batch(some[:500], add_special_tokens=False)]
