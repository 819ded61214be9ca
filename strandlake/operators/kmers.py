"""Counting words (k-mers, also spaced) over sequences."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..functions.seq import code_word

CODES = np.full(256, 4, np.int64)
for _i, _c in enumerate(b"ACGT"):
    CODES[_c] = _i

COUNTS = "grp string, gap int, code long, n long, nn long, docs long, n_all long"


def templates(length=8):
    """[(gap, span, [(start, length)])]: one block; two halves 1 to 5 apart; three blocks 1 to 3 apart."""
    half, third = length // 2, length // 3
    out = [(0, length, [(0, length)])]
    out += [(g, length + g, [(0, half), (half + g, length - half)]) for g in range(1, 6)]
    middle = length - 2 * third
    return out + [(5 + d, length + 2 * d, [(0, third), (third + d, middle), (third + 2 * d + middle, third)]) for d in range(1, 4)]


def window_codes(seq, span, parts):
    """(starts, codes) of the windows that hold no missing base anywhere in their span."""
    bases = CODES[np.frombuffer(seq.encode(), np.uint8)]
    n = len(bases) - span + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    missing = np.concatenate([[0], np.cumsum(bases > 3)])
    codes, power = np.zeros(n, np.int64), 1
    for start, size in parts:
        for j in range(start, start + size):
            codes += bases[j : j + n] * power
            power *= 4
    at = np.flatnonzero(missing[span:] == missing[:-span])
    return at, codes[at]


def apart(at, codes, span):
    """(distinct codes, all occurrences, occurrences left to right that don't overlap an earlier counted one)."""
    order = np.argsort(codes, kind="stable")
    at, codes = at[order], codes[order]
    own, first, n = np.unique(codes, return_index=True, return_counts=True)
    kept = n.copy()
    close = (codes[1:] == codes[:-1]) & (at[1:] - at[:-1] < span)
    for k in np.unique(np.searchsorted(own, codes[1:][close])).tolist():
        last, kept[k] = -span, 0
        for p in at[first[k] : first[k] + n[k]].tolist():
            if p >= last + span:
                kept[k] += 1
                last = p
    return own, n, kept


def ranks(length):
    """Place in the alphabet of each code's word, and the code of its reverse complement."""
    codes = np.arange(4**length)
    digits = [(codes >> (2 * j)) & 3 for j in range(length)]
    return sum(d * 4 ** (length - 1 - j) for j, d in enumerate(digits)), sum((3 - d) * 4 ** (length - 1 - j) for j, d in enumerate(digits))


def count_words(seqs, length=8, gaps=(0,), fold=False):
    """(grp, gap, word, n, nn, docs, n_all): over all sequences of a group, the occurrences of each word that don't
    overlap an earlier one (n), the sum of squares of those by sequence, the sequences that have it, all occurrences.

    seqs: grp, u (upper-case bases). fold: a word and its reverse complement count as the lesser of both. Each task adds
    up its sequences in arrays of 4**length places a group and template, so what is shuffled are words, not windows.
    Null and short sequences have no words.
    """
    chosen = [t for t in templates(length) if t[0] in gaps]

    def run(batches):
        sums, canon = {}, None
        if fold:
            rank, other = ranks(length)
            canon = np.where(rank <= rank[other], np.arange(4**length), other)
        for b in batches:
            for grp, seq in zip(b.column("grp").to_pylist(), b.column("u").to_pylist(), strict=True):
                for gap, span, parts in chosen if seq else ():
                    own, n_all, n = apart(*window_codes(seq, span, parts), span)
                    if fold and len(own):
                        own, at = np.unique(canon[own], return_inverse=True)
                        n, n_all = np.bincount(at, n).astype(np.int64), np.bincount(at, n_all).astype(np.int64)
                    if (grp, gap) not in sums:
                        sums[grp, gap] = np.zeros((4, 4**length), np.int64)
                    for k, v in enumerate((n, n * n, 1, n_all)):
                        sums[grp, gap][k, own] += v
        for (grp, gap), x in sums.items():
            code = np.flatnonzero(x[3])
            cols = [pa.array([grp] * len(code), pa.string()), pa.array(np.full(len(code), gap, np.int32)), pa.array(code), *(pa.array(x[k, code]) for k in range(4))]
            yield pa.record_batch(cols, names=["grp", "gap", "code", "n", "nn", "docs", "n_all"])

    parts = seqs.select("grp", "u").mapInArrow(run, COUNTS)
    sums = parts.groupBy("grp", "gap", "code").agg(*(F.sum(c).alias(c) for c in ("n", "nn", "docs", "n_all")))
    return sums.select("grp", F.col("gap").cast("long").alias("gap"), code_word(F.col("code"), length).alias("word"), "n", "nn", "docs", "n_all")


def pivot_groups(counts, test="test", control="ctrl", measure="n"):
    """(gap, word, x, y): a word's measure in test and control, 0 where it is missing."""
    of = lambda g: F.coalesce(F.sum(F.when(F.col("grp") == g, F.col(measure))), F.lit(0)).cast("long")
    return counts.groupBy("gap", "word").agg(of(test).alias("x"), of(control).alias("y"))
