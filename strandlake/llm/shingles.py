"""Word shingles of whole texts as sets of 64-bit hashes, and their one-permutation MinHash signatures."""

import hashlib

import numpy as np
import xxhash

EMPTY = np.empty(0, np.uint64)
MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def mix(x):
    """The finaliser of splitmix64, on arrays."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(raw, k):
    """Sorted hashes of the distinct k-word shingles of UTF-8 bytes; words are runs without [\\x20\\x09-\\x0D], A-Z in
    lower case. Fewer words than k are one shingle, none are the empty set."""
    words = raw.lower().split()
    if not words:
        return EMPTY
    own = np.array(list(map(xxhash.xxh3_64_intdigest, words)), np.uint64)
    n = max(1, len(own) - k + 1)
    out = np.full(n, min(len(own), k), np.uint64)
    for i in range(min(k, len(own))):
        out = mix(out * MULTIPLY + own[i : i + n])
    return np.unique(out)


def digest(own):
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def probes(bins, seed=5, turns=64):
    """For each turn, the bin that an empty bin asks for a value; the same for every set."""
    return np.random.default_rng(seed).integers(0, bins, (turns, bins))


def signature(own, bins, table):
    """One-permutation MinHash of a non-empty set: the least hash in each of `bins` ranges, empty bins filled by
    optimal densification: each asks bins by its own random sequence until one is filled."""
    width = 64 - int(bins).bit_length() + 1
    at = np.searchsorted(own, np.arange(bins, dtype=np.uint64) << np.uint64(width))
    first = own[np.minimum(at, len(own) - 1)]
    full = (at < len(own)) & ((first >> np.uint64(width)) == np.arange(bins, dtype=np.uint64))
    out, empty = first, np.flatnonzero(~full)
    for turn in table:
        if not len(empty):
            break
        asked = turn[empty]
        got = full[asked]
        out[empty[got]] = first[asked[got]]
        empty = empty[~got]
    if len(empty):  # no turn helped: the first filled bin
        out[empty] = first[np.flatnonzero(full)[0]]
    return out


def bands(signature, rows):
    """One hash for each band of `rows` bins, of the band's number and values."""
    parts = signature.reshape(-1, rows)
    out = np.arange(len(parts), dtype=np.uint64) + np.uint64(1)
    for i in range(rows):
        out = mix(out * MULTIPLY + parts[:, i])
    return out.view(np.int64)


def linked(a, b, percent):
    """Whether 100 * intersection >= percent * union of two sorted sets of distinct hashes."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    same = int((both[1:] == both[:-1]).sum())
    return 100 * same >= percent * (len(a) + len(b) - same)
