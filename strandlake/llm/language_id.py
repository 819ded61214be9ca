"""Language identification with hyperdimensional n-gram profiles.

Each letter has a random vector of +1 and -1, drawn from its code point. An n-gram is bound by permuting the vector of each
letter by its place and multiplying; a text bundles its n-grams by adding them up. Languages have the bundle of their
texts as prototype, and a text gets the language with the largest cosine.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from . import common as C
from .shingles import mix

POINT = 21  # bits of a code point
ROWS = 128  # texts whose n-grams are bound together
BOUND = 1 << 10  # n-grams bound at once

_tables = {}


def symbols():
    """Symbol of each code point of the basic plane: the letter in lower case, 0 for what is no letter."""
    if "symbols" not in _tables:
        _tables["symbols"] = np.array([symbol(x) for x in range(1 << 16)], np.int64)
    return _tables["symbols"]


def symbol(point):
    c = chr(point)
    return ord(c.lower()[0]) if c.isalpha() else 0


def vectors(points, dimensions, seed):
    """Rows of +1 and -1: 64 of them from each hash of the code point, the seed and a counter."""
    words = -(-dimensions // 64)
    hashes = mix(mix(points.astype(np.uint64) + np.uint64(seed << 32))[:, None] + np.arange(1, words + 1, dtype=np.uint64))
    return np.unpackbits(hashes.view(np.uint8), axis=1)[:, :dimensions].astype(np.float32) * 2 - 1


def grams(text, n):
    """(codes, counts) of the text's n-grams over symbols; runs without letters are one break; empty without letters."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    own = symbols()[np.minimum(points, 0xFFFF)]
    if (high := points > 0xFFFF).any():
        own[high] = [symbol(x) for x in points[high].tolist()]
    if not own.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    own = np.concatenate([[0], own, [0]])
    own = own[np.append(True, (own[1:] != 0) | (own[:-1] != 0))]
    if len(own) < n:
        own = np.append(own, np.zeros(n - len(own), np.int64))
    codes = own[: len(own) - n + 1].copy()
    for k in range(1, n):
        codes = (codes << POINT) | own[k : len(own) - n + 1 + k]
    return np.unique(codes, return_counts=True)


def bind(codes, n, dimensions, seed):
    """The product of the letters' vectors, the k-th letter's rotated by n - 1 - k places."""
    out = None
    for k in range(n):  # from the last letter on
        points, at = np.unique((codes >> (POINT * k)) & ((1 << POINT) - 1), return_inverse=True)
        own = np.roll(vectors(points, dimensions, seed), k, axis=1)[at]
        out = own if out is None else np.multiply(out, own, out=out)
    return out


def bundles(texts, n, dimensions, seed):
    """One vector a text, zero without letters."""
    out = np.zeros((len(texts), dimensions), np.float32)
    for at in range(0, len(texts), ROWS):
        own = [grams(x, n) for x in texts[at : at + ROWS]]
        codes, place = np.unique(np.concatenate([c for c, _ in own]), return_inverse=True)
        if not len(codes):
            continue
        counts = np.zeros((len(own), len(codes)), np.float32)
        counts[np.repeat(np.arange(len(own)), [len(c) for c, _ in own]), place] = np.concatenate([c for _, c in own])
        for k in range(0, len(codes), BOUND):
            out[at : at + ROWS] += counts[:, k : k + BOUND] @ bind(codes[k : k + BOUND], n, dimensions, seed)
    return out


def learn(n, dimensions, seed):
    def run(batches):
        sums, texts = {}, {}
        for b in C.slices(batches):
            held = {}
            for lang, text in zip(b.column("_lang").to_pylist(), C.strings(b.column("_text")), strict=True):
                held.setdefault(lang, []).append(text)
            for lang, own in held.items():
                for at in range(0, len(own), 4 * ROWS):
                    sums[lang] = sums.get(lang, 0) + bundles(own[at : at + 4 * ROWS], n, dimensions, seed).sum(axis=0, dtype=np.float64)
                texts[lang] = texts.get(lang, 0) + len(own)
        keys = list(sums)
        yield pa.record_batch([pa.array(keys, pa.string()), pa.array([texts[k] for k in keys], pa.int64()), pa.array([sums[k] for k in keys], pa.list_(pa.float64()))], names=["lang", "n", "sums"])

    return run


def fit(labelled, lang_col="lang", text_col="text", n=3, dimensions=1024, seed=7):
    """{"langs", "prototypes", ...} from every row with a language and a text; n is at most 3, three code points in a long.

    Each task adds up its own texts and returns one row a language; those rows are summed by language and place, so
    what reaches the driver is one vector of `dimensions` for each language.
    """
    rows = C.pick(labelled, _lang=lang_col, _text=text_col).where("_lang is not null and _text is not null")
    parts = rows.mapInArrow(learn(n, dimensions, seed), "lang string, n long, sums array<double>")
    sums = parts.select("lang", F.posexplode("sums").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    got = sorted((r["lang"], r["v"]) for r in sums.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v")).collect())
    prototypes = np.array([v for _, v in got]).reshape(len(got), dimensions)
    size = np.linalg.norm(prototypes, axis=1, keepdims=True)
    return {"langs": [k for k, _ in got], "prototypes": (prototypes / np.where(size == 0, 1, size)).astype(np.float32), "n": n, "dimensions": dimensions, "seed": seed}


def predict(texts, model):
    """[(language or 'und', cosine from 0 to 1)]; ties go to the language first in the alphabet."""
    if not model["langs"]:
        return [("und", 0.0)] * len(texts)
    x = bundles(texts, model["n"], model["dimensions"], model["seed"])
    size = np.linalg.norm(x, axis=1)
    cosine = x @ model["prototypes"].T / np.where(size == 0, 1, size)[:, None]
    best = cosine.argmax(axis=1)
    # a text has letters exactly if it has n-grams; its bundle may cancel out only by chance
    return [(model["langs"][k], float(min(1.0, max(0.0, row[k])))) if s > 0 else ("und", 0.0) for k, row, s in zip(best.tolist(), cosine, size.tolist(), strict=True)]


def label(shared, keep_text=False):
    """Rows with _text -> the other columns, _text if it is to be kept, language and score, in small batches."""

    def run(batches):
        for whole in C.slices(batches):
            rest = [x for x in whole.schema.names if keep_text or x != "_text"]
            for at in range(0, whole.num_rows, 4 * ROWS):
                b = whole.slice(at, 4 * ROWS)
                got = predict(C.strings(b.column("_text")), shared.value)
                yield pa.record_batch([*(b.column(x) for x in rest), pa.array([k for k, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], names=[*rest, "lang_pred", "score"])

    return run


def identify(docs, model, text_col="text", keep=None, lang_name="lang_pred", score_name="score"):
    """The kept columns (all by default) of every row with the predicted language and score, under the given names;
    columns of these names are replaced.

    score is the cosine with the language's prototype, at least 0. Null texts and those without letters get 'und' and
    0, as do all without a learned language. Texts are taken whole; no rows give no rows. The model, of one vector a
    language, is broadcast.
    """
    names = (lang_name, score_name)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in names]
    # the text goes to the workers once, whether or not it is kept
    inner = {c: "_text" if c == text_col else f"_x_{c}" for c in keep}
    rows = docs.select(*(F.col(f"`{c}`").alias(x) for c, x in {**inner, text_col: "_text"}.items()))
    kinds = "".join(f"`{x}` {docs.schema[c].dataType.simpleString()}, " for c, x in inner.items())
    out = rows.mapInArrow(label(docs.sparkSession.sparkContext.broadcast(model), text_col in inner), f"{kinds}lang_pred string, score double")
    return out.select(*(F.col(f"`{x}`").alias(c) for c, x in inner.items()), F.col("lang_pred").alias(names[0]), F.col("score").alias(names[1]))


def held_out(doc_id):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def op5_language_id(spark, sf_dir):
    docs = C.read(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")), model, keep=["doc_id", "held_out"])


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())
