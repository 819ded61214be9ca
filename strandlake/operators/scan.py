"""Scanning sequences for motifs whose words of one length all have a score, and what stands around words."""

import itertools
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .kmers import CODES, ranks, templates, window_codes

LIMIT = 64 << 20  # bytes of scores that may be broadcast


def word_scores(rows):
    """{motif: score of every word by code, rounded to 6}; rows: [(motif, matrix of log-odds)], width of up to 10."""
    out = {}
    for motif, matrix in rows:
        length = len(matrix)
        codes = np.arange(4**length)
        total = np.zeros(4**length)
        for j, row in enumerate(matrix):
            total = total + np.array(row)[(codes >> (2 * j)) & 3]
        out[motif] = np.round(total, 6)
    return out


def scan(seqs, scores, threshold, length=8):
    """(motif, seq_id, grp, strand, start, score, match): windows without missing bases that score at least threshold.

    - is the other strand; start counts from 0 on the forward strand, match reads along the motif. scores are broadcast
    after their size is checked: motifs x 4**length numbers; more motifs are scanned in several calls. Words that no
    motif wants are dropped by one look-up a base.
    """
    size = sum(x.nbytes for x in scores.values())
    if size > LIMIT:
        raise ValueError(f"{len(scores)} motifs take {size} bytes of scores; scan at most {LIMIT} at once")
    shared = seqs.sparkSession.sparkContext.broadcast(scores)
    _, span, parts = templates(length)[0]

    def run(batches):
        other = ranks(length)[1]
        table = shared.value
        wanted = np.zeros(4**length, bool)
        for s in table.values():
            wanted |= (s >= threshold) | (s[other] >= threshold)
        for b in batches:
            cols = [[] for _ in range(6)]
            for seq_id, grp, u in zip(*(b.column(x).to_pylist() for x in ("seq_id", "grp", "u")), strict=True):
                at, codes = window_codes(u or "", span, parts)
                near = wanted[codes]
                at, codes = at[near], codes[near]
                for motif, s in table.items():
                    for strand, score in (("+", s[codes]), ("-", s[other[codes]])):
                        k = np.flatnonzero(score >= threshold)
                        for col, x in zip(cols, ([motif] * len(k), [seq_id] * len(k), [grp] * len(k), [strand] * len(k), at[k].tolist(), score[k].tolist()), strict=True):
                            col += x
            kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.float64())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["motif", "seq_id", "grp", "strand", "start", "score"])

    return seqs.select("seq_id", "grp", "u").mapInArrow(run, "motif string, seq_id long, grp string, strand string, start long, score double")


HITS = "motif long, seq_id long, grp string, strand string, start long, score double"


def stretches(batch, bases=1 << 21):
    """(seq_ids, groups, text, starts) of a batch's sequences in runs of some `bases`, joined by a missing base."""
    ids, grps, texts, n = [], [], [], 0
    for seq_id, grp, u in zip(*(batch.column(x).to_pylist() for x in ("seq_id", "grp", "u")), strict=True):
        ids.append(seq_id), grps.append(grp), texts.append(u or "")
        n += len(u or "") + 1
        if n >= bases:
            yield ids, grps, "N".join(texts), np.cumsum([0, *(len(x) + 1 for x in texts[:-1])])
            ids, grps, texts, n = [], [], [], 0
    if ids:
        yield ids, grps, "N".join(texts), np.cumsum([0, *(len(x) + 1 for x in texts[:-1])])


def blocks_of(matrix, least, core, length=8):
    """[(first column, least score)]: what a hit needs in one of these blocks of `length` columns, at least.

    Blocks don't overlap. A score of `least` leaves least - (best of the columns in no block) to all blocks together, so
    one of them has its part of it; parts follow the blocks' means and deviations, so that few words have them. A matrix
    too narrow for two blocks has the one that starts at `core`, which has to bear it all.
    """
    width = len(matrix)
    at = [core] if width < 2 * length else [length * k for k in range(width // length)]
    own = np.array([matrix[k : k + length].mean(axis=1).sum() for k in at])
    spread = np.array([np.sqrt(matrix[k : k + length].var(axis=1).sum()) for k in at])
    rest = least - np.delete(matrix, np.concatenate([np.arange(k, k + length) for k in at]), axis=0).max(axis=1, initial=-np.inf).sum() if width > length * len(at) else least
    share = spread / spread.sum() if spread.sum() > 0 else np.full(len(at), 1 / len(at))
    return [(k, float(x)) for k, x in zip(at, own + (rest - own.sum()) * share - 1e-4, strict=True)]


def best_words(first, second, least):
    """Codes of the words whose halves' scores add up to `least`, found from the best pair on: only they are looked at."""
    order = np.argsort(-first), np.argsort(-second)
    x, y = first[order[0]], second[order[1]]
    n = np.searchsorted(-y, -(least - x) + 1e-5, "right")  # a few more; the sum decides
    i = np.repeat(np.arange(len(x)), n)
    j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
    good = x[i] + y[j] >= np.float32(least)
    return order[0][i[good]] + len(first) * order[1][j[good]]


class Index:
    """Postings of words to motifs, for all motifs of one broadcast.

    Entry 2 m is motif m, 2 m + 1 its reverse complement. A posting of a word is a block of an entry in which the word
    has the least score that some block of a hit must have; post[ptr[w] : ptr[w + 1]] are those of word w. tables holds
    the scores of each entry's columns, four at a time.
    """

    def __init__(self, motifs, length=8):
        self.motifs = [(k, np.array(m, float), least) for k, m, _, least in motifs]
        self.quads = -(-max((len(m) for _, m, _ in self.motifs), default=4) // 4)
        n, most = 2 * len(self.motifs), max(1, self.quads * 4 // length)
        self.tables = np.zeros((n, self.quads, 256), np.float32)
        self.width, self.least = np.zeros(n, np.int64), np.zeros(n, np.float32)
        self.first, self.need = np.full((n, most), 0, np.int64), np.full((n, most), np.inf, np.float32)
        words, posts = [], []
        for k, (_, forward, least) in enumerate(self.motifs):
            for e, m in ((2 * k, forward), (2 * k + 1, forward[::-1, ::-1])):
                self.width[e], self.least[e] = len(m), least - 1e-4
                quads = self.tables[e]
                for q in range(self.quads):
                    quads[q] = self.sums(m[4 * q : 4 * q + 4])
                core = motifs[k][2] if e % 2 == 0 else len(m) - length - motifs[k][2]
                for b, (at, part) in enumerate(blocks_of(m, least, core, length)):
                    self.first[e, b], self.need[e, b] = at, part
                    halves = (quads[at // 4], quads[at // 4 + 1]) if at % 4 == 0 else (self.sums(m[at : at + 4]), self.sums(m[at + 4 : at + 8]))
                    words.append(best_words(*halves, part))
                    posts.append(np.full(len(words[-1]), e * most + b, np.int32))
        words, posts = (np.concatenate(x or [np.empty(0, np.int64)]) for x in (words, posts))
        order = np.argsort(words, kind="stable")
        self.post, self.most = posts[order].astype(np.int32), most
        self.ptr = np.searchsorted(words[order], np.arange(4**length + 1))

    @staticmethod
    def sums(rows):
        """Scores of all words of up to four columns, by code, as if the missing columns were 0."""
        total = np.zeros(1, np.float32)
        for row in [*rows, *[np.zeros(4)] * (4 - len(rows))]:
            total = (row.astype(np.float32)[:, None] + total[None, :]).ravel()
        return total

    def hits(self, bases, at, codes, missing, room=1 << 20):
        """(entry, start, score) of a stretch: at, codes are its clean words, missing counts missing bases before each
        place. Runs of words with some `room` postings are looked at together."""
        clean = np.minimum(bases, 3).astype(np.int64)  # windows with a missing base drop out below
        clean = np.append(clean, np.zeros(4 * self.quads + 4, np.int64))
        four = clean[:-3] + 4 * clean[1:-2] + 16 * clean[2:-1] + 64 * clean[3:]
        n = self.ptr[codes + 1] - self.ptr[codes]
        upto = np.cumsum(n)
        edge = np.unique(np.append(np.searchsorted(upto, np.arange(0, upto[-1] if len(upto) else 0, room), "right"), len(n)))
        for x, y in zip(edge[:-1], edge[1:], strict=True):
            part = n[x:y]
            k = np.arange(part.sum()) - np.repeat(np.cumsum(part) - part - self.ptr[codes[x:y]], part)
            entry, block = np.divmod(self.post[k], self.most)
            start = np.repeat(at[x:y], part) - self.first[entry, block]
            end = start + self.width[entry]
            good = (start >= 0) & (end <= len(bases))
            good[good] = missing[end[good]] == missing[start[good]]
            entry, block, start = entry[good], block[good], start[good]
            score = self.tables[entry, 0, four[start]]
            for q in range(1, self.quads):
                score = score + self.tables[entry, q, four[start + 4 * q]]
            good = score >= self.least[entry]
            yield from self.settled(entry[good], block[good], start[good], four, bases)

    def settled(self, entry, block, start, four, bases):
        """Hits by their exact scores, each from the first of its blocks that has its part."""
        first = np.ones(len(entry), bool)
        for b in range(self.most - 1):  # those with a later block have their blocks in a row
            own = self.tables[entry, 2 * b, four[start + 8 * b]] + self.tables[entry, 2 * b + 1, four[start + 8 * b + 4]]
            first &= (block <= b) | (own < self.need[entry, b])
        entry, start = entry[first], start[first]
        if not len(entry):
            return
        order = np.argsort(entry, kind="stable")
        entry, start = entry[order], start[order]
        edge = np.flatnonzero(np.diff(entry, prepend=-1)).tolist()
        for x, y in zip(edge, [*edge[1:], len(entry)], strict=True):
            motif, m, least = self.motifs[entry[x] // 2]
            here, score = start[x:y], np.zeros(y - x)
            for j, row in enumerate(m):
                score = score + row[bases[here + j] if entry[x] % 2 == 0 else 3 - bases[here + len(m) - 1 - j]]
            score = np.round(score, 6)
            good = score >= least
            if good.any():
                yield motif, "+-"[entry[x] % 2], here[good], score[good]


_indexes = {}


def index_of(shared, length):
    """One index for each worker and broadcast; the last one is kept."""
    if shared.id not in _indexes:
        _indexes.clear()
        _indexes[shared.id] = Index(shared.block.value, length)
    return _indexes[shared.id]


class Shared:
    """A broadcast block of motifs and a name for it that all workers know."""

    def __init__(self, spark, block):
        self.id, self.block = uuid.uuid4().hex, spark.sparkContext.broadcast(block)


def wide_scan(seqs, motifs, length=8, most=4096):
    """(motif, seq_id, grp, strand, start, score): windows over the whole width of each motif that score its threshold.

    motifs: any number of (motif, matrix of log-odds with `length` columns at least, first core column from 0,
    threshold). Each word of a sequence is looked up in an index of words to motifs, under bounds that no hit fails, so
    that a base costs its postings, not the number of motifs. At most `most` motifs are broadcast at once (some 500 bytes
    each at 16 columns, and some 10 kB in a worker's index); only beyond that are the sequences read again. A window
    counts if it is clean over its whole width; start counts from 0 on the forward strand.
    """
    spark, rows, out = seqs.sparkSession, iter(motifs), None
    while (block := list(itertools.islice(rows, most))) or out is None:
        part = seqs.select("seq_id", "grp", "u").mapInArrow(wide_run(Shared(spark, block), length), HITS)
        out = part if out is None else out.unionByName(part)
    return out


def wide_run(shared, length, flush=1 << 18):
    _, span, parts = templates(length)[0]

    def run(batches):
        index = index_of(shared, length)
        for b in batches:
            for ids, grps, text, starts in stretches(b):
                at, codes = window_codes(text, span, parts)
                bases = CODES[np.frombuffer(text.encode(), np.uint8)]
                missing, ids, grps = np.concatenate([[0], np.cumsum(bases > 3)]), pa.array(ids, pa.int64()), pa.array(grps, pa.string())
                held, n = [], 0
                for hit in index.hits(bases, at, codes, missing):
                    held.append(hit)
                    n += len(hit[2])
                    if n >= flush:
                        yield record(held, ids, grps, starts)
                        held, n = [], 0
                if held:
                    yield record(held, ids, grps, starts)

    return run


def record(held, ids, grps, starts):
    """Hits of a stretch as an Arrow batch; starts: where its sequences begin."""
    size = np.array([len(h[2]) for h in held])
    start = np.concatenate([h[2] for h in held])
    k = np.searchsorted(starts, start, "right") - 1
    owner = pa.array(k)
    motif, strand = (pa.array([h[i] for h in held], t).take(pa.array(np.repeat(np.arange(len(held)), size))) for i, t in ((0, pa.int64()), (1, pa.string())))
    return pa.record_batch([motif, ids.take(owner), grps.take(owner), strand, pa.array(start - starts[k]), pa.array(np.concatenate([h[3] for h in held]))], names=["motif", "seq_id", "grp", "strand", "start", "score"])


INSIDE = 100  # the place of a column inside a spaced word is this and its offset in the span


def between(span, parts):
    """Places of the columns of a template's span that its word skips."""
    own = {k for start, n in parts for k in range(start, start + n)}
    return [INSIDE + k for k in range(span) if k not in own]


def flanks(seqs, words, length=8, reach=2):
    """(grp, gap, word, place, base, n): bases up to `reach` before (-2, -1) and after (1, 2) the whole span of every
    occurrence of the words on either strand, as seen along the word; those missing or beyond the ends don't count.

    words: strings, at most 4**length, or {gap: strings} of several templates, which are read in one pass. The columns
    inside a spaced word count as well, at the places of between().
    """
    by_gap = words if isinstance(words, dict) else {0: words}
    shared = seqs.sparkSession.sparkContext.broadcast({g: (ws, [sum("ACGT".index(c) * 4**j for j, c in enumerate(w)) for w in ws]) for g, ws in by_gap.items()})
    around = [(p, p if p < 0 else None) for p in (*range(-reach, 0), *range(1, reach + 1))]

    def run(batches):
        other, sums, chosen = ranks(length)[1], {}, []
        for gap, span, parts in templates(length):
            if gap in shared.value:
                index = np.full(4**length, -1)
                index[shared.value[gap][1]] = np.arange(len(shared.value[gap][1]))
                offsets = [(p, o if o is not None else span - 1 + p) for p, o in around] + [(p, p - INSIDE) for p in between(span, parts)]
                chosen.append((gap, span, parts, index, offsets))
        for b in batches:
            for grp, u in zip(b.column("grp").to_pylist(), b.column("u").to_pylist(), strict=True):
                bases = np.pad(CODES[np.frombuffer((u or "").encode(), np.uint8)], reach, constant_values=4)
                for gap, span, parts, index, offsets in chosen:
                    at, own = window_codes(u or "", span, parts)
                    total = sums.setdefault((grp, gap), np.zeros((len(shared.value[gap][0]), len(offsets), 4), np.int64))
                    for turned in (False, True):
                        word = index[other[own]] if turned else index[own]
                        k = word >= 0
                        if turned:
                            k &= own != other[own]  # a palindrome is one occurrence
                        for i, (_, offset) in enumerate(offsets):
                            x = bases[reach + at[k] + (span - 1 - offset if turned else offset)]
                            good = x < 4
                            np.add.at(total, (word[k][good], i, 3 - x[good] if turned else x[good]), 1)
        names = {c[0]: [p for p, _ in c[4]] for c in chosen}
        for (grp, gap), total in sums.items():
            places = names[gap]
            w, i, x = np.nonzero(total)
            cols = [pa.array([grp] * len(w), pa.string()), pa.array([gap] * len(w), pa.int64()), pa.array([shared.value[gap][0][k] for k in w.tolist()], pa.string()), pa.array([places[k] for k in i.tolist()], pa.int64()), pa.array(["ACGT"[k] for k in x.tolist()], pa.string()), pa.array(total[w, i, x])]
            yield pa.record_batch(cols, names=["grp", "gap", "word", "place", "base", "n"])

    parts_ = seqs.select("grp", "u").mapInArrow(run, "grp string, gap long, word string, place long, base string, n long")
    return parts_.groupBy("grp", "gap", "word", "place", "base").agg(F.sum("n").alias("n"))
