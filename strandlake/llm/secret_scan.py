"""Secret scan: fixed patterns, and a linear-chain conditional random field over all tokens, decoded by Viterbi."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from . import common as C

# Fixed patterns of the base scan.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KEYS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")
KINDS = ("assign", "access", "hex", "crf")

#: A run of letters and digits, or one sign; with the white space character before it, if any.
TOKEN = re.compile(r"\s?[^\W_]+|\s?[^\w\s]|\s?_")
SLICE = 1 << 20  # characters whose tokens are held as strings at once
BLOCK = 1 << 18  # tokens whose scores are held at once
O, B, I = 0, 1, 2  # noqa: E741
ALLOWED = np.array([[0, 0, -1e9], [0, 0, 0], [0, 0, 0]], np.float64)  # from row to column: I never follows O
BITS = 15
NEAR = (-3, -2, -1, 1, 2)


def base_spans(text):
    """[(start, end, kind, start of the secret part)] of the fixed patterns, leftmost and non-overlapping for each kind."""
    out = []
    low = text.encode("utf-8", "surrogatepass").lower()
    if any(k in low for k in KEYS):
        out += [(*m.span(), "assign", m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(*m.span(), "access", m.start()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [(*m.span(), "hex", m.start()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def shape(token):
    """White space before it, classes of its characters, length, changes between letters and digits, and of case."""
    lead = "" if not token[0].isspace() else " " if token[0] == " " else "n"
    token = token[1:] if lead else token
    if len(token) == 1 and not token.isalnum():
        return f"{lead}{token}" if token.isascii() else f"{lead}sign"
    n = len(token)
    if n > 1 and token.isascii() and token.isalpha() and token[1:].islower():  # most words
        kind = f"{lead}{'l' if token[0].islower() else 'lu'}:{n if n < 5 else min(n, 64).bit_length()}"
        return kind if n < 5 else f"{kind}:-:{'' if token.lower().strip('abcdef') else 'x'}"
    letters = "".join(sorted({("d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "o") for c in token}))
    kind = f"{lead}{letters}:{min(len(token), 64).bit_length() if len(token) > 4 else len(token)}"
    if len(token) < 5:
        return kind
    turns = sum(a.isdigit() != b.isdigit() or (a.islower() and b.isupper()) for a, b in zip(token, token[1:], strict=False))
    return f"{kind}:{min(4, 8 * turns // len(token)) if turns else '-'}:{'x' if not set(token.lower()) - set('0123456789abcdef') else ''}"


def kind_of(token, words):
    """(shape, the word if it is one of those learned): all that the field sees of a token."""
    low = token.strip().lower() if len(token) <= 13 else ""
    return shape(token), low if low in words else ""


def file_features(n_chars, signs, tokens):
    """Of the whole text: its length, and how many of its tokens are signs."""
    return [f"size{int(math.log10(n_chars + 1))}", f"signs{min(6, 20 * signs // max(1, tokens))}"]


def place(feature):
    return zlib.crc32(feature.encode()) & ((1 << BITS) - 1)


def own_features(kind):
    """Names of what a token says about its own label."""
    return ["bias", f"s={kind[0]}", f"w={kind[1]}"]


def file_shape(of_file, kind):
    return [f"{f}|{kind[0]}" for f in of_file]


def near_features(kind, d):
    """Names of what a token says about the label of the one that has it at distance d; beyond the ends it is ^."""
    return [f"s{d}={kind[0]}", f"w{d}={kind[1]}"] if d < 0 else [f"s{d}={kind[0]}"]


END = ("^", "^")


def kind_features(kinds, of_file):
    """[[place]] for each token: its shape and word, its neighbours' shapes and words, and the file's features."""
    at = lambda j: kinds[j] if 0 <= j < len(kinds) else END
    return [[place(x) for x in own_features(k) + file_shape(of_file, k) + [f for d in NEAR for f in near_features(at(i + d), d)]] for i, k in enumerate(kinds)]


class Scorer:
    """Scores of tokens under a model. Tokens become numbers of kinds; what a kind adds to the labels of the token and of
    those around it is added up once and then looked up, for all tokens of a text at once."""

    def __init__(self, model, keep=200_000):
        self.weights, self.steps, self.words = model["weights"].astype(np.float64), np.asarray(model["steps"], np.float64), set(model["words"])
        self.keep, self.tokens, self.kinds, self.known = keep, {}, {}, []
        self.own, self.near, self.sign = np.zeros((0, 3)), np.zeros((0, len(NEAR), 3)), np.zeros(0, bool)
        self.of_file = {}
        self.doubt = doubt(self.steps)
        self.number(END)
        self.grow()

    def total(self, names):
        return self.weights[[place(x) for x in names]].sum(axis=0)

    def number(self, kind):
        if kind not in self.kinds:
            self.kinds[kind] = len(self.known)
            self.known.append(kind)
        return self.kinds[kind]

    def grow(self):
        new = self.known[len(self.own) :]
        if new:
            self.own = np.concatenate([self.own, [self.total(own_features(k)) for k in new]])
            self.near = np.concatenate([self.near, [[self.total(near_features(k, d)) for d in NEAR] for k in new]])
            self.sign = np.concatenate([self.sign, [":" not in k[0] or len(k[0]) < 3 for k in new]])

    def read(self, text):
        """Numbers of the kinds of all tokens."""
        out, at = [], 0
        while at < len(text):
            end = at + SLICE
            while end < len(text) and not text[end].isspace():
                end += 1
            tokens = TOKEN.findall(text, at, min(end, len(text)))
            got = list(map(self.tokens.get, tokens))
            if None in got:
                if len(self.tokens) > self.keep:
                    self.tokens = {}
                for i, k in enumerate(got):
                    if k is None:
                        got[i] = self.tokens[tokens[i]] = self.number(kind_of(tokens[i], self.words))
            out.append(np.array(got, np.int32))
            at = end
        self.grow()
        return np.concatenate(out) if out else np.empty(0, np.int32)

    def file_scores(self, of_file):
        key = tuple(of_file)
        held = self.of_file.get(key, np.zeros((0, 3)))
        if len(held) < len(self.known):
            held = self.of_file[key] = np.concatenate([held, [self.total(file_shape(of_file, k)) for k in self.known[len(held) :]]])
        return held

    def scores(self, numbers, of_file, a, b):
        """Scores of the tokens from a to b of a text."""
        low, high = max(0, a - 3), min(len(numbers), b + 2)
        padded = np.concatenate([np.zeros(3 - a + low, np.int32), numbers[low:high], np.zeros(2 - high + b, np.int32)])
        own = numbers[a:b]
        out = self.own[own] + self.file_scores(of_file)[own]
        for i, d in enumerate(NEAR):
            out += self.near[padded[3 + d : 3 + d + b - a], i]
        return out

    def decode(self, numbers, of_file):
        """[(first token, token after the last)] of the secrets on the best path through all tokens."""
        found, n = [], len(numbers)
        at, held = [], []
        for a in range(0, n, BLOCK):
            b = min(n, a + BLOCK)
            s = self.scores(numbers, of_file, a, min(n, b + 1))
            ahead = np.zeros(b - a)
            ahead[: len(s) - 1] = np.maximum(0, s[1:, I] - s[1:, B])[: b - a]
            open_ = np.flatnonzero(s[: b - a, O] - np.maximum(s[: b - a, B], s[: b - a, I]) <= self.doubt + ahead)
            at.append(open_ + a)
            held.append(s[open_])
        at = np.concatenate(at) if at else np.empty(0, np.int64)
        if not len(at):
            return found
        held = np.concatenate(held)
        edges = [0, *(np.flatnonzero(np.diff(at) != 1) + 1).tolist(), len(at)]
        steps = self.steps.tolist()
        for x, y in zip(edges, edges[1:], strict=False):
            path, i, first = viterbi(held[x:y].tolist(), steps, at[y - 1] + 1 < n), 0, int(at[x])
            while i < len(path):
                j = i + 1
                if path[i]:
                    while j < len(path) and path[j] == I:
                        j += 1
                    found.append((first + i, first + j))
                i = j
        return found


def doubt(steps):
    """The most that a path can win in steps by a label other than O, against O there (and B after it in place of I)."""
    most = 0.0
    for before in (O, B, I):
        for own in (B, I):
            for after in (O, B, I):
                if before == O and own == I:
                    continue
                then = B if after == I else after
                rest = max(steps[I][x] - steps[B][x] for x in (O, B, I)) if after == I else 0.0
                most = max(most, steps[before][own] + steps[own][after] - steps[before][O] - steps[O][then] + max(0.0, rest), steps[before][own] - steps[before][O])
    return most


def viterbi(scores, steps, closed=False):
    """Best labels; scores: tokens x labels, steps: from label to label, the first as after O, and the last as before O
    if closed. Ties: the first label."""
    best, back = [s + t for s, t in zip(scores[0], steps[0], strict=True)], []
    for s in scores[1:]:
        row, came = [], []
        for k in (0, 1, 2):
            x, y, z = best[0] + steps[0][k], best[1] + steps[1][k], best[2] + steps[2][k]
            top, j = (x, 0) if x >= y and x >= z else (y, 1) if y >= z else (z, 2)
            row.append(top + s[k])
            came.append(j)
        best = row
        back.append(came)
    if closed:
        best = [x + t[0] for x, t in zip(best, steps, strict=True)]
    path = [best.index(max(best))]
    for came in reversed(back):
        path.append(came[path[-1]])
    return path[::-1]


def log_sum(x, axis):
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def marginals(scores, steps, mask):
    """(sequences x tokens x labels probabilities, summed label-to-label probabilities) by forward and backward passes
    over sequences side by side; mask: sequences x tokens that there are, at least one each, from the left."""
    m, n, _ = scores.shape
    ahead, behind = np.empty((m, n, 3)), np.zeros((m, n, 3))
    ahead[:, 0] = scores[:, 0] + steps[0]
    for i in range(1, n):
        ahead[:, i] = np.where(mask[:, i, None], log_sum(ahead[:, i - 1, :, None] + steps, 1) + scores[:, i], ahead[:, i - 1])
    for i in range(n - 2, -1, -1):
        behind[:, i] = np.where(mask[:, i + 1, None], log_sum(steps + (scores[:, i + 1] + behind[:, i + 1])[:, None, :], 2), 0)
    total = log_sum(ahead[:, -1], 1)[:, None, None]
    p = np.exp(ahead + behind - total) * mask[:, :, None]
    both = np.zeros((3, 3))
    both[0] += p[:, 0].sum(axis=0)
    for i in range(1, n):
        both += (np.exp(ahead[:, i - 1, :, None] + steps + (scores[:, i] + behind[:, i])[:, None, :] - total) * mask[:, i, None, None]).sum(axis=0)
    return p, both


def train(sequences, passes=8, rate=0.3, decay=1e-3, side=64, seed=3):
    """Weights of the field by gradient ascent on its log-likelihood, with steps that shrink by feature (Adagrad), over
    `side` sequences of about one length at a time; sequences: [(features, labels)]."""
    weights, steps, rng = np.zeros((1 << BITS, 3)), np.zeros((3, 3)), np.random.default_rng(seed)
    past, past_steps = np.full((1 << BITS, 3), 1e-2), np.full((3, 3), 1.0)
    order = sorted(range(len(sequences)), key=lambda k: len(sequences[k][1]))
    groups = [order[k : k + side] for k in range(0, len(order), side)]
    for _ in range(passes):
        for g in rng.permutation(len(groups)):
            own = [sequences[k] for k in groups[g]]
            n = max(len(y) for _, y in own)
            mask = np.array([[j < len(y) for j in range(n)] for _, y in own])
            at = np.zeros((len(own), n, len(own[0][0][0])), np.int64)
            gold = np.zeros((len(own), n), np.int64)
            for r, (x, y) in enumerate(own):
                at[r, : len(y)], gold[r, : len(y)] = x, y
            p, both = marginals(weights[at].sum(axis=2), steps + ALLOWED, mask)
            slope = (np.eye(3)[gold] - p) * mask[:, :, None]
            flat = at.ravel()
            step = np.stack([np.bincount(flat, np.repeat(slope[:, :, k].ravel(), at.shape[2]), len(weights)) for k in (O, B, I)], axis=1)
            step -= decay * weights * (step != 0)
            past += step * step
            weights += rate * step / np.sqrt(past)
            seen = np.zeros((3, 3))
            for y in (y for _, y in own):
                np.add.at(seen, ([0, *y[:-1]], y), 1)
            step = seen - both
            past_steps += step * step
            steps += rate * step / np.sqrt(past_steps)
    return weights.astype(np.float32), steps + ALLOWED


NAMES = ("password", "passwd", "pwd", "secret", "client_secret", "token", "access_token", "auth", "bearer", "api_key", "api key", "private key", "key", "login")
HELD_NAMES = ("passphrase", "credential", "signing key", "session-token", "db_pass", "license code")
JOINS = ("=", ": ", " = ", " : ", " is ", " => ", "=\"", ": '", " := ")
HELD_JOINS = (" -> ", "='", " was ", " == ")
DECOYS = ("{a}.{b}.{c}.{d}", "20{b}-0{e}-1{e} 1{e}:{b}:{b}", "+{b} {a}{b} {c}{d}{e}", "v{e}.{b}.{c}-rc{e}", "{w}{a}@{w}{e}.org", "https://{w}.org/{w}/{a}{b}?p={c}", "{a}{b}{c} {w}s", "#{a}{b}", "{w}_{w}_{e} = {a}", "{a} x {b} = {c}{d}", "{a}{b}-{c}{d}-{a}{d}-{c}{b}", "{w}-{w}-{w}", "${a}.{b}", "{w}: {w}", "{w} = \"{w} {w}\"")


def made_secret(rng):
    """A secret of one of several kinds: random letters and digits, groups of them, words with digits and signs."""
    pick = lambda letters, low, high: "".join(rng.choices(letters, k=rng.randint(low, high)))
    digits, low, up = "0123456789", "abcdefghijklmnopqrstuvwxyz", C.UPPER
    kind = rng.randrange(7)
    if kind == 0:
        return pick("0123456789abcdef", 16, 48)
    if kind == 1:
        return pick(digits + low + up, 14, 40)
    if kind == 2:
        return pick(digits + up, 14, 24)
    if kind == 3:
        return rng.choice("-_.").join(pick(digits + low, 4, 9) for _ in range(rng.randint(3, 5)))
    if kind == 4:
        return pick(low, 2, 4) + "_" + pick(low, 3, 5) + "_" + pick(digits + low + up, 14, 30)
    if kind == 5:
        return pick(low + up, 3, 7) + pick(digits, 1, 3) + rng.choice("!#$%&@*+") + pick(low + up + digits, 3, 8)
    return pick(digits + low + up, 6, 12) + rng.choice("+/") + pick(digits + low + up, 8, 16) + "=="


def planted(rng, names=NAMES, joins=JOINS, unnamed=0.0):
    """(text, start, end of the secret in it); a share of them after any word, so that shape alone has to tell."""
    name, join, secret = rng.choice(names), rng.choice(joins), made_secret(rng)
    if rng.random() < unnamed:
        name, join = "".join(rng.choices("abcdefghijklmnoprstuvw", k=rng.randint(3, 9))), rng.choice((join, " "))
    name = rng.choice((name, name.upper(), name.capitalize()))
    head = f"{rng.choice(('', '', 'the ', 'my_', '\"'))}{name}{join}"
    close = join[-1] if join[-1] in "\"'" else ""
    return f"{head}{secret}{close}{rng.choice(('', ';', ',', '.', ''))}", len(head), len(head) + len(secret)


def decoy(rng):
    """Numbers, dates, addresses and the like, that are no secrets."""
    word = "".join(rng.choices("abcdefghijklmnoprstuvw", k=rng.randint(3, 9)))
    return rng.choice(DECOYS).format(a=rng.randrange(10, 1000), b=rng.randrange(10, 60), c=rng.randrange(10, 1000), d=rng.randrange(10, 1000), e=rng.randrange(1, 9), w=word)


def labelled(text, marked, a=0, b=None):
    """(tokens, labels) from a to b; marked: [(start, end)] of secrets."""
    at = [(m.start() + m[0][0].isspace(), m.end(), m[0]) for m in TOKEN.finditer(text, a, len(text) if b is None else b)]
    gold = [O] * len(at)
    for start, end in marked:
        for k, i in enumerate(i for i, (x, y, _) in enumerate(at) if x >= start and y <= end):
            gold[i] = I if k else B
    return [t for _, _, t in at], gold


def cut_out(text, start, end, reach):
    """A stretch of `reach` characters on either side, out to white space."""
    a, b = max(0, start - reach), min(len(text), end + reach)
    while a and not text[a - 1].isspace() and start - a < 2 * reach:
        a -= 1
    while b < len(text) and not text[b].isspace() and b - end < 2 * reach:
        b += 1
    return a, b


def sequences_of(text, rng, reach=120, longest=300, each=20):
    """[(kind, tokens, labels)] to learn from: around `each` secrets at most, drawn from those that the base scan finds; a
    planted one, a decoy and nothing at random places of the text; each of at most `longest` tokens, the first ones."""
    out, base = [], [(secret, end) for _, end, _, secret in base_spans(text)]
    drawn = base if len(base) <= each else rng.sample(base, each)

    def tell(kind, text, marked, a, b):
        tokens, gold = labelled(text, marked, a, b)
        if tokens:
            gold = gold[:longest]
            out.append((kind, tokens[:longest], gold))

    for start, end in drawn:
        tell("base", text, base, *cut_out(text, start, end, reach))
    for kind in ("planted", "decoy", "plain"):
        at = rng.randrange(len(text) + 1)
        while at < len(text) and not text[at].isspace():
            at += 1
        a, b = cut_out(text, at, at, reach)
        if kind == "plain":
            tell(kind, text, base, a, b)
            continue
        new, start, end = planted(rng, unnamed=0.3) if kind == "planted" else (decoy(rng), 0, 0)
        whole, offset = f"{text[a:at]} {new}{text[at:b]}", at - a + 1
        marked = [(s, e) for _, e, _, s in base_spans(whole)]
        if kind == "planted":
            marked = [m for m in marked if m[1] <= offset + start or m[0] >= offset + end] + [(offset + start, offset + end)]
        tell(kind, whole, marked, 0, len(whole))
    return out


def samples(seed, longest, each):
    """Sequences of whole texts: all that the field sees of each token (shape, word), file features, labels."""

    def run(batches):
        for b in batches:
            rows = []
            for o, text in zip(b.column("o").to_pylist(), C.strings(b.column("_text")), strict=True):
                tokens = TOKEN.findall(text)
                if not tokens:
                    continue
                signs = sum(len(t.strip()) == 1 and not t.strip().isalnum() for t in tokens)
                of_file = file_features(len(text), signs, len(tokens))
                for i, (kind, own, gold) in enumerate(sequences_of(text, random.Random(o ^ seed), longest=longest, each=each)):
                    rows.append((o, i, kind, [shape(t) for t in own], [t.strip().lower() if len(t) <= 13 else "" for t in own], of_file, gold))
            names, labels = pa.list_(pa.string()), pa.list_(pa.int64())
            kinds = (pa.int64(), pa.int64(), pa.string(), names, names, names, labels)
            cols = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["o", "i", "kind", "shapes", "low", "of_file", "gold"])

    return run


def words_before(sequences, most=500):
    """Words of 3 to 12 characters, mostly within three tokens before a secret, seen there in at least 3 texts; the most
    frequent. sequences: (text's number, words, labels)."""
    seen, near, texts = Counter(), Counter(), {}
    for o, low, gold in sequences:
        seen.update(low)
        here = [low[j] for j in {j for i, g in enumerate(gold) if g == B for j in range(max(0, i - 3), i)}]
        near.update(here)
        for w in here:
            texts.setdefault(w, set()).add(o)
    kept = [(-n, w) for w, n in near.items() if len(texts[w]) >= 3 and 2 * n > seen[w] and 3 <= len(w) <= 12]
    return [w for _, w in sorted(kept)[:most]]


def fit(docs, text_col="text", pool=20_000, most=1000, longest=300, each=20, seed=3):
    """Fits the field on a bounded sample: about `pool` different whole texts at most, chosen by hash, of which at most
    `most` sequences of each kind come to the driver, of at most `longest` tokens each, and around `each` found secrets of
    a text at most; no text or sequence is chosen by where it is, and a text that repeats counts once.

    Labels are those of the base scan, and of secrets planted into texts of the sample in other wordings (NAMES, JOINS,
    made_secret); decoys and plain stretches are the other examples. None where no text of the sample has a token.
    """
    texts = C.pick(docs, _text=text_col).where("_text is not null").withColumn("o", F.xxhash64("_text", F.lit(seed)))
    n = docs.count()
    if pool < n:
        texts = texts.where(F.col("o") < int(-(1 << 63) + (1 << 64) * pool / n))
    texts = texts.groupBy("o").agg(F.first("_text").alias("_text"))  # one of equal texts
    found = texts.mapInArrow(samples(seed, longest, each), "o long, i long, kind string, shapes array<string>, low array<string>, of_file array<string>, gold array<long>")
    nth = F.row_number().over(Window.partitionBy("kind").orderBy(F.xxhash64("o", "i"), "o", "i"))  # of the sample alone
    picked = found.withColumn("n", nth).where(F.col("n") <= most).orderBy("kind", "n").collect()
    if not picked:
        return None
    words = words_before([(r["o"], r["low"], r["gold"]) for r in picked])
    known = set(words)
    learned = [(kind_features([(s, w if w in known else "") for s, w in zip(r["shapes"], r["low"], strict=True)], r["of_file"]), r["gold"]) for r in picked]
    weights, steps = train(learned, seed=seed)
    return {"weights": weights, "steps": steps, "words": words}


def field_spans(text, scorer):
    """[(start, end, 'crf', start)] of the secrets that the field tags, over all tokens of the text."""
    if scorer is None or not text:
        return []
    numbers = scorer.read(text)
    if not len(numbers):
        return []
    found = scorer.decode(numbers, file_features(len(text), int(scorer.sign[numbers].sum()), len(numbers)))
    if not found:
        return []
    wanted, at = {i for a, b in found for i in (a, b - 1)}, {}
    last = max(wanted)
    for i, m in enumerate(TOKEN.finditer(text)):
        if i in wanted:
            at[i] = (m.start() + m[0][0].isspace(), m.end())
            if i == last:
                break
    return [(at[a][0], at[b - 1][1], "crf", at[a][0]) for a, b in found]


def joined(spans):
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind, _ in spans)


def find(text, scorer):
    """(base spans, all spans), by start and kind."""
    base = base_spans(text)
    return base, sorted(base + field_spans(text, scorer), key=lambda x: (x[0], KINDS.index(x[2])))


def scan(shared):
    def run(batches):
        scorer = None
        for b in batches:
            scorer = scorer or (Scorer(shared.value) if shared.value else None)
            rows = []
            for text in C.strings(b.column("_text")):
                base, spans = find(text, scorer)
                n = [sum(x[2] == k for x in base) for k in KINDS[:3]]
                listed = [{"kind": k, "start": s, "end": e, "text": text[s:e]} for s, e, k, _ in spans]
                rows.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), listed))
            found = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string())]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), found)
            cols = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.record_batch([b.column("_id"), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=["_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "found"])

    return run


def secret_scan(docs, model, id_col="doc_id", text_col="text"):
    """One row per input row: id, n_assign, n_access, n_hex, base_sha256, spans, found (kind, start, end, text).

    Base spans are those of the fixed patterns; spans of kind crf are the secrets that the field tags, whether or not they
    meet base spans. All tokens of every whole text are scored, and the best path is the one through all of them: a token
    where no path can gain by another label than outside parts the text into stretches that are decoded on their own.
    Positions count code points. Null and empty texts have no spans. Rows that repeat are each scanned; other columns
    don't matter; no rows give no rows. model: of fit(), or None for the base alone; its size is fixed, and it is broadcast.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = C.pick(docs, _id=id_col, _text=text_col).mapInArrow(scan(docs.sparkSession.sparkContext.broadcast(model)), f"_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, found array<struct<kind:string,start:long,end:long,text:string>>")
    return rows.withColumnRenamed("_id", id_col)


def op1_secrets(spark, sf_dir):
    docs = C.read(spark, sf_dir, "documents")
    return secret_scan(docs, fit(docs)).drop("found")
