"""Token ids of whole texts through a vocabulary file of the tokenizers library."""

import codecs
import json
import os
import re
import struct
from array import array
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex

from . import common as C

#: A space between two others than white space is the start of a new pre-token in byte-level vocabularies.
EDGE = re.compile(r"(?<=\S)(?= \S)")
CROWDED = re.compile(r"\s \s")
# Fixed value: the pre-tokens of byte-level vocabularies.
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Words that a worker remembers, about 150 bytes each.
KEEP = 300_000
#: A byte that UTF-8 never has, pre-tokens that are joined by it, and joined ones that are encoded in a call.
APART, JOINED, CALL = 0xFF, 100, 20


def byte_letters():
    """The letter that stands for each byte in byte-level vocabularies: itself if it prints, else the next from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [x for x in range(256) if x not in own]
    return {x: chr(x) for x in own} | {x: chr(0x100 + i) for i, x in enumerate(rest)}


def kinds(*ranges):
    """For each byte whether it is in one of the ranges, ends included."""
    return np.array([any(a <= x <= b for a, b in ranges) for x in range(256)])


WORD, MARK = kinds((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A)), kinds((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))
#: First bytes of characters that aren't white space; white space beyond ASCII starts with C2, E1, E2 or E3.
SOLID = WORD | MARK | kinds((0xC3, 0xE0), (0xE4, 0xFF))


def edges(data):
    """For each byte of UTF-8 text whether a pre-token of byte-level vocabularies surely starts there: at a space or line
    feed between two others than white space, after such a line feed, between ASCII letters or digits and ASCII marks
    (but for an apostrophe before a letter)."""
    tail = np.zeros(3, np.uint8)
    b = np.concatenate([tail, data, tail[:1]])
    here, last, second, third, after = b[3:-1], b[2:-2], b[1:-3], b[:-4], b[4:]
    solid = WORD[last] | MARK[last] | (last >= 0x80) & (second != 0xC2) & ((third < 0xE1) | (third > 0xE3))
    blank = ((here == 0x20) | (here == 0x0A)) & solid & SOLID[after]
    found = blank | WORD[last] & MARK[here] | MARK[last] & (last != 0x27) & WORD[here]
    found[1:] |= (blank & (here == 0x0A))[:-1]
    return found


LONG_BLANK = re.compile(r"\s{4000}")


class ByteLevel:
    """Ids of a byte-level vocabulary of the tokenizers library, without adding special tokens.

    Its ids are those of merging by rank, if the merges stand in the order of their ids (checked), which a faster library
    does as well. plain: strings of added tokens inside a text are plain text, else they are their ids, and the texts that
    hold them are left to the tokenizers library.
    """

    def __init__(self, path, plain=False):
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = plain
        letters, entries = {v: k for k, v in byte_letters().items()}, self.library.get_vocab()
        added = {x.content for x in self.library.get_added_tokens_decoder().values()}
        self.added = [] if plain else sorted(added)
        ranks = {bytes(map(letters.__getitem__, w)): i for w, i in entries.items() if w not in added}
        merges = json.loads(self.library.to_str())["model"]["merges"]
        ids = [entries["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in merges]
        if max(entries.values()) >= 1 << 16 or ids != sorted(ids):
            raise ValueError("ids must fit into 16 bits and follow the merges")
        self.size = np.zeros(1 << 16, np.int64)
        self.size[[*ranks.values()]] = [*map(len, ranks)]
        self.encoding = tiktoken.Encoding("byte-level", pat_str=PIECE.pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text):
        if any(x in text for x in self.added) or LONG_BLANK.search(text):  # too deep for the faster one
            return self.library.encode(text, add_special_tokens=False).ids
        return self.encoding.encode_ordinary(text)

    def encode(self, text):
        return array("H", self.ids(text)).tobytes()

    def sizes(self):
        """Bytes of each id's token."""
        return self.size


_counters = {}


def counter(path):
    """One ByteLevel for each worker and file."""
    if path not in _counters:
        _counters[path] = ByteLevel(path)
    return _counters[path]


_encoders = {}


def encoder(path):
    """One encoder for each worker and file; what it remembers, some 45 MB at most, outlives the task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Encoder(dict):
    """Word -> the ids of a space and the word, as bytes; ids are those that the library gives without adding special tokens.

    A byte-level vocabulary splits at each single space before encoding, so the ids of a text are those of its words,
    each with its space, in a row. The words met last are remembered, between half of `keep` and `keep` of them: when
    half of it is full, it becomes the older half. Texts that hold the string of an added token are left to the library
    whole, which splits there first.

    `encode_all` takes many texts, cuts them where pre-tokens surely start and encodes each different stretch once: that
    goes through memory in order, where looking up every word costs more than the model. Pre-tokens are given to the
    model joined by a byte that no text and no merge has, so each is encoded as if it stood alone.
    """

    def __init__(self, path, keep=KEEP):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.half, self.older, self.short, self.letters = max(1, keep // 2), {}, {}, byte_letters()
        self.formats = [struct.Struct(f"<{n}{self.kind.char}").pack for n in range(64)]
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = Tokenizer.from_file(path).model
        self.model._resize_cache(0)  # what is remembered is remembered here
        self.joint, self.table = Tokenizer(self.model), "".join(x for _, x in sorted(self.letters.items()))
        mark, model = self.letters[APART], self.model
        alone = model.dropout or model.ignore_merges or model.continuing_subword_prefix or model.end_of_word_suffix
        self.apart = None if alone or [w for w in self.joint.get_vocab() if mark in w] != [mark] else model.token_to_id(mark)

    def encode(self, text):
        """The ids as little-endian unsigned numbers of `kind`."""
        if any(x in text for x in self.added):
            return self.packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if CROWDED.search(text):
            return b"".join([self[x[1:]] if x[0] == " " else self.pieces(x) for x in EDGE.split(text)])
        head, *rest = text.split(" ")
        return (self.pieces(head) if head else b"") + b"".join(map(self.__getitem__, rest))

    def packed(self, ids):
        return self.formats[len(ids)](*ids) if len(ids) < 64 else struct.pack(f"<{len(ids)}{self.kind.char}", *ids)

    def piece(self, text):
        """Of a single pre-token; short ones are remembered, up to 10,000 of them."""
        if (ids := self.short.get(text)) is None:
            ids = self.packed([x.id for x in self.model.tokenize(text.encode().decode("latin1").translate(self.letters))])
            if len(text) < 4 and len(self.short) < 10_000:
                self.short[text] = ids
        return ids

    def split(self, text):
        """Pre-tokens; by the library where a character may be a letter in one version of Unicode alone."""
        if text.isascii() or text.isprintable():
            return PIECE.findall(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def pieces(self, text):
        return b"".join([self[x[1:]] if x[0] == " " and x[1:].isalpha() else self.piece(x) for x in self.split(text)])

    def __missing__(self, word):
        ids = self.older.get(word)
        if ids is None:
            if word.isalpha():
                ids = self.packed([x.id for x in self.model.tokenize("Ġ" + word)]) if word.isascii() else self.piece(" " + word)
            elif word[:-1].isalpha() and word[-1] in ".,;:!?":
                ids = self[word[:-1]] + self.piece(word[-1])
            else:
                ids = self.pieces(" " + word)
        if len(word) < 64:
            if len(self) >= self.half:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def encode_all(self, column):
        """`encode` of each text of an Arrow column; null is empty."""
        texts = C.raw(column)
        if self.apart is None:
            return [self.encode(x.decode()) if x else b"" for x in texts]
        added = [x.encode() for x in self.added]
        whole = {i: self.encode(x.decode()) for i, x in enumerate(texts) if any(y in x for y in added)}
        rest = [b"" if i in whole else x for i, x in enumerate(texts)]
        ids = self.cut_up(rest) if any(rest) else rest
        return [whole.get(i, x) for i, x in enumerate(ids)]

    def cut_up(self, texts):
        data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
        starts = edges(data)
        starts[ends[ends < len(data)]] = True
        starts = np.append(np.flatnonzero(starts), len(data))
        stretches = pa.LargeStringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts), pa.py_buffer(data)).dictionary_encode()
        ids, upto = self.of(stretches.dictionary.to_numpy(zero_copy_only=False))
        numbers, width = stretches.indices.to_numpy(), self.kind.itemsize
        sizes = np.diff(upto)[numbers]
        so_far = np.concatenate([[0], np.cumsum(sizes)])
        found = ids[np.repeat(upto[numbers] - so_far[:-1], sizes) + np.arange(so_far[-1])].tobytes()
        return [found[a * width : b * width] for a, b in pairwise(so_far[np.searchsorted(starts, ends)].tolist())]

    def of(self, stretches):
        """The ids of all stretches in a row, and how many there are up to each, from 0 on."""
        pieces, upto = [], [0]
        for x in stretches:
            if (x[1:] if x[0] == " " else x).isalpha():
                pieces.append(x)
            else:
                pieces += self.split(x)
            upto.append(len(pieces))
        joined = [bytes([APART]).join([p.encode() for p in pieces[i : i + JOINED]] + [b""]) for i in range(0, len(pieces), JOINED)]
        joined = [codecs.charmap_decode(x, "strict", self.table)[0] for x in joined]
        calls = (self.joint.encode_batch_fast(joined[i : i + CALL], add_special_tokens=False) for i in range(0, len(joined), CALL))
        ids = np.concatenate([np.array(x.ids, self.kind) for call in calls for x in call])
        marks = np.flatnonzero(ids == self.apart)
        sizes = np.diff(marks, prepend=-1) - 1
        return np.delete(ids, marks), np.concatenate([[0], np.cumsum(sizes)])[upto]
