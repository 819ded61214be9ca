"""Columns over sequences: strings of A, C, G, T (lower case: masked repeats) and N for missing."""

import string

from pyspark.sql import functions as F

BASES = "ACGT"
# IUPAC codes by the set of bases they stand for (A = 1, C = 2, G = 4, T = 8), and their complements: fixed values.
IUPAC = "OACMGRSVTWYHKDBN"
IUPAC_FROM, IUPAC_TO = "ACMGRSVTWYHKDBN", "TGKCYSBAWRDMHVN"

LETTERS = string.ascii_lowercase + string.ascii_uppercase
AS_BASES = "".join("ACGT"[i % 4] for i in range(26)) + "".join("acgt"[i % 4] for i in range(26))


def from_text(text):
    """Any text as a sequence: letters go round the bases, capitals masked; other ASCII drops out, the rest is missing."""
    kept = F.regexp_replace(F.coalesce(text, F.lit("")), r"[ -@\[-`{-~\n\r\t]", "")
    return F.regexp_replace(F.translate(kept, LETTERS, AS_BASES), "[^ACGTacgt]", "N")


def masked(seq, mode):
    """The bases that count: mode 0 unmasked only, 1 all, 2 masked only; the others become N."""
    if mode == 1:
        return F.upper(seq)
    return F.translate(seq, "acgt", "NNNN") if mode == 0 else F.translate(seq, "ACGTacgt", "NNNNACGT")


def revcomp(seq):
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def revcomp_consensus(pattern):
    return F.reverse(F.translate(pattern, IUPAC_FROM, IUPAC_TO))


def canonical(word):
    """The lesser of a word and its reverse complement."""
    return F.least(word, revcomp(word))


def word_code(word):
    """Base-4 number, first base least."""
    return F.conv(F.translate(F.reverse(word), BASES, "0123"), 4, 10).cast("long")


def code_word(code, length):
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.element_at(F.array(*map(F.lit, BASES)), (F.pmod(F.floor(code / F.pow(F.lit(4), i)), F.lit(4)) + 1).cast("int"))), "")


def count_cg(word):
    return (F.length(word) - F.length(F.translate(word, "CG", ""))).cast("long")


def count_cpg(word):
    return ((F.length(word) - F.length(F.replace(word, F.lit("CG"), F.lit("")))) / 2).cast("long")
