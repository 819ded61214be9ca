"""Columns over motifs: matrices of one row a position and four cells, A, C, G, T."""

from pyspark.sql import functions as F

from .seq import IUPAC

each = F.transform


def total(row):
    return F.aggregate(row, F.lit(0.0), lambda a, x: a + x)


def from_vector(vector, scale=8.0, width=16):
    """A flat vector as a matrix of log weights, each row centred on 0."""
    raw = each(F.sequence(F.lit(0), F.lit(width - 1)), lambda p: each(F.slice(vector, p * 4 + 1, F.lit(4)), lambda x: x.cast("double") * scale))
    return each(raw, lambda r: each(r, lambda x: x - total(r) / 4))


def percent(logs):
    """Rows of log weights as percent."""
    return each(logs, lambda r: each(r, lambda x: 100 * F.exp(x) / total(each(r, lambda y: F.exp(y)))))


def logodds(pfm):
    """log10 of four times the share, with a hundredth of the row's sum added to each cell (1 if that is 0 or above 1)."""

    def row(r):
        add = total(r) / 100
        add = F.when((add <= 0) | (add > 1), 1.0).otherwise(add)
        return each(r, lambda x: F.log10(4 * (x + add) / (total(r) + 4 * add)))

    return each(pfm, row)


def centred(pfm, add=1.0):
    """ln(cell + add), less the row's mean."""
    return each(pfm, lambda r: each(r, lambda x: F.log(x + add) - total(each(r, lambda y: F.log(y + add))) / 4))


def information(pfm):
    """Bits of each row: 2 less its entropy."""
    term = lambda p: F.when(p > 0, p * F.log2(p)).otherwise(0.0)
    return each(pfm, lambda r: 2 + total(each(r, lambda x: term(x / total(r)))))


def consensus(pfm, share=0.5, strict=True):
    """IUPAC letters of the bases above share of the row's largest."""

    def letter(r):
        top = F.array_max(r) * share
        bits = F.aggregate(F.sequence(F.lit(0), F.lit(3)), F.lit(0), lambda a, k: a + F.when((r[k] > top) if strict else (r[k] >= top), F.shiftleft(F.lit(1), 0) * F.pow(F.lit(2), k).cast("int")).otherwise(0))
        return F.substring(F.lit(IUPAC), bits + 1, F.lit(1))

    return F.array_join(each(pfm, letter), "")


def display(pfm):
    """Strong bases in capitals (twice the second), weak ones small (1.3 times), two alike as a pair (twice the third), else _."""

    def letter(r):
        s = F.reverse(F.array_sort(F.transform(r, lambda x, i: F.struct(x.alias("x"), (-i).alias("i")))))
        x, i = (lambda k: s[k]["x"]), (lambda k: -s[k]["i"])
        pair = F.concat(F.least(i(0), i(1)).cast("string"), F.greatest(i(0), i(1)).cast("string"))
        named = F.element_at(F.create_map(*(F.lit(v) for kv in (("01", "m"), ("02", "r"), ("03", "w"), ("12", "s"), ("13", "y"), ("23", "k")) for v in kv)), pair)
        one = lambda letters: F.substring(F.lit(letters), i(0) + 1, F.lit(1))
        return F.when(x(0) >= 2 * x(1), one("ACGT")).when(x(0) >= 1.3 * x(1), one("acgt")).when(x(1) >= 2 * x(2), named).otherwise("_")

    return F.array_join(each(pfm, letter), "")


def reverse(pfm):
    return F.reverse(each(pfm, lambda r: F.reverse(r)))


def row_ratio(row):
    return F.array_max(row) / F.greatest(F.array_min(row), F.lit(1.0))


def dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def self_similarity(pfm, width=16, offsets=(1, 2, 3)):
    """Largest uncentred correlation of the centred logs with themselves, shifted; at least 0."""
    flat = F.flatten(centred(pfm))
    best = F.lit(0.0)
    for o in offsets:
        a, b = F.slice(flat, 1, 4 * (width - o)), F.slice(flat, 4 * o + 1, 4 * (width - o))
        size = F.sqrt(dot(a, a) * dot(b, b))
        best = F.greatest(best, F.when(size > 0, dot(a, b) / size).otherwise(0.0))
    return best


def from_consensus(pattern):
    """Equal whole percents for the bases that each IUPAC letter stands for."""

    def row(c):
        bits = F.instr(F.lit(IUPAC), c) - 1
        on = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.pmod(F.floor(bits / F.pow(F.lit(2), k)), F.lit(2)))
        n = F.aggregate(on, F.lit(0).cast("bigint"), lambda a, x: a + x)
        return F.transform(on, lambda x: F.when(x == 1, F.floor(F.lit(100) / n)).otherwise(0).cast("long"))

    return F.transform(F.split(pattern, ""), row)


def weight_consensus(pwm, drop):
    """IUPAC letters of the bases whose weight is at most `drop` below the row's largest."""

    def letter(r):
        bits = F.aggregate(F.sequence(F.lit(0), F.lit(3)), F.lit(0), lambda a, k: a + F.when(r[k] >= F.array_max(r) - drop, F.pow(F.lit(2), k).cast("int")).otherwise(0))
        return F.substring(F.lit(IUPAC), bits + 1, F.lit(1))

    return F.array_join(each(pwm, letter), "")
