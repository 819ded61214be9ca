"""The engine's functions for SQL."""

from pyspark.sql.functions import udtf

FUNCTIONS = (
    "revcomp(s STRING) RETURNS STRING RETURN reverse(translate(s, 'ACGTacgt', 'TGCAtgca'))",
    "canonical_word(w STRING) RETURNS STRING RETURN least(w, reverse(translate(w, 'ACGT', 'TGCA')))",
    "word_code(w STRING) RETURNS BIGINT RETURN CAST(conv(translate(reverse(w), 'ACGT', '0123'), 4, 10) AS BIGINT)",
    "hit_p(score DOUBLE) RETURNS DOUBLE RETURN floor(100000 * pow(10, -score)) / 100000",
    "count_cg(w STRING) RETURNS BIGINT RETURN length(w) - length(translate(w, 'CG', ''))",
)


class Kmers:
    """pos, word of every clean window of a sequence; gap chooses the template."""

    def eval(self, seq: str, gap: int, length: int):
        from ..operators.kmers import templates, window_codes

        for g, span, parts in templates(length):
            if g == gap and seq:
                at, codes = window_codes(seq, span, parts)
                for p, c in zip(at.tolist(), codes.tolist(), strict=True):
                    yield p, "".join("ACGT"[(c >> (2 * j)) & 3] for j in range(length))


def register(spark):
    """Makes the functions, and the table function kmers(seq, gap, length), known to the session's SQL."""
    for f in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {f}")
    spark.udtf.register("kmers", udtf(Kmers, returnType="pos: long, word: string"))
