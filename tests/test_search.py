"""Searches from rows of conditions."""

import pytest

from strandlake.operators import search

HITS = "event_id long, motif string, seq_id long, strand string, len long, start long, score double, conservation long"
ROWS = [
    (1, "a", 1, "+", 8, 10, 2.0, 5), (2, "a", 1, "-", 8, 30, 1.0, None), (3, "b", 1, "+", 8, 45, 3.0, 1),
    (4, "a", 2, "+", 8, 10, 0.5, 9), (5, "b", 2, "-", 8, 90, 3.0, 9), (6, "b", 3, "+", 8, 5, 1.0, None),
]


def found(df):
    return sorted(tuple(r) for r in df.collect())


def test_conditions_are_counted_and_combined(spark):
    hits = spark.createDataFrame(ROWS, HITS)
    ask = lambda *rows: spark.createDataFrame(list(rows), search.CONDITIONS)
    two = ask((1, "a", None, None, None, None, None, None), (2, "b", None, None, None, None, None, 1))
    assert found(search.combined(hits, two)) == [(1, 2, 3), (2, 2, 2)]
    assert found(search.combined(hits, two, "or")) == [(1, 2, 3), (2, 2, 2), (3, 1, 1)]
    assert found(search.combined(hits, ask((1, "a", None, None, None, None, None, 2)))) == [(1, 1, 2)]
    assert found(search.combined(hits, ask((1, "a", 10, 18, "+", 0.6, 5, 1)))) == [(1, 1, 1)]
    assert found(search.combined(hits, ask((1, "b", None, None, None, None, 0, 1)))) == [(1, 1, 1), (2, 1, 1)]  # unknown isn't enough
    assert found(search.combined(hits.limit(0), two)) == []
    with pytest.raises(ValueError, match="how"):
        search.combined(hits, two, "xor")


def test_distance_in_either_order(spark):
    hits = spark.createDataFrame(ROWS, HITS)
    two = spark.createDataFrame([(1, "b", None, None, None, None, None, 1), (2, "a", None, None, None, None, None, 1)], search.CONDITIONS)
    assert found(search.apart(hits, two, 35)) == [(1, 2, 15)]
    assert found(search.apart(hits, two, 14)) == []


def test_sequences_by_name_symbol_and_distance(spark):
    rows = spark.createDataFrame([(1, "Chr1-x", "Sox2, Pou5f1", "-120,4000"), (2, "chr2", "sox2", "x;50"), (3, None, None, None)], "seq_id long, name string, symbols string, distances string")
    of = lambda **k: [r[0] for r in found(search.described(rows, **k))]
    assert of() == [1, 2, 3] and of(name="^chr") == [1, 2] and of(symbol="POU5F1") == [1] and of(symbol="sox") == []
    assert of(nearest=(0, 100)) == [2] and of(nearest=(-200, -100)) == [1] and of(name="chr", symbol="SOX2", nearest=(4000, 4000)) == [1]
