import random

import pytest

from strandlake.operators import numbering


def test_numbers_run_over_all_tasks(spark):
    values = random.Random(1).sample(range(10_000), 500)
    rows = spark.createDataFrame([(v,) for v in values], "v long").repartition(7)
    got = {r["v"]: r["n"] for r in numbering.numbered(rows, "v").collect()}
    assert got == {v: k for k, v in enumerate(sorted(values))}
    assert numbering.numbered(rows.limit(0), "v").count() == 0


def test_ids_by_first_appearance(spark):
    rows = spark.createDataFrame([("b", 5), ("a", 9), ("NONE", 0), ("b", 1), ("c", 3), (None, 2)], "k string, o long")
    got = {r["k"]: r["id"] for r in numbering.first_seen(rows, "k", "o", none="NONE").collect()}
    assert got == {"b": 1, None: 2, "c": 3, "a": 4, "NONE": 0}
    assert {r["k"]: r["id"] for r in numbering.first_seen(rows, "k", "o", start=0).collect()} == {"NONE": 0, "b": 1, None: 2, "c": 3, "a": 4}


def test_names_and_the_total_of_regions(spark):
    rows = spark.createDataFrame([(3, "x", 5), (1, None, 7), (2, "", 9)], "o long, name string, len long")
    assert {r["o"]: r["name"] for r in numbering.region_names(rows, "o").collect()} == {1: "R0000001", 2: "R0000002", 3: "x"}
    assert numbering.within(rows, 21).count() == 3
    with pytest.raises(Exception, match="regions of 21 bases"):
        numbering.within(rows, 20).collect()
