from strandlake.operators import validate


def found(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_rules(spark):
    fasta = validate.clean_fasta(spark.createDataFrame([("a b", "AC GU\nu"), ("a_b", "N"), ("", "AX"), (None, None), ("c", "")], "name string, seq string"))
    assert found(fasta)[:1] == [("", "AX")] and ("a_b", "ACGTt") in found(fasta)
    assert found(validate.fasta_problems(fasta)) == sorted([("", "no name", 1), ("", "wrong letter", 1), (None, "no name", 1), ("a_b", "name taken", 2)], key=repr)
    rows = spark.createDataFrame([("x", "chr1", "+", 5, 7), ("y", "1", "?", 0, 0), ("z", None, None, None, None)], "name string, chr string, strand string, len long, start long")
    every = ("chromosome", "place", "size", "strand")
    assert found(validate.coordinate_problems(rows)) == sorted([(k, p, 1) for k in "yz" for p in every], key=repr)
    hits = spark.createDataFrame([("m", "+", 8, 1.0), ("m", "x", 0, 0.0), ("NONE", None, None, None)], "motif string, strand string, len long, score double")
    assert found(validate.hit_problems(hits)) == [("m", "score", 1), ("m", "size", 1), ("m", "strand", 1)]
    tracks = spark.createDataFrame([("a", 1, [0, 100]), ("b", 0, [101]), ("c", 5, [])], "name string, interval long, values array<int>")
    assert found(validate.conservation_problems(tracks)) == [("b", "interval", 1), ("b", "value", 1), ("c", "no values", 1)]
