"""Queries that SQL can't express, against plain code or exact values."""

import os
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake import registry
from strandlake.operators import background
from strandlake.plans import clusters, scans

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def test_core_thresholds_are_near_the_exact_ones(spark):
    """What share of all 4**8 scores of the other columns lies above the quantile that the draws gave."""
    got = {r["vec_id"]: r["core_threshold"] for r in registry.QUERIES["core_threshold_mc"](spark, SF).where("vec_id < 25").collect()}
    every = {k: (m, core, least) for k, m, core, least in scans.whole_motifs(spark, SF) if k < 25}
    assert got.keys() == every.keys() and got
    for k, (m, core, least) in every.items():
        total = np.zeros(1)
        for row in np.delete(np.array(m), np.s_[core : core + 8], axis=0):
            total = (total[:, None] + row[None, :]).ravel()
        # of 10,000 draws ten lie above, give or take some five standard deviations
        assert 0.0002 < (total > least - 0.1 - got[k]).mean() < 0.0030


def test_uniform_control_is_as_long_and_as_mixed(spark):
    seqs = spark.createDataFrame([(k, "N" * n) for k, n in enumerate((0, 1, 5, 9000))], "seq_id long, u string")
    got = {r["seq_id"]: r["u"] for r in background.markov(seqs, [], seed=2).collect()}
    assert [len(got[k]) for k in range(4)] == [0, 1, 5, 9000]
    share = Counter(got[3])
    assert set(share) == set("ACGT") and all(abs(n / 9000 - 0.25) < 0.02 for n in share.values())
    pairs = Counter(zip(got[3], got[3][1:], strict=False))
    assert all(abs(n / 8999 - 1 / 16) < 0.015 for n in pairs.values())


def test_words_enriched_against_a_random_control(spark):
    """Counts in test are those of the query with a control; all that is told meets the candidates' limits."""
    got = {r["word"]: r for r in registry.QUERIES["enriched_markov"](spark, SF).collect()}
    with_control = {r["word"]: r["x"] for r in registry.QUERIES["enrichment_z"](spark, SF).collect()}
    assert len(got) > 100 and all(with_control[w] == r["x"] for w, r in got.items())
    assert all(r["z"] >= 1.643 and r["ratio"] >= 1.5 and r["x"] > r["y"] for r in got.values())


def test_found_clusters_are_ranked_by_their_best_member(spark, monkeypatch):
    rows = spark.createDataFrame([("b", 4, 2.0), ("b", 4, 2.0), ("a", 9, 1.0), ("c", 1, 5.0)], "cluster string, members long, best double")
    monkeypatch.setattr(clusters, "cluster_matrices", lambda *_: rows)
    got = {r["cluster"]: (r["members"], r["width"], r["score"]) for r in clusters.cluster_rank_found(spark, SF).collect()}
    assert got == {"b": (4, 2, 4.0), "a": (9, 1, 3.0), "c": (1, 1, 5.0)}


def test_progress_of_the_refinement_is_read_back(spark):
    """The file's rows are those of the loop: every motif and turn once, sub-turns 1 to 3, the last turn's only one."""
    rows = registry.QUERIES["refine_loop"](spark, SF).cache()
    assert rows.groupBy("motif", "turn", "sub_turn").count().where("count > 1").count() == 0
    kinds = {tuple(r) for r in rows.select("turn", "sub_turn").distinct().collect()}
    assert kinds <= {(t, s) for t in (1, 2, 3) for s in (1, 2, 3)} | {(4, 1)} and (4, 1) in kinds
    assert rows.where((F.col("n1") > F.col("all1")) | (F.col("n2") > F.col("all2")) | F.col("threshold").isNull()).count() == 0


@pytest.mark.parametrize("name", ["flank_gtest_gapped", "top_motifs_gapped"])
def test_discovery_over_all_templates_against_sql(spark, name):
    """SQL that is too slow for larger tables; the second builds on the first, and on the p-values and fdr between."""
    duck = pytest.importorskip("duckdb").connect()
    duck.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    got, want = registry.QUERIES[name](spark, SF), duck.sql(scans.SLOW_SQL[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert sorted(map(repr, map(tuple, got.select(cols).collect()))) == sorted(map(repr, want.select(*cols).fetchall()))
