"""The sequence engine: hand-made fixtures, invariants, and queries against their SQL on the smallest tables."""

import itertools
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandlake import registry
from strandlake.functions import pfm, seq, stats
from strandlake.operators import enrich, hits, kmers, motifs, scan
from strandlake.sources import text
from strandlake.streaming.hits import windowed_counts

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
AGAINST_SQL = """seq_normalize seq_stats mask_modes revcomp kmer_count_gap0 kmer_mean_ss cg_adjust markov3_transitions enrichment_z enriched_words
distrib_histogram distrib_quantiles abundance hit_spans sequence_summary search_dist hit_pairs hits_resolved region_split extract_regions validate_upload normal_cdf gamma_q lower_bound
pwm_logodds pfm_consensus display_consensus self_similarity scan_core scan_threshold motif_pairs palindromes motif_components kmeans_step scan_hits calibrate_threshold refine_regression
paged scan_consensus hit_conflicts pair_frames search_names region_coordinates fasta_file pfm_file meme_file hits_file positions_file conservation_file bed_file coordinates_file
sql_functions pwm_consensus motif_edit validate_motifs kmeans_distance repeats_file repeat_annotate enrichment_cg""".split()


def seqs(spark, rows):
    return spark.createDataFrame([(k, g, s, s.upper()) for k, (g, s) in enumerate(rows)], "seq_id long, grp string, s string, u string")


def counted(df):
    return {(r["grp"], r["gap"], r["word"]): (r["n"], r["n_all"], r["docs"]) for r in df.collect()}


def test_words_do_not_overlap(spark):
    got = counted(kmers.count_words(seqs(spark, [("test", "A" * 20), ("ctrl", "ACGTACGTN"), ("ctrl", "ACGT"), ("ctrl", "")])))
    assert got == {("test", 0, "AAAAAAAA"): (2, 13, 1), ("ctrl", 0, "ACGTACGT"): (1, 1, 1)}


@pytest.mark.parametrize("length", [6, 8])
def test_words_against_brute_force(spark, length):
    rng = random.Random(length)
    rows = [(rng.choice(["test", "ctrl"]), "".join(rng.choices("ACGTN", [5, 3, 3, 5, 0.3], k=rng.randrange(5, 120)))) for _ in range(30)]
    want = {}
    for gap, span, parts in kmers.templates(length):
        for g, s in rows:
            last = {}
            for i in range(len(s) - span + 1):
                if "N" not in (w := s[i : i + span]):
                    word = "".join(w[a : a + n] for a, n in parts)
                    x = want.setdefault((g, gap, word), [0, 0, 0])
                    x[1] += 1
                    x[2] += word not in last
                    if i >= last.get(word, -span) + span:
                        x[0] += 1
                        last[word] = i
    got = counted(kmers.count_words(seqs(spark, rows), length, tuple(range(9))))
    assert got == {k: tuple(v) for k, v in want.items()}


def test_planted_word_comes_first(spark):
    rng = random.Random(3)
    made = lambda: "".join(rng.choices("ACGT", k=400))
    rows = [("test", (s := made())[:200] + "GATTACAG" * (k < 30) + s[200:]) for k in range(40)] + [("ctrl", made()) for _ in range(40)]
    table = seqs(spark, rows)
    st = enrich.statistics(enrich.fold(kmers.pivot_groups(kmers.count_words(table))), enrich.lengths(table), {0: 8})
    best = enrich.candidates(st).orderBy(F.desc("z"), "word").first()
    assert best["word"] == min("GATTACAG", "CTGTAATC") and best["x"] >= 30


def test_false_discovery_is_monotone(spark):
    rng = random.Random(4)
    rows = spark.createDataFrame([(0, f"w{k:03d}", rng.random() ** 3, 300) for k in range(100)], "gap long, word string, p double, n_hyp long")
    got = sorted((r["p"], r["fdr"]) for r in enrich.false_discovery(rows).collect())
    assert all(a[1] <= b[1] for a, b in itertools.pairwise(got)) and all(f >= min(1, p) for p, f in got)


def test_statistics_agree_with_the_library(spark):
    import math

    xs = [-4.0, -1.0, -0.1, 0.0, 0.5, 2.0, 5.0]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", stats.erfc(F.col("x")).alias("e"), *(stats.gamma_q(d, F.abs("x")).alias(f"q{d}") for d in (1, 4, 7, 12)))
    for r in rows.collect():
        assert abs(r["e"] - math.erfc(r["x"])) < 2e-7
        x = abs(r["x"])
        assert abs(r["q4"] - math.exp(-x) * (1 + x)) < 1e-9
        for d in (1, 7, 12):
            grid = np.linspace(0, x**0.5, 200_001)
            inside = np.trapezoid(2 * grid ** (d - 1) * np.exp(-(grid**2)), grid) / math.gamma(d / 2)
            assert abs(r[f"q{d}"] - (1 - inside)) < 1e-5


def test_strings_and_matrices(spark):
    row = spark.createDataFrame([("ACGTN", "acRYN", [[10.0, 70.0, 10.0, 10.0], [25.0, 25.0, 25.0, 25.0]])], "w string, p string, m array<array<double>>")
    got = row.select(seq.revcomp(F.col("w")), seq.revcomp_consensus(F.upper("p")), pfm.consensus(F.col("m")), seq.code_word(seq.word_code(F.lit("GATTACAG")), 8), pfm.information(F.col("m"))[1], pfm.from_consensus(F.lit("AN"))).first()
    assert list(got)[:4] == ["NACGT", "NRYGT", "CN", "GATTACAG"]
    assert abs(got[4]) < 1e-12 and got[5] == [[100, 0, 0, 0], [25, 25, 25, 25]]


def test_hits_in_conflict(spark):
    rows = [(1, "a", 1, "+", 8, 0, 5.0), (2, "b", 1, "+", 8, 4, 5.0), (3, "b", 1, "+", 8, 7, 4.0), (4, "a", 1, "-", 8, 30, 1.0), (5, "a", 2, "-", 8, 2, 1.0)]
    table = spark.createDataFrame(rows, "event_id long, motif string, seq_id long, strand string, len long, start long, score double")
    assert sorted(r["event_id"] for r in hits.resolve(table).collect()) == [1, 4, 5]
    assert sorted((r["seq_id"], r["start"], r["end"], r["n"]) for r in hits.spans(table).collect()) == [(1, 0, 15, 3), (1, 30, 38, 1), (2, 2, 10, 1)]
    assert {(r["a_event_id"], r["b_event_id"]) for r in hits.later_pairs(table, 7).collect()} == {(1, 2), (1, 3), (2, 3)}
    assert hits.resolve(table.limit(0)).count() == 0


def test_spans_of_tied_hits_never_overlap(spark):
    """Many hits of the same start, against plain code."""
    rng = random.Random(5)
    rows = [(k, rng.randrange(3), rng.randrange(300), 8) for k in range(40)] * 6
    rows = [(i, "m", s, "+", n, at, 1.0) for i, (_, s, at, n) in enumerate(rows)]
    rng.shuffle(rows)
    want = []
    for s in range(3):
        end = None
        for at in sorted(r[5] for r in rows if r[2] == s):
            if end is None or at > end:
                want.append([s, at, at + 8, 0])
            end = at + 8
            want[-1][2:] = [end, want[-1][3] + 1]
    table = spark.createDataFrame(rows, "event_id long, motif string, seq_id long, strand string, len long, start long, score double").repartition(5)
    assert sorted((r["seq_id"], r["start"], r["end"], r["n"]) for r in hits.spans(table).collect()) == sorted(map(tuple, want))


def test_similar_pairs_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    flat = rng.normal(size=(30, 64))
    flat[7], flat[9] = flat[3] + rng.normal(size=64) * 0.1, flat[4][::-1]
    table = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(flat)], "id long, flat array<double>")
    whole = sorted(map(tuple, motifs.similar_pairs(table, None, 0.3).collect()))
    monkeypatch.setattr(motifs, "BLOCK", 4)
    assert sorted(map(tuple, motifs.similar_pairs(table, None, 0.3).collect())) == whole
    found = {(a, b): (d, o) for a, b, r, d, o in whole if r > 0.9}
    assert found == {(3, 7): (1, 0), (4, 9): (-1, 0)}
    groups = dict(map(tuple, motifs.groups(table, motifs.similar_pairs(table, None, 0.9)).collect()))
    assert groups[7] == 3 and groups[9] == 4 and groups[5] == 5


def test_pairs_of_thousands_of_motifs(spark):
    """As compared one by one, though the similarity is taken of few pairs only."""
    rng = np.random.default_rng(8)
    flat = rng.normal(size=(4000, 64))
    flat[2000:2040] = flat[:40, ::-1] + rng.normal(size=(40, 64)) * 0.3
    flat[3000:3040, :60] = flat[40:80, 4:] + rng.normal(size=(40, 60)) * 0.3
    table = spark.createDataFrame([(k * 7 % 4001, x.tolist()) for k, x in enumerate(flat)], "id long, flat array<double>").repartition(4)
    assert sum(len(i) for i, _ in motifs.near(flat, flat, 16, 0.5)) < 0.01 * 4000**2
    found = {(r["a"], r["b"]): (r["r"], r["dir"], r["offset"]) for r in motifs.similar_pairs(table, None, 0.5).collect()}
    ids = np.arange(4000) * 7 % 4001
    some = np.r_[0:20, 40:60, 2020:2030, 3060:3070]  # these against all, by the plain similarity
    want = {}
    for i in some:
        ahead, o1 = motifs.similarity(flat[i : i + 1], flat, 16, match=0.5)
        back, o2 = motifs.similarity(flat[i : i + 1], motifs.backward(flat), 16, match=0.5)
        for j in range(4000):
            if ids[i] < ids[j] and max(ahead[0, j], back[0, j]) >= 0.5:
                want[ids[i], ids[j]] = (ahead[0, j], 1, o1[0, j]) if ahead[0, j] >= back[0, j] else (back[0, j], -1, o2[0, j])
    got = {k: v for k, v in found.items() if k[0] in set(ids[some])}
    assert len(want) > 40 and got.keys() == want.keys()
    assert all(abs(got[k][0] - want[k][0]) < 1e-12 and got[k][1:] == want[k][1:] for k in want)


def test_pairs_of_two_libraries(spark):
    """Left against right only, whichever id is the lesser, as compared one by one."""
    rng = np.random.default_rng(9)
    flat = rng.normal(size=(700, 64))
    flat[600:620, :56] = flat[:20, 8:] + rng.normal(size=(20, 56)) * 0.3
    flat[20:40] = flat[620:640, ::-1] + rng.normal(size=(20, 64)) * 0.3
    left, right = (spark.createDataFrame([(int(k), flat[k].tolist()) for k in ks], "id long, flat array<double>") for ks in (range(0, 700, 2), range(1, 700, 2)))
    got = {(r["a"], r["b"]): (r["r"], r["dir"], r["offset"]) for r in motifs.similar_pairs(left, right, 0.4).collect()}
    x, y = flat[::2], flat[1::2]
    (ahead, o1), (back, o2) = motifs.similarity(x, y, 16, match=0.4), motifs.similarity(x, motifs.backward(y), 16, match=0.4)
    want = {(2 * i, 2 * j + 1): (ahead[i, j], 1, o1[i, j]) if ahead[i, j] >= back[i, j] else (back[i, j], -1, o2[i, j]) for i, j in np.argwhere(np.maximum(ahead, back) >= 0.4).tolist()}
    assert got.keys() == want.keys() and all(abs(got[k][0] - want[k][0]) < 1e-12 and got[k][1:] == want[k][1:] for k in want)
    assert sum(len(i) for i, _ in motifs.near(x, y, 16, 0.4)) < 0.05 * 350**2


def test_links_are_made_fewer_before_groups_are_sought(spark):
    rng = random.Random(4)
    links = [tuple(rng.sample(range(300), 2)) for _ in range(180)] + [(k, k + 1) for k in range(400, 900)] + [(7, 7)]
    root = {k: k for k in range(1000)}  # plain code: each link relabels a whole group
    for a, b in links:
        one, two = sorted((root[a], root[b]))
        root = {k: one if v == two else v for k, v in root.items()}
    table = spark.createDataFrame(links * 3, "a long, b long").repartition(5)
    assert dict(map(tuple, motifs.groups(spark.range(1000), table).collect())) == root
    batches = [pa.record_batch([pa.array([a for a, _ in links[k::4]]), pa.array([b for _, b in links[k::4]])], names=["a", "b"]) for k in range(4)]
    for most in (1, 1 << 20):
        left = [r for b in motifs.forest(iter(batches * 50), most) for r in b.to_pylist()]
        assert all(root[r["a"]] == root[r["b"]] and r["b"] < r["a"] for r in left)
    assert len(left) == sum(k != v for k, v in root.items())
    assert not list(motifs.forest(iter([])))


def test_kmeans_invariants(spark):
    rng = np.random.default_rng(6)
    base = rng.random((3, 64)) * 50
    table = spark.createDataFrame([(k, (base[k % 3] + rng.random(64)).tolist()) for k in range(60)], "id long, flat array<double>")
    got = dict((r["id"], r["cluster"]) for r in motifs.kmeans(table, 3, seed=2).collect())
    assert len(got) == 60 and motifs.kmeans(table, 3, seed=2).agg(F.max("distance")).first()[0] < 100


def test_scan_both_strands(spark):
    rows = [("test", "AAGATTACAGAA"), ("test", "CTGTAATC"), ("test", "GATTNCAG")]
    one_hot = [[1.0 if c == b else 0.0 for b in "ACGT"] for c in "GATTACAG"]
    got = scan.scan(seqs(spark, rows), scan.word_scores([("m", one_hot)]), 8.0)
    assert sorted((r["seq_id"], r["strand"], r["start"]) for r in got.collect()) == [(0, "+", 2), (1, "-", 0)]
    around = {(r["place"], r["base"]): r["n"] for r in scan.flanks(seqs(spark, rows), ["GATTACAG"]).collect()}
    assert around == {(-2, "A"): 1, (-1, "A"): 1, (1, "A"): 1, (2, "A"): 1}


def test_text_formats_round_trip(spark, tmp_path):
    fasta = spark.createDataFrame([("s1", "ACGT" * 60), ("s2", "acgtNacgtAA")], "name string, seq string")
    text.write_fasta(fasta, f"{tmp_path}/fa")
    assert sorted(map(tuple, text.read_fasta(spark, f"{tmp_path}/fa").collect())) == sorted(map(tuple, fasta.collect()))
    (tmp_path / "m.txt").write_text("Headers:\tName\n>SOX\tCCWT\tAWGG\t12813\t4.5\n0\t2\t72\t13\t13\n1\t5\t80\t5\t10\n\n>B\tAC\n0 1 2 3 4\n")
    got = text.read_pfm(spark, f"{tmp_path}/m.txt")
    rows = {r["name"]: r for r in got.collect()}
    assert rows["SOX"]["pfm"] == [[2.0, 72.0, 13.0, 13.0], [5.0, 80.0, 5.0, 10.0]] and rows["SOX"]["freq"] == 12813
    assert (rows["B"]["freq"], rows["B"]["ratio"], rows["B"]["pfm"]) == (100, 2.0, [[1.0, 2.0, 3.0, 4.0]])
    text.write_pfm(got, f"{tmp_path}/pfm")
    assert sorted(map(str, text.read_pfm(spark, f"{tmp_path}/pfm").collect())) == sorted(map(str, got.collect()))
    (tmp_path / "meme.txt").write_text("MEME version 4\nMOTIF x\nletter-probability matrix: alength= 4 w= 6 nsites= 100\n" + " 0.1 0.2 0.3 0.4\n" * 6)
    meme = text.read_meme(spark, f"{tmp_path}/meme.txt").first()
    assert (meme["name"], meme["nsites"], len(meme["pfm"])) == ("x", 100, 6)
    (tmp_path / "hits.txt").write_text("Headers:\tTF\tSeq\nSTAT3\tP3\t-\t9\t119\t4.39\tTTCCCGGAA\t40\nNONE\tP4\n")
    found = {r["seq_name"]: r for r in text.read_hits(spark, f"{tmp_path}/hits.txt").collect()}
    assert found["P3"]["conservation"] == 40 and found["P4"]["start"] is None
    (tmp_path / "c.txt").write_text(">s1\n1,2,3\n4\n")
    assert text.read_conservation(spark, f"{tmp_path}/c.txt").first()["values"] == [1, 2, 3, 4]
    (tmp_path / "b.bed").write_text("chr8\t3\t9\tr1\t0\t-\nchr8 1 4\n")
    regions = text.read_bed(spark, f"{tmp_path}/b.bed")
    chromosomes = spark.createDataFrame([("chr8", "ACGTTGCAAC")], "chr string, seq string")
    assert sorted(map(tuple, text.extract(regions, chromosomes, width=4).collect())) == [("chr8:1", "CGT"), ("r1", "TTGCAA")]


def test_stream_of_hits(spark, tmp_path):
    rows = spark.createDataFrame([(f"2024-01-01 00:{m:02d}:00", "a" if m % 2 else "b", float(m)) for m in range(60)], "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(f"{tmp_path}/in")
    stream = windowed_counts(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), "30 minutes")
    query = stream.writeStream.outputMode("complete").format("memory").queryName("counts").start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r["motif"], r["n"], r["best"]) for r in spark.table("counts").collect()) == [("a", 15, 29.0), ("a", 15, 59.0), ("b", 15, 28.0), ("b", 15, 58.0)]


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("no tables")
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", AGAINST_SQL)
def test_query_against_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, SF), duck.sql(registry.SQL[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert sorted(map(repr, map(tuple, got.select(*(f"`{c}`" for c in cols)).collect()))) == sorted(map(repr, want.select(*(f'"{c}"' for c in cols)).fetchall()))


def test_every_query_has_a_callable():
    assert set(registry.SQL) <= set(registry.QUERIES) and all(map(callable, registry.QUERIES.values()))


def test_entry_without_the_text_operators(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "strandlake", tmp_path / "strandlake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert 'enriched_words' in e.queries() and not any(n.startswith('op') for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_background_follows_its_transitions(spark):
    from strandlake.operators import background

    table = seqs(spark, [("test", "A" * 4000), ("test", "ACG"), ("test", "")])
    got = {r["seq_id"]: r["u"] for r in background.markov(table, [(a + b + c, c, 1) for a in "ACGT" for b in "ACGT" for c in "ACGT"]).collect()}
    assert [len(got[k]) for k in range(3)] == [4000, 3, 0] and len(set(got[0][3:])) == 1
    assert got == {r["seq_id"]: r["u"] for r in background.markov(table, [(a + b + c, c, 1) for a in "ACGT" for b in "ACGT" for c in "ACGT"]).collect()}


def test_whole_motifs_are_scanned(spark):
    """Every motif over all 16 columns, against brute force; a bound on eight columns must not lose a hit."""
    rng = np.random.default_rng(11)
    wide = [(k, np.log10(4 * rng.dirichlet([0.4] * 4, 16) + 0.04).tolist(), core, least) for k, core, least in ((3, 0, 1.0), (4, 5, -1.0), (5, 8, 2.0))]
    rows = [("test" if k % 2 else "ctrl", "".join(rng.choice(list("ACGTN"), n, p=[0.26, 0.23, 0.23, 0.26, 0.02]))) for k, n in enumerate((400, 0, 15, 16, 300, 60))]
    want = set()
    for motif, m, _, least in wide:
        for k, (_, s) in enumerate(rows):
            for i in range(len(s) - 15):
                w = s[i : i + 16]
                if "N" in w:
                    continue
                for strand, t in (("+", w), ("-", w[::-1].translate(str.maketrans("ACGT", "TGCA")))):
                    score = round(sum(m[j]["ACGT".index(c)] for j, c in enumerate(t)), 6)
                    if score >= least:
                        want.add((motif, k, strand, i, score))
    for most in (32768, 2):
        got = scan.wide_scan(seqs(spark, rows), wide, most=most).collect()
        assert len(got) == len(want) and {(r["motif"], r["seq_id"], r["strand"], r["start"], round(r["score"], 6)) for r in got} == want
    assert len({x[0] for x in want}) == 3 and scan.wide_scan(seqs(spark, rows), []).count() == 0


def test_motifs_of_all_widths_share_one_index():
    """Brute force over widths with one block, several, and columns left over; strong and weak thresholds."""
    rng = np.random.default_rng(4)
    motifs = []
    for k, width in enumerate((8, 9, 11, 15, 16, 17, 23, 24, 31, 16, 8)):
        m = np.log10(4 * rng.dirichlet([0.3] * 4, width) + 0.04)
        motifs.append((k, m.tolist(), int(rng.integers(0, width - 7)), float(m.max(axis=1).sum() * rng.choice([0.2, 0.4, 0.6]))))
    bases = rng.choice([0, 1, 2, 3, 4], 1500, p=[0.25, 0.24, 0.24, 0.25, 0.02])
    text = "".join("ACGTN"[b] for b in bases)
    want = set()
    for k, m, _, least in motifs:
        m = np.array(m)
        for strand, turned in (("+", m), ("-", m[::-1, ::-1])):
            for i in range(len(bases) - len(m) + 1):
                w = bases[i : i + len(m)]
                if (w < 4).all() and round(turned[np.arange(len(m)), w].sum(), 6) >= least:
                    want.add((k, strand, i))
    _, span, parts = kmers.templates(8)[0]
    for room in (1, 1000, 1 << 20):
        got = [(k, strand, i) for k, strand, at, _ in scan.Index(motifs).hits(bases, *kmers.window_codes(text, span, parts), np.concatenate([[0], np.cumsum(bases > 3)]), room=room) for i in at.tolist()]
        assert len(got) == len(want) and set(got) == want
    assert len({k for k, _, _ in want}) > 5 and len(scan.Index(motifs).post) < len(motifs) * 65536 / 4


def test_scan_whole_takes_every_motif(spark):
    """All rows of embeddings, not one of each label, in 16 columns: the strand and place of a planted best window."""
    if not os.path.isdir(SF):
        pytest.skip("no tables")
    from strandlake.plans import scans

    every = list(scans.whole_motifs(spark, SF))
    assert len(every) == spark.read.parquet(f"{SF}/embeddings.parquet").count() and all(len(m) == 16 for _, m, _, _ in every)
    best = ["".join("ACGT"[int(np.argmax(r))] for r in m) for _, m, _, _ in every]
    got = scan.wide_scan(seqs(spark, [("test", b) for b in best]), every).where("motif = seq_id and strand = '+' and start = 0")
    assert got.count() == len(every)


def test_queries_over_whole_hits(spark):
    """What is counted from the hits of all 16 columns agrees with the hits themselves."""
    if not os.path.isdir(SF):
        pytest.skip("no tables")
    from strandlake.plans import scans

    rows = scans.scan_whole(spark, SF).where("vec_id < 20").collect()
    assert {len(r["match"]) for r in rows} == {16}
    n = {k: sum(r["vec_id"] == k and r["grp"] == "test" for r in rows) for k in range(20)}
    fp = {r["vec_id"]: r["n1"] for r in scans.fp_whole(spark, SF).where("vec_id < 20").collect()}
    assert all(fp.get(k, 0) == v for k, v in n.items())
    f1 = {}
    for r in scans.refine_counts_whole(spark, SF).where("vec_id < 20").collect():
        f1[r["vec_id"], r["p"]] = f1.get((r["vec_id"], r["p"]), 0) + r["f1"]
    assert all(v == n[k] for (k, _), v in f1.items()) and {p for _, p in f1} == set(range(1, 17))
    again = {(r["vec_id"], r["seq_id"], r["strand"], r["start"]): r["again"] for r in scans.rescore_whole(spark, SF).where("vec_id < 20").collect()}
    assert len(again) == len(rows) and all(abs(again[r["vec_id"], r["seq_id"], r["strand"], r["start"]] - r["score"]) < 1e-4 for r in rows)


def test_flanks_of_spaced_words(spark):
    """Bases around the whole span of a word, on either strand, against brute force for every template."""
    rng, turn = random.Random(12), str.maketrans("ACGT", "TGCA")
    rows = [("test", "".join(rng.choices("ACGTN", [5, 5, 5, 5, 0.2], k=80))) for _ in range(6)]
    rows = [*rows, ("ctrl", rows[0][1]), ("ctrl", rows[1][1][::-1].translate(turn))]
    names, want = {}, {}
    for gap, span, parts in kmers.templates(8):
        word = lambda f: "".join(f[a : a + n] for a, n in parts)  # noqa: E731, B023
        names[gap] = sorted({word(s[i : i + span]) for _, s in rows[:2] for i in range(0, 80 - span, 7) if "N" not in s[i : i + span]})
        for g, s in rows:
            for i in range(len(s) - span + 1):
                if "N" in s[i : i + span]:
                    continue
                for t, at in ((s, i), (s[::-1].translate(turn), len(s) - i - span)):
                    w = word(t[at : at + span])
                    if w not in names[gap] or (t is not s and word(s[i : i + span]) == w):
                        continue
                    skipped = sorted(set(range(span)) - {x for a, n in parts for x in range(a, a + n)})
                    for place in (-2, -1, 1, 2, *(100 + o for o in skipped)):
                        k = at + place - 100 if place >= 100 else at + place if place < 0 else at + span - 1 + place
                        if 0 <= k < len(t) and t[k] != "N":
                            key = (g, gap, w, place, t[k])
                            want[key] = want.get(key, 0) + 1
    got = {tuple(r)[:5]: r["n"] for r in scan.flanks(seqs(spark, rows), names).select("grp", "gap", "word", "place", "base", "n").collect()}
    assert got == want and {k[1] for k in want} == set(range(9))


def test_report_ranks_all_templates(spark):
    if not os.path.isdir(SF):
        pytest.skip("no tables")
    top = registry.QUERIES["top_motifs_gapped"](spark, SF).collect()
    assert {r["gap"] for r in top} - {0} and [r["z"] for r in top] == sorted((r["z"] for r in top), reverse=True)
    plain = {r["word"]: r["fdr"] for r in registry.QUERIES["fdr_bh"](spark, SF).collect()}
    rows = registry.QUERIES["fdr_bh_gapped"](spark, SF).collect()
    assert {r["word"]: r["fdr"] for r in rows if r["gap"] == 0} == plain and len({r["gap"] for r in rows}) > 1


@pytest.mark.parametrize("name", ["enrichment_z_gapped", "enriched_words_gapped"])
def test_spaced_words_against_sql(spark, duck, name):
    test_query_against_sql(spark, duck, name)
