"""All queries of the sequence engine: name -> function(spark, sf_dir), and name -> the same in SQL."""

from .plans import clusters, cooccur, files, finish, hits, motifs, scans, searches, words

PLANS = (words, motifs, scans, finish, clusters, cooccur, hits, searches, files)
QUERIES = {k: f for p in PLANS for k, f in p.QUERIES.items()}
SQL = {k: s for p in PLANS for k, s in p.SQL.items()}
