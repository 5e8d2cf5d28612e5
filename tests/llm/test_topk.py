import numpy as np
from pyspark.sql import functions as F

from pagemill.llm import queries, topk


def brute(vectors, is_query, k):
    out = []
    for q, v in vectors:
        if is_query(q):
            scored = sorted((-int(np.dot(v, w)), i) for i, w in vectors if i != q and len(w) == len(v))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(topk, "BLOCK", 32)
    monkeypatch.setattr(topk, "LONGEST", 20)
    raw = [(i, (rng.normal(size=8) * rng.choice([0.2, 1, 3])).tolist()) for i in range(300)]
    raw += [(i, raw[0][1]) for i in range(300, 360)]  # one common vector
    raw += [(400, [0.0] * 8), (420, [1e7] * 8), (440, [-1e7] * 8)]
    bad = [(500, None), (520, [1.0] * 7 + [float("nan")]), (540, [1.0] * 7 + [float("inf")]), (560, [1.0] * 7 + [None]), (None, [1.0] * 8), (580, [])]
    df = spark.createDataFrame([(i, v, "x") for i, v in raw + bad], "vec_id long, embedding array<double>, rank string").repartition(5)
    ready = df.where(topk.usable(F.col("embedding"))).withColumn("v", topk.quantise(F.col("embedding")))
    got = topk.top_k(ready, F.col("vec_id") % 20 == 0, k=7, query_bytes=6 * 64)
    want = brute([(i, np.floor(64 * np.array(v)).astype(int).astype(object)) for i, v in raw], lambda q: q % 20 == 0, 7)
    assert sorted(map(tuple, got.collect())) == want
    assert got.columns == ["query_id", "rank", "vec_id", "score"]


def test_many_lengths_of_vectors(spark):
    """Queries of 70 different lengths are all searched, among vectors of their own length."""
    rng = np.random.default_rng(5)
    rows = [(20 * d + i, rng.integers(-9, 9, d).tolist()) for d in range(1, 71) for i in (0, 1, 2)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, v array<long>"), F.col("vec_id") % 20 == 0, k=2)
    assert sorted(map(tuple, got.collect())) == brute([(i, np.array(v)) for i, v in rows], lambda q: q % 20 == 0, 2)


def test_repeated_query_ids(spark):
    rows = [(0, [1, 0]), (0, [0, 1]), (1, [5, 0]), (2, [0, 7]), (3, [1, 1])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, v array<long>"), F.col("vec_id") == 0, k=2)
    assert sorted(map(tuple, got.collect())) == [(0, 1, 2, 7), (0, 2, 1, 5)]


def test_embeddings_equal_brute_force(spark):
    """The query itself, on the given table, against all inner products."""
    d = "/root/testdata/sf0.01"
    rows = [(r.vec_id, np.floor(64 * np.array(r.embedding, dtype=float)).astype(int)) for r in queries.table(spark, d, "embeddings").collect()]
    got = [tuple(r) for r in queries.op2_topk(spark, d).select("query_id", "rank", "vec_id", "score").collect()]
    assert sorted(got) == brute(rows, lambda q: q % 20 == 0, 20)


def test_lengths_and_spectrum_prune(spark, monkeypatch):
    """Vectors of uneven length in few directions: the scan ends early and hardly any pair is scored in full."""
    monkeypatch.setattr(topk, "LONGEST", 256)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(6000, 32)) * 0.7 ** np.arange(32) * rng.lognormal(0, 1, (6000, 1))
    rows = [(i, np.floor(256 * v).astype(int).tolist()) for i, v in enumerate(x)]
    tally = {}
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, v array<long>"), F.col("vec_id") % 100 == 0, k=5, tally=tally)
    assert sorted(map(tuple, got.collect())) == brute([(i, np.array(v)) for i, v in rows], lambda q: q % 100 == 0, 5)
    assert tally["pairs"] < 0.7 * 60 * 6000 and tally["scored in integers"] < 0.05 * 60 * 6000


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1, 2]), (1, [3, 4]), (20, [1, 1, 1])], "vec_id long, v array<long>")
    assert [tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0).collect()] == [(0, 1, 1, 11)]
    assert topk.top_k(df.limit(0), F.lit(True)).collect() == []
