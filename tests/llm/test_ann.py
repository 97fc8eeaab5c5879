"""Block matrix neighbours against all inner products."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tabclean.llm import ann, queries

from conftest import SF_SMALL


def brute(ids, vectors, k):
    out = []
    for at in np.flatnonzero(ids % 20 == 0):  # every row asks, and all others are its candidates
        score = (vectors * vectors[at]).sum(axis=1)
        live = np.flatnonzero(np.arange(len(ids)) != at)
        best = live[np.lexsort((ids[live], -score[live]))[:k]]
        out += [(int(ids[at]), r + 1, int(ids[i]), float(score[i])) for r, i in enumerate(best)]
    return sorted(out)


def test_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{SF_SMALL}/embeddings.parquet')")
    want = con.execute(queries.NEAR_SQL["op7_nearest"]).fetchall()
    got = rows_of(queries.op7_nearest(spark, SF_SMALL))
    assert [g[:3] for g in got] == [w[:3] for w in sorted(want)]
    assert np.allclose([g[3] for g in got], [w[3] for w in sorted(want)], rtol=1e-9)


def test_rows_of_one_id_are_rows_of_their_own(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 2.0]), (1, [3.0, 1.0])], "vec_id bigint, embedding array<double>")
    got = rows_of(ann.nearest(table, F.col("vec_id") % 20 == 0, 2))
    assert got == sorted([(0, 1, 1, 3.0), (0, 2, 0, 0.0), (0, 1, 1, 2.0), (0, 2, 0, 0.0)])


@pytest.mark.parametrize("k", [1, 3])
def test_many_copies_and_a_candidate_of_all(spark, k, monkeypatch):
    monkeypatch.setattr(ann, "hot_limit", lambda n: 5)
    rnd = np.random.default_rng(5)
    vectors = rnd.standard_normal((400, 8))
    vectors[100:300] = vectors[100]
    vectors[377] = 50 * vectors[100]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<double>")
    got = rows_of(ann.nearest(table, F.col("vec_id") % 20 == 0, k, query_block=7, candidate_block=31))
    assert [g[:3] for g in got] == [w[:3] for w in brute(np.arange(400), vectors, k)]


def rows_of(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect())


def test_query(spark):
    rows = sorted((r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").collect())
    got = rows_of(queries.op7_nearest(spark, SF_SMALL))
    want = brute(np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float), 20)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-15)


@pytest.mark.parametrize("blocks", [(1024, 8192), (4, 10), (2, 3)])
def test_blocks_ties_and_unusable_vectors(spark, blocks):
    rnd = np.random.default_rng(1)
    vectors = rnd.integers(-3, 4, (300, 6)).astype(float)
    vectors[50:180] = vectors[50]  # a common vector
    vectors[7], vectors[40] = 1e30 * vectors[7], 1e-30 * vectors[40]
    rows = [(i, v.tolist(), "x") for i, v in enumerate(vectors) if np.abs(v).any()]
    rows += [(1000, None, "x"), (1020, [0.0] * 6, "x"), (1040, [1.0, None, 0.0, 0.0, 0.0, 0.0], "x"), (1060, [float("nan")] * 6, "x"),
             (1080, [float("inf")] * 6, "x"), (1100, [], "x"), rows[0]]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, score string")
    got = rows_of(ann.nearest(table, F.col("vec_id") % 20 == 0, 7, query_block=blocks[0], candidate_block=blocks[1]))
    usable = [*rows[:-7], rows[-1]]
    want = brute(np.array([r[0] for r in usable]), np.array([r[1] for r in usable]), 7)
    assert [g[:3] for g in got] == [w[:3] for w in want]


def test_few_candidates_and_none(spark):
    table = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0]), (20, [1.0])], "vec_id bigint, embedding array<double>")
    assert rows_of(ann.nearest(table, F.col("vec_id") % 20 == 0, 20)) == [(0, 1, 1, 4.0)]
    assert ann.nearest(table.limit(0), F.col("vec_id") % 20 == 0, 20).count() == 0


def test_error_bound_holds():
    rnd = np.random.default_rng(2)
    a, b = rnd.standard_normal((50, 64)), rnd.standard_normal((80, 64)) * rnd.uniform(0.01, 100, (80, 1))
    (ac, as_, an, ae), (bc, bs, bn, be) = ann.quantise(a), ann.quantise(b)
    near = (ac @ bc.T) * as_[:, None] * bs[None, :]
    assert (np.abs(near - a @ b.T) <= ae[:, None] * (bn + be)[None, :] + an[:, None] * be[None, :] + 1e-9).all()
