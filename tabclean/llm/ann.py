"""Nearest neighbours by a block matrix join with int8 tiles, exact in the end.

Every vector is quantised once to int8 with a scale of its own and stored. The codes are
dealt into blocks of queries and blocks of candidates; every pair of blocks is one tile, so
no task holds more than one block of each, and only codes travel. In a tile one matrix product
gives every approximate inner product. With x = x' + ex and y = y' + ey the error is at most
|ex| |y'| + |x| |ey| (Cauchy-Schwarz, norms measured and not assumed). The k-th largest
lower bound of a query cuts off every candidate whose upper bound lies below it, first in
its tile and then over all tiles; the survivors fetch their vectors and are computed again in double
precision. Heaps merge them, a batch of pairs at a time, to the k best of each query; a ranked
window ends it.

Of equal vectors only the k + 1 rows of smallest id are candidates, as no other can be among the k
nearest of any query; so copies, however many, do not survive in bulk. Vectors that differ by less than
the quantisation error all survive and are all computed. A candidate that very many queries share
is looked up by broadcast (``common.look_up``).

The int8 products are summed in float32, which is exact as long as a sum
stays below 2^24: up to 1,040 dimensions; longer vectors take float64.

Edge cases: vectors that are null, empty, zero or hold null or non-finite
components take no part, nor do rows without an id. Vectors only meet vectors of their own length.
Rows repeated with one id are rows of their own: each is a candidate, and each asks
(its neighbours may be the others). Ties go to the smaller id. A query with fewer candidates than k gets all of
them; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabclean.llm.common import hot_limit, look_up, stored

QUERY_BLOCK = 1024
CANDIDATE_BLOCK = 8192
CODES = "row bigint, vec_id bigint, asks boolean, vector array<double>, dim int, codes binary, scale double, said double, missed double"
FOUND = "query bigint, row bigint, low double, high double"


def usable(vector: Column) -> Column:
    """True for a vector that takes part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def quantise(vectors: np.ndarray):
    """int8 codes, their scale, the norm of what they say and of what they miss."""
    scale = np.abs(vectors).max(axis=1) / 127
    codes = np.rint(vectors / scale[:, None])
    said = codes * scale[:, None]
    return codes, scale, np.sqrt((said ** 2).sum(axis=1)), np.sqrt(((vectors - said) ** 2).sum(axis=1))


def tile(queries: tuple, query_rows: np.ndarray, cands: tuple, cand_rows: np.ndarray, k: int) -> Iterator[tuple]:
    """For every query of a tile: its place, the places of the candidates that survive, their bounds.

    Both sides are (int8 codes, scale, norm of what they say, norm of what they miss).
    """
    (qc, qs, qn, qe), (cc, cs, cn, ce) = queries, cands
    exact = np.float32 if qc.shape[1] * 127 * 127 < 1 << 24 else np.float64
    cc = cc.astype(exact).T.copy()
    c_norm = cn + ce  # at least the norm of the original
    for at in range(0, len(qc), 128):
        rows = slice(at, at + 128)
        near = (qc[rows].astype(exact) @ cc).astype(np.float64) * qs[rows, None] * cs[None, :]
        slack = qe[rows, None] * c_norm[None, :] + qn[rows, None] * ce[None, :]
        slack = slack * (1 + 1e-9) + 1e-12 * qn[rows, None] * c_norm[None, :]
        near[query_rows[rows, None] == cand_rows[None, :]] = -np.inf
        for j, low in enumerate(near - slack):
            cut = np.partition(low, len(low) - k)[len(low) - k] if len(low) > k else -np.inf
            live = np.flatnonzero((near[j] + slack[j] >= cut) & np.isfinite(near[j]))
            yield at + j, live, low[live], near[j, live] + slack[j, live]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _quantised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each vector with its codes; vectors of one length are quantised together."""
    for batch in batches:
        dims = batch.column("dim").to_numpy(zero_copy_only=False)
        for dim in np.unique(dims).tolist():
            part = batch.filter(pa.array(dims == dim))
            codes, *numbers = quantise(_matrix(part.column("vector"), dim))
            packed = pa.array([c.tobytes() for c in codes.astype(np.int8)], pa.binary())
            yield pa.RecordBatch.from_arrays([*part.columns, packed, *map(pa.array, numbers)],
                                             names=[*part.schema.names, "codes", "scale", "said", "missed"])


def _side(table: pa.Table, dim: int) -> tuple[tuple, np.ndarray]:
    codes = np.frombuffer(b"".join(table.column("codes").to_pylist()), np.int8).reshape(-1, dim)
    return (codes, *(table.column(c).to_numpy() for c in ("scale", "said", "missed"))), table.column("row").to_numpy()


def _tiles(k: int):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        asks = group.column("asks").to_numpy()
        (queries, q_rows), (cands, c_rows) = _side(group.filter(pa.array(asks)), dim), _side(group.filter(pa.array(~asks)), dim)
        out = [(q_rows[i], c_rows[live], low, high) for i, live, low, high in (tile(queries, q_rows, cands, c_rows, k) if len(c_rows) else ())]
        cat = lambda at, kind: np.concatenate([np.empty(0, kind), *[o[at] for o in out]])
        return pa.table({"query": np.repeat(np.array([o[0] for o in out], np.int64), [len(o[1]) for o in out]),
                         "row": cat(1, np.int64), "low": cat(2, np.float64), "high": cat(3, np.float64)})
    return run


def merge_heaps(runs: Iterable[tuple[int, int, float]], k: int) -> dict[int, list[tuple[float, int]]]:
    """Keep the k best (score, smaller id first) of each query in a heap."""
    heaps: dict[int, list] = {}
    for query, vec, score in runs:
        heap = heaps.setdefault(query, [])
        if len(heap) < k:
            heapq.heappush(heap, (score, -vec))
        elif (score, -vec) > heap[0]:
            heapq.heapreplace(heap, (score, -vec))
    return {q: [(s, -v) for s, v in sorted(heap, reverse=True)] for q, heap in heaps.items()}


def _computed(k: int):
    """Pairs with both vectors: the inner products in double precision, the k best of each query in the batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = dict(zip(batch.column("query").to_pylist(), batch.column("query_id").to_pylist()))
            dims = batch.column("dim").to_numpy(zero_copy_only=False)
            pairs = []
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                score = (_matrix(part.column("vector"), dim) * _matrix(part.column("asking"), dim)).sum(axis=1)
                pairs += zip(part.column("query").to_pylist(), part.column("vec_id").to_pylist(), score.tolist())
            rows = [(q, asked[q], v, s) for q, best in merge_heaps(pairs, k).items() for s, v in best]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.float64()))]
                                             if rows else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.float64())],
                                             names=["query", "query_id", "vec_id", "score"])
    return run


def survivors(table: DataFrame, k: int, query_block: int, candidate_block: int) -> DataFrame:
    """(query, row, low, high) of the pairs whose bounds leave them among the k nearest of a query."""
    copies = Window.partitionBy("vector").orderBy("vec_id", "row")
    codes = ["row", "dim", "codes", "scale", "said", "missed"]
    cands = stored(table.withColumn("_copy", F.row_number().over(copies)).filter(F.col("_copy") <= k + 1).select(codes), "ann-candidates")
    queries = table.filter("asks").select(codes)
    blocks_c, blocks_q = max(1, -(-cands.count() // candidate_block)), max(1, -(-queries.count() // query_block))

    def dealt(rows, own, blocks, other, others):
        block = F.pmod(F.xxhash64("row", F.lit(7)), F.lit(blocks)).alias(own)
        return rows.withColumn(own, block).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1)).cast("array<bigint>")))

    both = (dealt(cands.withColumn("asks", F.lit(False)), "cb", blocks_c, "qb", blocks_q)
            .unionByName(dealt(queries.withColumn("asks", F.lit(True)), "qb", blocks_q, "cb", blocks_c)))
    found = stored(both.select("qb", "cb", "asks", *codes).groupBy("dim", "qb", "cb").applyInArrow(_tiles(k), FOUND), "ann-found")
    if blocks_c == 1:
        return found
    lows = Window.partitionBy("query").orderBy(F.desc("low"))
    cuts = (found.withColumn("_n", F.row_number().over(lows)).filter(F.col("_n") <= k)
            .groupBy("query").agg(F.min("low").alias("_cut"), F.count(F.lit(1)).alias("_lows")).filter(F.col("_lows") == k))
    return stored(found.join(cuts.select("query", "_cut"), "query", "left")
                  .filter(F.col("_cut").isNull() | (F.col("high") >= F.col("_cut"))).select("query", "row", "low", "high"), "ann-survivors")


def nearest(vectors: DataFrame, asks: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
            query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """The k rows of largest inner product for every row where ``asks`` (on the id) holds.

    Returns query_id, rank (from 1), vec_id, score.
    """
    table = (vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"),
                            F.coalesce(asks, F.lit(False)).alias("asks"))
             .filter(F.col("vec_id").isNotNull() & usable(F.col("vector")))
             .select(F.monotonically_increasing_id().alias("row"), "vec_id", "asks", "vector", F.size("vector").alias("dim")))
    table = stored(table.mapInArrow(_quantised, CODES), "ann-codes")
    pairs = survivors(table, k, query_block, candidate_block).select("query", "row")
    wanted = table.select("row", "vec_id", "vector").join(pairs.groupBy("row").agg(F.count(F.lit(1)).alias("times")), "row")
    met = look_up(pairs, wanted, "row", "times", hot_limit(pairs.count()))
    asking = table.filter("asks").select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"), F.col("vector").alias("asking"), "dim")
    best = met.join(asking, "query").select("query", "query_id", "vec_id", "vector", "asking", "dim").mapInArrow(
        _computed(k), "query bigint, query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return (best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
