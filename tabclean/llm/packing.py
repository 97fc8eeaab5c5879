"""Packing along a space-filling curve.

Every document becomes a hashed vector of its token ids (feature hashing with
signs, unit length), projected to ``DIMS`` dimensions by fixed random
directions and squashed into a grid; its cell's place on the Hilbert curve is
its key. The documents are range-sorted by the key, and their tokens follow
one another along the curve, cut into sequences of ``length`` tokens: near
documents share sequences, and only the last sequence is padded.

The sort moves keys and lengths only, in range partitions whose offsets are
added up; the ids move once, to meet their position.

Edge cases: a null text counts as empty, which is the end id alone. Equal
keys go by id. Rows repeated with one id are packed each. An empty table gives
no rows. A document longer than a sequence is cut into pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabclean.llm.chunks import encoder
from tabclean.llm.common import slices, stored
from tabclean.operators.rank import prefix_sums

LENGTH = 2048
DIMS, GRID_BITS, HASHED = 3, 10, 256
PIECES = ("_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")


def hilbert_keys(cells: np.ndarray, bits: int = GRID_BITS) -> np.ndarray:
    """Place of each grid cell (a row of whole numbers below 2^bits) on the Hilbert curve.

    Skilling's transform: undo the excess turns from the top bit down, Gray
    encode, then interleave the bits of the axes.
    """
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(dims):
            turned = (x[i] & q) != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(turned, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where(x[-1] & q, q - 1, 0)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | (x[i] >> b) & 1
    return key


def directions() -> np.ndarray:
    return np.random.default_rng(20240607).standard_normal((HASHED, DIMS))


def cells_of(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Grid cell of each document, from its hashed and projected token counts."""
    mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    slot = (mixed >> np.uint64(40)).astype(np.int64) % HASHED
    sign = 1.0 - 2.0 * ((mixed >> np.uint64(39)) & np.uint64(1)).astype(float)
    n = np.diff(bounds)
    doc = np.repeat(np.arange(len(n)), n)
    vectors = np.bincount(doc * HASHED + slot, weights=sign, minlength=len(n) * HASHED).reshape(-1, HASHED)
    norms = np.sqrt((vectors ** 2).sum(axis=1, keepdims=True))
    flat = (vectors / np.where(norms > 0, norms, 1)) @ directions()
    return np.minimum((0.5 + 0.5 * np.tanh(flat)) * (1 << GRID_BITS), (1 << GRID_BITS) - 1).astype(np.int64)


def _tokenise(vocabulary: str, end_id: int, special: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, spaced=False, special=special)
        for batch in slices(batches):
            ids, bounds = encode.encode(batch.column(2))
            keys = hilbert_keys(cells_of(ids, bounds))
            n = np.diff(bounds)
            whole = np.full(len(ids) + len(n), end_id, "<u2" if max(int(ids.max(initial=0)), end_id) < 1 << 16 else "<u4")
            whole[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)] = ids
            cuts = (np.concatenate([[0], np.cumsum(n + 1)]) * whole.itemsize).tolist()
            data = whole.tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(keys), pa.array(n + 1), pa.array(np.full(len(n), whole.itemsize), pa.int32()),
                 pa.array([data[a:b] for a, b in zip(cuts, cuts[1:])], pa.binary())],
                names=["_id", "_row", "_key", "_n", "_width", "_ids"])
    return run


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for row in batch.to_pylist():
                ids = np.frombuffer(row["_ids"], f"<u{row['_width']}").astype("<u4")
                at, done = row["_start"], 0
                while done < len(ids):
                    take = min(length - at % length, len(ids) - done)
                    out.append((row["_id"], done, take, zlib.crc32(ids[done:done + take].tobytes()), len(ids), at // length, at % length))
                    at, done = at + take, done + take
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else ((),) * 7)],
                                             names=["_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
    return run


def tokenised(docs: DataFrame, vocabulary: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text",
              special: bool = False) -> DataFrame:
    """Stored ids of every document with its Hilbert key."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.monotonically_increasing_id().alias("_row"), F.col(text_col).alias("_text"))
    return stored(rows.mapInArrow(_tokenise(vocabulary, end_id, special), "_id bigint, _row bigint, _key bigint, _n bigint, _width int, _ids binary"),
                  "packing-ids")


def positions(tokens: DataFrame) -> DataFrame:
    """First token position of every document (by ``_row``) along the curve."""
    order = tokens.select("_row", "_n", F.lit(0).alias("_all"), F.struct("_key", "_id", "_row").alias("_order"))
    summed, _ = prefix_sums(order, "_all", "_order", "_n")
    return summed.select("_row", (F.col("_cum") - F.col("_n")).alias("_start"))


def pack(docs: DataFrame, vocabulary: str, length: int = LENGTH, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text",
         special: bool = False) -> DataFrame:
    """One row a piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``special``: strings of special tokens in a text get those tokens' ids, as in a plain call of the library.
    """
    tokens = tokenised(docs, vocabulary, end_id, id_col, text_col, special)
    placed = tokens.join(positions(tokens), "_row").select("_id", "_start", "_width", "_ids")
    return placed.mapInArrow(_cut(length), PIECES).withColumnRenamed("_id", id_col)
