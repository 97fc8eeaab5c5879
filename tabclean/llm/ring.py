"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every id is hashed to a point of the ring and belongs to the next virtual
node clockwise. A shard takes the keys of its own virtual nodes until it is
full; keys that overflow continue clockwise to the next virtual node whose
shard has room. The capacities add up to the number of rows and differ by
one at most (law ``rows``), so balance is guaranteed.

The ring is cut into 2^16 cells. Only the counts of the cells (at most
65,536 numbers) reach the driver, which walks the ring over them and returns
ranges of ring ranks with their shard. The rows are ranked within their cell
in Spark, and look up their range by cell; that table has at most one row a
cell, plus one a cut, so its broadcast is bounded.

Edge cases: a null text has size 1 and checksum 0, like an empty one. Rows
repeated with one id stand side by side on the ring and get slots of their
own. Null ids share one point. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabclean.llm.common import stored, text_of

CELL_BITS = 16
VIRTUAL_NODES = 128


def ring_nodes(shards: int, virtual_nodes: int = VIRTUAL_NODES) -> list[tuple[int, int]]:
    """(cell, shard) of every virtual node in ring order; one node a cell (the smallest shard wins it)."""
    taken: dict[int, int] = {}
    for shard in range(shards):
        for k in range(virtual_nodes):
            point = int.from_bytes(hashlib.sha256(f"shard-{shard}-node-{k}".encode()).digest()[:8], "big")
            taken.setdefault(point >> (64 - CELL_BITS), shard)
    return sorted(taken.items())


def capacities(rows: int, shards: int) -> list[int]:
    """Whole capacities that add up to ``rows`` and differ by one at most."""
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def walk(counts: np.ndarray, shards: int, virtual_nodes: int = VIRTUAL_NODES) -> list[tuple[int, int, int]]:
    """Ranges of ring ranks with their shard: (first rank, one past the last, shard).

    ``counts`` has the rows of each cell. First every shard takes its own
    arcs in ring order; then overflowing ranges walk on, nearest first.
    """
    nodes = ring_nodes(shards, virtual_nodes)
    ranks = np.concatenate([[0], np.cumsum(counts)]).tolist()
    total, room = ranks[-1], capacities(ranks[-1], shards)
    arcs, first = [], 0
    for cell, shard in nodes:  # a node owns the cells after the node before it, up to its own
        arcs.append((first, ranks[cell + 1], shard))
        first = ranks[cell + 1]
    if first < total:  # past the last node: on to the first one
        arcs.append((first, total, nodes[0][1]))
    out, over = [], []
    for at, (a, b, shard) in enumerate(arcs):
        take = min(b - a, room[shard])
        if take:
            out.append((a, a + take, shard))
            room[shard] -= take
        if a + take < b:
            over.append((at, a + take, b))
    for at, a, b in over:
        step = at
        while a < b:
            step += 1
            shard = arcs[step % len(arcs)][2]
            take = min(b - a, room[shard])
            if take:
                out.append((a, a + take, shard))
                room[shard] -= take
                a += take
    return sorted(out)


def assign(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text",
           virtual_nodes: int = VIRTUAL_NODES) -> DataFrame:
    """One row a document: id, size, text_crc32, law, shard, slot, grown_shard."""
    spark = docs.sparkSession
    raw = text_of(text_col).cast("binary")
    point = F.xxhash64(F.col(id_col))
    keys = stored(docs.select(
        F.col(id_col).alias("_id"), (F.octet_length(raw).cast("bigint") + 1).alias("size"),
        F.crc32(raw).alias("text_crc32"), point.alias("_point"),
        F.shiftrightunsigned(point, 64 - CELL_BITS).cast("int").alias("_cell")), "ring-keys")
    counts = np.zeros(1 << CELL_BITS, np.int64)
    for row in keys.groupBy("_cell").count().collect():
        counts[row["_cell"]] = row["count"]
    starts = np.concatenate([[0], np.cumsum(counts)])
    cells, filled = [], [0] * shards
    for a, b, shard in walk(counts, shards, virtual_nodes):
        cell = int(np.searchsorted(starts, a, "right")) - 1
        while cell < len(counts) and starts[cell] < b:
            lo, hi = max(a, int(starts[cell])), min(b, int(starts[cell + 1]))
            if lo < hi:  # ranks within the cell, the shard, and what to add for the slot
                base = int(starts[cell])
                cells.append((cell, lo - base, hi - base, shard, filled[shard] + lo - a - (lo - base)))
            cell += 1
        filled[shard] += b - a
    names = ["_cell", "_lo", "_hi", "shard", "_add"]
    table = spark.createDataFrame(pd.DataFrame(cells, columns=names, dtype="int64"),
                                  "_cell bigint, _lo bigint, _hi bigint, shard bigint, _add bigint")
    table = table.withColumns({"_cell": F.col("_cell").cast("int"), "shard": F.col("shard").cast("int")})
    order = Window.partitionBy("_cell").orderBy("_point", "_id", "size", "text_crc32")
    ranked = keys.withColumn("_rank", (F.row_number().over(order) - 1).cast("bigint"))
    placed = ranked.join(F.broadcast(table), "_cell").filter("_rank >= _lo and _rank < _hi")
    return placed.select(
        F.col("_id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        (F.col("_rank") + F.col("_add")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, placed: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Write the documents under ``path``, one folder a shard, in slot order within each file.

    Ids must be unique. Each shard is written by as many tasks as the join has.
    """
    (docs.join(placed.select(id_col, "shard", "slot"), id_col)
     .sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path))
