"""Distributed ranks and prefix sums over a global order, and exact medians, without one task.

A window with no partition key runs in a single task. Here the rows are range
partitioned on ``(group, value)``, each range partition ranks its own rows,
and the offset of every earlier partition is added. The partition id is
pinned by a reliable checkpoint (range bounds come from sampling, so a
recomputation could otherwise move rows), and the offsets table has at most
``partitions + groups`` rows, so broadcasting it has a proven bound.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabclean.session import ensure_checkpoint_dir


def _partitions(df: DataFrame, partitions: int | None) -> int:
    if partitions:
        return partitions
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def prefix_sums(values: DataFrame, group: str, order: str, weight: str | None = None,
                partitions: int | None = None) -> tuple[DataFrame, dict]:
    """Add ``_cum``: inclusive running sum of ``weight`` (1 if None) within ``group`` by ``order``.

    ``(group, order)`` must be unique in ``values``. Also returns the total
    weight of every group.
    """
    spark = values.sparkSession
    ensure_checkpoint_dir(spark)
    w_col = F.col(weight) if weight else F.lit(1).cast("bigint")
    ranged = (values.repartitionByRange(_partitions(values, partitions), F.col(group), F.col(order))
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_w", w_col))
    ranged = ranged.checkpoint(eager=True)
    w = (Window.partitionBy("_pid", group).orderBy(order)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = ranged.withColumn("_lcum", F.sum("_w").over(w))
    totals = ranged.groupBy("_pid", group).agg(F.sum("_w").alias("_tot")).collect()
    offsets, running = [], {}
    for row in sorted(totals, key=lambda r: (r[group], r["_pid"])):
        g = row[group]
        offsets.append((row["_pid"], g, running.get(g, 0)))
        running[g] = running.get(g, 0) + int(row["_tot"])
    schema = f"_pid int, `{group}` {dict(values.dtypes)[group]}, _off bigint"
    off_df = spark.createDataFrame(offsets, schema)
    joined = local.join(F.broadcast(off_df), ["_pid", group])
    return joined.withColumn("_cum", F.col("_lcum") + F.col("_off")).drop("_pid", "_lcum", "_off", "_w"), running


def dense_ranks(distinct_values: DataFrame, group: str, order: str, partitions: int | None = None) -> DataFrame:
    """0-based dense rank of each distinct value within its group (sorted ascending)."""
    ranked, _ = prefix_sums(distinct_values, group, order, None, partitions)
    return ranked.withColumn("rank", F.col("_cum") - 1).drop("_cum")


# Selection: quantiles kept a pass, values of all groups that are collected at the end, passes before the rank takes over.
_QUANTILES, _ACCURACY, MOST_COLLECTED, MOST_PASSES = 256, 2560, 100_000, 12


@dataclass
class _Bracket:
    """Where a group's two middle values lie: ``below`` values come before ``low``, ``inside`` lie in [low, high]."""
    n: int
    low: float
    high: float
    below: int
    inside: int
    quantiles: list

    def narrowed(self) -> tuple[float, float]:
        """Two quantiles around the middle ranks, a place further out on each side than their error."""
        first, last = ((k - self.below) / self.inside for k in ((self.n - 1) // 2, self.n // 2))
        a, b = int(first * _QUANTILES) - 2, int(last * _QUANTILES) + 3
        return (self.low if a < 0 else max(self.low, float(self.quantiles[a])),
                self.high if b >= len(self.quantiles) else min(self.high, float(self.quantiles[b])))

    def holds(self, below: int, inside: int) -> bool:
        return below <= (self.n - 1) // 2 and self.n // 2 < below + inside


def exact_medians(values: DataFrame, group: str, value: str, partitions: int | None = None,
                  most: int = MOST_COLLECTED) -> dict:
    """Exact median per group: the midpoint of the two middle values (pandas/NumPy rule).

    ``values`` holds one row per observation ``(group, value)``; NULL values are
    ignored. The middle ranks ``(n - 1) // 2`` and ``n // 2`` are found by selection:
    each pass takes approximate quantiles of what is left and counts exactly how many values
    lie before and between two of them, which leaves about a fiftieth. That
    is an aggregate with one row a group; nothing is sorted and no value
    stored. When few values are left they are counted and collected (at most ``most`` of all groups).
    The quantiles only steer: a bracket that does not hold the ranks by exact count is not taken. Groups
    that no longer shrink (a few values on very many rows) are counted and ranked by range partition.
    """
    values = values.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).filter("v is not null")
    shares = [i / _QUANTILES for i in range(_QUANTILES + 1)]
    stats = values.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"),
                                    F.percentile_approx("v", shares, _ACCURACY).alias("qs")).collect()
    found = {r["g"]: _Bracket(r["n"], r["lo"], r["hi"], 0, r["n"], r["qs"]) for r in stats}
    if not found:
        return {}
    spark = values.sparkSession
    g_type = dict(values.dtypes)["g"]
    share = max(100, most // len(found))
    open_ = {g for g, b in found.items() if b.inside > share and b.low < b.high}
    stuck: set = set()
    for _ in range(MOST_PASSES):
        if not open_ - stuck:
            break
        tried = {g: found[g].narrowed() for g in open_ - stuck}
        table = spark.createDataFrame([(g, float(a), float(b)) for g, (a, b) in tried.items()], f"g {g_type}, a double, b double")  # a row a group
        kept = F.col("v").between(F.col("a"), F.col("b"))
        rows = (values.join(F.broadcast(table), "g").groupBy("g").agg(
            F.count_if(F.col("v") < F.col("a")).alias("below"), F.count_if(kept).alias("inside"), F.min(F.when(kept, F.col("v"))).alias("lo"),
            F.max(F.when(kept, F.col("v"))).alias("hi"), F.percentile_approx(F.when(kept, F.col("v")), shares, _ACCURACY).alias("qs")).collect())
        for r in rows:
            old = found[r["g"]]
            if old.holds(r["below"], r["inside"]) and r["inside"] < old.inside:
                found[r["g"]] = _Bracket(old.n, r["lo"], r["hi"], r["below"], r["inside"], r["qs"])
            if not old.holds(r["below"], r["inside"]) or r["inside"] > old.inside // 2:
                stuck.add(r["g"])
        open_ = {g for g, b in found.items() if b.inside > share and b.low < b.high}
    out = {g: b.low for g, b in found.items() if b.low == b.high}
    left = [g for g in found if g not in out]
    if left:
        table = spark.createDataFrame([(g, found[g].low, found[g].high) for g in left], f"g {g_type}, a double, b double")
        counts = (values.join(F.broadcast(table), "g").filter(F.col("v").between(F.col("a"), F.col("b")))
                  .groupBy("g", "v").agg(F.count(F.lit(1)).alias("_n")))
        ranks = {g: ((b.n - 1) // 2 - b.below, b.n // 2 - b.below) for g, b in found.items()}
        out |= _collected(counts, ranks, [g for g in left if g not in open_])
        out |= _ranked(counts.filter(F.col("g").isin(list(open_))), ranks, partitions) if open_ else {}
    return out


def _collected(counts: DataFrame, ranks: dict, groups: list) -> dict:
    """Middle values of groups with few values left, counted on the executors and walked on the driver."""
    if not groups:
        return {}
    each: dict = {}
    for r in counts.filter(F.col("g").isin(groups)).collect():
        each.setdefault(r["g"], []).append((r["v"], r["_n"]))
    out = {}
    for g, pairs in each.items():
        middle, before = {}, 0
        for v, n in sorted(pairs):
            for k in ranks[g]:
                if before <= k < before + n:
                    middle[k] = v
            before += n
        out[g] = (middle[ranks[g][0]] + middle[ranks[g][1]]) / 2
    return out


def _ranked(counts: DataFrame, ranks: dict, partitions: int | None) -> dict:
    """Middle values of ``(g, v, _n)`` by the distributed rank."""
    cum, sizes = prefix_sums(counts, "g", "v", "_n", partitions)
    wanted = counts.sparkSession.createDataFrame([(g, *ranks[g]) for g in sizes], f"g {dict(counts.dtypes)['g']}, _lo bigint, _hi bigint")
    holds = lambda k: (F.col("_cum") - F.col("_n") <= F.col(k)) & (F.col(k) < F.col("_cum"))
    middle = (cum.join(F.broadcast(wanted), "g").select("g", "v", holds("_lo").alias("_a"), holds("_hi").alias("_b"))
              .filter("_a or _b").collect())
    low = {r["g"]: r["v"] for r in middle if r["_a"]}
    high = {r["g"]: r["v"] for r in middle if r["_b"]}
    return {g: (low[g] + high[g]) / 2 for g in sizes}
