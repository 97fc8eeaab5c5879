"""SimHash near-duplicates by pigeonring filtering.

A fingerprint has 64 bits: a bit is set when over half of the XXH64 values
(seed 42, unsigned) of the document's word shingles have it set. Two
fingerprints link at ``max_distance`` or fewer differing bits.

Candidates come from the pigeonring principle. The 64 bits are cut into m
segments on a ring. If two fingerprints differ in at most t bits, then from
some segment on, going round, the first l segments together differ in at
most l*t/m bits, for every l at once. A chain starts with segments whose
budget l*t/m is below one, so those are equal; while the budget is below two,
at most one later segment of the chain differs at all. Every choice of that
segment gives a key of equal segments, and fingerprints meet on a shared key.
Met pairs must then keep all proportional budgets of the chain from that
start, and only pairs that do get the full Hamming check.

Fingerprints are compared once each, so copies of a text never multiply.
Within a key that many fingerprints share, a breadth-first sweep compares
each reached fingerprint with those not reached yet, and emits a spanning
link instead of all pairs. A key with more than ``block`` fingerprints is
dealt into blocks, and every pair of blocks is swept in a task of its own.
Components are found by contraction over tables; no link, fingerprint or
component reaches the driver.

Edge cases: a null text counts as empty. A text without words has fingerprint
zero, which links like any other. A text with fewer words than a shingle is
one shingle. Rows repeated with one id are members like any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tabclean.llm.common import hot_limit, look_up, no_nulls, slices, stored

BITS = 64
SHINGLE = 4
MAX_DISTANCE = 4
SEGMENTS = 9
BLOCK = 4096
MOST_HOT_KEYS = 1 << 16
SMALL_RUN = 12

# For each byte, its bits as eight counters of one byte each, the highest bit first.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()


def shingle_hashes(text: str, size: int = SHINGLE) -> list[int]:
    """XXH64 (seed 42) of every word shingle, repeats included."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(joined, 42)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (ends[:-size] - 0).tolist()
    hashed = xxhash.xxh64_intdigest
    return [hashed(joined[a:b], 42) for a, b in zip([0, *starts], (ends[size - 1:] - 1).tolist())]


def fingerprints_of(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The fingerprint of each slice of ``hashes``; zero for an empty slice."""
    raw = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    out = np.zeros(len(bounds) - 1, np.uint64)
    for i in range(len(out)):
        a, b = int(bounds[i]), int(bounds[i + 1])
        counts = np.zeros(BITS, np.int64)
        for at in range(a, b, 255):  # a counter of one byte holds 255 rows
            part = _SPREAD[raw[at:min(at + 255, b)]].sum(axis=0, dtype=np.uint64)
            counts += part.view(np.uint8)
        out[i] = np.packbits(counts * 2 > b - a).view(">u8")[0]
    return out


def _fingerprint_batches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, bounds = [], [0]
            for text in no_nulls(batch.column(1)).to_pylist():
                found.append(np.array(shingle_hashes(text, size), np.uint64))
                bounds.append(bounds[-1] + len(found[-1]))
            hashes = np.concatenate(found) if found else np.empty(0, np.uint64)
            prints = fingerprints_of(hashes, np.array(bounds)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], names=["_id", "_fp"])
    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Id and fingerprint (as a signed long) of every row."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(_fingerprint_batches(shingle), "_id bigint, _fp bigint")


def with_fingerprint(docs: DataFrame, text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``docs``, stored, with the fingerprint of each row as a last column of an unused name."""
    name = "_fp"
    while name in docs.columns:
        name += "_"
    at = docs.columns.index(text_col)
    run = _fingerprint_batches(shingle)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            prints = next(run([pa.RecordBatch.from_arrays([batch.column(at)] * 2, names=["_id", "_text"])]))
            yield pa.RecordBatch.from_arrays([*batch.columns, prints.column(1)], names=[*batch.schema.names, name])
    schema = StructType([*docs.schema.fields, StructField(name, LongType())])
    return stored(docs.mapInArrow(add, schema), "simhash-marked")


def segment_bounds(segments: int) -> list[tuple[int, int]]:
    """(first bit, width) of each segment, as even as can be."""
    cuts = [i * BITS // segments for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def chain_keys(segments: int, distance: int) -> list[tuple[int, tuple[int, ...]]]:
    """(start, segments that must be equal) of every key.

    The chain is as long as its budget stays below two. Its first segments,
    of budget below one, are equal; of the others any one may differ.
    """
    equal = max(n for n in range(segments) if n * distance < segments)
    if not equal:
        raise ValueError("more segments than max_distance are needed")
    length = max(n for n in range(segments) if n * distance < 2 * segments)
    later = range(equal, length)
    keys = []
    for start in range(segments):
        for free in later if len(later) > 1 else [None]:
            keys.append((start, tuple((start + i) % segments for i in range(length if len(later) > 1 else equal) if i != free)))
    return keys


def _key(fp: Column, at: int, equal: tuple[int, ...], bounds: list[tuple[int, int]]) -> Column:
    mask = sum(((1 << bounds[s][1]) - 1) << bounds[s][0] for s in equal)
    mask -= (mask >> 63) << 64
    return F.xxhash64(F.lit(at), fp.bitwiseAND(F.lit(mask)))


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def linked(a: np.ndarray, b: np.ndarray, start: np.ndarray, segments: int, distance: int) -> np.ndarray:
    """Whether pairs keep the chain's budgets from ``start`` on, then the distance itself."""
    bounds = segment_bounds(segments)
    low = np.array([x for x, _ in bounds], np.uint64)
    width = np.array([(1 << w) - 1 for _, w in bounds], np.uint64)
    x = a ^ b
    live = np.arange(len(x))
    total = np.zeros(len(x), np.int64)
    for n in range(1, segments):  # prune: cumulative differences within n * distance / segments
        s = (start[live] + n - 1) % segments
        total = total + _popcount((x[live] >> low[s]) & width[s])
        keep = total * segments <= n * distance
        live, total = live[keep], total[keep]
    out = np.zeros(len(x), bool)
    out[live] = _popcount(x[live]) <= distance
    return out


def sweep(prints: np.ndarray, start: int, segments: int, distance: int) -> list[tuple[int, int]]:
    """Spanning links among fingerprints of one key."""
    links, left = [], np.arange(len(prints))
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = linked(prints[left], np.full(len(left), prints[at]), np.full(len(left), start), segments, distance)
            links += [(at, int(i)) for i in left[near]]
            queue += left[near].tolist()
            left = left[~near]
    return links


def _sweep_runs(starts: list[int], segments: int, distance: int):
    """Over rows sorted by group: links within each run of one group."""
    starts_of = np.array(starts)

    def links_of(group: np.ndarray, key: np.ndarray, prints: np.ndarray):
        edge = np.flatnonzero(np.diff(group)) + 1
        first = np.concatenate([[0], edge])
        length = np.diff(np.concatenate([first, [len(group)]]))
        found_a, found_b = [], []
        start = starts_of[key]
        place = np.arange(len(group)) - np.repeat(first, length)
        size = np.repeat(length, length)
        for gap in range(1, SMALL_RUN):  # small runs: all their pairs, as arrays
            i = np.flatnonzero((size <= SMALL_RUN) & (place + gap < size))
            if not len(i):
                break
            ok = linked(prints[i], prints[i + gap], start[i], segments, distance)
            found_a.append(prints[i[ok]])
            found_b.append(prints[i[ok] + gap])
        for at, n in zip(first[length > SMALL_RUN].tolist(), length[length > SMALL_RUN].tolist()):
            run = np.unique(prints[at:at + n])
            pairs = sweep(run, int(start[at]), segments, distance)
            if pairs:
                i, j = np.array(pairs).T
                found_a.append(run[i])
                found_b.append(run[j])
        cat = lambda x: np.concatenate([np.empty(0, np.uint64), *x]).view(np.int64)
        a, b = cat(found_a), cat(found_b)
        return pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            if not len(cols[0]):
                continue
            tail = np.searchsorted(cols[0], cols[0][-1], "left")  # the last run may go on in the next batch
            if tail == 0:
                held.append(cols)
                continue
            done = [np.concatenate([*[h[i] for h in held], cols[i][:tail]]) for i in range(3)]
            yield links_of(done[0], done[1], done[2].view(np.uint64))
            held = [[c[tail:] for c in cols]]
        if held:
            done = [np.concatenate([h[i] for h in held]) for i in range(3)]
            yield links_of(done[0], done[1], done[2].view(np.uint64))
    return run


def links(prints: DataFrame, distance: int = MAX_DISTANCE, segments: int = SEGMENTS, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that span every group of distinct fingerprints ``_fp`` within ``distance``."""
    keys, bounds = chain_keys(segments, distance), segment_bounds(segments)
    fp = F.col("_fp")
    exploded = prints.select("_fp", F.posexplode(F.array(*[_key(fp, i, eq, bounds) for i, (_, eq) in enumerate(keys)])).alias("_at", "_key"))
    most = max(block, -(-prints.count() * len(keys) // MOST_HOT_KEYS))  # so at most 65,536 keys are hot
    hot = stored(exploded.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most), "simhash-hot")
    marked = exploded.join(F.broadcast(hot), "_key", "left")
    cold = marked.filter("_n is null").select(F.col("_key").alias("_group"), "_at", "_fp")
    # A hot key: g blocks by fingerprint; a row goes to the pairs of blocks that hold its own.
    g = F.ceil(F.col("_n") / F.lit(most)).cast("bigint")
    mine = F.pmod(F.xxhash64("_fp", F.lit(11)), F.col("_g"))
    pair = F.xxhash64("_key", F.least(F.col("_mine"), F.col("_other")), F.greatest(F.col("_mine"), F.col("_other")), F.lit(1))
    split = (marked.filter("_n is not null").withColumn("_g", g).withColumn("_mine", mine)
             .withColumn("_other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_g") - 1)))
             .select(pair.alias("_group"), "_at", "_fp"))
    rows = cold.unionByName(split)
    dealt = rows.repartition("_group").sortWithinPartitions("_group")
    found = dealt.mapInArrow(_sweep_runs([s for s, _ in keys], segments, distance), "a bigint, b bigint")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b), by contraction.

    In a round every node joins the neighbour (or itself) of smallest hash;
    edges are then drawn between the joined nodes. Hashes are fixed, so a
    star is done in two rounds and a path loses a share of its nodes in each.
    """
    edges = stored(edges.select("a", "b"), "cc-edges")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    labels = stored(nodes.select("node", F.col("node").alias("root")), "cc-labels")
    n = labels.count()
    for _ in range(rounds):
        if not edges.take(1):
            return labels
        both = edges.union(edges.select("b", "a"))
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(5)).alias("h"), F.col(c).alias("v"))
        joined = both.groupBy("a").agg(F.min(F.least(rank("a"), rank("b"))).alias("best"))
        joined = stored(joined.select(F.col("a").alias("old"), F.col("best.v").alias("new")), "cc-step")
        sizes = labels.groupBy("root").agg(F.count(F.lit(1)).alias("_n"))
        step = joined.join(sizes, joined["old"] == sizes["root"]).select("root", "new", "_n")
        moved = look_up(labels, step, "root", "_n", hot_limit(n))
        labels = stored(moved.select("node", F.coalesce("new", "root").alias("root")), "cc-labels")
        a = joined.withColumnsRenamed({"old": "a", "new": "na"})
        b = joined.withColumnsRenamed({"old": "b", "new": "nb"})
        moved_edges = edges.join(a, "a").join(b, "b").filter("na != nb")
        edges = stored(moved_edges.select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).distinct(), "cc-edges")
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def members(prints_of: DataFrame, distance: int = MAX_DISTANCE, segments: int = SEGMENTS, block: int = BLOCK) -> DataFrame:
    """Add component_id to rows of ``_id`` and ``_fp``."""
    rows = stored(prints_of.select("_id", "_fp"), "simhash-prints")
    prints = stored(rows.groupBy("_fp").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n")), "simhash-distinct")
    roots = components(links(prints.select("_fp"), distance, segments, block))
    rooted = prints.join(roots, prints["_fp"] == roots["node"], "left").select("_fp", "_first", "_n", F.coalesce("root", "_fp").alias("_root"))
    rooted = stored(rooted, "simhash-roots")
    roots_of = rooted.groupBy("_root").agg(F.min("_first").alias("component_id"), F.count(F.lit(1)).alias("_size"))
    placed = look_up(rooted, roots_of, "_root", "_size", hot_limit(rows.count()))
    out = look_up(rows, placed.select("_fp", "component_id", "_n"), "_fp", "_n", hot_limit(rows.count()))
    return out.select("_id", "_fp", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    distance: int = MAX_DISTANCE, segments: int = SEGMENTS, block: int = BLOCK) -> DataFrame:
    """One row a document: id, fingerprint (hex), component_id (smallest id reachable)."""
    out = members(fingerprints(docs, id_col, text_col, shingle), distance, segments, block)
    return out.select(F.col("_id").alias(id_col), F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                     distance: int = MAX_DISTANCE, segments: int = SEGMENTS, block: int = BLOCK) -> DataFrame:
    """The rows that have the smallest id of their component; all columns kept.

    A row is decided by its id and its own fingerprint, as rows of one id may
    have different texts and so lie in different components. Rows with a null
    id are kept: there is no id to tell them by.
    """
    marked = with_fingerprint(docs, text_col, shingle)
    own = marked.columns[-1]
    ids = F.col(f"`{id_col}`").cast("bigint")
    found = members(marked.select(ids.alias("_id"), F.col(own).alias("_fp")), distance, segments, block)
    gone = found.filter("_id != component_id").select(F.col("_id").alias("_gone"), F.col("_fp").alias("_gone_fp")).distinct()
    same = (marked[f"`{id_col}`"].cast("bigint") == gone["_gone"]) & (marked[own] == gone["_gone_fp"])
    return marked.join(gone, same, "left_anti").drop(own)
