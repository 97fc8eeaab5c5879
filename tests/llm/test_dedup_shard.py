"""Exact dedup and the shard ring against plain Python."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabclean.llm import common, exact_dedup, ring


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


@pytest.mark.parametrize("max_words", [exact_dedup.MAX_WORDS, 1])
def test_decisions(odd_docs, odd_texts, max_words):
    """A filter of one word lets everything through to the shuffle; the rows must not change."""
    got = exact_dedup.decisions(odd_docs, max_words=max_words).collect()
    ids = [*range(len(odd_texts)), 7]
    groups = {}
    for i in ids:
        groups.setdefault(normal(odd_texts[i]), []).append(i)
    want = sorted((i, min(groups[normal(odd_texts[i])]), len(groups[normal(odd_texts[i])]),
                   hashlib.sha256(normal(odd_texts[i]).encode()).hexdigest()) for i in ids)
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    kept = [r["doc_id"] for r in got if r["kept"]]
    assert sorted(kept) == sorted(min(g) for g in groups.values())


def test_drop_copies(odd_docs, odd_texts, no_docs):
    got = exact_dedup.drop_copies(odd_docs)
    assert got.columns == odd_docs.columns
    first = {}
    for i, t in enumerate(odd_texts):
        first.setdefault(normal(t), i)
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(first.values())
    assert exact_dedup.drop_copies(no_docs).count() == 0 and exact_dedup.decisions(no_docs).count() == 0


def test_no_python_in_plan(odd_docs):
    plan = exact_dedup.decisions(odd_docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_unique_rows_do_not_move(spark):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    keys = exact_dedup.text_keys(docs)
    words = exact_dedup.filter_words(500)
    maybe = exact_dedup.flag_repeats(keys, exact_dedup.repeated_bits(keys, words), words).filter("_maybe").count()
    assert maybe < 50


def test_look_up_hot_and_cold(spark):
    rows = spark.range(100).select((F.col("id") % 7 % 3).alias("k"), "id")
    table = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    for most in (0, 30, 1000):
        got = {r["id"]: (r["n"], r["first"]) for r in common.look_up(rows, table, "k", "n", most).collect()}
        assert got == {i: (sum(j % 7 % 3 == i % 7 % 3 for j in range(100)), min(j for j in range(100) if j % 7 % 3 == i % 7 % 3)) for i in range(100)}


def test_running_totals(spark):
    rows = spark.range(5000).select(F.col("id").alias("part"), (F.col("id") % 5 + 1).alias("w"))
    got = [r["before"] for r in common.running_totals(rows, "part", "w", fan=64).orderBy("part").collect()]
    assert got == list(np.cumsum([0, *[i % 5 + 1 for i in range(4999)]]))


def brute_walk(points, shards):
    """Every key by itself: home shards first in ring order, then the overflow goes on clockwise."""
    nodes, room = ring.ring_nodes(shards), ring.capacities(len(points), shards)
    cell = lambda p: (p & (2**64 - 1)) >> (64 - ring.CELL_BITS)
    order = sorted(range(len(points)), key=lambda i: (cell(points[i]), points[i], i))
    out, over = {}, []
    for i in order:
        at = next((n for n, (c, _) in enumerate(nodes) if c >= cell(points[i])), 0)
        arc = at if cell(points[i]) <= nodes[-1][0] else len(nodes)
        if room[nodes[at][1]]:
            out[i] = nodes[at][1]
            room[nodes[at][1]] -= 1
        else:
            over.append((i, arc))
    arcs = [s for _, s in nodes] + [nodes[0][1]]
    for i, arc in over:
        while i not in out:
            arc += 1
            if room[arcs[arc % len(arcs)]]:
                out[i] = arcs[arc % len(arcs)]
                room[out[i]] -= 1
    return out


def test_ring_assign(odd_docs, odd_texts, no_docs):
    got = ring.assign(odd_docs, shards=8).collect()
    assert sorted(r["doc_id"] for r in got) == sorted([*range(len(odd_texts)), 7])
    by = {}
    for r in got:
        raw = (odd_texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(slots) == list(range(len(slots))) for slots in by.values())
    assert max(map(len, by.values())) - min(len(by.get(s, [])) for s in range(8)) <= 1
    assert ring.assign(no_docs).count() == 0


def test_ring_is_the_brute_walk(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    got = {r["doc_id"]: r["shard"] for r in ring.assign(docs).collect()}
    points = {r["doc_id"]: r["p"] for r in docs.select("doc_id", F.xxhash64("doc_id").alias("p")).collect()}
    assert got == brute_walk([points[i] for i in range(3000)], 8)


def test_ring_moves_little(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    eight = {r["doc_id"]: r["shard"] for r in ring.assign(docs, 8).collect()}
    nine = {r["doc_id"]: r["shard"] for r in ring.assign(docs, 9).collect()}
    moved = sum(eight[i] != nine[i] for i in eight) / len(eight)
    assert moved < 0.4  # a fresh deal would move 8/9
