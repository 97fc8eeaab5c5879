"""SimHash links and components against comparing all pairs."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tabclean.llm import simhash


def brute_print(text, size=4):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if hashes and sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(prints, distance):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_documents(odd_docs, odd_texts, no_docs):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(odd_docs).collect()}
    prints = [brute_print(t) for t in odd_texts]
    assert {i: v[0] for i, v in got.items()} == {i: f"{p:016x}" for i, p in enumerate(prints)}
    assert [got[i][1] for i in range(len(prints))] == brute_components(prints, 4)
    assert simhash.near_duplicates(no_docs).count() == 0
    kept = simhash.drop_near_copies(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted({r["doc_id"] for r in kept.collect()}) == sorted(set(brute_components(prints, 4)))


def test_one_id_with_two_texts(spark):
    """An id that is dropped in one group stays in another of which it is the smallest."""
    one, two = "alpha beta gamma delta epsilon", "one two three four five six seven"
    rows = [(1, one, "a"), (5, one, "b"), (5, two, "c"), (9, two, "d"), (None, two, "e")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _fp string")
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r["_fp"] for r in kept.collect()) == ["a", "c", "e"]


def test_xxhash_is_sparks(spark):
    text = "the quick brown fox"
    got = spark.range(1).select(F.xxhash64(F.lit(text)).alias("h")).first()["h"]
    assert got & (2**64 - 1) == simhash.shingle_hashes(text)[0]


@pytest.mark.parametrize("segments", [5, 9, 13, 16])
def test_every_close_pair_shares_a_key_and_keeps_the_chain(segments):
    rnd = random.Random(segments)
    bounds, keys = simhash.segment_bounds(segments), simhash.chain_keys(segments, 4)
    masks = [sum(((1 << bounds[s][1]) - 1) << bounds[s][0] for s in equal) for _, equal in keys]
    for _ in range(3000):
        a = rnd.getrandbits(64)
        b = a
        for bit in rnd.sample(range(64), rnd.randint(0, 4)):
            b ^= 1 << bit
        met = [start for (start, _), mask in zip(keys, masks) if a & mask == b & mask]
        n = len(met)
        assert n and simhash.linked(np.full(n, a, np.uint64), np.full(n, b, np.uint64), np.array(met), segments, 4).any()


@pytest.mark.parametrize("block", [simhash.BLOCK, 8])
def test_links_of_dense_groups(spark, block):
    """Clusters of near fingerprints, also where keys are split into blocks."""
    rnd = random.Random(5)
    prints = {0, 2**64 - 1}
    for _ in range(12):
        centre = rnd.getrandbits(64)
        prints |= {centre}
        for _ in range(40):
            near = centre
            for bit in rnd.sample(range(64), rnd.randint(1, 6)):
                near ^= 1 << bit
            prints.add(near)
    prints = sorted(prints)
    signed = [p - 2**64 if p >> 63 else p for p in prints]
    table = spark.createDataFrame([(p,) for p in signed], "_fp bigint")
    found = simhash.links(table, 4, block=block)
    roots = {r["node"]: r["root"] for r in simhash.components(found).collect()}
    want = brute_components(prints, 4)
    got = [roots.get(p, p) for p in signed]
    groups = lambda labels: sorted(sorted(i for i, x in enumerate(labels) if x == v) for v in set(labels))
    assert groups(got) == groups(want)


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1300)]
    roots = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert len({roots[i] for i in range(301)}) == 1 and len({roots[i] for i in range(1000, 1300)}) == 1
    assert roots[0] != roots[1000]
