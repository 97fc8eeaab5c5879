import hashlib
import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from tabclean.llm import common, merkle


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r, n_chars):
    return H(*map(enc, (r["doc_id"], r["source"], r["lang"], n_chars, r["text"])))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i:i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def steps(tree, at):
    for level in tree[:-1]:
        other = at ^ 1
        yield (level[other] if other < len(level) else "", at % 2)
        at //= 2


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r["lang"]].append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["n_chars"])))
        trees[g] = levels([leaf(r, r["n_chars"]) for r in groups[g]])
    top = levels([trees[g][-1][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for i, r in enumerate(groups[g]):
            path = [*steps(trees[g], i), *steps(top, k)]
            hit = zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 7 == 0
            node = leaf(r, r["n_chars"] + 1 if hit and r["n_chars"] is not None else r["n_chars"])
            for other, right in path:
                node = H(other, node) if right else H(node, other)
            out.append((r["doc_id"], trees[g][0][i], trees[g][-1][0], top[-1][0], H(*[p[0] for p in path]), node, node == top[-1][0]))
    return sorted(out, key=str)


def ours(spark, rows, parts=3):
    docs = spark.createDataFrame([(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"], "x", 1) for r in rows],
                                 "doc_id bigint, source string, lang string, n_chars bigint, text string, _word string, _rank int").repartition(parts)
    hit = common.remainder_of_id("doc_id", 7) == 0
    return docs, sorted(map(tuple, merkle.digests(docs, {"n_chars": F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}).collect()), key=str)


def made(n, seed=1, langs=("en", "de", None, ""), ids=None):
    rnd = random.Random(seed)
    return [{"doc_id": ids(rnd, i) if ids else i, "source": rnd.choice(["a", None, ""]), "lang": rnd.choice(langs),
             "n_chars": rnd.choice([None, 5, 70]), "text": rnd.choice([None, "", "über", f"t{i}"])} for i in range(n)]


def test_nulls_gaps_and_signs(spark):
    rows = made(300, ids=lambda rnd, i: rnd.choice([i, -i * 1000, (1 << 63) - 1 - i, -(1 << 63) + i]))
    assert ours(spark, rows)[1] == brute(rows)


def test_repeated_ids_and_hot_id(spark):
    rows = made(400, seed=2, ids=lambda rnd, i: rnd.choice([None, 7, 7, 7, 8, i]))
    rows += rows[:40]  # whole rows repeated
    assert ours(spark, rows)[1] == brute(rows)


def test_hot_words_are_looked_up_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(merkle, "hot_limit", lambda n: 20)
    rows = made(300, seed=5, ids=lambda rnd, i: rnd.choice([7, 8, 9, i]))
    assert ours(spark, rows)[1] == brute(rows)


def test_three_passes(spark):
    rows = [{"doc_id": i * 3, "source": None, "lang": "en", "n_chars": i, "text": "t"} for i in range(66_000)]
    assert ours(spark, rows, 8)[1] == brute(rows)


def test_lone_leaf_and_long_text(spark):
    rows = [{"doc_id": 5, "source": "s", "lang": "en", "n_chars": 1, "text": "x" * 1_000_000}]
    got = ours(spark, rows)[1]
    assert got == brute(rows)
    assert got[0][1] == got[0][2] == got[0][3] and got[0][4] == H()


def test_empty_table(spark, no_docs):
    assert merkle.digests(no_docs, {}).collect() == []


def test_any_row_is_proved_by_its_path(spark, odd_docs):
    assert odd_docs.count() == merkle.proofs(odd_docs.withColumn("n_chars", F.lit(1))).filter("verified").count()
