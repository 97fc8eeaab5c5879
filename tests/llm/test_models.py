"""Language model, language identification and toxicity against plain Python or held-out rows."""

import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import pyarrow as pa
from pyspark.sql import functions as F

from tabclean.llm import common, langid, ngram_lm, queries, toxicity

from conftest import SF_ORACLE


def brute_lm(texts, held, order=ngram_lm.ORDER):
    tokens = [[None, *(t or "").encode().lower().split(), b"\n"] for t in texts]  # None: the start of a text
    count = Counter()
    for words, out in zip(tokens, held):
        for k in range(1, order + 1):
            count.update(tuple(words[i:i + k]) for i in range(len(words) - k + 1) if not out)
    n = sum(c for g, c in count.items() if len(g) == 1 and g != (None,))
    v = sum(len(g) == 1 and g != (None,) for g in count)

    def p(context, w):
        if not context:
            return (count[w,] + 1) / (n + v + 1)
        visits = count[context]
        share = ngram_lm.TOP * visits / (visits + ngram_lm.HALF)
        return (1 - share) * p(context[1:], w) + (share * count[*context, w] / visits if visits else 0)

    rows = []
    for words, out in zip(tokens, held):
        base = [math.log10(p((), w)) for w in words[1:]]
        score = [math.log10(p(tuple(words[max(0, i - order + 1):i]), words[i])) for i in range(1, len(words))]
        rows.append((out, len(words) - 1, sum(count[w,] > 0 for w in words[1:]), n, sum(base), sum(score)))
    return rows


def check_lm(got, want):
    for g, w in zip(got, want):
        assert tuple(g)[1:5] == w[:4]
        assert np.allclose(tuple(g)[5:], w[4:], rtol=1e-9)


def test_lm_scores(odd_docs, odd_texts, no_docs):
    rule = common.remainder_of_id("doc_id", 7) == 2
    ids = sorted([*range(len(odd_texts)), 7])
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in ids]
    for sizes in ({}, {"block_chars": 300, "bucket_words": 50}, {"order": 2}, {"order": 5}, {"order": 1}):  # many blocks and buckets must not matter
        got = sorted(ngram_lm.score(odd_docs, rule, **sizes).collect(), key=lambda r: r["doc_id"])
        assert [r["doc_id"] for r in got] == ids
        check_lm(got, brute_lm([odd_texts[i] for i in ids], held, sizes.get("order", ngram_lm.ORDER)))
    assert ngram_lm.score(no_docs, rule).count() == 0


def test_lm_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{SF_ORACLE}/documents.parquet')")
    found = con.execute(queries.NEAR_SQL["op2_lm_scoring"])
    names = [c[0] for c in found.description]
    want = sorted((dict(zip(names, r)) for r in found.fetchall()), key=lambda r: r["doc_id"])
    got = sorted((r.asDict() for r in queries.op2_lm_scoring(spark, SF_ORACLE).collect()), key=lambda r: r["doc_id"])
    for g, w in zip(got, want, strict=True):
        assert g == pytest.approx(w, rel=1e-9)


def test_lm_sends_a_row_to_buckets_that_hold_something():
    hashes = np.random.default_rng(0).integers(0, 1 << 63, 50, dtype=np.uint64) * np.uint64(2)
    for buckets in (1, 7, 1 << 20):
        order, parts = ngram_lm._bucket_order(hashes, buckets)
        assert len(parts) <= min(buckets, 50) and [a for _, a, _ in parts] + [50] == [0] + [z for _, _, z in parts]
        assert all((int(h) >> 32) * buckets >> 32 == b for b, a, z in parts for h in hashes[order[a:z]])


def test_lm_without_training_rows(odd_docs):
    got = ngram_lm.score(odd_docs, F.lit(True)).collect()
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 and r["score"] == r["base_score"] == 0 for r in got)


def test_lm_weights_add_up():
    """The words after any state, with one share for all unseen words, have probability one."""
    texts = ["a b a c", "a a b", "c", "a b a b a c"]
    tokens = [t.split() + ["\n"] for t in texts]
    words = sorted({w for t in tokens for w in t} - {"\n"})
    code = {"\n": ngram_lm.END, **{w: i + 2 for i, w in enumerate(words)}, "unseen": len(words) + 2}
    runs = Counter(tuple(["<s>", *t][i:i + k]) for t in tokens for k in (1, 2, 3, 4) for i in range(len(t) + 2 - k))
    count = np.zeros(len(code) + 1, np.int64)
    for w in code:
        count[code[w]] = runs[w,]
    contexts = [(a, b, c) for a in ("a", "b", "c", "unseen") for b in ("a", "b", "unseen") for c in ("a", "b", "c")]
    for context in [(), ("a",), ("b", "a"), *contexts]:
        read = [[*context, w] for w in code]  # a text for each word that may follow
        whole = [["<s>", *t] for t in read]
        bounds = np.arange(len(read) + 1) * (len(context) + 1)
        grams = [np.array([runs[tuple(t[i + 1 - k + 1:i + 2])] if i + 2 >= k else 0 for t in whole for i in range(len(t) - 1)]) for k in (2, 3, 4)]
        machine = ngram_lm.BackoffAutomaton(count, grams, np.array([code[w] for t in read for w in t]), bounds, sum(map(len, tokens)), len(words) + 1, len(texts))
        assert np.isclose((10 ** machine.read[3][bounds[1:] - 1]).sum(), 1)
        for few in (0, 100):  # together and alone
            ngram_lm.FEW_LIVE, kept = max(1, few), ngram_lm.FEW_LIVE
            score = machine.traverse()
            ngram_lm.FEW_LIVE = kept
            assert np.allclose(score, np.add.reduceat(machine.read[3], bounds[:-1]))


def test_lm_beats_base_on_held_out(spark):
    got = queries.op2_lm_scoring(spark, SF_ORACLE).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    docs = spark.read.parquet(f"{SF_ORACLE}/documents.parquet")
    pairs = ngram_lm.score(docs, common.remainder_of_id("doc_id", 7) == 2, order=2).filter("held_out").agg(F.sum("score")).first()
    assert got[0] > pairs[0] > got[1]


def test_pack_round_trip():
    arrays = [np.arange(1000, dtype=np.uint64) ** 5, np.empty(0, np.int64), np.array([7], np.uint8)]
    assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(arrays, ngram_lm.unpack(ngram_lm.pack(*arrays))))


def test_language_held_out(spark):
    got = queries.op4_language(spark, SF_ORACLE).join(spark.read.parquet(f"{SF_ORACLE}/documents.parquet").select("doc_id", "lang"), "doc_id")
    right = got.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.99
    assert got.filter("score < 0 or score > 1").count() == 0


def test_language_backoff():
    model = langid.Model([("haus", "de", 5), ("house", "en", 5), ("schule", "de", 3), ("school", "en", 3)])
    assert langid.predict(model, ["haus", "Schulung", "12 ...", "", "schooling"], {}) [0] == ["de", "de", "und", "und", "en"]
    assert langid.predict(langid.Model([]), ["haus"], {}) == (["und"], [0.0])


def test_language_learns_every_word_of_the_sample(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    words = langid.word_counts(langid.sample_by_language(docs.filter("lang is not null and text is not null"), "doc_id", "lang", langid.MAX_ROWS), "text", "lang")
    assert len(langid.fit(docs, F.lit(True)).words[0]) == words.select("word").distinct().count()


def test_language_ngrams_of_every_word(spark):
    docs = spark.createDataFrame([(0, "the the the house", "en"), (1, "the school", "en"), (2, "schule", "de")], "doc_id bigint, text string, lang string")
    model = langid.fit(docs, F.lit(True), max_words=1)
    assert list(model.words[0]) == ["the"] and model.langs == ["de", "en"]
    assert langid.predict(model, ["schulung", "housing"], {})[0] == ["de", "en"]
    whole = langid.fit(docs, F.lit(True))
    plain = langid.Model([("the", "en", 4), ("house", "en", 1), ("school", "en", 1), ("schule", "de", 1)])
    for (index, logs), (own, own_logs), (cut, cut_logs) in zip(plain.grams, whole.grams, model.grams):
        assert index.keys() == own.keys() == cut.keys()
        assert all(np.allclose(logs[i], own_logs[own[g]]) and np.allclose(logs[i], cut_logs[cut[g]]) for g, i in index.items())


def test_language_edges(odd_docs, odd_texts, no_docs):
    model = langid.fit(odd_docs, F.lit(True))
    got = {r["doc_id"]: r for r in langid.identify(odd_docs, model).collect()}
    assert got[0]["lang_pred"] == got[1]["lang_pred"] == "und" and got[4]["lang_pred"] == "en"
    kept = langid.keep_identified(odd_docs, model)
    assert kept.columns == odd_docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["lang_pred"] != "und"}
    assert langid.identify(no_docs, langid.fit(no_docs, F.lit(True))).count() == 0


def test_sample_is_bounded(spark):
    rows = spark.range(10_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 50, "fi").otherwise("en").alias("lang"))
    got = {r["lang"]: r["count"] for r in langid.sample_by_language(rows, "doc_id", "lang", 1000).groupBy("lang").count().collect()}
    assert got["fi"] == 50 and 900 < got["en"] < 1100
    assert langid.sample_by_language(rows, "doc_id", "lang", 20_000).count() == 10_000


def brute_marginals(emission, moves, begin):
    """Sum over all labellings."""
    n = len(emission)
    weight = np.zeros(2 ** n)
    for k in range(2 ** n):
        y = [k >> i & 1 for i in range(n)]
        weight[k] = begin * y[0] + sum(e * v for e, v in zip(emission, y)) + sum(moves[a, b] for a, b in zip(y, y[1:]))
    p = np.exp(weight - weight.max())
    p /= p.sum()
    return [sum(p[k] for k in range(2 ** n) if k >> i & 1) for i in range(n)]


def test_forward_backward():
    rnd = np.random.default_rng(3)
    moves = rnd.standard_normal((2, 2))
    sizes = [1, 5, 3, 8, 1, 2]
    emission = rnd.standard_normal(sum(sizes)) * 2
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    forward, backward = toxicity._messages(emission, bounds, moves, 0.3)
    got = 1 / (1 + np.exp(-(forward + backward)))
    want = [p for a, b in zip(bounds, bounds[1:]) for p in brute_marginals(emission[a:b], moves, 0.3)]
    assert np.allclose(got, want)


def test_toxicity_learns_words_and_stems(spark):
    rnd = np.random.default_rng(0)
    plain = ["".join(rnd.choice(list("abcdefgh"), 5)) for _ in range(60)]
    rows, labels = [], []
    for i in range(400):
        words = list(rnd.choice(plain, 30))
        toxic = i % 4 == 0
        for _ in range(3 * toxic):
            words[rnd.integers(30)] = rnd.choice(["vilest", *["zork" + end for end in ("an", "el", "ing", "or", "um", "ast", "if", "ly", "ed", "oo")]])
        rows.append((i, " ".join(words).replace(" a", ". A", 2)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    held = common.remainder_of_id("doc_id", 5) == 0
    scorer = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"), ~held)
    got = {r["doc_id"]: r for r in toxicity.score(docs, scorer).collect()}
    assert all(got[i]["predicted"] == y for i, y in labels)
    odd = pa.array(["One zorkish abcde", "", "Abcde zorkan,\n vilest! Zorkel."], pa.string())
    scores = scorer.score(odd)
    assert scores[0] > 0.5 and scores[1] < 0.5 and scores[2] > 0.5
    text = odd[2].as_py()
    found = "".join(text[a:b] for a, b, _ in scorer.spans(odd)[2])
    assert "".join(found.split()) == "zorkan,vilest!Zorkel." and scorer.spans(odd)[1] == []


def test_toxicity_edges(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(1, None), (None, 1), (3, 1)], "doc_id bigint, toxic int")
    scorer = toxicity.fit(odd_docs, labels, F.lit(True))
    got = toxicity.score(odd_docs, scorer).collect()
    assert len(got) == odd_docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert toxicity.drop_toxic(odd_docs, scorer).columns == odd_docs.columns
    assert toxicity.tag(odd_docs, scorer).count() == odd_docs.count()
    for one_class in (labels.limit(0), labels.filter("toxic = 0")):
        flat = toxicity.fit(odd_docs, one_class, F.lit(True))
        assert {r["score"] for r in toxicity.score(odd_docs, flat).collect()} == {0.0}
    assert toxicity.score(no_docs, toxicity.fit(no_docs, labels, F.lit(True))).count() == 0


def test_toxicity_held_out(spark):
    labels = spark.read.parquet(f"{SF_ORACLE}/labels.parquet")
    got = queries.op8_toxicity(spark, SF_ORACLE).join(labels, "doc_id")
    assert got.filter("toxic = 0 and predicted = 1").count() == 0


def test_toxicity_recall_of_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"  # at sf0.01 the rarer languages have too few labelled sentences
    counts = {(r["toxic"], r["predicted"]): r["count"] for r in
              queries.op8_toxicity(spark, sf).filter("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").groupBy("toxic", "predicted").count().collect()}
    assert counts[1, 1] >= 0.9 * (counts[1, 1] + counts.get((1, 0), 0)) and counts.get((0, 1), 0) <= 0.005 * counts[0, 0]


@pytest.mark.parametrize("bad", ["bad ass", "vile scum", "xq"])
def test_toxicity_words_of_any_length(spark, bad):
    rnd = np.random.default_rng(5)
    plain = ["".join(rnd.choice(list("abcdefgh"), 5)) for _ in range(80)]
    # One of the words in a few clean documents as well, and long sentences without an end.
    rows = [(i, " ".join([*rnd.choice(plain, 15), *([bad] if i % 4 == 0 else []), *([bad.split()[-1]] if i == 1 else []),
                          *rnd.choice(plain, 400 if i % 8 == 0 else 15)])) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id bigint, toxic int")
    held = common.remainder_of_id("doc_id", 5) == 0
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, toxicity.fit(docs, labels, ~held)).collect()}
    assert sum(got[i] for i in range(0, 400, 4)) >= 95 and sum(got[i] for i in range(400) if i % 4) <= 2


def test_rare_languages_are_learned_and_strange_texts_rejected(spark):
    rnd = np.random.default_rng(7)
    words = {"en": ["the", "house", "and", "school", "water", "with", "people", "never"], "fi": ["talo", "koulu", "vesi", "ja", "kanssa", "ihmiset"]}
    rows = [(i, " ".join(rnd.choice(words["fi" if i < 4 else "en"], 30)), "fi" if i < 4 else "en") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.fit(docs, F.lit(True), max_rows=100)
    assert model.langs == ["en", "fi"]
    assert langid.predict(model, ["talo ja vesi", "the school"], {})[0] == ["fi", "en"]
    letters = list("abcdefghijklmnopqrstuvwxyz")
    strange = [" ".join("".join(rnd.choice(letters, 7)) for _ in range(n)) for n in (10, 50, 500)] + ["kahdeksan omenaa oli pudonnut puusta kun poika tuli kotiin illalla myöhään"]
    odd = spark.createDataFrame([(i, t, None) for i, t in enumerate(strange)] + [(9, rows[0][1], "x"), (10, rows[9][1], "x")], docs.schema)
    assert {r["doc_id"] for r in langid.keep_identified(odd, model).collect()} == {9, 10}
