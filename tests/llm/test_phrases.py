import re
from collections import Counter

import pytest

from tabclean.llm import phrases


def brute(rows, least, top=2000, share=80):
    total, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i:i + k])] += 1
    out = []
    for lang in total:
        own = {p: a for (g, p), a in f.items() if g == lang and len(p) > 1 and a >= least}
        held = set()
        for p, a in own.items():
            for n in range(2, len(p)):
                for i in range(len(p) - n + 1):
                    if 100 * a >= share * own[p[i:i + n]]:
                        held.add(p[i:i + n])
        rows_of = []
        for p, a in own.items():
            if p in held:
                continue
            score, k = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
            rows_of.append((score, a, " ".join(p), f[lang, p[:k]], f[lang, p[k:]]))
        rows_of.sort(key=lambda r: (-r[0], -r[1], r[2].encode()))
        out += [(lang, i + 1, p, a, left, right, total[lang], s) for i, (s, a, p, left, right) in enumerate(rows_of[:top])]
    return sorted(out)


def ours(docs, **options):
    return sorted(map(tuple, phrases.collocations(docs, **options).collect()))


@pytest.mark.parametrize("period", [1, 3, 32])
def test_brute_force(spark, odd_docs, odd_texts, period):
    rows = [(r["lang"], r["text"]) for r in odd_docs.select("lang", "text").collect()]
    assert ours(odd_docs, least=2, period=period) == brute(rows, 2)


def test_documents_sample(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["lang"], r["text"]) for r in docs.select("lang", "text").collect()]
    assert ours(docs, least=5, top=50) == brute(rows, 5, top=50)


def test_pieces_ties_und_and_parts(spark):
    rows = [(None, "a b. c d"), ("und", "A B c\nd a b"), ("en", "x y z w v"), ("en", "x y z w v"), ("en", ",.;"), ("en", None), ("en", "")]
    docs = spark.createDataFrame(rows, "lang string, text string")
    got = ours(docs, least=2)
    assert got == brute(rows, 2)
    assert {r[2] for r in got if r[0] == "en"} == {"x y z w", "y z w v"}
    assert [r[2] for r in got if r[0] == "und"] == ["a b"]


def test_small_filter_lets_all_through(spark, odd_docs, monkeypatch):
    whole = ours(odd_docs, least=2)
    monkeypatch.setattr(phrases, "MOST_FILTER_WORDS", 1)
    monkeypatch.setattr(phrases.pair_filter, "__defaults__", (1,))
    assert ours(odd_docs, least=2) == whole


def test_hot_part(spark, monkeypatch):
    monkeypatch.setattr(phrases, "hot_limit", lambda n: 1)
    rows = [("en", f"the w{i % 9} z{i % 4}") for i in range(90)]
    assert ours(spark.createDataFrame(rows, "lang string, text string"), least=3) == brute(rows, 3)


def test_copies_share_their_chunks(spark):
    text = " ".join(f"w{(i * i) % 501}" for i in range(3000))
    docs = spark.createDataFrame([("en", f"head {i} " + text) for i in range(20)], "lang string, text string")
    chunks = phrases.dictionary(docs)
    one = phrases.dictionary(docs.limit(1)).count()
    assert chunks.count() < one + 60
    assert chunks.selectExpr("sum(_n * _words)").first()[0] == 20 * 3002


def test_empty_table(spark, no_docs):
    assert ours(no_docs) == []
