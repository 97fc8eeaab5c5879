"""Token records, packing and the agenda codec against the libraries on whole texts."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import corpus_pipeline
from tabclean.llm import chunks, common, packing, queries, records, sp_bpe

from conftest import SF_SMALL

BYTES, WORDS, PIECES = (common.vocabulary(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
TEXTS = st.lists(st.text(alphabet=st.one_of(st.sampled_from(list("ab e1.,'\n\t▁é日🎉́ ​İΣ")), st.characters(exclude_categories=["Cs"])), max_size=40), max_size=8)


def library(path):
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    return tok


def whole(path, texts):
    return [e.ids for e in library(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("path, spaced", [(BYTES, True), (WORDS, False)])
def test_chunk_encoder(odd_texts, path, spaced):
    ids, bounds = chunks.ChunkEncoder(path, spaced).encode(pa.array(odd_texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == whole(path, odd_texts)


@pytest.mark.parametrize("path, spaced", [(BYTES, True), (WORDS, False)])
def test_chunk_encoder_any_text(path, spaced):
    own, lib = chunks.ChunkEncoder(path, spaced), library(path)

    @settings(max_examples=300, deadline=None)
    @given(TEXTS)
    def check(texts):
        ids, bounds = own.encode(pa.array(texts, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    check()


def test_plain_words_need_no_pattern(monkeypatch):
    """Marks, digits, lines and capitals are cut off over a batch; each distinct piece meets the model once, dropped ones too."""
    monkeypatch.setattr(chunks, "MOST_CACHED", 3)
    own, searched, met = chunks.ChunkEncoder(WORDS, spaced=False), [], []
    find, modelled = own.find, own._modelled
    own.find = lambda t: searched.append(t) or find(t)
    own._modelled = lambda p: met.append(p) or modelled(p)
    for texts in (["Über, über; ÜBER.\nNiño 12 1.2...", "", " über\t "], ["niño!"], ["the niño"]):
        ids, bounds = own.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == whole(WORDS, texts)
    assert not searched and sorted(met) == sorted(["über", ",", ";", ".", "niño", "1", "2", "...", "!", "the"])


@pytest.mark.parametrize("odd", ["don't", "a\x85", "\x85", "É\u0323É", "x\x1cY\n1", "'S", "İ", "Ⱥ", "ǅ\u0300", "日A", "\x00", "²½", "n×÷N", "e\n\u0301E"])
def test_odd_chunks_between_plain_words(odd):
    texts = [f"{a}{odd}{b}" for a in ("", "The ", "Été\n", "7", "!") for b in ("", " Ends", "\tE", "2", ".")]
    ids, bounds = chunks.ChunkEncoder(WORDS, spaced=False).encode(pa.array(["cut off", *texts, None, ""]).slice(1))
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == whole(WORDS, [*texts, "", ""])


def plain(path, texts):
    """By the library as it is, with no switch set."""
    return [e.ids for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


SPECIAL = ["<|endoftext|>", "a <|endoftext|> b", "x<|startoftext|>y", "<|ENDOFTEXT|> <|endoftext |>", "a\n<|endoftext|><|endoftext|>é 日", "none"]


@pytest.mark.parametrize("path, spaced", [(BYTES, True), (WORDS, False)])
def test_special_tokens_as_the_plain_library(odd_texts, path, spaced):
    texts = [*SPECIAL, *odd_texts]
    ids, bounds = chunks.ChunkEncoder(path, spaced, special=True).encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == plain(path, texts)


def test_queries_encode_special_tokens_as_the_plain_library(spark, tmp_dir):
    spark.createDataFrame(list(enumerate(SPECIAL)), "doc_id bigint, text string").write.parquet(f"{tmp_dir}/documents.parquet")
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    got = {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in queries.op5_token_records(spark, tmp_dir).collect()}
    assert got == {i: (len(ids) + 1, crc([*ids, 2])) for i, ids in enumerate(plain(BYTES, SPECIAL))}
    want = {i: (len(ids) + 1, crc([*ids, 1])) for i, ids in enumerate(plain(WORDS, SPECIAL))}
    docs = spark.read.parquet(f"{tmp_dir}/documents.parquet")
    for packed in (queries.op10_packing(spark, tmp_dir), corpus_pipeline.pack(spark, docs, tmp_dir)):
        assert {r["doc_id"]: (r["doc_tokens"], r["ids_crc32"]) for r in packed.collect()} == want


def test_agenda_any_text():
    own, lib = sp_bpe.AgendaCodec(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)

    @settings(max_examples=400, deadline=None)
    @given(TEXTS)
    def check(texts):
        for text, (n, ids, decoded) in zip(texts, own.batch(pa.array(texts, pa.string()))):
            want = lib.encode(text)
            assert (n, ids, decoded) == (len(want), ",".join(map(str, want)), lib.decode(want))
    check()


def test_agenda_decodes_any_ids():
    own, rnd = sp_bpe.AgendaCodec(PIECES), random.Random(4)
    for _ in range(500):
        ids = [rnd.choice([rnd.randint(1, 31_999), rnd.randint(3, 258)]) for _ in range(rnd.randint(0, 12))]
        assert own.decode(ids) == own.library.decode(ids)


def test_agenda_check_raises():
    own = sp_bpe.AgendaCodec(PIECES)
    with pytest.raises(ValueError):
        own.check(["cat"], [[5]])


def test_sentencepiece_rows(odd_docs, odd_texts, no_docs):
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in sp_bpe.digests(odd_docs, PIECES).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for i, text in enumerate(odd_texts):
        ids = lib.encode(text or "")
        assert got[i] == (len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids)))
    assert sp_bpe.encode_decode(no_docs, PIECES).count() == 0


def test_records_round_trip(spark, odd_docs, odd_texts, no_docs):
    manifest = records.write_records(odd_docs, BYTES, 2, files=4)
    assert manifest.count() > 1
    got = sorted(tuple(r) for r in records.read_back(manifest).collect())
    texts = sorted([*enumerate(odd_texts), (7, odd_texts[7])], key=lambda p: p[0])
    start, want = 0, []
    for (i, _), ids in zip(texts, whole(BYTES, [t for _, t in texts])):
        ids = [*ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    assert records.read_back(records.write_records(no_docs, BYTES, 2)).count() == 0


def test_records_ids_order_and_width(spark, tmp_dir):
    rows = [(-1, "minus"), (None, "none"), (None, "none two"), (0, "zero"), (-2, "b"), (-2, "a"), (-2, "c")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    got = records.read_back(records.write_records(docs, BYTES, 2, files=3)).orderBy("start").collect()
    library = Tokenizer.from_file(BYTES)
    want = [(i, t) for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))]
    assert [r["doc_id"] for r in got] == [i for i, _ in want]
    ids = [np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4") for _, t in want]
    assert [r["ids_crc32"] for r in got] == [zlib.crc32(x.tobytes()) for x in ids]
    wide = records.write_records(docs, BYTES, 70_000, files=1)  # an end id that 2 bytes can't hold
    assert wide.first()["width"] == 4 and records.width_of(BYTES, 2) == 2
    found = {r["doc_id"]: r["ids_crc32"] for r in records.read_back(wide).collect()}
    assert found[0] == zlib.crc32(np.array([*library.encode("zero", add_special_tokens=False).ids, 70_000], "<u4").tobytes())


@pytest.mark.parametrize("text", ["a  b", " a", "a ", "▁", "a▁b  ▁", "x" * 1000, "  "])
def test_uneven_and_long_texts_are_checked_and_not_kept(text):
    encoder = sp_bpe.AgendaCodec(PIECES)
    checked = []
    plain = encoder.check
    encoder.check = lambda words, found: (checked.extend(words), plain(words, found))
    (n, joined, _), = encoder.batch(pa.array([text]))
    assert checked and joined == ",".join(map(str, encoder.library.encode(text))) and n == len(encoder.library.encode(text))
    assert all(len(w) <= sp_bpe.LONGEST_CACHED for w in encoder.words)


def test_records_are_read_in_any_order_and_guarded(odd_docs, tmp_dir):
    row = records.write_records(odd_docs, BYTES, 2, folder=f"file:{tmp_dir}/r", files=1).first()
    fs, root = common.file_system(row["folder"])
    path = f"{root}/{row['name']}.records"
    entries = records.read_index(fs, f"{root}/{row['name']}.index")
    straight = list(records.read_records(fs, path, entries, row["width"]))
    order = np.random.default_rng(0).permutation(len(entries))
    mixed = list(records.read_records(fs, path, entries[order], row["width"]))
    assert all(a == straight[i][0] and (b == straight[i][1]).all() for (a, b), i in zip(mixed, order))
    raw = bytearray(open(path, "rb").read())
    for at in (2, 9, 13):  # a bit of the length, of its checksum, of the payload
        raw[at] ^= 1
        with pytest.raises(ValueError):
            records.unframe(memoryview(raw), 0)
        raw[at] ^= 1


def test_packing(odd_docs, odd_texts, no_docs):
    got = [r.asDict() for r in packing.pack(odd_docs, WORDS, length=64).collect()]
    ids = {i: [*e, 1] for i, e in enumerate(whole(WORDS, odd_texts))}
    seen, filled = {}, {}
    for r in got:
        own = ids[r["doc_id"]]
        part = own[r["start"]:r["start"] + r["length"]]
        assert r["doc_tokens"] == len(own) and r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
        seen.setdefault(r["doc_id"], []).extend(range(r["start"], r["start"] + r["length"]))
        filled.setdefault(r["sequence_id"], []).extend(range(r["offset"], r["offset"] + r["length"]))
    assert all(sorted(v) == sorted(list(range(len(ids[i]))) * (2 if i == 7 else 1)) for i, v in seen.items()) and len(seen) == len(ids)
    total = sum(map(len, ids.values())) + len(ids[7])
    assert sorted(filled) == list(range(-(-total // 64)))
    assert all(sorted(v) == list(range(64 if s < total // 64 else total % 64)) for s, v in filled.items())
    assert packing.pack(no_docs, WORDS).count() == 0


def test_documents_lie_along_the_curve(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    laid = sorted((r["sequence_id"], r["offset"], r["doc_id"]) for r in packing.pack(docs, WORDS).filter("start = 0").collect())
    texts = docs.select("doc_id", "text").collect()
    ids = whole(WORDS, [r["text"] for r in texts])
    keys = packing.hilbert_keys(packing.cells_of(np.concatenate([np.array(i, np.uint32) for i in ids]), np.concatenate([[0], np.cumsum([len(i) for i in ids])])))
    assert [d for _, _, d in laid] == [d for _, d in sorted(zip(keys.tolist(), [r["doc_id"] for r in texts]))]


def test_hilbert_is_a_curve():
    """Every cell once, and one step between neighbours on the curve."""
    for dims, bits in ((2, 4), (3, 3)):
        side = np.arange(1 << bits)
        cells = np.stack(np.meshgrid(*[side] * dims), axis=-1).reshape(-1, dims)
        keys = packing.hilbert_keys(cells, bits)
        assert sorted(keys) == list(range(len(cells)))
        path = cells[np.argsort(keys)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()
