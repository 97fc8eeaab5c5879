"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Encoding: the text with spaces written as U+2581 (and one in front) starts
as single characters. An agenda holds every adjacent pair of symbols whose
union is in the vocabulary, best score first, then leftmost; the top pair is
merged and its new neighbours join the agenda, until none is left. Symbols
outside the vocabulary become their UTF-8 bytes' pieces. Decoding turns ids
back into pieces, byte pieces into characters (U+FFFD for a byte that is
none), and drops the space in front.

Two neighbours that stand beside each other in no piece can never merge, so a
text is cut there without changing the result. Since no piece holds a space
mark after another character, words are such parts: a batch is split at
single spaces in Arrow, each distinct word is run through the agenda once, and
ids and surfaces are put together again. Every Arrow batch checks its new
words, ids and decoded text, against the sentencepiece library, and raises
where they differ.

Edge cases: a null or empty text has no ids and decodes to an empty text.
Rows repeated with one id give a row each. U+2581 in a text decodes to a space,
as in the library.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabclean.llm.common import no_nulls, split_on

MARK = "▁"
MOST_CACHED = 600_000
LONGEST_CACHED = 64
# Two spaces in a row, one at an end, or the mark itself: such texts are cut as a whole.
UNEVEN = f"  |^ | $|{MARK}"


class AgendaCodec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.library.get_piece_size()
        self.surface: list[str | int | None] = []  # text of a piece, byte of a byte piece, None for control pieces
        self.ids: dict[str, int] = {}
        self.cost: dict[str, float] = {}  # least first
        self.byte_ids: dict[int, int] = {}
        for i in range(size):
            piece = self.library.id_to_piece(i)
            if self.library.is_byte(i):
                self.surface.append(int(piece[3:5], 16))
                self.byte_ids[int(piece[3:5], 16)] = i
            elif self.library.is_control(i) or self.library.is_unknown(i):
                self.surface.append(None)
            else:
                self.surface.append(piece.replace(MARK, " "))
                self.ids[piece] = i
                self.cost[piece] = -self.library.get_score(i)
        if len(self.byte_ids) != 256:
            raise ValueError("the vocabulary has no byte pieces")
        self.beside = {p[i:i + 2] for p in self.ids for i in range(len(p) - 1)}
        if any(pair[1] == MARK and pair[0] != MARK for pair in self.beside):
            raise ValueError("pieces of the vocabulary go beyond words")
        self.known: dict[str, tuple[int, ...]] = {}
        self.words: dict[str, tuple[str, str, int]] = {}

    def _merge(self, part: str) -> tuple[int, ...]:
        """Ids of a part by the agenda."""
        cost = self.cost.get
        symbols = list(part)
        agenda = [(c, i, i + 1, 2) for i, pair in enumerate(map(add, part, part[1:])) if (c := cost(pair)) is not None]
        heapify(agenda)
        after, ahead, end = list(range(1, len(part) + 1)), list(range(-1, len(part) - 1)), len(part)
        while agenda:
            _, i, j, size = heappop(agenda)
            left, right = symbols[i], symbols[j]
            if not left or not right or len(left) + len(right) != size:
                continue  # one of the two has merged otherwise
            symbols[i] = merged = left + right
            symbols[j] = ""
            after[i] = k = after[j]
            if k < end:
                ahead[k] = i
                if (c := cost(merged + symbols[k])) is not None:
                    heappush(agenda, (c, i, k, size + len(symbols[k])))
            if (h := ahead[i]) >= 0 and (c := cost(symbols[h] + merged)) is not None:
                heappush(agenda, (c, h, i, size + len(symbols[h])))
        out: list[int] = []
        for s in symbols:
            if s:
                whole = self.ids.get(s)
                if whole is not None:
                    out.append(whole)
                else:
                    out += [self.byte_ids[b] for b in s.encode()]
        return tuple(out)

    def _part(self, part: str) -> tuple[int, ...]:
        found = self.known.get(part)
        if found is None:
            found = self._merge(part)
            if len(part) <= 32:
                self.known[part] = found
        return found

    def encode_marked(self, text: str) -> list[int]:
        """Ids of a text whose spaces are marks already; cut where no piece reaches across."""
        beside = self.beside
        cuts = [i for i, pair in enumerate(map(add, text, text[1:]), 1) if pair not in beside]
        if not cuts:
            return list(self._part(text))
        out: list[int] = []
        for a, b in zip([0, *cuts], [*cuts, len(text)]):
            out += self._part(text[a:b])
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_marked(MARK + text.replace(" ", MARK)) if text else []

    def spell(self, ids: list[int]) -> str:
        """Text of ids, without taking off the space in front."""
        out: list[str] = []
        raw = bytearray()
        for i in [*ids, None]:
            piece = None if i is None else self.surface[i]
            if isinstance(piece, int):
                raw.append(piece)
                continue
            if raw:
                out.append(spell_bytes(bytes(raw)))
                raw.clear()
            if piece is not None:
                out.append(piece)
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        text = self.spell(ids)
        first = self.surface[ids[0]] if ids else None
        return text[1:] if isinstance(first, str) and first.startswith(" ") else text

    def check(self, words: list[str], found: list[list[int]]) -> None:
        """Raise unless the library gives the same ids, and the same text for them."""
        if not words:
            return
        if self.library.encode(words, num_threads=1) != found:
            bad = next(w for w, ids in zip(words, found) if self.library.encode(w) != ids)
            raise ValueError(f"ids differ from the library for {bad!r}")
        if self.library.decode(found, num_threads=1) != [self.decode(ids) for ids in found]:
            raise ValueError("a decoded text differs from the library")

    def batch(self, texts: pa.Array) -> Iterator[tuple[int, str, str]]:
        """(number of ids, ids joined by commas, decoded text) of every text."""
        texts = no_nulls(texts)
        if len(self.known) > MOST_CACHED:
            self.known.clear()
        if len(self.words) > MOST_CACHED:
            self.words.clear()
        uneven = pc.match_substring_regex(texts, UNEVEN).to_numpy(zero_copy_only=False)
        codes, words, bounds = split_on(texts)
        new = [w for w in words if w and w not in self.words]
        found = [self.encode(w) for w in new]
        self.check(new, found)
        self.words.update((w, (",".join(map(str, ids)), self.spell(ids), len(ids))) for w, ids in zip(new, found))
        self.words.setdefault("", ("", "", 0))
        entries = [self.words[w] for w in words]
        for w in new:
            if len(w) > LONGEST_CACHED:
                del self.words[w]
        lengths = np.array([e[2] for e in entries], np.int64)
        apart = {i: texts[i].as_py() for i in np.flatnonzero(uneven).tolist()}
        whole = {i: self.encode(text) for i, text in apart.items()}
        self.check(list(apart.values()), list(whole.values()))
        codes = codes.tolist()
        joined, spelt = [e[0] for e in entries], [e[1] for e in entries]
        for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
            if i in whole:
                ids = whole[i]
                yield len(ids), ",".join(map(str, ids)), self.decode(ids)
            else:
                own = codes[a:b]
                yield int(lengths[own].sum()), ",".join([joined[c] for c in own]), "".join([spelt[c] for c in own])[1:]


def spell_bytes(raw: bytes) -> str:
    """UTF-8 text of bytes; each byte that is part of no character becomes U+FFFD."""
    out, at = [], 0
    while at < len(raw):
        size = next((n for n in (1, 2, 3, 4) if _is_character(raw[at:at + n])), 0)
        out.append(raw[at:at + size].decode() if size else "�")
        at += size or 1
    return "".join(out)


def _is_character(raw: bytes) -> bool:
    try:
        return len(raw.decode()) == 1
    except UnicodeDecodeError:
        return False


_CODECS: dict[str, AgendaCodec] = {}


def codec(path: str) -> AgendaCodec:
    """The codec of this worker process for a vocabulary file."""
    if path not in _CODECS:
        _CODECS[path] = AgendaCodec(path)
    return _CODECS[path]


def encode_decode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, n_tokens, ids (joined by commas) and decoded text of every row."""
    return _mapped(docs, vocabulary, id_col, text_col, lambda n, ids, text: (n, ids, text),
                   "_id bigint, n_tokens bigint, ids string, decoded string")


def digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, n_tokens, and the SHA-256 of the joined ids and of the decoded text of every row."""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return _mapped(docs, vocabulary, id_col, text_col, lambda n, ids, text: (n, sha(ids), sha(text)),
                   "_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def _mapped(docs: DataFrame, vocabulary: str, id_col: str, text_col: str, shape, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        for batch in batches:
            rows = [shape(*found) for found in own.batch(batch.column(1))]
            cols = list(zip(*rows)) if rows else [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()),
                                              pa.array(cols[2], pa.string())], names=names)
    names = [c.split()[0] for c in schema.split(", ")]
    rows = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, schema).withColumnRenamed("_id", id_col)
