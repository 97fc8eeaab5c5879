"""Exact tokenisation by distinct chunks, for tokenizers of the tokenizers library.

Encoding a text as a whole repeats the same work for each of its frequent
words. Here a batch of texts is split, in Arrow, at single spaces between two
characters that are not white space, where neither tokenizer ever joins; the
distinct chunks are cut further by the tokenizer's own pattern, each distinct
piece is encoded once by the library's BPE model, and the ids are put together
again with array operations. Where a chunk holds a character beyond Latin
Extended-B (on which two Unicode versions might disagree), or a text has other
white space beside a space, the library encodes the chunk or the text itself.
So it does with a text that holds the string of an added token, if that is to
get the token's id (``special``), as in a plain call of the library.

Where white space is no part of a piece, most chunks need no pattern: those of
white space, ASCII marks and digits, and letters below Latin Extended-B's end are
cut into pieces over the bytes of the whole batch, and its distinct pieces go
straight to the model. An apostrophe or any other character leaves its chunk to
the pattern, as above.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

from tabclean.llm.common import WIDE_SPACE, no_nulls, ragged_take, split_on

MOST_CACHED = 250_000
LONGEST_CACHED = 64
SIMPLE = "ɐ"  # characters below are the same in every Unicode version in use

# Fixed: the patterns of the two vocabularies.
BYTE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""

# Fixed: kinds of bytes. A piece is a digit, or a run of letters or of marks; a run of ODD is a chunk for the pattern.
WHITE, LETTER, DIGIT, MARK, ODD = range(5)


def _kinds() -> np.ndarray:
    """Kind of each byte by itself: ODD for an apostrophe, for control characters and beyond ASCII."""
    kinds = np.full(256, ODD, np.uint8)
    kinds[33:127] = MARK
    kinds[[9, 10, 11, 12, 13, 32]] = WHITE
    kinds[48:58] = DIGIT
    kinds[65:91] = kinds[97:123] = LETTER
    kinds[39] = ODD
    return kinds


def _lowered() -> np.ndarray:
    """Lower case of each letter of two bytes below ``SIMPLE``, if that is a letter of two bytes; else 0."""
    low = [chr(c).lower() if chr(c).isalpha() and c < ord(SIMPLE) else "" for c in range(0x400)]
    return np.array([ord(x) if len(x) == 1 and x.isalpha() and len(x.encode()) == 2 else 0 for x in low], np.uint16)


KINDS, LOWERED = _kinds(), _lowered()
ASCII_LOWER = np.arange(256, dtype=np.uint8) + 32 * np.isin(np.arange(256), np.arange(65, 91)).astype(np.uint8)

# White space beside a space, or a space at either end of the text.
UNEVEN = f"[{WIDE_SPACE}] | [{WIDE_SPACE}]|^ | $"


def byte_letters() -> dict[int, str]:
    """The letter that byte-level BPE writes for each byte: printable ones as they are, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in set(plain))
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def lower_pieces(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
    """Pieces of WORD_PATTERN in lower case: codes, the distinct ones, bounds by text, and the codes of odd chunks.

    A chunk between two spaces that holds an ODD byte is one piece, as it stands.
    """
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    cuts = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data or b"", np.uint8)[cuts[0]:cuts[-1]]
    cuts = cuts - cuts[0]
    kinds, low = KINDS[raw], ASCII_LOWER[raw]
    pairs = np.flatnonzero((raw >= 0xC3) & (raw <= 0xC9))  # first bytes of U+00C0 to U+027F
    lowered = LOWERED[(raw[pairs] & 0x1F).astype(np.int64) << 6 | raw[pairs + 1] & 0x3F]
    pairs, lowered = pairs[lowered > 0], lowered[lowered > 0]
    kinds[pairs] = kinds[pairs + 1] = LETTER
    low[pairs], low[pairs + 1] = 0xC0 | lowered >> 6, 0x80 | lowered & 0x3F
    odd = np.flatnonzero(kinds == ODD)
    if len(odd):
        edges = np.unique(np.concatenate([cuts, np.flatnonzero(raw == 32) + 1]))
        chunk = np.unique(np.searchsorted(edges, odd, "right")) - 1
        ends = edges[chunk + 1]
        step = np.zeros(len(raw) + 1, np.int8)
        step[edges[chunk]] += 1
        step[ends - (raw[ends - 1] == 32)] -= 1
        whole = np.cumsum(step[:-1], dtype=np.int8).view(bool)
        kinds[whole], low[whole] = ODD, raw[whole]
    new = kinds == DIGIT
    new[1:] |= kinds[1:] != kinds[:-1]
    new[cuts[:-1][cuts[:-1] < len(raw)]] = True
    starts = np.flatnonzero(new)
    sizes = np.diff(starts, append=len(raw))
    real = kinds[starts] != WHITE
    starts, sizes = starts[real], sizes[real]
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    pieces = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(low[kinds != WHITE])]).dictionary_encode()
    codes = pieces.indices.to_numpy(zero_copy_only=False)
    return codes, pieces.dictionary.to_numpy(zero_copy_only=False).tolist(), np.searchsorted(starts, cuts), np.unique(codes[kinds[starts] == ODD])


class ChunkEncoder:
    """Ids of whole texts, equal to ``encode(text, add_special_tokens=False)`` of the library.

    Caches are dropped when they reach ``MOST_CACHED`` entries, of at most ``LONGEST_CACHED`` characters each.
    Where few chunks are cached (not ``spaced``), dropped pieces serve once more, until the next drop.
    """

    def __init__(self, path: str, spaced: bool, special: bool = False):
        """``spaced``: a word's leading space is part of it (byte-level); else white space is dropped.

        ``special``: the string of a special token in a text gets that token's
        id, the library's default; else it is ordinary text.
        """
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = not special
        added = self.library.get_added_tokens_decoder().values()
        self.added = "|".join(regex.escape(t.content) for t in added if special or not t.special)
        self.model = self.library.model
        self.spaced = spaced
        self.find = regex.compile(BYTE_PATTERN if spaced else WORD_PATTERN).findall
        self.letters = byte_letters()
        self.pieces: dict[str, bytes] = {}
        self.dropped: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        found = self.dropped.get(piece)
        if found is None:
            found = self._modelled(piece)
        if len(piece) <= LONGEST_CACHED:
            self.pieces[piece] = found
        return found

    def _modelled(self, piece: str) -> bytes:
        if piece.isascii() and piece.isprintable():  # only the space has another letter
            letters = piece.replace(" ", self.letters[32])
        else:
            letters = piece.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def chunk(self, chunk: str) -> bytes:
        """Ids of one chunk, as bytes of uint32."""
        found = self.chunks.get(chunk)
        if found is None:
            if not chunk.isascii() and max(chunk) >= SIMPLE:
                found = self._whole(chunk)
            else:
                pieces, plain = self.pieces, chunk if self.spaced else chunk.lower()
                if chunk.isascii() and chunk.lstrip(" ").isalpha():  # letters alone, with at most the space before them, are one piece
                    found = pieces.get(plain) or self._piece(plain)
                else:
                    found = b"".join([pieces.get(p) or self._piece(p) for p in self.find(plain)])
            if len(chunk) <= LONGEST_CACHED:
                self.chunks[chunk] = found
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the bounds of each text."""
        texts = no_nulls(texts)
        if len(self.pieces) > MOST_CACHED:
            self.dropped = {} if self.spaced else self.pieces
            self.pieces = {}
        if len(self.chunks) > MOST_CACHED:
            self.chunks.clear()
        by_library = [p for p in (UNEVEN if self.spaced else "", self.added) if p]
        uneven = np.flatnonzero(pc.match_substring_regex(texts, "|".join(by_library)).to_numpy(zero_copy_only=False)) if by_library else []
        if self.spaced:  # a chunk after the first takes its space along
            codes, words, bounds = split_on(texts)
            first = bounds[:-1]
            encoded = [self.chunk(" " + w) for w in words]
            heads = np.full(len(texts), len(words)) + np.arange(len(texts))
            encoded += [self.chunk(words[c]) for c in codes[first]]
            codes = codes.astype(np.int64)
            codes[first] = heads
        else:
            codes, words, bounds, odd = lower_pieces(texts)
            encoded = list(map(self.pieces.get, words))
            for c in odd.tolist():
                encoded[c] = self.chunk(words[c])
            encoded = [self._piece(w) if e is None else e for e, w in zip(encoded, words)]
        lengths = np.fromiter(map(len, encoded), np.int64, len(encoded)) // 4
        values = np.frombuffer(b"".join(encoded), np.uint32)
        ids, cuts = ragged_take(values, np.cumsum(lengths) - lengths, lengths, codes)
        cuts = cuts[bounds]
        if not len(uneven):
            return ids, cuts
        parts = [ids[a:b] for a, b in zip(cuts, cuts[1:])]
        for i in uneven:
            parts[i] = np.frombuffer(self._whole(texts[int(i)].as_py()), np.uint32)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


_ENCODERS: dict[tuple[str, bool, bool], ChunkEncoder] = {}


def encoder(path: str, spaced: bool, special: bool = False) -> ChunkEncoder:
    """The encoder of this worker process for a vocabulary file."""
    if (path, spaced, special) not in _ENCODERS:
        _ENCODERS[path, spaced, special] = ChunkEncoder(path, spaced, special)
    return _ENCODERS[path, spaced, special]
