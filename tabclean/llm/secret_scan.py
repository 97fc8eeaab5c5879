"""Secret scan by a recursive decoding worklist.

A document is the first **layer** of its worklist. Each layer is scanned for
secrets, and every encoded part of it becomes a new layer: lines with URL
escapes (``%3D``), lines with Unicode escapes (``\\u0041``, ``\\x41``, ``&#65;``, ``U+0041``),
base64 runs (also wrapped over lines, URL-safe, unpadded, or glued to what
stands before them: all four alignments are tried), and compressed streams (gzip, zlib, bzip2, xz, zstd)
inside decoded bytes. That goes on until no new layer appears. A layer is known
by its content and the place it came from, so content that unpacks to itself ends (cycle
detection) and the same part reached by two ways is scanned once.

**Spans** always lie in the document, in code points, end exclusive. Each layer
keeps, for every character, the first and last character it was made from; a
compressed stream has no such places, so all it holds maps to the whole stream.

A secret found in a decoded layer adds a finding; the document's own ones stay.
Bytes are taken as Latin-1, one character a byte: all patterns are ASCII, so text that is no
valid UTF-8 is searched like any other.

The work is one Arrow pass over the texts and has no shuffle. Documents that
hold neither a secret's shape nor an encoded part (tested on whole texts by Arrow's
regular expressions) never become Python strings.

Limits (parameters): a stream that unpacks to more than ``unpack`` characters, or a document whose layers together
have more than ``whole``, gets a finding of kind ``oversize`` on that part, so that nothing is skipped silently.

Edge cases: null counts as empty, which has no findings; very long texts are scanned whole;
repeated rows give a row each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import io
import lzma
import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabclean.llm.common import slices, text_of

# Fixed: the kinds and their patterns. A key's letters may be in either case; lengths are of group 2 and of the match.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_VALUE, LEAST_ACCESS = 12, 18

ESCAPES = {
    "url": re.compile(r"%([0-9A-Fa-f]{2})"),
    "unicode": re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|(?:\\u|%u|U\+)([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});"),
}
# The shortest secret has 16 characters, 22 in base64; a compressed stream may be shorter and is known by its first bytes.
PACKED_64 = "eAE|eF4|eJw|eNo|H4sI|Qlpo|KLUv|/Td6"
RUN = re.compile(rf"[A-Za-z0-9+/_-]{{22,}}(?:\r?\n[A-Za-z0-9+/_-]{{4,}})*|(?:{PACKED_64})[A-Za-z0-9+/_-]{{8,}}")
MAGIC = re.compile(r"(?P<gzip>\x1f\x8b\x08)|(?P<zlib>x[\x01\x5e\x9c\xda])|(?P<bzip2>BZh[1-9]1AY&SY)|(?P<xz>\xfd7zXZ\x00)|(?P<zstd>\x28\xb5\x2f\xfd)")
BYTES = re.compile(r"[\x00-\xff]*")
# What a decoded layer must hold to be worth a scan: a secret's shape or something encoded.
WORTH = re.compile(rf"AKIA[A-Z0-9]|[0-9a-f]{{16}}|(?i:passw|secret|token|api_?key)|%[0-9A-Fa-fu]|\\[uUx]|&#|U\+|[A-Za-z0-9+/_-]{{22}}|{PACKED_64}|{MAGIC.pattern.replace('?P<', '?P<w')}")

# The same, for Arrow's regular expressions over whole documents.
SHAPES = (
    r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]""",
    r"[0-9a-f]{16}", r"AKIA[A-Z0-9]{14}",
    r"%[0-9A-Fa-fu]|\\[uUx]|&#|U\+[0-9A-Fa-f]{4}",
    rf"[A-Za-z0-9+/_-]{{22}}|{PACKED_64}",
    r"\x{1f}\x{8b}|x[\x{01}\x{5e}\x{9c}\x{da}]|BZh[1-9]1AY|\x{fd}7zXZ|\x{28}\x{b5}\x{2f}",
)

UNPACK, WHOLE = 32 << 20, 128 << 20

# Where a layer's characters come from: None (the document itself), a pair of
# places (all of them from there), or two arrays, the first place and the end by character.
Place = tuple | None


def matches(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the secrets in ``text``, in no order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    return found + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def origin(place: Place, start: int, end: int) -> tuple[int, int]:
    """The document's span behind ``[start, end)`` of a layer."""
    if place is None:
        return start, end
    if isinstance(place[0], np.ndarray):
        return int(place[0][start]), int(place[1][end - 1])
    return place


def derived(place: Place, first: np.ndarray, last: np.ndarray) -> Place:
    """The place of a layer whose characters came from ``first`` to ``last`` of their layer."""
    if place is None:
        return first, last + 1
    if isinstance(place[0], np.ndarray):
        return place[0][first], place[1][last]
    return place


def _character(m: re.Match) -> str:
    digits = m[m.lastindex]
    code = int(digits, 10 if m[0].startswith("&#") and m[0][2] not in "xX" else 16)
    return chr(code) if code < 0x110000 else "\ufffd"


def unescaped(text: str, place: Place, kind: str) -> Iterator[tuple[str, Place]]:
    """Each line with an escape of that kind, decoded once."""
    pattern, done = ESCAPES[kind], -1
    for m in pattern.finditer(text):
        if m.start() < done:
            continue
        start = text.rfind("\n", 0, m.start()) + 1
        done = len(text) if (end := text.find("\n", m.start())) < 0 else end
        line = text[start:done]
        at = np.array([x.span() for x in pattern.finditer(line)], np.int64)
        inside = np.zeros(len(line) + 1, np.int64)
        inside[at[:, 0] + 1] += 1
        inside[at[:, 1]] -= 1
        last = np.arange(len(line))
        last[at[:, 0]] = at[:, 1] - 1
        first = np.flatnonzero(np.cumsum(inside[:-1]) == 0)
        yield pattern.sub(_character, line), derived(place, first + start, last[first] + start)


def from_base64(text: str, place: Place) -> Iterator[tuple[str, Place]]:
    """Every base64 run, decoded at each of the four alignments."""
    for m in RUN.finditer(text):
        run = m[0]
        at = np.arange(m.start(), m.end())
        if "\n" in run:
            at = at[np.array([c not in "\r\n" for c in run])]
            run = run.replace("\r", "").replace("\n", "")
        run = run.replace("-", "+").replace("_", "/")
        for skip in range(4):
            body = run[skip:]
            body = body[:len(body) - (len(body) % 4 == 1)]
            data = base64.b64decode(body + "=" * (-len(body) % 4)).decode("latin-1")
            if WORTH.search(data):
                bit = np.arange(len(data)) * 8
                yield data, derived(place, at[skip + bit // 6], at[skip + (bit + 7) // 6])


def _unpacked(kind: str, data: bytes, most: int) -> tuple[bytes, int]:
    """At most ``most`` + 1 bytes that ``data`` unpacks to, and how many of its bytes that took."""
    if kind == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data)).read(most + 1), len(data)
    made = {"gzip": lambda: zlib.decompressobj(31), "zlib": zlib.decompressobj, "bzip2": bz2.BZ2Decompressor, "xz": lzma.LZMADecompressor}[kind]()
    out = made.decompress(data, most + 1)
    return out, len(data) - len(made.unused_data) if made.eof else len(data)


def unpacked(text: str, place: Place, most: int) -> Iterator[tuple[str, Place, bool]]:
    """Every compressed stream in a layer, and whether it was too large to unpack whole."""
    for m in MAGIC.finditer(text):
        data = BYTES.match(text, m.start())[0].encode("latin-1")
        try:
            out, used = _unpacked(m.lastgroup, data, most)
        except Exception:  # each library has errors of its own; bytes that only look like a stream are none
            continue
        if out:
            yield out[:most].decode("latin-1"), origin(place, m.start(), m.start() + used), len(out) > most


def findings(text: str, unpack: int = UNPACK, whole: int = WHOLE) -> list[tuple[int, int, int, str]]:
    """(start, kind number, end, how) of all secrets; ``how`` names the layers, and is empty in the document itself.

    Kind number 3 is ``oversize``.
    """
    found: dict[tuple[int, int, int], str] = {}
    work: deque[tuple[str, Place, str]] = deque([(text, None, "")])
    seen, total = set(), 0
    while work:
        layer, place, how = work.popleft()
        for start, kind, end in matches(layer):
            a, b = origin(place, start, end)
            found.setdefault((a, kind, b), how)
        steps = [(kind, *x, False) for kind in ESCAPES for x in unescaped(layer, place, kind)]
        steps += [("base64", *x, False) for x in from_base64(layer, place)]
        steps += [("packed", *x) for x in unpacked(layer, place, unpack)]
        for step, content, from_, cut in steps:
            if not content:
                continue
            span = origin(from_, 0, len(content))
            key = (hashlib.sha1(content.encode("utf-8", "surrogatepass")).digest(), span)
            if key in seen:
                continue
            seen.add(key)
            total += len(content)
            if cut or total > whole:
                found.setdefault((span[0], 3, span[1]), f"{how}>{step}".lstrip(">"))
            if total <= whole:
                work.append((content, from_, f"{how}>{step}".lstrip(">")))
    return sorted((*k, how) for k, how in found.items())


FINDING = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("how", pa.string())])


def suspects(texts: pa.Array) -> pa.Array:
    """Which texts hold a secret's shape or something encoded."""
    hit = pc.match_substring_regex(texts, SHAPES[0])
    for shape in SHAPES[1:]:
        hit = pc.or_(hit, pc.match_substring_regex(texts, shape))
    return hit


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unpack: int = UNPACK, whole: int = WHOLE) -> DataFrame:
    """One row a document: id and its findings (kind, start, end, how), in order of place and kind."""
    names = [*KINDS, "oversize"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(1)
            out: list[list] = [[]] * batch.num_rows
            for i in np.flatnonzero(suspects(texts).to_numpy(zero_copy_only=False)):
                out[i] = [(names[k], a, b, how) for a, k, b, how in findings(texts[i].as_py(), unpack, whole)]
            rows = [[dict(zip(("kind", "start", "end", "how"), x, strict=True)) for x in row] for row in out]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(FINDING))], ["_id", "findings"])

    id_type = dict(docs.select(F.col(f"`{id_col}`").alias("_id")).dtypes)["_id"]
    read = docs.select(F.col(f"`{id_col}`").alias("_id"), text_of(f"`{text_col}`").alias("_text"))
    schema = f"_id {id_type}, findings array<struct<kind:string,start:bigint,end:bigint,how:string>>"
    return read.mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def _listed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x.kind, x.start, x.end)), ",")


def digests(docs: DataFrame) -> DataFrame:
    """The contract's columns: counts and digest of the document's own findings, and all spans."""
    base = F.filter("findings", lambda x: x.how == "")
    counts = [F.expr(f"cast(size(filter(findings, x -> x.how = '' and x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in KINDS]
    return scan(docs).select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("findings")).alias("spans"))
