"""Token ids as length-delimited binary records with an offset index.

Format of a data file: records one after the other, each

    uint64 length | uint32 masked checksum of those 8 bytes |
    payload of that length | uint32 masked checksum of the payload

all little-endian. A payload is the ids of one document as little-endian
unsigned integers of the file's width (2 bytes if all ids of the vocabulary
and the end id allow it, else 4). The checksum is CRC-32 (zlib), masked by rotating it right by 15 bits
and adding a constant, so that a checksum over bytes that hold checksums stays
sound. Beside each data file lies an index file: for every record the document
id, whether there is one (0 for a null id, else 1), the offset and the length of its frame (int64
each), so records can be read in any order.

Documents are range-partitioned by id and, within an id, by their place in the input, so the rows of
an id that very many share (or of no id) are cut into ranges too. A task writes one data file and its
index, under names of its own attempt, and only the files of attempts that
Spark commits are in the manifest. A lost executor thus costs its running
tasks and leaves no doubtful file in use.

Edge cases: a null text counts as empty, which is a record with the end id
alone; a very long one is one record, encoded whole. Null ids sort first. Rows repeated with one id are
records of their own, in the order of the input. Other columns are not read. An empty table gives an empty manifest and no rows.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext
from tokenizers import Tokenizer

from tabclean.llm.chunks import encoder
from tabclean.llm.common import file_system, running_totals, slices, stored
from tabclean.session import scratch_dir

# Fixed values of the format.
MASK_DELTA = 0xA282EAD8
HEAD, FOOT = 12, 4

READ_BYTES = 8 << 20
MANIFEST = "part bigint, folder string, name string, width int, records bigint, tokens bigint"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return length + struct.pack("<I", masked(length)) + payload + struct.pack("<I", masked(payload))


def unframe(data: memoryview, at: int) -> memoryview:
    """The payload of the record at ``at``; raises if a checksum differs."""
    length = bytes(data[at:at + 8])
    if struct.unpack_from("<I", data, at + 8)[0] != masked(length):
        raise ValueError(f"record at {at}: checksum of the length differs")
    n = struct.unpack("<Q", length)[0]
    payload = data[at + HEAD:at + HEAD + n]
    if struct.unpack_from("<I", data, at + HEAD + n)[0] != masked(payload):
        raise ValueError(f"record at {at}: checksum of the data differs")
    return payload


def _writer(folder: str, vocabulary: str, end_id: int, width: int, special: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        fs, root = file_system(folder)
        name = f"part-{part:06d}-{uuid.uuid4().hex}"
        encode, kind = encoder(vocabulary, spaced=True, special=special), np.dtype(f"<u{width}")
        entries, tokens, offset, out = [], 0, 0, None
        for batch in slices(batches):
            if out is None:
                fs.create_dir(root, recursive=True)
                out = fs.open_output_stream(f"{root}/{name}.records")
            ids, bounds = encode.encode(batch.column(1))
            ids = ids.astype(kind)
            end = np.array([end_id], kind).tobytes()
            frames = []
            for doc, a, b in zip(batch.column(0).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                frames.append(frame(ids[a:b].tobytes() + end))
                entries.append((doc or 0, int(doc is not None), offset, len(frames[-1])))
                offset += len(frames[-1])
                tokens += b - a + 1
            out.write(b"".join(frames))
        if out is not None:
            out.close()
            with fs.open_output_stream(f"{root}/{name}.index") as index:
                index.write(np.array(entries, "<i8").tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array([part]), pa.array([folder]), pa.array([name]), pa.array([width], pa.int32()),
                 pa.array([len(entries)]), pa.array([tokens])], names=["part", "folder", "name", "width", "records", "tokens"])
    return run


def width_of(vocabulary: str, end_id: int) -> int:
    """Bytes of an id: 2 if every id of the vocabulary and the end id fit, else 4."""
    return 2 if max(end_id, *Tokenizer.from_file(vocabulary).get_vocab(with_added_tokens=True).values()) < 1 << 16 else 4


def write_records(docs: DataFrame, vocabulary: str, end_id: int, folder: str | None = None, id_col: str = "doc_id",
                  text_col: str = "text", files: int | None = None, special: bool = False) -> DataFrame:
    """Write every document in ascending id order; returns the manifest (a row a file).

    ``folder`` must be one that all executors share; by default a fresh one
    beside the checkpoints. ``special``: strings of special tokens in a text
    get those tokens' ids, as in a plain call of the library.
    """
    spark = docs.sparkSession
    folder = folder or scratch_dir(spark, "records")
    files = files or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).alias("_text"), F.monotonically_increasing_id().alias("_row"))
    ordered = rows.repartitionByRange(files, "_id", "_row").sortWithinPartitions("_id", "_row").select("_id", "_text")
    return stored(ordered.mapInArrow(_writer(folder, vocabulary, end_id, width_of(vocabulary, end_id), special), MANIFEST), "records-manifest")


def read_index(fs, path: str) -> np.ndarray:
    """(id, whether there is one, offset, length) of every record of a file."""
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), "<i8").reshape(-1, 4)


def read_records(fs, path: str, entries: np.ndarray, width: int) -> Iterator[tuple[int | None, np.ndarray]]:
    """(id, ids) of the given index entries, in the order given; neighbours are read together."""
    with fs.open_input_file(path) as f:
        at = 0
        while at < len(entries):
            last, begin = at, int(entries[at, 2])
            while (last + 1 < len(entries) and entries[last + 1, 2] == entries[last, 2] + entries[last, 3]
                   and entries[last + 1, 2] + entries[last + 1, 3] - begin <= READ_BYTES):
                last += 1
            size = int(entries[last, 2] + entries[last, 3]) - begin
            f.seek(begin)
            data = memoryview(f.read(size))
            for doc, there, offset, _ in entries[at:last + 1].tolist():
                yield doc if there else None, np.frombuffer(unframe(data, offset - begin), f"<u{width}")
            at = last + 1


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            fs, root = file_system(row["folder"])
            name = f"{root}/{row['name']}"
            entries = read_index(fs, f"{name}.index")
            start, out = row["before"], []
            for doc, ids in read_records(fs, f"{name}.records", entries, row["width"]):
                out.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                start += len(ids)
                if len(out) == 10_000:
                    yield _found(out)
                    out = []
            yield _found(out)


def _found(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else ((),) * 4)],
                                      names=["_id", "start", "n_tokens", "ids_crc32"])


def read_back(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Read the files of a manifest: id, start, n_tokens and ids_crc32 of every record."""
    placed = running_totals(manifest, "part", "tokens")
    dealt = placed.repartition(max(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1), "part")
    return dealt.mapInArrow(_reader, "_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint").withColumnRenamed("_id", id_col)
