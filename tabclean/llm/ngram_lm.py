"""Language-model scores from a weighted backoff automaton over all of the corpus.

The states of the automaton are the contexts seen in training: the empty one
and every run of up to ``ORDER`` - 1 words (the start of a text counts as one, at its place). An
arc leaves state h with word w where training has hw; its weight is the interpolated
probability l(h) c(hw)/c(h) + (1 - l(h)) p(w after h without its first word). Every state has a
failure arc of weight 1 - l(h) to the state without its first word, down to the
empty state, whose arcs are the smoothed unigrams p(w) = (c(w)+1)/(N+V+1). With l(h) =
TOP c(h)/(c(h)+HALF) the weights of the words after any state add up to one (counting one
share for all unseen words). A text is read left to right: its state is carried along, failure
arcs are followed from state to state where no arc matches, their weights included, and the
log-probabilities are added. An arc leads to the longest context that ends in its word.

The automaton grows with the corpus and is never gathered in one place. The
texts are stored as blocks of word codes. The distinct words of each block go
to buckets by hash, are counted there over all blocks, and only the counts
that a block needs return to it; so do its distinct pairs, triples and so on.
A bucket holds at most one entry a block for any of them, however
frequent, so no word is a hot key. Each block thus receives the part of
the automaton that its texts can reach, and traverses it alone. A block sends a row to
each bucket that holds any of its runs, so never more rows than it has distinct runs: what is
sent grows with the input, though rows get smaller with the number of buckets. The blocks
are stored bucketed by number and do not move to where their counts return.

Words and runs of words are told apart by 64-bit hashes in the buckets of runs, and as
strings in the buckets of words. All counts cover all training documents.

Edge cases: a null or empty text is the end token alone; a very long one is read whole (a block
holds at least one batch of texts). Without training rows every count is zero. Rows repeated with one
id are scored (and learned from) each. A null id counts as empty text in the split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from tabclean.llm.common import ascii_words, no_nulls, stored, stored_by

ORDER = 3
TOP, HALF = 0.8, 1.0
FEW_LIVE = 16  # texts that go on; so few advance one by one
BLOCK_CHARS = 8 << 20
BUCKET_WORDS = 1 << 20
# Fixed: codes of the end of a text and of its start in every block.
END, START = 0, 1
BLOCKS = "block bigint, ids array<bigint>, held binary, bounds binary, words binary, codes binary, n_tokens bigint, n_texts bigint"
SENT = "kind int, bucket int, block bigint, data binary"
COUNTED = SENT + ", v bigint, n bigint"


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed blob; bytes of equal weight stand together."""
    out = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        planes = a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if len(a) else b""
        body = pa.compress(planes, codec="zstd", asbytes=True) if planes else b""
        out.append(np.array([len(body), len(a)], np.int64).tobytes() + a.dtype.str.encode().ljust(8) + body)
    return b"".join(out)


def unpack(blob: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(blob):
        size, n = np.frombuffer(blob, np.int64, 2, at)
        kind = np.dtype(bytes(blob[at + 16:at + 24]).decode().strip())
        at += 24
        if n:
            planes = np.frombuffer(pa.decompress(blob[at:at + size], int(n) * kind.itemsize, codec="zstd", asbytes=True), np.uint8)
            out.append(np.ascontiguousarray(planes.reshape(kind.itemsize, n).T).view(kind).ravel())
        else:
            out.append(np.empty(0, kind))
        at += int(size)
    return out


def pack_words(words: list[str]) -> bytes:
    return pack(np.frombuffer("\n".join(words).encode(), np.uint8))


def unpack_words(blob: bytes) -> list[str]:
    text = unpack(blob)[0].tobytes().decode()
    return text.split("\n") if text else []


def _small(a: np.ndarray) -> np.ndarray:
    """The same counts in the least unsigned width."""
    return a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0))


def word_hashes(words: list[str]) -> np.ndarray:
    """64-bit hash of each word; the end and the start of a text have fixed ones."""
    hashed = xxhash.xxh64_intdigest
    return np.array([hashed(b"\n", END), hashed(b"\n", START), *[hashed(w.encode()) for w in words]], np.uint64)


def gram_keys(hashes: np.ndarray, codes: np.ndarray, bounds: np.ndarray, order: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For runs of n = 2.. ``order`` words: n, the 64-bit key of the run that ends at each token, and where there is one.

    The key of a run is made of that of the run before its last word. The start of a text
    is the word before the first.
    """
    own = hashes[codes]
    place = np.arange(len(codes)) - np.repeat(bounds[:-1], np.diff(bounds))
    key = own
    for n in range(2, order + 1):
        x = np.empty_like(key)
        x[1:] = key[:-1]
        if n == 2:
            x[place == 0] = hashes[START]
        x = x * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)
        x = (x ^ (x >> np.uint64(32))) + own
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        key = x ^ (x >> np.uint64(32))
        yield n, key, place >= n - 2


def _block(texts: list[pa.Array], ids: list, held: list, number: int) -> tuple:
    codes, words, cuts = ascii_words(pa.concat_arrays(texts))
    n = np.diff(cuts)
    bounds = np.concatenate([[0], np.cumsum(n + 1)])
    out = np.full(bounds[-1], END, np.int32)
    out[np.arange(len(codes)) + np.repeat(np.arange(len(n)), n)] = codes + 2
    # Frequent words get small codes, which compress best; the empty chunk is no word.
    times = np.bincount(codes, minlength=len(words)).tolist()
    used = np.array(sorted((i for i, t in enumerate(times) if t), key=lambda i: (-times[i], words[i])), np.int64)
    place = np.arange(len(words) + 2, dtype=np.int32)
    place[used + 2] = np.arange(len(used)) + 2
    out, words = place[out], [words[i] for i in used]
    return (number, ids, pack(np.array(held, np.uint8)), pack(np.diff(bounds).astype(np.uint32)), pack_words(words),
            pack(out.astype(np.uint32)), len(out), held.count(False))


def _to_blocks(block_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("held", pa.binary()), ("bounds", pa.binary()),
                            ("words", pa.binary()), ("codes", pa.binary()), ("n_tokens", pa.int64()), ("n_texts", pa.int64())])
        number = TaskContext.get().partitionId() << 24
        texts, ids, held, size = [], [], [], 0
        emit = lambda: pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(_block(texts, ids, held, number), schema.types)], schema=schema)
        for batch in batches:
            texts.append(no_nulls(batch.column(1)))
            ids += batch.column(0).to_pylist()
            held += batch.column(2).to_pylist()
            size += texts[-1].nbytes
            if size >= block_chars:
                yield emit()
                texts, ids, held, size, number = [], [], [], 0, number + 1
        if ids:
            yield emit()
    return run


def blocks_of(docs: DataFrame, held_out, id_col: str, text_col: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).alias("_text"), held_out.alias("_held"))
    return stored_by(rows.mapInArrow(_to_blocks(block_chars), BLOCKS), "lm-blocks", "block")


def _read(row: dict) -> tuple:
    """ids, held-out flags, bounds, words, codes of a stored block."""
    held = unpack(row["held"])[0].astype(bool)
    bounds = np.concatenate([[0], np.cumsum(unpack(row["bounds"])[0], dtype=np.int64)])
    return row["ids"], held, bounds, unpack_words(row["words"]), unpack(row["codes"])[0].astype(np.int64)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _sent(rows: list[tuple]) -> pa.RecordBatch:
    kind, bucket, block, data = zip(*rows) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(bucket, pa.int32()), pa.array(block, pa.int64()), pa.array(data, pa.binary())],
                                      names=["kind", "bucket", "block", "data"])


def _bucket_order(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Order of the hashes by value, and (bucket, begin, end) in it of every bucket (a range of values) that has any."""
    order = np.argsort(hashes, kind="stable")
    number = (hashes[order] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    used, begin = np.unique(number, return_index=True)
    return order, list(zip(used.tolist(), begin.tolist(), [*begin[1:].tolist(), len(hashes)]))


def _send_words(buckets: int):
    """Each block's words and their training counts, by bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            _, held, bounds, words, codes = _read(row)
            train = np.repeat(~held, np.diff(bounds))
            counts = np.bincount(codes[train], minlength=len(words) + 2)[2:]
            order, parts = _bucket_order(word_hashes(words)[2:], buckets)
            out = []
            for b, a, z in parts:
                part = order[a:z]
                text = pack_words([words[i] for i in part])
                out.append((1, b, row["block"], len(text).to_bytes(8, "little") + text + pack(_small(counts[part]))))
            yield _sent(out)
    return run


def _count_words(key: tuple, group: pa.Table) -> pa.Table:
    """Counts of a bucket's words over all blocks, returned to every block; the first row has its V and N."""
    bucket = key[0].as_py()
    words, counts, sizes = [], [], []
    for blob in group.column("data").to_pylist():
        n = int.from_bytes(blob[:8], "little")
        part = unpack_words(blob[8:8 + n])
        words += part
        sizes.append(len(part))
        counts.append(unpack(blob[8 + n:])[0].astype(np.int64))
    codes = pa.array(words, pa.string()).dictionary_encode().indices.to_numpy()
    total = np.bincount(codes, weights=np.concatenate(counts)).astype(np.int64)
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    out = [(1, bucket, block, pack(_small(total[codes[a:b]])))
           for block, a, b in zip(group.column("block").to_pylist(), cuts, cuts[1:])]
    table = pa.Table.from_batches([_sent(out)])
    for name, value in (("v", (total > 0).sum()), ("n", total.sum())):
        table = table.append_column(name, pa.array([int(value), *[0] * (len(out) - 1)], pa.int64()))
    return table


def _send_grams(buckets: int, order: int):
    """Each block's distinct runs of two words and more and their training counts, by length and bucket, sorted by key."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            _, held, bounds, words, codes = _read(row)
            train = np.repeat(~held, np.diff(bounds))
            for n, key, there in gram_keys(word_hashes(words), codes, bounds, order):
                keys, inverse = np.unique(key[there], return_inverse=True)
                counts = np.bincount(inverse[train[there]], minlength=len(keys))
                del inverse
                yield _sent([(n, b, row["block"], pack(np.diff(keys[a:z], prepend=np.uint64(0)), _small(counts[a:z])))
                             for b, a, z in _bucket_order(keys, buckets)[1]])
    return run


def _count_grams(key: tuple, group: pa.Table) -> pa.Table:
    kind, bucket = (k.as_py() for k in key)
    keys, counts = [], []
    for blob in group.column("data").to_pylist():
        step, n = unpack(blob)
        keys.append(np.cumsum(step, dtype=np.uint64))
        counts.append(n.astype(np.int64))
    cuts = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
    flat, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(flat, kind="stable")
    ordered = flat[order]
    run = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
    total = np.empty(len(flat), np.int64)
    total[order] = np.bincount(run, weights=n[order])[run].astype(np.int64)
    return pa.Table.from_batches([_sent([(kind, bucket, block, pack(_small(total[a:b])))
                                         for block, a, b in zip(group.column("block").to_pylist(), cuts, cuts[1:])])])


class BackoffAutomaton:
    """The part of the automaton that the texts of one block can reach.

    ``count``: training count of every word code; ``grams``: for each length from two on, the training
    count of the run that ends at each token (0 where there is none); N and V of the corpus; ``starts``:
    training texts. What belongs to a token's longest and shorter contexts is kept by token:
    ``arc[d]`` whether the context of d words before it has an arc with it, ``read[d]`` the arc's log10
    weight, ``fail[d]`` that of the context's failure arc.
    """

    def __init__(self, count: np.ndarray, grams: list[np.ndarray], codes: np.ndarray, bounds: np.ndarray,
                 n: int, v: int, starts: int, top: float = TOP, half: float = HALF):
        self.codes, self.bounds, self.order = codes, bounds, len(grams) + 1
        self.empty = (count + 1.0) / (n + v + 1.0)  # arcs of the empty state
        self.known = count[codes] > 0
        place = np.arange(len(codes)) - np.repeat(bounds[:-1], np.diff(bounds))
        weight = self.empty[codes]
        self.arc, self.read, self.fail = [self.known], [np.log10(weight)], [np.zeros(0)]
        runs = [count[codes].astype(np.int64), *grams]
        for d in range(1, self.order):
            visits = np.zeros(len(codes))
            visits[1:] = runs[d - 1][:-1]  # the run of d words that ends before the token
            visits[place < d - 1] = 0  # with the start of the text as a word, a token has place + 1 before it
            if d == 1:
                visits[place == 0] = starts
            share = top * visits / (visits + half)
            weight = np.divide(share * grams[d - 1], visits, out=np.zeros(len(codes)), where=visits > 0) + (1 - share) * weight
            self.arc.append(grams[d - 1] > 0)
            self.read.append(np.log10(weight))
            self.fail.append(np.log10(1 - share))

    def traverse(self) -> np.ndarray:
        """Log10 probability of each text, read left to right with the state carried from token to token.

        The state is the number of words of the context before the token. Texts advance
        together; the last few long ones go on alone.
        """
        length = np.diff(self.bounds)
        order = np.argsort(-length, kind="stable")
        begin, longest = self.bounds[:-1][order], length[order]
        total, state = np.zeros(len(length)), np.full(len(length), min(1, self.order - 1))
        steps = int(longest[FEW_LIVE - 1]) if len(longest) >= FEW_LIVE else 0
        for t in range(steps):
            live = int(np.searchsorted(-longest, -t, "left"))
            total[:live] += self._advance(state[:live], begin[:live] + t)
        for i in np.flatnonzero(longest > steps):
            total[i] += self._alone(int(begin[i]) + steps, int(begin[i] + longest[i]), int(state[i]))
        out = np.empty(len(length))
        out[order] = total
        return out

    def _advance(self, state: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Log weights of the next tokens; ``state`` becomes the states behind them."""
        got = np.zeros(len(at))
        depth, open_ = state.copy(), np.ones(len(at), bool)
        for d in range(self.order - 1, 0, -1):
            here = np.flatnonzero(open_ & (depth == d))
            hit = self.arc[d][at[here]]
            reads, fails = here[hit], here[~hit]
            got[reads] += self.read[d][at[reads]]
            state[reads] = min(d + 1, self.order - 1)
            open_[reads] = False
            got[fails] += self.fail[d][at[fails]]
            depth[fails] = d - 1
        left = np.flatnonzero(open_)
        got[left] += self.read[0][at[left]]
        state[left] = np.minimum(self.known[at[left]], self.order - 1)
        return got

    def _alone(self, begin: int, end: int, state: int) -> float:
        arc, read, fail = ([x[begin:end].tolist() for x in kind] for kind in (self.arc, self.read, self.fail))
        total, most = 0.0, self.order - 1
        for t in range(end - begin):
            d = state
            while d and not arc[d][t]:
                total += fail[d][t]
                d -= 1
            total += read[d][t]
            state = min(d + 1, most) if arc[d][t] else 0
        return total


def _score(totals: tuple[int, int, int, int], order: int):
    n, v, starts, ends = totals

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        sent: dict[int, list] = {kind: [] for kind in range(1, order + 1)}
        for kind, bucket, data in zip(*[right.column(c).to_pylist() for c in ("kind", "bucket", "data")]):
            sent[kind].append((bucket, data))
        counts_in = {k: np.concatenate([np.empty(0, np.int64), *[unpack(d)[0].astype(np.int64) for _, d in sorted(parts)]]) for k, parts in sent.items()}
        for row in left.to_pylist():
            ids, held, bounds, words, codes = _read(row)
            hashes = word_hashes(words)
            place, _ = _bucket_order(hashes[2:], 1)
            count = np.zeros(len(words) + 2, np.int64)
            count[2 + place] = counts_in[1]
            count[END] = ends
            grams = []
            for k, keys, there in gram_keys(hashes, codes, bounds, order):
                grams.append(np.zeros(len(codes), np.int64))
                grams[-1][there] = counts_in[k][np.unique(keys[there], return_inverse=True)[1]]
            machine = BackoffAutomaton(count, grams, codes, bounds, n, v, starts)
            known = np.add.reduceat(machine.known.astype(np.int64), bounds[:-1])
            base = np.add.reduceat(machine.read[0], bounds[:-1])
            out.append(pa.table({"_id": pa.array(ids, pa.int64()), "held_out": held, "n_tokens": np.diff(bounds), "n_known": known,
                                 "train_tokens": np.full(len(ids), n, np.int64), "base_score": base, "score": machine.traverse()}))
        schema = pa.schema([("_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                            ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
        return pa.concat_tables(out) if out else schema.empty_table()
    return run


SCORES = "_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def score(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text",
          block_chars: int = BLOCK_CHARS, bucket_words: int = BUCKET_WORDS, order: int = ORDER) -> DataFrame:
    """Score every text with the automaton of the texts that are not ``held_out``."""
    blocks = blocks_of(docs, held_out, id_col, text_col, block_chars)
    size = blocks.agg(F.sum("n_tokens").alias("tokens"), F.sum("n_texts").alias("texts")).first()
    buckets = max(1, -(-(size["tokens"] or 0) // bucket_words))
    columns = [c for c in blocks.columns if c in ("block", "ids", "held", "bounds", "words", "codes")]

    sent = blocks.select(columns).mapInArrow(_send_words(max(1, buckets // 4)), SENT)
    words = stored(sent.groupBy("bucket").applyInArrow(_count_words, COUNTED), "lm-words")
    seen = words.agg(F.sum("v").alias("v"), F.sum("n").alias("n")).first()
    ends = size["texts"] or 0
    n, v = (seen["n"] or 0) + ends, (seen["v"] or 0) + (ends > 0)  # the end is a token too

    sent = blocks.select(columns).mapInArrow(_send_grams(buckets, order), SENT)
    back = words.drop("v", "n").unionByName(sent.groupBy("kind", "bucket").applyInArrow(_count_grams, SENT))
    scored = (blocks.select(columns).groupBy("block").cogroup(back.groupBy("block"))
              .applyInArrow(_score((n, v, ends, ends), order), SCORES))
    return scored.withColumnRenamed("_id", id_col)
