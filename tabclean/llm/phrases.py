"""Phrase collocations by prefix-free parsing.

1. **Parse.** A text is a sequence of words and of separators (``. , ; : ! ?`` and line
   ends). Where the hash of three tokens in a row is a multiple of ``period``, these
   three are a **trigger**: a chunk ends with them and the next one begins with them. The content
   alone decides, so copied passages are cut alike wherever they stand, and overlapping
   chunks meet in a **dictionary**: each distinct chunk of a language with its number of occurrences.
2. **Count.** Phrases are counted inside the distinct chunks, weighted by the
   chunk's occurrences. A phrase belongs to the chunk in which it begins before the closing
   trigger; the three tokens of overlap are there so that phrases of up to four words
   end in their chunk. So each occurrence is counted once.
   First words and pairs, then phrases of three and four words all of whose pairs are frequent
   (no other can be). Frequent pairs are known by a Bloom filter of at most ``MOST_FILTER_WORDS`` words
   of 64 bits; what it lets through in error is counted and then found to be rare, so
   the filter's size costs time and never a wrong result. Counts meet by phrase after map-side sums.
3. **Score.** Phrases are joined to the counts of their parts (frequent parts are looked up by
   broadcast, of which there are at most a thousand), the lowest-scoring cut is taken, and phrases inside a longer
   one nearly as frequent are dropped.
4. **Rank.** Ranks by score come from a range partition (``rank.prefix_sums``), so no language is one task.

Scores are exact: decimals of 38 digits. Phrases are strings throughout, so no hash decides a count.

Edge cases: null and empty texts have no words; a null language counts as ``und``, together with the
language of that name; very long texts are parsed whole (a run without a trigger is one long chunk); repeated rows count
as often as they stand; ties in score and count go by the phrase's bytes; an empty table gives no rows. Other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabclean.llm.common import hot_limit, look_up, ragged_take, slices, stored, text_of
from tabclean.operators.rank import prefix_sums

# Fixed: the characters that end a piece, and those between words (as classes of Arrow's regular expressions).
PIECE_END, BETWEEN = r".,;:!?\x0A-\x0D", r"\x20\x09"
SEPARATOR = "\n"

OVERLAP = 3
LONGEST = OVERLAP + 1
PERIOD = 32
BATCH_TOKENS = 1_500_000
MOST_FILTER_WORDS = 1 << 20
MIX = np.uint64(0x9E3779B97F4A7C15)

CHUNKS = "_lang string, _chunk string, _last boolean, _words bigint, _n bigint"


def _hashes(words: list) -> np.ndarray:
    return pd.util.hash_array(np.array(words, object), categorize=False)


def _mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(31))) * MIX
    return h ^ (h >> np.uint64(29))


def _tokens(texts: pa.Array):
    """Codes of all words and separators, the distinct ones, bounds by text."""
    marked = pc.replace_substring_regex(pc.ascii_lower(texts), f"[{BETWEEN}]*[{PIECE_END}][{PIECE_END}{BETWEEN}]*", f" {SEPARATOR} ")
    parts = pc.split_pattern_regex(marked, f"[{BETWEEN}]+")
    bounds = parts.offsets.to_numpy().astype(np.int64)
    flat = parts.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
    codes, words, bounds = flat.indices.to_numpy(zero_copy_only=False), flat.dictionary, bounds - bounds[0]
    real = np.append(pc.not_equal(words, "").to_numpy(zero_copy_only=False), True)[codes]
    kept = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(real, out=kept[1:])
    return codes[real], words, kept[bounds]


def _parse(batch: pa.RecordBatch, period: int) -> pa.RecordBatch | None:
    """The distinct chunks of a batch (language, text) with their occurrences in it."""
    codes, words, bounds = _tokens(batch.column(1))
    n = len(codes)
    if not n:
        return None
    names = words.to_pylist()
    separator = np.array([w == SEPARATOR for w in names])
    h = _hashes(names)[codes]
    window = np.zeros(n, np.uint64)
    window[:-2] = _mixed(_mixed(_mixed(h[:-2]) + h[1:-1]) + h[2:])
    text = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
    end = bounds[1:][text]
    begins = ((window >> np.uint64(20)) % np.uint64(period) == 0) & (np.arange(n) + OVERLAP <= end)
    first = np.unique(bounds[:-1][np.diff(bounds) > 0])
    begins[first] = True
    start = np.flatnonzero(begins)
    following = np.append(start[1:], n)
    last = np.isin(following, first) | (following == n)
    stop = np.where(last, following, following + OVERLAP)
    seen_words = np.zeros(n + 1, np.int64)
    np.cumsum(~separator[codes], out=seen_words[1:])
    flat, at = ragged_take(codes, start, stop - start, np.arange(len(start)))
    chunks = pc.binary_join(pa.ListArray.from_arrays(pa.array(at, pa.int32()), words.take(pa.array(flat))), " ").dictionary_encode()
    langs = batch.column(0).dictionary_encode()
    lang = langs.indices.to_numpy(zero_copy_only=False)[text[start]]
    key = (chunks.indices.to_numpy(zero_copy_only=False).astype(np.int64) * 2 + last) * len(langs.dictionary) + lang
    _, one, times = np.unique(key, return_index=True, return_counts=True)
    return pa.RecordBatch.from_arrays([
        langs.dictionary.take(pa.array(lang[one])), chunks.dictionary.take(chunks.indices.take(pa.array(one))), pa.array(last[one]),
        pa.array((seen_words[following] - seen_words[start])[one]), pa.array(times.astype(np.int64))], ["_lang", "_chunk", "_last", "_words", "_n"])


def dictionary(docs: DataFrame, text_col: str = "text", group_col: str = "lang", period: int = PERIOD) -> DataFrame:
    """The distinct chunks by language: text, whether it ends its document, its own words, occurrences; stored."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            if (out := _parse(batch, period)) is not None:
                yield out

    read = docs.select(F.coalesce(F.col(f"`{group_col}`"), F.lit("und")).alias("_lang"), text_of(f"`{text_col}`").alias("_text"))
    chunks = read.mapInArrow(run, CHUNKS).groupBy("_lang", "_chunk", "_last", "_words").agg(F.sum("_n").alias("_n"))
    return stored(chunks, "phrase-chunks")


def _gathered(batches: Iterator[pa.RecordBatch], tokens: int = BATCH_TOKENS) -> Iterator[pa.Table]:
    """Batches put together until they hold about ``tokens`` words: larger ones have more to sum."""
    held, size = [], 0
    for batch in slices(batches, 2000):
        held.append(batch)
        size += int(pc.sum(batch.column("_words")).as_py() or 0) + OVERLAP * batch.num_rows
        if size >= tokens:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _pair_slots(h1: np.ndarray, h2: np.ndarray, lang: np.ndarray, words: int):
    """A pair's word in the filter, and its two bits there."""
    h = _mixed(_mixed(_mixed(lang) + h1) + h2)
    one = np.uint64(1)
    return (h % np.uint64(words)).astype(np.int64), (one << ((h >> np.uint64(40)) & np.uint64(63))) | (one << ((h >> np.uint64(50)) & np.uint64(63)))


def _summed(key: np.ndarray, weight: np.ndarray, *values: np.ndarray):
    """Weights by distinct key, and each key's first values."""
    _, one, at = np.unique(key, return_index=True, return_inverse=True)
    total = np.zeros(len(one), np.int64)
    np.add.at(total, at, weight)
    return total, at, [v[one] for v in values]


def _column(table: pa.Table, name: str) -> pa.Array:
    chunked = table.column(name)
    return chunked.chunk(0) if chunked.num_chunks == 1 else pa.concat_arrays(chunked.chunks)


def _count(table: pa.Table, sizes: tuple[int, ...], frequent: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Phrases of ``sizes`` words in a part of the dictionary, with their weighted counts."""
    parts = pc.split_pattern(_column(table, "_chunk"), " ")
    bounds = parts.offsets.to_numpy().astype(np.int64)
    coded = parts.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
    bounds -= bounds[0]
    codes, words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
    names = words.to_pylist()
    langs = _column(table, "_lang").dictionary_encode()
    length = np.diff(bounds)
    lang = np.repeat(langs.indices.to_numpy(zero_copy_only=False).astype(np.int64), length)
    weight = np.repeat(_column(table, "_n").to_numpy(), length)
    stop = np.repeat(bounds[1:], length)
    own = np.arange(len(codes)) < np.repeat(np.where(_column(table, "_last").to_numpy(zero_copy_only=False), bounds[1:], bounds[1:] - OVERLAP), length)
    word = ~np.array([w == SEPARATOR for w in names], bool)[codes]
    n_words = len(names)

    def batch(lang_at, sums, *code):
        texts = [words.take(pa.array(c)) for c in code]
        joined = texts[0] if len(texts) == 1 else pc.binary_join_element_wise(*texts, " ")
        return pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(lang_at)), joined, pa.array(np.full(len(sums), len(code), np.int32)), pa.array(sums)],
                                          ["_lang", "_phrase", "_size", "_n"])

    if 1 in sizes:
        at = np.flatnonzero(own & word)
        sums, _, (l, c) = _summed(lang[at] * n_words + codes[at], weight[at], lang[at], codes[at])
        yield batch(l, sums, c)
    # Pairs are numbered at every place, also in the overlap, where longer phrases go on.
    pair = np.zeros(len(codes), bool)
    pair[:-1] = word[:-1] & word[1:] & (np.arange(len(codes) - 1) + 1 < stop[:-1])
    at = np.flatnonzero(pair)
    if not len(at):
        return
    key = (lang[at] * n_words + codes[at]) * n_words + codes[at + 1]
    sums, number, (l, a, b) = _summed(key, np.where(own[at], weight[at], 0), lang[at], codes[at], codes[at + 1])
    if 2 in sizes:
        some = sums > 0
        yield batch(l[some], sums[some], a[some], b[some])
    if frequent is None:
        return
    h = _hashes(names)
    slot, bits = _pair_slots(h[a], h[b], _hashes(langs.dictionary.to_pylist())[l], len(frequent))
    good = np.zeros(len(codes) + LONGEST, bool)
    good[at] = ((frequent[slot] & bits) == bits)[number]
    phrase = np.zeros(len(codes) + LONGEST, np.int64)  # the number of the phrase that begins at a place
    phrase[at] = number
    runs = good.copy()
    for size in range(3, LONGEST + 1):
        runs[:-(size - 2)] &= good[size - 2:]
        at = np.flatnonzero(runs[:len(codes)])
        if not len(at):
            return
        sums, number, got = _summed(phrase[at] * n_words + codes[at + size - 1], np.where(own[at], weight[at], 0), lang[at], *[codes[at + k] for k in range(size)])
        phrase[at] = number
        if size in sizes:
            some = sums > 0
            yield batch(got[0][some], sums[some], *[c[some] for c in got[1:]])


def count(chunks: DataFrame, sizes: tuple[int, ...], least: int, frequent: np.ndarray | None = None) -> DataFrame:
    """Phrases of ``sizes`` words that occur ``least`` times or more in a language; stored."""
    shared = None if frequent is None else chunks.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _gathered(batches):
            yield from _count(table, sizes, None if shared is None else shared.value)

    found = chunks.mapInArrow(run, "_lang string, _phrase string, _size int, _n bigint")
    return stored(found.groupBy("_lang", "_phrase", "_size").agg(F.sum("_n").alias("_n")).filter(F.col("_n") >= least), "phrase-counts")


def pair_filter(pairs: DataFrame, most_words: int = MOST_FILTER_WORDS) -> np.ndarray:
    """The Bloom filter of the frequent pairs: sixteen bits a pair, up to ``most_words`` words of 64."""
    n = pairs.count()
    words = min(most_words, 1 << max(6, (n // 4).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [p.split(" ") for p in batch.column(1).to_pylist()]
            if both:
                h1, h2 = (_hashes([x[k] for x in both]) for k in (0, 1))
                slot, bits = _pair_slots(h1, h2, _hashes(batch.column(0).to_pylist()), words)
                yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(bits.view(np.int64))], ["_word", "_bits"])

    bits = pairs.select("_lang", "_phrase").mapInArrow(run, "_word bigint, _bits bigint").groupBy("_word").agg(F.bit_or("_bits").alias("_bits")).toArrow()
    out = np.zeros(words, np.uint64)
    out[bits.column("_word").to_numpy()] = bits.column("_bits").to_numpy().view(np.uint64)
    return out


def scored(counts: DataFrame) -> DataFrame:
    """Every phrase of two words or more with its lowest-scoring cut: _a, _l, _r, _score."""
    key = F.struct("_lang", "_phrase")
    phrases = counts.filter("_size > 1")
    words = F.split("_phrase", " ", -1)
    cuts = phrases.select("_lang", "_phrase", F.col("_n").alias("_a"), words.alias("_words"), F.explode(F.sequence(F.lit(1), F.col("_size") - 1)).alias("_k"))
    part = lambda a, b: F.struct("_lang", F.array_join(F.slice("_words", a, b), " ").alias("_phrase"))
    cuts = cuts.withColumn("_left", part(F.lit(1), F.col("_k"))).withColumn("_right", part(F.col("_k") + 1, F.size("_words") - F.col("_k")))
    cuts = stored(cuts.drop("_words"), "phrase-cuts")
    n = cuts.count()
    for side, value in (("_left", "_l"), ("_right", "_r")):
        uses = cuts.groupBy(side).agg(F.count(F.lit(1)).alias("_uses"))
        table = stored(uses.join(counts.select(key.alias(side), F.col("_n").alias(value)), side), "phrase-parts")
        cuts = look_up(cuts, table, side, "_uses", hot_limit(n)).drop("_uses")
    score = F.expr("cast(cast(_a as decimal(28,0)) * 2000000 div (cast(_l as decimal(28,0)) + _r) as bigint)")
    least = F.min(F.struct(score.alias("_score"), "_k", "_l", "_r", "_a")).alias("_best")
    return cuts.groupBy("_lang", "_phrase").agg(least).select("_lang", "_phrase", "_best.*").drop("_k")


def inside_longer(counts: DataFrame) -> DataFrame:
    """The highest count of a longer phrase around each phrase that lies in one."""
    words = F.split("_phrase", " ", -1)
    spans = F.expr("filter(flatten(transform(sequence(1, _size - 1), at -> transform(sequence(2, _size - 1), n -> if(at + n <= _size + 1, array_join(slice(_words, at, n), ' '), null)))), p -> p is not null)")
    return (counts.filter("_size > 2").withColumn("_words", words).select("_lang", "_n", F.explode(spans).alias("_phrase"))
            .groupBy("_lang", "_phrase").agg(F.max("_n").alias("_longer")))


def collocations(docs: DataFrame, text_col: str = "text", group_col: str = "lang", least: int = 30, top: int = 2000, share: int = 80,
                 period: int = PERIOD) -> DataFrame:
    """The ``top`` phrases of two to four words of each language by score."""
    chunks = dictionary(docs, text_col, group_col, period)
    totals = chunks.groupBy("_lang").agg(F.sum(F.col("_n") * F.col("_words")).alias("n"))
    short = count(chunks, (1, 2), least)
    long = count(chunks, tuple(range(3, LONGEST + 1)), least, pair_filter(short.filter("_size = 2")))
    counts = short.unionByName(long)
    whole = scored(counts).join(inside_longer(counts), ["_lang", "_phrase"], "left")
    left = whole.filter(F.expr(f"_longer is null or 100 * cast(_longer as decimal(28,0)) < {share} * cast(_a as decimal(28,0))"))
    order = F.struct((-F.col("_score")).alias("s"), (-F.col("_a")).alias("a"), "_phrase")
    ranks, _ = prefix_sums(left.withColumn("_order", order), "_lang", "_order")
    return (ranks.filter(F.col("_cum") <= top).join(totals, "_lang")
            .select(F.col("_lang").alias("lang"), F.col("_cum").alias("rank"), F.col("_phrase").alias("phrase"),
                    F.col("_a").alias("a"), F.col("_l").alias("l"), F.col("_r").alias("r"), "n", F.col("_score").alias("score")))
