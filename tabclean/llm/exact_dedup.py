"""Exact dedup by two-pass Bloom filtering, in DataFrame functions only.

Pass one sets, for every text hash, a few bits of a blocked Bloom filter and
keeps the bits that more than one row has set. Pass two tests every row
against those bits: a row with a bit that only it has set is surely alone
and passes straight through. Only the other rows are shuffled, by the
SHA-256 of their text, so false positives of the filter cost time and never
a wrong answer.

The filter has at most ``max_words`` words of 64 bits, whatever the input,
so broadcasting it has a proven bound (16 bytes a word). Past about eight
rows a word it lets more unique rows into the shuffle, of which each carries
its id and 32 bytes.

Edge cases: a null text counts as empty, so all empty texts are one group
together with null; an empty table gives no rows. Rows repeated with the same
id are copies like any other: one of them is kept. A null id sorts after every
id. Other columns pass through ``drop_copies`` untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabclean.llm.common import SPACE, hot_limit, look_up, stored

MAX_WORDS = 1 << 20
BITS_A_ROW = 16


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; null becomes empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def filter_words(rows: int, max_words: int = MAX_WORDS) -> int:
    """Words of the filter: 16 bits a row, a power of two, at most ``max_words``."""
    want = max(1, rows * BITS_A_ROW // 64)
    return min(max_words, 1 << max(10, (want - 1).bit_length()))


def _slots(digest: Column, words: int) -> tuple[Column, Column, Column]:
    """The word of a digest and two bit numbers in it."""
    h = F.xxhash64(digest)
    return (F.pmod(h, F.lit(words)), F.shiftrightunsigned(h, 52).bitwiseAND(F.lit(63)),
            F.shiftrightunsigned(h, 58).bitwiseAND(F.lit(63)))


def _bit(at: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), at.cast("int"))


def repeated_bits(keys: DataFrame, words: int, digest: str = "_digest") -> DataFrame:
    """Pass one: words of the filter with the bits that more than one row has set."""
    word, a, b = _slots(F.col(digest), words)
    bits = keys.select(word.alias("_word"), F.explode(F.array_distinct(F.array(a, b))).alias("_at"))
    shared = bits.groupBy("_word", "_at").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return shared.groupBy("_word").agg(F.bit_or(_bit(F.col("_at"))).alias("_bits"))


def flag_repeats(rows: DataFrame, bits: DataFrame, words: int, digest: str = "_digest") -> DataFrame:
    """Pass two: add ``_maybe``, false where the text is surely alone."""
    word, a, b = _slots(F.col(digest), words)
    mask = _bit(a).bitwiseOR(_bit(b))
    return (rows.withColumn("_word", word).withColumn("_mask", mask)
            .join(F.broadcast(bits), "_word", "left")
            .withColumn("_maybe", F.coalesce(F.col("_bits").bitwiseAND(F.col("_mask")) == F.col("_mask"), F.lit(False)))
            .drop("_word", "_mask", "_bits"))


def text_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, row number and SHA-256 (binary) of the normalised text, stored once."""
    return stored(docs.select(
        F.col(id_col).alias("_id"), F.monotonically_increasing_id().alias("_row"),
        F.unhex(F.sha2(normalised(F.col(text_col)).cast("binary"), 256)).alias("_digest")), "dedup-keys")


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_words: int = MAX_WORDS) -> DataFrame:
    """One row a document: id, keep_id, group_size, kept, text_sha256."""
    keys = text_keys(docs, id_col, text_col)
    n = keys.count()
    words = filter_words(n, max_words)
    flagged = flag_repeats(keys, repeated_bits(keys, words), words)
    alone = flagged.filter(~F.col("_maybe")).select(
        "_id", F.col("_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"),
        F.lit(True).alias("kept"), "_digest")
    maybe = flagged.filter("_maybe").select("_id", "_row", "_digest")
    groups = maybe.groupBy("_digest").agg(
        F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_row")).alias("first"),
        F.count(F.lit(1)).alias("group_size"))
    met = look_up(maybe, groups, "_digest", "group_size", hot_limit(n))
    met = met.select("_id", F.col("first._id").alias("keep_id"), "group_size",
                     (F.col("_row") == F.col("first._row")).alias("kept"), "_digest")
    return alone.unionByName(met).select(
        F.col("_id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("_digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_words: int = MAX_WORDS) -> DataFrame:
    """The documents without their exact copies, all columns kept.

    Rows that are surely alone never move. The others are reduced to the
    row with the smallest id before and after one shuffle, so a group of
    copies of any size sends one row a task.
    """
    columns = docs.columns
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_doc"))
    digest = F.unhex(F.sha2(normalised(F.col(f"_doc.`{text_col}`")).cast("binary"), 256))
    keys = text_keys(docs, id_col, text_col)
    words = filter_words(keys.count(), max_words)
    flagged = flag_repeats(whole.withColumn("_digest", digest), repeated_bits(keys, words), words)
    order = F.struct(F.col(f"_doc.`{id_col}`").isNull(), F.col(f"_doc.`{id_col}`"))
    kept = (flagged.filter("_maybe").groupBy("_digest").agg(F.min_by("_doc", order).alias("_doc")))
    return flagged.filter(~F.col("_maybe")).select("_doc").unionByName(kept.select("_doc")).select("_doc.*")
