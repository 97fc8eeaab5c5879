"""Merkle manifest of a dataset: leaves placed by bitmap ranks, levels reduced in keyed slot arrays.

Every row is a leaf. Each group of rows (a language) has a binary tree over its
leaves by ascending id, and the groups' roots, ordered by group, have one more
tree above them. The leaves are never sorted:

1. **Bitmaps.** The ids of a group become words of 64 bits, kept only where a
   bit is set. A word is an aggregate (``bit_or``), so partial bitmaps of one
   group merge on the way to the shuffle.
2. **Popcount directory.** Rows are counted by word and by block of 1,024 words;
   running totals over the blocks, and inside each block, give the rank at which a word begins.
3. **Rank queries.** The rank of a leaf is that of its word plus the set bits
   below its own. Hot words (one id on very many rows) are looked up by broadcast,
   of which there are at most a thousand.
4. **Slot arrays.** Leaves meet by (group, rank / 256) in an array of at most 256
   slots, which one row reduces by eight levels; its last digest is a slot of the
   next pass. So n leaves take log256(n) passes, each 256 times smaller than the one before.
5. **Proofs.** Down again, each block joins the path of its parent, and every
   leaf's siblings are read off its block's levels.

Nothing but the number of passes reaches the driver, and running totals with
one number a range partition and group (``rank.prefix_sums``).

Edge cases: a null field is hashed as ``-``; an empty text as ``0:``, a very long
one whole. A null id comes before all ids. Rows that share an id lie next to each
other in the order of their leaf digests (equal rows are interchangeable): words in which that
happens are ranked by a range partition over (id, leaf, row), however many rows share
one id. A null group comes before all groups and differs from an empty one. Ids are whole
numbers of up to 64 bits, of either sign. An empty table gives no rows. Other columns
are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabclean.llm.common import hot_limit, look_up, stored
from tabclean.operators.rank import dense_ranks, prefix_sums

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SLOTS = 256
WORDS_A_BLOCK = 1024
NO_ID_WORD = -(1 << 57) - 1  # before the word of every 64-bit id


def encoded(values: Sequence[Column]) -> Column:
    """``-`` for null, else byte count, colon and value, one after the other."""
    parts = []
    for value in values:
        text = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.concat(*parts)


def _digest(text: Column) -> Column:
    return F.sha2(text, 256)


def leaves(docs: DataFrame, id_col: str, group_col: str, fields: Sequence[str], altered: Mapping[str, Column]) -> DataFrame:
    """Id, group key, leaf, leaf of the altered row, row number; stored once."""
    old = [F.col(f"`{f}`") for f in fields]
    new = [altered.get(f, F.col(f"`{f}`")) for f in fields]
    group = F.col(f"`{group_col}`")
    return stored(docs.select(
        F.col(f"`{id_col}`").cast("bigint").alias("_id"),
        F.coalesce(F.concat(F.lit("+"), group), F.lit("")).alias("_group"),  # null before all, then bytewise
        _digest(encoded(old)).alias("_leaf"), _digest(encoded(new)).alias("_other"),
        F.monotonically_increasing_id().alias("_row")), "merkle-leaves")


def _bit_number() -> Column:
    return F.coalesce(F.col("_id").bitwiseAND(F.lit(63)), F.lit(0)).cast("int")


def _shifted(value: int, by: Column) -> Column:
    return F.call_function("shiftleft", F.lit(value).cast("bigint"), by)


def _word_number() -> Column:
    return F.coalesce(F.shiftright("_id", 6), F.lit(NO_ID_WORD)).cast("bigint")


def directory(rows: DataFrame) -> DataFrame:
    """One row a word: its bits, its rows, the rank at which it begins, its group's total."""
    words = stored(rows.groupBy("_group", _word_number().alias("_word")).agg(
        F.bit_or(_shifted(1, _bit_number())).alias("_bits"), F.count(F.lit(1)).alias("_rows")), "merkle-words")
    words = words.withColumn("_block", F.shiftright("_word", WORDS_A_BLOCK.bit_length() - 1))
    blocks = words.groupBy("_group", "_block").agg(F.sum("_rows").alias("_in"))
    blocks, _ = prefix_sums(blocks, "_group", "_block", "_in")
    totals = blocks.groupBy("_group").agg(F.max("_cum").alias("_total"))
    blocks = blocks.join(totals, "_group").select("_group", "_block", (F.col("_cum") - F.col("_in")).alias("_before"), "_total")
    inside = Window.partitionBy("_group", "_block").orderBy("_word").rowsBetween(Window.unboundedPreceding, -1)
    return (words.withColumn("_inside", F.coalesce(F.sum("_rows").over(inside), F.lit(0)))
            .join(blocks, ["_group", "_block"])
            .select("_group", "_word", "_bits", "_rows", (F.col("_before") + F.col("_inside")).alias("_first"), "_total"))


def ranked(rows: DataFrame) -> DataFrame:
    """Add ``_rank`` (from 0 in the group) and ``_total`` (rows of the group)."""
    words = directory(rows).withColumn("_shared", F.col("_rows") > F.bit_count("_bits"))
    words = stored(words, "merkle-directory")
    shared = words.filter("_shared")
    repeats = not shared.isEmpty()
    if repeats:  # where the words with repeated ids begin among the rows of all such words
        starts, _ = prefix_sums(shared.select(F.lit(0).alias("_all"), F.struct("_group", "_word").alias("_key"), "_rows"), "_all", "_key", "_rows")
        starts = starts.select(F.col("_key._group").alias("_group"), F.col("_key._word").alias("_word"), (F.col("_cum") - F.col("_rows")).alias("_start"))
        words = words.join(starts, ["_group", "_word"], "left")
    else:
        words = words.withColumn("_start", F.lit(None).cast("bigint"))
    table = words.withColumn("_key", F.struct("_group", "_word")).drop("_group", "_word")
    at = look_up(rows.withColumn("_key", F.struct("_group", _word_number().alias("_word"))), table, "_key", "_rows", hot_limit(rows.count()))
    below = F.bitwise_not(_shifted(-1, _bit_number()))
    shape = ["_id", "_group", "_leaf", "_other", "_total"]
    alone = at.filter(~F.col("_shared")).select(*shape, (F.col("_first") + F.bit_count(F.col("_bits").bitwiseAND(below))).alias("_rank"))
    if not repeats:
        return alone
    order = F.struct("_group", F.col("_id").isNotNull().alias("some"), "_id", "_leaf", "_row")
    together = at.filter("_shared").select(*shape, "_first", "_start", F.lit(0).alias("_all"), order.alias("_order"))
    together, _ = prefix_sums(together, "_all", "_order")
    return alone.unionByName(together.select(*shape, (F.col("_first") + F.col("_cum") - 1 - F.col("_start")).alias("_rank")))


# Levels of a block: all eight, but for a group's only block, which stops at one node.
_LEVELS_NEEDED = f"if(_total = 1, 0, if(_total <= {SLOTS}, length(bin(_total - 1)), {SLOTS.bit_length() - 1}))"
_ALL_LEVELS = """aggregate(if(_need = 0, cast(array() as array<int>), sequence(1, _need)), array(transform(_slots, s -> s._leaf)),
  (levels, i) -> concat(levels, array(transform(sequence(0, (size(element_at(levels, -1)) - 1) div 2),
    j -> sha2(concat(element_at(levels, -1)[2 * j], coalesce(get(element_at(levels, -1), 2 * j + 1), '')), 256)))))"""
# What stands left and right of a slot, level by level; both empty for the last node without a partner.
_SIBLINGS = """transform(if(_need = 0, cast(array() as array<int>), sequence(0, _need - 1)), l ->
  if(shiftright(s._slot, l) % 2 = 1,
     named_struct('l', _levels[l][shiftright(s._slot, l) - 1], 'r', ''),
     named_struct('l', '', 'r', coalesce(get(_levels[l], shiftright(s._slot, l) + 1), ''))))"""
_PATH = "array<struct<l:string,r:string>>"


def _blocks(nodes: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
    """Nodes meet in slot arrays by (group, rank / 256); each array is reduced in its row."""
    slot = F.struct((F.col("_rank") % SLOTS).cast("int").alias("_slot"), "_leaf", *carried)
    met = (nodes.groupBy("_group", F.expr(f"_rank div {SLOTS}").alias("_block"))
           .agg(F.array_sort(F.collect_list(slot)).alias("_slots"), F.max("_total").alias("_total")))
    return stored(met.withColumn("_need", F.expr(_LEVELS_NEEDED)).withColumn("_levels", F.expr(_ALL_LEVELS)), "merkle-blocks")


def reduce_tree(nodes: DataFrame, carried: Sequence[str] = ()) -> list[DataFrame]:
    """The passes of all groups' trees, leaves first; in the last one each group has one block."""
    passes = [_blocks(nodes, carried)]
    while (passes[-1].agg(F.max("_total")).first()[0] or 1) > SLOTS:
        passes.append(_blocks(passes[-1].select(
            "_group", F.col("_block").alias("_rank"), F.element_at("_levels", -1)[0].alias("_leaf"),
            F.expr(f"(_total + {SLOTS - 1}) div {SLOTS}").alias("_total"))))
    return passes


def tops(passes: list[DataFrame]) -> DataFrame:
    return passes[-1].select("_group", F.element_at("_levels", -1)[0].alias("_top"))


def paths_down(passes: list[DataFrame], above: DataFrame) -> DataFrame:
    """The first pass' blocks with the path from their node to the root (``above``: _group, _up and what else to carry)."""
    more = [c for c in above.columns if c != "_group"]
    up = above.withColumn("_block", F.lit(0).cast("bigint"))
    for below in reversed(passes[1:]):
        at = below.join(up, ["_group", "_block"])
        rest = [c for c in more if c != "_up"]
        up = at.select("_group", *rest, F.explode(F.expr(
            f"transform(_slots, s -> named_struct('_block', _block * {SLOTS} + s._slot, '_up', concat({_SIBLINGS}, _up)))")).alias("_at")
        ).select("_group", *rest, "_at._block", "_at._up")
    return passes[0].join(up, ["_group", "_block"])


def proofs(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", fields: Sequence[str] = FIELDS,
           altered: Mapping[str, Column] | None = None) -> DataFrame:
    """Each leaf with its group's root, the root, its path of siblings, and the root its altered row leads to.

    ``altered`` gives other values of some fields, as expressions over the
    row: a row is ``verified`` if those lead to the same root by the same siblings.
    """
    rows = leaves(docs, id_col, group_col, fields, altered or {})
    groups = reduce_tree(ranked(rows), ["_id", "_other"])
    subroots = stored(tops(groups), "merkle-subroots")
    order = dense_ranks(subroots.select(F.lit(0).alias("_all"), "_group"), "_all", "_group")
    top = reduce_tree(order.join(subroots, "_group").select(
        F.lit("").alias("_group"), F.col("rank").alias("_rank"), F.col("_top").alias("_leaf"),
        F.lit(subroots.count()).cast("bigint").alias("_total"), F.col("_group").alias("_name")), ["_name"])
    start = tops(top).select("_group", F.col("_top").alias("root"), F.expr(f"cast(array() as {_PATH})").alias("_up"))
    above = paths_down(top, start).select("root", F.explode(F.expr(
        f"transform(_slots, s -> named_struct('_group', s._name, 'subroot', s._leaf, '_up', concat({_SIBLINGS}, _up)))")).alias("_at")
    ).select("root", "_at.*")
    at = paths_down(groups, stored(above, "merkle-above"))
    each = at.select("subroot", "root", F.explode(F.expr(
        f"transform(_slots, s -> named_struct('id', s._id, 'leaf', s._leaf, 'other', s._other, 'path', concat({_SIBLINGS}, _up)))")).alias("_at"))
    folded = F.expr("aggregate(_at.path, _at.other, (node, s) -> sha2(concat(s.l, node, s.r), 256))")
    return (each.select(F.col("_at.id").alias(id_col), F.col("_at.leaf").alias("leaf"), "subroot", "root",
                        F.col("_at.path").alias("path"), folded.alias("folded_root"))
            .withColumn("verified", F.col("folded_root") == F.col("root")))


def digests(docs: DataFrame, altered: Mapping[str, Column]) -> DataFrame:
    """The contract's columns: the path as one digest of its siblings, left to right."""
    path = F.expr("array_join(transform(path, s -> concat(s.l, s.r)), '')")
    return proofs(docs, altered=altered).select(
        "doc_id", "leaf", "subroot", "root", _digest(path).alias("proof_sha256"), "folded_root", "verified")
