"""A corpus pipeline over ``documents``: five stages, each by one operator of ``tabclean.llm``.

A stage takes (spark, docs, sf_dir), with docs the rows its predecessor kept,
and returns a DataFrame; ``run`` writes it as Parquet to the shared folder and
reads it back for the next stage. All but the last return the columns of
``documents``. Whatever rows a stage gets, it works on all of them:

1. ``toxicity`` drops documents that score one half or more. The chain learns
   from the labelled ones among docs.
2. ``language`` drops documents without a letter and those whose language is
   in doubt (score below one half). The model learns from docs that have a language.
3. ``exact_dedup`` keeps the copy with the smallest id of equal texts.
4. ``near_dedup`` keeps the document with the smallest id of each SimHash group.
5. ``packing`` packs what is left into sequences of 2,048 tokens; it returns pieces.

Null texts count as empty; they have no letter, so stage 2 drops them. Empty
tables pass through. Other columns of docs are carried along, whatever their
names. Of rows repeated with one id, stage 3 keeps one if their texts are
equal; stage 4 keeps each row that has its group's smallest id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabclean.llm import common, exact_dedup, langid, packing, simhash, toxicity
from tabclean.session import apply_required_conf, ensure_checkpoint_dir


def _ready(spark: SparkSession) -> None:
    apply_required_conf(spark)
    ensure_checkpoint_dir(spark)
    common.prepare(spark)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.fit(docs, labels, F.lit(True)))


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    return langid.keep_identified(docs, langid.fit(docs, F.lit(True)))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    return simhash.drop_near_copies(docs, shingle=4, distance=4)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _ready(spark)
    return packing.pack(docs, common.vocabulary("word_bpe_49k.json"), length=2048, end_id=1, special=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("language", keep_languages),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("packing", pack),
]

# SQL can't express the chain of stage 1, the models of stage 2 or the tokenizer of stage 5.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; the rows of the last one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
