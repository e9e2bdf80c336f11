"""From raw documents to tokens, in five stages, each of them one operator of orrery.llm.

Every stage works on all that the one before it kept, and is written as Parquet before the next
reads it, so that a lost executor costs a stage's tasks and never an earlier stage.

Texts without a letter are rejected by the first stage, since no language can be told; a document
is never rejected for the language that it has. Where nothing could be learned about languages, the
first stage rejects nothing.

Defined results: a null or empty text has no letter; it counts as empty in every stage. A null doc_id and
a null source are values like others; repeated rows are one document after the second stage. Of equal texts, and
of near-duplicates, the stages keep the rows that their operators name. An empty table stays empty through all
stages. Columns that documents don't have by contract, such as `score`, `kept` or `size`, keep
their values up to the last stage, whatever the operators call their own.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import bpe, exact_dedup, language, mixing, near_dedup
from orrery.llm.common import prepare, remove, shared_dir, table

#: A stage learns, compares fingerprints and merges ids: no SQL for it.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told."""
    prepare(spark)
    learned = language.samples(docs, ~language.held_out(F.col("doc_id")))
    if not learned:
        return docs
    # A table's own columns of the prediction's names step aside for it.
    own = {c: f"__own_{c}" for c in ("lang_pred", "score") if c in docs.columns}
    known = language.identify(docs.withColumnsRenamed(own), learned)
    return known.filter(F.col("lang_pred") != language.UNDETERMINED).select(*(F.col(own.get(c, c)).alias(c) for c in docs.columns))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, white space aside."""
    return exact_dedup.drop_duplicates(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return near_dedup.drop_near_duplicates(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the order of the curriculum, as often as the mix takes them."""
    return mixing.mix(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Numbers of tokens, and digests of the ids and of the bytes that they decode to."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", language_id),
    ("exact_duplicates", exact_duplicates),
    ("near_duplicates", near_duplicates),
    ("source_mix", source_mix),
    ("byte_bpe", byte_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's files go as soon as the next one's stand; the last one's are the result's."""
    docs, folder, before = table(spark, sf_dir, "documents"), shared_dir(spark), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove(spark, before)
        before = f"{folder}/{name}"
    return docs
