"""Training-data pipeline over the documents table: quality, repeated lines,
near-duplicates, mixing, token ids. Each stage reads what the one before it
kept; all but the last return the columns of documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tamperscope.llm import bpe, line_dedup, mixing, near_texts, quality_mil
from tamperscope.llm.common import read
from tamperscope.session import new_path


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. A null or empty text
    is scored as one without words; a null doc_id is scored, never learned
    from; repeated rows are judged alike; without labels of both classes all
    documents have one score. Columns stay as they were."""
    return quality_mil.keep_good(docs, read(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand in an earlier document (by doc_id, null last) or earlier
    in the same go, and documents that are emptied by it. Null and empty texts
    stay, blank lines too; of repeated rows each is cut alike."""
    return line_dedup.drop_repeated_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the first by doc_id
    (null last): five-word shingles, similarity from 0.8. SimHash fingerprints
    link near copies, each link verified; pairs they don't reach are found by
    shared shingles. Texts without words are one group, and so are repeated rows."""
    return near_texts.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each text, in rows of at most the whole text and
    at most three of them; documents without words, null texts among them, are
    not taken. A null source is a source."""
    return mixing.mixed_documents(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes of each text; a null
    text is an empty one, a null doc_id stays null, equal rows give equal rows."""
    return bpe.round_trip_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_repeated_lines),
    ("simhash near-dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("byte-level bpe", encode_tokens),
]

#: SQL can't express the classifier or the merges; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each written to the shared folder and read again, so
    that a lost executor re-reads a stage. Texts are read whole; an empty
    ``documents`` gives no rows; columns beyond the contract's pass through
    all stages but the last."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = new_path(spark, "pipeline")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
