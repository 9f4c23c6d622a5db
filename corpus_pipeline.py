"""A corpus pipeline of five stages: quality rules, line dedup, near-dedup, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.

Defined cases: null texts count as empty (the quality rules reject them); a null source is a source of its own; a null
doc_id sorts after all others; repeated rows are copies, of which near-dedup leaves one; an empty table gives an empty
result; extra columns are kept up to the mix.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, common, line_dedup, mixing, repetition, simhash


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return repetition.repetition(docs).filter("kept").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated multi-line chunks and blocks go; a document of which nothing is left goes with them."""
    done = line_dedup.dedup_blocks(docs)
    left = done.filter((F.col("n_removed_lines") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return left.withColumn("n_chars", F.when(F.col("n_removed_lines") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard similarity of 0.8 or more, verified) the row with the smallest id stays."""
    return simhash.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row appears as often as the mix takes it."""
    taken = mixing.mixed_rows(docs, docs.columns).filter("times > 0")
    return taken.select("d", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("d.*")


#: Words in a generation of the tokenizer's cache: the executors' heaps are full behind the other stages, so workers hold less than in op1.
CACHED_WORDS = 150_000


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, checked by decoding."""
    return bpe.op1(docs, public_tokenizers.path("word_bpe_49k.json"), CACHED_WORDS)


STAGES = [("quality rules", quality), ("line dedup", lines), ("near-dedup", near_copies), ("mixing", mixed), ("tokens", tokens)]

#: BPE, suffix arrays and weighted sampling have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.stored(docs, f"stage-{k}")
    return docs
