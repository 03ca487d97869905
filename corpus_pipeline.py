"""The corpus pipeline: quality, language, near duplicates, repeated passages, packing.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's
docs. All but the last return the columns of docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gridlore.llm import jaccard_partenum, language_cnn, packing, quality_pu, suffix_dedup
from gridlore.llm.common import dropped, small_batches, staged


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier predicts to be good.

    Null and empty texts are judged by their statistics as others are; all stay if no label can be learnt from.
    Repeated rows stand or fall together; an empty table stays empty; further columns are passed on.
    """
    small_batches(spark)
    return quality_pu.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the byte network is sure of, and whose own ``lang``, if any, it does not contradict.

    Null and empty texts, and those without a letter, go. Repeated rows stand or fall together; an empty table stays
    empty; further columns are passed on.
    """
    small_batches(spark)
    return language_cnn.keep_known(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of least id.

    Null and empty texts are nobody's duplicates; rows with a null id stay, and rows that repeat an id stand or fall
    together. An empty table stays empty; further columns, whatever their names, are passed on.
    """
    small_batches(spark)
    return jaccard_partenum.keep_first(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that stand at an earlier place; those of which nothing is left go.

    Null and short texts, and rows with a null id, stay as they are; rows that repeat an id lose the same spans. An
    empty table stays empty; further columns, whatever their names, are passed on; ``n_chars`` follows the text.
    """
    small_batches(spark)
    return suffix_dedup.without_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens.

    Null and empty texts are one end token; repeated rows are packed repeatedly; an empty table gives no piece.
    """
    small_batches(spark)
    special = packing.special_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, special=special)


STAGES = [
    ("quality", good_quality),
    ("language", known_language),
    ("near_duplicates", one_of_each),
    ("repeats", without_repeats),
    ("packing", packed),
]

#: Stages learn models and tokenise, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
        if last is not None:
            dropped(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
