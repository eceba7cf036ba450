"""From raw documents to packed training sequences, in five stages.

Each stage takes the rows that its predecessor kept. All but the last return the columns of documents, and further columns, whatever
their names, ride along. An empty table stays empty, and very long texts are handled whole, in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import mixing, near_dup, packing, quality, secret_scan
from tessella.llm.common import checkpoint, table

#: Near duplicates: words of a shingle, and the least similarity in percent.
WIDTH, PERCENT = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the adaptive quality rules keep.

    Null and empty texts go, as they fail the base rules; null languages and sources are groups; equal rows share their verdict.
    """
    return quality.filtered(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest doc_id.

    Five words and 80 %, as near-duplicate stages take without another contract. Repeated rows are duplicates; a null doc_id stays only where
    all of its group are null; texts without words all stay.
    """
    return near_dup.deduplicated(docs, WIDTH, PERCENT)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced; null texts stay null, n_chars stays as it was."""
    return secret_scan.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix to target weights holds of the documents, a row for each pass over one.

    Null sources are one source, the last; texts without words are never taken; n_chars follows the text.
    """
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents' ids, with their sequences and places; a null text is empty, repeated rows are documents of their own."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mix", mix), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = checkpoint(docs)
    return docs


#: Fences, similarity components and best fit have no plain SQL; tests hold the stages against brute force.
ORACLE_SQL = None
