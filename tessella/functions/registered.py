"""SQL names for the engine's functions."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from tessella.functions.scores import edits, fuzzy_match
from tessella.functions.text import STRIDE, WINDOW


class ChunkText:
    """chunk_text(text): its windows as (chunk_index, content)."""

    def eval(self, text: str):
        raw = (text or "").encode()
        for k in range(1 + max(0, -(-(len(raw) - WINDOW) // STRIDE)) if raw else 0):
            yield k, raw[k * STRIDE : k * STRIDE + WINDOW]


def register(spark: SparkSession) -> None:
    """fuzzy_match(pattern, name), edits(a, b) and the table function chunk_text(text)."""
    spark.udf.register("fuzzy_match", fuzzy_match)
    spark.udf.register("edits", edits)
    spark.udtf.register("chunk_text", udtf(ChunkText, returnType="chunk_index int, content binary"))
