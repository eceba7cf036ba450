"""The engine's relations over the benchmark tables: projections without state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.text import path_parts
from tessella.schema import RETRY

#: DuckDB views of the same relations.
SQL = """
files AS (
  SELECT file_id, path, CASE WHEN extension = '.pdf' THEN 'document' ELSE 'text' END AS file_type, extension, size_bytes, modified_at, content_hash,
    'doc_' || file_id || extension AS basename, '/corpus/' || source || '/' || lang AS parent, 'doc_' || file_id AS stem, text
  FROM (SELECT *, '/corpus/' || source || '/' || lang || '/doc_' || file_id || extension AS path FROM (
    SELECT doc_id AS file_id, source, lang, text, ['.md', '.py', '.pdf', '.txt'][doc_id % 4 + 1] AS extension, n_chars AS size_bytes,
      TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id AS INTEGER)) AS modified_at, CASE WHEN doc_id % 17 = 0 THEN '' ELSE sha256(text) END AS content_hash
    FROM documents))
),
chunks AS (
  SELECT vec_id % 200 AS file_id, 'f' || (vec_id % 200) || '-c' || (vec_id // 200) AS vector_id, vec_id // 200 AS chunk_index, embedding,
    CASE WHEN label = 9 THEN 'model-b' ELSE 'model-a' END AS embedding_model, 64 AS embedding_dims
  FROM embeddings
),
query_vector AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 7),
failures AS (
  SELECT event_id AS seq, '/corpus/user_' || user_id AS path, ts AS last_failed_at,
    ['ERR_EMBED_COUNT_MISMATCH', 'ERR_EMBED_FAILED', 'ERR_EXTRACTION_FAILED', 'ERR_FILE_TOO_LARGE', 'ERR_FILE_UNREADABLE', 'ERR_HNSW_ADD', 'ERR_RATE_LIMITED', 'ERR_STORE_WRITE', 'ERR_UNSUPPORTED_FORMAT'][event_id % 9 + 1] AS code
  FROM events
)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str, text: bool = False) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    ext = F.element_at(F.array(*map(F.lit, (".md", ".py", ".pdf", ".txt"))), (F.col("doc_id") % 4 + 1).cast("int"))
    x = d.select(
        F.col("doc_id").alias("file_id"),
        F.concat(F.lit("/corpus/"), "source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), ext).alias("path"),
        F.when(ext == ".pdf", "document").otherwise("text").alias("file_type"),
        ext.alias("extension"),
        F.col("n_chars").alias("size_bytes"),
        F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00")) + F.col("doc_id") * 3600).alias("modified_at"),
        F.when(F.col("doc_id") % 17 == 0, F.lit("")).otherwise(F.sha2(F.col("text").cast("binary"), 256)).alias("content_hash"),
        *([F.col("text")] if text else []),
    )
    parts = path_parts(F.col("path"))
    return x.withColumns({n: parts[n] for n in ("basename", "parent", "stem")})


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    file_id, index = F.col("vec_id") % 200, F.expr("vec_id div 200")
    return e.select(
        file_id.alias("file_id"),
        F.concat(F.lit("f"), file_id.cast("string"), F.lit("-c"), index.cast("string")).alias("vector_id"),
        index.cast("int").alias("chunk_index"),
        (index * 25.0).alias("start_time"),
        (index * 25.0 + 30.0).alias("end_time"),
        "embedding",
        F.when(F.col("label") == 9, "model-b").otherwise("model-a").alias("embedding_model"),
        F.lit(64).alias("embedding_dims"),
    )


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 7) -> list[float]:
    return table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == vec_id).select("embedding").first()[0]


def watch_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("path"), F.col("event_type").alias("type"), F.col("ts").cast("timestamp").alias("ts"))


def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = F.array(*map(F.lit, sorted(RETRY)))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit("/corpus/user_"), F.col("user_id").cast("string")).alias("path"),
        F.col("ts").cast("timestamp").alias("last_failed_at"),
        F.element_at(codes, (F.col("event_id") % 9 + 1).cast("int")).alias("code"),
    )
