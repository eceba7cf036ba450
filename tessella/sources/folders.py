"""Folders as a relation of files, with exclusion, size limits and hashes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.text import extension, file_kind, glob_regex, media_type, path_parts
from tessella.operators.tables import file_id
from tessella.schema import DEFAULT_IGNORED

#: Larger media are refused, and any file that no row can hold.
MOST_BYTES, MOST_ROW = 50 << 20, 1 << 30


def excluded(path, patterns):
    """Whether a folder on the path has a name that a pattern matches."""
    folders = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    one = lambda p: F.exists(folders, lambda f: F.lower(f).rlike(glob_regex(p)))
    return reduce(lambda a, b: a | b, map(one, patterns), F.lit(False))


def listing(raw: DataFrame, folder: str, patterns: tuple[str, ...] = DEFAULT_IGNORED) -> DataFrame:
    """raw (path, length, modificationTime) without what lies in excluded folders below folder, and file_kind by name ("" if only
    the content tells) and error of what is too large to read. No content is touched."""
    x = raw.withColumn("path", F.regexp_replace("path", "^file:/*", "/"))
    root = len(folder.removeprefix("file://").rstrip("/")) + 1
    x = x.filter(~excluded(F.substring(F.col("path"), F.lit(root), F.length("path")), patterns))
    kind = file_kind(F.col("path"))
    large = (F.col("length") > MOST_BYTES) & kind.isin("image", "video", "audio", "document")
    return x.withColumns({"kind": kind, "error": F.when(large, "ERR_FILE_TOO_LARGE")})


def described(rows: DataFrame) -> DataFrame:
    """listing's rows (and content, null where there is an error) as the files relation's columns, content and error; rows of no known kind go."""
    parts = path_parts(F.col("path"))
    kind = F.when(F.col("kind") != "", F.col("kind")).otherwise(file_kind(F.col("path"), F.col("content")))
    return rows.select(
        file_id(F.col("path")).alias("file_id"), "path", kind.alias("file_type"), extension(F.col("path")).alias("extension"),
        F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"), F.coalesce(F.sha2("content", 256), F.lit("")).alias("content_hash"),
        parts["basename"].alias("basename"), parts["parent"].alias("parent"), parts["stem"].alias("stem"), media_type(F.col("path")).alias("media_type"), "content", "error",
    ).filter("file_type != ''")


def read(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of some paths that are there still."""
    conf, path = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    return [p for p in paths if (x := path(p)).getFileSystem(conf).exists(x)]


def walk(spark: SparkSession, folder: str, patterns: tuple[str, ...] = DEFAULT_IGNORED, paths: list[str] | None = None) -> DataFrame:
    """Files of known kinds under a folder (or some paths of it): the files relation's columns, content and error.

    Names, lengths and times come from the listing. The length bound is pushed into the scan, so that no media over it, nor any file
    over what a row can hold, is opened; those are listed with an error and no hash.
    """
    raw = read(spark, paths or folder)
    readable = described(listing(raw.filter(F.col("length") <= MOST_BYTES), folder, patterns))
    # text has no bound of its own but a row's
    texts = listing(raw.filter((F.col("length") > MOST_BYTES) & (F.col("length") <= MOST_ROW)), folder, patterns).filter("kind in ('', 'text')")
    larger = listing(raw.drop("content").filter(F.col("length") > MOST_BYTES), folder, patterns).withColumn("content", F.lit(None).cast("binary"))
    refused = larger.filter((F.col("kind") != "") & (F.col("error").isNotNull() | (F.col("length") > MOST_ROW))).withColumn("error", F.lit("ERR_FILE_TOO_LARGE"))
    return readable.unionByName(described(texts)).unionByName(described(refused))


def stats(spark: SparkSession, folder: str, patterns: tuple[str, ...] = DEFAULT_IGNORED) -> DataFrame:
    """(path, size_bytes, modified_at) of a folder's files of kinds that names tell, without reading any."""
    x = listing(read(spark, folder).drop("content"), folder, patterns)
    return x.select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"), "kind")


def count_indexable(spark: SparkSession, folders: list[str], patterns: tuple[str, ...] = DEFAULT_IGNORED) -> int:
    return sum(walk(spark, f, patterns).count() for f in folders)
