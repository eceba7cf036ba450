"""Table maintenance: each change is a new DataFrame to publish; keys decide, not row order."""

from __future__ import annotations

import os
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.text import inside, path_parts


def file_id(path: Column) -> Column:
    """An id that follows from the path, so that repeated ingestion agrees."""
    return F.xxhash64(path)


def latest(rows: DataFrame, key: str, order: str = "seq") -> DataFrame:
    """Of the rows of a key, the last by order; of equally late ones the greatest row, column by column."""
    rest = [c for c in rows.columns if c not in (key, order)]
    last = rows.groupBy(key).agg(F.max(F.struct(order, *rest)).alias("r"))
    return last.select(*[F.col(key) if c == key else F.col(f"r.{c}") for c in rows.columns])


def upsert_files(files: DataFrame, changes: DataFrame) -> DataFrame:
    """changes (files' columns but for ids and path parts, seq) over files by path.

    A known path keeps its id, so that its chunks stay its own; a new one gets an id that follows from the path. Columns
    that changes lack keep their values.
    """
    new = latest(changes, "path").drop("seq")
    parts = path_parts(F.col("path"))
    given = {c for c in new.columns if c != "file_id"}
    x = files.alias("o").join(new.alias("n").withColumn("__new", F.lit(True)), "path", "full_outer")
    made = {"file_id": F.coalesce("o.file_id", file_id(F.col("path"))), **{n: F.coalesce(f"o.{n}", parts[n]) for n in ("basename", "parent", "stem")}}

    def pick(c: str) -> Column:
        if c in made:
            return made[c]
        if c == "path":
            return F.col(c)
        return F.when(F.col("__new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) if c in given else F.col(f"o.{c}")

    return x.select(*[pick(c).alias(c) for c in files.columns])


def set_hashes(files: DataFrame, done: DataFrame) -> DataFrame:
    """files with the content_hash of done (file_id, content_hash): what a file's rows are committed by."""
    known = done.select("file_id", F.col("content_hash").alias("__hash"))
    return files.join(known, "file_id", "left").withColumn("content_hash", F.coalesce("__hash", "content_hash")).select(*files.columns)


def replace_chunks(chunks: DataFrame, ids: DataFrame, new: DataFrame | None = None) -> DataFrame:
    """chunks without those of the files in ids (file_id), and with new ones."""
    kept = chunks.join(ids.select("file_id").distinct(), "file_id", "left_anti").select(*chunks.columns)
    return kept if new is None else kept.unionByName(new.select(*chunks.columns))


def upsert_chunks(chunks: DataFrame, changes: DataFrame) -> DataFrame:
    """By vector_id; a known chunk takes the new vector and model but keeps its file, place and times."""
    fresh = ("embedding", "embedding_model", "embedding_dims")
    new = latest(changes, "vector_id").drop("seq")
    x = chunks.alias("o").join(new.alias("n"), "vector_id", "full_outer")
    was = F.col("o.file_id").isNotNull()
    pick = lambda c: F.when(was, F.coalesce(f"n.{c}", f"o.{c}") if c in fresh else F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))
    return x.select(*[F.col(c) if c == "vector_id" else pick(c).alias(c) for c in chunks.columns])


def delete_files(files: DataFrame, chunks: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """files and chunks without those of gone (path), and the vector_ids that went."""
    ids = files.join(gone.select("path").distinct(), "path", "left_semi").select("file_id")
    return files.join(ids, "file_id", "left_anti"), chunks.join(ids, "file_id", "left_anti"), chunks.join(ids, "file_id", "left_semi").select("vector_id")


def delete_folder(files: DataFrame, chunks: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """Both without what is in the folder; sibling folders of a longer name stay."""
    out = files.filter(inside(F.col("path"), folder)).select("file_id")
    return files.filter(~inside(F.col("path"), folder)), chunks.join(out, "file_id", "left_anti")


def rename(files: DataFrame, old: str, new: str) -> DataFrame:
    """files with old's row under its new path; FileNotFoundError where there is none, FileExistsError where new is taken."""
    there = {r["path"] for r in files.filter(F.col("path").isin(old, new)).select("path").limit(2).collect()}
    if old not in there:
        raise FileNotFoundError(old)
    if new in there and new != old:
        raise FileExistsError(new)
    parts = path_parts(F.lit(new))
    hit = F.col("path") == old
    return files.withColumns({"path": F.when(hit, F.lit(new)).otherwise(F.col("path")), **{n: F.when(hit, parts[n]).otherwise(F.col(n)) for n in ("basename", "parent", "stem")}})


def stale(listing: DataFrame, files: DataFrame, force: bool = False) -> DataFrame:
    """listing (path, content_hash, ...) with stale: new, changed, incomplete, or all if forced."""
    known = files.select("path", F.col("content_hash").alias("__hash"))
    return listing.join(known, "path", "left").withColumn("stale", F.lit(force) | F.col("__hash").isNull() | (F.col("__hash") == "") | (F.col("__hash") != F.col("content_hash"))).drop("__hash")


def rescan(listing: DataFrame, files: DataFrame) -> DataFrame:
    """(path, action): new, changed (another modification time) or gone; unchanged paths are left out."""
    x = listing.select("path", F.col("modified_at").alias("there")).join(files.select("path", F.col("modified_at").alias("known")), "path", "full_outer")
    action = F.when(F.col("known").isNull(), "new").when(F.col("there").isNull(), "gone").when(F.col("there") != F.col("known"), "changed")
    return x.select("path", action.alias("action")).filter("action is not null")


def missing_vectors(chunks: DataFrame, index: DataFrame) -> DataFrame:
    """(file_id, n_missing) of the files with chunks that the index (vector_id) lacks."""
    return chunks.join(index.select("vector_id").distinct(), "vector_id", "left_anti").groupBy("file_id").agg(F.count("*").alias("n_missing"))


def to_index(files: DataFrame, chunks: DataFrame, index: DataFrame) -> DataFrame:
    """(file_id) to queue again: incomplete files, and files with missing vectors, each once."""
    broken = missing_vectors(chunks, index).select("file_id")
    return files.filter(F.col("content_hash") == "").select("file_id").union(broken).distinct()


def derived(files: DataFrame) -> DataFrame:
    """files with the columns that follow from the path filled in where an older version lacks them."""
    parts = path_parts(F.col("path"))
    have = set(files.columns)
    return files.withColumns({n: F.coalesce(F.nullif(F.col(n), F.lit("")), parts[n]) if n in have else parts[n] for n in ("basename", "parent", "stem")})


def put_setting(settings: DataFrame, key: str, value: str) -> DataFrame:
    new = settings.sparkSession.createDataFrame([(key, value)], "key string, value string")
    return settings.filter(F.col("key") != key).select("key", "value").union(new)


def with_name(names: DataFrame, value: str) -> DataFrame:
    """A one-column list (folders, excluded patterns) with value, once."""
    new = names.sparkSession.createDataFrame([(value,)], f"`{names.columns[0]}` string")
    return names.union(new).distinct()


def without_name(names: DataFrame, value: str) -> DataFrame:
    return names.filter(F.col(names.columns[0]) != value)


def has_missing_blobs(chunks: DataFrame) -> bool:
    return not chunks.filter(F.col("embedding").isNull()).isEmpty()


def models(chunks: DataFrame) -> DataFrame:
    """(embedding_model, n) of the named models."""
    return chunks.filter(F.col("embedding_model") != "").groupBy("embedding_model").agg(F.count("*").alias("n"))


def evict(cache: DataFrame, column: str, limit: int, keep_equal: bool) -> DataFrame:
    """Cache rows young enough: column > limit, or >= limit."""
    return cache.filter(F.col(column) >= limit if keep_equal else F.col(column) > limit)


def setting(settings: DataFrame, key: str, default: str) -> str:
    row = settings.filter(F.col("key") == key).select("value").first()
    return default if row is None or row[0] is None else row[0]


class LostUpdate(RuntimeError):
    """Another writer published a version of the table since this store read it."""


class Store:
    """Tables as Parquet folders: a table's versions lie side by side, and a small pointer names the current one.

    A write becomes visible when the pointer is replaced, in one step, so that readers see the old version or the new one and a lost
    job leaves the old one. A version has one successor: whoever first creates the file that names it. A store that has read or written a table
    succeeds to the version that it saw; where another one came first, LostUpdate is raised and that one's version stays. A writer that is lost
    after naming its successor is finished by the next. The version before the current one stays for readers that began with it; older ones go.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.seen: dict[str, str | None] = {}

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _pointer(self, name: str) -> str:
        return f"{self.root}/{name}/CURRENT"

    def _put(self, path: str, text: str, replace: bool = True) -> None:
        fs, p = self._fs(path)
        out = fs.create(p, replace)
        out.write(bytearray(text.encode()))
        out.close()

    def _text(self, path: str) -> str:
        fs, p = self._fs(path)
        stream = fs.open(p)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def _replace(self, fresh, p) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), conf).rename(fresh, p, how)

    def exists(self, name: str) -> bool:
        fs, p = self._fs(self._pointer(name))
        return fs.exists(p)

    def version(self, name: str) -> str:
        return self._text(self._pointer(name))

    def versions(self, name: str) -> list[str]:
        """The stored versions, oldest first."""
        fs, p = self._fs(f"{self.root}/{name}")
        return sorted(x.getPath().getName() for x in fs.listStatus(p) if x.isDirectory())

    def folder(self, name: str, version: str | None = None) -> str:
        """Where a version lies: the current one if none is given, and then a later write succeeds to it."""
        if version is None:
            version = self.seen[name] = self.version(name)
        return f"{self.root}/{name}/{version}"

    def read(self, name: str, version: str | None = None) -> DataFrame:
        return self.spark.read.parquet(self.folder(name, version))

    def write(self, name: str, df: DataFrame, by: list[str] | None = None, most: int = 0) -> DataFrame:
        """Stores df as the table's new version, partitioned by some columns and with at most most rows in a file (0: any), and returns it as stored."""
        before = self.seen[name] if name in self.seen else (self.version(name) if self.exists(name) else None)
        version = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        df.write.option("maxRecordsPerFile", most).partitionBy(*by or []).parquet(f"{self.root}/{name}/{version}")
        self._succeed(name, before, version)
        self.seen[name] = version
        fs, _ = self._fs(self.root)
        for old in self.versions(name)[:-2]:
            for gone in (old, f".after-{old}"):
                fs.delete(self._fs(f"{self.root}/{name}/{gone}")[1], True)
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}/{version}")

    def _succeed(self, name: str, before: str | None, version: str) -> None:
        mark = f"{self.root}/{name}/.after-{before or 'none'}"
        fs, p = self._fs(mark)
        try:
            if (self.version(name) if self.exists(name) else None) != before:
                raise LostUpdate(name)
            try:
                self._put(mark, version, False)
            except Exception as e:
                if not fs.exists(p):
                    raise
                self._point(name, self._text(mark))
                raise LostUpdate(name) from e
        except LostUpdate:
            fs.delete(self._fs(f"{self.root}/{name}/{version}")[1], True)
            raise
        self._point(name, version)

    def _point(self, name: str, version: str) -> None:
        fresh = f"{self.root}/{name}/.{version}"
        self._put(fresh, version)
        self._replace(self._fs(fresh)[1], self._fs(self._pointer(name))[1])

    def append(self, name: str, df: DataFrame, version: str | None = None) -> int:
        """Adds a batch of rows to a version (the current one), under a number of its own (column batch), and returns the number. Readers see all of it or nothing."""
        home = self.folder(name, version)
        fs, p = self._fs(home)
        # where two writers choose one number, the rename of the second fails, and it takes the next
        fresh = f"{home}/.{uuid.uuid4().hex}"
        df.write.parquet(fresh)
        while True:
            batch = 1 + max([int(n.removeprefix("batch=")) for x in fs.listStatus(p) if (n := x.getPath().getName()).startswith("batch=")], default=0)
            to = self._fs(f"{home}/batch={batch}")[1]
            if not fs.exists(to) and fs.rename(self._fs(fresh)[1], to):
                return batch

    def appended(self, name: str, schema: str, version: str | None = None) -> DataFrame:
        """The batches of a version (the current one); schema is that of their rows."""
        home = self.folder(name, version)
        fs, p = self._fs(home)
        batches = [x.getPath().toString() for x in fs.listStatus(p) if x.getPath().getName().startswith("batch=")]
        if not batches:
            return self.spark.createDataFrame([], f"{schema}, batch int")
        return self.spark.read.option("basePath", home).schema(f"{schema}, batch int").parquet(*batches)

    def drop(self, name: str) -> None:
        fs, p = self._fs(f"{self.root}/{name}")
        fs.delete(p, True)
        self.seen.pop(name, None)


def local_path(uri: str) -> str:
    """A file URI's path."""
    return uri.removeprefix("file://") if uri.startswith("file:///") else os.path.normpath(uri.removeprefix("file:"))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share: under spark.checkpoint.dir, or a temporary one on a local master."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir")
    if not base and not sc.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir is not set")
    return f"{base or 'file://' + os.path.join(tempfile.gettempdir(), 'tessella')}/{name}-{uuid.uuid4().hex}"
