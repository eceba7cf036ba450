"""Stored trigram postings of file names: an inverted index with positions, kept up to date by what changes.

A posting is one place of one trigram in one of a file's four name columns. Postings are partitioned by a hash of the trigram and sorted by it within files, so
a query reads the folders of its own trigrams and, in these, the row groups that hold them. A phrase is found where all its
trigrams stand one after the other: their places, shifted back by their places in the phrase, meet in one group.

Changes are appended as batches: rows that take files out, and postings of files that came. A file's rows count if no later batch took it out. save() writes
all that counts into a new version. Corpus figures are kept with the version and corrected by the batches' own rows.

Defined results: queries under three characters find nothing; null columns are empty; an updated file is one that was removed and added in one batch. Characters
are compared in lower case. A trigram that all files hold has a posting for each of them, in several files of bounded size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.filenames import LEAST, WEIGHTS, name_length
from tessella.operators.tables import Store

POSTINGS = "file_id long, field int, place int, length int, gram string, bucket int"
LOG = f"{POSTINGS}, gone boolean"
#: Partitions by trigram, and rows of a file.
BUCKETS, FILE_ROWS = 64, 2_000_000
#: Files of the log that are broadcast, and its share of the corpus beyond which it is written into the version.
MOST_FILES, LOG_SHARE = 1_000_000, 0.1


def bucket(gram: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(buckets)).cast("int")


def postings(files: DataFrame) -> DataFrame:
    """A row for each place (from 1) of a trigram in a file's name columns."""
    low = [F.lower(F.coalesce(F.col(c), F.lit(""))) for c in WEIGHTS]
    fields = F.array(*[F.struct(F.lit(k).alias("field"), x.alias("low")) for k, x in enumerate(low)])
    each = files.select("file_id", name_length().cast("int").alias("length"), F.explode(fields).alias("f")).filter(F.length("f.low") >= LEAST)
    places = each.select("file_id", "f.field", "length", F.col("f.low").alias("low"), F.explode(F.sequence(F.lit(1), F.length("f.low") - 2)).alias("place"))
    gram = F.substring(F.col("low"), F.col("place"), F.lit(3))
    return places.select("file_id", "field", "place", "length", gram.alias("gram"), bucket(gram).alias("bucket"))


class NameIndex:
    """build, update, hits and save over a store."""

    def __init__(self, spark: SparkSession, root: str, name: str = "names", store: Store | None = None):
        self.spark, self.store, self.name = spark, store or Store(spark, root), name
        self.n, self.length, self.at = 0, 0, ("", "")
        self.load()

    def load(self) -> bool:
        """Takes up the stored version; whether there is one. The figures are written last, and name the versions of the others that they are of."""
        if not self.store.exists(f"{self.name}_figures"):
            return False
        row = self.store.read(f"{self.name}_figures").first()
        self.n, self.length, self.at = row["n"], row["length"], (row["postings"], row["log"])
        return True

    def exists(self) -> bool:
        return bool(self.at[0])

    def build(self, files: DataFrame) -> None:
        """A new index of these files (file_id and the name columns), each id once."""
        n, length = files.agg(F.count("*"), F.coalesce(F.sum(name_length()), F.lit(0))).first()
        self._write(postings(files), n, length)

    def _write(self, rows: DataFrame, n: int, length: int) -> None:
        self.store.write(self.name, rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "gram"), ["bucket"], FILE_ROWS)
        self.store.write(f"{self.name}_log", self.spark.createDataFrame([], LOG))
        self.n, self.length, self.at = n, length, (self.store.seen[self.name], self.store.seen[f"{self.name}_log"])
        self.store.write(f"{self.name}_figures", self.spark.createDataFrame([(n, length, *self.at)], "n long, length long, postings string, log string"))

    def _log(self) -> DataFrame:
        return self.store.appended(f"{self.name}_log", LOG, self.at[1])

    def update(self, added: DataFrame | None = None, removed: DataFrame | None = None) -> None:
        """Files (file_id and the name columns) that came and went; an updated file is in both, in removed as it was."""
        parts = []
        if removed is not None:
            parts.append(self._whole(removed, True))
        if added is not None:
            parts += [self._whole(added, False), postings(added).withColumn("gone", F.lit(False))]
        self.store.append(f"{self.name}_log", reduce(DataFrame.unionByName, parts))
        if self._log().filter("gram is null").count() > max(MOST_FILES // 10, LOG_SHARE * self.n):
            self.save()

    @staticmethod
    def _whole(files: DataFrame, gone: bool) -> DataFrame:
        """A file's own row in the log: it counts in the figures, and takes the file's earlier rows out if it is gone."""
        null = lambda t: F.lit(None).cast(t)
        return files.select("file_id", null("int").alias("field"), null("int").alias("place"), name_length().cast("int").alias("length"), null("string").alias("gram"), null("int").alias("bucket"), F.lit(gone).alias("gone"))

    def figures(self) -> tuple[int, int]:
        """The number of files and of their trigrams."""
        sign = F.when(F.col("gone"), -1).otherwise(1)
        n, length = self._log().filter("gram is null").agg(F.coalesce(F.sum(sign), F.lit(0)), F.coalesce(F.sum(sign * F.col("length")), F.lit(0))).first()
        return self.n + n, self.length + length

    def rows(self, grams: list[str] | None = None) -> DataFrame:
        """The postings that count (file_id, field, place, length, gram, bucket), of some trigrams or all."""
        base = self.spark.read.schema(POSTINGS).parquet(self.store.folder(self.name, self.at[0]))
        log = self._log()
        if grams is not None:
            buckets = self.spark.createDataFrame([(g,) for g in grams], "g string").select(bucket(F.col("g"))).distinct()
            base = base.filter(F.col("bucket").isin([r[0] for r in buckets.collect()]) & F.col("gram").isin(grams))
        gone = log.filter("gone").groupBy("file_id").agg(F.max("batch").alias("__until"))
        n = log.filter("gram is null").count()
        if not n:
            return base
        fresh = log.filter("gram is not null" if grams is None else F.col("gram").isin(grams)).select(*base.columns, "batch")
        both = base.withColumn("batch", F.lit(0)).unionByName(fresh)
        out = both.join(F.broadcast(gone) if n <= MOST_FILES else gone, "file_id", "left").filter(F.col("__until").isNull() | (F.col("batch") >= F.col("__until")))
        return out.select(*base.columns)

    def hits(self, query: str) -> DataFrame:
        """(file_id, tf, length) of the files that hold the query as a phrase: weighted occurrences that don't overlap, and trigrams of the file."""
        q = query.lower()
        if len(q) < LEAST:
            return self.spark.createDataFrame([], "file_id long, tf double, length int")
        at: dict[str, list[int]] = {}
        for k in range(len(q) - 2):
            at.setdefault(q[k : k + 3], []).append(k)
        offsets = F.create_map(*[x for g, ks in at.items() for x in (F.lit(g), F.array(*map(F.lit, ks)))])
        # all of a file meets in one task, so that no more than the query's own postings are shuffled, once
        places = self.rows(list(at)).repartition("file_id").select("file_id", "field", "length", F.explode(F.transform(offsets[F.col("gram")], lambda o: F.col("place") - o)).alias("start"))
        whole = places.groupBy("file_id", "field", "start").agg(F.count("*").alias("n"), F.first("length").alias("length")).filter(F.col("n") == len(q) - 2)
        by_field = whole.groupBy("file_id", "field").agg(F.sort_array(F.collect_list("start")).alias("starts"), F.first("length").alias("length"))
        step = len(q)
        taken = F.aggregate("starts", F.struct(F.lit(0).alias("n"), F.lit(-step).alias("last")), lambda a, s: F.when(s >= a["last"] + step, F.struct((a["n"] + 1).alias("n"), s.alias("last"))).otherwise(a), lambda a: a["n"])
        weight = F.array(*map(F.lit, WEIGHTS.values()))[F.col("field")]
        return by_field.groupBy("file_id").agg(F.sum(taken * weight).alias("tf"), F.first("length").alias("length"))

    def save(self) -> None:
        """Writes what counts into a new version, in place of version and log."""
        n, length = self.figures()
        self._write(self.rows(), n, length)
