"""Helpers that the corpus operators share."""

from __future__ import annotations

import os
import re
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: A word is a run of characters other than these separators.
SEPARATORS = r"\x20\x09-\x0D"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text as an array; null gives an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SEPARATORS}]+"), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SEPARATORS}]+")), F.lit(0)).cast("long")


def extended(df: DataFrame, ddl: str) -> T.StructType:
    return T.StructType(df.schema.fields + T.StructType.fromDDL(ddl).fields)


#: Rows of an Arrow batch that are Python objects at a time.
SLICE = 500


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of SLICE rows; memory that Arrow holds on to is given back at the end of a task."""
    for batch in batches:
        for k in range(0, batch.num_rows, SLICE):
            yield batch.slice(k, SLICE)
    pa.default_memory_pool().release_unused()


def map_columns(df: DataFrame, make: Callable[[], Callable[[dict], dict]], schema: str | T.StructType) -> DataFrame:
    """Slices of Arrow batches through make()(columns as lists) -> columns as lists; make() runs once a task."""
    struct = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in slices(batches):
            out = f({n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)})
            yield pa.RecordBatch.from_arrays([pa.array(out[x.name], x.type) for x in arrow], schema=arrow)

    return df.mapInArrow(run, struct)


def checkpoint(df: DataFrame) -> DataFrame:
    """df, stored in the checkpoint folder that executors share, so that a lost executor costs no recomputation.

    The folder is the session's spark.checkpoint.dir. Where that is unset, a local master (tests) gets a temporary one; a
    cluster raises, since its machines share no temporary folder.
    """
    sc: SparkContext = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set")
        sc.setCheckpointDir(folder or os.path.join(tempfile.gettempdir(), "checkpoints"))
    stored = df.checkpoint(eager=True)
    # A checkpoint keeps the size that the optimizer guessed for its plan, the product of its joins' sides. Over rounds these
    # numbers grow to millions of digits, and planning with them; the same rows as a new relation have none.
    spark, jdf = df.sparkSession, stored._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(jdf.queryExecution().toRdd(), jdf.schema(), False), spark)
