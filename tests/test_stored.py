"""Stored tables as a data source: versions, pruning by pushed filters, SQL."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In, Not, StringStartsWith

from tessella.operators.tables import Store
from tessella.sources import stored


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    stored.register(spark)
    root = f"file://{tmp_path_factory.mktemp('stored')}/s"
    df = spark.range(1000).select(F.col("id").alias("file_id"), F.concat(F.lit("/d/"), F.col("id").cast("string")).alias("path"), F.when(F.col("id") % 10 != 0, F.col("id") % 3).alias("kind"), F.array(F.col("id").cast("float")).alias("embedding"), F.lit("2024-01-01").cast("timestamp").alias("at"))
    store = Store(spark, root)
    store.write("files", df.limit(1))
    store.write("files", df.repartitionByRange(5, "file_id").sortWithinPartitions("file_id"))
    store.write("cells", df.withColumn("cell", (F.col("file_id") % 4).cast("int")), ["cell"])
    return root


def read(spark, root, table):
    return spark.read.format("tessella").option("root", root).option("table", table).load()


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("where", ["true", "file_id = 17", "file_id > 900 and path like '/d/9%'", "kind is null", "kind <> 1", "not (path like '%7')", "file_id in (3, 999, 5000)", "kind = 1 or file_id < 3", "path like '%99%' and kind is not null", "at > timestamp '2023-01-01' and file_id <= 4", "file_id < 0"])
def test_filters(spark, root, where):
    df = spark.read.parquet(Store(spark, root).folder("files"))
    assert rows(read(spark, root, "files").filter(where)) == rows(df.filter(where))


def test_pushed_filters_prune(spark, root):
    schema = read(spark, root, "files").schema
    reader = stored.StoredReader(root, "files", schema)
    assert len(reader.partitions()) == 5
    left = list(reader.pushFilters([EqualTo(("file_id",), 17), EqualTo(("at",), 1.5), EqualTo(("a", "b"), 1)]))
    assert len(left) == 2 and len(reader.partitions()) == 1
    cells = stored.StoredReader(root, "cells", read(spark, root, "cells").schema)
    assert list(cells.pushFilters([In(("cell",), (1, 2))])) == []
    assert {p.path.split("cell=")[1][0] for p in cells.partitions()} == {"1", "2"}
    plan = read(spark, root, "files").filter("file_id = 17")._jdf.queryExecution().executedPlan().toString()
    assert "Filter (file_id" not in plan.replace("isnotnull(file_id", "")
    assert stored.expression(Not(In(("a",), (1,)))) is None and stored.expression(StringStartsWith(("a",), "x")) is not None


def test_sql_versions_and_options(spark, root):
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW stored_cells USING tessella OPTIONS (root '{root}', table 'cells')")
    assert [tuple(r) for r in spark.sql("SELECT cell, count(*) FROM stored_cells WHERE file_id >= 500 GROUP BY cell ORDER BY cell").collect()] == [(k, 125) for k in range(4)]
    Store(spark, root).write("small", spark.range(2))
    df = read(spark, root, "small")
    assert df.count() == 2
    Store(spark, root).write("small", spark.range(3))
    assert read(spark, root, "small").count() == 3
    with pytest.raises(Exception, match="options needed"):
        spark.read.format("tessella").option("root", root).load()
