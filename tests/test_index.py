"""The stored vector index: recall, bounds, pruning, log, versions; and the engine's searches by it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.engine import Engine
from tessella.operators import tables
from tessella.operators.index import VectorIndex
from tessella.operators.tables import LostUpdate, Store

SCHEMA = "vector_id string, file_id long, embedding array<float>"


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


@pytest.fixture(scope="module")
def data(spark):
    """3,000 vectors of 1,500 files, around 60 centers."""
    rng = np.random.default_rng(3)
    x = unit(unit(rng.normal(size=(60, 32)))[rng.integers(60, size=3000)] + 0.2 * rng.normal(size=(3000, 32))).astype(np.float32)
    df = spark.createDataFrame([(f"v{i}", i // 2, v.tolist()) for i, v in enumerate(x)], SCHEMA).repartition(4).cache()
    return x.astype(np.float64), df


@pytest.fixture(scope="module")
def index(spark, data, tmp_path_factory):
    i = VectorIndex(spark, f"file://{tmp_path_factory.mktemp('index')}/i")
    i.build(data[1], 12, cell_rows=150)
    return i


def exact(x, q, k, allowed=lambda f: True):
    d = 1 - x @ (q / np.linalg.norm(q))
    best = {}
    for i, v in enumerate(d):
        if allowed(i // 2) and v < best.get(i // 2, (9.0,))[0]:
            best[i // 2] = v, i
    return sorted((v, i, f) for f, (v, i) in best.items())[:k]


def test_cells_grow_with_the_vectors(index):
    assert len(index.cells.coarse) == 12 and index.cells.parts
    assert sum(n for n, _ in index.figures.values()) == 3000
    assert max(n for n, _ in index.figures.values()) < 600 and len(index.figures) > 15
    again = VectorIndex(index.spark, index.store.root)
    assert again.figures == index.figures and np.array_equal(again.cells.coarse, index.cells.coarse) and again.cells.parts.keys() == index.cells.parts.keys()


@pytest.mark.parametrize("share", [1, 5, 50])
def test_recall_at_three_selectivities(spark, data, index, share):
    x, _ = data
    files = spark.range(1500).select(F.col("id").alias("file_id")).filter(F.col("file_id") % share == 0) if share > 1 else None
    found, read = 0, []
    for q in x[::750] + 0.05:
        got, how = index.nearest_files(q.tolist(), 20, files, width=1200)
        found += len({f for _, _, f in got} & {f for _, _, f in exact(x, q, 20, lambda f: f % share == 0)})
        read.append(how["cells"])
        if how["certain"]:
            assert [f for _, _, f in got] == [f for _, _, f in exact(x, q, 20, lambda f: f % share == 0)]
    assert found >= 0.95 * 20 * 4
    assert share > 1 or max(read) < how["of"]  # without a filter, most cells stay unread


def test_certain_answers_are_exact(data, index):
    x, _ = data
    for i in (5, 777):
        got, how = index.nearest_files(x[i].tolist(), 3, None, width=10**9, first=1)
        assert how["certain"] and [f for _, _, f in got] == [f for _, _, f in exact(x, x[i], 3)]


def test_only_the_cells_are_read(index):
    cells = list(index.figures)[:2]
    plan = index.rows(cells, fresh=False)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "cell" in plan.split("PartitionFilters")[1][:200]
    files = index.rows(cells, fresh=False).select(F.input_file_name()).distinct().collect()
    assert {r[0].split("/cell=")[1].split("/")[0] for r in files} == {str(c) for c in cells}


def test_log_and_odd_vectors(spark, data, tmp_path):
    x, df = data
    i = VectorIndex(spark, f"file://{tmp_path}/i")
    assert not i.exists()
    odd = spark.createDataFrame([("none", -1, None), ("short", -2, [1.0]), ("zero", -3, [0.0] * 32), ("nan", -4, [float("nan")] * 32)], SCHEMA)
    i.build(df.filter("file_id < 500").unionByName(odd), 8)
    assert i.figures[-1][0] == 4
    i.add(df.filter("file_id >= 500 and file_id < 600"))
    i.add(spark.createDataFrame([("v0", 0, x[1999].tolist())], SCHEMA))  # a known id takes the new vector
    assert i.delete(spark.createDataFrame([("v1",), ("v1100",), ("nobody",)], "vector_id string")) == 2
    now = {f"v{k}": x[k] for k in range(1200) if k not in (1, 1100)} | {"v0": x[1999]}

    def check(index):
        for q in (x[1100], x[1999]):
            best = {}
            for name, v in now.items():
                f = int(name[1:]) // 2
                best[f] = min(best.get(f, (9.0, "")), (float(1 - v @ q), name))
            want = [f for f, _ in sorted(best.items(), key=lambda e: e[1])[:5]]
            assert [f for _, _, f in index.nearest_files(q.tolist(), 5, None, width=10**9, first=1)[0]] == want
        assert {r["vector_id"]: r["has"] for r in index.has(spark.createDataFrame([("v0",), ("v1",), ("v1100",), ("x",)], "vector_id string")).collect()} == {"v0": True, "v1": False, "v1100": False, "x": False}

    check(i)
    check(VectorIndex(spark, i.store.root))
    i.save()
    check(VectorIndex(spark, i.store.root))
    short = i.nearest_files([1.0], 3)
    assert short[1]["certain"]  # a query of another length is compared with all


def test_a_lost_swap_raises(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    one, two = Store(spark, root), Store(spark, root)
    one.write("t", spark.range(3))
    assert two.read("t").count() == 3
    one.write("t", spark.range(4))
    with pytest.raises(LostUpdate):
        two.write("t", spark.range(5))
    assert two.read("t").count() == 4 and len(two.versions("t")) == 2
    two.write("t", spark.range(6))
    # a writer that was lost after it named its successor is finished by the next one
    current = two.version("t")
    spark.range(7).write.parquet(f"{root}/t/99999999999999999999-lost")
    two._put(f"{root}/t/.after-{current}", "99999999999999999999-lost", False)
    with pytest.raises(LostUpdate):
        two.write("t", spark.range(8))
    assert two.read("t").count() == 7


def test_appended_batches(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s")
    s.write("log", spark.createDataFrame([], "a long"))
    assert s.appended("log", "a long").count() == 0
    assert [s.append("log", spark.createDataFrame([(k,)], "a long")) for k in range(3)] == [1, 2, 3]
    assert sorted(map(tuple, s.appended("log", "a long").collect())) == [(0, 1), (1, 2), (2, 3)]


def test_the_engine_searches_by_its_index(spark, data, tmp_path):
    x, df = data
    files = df.select("file_id").distinct().select(
        "file_id", F.concat(F.lit("/d/"), F.col("file_id").cast("string"), F.when(F.col("file_id") % 5 == 0, ".md").otherwise(".txt")).alias("path"), F.lit("text").alias("file_type"),
        F.when(F.col("file_id") % 5 == 0, ".md").otherwise(".txt").alias("extension"), F.lit(10).cast("long").alias("size_bytes"), F.lit("2024-01-01").cast("timestamp").alias("modified_at"),
        F.lit("2024-01-01").cast("timestamp").alias("indexed_at"), F.lit("h").alias("content_hash"), F.lit("").alias("thumbnail_path"), F.col("file_id").cast("string").alias("basename"), F.lit("/d").alias("parent"), F.col("file_id").cast("string").alias("stem"),
    )
    chunks = df.select("file_id", "vector_id", F.lit(0).alias("chunk_index"), F.lit(0.0).alias("start_time"), F.lit(0.0).alias("end_time"), "embedding", F.lit("m").alias("embedding_model"), F.lit(32).alias("embedding_dims"))
    q = x[42] + 0.03
    e = Engine(spark, files, chunks, embed=lambda _: q.tolist(), model="m", root=f"file://{tmp_path}/e")
    text = "where is the report about rivers"
    plain, how = e.search(text, 10)
    assert how["strategy"] == "brute_force"
    want = [r["path"] for r in plain.collect()]
    e.build_index(12)
    e.settings = tables.put_setting(e.settings, "brute_force_threshold", "100")
    got, how = e.search(text, 10)
    assert how["strategy"] == "semantic" and how["cells"] <= how["of"] and len(set(want) & {r["path"] for r in got.collect()}) >= 9
    got, how = e.search(f"ext:md {text}", 10)
    assert how["strategy"] == "post_filter" and how["matching"] == 300
    want = [f"/d/{f}.md" for _, _, f in exact(x, q, 10, lambda f: f % 5 == 0)]
    assert len(set(want) & {r["path"] for r in got.collect()}) >= 9
    assert e.search(f"ext:md in:/d/1 {text}", 10)[1]["strategy"] in ("brute_force", "post_filter")
    # what is removed leaves the index too
    gone = want[0]
    e.remove_paths(spark.createDataFrame([(gone,)], "path string"))
    got, how = e.search(f"ext:md {text}", 10)
    assert how["strategy"] == "post_filter" and gone not in {r["path"] for r in got.collect()}
    e.save(e.store.root)
    again = Engine(spark, embed=lambda _: q.tolist(), model="m", root=e.store.root)
    again.load(e.store.root)
    assert again.search(f"ext:md {text}", 10)[1]["strategy"] == "post_filter"
    again.model = "other"
    assert again.vector_index() is None
