"""The engine's stored tables as a data source: spark.read.format("tessella").option("root", ...).option("table", ...), and from SQL by USING tessella.

Readers take the version that is current when a scan is planned, also from outside of the session that wrote it. A table's files are the partitions of a scan (large files by
row groups). Pushed filters choose among partition folders, skip row groups by their statistics, and are applied within them; only those that a file's types can't answer
stay with Spark. Appended batches of a table that has them are read as its rows, with the column batch.

Pushdown for Python sources is off in Spark by default; register() turns it on.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not, StringContains, StringEndsWith, StringStartsWith,
)
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

from tessella.sources.watching import _open

#: Row groups of a partition of a scan.
GROUPS = 8


class GroupPart(InputPartition):
    def __init__(self, path: str, groups: list[int]):
        super().__init__((path, groups))
        self.path, self.groups = path, groups


class StoredReader(DataSourceReader):
    def __init__(self, root: str, table: str, schema: StructType):
        self.root, self.table, self.schema, self.pushed = root, table, schema, []

    def _dataset(self, files: list[str] | None = None) -> ds.Dataset:
        fs, home = current(self.root, self.table)
        part = ds.partitioning(flavor="hive")
        if files is None:
            found = fs.get_file_info(pafs.FileSelector(home, recursive=True))
            files = sorted(x.path for x in found if x.type == pafs.FileType.File and x.path.endswith(".parquet") and not any(n.startswith(("_", ".")) for n in x.path.removeprefix(home).split("/")))
        return ds.dataset(files, filesystem=fs, format="parquet", partitioning=part, partition_base_dir=home, schema=to_arrow_schema(self.schema))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if expression(f) is None:
                yield f
            else:
                self.pushed.append(f)

    def _filter(self) -> pc.Expression | None:
        return reduce(lambda a, b: a & b, map(expression, self.pushed)) if self.pushed else None

    def partitions(self) -> list[GroupPart]:
        data, out, test = self._dataset(), [], self._filter()
        for fragment in data.get_fragments(filter=test):
            groups = [g.id for one in fragment.split_by_row_group(filter=test, schema=data.schema) for g in one.row_groups]
            out += [GroupPart(fragment.path, groups[k : k + GROUPS]) for k in range(0, len(groups), GROUPS)]
        return out or [GroupPart("", [])]

    def read(self, partition: GroupPart) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        data, want = self._dataset([partition.path]), to_arrow_schema(self.schema)
        for fragment in data.get_fragments():
            own = fragment.subset(row_group_ids=partition.groups)
            for batch in own.scanner(schema=data.schema, filter=self._filter()).to_batches():
                if batch.num_rows:
                    yield pa.RecordBatch.from_arrays([pc.cast(batch.column(n), want.field(n).type) for n in want.names], schema=want)


def expression(f: Filter) -> pc.Expression | None:
    """A pushed filter over a top-level column, as one of the file format's; None for others. Comparisons with null are never true, as in SQL."""
    if isinstance(f, Not):
        inner = expression(f.child) if not isinstance(f.child, (In, Not)) else None
        return None if inner is None else ~inner
    if len(getattr(f, "attribute", ())) != 1:
        return None
    column = pc.field(f.attribute[0])
    if isinstance(f, IsNull | IsNotNull):
        return column.is_null() if isinstance(f, IsNull) else column.is_valid()
    value = getattr(f, "value", None)
    if isinstance(f, In):
        return column.isin(list(f.value)) if f.value and all(isinstance(v, int | str) and not isinstance(v, bool) for v in f.value) else None
    if not isinstance(value, int | str) or isinstance(value, bool):  # fractions, times and decimals stay with Spark
        return None
    compare = {EqualTo: lambda: column == value, GreaterThan: lambda: column > value, GreaterThanOrEqual: lambda: column >= value, LessThan: lambda: column < value, LessThanOrEqual: lambda: column <= value}
    text = {StringStartsWith: pc.starts_with, StringEndsWith: pc.ends_with, StringContains: pc.match_substring}
    if type(f) in compare:
        return compare[type(f)]()
    return text[type(f)](column, value) if type(f) in text else None


def current(root: str, table: str) -> tuple[pafs.FileSystem, str]:
    """Where a table's current version lies."""
    fs, path = _open(root)
    with fs.open_input_stream(f"{path}/{table}/CURRENT") as f:
        return fs, f"{path}/{table}/{f.read().decode().strip()}"


class StoredTables(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tessella"

    def _options(self) -> tuple[str, str]:
        missing = [n for n in ("root", "table") if n not in self.options]
        if missing:
            raise ValueError(f"options needed: {', '.join(missing)}")
        return self.options["root"], self.options["table"]

    def schema(self) -> StructType:
        fs, home = current(*self._options())
        return from_arrow_schema(ds.dataset(home, filesystem=fs, format="parquet", partitioning="hive").schema)

    def reader(self, schema: StructType) -> StoredReader:
        return StoredReader(*self._options(), schema)


def register(spark: SparkSession) -> None:
    """Makes format("tessella") known to a session, with pushdown."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(StoredTables)
