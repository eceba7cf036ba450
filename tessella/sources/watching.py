"""A streaming source of a folder's changes: spark.readStream.format("folder_changes").option("path", ...).option("snapshots", ...).

An offset is the number of a snapshot of the folder and all folders below it, so new folders are taken up and what happens
between two looks is one change a path. Snapshots are Parquet files in a folder that executors share, in parts by the hash of the path; a batch
is the difference of two of them, each part in a task of its own. As the stream's checkpoint keeps the number, a restart goes on from the snapshot that was
applied last, and a change is told once.

Rows are (path, op, ts): create, write (another time of modification or length) and remove; a renamed file is removed and created. ts is the time of modification, or
that of the snapshot where a file is gone. Options: path (a folder, as a path or a URI that pyarrow.fs reads), snapshots, parts (8), ignored (folder names, comma-separated), existing
("true": files that are there at the start are created; else only changes from then on count).
"""

from __future__ import annotations

import hashlib
import time
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from tessella.schema import DEFAULT_IGNORED

LISTED = pa.schema([("path", pa.string()), ("us", pa.int64()), ("size", pa.int64())])


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" in uri or uri.startswith("file:"):
        fs, path = pafs.FileSystem.from_uri(uri)
    else:
        fs, path = pafs.LocalFileSystem(), uri
    return fs, path.rstrip("/")


@dataclass
class Part(InputPartition):
    before: int
    after: int
    part: int

    def __init__(self, before: int, after: int, part: int):
        super().__init__(None)
        self.before, self.after, self.part = before, after, part


class FolderReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.kept = options["path"], options["snapshots"]
        self.parts = int(options.get("parts", "8"))
        self.ignored = frozenset(x.strip().lower() for x in options["ignored"].split(",")) if "ignored" in options else frozenset(x.lower() for x in DEFAULT_IGNORED)
        self.existing = options.get("existing", "false").lower() == "true"

    # --- snapshots

    def _home(self, number: int) -> tuple[pafs.FileSystem, str]:
        fs, path = _open(self.kept)
        return fs, f"{path}/{number:020d}"

    def _numbers(self) -> list[int]:
        fs, path = _open(self.kept)
        found = fs.get_file_info(pafs.FileSelector(path, allow_not_found=True))
        return sorted(int(x.base_name) for x in found if x.base_name.isdigit())

    def _listing(self) -> list[tuple[str, int, int]]:
        fs, root = _open(self.folder)
        out, todo = [], [root]
        while todo:
            for x in fs.get_file_info(pafs.FileSelector(todo.pop(), allow_not_found=True)):
                if x.type == pafs.FileType.Directory:
                    if x.base_name.lower() not in self.ignored:
                        todo.append(x.path)
                elif x.type == pafs.FileType.File:
                    out.append((x.path, (x.mtime_ns or 0) // 1000, x.size or 0))
        return sorted(out)

    def _take(self, rows: list[tuple[str, int, int]]) -> int:
        """Stores a listing as the next snapshot; complete once its last file, the digest, is there."""
        number = max(self._numbers(), default=0) + 1
        fs, home = self._home(number)
        fs.create_dir(home, recursive=True)
        parts: list[list] = [[] for _ in range(self.parts)]
        for r in rows:
            parts[zlib.crc32(r[0].encode("utf-8", "surrogatepass")) % self.parts].append(r)
        for k, own in enumerate(parts):
            pq.write_table(pa.Table.from_arrays([pa.array([r[i] for r in own], f.type) for i, f in enumerate(LISTED)], schema=LISTED), f"{home}/part-{k}.parquet", filesystem=fs)
        with fs.open_output_stream(f"{home}/DIGEST") as f:
            f.write(f"{self._digest(rows)} {time.time_ns() // 1000}".encode())
        return number

    @staticmethod
    def _digest(rows: list[tuple[str, int, int]]) -> str:
        return hashlib.sha256(repr(rows).encode("utf-8", "surrogatepass")).hexdigest()

    def _noted(self, number: int) -> tuple[str, int]:
        """A snapshot's digest and time; none if it was never completed."""
        fs, home = self._home(number)
        if fs.get_file_info(f"{home}/DIGEST").type != pafs.FileType.File:
            return "", 0
        with fs.open_input_stream(f"{home}/DIGEST") as f:
            digest, _, at = f.read().decode().partition(" ")
        return digest, int(at)

    def _files(self, number: int, part: int) -> dict[str, tuple[int, int]]:
        if not number:
            return {}
        fs, home = self._home(number)
        t = pq.read_table(f"{home}/part-{part}.parquet", filesystem=fs)
        return dict(zip(t["path"].to_pylist(), zip(t["us"].to_pylist(), t["size"].to_pylist(), strict=True), strict=True))

    # --- the source

    def initialOffset(self) -> dict:
        return {"snapshot": 0 if self.existing else self._take(self._listing())}

    def latestOffset(self) -> dict:
        rows = self._listing()
        last = max((n for n in self._numbers() if self._noted(n)[0]), default=0)
        return {"snapshot": last if last and self._noted(last)[0] == self._digest(rows) else self._take(rows)}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return [Part(start["snapshot"], end["snapshot"], k) for k in range(self.parts)]

    def read(self, partition: Part) -> Iterator[tuple]:
        before, after = self._files(partition.before, partition.part), self._files(partition.after, partition.part)
        gone_at = self._noted(partition.after)[1]
        when = lambda us: datetime.fromtimestamp(us / 1e6, UTC)
        for path in sorted(before.keys() - after.keys()):
            yield path, "remove", when(gone_at)
        for path, own in after.items():
            if before.get(path) != own:
                yield path, "write" if path in before else "create", when(own[0])

    def commit(self, end: dict) -> None:
        """Snapshots before the applied one are needed no more."""
        for n in self._numbers():
            if n < end["snapshot"]:
                fs, home = self._home(n)
                fs.delete_dir(home)


class FolderChanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "folder_changes"

    def schema(self) -> str:
        return "path string, op string, ts timestamp"

    def streamReader(self, schema: StructType) -> FolderReader:
        return FolderReader(dict(self.options))


def changes(spark: SparkSession, folder: str, snapshots: str, existing: bool = False, ignored: tuple[str, ...] = DEFAULT_IGNORED) -> DataFrame:
    """The changes of a folder as a stream (path, op, ts)."""
    spark.dataSource.register(FolderChanges)
    return spark.readStream.format("folder_changes").option("path", folder).option("snapshots", snapshots).option("existing", str(existing)).option("ignored", ",".join(ignored)).load()
