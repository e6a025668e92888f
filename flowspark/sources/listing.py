"""Folders listed by tasks: a Python data source for batches and streams.

Each task lists the folder for its share of the names (``shares`` of them, by a checksum of the name) and gives rows (path,
modificationTime, length), empty files included. Nothing is listed by the driver.

In a stream an offset is a tick of the clock. The task that reads up to a tick lists its share, writes that listing below
``state`` and gives the files that the listing of the tick before does not have with the same time and length: new files and
new versions, each once, whatever times they bear. A repeated task finds the listing that was written and gives the same rows.
Listings of past ticks are removed, so the state is as large as the folder's listing. Files changed less than ``settle``
seconds ago wait for the next tick.
"""

from __future__ import annotations

import re
import time
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from ..functions.paths import glob_regex
from ..sinks.storage import children, entries, exists, open_store, put

LISTED = "path string, modificationTime timestamp, length bigint"
ROWS = 10_000
_KEPT = pa.schema([("name", pa.string()), ("mtime", pa.int64()), ("length", pa.int64())])


def hidden(name: str) -> bool:
    """Names that Spark takes for hidden files."""
    told = name.startswith(("_metadata", "_common_metadata"))
    return not told and (name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_"))


@dataclass
class Share(InputPartition):
    number: int
    start: int = 0
    end: int = 0


class _Folder:
    """The options of a reader, and what its tasks do with them."""

    def __init__(self, options: dict):
        if not options.get("path"):
            raise ValueError("missing option: path")
        self.path = options["path"]
        self.prefix = options.get("prefix") or self.path.rstrip("/")
        self.pattern = glob_regex(options.get("pattern") or "*")
        self.shares = int(options.get("shares") or 1)
        self.settle = float(options.get("settle") or 0)
        self.state = options.get("state")
        self.recursive = options.get("recursive") == "true"

    def listed(self, share: int) -> pa.Table:
        """Name, time (microseconds, cut to milliseconds as Spark has them) and length of the files of a share."""
        fits, until = re.compile(self.pattern), time.time() - self.settle
        names, times, lengths = [], [], []
        for name, mtime_ns, size in entries(
                self.path, lambda name: zlib.crc32(name.encode()) % self.shares == share and not hidden(name) and bool(fits.match(name)),
                (lambda name: not hidden(name)) if self.recursive else None):
            if self.settle and mtime_ns > until * 1e9:
                continue
            names.append(name)
            times.append(mtime_ns // 10**6 * 1000)
            lengths.append(size)
        return pa.table([pa.array(names, pa.string()), pa.array(times, pa.int64()), pa.array(lengths, pa.int64())], schema=_KEPT)

    def rows(self, found: pa.Table) -> Iterator[pa.RecordBatch]:
        for batch in found.to_batches(max_chunksize=ROWS):
            paths = pa.array([f"{self.prefix}/{name}" for name in batch.column("name").to_pylist()], pa.string())
            moments = batch.column("mtime").cast(pa.timestamp("us", "UTC"))
            yield pa.RecordBatch.from_arrays([paths, moments, batch.column("length")], ["path", "modificationTime", "length"])


class FolderReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = _Folder(options)

    def partitions(self) -> Sequence[InputPartition]:
        return [Share(k) for k in range(self.folder.shares)]

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        yield from self.folder.rows(self.folder.listed(partition.number))


class FolderStream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder = _Folder(options)
        if not self.folder.state:
            raise ValueError("missing option: state")

    def initialOffset(self) -> dict:
        return {"tick": 0}

    def latestOffset(self) -> dict:
        return {"tick": int(time.time() * 1000)}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        if start["tick"] == end["tick"]:
            return []
        return [Share(k, start["tick"], end["tick"]) for k in range(self.folder.shares)]

    def _listing(self, tick: int, share: int) -> pa.Table | None:
        store, root = open_store(self.folder.state)
        place = f"{root}/{tick}/{share}.parquet"
        return pq.read_table(store.open_input_file(place)) if exists(store, place) else None

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        now = self._listing(partition.end, partition.number)
        if now is None:
            out = pa.BufferOutputStream()
            pq.write_table(self.folder.listed(partition.number), out)
            store, root = open_store(self.folder.state)
            put(store, f"{root}/{partition.end}/{partition.number}.parquet", out.getvalue().to_pybytes())
            now = self._listing(partition.end, partition.number)
        before = self._listing(partition.start, partition.number)
        if before is not None:
            now = now.join(before.append_column("known", pa.array([True] * before.num_rows)),
                           ["name", "mtime", "length"], join_type="left anti")
        yield from self.folder.rows(now.select(_KEPT.names))

    def commit(self, end: dict) -> None:
        store, root = open_store(self.folder.state)
        for name in children(store, root):  # a folder a tick
            if name.isdecimal() and int(name) < end["tick"]:
                store.delete_dir(f"{root}/{name}")


class FolderSource(DataSource):
    """To be read by batches and streams; options ``path``, ``prefix``, ``pattern``, ``shares``, ``settle``, ``state``,
    ``recursive`` (sub-folders too, their files named by the path below the folder)."""

    @classmethod
    def name(cls) -> str:
        return "folder"

    def schema(self) -> str:
        return LISTED

    def reader(self, schema: StructType) -> DataSourceReader:
        return FolderReader(dict(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return FolderStream(dict(self.options))
