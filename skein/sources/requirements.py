"""Requirements from outside as a Spark data source: a connector's shards are read in parallel, its changes as a stream."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from importlib import import_module
from typing import Protocol

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Columns of a requirement; seq is the connector's change number, which only grows.
COLUMNS = "seq long, item_id string, project_id string, title string, body string, status string"
_NAMES = [c.split()[0] for c in COLUMNS.split(", ")]
_TYPES = [pa.int64()] + [pa.string()] * (len(_NAMES) - 1)
_ROWS = 4096


class RequirementConnector(Protocol):
    """What a system of requirements must offer. An instance is made from the options where it is used, on any executor."""

    def __init__(self, options: dict[str, str]): ...

    def shards(self) -> list[str]:
        """Parts that can be pulled on their own: projects, pages, files."""

    def latest(self) -> int:
        """The greatest change number so far."""

    def pull(self, shard: str, after: int, upto: int) -> Iterator[dict]:
        """A shard's items with after < seq <= upto."""


class FolderConnector:
    """Files of JSON lines under `path` (a URI that Arrow's file systems open), one shard a file."""

    def __init__(self, options: dict[str, str]):
        self._fs, self._root = fs.FileSystem.from_uri(options["path"])

    def shards(self) -> list[str]:
        found = self._fs.get_file_info(fs.FileSelector(self._root, recursive=True, allow_not_found=True))
        return sorted(f.path for f in found if f.is_file and f.path.endswith(".json"))

    def _lines(self, shard: str) -> Iterator[dict]:
        with self._fs.open_input_stream(shard) as raw:
            rest = b""
            while block := raw.read(1 << 20):
                *lines, rest = (rest + block).split(b"\n")
                yield from (json.loads(x) for x in lines if x.strip())
            if rest.strip():
                yield json.loads(rest)

    def latest(self) -> int:
        return max((int(x["seq"]) for s in self.shards() for x in self._lines(s) if x.get("seq") is not None), default=0)

    def pull(self, shard: str, after: int, upto: int) -> Iterator[dict]:
        return (x for x in self._lines(shard) if x.get("seq") is not None and after < int(x["seq"]) <= upto)


@dataclass
class Shard(InputPartition):
    """One task's part of a pull."""

    name: str
    after: int
    upto: int

    def __init__(self, name: str, after: int, upto: int):
        super().__init__((name, after, upto))
        self.name, self.after, self.upto = name, after, upto


def _connector(options: dict[str, str]) -> RequirementConnector:
    """The connector that option `connector` names as module:Class; a folder without it."""
    module, _, name = options.get("connector", f"{__name__}:FolderConnector").partition(":")
    return getattr(import_module(module), name)(options)


def _pulled(options: dict[str, str], shard: Shard) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    batch = lambda: pa.RecordBatch.from_arrays([pa.array([x.get(c) for x in held], t) for c, t in zip(_NAMES, _TYPES, strict=True)], _NAMES)
    for item in _connector(options).pull(shard.name, shard.after, shard.upto):
        held.append(item)
        if len(held) == _ROWS:
            yield batch()
            held = []
    if held:
        yield batch()


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[Shard]:
        after, upto = int(self.options.get("after", "0")), int(self.options.get("upto", str((1 << 63) - 1)))
        return [Shard(s, after, upto) for s in _connector(self.options).shards()] or [Shard("", 0, 0)]

    def read(self, partition: Shard) -> Iterator[pa.RecordBatch]:
        return _pulled(self.options, partition) if partition.name else iter(())


class _StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def initialOffset(self) -> dict:
        return {"seq": int(self.options.get("after", "0"))}

    def latestOffset(self) -> dict:
        return {"seq": _connector(self.options).latest()}

    def partitions(self, start: dict, end: dict) -> list[Shard]:
        return [Shard(s, start["seq"], end["seq"]) for s in _connector(self.options).shards()]

    def read(self, partition: Shard) -> Iterator[pa.RecordBatch]:
        return _pulled(self.options, partition)


class RequirementSource(DataSource):
    """spark.read.format("requirements"): options path, or connector and whatever it takes; after and upto bound change numbers.

    A batch read has a partition for each shard. A stream's offset is a change number: each batch pulls what changed since, and
    a batch that runs again after a loss pulls the same range.
    """

    @classmethod
    def name(cls) -> str:
        return "requirements"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RequirementSource)
