"""A keyed store of JSON lines as a Spark data source: rows by key, the last batch that has a key wins.

    spark.dataSource.register(KeyedJsonl)
    df.write.format("keyed_jsonl").option("path", folder).option("key", "id").option("batch", "2024-05-01").mode("append").save()
    spark.read.format("keyed_jsonl").option("key", "id").schema("id long, name string").load(folder)

Tasks write staged files, one for each bucket of keys that they meet; they are part of the store only when the commit, a
single file that names them, is there. So a task that is lost or runs twice leaves no row, a write that fails leaves none, and
a batch that was committed before changes nothing when it is written again. Readers take one bucket a task: the files of a
bucket in the order of their commits.

A bucket's keys are held by the task that reads it: choose `buckets` (64) by the size of the store; it is fixed by the first
commit. Rows without a key are kept as they are, each for itself. Within a batch, of rows with one key any one is kept.
Columns that a line doesn't have are null; lines that can't be read raise an error that names the file.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType


def _files(path: str):
    """The file system and the folder in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def _named(base: str, files, folder: str, end: str) -> list[str]:
    from pyarrow import fs

    found = files.get_file_info(fs.FileSelector(f"{base}/{folder}", allow_not_found=True))
    return sorted(f.path for f in found if f.path.endswith(end))


def commits(path: str) -> list[dict]:
    """The store's commits in order: number, batch, buckets, files by bucket."""
    files, base = _files(path)
    out = []
    for p in _named(base, files, "commits", ".json"):
        with files.open_input_file(p) as f:
            out.append(json.loads(f.read()))
    return sorted(out, key=lambda c: c["number"])


def _bucket(key, buckets: int) -> int:
    return zlib.crc32(json.dumps(key, ensure_ascii=False, default=str).encode()) % buckets


@dataclass
class Staged(WriterCommitMessage):
    """What a task has written: (bucket, file) pairs."""

    files: list[tuple[int, str]]


@dataclass
class Bucket(InputPartition):
    names: list[str]


class KeyedJsonl(DataSource):
    @classmethod
    def name(cls) -> str:
        return "keyed_jsonl"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], self.options["key"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("the store takes batches: use mode append")
        return _Writer(self.options["path"], self.options["key"], self.options.get("batch") or uuid.uuid4().hex, int(self.options.get("buckets", 64)), schema)


class _Reader(DataSourceReader):
    def __init__(self, path: str, key: str, schema: StructType):
        self.path, self.key, self.schema = path, key, schema

    def partitions(self) -> list[InputPartition]:
        held: dict[int, list[str]] = {}
        for commit in commits(self.path):
            for bucket, name in commit["files"]:
                held.setdefault(bucket, []).append(name)
        return [Bucket(held[b]) for b in sorted(held)] or [Bucket([])]

    def read(self, partition: Bucket) -> Iterator[tuple]:
        files, base = _files(self.path)
        names, last, lone = self.schema.names, {}, []
        convert = [_from_json(f.dataType) for f in self.schema.fields]
        for name in partition.names:
            with files.open_input_file(f"{base}/data/{name}") as f:
                for line in f.read().splitlines():
                    try:
                        row = json.loads(line)
                    except ValueError as e:
                        raise ValueError(f"{name}: {e}") from e
                    key = row.get(self.key)
                    if key is None:
                        lone.append(row)
                    else:
                        last[json.dumps(key)] = row
        for row in [*lone, *last.values()]:
            yield tuple(c(row.get(n)) for n, c in zip(names, convert, strict=True))


def _from_json(kind):
    """Dates and times are written as text."""
    import datetime
    import decimal

    name = kind.typeName()
    if name in ("timestamp", "timestamp_ntz"):
        return lambda x: None if x is None else datetime.datetime.fromisoformat(x)
    if name == "date":
        return lambda x: None if x is None else datetime.date.fromisoformat(x)
    if name == "decimal":
        return lambda x: None if x is None else decimal.Decimal(x)
    if name in ("float", "double"):
        return lambda x: None if x is None else float(x)
    return lambda x: x


def _plain(x):
    return x.asDict(True) if hasattr(x, "asDict") else str(x)


class _Writer(DataSourceWriter):
    def __init__(self, path: str, key: str, batch: str, buckets: int, schema: StructType):
        self.path, self.key, self.batch, self.schema = path, key, batch, schema
        before = commits(path)
        self.buckets = before[0]["buckets"] if before else buckets

    def write(self, iterator: Iterator) -> Staged:
        files, base = _files(self.path)
        files.create_dir(f"{base}/data", recursive=True)
        at, names, out = self.schema.names.index(self.key), self.schema.names, {}
        try:
            for row in iterator:
                bucket = _bucket(row[at], self.buckets)
                if bucket not in out:
                    name = f"{bucket:05d}-{uuid.uuid4().hex}.jsonl"
                    out[bucket] = (name, files.open_output_stream(f"{base}/data/{name}"))
                values = {n: v.isoformat() if hasattr(v, "isoformat") else v for n, v in zip(names, row, strict=True)}
                out[bucket][1].write(json.dumps(values, ensure_ascii=False, default=_plain).encode() + b"\n")
        finally:
            for _, stream in out.values():
                stream.close()
        return Staged([(b, name) for b, (name, _) in out.items()])

    def commit(self, messages: list) -> None:
        before = commits(self.path)
        if any(c["batch"] == self.batch for c in before):
            self.abort(messages)  # committed before: what was staged now is not wanted
            return
        files, base = _files(self.path)
        files.create_dir(f"{base}/commits", recursive=True)
        number = max((c["number"] for c in before), default=-1) + 1
        made = {"number": number, "batch": self.batch, "buckets": self.buckets, "files": sorted(f for m in messages if m for f in m.files)}
        staged = f"{base}/commits/{uuid.uuid4().hex}.staged"
        with files.open_output_stream(staged) as f:
            f.write(json.dumps(made).encode())
        files.move(staged, f"{base}/commits/{number:010d}.json")  # the store changes here, at once

    def abort(self, messages: list) -> None:
        files, base = _files(self.path)
        for m in messages:
            for _, name in m.files if m else []:
                files.delete_file(f"{base}/data/{name}")
