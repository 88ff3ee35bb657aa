"""Stored answers of scans as a data source: ``spark.dataSource.register(AnswersSource)``, format "answers", option ``path``.

A write gives every task a file of its own; only a commit names the files of its tasks in a manifest, with how many rows and
which query ids they hold, so what failed or aborted attempts leave is never read, and an abort removes what it
knows of.  A scan lists the manifests, leaves out files whose ids a pushed filter on ``query_id`` excludes, and reads each
of the others in one task; filters it cannot use (and the used ones, row by row) are left to Spark.

Set ``spark.sql.python.filterPushdown.enabled`` for filters to come this far."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

SCHEMA = "query_id long, body string"


def filesystem(path: str):
    """(pyarrow file system, path in it) of a shared folder."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[len("file:") :].lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


@dataclass
class Part(InputPartition):
    file: str


@dataclass
class Written(WriterCommitMessage):
    file: str
    rows: int
    low: int | None
    high: int | None


class AnswersSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "answers"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> AnswersReader:
        return AnswersReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> AnswersWriter:
        if overwrite:
            raise ValueError("answers are only appended")
        return AnswersWriter(self.options["path"])


class AnswersReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.bounds = path, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Keep the bounds on ``query_id``; Spark checks all rows again."""
        for f in filters:
            if getattr(f, "attribute", None) == ("query_id",) and isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                self.bounds.append(f)
            yield f

    def wanted(self, low: int | None, high: int | None) -> bool:
        """May a file with these ids have rows that pass?"""
        if low is None:
            return not self.bounds
        test = {
            EqualTo: lambda v: low <= v <= high,
            In: lambda v: any(low <= x <= high for x in v if x is not None),
            GreaterThan: lambda v: high > v,
            GreaterThanOrEqual: lambda v: high >= v,
            LessThan: lambda v: low < v,
            LessThanOrEqual: lambda v: low <= v,
        }
        return all(test[type(f)](f.value) for f in self.bounds)

    def partitions(self) -> list[Part]:
        from pyarrow import fs

        system, top = filesystem(self.path)
        found = system.get_file_info(fs.FileSelector(f"{top}/manifests", allow_not_found=True))
        out = []
        for info in sorted(found, key=lambda x: x.path):
            if info.path.endswith(".json"):
                with system.open_input_stream(info.path) as f:
                    out += [Part(x["file"]) for x in json.loads(f.read()) if x["rows"] and self.wanted(x["low"], x["high"])]
        return out or [Part("")]

    def read(self, partition: Part) -> Iterator[tuple]:
        if not partition.file:
            return
        system, top = filesystem(self.path)
        with system.open_input_stream(f"{top}/{partition.file}") as f:
            rest = b""
            while block := f.read(1 << 20):  # a line at a time, whatever a file's size
                *lines, rest = (rest + block).split(b"\n")
                for line in lines:
                    yield tuple(json.loads(line))


class AnswersWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator) -> Written:
        system, top = filesystem(self.path)
        system.create_dir(f"{top}/data", recursive=True)
        file, rows, low, high = f"data/{uuid.uuid4().hex}.jsonl", 0, None, None
        with system.open_output_stream(f"{top}/{file}") as out:
            for row in iterator:
                out.write(json.dumps([row.query_id, row.body], ensure_ascii=False).encode() + b"\n")
                rows += 1
                if row.query_id is not None:
                    low = row.query_id if low is None else min(low, row.query_id)
                    high = row.query_id if high is None else max(high, row.query_id)
        return Written(file, rows, low, high)

    def commit(self, messages: list[Written | None]) -> None:
        system, top = filesystem(self.path)
        system.create_dir(f"{top}/manifests", recursive=True)
        name = f"{top}/manifests/{uuid.uuid4().hex}"
        with system.open_output_stream(f"{name}.tmp") as out:
            out.write(json.dumps([m.__dict__ for m in messages if m]).encode())
        system.move(f"{name}.tmp", f"{name}.json")  # all of the write's files become visible at once

    def abort(self, messages: list[Written | None]) -> None:
        system, top = filesystem(self.path)
        for m in messages:
            if m:
                system.delete_file(f"{top}/{m.file}")
