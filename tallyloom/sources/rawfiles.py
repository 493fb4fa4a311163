"""A data source writer of raw outputs, one file a record: rows.write.format("rawfiles").mode("append").save(folder).

Rows are (name string, value string), as sinks.raw_records makes them. A task writes each record to a hidden file of its own and lists what it wrote; only when all tasks are done are the files given their names, each by one rename. A reader so never sees half a file. Tasks that were killed, and attempts that lost, leave hidden files, which the commit or the abort of the job removes. Of records of one name the last one named stays. Names are file names without a path; files can be read by their owner alone. The folder is one of a file system that all machines have mounted.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from tallyloom.sources import sinks


@dataclass
class Written(WriterCommitMessage):
    """Where a task has listed its files."""

    listing: str


class RawWriter(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder, self.job = folder, uuid.uuid4().hex

    def _hidden(self) -> str:
        return os.path.join(self.folder, f".{self.job}-{uuid.uuid4().hex}")

    def _put(self, path: str, data: bytes) -> None:
        with os.fdopen(os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY, 0o600), "wb") as out:
            out.write(data)

    def write(self, rows: Iterator[Row]) -> Written:
        os.makedirs(self.folder, exist_ok=True)
        listing, listed = self._hidden(), []
        for row in rows:
            if not row.name or os.path.basename(row.name) != row.name or row.name.startswith("."):
                raise ValueError(f"not a file name: {row.name!r}")
            path = self._hidden()
            self._put(path, (row.value or "").encode("utf-8", "surrogatepass"))
            listed.append(f"{os.path.basename(path)} {row.name}\n")
        self._put(listing, "".join(listed).encode())
        return Written(listing)

    def commit(self, messages: list[Written | None]) -> None:
        for message in messages:
            if message is not None:
                with open(message.listing, encoding="utf-8") as listed:
                    for line in listed:
                        hidden, name = line.rstrip("\n").split(" ", 1)
                        os.replace(os.path.join(self.folder, hidden), os.path.join(self.folder, name))
        self._sweep()

    def abort(self, messages: list[Written | None]) -> None:
        self._sweep()

    def _sweep(self) -> None:
        if os.path.isdir(self.folder):
            for e in os.scandir(self.folder):
                if e.name.startswith(f".{self.job}-"):
                    os.unlink(e.path)


class RawFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rawfiles"

    def schema(self) -> str:
        return "name string, value string"

    def writer(self, schema, overwrite: bool) -> RawWriter:
        if overwrite:
            raise ValueError("raw outputs are only added")
        return RawWriter(self.options["path"])


def write_raw(records: DataFrame, folder: str, keep: int = sinks.KEPT_RAW) -> None:
    """Writes raw outputs (name, time, value), then lets all but the newest of the folder go, by the time and the order that their names begin with."""
    records.sparkSession.dataSource.register(RawFiles)
    records.select("name", "value").write.format("rawfiles").mode("append").save(folder)
    retain_raw(folder, keep)


def retain_raw(folder: str, keep: int = sinks.KEPT_RAW) -> list[str]:
    """Removes all but the newest `keep` raw outputs of a folder; gives their names."""
    if not os.path.isdir(folder):
        return []
    age = lambda name: (int(name.split("_")[0]) if name.split("_")[0].isdigit() else 0, name)
    names = sorted((e.name for e in os.scandir(folder) if e.name.endswith(".log") and not e.name.startswith(".")), key=age)
    gone = names[: max(0, len(names) - keep)]
    for name in gone:
        os.unlink(os.path.join(folder, name))
    return gone
