"""Folders as a Spark data source: files listed, and read if asked, by tasks in parallel.

Spark's own listing leaves out every file and folder whose name starts with ``_`` or ``.``.
This source goes by its own rule: all folders count, files whose name starts with a dot only
with ``hidden``.  The driver opens folders only until there are enough to share out; tasks
walk the rest.  As a stream it gives files by their modification time, so nothing has to be
remembered but the time of the last batch.

Roots are paths or URIs of any file system that Arrow can open (local, S3, GCS, HDFS).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

LISTED = "path string, modificationTime timestamp, length long"
READ = LISTED + ", content binary"
BATCH_FILES, BATCH_BYTES = 1_000, 4 << 20  # of one Arrow batch, whichever comes first
SETTLE_MS = 1_000  # a stream leaves files younger than this to its next batch


@dataclass
class Share(InputPartition):
    """Folders that one task walks, and single files beside them; only those modified in (after, until]."""

    folders: tuple[str, ...]
    files: tuple[str, ...]
    after: int = -1
    until: int = 1 << 62


@dataclass(frozen=True)
class Rule:
    root: str
    extensions: tuple[str, ...]
    hidden: bool
    content: bool
    shares: int

    @classmethod
    def of(cls, options) -> Rule:
        on = lambda name: str(options.get(name, "false")).lower() == "true"
        extensions = tuple(e.lower() for e in options.get("extensions", "").split(",") if e)
        return cls(options["path"], extensions, on("hidden"), on("content"), int(options.get("shares", "64")))

    def wants(self, name: str) -> bool:
        if name.startswith(".") and not self.hidden:
            return False
        return not self.extensions or name.lower().endswith(self.extensions)

    def store(self):
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(self.root if "://" in self.root or self.root.startswith("file:") else f"file://{self.root}")
        return system, path.rstrip("/") or "/"

    def children(self, system, folder: str) -> tuple[list[str], list]:
        """Folders and wanted files right below a folder; one that has gone meanwhile has none."""
        from pyarrow import fs

        found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        folders = [x.path for x in found if x.type == fs.FileType.Directory]
        return folders, [x for x in found if x.type == fs.FileType.File and self.wants(x.base_name)]

    def shared_out(self, after: int = -1, until: int = 1 << 62) -> list[Share]:
        """Opens folders, level by level, until there are a few for each share."""
        system, path = self.store()
        level, files = [path], []
        while level and len(level) < 2 * self.shares:
            below: list[str] = []
            for folder in level:
                folders, own = self.children(system, folder)
                below += folders
                files += [x.path for x in own]
            level = below
        n = max(1, min(self.shares, len(level) + len(files)))
        level.sort(), files.sort()
        return [Share(tuple(level[k::n]), tuple(files[k::n]), after, until) for k in range(n)]

    def rows(self, share: Share) -> Iterator[tuple]:
        system, _ = self.store()
        waiting = list(share.folders)
        yield from self.given(system, [x for k in range(0, len(share.files), 1000) for x in system.get_file_info(list(share.files[k : k + 1000]))], share)
        while waiting:
            folders, files = self.children(system, waiting.pop())
            waiting += folders
            yield from self.given(system, files, share)

    def given(self, system, files: list, share: Share) -> Iterator[tuple]:
        from pyarrow import fs

        for x in files:
            if x.type != fs.FileType.File or not share.after < x.mtime_ns // 1_000_000 <= share.until:
                continue
            when = datetime.fromtimestamp(x.mtime_ns // 1_000 / 1e6, timezone.utc)
            if self.content:
                with system.open_input_stream(x.path) as body:
                    yield x.path, when, x.size, body.read()
            else:
                yield x.path, when, x.size


def batches(rows: Iterator[tuple], content: bool):
    """Arrow batches of the rows; one has few files or few bytes, as a file may be of any size."""
    import pyarrow as pa

    fields = [("path", pa.string()), ("modificationTime", pa.timestamp("us", "UTC")), ("length", pa.int64()), *([("content", pa.binary())] if content else [])]
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += row[2] if content else 0
        if len(held) >= BATCH_FILES or size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(zip(*held), fields)], schema=pa.schema(fields))
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(zip(*held), fields)], schema=pa.schema(fields))


class TreeReader(DataSourceReader):
    def __init__(self, rule: Rule):
        self.rule = rule

    def partitions(self) -> list[Share]:
        return self.rule.shared_out()

    def read(self, partition: Share):
        return batches(self.rule.rows(partition), self.rule.content)


class TreeStream(DataSourceStreamReader):
    def __init__(self, rule: Rule):
        self.rule = rule

    def initialOffset(self) -> dict:
        return {"until": -1}

    def latestOffset(self) -> dict:
        return {"until": int(datetime.now(timezone.utc).timestamp() * 1000) - SETTLE_MS}

    def partitions(self, start: dict, end: dict) -> list[Share]:
        return self.rule.shared_out(start["until"], end["until"])

    def read(self, partition: Share) -> Iterator[tuple]:
        return self.rule.rows(partition)

    def commit(self, end: dict) -> None:
        pass


class TreeSource(DataSource):
    """Options: ``path``, ``extensions`` (with commas), ``hidden``, ``content``, ``shares`` (tasks of a listing)."""

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return READ if Rule.of(self.options).content else LISTED

    def reader(self, schema) -> TreeReader:
        return TreeReader(Rule.of(self.options))

    def streamReader(self, schema) -> TreeStream:
        return TreeStream(Rule.of(self.options))


def registered(spark: SparkSession) -> SparkSession:
    """The session, knowing ``spark.read.format("tree")`` and ``spark.readStream.format("tree")``."""
    spark.dataSource.register(TreeSource)
    return spark
