"""Discovery and reading of source files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill.functions import paths
from passagemill.functions.batches import bounded_batches
from passagemill.functions.text import decode_lenient
from passagemill.options import SKIP_DIRS, SUPPORTED_EXTENSIONS, IngestOptions
from passagemill.sources.tree import registered


def scan_tree(
    spark: SparkSession,
    root: str,
    extensions: tuple[str, ...] = SUPPORTED_EXTENSIONS,
    content: bool = True,
    hidden: bool = False,
) -> DataFrame:
    """Files below ``root`` with one of the suffixes in any case: ``path, modificationTime, length[, content]``.

    The suffixes are matched while listing, so no other file's bytes are read.  Folders are
    entered whatever their names; a file whose name starts with a dot counts only with ``hidden``.
    """
    return _tree(registered(spark).read, root, extensions, content, hidden)


def stream_tree(
    spark: SparkSession, root: str, extensions: tuple[str, ...] = SUPPORTED_EXTENSIONS, content: bool = True, hidden: bool = False
) -> DataFrame:
    """The same rows as a stream: files come when they are new or were changed."""
    return _tree(registered(spark).readStream, root, extensions, content, hidden)


def _tree(reader, root: str, extensions: tuple[str, ...], content: bool, hidden: bool) -> DataFrame:
    options = {"extensions": ",".join(extensions), "content": content, "hidden": hidden}
    return reader.format("tree").options(**options).load(root)


def write_files(files: DataFrame, root: str) -> int:
    """Write ``files(path, content)`` below ``root``, by tasks in parallel; paths are relative. Returns how many."""
    from passagemill.sources.tree import Rule

    bounded_batches(files.sparkSession)
    rule = Rule(root, (), True, False, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = rule.store()
        made: set[str] = set()
        for batch in batches:
            for at, body in zip(batch.column(0), batch.column(1)):
                path, body = at.as_py(), body.as_py()
                folder = f"{base}/{path}".rsplit("/", 1)[0]
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                with system.open_output_stream(f"{base}/{path}") as out:
                    out.write(body or b"")
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    return files.select("path", "content").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def discover(files: DataFrame, root: str, include_parsed: bool = False) -> DataFrame:
    """Files with a supported suffix, no dot name, and outside generated folders."""
    path = F.col("path")
    keep = paths.extension(path).isin(*SUPPORTED_EXTENSIONS) & ~paths.file_name(path).startswith(".")
    if not include_parsed:
        parts = F.split(paths.relative_path(path, root), "/")
        keep &= ~F.arrays_overlap(parts, F.array(*[F.lit(d) for d in SKIP_DIRS]))
    return files.where(keep)


def first_files(files: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` files in path order; 0 keeps all."""
    if not limit:
        return files
    return files.orderBy(paths.sort_key(F.col("path"))).limit(limit)


def read_text(files: DataFrame) -> DataFrame:
    """Text of ``.txt`` and ``.md`` files; other suffixes need a page or paragraph table."""
    return files.where(paths.extension(F.col("path")).isin(".txt", ".md")).withColumn(
        "text", decode_lenient(F.col("content"))
    )


def route(files: DataFrame, options: IngestOptions) -> DataFrame:
    return files.withColumn(
        "parser", paths.parser_route(paths.extension(F.col("path")), F.col("length"), options)
    )
