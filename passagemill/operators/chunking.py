"""Header-aware sectioning and size-bounded chunking of markdown text.

The whole chain is map-only: a document's sections, pieces and chunk numbers are
built inside its own row and exploded at the end, so no text is shuffled.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagemill.functions import paths
from passagemill.functions.batches import bounded_batches
from passagemill.functions.text import LOW_QUALITY, SPACES, clean_text, is_low_quality, keep_part, let, strip
from passagemill.options import IngestOptions

# Break points tried in this order.
SEPARATORS = ("\n\n", "\n", ". ", " ", "")

LEVELS = 4
_MARK = chr(0xFDD0)  # a Unicode non-character: never part of interchanged text
_SPACES_IN_LINE = SPACES.replace("\n", "")
_PATH = T.ArrayType(T.StringType())
_SECTIONS = T.ArrayType(
    T.StructType([T.StructField("headers", _PATH), T.StructField("text", T.StringType())])
)


def _tidy(text: Column) -> Column:
    """Every line stripped."""
    return F.array_join(F.transform(F.split(text, "\n"), lambda line: F.trim(line, F.lit(_SPACES_IN_LINE))), "\n")


def _marked(tidy: Column) -> Column:
    """Put a mark before every header line that lies outside fenced code; a line break comes before the first line."""
    # Splitting before each fence line puts fenced code at the odd places; the
    # leading line break keeps the first place outside.
    runs = F.split(tidy, r"(?md)^(?=```|~~~)")
    header = rf"(?md)^(#{{1,{LEVELS}}}(?: .*)?)$"
    return F.array_join(
        F.transform(
            runs,
            lambda run, i: F.when(i % 2 == 0, F.regexp_replace(run, header, f"{_MARK}$1")).otherwise(run),
        ),
        "",
    )


def header_sections(text: Column) -> Column:
    """``array<struct<headers array<string>, text>>``: maximal runs under one header path.

    ``headers`` has four places, null where no header of that level is open.  A
    header closes the deeper ones and its line stays in the text.
    """
    return _sectioner()(_header_pieces(text))


def _header_pieces(text: Column) -> Column:
    """The stripped pieces of a text that is split before its headers; one without any is one piece."""

    def pieces(tidy: Column) -> Column:
        whole = ~tidy.contains("\n#") & ~tidy.contains(_MARK)
        return F.when(whole, F.array(strip(tidy))).otherwise(F.transform(F.split(_marked(tidy), _MARK), strip))

    return let(F.concat(F.lit("\n"), _tidy(text)), pieces)


_HEADER = re.compile(rf"(#{{1,{LEVELS}}})(?: |\n|\Z)([^\n]*)")


def sections_of(pieces: list[str]) -> list[dict]:
    """Sections of a text that was split before its headers; one walk, whatever their number."""
    out: list[dict] = []
    if pieces[0]:
        out.append({"headers": [None] * LEVELS, "texts": [pieces[0]]})
    headed, path = len(out), [None] * LEVELS
    for piece in pieces[1:]:
        mark = _HEADER.match(piece)
        level = len(mark[1]) if mark else 0
        if mark:
            path = [*path[: level - 1], mark[2].strip(), *[None] * (LEVELS - level)]
        if len(out) > headed and out[-1]["headers"] == path:
            out[-1]["texts"].append(piece)
        else:
            out.append({"headers": path, "texts": [piece]})
    return [{"headers": s["headers"], "text": "\n".join(s["texts"])} for s in out]


def _sectioner():
    """Arrow function ``array<string>`` (pieces) -> sections; not repeated or copied by the optimizer."""

    @F.arrow_udf(_SECTIONS)
    def run(pieces: pa.Array) -> pa.Array:
        rows = [None if row is None else sections_of(row) for row in pieces.to_pylist()]
        kind = pa.struct([("headers", pa.list_(pa.string())), ("text", pa.string())])
        return pa.array(rows, pa.list_(kind))

    return run.asNondeterministic()


def _pieces(text: str, size: int, seps: tuple[str, ...]) -> Iterator[tuple[str, bool]]:
    """Break at the first separator present; yield ``(piece, still too long)``.  The pieces make up the text."""
    at = next(i for i, sep in enumerate(seps) if sep in text)
    sep, rest = seps[at], seps[at + 1 :]
    parts = [p if i == 0 else sep + p for i, p in enumerate(text.split(sep))]
    for part in filter(None, parts):
        yield part, len(part) >= size and bool(rest)


def _merge(lengths: list[int], at: int, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Spans of neighbouring pieces, of which the first starts ``at``."""
    window: deque[int] = deque()
    total = 0
    for length in lengths:
        if window and total + length > size:
            yield at, at + total
            while window and (total > overlap or total + length > size):
                at += window[0]
                total -= window.popleft()
        window.append(length)
        total += length
    if window:
        yield at, at + total


def _cut(text: str, at: int, size: int, overlap: int, seps: tuple[str, ...]) -> Iterator[tuple[int, int]]:
    """Spans, blank ends included, of a text that starts ``at``."""
    first = next(i for i, sep in enumerate(seps) if sep in text)
    if seps[first] == "":  # nothing to break at: windows of equal length
        step = size - min(overlap, size - 1)
        for i in range(0, max(len(text) - size, 0) + step, step):
            yield at + i, at + min(i + size, len(text))
        return
    short: list[int] = []
    from_ = at
    for piece, too_long in _pieces(text, size, seps):
        if too_long:
            yield from _merge(short, from_, size, overlap)
            yield from _cut(piece, at, size, overlap, seps[first + 1 :])
            short, from_ = [], at + len(piece)
        else:
            short.append(len(piece))
        at += len(piece)
    yield from _merge(short, from_, size, overlap)


def split_spans(text: str, size: int, overlap: int, seps: tuple[str, ...] = SEPARATORS) -> Iterator[tuple[int, int]]:
    """Where the stripped parts of a section start and end, of at most ``size`` code points each."""
    for start, end in _cut(text, 0, size, overlap, seps):
        part = text[start:end]
        start += len(part) - len(part.lstrip())
        end = start + len(part.strip())
        if start < end:
            yield start, end


def split_to_size(text: str, size: int, overlap: int, seps: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Cut one section into stripped parts of at most ``size`` code points."""
    return [text[start:end] for start, end in split_spans(text, size, overlap, seps)]


def size_splitter(size: int, overlap: int):
    """Arrow function ``array<string>`` (sections) -> ``array<array<string>>`` (their parts).

    Greedy cutting is sequential within one section; rows are cut in parallel.
    """

    @F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
    def run(sections: pd.Series) -> pd.Series:
        return pd.Series([[] if row is None else [split_to_size(s, size, overlap) for s in row] for row in sections])

    # Marked nondeterministic so that the optimizer neither repeats the call nor
    # copies it into the filter it derives for the explode.
    return run.asNondeterministic()


def section_cutter(size: int, overlap: int):
    """Arrow function ``array<string>`` (pieces) -> ``(headers, text)`` of the parts of all sections; none for a null.

    Sectioning and cutting share one worker, and a section's text does not go back and forth between them.
    """

    @F.arrow_udf(_SECTIONS)
    def run(pieces: pa.Array) -> pa.Array:
        rows = [
            [{"headers": s["headers"], "text": part} for s in sections_of(row.as_py()) for part in split_to_size(s["text"], size, overlap)]
            if row.is_valid
            else []
            for row in pieces
        ]
        return pa.array(rows, pa.list_(pa.struct([("headers", pa.list_(pa.string())), ("text", pa.string())])))

    return run.asNondeterministic()


def explode_once(df: DataFrame, array: str, place: str, item: str, count: str | None = None) -> DataFrame:
    """Explode an array column that was costly to make.

    A plain explode makes the optimizer derive ``size(array) > 0`` and move it below
    the projection, where the array is made again; the outer form does not.
    """
    rest = [c for c in df.columns if c != array]
    sizes = [] if count is None else [F.size(array).alias(count)]
    return df.select(*rest, *sizes, F.posexplode_outer(array).alias(place, item)).where(F.col(place).isNotNull())


def chunk_arrays(docs: DataFrame, options: IngestOptions = IngestOptions()) -> DataFrame:
    """The rows with ``_chunks`` in place of ``text``: an array of kept ``(headers, text)``, empty for a null text.

    A column ``_runs`` tells ``text.long_runs`` where it is known already.
    """
    bounded_batches(docs.sparkSession)
    cut = section_cutter(options.chunk_size, options.overlap)
    rest = [c for c in docs.columns if c not in ("text", "_runs")]
    known = [c for c in docs.columns if c == "_runs"]
    parted = docs.select(*rest, *known, cut(_header_pieces(F.col("text"))).alias("_parts"))
    runs = F.col("_runs") if known else None
    return parted.select(*rest, F.filter("_parts", lambda c: keep_part(c["text"], runs)).alias("_chunks"))


def chunk_documents(docs: DataFrame, options: IngestOptions = IngestOptions()) -> DataFrame:
    """Explode ``text`` into kept chunks: adds ``chunk_index, n_chunks, headers`` and the chunk ``text``.

    The number of chunks is the size of the row's own array, so neither the index
    nor the count needs a window.
    """
    rest = [c for c in docs.columns if c != "text"]
    numbered = explode_once(chunk_arrays(docs, options), "_chunks", "chunk_index", "_chunk", count="n_chunks")
    return numbered.select(*rest, "chunk_index", "n_chunks", "_chunk.headers", "_chunk.text")


def low_quality_reason(text: Column, ext: Column) -> Column:
    """Why a raw text is turned away after cleaning, or null."""
    return F.when(is_low_quality(clean_text(text), ext), F.lit(LOW_QUALITY))


def gate(docs: DataFrame, ext: Column) -> tuple[DataFrame, DataFrame]:
    """``(accepted, rejected)``: cleaned documents, and ids with a reason for the others.

    Exploding a list of one or none instead of filtering keeps the optimizer from
    cleaning every text a second time inside a filter it has moved down.
    """
    rest = [c for c in docs.columns if c != "text"]
    none = F.array().cast("array<string>")
    passed = let(clean_text(F.col("text")), lambda t: F.when(is_low_quality(t, ext), none).otherwise(F.array(t)))
    reason = low_quality_reason(F.col("text"), ext)
    accepted = docs.select(*rest, F.explode(passed).alias("text"))
    rejected = docs.select(*rest, F.explode(F.filter(F.array(reason), lambda r: r.isNotNull())).alias("reason"))
    return accepted, rejected


def chunk_id(doc_sha: Column, index: Column) -> Column:
    """Stable id, so that a repeated run writes the same keys."""
    return F.sha2(F.concat_ws("|", doc_sha, index.cast("string")), 256)


def stamp_chunks(
    chunks: DataFrame, root: str | None, category: str | None = None, parser: Column | None = None
) -> DataFrame:
    """Add path fields, category and ids to chunks that carry ``path`` and ``doc_sha``."""
    path = F.col("path")
    out = chunks.withColumns(paths.stamp_columns(path, root))
    out = out.withColumn("category", paths.category(path, root, category))
    out = out.withColumn("parser", F.lit("text") if parser is None else parser)
    for name, kind in (("section_type", "string"), ("video_title", "string"), ("extra", "map<string,string>")):
        if name not in out.columns:
            out = out.withColumn(name, F.lit(None).cast(kind))
    return out.withColumn("chunk_id", chunk_id(F.col("doc_sha"), F.col("chunk_index")))
