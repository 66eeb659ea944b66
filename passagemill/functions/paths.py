"""Path, category and parser expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from passagemill.options import IngestOptions

MIB = 1024 * 1024


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower-case suffix of the name; a leading dot alone is not a suffix."""
    return F.lower(F.regexp_extract(file_name(path), r"(?s)^.+(\.[^.]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?s)(?<=.)\.[^.]+$", "")


def relative_path(path: Column, root: str | None) -> Column:
    """Path under ``root``, or the whole path when it lies outside."""
    if root is None:
        return file_name(path)
    base = root.rstrip("/") + "/"
    return F.when(path.startswith(base), F.substring(path, len(base) + 1, 2**31 - 1)).otherwise(path)


def directory(path: Column) -> Column:
    cut = F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)
    return F.when(cut != "", cut).when(path.startswith("/"), F.lit("/")).otherwise(F.lit("."))


def category(path: Column, root: str | None, override: str | None = None) -> Column:
    """Override, else the first folder under the root, else the parent folder's name."""
    if override:
        return F.lit(override)
    parent = F.coalesce(F.get(F.reverse(F.split(path, "/")), F.lit(1)), F.lit(""))
    if root is None:
        return parent
    inside = path.startswith(root.rstrip("/") + "/")
    rel = relative_path(path, root)
    return F.when(inside & rel.contains("/"), F.substring_index(rel, "/", 1)).otherwise(parent)


def sort_key(path: Column) -> Column:
    """Orders paths component by component, as ``a/x`` comes before ``a-b/x``."""
    return F.translate(path, "/", "\u0001")


def parser_route(ext: Column, length: Column, options: IngestOptions) -> Column:
    """Which text route a file takes; null for an unsupported suffix."""
    if options.pdf_parser == "text":
        fast = F.lit(True)
    elif options.pdf_parser == "auto":
        fast = length >= options.fast_pdf_mb * MIB
    else:
        fast = F.lit(False)
    return (
        F.when((ext == ".pdf") & fast, "pymupdf-text")
        .when(ext == ".pdf", "pymupdf4llm")
        .when(ext.isin(".txt", ".md"), "text")
    )


def stamp_columns(path: Column, root: str | None) -> dict[str, Column]:
    """The path fields stamped on every chunk."""
    rel = relative_path(path, root)
    return {
        "name": file_name(path),
        "original_filename": file_name(path),
        "source_path": rel,
        "source_dir": directory(rel),
        "source_ext": extension(path),
    }
