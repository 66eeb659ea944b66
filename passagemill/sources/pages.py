"""Page tables and paragraph tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.functions import paths
from passagemill.functions.text import strip


def pages_to_markdown(pages: DataFrame) -> DataFrame:
    """One markdown text per file from ``(path, page_number, text)``.

    Blank pages leave no section; the page numbers come from the table, so they
    still count.  One shuffle, on the file.
    """
    body = strip(F.col("text"))
    section = F.when(
        body != "",
        F.struct(
            F.col("page_number"),
            F.concat(F.lit("## Page "), F.col("page_number").cast("string"), F.lit("\n\n"), body).alias("part"),
        ),
    )
    ordered = F.array_sort(F.collect_list(section))
    return (
        pages.groupBy("path")
        .agg(ordered.alias("parts"))
        .select(
            "path",
            F.array_join(
                F.concat(
                    F.array(F.concat(F.lit("# "), paths.stem(F.col("path")))),
                    F.transform("parts", lambda p: p["part"]),
                ),
                "\n\n",
            ).alias("text"),
        )
    )


def heading_level(style: Column) -> Column:
    """1..9 from a style name such as ``Heading 3``, else 0."""
    plain = F.lower(F.replace(F.coalesce(style, F.lit("")), F.lit(" "), F.lit("")))
    return F.coalesce(F.regexp_extract(plain, "^heading([1-9])$", 1).try_cast("int"), F.lit(0))


def paragraph_levels(styled: DataFrame) -> DataFrame:
    """``(path, para_index, style, text)`` as stripped, non-blank levelled paragraphs."""
    return (
        styled.withColumn("text", strip(F.col("text")))
        .where(F.col("text") != "")
        .select("path", "para_index", heading_level(F.col("style")).alias("level"), "text")
    )


def paragraphs_to_markdown(paragraphs: DataFrame) -> DataFrame:
    """Levelled paragraphs of a file as one markdown text."""
    line = F.when(
        F.col("level") > 0, F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), F.col("text"))
    ).otherwise(F.col("text"))
    ordered = F.array_sort(F.collect_list(F.struct("para_index", line.alias("line"))))
    return (
        paragraphs.groupBy("path")
        .agg(ordered.alias("rows"))
        .select("path", F.array_join(F.transform("rows", lambda r: r["line"]), "\n\n").alias("text"))
    )
