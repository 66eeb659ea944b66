"""Schemas of the tables that jobs exchange."""

from __future__ import annotations

from pyspark.sql import types as T

CHAT_METADATA = T.StructType(
    [
        T.StructField("conversation_id", T.StringType()),
        T.StructField("rating", T.DoubleType()),
        T.StructField("title", T.StringType()),
        T.StructField("input_tokens_used", T.IntegerType()),
        T.StructField("output_tokens_used", T.IntegerType()),
    ]
)

CHAT_EVENT = T.StructType(
    [
        T.StructField("conversation_id", T.StringType()),
        T.StructField("turn_id", T.LongType()),
        T.StructField("seq", T.LongType()),
        T.StructField("status", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("metadata", CHAT_METADATA),
    ]
)

CHUNK_COLUMNS = [
    "chunk_id",
    "text",
    "name",
    "original_filename",
    "source_path",
    "source_dir",
    "source_ext",
    "parser",
    "category",
    "chunk_index",
    "n_chunks",
    "doc_sha",
    "headers",
    "section_type",
    "video_title",
    "extra",
]
