"""Embedding expressions and the pluggable embedder."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagemill.functions.batches import bounded_batches
from passagemill.functions.text import SPACE, let

HASH_DIM = 64


def word_bucket_counts(text: Column, dim: int = HASH_DIM) -> Column:
    """How many words of the text fall in each of ``dim`` md5 buckets, for any ``dim`` up to 65,536.

    Bucket numbers are made inside the JVM; a batch of texts is counted at once.
    A null text has no words.
    """
    if not 1 <= dim <= 1 << 16:
        raise ValueError("a bucket is named by two bytes of the word's md5")
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), f"{SPACE}+"), lambda w: w != "")
    codes = F.transform(
        words, lambda w: F.conv(F.substring(F.md5(w.cast("binary")), 1, 4), 16, 10).cast("int") % dim
    )

    @F.arrow_udf("array<double>")
    def counts(batch: pa.Array) -> pa.Array:
        sizes = pc.list_value_length(batch).to_numpy(zero_copy_only=False)
        rows = np.repeat(np.arange(len(batch)), sizes)
        table = np.bincount(rows * dim + batch.flatten().to_numpy(), minlength=len(batch) * dim)
        ends = np.arange(len(batch) + 1, dtype=np.int32) * dim
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(table.astype(float)))

    return counts(codes)


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x * x))


def unit(vector: Column) -> Column:
    """L2-normalised vector; the zero vector stays zero."""

    def scaled(v: Column) -> Column:
        return let(norm(v), lambda size: F.transform(v, lambda x: F.when(size > 0, x / size).otherwise(F.lit(0.0))))

    return let(vector, scaled)


def embed_hashed(df: DataFrame, text: str = "text", output: str = "embedding", dim: int = HASH_DIM) -> DataFrame:
    """Offline default embedder: bag of hashed words."""
    bounded_batches(df.sparkSession)
    return df.withColumn(output, word_bucket_counts(F.col(text), dim))


def embedder(fn: Callable[[list[str]], list[list[float]]], batch: int = 256) -> Callable[[Column], Column]:
    """Wrap a batch model ``texts -> vectors`` as an Arrow function of a column.

    A call has at most ``batch`` texts of one Arrow batch; ``models.encoded`` fills calls up
    across Arrow batches.
    """

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(texts: pd.Series) -> pd.Series:
        rows = texts.fillna("").tolist()
        vectors: list[list[float]] = []
        for at in range(0, len(rows), batch):
            vectors.extend(fn(rows[at : at + batch]))
        return pd.Series(vectors)

    return run
