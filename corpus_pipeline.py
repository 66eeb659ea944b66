"""From raw documents to training sequences: five stages, each one operator of ``passagemill.llm``.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read
again as the next stage's documents.  All but the last return the columns of documents.

* quality: documents that the classifier rejects go.
* near duplicates: of each component of documents that share four fifths of their five-word
  shingles the one with the smallest id stays.
* decontamination: words of benchmark passages are cut out; a document left without words goes.
* mixing: rows repeat or go so that each source's words come to its target.
* output: sequences of token ids in training order.

Null texts and ids, empty and very long texts, repeated rows and empty tables have the
results that the operators state.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from passagemill.llm import common, decontaminate, mixing, ngram_join, quality, training_order


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


NEAR = ngram_join.JoinOptions(width=5, percent=80)  # op5's contract has three words and nine tenths


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs, NEAR)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.cleaned(docs, _table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def write_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return training_order.training_order(docs)


_scratch: list[str] = []  # staged tables of the stages called so far


def _tidy(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that first deletes what earlier ones staged: their results are written by then.

    Tables that ``docs`` still reads, as it may if it was not written, stay.
    """

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _scratch[:] = common.drop_tables(spark, _scratch, unless_read_by=docs)
        with common.noted_tables() as made:
            result = stage(spark, docs, sf_dir)
        _scratch.extend(made)
        return result

    return run_stage


STAGES = [
    ("quality classifier", _tidy(accept_quality)),
    ("n-gram jaccard join", _tidy(drop_near_duplicates)),
    ("benchmark decontamination", _tidy(cut_benchmark)),
    ("mixing sources", _tidy(mix_sources)),
    ("token-id output", _tidy(write_sequences)),
]

ORACLE_SQL = None  # trees, tokenizer and permutation have no SQL; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = _table(spark, sf_dir, "documents"), []
    for k, (_, stage) in enumerate(STAGES):
        if k:
            with common.noted_tables() as made:
                docs = common.staged(docs)
            held = common.drop_tables(spark, held) + made  # what the stage before read
        docs = stage(spark, docs, sf_dir)
    return docs
