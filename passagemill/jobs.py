"""Whole jobs: ingest a corpus, prepare a batch of answers, measure recall."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagemill.functions import models, paths
from passagemill.functions.embed import embed_hashed
from passagemill.functions.prompts import question_prompt
from passagemill.functions.text import LOW_QUALITY, clean_text, is_low_quality, let, long_runs
from passagemill.operators import audit, chunking, context, evaluation, identity, retrieval, transcript
from passagemill.operators.carry import number_rows
from passagemill.options import (
    SUPPORTED_EXTENSIONS,
    IngestOptions,
    RetrievalOptions,
    TranscriptOptions,
)
from passagemill.sources import files as files_src
from passagemill.sources import pages as pages_src
from passagemill.sources import sinks

NO_USABLE_CHUNKS = "template docx produced no usable chunks"


@dataclass(frozen=True)
class IngestResult:
    """What a run gives back: audit records, and sample chunks of a dry run."""

    records: DataFrame
    sample: DataFrame | None


# -- texts ---------------------------------------------------------------


def hashed(files: DataFrame) -> DataFrame:
    """The files with ``doc_sha``: a given one stays, else it is taken of the raw ``content``, else of the text.

    A file without any of them counts as a content of its own.
    """
    if "doc_sha" in files.columns:
        return files
    own = F.sha2(F.concat(F.lit("path:"), F.col("path")).cast("binary"), 256)
    raw = "content" if "content" in files.columns else "text"
    return files.withColumn("doc_sha", F.coalesce(identity.content_sha(F.col(raw)), own))


def routed(files: DataFrame, options: IngestOptions) -> DataFrame:
    """The files with ``parser``: a given one stays, else the route of their suffix and size."""
    if "parser" in files.columns:
        return files
    size = next((F.col("length") if c == "length" else F.octet_length(c) for c in ("length", "content") if c in files.columns), F.octet_length("text"))
    return files.withColumn("parser", F.coalesce(paths.parser_route(paths.extension(F.col("path")), size, options), F.lit("text")))


def judged_files(kept: DataFrame, options: IngestOptions) -> DataFrame:
    """One row per file ``(path, doc_sha, parser, reason, chunks)``: each text is cleaned, gated and cut once."""
    ext = paths.extension(F.col("path"))

    def judge(raw: Column, runs: Column) -> Column:
        return let(
            clean_text(raw, runs),
            lambda t: F.struct(is_low_quality(t, ext, runs).alias("low"), t.alias("text"), runs.alias("runs")),
        )

    judged = let(F.coalesce("text", F.lit("")), lambda raw: let(long_runs(raw), lambda runs: judge(raw, runs)))
    cleaned = kept.select("path", "doc_sha", "parser", judged.alias("_judged"))
    accepted = cleaned.select(
        "path",
        "doc_sha",
        "parser",
        F.when(F.col("_judged.low"), F.lit(LOW_QUALITY)).alias("reason"),
        F.when(~F.col("_judged.low"), F.col("_judged.text")).alias("text"),
        F.col("_judged.runs").alias("_runs"),
    )
    return chunking.chunk_arrays(accepted, options).withColumnRenamed("_chunks", "chunks")


def settled(files: DataFrame, options: IngestOptions) -> tuple[DataFrame, DataFrame]:
    """``(kept, copies)`` of routed files: one pass hashes them and writes (path, doc_sha, parser), the next reads what is kept."""
    rows = routed(files, options)
    at = sinks.scratch_dir(files.sparkSession, "file-keys")
    rows.select("path", "doc_sha", "parser").write.parquet(at)
    keys = files.sparkSession.read.parquet(at)
    return identity.split_copies(rows, keys=keys)


def file_rows(files: DataFrame, options: IngestOptions = IngestOptions()) -> DataFrame:
    """``judged_files`` of the first file of each content, and the copies with their reason."""
    kept, copies = settled(files, options)
    judged = judged_files(kept, options)
    return judged.unionByName(copies.select("path", "doc_sha", "parser", "reason"), allowMissingColumns=True)


def chunk_rows(rows: DataFrame, root: str | None, options: IngestOptions) -> DataFrame:
    """Stamped chunks of file rows."""
    one = chunking.explode_once(rows.select("path", "doc_sha", "parser", "chunks"), "chunks", "chunk_index", "_chunk", count="n_chunks")
    flat = one.select("path", "doc_sha", "parser", "chunk_index", "n_chunks", "_chunk.headers", "_chunk.text")
    return chunking.stamp_chunks(flat, root, options.category, F.col("parser"))


def outcome_rows(rows: DataFrame, root: str | None, options: IngestOptions) -> DataFrame:
    """Every file with the reason why it is not in the corpus, null where it is."""
    path = F.col("path")
    return rows.select(
        "path",
        paths.file_name(path).alias("name"),
        paths.category(path, root, options.category).alias("category"),
        "doc_sha",
        "reason",
    )


def text_chunks(files: DataFrame, root: str | None, options: IngestOptions = IngestOptions()) -> DataFrame:
    """Stamped chunks of ``(path, text, doc_sha[, parser])`` texts."""
    return chunk_rows(file_rows(files, options), root, options)


def text_outcomes(files: DataFrame, root: str | None, options: IngestOptions = IngestOptions()) -> DataFrame:
    return outcome_rows(file_rows(files, options), root, options)


# -- transcript compilations ---------------------------------------------


def compilation_chunks(
    paragraphs: DataFrame,
    shas: DataFrame,
    root: str | None,
    options: IngestOptions = IngestOptions(),
    layout: TranscriptOptions = TranscriptOptions(),
) -> DataFrame:
    """Stamped chunks of a paragraph table: typed where the template fits, else by markdown.

    ``shas(path, doc_sha)`` names the content of every file.
    """
    kinds = transcript.detect_template(paragraphs)
    template = paragraphs.join(kinds.where("is_compilation"), "path", "left_semi")
    plain = paragraphs.join(kinds.where(~F.col("is_compilation")), "path", "left_semi")

    # The span of a chunk's place keeps each numbered group small.
    part = F.floor(F.col("chunk_start") / (layout.span * (1 << 20))).alias("part")
    typed = number_rows(
        transcript.typed_chunks(template, layout).select("*", part),
        ["path"],
        ["block_start", "section_rank", "part"],
        ["chunk_start"],
        "chunk_index",
        "n_chunks",
    ).select("path", "chunk_index", "n_chunks", "headers", "text", "section_type", "video_title")
    accepted, _ = chunking.gate(pages_src.paragraphs_to_markdown(plain), F.lit(".docx"))
    by_markdown = chunking.chunk_documents(accepted, options)
    both = typed.withColumn("parser", F.lit("docx-structured")).unionByName(
        by_markdown.withColumn("parser", F.lit("docx-markdown")), allowMissingColumns=True
    )
    stamped = both.join(shas.select("path", "doc_sha"), "path")
    return chunking.stamp_chunks(stamped, root, options.category, F.col("parser"))


def compilation_outcomes(paragraphs: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(path, reason)`` of a paragraph table's files, given the chunks made of them."""
    kinds = transcript.detect_template(paragraphs)
    made = chunks.select("path").distinct().withColumn("made", F.lit(True))
    texts = pages_src.paragraphs_to_markdown(
        paragraphs.join(kinds.where(~F.col("is_compilation")), "path", "left_semi")
    ).select("path", chunking.low_quality_reason(F.col("text"), F.lit(".docx")).alias("low"))
    unusable = F.when(F.col("is_compilation") & F.col("made").isNull(), NO_USABLE_CHUNKS)
    return kinds.join(made, "path", "left").join(texts, "path", "left").select(
        "path", F.coalesce("low", unusable).alias("reason")
    )


# -- the ingestion run ---------------------------------------------------


def ingest(
    files: DataFrame,
    target: str,
    root: str | None = None,
    options: IngestOptions = IngestOptions(),
    drop_old: bool = False,
    embed: Callable[[DataFrame], DataFrame] = embed_hashed,
    manifest: str | None = None,
    pages: DataFrame | None = None,
    paragraphs: DataFrame | None = None,
    encoder: Callable[[], models.Encoder] | None = None,
) -> IngestResult:
    """Ingest files into an embedded chunk table.

    Vectors come from ``embed``, or from the model that ``encoder`` makes, called with
    ``options.embed_batch`` texts at a time.

    ``files(path, text[, content | doc_sha][, length][, parser])`` lists all files of the run;
    ``pages(path, page_number, text)`` and ``paragraphs(path, para_index, level, text)``
    hold the bodies of those whose text is null.  Copies are told by raw content over all
    kinds of files together.

    Each text is cleaned, gated and cut once into a staged row of its file, from which chunks,
    records and statistics are read; a failed embedding starts from there.  A dry run stages
    and reports, and leaves the target alone.
    """
    spark = files.sparkSession
    started = datetime.now(timezone.utc)
    embedder = getattr(encoder or embed, "__name__", type(encoder or embed).__name__)
    if encoder is not None:
        embed = partial(models.encoded, make=encoder, batch=options.embed_batch)
    if options.limit:
        chosen = files_src.first_files(files.select("path"), options.limit)
        files = files.join(F.broadcast(chosen), "path", "left_semi")  # options.limit rows
    inputs = hashed(files)
    if pages is not None:
        bodies = pages_src.pages_to_markdown(pages).select("path", F.col("text").alias("_body"))
        inputs = inputs.join(bodies, "path", "left").withColumn("text", F.coalesce("text", "_body")).drop("_body")
    kept, copies = settled(inputs, options)
    staged = sinks.scratch_dir(spark, "staged-files")
    typed = F.lit(False) if paragraphs is None else (paths.extension(F.col("path")) == ".docx") & F.col("text").isNull()
    judged = judged_files(kept.where(~typed), options)
    judged.unionByName(copies.select("path", "doc_sha", "parser", "reason"), allowMissingColumns=True).write.parquet(staged)
    rows = spark.read.parquet(staged)
    chunks, told = chunk_rows(rows, root, options), outcome_rows(rows, root, options)
    if paragraphs is not None:
        shas = kept.where(typed).select("path", "doc_sha")
        bodies = paragraphs.join(shas.select("path"), "path", "left_semi")
        made = sinks.scratch_dir(spark, "staged-compilations")
        compilation_chunks(bodies, shas, root, options).write.parquet(made)
        more = spark.read.parquet(made)
        reasons = shas.join(compilation_outcomes(bodies, more), "path", "left")
        chunks = chunks.unionByName(more, allowMissingColumns=True)
        told = told.unionByName(outcome_rows(reasons, root, options))
    if chunks.isEmpty():
        raise ValueError("no chunks produced.")
    stats = audit.corpus_stats(chunks)
    records = sinks.scratch_dir(spark, "file-records")
    audit.file_summary(told, chunks, root).write.parquet(records)

    if not options.dry_run:
        sinks.write_chunks(embed(chunks), target, drop_old)
        stats = stats.withColumn("chunks_written", F.col("chunks"))
    run = {
        "started_at": started.isoformat(),
        "finished_at": datetime.now(timezone.utc).isoformat(),
        "dry_run": options.dry_run,
        "source": {
            "root": root,
            "include_parsed": options.include_parsed,
            "supported_extensions": list(SUPPORTED_EXTENSIONS),
        },
        "target": {
            "table": target,
            "drop_old": drop_old,
            "embedder": embedder,
            "embed_batch": options.embed_batch,
        },
        "chunking": {
            "chunk_size": options.chunk_size,
            "overlap": options.overlap,
            "pdf_parser": options.pdf_parser,
            "fast_pdf_mb": options.fast_pdf_mb,
        },
    }
    records = audit.manifest_records(spark.read.parquet(records), stats, run)
    if manifest:
        sinks.write_manifest(records, manifest)
    return IngestResult(records, audit.sample_chunks(chunks, options.sample) if options.dry_run else None)


# -- answering and evaluating --------------------------------------------

SOURCE_FIELDS = ["name", "original_filename", "headers", "text"]


def contexts(
    queries: DataFrame,
    collection: DataFrame,
    options: RetrievalOptions = RetrievalOptions(),
    replies: DataFrame | None = None,
    sources: DataFrame | None = None,
) -> DataFrame:
    """``(qid, context)`` for ``queries(qid, embedding)``.

    ``collection`` holds ``chunk_id`` (long), ``embedding`` and the source fields; where these lie
    in another table, ``sources(chunk_id, ...)`` has them and is met by the winners only.
    """
    vectors = collection.select("chunk_id", "embedding")
    ranked = retrieval.retrieve(queries, vectors, options, replies).select("qid", "rank", "chunk_id")
    bound = retrieval.rows_bound(queries, options.top_k, options)
    return context.build_context(queries, retrieval.attach(ranked, collection if sources is None else sources, SOURCE_FIELDS, bound))


def recall_evaluation(
    sample: DataFrame, questions: DataFrame, found: Callable[[DataFrame], DataFrame]
) -> tuple[DataFrame, DataFrame]:
    """``(details, summary)`` of a recall run.

    ``sample(pk, text, source)`` are evaluation chunks, ``questions(pk, question)`` what
    a model asked about them (null where it failed), and ``found`` turns
    ``(qid, question)`` rows into ``(qid, context)``.
    """
    items = sample.join(questions, "pk", "left").withColumn("qid", F.col("pk"))
    asked = items.where(F.col("question").isNotNull()).select("qid", "question")
    details = evaluation.recall_hits(items, found(asked))
    return details, evaluation.recall_rate(details)


def generated_recall(
    sample: DataFrame,
    make: Callable[[], models.Chat],
    found: Callable[[DataFrame], DataFrame],
    in_flight: int = 8,
    retries: int = 2,
    wait_s: float = 0.5,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(details, summary, failures)``: a recall run whose questions a model writes from the sampled chunks.

    The replies are written once, as asking again may give others.  A chunk for which the
    model failed is not asked about and lowers ``total``; ``failures(pk, failure)`` names it.
    """
    spark = sample.sparkSession
    path = sinks.scratch_dir(spark, "questions")
    prompts = sample.select("pk", question_prompt(F.col("text")).alias("prompt"))
    models.answered(prompts, make, in_flight=in_flight, retries=retries, wait_s=wait_s).write.parquet(path)
    replies = spark.read.parquet(path)
    details, summary = recall_evaluation(sample, replies.select("pk", F.col("reply").alias("question")), found)
    return details, summary, replies.where("reply is null").select("pk", "failure")
