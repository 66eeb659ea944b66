"""Options of the ingestion and retrieval jobs, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass, field

# What a corpus run accepts and skips.
SUPPORTED_EXTENSIONS = (".docx", ".md", ".pdf", ".txt")
SKIP_DIRS = ("parsed", "sample_set")
RERANK_BACKENDS = ("none", "mmr", "llm")


@dataclass(frozen=True)
class IngestOptions:
    chunk_size: int = 1800
    overlap: int = 250
    embed_batch: int = 256
    pdf_parser: str = "auto"
    fast_pdf_mb: int = 15
    include_parsed: bool = False
    limit: int = 0
    category: str | None = None
    dry_run: bool = False
    sample: int = 3


@dataclass(frozen=True)
class RetrievalOptions:
    top_k: int = 10
    fetch_k: int = 40
    mmr_lambda: float = 0.5
    rerank_backend: str | None = "none"
    # So many queries are shipped to every task at once; a larger batch is taken
    # block by block.
    max_broadcast_queries: int = 1024

    @property
    def backend(self) -> str:
        name = (self.rerank_backend or "none").strip().lower()
        return name if name in RERANK_BACKENDS else "none"

    @property
    def candidate_k(self) -> int:
        return max(self.fetch_k, self.top_k)


@dataclass(frozen=True)
class PackRule:
    target: int
    cap: int


@dataclass(frozen=True)
class TranscriptOptions:
    """Chunk size targets per section type; the cap defaults to 1.5 targets."""

    rules: dict[str, PackRule] = field(
        default_factory=lambda: {
            "summary": PackRule(1300, 1950),
            "qa": PackRule(1100, 1650),
            "terminology": PackRule(1200, 1800),
            "body": PackRule(1300, 1950),
            "transcript": PackRule(1400, 2000),
        }
    )
    min_alnum: int = 60
    # Full-width colons are not accepted in speaker markers unless asked for.
    speaker_colons: str = ":"
    # Running state is computed per span of this many paragraph positions, so a
    # file of any length is spread over many tasks.
    span: int = 100_000
