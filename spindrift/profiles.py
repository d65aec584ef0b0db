"""The two sets of search semantics, as data."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Profile:
    """How a search ranks, fuses and expands."""

    name: str
    top_k: int
    vector_weight: float
    lexical: str  # bm25 over words, or coverage of stems
    metric: str  # l2 or cosine
    vector_filter: str  # after the nearest five times limit, or before
    neighbours: str  # interleaved or appended
    rrf_k: int = 60
    max_df: float | None = None  # share of chunks above which a term is too frequent to search for
    candidates: int = 40
    window: int = 1
    block_chars: int = 8_000
    context_chars: int = 60_000


SQLITE = Profile("sqlite", 12, 1.0, "bm25", "l2", "after", "interleaved")
#: The cut of 10,000 chunks holds for a store of 416,837.
POSTGRES = Profile("postgres", 20, 1.5, "coverage", "cosine", "before", "appended", max_df=10_000 / 416_837)
PROFILES = {p.name: p for p in (SQLITE, POSTGRES)}

#: Sizes of chunks in characters: aimed at, carried over, least.
CHUNK_TARGET, CHUNK_OVERLAP, CHUNK_MIN = 1200, 200, 120
#: Places that the ids of a document's chunks leave; one with more chunks is an error.
CHUNK_PLACES = 10_000_000
#: Requests of a minute by purpose.
LIMITS = {"ask": 10, "login": 5}
