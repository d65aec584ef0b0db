"""Interfaces of the embedding and language models, and deterministic ones that need no network."""

from __future__ import annotations

import hashlib
import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import partial
from typing import Protocol, TypeVar

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shipping import shipped

#: Characters that a model sees, dimensions, texts of a call, tries, first wait.
MAX_CHARS, DIMENSIONS, BATCH, TRIES, WAIT = 8_000, 768, 64, 5, 2.0
DOCUMENT, QUERY = "document", "query"
#: Calls at once in a task, and the statuses of a service that may pass.
FLIGHT, PASSING = 6, (429, 500, 503)
T = TypeVar("T")


class Embedder(Protocol):
    def embed(self, texts: list[str], task: str) -> list[list[float]]: ...


class Generator(Protocol):
    def complete(self, prompt: str, temperature: float = 0.0) -> str: ...

    def stream(self, prompt: str, temperature: float = 0.0) -> Iterator[str]: ...


class HashEmbedder:
    """Unit vectors of hashed words: equal texts are equal, texts that share words are near."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.dimensions = dimensions

    def embed(self, texts: list[str], task: str = DOCUMENT) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.zeros(self.dimensions)
            for w in t[:MAX_CHARS].lower().split():
                h = int.from_bytes(hashlib.sha256(w.encode()).digest()[:8], "little")
                v[h % self.dimensions] += 1.0 if h >> 63 else -1.0
            out.append((v / (np.linalg.norm(v) or 1.0)).tolist())
        return out


class EchoGenerator:
    """Answers with what it was told to, for tests."""

    def __init__(self, answers: list[str] | None = None):
        self.answers = list(answers or [])

    def complete(self, prompt: str, temperature: float = 0.0) -> str:
        return self.answers.pop(0) if self.answers else ""

    def stream(self, prompt: str, temperature: float = 0.0) -> Iterator[str]:
        yield from self.complete(prompt, temperature).split(" ")


class ModelError(RuntimeError):
    """An answer of a model service that is none: its HTTP status, and how long it asks to wait if it does.

    429, 500 and 503 may pass and are tried again; all others are final.
    """

    def __init__(self, status: int, text: str = "", retry_after: float | None = None):
        super().__init__(f"{status} {text[:300]}".rstrip())
        self.status, self.retry_after = status, retry_after

    @property
    def passing(self) -> bool:
        return self.status in PASSING


def retried(call: Callable[[], list], tries: int = TRIES, wait: float = WAIT, sleep: Callable[[float], None] = time.sleep) -> list:
    """A model call that is tried again after OSError (transport) and after a ``ModelError`` that may pass, with doubled waits or as long as the service asks for."""
    for left in range(tries - 1, -1, -1):
        try:
            return call()
        except OSError:
            if not left:
                raise
            sleep(wait)
        except ModelError as e:
            if not left or not e.passing:
                raise
            sleep(wait if e.retry_after is None else e.retry_after)
        wait *= 2
    return []


def in_flight(calls: Iterable[Callable[[], T]], most: int = FLIGHT) -> Iterator[T]:
    """Results in the order of the calls, of which so many run at once; no more are begun than their results are taken.

    The first that fails ends all: those that wait are not begun.
    """
    with ThreadPoolExecutor(max_workers=most) as pool:
        waiting: deque = deque()
        try:
            for call in calls:
                waiting.append(pool.submit(call))
                if len(waiting) == most:
                    yield waiting.popleft().result()
            while waiting:
                yield waiting.popleft().result()
        finally:
            for w in waiting:
                w.cancel()


def embed(chunks: DataFrame, embedder: Embedder, task: str = DOCUMENT, id_: str = "chunk_id", text: str = "text", flight: int = FLIGHT) -> DataFrame:
    """(chunk_id, embedding): calls of ``BATCH`` texts, ``flight`` of them at once in each task; only what the caller left open is embedded.

    An embedder is used by several threads, as a client of a service can be. A call without as many vectors as texts is an error, so that none lands beside
    another's text.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def calls() -> Iterator[Callable[[], pd.DataFrame]]:
            for p in parts:
                for at in range(0, len(p), BATCH):
                    yield partial(one, p.iloc[at : at + BATCH])

        def one(part: pd.DataFrame) -> pd.DataFrame:
            texts = [t[:MAX_CHARS] for t in part["text"]]
            vectors = retried(lambda: embedder.embed(texts, task))
            if len(vectors) != len(texts):
                raise ValueError(f"{len(vectors)} vectors for {len(texts)} texts")
            return pd.DataFrame({"chunk_id": part["chunk_id"], "embedding": vectors})

        yield from in_flight(calls(), flight)

    rows = chunks.select(F.col(id_).cast("long").alias("chunk_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    shipped(rows.sparkSession)
    return rows.mapInPandas(run, "chunk_id long, embedding array<float>")
