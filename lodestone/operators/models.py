"""Models as column functions: embedding, reranking, generation; offline stand-ins for each.

A real model is an object with the same method; it is loaded once per worker.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StringType

from .scan import redact

MAX_BATCH = 64


class Embedder(Protocol):
    dimension: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Reranker(Protocol):
    def score(self, query: str, documents: list[str]) -> list[float]: ...


class Generator(Protocol):
    def generate(self, prompt: str, max_tokens: int, temperature: float) -> str: ...


class HashingEmbedder:
    """Signed feature hashing of words and their neighbours: deterministic, needs no model."""

    def __init__(self, dimension: int = 384):
        self.dimension = dimension

    def embed(self, texts: list[str]) -> list[list[float]]:
        if not 1 <= len(texts) <= MAX_BATCH:
            raise ValueError(f"1 to {MAX_BATCH} texts at once")
        import re
        from zlib import crc32

        out = np.zeros((len(texts), self.dimension), np.float32)
        for i, t in enumerate(texts):
            words = re.findall(r"[^\W_]+", t.lower())
            for w in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))]:
                h = crc32(w.encode())
                out[i, h % self.dimension] += 1.0 if h >> 31 else -1.0
            n = float(np.linalg.norm(out[i]))
            out[i] /= n or 1.0
        return out.tolist()


class OverlapReranker:
    """The share of the query's words a document has."""

    def score(self, query: str, documents: list[str]) -> list[float]:
        if not documents or not query:
            raise ValueError("a query and documents are needed")
        q = set(query.lower().split())
        return [len(q & set(d.lower().split())) / len(q) for d in documents]


class EchoGenerator:
    """Answers with the last user line of the prompt."""

    def generate(self, prompt: str, max_tokens: int = 1024, temperature: float = 0.1) -> str:
        lines = [x[6:] for x in prompt.splitlines() if x.startswith("user: ")]
        return " ".join((lines[-1] if lines else "").split()[:max_tokens])


def embedded(text: Column, embedder: Embedder) -> Column:
    """Vectors of a text column, in requests of at most MAX_BATCH texts; null texts have none.

    A worker holds the Arrow batch that Spark hands it (10,000 rows and 64 MB by
    default) and the texts and vectors of one request. Marked as nondeterministic,
    so that filters on the vectors are not pushed below them: else each such
    filter computes them again, in a worker of its own beside the first.
    """

    @F.arrow_udf(ArrayType(FloatType()))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            for a in range(0, len(b), MAX_BATCH):
                part = b.slice(a, MAX_BATCH)
                texts = part.drop_null().to_pylist()
                vectors = iter(embedder.embed(texts) if texts else [])
                yield pa.array([next(vectors) if x else None for x in part.is_valid().to_pylist()], pa.list_(pa.float32()))

    return run.asNondeterministic()(text)


def rerank_scores(query: str, content: Column, reranker: Reranker) -> Column:
    @F.pandas_udf(DoubleType())
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(reranker.score(query, s.fillna("").tolist()) if len(s) else [], dtype=float)

    return run(content)


def generated(prompt: Column, generator: Generator, max_tokens: int = 1024, temperature: float = 0.1, redacted: bool = True) -> Column:
    """Answers; out-of-range settings fall back to their defaults, secrets are redacted before they leave."""
    tokens = max_tokens if 1 <= max_tokens <= 32768 else 1024
    heat = temperature if 0 <= temperature <= 2 else 0.1

    @F.pandas_udf(StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda p: None if p is None else generator.generate(p, tokens, heat))

    return run(redact(prompt)[0] if redacted else prompt)
