"""Embedding providers: a stored table, feature hashing, and a batched remote model with resume."""

from __future__ import annotations

import hashlib
import re
import time
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.operators.vectors import normalise

_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")


class Embedder(ABC):
    """Turns texts into unit vectors. ``task`` tells documents from queries for models that care."""

    dims: int

    @abstractmethod
    def embed(self, texts: DataFrame, key: str = "id", text: str = "text", task: str = "document") -> DataFrame:
        """(id, vec) for (key, text)."""

    @abstractmethod
    def embed_query(self, text: str) -> list[float]:
        """The vector of one question."""


class HashingEmbedder(Embedder):
    """Signed feature hashing: the first 32 bits of a word's MD5 give its dimension and sign. No model, no shuffle."""

    def __init__(self, dims: int = 64):
        self.dims = dims

    def _code(self, word: str) -> int:
        """Twice the dimension, plus one for a negative sign."""
        h = int(hashlib.md5(word.encode()).hexdigest()[:8], 16)
        return 2 * (h % self.dims) + (h // self.dims) % 2

    def vectors(self, texts: list[str | None], seen: dict[str, int]) -> np.ndarray:
        out = np.zeros((len(texts), self.dims))
        for row, text in enumerate(texts):
            words = _WORD.findall((text or "").lower())
            for w in set(words).difference(seen):
                seen[w] = self._code(w)
            if words:
                signed = np.bincount([seen[w] for w in words], minlength=2 * self.dims)
                out[row] = signed[0::2] - signed[1::2]
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    def embed(self, texts: DataFrame, key: str = "id", text: str = "text", task: str = "document") -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: dict[str, int] = {}
            for batch in batches:
                if len(seen) > 500_000:
                    seen.clear()
                v = self.vectors(batch.column("_text").to_pylist(), seen)
                offsets = pa.array(np.arange(len(v) + 1, dtype=np.int32) * self.dims)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.ListArray.from_arrays(offsets, pa.array(v.ravel()))], names=["id", "vec"]
                )

        return texts.select(F.col(key).cast("long").alias("id"), F.col(text).alias("_text")).mapInArrow(run, "id long, vec array<double>")

    def embed_query(self, text: str) -> list[float]:
        return self.vectors([text], {})[0].tolist()


class PrecomputedEmbedder(Embedder):
    """Vectors of a stored table (id, vec), normalised; queries are the vectors of given ids or of a fallback."""

    def __init__(self, table: DataFrame, dims: int, query: Embedder | None = None):
        self.table, self.dims, self.query = table, dims, query or HashingEmbedder(dims)

    def embed(self, texts: DataFrame, key: str = "id", text: str = "text", task: str = "document") -> DataFrame:
        found = texts.select(F.col(key).alias("id")).join(self.table.select("id", "vec"), "id", "left")
        return found.select("id", normalise(F.coalesce("vec", F.array_repeat(F.lit(0.0), self.dims))).alias("vec"))

    def embed_query(self, text: str) -> list[float]:
        return self.query.embed_query(text)


class RemoteEmbedder(Embedder):
    """A remote model called in batches, at a pace, with retries on quota errors.

    ``call(texts, task)`` returns one vector for each text. Work is resumed by giving ``done``: ids with stored vectors
    are left out by an anti-join, and ``store`` may be called on every batch of results.
    """

    def __init__(self, call: Callable[[list[str], str], list[list[float]]], dims: int, batch: int = 64, delay: float = 1.4, attempts: int = 4):
        self.call, self.dims, self.batch, self.delay, self.attempts = call, dims, batch, delay, attempts

    def _once(self, texts: list[str], task: str) -> list[list[float]]:
        for attempt in range(self.attempts):
            try:
                got = self.call(texts, task)
                if len(got) != len(texts):
                    raise ValueError("the model returned another number of vectors than of texts")
                return got
            except Exception as e:
                if "429" not in str(e) or attempt == self.attempts - 1:
                    raise
                asked = re.search(r"retry in ([0-9.]+)\s*s", str(e), re.I)
                time.sleep(float(asked[1]) + 2 if asked else 65)
        raise AssertionError

    def embed(self, texts: DataFrame, key: str = "id", text: str = "text", task: str = "document", done: DataFrame | None = None) -> DataFrame:
        todo = texts.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
        if done is not None:
            todo = todo.join(done.select("id"), "id", "left_anti")
        size, delay = self.batch, self.delay

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, size):
                    part = b.slice(at, size)
                    vectors = self._once(part.column("_text").to_pylist(), task)
                    yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(vectors, pa.list_(pa.float64()))], names=["id", "vec"])
                    time.sleep(delay)

        fresh = todo.mapInArrow(run, "id long, vec array<double>").select("id", normalise(F.col("vec")).alias("vec"))
        return fresh if done is None else done.select("id", F.col("vec").cast("array<double>").alias("vec")).unionByName(fresh)

    def embed_query(self, text: str) -> list[float]:
        v = np.asarray(self._once([text], "query")[0], dtype=float)
        return (v / max(np.linalg.norm(v), 1e-12)).tolist()
