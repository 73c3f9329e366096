"""Embedding providers: an interface, and one that needs no network."""

from __future__ import annotations

import hashlib
from abc import ABC, abstractmethod
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, FloatType, LongType, StringType, StructType

from quillmill.runtime import prepare
from quillmill.settings import PermanentEmbeddingError


class EmbeddingProvider(ABC):
    """Sent to the executors as it is, so it holds settings only; connections belong in embed_batch()."""

    name: str
    dimensions: int

    @abstractmethod
    def embed_batch(self, texts: list[str]) -> tuple[list[list[float]], int]:
        """A vector for each text, and the tokens used in all, or -1 if unknown."""


class HashProvider(EmbeddingProvider):
    """Unit vectors from SHA-256 of the text: equal texts have equal vectors, on every machine."""

    def __init__(self, dimensions: int = 64):
        self.name, self.dimensions = f"sha256-{dimensions}", dimensions

    def embed_batch(self, texts: list[str]) -> tuple[list[list[float]], int]:
        out = []
        for text in texts:
            blocks = b"".join(hashlib.sha256(f"{i}:{text}".encode()).digest() for i in range(-(-self.dimensions // 8)))
            v = np.frombuffer(blocks, "<u4")[: self.dimensions] / 2**31 - 1
            out.append((v / np.linalg.norm(v)).astype(np.float32).tolist())
        return out, sum(len(t.split()) for t in texts)


def embed(df: DataFrame, provider: EmbeddingProvider, text: str = "text", batch: int = 50, attempts: int = 3) -> DataFrame:
    """df with embedding, token_count (the batch's tokens over its texts, or -1) and error added.

    A batch that fails ``attempts`` times, or once with PermanentEmbeddingError, gives null vectors and the error's text instead of failing the job. Vectors stay in
    the row of their text, so nothing is joined by position.
    """
    prepare(df.sparkSession)
    names, at = df.columns, df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import time

        for rows in batches:
            for begin in range(0, rows.num_rows, batch):
                part = rows.slice(begin, batch)
                texts, error = [t or "" for t in part.column(at).to_pylist()], None
                for attempt in range(attempts):
                    try:
                        vectors, tokens = provider.embed_batch(texts)
                        if len(vectors) != len(texts):
                            raise ValueError(f"{len(vectors)} vectors for {len(texts)} texts")
                        error = None
                        break
                    except PermanentEmbeddingError as e:
                        vectors, tokens, error = [None] * len(texts), -1, str(e)
                        break
                    except Exception as e:  # noqa: BLE001  the error is part of the result
                        vectors, tokens, error = [None] * len(texts), -1, str(e)
                        if attempt + 1 < attempts:
                            time.sleep(2**attempt)
                each = tokens // len(texts) if tokens >= 0 else -1
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(vectors, pa.list_(pa.float32())), pa.array([each] * len(texts), pa.int64()), pa.array([error] * len(texts), pa.string())], [*names, "embedding", "token_count", "error"])

    schema = StructType([*df.schema.fields]).add("embedding", ArrayType(FloatType())).add("token_count", LongType()).add("error", StringType())
    return df.mapInArrow(run, schema)
