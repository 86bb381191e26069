"""What both vector operators need: usable rows, bounded samples and matrices from Arrow."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(df: DataFrame) -> DataFrame:
    """(vec_id, embedding): rows with an id and a finite vector that isn't zero, of any length."""
    ok = "vec_id IS NOT NULL AND embedding IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(embedding, x -> x != 0)"
    return df.select("vec_id", "embedding").filter(ok)


def lengths(vecs: DataFrame) -> list[int]:
    """The vectors' lengths, the commonest first; only vectors of one length can be compared."""
    return [r.n for r in vecs.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").collect()]


def of_length(df: DataFrame, n: int) -> DataFrame:
    return df.filter(F.size("embedding") == n)


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of doubles from a list column of equal lengths."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), np.finfo(float).tiny)  # squares of huge or tiny values stay finite
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision; the same for equal rows wherever they stand."""
    out = np.empty(len(a))
    for i in range(0, len(a), 50_000):
        x, y = a[i : i + 50_000], b[i : i + 50_000]
        x = x / np.abs(x).max(axis=1, keepdims=True)
        y = y / np.abs(y).max(axis=1, keepdims=True)
        out[i : i + 50_000] = (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
    return out


def sample(df: DataFrame, most: int, key: str = "vec_id") -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of `most` rows at most, smallest hash of the id first, so the same rows every time."""
    got = df.select(key, "embedding").orderBy(F.xxhash64(key), key).limit(most).toArrow()
    return got.column(0).to_numpy(), matrix(got.column(1))
