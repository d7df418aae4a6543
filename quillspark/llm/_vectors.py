"""Integer vectors in blocks, shared by the operators on embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE = 256
#: Components must stay below this after scaling, so that squares and products of two fit in 64 bits.
MOST = 2**30


def whole(vectors: DataFrame) -> DataFrame:
    """Rows whose vector is there and has finite components only."""
    good = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return vectors.where(F.coalesce(good, F.lit(False)))


def integers(column: pa.Array, dim: int) -> np.ndarray:
    """floor(256 * x) of a list column as rows of `dim` integers; shorter vectors are padded with zeros."""
    column = column.cast(pa.list_(pa.float64()))
    sizes = np.diff(np.asarray(column.offsets))
    flat = np.floor(np.asarray(column.flatten(), np.float64) * SCALE)
    if len(flat) and np.abs(flat).max() >= MOST:
        raise ValueError(f"components of {MOST // SCALE} or more: their products do not fit in 64 bits")
    if (sizes == dim).all():
        return flat.astype(np.int64).reshape(-1, dim)
    out = np.zeros((len(sizes), dim), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def width(vectors: DataFrame) -> tuple[int, int]:
    """Length of the longest vector (at least 1), number of vectors."""
    r = vectors.agg(F.max(F.size("embedding")).alias("d"), F.count("*").alias("n")).first()
    return max(r.d or 0, 1), r.n


def packed(a: np.ndarray) -> bytes:
    """Smallest integer type that holds a, its letter first."""
    for letter, kind in (("b", np.int8), ("h", np.int16), ("i", np.int32)):
        if not a.size or (a.min() >= np.iinfo(kind).min and a.max() <= np.iinfo(kind).max):
            return letter.encode() + a.astype(kind).tobytes()
    return b"q" + a.astype(np.int64).tobytes()


def unpacked(b: bytes, dim: int) -> np.ndarray:
    kind = {"b": np.int8, "h": np.int16, "i": np.int32, "q": np.int64}[chr(b[0])]
    return np.frombuffer(b, kind, offset=1).reshape(-1, dim).astype(np.int64)


def pieces(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of at most `rows` rows."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)
