"""Rows of vectors as packed bytes, and which of them take part in a search or join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(1)
        flat = np.asarray(lists.flatten(), np.float64)
        size = np.diff(np.asarray(lists.offsets)) if len(lists) else np.empty(0, np.int64)
        upto = np.cumsum(size) if len(size) else size
        ok = np.array([s > 0 and bool(np.isfinite(v := flat[e - s : e]).all()) and bool(v.any()) for s, e in zip(size, upto, strict=True)], bool)
        rows = np.flatnonzero(ok)
        packed = [flat[upto[i] - size[i] : upto[i]].tobytes() for i in rows]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(size[rows], pa.int32()), pa.array(packed, pa.binary())], ["vec_id", "dim", "vec"])


def packed_vectors(table: DataFrame, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """``vec_id, dim, vec`` (doubles as bytes) of the rows whose vector is whole, finite and not zero."""
    base = table.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    base = base.where("vec_id is not null and v is not null and not exists(v, x -> x is null)")
    return base.mapInArrow(_packed, "vec_id long, dim int, vec binary")


def one_each(vectors: DataFrame) -> DataFrame:
    """One row an id: of several that of the lowest dimension and, among those, of the least bytes."""
    rest = [c for c in vectors.columns if c != "vec_id"]
    return vectors.groupBy("vec_id").agg(F.min(F.struct(*rest)).alias("one")).select("vec_id", "one.*")


def dimensions(vectors: DataFrame) -> list[tuple[int, int]]:
    """Every dimension and its number of rows."""
    return [(r["dim"], r["count"]) for r in vectors.groupBy("dim").count().orderBy("dim").collect()]


def sample_matrix(vectors: DataFrame, rows: int) -> np.ndarray:
    """At most ``rows`` vectors, chosen by a hash of their id, as a matrix on the driver."""
    picked = vectors.select("vec_id", "vec").orderBy(F.xxhash64("vec_id"), "vec_id").limit(rows).collect()
    return np.stack([np.frombuffer(r["vec"]) for r in picked])


def matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column)).reshape(len(column), -1)
