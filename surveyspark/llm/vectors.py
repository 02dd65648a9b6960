"""What the vector operators share: which vectors count, integer components, grouped sums."""

from __future__ import annotations

import math
from collections.abc import Callable
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLICE = 262_144  # components worked on at once


def finite(column: str = "embedding") -> Column:
    """True for a vector that is there and holds neither null nor non-finite components."""
    good = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(good, F.lit(False))


def kept_vectors(vectors: DataFrame) -> DataFrame:
    """The rows whose vectors have finite components, one at least, as doubles."""
    wide = vectors.withColumn("embedding", F.col("embedding").cast("array<double>"))
    return wide.filter(finite() & (F.size("embedding") > 0))


def of_length(vectors: DataFrame, width: int) -> DataFrame:
    return kept_vectors(vectors).filter(F.size("embedding") == width)


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equally long lists of doubles as an array, a row each."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1 if len(column) else 0)


def slices(batches, width: int):
    """Batches cut into pieces of at most ``SLICE`` components."""
    rows = max(1, SLICE // max(1, width))
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def integers(x: np.ndarray, scale: int, most: int) -> np.ndarray:
    """floor(scale * x) for a power of two; Python's integers where any passes ``most``,
    beyond which 64 bits might not hold the caller's sums of squares."""
    largest = np.abs(x).max(initial=0)
    if largest * scale < most:
        return np.floor(x * scale).astype(np.int64)
    exact = [math.floor(v * scale) if abs(v) < 2**53 else int(v) * scale for v in x.ravel().tolist()]
    return np.array(exact, object).reshape(x.shape)


def compact(rows: list[list[int]], most: int) -> np.ndarray:
    """Integer vectors as 64-bit integers, or as Python's where any passes ``most``."""
    exact = np.array(rows, object)
    return exact.astype(np.int64) if max(map(abs, exact.ravel().tolist()), default=0) < most else exact


def floored_means(rows: DataFrame, assigned: Callable, width: int) -> dict[int, list[int]]:
    """By group the componentwise floor(sum / count) of its integer vectors.

    ``assigned`` turns one record batch into pairs (groups, vectors), arrays of equal
    length. Each task adds up its own rows, so a row for each task, group and component is
    shuffled; groups and components are few and their means come to the driver.
    """

    def run(batches):
        count, total = {}, {}
        for batch in slices(batches, width):
            for group, vector in assigned(batch):
                order = np.argsort(group, kind="stable")
                starts = np.flatnonzero(np.diff(group[order], prepend=-1))
                sums, sizes = np.add.reduceat(vector[order], starts), np.diff(starts, append=len(order))
                for g, own, n in zip(group[order][starts].tolist(), sums, sizes.tolist()):
                    count[g] = count.get(g, 0) + n
                    total[g] = total.get(g, 0) + own
        keys = sorted(count)
        places = len(total[keys[0]]) if keys else 0
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(np.array(keys, np.int32), places), pa.int32()),
            pa.array(np.tile(np.arange(places, dtype=np.int32), len(keys)), pa.int32()),
            pa.array([Decimal(int(v)) for k in keys for v in total[k]], pa.decimal128(38, 0)),
            pa.array(np.repeat(np.array([count[k] for k in keys], np.int64), places), pa.int64()),
        ], ["part", "place", "total", "n"])

    sums = rows.mapInArrow(run, "part int, place int, total decimal(38,0), n long")
    sums = sums.groupBy("part", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    means: dict[int, list[int]] = {}
    for row in sums.sort("part", "place").collect():
        means.setdefault(row["part"], []).append(int(row["total"]) // row["n"])
    return means
