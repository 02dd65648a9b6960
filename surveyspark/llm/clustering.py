"""Centroid clustering of integer vectors by progressive search in the Walsh-Hadamard domain.

Vectors and centroids go through the same exact integer transform, which multiplies every
squared distance by the dimension. Coefficients are ordered from few sign changes to
many. A search adds up squared differences of the first ones for every centroid,
takes the whole distance of the one in front as bound, and then goes on in steps, dropping
centroids whose sum so far is strictly above the bound. Those left at the end have their
whole distance, so ties stay and go to the smaller number.

Each round is one pass over the vectors: tasks add up their own vectors by centroid, and
only these sums are shuffled. The centroids (few) are the only thing on the driver.
"""

from __future__ import annotations

import math
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .vectors import compact, floored_means, integers, matrix, of_length, slices

STEPS = (4, 8, 16, 32)  # coefficients after which centroids are dropped


def coarse_to_fine(width: int) -> np.ndarray:
    """Places of the transform's coefficients by their number of sign changes."""
    rows = np.ones((1, 1), np.int64)
    while len(rows) < width:
        rows = np.block([[rows, rows], [rows, -rows]])
    return np.argsort((rows[:, 1:] != rows[:, :-1]).sum(1), kind="stable")


def transformed(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row (a power of two long), coarse to fine."""
    width, half = x.shape[1], 1
    while half < width:
        pairs = x.reshape(len(x), width // (2 * half), 2, half)
        a, b = pairs[:, :, 0], pairs[:, :, 1]
        x = np.stack([a + b, a - b], 2).reshape(len(x), width)
        half *= 2
    return x[:, coarse_to_fine(width)]


def nearest(points: np.ndarray, centers: np.ndarray, tally: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance (in the transform) of each point's nearest center.

    ``tally`` is given the coefficient differences that were computed.
    """
    width = points.shape[1]
    steps = [s for s in STEPS if s < width]
    first = steps[0] if steps else width
    sums = ((points[:, None, :first] - centers[None, :, :first]) ** 2).sum(2)
    lead = sums.argmin(1)
    bound = ((points - centers[lead]) ** 2).sum(1)
    row, center = np.nonzero(sums <= bound[:, None])
    held = sums[row, center]
    done = sums.size * first + points.size
    for lo, hi in pairwise([first, *steps[1:], width]):
        held = held + ((points[row, lo:hi] - centers[center, lo:hi]) ** 2).sum(1)
        done += len(row) * (hi - lo)
        left = held <= bound[row]
        row, center, held = row[left], center[left], held[left]
    order = np.lexsort((center, held, row))
    row, center, held = row[order], center[order], held[order]
    best = np.flatnonzero(np.diff(row, prepend=-1))
    if tally is not None:
        tally.append(done)
    return center[best], held[best]


def starts(kept: DataFrame, clusters: int, seed: int) -> DataFrame:
    """The vectors with the smallest SHA-256 of seed and id; equal ids by vector, null ids last."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return kept.orderBy(digest.asc_nulls_last(), "embedding").limit(clusters)


def cluster(
    vectors: DataFrame, clusters: int = 16, rounds: int = 3, width: int = 64, scale: int = 64, seed: int = 1
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid (its integer components).

    Kept are vectors of exactly ``width`` (a power of two) components, all finite; others,
    null and empty vectors have no row. Rows of equal id, and null ids, take part each for
    itself. Equal distances go to the smaller number. With fewer vectors than ``clusters``
    there are as many clusters as vectors; an empty table gives an empty result. Other
    columns are ignored. A distance that a long cannot hold is an error.
    """
    spark = vectors.sparkSession
    kept = of_length(vectors.select("vec_id", "embedding"), width)
    first = starts(kept, clusters, seed).collect()
    kind = kept.schema["vec_id"].dataType.simpleString()
    if not first:
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, "
                                         "inertia long, centroid array<long>")
    most = math.isqrt(2**60 // width**3)
    centers = integers(np.array([row["embedding"] for row in first]), scale, most)

    def searched(batch, centers):
        points = integers(matrix(batch.column("embedding")), scale, most)
        return points, *nearest(transformed(points), transformed(centers))

    for _ in range(rounds):
        def assigned(batch, centers=centers):
            points, found, _ = searched(batch, centers)
            return [(found, points)]

        means = floored_means(kept, assigned, width)
        centers = compact([means.get(k, c) for k, c in enumerate(centers.tolist())], most)

    def last(batches):
        for batch in slices(batches, width):
            _, found, distance = searched(batch, centers)
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id"), pa.array(found.astype(np.int32)), pa.array((distance // width).tolist(), pa.int64())
            ], ["vec_id", "cluster", "distance"])

    done = written(kept.mapInArrow(last, f"vec_id {kind}, cluster int, distance long"), "clusters")
    sums = dict(done.groupBy("cluster").agg(F.sum("distance")).collect())  # a row for each cluster
    whole = sum(sums.values())
    facts = spark.createDataFrame(
        [(k, sums[k], whole, [int(v) for v in centers[k]]) for k in sorted(sums)],
        "cluster int, cluster_inertia long, inertia long, centroid array<long>",
    )
    return done.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cluster(table(spark, sf_dir, "embeddings"))
    return found.select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia",
        F.sha2(F.concat_ws(",", F.col("centroid").cast("array<string>")), 256).alias("centroid_sha256"),
    )


def _sql(rounds: int = 3) -> str:
    """Plain k-means over (vector, place, value) rows, a pair of CTEs a round."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""apart{r} AS (
    SELECT vec_id, cluster, sum((x.v - c.v) * (x.v - c.v))::BIGINT AS distance
    FROM x JOIN c{r} c USING (place) GROUP BY vec_id, cluster
), found{r} AS (
    SELECT vec_id, cluster, distance FROM apart{r}
    QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, cluster) = 1
)""")
        if r < rounds:
            steps.append(f"""c{r + 1} AS (
    SELECT c.cluster, place, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN (
        SELECT cluster, place, (s - ((s % n) + n) % n) // n AS v FROM (
            SELECT cluster, place, sum(x.v)::BIGINT AS s, count(*) AS n
            FROM x JOIN found{r} USING (vec_id) GROUP BY ALL)
    ) m USING (cluster, place)
)""")
    return f"""
WITH kept AS (
    SELECT vec_id, embedding FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: isfinite(e))) = 64
), x AS (
    SELECT vec_id, unnest(range(1, 65)) AS place, floor(64 * unnest(embedding)::DOUBLE)::BIGINT AS v FROM kept
), first AS (
    SELECT vec_id, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS cluster FROM kept
    QUALIFY row_number() OVER (ORDER BY sha256('1:' || vec_id)) <= 16
), c0 AS (
    SELECT cluster, place, v FROM first JOIN x USING (vec_id)
), {", ".join(steps)}, named AS (
    SELECT cluster, sha256(string_agg(v::VARCHAR, ',' ORDER BY place)) AS centroid_sha256 FROM c{rounds} GROUP BY cluster
)
SELECT vec_id, cluster::INT AS cluster, distance,
    sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia,
    sum(distance) OVER ()::BIGINT AS inertia, centroid_sha256
FROM found{rounds} JOIN named USING (cluster)
"""


SQL = _sql()
