"""Compression of vectors to one code a part, the nearest entries found in GNATs.

A geometric near-neighbour access tree over a codebook's entries: a node has a few split
points, every other entry goes to its nearest one, and for each pair of split point i and
child j the node stores the range of distances from i to the entries of j. A query
computes its distances to the split points; a child is left out, with all that is
below it, if for some split point the query's distance and the best distance so far lie
strictly outside the child's range. Ranges and sums are rounded outwards, so that
nothing at the best distance is left out, and equal distances are settled on integers:
the lower index stays. A batch of queries goes through a tree together.

Each round is one pass over the vectors: tasks add up their parts by entry, and only these
sums are shuffled. The codebooks (parts x entries) are the only thing on the driver.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .vectors import compact, floored_means, integers, kept_vectors, matrix, of_length, slices

ARITY, LEAF = 6, 6  # split points of a node; entries from which on a node is split
_OUT = 2.0**-50


def _up(x):
    return x * (1 + _OUT)


def _down(x):
    return x * (1 - _OUT)


def _apart(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances, a row for each point."""
    return ((points[:, None] - entries[None]) ** 2).sum(2)


def gnat(entries: np.ndarray, ids: np.ndarray | None = None) -> tuple:
    """A tree over the entries: (split ids, least, most, children), or (ids,) for a leaf."""
    ids = np.arange(len(entries)) if ids is None else ids
    if len(ids) <= LEAF:
        return (ids,)
    own = entries[ids]
    chosen, away = [0], _apart(own, own[:1])[:, 0]
    while len(chosen) < ARITY:  # the entry farthest from those chosen
        away[chosen[-1]] = -1
        chosen.append(int(away.argmax()))
        away = np.minimum(away, _apart(own, own[chosen[-1:]])[:, 0])
    rest = np.delete(np.arange(len(ids)), chosen)
    squares = _apart(own[chosen], own[rest])
    roots = np.sqrt(squares.astype(float))
    nearest = squares.argmin(0)
    children, least, most = [], np.full((ARITY, ARITY), np.inf), np.full((ARITY, ARITY), -np.inf)
    for j in range(ARITY):
        member = nearest == j
        children.append(gnat(entries, ids[rest[member]]))
        if member.any():
            least[:, j], most[:, j] = _down(roots[:, member].min(1)), _up(roots[:, member].max(1))
    return ids[chosen], least, most, children


def nearest(tree: tuple, entries: np.ndarray, points: np.ndarray, tally: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index and exact squared distance of each point's nearest entry; ties to the lower index.

    ``tally`` is given the number of distances computed, node by node.
    """
    index = np.full(len(points), len(entries))
    best = np.full(len(points), -1, np.result_type(points, entries))  # -1: none yet

    def take(rows, ids, squares):
        order = np.argsort(ids, kind="stable")  # so that the first minimum has the lower index
        at = squares[:, order].argmin(1)
        found, name = squares[np.arange(len(rows)), order[at]], ids[order[at]]
        better = (best[rows] < 0) | (found < best[rows]) | ((found == best[rows]) & (name < index[rows]))
        best[rows[better]], index[rows[better]] = found[better], name[better]

    def visit(node, rows):
        ids = node[0]
        if not len(ids) or not len(rows):
            return
        squares = _apart(points[rows], entries[ids])
        if tally is not None:
            tally.append(squares.size)
        take(rows, ids, squares)
        if len(node) == 1:
            return
        _, least, most, children = node
        roots = np.sqrt(squares.astype(float))
        for j, child in enumerate(children):
            if not len(child[0]):
                continue
            reach = _up(np.sqrt(best[rows].astype(float)))[:, None]
            outside = (_down(roots) > _up(most[:, j] + reach)) | (_up(roots + reach) < least[:, j])
            visit(child, rows[~outside.any(1)])

    visit(tree, np.arange(len(points)))
    return index, best


def compress(
    vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, width: int | None = None
) -> tuple[DataFrame, list[np.ndarray]]:
    """vec_id, label, codes (an index a part), error of every kept vector; the codebooks.

    Vectors that are null or empty, or hold null or non-finite components, have no row; nor
    have those not of ``width`` components (the length of the kept vector of the smallest
    id, if not given), which has to be a multiple of ``parts``. Rows of equal id, and null
    ids, take part each for itself; as first entries equal ids go by vector, null ids come
    last. Fewer vectors than ``entries`` make shorter codebooks; an empty table gives an
    empty result. Other columns are ignored. An error that a long cannot hold fails.
    """
    spark = vectors.sparkSession
    plain = vectors.select("vec_id", "embedding", "label")
    kinds = {c: plain.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    ranked = [F.col("vec_id").asc_nulls_last(), F.col("embedding")]
    if width is None:
        least = kept_vectors(plain).orderBy(*ranked).select(F.size("embedding")).first()
        width = least[0] if least else parts
    if width % parts:
        raise ValueError(f"vectors of {width} components cannot be cut into {parts} equal parts")
    kept = of_length(plain, width)
    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, codes array<int>, error long"
    first = kept.orderBy(*ranked).limit(entries).collect()
    if not first:
        return spark.createDataFrame([], schema), []
    size = width // parts
    most = math.isqrt(2**60 // width)
    start = integers(np.array([row["embedding"] for row in first]), scale, most)
    books = [start[:, p * size : (p + 1) * size] for p in range(parts)]

    def coded(batch, books, trees):
        points = integers(matrix(batch.column("embedding")), scale, most)
        cut = [points[:, p * size : (p + 1) * size] for p in range(parts)]
        return cut, [nearest(trees[p], books[p], cut[p]) for p in range(parts)]

    for _ in range(rounds):
        def assigned(batch, books=books, trees=[gnat(b) for b in books]):
            cut, found = coded(batch, books, trees)
            return [(found[p][0] + p * len(books[p]), cut[p]) for p in range(parts)]

        means = floored_means(kept, assigned, width)
        count = len(books[0])
        books = [
            compact([means.get(p * count + k, e) for k, e in enumerate(book.tolist())], most)
            for p, book in enumerate(books)
        ]
    trees = [gnat(b) for b in books]

    def last(batches):
        for batch in slices(batches, width):
            _, found = coded(batch, books, trees)
            codes = np.stack([index for index, _ in found], 1).astype(np.int32)
            error = sum(best for _, best in found)
            offsets = pa.array(np.arange(0, codes.size + 1, parts, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id"), batch.column("label"),
                pa.ListArray.from_arrays(offsets, pa.array(codes.ravel())), pa.array(error.tolist(), pa.int64()),
            ], ["vec_id", "label", "codes", "error"])

    return kept.mapInArrow(last, schema), books


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns; a label of a third of all rows is added up in the tasks first."""
    found, books = compress(table(spark, sf_dir, "embeddings"))
    digest = hashlib.sha256(",".join(str(v) for book in books for v in book.ravel().tolist()).encode()).hexdigest()
    done = written(found, "codes")
    sums = written(done.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    sums = sums.withColumnRenamed("label", "of")
    code = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    return done.join(sums, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", code.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256")
    )


def _sql(rounds: int = 2) -> str:
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""apart{r} AS (
    SELECT vec_id, part, entry, sum((x.v - c.v) * (x.v - c.v))::BIGINT AS distance
    FROM x JOIN c{r} c USING (part, place) GROUP BY vec_id, part, entry
), found{r} AS (
    SELECT vec_id, part, entry, distance FROM apart{r}
    QUALIFY row_number() OVER (PARTITION BY vec_id, part ORDER BY distance, entry) = 1
)""")
        if r < rounds:
            steps.append(f"""c{r + 1} AS (
    SELECT c.part, c.entry, place, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN (
        SELECT part, entry, place, (s - ((s % n) + n) % n) // n AS v FROM (
            SELECT part, entry, place, sum(x.v)::BIGINT AS s, count(*) AS n
            FROM x JOIN found{r} USING (vec_id, part) GROUP BY ALL)
    ) m USING (part, entry, place)
)""")
    return f"""
WITH kept AS (
    SELECT vec_id, embedding, label FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: isfinite(e))) = 64
), x AS (
    SELECT vec_id, (k - 1) // 4 AS part, (k - 1) % 4 AS place, v FROM (
        SELECT vec_id, unnest(range(1, 65)) AS k, floor(256 * unnest(embedding)::DOUBLE)::BIGINT AS v FROM kept)
), first AS (
    SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept
    QUALIFY row_number() OVER (ORDER BY vec_id) <= 64
), c0 AS (
    SELECT part, entry, place, v FROM first JOIN x USING (vec_id)
), {", ".join(steps)}, coded AS (
    SELECT vec_id, string_agg(lpad(lower(to_hex(entry)), 2, '0'), '' ORDER BY part) AS code,
        sum(distance)::BIGINT AS error FROM found{rounds} GROUP BY vec_id
)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
    (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, entry, place)) FROM c{rounds}) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)
"""


SQL = _sql()
