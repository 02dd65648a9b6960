"""Near-duplicate vectors by product quantisation, links confirmed on exact cosines.

Rows of equal vectors form one class, numbered in order of its smallest id; only classes
go on. An index is fitted on a bounded sample: coarse centers, and for the residuals of
unit vectors from their center a codebook for each of some subspaces.

1. Every class is held by the inverted list of its nearest center, with the codes of its
   residual and the exact length of what the codes leave out.
2. Every class visits the lists that may hold a vector within the link distance: the list of
   center j if, among the centers, the class is nearer to its own by no more than that
   distance in the direction from one to the other could make up for. A difference of
   random direction has only a small part along that line, so ``spread`` standard
   deviations of it are allowed for; the effective dimension of the sample sets them, and
   in few dimensions the bound is strict. A pair is met if either visits the other's list.
3. In a list, a visitor's distances to all codes come from tables of its residual to the
   codebooks. A held vector is out if that distance is above the link distance plus what
   its codes leave out, which never drops a link. Cosines of the rest are computed in
   double precision.

A pair that is met in two lists counts in the lower one. Lists are joined in blocks of
bounded size, many blocks for a hot list; a block returns a row for each class that it
links, with its number of links and the smallest class it reaches there, never pairs.
"""

from __future__ import annotations

import hashlib
import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import table, written
from .near_dedup import components
from .vectors import finite, slices

SAMPLE = 16_384  # classes that the index is fitted on
LISTS, MOST_LISTS = 4, 4_096  # lists: so many times the root of the classes, at most so many
SPACES, CODES = 16, 64  # subspaces and codewords of each
SPREAD = 2.5
BLOCK = 1_024  # classes of a list on either side of a join block
CHUNK = 2_000_000  # numbers worked on at once


def unit_rows(raw: list[bytes], width: int, form: str) -> np.ndarray:
    """Unit vectors in doubles from packed numbers, shorter ones filled up with zeros."""
    x = np.zeros((len(raw), width))
    for row, data in zip(x, raw):
        own = np.frombuffer(data, form)
        row[: len(own)] = own
    x /= np.abs(x).max(1, initial=0, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _packed(vectors: DataFrame) -> DataFrame:
    """vec_id, raw (the numbers in bytes) and name (their SHA-256); null for vectors without links."""
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def run(batches):
        for batch in slices(batches, 64):
            raw, names = [], []
            for cell in batch.column("embedding"):
                own = None if not cell.is_valid else cell.values.to_numpy(zero_copy_only=False)
                if own is None or not own.any():
                    raw.append(None), names.append(None)
                else:
                    raw.append((own + own.dtype.type(0)).tobytes())  # -0.0 equals 0.0
                    names.append(hashlib.sha256(raw[-1]).digest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(raw, pa.binary()), pa.array(names, pa.binary())], ["vec_id", "raw", "name"]
            )

    return vectors.mapInArrow(run, f"vec_id {kind}, raw binary, name binary")


def _lloyd(x: np.ndarray, centers: np.ndarray, rounds: int) -> np.ndarray:
    for _ in range(rounds):
        own = nearest_center(x, centers)
        order = np.argsort(own, kind="stable")
        starts = np.flatnonzero(np.diff(own[order], prepend=-1))
        sums, sizes = np.add.reduceat(x[order], starts), np.diff(starts, append=len(x))
        centers = centers.copy()
        centers[own[order][starts]] = sums / sizes[:, None]
    return centers


def nearest_center(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    half = (centers * centers).sum(1) / 2
    step = max(1, CHUNK // len(centers))
    return np.concatenate([(x[lo : lo + step] @ centers.T - half).argmax(1) for lo in range(0, len(x), step)])


def spaces(width: int) -> list[np.ndarray]:
    return np.array_split(np.arange(width), min(SPACES, width))


def fit_index(x: np.ndarray, lists: int, cosine: float) -> tuple[np.ndarray, list[np.ndarray], float]:
    """Centers, codebooks and effective dimension from a sample of unit vectors.

    First centers are sample vectors with no link to one another, so a group of near
    copies is one list, however many they are.
    """
    chosen = np.empty((lists, x.shape[1]))
    count = 0
    for row in x:
        if count == lists:
            break
        if not count or (chosen[:count] @ row).max() < cosine:
            chosen[count] = row
            count += 1
    centers = _lloyd(x, chosen[:count], 4)
    rest = x - centers[nearest_center(x, centers)]
    books = []
    for space in spaces(x.shape[1]):
        own = rest[:, space]
        first = np.unique(own, axis=0)
        first = first[np.random.default_rng(5).permutation(len(first))[:CODES]]
        books.append(_lloyd(own, first, 5))
    spread = np.cov(x, rowvar=False, bias=True).reshape(x.shape[1], -1)
    dimension = np.trace(spread) ** 2 / max((spread * spread).sum(), 1e-300)
    return centers, books, float(max(dimension, 1.0))


def _fitted(classes: DataFrame, width: int, form: str, lists: int, cosine: float):
    """The index, fitted in one task on the ``SAMPLE`` classes of smallest hash."""
    sample = classes.orderBy(F.xxhash64("node", F.lit(5)), "node").limit(SAMPLE).select("raw")

    def run(batches):
        raw = list(itertools.chain.from_iterable(batch.column(0).to_pylist() for batch in batches))
        if raw:
            centers, books, dimension = fit_index(unit_rows(raw, width, form), lists, cosine)
            parts = [centers, *books, np.array([[dimension]])]
            yield pa.RecordBatch.from_arrays(
                [pa.array([p.tobytes() for p in parts], pa.binary()), pa.array([p.shape[1] for p in parts])], ["data", "width"]
            )

    found = [np.frombuffer(r["data"]).reshape(-1, r["width"])
             for r in sample.coalesce(1).mapInArrow(run, "data binary, width long").collect()]
    return found[0], found[1:-1], float(found[-1][0, 0])


def visits(x: np.ndarray, centers: np.ndarray, reach: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """Each vector's nearest center, and the centers whose lists it visits (its own among them).

    ``reach``: how far along a line between two centers a linked vector may lie.
    """
    half = (centers * centers).sum(1) / 2
    home, found = np.empty(len(x), np.int32), []
    step = max(1, CHUNK // len(centers))
    for lo in range(0, len(x), step):
        score = x[lo : lo + step] @ centers.T - half
        own = score.argmax(1)
        home[lo : lo + step] = own
        apart = np.sqrt(np.maximum(2 * (half + half[own][:, None] - centers[own] @ centers.T), 0))
        near = score.max(1, keepdims=True) - score <= reach * apart + 1e-9
        near[np.arange(len(own)), own] = True
        row, center = np.nonzero(near)
        found += np.split(center.astype(np.int32), np.cumsum(near.sum(1))[:-1])
    return home, found


def encode(rest: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of residuals, and the length of what the codes leave out."""
    codes = np.empty((len(rest), len(books)), np.uint8)
    left = np.zeros(len(rest))
    for m, (space, book) in enumerate(zip(spaces(rest.shape[1]), books)):
        codes[:, m] = nearest_center(rest[:, space], book)
        left += ((rest[:, space] - book[codes[:, m]]) ** 2).sum(1)
    return codes, np.sqrt(left)


def _indexed(classes: DataFrame, index, width: int, form: str, reach: float) -> DataFrame:
    """node, copies, raw, home, lists, codes, left."""

    def run(batches):
        centers, books, _ = index.value
        for batch in slices(batches, width):
            x = unit_rows(batch.column("raw").to_pylist(), width, form)
            home, lists = visits(x, centers, reach)
            codes, left = encode(x - centers[home], books)
            yield pa.RecordBatch.from_arrays([
                batch.column("node"), batch.column("copies"), batch.column("raw"), pa.array(home),
                pa.array(lists, pa.list_(pa.int32())), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(left),
            ], ["node", "copies", "raw", "home", "lists", "codes", "left"])

    return classes.select("node", "copies", "raw").mapInArrow(
        run, "node long, copies long, raw binary, home int, lists array<int>, codes binary, left double"
    )


def _groups(n: int, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The smallest number that each of n numbers reaches by the links one - two."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[one], root[two])
        new = root.copy()
        np.minimum.at(new, root[one], low)
        np.minimum.at(new, root[two], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def links_in(held: dict, visitor: dict, center: np.ndarray, books, place: int, width: int, form: str, cosine: float):
    """Linked pairs (row of visitor, row of held) of a list, each pair once over all lists."""
    x, y = unit_rows(visitor["raw"], width, form), unit_rows(held["raw"], width, form)
    codes = np.frombuffer(b"".join(held["codes"]), np.uint8).reshape(len(y), -1)
    limit = (np.sqrt(2 - 2 * cosine) + held["left"]) ** 2 + 1e-9
    rest, out = x - center, []
    length = np.array([len(r) for r in visitor["raw"]]), np.array([len(r) for r in held["raw"]])
    # Whether a held class visits a visitor's own list: then they meet there too.
    homes, of_home = np.unique(visitor["home"], return_inverse=True)
    sizes = np.array([len(v) for v in held["lists"]])
    flat = np.concatenate(held["lists"])
    at = np.searchsorted(homes, flat).clip(max=len(homes) - 1)
    both = np.zeros((len(y), len(homes)), bool)
    known = homes[at] == flat
    both[np.repeat(np.arange(len(y)), sizes)[known], at[known]] = True
    step = max(1, CHUNK // max(len(y), 1))
    pairs = max(1, CHUNK // width)
    for lo in range(0, len(x), step):
        apart = np.zeros((len(x[lo : lo + step]), len(y)))
        for m, (space, book) in enumerate(zip(spaces(width), books)):
            own = rest[lo : lo + step, space]
            tables = ((own[:, None] - book[None]) ** 2).sum(2)
            apart += tables[:, codes[:, m]]
        i, j = np.nonzero(apart <= limit)
        i += lo
        here = visitor["home"][i] == place
        twice = both[j, of_home[i]]
        once = np.where(here, visitor["node"][i] < held["node"][j], ~twice | (place < visitor["home"][i]))
        once &= length[0][i] == length[1][j]
        i, j = i[once], j[once]
        for k in range(0, len(i), pairs):
            a, b = i[k : k + pairs], j[k : k + pairs]
            near = np.einsum("ij,ij->i", x[a], y[b]) >= cosine
            out.append((a[near], b[near]))
    one, two = (np.concatenate([p[s] for p in out]) if out else np.empty(0, np.int64) for s in (0, 1))
    return one, two


def _joined(rows: DataFrame, index, width: int, form: str, cosine: float) -> DataFrame:
    """node, links, least: for every block of a list the classes it links."""
    homes = rows.groupBy(F.col("home").alias("list")).agg(F.count(F.lit(1)).alias("held"))
    coming = rows.select(F.explode("lists").alias("list")).groupBy("list").agg(F.count(F.lit(1)).alias("coming"))
    blocks = written(homes.join(coming, "list").select(
        "list", F.ceil(F.col("held") / BLOCK).cast("int").alias("held_blocks"),
        F.ceil(F.col("coming") / BLOCK).cast("int").alias("coming_blocks"),
    ), "blocks")  # at most MOST_LISTS rows

    def dealt(blocks: str) -> Column:
        return F.pmod(F.xxhash64("node"), blocks).cast("int")

    def every(blocks: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))

    held = rows.withColumnRenamed("home", "list").join(blocks, "list").select(
        "list", dealt("held_blocks").alias("one"), every("coming_blocks").alias("two"), "node", "copies", "raw", "lists", "codes", "left"
    )
    # Aliases, as both sides come from the same columns.
    coming = rows.select(*[F.col(c).alias(c) for c in ("node", "copies", "raw", "home")], F.explode("lists").alias("list"))
    coming = coming.join(blocks, "list").select(
        F.col("list").alias("list"), dealt("coming_blocks").alias("two"), every("held_blocks").alias("one"),
        "node", "copies", "raw", "home",
    )
    schema = "node long, links long, least long"

    def run(key, held: pa.Table, visitor: pa.Table) -> pa.Table:
        place = key[0].as_py()
        centers, books, _ = index.value
        one, two = [
            {c: t.column(c).to_pylist() if c in ("raw", "codes", "lists") else t.column(c).to_numpy()
             for c in t.column_names} for t in (held, visitor)
        ]
        i, j = links_in(one, two, centers[place], books, place, width, form, cosine) if len(held) and len(visitor) else ([], [])
        nodes, at = np.unique(np.concatenate([two["node"][i], one["node"][j]]), return_inverse=True)
        a, b = at[: len(i)], at[len(i) :]
        links = np.bincount(a, one["copies"][j], len(nodes)) + np.bincount(b, two["copies"][i], len(nodes))
        least = nodes[_groups(len(nodes), a, b)]
        return pa.table({"node": nodes, "links": links.astype(np.int64), "least": least})

    return held.groupBy("list", "one", "two").cogroup(coming.groupBy("list", "one", "two")).applyInArrow(run, schema)


def near_duplicate_vectors(vectors: DataFrame, cosine: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row.

    Rows are linked if the cosine of their vectors, in double precision, is at least
    ``cosine``; n_links counts the other rows linked directly, component_id is the smallest
    id reachable. Vectors that are null, empty or zero, or hold null or non-finite
    components, link with nothing, and vectors link only with those of their length. Rows of
    equal id take part each for itself. A null id counts as the largest; kept is whether
    component_id is the row's own id, null as the id only of null ids. An empty
    table gives an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    plain = vectors.select("vec_id", "embedding")
    single = isinstance(plain.schema["embedding"].dataType.elementType, FloatType)
    if not single:
        plain = plain.withColumn("embedding", F.col("embedding").cast("array<double>"))
    form = "<f4" if single else "<f8"
    packed = written(_packed(plain.withColumn("embedding", F.when(finite(), F.col("embedding")))), "vectors")
    alone = packed.filter("name IS NULL").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")
    )
    linked = packed.filter("name IS NOT NULL")
    classes = linked.groupBy("name", "raw").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    # Numbers follow the order of the smallest ids.
    classes = written(classes.sort(F.col("least").asc_nulls_last(), "name").select(
        "name", "raw", "least", "copies", F.monotonically_increasing_id().alias("node")
    ), "classes")
    count, longest = classes.agg(F.count(F.lit(1)), F.max(F.length("raw"))).first()
    if not count:
        return alone
    width = longest // np.dtype(form).itemsize
    lists = min(MOST_LISTS, math.ceil(LISTS * math.sqrt(count)))
    index = _fitted(classes, width, form, lists, cosine)
    reach = math.sqrt(2 - 2 * cosine) * min(1.0, SPREAD / math.sqrt(index[2]))
    index = spark.sparkContext.broadcast(index)  # at most MOST_LISTS centers
    rows = written(_indexed(classes, index, width, form, reach), "index")
    found = written(_joined(rows, index, width, form, cosine), "links")
    labels = components(found.filter("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = classes.select("name", "node", "copies").join(links, "node", "left").join(labels, "node", "left")
    named = named.withColumn("component", F.coalesce("component", "node")).join(
        classes.select(F.col("node").alias("component"), F.col("least").alias("component_id")), "component"
    )
    named = named.select("name", "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    kept = F.col("vec_id").eqNullSafe(F.col("component_id"))
    return linked.select("vec_id", "name").join(named, "name").select(
        "vec_id", "n_links", "component_id", kept.alias("kept")
    ).unionByName(alone)


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE v AS (
    SELECT vec_id, list_transform(embedding, lambda e: e::DOUBLE) AS e FROM embeddings
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda e: isfinite(e))) = len(embedding)
        AND len(list_filter(embedding, lambda e: e <> 0)) > 0
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_cosine_similarity(a.e, b.e) >= 0.95
), reach AS (
    SELECT vec_id AS a, vec_id AS b FROM embeddings
    UNION
    SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT e.vec_id, coalesce(n, 0) AS n_links, m AS component_id, e.vec_id = m AS kept
FROM embeddings e LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a) USING (vec_id)
JOIN (SELECT a AS vec_id, min(b) AS m FROM reach GROUP BY a) USING (vec_id)
"""
