"""SMOTENC: synthetic minority rows from exact nearest neighbours."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Mapping, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surveyspark.functions.checkpoints import cut
from surveyspark.functions.hashing import hash_key, uniform
from surveyspark.operators.boxes import Screen, first_k, first_of_query, nearest_in_boxes, parts_of_distance, slack, up
from surveyspark.operators.prefix import hash_bucket, prefix_sum

_BLOCK_ROWS = 1024  # rows of a pivot that are ruled out or compared together
_SHELF_ROWS = 8192  # rows of either side in one neighbour-search group, of large tables up to four times as many
_PIECE_ROWS = 4096  # rows multiplied with a slab of queries at once
_MOST_PIVOTS = 4096  # in a broadcast
_MOST_BLOCKS = 200_000  # in a broadcast
_FEW_QUERIES = 512  # that one pass over the rows serves
_SLOTS = 256  # parts that the rows of a pivot can be cut into


def _distances(a: np.ndarray, b: np.ndarray, n_continuous: int, penalty: float) -> np.ndarray:
    """Distances between rows of a and b: Euclidean on the leading continuous
    columns, plus ``penalty`` per differing category under the root."""
    squared = np.zeros((len(a), len(b)))
    for j in range(n_continuous):
        squared += (a[:, j, None] - b[None, :, j]) ** 2
    for j in range(n_continuous, a.shape[1]):
        squared += penalty * (a[:, j, None] != b[None, :, j])
    return np.sqrt(squared)


def _pivot_tree(pivot_rows: np.ndarray, n_continuous: int, penalty: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pivots in the order of their upper pivots, the first root-many of them; how many each has."""
    top = pivot_rows[: math.ceil(math.sqrt(len(pivot_rows)))]
    owner = _distances(pivot_rows, top, n_continuous, penalty).argmin(axis=1)
    order = np.argsort(owner, kind="stable")
    return top, pivot_rows[order], np.searchsorted(owner[order], np.arange(len(top) + 1))


def _slabs(pdf: pd.DataFrame, rows: int = 2048) -> Iterator[pd.DataFrame]:
    for start in range(0, len(pdf), rows):
        yield pdf.iloc[start : start + rows]


class PivotTree:
    """Rows in a metric tree, for queries that are rows themselves.

    About sqrt(n) pivots (at most ``_MOST_PIVOTS``) in two levels: a row belongs to its
    nearest upper pivot, and below that to its nearest pivot. The rows of a pivot are
    cut into blocks in order of their distance to it. A query skips an upper pivot, a
    pivot or a block if its distance to the pivot lies further from the range of
    distances there than its bound, which no row nearer than the bound can. The bound is the
    distance within which k other rows certainly lie: counted over whole pivots, or
    known from a search (``bounds``). Blocks that follow one another, mostly those of an
    upper pivot, lie on a shelf: a query is sent to a shelf once, with the blocks it needs.
    """

    def __init__(
        self, rows: DataFrame, key: str, columns: Sequence[str], n_continuous: int, penalty: float, k: int,
        pivots: int | None = None, block_rows: int = _BLOCK_ROWS,
    ):
        self.key, self.columns, self.k = key, list(columns), k
        self.n_continuous, self.penalty = n_continuous, penalty
        count = rows.count()
        size = pivots or min(_MOST_PIVOTS, max(1, math.ceil(math.sqrt(count))))
        # Many blocks are a large table: past the limit blocks grow instead.
        self.block_rows = max(block_rows, -(-count // _MOST_BLOCKS))
        # Rows are sent to every group of the other side that needs them: larger tables get larger groups.
        self.shelf_rows = max(_SHELF_ROWS, min(4 * _SHELF_ROWS, count // 32))
        chosen = rows.orderBy(F.md5(F.col(key).cast("string"))).select(*columns).limit(size)
        self.pivots = _pivot_tree(np.array([list(r) for r in chosen.collect()], dtype=float), n_continuous, penalty)
        self.edges = cut(self._slot_edges(self._celled(rows)))
        placed = cut(self._blocked(self._celled(rows)))
        table = placed.groupBy("block", "cell").agg(
            F.count(F.lit(1)).alias("n"), F.min("reach").alias("low"), F.max("reach").alias("high"),
            F.min("upper").alias("upper_low"), F.max("upper").alias("upper_high"),
        ).toPandas().sort_values("block")  # at most _MOST_BLOCKS and one for each pivot
        table["shelf"] = _shelves(table["n"].to_numpy(), self.shelf_rows)
        self.layout = {c: table[c].to_numpy() for c in table.columns}
        spark = rows.sparkSession
        self.blocks = spark.createDataFrame(table[["block", "shelf", "n"]]) if count else spark.createDataFrame(
            [], "block long, shelf long, n long")
        self.placed = placed.drop("cell", "upper", "reach").join(F.broadcast(self.blocks.select("block", "shelf")), "block")

    def _celled(self, df: DataFrame) -> DataFrame:
        columns, n_continuous, penalty = self.columns, self.n_continuous, self.penalty
        top, pivots, starts = self.pivots
        fields = ", ".join(f"{c} double" for c in columns)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in itertools.chain.from_iterable(map(_slabs, batches)):
                x = pdf[columns].to_numpy()
                above = _distances(x, top, n_continuous, penalty)
                owner = above.argmin(axis=1)
                cell, reach = np.zeros(len(x), np.int64), np.zeros(len(x))
                for t in np.unique(owner):
                    own = owner == t
                    below = _distances(x[own], pivots[starts[t] : starts[t + 1]], n_continuous, penalty)
                    cell[own], reach[own] = starts[t] + below.argmin(axis=1), below.min(axis=1)
                yield pdf.assign(cell=cell, upper=above.min(axis=1), reach=reach)

        return df.select(self.key, *columns).mapInPandas(
            run, f"{self.key} long, {fields}, cell long, upper double, reach double"
        )

    def _slot_edges(self, celled: DataFrame) -> DataFrame:
        """Equal-frequency edges of the distance to the pivot, for pivots of several blocks."""
        sizes = celled.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > self.block_rows)
        shares = [i / _SLOTS for i in range(1, _SLOTS)]
        edged = celled.join(sizes, "cell").groupBy("cell").agg(
            F.percentile_approx("reach", shares, 10 * _SLOTS).alias("edges"), F.first("n").alias("n")
        )
        step = F.greatest(F.lit(1), F.floor(F.lit(_SLOTS * self.block_rows) / F.col("n"))).cast("int")
        chosen = F.filter("edges", lambda _, i: (i + 1) % step == 0)
        return edged.select("cell", F.array_distinct(chosen).alias("edges"))

    def _blocked(self, celled: DataFrame) -> DataFrame:
        found = celled.join(self.edges, "cell", "left")
        slot = F.coalesce(F.size(F.filter("edges", lambda e: e < F.col("reach"))), F.lit(0))
        slot = F.when(F.col("edges").isNull(), 0).otherwise(slot)
        return found.withColumn("block", F.col("cell") * _SLOTS + slot).drop("edges")

    def home(self, queries: DataFrame, bounds: DataFrame | None = None) -> DataFrame:
        """Each query next to the block it lies in, and that block's shelf. ``bounds``: see ``searches``."""
        found = self._blocked(self._celled(queries)).drop("cell", "upper", "reach")
        found = found.join(F.broadcast(self.blocks.select("block", "shelf")), "block")
        found = found.withColumn("needed", F.array("block"))
        if bounds is None:
            return found.withColumn("bound", F.lit(None).cast("double"))
        return found.join(bounds, self.key, "left")

    def searches(self, home: DataFrame, bounds: DataFrame | None = None, own_shelf: bool | None = None) -> DataFrame:
        """Each query of ``home`` next to every shelf, the blocks of it (``needed``) other than its
        own that may hold one of its k nearest rows, and how far those can lie (``bound``).

        ``bounds`` (key, bound): distances within which k other rows are known. ``own_shelf``: the shelf
        of the query's own block alone, or all shelves but that.
        """
        key, columns, k, n_continuous, penalty = self.key, self.columns, self.k, self.n_continuous, self.penalty
        shipped = home.sparkSession.sparkContext.broadcast((*self.pivots, self.layout))
        home = home.drop("shelf", "needed", "bound")
        asked = home.join(bounds, key, "left") if bounds is not None else home.withColumn("bound", F.lit(None).cast("double"))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            top, pivots, starts, at = shipped.value
            edges = np.searchsorted(at["cell"], starts)  # blocks are in the order of their cells
            parts = [slice(lo, hi) for lo, hi in zip(edges, edges[1:])]
            used = [t for t, p in enumerate(parts) if p.stop > p.start]
            low = np.array([at["upper_low"][parts[t]].min() for t in used])
            high = np.array([at["upper_high"][parts[t]].max() for t in used])
            within = np.array([at["n"][parts[t]].sum() for t in used])
            for pdf in itertools.chain.from_iterable(map(_slabs, batches)):
                x = pdf[columns].to_numpy()
                above = _distances(x, top[used], n_continuous, penalty)
                limit = np.minimum(pdf["bound"].fillna(np.inf).to_numpy(), _certain(above + high, within, k))
                nearest = above.argmin(axis=1)
                query, found = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
                for own_first in (True, False):  # a query's nearest upper pivot first, for its bound
                    for j, t in enumerate(used):
                        gap = np.maximum(above[:, j] - high[j], low[j] - above[:, j])
                        row = np.flatnonzero(((nearest == j) == own_first) & (gap <= slack(limit)))
                        if not len(row):
                            continue
                        own = {name: column[parts[t]] for name, column in at.items()}
                        cells, place = np.unique(own["cell"], return_inverse=True)
                        d = _distances(x[row], pivots[cells], n_continuous, penalty)[:, place]
                        if own_first:
                            limit[row] = np.minimum(limit[row], _certain(d + own["high"], own["n"], k))
                        up = above[row, j][:, None]
                        gap = np.maximum(np.maximum(d - own["high"], own["low"] - d),
                                         np.maximum(up - own["upper_high"], own["upper_low"] - up))
                        i, block = np.nonzero(gap <= slack(limit[row])[:, None])
                        query.append(row[i])
                        found.append(own["block"][block])
                query, found = np.concatenate(query), np.concatenate(found)
                elsewhere = found != pdf["block"].to_numpy()[query]
                query, found = query[elsewhere], found[elsewhere]
                shelf = at["shelf"][np.searchsorted(at["block"], found)]
                if own_shelf is not None:
                    own = at["shelf"][np.searchsorted(at["block"], pdf["block"].to_numpy())]
                    wanted = (shelf == own[query]) == own_shelf
                    query, found, shelf = query[wanted], found[wanted], shelf[wanted]
                order = np.lexsort((found, shelf, query))
                query, found, shelf = query[order], found[order], shelf[order]
                heads = np.flatnonzero((np.diff(query, prepend=-1) != 0) | (np.diff(shelf, prepend=-1) != 0))
                needed = np.split(found, heads[1:]) if len(heads) else []
                yield pdf[[key, *columns]].iloc[query[heads]].assign(shelf=shelf[heads], needed=needed, bound=limit[query[heads]])

        fields = ", ".join(f"{c} double" for c in columns)
        return asked.mapInPandas(run, f"{key} long, {fields}, shelf long, needed array<long>, bound double")

    def nearest_in_blocks(self, searches: DataFrame) -> DataFrame:
        """(key, other, distance, squared, differ): the k nearest rows within the bound on each
        shelf searched, never all pairs. ``squared``: the continuous part; ``differ``: differing categories."""
        key, columns, k, n_continuous, penalty = self.key, self.columns, self.k, self.n_continuous, self.penalty
        load = searches.groupBy("shelf").agg(F.ceil(F.count(F.lit(1)) / self.shelf_rows).alias("query_pieces"))
        # Rows at one distance of a pivot cannot be cut by it: such shelves are dealt in pieces.
        sizes = self.blocks.groupBy("shelf").agg(F.ceil(F.sum("n") / (2 * self.shelf_rows)).alias("row_pieces"))
        layout = cut(sizes.join(load, "shelf"))

        def dealt(df: DataFrame, own: str, other: str, *extra: str) -> DataFrame:
            """Keep a row in one piece of its own side, next to every piece of the other."""
            sized = df.select(*[F.col(c).alias(c) for c in (key, *columns, "shelf", *extra)]).join(layout, "shelf")
            mine = F.pmod(F.xxhash64(key), F.col(own)).alias(own[:-1])
            theirs = F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)).alias(other[:-1])
            return sized.select(F.col("shelf").alias("shelf"), mine, theirs, key, *columns, *extra)

        def best_in_group(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
            none = pd.DataFrame({key: [], "other": [], "distance": [], "squared": [], "differ": []})
            if q.empty or r.empty:
                return none
            r = r.sort_values(key)
            ids, against, block = r[key].to_numpy(), r[columns].to_numpy(), r["block"].to_numpy()
            screen = Screen(against, n_continuous, penalty)
            by_block = np.argsort(block, kind="stable")
            edges = np.flatnonzero(np.diff(block[by_block])) + 1
            members = [
                at[start : start + _PIECE_ROWS]
                for at in np.split(by_block, edges) for start in range(0, len(at), _PIECE_ROWS)
            ]
            out = []
            for part in _slabs(q):
                own, x = part[key].to_numpy(), part[columns].to_numpy()
                factors, error = screen.queries(x)
                limit = slack(part["bound"].fillna(np.inf).to_numpy()) ** 2
                sizes = part["needed"].map(len).to_numpy()
                asked, rows = np.concatenate(part["needed"].to_numpy()), np.repeat(np.arange(len(part)), sizes)
                order = np.argsort(asked, kind="stable")
                asked, rows = asked[order], rows[order]
                found, held = [], 0
                for at in members:
                    first, stop = np.searchsorted(asked, [block[at[0]], block[at[0]] + 1])
                    row = rows[first:stop]
                    if not len(row):
                        continue
                    near = factors[row] @ screen.factors[:, at]
                    inside = near <= up(limit[row] + error[row], near.dtype)[:, None]
                    if near.shape[1] > k and np.count_nonzero(inside) > k * len(row):
                        # Where many rows are inside the limit, the k-th other row is a nearer one.
                        loose = np.flatnonzero(np.count_nonzero(inside, axis=1) > k)
                        kth = np.partition(near[loose], k, axis=1)[:, k].astype(float) + error[row[loose]]
                        limit[row[loose]] = np.minimum(limit[row[loose]], slack(np.maximum(kth, 0)))
                        inside[loose] = near[loose] <= up(limit[row[loose]] + error[row[loose]], near.dtype)[:, None]
                    i, j = np.divmod(np.flatnonzero(inside), near.shape[1])
                    i, j = row[i], at[j]
                    others = own[i] != ids[j]
                    i, j = i[others], j[others]
                    squared, differ = parts_of_distance(x, against, i, j, n_continuous)
                    d = squared + penalty * differ
                    inside = d <= limit[i]
                    found.append((i[inside], j[inside], d[inside], squared[inside], differ[inside]))
                    held += len(found[-1][0])
                    if held > 32 * k * len(part):  # what is known by now bounds the rest
                        found = [first_of_query(found, k)]
                        held = len(found[0][0])
                        full = np.flatnonzero(np.bincount(found[0][0], minlength=len(part)) == k)
                        last = np.searchsorted(found[0][0], full, side="right") - 1
                        limit[full] = np.minimum(limit[full], slack(found[0][2][last]))
                if not held:  # other pieces have these blocks
                    continue
                query, column, distance, squared, differ = first_of_query(found, k)
                out.append(
                    pd.DataFrame({
                        key: own[query], "other": ids[column], "distance": np.sqrt(distance),
                        "squared": squared, "differ": differ,
                    })
                )
            return pd.concat(out) if out else none

        groups = ["shelf", "row_piece", "query_piece"]
        left = dealt(searches, "query_pieces", "row_pieces", "needed", "bound").groupBy(*groups)
        right = dealt(self.placed, "row_pieces", "query_pieces", "block").groupBy(*groups)
        return left.cogroup(right).applyInPandas(
            best_in_group, f"{key} long, other long, distance double, squared double, differ int"
        )

    def compared_pairs(self, searches: DataFrame) -> int:
        """How many pairs of query and row the searches compare."""
        found = searches.select(F.explode("needed").alias("block")).groupBy("block").count().join(self.blocks, "block")
        return found.agg(F.coalesce(F.sum(F.col("count") * F.col("n")), F.lit(0))).first()[0]


def _shelves(sizes: np.ndarray, rows: int) -> np.ndarray:
    """Numbers blocks in a row so that a shelf has up to ``rows`` rows; larger blocks stand alone."""
    out, shelf, held = np.zeros(len(sizes), np.int64), 0, 0
    for k, n in enumerate(sizes.tolist()):
        if held and held + n > rows:
            shelf, held = shelf + 1, 0
        out[k], held = shelf, held + n
    return out


def _certain(far: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
    """Per row the distance within which k other rows lie for certain: column j has ``n[j]``
    rows no farther than ``far[:, j]``. The row itself may be one of them."""
    order = np.argsort(far, axis=1)
    reached = np.cumsum(n[order], axis=1) >= k + 1
    first = reached.argmax(axis=1)
    limit = np.take_along_axis(far, np.take_along_axis(order, first[:, None], 1), 1)[:, 0]
    return np.where(reached.any(axis=1), limit, np.inf)


def known_bounds(found: DataFrame, key: str, k: int) -> DataFrame:
    """(key, bound): the k-th distance of queries with k or more rows in ``found``, k of each block."""
    ranked = first_k(found, key, k).groupBy(key).agg(F.max("place").alias("n"), F.max("distance").alias("bound"))
    return ranked.filter(F.col("n") == k).select(key, "bound")


def nearest_neighbours(
    rows: DataFrame, queries: DataFrame, key: str, columns: Sequence[str], n_continuous: int,
    penalty: float, k: int, pivots: int | None = None, block_rows: int = _BLOCK_ROWS,
    bounds: DataFrame | None = None,
) -> DataFrame:
    """(key, other, distance, squared, differ, place): the k nearest other rows of each
    query row, exactly.

    First each query, one of the rows, searches the block it lies in; the k-th distance
    there is its bound in the tree, and only blocks that can hold something as near are
    searched then (``PivotTree``): with several shelves its own shelf before the rest, as what
    that leaves within the bound of a single block would be most of the work. Groups send back their
    k best per query, never all pairs, and no group holds more than some 65,000 rows of either
    side. Ties go to the smaller key. ``bounds`` (key, bound): distances within which k other rows
    of some queries are known beforehand.
    """
    tree = PivotTree(rows, key, columns, n_continuous, penalty, k, pivots, block_rows)
    home = cut(tree.home(queries, bounds))
    found = cut(tree.nearest_in_blocks(home))

    def known() -> DataFrame:
        so_far = known_bounds(found, key, k)
        return so_far if bounds is None else so_far.unionByName(bounds).groupBy(key).agg(F.min("bound").alias("bound"))

    several = len(np.unique(tree.layout["shelf"])) > 2
    if several:
        beside = cut(tree.searches(home, known(), own_shelf=True))
        found = cut(first_k(found.unionByName(tree.nearest_in_blocks(beside)), key, k).drop("place"))
    searches = cut(tree.searches(home, known(), own_shelf=False if several else None))
    return first_k(found.unionByName(tree.nearest_in_blocks(searches)), key, k)


def nearest_by_scan(
    rows: DataFrame, queries: pd.DataFrame, key: str, columns: Sequence[str], n_continuous: int, penalty: float, k: int
) -> DataFrame:
    """``nearest_neighbours`` of a few queries: one pass over the rows, whose tasks send back k of each query."""
    columns = list(columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, x = queries[key].to_numpy(), queries[columns].to_numpy()
        found = []
        for pdf in itertools.chain.from_iterable(map(_slabs, batches)):
            ids, y = pdf[key].to_numpy(), pdf[columns].to_numpy()
            d = _distances(x, y, n_continuous, penalty)
            d[own[:, None] == ids] = np.inf
            last = np.partition(d, min(k, len(ids)) - 1, axis=1)[:, min(k, len(ids)) - 1]
            i, j = np.nonzero((d <= slack(last)[:, None]) & np.isfinite(d))
            squared, differ = parts_of_distance(x, y, i, j, n_continuous)
            found = [first_of_query([*found, (i, ids[j], np.sqrt(squared + penalty * differ), squared, differ)], k)]
        for i, other, distance, squared, differ in found:
            yield pd.DataFrame({key: own[i], "other": other, "distance": distance, "squared": squared, "differ": differ})

    found = rows.select(key, *columns).mapInPandas(run, f"{key} long, other long, distance double, squared double, differ int")
    return first_k(found, key, k)


def _k_places(found: DataFrame, table: DataFrame, k: int) -> DataFrame:
    """(row_id, other, place): exactly k neighbours per row, copies counted.

    The search runs over distinct rows. A neighbour with several copies fills
    several places, and a row's own further copies come first, at distance 0.
    """
    own = found.select("row_id").distinct().join(table.select("row_id", "copies"), "row_id").filter(
        "copies > 1"
    ).select(
        "row_id", F.col("row_id").alias("other"), F.lit(0).alias("place"), (F.col("copies") - 1).alias("copies")
    )
    others = found.join(
        table.select(F.col("row_id").alias("other"), "copies"), "other"
    ).select("row_id", "other", "place", "copies")
    order = Window.partitionBy("row_id").orderBy("place")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = own.unionByName(others).withColumn("stop", F.sum("copies").over(upto))
    first = F.col("stop") - F.col("copies") + 1
    last = F.least(F.col("stop"), F.lit(k).cast("long"))
    return filled.filter(first <= k).select(
        "row_id", "other", F.explode(F.sequence(first, last)).alias("place")
    )


def _spread_copies(df: DataFrame, count: str, name: str, chunk: int = 10_000) -> DataFrame:
    """Repeat each row ``count`` times, numbered by ``name``; a row with a huge
    count is first cut into chunks that different tasks expand."""
    n = F.col(count)
    chunks = F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / chunk))
    pieces = df.withColumn("_chunk", F.explode(chunks)).repartition("row_id", "_chunk")
    start = F.col("_chunk") * chunk
    return pieces.withColumn(
        name, F.explode(F.sequence(start, F.least(start + chunk, n) - 1))
    ).drop("_chunk")


class _Sizes(NamedTuple):
    minority: object  # its label
    k: int
    n_new: int


def _plan(sizes: Mapping[object, int], neighbours: int) -> _Sizes | None:
    """What to make from class sizes; None if there is nothing to make."""
    sizes = {label: n for label, n in sizes.items() if n}
    if len(sizes) < 2:
        return None
    minority = min(sizes, key=lambda label: (sizes[label], label))
    k, n_new = min(neighbours, sizes[minority] - 1), max(sizes.values()) - sizes[minority]
    return _Sizes(minority, k, n_new) if k >= 1 and n_new >= 1 else None


def _split_columns(features: Sequence[str], continuous: Sequence[str]) -> tuple[list[str], list[str]]:
    measured = [f for f in features if f in set(continuous)]
    return measured, [f for f in features if f not in set(continuous)]


def _penalty(small: DataFrame, measured: Sequence[str]) -> float:
    """What a differing category costs: the squared median deviation."""
    deviations = small.agg(*[F.stddev_pop(c) for c in measured]).first() if measured else []
    return float(np.median(deviations)) ** 2 if measured else 1.0


def _numbered(distinct: DataFrame, columns: Sequence[str], n_new: int, seed: int, keep: Sequence[str] = ()) -> DataFrame:
    """(row_id, columns, copies, n_new): distinct rows numbered in hash order, each with its
    share of the new rows in proportion to its copies. Written down, as it is read often."""
    hashed = distinct.withColumn("_hash", hash_key(*columns, seed)).withColumn("_one", F.lit(1))
    running = prefix_sum(hashed, (), "_hash", ["copies", "_one"], bucket=hash_bucket("_hash"))
    upto = lambda stop: F.floor(F.lit(n_new) * (stop / F.col("total_copies")))
    share = upto(F.col("cum_copies")) - upto(F.col("cum_copies") - F.col("copies"))
    row_id = (F.col("cum__one") - 1).cast("long").alias("row_id")
    return cut(running.select(row_id, *columns, *keep, "copies", share.alias("n_new")))


def smotenc(
    rows: DataFrame, features: Sequence[str], y: str, continuous: Sequence[str],
    neighbours: int, seed: int,
) -> DataFrame:
    """Rows plus synthetic minority rows so that both classes are equally large.

    Continuous features move a random share of the way to a random neighbour;
    every other feature takes the neighbours' most frequent value (the smallest
    on ties). The number of neighbours is capped at minority size - 1. With one
    class, or a minority of one row, the rows are returned as they are.
    """
    plan = _plan({r[y]: r["count"] for r in rows.groupBy(y).count().collect()}, neighbours)
    if plan is None:
        return rows.select(*features, y)
    measured, categories = _split_columns(features, continuous)
    columns = measured + categories
    small = rows.filter(F.col(y) == plan.minority).select(*columns)
    penalty = _penalty(small, measured)
    # Equal rows collapse to one with a copy count, so a vector shared by many
    # rows is searched once.
    distinct = small.groupBy(*columns).agg(F.count(F.lit(1)).alias("copies"))
    table = _numbered(distinct, columns, plan.n_new, seed)
    found = nearest_in_boxes(table, F.col("n_new") > 0, "row_id", columns, len(measured), penalty, plan.k)
    # Lists are read twice; the search runs once.
    return _with_synthetic(rows, features, y, measured, table, cut(found.select("row_id", "other", "place")), plan, seed)


def _with_synthetic(
    rows: DataFrame, features: Sequence[str], y: str, measured: Sequence[str],
    table: DataFrame, found: DataFrame, plan: _Sizes, seed: int,
) -> DataFrame:
    categories = [f for f in features if f not in measured]
    columns = [*measured, *categories]
    k = plan.k
    bases = table.filter("n_new > 0")
    places = _k_places(found, table, k)
    values = table.select(
        F.col("row_id").alias("other"), *[F.col(c).alias(f"o_{c}") for c in columns]
    )
    gathered = (
        places.join(values, "other")
        .groupBy("row_id")
        .agg(
            F.map_from_entries(
                F.collect_list(F.struct("place", F.struct(F.col("other"), *[f"o_{c}" for c in measured])))
            ).alias("near"),
            *[F.mode(f"o_{c}", deterministic=True).alias(f"m_{c}") for c in categories],
        )
    )
    drawn = _spread_copies(bases.join(gathered, "row_id"), "n_new", "slot")
    draw = lambda purpose: uniform(hash_key(F.lit(purpose), "row_id", "slot", seed))
    synthetic = (
        drawn.withColumn("_near", F.col("near")[F.floor(draw("neighbour") * k) + 1])
        .withColumn("_gap", draw("gap"))
        .select(
            *[
                (F.col(f) + F.col("_gap") * (F.col("_near")[f"o_{f}"] - F.col(f))).alias(f)
                if f in measured
                else F.col(f"m_{f}").alias(f)
                for f in features
            ],
            F.lit(plan.minority).cast(rows.schema[y].dataType).alias(y),
        )
    )
    return rows.select(*features, y).unionByName(synthetic)


class FoldNeighbours:
    """One neighbour search for SMOTENC on every fold's training rows.

    The distinct minority rows of the whole pool keep their ``depth`` nearest others, with
    the continuous and the categorical part of the distance apart. A fold's lists are read
    off: rows that only the fold has are left out, and the rest is ranked by the distance
    that holds there, as the price of a category depends on the rows. Rows beyond the depth
    are at least as far as the last one kept; a list that this does not settle, or
    that has too few left, is searched again among the fold's rows. Lists are therefore
    those of a search of its own.
    """

    def __init__(
        self, pool: DataFrame, features: Sequence[str], y: str, continuous: Sequence[str], fold: str,
        neighbours: int, seed: int, depth: int | None = None,
    ):
        self.features, self.y, self.fold = list(features), y, fold
        self.continuous, self.neighbours, self.seed = list(continuous), neighbours, seed
        self.depth = depth or 2 * neighbours + 6
        self.measured, categories = _split_columns(features, continuous)
        self.columns = self.measured + categories
        self.sizes = {(r[0], r[1]): r[2] for r in pool.groupBy(y, fold).count().collect()}  # classes x folds
        plan = self._plan(None)
        self.minority = plan.minority if plan else None
        if plan is None:
            return
        small = pool.filter(F.col(y) == plan.minority)
        self.penalty = _penalty(small, self.measured)
        counted = small.groupBy(*self.columns, fold).agg(F.count(F.lit(1)).alias("n"))
        distinct = counted.groupBy(*self.columns).agg(
            F.map_from_entries(F.collect_list(F.struct(fold, "n"))).alias("by_fold"), F.sum("n").alias("copies")
        )
        self.table = _numbered(distinct, self.columns, 0, seed, ["by_fold"])
        found = nearest_in_boxes(self.table, F.lit(True), "row_id", self.columns, len(self.measured), self.penalty, self.depth)
        self.found = cut(found.select("row_id", "other", "squared", "differ", "place"))

    def _plan(self, left_out) -> _Sizes | None:
        sizes: dict[object, int] = {}
        for (label, fold), n in self.sizes.items():
            if left_out is None or fold != left_out:
                sizes[label] = sizes.get(label, 0) + n
        return _plan(sizes, self.neighbours)

    def oversampled(self, rows: DataFrame, left_out=None) -> DataFrame:
        """``smotenc`` of ``rows``: the pool, without the fold ``left_out`` if given."""
        plan = self._plan(left_out)
        if plan is None or plan.minority != self.minority:
            return smotenc(rows, self.features, self.y, self.continuous, self.neighbours, self.seed)
        penalty = _penalty(rows.filter(F.col(self.y) == plan.minority), self.measured)
        gone = F.lit(0) if left_out is None else F.coalesce(F.col("by_fold")[F.lit(left_out)], F.lit(0))
        own = self.table.withColumn("copies", F.col("copies") - gone).filter("copies > 0")
        own = own.select(F.col("row_id").alias("pool_id"), *self.columns, "copies")
        table = _numbered(own, self.columns, plan.n_new, self.seed, ["pool_id"])
        settled, open_rows = self._read_off(table, plan.k, penalty)
        bases = table.join(open_rows, "row_id", "left_semi")
        if not bases.isEmpty():
            args = (self.columns, len(self.measured), penalty, plan.k)
            few = bases.select("row_id", *self.columns).limit(_FEW_QUERIES + 1).toPandas()
            if len(few) <= _FEW_QUERIES:
                again = nearest_by_scan(table, few, "row_id", *args)
            else:
                again = nearest_neighbours(table, bases, "row_id", *args, bounds=open_rows.filter("bound IS NOT NULL"))
            settled = settled.unionByName(again.select(*settled.columns))
        return _with_synthetic(rows, self.features, self.y, self.measured, table.drop("pool_id"), settled, plan, self.seed)

    def _read_off(self, table: DataFrame, k: int, penalty: float) -> tuple[DataFrame, DataFrame]:
        """(row_id, other, distance, place) of lists that the depth settles; row_id of the rest and
        the distance within which k rows of their lists lie, if there are as many."""
        ids = table.select(F.col("pool_id").alias("pool_id"), F.col("row_id").alias("row_id"), "n_new")
        bases = ids.filter("n_new > 0").select("pool_id", "row_id")
        kept = self.found.withColumnRenamed("row_id", "pool_id").withColumnRenamed("other", "pool_other")
        last = kept.groupBy("pool_id").agg(
            F.count(F.lit(1)).alias("n"), F.max(F.col("squared") + self.penalty * F.col("differ")).alias("edge")
        )
        others = ids.select(F.col("pool_id").alias("pool_other"), F.col("row_id").alias("other"))
        distance = F.sqrt(F.col("squared") + penalty * F.col("differ"))
        lists = kept.join(bases, "pool_id").join(others, "pool_other").select("row_id", "other", distance.alias("distance"))
        lists = first_k(lists, "row_id", k)
        # At another price of a category, what lies beyond the edge keeps at least this share of it.
        share = min(1.0, penalty / self.penalty) if self.penalty > 0 else 1.0
        reach = lists.groupBy("row_id").agg(F.max("place").alias("have"), F.max("distance").alias("far"))
        state = bases.join(last, "pool_id", "left").join(reach, "row_id", "left")
        whole = F.coalesce(F.col("n"), F.lit(0)) < self.depth  # all other rows of the pool are in the list
        inside = (F.col("have") == k) & (F.col("far") * F.col("far") < F.col("edge") * share * (1 - 1e-9))
        state = cut(state.select(
            "row_id", F.coalesce(whole | inside, F.lit(False)).alias("settled"), F.when(F.col("have") == k, F.col("far")).alias("bound")
        ))
        settled = lists.join(state.filter("settled"), "row_id", "left_semi")
        return settled, state.filter("NOT settled").select("row_id", "bound")
