"""Exact nearest rows by boxes: blocks of rows that share ranges and categories.

Rows are split like a k-d tree, each time along the column that adds most to the distances:
at a value of a continuous column, or into two sets of categories. A query leaves out a block
whose ranges and categories keep it farther than k rows that are known. Blocks travel packed,
a record each in the narrowest type that holds their values, and queries and rows meet in
few wide groups: the volume moved is a row's few bytes times the groups of the other side,
with no list of pairs or of blocks a query.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveyspark.functions.checkpoints import cut

_BLOCK_ROWS = 1024  # rows of a box
_PIECE_ROWS = 16_384  # rows that are cut into boxes in one task
_GROUP_ROWS = 262_144  # most rows of either side that meet in one task
_GROUPS = 8  # of either side, if those are smaller
_MOST_GROUPS = 1024  # partitions of pairs of groups
_SLAB_ROWS = 2048  # queries worked on at once
_SAMPLE = 64  # rows that place a piece's edges
_MOST_SAMPLE = 65_536  # of them on the driver
_MOST_WIDTH = 256  # categories in a screen; columns beyond are only measured


class Screen:
    """Rows as factors of a matrix product that gives squared distances to them, in single
    precision with a bound of its error, so that only rows it cannot rule out are measured."""

    def __init__(self, rows: np.ndarray, n_continuous: int, penalty: float):
        self.n_continuous, self.penalty = n_continuous, penalty
        measured, categories = rows[:, :n_continuous], rows[:, n_continuous:]
        self.center = measured.mean(axis=0)
        self.levels = [np.unique(c) for c in categories.T]
        # Squares beyond single precision stay in double.
        self.dtype = np.float32 if np.abs(measured).max(initial=0.0) < 1e15 else np.float64
        lengths = ((measured - self.center) ** 2).sum(axis=1)
        self.longest = math.sqrt(lengths.max(initial=0.0))
        self.factors = self._factors(rows, lengths, 1.0, 1.0, 1.0, self.dtype).T.copy()

    def _factors(self, rows, first, second, measured_by: float, shared_by: float, dtype) -> np.ndarray:
        n = self.n_continuous
        out = np.empty((len(rows), n + sum(map(len, self.levels)) + 2), dtype)
        out[:, :n] = (rows[:, :n] - self.center) * measured_by
        at = n
        for c, levels in zip(rows[:, n:].T, self.levels):
            out[:, at : at + len(levels)] = (c[:, None] == levels) * shared_by
            at += len(levels)
        out[:, -2], out[:, -1] = first, second
        return out

    def queries(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Factors of ``x``, and by how much each one's squared distances may be off."""
        apart = self.penalty * len(self.levels)
        lengths = ((x[:, : self.n_continuous] - self.center) ** 2).sum(axis=1)
        dtype = self.dtype if lengths.max(initial=0.0) < 1e30 else np.float64
        factors = self._factors(x, 1.0, lengths + apart, -2.0, -self.penalty, dtype)
        size = (np.sqrt(lengths) + self.longest) ** 2 + 2 * apart
        return factors, (factors.shape[1] + 4) * 2.0 * np.finfo(self.dtype).eps * size


def parts_of_distance(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, n_continuous: int) -> tuple[np.ndarray, np.ndarray]:
    """(squared continuous part, differing categories) of rows i of x and j of y, pair by pair."""
    squared, differ = np.zeros(len(i)), np.zeros(len(i), np.int64)
    for c in range(x.shape[1]):
        a, b = x[:, c][i], y[:, c][j]
        if c < n_continuous:
            squared += (a - b) ** 2
        else:
            differ += a != b
    return squared, differ


def first_of_query(found: list[tuple], k: int) -> tuple:
    """The first k pairs of each query by (distance, row), of (query, row, distance, squared, differ)."""
    query, row, distance, squared, differ = map(np.concatenate, zip(*found))
    order = np.lexsort((row, distance, query))
    ranked = query[order]
    kept = order[np.arange(len(ranked)) - np.searchsorted(ranked, ranked) < k]
    return query[kept], row[kept], distance[kept], squared[kept], differ[kept]


def up(limit: np.ndarray, dtype) -> np.ndarray:
    """``limit`` in ``dtype``, never rounded down."""
    return np.nextafter(limit.astype(dtype), np.dtype(dtype).type(np.inf))


def slack(limit: np.ndarray) -> np.ndarray:
    """Distances come from two formulas, whose rounding must not drop a row."""
    return limit + 1e-6 * (1 + limit)


def first_k(found: DataFrame, key: str, k: int) -> DataFrame:
    nearest = Window.partitionBy(key).orderBy("distance", "other")
    return found.withColumn("place", F.row_number().over(nearest)).filter(F.col("place") <= k)


def _split(x: np.ndarray, n_continuous: int, penalty: float) -> tuple[int, np.ndarray] | None:
    """(column, values of the left side) of the split along the widest column; None if all rows
    are equal. Of a continuous column the left side is all up to the last of the values."""
    spread, kinds = np.zeros(x.shape[1]), {}
    spread[:n_continuous] = x[:, :n_continuous].var(axis=0)
    for c in range(n_continuous, x.shape[1]):
        kinds[c] = np.unique(x[:, c], return_counts=True)
        spread[c] = penalty * (1 - ((kinds[c][1] / len(x)) ** 2).sum()) / 2
    for c in np.argsort(-spread, kind="stable"):
        values, counts = kinds[c] if c in kinds else np.unique(x[:, c], return_counts=True)
        if len(values) < 2:
            continue
        order = np.argsort(-counts, kind="stable") if c >= n_continuous else np.arange(len(values))
        share = np.cumsum(counts[order])[:-1] / len(x)
        return int(c), values[order[: np.abs(share - 0.5).argmin() + 1]]
    return None


def _left(column: np.ndarray, values: np.ndarray, continuous: bool) -> np.ndarray:
    return column <= values[-1] if continuous else np.isin(column, values)


def boxed(x: np.ndarray, rows: int, n_continuous: int, penalty: float) -> list[np.ndarray]:
    """Row numbers of ``x`` in boxes of up to ``rows`` rows, neighbours in the tree next to each other."""
    out, todo = [], [np.arange(len(x))]
    while todo:
        at = todo.pop()
        found = _split(x[at], n_continuous, penalty) if len(at) > rows else None
        if found is None:
            out.extend(at[start : start + rows] for start in range(0, len(at), rows))
            continue
        left = _left(x[at, found[0]], found[1], found[0] < n_continuous)
        todo += [at[~left], at[left]]
    return out


def _tree(x: np.ndarray, rows: float, n_continuous: int, penalty: float, leaves: itertools.count):
    """Nested (column, values, left, right) whose leaves are numbers, of up to ``rows`` rows each."""
    found = _split(x, n_continuous, penalty) if len(x) > rows else None
    if found is None:
        return next(leaves)
    left = _left(x[:, found[0]], found[1], found[0] < n_continuous)
    return (*found, *(_tree(x[side], rows, n_continuous, penalty, leaves) for side in (left, ~left)))


def _placed(x: np.ndarray, tree, n_continuous: int) -> np.ndarray:
    out, todo = np.zeros(len(x), np.int64), [(np.arange(len(x)), tree)]
    while todo:
        at, node = todo.pop()
        if isinstance(node, int):
            out[at] = node
        elif len(at):
            left = _left(x[at, node[0]], node[1], node[0] < n_continuous)
            todo += [(at[left], node[2]), (at[~left], node[3])]
    return out


def packed(values: np.ndarray) -> bytes:
    """The array in the narrowest type that holds its values, behind that type's letter."""
    for kind in ("b", "h", "i", "f"):
        with np.errstate(all="ignore"):
            small = values.astype(kind)
        if np.array_equal(small.astype(values.dtype), values):
            return kind.encode() + small.tobytes()
    return values.dtype.char.encode() + values.tobytes()


def unpacked(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, data[:1].decode(), offset=1).reshape(-1, width).astype(float)


class Boxes:
    """Blocks of rows, ready to be searched."""

    def __init__(self, ids: list[np.ndarray], rows: list[np.ndarray], n_continuous: int, penalty: float):
        self.n_continuous, self.penalty = n_continuous, penalty
        self.ids, self.rows = np.concatenate(ids), np.concatenate(rows)
        self.starts = np.cumsum([0, *map(len, rows)])
        heads = self.starts[:-1]
        measured = self.rows[:, :n_continuous]
        self.low, self.high = np.minimum.reduceat(measured, heads), np.maximum.reduceat(measured, heads)
        kinds = [len(np.unique(c)) for c in self.rows[:, n_continuous:].T]
        narrow = np.argsort(kinds, kind="stable")
        narrow = np.sort(narrow[np.cumsum(np.array(kinds)[narrow]) <= _MOST_WIDTH]) if kinds else narrow.astype(int)
        self.screened = np.concatenate([np.arange(n_continuous), n_continuous + narrow]).astype(int)
        self.screen = Screen(self.rows[:, self.screened], n_continuous, penalty)
        held = [np.logical_or.reduceat(c[:, None] == levels, heads) for c, levels in zip(
            self.rows[:, self.screened[n_continuous:]].T, self.screen.levels)]
        self.held = np.concatenate(held, axis=1).T.astype(np.float32) if held else np.zeros((0, len(heads)), np.float32)

    def gaps(self, x: np.ndarray) -> np.ndarray:
        """queries x blocks: squared distances that no row of the block is nearer than."""
        shares = [(c[:, None] == levels) for c, levels in zip(x[:, self.screened[self.n_continuous :]].T, self.screen.levels)]
        shared = np.concatenate(shares, axis=1).astype(np.float32) @ self.held if shares else np.zeros((len(x), 1))
        out = self.penalty * (len(shares) - shared.astype(float)) + np.zeros((1, len(self.starts) - 1))
        for c in range(self.n_continuous):
            out += np.maximum(0, np.maximum(self.low[:, c] - x[:, c, None], x[:, c, None] - self.high[:, c])) ** 2
        return out

    def nearest(self, own: np.ndarray, x: np.ndarray, limit: np.ndarray, k: int, first: int = 0) -> tuple:
        """(query, row id, distance, squared, differ): the first k other rows of each query within
        ``limit``, its squared bound. Blocks next to number ``first`` come first."""
        limit, gaps = slack(limit), self.gaps(x)
        factors, error = self.screen.queries(x[:, self.screened])
        needed = np.flatnonzero((gaps <= limit[:, None]).any(axis=0))
        found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0), np.empty(0, np.int64))]
        held = 0
        for b in needed[np.argsort(np.abs(needed - first), kind="stable")]:
            row = np.flatnonzero(gaps[:, b] <= limit)
            if not len(row):
                continue
            at = slice(self.starts[b], self.starts[b + 1])
            near = factors[row] @ self.screen.factors[:, at]
            inside = near <= up(limit[row] + error[row], near.dtype)[:, None]
            if near.shape[1] > k and np.count_nonzero(inside) > k * len(row):
                # Where many rows are inside the limit, the k-th other row is a nearer one,
                # unless columns that the screen leaves out keep it away.
                loose = np.flatnonzero(np.count_nonzero(inside, axis=1) > k)
                kth = np.partition(near[loose], k, axis=1)[:, k].astype(float) + error[row[loose]]
                kth += self.penalty * (x.shape[1] - len(self.screened))
                limit[row[loose]] = np.minimum(limit[row[loose]], slack(np.maximum(kth, 0)))
                inside[loose] = near[loose] <= up(limit[row[loose]] + error[row[loose]], near.dtype)[:, None]
            i, j = np.divmod(np.flatnonzero(inside), near.shape[1])
            i, j = row[i], j + at.start
            others = own[i] != self.ids[j]
            i, j = i[others], j[others]
            squared, differ = parts_of_distance(x, self.rows, i, j, self.n_continuous)
            d = squared + self.penalty * differ
            inside = d <= limit[i]
            found.append((i[inside], self.ids[j[inside]], np.sqrt(d[inside]), squared[inside], differ[inside]))
            held += len(found[-1][0])
            if held > 8 * k * len(x):  # what is known by now bounds the rest
                found = [first_of_query(found, k)]
                held = len(found[0][0])
                limit = np.minimum(limit, slack(kth_squares(found[0], len(x), k)))
        return first_of_query(found, k)


def kth_squares(found: tuple, queries: int, k: int) -> np.ndarray:
    """Each query's k-th squared distance in what ``first_of_query`` found; infinite with fewer rows."""
    out = np.full(queries, np.inf)
    full = np.flatnonzero(np.bincount(found[0], minlength=queries) == k)
    out[full] = found[2][np.searchsorted(found[0], full, side="right") - 1] ** 2
    return out


def _pieces(rows: DataFrame, key: str, columns: list[str], n_continuous: int, penalty: float) -> DataFrame:
    """``rows`` with the number of their piece, which neighbours share. The edges come from the
    first rows by hash; results do not depend on them."""
    count = rows.count()
    pieces = max(1, -(-count // _PIECE_ROWS))
    sample = rows.orderBy(F.md5(F.col(key).cast("string"))).select(*columns).limit(min(_MOST_SAMPLE, _SAMPLE * pieces))
    edges = np.array([list(r) for r in sample.collect()], dtype=float).reshape(-1, len(columns))
    tree = _tree(edges, max(1, len(edges) / pieces), n_continuous, penalty, itertools.count()) if pieces > 1 else 0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(piece=_placed(pdf[columns].to_numpy(float), tree, n_continuous))

    fields = ", ".join(f"{c} double" for c in columns)
    return rows.mapInPandas(run, f"{key} long, {fields}, asked boolean, piece long")


def _packed_blocks(rows: DataFrame, key: str, columns: list[str], n_continuous: int, penalty: float, k: int) -> DataFrame:
    """(piece, block, n, n_asked, ids, rows, asked, bounds): a record a box, arrays packed.
    ``bounds``: squared distances within which k other rows of the piece lie, of each query."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        ids, x, asked = pdf[key].to_numpy(), pdf[columns].to_numpy(float), pdf["asked"].to_numpy(bool)
        at = boxed(x, _BLOCK_ROWS, n_continuous, penalty)
        boxes, out = Boxes([ids[b] for b in at], [x[b] for b in at], n_continuous, penalty), []
        for number, b in enumerate(at):
            q = b[asked[b]]
            bounds = np.full(len(q), np.inf)
            if len(q):
                bounds = kth_squares(boxes.nearest(ids[q], x[q], bounds, k, number), len(q), k)
            out.append((pdf["piece"].iloc[0], number, len(b), len(q), ids[b].tobytes(), packed(x[b]),
                        np.packbits(asked[b]).tobytes(), bounds.tobytes()))
        return pd.DataFrame(out, columns=["piece", "block", "n", "n_asked", "ids", "rows", "asked", "bounds"])

    placed = _pieces(rows, key, columns, n_continuous, penalty)
    return placed.groupBy("piece").applyInPandas(
        run, "piece long, block long, n long, n_asked long, ids binary, rows binary, asked binary, bounds binary"
    )


def _groups(sizes: np.ndarray) -> np.ndarray:
    """Deals pieces to groups of about ``_GROUP_ROWS`` rows, or an ``_GROUPS``-th of fewer. Neighbours go to
    different groups, as their rows are what is compared most."""
    wanted = max(1, min(_GROUP_ROWS, -(-int(sizes.sum()) // _GROUPS)))
    return np.arange(len(sizes)) % max(1, min(len(sizes), -(-int(sizes.sum()) // wanted)))


def nearest_in_boxes(
    rows: DataFrame, asked: Column, key: str, columns: Sequence[str], n_continuous: int, penalty: float, k: int
) -> DataFrame:
    """(key, other, distance, squared, differ, place): the k nearest other rows of each row that
    is ``asked``, exactly; ``columns`` begins with the ``n_continuous`` continuous ones. Ties go to the smaller key.

    A query first searches its own piece of some 16,000 rows, for its bound; then groups of
    queries and of rows meet, each in one task, and send back what is within the bounds, k a
    query at most. ``squared``: the continuous part; ``differ``: differing categories.
    """
    columns = list(columns)
    flagged = rows.select(key, *[F.col(c).cast("double").alias(c) for c in columns], asked.alias("asked"))
    blocks = cut(_packed_blocks(flagged, key, columns, n_continuous, penalty, k))
    spark = rows.sparkSession
    sizes = blocks.groupBy("piece").agg(F.sum("n").alias("n"), F.sum("n_asked").alias("n_asked")).toPandas().sort_values("piece")
    sizes = sizes.assign(row_group=_groups(sizes["n"].to_numpy(np.int64)), query_group=_groups(sizes["n_asked"].to_numpy(np.int64)))
    layout = [tuple(map(int, r)) for r in sizes[["piece", "row_group", "query_group"]].itertuples(index=False)]
    table = spark.createDataFrame(layout, "piece long, row_group long, query_group long")
    numbered = blocks.join(F.broadcast(table), "piece")

    def every(name: str) -> Column:
        last = int(sizes[name].max()) if len(sizes) else 0
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long"))).alias(name)

    def side(df: DataFrame, own: str, other: str, *names: str) -> DataFrame:
        """Each record next to every group of the other side."""
        return df.select(F.col(own).alias(own), every(other), *[F.col(c).alias(c) for c in ("piece", "block", "ids", "rows", *names)])

    left = side(numbered.filter("n_asked > 0"), "query_group", "row_group", "asked", "bounds")
    right = side(numbered, "row_group", "query_group")

    def best(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        names = [key, "other", "distance", "squared", "differ"]
        if q.empty or r.empty:
            return pd.DataFrame({name: [] for name in names})
        r, q = r.sort_values(["piece", "block"]), q.sort_values(["piece", "block"])
        width = len(columns)
        boxes = Boxes([np.frombuffer(b, np.int64) for b in r["ids"]], [unpacked(b, width) for b in r["rows"]], n_continuous, penalty)
        at = {place: number for number, place in enumerate(zip(r["piece"], r["block"]))}
        out, waiting = [], []

        def search() -> None:
            own, x, bounds = map(np.concatenate, zip(*[w[:3] for w in waiting]))
            query, other, distance, squared, differ = boxes.nearest(own, x, bounds, k, waiting[0][3])
            out.append(pd.DataFrame(dict(zip(names, (own[query], other, distance, squared, differ)))))
            waiting.clear()

        for piece, block, ids, values, flags, bounds in q[["piece", "block", "ids", "rows", "asked", "bounds"]].itertuples(index=False):
            ids = np.frombuffer(ids, np.int64)
            own = np.unpackbits(np.frombuffer(flags, np.uint8), count=len(ids)).astype(bool)
            if waiting and sum(len(w[0]) for w in waiting) + own.sum() > _SLAB_ROWS:
                search()
            waiting.append((ids[own], unpacked(values, width)[own], np.frombuffer(bounds), at.get((piece, block), 0)))
        search()
        return pd.concat(out)

    groups = ["query_group", "row_group"]
    # Few bytes and much work: a partition a group, which adaptive execution would join.
    parts = min(_MOST_GROUPS, math.prod(int(sizes[name].max()) + 1 if len(sizes) else 1 for name in groups))
    left, right = (df.repartition(parts, *groups) for df in (left, right))
    found = left.groupBy(*groups).cogroup(right.groupBy(*groups)).applyInPandas(
        best, f"{key} long, other long, distance double, squared double, differ int"
    )
    return first_k(found, key, k)
