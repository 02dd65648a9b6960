"""Running totals and ranks without a single-partition window.

Rows are cut into ordered buckets, a window runs inside each (part, bucket), and
the total of all earlier buckets is added from a small offset table. No window
group holds more than about one bucket's share of the distinct keys, even if one
part holds most rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from surveyspark.functions.hashing import hash_integer

_BUCKET = "_bucket"
_WHOLE = "_whole"
_HASH_DIGITS = 3  # 4096 ordered buckets of equal expected size


def bucket_count(spark: SparkSession) -> int:
    """Buckets for a data-driven cut: a few per shuffle partition, a square number."""
    wanted = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    side = math.ceil(math.sqrt(min(max(wanted, 64), 4096)))
    return side * side


def _with_edge_bucket(df: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """Add the bucket number of ``key`` from approximate quantile edges of its rows.

    The edges are a scalar subquery: a fixed number of doubles, whatever the row
    count. They only balance the work; results do not depend on them. The value
    columns ride along in the subquery so that it reads the same shuffle as the
    rows themselves instead of computing its own.
    """
    n = bucket_count(df.sparkSession)
    side = math.isqrt(n)
    edges = df.agg(
        F.percentile_approx(F.col(key).cast("double"), [i / n for i in range(1, n)], 20 * n).alias("e"),
        *[F.sum(v).alias(f"t_{v}") for v in values],
    )
    # Coarse edges first, then the fine edges of one coarse cell: about
    # 2 * sqrt(n) comparisons per row.
    coarse = F.array(*[F.col("e")[i] for i in range(side - 1, n - 1, side)])
    cut = edges.select(F.struct(F.col("e"), coarse.alias("c"), *[f"t_{v}" for v in values])).scalar()
    value = F.col(key).cast("double")
    cell = F.size(F.filter("_cut.c", lambda e: e < value))
    fine = F.slice("_cut.e", F.col("_cell") * side + 1, F.lit(side))
    return (
        df.withColumn("_cut", cut)
        .withColumn("_cell", cell)
        .withColumn(_BUCKET, F.col("_cell") * side + F.size(F.filter(fine, lambda e: e < value)))
        .drop("_cut", "_cell")
    )


def prefix_sum(
    df: DataFrame,
    parts: Sequence[str],
    key: str,
    values: Sequence[str],
    bucket: Column | None = None,
    previous: bool = False,
) -> DataFrame:
    """Add ``cum_v`` (inclusive running total by ascending key) and ``total_v``.

    ``df`` has one row per (parts, key). ``bucket`` may give an order-preserving
    integer cut of the key; by default it is cut at quantiles of the data.
    ``previous=True`` also adds ``prev_v``: the value at the next lower key.
    """
    parts = list(parts)
    if not parts:
        whole = df.withColumn(_WHOLE, F.lit(0))
        return prefix_sum(whole, [_WHOLE], key, values, bucket, previous).drop(_WHOLE)

    cut = _with_edge_bucket(df, key, values) if bucket is None else df.withColumn(_BUCKET, bucket)
    # Never null. Otherwise the join below would imply an is-not-null filter,
    # which the optimizer pushes through the aggregation onto the raw rows.
    cut = cut.withColumn(_BUCKET, F.coalesce(F.col(_BUCKET), F.lit(-1)))
    inside = Window.partitionBy(*parts, _BUCKET).orderBy(key)
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = {f"cum_{v}": F.sum(v).over(running) for v in values}
    if previous:
        local |= {f"prev_{v}": F.lag(v).over(inside) for v in values}

    # One row per (part, bucket): few, and already partially summed.
    buckets = cut.groupBy(*parts, _BUCKET).agg(
        *[F.sum(v).alias(f"sum_{v}") for v in values],
        *([F.max_by(v, key).alias(f"last_{v}") for v in values] if previous else []),
    )
    across = Window.partitionBy(*parts)
    ordered = across.orderBy(_BUCKET)
    earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.select(
        *parts,
        _BUCKET,
        *[F.coalesce(F.sum(f"sum_{v}").over(earlier), F.lit(0)).alias(f"off_{v}") for v in values],
        *[F.sum(f"sum_{v}").over(across).alias(f"total_{v}") for v in values],
        *([F.lag(f"last_{v}").over(ordered).alias(f"tail_{v}") for v in values] if previous else []),
    )
    joined = cut.withColumns(local).join(offsets, [*parts, _BUCKET])
    final = {f"cum_{v}": F.col(f"cum_{v}") + F.col(f"off_{v}") for v in values}
    if previous:
        final |= {f"prev_{v}": F.coalesce(f"prev_{v}", f"tail_{v}") for v in values}
    drop = [_BUCKET, *[f"off_{v}" for v in values], *[f"tail_{v}" for v in values]]
    return joined.withColumns(final).drop(*drop)


def hash_bucket(hashed: str) -> Column:
    """Order-preserving bucket of an md5 hex column; even by construction."""
    return hash_integer(F.col(hashed), _HASH_DIGITS)


def hash_rank(
    df: DataFrame, hashed: str, parts: Sequence[str] = (), rank: str = "rank", count: str = "n_keys"
) -> DataFrame:
    """Rank rows from 0 by an md5 hex column, and add the number of rows.

    Hash prefixes cut the rows evenly by construction, so no quantile pass is
    needed.
    """
    ranked = prefix_sum(
        df.withColumn("_one", F.lit(1)), parts, hashed, ["_one"],
        bucket=hash_bucket(hashed),
    )
    return ranked.select(
        *df.columns, (F.col("cum__one") - 1).alias(rank), F.col("total__one").alias(count)
    )


def interpolated_quantiles(
    df: DataFrame, parts: Sequence[str], key: str, count: str, probabilities: Sequence[float],
    position: Callable[[Column, float], Column] | None = None,
) -> DataFrame:
    """Exact linearly interpolated quantiles of a (parts, key, count) histogram.

    Returns parts and ``quantiles``, an array in the order of ``probabilities``.
    ``position(n, p)`` gives the fractional rank from 0; by default (n - 1) * p.
    Only the keys at the ranks next to each quantile leave their tasks.
    """
    parts = list(parts)
    running = prefix_sum(df, parts, key, [count])
    total = F.col(f"total_{count}")
    position = position or (lambda n, p: (n - 1) * F.lit(float(p)))
    start, stop = F.col(f"cum_{count}") - F.col(count), F.col(f"cum_{count}")

    def hits(i: int, p: float) -> Column:
        """(index, share) if this key sits at the lower or upper rank of p."""
        at = position(total, p)
        low, high = F.floor(at), F.ceil(at)
        fraction = at - low
        share = (
            F.when((start <= low) & (low < stop), 1 - fraction).otherwise(0.0)
            + F.when((start <= high) & (high < stop), fraction).otherwise(0.0)
        )
        touched = ((start <= low) & (low < stop)) | ((start <= high) & (high < stop))
        return F.when(touched, F.struct(F.lit(i).alias("i"), share.alias("share")))

    found = running.select(
        *parts,
        F.col(key).cast("double").alias("_key"),
        F.array_compact(F.array(*[hits(i, p) for i, p in enumerate(probabilities)])).alias("_hits"),
    ).filter(F.size("_hits") > 0)
    pieces = found.select(*parts, "_key", F.inline("_hits"))
    per_quantile = pieces.groupBy(*parts, "i").agg(F.sum(F.col("_key") * F.col("share")).alias("q"))
    gathered = per_quantile.groupBy(*parts).agg(
        F.array_sort(F.collect_list(F.struct("i", "q"))).alias("_q")
    )
    return gathered.select(*parts, F.col("_q.q").alias("quantiles"))
