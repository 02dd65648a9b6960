"""Cluster bootstrap: resample whole clusters, recompute metrics, take percentiles."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyspark.functions.checkpoints import cut
from surveyspark.functions.hashing import hash_key, uniform
from surveyspark.operators import metrics
from surveyspark.operators.metrics import score_histogram, statistic_vector
from surveyspark.operators.prefix import hash_rank
from surveyspark.operators.stats import union_all

SUMS = ("tp", "fp", "pos", "neg", "squared")
_MOST_BUCKETS = 2000


def cluster_draws(df: DataFrame, cluster: str, replicates: int, seed: int) -> DataFrame:
    """(cluster, replicates): the replicates that drew the cluster, with repeats.

    With K clusters, each replicate makes K draws with replacement. A cluster's
    own rank doubles as the slot number of one draw per replicate, so the
    B x K draws are generated where the clusters are, with no driver count.
    """
    keys = (
        df.select(cluster)
        .filter(F.col(cluster).isNotNull())
        .distinct()
        .withColumn("_hash", hash_key(cluster, seed))
    )
    ranked = hash_rank(keys, "_hash").select(cluster, "rank", "n_keys")
    slots = ranked.select("rank", "n_keys", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("b"))
    picked = F.floor(uniform(hash_key("b", "rank", seed)) * F.col("n_keys")).cast("long")
    draws = slots.select("b", picked.alias("pick")).groupBy("pick").agg(
        F.collect_list("b").alias("replicates")
    )
    return ranked.join(draws, F.col("rank") == F.col("pick")).select(cluster, "replicates")


def packed_draws(draws: DataFrame, block: range) -> DataFrame:
    """(cluster, times): how often each replicate of ``block`` drew the cluster, in 16-bit numbers."""
    name, width = draws.columns[0], len(block)
    own = F.transform(
        F.filter("replicates", lambda b: (b >= block.start) & (b < block.stop)), lambda b: b - block.start
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counted = [np.bincount(found.values.to_numpy(), minlength=width).astype("<u2").tobytes() for found in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counted, pa.binary())], ["cluster", "times"])

    kind = dict(draws.dtypes)[name]
    return draws.select(F.col(name).alias("cluster"), own.alias("own")).mapInArrow(run, f"cluster {kind}, times binary")


def _times(column: pa.Array, width: int) -> np.ndarray:
    """rows x replicates from packed draws; a cluster that was never drawn has none."""
    out = np.zeros((len(column), width))
    for row, cell in zip(out, column):
        if cell.is_valid:
            row[:] = np.frombuffer(cell.as_buffer(), "<u2")
    return out


def _cluster_sums(collapsed: DataFrame, groups: Sequence[str]) -> DataFrame:
    """(cluster, sums): a cluster's sums over all its rows, each group value's and each bucket's.

    One row a cluster, as long as there are group values and buckets.
    """
    hit, gap = F.col("score") >= metrics.THRESHOLD, F.col("score") - F.col("y")
    keep = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0)).cast("double")
    kinds = [F.lit(None).cast("string"), *[F.col(g).cast("string") for g in groups], F.col("bucket").cast("string")]
    cells = F.array(*[F.struct(F.lit(k).alias("kind"), part.alias("part")) for k, part in enumerate(kinds)])
    sums = collapsed.select("cluster", "y", "score", "n", F.inline(cells)).groupBy("cluster", "kind", "part").agg(
        keep((F.col("y") == 1) & hit).alias("tp"), keep((F.col("y") == 0) & hit).alias("fp"),
        keep(F.col("y") == 1).alias("pos"), keep(F.col("y") == 0).alias("neg"),
        F.sum(gap * gap * F.col("n")).alias("squared"),
    )
    return sums.groupBy("cluster").agg(F.collect_list(F.struct("kind", "part", F.array(*SUMS).alias("own"))).alias("sums"))


def _replicate_sums(by_cluster: DataFrame, draws: DataFrame, width: int) -> DataFrame:
    """(kind, part, sums): SUMS x replicates, every cluster's sums times its draws.

    Draws and sums meet by cluster, one row each. A task adds up all its clusters, so
    each sends a row for each kind and part, and these are added in two steps.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, str | None], np.ndarray] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                times = _times(part.column(1), width)
                found: dict[tuple[int, str | None], tuple[list, list]] = {}
                for row, cells in enumerate(part.column(0).to_pylist()):
                    for cell in cells:
                        rows, own = found.setdefault((cell["kind"], cell["part"]), ([], []))
                        rows.append(row)
                        own.append(cell["own"])
                for key, (rows, own) in found.items():
                    held[key] = held.get(key, 0.0) + np.array(own).T @ times[rows]
        yield _rows_of(held)

    def add(key: tuple, rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(cell.as_buffer()) for cell in rows.column("sums"))
        cells = {name: [key[k].as_py()] for k, name in enumerate(("kind", "part"))}
        return pa.table({"kind": pa.array(cells["kind"], pa.int32()), "part": pa.array(cells["part"], pa.string()),
                         "sums": pa.array([total.tobytes()], pa.binary())})

    schema = "kind int, part string, sums binary"
    joined = by_cluster.join(draws, "cluster", "left").select("sums", "times")
    parts = joined.mapInArrow(run, schema).withColumn("salt", F.spark_partition_id() % 16)
    some = parts.groupBy("kind", "part", "salt").applyInArrow(add, schema)
    return some.groupBy("kind", "part").applyInArrow(add, schema)


def _rows_of(held: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array([k for k, _ in held], pa.int32()), pa.array([p for _, p in held], pa.string()),
        pa.array([v.tobytes() for v in held.values()], pa.binary()),
    ], ["kind", "part", "sums"])


def _sums_table(found: DataFrame, kind: int, block: range, group: str | None = None, cast: str | None = None) -> DataFrame:
    """(b, [group,] tp, fp, pos, neg, squared) from one kind of packed sums."""
    width = len(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, cell in zip(batch.column(0), batch.column(1)):
                sums = np.frombuffer(cell.as_buffer()).reshape(len(SUMS), width)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.arange(block.start, block.stop), pa.int32()), pa.array([part.as_py()] * width, pa.string()),
                    *map(pa.array, sums),
                ], ["b", "part", *SUMS])

    rows = found.filter(F.col("kind") == kind).select("part", "sums").mapInArrow(
        run, "b int, part string, " + ", ".join(f"{c} double" for c in SUMS)
    )
    return rows.drop("part") if group is None else rows.withColumn("part", F.col("part").cast(cast)).withColumnRenamed("part", group)


class Buckets:
    """Ordered score buckets: even numbers are ranges between edges, odd ones the single
    score of an edge that holds more rows than a bucket should."""

    def __init__(self, counts: DataFrame, bucket_rows: int):
        scores = counts.select("score").distinct().limit(_MOST_BUCKETS + 1).collect()
        if len(scores) <= _MOST_BUCKETS:
            edges = sorted(r[0] for r in scores)  # few scores: each is a bucket of its own
            self.edges, self.alone = np.array(edges, float), np.ones(len(edges), bool)
            return
        wanted = min(_MOST_BUCKETS, max(8, -(-counts.count() // bucket_rows)))
        shares = [k / wanted for k in range(1, wanted)]
        found = counts.agg(F.percentile_approx("score", shares, 20 * wanted)).first()[0]
        self.edges, times = np.unique(np.array(found, float), return_counts=True)
        self.alone = times > 1  # an edge that two quantiles fall on

    def add_to(self, counts: DataFrame) -> DataFrame:
        edges, alone = self.edges, self.alone

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                score = frame["score"].to_numpy(float)
                at = np.searchsorted(edges, score)
                inside = np.minimum(at, len(edges) - 1)
                single = (at < len(edges)) & (edges[inside] == score) & alone[inside]
                yield frame.assign(bucket=(2 * at + single).astype(np.int32))

        schema = ", ".join(f"`{n}` {t}" for n, t in counts.dtypes)
        return counts.mapInPandas(run, f"{schema}, bucket int")


def _rank_sums(ordered: pd.DataFrame, times: np.ndarray, index: np.ndarray, below: np.ndarray, whole: np.ndarray, step: int = 2048):
    """Over rows in ascending score order, per replicate: the pairs in the right order
    (ties half) and the sum of precisions. ``below`` and ``whole``: positives and
    negatives under these rows and in all; ``index``: the row of ``times`` of each row."""
    score, counts = ordered["score"].to_numpy(), ordered[["pos", "neg"]].to_numpy(np.float64)
    pairs, precision = (np.zeros(times.shape[1]) for _ in range(2))
    open_score, carried = None, np.zeros_like(below)

    def close(sums: np.ndarray) -> None:
        """sums: (scores, 2, replicates) of scores that are complete."""
        nonlocal below, pairs, precision
        under = below + np.cumsum(sums, axis=0) - sums
        more, ranked = _ranked(sums, under, whole)
        pairs, precision = pairs + more.sum(axis=0), precision + ranked.sum(axis=0)
        below = below + sums.sum(axis=0)

    for low in range(0, len(score), step):
        part = slice(low, low + step)
        own, drawn = score[part], times[index[part]].astype(np.float64)
        heads = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        sums = np.stack([np.add.reduceat(drawn * counts[part, k : k + 1], heads, axis=0) for k in (0, 1)], axis=1)
        if open_score is not None:
            if own[0] == open_score:
                sums[0] += carried
            else:
                close(carried[None])
        close(sums[:-1])
        open_score, carried = own[-1], sums[-1]
    if open_score is not None:
        close(carried[None])
    return pairs, precision


def _ranked(sums: np.ndarray, under: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scores, replicates) of ordered pairs and of summed precisions, from the positives
    and negatives (scores, 2, replicates) at each score and under it."""
    above = whole - under
    all_above = above.sum(axis=1)
    share = np.divide(above[:, 0], all_above, out=np.zeros_like(all_above), where=all_above > 0)
    return sums[:, 0] * (under[:, 1] + sums[:, 1] / 2), sums[:, 0] * share


def _ranking_by_replicate(dealt: DataFrame, draws: DataFrame, buckets: Buckets, found: DataFrame, block: range) -> DataFrame:
    """(b, roc_auc, average_precision).

    The sums of every bucket are known from ``found`` and small. Buckets of one score
    need nothing more; rows of the others are ranked inside their bucket, on top of the
    sums of lower ones, next to the draws of the clusters that the bucket holds.
    """
    spark, width = dealt.sparkSession, len(block)
    kind = found.agg(F.max("kind")).first()[0]
    sums = np.zeros((2 * len(buckets.edges) + 2, 2, width))
    pos, neg = SUMS.index("pos"), SUMS.index("neg")
    for row in found.filter(F.col("kind") == kind).select("part", "sums").collect():
        sums[int(row[0])] = np.frombuffer(row[1]).reshape(len(SUMS), width)[[pos, neg]]
    below, whole = np.cumsum(sums, axis=0) - sums, sums.sum(axis=0)
    pairs, precision = (m[1::2].sum(axis=0) for m in _ranked(sums, below, whole))
    counts = dealt.filter("bucket % 2 = 0").groupBy("bucket", "cluster", "score").agg(
        F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("neg"),
    )
    shipped = spark.sparkContext.broadcast((below, whole))  # at most _MOST_BUCKETS x replicates

    def ranked(rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:
            return pd.DataFrame({"b": [], "pairs": [], "precision": []})
        below, whole = shipped.value
        k = int(rows["bucket"].iloc[0])
        # The last row, all zero, stands for clusters that were never drawn.
        packed = [np.frombuffer(t, "<u2") for t in own["times"]] + [np.zeros(width, "<u2")]
        ordered = rows.sort_values("score")
        index = pd.Index(own["cluster"]).get_indexer(ordered["cluster"])
        pairs, precision = _rank_sums(ordered, np.stack(packed), index, below[k], whole)
        return pd.DataFrame({"b": np.arange(block.start, block.stop), "pairs": pairs, "precision": precision})

    held = counts.select(F.col("bucket").alias("bucket"), F.col("cluster").alias("cluster")).distinct().join(draws, "cluster")
    made = counts.groupBy("bucket").cogroup(held.groupBy("bucket")).applyInPandas(
        ranked, "b int, pairs double, precision double"
    )
    alone = spark.createDataFrame(
        list(zip(block, pairs.tolist(), precision.tolist(), whole[0].tolist(), whole[1].tolist())),
        "b int, pairs double, precision double, pos double, neg double",
    )
    more = made.groupBy("b").agg(F.sum("pairs").alias("more_pairs"), F.sum("precision").alias("more_precision"))
    total = alone.join(more, "b", "left")
    all_of = lambda c: F.col(c) + F.coalesce(f"more_{c}", F.lit(0.0))
    return total.select(
        "b", F.try_divide(all_of("pairs"), F.col("pos") * F.col("neg")).alias("roc_auc"),
        F.coalesce(F.try_divide(all_of("precision"), F.col("pos")), F.lit(0.0)).alias("average_precision"),
    )


def bootstrap_statistics(
    df: DataFrame, cluster: str, groups: Sequence[str], replicates: int, seed: int,
    y: str = "y", score: str = "proba", block_replicates: int = 1000, bucket_rows: int = 50_000,
) -> DataFrame:
    """The statistic vector of each replicate ``b``; single-class replicates drop out.

    No row is multiplied by the replicates in a shuffle, and the draws stay a table by
    cluster. Everything that needs no order, the class sums of score buckets included,
    comes from one row a cluster times its draws. Ranks come from buckets of about
    ``bucket_rows`` rows, each next to its own clusters' draws, for at most
    ``block_replicates`` replicates at a time.
    """
    histogram = score_histogram(df, groups, [cluster], y, score).withColumnRenamed(cluster, "cluster")
    collapsed = cut(histogram)
    buckets = Buckets(collapsed, bucket_rows)
    dealt = cut(buckets.add_to(collapsed))
    draws = cut(cluster_draws(df, cluster, replicates, seed))
    by_cluster = cut(_cluster_sums(dealt, groups))
    kinds = dict(df.dtypes)
    vectors = []
    for low in range(0, replicates, block_replicates):
        block = range(low, min(low + block_replicates, replicates))
        packed = cut(packed_draws(draws, block))
        found = cut(_replicate_sums(by_cluster, packed, len(block)))
        vectors.append(metrics.vector_of_sums(
            _sums_table(found, 0, block), _ranking_by_replicate(dealt, packed, buckets, found, block),
            {g: _sums_table(found, k, block, g, kinds[g]) for k, g in enumerate(groups, 1)}, ["b"],
        ))
    return cut(union_all(vectors))


def bootstrap_intervals(
    df: DataFrame, cluster: str, groups: Sequence[str], replicates: int, seed: int,
    y: str = "y", score: str = "proba", level: float = 0.95, digits: int = 3,
) -> DataFrame:
    """(metric, estimate, lower, upper) rounded; percentiles ignore nulls.

    The percentile aggregates see one value per replicate.
    """
    point = statistic_vector(score_histogram(df, groups, (), y, score), [], groups)
    metrics = point.columns
    tail = (1 - level) / 2
    estimates = point.unpivot([], metrics, "metric", "estimate")
    limits = (
        bootstrap_statistics(df, cluster, groups, replicates, seed, y, score)
        .unpivot(["b"], metrics, "metric", "value")
        .groupBy("metric")
        .agg(
            F.percentile("value", F.lit(tail)).alias("lower"),
            F.percentile("value", F.lit(1 - tail)).alias("upper"),
        )
    )
    rounded = [F.round(c, digits).alias(c) for c in ("estimate", "lower", "upper")]
    return estimates.join(limits, "metric", "left").select("metric", *rounded)
