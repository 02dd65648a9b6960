"""Boosted-tree training, scoring, cluster cross-validation and persistence."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyspark.functions.checkpoints import cut, ensure_checkpoint_dir
from surveyspark.operators import metrics
from surveyspark.operators.oversample import FoldNeighbours, smotenc
from surveyspark.operators.quality import assert_no_nulls
from surveyspark.operators.splits import train_rows
from surveyspark.operators.stats import union_all
from surveyspark.params import SurveyParams, TreeParams

IMBALANCE_METHODS = ("class_weight", "smote", "none")
_WEIGHT = "_class_weight"
_WHOLE = ("tinyint", "smallint", "int", "bigint")
_WALKED = 10  # depth up to which training walks a row's tree instead of keeping its node
_ROWS_AT_ONCE = 8_000_000  # training rows of all fits that run side by side
_PART_ROWS = 25_000  # training rows that are worth a partition: each tree is several jobs


def tree_classifier(params: TreeParams, seed: int, y: str, weight: str | None = None) -> GBTClassifier:
    classifier = GBTClassifier(
        featuresCol="features",
        labelCol=y,
        maxIter=params.trees,
        maxDepth=params.depth,
        stepSize=params.rate,
        subsamplingRate=params.row_fraction,
        featureSubsetStrategy=str(params.column_fraction),
        minInstancesPerNode=params.min_leaf,
        maxBins=params.bins,
        checkpointInterval=10,
        # Kept node ids are a new copy of all rows' ids at each level of each tree; walking
        # a shallow tree again costs a row less.
        cacheNodeIds=params.depth > _WALKED,
        maxMemoryInMB=512,
        seed=seed,
    )
    return classifier.setWeightCol(weight) if weight else classifier


def with_class_weight(df: DataFrame, y: str, name: str = _WEIGHT) -> DataFrame:
    """Weight positives by n_neg / n_pos of these rows; 1 if a class is absent."""
    ratio = df.agg(
        F.try_divide(
            F.count_if(F.col(y) == 0).cast("double"), F.count_if(F.col(y) == 1)
        ).alias("ratio")
    ).select(F.when(F.col("ratio") > 0, F.col("ratio")).otherwise(1.0))
    return df.withColumn(name, F.when(F.col(y) == 1, ratio.scalar()).otherwise(1.0))


def fixed_layout(rows: DataFrame, keys: Sequence[str | Column], partitions: int) -> DataFrame:
    """The rows dealt by a hash of ``keys`` and sorted inside each partition.

    Row sampling in training draws by partition and position, so a fit repeats only on
    equal layouts: this one depends on the rows and the number of partitions alone.
    ``keys`` should name a row, or rows that share them meet in one partition.
    """
    spot = F.xxhash64(*keys)
    dealt = rows.withColumn("_spot", spot).repartition(partitions, "_spot")
    return dealt.sortWithinPartitions("_spot", *rows.columns).drop("_spot")


def layout_partitions(train: DataFrame) -> int:
    """The session's shuffle partitions, or fewer for a small table."""
    most = int(train.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(most, -(-train.count() // _PART_ROWS)))


def training_layout(train: DataFrame, features: Sequence[str], p: SurveyParams, flags: Sequence[str] = ()) -> DataFrame:
    """Features, outcome and ``flags`` of ``train`` in their fixed layout, kept until unpersisted.

    Training passes over its input several times before it keeps points of its own: the
    layout is shuffled and sorted once. Whole numbers stay what they are, as these are kept
    encoded, doubles are not. A filter by the flags has the layout of the rows it leaves, so
    fits on parts of ``train`` share one layout and get the trees of their own in as many partitions.
    """
    y, kinds = p.outcome, dict(train.dtypes)
    complete = assert_no_nulls(train, [*features, y], "training rows")
    numbers = [F.col(c) if kinds[c] in _WHOLE else F.col(c).cast("double").alias(c) for c in (*features, y)]
    named = {f"_key_{k}": F.col(k) for k in p.birth_key if k in train.columns}
    rows = complete.select(*numbers, *[c.alias(n) for n, c in named.items()], *flags)
    keys = list(named) or [F.col(c).cast("double") for c in (*features, y)]
    partitions = p.tree.partitions or layout_partitions(train)
    return fixed_layout(rows, keys, partitions).select(*features, y, *flags).persist()


def fit_trees(
    train: DataFrame, features: Sequence[str], p: SurveyParams, method: str | None = None,
    oversample: Callable[[DataFrame], DataFrame] | None = None, laid: DataFrame | None = None,
) -> PipelineModel:
    """Fit on ``train`` with the configured handling of class imbalance.

    ``class_weight`` weights rows, ``smote`` adds synthetic minority rows, and
    ``none`` does neither. ``oversample`` stands in for the search of "smote". All of it sees the training rows only. Equal rows give equal
    fits, whatever layout they come in. ``laid`` may give the same rows as part of a
    ``training_layout`` that several fits share; "smote" makes rows and lays out its own.
    """
    # Boosting chains each round's predictions onto the last. The chain is cut by
    # checkpoints, so their folder must be known before fitting.
    method = method or p.imbalance
    if method not in IMBALANCE_METHODS:
        raise ValueError(f"unknown imbalance method {method!r}, expected one of {IMBALANCE_METHODS}")
    ensure_checkpoint_dir(train.sparkSession)
    y, own = p.outcome, None
    if method == "smote":
        complete = assert_no_nulls(train, [*features, y], "training rows")
        numbers = [F.col(c).cast("double").alias(c) for c in (*features, y)]
        named = [F.col(k).alias(f"_key_{k}") for k in p.birth_key if k in train.columns]
        # Boosting reads its input several times: the neighbour search runs once.
        made = oversample or (lambda r: smotenc(r, features, y, p.smote_continuous, p.smote_neighbours, p.seed))
        laid = own = training_layout(cut(made(complete.select(*numbers, *named))), features, p)
    elif laid is None:
        laid = own = training_layout(train, features, p)
    try:
        rows, weight = (with_class_weight(laid, y), _WEIGHT) if method == "class_weight" else (laid, None)
        assembler = VectorAssembler(inputCols=list(features), outputCol="features")
        label = F.col(y).cast("double").alias(y)
        assembled = assembler.transform(rows).select("features", label, *([weight] if weight else []))
        model = tree_classifier(p.tree, p.seed, y, weight).fit(assembled)
    finally:
        if own is not None:
            own.unpersist()
    return PipelineModel(stages=[assembler, model])


def model_features(model: PipelineModel) -> list[str]:
    """Feature order the model was fitted with."""
    return model.stages[0].getInputCols()


def tree_model(model: PipelineModel) -> GBTClassificationModel:
    return model.stages[-1]


def score(model: PipelineModel, df: DataFrame, name: str = "proba", threshold: float = 0.5) -> DataFrame:
    """Add the positive-class probability and the thresholded prediction."""
    features = model_features(model)
    kept = df.columns
    numeric = df.withColumns({f"_x_{f}": F.col(f).cast("double") for f in features})
    assembler = VectorAssembler(inputCols=[f"_x_{f}" for f in features], outputCol="features")
    scored = tree_model(model).transform(assembler.transform(numeric))
    return scored.select(
        *kept, vector_to_array("probability")[1].alias(name)
    ).withColumn("pred", (F.col(name) >= threshold).cast("int"))


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def fits_at_once(rows: DataFrame, parallelism: int) -> int:
    """How many fits on such rows may run side by side: each keeps its points in memory, and
    a large fit has tasks for all executors anyway."""
    return max(1, min(parallelism, _ROWS_AT_ONCE // max(1, rows.count())))


def run_parallel(tasks: Sequence[Callable], parallelism: int) -> list:
    """Submit independent fits at once so their jobs share the executors."""
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        return [f.result() for f in [pool.submit(t) for t in tasks]]


def fold_neighbours(pool: DataFrame, features: Sequence[str], p: SurveyParams) -> FoldNeighbours:
    """One neighbour search that serves SMOTENC on the pool and without any one fold."""
    rows = assert_no_nulls(pool, [*features, p.outcome], "training rows").select(
        *[F.col(f).cast("double").alias(f) for f in features], F.col(p.outcome).cast("double").alias(p.outcome), "cv_fold"
    )
    return FoldNeighbours(rows, features, p.outcome, p.smote_continuous, "cv_fold", p.smote_neighbours, p.seed)


def cluster_cv(
    pool: DataFrame, features: Sequence[str], p: SurveyParams,
    method: str | None = None, parallelism: int = 2, shared: FoldNeighbours | None = None,
    laid: DataFrame | None = None,
) -> DataFrame:
    """(cv_fold, roc_auc, n_test): each fold scored by a model that never saw it.

    ``pool`` should be persisted or a table: every fold reads it. With "smote" the folds
    share one neighbour search, ``shared`` if it was made before; else one layout of the pool
    with its folds, ``laid`` if the caller keeps one.
    """
    smote = (method or p.imbalance) == "smote"
    if smote and shared is None:
        shared = fold_neighbours(pool, features, p)
    own = None if smote or laid is not None else training_layout(pool, features, p, ["cv_fold"])
    laid = own if own is not None else laid

    def one_fold(fold: int) -> DataFrame:
        made = (lambda rows: shared.oversampled(rows, fold)) if shared else None
        others = F.col("cv_fold") != fold
        model = fit_trees(pool.filter(others), features, p, method, made, None if smote else laid.filter(others))
        test = pool.filter(F.col("cv_fold") == fold)
        return score(model, test).select("cv_fold", F.col(p.outcome).alias("y"), "proba")

    try:
        scored = union_all(run_parallel([lambda f=f: one_fold(f) for f in range(p.folds)], fits_at_once(pool, parallelism)))
    finally:
        if own is not None:
            own.unpersist()
    counts = metrics.score_counts(scored, ["cv_fold"])
    auc = metrics.ranking_metrics(counts, ["cv_fold"]).select("cv_fold", "roc_auc")
    sizes = counts.groupBy("cv_fold").agg(F.sum(F.col("pos") + F.col("neg")).alias("n_test"))
    return auc.join(sizes, "cv_fold")


def fit_final(
    matrix: DataFrame, features: Sequence[str], p: SurveyParams, method: str | None = None,
    shared: FoldNeighbours | None = None, laid: DataFrame | None = None,
) -> PipelineModel:
    """Fit on everything outside the hold-out."""
    return fit_trees(train_rows(matrix), features, p, method, shared.oversampled if shared else None, laid)
