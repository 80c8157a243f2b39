"""Splits, scaling, training, calibration, prediction and cross-validation (P19, M1-M6,
M13, M14) with Spark ML.

Exact ranks (chronological cut, stratified split, folds) never sort a whole table or label in
one task: rows are counted per (group, fine ordered bucket), a small window over those
counts gives each bucket's offset, and only rows inside one bucket are numbered. Null keys and
null times are a group and a bucket of their own (first in order).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom import schema as S
from riskloom.operators.prefix import stored

HASH_DIGITS = 5  # leading hex digits of the md5 order: a million ordered buckets


def rank_in_group(df: DataFrame, keys: list[str], order: list[Column], bucket: Column) -> DataFrame:
    """Add ``_rank`` (1-based position in ``order`` within ``keys``) and ``_group_n``.
    ``bucket`` must be non-decreasing along ``order``. ``df`` is read twice (counts, rows), its rows are shuffled once."""
    d = df.withColumn("_bk", bucket)
    per = d.groupBy(*keys, "_bk").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    wa = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    per = per.select(*keys, "_bk", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"),
                     F.sum("_n").over(wa).alias("_group_n"))
    # one comparable value, in which nulls are equal, serves the join and the numbering
    place = F.struct(*keys, "_bk").alias("_place")
    per = per.select(place, "_before", "_group_n")
    rn = F.row_number().over(Window.partitionBy("_place").orderBy(*order))
    return d.select("*", place).join(per, "_place").withColumn("_rank", F.col("_before") + rn).drop("_place", "_bk", "_before")


# M1
def chrono_split(df: DataFrame, train_frac: float = 0.8, ts: str = "timestamp",
                 id_col: str = "transaction_id") -> DataFrame:
    """First ``floor(frac·n)`` rows by (timestamp, id) are train, the rest test (exact)."""
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    r = rank_in_group(df, [], [t, F.col(id_col)], F.floor(t / F.lit(S.HOUR_US // 60)))
    split = F.when(F.col("_rank") <= F.floor(F.col("_group_n") * F.lit(train_frac)),
                   F.lit("train")).otherwise(F.lit("test"))
    return r.withColumn("split", split).drop("_rank", "_group_n")


def seeded_key(id_col: str, seed: int) -> Column:
    """Seeded random order of ids that any engine can repeat: md5 of ``id_seed``."""
    return F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(f"_{seed}")).cast("binary"))


# M2
def stratified_split(df: DataFrame, label: str = "is_fraud", test_frac: float = 0.2,
                     seed: int = 42, id_col: str = "transaction_id") -> DataFrame:
    """Per label, the first ``ceil(test_frac·n_label)`` rows in seeded-hash order are test."""
    h = seeded_key(id_col, seed)
    r = rank_in_group(df, [label], [h, F.col(id_col)], F.substring(h, 1, HASH_DIGITS))
    split = F.when(F.col("_rank") <= F.ceil(F.col("_group_n") * F.lit(test_frac)),
                   F.lit("test")).otherwise(F.lit("train"))
    return r.withColumn("split", split).drop("_rank", "_group_n")


# M3
def stratified_folds(df: DataFrame, k: int = 5, label: str = "is_fraud", seed: int = 42,
                     id_col: str = "transaction_id") -> DataFrame:
    """Fold 0..k-1 by position in seeded-hash order within each label (balanced per label)."""
    h = seeded_key(id_col, seed)
    r = rank_in_group(df, [label], [h, F.col(id_col)], F.substring(h, 1, HASH_DIGITS))
    return r.withColumn("fold", F.pmod(F.col("_rank") - 1, F.lit(k)).cast("int")) \
        .drop("_rank", "_group_n")


# P19
def standard_scale(df: DataFrame, cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """(x - mean) / population std; a constant column divides by 1. Returns (scaled frame,
    fitted statistics). Fitting is one aggregate pass whose single row (2 numbers per column,
    the scaler's parameters) is the model; the transform uses them as literals. The rows are written
    once, so that what leads to them isn't run again by the transform."""
    df = stored(df, "unscaled")
    stats = fit_scaler(df, cols)
    return apply_scaler(df, stats), stats


def fit_scaler(df: DataFrame, cols: list[str]) -> dict:
    row = df.agg(*[F.avg(c).alias(f"m_{i}") for i, c in enumerate(cols)],
                 *[F.stddev_pop(c).alias(f"s_{i}") for i, c in enumerate(cols)]).first()
    return {c: (row[f"m_{i}"], row[f"s_{i}"]) for i, c in enumerate(cols)}


def apply_scaler(df: DataFrame, stats: dict) -> DataFrame:
    def scale(c):
        m, s = stats[c]
        if m is None:
            return F.lit(None).cast("double")
        return (F.col(c) - F.lit(float(m))) / F.lit(float(s) if s else 1.0)
    return df.select(*[c for c in df.columns if c not in stats],
                     *[scale(c).alias(c) for c in stats])


def assemble(df: DataFrame, cols: list[str], out: str = "features") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=cols, outputCol=out, handleInvalid="keep").transform(df)


# M4
GBT_DEFAULTS = dict(maxIter=200, maxDepth=6, stepSize=0.1, subsamplingRate=0.8, seed=42,
                    checkpointInterval=10, featureSubsetStrategy="0.8", minInstancesPerNode=5)
#: Least gain of a split, summed over the rows of its node.
GAMMA = 0.1
#: Training rows of a partition, where the cores have two partitions each.
PARTITION_ROWS = 2_000_000


def training_partitions(rows: int, cores: int) -> int:
    """Every partition ships the histograms of every node in every round, so their number follows the cores, and the rows
    only where a partition would get large."""
    return max(2 * cores, -(-rows // PARTITION_ROWS))


def with_class_weight(df: DataFrame, label: str = "label", weighted: bool = True) -> DataFrame:
    """``weight`` = (1-r)/r for positives (r = positive share), 1 for negatives."""
    if not weighted:
        return df.withColumn("weight", F.lit(1.0))
    r = df.agg(F.avg(F.col(label).cast("double"))).first()[0]   # the positive share
    spw = (1.0 - r) / r if r else 1.0                              # scale_pos_weight
    return df.withColumn("weight", F.when(F.col(label) == 1, F.lit(float(spw)))
                         .otherwise(F.lit(1.0)))


def train_gbt(train: DataFrame, features_col: str = "features", label: str = "label",
              weighted: bool = True, validation_col: str | None = None, gamma: float = GAMMA, **params):
    """Boosted trees with the reference's settings: 200 rounds, depth 6, rate 0.1, row subsample 0.8, 0.8
    of the features, least child of 5, ``gamma``, positive class weight. Spark draws the features
    per node, not per tree, and counts a child's rows, not their curvature; its gain is an average over a node's
    rows, so ``gamma`` becomes ``minInfoGain = gamma / rows`` (the same at the root, more lenient below). L1 has no
    counterpart. With ``validation_col`` (boolean) the rows marked there aren't trained on and the
    rounds end when they no longer gain."""
    from pyspark import StorageLevel
    from pyspark.ml.classification import GBTClassifier

    from riskloom.session import checkpoint_dir
    # GBT truncates the lineage of its prediction errors every `checkpointInterval` rounds only
    # when a checkpoint folder is registered: use the cluster's shared one.
    checkpoint_dir(train.sparkSession)
    p = GBT_DEFAULTS | params
    marks = [validation_col] if validation_col else []
    # the input is scanned a few times before the rounds: materialize it once instead of re-running its plan, on disk,
    # since the rounds run on binned rows that want the memory
    d = with_class_weight(train, label, weighted).select(features_col, label, "weight", *marks).persist(StorageLevel.DISK_ONLY)
    try:
        n = d.count()
        if "minInfoGain" not in p:
            p["minInfoGain"] = gamma / max(n, 1)
        if validation_col:
            p["validationIndicatorCol"] = validation_col
        gbt = GBTClassifier(featuresCol=features_col, labelCol=label, weightCol="weight", **p)
        return gbt.fit(d.coalesce(training_partitions(n, train.sparkSession.sparkContext.defaultParallelism)))
    finally:
        d.unpersist()


def positive_probability(col: str = "probability") -> Column:
    from pyspark.ml.functions import vector_to_array
    return vector_to_array(F.col(col))[1]


# M5
def calibrate(model, validation: DataFrame, label: str = "label"):
    """Isotonic regression of the label on the model's positive probability. Rows of equal
    probability are one point with their mean label and their number as weight, which gives the
    same fit from one row per distinct probability."""
    from pyspark.ml.regression import IsotonicRegression
    p = (model.transform(validation).select(positive_probability().alias("p"), F.col(label).cast("double").alias("y"))
         .groupBy("p").agg(F.avg("y").alias("y"), F.count(F.lit(1)).cast("double").alias("w")))
    return IsotonicRegression(featuresCol="p", labelCol="y", weightCol="w", predictionCol="p_cal").fit(p)


# M6
def predict(model, df: DataFrame, calibrator=None, threshold: float = 0.5) -> DataFrame:
    """``fraud_probability`` (calibrated if a calibrator is given) and ``prediction`` (>=)."""
    out = model.transform(df).withColumn("p", positive_probability())
    if calibrator is not None:
        out = calibrator.transform(out).withColumn("p", F.col("p_cal")).drop("p_cal")
    return (out.withColumn("fraud_probability", F.col("p"))
            .withColumn("prediction", (F.col("p") >= threshold).cast("int")).drop("p"))


# M13
def cross_validate(df: DataFrame, k: int = 5, label: str = "label", weighted: bool = False,
                   features_col: str = "features", id_col: str = "transaction_id",
                   seed: int = 42, **params) -> dict:
    """k stratified folds; per fold fit on the rest and score the fold with the exact AUCs.
    Returns mean and population std of ROC-AUC and average precision. The loop is over model
    fits (k), each a distributed job; as many run at a time as together have the rows of one training partition."""
    import statistics
    from multiprocessing.pool import ThreadPool

    from pyspark import inheritable_thread_target

    from riskloom.operators.evaluation import average_precision, roc_auc
    folds = stored(stratified_folds(df, k, label, seed, id_col), "folds")

    def fit(i: int):
        return train_gbt(folds.where(F.col("fold") != i), features_col, label, weighted, **params)
    with ThreadPool(max(1, min(k, PARTITION_ROWS // max(folds.count(), 1)))) as pool:
        models = pool.map(inheritable_thread_target(df.sparkSession)(fit), range(k), 1)
    rocs, aps = [], []
    for i, m in enumerate(models):
        te = folds.where(F.col("fold") == i)
        p = stored(m.transform(te).select(positive_probability().alias("score"),
                                          F.col(label).alias("label")), "fold-scores")
        rocs.append(roc_auc(p).first()[0])
        aps.append(average_precision(p).first()[0])
    clean = lambda xs: [x for x in xs if x is not None]
    r, a = clean(rocs), clean(aps)
    return {"roc_auc_mean": statistics.fmean(r) if r else None,
            "roc_auc_std": statistics.pstdev(r) if r else None,
            "pr_auc_mean": statistics.fmean(a) if a else None,
            "pr_auc_std": statistics.pstdev(a) if a else None, "folds": k}


# M14
def train_pipeline(features: DataFrame, out_path: str | None = None, label: str = "is_fraud",
                   cv_folds: int = 5, calibrate_model: bool = True, held_out: DataFrame | None = None, **params) -> dict:
    """features → split → scale → CV → fit → calibrate → evaluate on held-out rows → save.

    The scaler is fitted on the training rows alone, the calibrator on a part of them that the
    trees never see, the metrics come from ``held_out`` (default: a stratified fifth of the rows),
    which neither has seen."""
    from riskloom.operators import evaluation as E
    from riskloom.operators.topk import feature_importance
    names = S.FEATURE_NAMES
    spark = features.sparkSession
    rows = stored(features.withColumn("label", F.col(label).cast("int")), "features")
    if held_out is None:
        split = stored(stratified_split(rows, "label", 0.2), "split")
        rows, test = split.where("split = 'train'").drop("split"), split.where("split = 'test'").drop("split")
    else:
        test = held_out.withColumn("label", F.col(label).cast("int"))
    parts = stored(stratified_split(rows, "label", 0.25, seed=43), "split")
    scaler = fit_scaler(parts.where("split = 'train'"), names)
    ready = lambda d: assemble(apply_scaler(d, scaler), names)
    train, check = ready(parts.where("split = 'train'")), ready(parts.where("split = 'test'"))
    meta: dict = {"n_features": len(names), "feature_names": names, "params": {**GBT_DEFAULTS, **params}}
    if cv_folds:
        meta["cv"] = cross_validate(train, cv_folds, "label", **params)
    model = train_gbt(train, "features", "label", True, **params)
    cal = calibrate(model, check) if calibrate_model else None
    pred = stored(predict(model, ready(test), cal).select(F.col("fraud_probability").alias("score"), F.col("label")), "predicted")
    metrics = {
        "roc_auc": E.roc_auc(pred).first()[0],
        "pr_auc": E.average_precision(pred).first()[0],
    }
    bt = E.best_threshold(pred).first()
    if bt is not None:
        metrics.update(optimal_threshold=bt["threshold"], precision_at_threshold=bt["precision"],
                       recall_at_threshold=bt["recall"], f1_at_threshold=bt["f1"])
    cm = E.confusion(pred, metrics.get("optimal_threshold", 0.5)).first().asDict()
    metrics.update({k: v for k, v in cm.items()})
    meta["metrics"] = metrics
    meta["top_features"] = [r.asDict() for r in
                            feature_importance(model.featureImportances, names, spark).collect()]
    if out_path:
        from pyspark.ml import PipelineModel

        from riskloom.sources.sinks import save_model
        save_model(PipelineModel(stages=[model]), meta, out_path, spark, cal, scaler)
    meta.update(model=model, calibrator=cal, scaler=scaler)
    return meta


def model_record(spark, version: str, metrics: dict, active: bool = True) -> DataFrame:
    """One row of the model metadata table (A12 input)."""
    m = {k: float(v) for k, v in metrics.items() if isinstance(v, (int, float)) and v is not None}
    return spark.createDataFrame(
        [(version, "gbt", None, m, S.FEATURE_NAMES, active)], S.MODEL) \
        .withColumn("training_date", F.current_timestamp())
