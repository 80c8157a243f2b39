"""Learning path: splits, folds, fit, calibration, prediction, CV and the pipeline.
Training here uses few rounds on the smallest data (the registered queries use the
reference's settings)."""
from pyspark.sql import functions as F

from conftest import SF_SMALL
from riskloom import schema as S
from riskloom.operators import learning as L
from riskloom.plans import catalog


def _data(spark):
    c = catalog.Ctx(spark, SF_SMALL)
    scaled, stats = L.standard_scale(c.features, S.FEATURE_NAMES)
    return c, L.assemble(scaled.withColumn("label", F.col("is_fraud").cast("int")), S.FEATURE_NAMES)


def test_splits_exact_and_stratified(spark):
    c, data = _data(spark)
    n = c.log.count()
    s = L.chrono_split(c.log, 0.8)
    assert s.where("split = 'train'").count() == int(0.8 * n)
    tmax = s.where("split = 'train'").agg(F.max("timestamp")).first()[0]
    tmin = s.where("split = 'test'").agg(F.min("timestamp")).first()[0]
    assert tmax <= tmin
    st = L.stratified_split(data, "label", 0.2)
    for lbl in (0, 1):
        tot = st.where(F.col("label") == lbl).count()
        te = st.where((F.col("label") == lbl) & (F.col("split") == "test")).count()
        assert te == -(-tot * 2 // 10)  # ceil(0.2 * n)
    folds = L.stratified_folds(data, 5, "label").groupBy("label", "fold").count().collect()
    for lbl in (0, 1):
        sizes = [r["count"] for r in folds if r.label == lbl]
        assert max(sizes) - min(sizes) <= 1


def test_fit_calibrate_predict_cv_and_pipeline(spark, tmp_path):
    c, data = _data(spark)
    sp = L.stratified_split(data, "label", 0.2)
    m = L.train_gbt(sp.where("split = 'train'"), maxIter=5, maxDepth=3)
    cal = L.calibrate(m, sp.where("split = 'test'"))
    p = L.predict(m, sp.where("split = 'test'"), cal)
    assert p.where((F.col("fraud_probability") < 0) | (F.col("fraud_probability") > 1)).count() == 0
    cv = L.cross_validate(data, 3, "label", maxIter=3, maxDepth=3)
    assert cv["folds"] == 3 and 0.0 <= cv["roc_auc_mean"] <= 1.0
    meta = L.train_pipeline(c.features, str(tmp_path / "model"), cv_folds=0, maxIter=3, maxDepth=3)
    assert set(meta["metrics"]) >= {"roc_auc", "pr_auc", "tn", "fp", "fn", "tp"}
    from riskloom.sources.sinks import load_model
    loaded, saved, cal2, scaler = load_model(str(tmp_path / "model"), spark)
    assert scaler == meta["scaler"] and cal2 is not None
    assert saved["feature_names"] == S.FEATURE_NAMES
    assert len(meta["top_features"]) == 15


def test_settings_reach_the_trees(spark, tmp_path):
    """Least child, least gain and feature subset in the saved trees; early stopping on marked rows."""
    _, data = _data(spark)
    m = L.train_gbt(data, maxIter=4)
    assert (m.getFeatureSubsetStrategy(), m.getMinInstancesPerNode(), m.getMaxDepth(), m.getSubsamplingRate()) == ("0.8", 5, 6, 0.8)
    n = data.count()
    assert m.getMinInfoGain() == L.GAMMA / n
    m.write().save(str(tmp_path / "m"))
    nodes = spark.read.parquet(str(tmp_path / "m" / "data")).select("treeID", "nodeData.*").collect()
    assert all(x.gain >= L.GAMMA / n for x in nodes if x.leftChild >= 0)
    assert all(x.rawCount >= 5 for x in nodes)
    marked = data.withColumn("check", F.crc32(F.col("transaction_id").cast("binary")) % 4 == 0)
    assert 1 <= L.train_gbt(marked, validation_col="check", maxIter=30, maxDepth=5, stepSize=1.0).getNumTrees < 30


def test_predictions_equal_a_walk_over_the_saved_trees(spark, tmp_path):
    import math
    _, data = _data(spark)
    m = L.train_gbt(data, maxIter=5, maxDepth=4)
    m.write().save(str(tmp_path / "m"))
    trees: dict = {}
    for x in spark.read.parquet(str(tmp_path / "m" / "data")).select("treeID", "nodeData.*").collect():
        trees.setdefault(x.treeID, {})[x.id] = x
    weight = m.treeWeights

    def leaf(nodes, v):
        x = nodes[0]
        while x.leftChild >= 0:
            left = v[x.split.featureIndex] <= x.split.leftCategoriesOrThreshold[0]
            x = nodes[x.leftChild if left else x.rightChild]
        return x.prediction

    for r in L.predict(m, data).collect():
        margin = sum(weight[t] * leaf(nodes, r.features) for t, nodes in trees.items())
        assert abs(r.fraud_probability - 1 / (1 + math.exp(-2 * margin))) < 1e-9
        assert r.prediction == int(r.fraud_probability >= 0.5)


def test_standard_scale_population_std_and_constant(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "a double, b double")
    out, _ = L.standard_scale(df, ["a", "b"])
    rows = out.orderBy("a").collect()
    assert abs(rows[0].a + 1.224744871391589) < 1e-12 and rows[0].b == 0.0
