"""Physical plan checks."""
import re

from pyspark.sql import functions as F

from conftest import SF_SMALL
from riskloom.plans import catalog


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_feature_plan_has_no_python_and_no_window_of_a_whole_user(spark):
    """Windows over rows are partitioned by user and cell or chunk, never by user alone; what a cell inherits is a window over
    one row a user and cell."""
    p = _plan(catalog.Ctx(spark, SF_SMALL).features)
    assert "PythonUDF" not in p and "BatchEvalPython" not in p and "ArrowEvalPython" not in p
    assert not re.search(r"Window \[[^\n]*\], \[user_id#\d+\]", p)
    assert re.search(r"Window \[[^\n]*\], \[user_id#\d+, _chunk#\d+L\]", p)
    assert re.search(r"Window \[[^\n]*\], \[k#\d+, _cell#\d+L\]", p)


def test_dimension_join_is_broadcast(spark):
    from riskloom.operators.joins import enrich_dims
    p = _plan(enrich_dims(catalog.Ctx(spark, SF_SMALL).log))
    assert p.count("BroadcastHashJoin") >= 2


def test_topk_uses_take_ordered(spark):
    for n in ("user_recent", "recent_transactions", "alerts"):
        assert "TakeOrderedAndProject" in _plan(catalog.QUERIES[n](spark, SF_SMALL)), n


def test_metric_window_runs_after_aggregate(spark):
    from riskloom.operators.evaluation import pr_curve
    df = catalog.Ctx(spark, SF_SMALL).scored.select(F.col("fraud_score").alias("score"),
                                                    F.col("is_fraud").alias("label"))
    p = _plan(pr_curve(df))
    assert p.index("Window") < p.rindex("HashAggregate")  # Window above the aggregate


def test_filter_and_projection_reach_parquet(spark, tmp_path):
    from riskloom.sources.readers import read_transactions
    c = catalog.Ctx(spark, SF_SMALL)
    path = str(tmp_path / "txn.parquet")
    c.log.write.parquet(path)
    q = read_transactions(spark, path).where(F.col("transaction_id") == "TXN-00000042") \
        .select("transaction_id", "amount")
    p = _plan(q)
    assert "PushedFilters: [IsNotNull(transaction_id), EqualTo(transaction_id,TXN-00000042)]" in p
    assert re.search(r"ReadSchema: struct<transaction_id:string,amount:double>", p)
    assert q.count() == 1


def test_percentiles_do_not_collect_groups(spark):
    p = _plan(catalog.QUERIES["hourly_rollup"](spark, SF_SMALL))
    assert not re.search(r"\bpercentile(_approx)?\(", p.lower())
    assert "collect_list(" not in p.lower()


def test_top_per_user_limits_groups_before_shuffle(spark):
    p = _plan(catalog.QUERIES["top_per_user"](spark, SF_SMALL))
    assert "WindowGroupLimit" in p


def test_no_cross_joins_in_registered_analytics(spark):
    for n in ("unexpired", "reuse_scores", "platform_kpis", "latency_by_minute",
              "user_velocity_sql", "standard_scale"):
        p = _plan(catalog.QUERIES[n](spark, SF_SMALL))
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, n


def test_counters_and_table_function_plans(spark):
    log = catalog.Ctx(spark, SF_SMALL).log
    from riskloom.operators.windows import anchored_counter
    p = _plan(anchored_counter(log, 3600))
    assert "MapInPandas" not in p and "Python" not in p
    p = _plan(catalog.QUERIES["user_velocity_tvf"](spark, SF_SMALL))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_lookups_push_their_filters(spark):
    for n in ("lookup_by_key", "user_recent"):
        assert re.search(r"PushedFilters: \[.*EqualTo\(", _plan(catalog.QUERIES[n](spark, SF_SMALL))), n


def test_percentiles_have_no_constant_key(spark):
    assert "hashpartitioning(1," not in _plan(catalog.QUERIES["latency_summary"](spark, SF_SMALL))
