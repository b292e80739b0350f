"""Plan properties the operators rely on at scale."""
from pyspark.sql import functions as F

from conftest import SF
from flowlens.operators import flows as fl
from flowlens.sources import fixtures as fx
from flowlens.sources.tables import table


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    e = table(spark, SF, "events").where(F.col("event_type") == "error").select("event_id", "value")
    p = _plan(e)
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,error)]" in p
    assert "ReadSchema: struct<event_id:bigint,event_type:string,value:double>" in p


def test_flow_statistics_combine_map_side(spark):
    f = fl.build_flows(fx.packets(spark, SF), idle_timeout=60.0)
    p = f._jdf.queryExecution().executedPlan().toString()
    # partial + final aggregation: rows are combined before the shuffle
    last = p[:p.index("Join")]  # above the join of packets and bucket summaries
    assert last.count("HashAggregate") >= 2 and "SortAggregate" not in last
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_no_single_partition_window_in_sessionize(spark):
    s = fl.sessionize(fl.canonical_key(fx.packets(spark, SF)), 60.0)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        p = _plan(s)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "SinglePartition" not in p
    assert "hashpartitioning(ip1" in p
