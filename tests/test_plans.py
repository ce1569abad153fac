"""Physical-plan checks and the driver entry point."""

import contextlib
import io

import pytest

from tests.conftest import SF_SMALL
from tessera.plans.registry import load_all

PYTHON_NODES = ("PythonUDF", "BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas")


def plan_text(df):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


def q(spark, name, sf=SF_SMALL):
    return load_all()[name].build(spark, sf)


def test_entry_runs(spark):
    import __spark_entry__ as entry
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and df.columns == ["key", "name", "value", "band", "colour", "is_missing"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_top_k_is_take_ordered(spark):
    assert "TakeOrderedAndProject" in plan_text(q(spark, "top_k"))


def test_fixed_dimensions_are_broadcast(spark):
    assert "BroadcastHashJoin" in plan_text(q(spark, "star_view"))


def test_indicator_join_broadcast_by_measured_size(spark):
    # no hint on the indicator side (its size depends on the data): AQE broadcasts it after
    # measuring it at run time, and would keep the sort-merge join for a large side
    df = q(spark, "attach_indicator")
    df.collect()
    p = plan_text(df)
    assert "isFinalPlan=true" in p and "BroadcastHashJoin" in p


def test_slice_filters_reach_the_scan(spark):
    p = plan_text(q(spark, "slice_by"))
    assert "GreaterThanOrEqual(o_orderdate,1996-01-01T00:00)" in p
    assert "EqualTo(c_mktsegment,BUILDING)" in p
    assert "In(r_name, [AMERICA,EUROPE])" in p
    # unused facts (the lineitem roll-up) and the repeat window are pruned away
    assert "lineitem" not in p


def test_fences_reach_the_scan_without_joins(spark):
    # the fence is a scalar subquery of the exact quantiles, bound before the scan runs
    p = plan_text(q(spark, "outliers_iqr"))
    assert "Subquery" in p
    assert "NestedLoopJoin" not in p and "CartesianProduct" not in p
    # the histogram's bounds stay one scalar subquery
    assert "Subquery" in plan_text(q(spark, "histogram"))


def test_column_pruning(spark):
    p = plan_text(q(spark, "describe_quantity_by_flag"))
    assert "ReadSchema: struct<l_quantity:double,l_returnflag:string>" in p


@pytest.mark.parametrize("name", ["describe_numeric", "profile", "kpi_headline", "stock_history", "trend",
                                  "parse_chat", "top_terms", "chunk_documents", "canonical_path",
                                  "segment_customers", "map_layer", "normalize_posts"])
def test_no_python_in_jvm_queries(spark, name):
    p = plan_text(q(spark, name))
    assert not any(n in p for n in PYTHON_NODES), name


def test_python_only_where_declared(spark):
    # the Arrow steps of the library: tiles of vectors and the cooldown replay
    assert "MapInArrow" in plan_text(q(spark, "similar_top_k"))
    assert "MapInPandas" in plan_text(q(spark, "cooldown_alerts"))


def test_no_cross_joins_anywhere(spark):
    skip = {"train_compare", "tune", "coefficients", "cluster_behaviour", "score_batch", "stability",
            "recommend", "match_psm"}
    for name, query in load_all().items():
        if name in skip:
            continue
        p = plan_text(query.build(spark, SF_SMALL))
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name


def test_bucketed_star_joins_orders_and_facts_without_exchange(spark):
    from tessera.plans import kpi
    orders, facts = kpi.star_layout(spark, SF_SMALL)
    j = orders.join(facts.hint("merge"), orders.o_orderkey == facts.l_orderkey, "left")
    p = plan_text(j)
    assert "SortMergeJoin" in p and "Exchange" not in p and p.count("Bucketed: true") == 2
    assert "Exchange" not in plan_text(facts.groupBy("l_orderkey").count())
    star = plan_text(kpi.star_from_layout(spark, SF_SMALL, (orders, facts)).select(*kpi.STAR_VIEW))
    assert star.count("Scan parquet spark_catalog.default.tessera_star_orders") == 2  # the tree and its detail: one read
    assert "o_orderkey" not in "".join(x for x in star.splitlines() if "hashpartitioning" in x)


def test_buckets_grow_with_the_input(spark):
    from tessera.sources.bucketed import buckets_for
    df = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    assert buckets_for(df) == 8 and buckets_for(df, bucket_bytes=1024) > 8
