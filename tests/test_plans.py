"""What the plans must and must not hold."""

import pytest

from loomlog import queries
from loomlog.operators import filters, order, render
from loomlog.operators.filters import LogFilter
from loomlog.plans import tables

SF = "/root/testdata/sf0.001"
#: These have a single-partition window on a table of a row or two a device, day or partition, a scalar maximum of partial ones, or a final sort with a limit.
SMALL_WINDOWS = {"h1_devices", "a7_backlog", "a8_overload_periods", "o3_assign_seq", "c2_run_topology", "f9_find_next", "f9_find_prev", "latest_warnings", "q1_tail", "o4_retain_last", "t5_view_window", "q1_newest"}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


#: Records of captures are bytes within bytes, which only Python can walk through.
PYTHON = {"s1_read_raw_capture"}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_no_python_no_cross_join_no_single_partition(spark, name):
    plan = plan_of(queries.queries()[name](spark, SF))
    for word in ("BatchEvalPython", "ArrowEvalPython", "InPandas", "InArrow", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in plan or word == "InArrow" and name in PYTHON
    assert name in SMALL_WINDOWS or "SinglePartition" not in plan


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")  # else plans cut the filters short
    path = str(tmp_path_factory.mktemp("logs") / "t")
    tables.logs(spark, SF).repartitionByRange(4, "seq").write.parquet(path)
    return spark.read.parquet(path)


def test_filters_reach_the_scan(stored):
    plan = plan_of(filters.apply_filter(stored, LogFilter(module="dev1.app", children=True, level="INFO", after_seq=10)).select("seq"))
    assert all(x in plan for x in ("EqualTo(device,dev1)", "StringStartsWith(module,app.)", "GreaterThanOrEqual(level,20)", "GreaterThan(seq,10)"))
    assert "message" not in plan.split("ReadSchema:")[1].split("\n")[0]
    assert plan.count("Filter ") == 1


def test_tail_takes_ordered(stored):
    assert "TakeOrderedAndProject" in plan_of(render.tail(stored, LogFilter(level="INFO"), 10))


def test_latest_combines_before_the_shuffle(stored):
    from loomlog.operators import latest

    plan = plan_of(latest.latest_by_module(stored))
    assert plan.count("max(struct") >= 2 and "Window" not in plan


def test_retention_needs_no_shuffle_of_rows(stored):
    plan = plan_of(order.retain_last(stored, 10))
    assert "hashpartitioning" not in plan and "Join" not in plan
