"""Sliced windows equal plain ones, also for a key with most of the rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from docflow.operators import ordered as O


def table(spark):
    rows = [("hot" if i % 4 else "k%d" % (i % 3), (i * 37) % 501, i, None if i % 3 else i % 11) for i in range(2000)]
    return spark.createDataFrame(rows, "k string, t int, id int, v int")


@pytest.mark.parametrize("order", [["t", "id"], ["-t", "id"]])
def test_slices_change_nothing(spark, order):
    df = table(spark)
    v = F.col("v")
    columns = dict(
        rn=O.row_number(), before=O.lag(F.col("id")), after=O.lead(F.col("id")), total=O.running_sum(v),
        low=O.running_min(v), high=O.running_max(v), known=O.last_known(v),
    )
    plain_plan = O.slicing(df, ["k"], order)
    cut_plan = O.slicing(df, ["k"], order, group_rows=100)
    assert plain_plan.large is None and cut_plan.large is not None
    assert cut_plan.sliced_rows(df).where("k = 'hot'").select("_slice").distinct().count() > 5
    plain = {r["id"]: r for r in O.ordered(df, plain_plan, **columns).collect()}
    cut = {r["id"]: r for r in O.ordered(df, cut_plan, **columns).collect()}
    assert plain == cut


def test_null_lag_is_kept(spark):
    df = spark.createDataFrame([("a", i, None if i % 2 else i) for i in range(50)], "k string, t int, v int")
    plan = O.slicing(df, ["k"], ["t"], group_rows=5)
    got = {r["t"]: r["p"] for r in O.ordered(df, plan, p=O.lag(F.col("v"))).collect()}
    assert got == {i: None if i == 0 or (i - 1) % 2 else i - 1 for i in range(50)}


def test_time_order(spark):
    df = spark.sql("SELECT 'a' AS k, timestamp_ntz'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id) AS t, id FROM range(300)")
    plan = O.slicing(df, ["k"], ["t"], group_rows=20)
    assert {r["id"]: r["n"] for r in O.ordered(df, plan, n=O.row_number()).collect()} == {i: i + 1 for i in range(300)}


def test_one_leading_value_is_split(spark):
    """A page of 20 times the limit whose boxes all lie in one column; another large one next to it; null keys."""
    rows = [(1, 0, 0, float(i // 7), float(i % 7), i) for i in range(4000)]
    rows += [(1, 1, i % 2, float(i), 0.0, i) for i in range(900)] + [(None, 2, 0, float(i), 0.0, i) for i in range(500)]
    rows += [(2, 0, 0, float(i), 0.0, i) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id int, page_num int, column_index int, y1 double, x1 double, box_no int").repartition(7)
    keys, order = ["doc_id", "page_num"], ["column_index", "y1", "x1", "box_no"]
    plan = O.slicing(df, keys, order, group_rows=200)
    sizes = plan.sliced_rows(df).groupBy("_slice").count().collect()
    assert len(sizes) > 20 and max(r["count"] for r in sizes) < 800
    columns = dict(n=O.row_number(), before=O.lag(F.col("box_no")), after=O.lead(F.col("box_no")), total=O.running_sum(F.col("x1")))
    got = sorted(map(tuple, O.ordered(df, plan, **columns).collect()), key=str)
    assert got == sorted(map(tuple, O.ordered(df, O.slicing(df, keys, order, bounded=True), **columns).collect()), key=str)


def test_text_order(spark):
    df = spark.createDataFrame([("a", f"s{i:04d}" if i else None, i) for i in range(300)], "k string, t string, id int")
    plan = O.slicing(df, ["k"], ["-t", "id"], group_rows=20)
    got = {r["id"]: r["n"] for r in O.ordered(df, plan, n=O.row_number()).collect()}
    assert got == {i: 300 - i for i in range(300)}
