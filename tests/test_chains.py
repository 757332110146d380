"""Chains folded in pieces equal the plain fold."""

from __future__ import annotations

import random

import pytest

from docflow.operators import chains as H
from docflow.operators import layout as L

SCHEMA = "doc_id int, page_num int, column_index int, box_no int, x1 double, y1 double, x2 double, y2 double, font_size double, bold boolean, text string, type string, merged_boxes int, merge_phase string"


def _boxes(rng, n, doc=1, page=0, gap=(2.0, 60.0)):
    y, out = 0.0, []
    for i in range(n):
        y += 12 + rng.choice(gap)
        font = rng.choice([10.0, 12.0, 18.0])
        out.append((doc, page, 0, i, 50.0 + rng.choice([0, 5, 40]), y, 300.0, y + 12, font, False, f"w{i}", rng.choice(["Text"] * 4 + ["List", "Title"]), 1, None))
    return out


def _plain(rows, rule):
    at = [SCHEMA.split(", ").index(next(c for c in SCHEMA.split(", ") if c.startswith(n + " "))) for n in rule.inputs]
    chains, number, state, key = {}, 0, None, None
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[2], r[5], r[4], r[3])):
        row = tuple(r[i] for i in at)
        merged = rule.join(state, row) if key == r[:3] else None
        if merged is None:
            number, state, key = number + 1, row, r[:3]
        else:
            state = merged
        chains.setdefault(number, []).append((r[0], r[1], r[3]))
    return sorted(chains.values())


@pytest.mark.parametrize("gap", [(2.0, 60.0), (2.0, 2.0, 2.0, 2.0, 2.0, 60.0)])
def test_pieces_change_nothing(spark, gap):
    """A page of 30 times the limit in one column, next to small ones."""
    rng = random.Random(4)
    rows = _boxes(rng, 1500, gap=gap) + _boxes(rng, 40, doc=2) + _boxes(rng, 300, doc=1, page=1, gap=gap)
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    order = ["y1", "x1", "box_no"]
    for rule in (L.COLUMN_RULE, L.DOWNWARD_RULE):
        out = H.with_chains(df, [*L.PAGE, "column_index"], order, rule, group_rows=50).collect()
        chains: dict = {}
        for r in sorted(out, key=lambda r: (r.doc_id, r.page_num, r.y1, r.x1, r.box_no)):
            chains.setdefault((r.doc_id, r.page_num, r["_chain"]), []).append((r.doc_id, r.page_num, r.box_no))
        assert sorted(chains.values()) == _plain(rows, rule)


def test_one_chain_over_all_pieces(spark):
    """Every summary depends on its left neighbour; the whole page is one chain."""
    rows = [(1, 0, 0, i, 50.0, 14.0 * i, 300.0, 14.0 * i + 12, 12.0, False, f"w{i}", "Text", 1, None) for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = L.merge_vertical(df, group_rows=100).collect()
    assert len(out) == 1 and out[0].merged_boxes == 400 and out[0].text == " ".join(f"w{i}" for i in range(400))


def test_merges_do_not_gather_more_than_a_chain(spark):
    df = spark.createDataFrame(_boxes(random.Random(1), 50), SCHEMA)
    plan = L.merge_vertical(df, bounded=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "_island" not in plan
