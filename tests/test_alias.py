"""Alias slots hold exactly the weights; draws follow them."""

import collections

import numpy as np
import pytest

from mirrortab.operators import alias, core


def _mass(table):
    out, totals = collections.Counter(), {r.g: (r._m, r._total) for r in table.groups.df.collect()}
    slots = collections.Counter()
    for r in table.slots.df.collect():
        slots[r.g] += 1
        out[r.g, r.v] += r._keep
        out[r.g, r._alias] += totals[r.g][1] - r._keep
        assert 0 < r._keep <= totals[r.g][1]
    assert slots == {g: m for g, (m, _) in totals.items()}
    return {k: (n, totals[k[0]][0]) for k, n in out.items() if n}


@pytest.mark.parametrize("rows_per_window", [core.WINDOW_ROWS, 20])
def test_slots_hold_the_weights(spark, monkeypatch, rows_per_window):
    monkeypatch.setattr(core, "WINDOW_ROWS", rows_per_window)
    rng = np.random.default_rng(1)
    rows = [("even", v, 4) for v in range(5)] + [("one", 0, 7)] + [("tie", 0, 1), ("tie", 1, 3), ("tie", 2, 2)]
    rows += [("wild", v, int(w)) for v, w in enumerate(rng.pareto(0.7, 40) * 10 + 1)]
    rows += [("spike", v, 1) for v in range(30)] + [("spike", 30, 10**9), ("zero", 0, 0), (None, 1, 2), (None, 2, 5)]
    table = alias.fit_alias(spark.createDataFrame(rows, "g string, v int, w bigint"), ["g"], "v", "w")
    want = {(g, v): w for g, v, w in rows if w and g}
    got = _mass(table)
    assert set(got) == set(want)
    assert all(got[k][0] == want[k] * got[k][1] for k in want)


@pytest.mark.parametrize("broadcast", [True, False])
def test_draws_follow_the_weights(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(core, "BROADCAST_ROWS", 0)
    weights = {"x": [1, 2, 7], "y": [5, 5]}
    df = spark.createDataFrame([(g, v, w) for g, ws in weights.items() for v, w in enumerate(ws)], "g string, v int, w int")
    table = alias.fit_alias(df, ["g"], "v", "w")
    draws = spark.range(9_000).selectExpr("id", "element_at(array('x', 'y', 'z'), cast(id % 3 as int) + 1) AS g")
    got = collections.Counter((r.g, r.value) for r in alias.alias_draw(draws, table, "id").collect())
    assert got["z", None] == 3_000
    for g, ws in weights.items():
        for v, w in enumerate(ws):
            assert abs(got[g, v] / 3_000 - w / sum(ws)) < 0.03


def test_no_group_and_empty_tables(spark):
    df = spark.createDataFrame([("a", 1), ("b", 3)], "v string, w int")
    got = collections.Counter(r.value for r in alias.alias_draw(spark.range(4_000), alias.fit_alias(df, [], "v", "w"), "id").collect())
    assert sum(got.values()) == 4_000 and abs(got["b"] / 4_000 - 0.75) < 0.03
    empty = alias.fit_alias(df.where("w > 5"), [], "v", "w")
    assert [r.value for r in alias.alias_draw(spark.range(2), empty, "id").collect()] == [None, None]
