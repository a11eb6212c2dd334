"""Joint completion against enumeration of all completions."""

import collections
import itertools
import math

import numpy as np
import pytest

from mirrortab.operators import core
from mirrortab.plans import completion, impute, kdb
from mirrortab.plans.condition import NEVER_SEEN


@pytest.fixture(scope="module")
def model(spark):
    rng = np.random.default_rng(8)
    rows = []
    for _ in range(150):
        y, a = int(rng.integers(0, 2)), int(rng.integers(0, 3))
        b = int((a + y + (rng.random() < 0.3)) % 3)
        c = int((b + (rng.random() < 0.3)) % 4)
        rows.append((a, b, c, int((c + a) % 2 if rng.random() < 0.8 else 2), y))
    df = spark.createDataFrame(rows, "a int, b int, c int, d int, y int")
    edges = [("y", x) for x in "abcd"] + [("a", "b"), ("b", "c"), ("c", "d"), ("a", "d")]
    return kdb.fit_kdb(df, "y", edges=edges)


def _weights(model, row):
    """All completions of a row of codes (None: missing) with their log weight."""
    order = [model.target, *model.order]
    cells = collections.defaultdict(dict)
    for r in model.cpt.df.collect():
        cells[r.feature, tuple(r.config)][r.value] = r.p
    out = {}
    for codes in itertools.product(*[range(model.cards[c]) if row[c] is None else [row[c]] for c in order]):
        full, w = dict(zip(order, codes)), 0.0
        for c in order:
            config = () if c == model.target else (full[model.target], *[full[p] for p in model.parents[c]])
            known = cells.get((c, config))
            p = 1 / model.cards[c] if known is None else known.get(full[c], 0.0 if row[c] is None else NEVER_SEEN)
            w += math.log(p) if p else -math.inf
        out[codes] = w
    return order, out


def _cases(model):
    rng = np.random.default_rng(9)
    rows = []
    for k in range(60):
        row = {c: int(rng.integers(0, model.cards[c])) for c in [*model.features, model.target]}
        rows.append((k, *[None if rng.random() < 0.5 else row[c] for c in model.features], None if rng.random() < 0.5 else row["y"]))
    return [*rows, (60, None, None, None, None, None), (61, 0, 0, 0, 0, 0)]


SCHEMA = "k int, a int, b int, c int, d int, y int"


@pytest.mark.parametrize("broadcast", [True, False])
def test_likeliest_completion_equals_enumeration(spark, model, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(core, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(completion, "STEPS_PER_CUT", 1)
    cases = _cases(model)
    got = {r.k: r for r in completion.complete_codes(model, spark.createDataFrame(cases, SCHEMA), "k").collect()}
    assert len(got) == len(cases)
    for k, *codes in cases:
        row = dict(zip("abcdy", codes))
        order, weights = _weights(model, row)
        best = max(weights, key=lambda c: (round(weights[c], 9), [-x for x in c]))
        assert tuple(got[k][c] for c in order) == best


@pytest.mark.parametrize("broadcast", [True, False])
def test_draws_follow_the_joint_distribution(spark, model, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(core, "BROADCAST_ROWS", 0)
    n = 6_000
    for row in ({"a": None, "b": None, "c": None, "d": 1, "y": None}, {"a": None, "b": 1, "c": None, "d": None, "y": 0}):
        holes = spark.createDataFrame([(i, *[row[c] for c in "abcdy"]) for i in range(n)], SCHEMA)
        order, weights = _weights(model, row)
        total = sum(math.exp(w) for w in weights.values())
        drawn = collections.Counter(tuple(r[c] for c in order) for r in completion.complete_codes(model, holes, "k", seed=3).collect())
        assert sum(drawn.values()) == n
        assert all(weights[c] > -math.inf for c in drawn)
        assert sum(abs(drawn[c] / n - math.exp(w) / total) for c, w in weights.items()) < 0.1


def test_odd_rows(spark, model):
    rows = [(1, 9, None, 0, 0, 1), (1, 9, None, 0, 0, 1), (2, None, None, None, None, None), (3, 9, 9, 9, 9, 9)]
    out = impute.impute(model, spark.createDataFrame(rows, SCHEMA), "k", joint=True).collect()
    got = collections.Counter(tuple(r) for r in out)
    assert len(out) == 4 and got[(3, 9, 9, 9, 9, 9)] == 1 and all(None not in r for r in got)
    assert [n for r, n in got.items() if r[0] == 1] == [2] and next(r for r in got if r[0] == 1)[1] == 9
    for seed in (None, 4):
        assert impute.impute(model, spark.createDataFrame([], SCHEMA), "k", seed, joint=True).collect() == []


def test_draws_do_not_depend_on_partitions(spark, model):
    holes = spark.createDataFrame(_cases(model), SCHEMA)
    draw = lambda df: sorted(map(str, completion.complete_codes(model, df, "k", seed=5).collect()))
    assert draw(holes.repartition(7)) == draw(holes.coalesce(1))
