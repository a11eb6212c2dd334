"""The pivot tree, structure of wide tables and exact conditions, against brute force."""

import collections
import itertools

import numpy as np
import pytest

from mirrortab.operators import information, nearest, wide
from mirrortab.plans import condition, kdb


# nearest records

@pytest.mark.parametrize("dims, kinds", [(1, 0), (2, 0), (2, 2), (0, 3), (6, 1)])
def test_no_leaf_that_holds_the_nearest_is_ruled_out(dims, kinds):
    rng = np.random.default_rng(dims + 10 * kinds)
    real = rng.normal(size=(1_500, dims)).round(1), rng.integers(0, 3, (1_500, kinds)).astype(np.int32)
    some = rng.normal(size=(80, dims)), rng.integers(0, 4, (80, kinds)).astype(np.int32)
    tree = nearest.pivot_tree(real[0][:300], real[1][:300], fanout=4, leaf=2)
    leaf, path = tree.descend(*real)
    tree.low, tree.high = np.full(len(tree.first), np.inf), np.full(len(tree.first), -np.inf)
    for _, nodes, d in path:
        np.minimum.at(tree.low, nodes, d)
        np.maximum.at(tree.high, nodes, d)
    d = nearest._distances(*some, *real)
    rows, leaves, bounds = tree.within(*some, d.min(axis=1))
    visited = set(zip(rows.tolist(), leaves.tolist()))
    least = {(r, c): b for r, c, b in zip(rows.tolist(), leaves.tolist(), bounds.tolist())}
    for q, x in enumerate(d.argmin(axis=1)):
        assert (q, leaf[x]) in visited and least[q, leaf[x]] <= d[q, x] + 1e-9
    assert len(tree.first) > 20 or not dims


def test_nearest_in_several_rounds_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(nearest, "ROWS_PER_POINT", 4)
    monkeypatch.setattr(nearest, "FIRST_VISITS", 2)
    rng = np.random.default_rng(3)
    rows = lambda n: [(float(a), float(b), str(c)) for a, b, c in zip(rng.normal(size=n).round(2), rng.normal(size=n) * 9, rng.integers(0, 3, n))]
    real, synth = rows(900), rows(150)
    frame = lambda r: spark.createDataFrame(r, "a double, b double, c string")
    got = sorted(r["d"] for r in nearest.closest_record(frame(real), frame(synth), ["a", "b", "c"]).collect())
    scale = [np.std([r[i] for r in real]) for i in (0, 1)]
    want = sorted(
        min(np.sqrt(sum(((r[i] - s[i]) / scale[i]) ** 2 for i in (0, 1)) + 2 * (r[2] != s[2])) for r in real) for s in synth
    )
    assert np.allclose(got, want)


def test_distances_grow_slowly_with_the_rows(spark):
    rng = np.random.default_rng(9)
    per_row = []
    for n in (4_000, 32_000):
        frame = lambda k: spark.createDataFrame([(float(a), float(b)) for a, b in rng.normal(size=(k, 2))], "a double, b double")
        counted = spark.sparkContext.accumulator(0)
        assert nearest.closest_record(frame(n), frame(400), ["a", "b"], counted).count() == 400
        per_row.append(counted.value / 400)
    assert per_row[1] < 2 * per_row[0] and per_row[1] < 2_500


# wide tables

def test_two_hundred_columns(spark):
    rng = np.random.default_rng(11)
    label = rng.integers(0, 2, 300)
    table = rng.integers(0, 3, (300, 200))
    for c in range(0, 200, 5):  # some columns follow from the one before, some are constant
        table[:, c] = (table[:, c - 1] + (rng.random(300) < 0.1)) % 3 if c % 10 else 0
    names = [f"f {i:03d}" for i in range(200)]
    df = spark.createDataFrame([(*map(int, r), int(y)) for r, y in zip(table, label)], [*names, "y"])
    counted = wide.coded_rows(df, [*names, "y"])
    sums = information.entropy_sums(counted, names, "y")
    ranking = information.mi_ranking(information.mutual_information(counted, names, "y", sums))
    order = [r["column"] for r in ranking.orderBy("rank").collect()]
    edges, pairs = wide.top_parents(counted, order, "y", 2, sums)

    def entropy(*columns):
        n = np.array(list(collections.Counter(zip(*columns)).values())) / 300
        return -(n * np.log2(n)).sum()

    of = {n: table[:, i] for i, n in enumerate(names)}
    for child in rng.choice(order[1:], 25, replace=False).tolist():
        scores = sorted(
            (-round(entropy(of[child], label) + entropy(of[p], label) - entropy(of[child], of[p], label) - entropy(label), 9), p)
            for p in order[: order.index(child)]
        )
        mine = [p for p, c, r in edges if c == child and r > 0]
        assert mine == [p for _, p in scores[:2]]
    assert pairs < 200 * 199 / 2
    explained = counted.select("f 001", "y")._jdf.queryExecution().executedPlan().toString()
    assert explained.count("c1") and "c77" not in explained  # a pass reads its columns only


def test_wide_and_narrow_learn_the_same_network(spark, monkeypatch):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 3, (400, 5))
    base[:, 3] = (base[:, 1] + base[:, 4]) % 3
    df = spark.createDataFrame([tuple(map(int, r)) for r in base], "a int, b int, c int, d int, y int")
    narrow = kdb.fit_kdb(df, "y", 2)
    monkeypatch.setattr(kdb, "WIDE", 2)
    same = kdb.fit_kdb(df, "y", 2)
    assert same.order == narrow.order and same.parents == narrow.parents and same.rows == narrow.rows
    cells = lambda m: sorted((r.feature, tuple(r.config), r.value, r.n) for r in m.cpt.df.collect())
    assert cells(same) == cells(narrow)


# exact conditions

def test_conditionals_equal_enumeration(spark):
    rng = np.random.default_rng(5)
    rows = [(int(y), int(a), int((a + y + (rng.random() < 0.2)) % 3), int((b + a) % 2), int(b))
            for y, a, b in zip(rng.integers(0, 2, 60), rng.integers(0, 3, 60), rng.integers(0, 4, 60))]
    df = spark.createDataFrame(rows, "y int, a int, b int, c int, d int")
    model = kdb.fit_kdb(df, "y", 2)
    order = [model.target, *model.order]
    cells = collections.defaultdict(dict)
    for r in model.cpt.df.collect():
        cells[r.feature, tuple(r.config)][r.value] = r.p

    def p(column, row, fixed):
        config = () if column == "y" else (row["y"], *[row[x] for x in model.parents[column]])
        known = cells.get((column, config))
        if known is None:
            return 1 / model.cards[column]
        return known.get(row[column], condition.NEVER_SEEN if column in fixed else 0.0)

    for fixed in ({model.order[-1]: 1}, {model.order[-1]: 0, model.order[0]: 1}, {model.order[1]: 0, "y": 1}):
        joint = collections.Counter()
        for codes in itertools.product(*[range(model.cards[c]) for c in order]):
            row = dict(zip(order, codes))
            if all(row[c] == v for c, v in fixed.items()):
                joint[codes] = float(np.prod([p(c, row, fixed) for c in order]))
        for column, given in condition.conditionals(model, fixed).items():
            at = order.index(column)
            share = collections.defaultdict(float)
            for r in given.table.df.collect():
                share[tuple(r._config), r._value] = r.hi - r.lo
            for prefix in {codes[:at] for codes, w in joint.items() if w > 0}:
                total = sum(w for codes, w in joint.items() if codes[:at] == prefix)
                config = tuple(prefix[order.index(c)] for c in given.scope)
                for v in range(model.cards[column]):
                    want = sum(w for codes, w in joint.items() if codes[: at + 1] == (*prefix, v)) / total
                    assert abs(share[config, v] - want) < 1e-9


def test_fixed_values_hold_and_nothing_is_drawn_twice(spark):
    rng = np.random.default_rng(6)
    rows = [(int(a), int(a ^ (rng.random() < 0.1)), "yes" if rng.random() < 0.3 + 0.4 * a else "no") for a in rng.integers(0, 2, 500)]
    df = spark.createDataFrame(rows, "a int, b int, y string")
    model = kdb.fit_kdb(df, "y", 2)
    out = kdb.sample_conditional(model, spark, 4_000, {"b": 1}).collect()
    assert len(out) == 4_000 == len({r.id for r in out}) and {r.b for r in out} == {1}
    share = sum(r[0] for r in rows if r[1] == 1) / sum(r[1] == 1 for r in rows)
    assert abs(sum(r.a for r in out) / 4_000 - share) < 0.03


def test_pairs_in_arrays_and_as_rows_are_the_same(spark, monkeypatch):
    from mirrortab.operators import information as info
    from mirrortab.operators import wide

    rows = [(None if i % 11 == 0 else i % 4 - 1, i % 5 * 7, i * i % 3, None if i % 13 == 0 else "xyz"[i % 7 % 3], 1 + i % 2) for i in range(700)]
    counted = spark.createDataFrame(rows, "a int, b bigint, c int, y string, _n bigint").repartition(3)
    sums = {r["column"]: (r["s_xy"], r["s_y"], float(r["total"])) for r in info.entropy_sums(counted, ["a", "b", "c"], "y").collect()}
    pairs = [("a", "b"), ("a", "c"), ("b", "c")]
    found = []
    for cells in (wide.PAIR_CELLS, 60, 0):  # all in arrays, some, none
        monkeypatch.setattr(wide, "PAIR_CELLS", cells)
        found.append(wide.pair_information(counted, pairs, "y", sums))
    assert found[0] == found[1] == found[2] and all(v > 0 for v in found[0].values())
    monkeypatch.undo()
    made = wide._counted_in_arrays(counted, pairs, [0, 1, 2], "y", wide._spans(counted, ["a", "b", "c"], "y"))
    plan = made._jdf.queryExecution().toString()
    assert "Generate" not in plan and "explode" not in plan  # no row is multiplied by the pairs
