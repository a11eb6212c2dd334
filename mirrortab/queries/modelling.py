"""Information measures, probability tables, generators, imputation, repairs, whole runs."""

from pyspark.sql import functions as F

from mirrortab.operators import cpt as tables
from mirrortab.operators import encode as enc
from mirrortab.operators import information as info
from mirrortab.operators import alias, repair, rowtext, wide
from mirrortab.operators.core import checkpointed
from mirrortab.operators.discretize import discretize, fit_bins
from mirrortab.operators.divergence import fidelity_report
from mirrortab.plans import impute as imp
from mirrortab.plans import kdb, marginal
from mirrortab.plans.run import run_train_test
from mirrortab.queries import query
from mirrortab.queries.common import (
    LINE_FEATURES, LINE_KEY, LINE_NUMERIC, LINE_TARGET, bin_sql, binned_sql, divergence_sql, from_normal_sql, lineitem,
    lineitem_binned, metric_sql, quantile_grid_sql, report_sql, split_sql, to_normal_sql, uniform_sql, unpivot_sql,
)
from mirrortab.sources.runs import new_run_id
from mirrortab.sources.tables import read_table

_ALL = [*LINE_FEATURES, LINE_TARGET]


def _codes_sql(source: str = "binned", extra: str = "") -> str:
    codes = ", ".join(f"(dense_rank() OVER (ORDER BY {c}) - 1)::INTEGER AS {c}" for c in _ALL)
    return f"coded AS (SELECT rid, {codes}{extra} FROM {source})"


def _information_sql(features=LINE_FEATURES) -> str:
    """CTEs ending in ``mi`` (column, mi) and ``cmi`` (a, b, cmi) over ``coded``."""
    s = "sum(n * log2(n))"
    return f"""
long AS ({unpivot_sql('coded', features, f'rid, {LINE_TARGET} AS y')}),
joint AS (SELECT "column", value, y, count(*) AS n FROM long GROUP BY 1, 2, 3),
sxy AS (SELECT "column", {s} AS s, sum(n)::DOUBLE AS total FROM joint GROUP BY 1),
sx AS (SELECT "column", {s} AS s FROM (SELECT "column", value, sum(n) AS n FROM joint GROUP BY 1, 2) GROUP BY 1),
sy AS (SELECT "column", {s} AS s FROM (SELECT "column", y, sum(n) AS n FROM joint GROUP BY 1, 2) GROUP BY 1),
mi AS (SELECT "column", {metric_sql('log2(total) + (sxy.s - sx.s - sy.s) / total')} AS mi FROM sxy JOIN sx USING ("column") JOIN sy USING ("column")),
triple AS (SELECT p."column" AS a, q."column" AS b, p.value AS va, q.value AS vb, p.y, count(*) AS n
           FROM long p JOIN long q ON p.rid = q.rid AND p."column" < q."column" GROUP BY 1, 2, 3, 4, 5),
sxzy AS (SELECT a, b, {s} AS s FROM triple GROUP BY 1, 2),
cmi AS (SELECT a, b, {metric_sql('(sxzy.s - p.s - q.s + sy.s) / p.total')} AS cmi FROM sxzy
        JOIN sxy p ON a = p."column" JOIN sxy q ON b = q."column" JOIN sy ON a = sy."column")"""


def _edges_sql(k: int) -> str:
    """CTEs ending in ``ranking`` and ``edges``."""
    return f"""
ranking AS (SELECT "column", mi, (row_number() OVER (ORDER BY mi DESC, "column") - 1)::INTEGER AS rank FROM mi),
both_ways AS (SELECT a AS child, b AS parent, cmi FROM cmi UNION ALL SELECT b, a, cmi FROM cmi),
chosen AS (SELECT parent, child, row_number() OVER (PARTITION BY child ORDER BY cmi DESC, parent) AS rank FROM both_ways
           JOIN ranking c ON child = c."column" JOIN ranking p ON parent = p."column" WHERE p.rank < c.rank),
edges AS (SELECT '{LINE_TARGET}' AS parent, "column" AS child, 0::INTEGER AS rank FROM ranking
          UNION ALL SELECT parent, child, rank::INTEGER FROM chosen WHERE rank <= {k})"""


def _cpt_sql() -> str:
    """CTEs ending in ``cpt`` (feature, config, value, n, p, lo, hi): config is the label's
    code and the parents' codes by parent name, joined by commas."""
    return f"""
config AS (SELECT l.rid, e.child AS feature, l.y || coalesce(',' || string_agg(l.value, ',' ORDER BY e.parent) FILTER (e.rank > 0), '') AS config
           FROM edges e JOIN long l ON l."column" = CASE WHEN e.rank > 0 THEN e.parent ELSE '{LINE_FEATURES[0]}' END GROUP BY l.rid, e.child, l.y),
cells AS (SELECT feature, config, l.value::INTEGER AS value, count(*) AS n FROM config c JOIN long l ON c.rid = l.rid AND l."column" = c.feature GROUP BY 1, 2, 3
          UNION ALL SELECT '{LINE_TARGET}', '', {LINE_TARGET}, count(*) FROM coded GROUP BY 3),
cpt AS (SELECT *, (sum(n) OVER w - n) / sum(n) OVER g::DOUBLE AS lo, sum(n) OVER w / sum(n) OVER g::DOUBLE AS hi
        FROM cells WINDOW w AS (PARTITION BY feature, config ORDER BY value), g AS (PARTITION BY feature, config))"""


def _sample_sql(k: int, fixed_label: str | None = None, base: str | None = None) -> str:
    """Forward sampling, unrolled over the features in MI order, in long form.

    ``base`` are CTEs ending in ``binned``.
    """
    label_u = uniform_sql("id", LINE_TARGET)
    label = (
        f"SELECT id, (SELECT min({LINE_TARGET}) FROM coded JOIN binned USING (rid) WHERE binned.{LINE_TARGET} = '{fixed_label}') AS v FROM ids"
        if fixed_label
        else f"SELECT id, value AS v FROM (SELECT id, {label_u} AS u FROM ids) JOIN cpt ON feature = '{LINE_TARGET}' AND u >= lo AND u < hi"
    )
    if fixed_label:
        label = label.replace(f"min({LINE_TARGET})", f"min(coded.{LINE_TARGET})")
    steps = []
    for r in range(len(LINE_FEATURES)):
        before = " UNION ALL ".join([f"SELECT * FROM s{i}" for i in range(r)]) or "SELECT id, '' AS feature, 0 AS v FROM ids WHERE false"
        steps.append(f"""
f{r} AS (SELECT "column" AS feature FROM ranking WHERE rank = {r}),
b{r} AS ({before}),
k{r} AS (SELECT y.id, f.feature, CAST(y.v AS VARCHAR) || coalesce((SELECT ',' || string_agg(CAST(b.v AS VARCHAR), ',' ORDER BY e.parent) FROM edges e JOIN b{r} b ON b.feature = e.parent
         WHERE e.child = f.feature AND e.rank > 0 AND b.id = y.id), '') AS config, {uniform_sql('y.id', stream_expr='f.feature')} AS u FROM label y, f{r} f),
s{r} AS (SELECT k.id, k.feature, coalesce(c.value, floor(k.u * (SELECT count(DISTINCT value) FROM long WHERE "column" = k.feature))::INTEGER) AS v
         FROM k{r} k LEFT JOIN cpt c ON c.feature = k.feature AND c.config = k.config AND k.u >= c.lo AND k.u < c.hi)""")
    values = ", ".join(f"max(v) FILTER (feature = '{c}') AS {c}" for c in LINE_FEATURES)
    everything = " UNION ALL ".join(f"SELECT * FROM s{i}" for i in range(len(LINE_FEATURES)))
    maps = ", ".join(
        f"d_{c} AS (SELECT coded.{c} AS code, any_value(binned.{c}) AS value FROM coded JOIN binned USING (rid) GROUP BY 1)" for c in _ALL
    )
    picks = ", ".join(f"d_{c}.value AS {c}" for c in _ALL)
    joins = " ".join(f"JOIN d_{c} ON d_{c}.code = w.{c}" for c in _ALL)
    return f"""
WITH {base or binned_sql()}, {_codes_sql()}, {_information_sql()}, {_edges_sql(k)}, {_cpt_sql()},
ids AS (SELECT range AS id FROM range((SELECT count(*) FROM coded))),
label AS ({label}), {', '.join(steps)},
w AS (SELECT l.id, l.v AS {LINE_TARGET}, x.* EXCLUDE (id) FROM label l JOIN (SELECT id, {values} FROM ({everything}) GROUP BY 1) x ON x.id = l.id),
{maps}
SELECT w.id, {picks} FROM w {joins}"""


_BASE = f"WITH {binned_sql()}, {_codes_sql()}, {_information_sql()}"


def _counted(spark, sf):
    return info.compact(lineitem_binned(spark, sf), _ALL)


def _fit(spark, sf, k=2):
    return kdb.fit_kdb(lineitem_binned(spark, sf), LINE_TARGET, k)


@query("mutual_information", f'{_BASE} SELECT "column", mi FROM mi')
def mutual_information(spark, sf):
    return info.mutual_information(_counted(spark, sf), LINE_FEATURES, LINE_TARGET)


@query("conditional_mutual_information", f"{_BASE} SELECT a, b, cmi FROM cmi")
def conditional_mutual_information(spark, sf):
    return info.conditional_mutual_information(_counted(spark, sf), LINE_FEATURES, LINE_TARGET)


@query("mi_ranking", f'{_BASE}, {_edges_sql(2)} SELECT "column", mi, rank FROM ranking')
def mi_ranking(spark, sf):
    return info.mi_ranking(info.mutual_information(_counted(spark, sf), LINE_FEATURES, LINE_TARGET))


@query("kdb_edges", f"{_BASE}, {_edges_sql(2)} SELECT parent, child, rank FROM edges")
def kdb_edges(spark, sf):
    counted = _counted(spark, sf)
    ranking = checkpointed(info.mi_ranking(info.mutual_information(counted, LINE_FEATURES, LINE_TARGET)))
    cmi = info.conditional_mutual_information(counted, LINE_FEATURES, LINE_TARGET)
    return info.kdb_edges(ranking, cmi, LINE_TARGET, 2)


#: Discrete columns of lineitem: some follow from others, some are nearly constant.
_WIDE = {
    **{f"p{i:02d}": f"(l_partkey * {i + 1} + l_suppkey) % {i % 7 + 2}" for i in range(10)},
    **{f"q{i:02d}": f"CAST(l_quantity AS BIGINT) * {i + 2} % {i % 5 + 3}" for i in range(7)},
    **{f"r{i:02d}": f"CASE WHEN l_partkey % {40 + i} = 0 THEN l_suppkey % 3 ELSE 0 END" for i in range(7)},
}
_WIDE_SQL = ", ".join(f"{e} AS {c}" for c, e in _WIDE.items())


@query("kdb_edges_wide", f"""
WITH coded AS (SELECT row_number() OVER () AS rid, {_WIDE_SQL}, {LINE_TARGET} FROM lineitem),
{_information_sql(list(_WIDE))}, {_edges_sql(2)} SELECT parent, child, rank FROM edges""")
def kdb_edges_wide(spark, sf):
    rows = lineitem(spark, sf).select(*[F.expr(e).alias(c) for c, e in _WIDE.items()], LINE_TARGET)
    counted = wide.coded_rows(rows, [*_WIDE, LINE_TARGET])
    sums = info.entropy_sums(counted, list(_WIDE), LINE_TARGET)
    ranking = info.mi_ranking(info.mutual_information(counted, list(_WIDE), LINE_TARGET, sums))
    order = [r["column"] for r in ranking.orderBy("rank").collect()]
    edges, _ = wide.top_parents(counted, order, LINE_TARGET, 2, sums)
    return spark.createDataFrame(edges, "parent string, child string, rank int")


@query("kdb_cpt", f"{_BASE}, {_edges_sql(2)}, {_cpt_sql()} SELECT feature, config, value, n, {metric_sql('hi - lo')} AS p FROM cpt")
def kdb_cpt(spark, sf):
    model = _fit(spark, sf)
    config = F.array_join(F.transform("config", lambda c: c.cast("string")), ",")
    return model.cpt.df.select("feature", config.alias("config"), "value", "n", (F.round("p", 9) + F.lit(0.0)).alias("p"))


@query("kdb_sample", _sample_sql(2))
def kdb_sample(spark, sf):
    return kdb.sample_kdb(_fit(spark, sf), spark)


@query("model_roundtrip", _sample_sql(2))
def model_roundtrip(spark, sf):
    model = _fit(spark, sf)
    path = f"{spark.sparkContext.getCheckpointDir()}/{new_run_id('model')}"
    model.save(path)
    return kdb.sample_kdb(kdb.load_kdb(spark, path), spark)


@query("sample_conditional", _sample_sql(2, "R"))
def sample_conditional(spark, sf):
    model = _fit(spark, sf)
    return kdb.sample_conditional(model, spark, model.rows, {LINE_TARGET: "R"})


@query("sample_conditional_feature")
def sample_conditional_feature(spark, sf):
    model = _fit(spark, sf)
    return kdb.sample_conditional(model, spark, model.rows, {"l_linestatus": "F"})


_CHAIN = "l_linestatus AS a, CAST(round(l_discount * 100) AS INTEGER) % 4 AS b, CAST(round(l_tax * 100) AS INTEGER) % 3 AS c, l_returnflag AS y"


def _shares_sql(table: str, group: str, value: str) -> str:
    """Intervals of a value's weights ``w`` within a group."""
    return f"""
SELECT *, (sum(w) OVER o - w) / sum(w) OVER g AS lo, sum(w) OVER o / sum(w) OVER g AS hi FROM {table} WHERE w > 0
WINDOW o AS ({group} ORDER BY {value}), g AS ({group})"""


@query("sample_conditional_exact", f"""
WITH t AS (SELECT {_CHAIN} FROM lineitem),
ny AS (SELECT y, count(*)::DOUBLE AS n FROM t GROUP BY ALL), na AS (SELECT y, a, count(*)::DOUBLE AS n FROM t GROUP BY ALL),
nb AS (SELECT y, a, b, count(*)::DOUBLE AS n FROM t GROUP BY ALL), nc AS (SELECT y, a, b, count(*)::DOUBLE AS n FROM t WHERE c = 1 GROUP BY ALL),
grid AS (SELECT * FROM (SELECT DISTINCT y FROM t), (SELECT DISTINCT a FROM t), (SELECT DISTINCT b FROM t)),
qb AS (SELECT y, a, b,
         CASE WHEN na.n IS NULL THEN 1.0::DOUBLE / (SELECT count(DISTINCT b) FROM t) ELSE coalesce(nb.n / na.n, 0) END
         * CASE WHEN nb.n IS NULL THEN 1.0::DOUBLE / (SELECT count(DISTINCT c) FROM t) ELSE coalesce(nc.n / nb.n, 1e-12) END AS w
       FROM grid LEFT JOIN na USING (y, a) LEFT JOIN nb USING (y, a, b) LEFT JOIN nc USING (y, a, b)),
qa AS (SELECT y, a, coalesce(any_value(na.n) / any_value(ny.n), 0) * sum(w) AS w FROM qb JOIN ny USING (y) LEFT JOIN na USING (y, a) GROUP BY y, a),
qy AS (SELECT y, any_value(ny.n) * sum(w) AS w FROM qa JOIN ny USING (y) GROUP BY y),
iy AS ({_shares_sql('qy', '', 'y')}), ia AS ({_shares_sql('qa', 'PARTITION BY y', 'a')}), ib AS ({_shares_sql('qb', 'PARTITION BY y, a', 'b')}),
ids AS (SELECT range AS id FROM range((SELECT count(*) FROM t))),
u AS (SELECT id, {uniform_sql('id', 'y')} AS uy, {uniform_sql('id', 'a')} AS ua, {uniform_sql('id', 'b')} AS ub FROM ids)
SELECT u.id, ia.a, ib.b, 1::INTEGER AS c, iy.y FROM u JOIN iy ON uy >= iy.lo AND uy < iy.hi
JOIN ia ON ia.y = iy.y AND ua >= ia.lo AND ua < ia.hi JOIN ib ON ib.y = iy.y AND ib.a = ia.a AND ub >= ib.lo AND ub < ib.hi""")
def sample_conditional_exact(spark, sf):
    rows = lineitem(spark, sf).selectExpr(*_CHAIN.split(", "))
    edges = [("y", "a"), ("y", "b"), ("y", "c"), ("a", "b"), ("a", "c"), ("b", "c")]
    model = kdb.fit_kdb(rows, "y", edges=edges)
    return kdb.sample_conditional(model, spark, model.rows, {"c": 1})


_THIN = "l_partkey % 61 + 100 AS a, l_orderkey % 53 + 100 AS b, CAST(floor(l_quantity) AS INTEGER) % 7 AS c, l_returnflag AS y"


@query("kdb_sample_backoff", f"""
WITH t AS (SELECT {_THIN} FROM lineitem),
ny AS (SELECT y, count(*)::DOUBLE AS w FROM t GROUP BY ALL), na AS (SELECT y, a, count(*)::DOUBLE AS w FROM t GROUP BY ALL),
nb AS (SELECT y, b, count(*)::DOUBLE AS w FROM t GROUP BY ALL), c1 AS (SELECT y, c, count(*)::DOUBLE AS w FROM t GROUP BY ALL),
c2 AS (SELECT y, a, c, count(*)::DOUBLE AS w FROM t GROUP BY ALL), c3 AS (SELECT y, a, b, c, count(*)::DOUBLE AS w FROM t GROUP BY ALL),
iy AS ({_shares_sql('ny', '', 'y')}), ia AS ({_shares_sql('na', 'PARTITION BY y', 'a')}), ib AS ({_shares_sql('nb', 'PARTITION BY y', 'b')}),
i1 AS ({_shares_sql('c1', 'PARTITION BY y', 'c')}), i2 AS ({_shares_sql('c2', 'PARTITION BY y, a', 'c')}), i3 AS ({_shares_sql('c3', 'PARTITION BY y, a, b', 'c')}),
u AS (SELECT range AS id, {', '.join(f"{uniform_sql('range', c)} AS u{c}" for c in 'abcy')} FROM range((SELECT count(*) FROM t))),
r AS (SELECT u.id, uc, iy.y, ia.a, ib.b FROM u JOIN iy ON uy >= iy.lo AND uy < iy.hi JOIN ia ON ia.y = iy.y AND ua >= ia.lo AND ua < ia.hi
      JOIN ib ON ib.y = iy.y AND ub >= ib.lo AND ub < ib.hi),
d AS (SELECT r.*, CASE WHEN (y, a, b) IN (SELECT (y, a, b) FROM c3) THEN 3 WHEN (y, a) IN (SELECT (y, a) FROM c2) THEN 2 ELSE 1 END AS seen FROM r)
SELECT id, d.a, d.b, i.c, d.y FROM d JOIN i3 i ON seen = 3 AND i.y = d.y AND i.a = d.a AND i.b = d.b AND uc >= lo AND uc < hi
UNION ALL SELECT id, d.a, d.b, i.c, d.y FROM d JOIN i2 i ON seen = 2 AND i.y = d.y AND i.a = d.a AND uc >= lo AND uc < hi
UNION ALL SELECT id, d.a, d.b, i.c, d.y FROM d JOIN i1 i ON seen = 1 AND i.y = d.y AND uc >= lo AND uc < hi""")
def kdb_sample_backoff(spark, sf):
    rows = lineitem(spark, sf).selectExpr(*_THIN.split(", "))
    model = kdb.fit_kdb(rows, "y", edges=[("y", "a"), ("y", "b"), ("y", "c"), ("a", "c"), ("b", "c")])
    return kdb.sample_kdb(model, spark, backoff=True)


_NAMES = ", ".join(_ALL)


@query("synthesize_kdb", f"""
WITH real_rows AS (WITH {binned_sql()} SELECT {_NAMES} FROM binned), synth_rows AS (SELECT {_NAMES} FROM ({_sample_sql(2)})),
{divergence_sql('real_rows', 'synth_rows', LINE_NUMERIC, ['l_linestatus', LINE_TARGET])} {report_sql('', 5)}""")
def synthesize_kdb(spark, sf):
    real = checkpointed(lineitem_binned(spark, sf))
    model = kdb.fit_kdb(real, LINE_TARGET, 2)
    synth = checkpointed(kdb.sample_kdb(model, spark).drop("id"))
    return fidelity_report(real, synth, LINE_TARGET)


def _marginal_sql() -> str:
    picks, joins, ctes = [], [], []
    for c in ["o_orderpriority", "o_orderstatus"]:
        counts = f"SELECT {c} AS value, count(*) + 1e-8::DOUBLE AS n FROM orders GROUP BY 1"
        ctes.append(
            f"i_{c} AS (SELECT value, (sum(n) OVER (ORDER BY value) - n) / sum(n) OVER () AS lo, "
            f"CASE WHEN row_number() OVER (ORDER BY value DESC) = 1 THEN 1.0 ELSE sum(n) OVER (ORDER BY value) / sum(n) OVER () END AS hi FROM ({counts}))"
        )
        ctes.append(f"u_{c} AS (SELECT range AS id, {uniform_sql('range', c)} AS u FROM range((SELECT count(*) FROM orders)))")
        ctes.append(f"x_{c} AS (SELECT id, value FROM u_{c} JOIN i_{c} ON u >= lo AND u < hi)")
        picks.append(f"x_{c}.value AS {c}")
    return f"WITH {', '.join(ctes)} SELECT x_o_orderpriority.id, {', '.join(picks)} FROM x_o_orderpriority JOIN x_o_orderstatus USING (id)"


@query("synthesize_marginal", _marginal_sql())
def synthesize_marginal(spark, sf):
    rows = read_table(spark, sf, "orders").select("o_orderpriority", "o_orderstatus")
    return marginal.sample_marginal(marginal.fit_marginal(rows), spark)


_PRICE_U = uniform_sql("range", "o_totalprice#r"), uniform_sql("range", "o_totalprice#a")


@query("synthesize_marginal_numeric", f"""
WITH _real AS (SELECT o_totalprice, o_orderpriority, o_orderstatus FROM orders),
{quantile_grid_sql('_real', 'o_totalprice')}, {to_normal_sql('_real', 'o_totalprice', [])},
_m AS (SELECT avg(z) AS mean, stddev_pop(z) + {marginal.SIGMA_PADDING!r}::DOUBLE AS deviation FROM normals),
_price AS (SELECT range AS id, mean + deviation * (sqrt(-2.0::DOUBLE * ln(1.0::DOUBLE - {_PRICE_U[0]})) * cos(2.0::DOUBLE * pi() * {_PRICE_U[1]})) AS z
           FROM _m, range((SELECT count(*) FROM orders))),
_synth AS (SELECT {from_normal_sql('z')} AS o_totalprice, c.* EXCLUDE (id) FROM arrays, _price JOIN ({_marginal_sql()}) c USING (id)),
{divergence_sql('_real', '_synth', ['o_totalprice'], ['o_orderpriority', 'o_orderstatus'])} {report_sql('', 3)}""")
def synthesize_marginal_numeric(spark, sf):
    real = read_table(spark, sf, "orders").select("o_totalprice", "o_orderpriority", "o_orderstatus")
    synth = checkpointed(marginal.sample_marginal(marginal.fit_marginal(real), spark).drop("id"))
    return fidelity_report(real, synth, "o_orderstatus")


# ---------------------------------------------------------------- imputation

_GAPS = {
    "l_returnflag": "l_linenumber = 3",
    "l_quantity": "l_linenumber = 1 OR l_linenumber = 3",
    "l_discount": "l_linenumber = 2",
    "l_linestatus": "l_linenumber = 3 OR l_linenumber = 4",
}


def _impute_sql() -> str:
    """Arg-max imputation from a network whose features have only the label as parent."""
    keys = ", ".join(LINE_KEY)
    gap = lambda c: f"CASE WHEN {_GAPS[c]} THEN NULL ELSE b.{c} END" if c in _GAPS else f"b.{c}"
    holes = ", ".join(f"{gap(c)} AS {c}" for c in _ALL)
    probs = " UNION ALL ".join(
        f"SELECT '{c}' AS f, CAST({c} AS VARCHAR) AS v, {LINE_TARGET} AS y, count(*) / sum(count(*)) OVER (PARTITION BY {LINE_TARGET})::DOUBLE AS p FROM b GROUP BY {c}, {LINE_TARGET}"
        for c in LINE_FEATURES
    )
    term = lambda c: f"CASE WHEN h.{c} IS NULL THEN 0.0 ELSE ln(coalesce((SELECT p FROM pr WHERE f = '{c}' AND v = CAST(h.{c} AS VARCHAR) AND pr.y = g.y), 1e-12)) END"
    score = " + ".join(["ln(g.p)", *[term(c) for c in LINE_FEATURES]])
    best = lambda c: (
        f"coalesce(CAST(h.{c} AS VARCHAR), (SELECT arg_min(v, (-round(ln(p), 9), o)) FROM pq WHERE f = '{c}' AND pq.y = h.yy))"
    )
    order = " UNION ALL ".join(
        f"SELECT '{c}' AS f, CAST({c} AS VARCHAR) AS v, row_number() OVER (ORDER BY {c}) AS o FROM (SELECT DISTINCT {c} FROM b)" for c in LINE_FEATURES
    )
    out = ", ".join(
        f"{best(c)}::INTEGER AS {c}" if c in LINE_NUMERIC else f"{best(c)} AS {c}" for c in LINE_FEATURES
    )
    return f"""
WITH {binned_sql()},
b AS (SELECT {keys}, binned.* FROM (SELECT row_number() OVER () AS rid, {keys} FROM lineitem) k JOIN binned USING (rid)),
h0 AS (SELECT {keys}, {holes} FROM b),
pr AS ({probs}), oo AS ({order}), pq AS (SELECT pr.*, oo.o FROM pr JOIN oo USING (f, v)),
g AS (SELECT {LINE_TARGET} AS y, count(*) / sum(count(*)) OVER ()::DOUBLE AS p FROM b GROUP BY 1),
sc AS (SELECT {', '.join('h.' + k for k in LINE_KEY)}, g.y, round({score}, 9) AS s FROM h0 h, g WHERE h.{LINE_TARGET} IS NULL),
yb AS (SELECT {keys}, arg_min(y, (-s, y)) AS yy FROM sc GROUP BY ALL),
h AS (SELECT h0.*, coalesce(h0.{LINE_TARGET}, yb.yy) AS yy FROM h0 LEFT JOIN yb USING ({keys}))
SELECT {keys}, {out}, yy AS {LINE_TARGET} FROM h"""


def _with_gaps(spark, sf):
    """Binned lineitem whole, and the same rows with a key ``k`` and gaps."""
    key = F.concat_ws("-", *LINE_KEY, F.date_format("l_shipdate", "yyyyMMdd")).alias("k")
    rows = lineitem(spark, sf).select(key, "l_linenumber", *_ALL)
    whole = discretize(rows, fit_bins(rows, LINE_NUMERIC))
    gaps = whole.withColumns({c: F.when(~F.expr(cond), F.col(c)) for c, cond in _GAPS.items()})
    return whole.select(*_ALL), gaps.drop("l_linenumber")


def _unkeyed(df):
    parts = F.split("k", "-")
    keys = [parts[i].cast("int" if c == "l_linenumber" else "bigint").alias(c) for i, c in enumerate(LINE_KEY)]
    return df.select(*keys, *_ALL)


@query("impute_conditional", _impute_sql())
def impute_conditional(spark, sf):
    whole, gaps = _with_gaps(spark, sf)
    model = kdb.fit_kdb(whole, LINE_TARGET, 0)
    return _unkeyed(imp.impute(model, gaps, "k"))


@query("impute_conditional_k2")
def impute_conditional_k2(spark, sf):
    whole, gaps = _with_gaps(spark, sf)
    model = kdb.fit_kdb(whole, LINE_TARGET, 2)
    return _unkeyed(imp.impute(model, gaps, "k"))


@query("complete_partial_row")
def complete_partial_row(spark, sf):
    whole, gaps = _with_gaps(spark, sf)
    model = kdb.fit_kdb(whole, LINE_TARGET, 1)
    prompts = rowtext.partial_row_prompt(gaps, _ALL, "k").select("k", "prompt")
    return _unkeyed(imp.complete_partial_rows(model, prompts, "prompt", "k"))


@query("sample_alias", f"""
WITH w AS (SELECT l_returnflag AS g, CAST(l_quantity AS INTEGER) AS v, count(*) AS n FROM lineitem GROUP BY ALL),
s AS (SELECT g, v, row_number() OVER p - 1 AS slot, count(*) OVER q AS m, sum(n) OVER q AS total, n * count(*) OVER q - sum(n) OVER q AS surplus
      FROM w WINDOW p AS (PARTITION BY g ORDER BY v), q AS (PARTITION BY g)),
l AS (SELECT *, -surplus AS need, sum(-surplus) OVER (PARTITION BY g ORDER BY slot) AS hi FROM s WHERE surplus < 0),
h AS (SELECT *, sum(surplus) OVER (PARTITION BY g ORDER BY slot) AS hi, lead(v) OVER (PARTITION BY g ORDER BY slot) AS heir FROM s WHERE surplus > 0),
a AS (SELECT l.g, l.slot, l.v, h.v AS other, l.total - l.need AS keep FROM l JOIN h ON l.g = h.g AND l.hi - l.need >= h.hi - h.surplus AND l.hi - l.need < h.hi
      UNION ALL SELECT h.g, h.slot, h.v, h.heir, h.total - (l.hi - h.hi) FROM h JOIN l ON l.g = h.g AND h.hi > l.hi - l.need AND h.hi <= l.hi
      UNION ALL SELECT g, slot, v, v, total FROM s WHERE surplus = 0),
d AS (SELECT l_orderkey || '-' || l_linenumber AS k, l_returnflag AS g FROM lineitem),
u AS (SELECT k, d.g, m, total, {uniform_sql('k', 'alias')} * m AS pos FROM d JOIN (SELECT DISTINCT g, m, total FROM s) USING (g))
SELECT k, u.g, CASE WHEN (pos - floor(pos)) * total < keep THEN v ELSE other END AS value FROM u JOIN a ON a.g = u.g AND a.slot = floor(pos)""")
def sample_alias(spark, sf):
    rows = lineitem(spark, sf)
    weights = rows.groupBy(F.col("l_returnflag").alias("g"), F.col("l_quantity").cast("int").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    draws = rows.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("k"), F.col("l_returnflag").alias("g"))
    return alias.alias_draw(draws, alias.fit_alias(weights, ["g"], "v", "n"), "k", stream="alias")


_HOLES = {"a": (1, 3, 5), "b": (1, 2), "c": (2, 3, 4), "y": (1, 4)}


def _joint_sql() -> str:
    """The best of all completions of a row, in the network y -> a, b, c; a -> b; b -> c."""
    hole = lambda c: f"CASE WHEN l_linenumber IN {_HOLES[c]} THEN NULL ELSE {c} END AS h{c}"
    counts = lambda keys: f"SELECT {keys}, count(*)::DOUBLE AS n FROM t GROUP BY ALL"
    p = lambda c, n, whole: (
        f"CASE WHEN {whole}.n IS NULL THEN 1.0::DOUBLE / (SELECT count(DISTINCT {c}) FROM t) "
        f"ELSE coalesce({n}.n / {whole}.n, CASE WHEN h{c} IS NULL THEN 0 ELSE 1e-12 END) END AS p{c}"
    )
    return f"""
WITH t AS (SELECT l_orderkey || '-' || l_linenumber AS k, l_linenumber, {_CHAIN} FROM lineitem),
h AS (SELECT k, {', '.join(hole(c) for c in 'abcy')} FROM t),
e AS (SELECT DISTINCT ha, hb, hc, hy FROM h),
ny AS ({counts('y')}), na AS ({counts('y, a')}), nb AS ({counts('y, a, b')}), n2 AS ({counts('y, b')}), nc AS ({counts('y, b, c')}),
grid AS (SELECT * FROM e, (SELECT DISTINCT y FROM t) ty, (SELECT DISTINCT a FROM t) ta, (SELECT DISTINCT b FROM t) tb, (SELECT DISTINCT c FROM t) tc
         WHERE coalesce(hy, y) = y AND coalesce(ha, a) = a AND coalesce(hb, b) = b AND coalesce(hc, c) = c),
w AS (SELECT ha, hb, hc, hy, y, a, b, c, ny.n AS py, {p('a', 'na', 'ny')}, {p('b', 'nb', 'na')}, {p('c', 'nc', 'n2')} FROM grid
      JOIN ny USING (y) LEFT JOIN na USING (y, a) LEFT JOIN nb USING (y, a, b) LEFT JOIN n2 USING (y, b) LEFT JOIN nc USING (y, b, c)),
best AS (SELECT * FROM w WHERE pa > 0 AND pb > 0 AND pc > 0 QUALIFY row_number() OVER
         (PARTITION BY ha, hb, hc, hy ORDER BY round(ln(py) + ln(pa) + ln(pb) + ln(pc), 9) DESC, y, a, b, c) = 1)
SELECT k, a, b, c, y FROM h JOIN best ON h.ha IS NOT DISTINCT FROM best.ha AND h.hb IS NOT DISTINCT FROM best.hb
AND h.hc IS NOT DISTINCT FROM best.hc AND h.hy IS NOT DISTINCT FROM best.hy"""


@query("impute_joint", _joint_sql())
def impute_joint(spark, sf):
    key = F.concat_ws("-", "l_orderkey", "l_linenumber").alias("k")
    rows = lineitem(spark, sf).select(key, "l_linenumber", *[F.expr(e) for e in _CHAIN.split(", ")])
    model = kdb.fit_kdb(rows.select("a", "b", "c", "y"), "y", edges=[("y", "a"), ("y", "b"), ("y", "c"), ("a", "b"), ("b", "c")])
    gaps = rows.withColumns({c: F.when(~F.col("l_linenumber").isin(*at), F.col(c)) for c, at in _HOLES.items()})
    return imp.impute(model, gaps.drop("l_linenumber"), "k", joint=True)


# ---------------------------------------------------------------- tables of counts

@query("cross_table", f"WITH {binned_sql()} SELECT l_quantity, l_linestatus, l_returnflag, count(*) AS n FROM binned GROUP BY 1, 2, 3")
def cross_table(spark, sf):
    return tables.cross_table(lineitem_binned(spark, sf), ["l_quantity", "l_linestatus", "l_returnflag"])


@query("cross_table_weighted", "SELECT l_linestatus, l_returnflag, round(sum(l_extendedprice), 2) AS w FROM lineitem GROUP BY 1, 2")
def cross_table_weighted(spark, sf):
    return tables.cross_table(lineitem(spark, sf), ["l_linestatus", "l_returnflag"], "l_extendedprice").withColumn("w", F.round("w", 2))


@query("cpt", f"""
WITH {binned_sql()} SELECT l_linestatus, l_returnflag, l_quantity, count(*) AS n,
{metric_sql('count(*) / sum(count(*)) OVER (PARTITION BY l_linestatus, l_returnflag)::DOUBLE')} AS p FROM binned GROUP BY 1, 2, 3""")
def cpt(spark, sf):
    out = tables.cpt(lineitem_binned(spark, sf), "l_quantity", ["l_linestatus", "l_returnflag"])
    return out.withColumn("p", F.round("p", 9) + F.lit(0.0))


# fewer rows per cell, so that some configurations do not occur: customers by nation
_SPARSE = """
s AS (SELECT (dense_rank() OVER (ORDER BY c_mktsegment) - 1)::INTEGER AS seg, (dense_rank() OVER (ORDER BY c_nationkey) - 1)::INTEGER AS nat,
      least(floor((c_acctbal + 1000) / 100), 119)::INTEGER AS bal0 FROM customer),
t AS (SELECT seg, nat, (dense_rank() OVER (ORDER BY bal0) - 1)::INTEGER AS bal FROM s),
dense AS (SELECT * FROM (SELECT DISTINCT nat FROM t), (SELECT DISTINCT bal FROM t), (SELECT DISTINCT seg FROM t)),
n3 AS (SELECT nat, bal, seg, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY nat, bal)::DOUBLE AS p FROM t GROUP BY 1, 2, 3),
n2 AS (SELECT nat, seg, count(*) / sum(count(*)) OVER (PARTITION BY nat)::DOUBLE AS p FROM t GROUP BY 1, 2),
n1 AS (SELECT seg, count(*) / sum(count(*)) OVER ()::DOUBLE AS p FROM t GROUP BY 1)"""


def _sparse(spark, sf):
    rows = read_table(spark, sf, "customer").select(
        F.col("c_mktsegment").alias("seg"), F.col("c_nationkey").alias("nat"),
        F.least(F.floor((F.col("c_acctbal") + 1000) / 100), F.lit(119)).cast("int").alias("bal"),
    )
    cols = ["seg", "nat", "bal"]
    dictionary = enc.fit_dictionary(rows, cols)
    return checkpointed(enc.encode(rows, dictionary, cols)), {c: dictionary.cardinality(c) for c in cols}


@query("cpt_backoff", f"""
WITH {_SPARSE} SELECT nat, bal, seg, {metric_sql('coalesce(n3.p, n2.p, n1.p, 0.0)')} AS p
FROM dense LEFT JOIN n3 USING (nat, bal, seg) LEFT JOIN n2 USING (nat, seg) LEFT JOIN n1 USING (seg)""")
def cpt_backoff(spark, sf):
    coded, cards = _sparse(spark, sf)
    return tables.cpt_backoff(coded, "seg", ["nat", "bal"], cards).withColumn("p", F.round("p", 9) + F.lit(0.0))


@query("cpt_uniform_fill", f"""
WITH {_SPARSE} SELECT nat, bal, seg, {metric_sql('CASE WHEN c.nat IS NULL THEN 1.0::DOUBLE / (SELECT count(*) FROM n1) WHEN n3.p IS NULL THEN 1e-5 ELSE n3.p END')} AS p
FROM dense LEFT JOIN n3 USING (nat, bal, seg) LEFT JOIN (SELECT DISTINCT nat, bal FROM t) c USING (nat, bal)""".replace("SELECT nat, bal, seg, (round(CASE WHEN c.nat", "SELECT dense.nat, dense.bal, dense.seg, (round(CASE WHEN c.nat"))
def cpt_uniform_fill(spark, sf):
    coded, cards = _sparse(spark, sf)
    return tables.cpt_uniform_fill(coded, "seg", ["nat", "bal"], cards).withColumn("p", F.round("p", 9) + F.lit(0.0))


@query("observed_combinations", f"WITH {_SPARSE} SELECT nat, bal, count(DISTINCT seg) AS n_values FROM t GROUP BY 1, 2")
def observed_combinations(spark, sf):
    coded, _ = _sparse(spark, sf)
    return tables.observed_combinations(coded, "seg", ["nat", "bal"])


_HIGH = "(l_discount * (SELECT max(l_tax) + 1 FROM coded) + l_tax) * (SELECT max(l_quantity) + 1 FROM coded) + l_quantity"


def _coded_lines(spark, sf, keep=()):
    source = lineitem(spark, sf).select(*keep, *_ALL)
    rows = discretize(source, fit_bins(source, LINE_NUMERIC))
    dictionary = enc.fit_dictionary(rows, _ALL)
    return enc.encode(rows, dictionary, _ALL), {c: dictionary.cardinality(c) for c in _ALL}


@query("high_order_feature", f"WITH {binned_sql()}, {_codes_sql()} SELECT ({_HIGH})::BIGINT AS id, count(*) AS n FROM coded GROUP BY 1")
def high_order_feature(spark, sf):
    coded, cards = _coded_lines(spark, sf)
    ids = coded.select(enc.high_order_id("l_quantity", ["l_discount", "l_tax"], cards).alias("id"))
    return ids.groupBy("id").agg(F.count(F.lit(1)).alias("n"))


def _high_order_sql() -> str:
    keys = ", ".join(LINE_KEY)
    config = f"""
pcfg AS (SELECT l.rid, l."column" AS feature, coalesce((SELECT string_agg(lpad(p.value, 4, '0'), ',' ORDER BY e.parent) FROM edges e JOIN long p ON p."column" = e.parent
         WHERE e.child = l."column" AND e.rank > 0 AND p.rid = l.rid), '') || ',' || lpad(l.value, 4, '0') AS combo FROM long l),
ranked AS (SELECT rid, feature, (dense_rank() OVER (PARTITION BY feature ORDER BY combo) - 1)::INTEGER AS code FROM pcfg)"""
    picks = ", ".join(f"max(code) FILTER (feature = '{c}') AS {c}" for c in LINE_FEATURES)
    return f"""{_BASE}, {_edges_sql(1)}, {config},
keys AS (SELECT row_number() OVER () AS rid, {keys} FROM lineitem)
SELECT {keys}, r.* EXCLUDE (rid) FROM keys JOIN (SELECT rid, {picks} FROM ranked GROUP BY 1) r USING (rid)"""


@query("high_order_encode", _high_order_sql())
def high_order_encode(spark, sf):
    coded, cards = _coded_lines(spark, sf, LINE_KEY)
    counted = info.compact(coded, _ALL)
    ranking = checkpointed(info.mi_ranking(info.mutual_information(counted, LINE_FEATURES, LINE_TARGET)))
    cmi = info.conditional_mutual_information(counted, LINE_FEATURES, LINE_TARGET)
    edges = [(r["parent"], r["child"]) for r in info.kdb_edges(ranking, cmi, LINE_TARGET, 1).collect()]
    parents = info.feature_parents(edges, LINE_TARGET, LINE_FEATURES)
    out, _ = enc.high_order_encode(coded, parents, cards, LINE_KEY)
    return out


# ---------------------------------------------------------------- repairs

@query("missing_classes", "SELECT o_orderpriority AS label, count(*) AS n FROM orders WHERE o_orderpriority IN ('5-LOW', '2-HIGH') GROUP BY 1")
def missing_classes(spark, sf):
    real = read_table(spark, sf, "orders")
    return repair.missing_classes(real, real.where(~F.col("o_orderpriority").isin("5-LOW", "2-HIGH")), "o_orderpriority")


_COLS = "o_orderkey, o_orderpriority, o_orderstatus"


@query("class_coverage_repair", f"""
WITH s AS (SELECT {_COLS} FROM orders WHERE o_orderpriority NOT IN ('5-LOW', '2-HIGH'))
SELECT * FROM s UNION ALL SELECT {_COLS} FROM orders WHERE o_orderpriority IN ('5-LOW', '2-HIGH')
QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) = 1""")
def class_coverage_repair(spark, sf):
    real = read_table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    synth = real.where(~F.col("o_orderpriority").isin("5-LOW", "2-HIGH"))
    repaired = repair.class_coverage_repair(real, synth, "o_orderpriority", "o_orderkey")
    return repair.guard_two_classes(real, repaired, "o_orderpriority", "o_orderkey")


@query("category_coverage_repair", f"""
WITH s AS (SELECT {_COLS} FROM orders WHERE o_orderpriority NOT IN ('5-LOW', '2-HIGH') AND o_orderstatus <> 'P'),
t AS (SELECT * FROM s ORDER BY o_orderkey DESC LIMIT 1)
SELECT * FROM s
UNION ALL SELECT t.o_orderkey, x.o_orderpriority, t.o_orderstatus FROM t, (SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderpriority IN ('5-LOW', '2-HIGH')) x
UNION ALL SELECT t.o_orderkey, t.o_orderpriority, 'P' FROM t""")
def category_coverage_repair(spark, sf):
    real = read_table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    synth = real.where(~F.col("o_orderpriority").isin("5-LOW", "2-HIGH") & (F.col("o_orderstatus") != "P"))
    return repair.category_coverage_repair(real, synth, ["o_orderpriority", "o_orderstatus"], "o_orderkey")


# ---------------------------------------------------------------- whole run

def _run_sql() -> str:
    """Split, fit on train, sample, and compare the sample with train."""
    stats = ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in LINE_NUMERIC)
    bins = ", ".join(f"{bin_sql(c, f'lo_{c}', f'hi_{c}')} AS {c}" for c in LINE_NUMERIC)
    base = f"""
_m AS (SELECT {stats} FROM lineitem),
lines AS (SELECT {', '.join(LINE_KEY)}, {bins}, l_linestatus, l_returnflag FROM lineitem, _m),
{split_sql('lines', LINE_TARGET, LINE_KEY)},
binned AS (SELECT row_number() OVER () AS rid, {_NAMES} FROM marked WHERE split = 'train')"""
    points = ", ".join(LINE_FEATURES)
    square = " + ".join(f"((s.{c} - r.{c}) / s_{c}) ** 2" for c in LINE_NUMERIC)
    return f"""
WITH real_rows AS (WITH {base} SELECT {_NAMES} FROM binned), synth_rows AS (SELECT {_NAMES} FROM ({_sample_sql(2, base=base)})),
{divergence_sql('real_rows', 'synth_rows', LINE_NUMERIC, ['l_linestatus', LINE_TARGET])},
spread AS (SELECT {', '.join(f'stddev_pop({c}) AS s_{c}' for c in LINE_NUMERIC)} FROM real_rows),
r AS (SELECT DISTINCT {points} FROM real_rows), s AS (SELECT {points}, count(*) AS n FROM synth_rows GROUP BY ALL),
near AS (SELECT s.n, (SELECT min(sqrt({square} + 2 * (s.l_linestatus <> r.l_linestatus)::INTEGER)) FROM r, spread) AS d FROM s),
x AS (SELECT d FROM near, range(n)),
report AS ({report_sql('', 5)} UNION ALL SELECT 'summary', 'dcr_mean', round(avg(d), 6) FROM x
           UNION ALL SELECT 'summary', 'dcr_p5', round(quantile_cont(d, 0.05), 6) FROM x)
SELECT 'fidelity' AS evaluation, * FROM report"""


@query("synthesis_run", _run_sql())
def synthesis_run(spark, sf):
    rows = lineitem(spark, sf).select(*LINE_KEY, *_ALL)
    binned = discretize(rows, fit_bins(rows, LINE_NUMERIC))
    report, _ = run_train_test(binned, LINE_TARGET, LINE_KEY, "kdb", ["fidelity"])
    return report
