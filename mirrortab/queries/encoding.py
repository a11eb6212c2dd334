"""Discretisers, encoders, scalers and their inverses; the two preprocessing flows."""

from pyspark.sql import functions as F

from mirrortab.functions import metric
from mirrortab.operators import encode as enc
from mirrortab.operators import scalers
from mirrortab.operators.discretize import discretize, fit_bins
from mirrortab.plans.preprocess import encode_preprocess, preprocess_tabular
from mirrortab.queries import query
from mirrortab.queries.common import (
    LINE_KEY, LINE_NUMERIC, bin_sql, from_normal_sql, lineitem, metric_sql, quantile_grid_sql, to_normal_sql,
)
from mirrortab.sources.tables import read_table

_KEYS = ", ".join(LINE_KEY)
_CONT = ["l_quantity", "l_extendedprice", "l_discount"]


def _dict_sql(table: str, column: str, name: str, first: str = "0") -> str:
    return (
        f"{name} AS (SELECT {column} AS v, (row_number() OVER (ORDER BY {first.format(v=column)}, {column}) - 1)::INTEGER AS code, "
        f"count(*) AS n FROM {table} GROUP BY 1)"
    )


@query("discretize_uniform", f"""
WITH m AS (SELECT {', '.join(f'min({c}) AS lo_{c}, max({c}) AS hi_{c}' for c in _CONT)} FROM lineitem)
SELECT {_KEYS}, {', '.join(f"{bin_sql(c, f'lo_{c}', f'hi_{c}')} AS {c}" for c in _CONT)} FROM lineitem, m""")
def discretize_uniform(spark, sf):
    rows = lineitem(spark, sf).select(*LINE_KEY, *_CONT)
    return discretize(rows, fit_bins(rows, _CONT))


@query("discretize_quantile", f"""
WITH m AS (SELECT {', '.join(f'quantile_cont({c}, [i / 10.0::DOUBLE for i in range(0, 11)]) AS q_{c}' for c in _CONT)} FROM lineitem)
SELECT {_KEYS}, {', '.join(f'len(list_filter(q_{c}[2:10], lambda e: e <= {c}))::INTEGER AS {c}' for c in _CONT)} FROM lineitem, m"""
    .replace("[i / 10.0::DOUBLE for i in range(0, 11)]", "[0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]"))
def discretize_quantile(spark, sf):
    rows = lineitem(spark, sf).select(*LINE_KEY, *_CONT)
    return discretize(rows, fit_bins(rows, _CONT, strategy="quantile"))


_LLOYD_STEPS = 3


def _kmeans_sql(column: str, table: str, key: str) -> str:
    steps = []
    for i in range(_LLOYD_STEPS):
        previous = f"c{i}"
        nearest = f"(SELECT count(*) FROM (SELECT k, (m + lead(m) OVER (ORDER BY k)) / 2 AS b FROM {previous}) WHERE b < x)"
        steps.append(
            f"s{i} AS (SELECT {nearest} AS k, sum(x * n) / sum(n)::DOUBLE AS m FROM v GROUP BY 1), "
            f"c{i + 1} AS (SELECT {previous}.k, coalesce(s{i}.m, {previous}.m) AS m FROM {previous} LEFT JOIN s{i} USING (k))"
        )
    last = f"(SELECT list(b) FROM (SELECT (m + lead(m) OVER (ORDER BY k)) / 2 AS b FROM c{_LLOYD_STEPS}) WHERE b IS NOT NULL)"
    return f"""
WITH v AS (SELECT {column} AS x, count(*) AS n FROM {table} GROUP BY 1),
r AS (SELECT min(x) AS lo, max(x) AS hi, (max(x) - min(x)) / 5 AS step FROM v),
c0 AS (SELECT i AS k, ((i * step + lo) + CASE WHEN i = 4 THEN hi ELSE ((i + 1) * step + lo) END) / 2 AS m FROM r, range(5) t(i)),
{', '.join(steps)},
e AS (SELECT {last} AS bs)
SELECT {key}, len(list_filter(bs, lambda b: b <= {column}))::INTEGER AS {column} FROM {table}, e"""


@query("discretize_kmeans", _kmeans_sql("o_totalprice", "orders", "o_orderkey"))
def discretize_kmeans(spark, sf):
    rows = read_table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return discretize(rows, fit_bins(rows, ["o_totalprice"], 5, "kmeans", iterations=_LLOYD_STEPS, tolerance=0.0))


@query("label_encode", f"""
WITH {_dict_sql('orders', 'o_orderpriority', 'a')}, {_dict_sql('orders', 'o_orderstatus', 'b')}
SELECT o_orderkey, a.code AS o_orderpriority, b.code AS o_orderstatus
FROM orders JOIN a ON o_orderpriority = a.v JOIN b ON o_orderstatus = b.v""")
def label_encode(spark, sf):
    cols = ["o_orderpriority", "o_orderstatus"]
    rows = read_table(spark, sf, "orders").select("o_orderkey", *cols)
    return enc.encode(rows, enc.fit_dictionary(rows, cols), cols)


@query("label_decode", f"""
WITH {_dict_sql('orders', 'o_orderpriority', 'a')},
r AS (SELECT o_orderkey, greatest(0, least(round_even(o_totalprice / 60000 - 1, 0), (SELECT max(code) FROM a)))::INTEGER AS code FROM orders)
SELECT o_orderkey, a.v AS o_orderpriority FROM r JOIN a USING (code)""")
def label_decode(spark, sf):
    rows = read_table(spark, sf, "orders")
    dictionary = enc.fit_dictionary(rows, ["o_orderpriority"])
    scores = rows.select("o_orderkey", (F.col("o_totalprice") / 60000 - 1).alias("o_orderpriority"))
    return enc.decode(scores, dictionary, ["o_orderpriority"])


_MISSING_FIRST = "CASE WHEN p IS NULL OR p = 'missing' THEN 'Missing' ELSE p END"
_MESSY = """m AS (SELECT o_orderkey, CASE o_orderpriority WHEN '5-LOW' THEN NULL WHEN '2-HIGH' THEN ' missing '
     WHEN '1-URGENT' THEN ' Alpha' ELSE o_orderpriority END AS raw FROM orders),
t AS (SELECT o_orderkey, coalesce(CASE WHEN trim(raw) = 'missing' THEN 'Missing' ELSE trim(raw) END, 'Missing') AS p FROM m)"""


@query("encode_missing_first", f"""
WITH {_MESSY}, d AS (SELECT p, (row_number() OVER (ORDER BY p <> 'Missing', p) - 1)::INTEGER AS code FROM (SELECT DISTINCT p FROM t))
SELECT o_orderkey, code AS priority FROM t JOIN d USING (p)""")
def encode_missing_first(spark, sf):
    p = F.col("o_orderpriority")
    raw = F.when(p == "2-HIGH", " missing ").when(p == "1-URGENT", " Alpha").when(p != "5-LOW", p)
    rows = read_table(spark, sf, "orders").select("o_orderkey", raw.alias("priority"))
    return enc.encode(rows, enc.fit_dictionary(rows, ["priority"], missing_first=True), ["priority"])


@query("ordinal_encode_unknown", f"""
WITH {_dict_sql("(SELECT * FROM orders WHERE o_orderstatus <> 'F' AND o_orderpriority <> '3-MEDIUM')", 'o_orderpriority', 'a')},
{_dict_sql("(SELECT * FROM orders WHERE o_orderstatus <> 'F' AND o_orderpriority <> '3-MEDIUM')", 'o_orderstatus', 'b')}
SELECT o_orderkey, coalesce(a.code, -1) AS o_orderpriority, coalesce(b.code, -1) AS o_orderstatus
FROM orders LEFT JOIN a ON o_orderpriority = a.v LEFT JOIN b ON o_orderstatus = b.v""")
def ordinal_encode_unknown(spark, sf):
    cols = ["o_orderpriority", "o_orderstatus"]
    rows = read_table(spark, sf, "orders").select("o_orderkey", *cols)
    known = rows.where((F.col("o_orderstatus") != "F") & (F.col("o_orderpriority") != "3-MEDIUM"))
    return enc.encode(rows, enc.fit_dictionary(known, cols), cols, unknown=-1)


@query("one_hot", f"""
WITH {_dict_sql('orders', 'o_orderpriority', 'a')}
SELECT o_orderkey, array_to_string(list_transform(range(0, (SELECT count(*) FROM a)), lambda i: (i = code)::INTEGER), '') AS bits
FROM orders JOIN a ON o_orderpriority = a.v""")
def one_hot(spark, sf):
    rows = read_table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    dictionary = enc.fit_dictionary(rows, ["o_orderpriority"])
    coded = enc.encode(rows, dictionary, ["o_orderpriority"], unknown=-1)
    bits = enc.one_hot(F.col("o_orderpriority"), dictionary.cardinality("o_orderpriority"))
    return coded.select("o_orderkey", F.array_join(bits, "").alias("bits"))


@query("argmax_decode", f"""
SELECT {_KEYS}, (list_position([l_discount, l_tax, 0.05::DOUBLE], greatest(l_discount, l_tax, 0.05::DOUBLE)) - 1)::INTEGER AS code FROM lineitem""")
def argmax_decode(spark, sf):
    scores = F.array("l_discount", "l_tax", F.lit(0.05))
    return lineitem(spark, sf).select(*LINE_KEY, enc.argmax_code(scores).alias("code"))


@query("condition_matrix", f"""
WITH {_dict_sql('orders', 'o_orderpriority', 'a')}, {_dict_sql('orders', 'o_orderstatus', 'b')}
SELECT o_orderkey, array_to_string(list_concat(
  list_transform(range(0, (SELECT count(*) FROM a)), lambda i: (i = a.code)::INTEGER),
  list_transform(range(0, (SELECT count(*) FROM b)), lambda i: (i = b.code)::INTEGER)), '') AS bits
FROM orders JOIN a ON o_orderpriority = a.v JOIN b ON o_orderstatus = b.v""")
def condition_matrix(spark, sf):
    cols = ["o_orderpriority", "o_orderstatus"]
    rows = read_table(spark, sf, "orders").select("o_orderkey", *cols)
    out = enc.condition_matrix(rows, enc.fit_dictionary(rows, cols), cols)
    return out.select("o_orderkey", F.array_join("cond", "").alias("bits"))


@query("minmax_scale", f"""
WITH m AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)
SELECT o_orderkey, {metric_sql('(o_totalprice - lo) / (hi - lo + 1e-8::DOUBLE)')} AS padded, {metric_sql('(o_totalprice - lo) / (hi - lo)')} AS plain,
       round(o_totalprice, 4) AS back FROM orders, m""")
def minmax_scale(spark, sf):
    rows = read_table(spark, sf, "orders")
    m = scalers.fit_moments(rows, ["o_totalprice"])["o_totalprice"]
    x = F.col("o_totalprice")
    padded = scalers.minmax_padded(x, m)
    return rows.select(
        "o_orderkey", metric(padded).alias("padded"), metric(scalers.minmax(x, m)).alias("plain"),
        F.round(scalers.minmax_padded_inverse(padded, m), 4).alias("back"),
    )


@query("minmax_symmetric", f"""
WITH m AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)
SELECT o_orderkey, {metric_sql('2.0::DOUBLE * (o_totalprice - lo) / (hi - lo) - 1.0::DOUBLE')} AS scaled, round(o_totalprice, 4) AS back FROM orders, m""")
def minmax_symmetric(spark, sf):
    rows = read_table(spark, sf, "orders")
    m = scalers.fit_moments(rows, ["o_totalprice"])["o_totalprice"]
    scaled = scalers.minmax_symmetric(F.col("o_totalprice"), m)
    return rows.select(
        "o_orderkey", metric(scaled).alias("scaled"), F.round(scalers.minmax_symmetric_inverse(scaled, m), 4).alias("back")
    )


@query("standardize", """
WITH m AS (SELECT avg(o_totalprice) AS mean, stddev_pop(o_totalprice) AS std FROM orders)
SELECT o_orderkey, round((o_totalprice - mean) / std, 6) + 0.0::DOUBLE AS scaled, round(o_totalprice, 4) AS back FROM orders, m""")
def standardize(spark, sf):
    rows = read_table(spark, sf, "orders")
    m = scalers.fit_moments(rows, ["o_totalprice"])["o_totalprice"]
    scaled = scalers.standardize(F.col("o_totalprice"), m)
    return rows.select(
        "o_orderkey", metric(scaled, 6).alias("scaled"), F.round(scalers.standardize_inverse(scaled, m), 4).alias("back")
    )


@query("quantile_transform", """
WITH n AS (SELECT least(1000, greatest(count(*), 10)) AS k, count(*) AS rows FROM customer),
s AS (SELECT c_acctbal AS x, row_number() OVER (ORDER BY c_acctbal) - 1 AS pos FROM customer),
g AS (SELECT i, i / (k - 1)::DOUBLE AS ref, i / (k - 1)::DOUBLE * (rows - 1) AS pt FROM n, range(n.k) t(i)),
q AS (SELECT i, ref, a.x + (b.x - a.x) * (pt - floor(pt)) AS v FROM g JOIN s a ON a.pos = floor(pt) JOIN s b ON b.pos = ceil(pt)),
h AS (SELECT q.i, q.v, q.ref, lead(v) OVER (ORDER BY i) AS v2, lead(ref) OVER (ORDER BY i) AS ref2 FROM q),
z AS (SELECT c_custkey, c_acctbal AS x, (SELECT max(i) FROM q WHERE v <= c_acctbal) AS hi_i, (SELECT count(*) FROM q WHERE v < c_acctbal) AS lo_i FROM customer)
SELECT c_custkey, round(CASE
   WHEN x <= (SELECT min(v) FROM q) THEN 0.0 WHEN x >= (SELECT max(v) FROM q) THEN 1.0
   WHEN h.v = x THEN (h.ref + (SELECT ref FROM q WHERE i = lo_i)) / 2
   ELSE h.ref + (x - h.v) / (h.v2 - h.v) * (h.ref2 - h.ref) END, 8) + 0.0::DOUBLE AS u
FROM z JOIN h ON h.i = hi_i""")
def quantile_transform(spark, sf):
    rows = read_table(spark, sf, "customer")
    grid = scalers.fit_quantile_grids(rows, ["c_acctbal"])["c_acctbal"]
    return rows.select("c_custkey", metric(scalers.to_uniform(F.col("c_acctbal"), grid), 8).alias("u"))


@query("quantile_normal_roundtrip", f"""
WITH r AS (SELECT {', '.join(LINE_KEY)}, l_extendedprice AS x FROM lineitem), {quantile_grid_sql('r', 'x')}, {to_normal_sql('r', 'x', LINE_KEY)}
SELECT {', '.join(LINE_KEY)}, {metric_sql('z', 6)} AS z, {metric_sql(from_normal_sql('z'), 4)} AS back FROM normals, arrays""")
def quantile_normal(spark, sf):
    rows = lineitem(spark, sf).select(*LINE_KEY, "l_extendedprice")
    grid = scalers.fit_quantile_grids(rows, ["l_extendedprice"])["l_extendedprice"]
    z = scalers.to_normal(F.col("l_extendedprice"), grid)
    placed = rows.select(*LINE_KEY, z.alias("z"))
    return placed.select(*LINE_KEY, metric(F.col("z"), 6).alias("z"), metric(scalers.from_normal(F.col("z"), grid), 4).alias("back"))


_PRE_SQL = f"""
WITH m AS (SELECT {', '.join(f'min({c}) AS lo_{c}, max({c}) AS hi_{c}' for c in LINE_NUMERIC)} FROM lineitem),
{_dict_sql('lineitem', 'l_linestatus', 'a')}, {_dict_sql('lineitem', 'l_returnflag', 'b')}
SELECT {', '.join(f"{bin_sql(c, f'lo_{c}', f'hi_{c}')} AS {c}" for c in LINE_NUMERIC)}, a.code AS l_linestatus, b.code AS l_returnflag
FROM lineitem JOIN a ON l_linestatus = a.v JOIN b ON l_returnflag = b.v, m"""


@query("preprocess_tabular", _PRE_SQL)
def preprocess(spark, sf):
    rows = lineitem(spark, sf).select(
        *LINE_NUMERIC, "l_linestatus", F.expr("nullif(l_linestatus, l_linestatus)").alias("void"), "l_returnflag"
    )
    return preprocess_tabular(rows, "l_returnflag")


@query("encode_preprocess", """
WITH m AS (SELECT *, CASE o_orderpriority WHEN '5-LOW' THEN NULL WHEN '2-HIGH' THEN 'missing' ELSE o_orderpriority END AS raw,
           CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE o_totalprice END AS price FROM orders),
t AS (SELECT price, coalesce(CASE WHEN raw = 'missing' THEN 'Missing' ELSE raw END, 'Missing') AS p, o_orderstatus AS s FROM m),
d AS (SELECT p, (row_number() OVER (ORDER BY p <> 'Missing', p) - 1)::INTEGER AS code FROM (SELECT DISTINCT p FROM t)),
e AS (SELECT s, (row_number() OVER (ORDER BY s) - 1)::INTEGER AS code FROM (SELECT DISTINCT s FROM t))
SELECT trunc(coalesce(price, (SELECT quantile_cont(price, 0.5) FROM t)))::BIGINT AS "0", d.code AS "1", e.code AS "2" FROM t JOIN d USING (p) JOIN e USING (s)""")
def encode_flow(spark, sf):
    p = F.col("o_orderpriority")
    rows = read_table(spark, sf, "orders").select(
        F.when(p != "1-URGENT", F.col("o_totalprice")).alias("price"),
        F.when(p == "2-HIGH", "missing").when(p != "5-LOW", p).alias("priority"),
        "o_orderstatus",
    )
    return encode_preprocess(rows)


@query("decode_unknown", "SELECT c_custkey, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END AS c_mktsegment FROM customer")
def decode_unknown(spark, sf):
    rows = read_table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    dictionary = enc.fit_dictionary(rows.where("c_mktsegment <> 'BUILDING'"), ["c_mktsegment"])
    return enc.decode(enc.encode(rows, dictionary, ["c_mktsegment"]), dictionary, ["c_mktsegment"])
