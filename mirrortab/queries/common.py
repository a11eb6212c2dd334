"""Shared inputs of the registered queries, and the SQL fragments that mirror them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirrortab.functions.numeric import (
    ERF_A, ERF_P, INVERSE_NORMAL_CENTRE, INVERSE_NORMAL_CENTRE_DIVISOR, INVERSE_NORMAL_LOW, INVERSE_NORMAL_TAIL,
    INVERSE_NORMAL_TAIL_DIVISOR,
)
from mirrortab.operators.core import checkpointed
from mirrortab.operators.discretize import discretize, fit_bins
from mirrortab.operators.split import stratified_split
from mirrortab.sources.tables import read_table

LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
LINE_NUMERIC = ["l_quantity", "l_discount", "l_tax"]
LINE_FEATURES = [*LINE_NUMERIC, "l_linestatus"]
LINE_TARGET = "l_returnflag"


def lineitem(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "lineitem")


def lineitem_split(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Train and test rows of the supervised lineitem table."""
    rows = lineitem(spark, sf).select(*LINE_KEY, *LINE_FEATURES, LINE_TARGET)
    marked = checkpointed(stratified_split(rows, LINE_TARGET, LINE_KEY))
    part = lambda p: marked.where(F.col("split") == p).select(*LINE_FEATURES, LINE_TARGET)
    return part("train"), part("test")


def lineitem_binned(spark: SparkSession, sf: str) -> DataFrame:
    """The supervised lineitem table with numbers in ten equal-width bins."""
    rows = lineitem(spark, sf).select(*LINE_FEATURES, LINE_TARGET)
    return discretize(rows, fit_bins(rows, LINE_NUMERIC))


# ---------------------------------------------------------------- SQL fragments


def metric_sql(x: str, decimals: int = 9) -> str:
    return f"(round({x}, {decimals}) + 0.0::DOUBLE)"


def hash_sql(*keys: str, seed: int | str = 42) -> str:
    parts = ", ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    return f"md5(concat_ws('|', '{seed}', {parts}))"


def uniform_sql(key: str, stream: str = "", seed: int = 42, stream_expr: str | None = None) -> str:
    tail = f"':' || {stream_expr}" if stream_expr else f"':{stream}'"
    return (
        f"(('0x' || substr(md5('{seed}:' || CAST({key} AS VARCHAR) || {tail}), 1, 13))::BIGINT"
        " / 4503599627370496.0::DOUBLE)"
    )


def split_sql(table: str, label: str, keys: list[str], columns: str = "*", test_size: float = 0.2) -> str:
    """CTEs ending in ``marked``: the table's columns and ``split``."""
    return f"""
_c AS (SELECT {label} AS label, count(*) AS n FROM {table} GROUP BY 1),
_t AS (SELECT sum(n)::DOUBLE AS total, ceil(sum(n)::DOUBLE * {test_size}::DOUBLE) AS target FROM _c),
_s AS (SELECT label, n, target, floor(n * target / total) AS base,
              round(n * target / total - floor(n * target / total), 9) AS rest FROM _c, _t),
_q AS (SELECT label, n, (base + CASE WHEN row_number() OVER (ORDER BY rest DESC, label)
              <= target - sum(base) OVER () THEN 1 ELSE 0 END)::BIGINT AS n_test FROM _s),
_r AS (SELECT {columns}, row_number() OVER (PARTITION BY {label} ORDER BY {hash_sql(*keys)}) AS _rn FROM {table}),
marked AS (SELECT _r.* EXCLUDE (_rn), CASE WHEN _rn <= n_test THEN 'test' ELSE 'train' END AS split
           FROM _r JOIN _q ON _r.{label} = _q.label)"""


LINE_SPLIT_SQL = split_sql("lineitem", LINE_TARGET, LINE_KEY)


def bin_sql(column: str, lo: str, hi: str, bins: str = "10") -> str:
    """Number of inner equal-width edges at or below the value."""
    return (
        f"len(list_filter(range(1, {bins}), lambda i: (i * (({hi} - {lo}) / {bins}) + {lo}) <= {column}))::INTEGER"
    )


def binned_sql(table: str = "lineitem") -> str:
    """CTEs ending in ``binned``: rid, binned numbers, line status, return flag."""
    stats = ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in LINE_NUMERIC)
    bins = ", ".join(f"{bin_sql(c, f'lo_{c}', f'hi_{c}')} AS {c}" for c in LINE_NUMERIC)
    return f"""
_m AS (SELECT {stats} FROM {table}),
binned AS (SELECT row_number() OVER () AS rid, {bins}, l_linestatus, l_returnflag FROM {table}, _m)"""


def unpivot_sql(table: str, columns: list[str], keep: str = "rid") -> str:
    return " UNION ALL ".join(
        f"SELECT {keep}, '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value FROM {table}" for c in columns
    )


def divergence_sql(real: str, synth: str, numeric: list[str], categorical: list[str], n_bins: int = 10, prefix: str = "") -> str:
    """CTEs ending in ``{prefix}div``: column, jsd, kld_sym."""
    p = prefix
    sides = f"SELECT 'real' AS side, * FROM {real} UNION ALL BY NAME SELECT 'synth' AS side, * FROM {synth}"
    stats = [
        f"SELECT '{c}' AS \"column\", min({c}) AS lo0, max({c}) AS hi0, least({n_bins}, greatest(3, count(DISTINCT {c}))) AS bins FROM {p}pair_rows"
        for c in numeric
    ]
    cells = [
        f"SELECT side, '{c}' AS \"column\", CAST({bin_sql(c, 's.lo', 's.hi', 's.bins')} AS VARCHAR) AS value, s.bins AS width "
        f"FROM {p}pair_rows, {p}edges s WHERE s.\"column\" = '{c}' AND {c} IS NOT NULL"
        for c in numeric
    ] + [
        f"SELECT side, '{c}' AS \"column\", coalesce(CAST({c} AS VARCHAR), 'Missing') AS value, NULL AS width FROM {p}pair_rows"
        for c in categorical
    ]
    edges = (
        f"""{p}stats AS ({' UNION ALL '.join(stats)}),
{p}edges AS (SELECT "column", CASE WHEN lo0 = hi0 THEN lo0 - 0.5 ELSE lo0 END AS lo,
             CASE WHEN lo0 = hi0 THEN hi0 + 0.5 ELSE hi0 END AS hi, bins FROM {p}stats),"""
        if numeric
        else ""
    )
    return f"""
{p}pair_rows AS ({sides}),
{edges}
{p}cells AS ({' UNION ALL '.join(cells)}),
{p}counts AS (SELECT "column", value, max(width) AS width, count(*) FILTER (side = 'real') AS real_n,
              count(*) FILTER (side = 'synth') AS synth_n FROM {p}cells GROUP BY 1, 2),
{p}tot AS (SELECT "column", sum(real_n)::DOUBLE AS nr, sum(synth_n)::DOUBLE AS ns,
           1.0::DOUBLE + 1e-12::DOUBLE * coalesce(max(width), count(*)) AS norm FROM {p}counts GROUP BY 1),
{p}pq AS (SELECT c."column", (real_n / nr + 1e-12::DOUBLE) / norm AS p, (synth_n / ns + 1e-12::DOUBLE) / norm AS q
          FROM {p}counts c JOIN {p}tot t ON c."column" = t."column"),
{p}div AS (SELECT "column",
           {metric_sql("sum(p * ln(p / ((p + q) * 0.5)) + q * ln(q / ((p + q) * 0.5))) * 0.5")} AS jsd,
           {metric_sql("sum(p * ln(p / q) + q * ln(q / p)) * 0.5")} AS kld_sym
           FROM {p}pq GROUP BY 1)"""


def report_sql(prefix: str, n_columns: int) -> str:
    """Long fidelity report from ``{prefix}div``."""
    d = f"{prefix}div"
    return f"""
SELECT "column" AS "group", 'jsd' AS metric, round(jsd, 6) AS value FROM {d}
UNION ALL SELECT "column", 'kld_sym', round(kld_sym, 6) FROM {d}
UNION ALL SELECT 'summary', 'mean_jsd', round(sum(jsd) / {n_columns}, 6) FROM {d}
UNION ALL SELECT 'summary', 'mean_kld_sym', round(sum(kld_sym) / {n_columns}, 6) FROM {d}"""


def _polynomial_sql(x: str, coefficients: Sequence[float]) -> str:
    total = f"{coefficients[0]!r}::DOUBLE"
    for c in coefficients[1:]:
        total = f"({total} * {x} + {c!r}::DOUBLE)"
    return total


def inverse_normal_sql(p: str) -> str:
    """Quantile of the standard normal distribution by the rational approximation."""
    ends = lambda t: f"{_polynomial_sql(t, INVERSE_NORMAL_TAIL)} / {_polynomial_sql(t, (*INVERSE_NORMAL_TAIL_DIVISOR, 1.0))}"
    q = f"({p} - 0.5::DOUBLE)"
    centre = (
        f"{_polynomial_sql(f'({q} * {q})', INVERSE_NORMAL_CENTRE)} * {q} / "
        f"{_polynomial_sql(f'({q} * {q})', (*INVERSE_NORMAL_CENTRE_DIVISOR, 1.0))}"
    )
    low, high = f"sqrt(-2.0::DOUBLE * ln({p}))", f"sqrt(-2.0::DOUBLE * ln(1.0::DOUBLE - {p}))"
    return (
        f"CASE WHEN {p} < {INVERSE_NORMAL_LOW!r}::DOUBLE THEN {ends(low)} "
        f"WHEN {p} > 1.0::DOUBLE - {INVERSE_NORMAL_LOW!r}::DOUBLE THEN -({ends(high)}) ELSE {centre} END"
    )


def normal_cdf_sql(z: str) -> str:
    x = f"(abs({z}) / sqrt(2.0::DOUBLE))"
    t = f"(1.0::DOUBLE / (1.0::DOUBLE + {ERF_P!r}::DOUBLE * {x}))"
    series = "0.0::DOUBLE"
    for a in reversed(ERF_A):
        series = f"(({series} + {a!r}::DOUBLE) * {t})"
    return f"(0.5::DOUBLE + (CASE WHEN {z} >= 0 THEN 0.5::DOUBLE ELSE -0.5::DOUBLE END) * (1.0::DOUBLE - {series} * exp(-{x} * {x})))"


def quantile_grid_sql(table: str, x: str) -> str:
    """CTEs ending in ``arrays``: the values of a column at up to 1,000 even probabilities, as one list."""
    return f"""
_k AS (SELECT least(1000, greatest(count(*), 10)) AS k, count({x}) AS rows FROM {table}),
_s AS (SELECT {x} AS x, row_number() OVER (ORDER BY {x}) - 1 AS pos FROM {table} WHERE {x} IS NOT NULL),
_g AS (SELECT i, i / (k - 1)::DOUBLE * (rows - 1) AS pt FROM _k, range(_k.k) t(i)),
arrays AS (SELECT list(a.x + (b.x - a.x) * (pt - floor(pt)) ORDER BY i) AS q, count(*) AS k
           FROM _g JOIN _s a ON a.pos = floor(pt) JOIN _s b ON b.pos = ceil(pt))"""


def to_normal_sql(table: str, x: str, keep: Sequence[str]) -> str:
    """CTEs ending in ``normals`` (keep..., z) after :func:`quantile_grid_sql`; counts per distinct value."""
    return f"""
_d AS (SELECT DISTINCT {x} AS x FROM {table}),
_n AS (SELECT x, q, k, len(list_filter(q, lambda e: e < x)) AS below, len(list_filter(q, lambda e: e <= x)) AS upto FROM _d, arrays),
_u AS (SELECT x, greatest(1e-7::DOUBLE, least(1.0::DOUBLE - 1e-7::DOUBLE, CASE WHEN x <= q[1] THEN 0.0::DOUBLE WHEN x >= q[k] THEN 1.0::DOUBLE
       WHEN upto > below THEN (below + upto - 1) / (2.0::DOUBLE * (k - 1))
       ELSE (below - 1 + (x - q[below]) / (q[below + 1] - q[below])) / (k - 1)::DOUBLE END)) AS u FROM _n),
_z AS (SELECT x, {inverse_normal_sql('u')} AS z FROM _u),
normals AS (SELECT {', '.join(f't.{c}' for c in keep)}{', ' if keep else ''}z FROM {table} t JOIN _z ON t.{x} = _z.x)"""


def from_normal_sql(z: str) -> str:
    """Value of the list ``q`` (``k`` entries) at a standard normal number."""
    at = f"({normal_cdf_sql(z)} * (k - 1))"
    left = f"least(floor({at}), k - 2)::BIGINT"
    return f"(q[{left} + 1] + ({at} - {left}) * (q[{left} + 2] - q[{left} + 1]))"
