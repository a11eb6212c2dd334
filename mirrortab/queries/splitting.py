"""Splits, folds, parts, samples and draws."""

from pyspark.sql import functions as F

from mirrortab.operators import sampling, split
from mirrortab.operators.divergence import empirical_probabilities
from mirrortab.queries import query
from mirrortab.queries.common import LINE_KEY, LINE_TARGET, hash_sql, lineitem, split_sql, uniform_sql
from mirrortab.sources.tables import read_table

_KEYS = ", ".join(LINE_KEY)
_SPLIT = split_sql("lineitem", LINE_TARGET, LINE_KEY, f"{_KEYS}, {LINE_TARGET}")


@query("stratified_split", f"WITH {_SPLIT} SELECT {_KEYS}, split FROM marked")
def stratified_split(spark, sf):
    rows = lineitem(spark, sf).select(*LINE_KEY, LINE_TARGET)
    return split.stratified_split(rows, LINE_TARGET, LINE_KEY).select(*LINE_KEY, "split")


@query("split_counts", f"WITH {_SPLIT} SELECT label, n, n_test FROM _q")
def split_counts(spark, sf):
    return split.split_counts(lineitem(spark, sf), LINE_TARGET)


@query("stratified_kfold", f"""
WITH r AS (SELECT {_KEYS}, {LINE_TARGET}, row_number() OVER (PARTITION BY {LINE_TARGET} ORDER BY {hash_sql(*LINE_KEY)}) AS rn,
           count(*) OVER (PARTITION BY {LINE_TARGET}) AS n FROM lineitem)
SELECT {_KEYS}, len(list_filter(range(1, 5), lambda i: floor(n * i / 5.0::DOUBLE) < rn))::INTEGER AS fold FROM r""")
def kfold(spark, sf):
    rows = lineitem(spark, sf).select(*LINE_KEY, LINE_TARGET)
    return split.stratified_kfold(rows, LINE_TARGET, LINE_KEY, 5).select(*LINE_KEY, "fold")


@query("partition_disjoint", f"""
SELECT o_orderkey, least((row_number() OVER (ORDER BY {hash_sql('o_orderkey')}) - 1) // (count(*) OVER () // 7), 6)::INTEGER AS part FROM orders""")
def partition_disjoint(spark, sf):
    return split.partition_disjoint(read_table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], 7)


@query("sample_fraction", f"""
SELECT o_orderkey, o_totalprice FROM orders
QUALIFY row_number() OVER (ORDER BY {hash_sql('o_orderkey')}) <= floor(count(*) OVER () * 0.8)""")
def sample_fraction(spark, sf):
    return split.sample_rows(read_table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], fraction=0.8)


def _intervals(counts: str, weight: str = "n", group: str = "1") -> str:
    return (
        f"SELECT *, (sum({weight}) OVER w - {weight}) / sum({weight}) OVER (PARTITION BY {group})::DOUBLE AS lo, "
        f"CASE WHEN row_number() OVER (PARTITION BY {group} ORDER BY value DESC) = 1 THEN 1.0 ELSE sum({weight}) OVER w / sum({weight}) OVER (PARTITION BY {group})::DOUBLE END AS hi "
        f"FROM ({counts}) WINDOW w AS (PARTITION BY {group} ORDER BY value)"
    )


@query("sample_categorical", f"""
WITH i AS ({_intervals("SELECT l_returnflag AS value, count(*) AS n FROM lineitem GROUP BY 1")}),
d AS (SELECT range AS id, {uniform_sql('range', 'label')} AS u FROM range((SELECT count(*) FROM lineitem)))
SELECT id, value FROM d JOIN i ON u >= lo AND u < hi""")
def sample_categorical(spark, sf):
    rows = lineitem(spark, sf)
    weights = rows.groupBy(F.col(LINE_TARGET).alias("value")).agg(F.count(F.lit(1)).alias("weight"))
    return sampling.sample_categorical(sampling.ids(spark, rows.count()), weights, stream="label")


@query("sample_continuous", f"""
WITH i AS ({_intervals("SELECT o_totalprice AS value, count(*) AS n FROM orders GROUP BY 1")}),
d AS (SELECT range AS id, {uniform_sql('range', 'o_totalprice')} AS u FROM range((SELECT count(*) FROM orders)))
SELECT id, printf('%.5f', value) AS value FROM d ASOF JOIN i ON u >= lo""")
def sample_continuous(spark, sf):
    rows = read_table(spark, sf, "orders")
    return sampling.sample_continuous(sampling.ids(spark, rows.count()), rows, "o_totalprice")


_COLS = ["o_orderpriority", "o_orderstatus"]


@query("sample_start_column", f"""
SELECT o_orderkey, list_extract(['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate', 'o_orderpriority'],
       floor({uniform_sql('o_orderkey', 'start')} * 6)::INTEGER + 1) AS "column" FROM orders""")
def sample_start_column(spark, sf):
    rows = read_table(spark, sf, "orders")
    return sampling.sample_start_column(rows.select("o_orderkey"), rows.columns, key="o_orderkey")


@query("sample_conditions", f"""
WITH c AS (SELECT 'o_orderpriority' AS "column", o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 2
           UNION ALL SELECT 'o_orderstatus', o_orderstatus, count(*) FROM orders GROUP BY 2),
p AS (SELECT "column", value, (n + 1e-8::DOUBLE) / (sum(n) OVER w + count(*) OVER w * 1e-8::DOUBLE) AS n FROM c WINDOW w AS (PARTITION BY "column")),
i AS ({_intervals('SELECT * FROM p', group='"column"')}),
d AS (SELECT o_orderkey, list_extract(['o_orderpriority', 'o_orderstatus'], floor({uniform_sql('o_orderkey', 'start')} * 2)::INTEGER + 1) AS "column",
      {uniform_sql('o_orderkey', 'value')} AS u FROM orders)
SELECT o_orderkey, d."column", value FROM d JOIN i ON d."column" = i."column" AND u >= lo AND u < hi""")
def sample_conditions(spark, sf):
    rows = read_table(spark, sf, "orders")
    probabilities = empirical_probabilities(rows, _COLS)
    return sampling.sample_conditions(rows.select("o_orderkey"), probabilities, _COLS, key="o_orderkey")


@query("start_prompts", f"""
WITH i AS ({_intervals("SELECT o_totalprice AS value, count(*) AS n FROM orders GROUP BY 1")}),
d AS (SELECT range AS id, {uniform_sql('range', 'o_totalprice')} AS u FROM range((SELECT count(*) FROM orders)))
SELECT id, 'o_totalprice is ' || printf('%.5f', value) || ',' AS prompt FROM d ASOF JOIN i ON u >= lo""")
def start_prompts(spark, sf):
    rows = read_table(spark, sf, "orders")
    return sampling.start_prompts(
        sampling.ids(spark, rows.count()), "o_totalprice", rows.select("o_totalprice"), rows.columns
    )


_NULLED = f"(SELECT * REPLACE (CASE WHEN l_linenumber <> 3 THEN {LINE_TARGET} END AS {LINE_TARGET}) FROM lineitem)"
_NULL_SPLIT = split_sql(_NULLED, LINE_TARGET, LINE_KEY, f"{_KEYS}, {LINE_TARGET}").replace(
    f"_r.{LINE_TARGET} = _q.label", f"_r.{LINE_TARGET} IS NOT DISTINCT FROM _q.label"
).replace("rest DESC, label)", "rest DESC, label NULLS FIRST)")


def _without_some_labels(spark, sf):
    label = F.when(F.col("l_linenumber") != 3, F.col(LINE_TARGET))
    return lineitem(spark, sf).withColumn(LINE_TARGET, label).select(*LINE_KEY, LINE_TARGET)


@query("stratified_split_null_labels", f"WITH {_NULL_SPLIT} SELECT {_KEYS}, split FROM marked")
def stratified_split_null_labels(spark, sf):
    return split.stratified_split(_without_some_labels(spark, sf), LINE_TARGET, LINE_KEY).select(*LINE_KEY, "split")


@query("stratified_kfold_null_labels", f"""
WITH r AS (SELECT {_KEYS}, row_number() OVER (PARTITION BY {LINE_TARGET} ORDER BY {hash_sql(*LINE_KEY)}) AS rn,
           count(*) OVER (PARTITION BY {LINE_TARGET}) AS n FROM {_NULLED})
SELECT {_KEYS}, len(list_filter(range(1, 5), lambda i: floor(n * i / 5.0::DOUBLE) < rn))::INTEGER AS fold FROM r""")
def kfold_null_labels(spark, sf):
    return split.stratified_kfold(_without_some_labels(spark, sf), LINE_TARGET, LINE_KEY, 5).select(*LINE_KEY, "fold")
