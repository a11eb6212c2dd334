"""Null handling, coercion, filters, alignment."""

from pyspark.sql import functions as F

from mirrortab.operators import clean, repair
from mirrortab.operators.core import checkpointed, value_counts
from mirrortab.operators.profile import constant_columns, distinct_counts
from mirrortab.queries import query
from mirrortab.queries.common import LINE_KEY, lineitem
from mirrortab.sources.tables import column_roles, read_table, role_blocks
from mirrortab.sources.runs import registry_entry, schema_drift

_KEYS = ", ".join(LINE_KEY)


@query("na_tokens", """
SELECT o_orderkey,
       CASE WHEN o_orderpriority IN ('5-LOW', '1-URGENT') THEN NULL ELSE o_orderpriority END AS priority
FROM orders""")
def na_tokens(spark, sf):
    priority = (
        F.when(F.col("o_orderpriority") == "5-LOW", "?")
        .when(F.col("o_orderpriority") == "1-URGENT", "NA")
        .otherwise(F.col("o_orderpriority"))
    )
    return clean.null_tokens_to_null(read_table(spark, sf, "orders").select("o_orderkey", priority.alias("priority")))


@query("drop_all_null_columns", "SELECT c_custkey, c_acctbal, c_mktsegment FROM customer")
def drop_all_null_columns(spark, sf):
    rows = read_table(spark, sf, "customer").select(
        "c_custkey", "c_acctbal", F.expr("nullif(c_mktsegment, c_mktsegment)").alias("empty"), "c_mktsegment"
    )
    return clean.drop_all_null_columns(rows)


@query("coerce_numeric", """
SELECT p_partkey, TRY_CAST(substr(p_brand, 7) AS DOUBLE) AS brand, TRY_CAST(p_name AS DOUBLE) AS name FROM part""")
def coerce_numeric(spark, sf):
    rows = read_table(spark, sf, "part").select(
        "p_partkey", F.expr("substr(p_brand, 7)").alias("brand"), F.col("p_name").alias("name")
    )
    return clean.coerce_numeric(rows, ["brand", "name"])


@query("impute_median", f"""
WITH r AS (SELECT {_KEYS}, CASE WHEN l_linestatus = 'F' AND l_tax = 0.04 THEN NULL ELSE l_extendedprice END AS price,
                  CASE WHEN l_linenumber = 1 THEN NULL ELSE l_quantity END AS quantity FROM lineitem)
SELECT {_KEYS}, coalesce(price, (SELECT quantile_cont(price, 0.5) FROM r)) AS price,
       coalesce(quantity, (SELECT quantile_cont(quantity, 0.5) FROM r)) AS quantity FROM r""")
def impute_median(spark, sf):
    rows = lineitem(spark, sf).select(
        *LINE_KEY,
        F.when(~((F.col("l_linestatus") == "F") & (F.col("l_tax") == 0.04)), F.col("l_extendedprice")).alias("price"),
        F.when(F.col("l_linenumber") != 1, F.col("l_quantity")).alias("quantity"),
    )
    return clean.impute_median(rows, ["price", "quantity"])


@query("impute_missing_token", """
SELECT o_orderkey, coalesce(nullif(o_orderpriority, '5-LOW'), 'Missing') AS o_orderpriority FROM orders""")
def impute_missing_token(spark, sf):
    rows = read_table(spark, sf, "orders").select(
        "o_orderkey", F.expr("nullif(o_orderpriority, '5-LOW')").alias("o_orderpriority")
    )
    return clean.impute_missing_token(rows, ["o_orderpriority"])


@query("constant_columns", """
SELECT 'l_quantity' AS "column", count(DISTINCT l_quantity) AS n_unique, count(DISTINCT l_quantity) <= 1 AS is_constant FROM lineitem
UNION ALL SELECT 'l_linestatus', count(DISTINCT l_linestatus), count(DISTINCT l_linestatus) <= 1 FROM lineitem
UNION ALL SELECT 'same', count(DISTINCT l_tax * 0), count(DISTINCT l_tax * 0) <= 1 FROM lineitem
UNION ALL SELECT 'empty', count(DISTINCT nullif(l_linestatus, l_linestatus)), count(DISTINCT nullif(l_linestatus, l_linestatus)) <= 1 FROM lineitem""")
def constants(spark, sf):
    rows = lineitem(spark, sf).select(
        "l_quantity", "l_linestatus", (F.col("l_tax") * 0).alias("same"),
        F.expr("nullif(l_linestatus, l_linestatus)").alias("empty"),
    )
    return constant_columns(rows)


@query("clean_generated", """
WITH g AS (SELECT o_orderkey AS k, CASE o_orderpriority WHEN '5-LOW' THEN 'placeholder' WHEN '2-HIGH' THEN NULL ELSE o_orderpriority END AS priority,
                  CASE o_orderstatus WHEN 'F' THEN 'about ' || CAST(o_custkey AS VARCHAR) WHEN 'P' THEN NULL ELSE CAST(o_custkey AS VARCHAR) END AS cust
           FROM orders)
SELECT k, priority, TRY_CAST(cust AS DOUBLE) AS cust FROM g
WHERE coalesce(priority <> 'placeholder', true) AND (TRY_CAST(cust AS DOUBLE) IS NOT NULL OR cust IS NULL)""")
def clean_generated(spark, sf):
    priority, status, cust = F.col("o_orderpriority"), F.col("o_orderstatus"), F.col("o_custkey").cast("string")
    rows = read_table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("k"),
        F.when(priority == "5-LOW", "placeholder").when(priority != "2-HIGH", priority).alias("priority"),
        F.when(status == "F", F.concat(F.lit("about "), cust)).when(status != "P", cust).alias("cust"),
    )
    return clean.clean_generated(rows, ["cust"])


@query("filter_unseen_labels", """
WITH d AS (SELECT o_orderstatus, dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS label_code
           FROM (SELECT DISTINCT o_orderstatus FROM orders WHERE o_orderstatus <> 'O'))
SELECT o_orderkey, label_code FROM orders JOIN d USING (o_orderstatus)""")
def filter_unseen_labels(spark, sf):
    orders = read_table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    seen = orders.where(F.col("o_orderstatus") != "O")
    return repair.filter_unseen_labels(seen, orders, "o_orderstatus").select("o_orderkey", "label_code")


@query("align_columns", "SELECT c_custkey, c_acctbal, c_mktsegment FROM customer")
def align_columns(spark, sf):
    rows = read_table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    return clean.align_columns(rows.toDF("0", "1", "cat_0"), rows.columns)


@query("round_clip_codes", f"""
SELECT {_KEYS}, greatest(0, least(round_even(l_quantity * 0.5 - 3, 0), 19))::INTEGER AS code FROM lineitem""")
def round_clip_codes(spark, sf):
    return lineitem(spark, sf).select(*LINE_KEY, clean.round_clip(F.col("l_quantity") * 0.5 - 3, 20).alias("code"))


_ROLES = [
    ("o_orderkey", "numeric"), ("o_custkey", "numeric"), ("o_orderstatus", "categorical"), ("o_totalprice", "numeric"),
    ("o_orderdate", "categorical"), ("o_orderpriority", "categorical"),
]


@query("column_roles", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {i} AS pos, '{block}' AS block, count(*) AS n_rows, count(DISTINCT {c}) AS n_unique FROM orders"
    for i, (c, block) in enumerate(_ROLES)))
def roles(spark, sf):
    orders = read_table(spark, sf, "orders")
    found = distinct_counts(orders).select("column", "n_unique")
    return column_roles(orders, "o_orderstatus", "multiclass").join(found, "column")


_REGISTERED = ["o_totalprice", "o_orderpriority", "o_orderstatus"]
_FRESH = ["o_orderpriority", "o_totalprice", "o_orderstatus"]


@query("registry_schema_drift", " UNION ALL ".join(
    f"SELECT 'sales-orders' AS dataset_key, true AS drifted, '{c}' AS \"column\", {_REGISTERED.index(c)} AS registered_pos, {_FRESH.index(c)} AS fresh_pos, "
    f"count(DISTINCT {c}) AS registered_unique, count(DISTINCT {c}) FILTER (o_orderstatus <> 'P') AS fresh_unique FROM orders" for c in _REGISTERED))
def registry_schema_drift(spark, sf):
    orders = read_table(spark, sf, "orders")
    before = checkpointed(registry_entry(orders.select(*_REGISTERED), "Sales Orders"))
    after = checkpointed(registry_entry(orders.where("o_orderstatus <> 'P'").select(*_FRESH), "sales_orders"))
    part = lambda entry, name: entry.select(
        "dataset_key", "column", F.col("pos").alias(f"{name}_pos"), F.col("n_unique").alias(f"{name}_unique")
    )
    drift = schema_drift(before, after).select("dataset_key", "drifted")
    return part(before, "registered").join(part(after, "fresh"), ["dataset_key", "column"]).join(drift, "dataset_key")


@query("impute_median_nan", """
WITH s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS x FROM orders)
SELECT o_orderkey, coalesce(x, (SELECT quantile_cont(x, 0.5) FROM s)) AS o_totalprice FROM s""")
def impute_median_nan(spark, sf):
    price = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).otherwise(F.lit(float("nan")))
    rows = read_table(spark, sf, "orders").select("o_orderkey", price.alias("o_totalprice"))
    return clean.impute_median(rows, ["o_totalprice"])


_BLOCKS = {"numeric": ["o_orderkey", "o_custkey", "o_totalprice"], "categorical": ["o_orderstatus", "o_orderdate", "o_orderpriority"]}


@query("role_block_profile", " UNION ALL ".join(
    f"SELECT '{block}' AS block, '{c}' AS \"column\", count({c}) AS n, count(DISTINCT {c}) AS n_values FROM orders"
    for block, columns in _BLOCKS.items() for c in columns))
def role_block_profile(spark, sf):
    columns = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
    blocks = role_blocks(read_table(spark, sf, "orders").select(*columns), [0, 1, 3], [4, 5], [2], "multiclass")
    counted = [
        value_counts(df, df.columns).groupBy("column").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_values"))
        .select(F.lit(block).alias("block"), "column", "n", "n_values")
        for block, df in zip(_BLOCKS, blocks)
    ]
    return counted[0].unionByName(counted[1])
