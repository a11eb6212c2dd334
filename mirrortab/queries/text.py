"""Rows as text and back, clean-up of generated values, slugs."""

from pyspark.sql import functions as F

from mirrortab.functions import clean_decoded_text, slug
from mirrortab.operators import rowtext
from mirrortab.queries import query
from mirrortab.sources.tables import read_table

_COLS = ["o_orderpriority", "o_totalprice", "o_orderstatus", "o_custkey"]


def _partial(spark, sf):
    """Orders with gaps: no status for P, no priority for 5-LOW."""
    return read_table(spark, sf, "orders").select(
        "o_orderkey", F.expr("nullif(o_orderpriority, '5-LOW')").alias("o_orderpriority"), "o_totalprice",
        F.expr("nullif(o_orderstatus, 'P')").alias("o_orderstatus"), "o_custkey",
    )


def _struct(c: str, text: str) -> str:
    key = "md5(concat_ws('|', '42', CAST(o_orderkey AS VARCHAR), '%s'))" % c
    return f"{{'o': {key}, 't': '{c} is ' || {text}}}"


_PARTS = ", ".join([
    _struct("o_orderpriority", "nullif(o_orderpriority, '5-LOW')"),
    _struct("o_totalprice", "regexp_replace(printf('%.1f', o_totalprice), '\\.?0+$', '')"),
    _struct("o_orderstatus", "nullif(o_orderstatus, 'P')"),
    _struct("o_custkey", "CAST(o_custkey AS VARCHAR)"),
])
_TEXT = (
    f"array_to_string(list_transform(list_sort(list_filter([{_PARTS}], lambda s: s.t IS NOT NULL)), lambda s: s.t), ', ')"
)


@query("row_to_text", f"SELECT o_orderkey, {_TEXT.replace('%.1f', '%.2f')} AS text FROM orders")
def row_to_text(spark, sf):
    return rowtext.row_to_text(_partial(spark, sf), _COLS, "o_orderkey", float_precision=2).select("o_orderkey", "text")


@query("text_to_row", """
SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN 'placeholder' ELSE o_orderpriority END AS o_orderpriority,
       CASE o_orderstatus WHEN 'P' THEN 'placeholder' WHEN 'F' THEN 'F' ELSE o_orderstatus END AS o_orderstatus,
       CAST(o_custkey AS VARCHAR) AS o_custkey, NULL::VARCHAR AS o_clerk FROM orders""")
def text_to_row(spark, sf):
    text = rowtext.row_to_text(_partial(spark, sf), _COLS, "o_orderkey", float_precision=2)
    noisy = text.select("o_orderkey", F.concat(F.lit("noise, o_orderstatus is , "), "text", F.lit(", o_custkey is 0, o_clerk is None")).alias("text"))
    return rowtext.text_to_row(noisy, "text", ["o_orderpriority", "o_orderstatus", "o_custkey", "o_clerk"]).drop("text")


@query("clean_text", r"""
SELECT doc_id, replace(replace(text, chr(10), ' '), chr(13), '') AS text FROM documents""")
def clean_text(spark, sf):
    return read_table(spark, sf, "documents").select(
        "doc_id", clean_decoded_text(F.concat("text", F.lit("<|endoftext|>"))).alias("text")
    )


def _gap(c: str, condition: str) -> str:
    return f"CASE WHEN {condition} THEN {{'o': md5(concat_ws('|', '42', CAST(o_orderkey AS VARCHAR), '{c}', 'missing')), 'c': '{c}'}} END"


@query("partial_row_prompt", f"""
WITH t AS (SELECT o_orderkey, {_TEXT.replace('%.1f', '%.2f')} AS known,
  list_sort(list_filter([{_gap('o_orderpriority', "o_orderpriority = '5-LOW'")}, {_gap('o_orderstatus', "o_orderstatus = 'P'")}], lambda g: g IS NOT NULL)) AS gaps FROM orders)
SELECT o_orderkey, CASE WHEN known <> '' THEN known || ', ' ELSE '' END || CASE WHEN len(gaps) > 0 THEN gaps[1].c || ' is' ELSE '' END AS prompt FROM t""")
def partial_row_prompt(spark, sf):
    return rowtext.partial_row_prompt(_partial(spark, sf), _COLS, "o_orderkey", float_precision=2).select("o_orderkey", "prompt")


@query("clean_generated_value", r"""
WITH g AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN lower(o_orderpriority) || '; o_totalprice is 3'
   WHEN 'O' THEN 'about ' || o_orderpriority || '!!, more' ELSE '  x-' || CAST(o_custkey AS VARCHAR) || ' units' END AS raw FROM orders),
s AS (SELECT *, trim(raw) AS t FROM g),
c AS (SELECT *, regexp_replace(trim(CASE WHEN contains(t, ';') THEN split_part(t, ';', 1) WHEN contains(t, ',') THEN split_part(t, ',', 1)
   WHEN contains(t, '.') THEN split_part(t, '.', 1) WHEN contains(t, chr(10)) THEN split_part(t, chr(10), 1)
   WHEN contains(t, ' ') THEN split_part(t, ' ', 1) ELSE t END), '[^\p{L}\p{N}.\-]+$', '') AS token FROM s),
k AS (SELECT DISTINCT o_orderpriority AS cat FROM orders)
SELECT o_orderkey, coalesce((SELECT min(cat) FROM k WHERE lower(cat) = lower(token)), (SELECT min(cat) FROM k WHERE contains(lower(token), lower(cat))), token) AS category,
       CASE WHEN regexp_matches(token, '-?\d+\.?\d*') THEN regexp_extract(token, '-?\d+\.?\d*') ELSE token END AS number FROM c""")
def clean_generated_value(spark, sf):
    orders = read_table(spark, sf, "orders")
    status = F.col("o_orderstatus")
    raw = (
        F.when(status == "F", F.concat(F.lower("o_orderpriority"), F.lit("; o_totalprice is 3")))
        .when(status == "O", F.concat(F.lit("about "), "o_orderpriority", F.lit("!!, more")))
        .otherwise(F.concat(F.lit("  x-"), F.col("o_custkey").cast("string"), F.lit(" units")))
    )
    rows = orders.select("o_orderkey", raw.alias("raw"))
    matched = rowtext.clean_generated_category(rows, "raw", orders.select("o_orderpriority"), "category")
    return matched.select("o_orderkey", "category", rowtext.clean_generated_number(F.col("raw")).alias("number"))


@query("slugify", """
WITH s AS (SELECT p_partkey AS k, p_name || ' / ' || p_type || '--' || p_brand AS t FROM part
           UNION ALL SELECT doc_id, '  ' || source || ': ' || lang || ' ' FROM documents)
SELECT k, t, CASE WHEN x = '' THEN 'unnamed' ELSE x END AS slug FROM (SELECT k, t,
  regexp_replace(regexp_replace(regexp_replace(lower(trim(t)), '[^a-z0-9-]+', '-', 'g'), '-{2,}', '-', 'g'), '^-+|-+$', '', 'g') AS x FROM s)""")
def slugify(spark, sf):
    parts = read_table(spark, sf, "part").select(
        F.col("p_partkey").alias("k"), F.concat("p_name", F.lit(" / "), "p_type", F.lit("--"), "p_brand").alias("t")
    )
    docs = read_table(spark, sf, "documents").select(
        F.col("doc_id").alias("k"), F.concat(F.lit("  "), "source", F.lit(": "), "lang", F.lit(" ")).alias("t")
    )
    return parts.unionByName(docs).withColumn("slug", slug(F.col("t")))
