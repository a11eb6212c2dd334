"""Profiles, inference rules, compatibility, presplit checks."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirrortab.functions import metric
from mirrortab.operators import profile, sketch
from mirrortab.operators.core import checkpointed
from mirrortab.operators.divergence import empirical_probabilities, label_distribution, label_tv_distance
from mirrortab.queries import query
from mirrortab.queries.common import (
    LINE_FEATURES, LINE_SPLIT_SQL, LINE_TARGET, lineitem, lineitem_split, metric_sql,
)
from mirrortab.sources.runs import DatasetRegistry, new_run_id
from mirrortab.sources.tables import read_table


def _kinds(table: str, columns: list[tuple[str, str]], target: str) -> str:
    rows = []
    for i, (c, kind) in enumerate(columns):
        shown = f"'{kind}'" if kind != "text" else f"CASE WHEN count(DISTINCT {c}) <= 32 THEN 'categorical' ELSE 'text' END"
        role = "target" if c == target else "feature"
        rows.append(
            f"SELECT '{c}' AS \"column\", {i} AS pos, {shown} AS kind, count(DISTINCT {c}) AS n_unique, "
            f"'{role}' AS role, count(*) AS n_rows, {len(columns) - 1} AS n_features FROM {table}"
        )
    return " UNION ALL ".join(rows)


@query("dataset_profile", _kinds("orders", [
    ("o_orderkey", "numeric"), ("o_custkey", "numeric"), ("o_orderstatus", "text"), ("o_totalprice", "numeric"),
    ("o_orderdate", "datetime"), ("o_orderpriority", "text")], "o_orderstatus"))
def dataset_profile(spark, sf):
    return profile.dataset_profile(read_table(spark, sf, "orders"), "o_orderstatus")


@query("registry_profile_reread", _kinds("orders", [
    ("o_orderkey", "numeric"), ("o_custkey", "numeric"), ("o_orderstatus", "text"), ("o_totalprice", "numeric"),
    ("o_orderdate", "datetime"), ("o_orderpriority", "text")], "o_orderstatus"))
def registry_profile_reread(spark, sf):
    """A dataset is registered under a shared folder, and its stored profile read again."""
    checkpointed(spark.range(1))  # makes sure that a shared folder is set
    registry = DatasetRegistry(spark, f"{spark.sparkContext.getCheckpointDir()}/registry-{new_run_id('query')}")
    return registry.register("Orders", read_table(spark, sf, "orders"), "o_orderstatus").drop("dataset_key", "task", "n_classes")


_LIMITS = {"l_returnflag": 3, "l_linestatus": 1, "l_quantity": 49, "l_discount": 12, "l_orderkey": 32, "l_partkey": 10}


@query("profile_merged", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) AS n_rows, count(x) AS n_values, "
    + (f"min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi, {metric_sql(f'sum({c}) / count(*)::DOUBLE', 4)} AS mean, "
       if not c.startswith(("l_r", "l_lines")) else "NULL::DOUBLE AS lo, NULL::DOUBLE AS hi, NULL::DOUBLE AS mean, ")
    + f"count(DISTINCT {c}) <= {limit} AS at_most FROM (SELECT *, {c} AS x FROM lineitem)" for c, limit in _LIMITS.items()))
def profile_merged(spark, sf):
    """Each return flag is a part with a profile of its own; the merged profile decides the rules."""
    rows = lineitem(spark, sf)
    parts = rows.select("l_returnflag").distinct().collect()  # the names of the parts
    stored = [checkpointed(sketch.fit_sketches(rows.where(F.col("l_returnflag") == p[0]), list(_LIMITS))) for p in parts]
    merged = checkpointed(sketch.merge_sketches(reduce(DataFrame.unionByName, stored)))
    rules = sketch.distinct_at_most(rows, merged, _LIMITS).select("column", "at_most")
    mean = metric(F.col("total") / F.col("n_values"), 4).alias("mean")
    return merged.select("column", "n_rows", "n_values", "lo", "hi", mean).join(rules, "column")


_TARGETS = ["l_returnflag", "l_linestatus", "l_linenumber", "l_quantity", "l_discount"]


@query("infer_task", " UNION ALL ".join(
    f"SELECT '{c}' AS target, CASE WHEN {number} AND count(DISTINCT {c}) > 10 THEN 'regression' "
    f"WHEN count(DISTINCT {c}) = 2 THEN 'binary_classification' ELSE 'multiclass_classification' END AS task, "
    f"CASE WHEN {number} AND count(DISTINCT {c}) > 10 THEN 0 ELSE count(DISTINCT {c}) END AS n_classes FROM lineitem"
    for c, number in zip(_TARGETS, ["false", "false", "true", "true", "true"])))
def infer_task(spark, sf):
    return profile.infer_task(lineitem(spark, sf), _TARGETS).fillna({"n_classes": 0})


@query("infer_task_ratio", " UNION ALL ".join(
    f"SELECT '{c}' AS target, "
    f"CASE WHEN NOT {is_float} OR count(DISTINCT {c}) <= greatest(20, floor(0.05 * count(*))) THEN 'classification' ELSE 'regression' END AS task_by_share, "
    f"CASE WHEN {text} OR count(DISTINCT {c}) < 20 THEN 'classification' ELSE 'regression' END AS task_by_count FROM lineitem"
    for c, is_float, text in [
        ("l_returnflag", "false", "true"), ("l_linenumber", "false", "false"), ("l_quantity", "true", "false"),
        ("l_discount", "true", "false"), ("l_extendedprice", "true", "false"), ("l_partkey", "false", "false")]))
def infer_task_ratio(spark, sf):
    targets = ["l_returnflag", "l_linenumber", "l_quantity", "l_discount", "l_extendedprice", "l_partkey"]
    return profile.infer_task_ratio(lineitem(spark, sf), targets)


def _schema_sql() -> str:
    rows = []
    for c, kind in [("l_partkey", "int"), ("l_linenumber", "int"), ("l_quantity", "float"), ("l_extendedprice", "float"),
                    ("l_discount", "float"), ("l_returnflag", "text")]:
        u = f"count(DISTINCT {c})"
        share = {"text": "true", "int": f"({u} <= 20 AND {u} / count(*)::DOUBLE < 0.05)", "float": "false"}[kind]
        count = "true" if kind == "text" else f"{u} <= 20"
        kinds = {"text": "categorical", "int": "discrete", "float": "continuous"}[kind]
        stats = (
            "NULL::DOUBLE AS min_value, NULL::DOUBLE AS max_value, NULL::DOUBLE AS mean_value, NULL::DOUBLE AS std_value"
            if kind == "text"
            else f"min({c})::DOUBLE AS min_value, max({c})::DOUBLE AS max_value, round(avg({c}), 7) AS mean_value, round(stddev_samp({c}), 7) AS std_value"
        )
        rows.append(
            f"SELECT '{c}' AS \"column\", {u} AS n_unique, CASE WHEN {share} THEN 'categorical' ELSE 'continuous' END AS kind_low_share, "
            f"CASE WHEN {count} THEN 'categorical' ELSE 'continuous' END AS kind_low_count, '{kinds}' AS kind_by_type, {stats} FROM lineitem"
        )
    return " UNION ALL ".join(rows)


@query("infer_schema", _schema_sql())
def infer_schema(spark, sf):
    rows = lineitem(spark, sf).select("l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag")
    return profile.infer_schema(rows)


_NEEDS = {
    "kdb": {"allowed_tasks": [profile.BINARY, profile.MULTICLASS]},
    "marginal": {},
    "binary-only": {"allowed_tasks": [profile.BINARY]},
    "small-label": {"min_classes": 2, "max_classes": 2},
    "numbers-only": {"requires_numeric_only": True},
}


@query("check_compatibility", """
WITH s AS (SELECT count(DISTINCT l_returnflag) AS classes, count(DISTINCT l_linestatus) > 0 AS has_text FROM lineitem)
SELECT 'kdb' AS model, true AS ok, 'ok' AS message FROM s
UNION ALL SELECT 'marginal', true, 'no requirements declared' FROM s
UNION ALL SELECT 'binary-only', classes = 2, CASE WHEN classes = 2 THEN 'ok' ELSE 'task not allowed: multiclass_classification' END FROM s
UNION ALL SELECT 'small-label', classes = 2, CASE WHEN classes > 2 THEN 'more than 2 classes' ELSE 'ok' END FROM s
UNION ALL SELECT 'numbers-only', NOT has_text, CASE WHEN has_text THEN 'feature columns must be numeric' ELSE 'ok' END FROM s""")
def check_compatibility(spark, sf):
    rows = lineitem(spark, sf).select(*LINE_FEATURES, LINE_TARGET)
    return profile.check_compatibility(
        profile.dataset_profile(rows, LINE_TARGET), profile.infer_task(rows, [LINE_TARGET]), _NEEDS
    )


@query("label_distribution", """
SELECT l_returnflag AS label, count(*) AS n, count(*) / sum(count(*)) OVER ()::DOUBLE AS p FROM lineitem GROUP BY 1""")
def label_dist(spark, sf):
    return label_distribution(lineitem(spark, sf), LINE_TARGET)


@query("empirical_probs", """
WITH c AS (SELECT 'o_orderpriority' AS "column", o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 2
           UNION ALL SELECT 'o_orderstatus', o_orderstatus, count(*) FROM orders GROUP BY 2)
SELECT "column", value, n, (n + 1e-8::DOUBLE) / (sum(n) OVER w + count(*) OVER w * 1e-8::DOUBLE) AS p FROM c WINDOW w AS (PARTITION BY "column")""")
def empirical_probs(spark, sf):
    return empirical_probabilities(read_table(spark, sf, "orders"), ["o_orderpriority", "o_orderstatus"])


_TV = f"""
WITH {LINE_SPLIT_SQL},
_p AS (SELECT {LINE_TARGET} AS label, count(*) FILTER (split = 'train') AS a, count(*) FILTER (split = 'test') AS b FROM marked GROUP BY 1)
SELECT %s{metric_sql('sum(abs(a / na - b / nb)) / 2')} AS tv
FROM _p, (SELECT sum(a)::DOUBLE AS na, sum(b)::DOUBLE AS nb FROM _p)"""


@query("label_tv_distance", _TV % "")
def tv_distance(spark, sf):
    return label_tv_distance(*lineitem_split(spark, sf), LINE_TARGET)


@query("presplit_check", _TV % "true AS ok, ")
def presplit(spark, sf):
    train, test = lineitem_split(spark, sf)
    profile.presplit_check(train, test, LINE_TARGET)
    return label_tv_distance(train, test, LINE_TARGET).select(F.lit(True).alias("ok"), "tv")
