"""Divergences, nearest records, discrepancy, utility, privacy, comparison, drift."""

from pyspark.sql import functions as F

from mirrortab.functions import metric
from mirrortab.operators import divergence, metrics, mmd, nearest, privacy
from mirrortab.operators.core import checkpointed
from mirrortab.operators.split import stratified_kfold, stratified_split
from mirrortab.plans import utility
from mirrortab.plans.run import compare_models
from mirrortab.queries import query
from mirrortab.queries.common import (
    LINE_FEATURES, LINE_KEY, LINE_NUMERIC, LINE_SPLIT_SQL, LINE_TARGET, divergence_sql, hash_sql, lineitem,
    lineitem_split, metric_sql, report_sql, split_sql, uniform_sql,
)
from mirrortab.sources.tables import read_table
from mirrortab.streaming.drift import label_drift, window_label_counts

_COLS = ", ".join([*LINE_FEATURES, LINE_TARGET])
_PARTS = f"""
_train AS (SELECT {_COLS} FROM marked WHERE split = 'train'),
_test AS (SELECT {_COLS} FROM marked WHERE split = 'test')"""
_ORDERS_SPLIT = split_sql("orders", "o_orderstatus", ["o_orderkey"])


def _orders_split(spark, sf):
    marked = checkpointed(stratified_split(read_table(spark, sf, "orders"), "o_orderstatus", ["o_orderkey"]))
    return marked.where(F.col("split") == "train"), marked.where(F.col("split") == "test")


@query("fidelity_report", f"""
WITH {LINE_SPLIT_SQL}, {_PARTS},
{divergence_sql('_train', '_test', LINE_NUMERIC, ['l_linestatus', LINE_TARGET])}
{report_sql('', 5)}""")
def fidelity_report(spark, sf):
    train, test = lineitem_split(spark, sf)
    return divergence.fidelity_report(train, test, LINE_TARGET)


@query("jsd_numeric", f"""
WITH {_ORDERS_SPLIT}, _a AS (SELECT o_totalprice, o_custkey FROM marked WHERE split = 'train'), _b AS (SELECT o_totalprice, o_custkey FROM marked WHERE split = 'test'),
{divergence_sql('_a', '_b', ['o_totalprice', 'o_custkey'], [], 20)} SELECT * FROM div""")
def jsd_numeric(spark, sf):
    train, test = _orders_split(spark, sf)
    return divergence.divergence_by_column(train, test, ["o_totalprice", "o_custkey"], [], 20)


@query("jsd_categorical", f"""
WITH {_ORDERS_SPLIT}, _a AS (SELECT nullif(o_orderpriority, '5-LOW') AS o_orderpriority, o_orderstatus FROM marked WHERE split = 'train'),
_b AS (SELECT o_orderpriority, nullif(o_orderstatus, 'P') AS o_orderstatus FROM marked WHERE split = 'test'),
{divergence_sql('_a', '_b', [], ['o_orderpriority', 'o_orderstatus'])} SELECT * FROM div""")
def jsd_categorical(spark, sf):
    train, test = _orders_split(spark, sf)
    a = train.select(F.expr("nullif(o_orderpriority, '5-LOW')").alias("o_orderpriority"), "o_orderstatus")
    b = test.select("o_orderpriority", F.expr("nullif(o_orderstatus, 'P')").alias("o_orderstatus"))
    return divergence.divergence_by_column(a, b, [], ["o_orderpriority", "o_orderstatus"])


@query("histogram_shared", f"""
WITH {LINE_SPLIT_SQL}, {_PARTS}, {divergence_sql('_train', '_test', LINE_NUMERIC, [])}
SELECT "column", CAST(value AS INTEGER) AS bin, real_n, synth_n FROM counts""")
def histogram_shared(spark, sf):
    return divergence.histogram_shared(*lineitem_split(spark, sf), LINE_NUMERIC)


_CUSTOMER_SPLIT = split_sql("customer", "c_mktsegment", ["c_custkey"])


@query("dcr", f"""
WITH {_CUSTOMER_SPLIT},
real AS (SELECT * FROM marked WHERE split = 'train'), synth AS (SELECT * FROM marked WHERE split = 'test'),
m AS (SELECT avg(c_acctbal) AS ma, stddev_pop(c_acctbal) AS sa, avg(c_nationkey) AS mn, stddev_pop(c_nationkey) AS sn FROM real),
d AS (SELECT s.c_custkey, min(sqrt(((s.c_acctbal - r.c_acctbal) / sa) ** 2 + ((s.c_nationkey - r.c_nationkey) / sn) ** 2
      + 2 * (s.c_mktsegment <> r.c_mktsegment)::INTEGER)) AS d FROM synth s, real r, m GROUP BY 1)
SELECT 'dcr_mean' AS metric, round(avg(d), 6) AS value FROM d
UNION ALL SELECT 'dcr_p5', round(quantile_cont(d, 0.05), 6) FROM d""")
def dcr(spark, sf):
    marked = checkpointed(stratified_split(read_table(spark, sf, "customer"), "c_mktsegment", ["c_custkey"]))
    part = lambda p: marked.where(F.col("split") == p)
    return nearest.dcr(part("train"), part("test"), ["c_acctbal", "c_nationkey", "c_mktsegment"])


_PTS = ", ".join(LINE_FEATURES)
_SCALED = " + ".join(f"((s.{c} - r.{c}) / s_{c}) ** 2" for c in LINE_NUMERIC)


@query("dcr_lineitem", f"""
WITH {LINE_SPLIT_SQL}, {_PARTS},
m AS (SELECT {', '.join(f'stddev_pop({c}) AS s_{c}' for c in LINE_NUMERIC)} FROM _train),
r AS (SELECT DISTINCT {_PTS} FROM _train), s AS (SELECT {_PTS}, count(*) AS n FROM _test GROUP BY ALL),
d AS (SELECT s.*, (SELECT min(sqrt({_SCALED} + 2 * (s.l_linestatus <> r.l_linestatus)::INTEGER)) FROM r, m) AS d FROM s),
x AS (SELECT d FROM d, range(n))
SELECT 'dcr_mean' AS metric, round(avg(d), 6) AS value FROM x UNION ALL SELECT 'dcr_p5', round(quantile_cont(d, 0.05), 6) FROM x""")
def dcr_lineitem(spark, sf):
    train, test = lineitem_split(spark, sf)
    return nearest.dcr(train, test, LINE_FEATURES)


_DIMS = """
_e AS (SELECT CASE WHEN label < 5 THEN 'x' ELSE 'y' END AS side, vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings)"""


@query("mmd_linear", f"""
WITH {_DIMS}, m AS (SELECT i, avg(v) FILTER (side = 'x') AS a, avg(v) FILTER (side = 'y') AS b FROM _e GROUP BY 1)
SELECT {metric_sql('sum((a - b) * (a - b))')} AS mmd FROM m""")
def mmd_linear(spark, sf):
    rows = read_table(spark, sf, "embeddings")
    return mmd.mmd_linear(rows.where("label < 5"), rows.where("label >= 5"), "embedding")


@query("mmd_rbf", f"""
WITH e AS (SELECT CASE WHEN label < 5 THEN 'x' ELSE 'y' END AS side, embedding::DOUBLE[] AS v FROM embeddings),
k AS (SELECT p.side AS a, q.side AS b, sum(exp(-(list_distance(p.v, q.v) ** 2) / 2)) AS s FROM e p, e q GROUP BY 1, 2),
n AS (SELECT count(*) FILTER (side = 'x')::DOUBLE AS m, count(*) FILTER (side = 'y')::DOUBLE AS n FROM e)
SELECT {metric_sql("(SELECT s FROM k WHERE a = 'x' AND b = 'x') / (m * m) + (SELECT s FROM k WHERE a = 'y' AND b = 'y') / (n * n) - 2 * (SELECT s FROM k WHERE a = 'x' AND b = 'y') / (m * n)")} AS mmd FROM n""")
def mmd_rbf(spark, sf):
    rows = read_table(spark, sf, "embeddings")
    return mmd.mmd_rbf(rows.where("label < 5"), rows.where("label >= 5"), "embedding")


_FREQUENCY = uniform_sql("k", "frequency#r"), uniform_sql("k", "frequency#a")


@query("mmd_fourier", f"""
WITH e AS (SELECT CASE WHEN label < 5 THEN 'x' ELSE 'y' END AS side, embedding::DOUBLE[] AS v FROM embeddings),
d AS (SELECT max(len(v)) AS d FROM e), k AS (SELECT j, i, j * d + i AS k FROM d, range(256) a(j), range(d.d) b(i)),
g AS (SELECT j, list(sqrt(-2.0::DOUBLE * ln(1.0::DOUBLE - {_FREQUENCY[0]})) * cos(2.0::DOUBLE * pi() * {_FREQUENCY[1]}) ORDER BY i) AS w FROM k GROUP BY 1),
c AS (SELECT side, j, avg(cos(list_inner_product(v, w) + 2.0::DOUBLE * pi() * {uniform_sql('j', 'phase')})) AS m FROM e, g GROUP BY 1, 2),
t AS (SELECT 2.0::DOUBLE * (max(m) FILTER (side = 'x') - max(m) FILTER (side = 'y')) ** 2 AS t FROM c GROUP BY j)
SELECT {metric_sql('avg(t)')} AS mmd, {metric_sql('stddev_samp(t) / 16')} AS std_error, {metric_sql('8 * sqrt(ln(2 / 0.05::DOUBLE) / 512)')} AS bound FROM t""")
def mmd_fourier(spark, sf):
    rows = read_table(spark, sf, "embeddings")
    return mmd.mmd_fourier(rows.where("label < 5"), rows.where("label >= 5"), "embedding")


@query("class_imbalance", f"""
SELECT count(*) FILTER (toxic = 0) AS n_neg, count(*) FILTER (toxic = 1) AS n_pos,
       {metric_sql('count(*) FILTER (toxic = 0) / count(*) FILTER (toxic = 1)::DOUBLE')} AS scale_pos_weight FROM labels""")
def class_imbalance(spark, sf):
    return metrics.class_imbalance(read_table(spark, sf, "labels"), "toxic")


_GUESS = "CASE WHEN l_quantity < 20 THEN 'A' WHEN l_linestatus = 'F' THEN 'R' WHEN l_tax > 0.06 THEN 'X' ELSE l_returnflag END"


@query("classification_metrics", f"""
WITH r AS (SELECT l_returnflag AS y, {_GUESS} AS p FROM lineitem),
c AS (SELECT y AS c FROM r UNION SELECT p FROM r),
s AS (SELECT c, (SELECT count(*) FROM r WHERE y = c) AS support, (SELECT count(*) FROM r WHERE p = c) AS called,
      (SELECT count(*) FROM r WHERE y = c AND p = c) AS tp FROM c),
f AS (SELECT *, CASE WHEN called > 0 THEN tp / called::DOUBLE ELSE 0 END AS pr, CASE WHEN support > 0 THEN tp / support::DOUBLE ELSE 0 END AS re,
      2.0 * tp / (called + support)::DOUBLE AS f1 FROM s),
t AS (SELECT sum(tp) / sum(support)::DOUBLE AS accuracy, sum(f1 * support) / sum(support)::DOUBLE AS f1_weighted, avg(f1) AS f1_macro,
      sum(pr * support) / sum(support)::DOUBLE AS precision_weighted, sum(re * support) / sum(support)::DOUBLE AS recall_weighted FROM f)
SELECT metric, round(value, 9) AS value FROM (UNPIVOT t ON accuracy, f1_weighted, f1_macro, precision_weighted, recall_weighted INTO NAME metric VALUE value)""")
def classification_metrics(spark, sf):
    return metrics.classification_metrics(
        lineitem(spark, sf).select(F.col("l_returnflag").alias("y"), F.expr(_GUESS).alias("p")), "y", "p"
    )


@query("roc_auc", f"""
WITH r AS (SELECT quality AS y, n_chars AS s FROM labels JOIN documents USING (doc_id)),
k AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0::DOUBLE AS r FROM r)
SELECT {metric_sql("(sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0::DOUBLE) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0))::DOUBLE")} AS auc FROM k""")
def roc_auc(spark, sf):
    rows = read_table(spark, sf, "labels").join(read_table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    return metrics.roc_auc(rows, "quality", "n_chars")


@query("regression_metrics", """
WITH r AS (SELECT l_extendedprice AS y, l_quantity * 2100.0::DOUBLE AS p FROM lineitem),
t AS (SELECT 1 - sum((y - p) ** 2) / (var_pop(y) * count(*)) AS r2, avg(abs(y - p)) AS mae, sqrt(avg((y - p) ** 2)) AS rmse FROM r)
SELECT metric, round(value, 6) AS value FROM (UNPIVOT t ON r2, mae, rmse INTO NAME metric VALUE value)""")
def regression_metrics(spark, sf):
    rows = lineitem(spark, sf).select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 2100.0).alias("p"))
    return metrics.regression_metrics(rows, "y", "p")


_U1, _U2 = uniform_sql("record", "votes#r"), uniform_sql("record", "votes#a")
_SIGMA = privacy.gaussian_sigma(1.0, 1e-5)


@query("noisy_vote_aggregate", f"""
WITH v AS (SELECT l_orderkey AS record, count(*) FILTER (l_returnflag = 'R') AS votes FROM lineitem GROUP BY 1),
z AS (SELECT record, votes, votes + {_SIGMA!r}::DOUBLE * (sqrt(-2.0::DOUBLE * ln(1.0::DOUBLE - {_U1})) * cos(2.0::DOUBLE * pi() * {_U2})) AS noisy FROM v)
SELECT record, votes, {metric_sql('noisy')} AS noisy_votes, (noisy / 7.0::DOUBLE > 0.5)::INTEGER AS label FROM z""")
def noisy_votes(spark, sf):
    votes = lineitem(spark, sf).select(
        F.col("l_orderkey").alias("record"), F.col("l_linenumber").alias("teacher"),
        (F.col("l_returnflag") == "R").cast("int").alias("vote"),
    )
    noisy = privacy.noisy_vote_aggregate(votes, 7, seed=42)
    return noisy.withColumn("noisy_votes", F.round("noisy_votes", 9) + F.lit(0.0))


@query("privacy_spent", f"""
WITH r AS (SELECT l_linestatus, l_orderkey, {_SIGMA!r}::DOUBLE * max(l_linenumber) AS sigma FROM lineitem GROUP BY 1, 2),
g AS (SELECT l_linestatus, count(*) AS n_released, sum(1 / (2 * sigma * sigma)) AS rho FROM r GROUP BY 1)
SELECT l_linestatus, n_released, {metric_sql('rho', 6)} AS rho, {metric_sql('1 + sqrt(ln(1e5::DOUBLE) / rho)', 6)} AS best_order,
       {metric_sql('rho + 2 * sqrt(rho * ln(1e5::DOUBLE))', 6)} AS epsilon FROM g""")
def privacy_spent(spark, sf):
    answered = lineitem(spark, sf).groupBy("l_linestatus", "l_orderkey").agg((F.lit(_SIGMA) * F.max("l_linenumber")).alias("sigma"))
    spent = privacy.privacy_spent(answered, ["l_linestatus"])
    return spent.select("l_linestatus", "n_released", *[metric(F.col(c), 6).alias(c) for c in ("rho", "best_order", "epsilon")])


def _labelled(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id", "n_chars", "lang", "source", F.size(F.split("text", r"\s+")).alias("n_words"))
    return read_table(spark, sf, "labels").join(docs, "doc_id")


@query("teacher_ensemble")
def teacher_ensemble(spark, sf):
    rows = _labelled(spark, sf)
    public = read_table(spark, sf, "documents").join(rows.select("doc_id"), "doc_id", "left_anti").select(
        F.col("doc_id").alias("record"), "n_chars", F.size(F.split("text", r"\s+")).alias("n_words")
    )  # rows that no teacher has seen
    return utility.teacher_ensemble(rows, public, ["n_chars", "n_words"], "quality", ["doc_id"], teachers=3, noise_seed=42)


@query("tstr_report")
def tstr_report(spark, sf):
    train, test = lineitem_split(spark, sf)
    return utility.tstr_report(train, test, LINE_TARGET)


@query("tstr_report_binary")
def tstr_report_binary(spark, sf):
    marked = checkpointed(stratified_split(_labelled(spark, sf), "quality", ["doc_id"]))
    part = lambda p: marked.where(F.col("split") == p).select("n_chars", "n_words", "lang", "quality")
    return utility.tstr_report(part("train"), part("test"), "quality", ["LR", "RF", "MLP", "GBT"])


@query("utility_regression")
def utility_regression(spark, sf):
    marked = checkpointed(stratified_split(lineitem(spark, sf), LINE_TARGET, LINE_KEY))
    part = lambda p: marked.where(F.col("split") == p).select("l_quantity", "l_discount", "l_linestatus", "l_extendedprice")
    return utility.utility_regression(part("train"), part("test"), "l_extendedprice")


@query("detection_score")
def detection_score(spark, sf):
    train, test = lineitem_split(spark, sf)
    return utility.detection_score(train, test, [*LINE_FEATURES, LINE_TARGET])


_FOLDS = f"""
_f AS (SELECT o_totalprice, o_orderpriority, o_orderstatus,
       len(list_filter(range(1, 3), lambda i: floor(n * i / 3.0::DOUBLE) < rn)) AS fold FROM
       (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {hash_sql('o_orderkey')}) AS rn, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)),
_r AS (SELECT * EXCLUDE (fold) FROM _f WHERE fold = 0), _a AS (SELECT * EXCLUDE (fold) FROM _f WHERE fold = 1), _b AS (SELECT * EXCLUDE (fold) FROM _f WHERE fold = 2)"""


@query("compare_models", f"""
WITH {_FOLDS},
{divergence_sql('_r', '_a', ['o_totalprice'], ['o_orderpriority', 'o_orderstatus'], prefix='a_')},
{divergence_sql('_r', '_b', ['o_totalprice'], ['o_orderpriority', 'o_orderstatus'], prefix='b_')},
x AS ({report_sql('a_', 3)}), y AS ({report_sql('b_', 3)})
SELECT x."group", x.metric, x.value AS first, y.value AS second FROM x JOIN y ON x."group" = y."group" AND x.metric = y.metric""")
def compare(spark, sf):
    rows = read_table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus")
    folds = checkpointed(stratified_kfold(rows, "o_orderstatus", ["o_orderkey"], 3))
    part = lambda i: folds.where(F.col("fold") == i).drop("o_orderkey", "fold")
    report = lambda i: divergence.fidelity_report(part(0), part(i), "o_orderstatus")
    return compare_models({"first": report(1), "second": report(2)})


@query("stream_label_drift", f"""
WITH ref AS (SELECT event_type AS label, count(*) / sum(count(*)) OVER ()::DOUBLE AS p FROM events GROUP BY 1),
w AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type AS label, count(*) AS n FROM events GROUP BY 1, 2),
t AS (SELECT window_start, sum(n)::BIGINT AS n FROM w GROUP BY 1)
SELECT t.window_start, t.n, {metric_sql('sum(abs(coalesce(w.n, 0) / t.n::DOUBLE - ref.p)) / 2')} AS tv
FROM t CROSS JOIN ref LEFT JOIN w ON w.window_start = t.window_start AND w.label = ref.label GROUP BY 1, 2""")
def stream_label_drift(spark, sf):
    static = read_table(spark, sf, "events")
    reference = divergence.label_distribution(static, "event_type")
    stream = spark.readStream.schema(static.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    stamped = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    counts = window_label_counts(stamped, "ts", "event_type")
    context = spark.sparkContext
    checkpointed(reference)  # makes sure that a shared checkpoint folder is set
    base = f"{context.getCheckpointDir()}/drift-{context._jvm.java.util.UUID.randomUUID()}"

    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={batch_id}")

    run = (
        counts.writeStream.outputMode("update").foreachBatch(keep)
        .option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    )
    run.awaitTermination()
    batches = spark.read.parquet(f"{base}/out")
    # a batch holds the counts it changed, so that closed windows leave the state
    latest = batches.groupBy("window_start", "label").agg(F.max_by("n", "batch").alias("n"))
    drift = label_drift(latest, reference)
    return drift.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
