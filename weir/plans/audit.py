"""Queries of statistics, quality rules, metrics, drift, correlation, models, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weir.operators import metrics, quality
from weir.plans.registry import query, table

NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("ag04_value_counts", "SELECT p_brand, count(*) AS n FROM part GROUP BY 1")
def ag04(spark, d):
    return quality.value_counts(table(spark, d, "part"), ["p_brand"])


@query("ag05_group_sizes", "SELECT coalesce(l_returnflag, 'nan') || '|' || coalesce(l_linestatus, 'nan') AS key, count(*) AS n FROM lineitem GROUP BY 1")
def ag05(spark, d):
    return quality.joined_counts(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"])


@query("ag06_quantiles", "SELECT o_orderstatus, " + ", ".join(f"round(quantile_cont(o_totalprice, {q}), 4) AS q{int(q * 100)}" for q in (0.1, 0.5, 0.9, 0.99)) + " FROM orders GROUP BY 1")
def ag06(spark, d):
    out = quality.quantiles(table(spark, d, "orders"), ["o_orderstatus"], "o_totalprice", (0.1, 0.5, 0.9, 0.99))
    return out.select("o_orderstatus", *[F.round(f"q{k}", 4).alias(f"q{k}") for k in (10, 50, 90, 99)])


@query("ag07_missing_rates", "SELECT 'o_orderpriority' AS name, avg((nullif(o_orderpriority, '5-LOW') IS NULL)::INT) AS rate FROM orders UNION ALL SELECT 'o_custkey', avg((o_custkey IS NULL)::INT) FROM orders")
def ag07(spark, d):
    o = table(spark, d, "orders").select(F.expr("nullif(o_orderpriority, '5-LOW')").alias("o_orderpriority"), "o_custkey")
    return quality.missing_rates(o)


def _scored(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    return docs.join(table(spark, d, "labels"), "doc_id").select("lang", F.col("quality").alias("label"), ((F.col("n_chars") % 1000) / 1000.0).alias("score"), ((F.col("n_chars") % 1000) >= 500).cast("int").alias("predicted"))


_SCORED = "WITH s AS (SELECT lang, quality AS label, (n_chars % 1000) / 1000.0::DOUBLE AS score, ((n_chars % 1000) >= 500)::INT AS predicted FROM documents JOIN labels USING (doc_id))"


@query("ag13_confusion", _SCORED + """, c AS (SELECT lang, count(*) FILTER (label = 0 AND predicted = 0) AS tn, count(*) FILTER (label = 0 AND predicted = 1) AS fp, count(*) FILTER (label = 1 AND predicted = 0) AS fn, count(*) FILTER (label = 1 AND predicted = 1) AS tp FROM s GROUP BY 1)
SELECT lang, CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN tn ELSE -1 END AS tn, CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN tp ELSE -1 END AS tp, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision_pos, round(tp / nullif(tp + fn, 0), 6) AS recall_pos, round(fp / nullif(tn + fp, 0), 6) AS fpr,
 round(CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) END, 6) AS f1_pos FROM c""")
def ag13(spark, d):
    c = metrics.confusion(_scored(spark, d), ["lang"], "label", "predicted")
    return c.select("lang", "tn", "tp", *[F.round(k, 6).alias(k) for k in ("precision_pos", "recall_pos", "fpr", "f1_pos")])


@query("ag14_ag15_ranking", _SCORED + """, p AS (SELECT lang, score, sum(label) AS p, count(*) AS n FROM s GROUP BY 1, 2), c AS (SELECT *, sum(p) OVER w AS cp, sum(n) OVER w AS cn FROM p WINDOW w AS (PARTITION BY lang ORDER BY score DESC)),
t AS (SELECT lang, sum(p) AS pos, sum(n - p) AS neg, sum((n - p) * (cp - p + p / 2.0::DOUBLE)) AS area, sum(p * cp / cn::DOUBLE) AS steps FROM c GROUP BY 1)
SELECT lang, round(CASE WHEN pos > 0 AND neg > 0 THEN area / (pos * neg) END, 6) AS roc_auc, round(CASE WHEN pos > 0 AND neg > 0 THEN steps / pos END, 6) AS pr_auc FROM t""")
def ag14(spark, d):
    return metrics.ranking(_scored(spark, d), ["lang"], "label", "score").select("lang", F.round("roc_auc", 6).alias("roc_auc"), F.round("pr_auc", 6).alias("pr_auc"))


def drift_sql(columns: list[str] = NUMERIC) -> str:
    """SQL of the drift of ``lineitem`` columns between return flags."""
    long_ = " UNION ALL ".join(f"SELECT '{c}' AS feature, l_returnflag AS s, {c}::DOUBLE AS v FROM lineitem" for c in columns)
    levels = ", ".join(str(k / 50) for k in range(51))
    return f"""
WITH l AS ({long_}), p AS (SELECT DISTINCT a.feature, a.s AS source_a, b.s AS source_b FROM (SELECT DISTINCT feature, s FROM l) a JOIN (SELECT DISTINCT feature, s FROM l) b ON a.feature = b.feature AND a.s < b.s),
w AS (SELECT p.*, s, v FROM p JOIN l ON l.feature = p.feature AND (s = source_a OR s = source_b)),
e AS (SELECT feature, source_a, source_b, list_sort(list_distinct(quantile_cont(v, [{levels}]))) AS edges FROM w GROUP BY 1, 2, 3),
b AS (SELECT w.*, greatest(1, least(len(list_filter(edges, lambda x: x <= v)), len(edges) - 1)) AS bin, len(edges) - 1 AS k FROM w JOIN e USING (feature, source_a, source_b)),
h AS (SELECT feature, source_a, source_b, bin, any_value(k) AS k, count(*) FILTER (s = source_a) AS a, count(*) FILTER (s = source_b) AS b FROM b GROUP BY 1, 2, 3, 4),
q AS (SELECT *, (a / sum(a) OVER g + 1e-12) / (1 + 1e-12 * k) AS pa, (b / sum(b) OVER g + 1e-12) / (1 + 1e-12 * k) AS pb FROM h WINDOW g AS (PARTITION BY feature, source_a, source_b)),
drift AS (SELECT feature, source_a, source_b, sqrt(greatest(sum(pa * log2(pa / ((pa + pb) / 2)) + pb * log2(pb / ((pa + pb) / 2))) / 2, 0)) AS jsd FROM q GROUP BY 1, 2, 3)"""


def _drift(spark, d):
    return metrics.drift(table(spark, d, "lineitem"), "l_returnflag", NUMERIC)


@query("fn35_fn36_drift", drift_sql() + " SELECT feature, source_a, source_b, round(jsd, 5) AS jsd FROM drift")
def fn35(spark, d):
    return _drift(spark, d).withColumn("jsd", F.round("jsd", 5))


_GROUP_SQL = "CASE WHEN feature IN ('l_quantity', 'l_extendedprice') THEN 'flow' ELSE 'timing' END"


@query("ag16_drift_by_group", drift_sql() + f' SELECT {_GROUP_SQL} AS "group", source_a, source_b, round(avg(jsd), 5) AS mean_jsd, round(quantile_cont(jsd, 0.5), 5) AS median_jsd, round(max(jsd), 5) AS max_jsd, count(*) AS n_features FROM drift GROUP BY 1, 2, 3')
def ag16(spark, d):
    group = F.when(F.col("feature").isin("l_quantity", "l_extendedprice"), "flow").otherwise("timing")
    g = metrics.drift_by_group(_drift(spark, d), group)
    return g.select("group", "source_a", "source_b", *[F.round(c, 5).alias(c) for c in ("mean_jsd", "median_jsd", "max_jsd")], "n_features")


@query("ag18_so04_symmetric_drift", drift_sql() + ", m AS (SELECT source_a, source_b, avg(jsd) AS v FROM drift GROUP BY 1, 2), t AS (SELECT * FROM m UNION ALL SELECT source_b, source_a, v FROM m) SELECT source_a, source_b, round(v, 5) AS value FROM t UNION ALL SELECT DISTINCT source_a, source_a, 0.0::DOUBLE FROM t")
def ag18(spark, d):
    return metrics.symmetric(_drift(spark, d)).withColumn("value", F.round("value", 5))


@query("wn08_top_drift", drift_sql() + " SELECT source_a, source_b, feature, k::INTEGER AS k FROM (SELECT *, row_number() OVER (PARTITION BY source_a, source_b ORDER BY round(jsd, 5) DESC, feature) AS k FROM drift) WHERE k <= 3")
def wn08(spark, d):
    w = Window.partitionBy("source_a", "source_b").orderBy(F.desc(F.round("jsd", 5)), "feature")
    return _drift(spark, d).withColumn("k", F.row_number().over(w)).filter("k <= 3").select("source_a", "source_b", "feature", "k")


@query("ag17_pivot", "SELECT o_orderpriority, round(avg(o_totalprice) FILTER (o_orderstatus = 'F'), 4) AS \"F\", round(avg(o_totalprice) FILTER (o_orderstatus = 'O'), 4) AS \"O\", round(avg(o_totalprice) FILTER (o_orderstatus = 'P'), 4) AS \"P\" FROM orders GROUP BY 1")
def ag17(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.round(F.avg("o_totalprice"), 4))


@query("ag19_gap", "SELECT o_orderstatus, round(avg(o_totalprice) FILTER (o_orderpriority = '1-URGENT') - avg(o_totalprice) FILTER (o_orderpriority <> '1-URGENT'), 4) AS gap, count(*) FILTER (o_orderpriority = '1-URGENT') AS n_in, count(*) FILTER (o_orderpriority <> '1-URGENT') AS n_cross FROM orders GROUP BY 1")
def ag19(spark, d):
    return quality.gap(table(spark, d, "orders"), ["o_orderstatus"], F.col("o_orderpriority") == "1-URGENT", "o_totalprice")


@query("ag20_jn08_jn09_mean_drift", drift_sql() + ", held AS (SELECT DISTINCT l_returnflag AS heldout FROM lineitem) SELECT heldout, round(avg(jsd), 5) AS mean_drift, count(DISTINCT feature) AS n_features FROM drift JOIN held ON source_a = heldout OR source_b = heldout WHERE feature IN ('l_quantity', 'l_tax') GROUP BY 1")
def ag20(spark, d):
    # each drift row speaks for both of its sources, so the join is an explode
    x = _drift(spark, d).filter(F.col("feature").isin("l_quantity", "l_tax")).select(F.explode(F.array("source_a", "source_b")).alias("heldout"), "feature", "jsd")
    return x.groupBy("heldout").agg(F.round(F.avg("jsd"), 5).alias("mean_drift"), F.countDistinct("feature").alias("n_features"))


@query("ag21_correlation", """
WITH r AS (SELECT lang, n_chars::DOUBLE AS x, (doc_id % 97)::DOUBLE AS y FROM documents), k AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY x) + (count(*) OVER (PARTITION BY lang, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY lang ORDER BY y) + (count(*) OVER (PARTITION BY lang, y) - 1) / 2.0::DOUBLE AS ry FROM r)
SELECT lang, count(*) AS n, round(corr(x, y), 6) AS pearson_r, round(corr(rx, ry), 6) AS spearman_rho FROM k GROUP BY 1""")
def ag21(spark, d):
    t = table(spark, d, "documents").select("lang", F.col("n_chars").cast("double").alias("x"), (F.col("doc_id") % 97).cast("double").alias("y"))
    c = metrics.correlations(t, ["lang"], "x", "y")
    return c.select("lang", "n", F.round("pearson_r", 6).alias("pearson_r"), F.round("spearman_rho", 6).alias("spearman_rho"))


@query("ag22_correlation_p")
def ag22(spark, d):
    """Correlations with their p-values, from figures that aren't rounded."""
    t = table(spark, d, "documents").select("lang", F.col("n_chars").cast("double").alias("x"), (F.col("doc_id") % 97).cast("double").alias("y"))
    return metrics.with_p_values(metrics.correlations(t, ["lang"], "x", "y"))


@query("ag23_distinct_sources", "SELECT DISTINCT source FROM documents ORDER BY source")
def ag23(spark, d):
    return table(spark, d, "documents").select("source").distinct().orderBy("source")


@query("ag24_dq03_label_sets", "SELECT bool_and(toxic IN (0, 1)) AS valid, max(toxic) = 1 AND min(toxic) = 0 AS both FROM labels")
def ag24(spark, d):
    return quality.label_check(table(spark, d, "labels"), "toxic")


@query("ag25_class_weights", "SELECT toxic, count(*) AS n, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight FROM labels GROUP BY 1")
def ag25(spark, d):
    return metrics.class_weights(table(spark, d, "labels"), "toxic").withColumn("weight", F.round("weight", 6))


@query("dq02_unique_ids", "SELECT count(*) AS n, count(*) FILTER (doc_id IS NULL) AS n_null, count(*) - count(DISTINCT doc_id) - count(*) FILTER (doc_id IS NULL) AS n_repeated FROM documents")
def dq02(spark, d):
    return quality.id_check(table(spark, d, "documents"), "doc_id")


@query("dq05_ranges", "SELECT count(*) FILTER (l_quantity < 0) AS bad_duration, count(*) FILTER (l_linenumber < 0) AS bad_packets, count(*) FILTER (l_linestatus NOT IN ('F', 'O')) AS bad_flag FROM lineitem")
def dq05(spark, d):
    bad = {"bad_duration": F.col("l_quantity") < 0, "bad_packets": F.col("l_linenumber") < 0, "bad_flag": ~F.col("l_linestatus").isin("F", "O")}
    return quality.violations(table(spark, d, "lineitem"), bad)


@query("dq06_coverage", "SELECT bool_or(lang = 'en' AND source = 'src0') AS named_source, count(DISTINCT lang) AS n_langs FROM documents")
def dq06(spark, d):
    return table(spark, d, "documents").agg(F.max((F.col("lang") == "en") & (F.col("source") == "src0")).alias("named_source"), F.countDistinct("lang").alias("n_langs"))


@query("dq08_vocabulary", "SELECT 'p_type' AS field, p_type AS value, count(*) AS n FROM part GROUP BY 2 UNION ALL SELECT 'p_brand', p_brand, count(*) FROM part GROUP BY 2")
def dq08(spark, d):
    return quality.vocabulary(table(spark, d, "part"), ["p_type", "p_brand"])


@query("ml01_boosted_trees")
def ml01(spark, d):
    """Gradient-boosted trees on documents' numbers, trained in one job per tree level by the library's own histograms."""
    from weir.operators import models

    return models.holdout_scores(_model_rows(spark, d), ["n_chars", "n_words", "n_lines"], "label", "doc_id")


def _model_rows(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars", F.size(F.split("text", " ")).alias("n_words"), F.size(F.split("text", "\n")).alias("n_lines"))
    return docs.join(table(spark, d, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")
