"""Queries of dedupe, splits, samples and duplicate groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from weir.functions import scalars as fn
from weir.operators import shaping, splits
from weir.plans.registry import query, table


@query("wn05_first_wins", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity) AS k FROM lineitem) WHERE k = 1")
def wn05(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity")
    return shaping.first_by(li, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity"]).drop("l_shipdate", "l_quantity")


def _groups(spark, d):
    docs = table(spark, d, "documents").select("doc_id", fn.fingerprint({"text": F.col("text")}).alias("fp"), (F.col("n_chars") % 2).alias("label"))
    return docs, splits.duplicate_groups(docs, "doc_id", "fp", "label")


_DUP = """
WITH f AS (SELECT doc_id, sha256('text=' || text) AS fp, n_chars % 2 AS label FROM documents),
g AS (SELECT fp, count(*) AS group_size, sum(label)::BIGINT AS label_1, min(doc_id) AS representative FROM f GROUP BY 1)"""


@query("ag11_wn07_duplicate_groups", _DUP + " SELECT fp, group_size, label_1, representative, group_size - label_1 AS label_0, (label_1 > 0 AND label_1 < group_size)::INTEGER AS mixed, printf('dedup_%07d', row_number() OVER (ORDER BY fp)) AS dedup_group_id FROM g")
def ag11(spark, d):
    return _groups(spark, d)[1]


@query("wn06_representatives", _DUP + " SELECT doc_id, (doc_id = representative)::INTEGER AS is_representative FROM f JOIN g USING (fp)")
def wn06(spark, d):
    docs, groups = _groups(spark, d)
    return docs.join(groups.select("fp", "representative"), "fp").select("doc_id", (F.col("doc_id") == F.col("representative")).cast("int").alias("is_representative"))


@query("ag12_duplicate_totals", _DUP + " SELECT count(*) AS unique_groups, coalesce(sum(group_size) FILTER (group_size > 1), 0)::BIGINT AS rows_in_groups, max(group_size) AS max_group, count(*) FILTER (label_1 > 0 AND label_1 < group_size) AS mixed_groups FROM g")
def ag12(spark, d):
    return _groups(spark, d)[1].agg(F.count("*").alias("unique_groups"), F.coalesce(F.sum(F.when(F.col("group_size") > 1, F.col("group_size"))), F.lit(0)).alias("rows_in_groups"), F.max("group_size").alias("max_group"), F.sum("mixed").cast("long").alias("mixed_groups"))


@query("wn09_row_caps", "SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents) WHERE k <= 20 ORDER BY doc_id LIMIT 300")
def wn09(spark, d):
    return shaping.row_caps(table(spark, d, "documents").select("doc_id", "source"), ["doc_id"], total=300, per="source", each=20)


@query("wn10_so03_stratified_sample", """
WITH rest AS (SELECT * FROM documents WHERE lang <> 'en'), s AS (SELECT lang, count(*) AS n, round_even(200.0::DOUBLE * count(*) / sum(count(*)) OVER (), 0) AS take FROM rest GROUP BY 1),
r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('42:' || doc_id)) AS k FROM rest)
SELECT doc_id, lang FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, lang FROM r JOIN s USING (lang) WHERE k <= least(take, n)""")
def wn10(spark, d):
    return splits.stratified_sample(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", "lang", 200, F.col("lang") == "en")


@query("wn11_stratified_split", """
WITH s AS (SELECT lang, round_even(count(*) * 0.2::DOUBLE, 0) AS n FROM documents GROUP BY 1)
SELECT doc_id, lang, CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY sha256('42:' || doc_id)) <= n THEN 'test' ELSE 'train' END AS split FROM documents JOIN s USING (lang)""")
def wn11(spark, d):
    return splits.stratified_split(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", "lang")


@query("wn12_shuffle_order", "SELECT doc_id, row_number() OVER (ORDER BY sha256('42:' || doc_id)) AS position FROM documents")
def wn12(spark, d):
    docs = table(spark, d, "documents").select("doc_id").withColumn("_h", splits.hash_order("doc_id"))
    part = docs.withColumn("_p", F.substring("_h", 1, 2))
    from pyspark.sql.window import Window

    before = part.groupBy("_p").agg(F.count("*").alias("_n")).withColumn("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return part.join(F.broadcast(before.select("_p", "_b")), "_p").select("doc_id", (F.row_number().over(Window.partitionBy("_p").orderBy("_h")) + F.col("_b")).alias("position"))


@query("wn13_st03_group_split")
def wn13(spark, d):
    """Greedy balanced split of (lang, source) groups, held against a plain loop in the tests."""
    g = table(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    return splits.group_split(g.withColumn("key", F.concat_ws("\0", "lang", "source")), "key", "n")


@query("jn10_group_split_rows")
def jn10(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.concat_ws("\0", "lang", "source").alias("key"))
    g = splits.group_split(docs.groupBy("key").agg(F.count("*").alias("n")), "key", "n")
    return docs.join(F.broadcast(g.select("key", "split")), "key")  # groups are files: few


@query("ag09_group_sizes", "SELECT lang, source, count(*) AS n, count(*) FILTER (n_chars % 2 = 1) AS label_1, count(*) FILTER (n_chars % 2 = 0) AS label_0 FROM documents GROUP BY 1, 2")
def ag09(spark, d):
    odd = F.col("n_chars") % 2
    return table(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"), F.sum(odd).alias("label_1"), F.sum(1 - odd).alias("label_0"))


@query("st01_st02_ordered_report", "SELECT source, n, (row_number() OVER (ORDER BY n DESC, source))::INTEGER AS position FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1)")
def st01(spark, d):
    from pyspark.sql.window import Window

    g = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))  # a report: a row per source
    return g.withColumn("position", F.row_number().over(Window.orderBy(F.desc("n"), "source")))
