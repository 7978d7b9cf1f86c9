"""Queries that write files through the sinks and read them back through the sources."""

from __future__ import annotations

import atexit
import gzip
import json
import tempfile
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weir.operators import metrics, quality, shaping, splits
from weir.plans.registry import query, table
from weir.sources import logs, sinks, tables

_MADE: list[tuple[SparkSession, str]] = []


def _folder(spark: SparkSession, label: str) -> str:
    """A new folder that all executors share, gone at exit; beside a local master it may be a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="weir-folders-")
    path = f"{root.rstrip('/')}/weir-{label}-{uuid.uuid4().hex}"
    _MADE.append((spark, path))
    return path


@atexit.register
def _remove() -> None:
    for spark, path in _MADE:
        if spark.sparkContext._jsc is not None:
            try:
                p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
            except Exception:  # the JVM may be gone before Python is
                return


def _nations(spark, d) -> list:
    return table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey").orderBy("n_nationkey").collect()  # 25 rows


@query("sc02_sc03_logs", "SELECT 'json' AS form, n_nationkey::VARCHAR AS uid, n_name AS name, CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE n_regionkey::VARCHAR END AS region FROM nation UNION ALL SELECT 'tab', n_nationkey::VARCHAR, n_name, CASE WHEN n_nationkey % 5 = 0 THEN '' ELSE n_regionkey::VARCHAR END FROM nation")
def sc02(spark, d):
    """JSON lines in a plain log, a table with a short row in a gzipped one; each is found by its name."""
    at, rows = _folder(spark, "logs"), _nations(spark, d)
    sinks.put_text(spark, f"{at}/ssl.log", "\n" + "\n".join(json.dumps({"uid": r[0], "name": r[1]} | ({} if r[0] % 5 == 0 else {"region": r[2]})) for r in rows) + "\n")
    lines = ["#separator \\x09", "#fields\tuid\tname\tregion", "#types\tstring\tstring\tint", *(f"{r[0]}\t{r[1]}" + ("" if r[0] % 5 == 0 else f"\t{r[2]}") for r in rows), "#close"]
    sinks.put_bytes(spark, f"{at}/conn.log.gz", gzip.compress("\n".join(lines).encode()))
    one = lambda form, name: logs.read_log(spark, logs.log_path(spark, at, name)).select(F.lit(form).alias("form"), "uid", "name", "region")
    return one("json", "ssl").union(one("tab", "conn"))


@query("sc05_labelled_connections", "SELECT n_nationkey::VARCHAR AS uid, n_name AS host, CASE WHEN n_regionkey = 1 THEN 'Malicious' ELSE 'benign' END AS label, 'r' || n_regionkey AS detail FROM nation")
def sc05(spark, d):
    at = _folder(spark, "labelled")
    lines = ["#fields\tuid\thost\ttunnel   label   detail", *(f"{r[0]}\t{r[1]}\t-   {'Malicious' if r[2] == 1 else 'benign'}   r{r[2]}" for r in _nations(spark, d)), "broken", "#close"]
    sinks.put_text(spark, f"{at}/conn.log.labeled", "\n".join(lines) + "\n")
    return logs.read_labelled_connections(spark, f"{at}/conn.log.labeled").select("uid", "host", "label", "detail")


@query("sc04_side_files", "SELECT r_name AS dir, CASE WHEN r_regionkey % 2 = 0 THEN 'capture ' || r_regionkey ELSE r_name END AS source_file, n_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def sc04(spark, d):
    """A folder's capture by its side file, or else by its own name."""
    at = _folder(spark, "sides")
    regions = table(spark, d, "region").select("r_regionkey", F.col("r_name").alias("dir"))
    for r in regions.collect():  # five rows
        sinks.put_text(spark, f"{at}/{r['dir']}/{'source_file.txt' if r[0] % 2 == 0 else 'other.txt'}", f" capture {r[0]}\n")
    rows = table(spark, d, "nation").join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select("dir", "n_name")
    return tables.with_source_file(rows, tables.side_file(spark, at)).select("dir", "source_file", "n_name")


@query("sc10_sc25_complete_captures", "SELECT * FROM (VALUES ('a.pcap', false), ('deep/c.pcap', false), ('obfs4/d.pcap', true)) AS t(name, obfuscated)")
def sc10(spark, d):
    """Captures with a partial download beside them are left out; some are listed by a part of their path."""
    at = _folder(spark, "captures")
    for name in ("a.pcap", "b.pcap", "b.pcap.aria2", "deep/c.pcap", "obfs4/d.pcap", "notes.txt"):
        sinks.put_text(spark, f"{at}/{name}", name)
    name = F.substring_index("path", at.rsplit("/", 1)[1] + "/", -1)
    whole = tables.complete_captures(tables.list_files(spark, at, "*.pcap"), tables.partial_files(spark, at))
    part = tables.list_files(spark, at, "*.pcap", ["OBFS", "tor"]).select("path", F.lit(True).alias("obfuscated"))
    return whole.join(part, "path", "left").select(name.alias("name"), F.coalesce("obfuscated", F.lit(False)).alias("obfuscated"))


@query("sc13_sk01_sk04_packet_rows", "SELECT c_custkey, c_name, c_nationkey FROM customer")
def sc13(spark, d):
    """Rows kept and rows rejected, written apart as Parquet, are all found again below one root."""
    at, rows = _folder(spark, "packets"), table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey")
    kept, lost = shaping.split_rejects(rows, F.col("c_nationkey") > 3, "near")
    sinks.write_parquet(kept, f"{at}/kept")
    sinks.write_rejects(lost.drop("reject_reason"), at, "customer", "near")
    return tables.load_packet_rows(spark, at)


@query("sc14_label_rows", "SELECT 'named' AS form, c_custkey::VARCHAR AS id, c_mktsegment AS value FROM customer UNION ALL SELECT 'bare', c_custkey::VARCHAR, c_mktsegment FROM customer")
def sc14(spark, d):
    """A label file with a header and one without; the columns of the latter are fixed."""
    at, c = _folder(spark, "labels"), table(spark, d, "customer")
    c.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("coin_type")).write.option("header", True).csv(f"{at}/named")
    c.select(*[F.col("c_custkey") if n == "id" else F.col("c_mktsegment") if n == "coin_type" else F.lit("x") for n in tables.LABEL_COLUMNS]).write.csv(f"{at}/bare")
    one = lambda form: tables.read_label_rows(spark, f"{at}/{form}").select(F.lit(form).alias("form"), "id", F.col("coin_type").alias("value"))
    return one("named").union(one("bare"))


@query("sc20_metadata_rows", "SELECT p_partkey::VARCHAR AS id, CASE WHEN p_size % 4 < 2 THEN 'yes' ELSE 'no' END AS encrypted FROM part")
def sc20(spark, d):
    """A gzipped CSV's rows with their flag in one spelling."""
    at = _folder(spark, "metadata")
    raw = F.element_at(F.array(F.lit("Yes"), F.lit(" TRUE "), F.lit("0"), F.lit(None).cast("string")), F.col("p_size") % 4 + 1)
    sinks.write_scalar_csv(table(spark, d, "part").select(F.col("p_partkey").alias("id"), raw.alias("Encrypted"), F.array("p_size").alias("list")), f"{at}/meta.csv.gz")
    return tables.read_metadata(spark, f"{at}/meta.csv.gz", "encrypted").select("id", "encrypted")


@query("sk03_sk07_json", "SELECT 'schema' AS part, 'doc_id' AS name, 'bigint' AS value UNION ALL SELECT 'schema', 'lang', 'string' UNION ALL SELECT 'lang', lang, count(*)::VARCHAR FROM documents GROUP BY 2")
def sk03(spark, d):
    """A schema and a vocabulary as JSON, read back."""
    at, docs = _folder(spark, "json"), table(spark, d, "documents").select("doc_id", "lang")
    sinks.put_text(spark, f"{at}/schema.json", sinks.schema_json(docs.schema))
    sinks.put_text(spark, f"{at}/vocabulary.json", sinks.vocabulary_json(quality.vocabulary(docs, ["lang"])))
    of = T.MapType(T.StringType(), T.LongType())
    schema = spark.read.option("multiLine", True).json(f"{at}/schema.json").select(F.explode("columns").alias("c")).select(F.lit("schema").alias("part"), "c.name", F.col("c.type").alias("value"))
    words = spark.read.option("multiLine", True).schema(T.StructType([T.StructField("lang", of)])).json(f"{at}/vocabulary.json").select(F.explode("lang").alias("name", "n"))
    return schema.union(words.select(F.lit("lang"), "name", F.col("n").cast("string")))


@query("sk05_sk09_reports", "SELECT o_orderpriority AS name, count(*)::VARCHAR AS n, CASE WHEN o_orderpriority LIKE '1%' THEN '' ELSE 'x' END AS note FROM orders GROUP BY 1")
def sk05(spark, d):
    """A report as one gzipped CSV in the order of its rows, missing cells blank."""
    at = _folder(spark, "report")
    rows = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("name")).agg(F.count("*").alias("n")).withColumn("note", F.when(~F.col("name").startswith("1"), "x"))
    sinks.write_report(rows.orderBy(F.desc("n"), "name"), f"{at}/report.csv.gz")
    return spark.read.option("header", True).option("nullValue", "\0").option("emptyValue", "").csv(f"{at}/report.csv.gz").select("name", "n", F.coalesce("note", F.lit("")).alias("note"))


@query("sk10_sk11_cache", "SELECT s_suppkey, s_nationkey FROM supplier")
def sk10(spark, d):
    """A table that is built once, read twice; metrics that were never measured add their header and no rows."""
    at, calls = _folder(spark, "cache"), []
    build = lambda: calls.append(1) or table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    first = sinks.read_through(spark, f"{at}/cache", build)
    again = sinks.read_through(spark, f"{at}/cache", build)
    none = sinks.metric_template(spark, ["f1"]).select(F.lit(0).alias("s_suppkey"), F.lit(0).alias("s_nationkey"))
    return (first if len(calls) == 1 else first.limit(0)).intersectAll(again).unionByName(none)


_MODEL = "concat_ws(chr(31), 'l_extendedprice=' || printf('%.6g', l_extendedprice::DOUBLE), 'l_quantity=' || printf('%.6g', l_quantity::DOUBLE), 'l_returnflag=' || l_returnflag)"


@query("ag11_fn31_fn32_model_duplicates", f"""
WITH f AS (SELECT sha256({_MODEL}) AS fingerprint, (l_linenumber % 2) AS label, l_orderkey * 10 + l_linenumber AS row FROM lineitem),
g AS (SELECT fingerprint, count(*) AS group_size, sum(label)::BIGINT AS label_1, min(row) AS representative FROM f GROUP BY 1)
SELECT fingerprint, group_size, label_1, representative, group_size - label_1 AS label_0, (label_1 > 0 AND label_1 < group_size)::INTEGER AS mixed, printf('dedup_%07d', row_number() OVER (ORDER BY fingerprint)) AS dedup_group_id FROM g""")
def ag11_model(spark, d):
    """Rows that a model can't tell apart, by the canonical values of what it reads."""
    li = table(spark, d, "lineitem").select(F.col("l_extendedprice").cast("double").alias("l_extendedprice"), F.col("l_quantity").cast("double").alias("l_quantity"), "l_returnflag", (F.col("l_linenumber") % 2).alias("label"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row"))
    return splits.duplicate_groups(shaping.model_fingerprint(li, ["l_extendedprice", "l_quantity", "l_returnflag"]), "row", "fingerprint", "label")


@query("pf02_minted_rows", "SELECT CASE WHEN doc_id % 3 = 0 THEN doc_id::VARCHAR ELSE sha256(concat_ws('|', 'mining_dataset_v1', source, '', doc_id::VARCHAR, 'tcp', '', '', '', '', '0.000000', '0.000000', '')) END AS sample_id, CASE WHEN doc_id % 2 = 0 THEN [1.0, 0.0, 2.5] ELSE [] END::DOUBLE[] AS seq_iat FROM documents")
def pf02_minted(spark, d):
    """Ids for rows without one, sequences from text, padding for what is missing."""
    field = lambda n, t, pad=None: T.StructField(n, t, True, {"padding": pad})
    schema = T.StructType([field("sample_id", T.StringType()), field("source", T.StringType(), ""), field("source_record_id", T.StringType(), ""), field("proto", T.StringType(), "tcp"), field("seq_iat", T.ArrayType(T.DoubleType()))])
    docs = table(spark, d, "documents").select(F.when(F.col("doc_id") % 3 == 0, F.col("doc_id").cast("string")).when(F.col("doc_id") % 3 == 1, "").alias("sample_id"), "source", F.col("doc_id").cast("string").alias("source_record_id"), F.when(F.col("doc_id") % 2 == 0, "[1|x|2.5]").alias("seq_iat"))
    return shaping.normalize(docs, schema, mint="sample_id").select("sample_id", "seq_iat")


@query("jn09_baseline_lookup", "SELECT l_linestatus AS feature_group, l_returnflag AS heldout, round(b.m - avg(l_discount), 6) AS gap FROM lineitem JOIN (SELECT l_linestatus AS s, avg(l_discount) AS m FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1) AS b ON b.s = l_linestatus WHERE l_returnflag <> 'N' GROUP BY 1, 2, b.m")
def jn09(spark, d):
    """A held-out figure against the baseline of its feature group."""
    figures = table(spark, d, "lineitem").groupBy(F.col("l_linestatus").alias("feature_group"), F.col("l_returnflag").alias("heldout")).agg(F.avg("l_discount").alias("value"))
    gaps = metrics.against_baseline(figures, F.col("heldout") == "N", "feature_group", "value")
    return gaps.select("feature_group", "heldout", F.round("gap", 6).alias("gap"))
