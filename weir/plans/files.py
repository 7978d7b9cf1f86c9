"""Queries of sources, sinks, models and the streaming extension."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from weir.operators import models, quality, shaping, splits
from weir.plans.registry import query, table
from weir.sources import sinks, tables
from weir.streaming.bursts import session_bursts

PATHS = ["/raw/alpha/a.pcap", "/raw/beta/b.pcapng", "/raw/x/c.csv.zip", "/raw/alpha/d.csv.gz", "/raw/x/conn.log.gz", "/raw/x/e.parquet", "/raw/beta/f.tar.gz", "/raw/x/readme", "/raw/x/conn.log.labeled", "/raw/x/a.TAR", "/raw/x/notes.txt", "/raw/x/.hidden", "/raw/x/k.tgz", "/raw/x/s.log.bz2"]
_PATHS = "(VALUES " + ", ".join(f"({i}, '{p}')" for i, p in enumerate(PATHS)) + ") AS t(i, p)"


@query("sc01_read_table", "SELECT r_regionkey, r_name FROM region")
def sc01(spark, d):
    return tables.read_table(spark, f"{d}/region.parquet")


@query("sc06_sc07_pruned_scan", "SELECT o_orderkey, o_orderstatus FROM orders")
def sc06(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_orderstatus")


@query("sc08_typed_headers", "SELECT * FROM (VALUES ('uint32 BYTES', 'bytes'), ('time TIME_FIRST', 'time_first'), ('LABEL', 'label'), ('', '')) AS t(header, name)")
def sc08(spark, d):
    return spark.createDataFrame([(h, shaping.type_name(h)) for h in ("uint32 BYTES", "time TIME_FIRST", "LABEL", "")], "header string, name string")


@query("sc09_sc10_sc25_listing")
def sc09(spark, d):
    files = tables.list_files(spark, d, "*.parquet")
    return tables.complete_captures(files, files.filter("path like '%.aria2'"))


@query("sc15_sc16_manifest")
def sc15(spark, d):
    return tables.file_manifest(spark, d, ["testdata"], {"testdata": "synthetic"})


_NAME = "lower(regexp_extract(p, '[^/]*$'))"


@query("sc17_sc18_file_types", f"""
SELECT i, CASE WHEN regexp_matches({_NAME}, '\\.(pcap|pcapng|cap)$') THEN 'pcap' WHEN regexp_matches({_NAME}, '\\.csv(\\.gz|\\.zip)?$') THEN 'csv' WHEN regexp_matches({_NAME}, '\\.(parquet|pq)$') THEN 'parquet' WHEN regexp_matches({_NAME}, '\\.(log|log\\.gz|labeled)$') THEN 'zeek_log'
 WHEN regexp_matches({_NAME}, '\\.(zip|tgz|tar\\.gz|7z)$') THEN 'archive' ELSE coalesce(nullif(regexp_extract({_NAME}, '[^.]\\.([^.]+)$', 1), ''), 'unknown') END AS kind, CASE WHEN string_split(p, '/')[3] IN ('alpha', 'beta') THEN string_split(p, '/')[3] ELSE 'unknown' END AS source FROM {_PATHS}""")
def sc17(spark, d):
    t = spark.createDataFrame([*enumerate(PATHS)], "i int, p string")
    return t.select("i", tables.file_type(F.col("p")).alias("kind"), tables.source_for(F.col("p"), ["alpha", "beta"]).alias("source"))


@query("sc20_flags", "SELECT p_partkey, CASE WHEN p_size = 1 THEN 'yes' ELSE 'no' END AS encrypted FROM part")
def sc20(spark, d):
    return table(spark, d, "part").select("p_partkey", tables.encrypted_flag(F.col("p_size").cast("string")).alias("encrypted"))


@query("sk02_scalar_columns", "SELECT vec_id, label FROM embeddings")
def sk02(spark, d):
    e = table(spark, d, "embeddings")
    return e.select(*sinks.scalar_columns(e))


@query("sk06_provenance", "SELECT doc_id AS sample_id, (n_chars % 2)::BIGINT AS label, source, " + ", ".join(f"NULL::VARCHAR AS {c}" for c in sinks.PROVENANCE if c != "source") + " FROM documents")
def sk06(spark, d):
    return sinks.provenance(table(spark, d, "documents").select(F.col("doc_id").alias("sample_id"), (F.col("n_chars") % 2).alias("label"), "source"))


@query("sk13_pf15_pf16_ablation_table", "SELECT l_orderkey, l_linestatus, l_quantity, l_tax FROM lineitem")
def sk13(spark, d):
    return sinks.ablation_table(table(spark, d, "lineitem"), "l_orderkey", "l_linestatus", [c for c in ("l_quantity", "l_tax", "l_shipdate", "absent") if c != "l_shipdate"])


def _schema() -> T.StructType:
    field = lambda n, t, pad, group="flow", model=True: T.StructField(n, t, True, {"padding": pad, "group": group, "model": model})
    return T.StructType([field("doc_id", T.LongType(), 0, "provenance", False), field("n_chars", T.LongType(), 0), field("has_tls", T.ByteType(), 0, "tls"), field("tls_source", T.StringType(), "none", "tls"), field("pkt_len", T.ArrayType(T.IntegerType()), None, "sequence")])


@query("pf02_normalize", "SELECT doc_id, n_chars, 0::TINYINT AS has_tls, 'none' AS tls_source, 0::INTEGER AS n_packets FROM documents")
def pf02(spark, d):
    out = shaping.normalize(table(spark, d, "documents"), _schema())
    return out.select("doc_id", "n_chars", "has_tls", "tls_source", F.size("pkt_len").alias("n_packets"))


@query("pf14_jn13_features", "SELECT * FROM (VALUES ('n_chars'), ('has_tls'), ('tls_source')) AS t(name)")
def pf14(spark, d):
    return spark.createDataFrame([(c,) for c in shaping.features(_schema())], "name string")


@query("pf15_pf16_feature_sets", "SELECT * FROM (VALUES ('flow_only', 'n_chars'), ('flow_timing', 'n_chars'), ('flow_tls', 'n_chars'), ('flow_tls', 'has_tls'), ('flow_tls', 'tls_source'), ('flow_timing_tls', 'n_chars'), ('flow_timing_tls', 'has_tls'), ('flow_timing_tls', 'tls_source')) AS t(name, feature)")
def pf15(spark, d):
    late = T.StructField("time_last", T.DoubleType(), True, {"padding": 0.0, "group": "timing", "model": True})
    sets = shaping.feature_sets(T.StructType([*_schema().fields, late]))
    return spark.createDataFrame([(k, c) for k, v in sets.items() for c in v], "name string, feature string")


@query("dq01_dq04_so05_so06_schema_gate", "SELECT * FROM (VALUES ('extra', 'lang'), ('extra', 'source'), ('extra', 'text'), ('forbidden', 'text'), ('missing', 'has_tls'), ('missing', 'pkt_len'), ('missing', 'tls_source')) AS t(kind, name)")
def dq01(spark, d):
    docs = table(spark, d, "documents")
    found = quality.schema_differences(docs, _schema()) | {"forbidden": quality.forbidden(docs, {"TEXT", "src_ip"})}
    return spark.createDataFrame([(k, v) for k in ("missing", "extra", "forbidden") for v in found[k]], "kind string, name string")


@query("dq07_gate_messages")
def dq07(spark, d):
    docs = table(spark, d, "documents").withColumn("label", (F.col("n_chars") % 2))
    found = quality.gate(docs, _schema(), "doc_id", "label", {"empty": F.col("n_chars") <= 0}, {"text"})
    return spark.createDataFrame([(m,) for m in found], "message string")


#: Four feature sets.
_SETS = {"chars": ["n_chars"], "lines": ["n_chars", "n_lines"], "words": ["n_chars", "n_words"], "all": ["n_chars", "n_words", "n_lines", "has_lines"]}


@query("ml03_leave_one_source_out")
def ml03(spark, d):
    """Held-out metrics for each source and four feature sets."""
    return models.leave_one_out(_rows(spark, d), "lang", _SETS | {"none": []}, "label")


@query("ml02_ml04_ml05_ablations")
def ml04(spark, d):
    """Four feature sets on a stratified fifth (ML02), each with and without lines (ML04; "with" is ML02's own run), and three exposures of padded columns on a held-out source (ML05)."""
    rows = _rows(spark, d)
    without = {f"{k}_without": [c for c in v if c not in ("n_lines", "has_lines")] for k, v in _SETS.items()}
    split = splits.stratified_split(rows, "doc_id", "label")
    inside = models.ablation(split, F.col("split") == "train", _SETS | without, "label")
    padded = {"no_lines": ["n_chars", "n_words"], "plus_has_lines": ["n_chars", "n_words", "has_lines"], "lines_full": ["n_chars", "n_words", "has_lines", "n_lines"]}
    held = models.ablation(rows, F.col("lang") != "en", padded, "label")
    return inside.withColumn("heldout_source", F.lit("none")).unionByName(held.withColumn("heldout_source", F.lit("en")))


def _rows(spark, d):
    lines = F.size(F.split("text", "\n"))
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars", lines.alias("n_lines"), F.size(F.split("text", " ")).alias("n_words"), (lines > 1).cast("int").alias("has_lines"))
    return docs.join(table(spark, d, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")


@query("streaming_session_bursts", """
WITH o AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 1 HOUR THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
r AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM o)
SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS packets FROM r GROUP BY user_id, run""")
def streaming(spark, d):
    e = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return session_bursts(e, "user_id", "ts", "1 hour").select("user_id", F.unix_micros("start").alias("start_us"), "packets")
