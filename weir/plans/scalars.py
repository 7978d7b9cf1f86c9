"""Queries of the scalar functions, over dirty values in line and over table columns."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.functions import scalars as fn
from weir.functions import sequences as seq
from weir.operators import quality, shaping
from weir.plans.registry import query, table

KEY = "weir-demonstration-salt"
BLANKS = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || ' ' || chr(133) || chr(160) || chr(8195) || chr(8232) || chr(12288)"
DIRTY = ["\t-\n", "\u00a0 NULL\t", "\t9.5\n", "\u2003host\u3000", "1_000", "1d", "0x10", "+7.", "", " - ", "-", "Unknown", "nan", "NaN", None, "inf", "-inf", "12.7", "1e3", " 5 ", "abc", "-3.9", "0", "None", "null", "9007199254740991", "example.com"]


def _text(v: str) -> str:
    """A SQL text, with characters beyond plain ones by number."""
    parts = re.findall(r"[ -~]+|.", v, re.DOTALL)
    return " || ".join("'" + p.replace("'", "''") + "'" if " " <= p[0] <= "~" else f"chr({ord(p)})" for p in parts) or "''"


_VALUES = "(VALUES " + ", ".join(f"({i}, {'NULL' if v is None else _text(v)})" for i, v in enumerate(DIRTY)) + ") AS t(i, v)"


def _inline(spark: SparkSession, rows: list, schema: str = "i int, v string") -> DataFrame:
    return spark.createDataFrame([(i, *r) if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)], schema)


def _values(rows: list) -> str:
    show = lambda v: "NULL" if v is None else _text(v) if isinstance(v, str) else str(v)
    width = 1 + (len(rows[0]) if isinstance(rows[0], tuple) else 1)
    names = ", ".join(["i", "v", "w", "x", "y", "z"][:width])
    return "(VALUES " + ", ".join("(" + ", ".join([str(i), *map(show, r if isinstance(r, tuple) else (r,))]) + ")" for i, r in enumerate(rows)) + f") AS t({names})"


def _hex_bytes(key: str, pad: int) -> str:
    return "".join(f"\\x{b ^ pad:02X}" for b in key.encode().ljust(64, b"\0"))


def hmac_sql(v: str, key: str = KEY) -> str:
    """DuckDB SQL of ``keyed_hash64`` of a text expression."""
    digest = f"sha256('{_hex_bytes(key, 0x5C)}'::BLOB || unhex(sha256('{_hex_bytes(key, 0x36)}'::BLOB || encode(trim({v}, {BLANKS})))))"
    missing = f"({v} IS NULL OR lower(trim({v}, {BLANKS})) IN ('', '-', 'nan', 'none', 'null', 'unknown'))"
    return f"CASE WHEN {missing} THEN 0::BIGINT ELSE (('0x' || substr({digest}, 1, 16))::UBIGINT & 9223372036854775807::UBIGINT)::BIGINT END"


_NUMBER = "CASE WHEN regexp_full_match(regexp_replace({0}, '([0-9])_([0-9])', '\\1\\2', 'g'), '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN try_cast(regexp_replace({0}, '([0-9])_([0-9])', '\\1\\2', 'g') AS DOUBLE) END"
_CLEAN = _NUMBER.format(f"trim(v, {BLANKS})")
_FLOAT = "CASE WHEN {0} IS NULL OR isnan({0}) OR isinf({0}) THEN 0.0::DOUBLE ELSE {0} END"


@query("fn01_keyed_hash64", f"SELECT c_custkey, {hmac_sql('c_name')} AS h FROM customer UNION ALL SELECT -i - 1, {hmac_sql('v')} FROM {_VALUES}")
def fn01(spark, d):
    names = table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("v"))
    dirty = _inline(spark, DIRTY).select((-F.col("i") - 1).cast("long").alias("c_custkey"), "v")
    return names.union(dirty).select("c_custkey", fn.keyed_hash64(F.col("v"), KEY).alias("h"))


@query("fn02_sample_id", "SELECT o_orderkey, sha256(concat_ws('|', o_orderkey::VARCHAR, o_orderstatus, coalesce(nullif(o_orderpriority, '1-URGENT'), ''), printf('%.6f', epoch_us(o_orderdate) / 1e6))) AS sample_id FROM orders")
def fn02(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", fn.sample_id(F.col("o_orderkey"), F.col("o_orderstatus"), F.expr("nullif(o_orderpriority, '1-URGENT')"), fn.six_decimals(fn.epoch_seconds(F.col("o_orderdate")))).alias("sample_id"))


@query("fn03_float_or_zero", f"SELECT i, {_FLOAT.format('(' + _CLEAN + ')')} AS x FROM {_VALUES}")
def fn03(spark, d):
    return _inline(spark, DIRTY).select("i", fn.float_or_zero(F.col("v")).alias("x"))


@query("fn04_int_or_zero", f"SELECT i, trunc({_FLOAT.format('(' + _CLEAN + ')')})::BIGINT AS x FROM {_VALUES}")
def fn04(spark, d):
    return _inline(spark, DIRTY).select("i", fn.int_or_zero(F.col("v")).alias("x"))


BOOLS = ["1", "true", "T", " yes ", "Y", "established", "0", "false", "no", "", None, "2", "ESTABLISHED"]


@query("fn05_bool_id", f"SELECT i, CASE WHEN lower(trim(v)) IN ('1','true','t','yes','y','established') THEN 1 ELSE 0 END::INTEGER AS x FROM {_values(BOOLS)}")
def fn05(spark, d):
    return _inline(spark, BOOLS).select("i", fn.bool_id(F.col("v")).alias("x"))


SEQUENCES = ["nan", "None", " null ", "1 2|3", "[1 | 2]", "1,,2", "\t(8|9)\n", "['4', 'y']", "[1, 2, 3]", "1|2|3", "(4;5 6)", "", None, "[]", "[1.5,-2,x]", "[100|200|300]", "7"]


_ITEM = _NUMBER.format(f"trim(p, {BLANKS})")


@query("fn06_parse_sequence", f"""
WITH s AS (SELECT i, trim(v, {BLANKS}) AS v FROM {_values(SEQUENCES)} WHERE v IS NOT NULL AND lower(trim(v, {BLANKS})) NOT IN ('', 'nan', 'none', 'null', '[]')),
b AS (SELECT i, trim(v, '[]()') AS v FROM s),
l AS (SELECT i, list_filter(CASE WHEN contains(v, '|') THEN string_split(v, '|') ELSE list_transform(regexp_split_to_array(v, '[\\s,;]+'), lambda q: trim(q, '''')) END, lambda q: q <> '') AS parts FROM b)
SELECT i, pos::INTEGER AS pos, {_FLOAT.format("(" + _ITEM + ")")} AS x FROM (SELECT i, unnest(parts) AS p, unnest(range(len(parts))) AS pos FROM l)""")
def fn06(spark, d):
    return _inline(spark, SEQUENCES).select("i", F.posexplode(fn.parse_sequence(F.col("v"))).alias("pos", "x"))


@query("fn07_string_entropy", """
WITH c AS (SELECT p_partkey, ch, count(*) AS k, length(p_name) AS n FROM (SELECT p_partkey, p_name, unnest(string_split(p_name, '')) AS ch FROM part) GROUP BY ALL)
SELECT p_partkey, round(sum(-(k / n::DOUBLE) * log2(k / n::DOUBLE)), 6) AS bits FROM c GROUP BY p_partkey""")
def fn07(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(fn.string_entropy(F.col("p_name")), 6).alias("bits"))


@query("fn08_fn09_host_labels", """
WITH h AS (SELECT page_id, coalesce(regexp_extract(url, '^[a-z]+://([^/:]+)', 1), '') AS host FROM pages)
SELECT page_id, CASE WHEN contains(lower(trim(trim(host), '.')), '.') THEN string_split(lower(trim(trim(host), '.')), '.')[-1] ELSE '' END AS tld,
 length(host)::INTEGER AS host_len, len(list_filter(string_split(host, '.'), lambda x: x <> ''))::INTEGER AS labels FROM h""")
def fn08(spark, d):
    host = F.coalesce(F.regexp_extract("url", "^[a-z]+://([^/:]+)", 1), F.lit(""))
    h = table(spark, d, "pages").select("page_id", host.alias("host"))
    return h.select("page_id", fn.last_label(F.col("host")).alias("tld"), F.length("host").alias("host_len"), fn.label_count(F.col("host")).alias("labels"))


VERSIONS = ["SSLv3", "TLSv10", "TLSv11", "TLSv12", "TLSv13", "tlsv12", "", None, "TLSv14"]


@query("fn10_fn11_tls_version", f"""
SELECT i, CASE v WHEN 'SSLv3' THEN 1 WHEN 'TLSv10' THEN 2 WHEN 'TLSv11' THEN 3 WHEN 'TLSv12' THEN 4 WHEN 'TLSv13' THEN 5 ELSE 0 END::INTEGER AS id,
 CASE WHEN v IN ('SSLv3','TLSv10','TLSv11','TLSv12','TLSv13') THEN 1 ELSE 0 END::INTEGER AS tls_full, CASE WHEN v IN ('SSLv3','TLSv10','TLSv11','TLSv12','TLSv13') THEN 'log' ELSE 'none' END AS tls_source FROM {_values(VERSIONS)}""")
def fn10(spark, d):
    t = _inline(spark, VERSIONS).withColumn("id", fn.tls_version_id(F.col("v")))
    return t.select("i", "id", (F.col("id") > 0).cast("int").alias("tls_full"), F.when(F.col("id") > 0, "log").otherwise("none").alias("tls_source"))


CERTS = [
    ("2020-01-01 00:00:00", "2021-01-01 00:00:00", "CN=a", "CN=a", "a.com,b.com"), ("1577836800", "1609459200", "CN=a", "CN=b", "-"), ("x", "", "-", "-", "(empty)"), (None, None, None, None, None),
    ("", "2021-01-01 00:00:00", "unknown", "unknown", "a.com  b.com,,c.com"), ("2020-01-01", None, "", "", "-,a.com"), ("2021-01-01 00:00:00", "2020-01-01 00:00:00", "CN=a", "", "a.com"),
]
_STAMP = "coalesce(try_cast({0} AS DOUBLE), epoch_us(try_cast({0} AS TIMESTAMP)) / 1e6, 0.0)"


@query("fn12_certificate_facts", f"""
SELECT i, CASE WHEN v <> '' AND w <> '' THEN greatest(({_STAMP.format("w")} - {_STAMP.format("v")}) / 86400, 0.0) ELSE 0.0 END::DOUBLE AS validity_days, CASE WHEN x = y AND x <> '' THEN 1 ELSE 0 END::INTEGER AS self_signed,
 len(list_filter(regexp_split_to_array(coalesce(z, ''), '[, ]+'), lambda q: q NOT IN ('', '-', '(empty)')))::INTEGER AS san_count, len(list_filter(regexp_split_to_array(coalesce(z, ''), '[, ]+'), lambda q: q NOT IN ('', '-', '(empty)')))::INTEGER AS chain_len,
 CASE WHEN v = '1577836800' THEN 1577836800 ELSE 0 END::BIGINT AS key_length, {hmac_sql("x")} AS subject_hash64, {hmac_sql("y")} AS issuer_hash64 FROM {_values(CERTS)}""")
def fn12(spark, d):
    t = _inline(spark, CERTS, "i int, v string, w string, x string, y string, z string")
    facts = fn.certificate_facts(F.col("v"), F.col("w"), F.col("x"), F.col("y"), F.col("z"), chain=F.col("z"), key_length=F.col("v"), key=KEY)
    return t.select("i", *[c.alias(k) for k, c in facts.items()])


VECTORS = ["a\tb,\tc", "\t-\n", "a,b c", "-", "(empty)", "", None, "x,-,y", "F1,F2,F3"]


@query("fn13_parse_vector", f"""
SELECT i, pos::INTEGER AS pos, item FROM (SELECT i, unnest(parts) AS item, unnest(range(len(parts))) AS pos FROM (
 SELECT i, list_filter(regexp_split_to_array(trim(v, {BLANKS}), '[, \\t]+'), lambda q: q NOT IN ('', '-')) AS parts FROM {_values(VECTORS)} WHERE v IS NOT NULL AND trim(v, {BLANKS}) NOT IN ('-', '(empty)', '')))""")
def fn13(spark, d):
    return _inline(spark, VECTORS).select("i", F.posexplode(fn.parse_vector(F.col("v"))).alias("pos", "item"))


TIMES = ["2024-03-01T12:00:00Z", "2024-03-01 12:00:00.5", "1700000000.25", "x", "", None, "2024-03-01T12:00:00"]


@query("fn14_fn15_timestamp_or_zero", f"SELECT i, round(coalesce(try_cast(v AS DOUBLE), epoch_us(try_cast(replace(v, 'Z', '') AS TIMESTAMP)) / 1e6, 0.0), 6)::DOUBLE AS seconds FROM {_values(TIMES)}")
def fn15(spark, d):
    return _inline(spark, TIMES).select("i", F.round(fn.timestamp_or_zero(F.col("v")), 6).alias("seconds"))


# a clock counts only at the start of the text or right after its T; what has none counts as a time, and so do its seconds since 1970
CLOCKS = ["23:59:59.5", "2024-03-01T00:00:00.5", "12:30:00", "x", None, "2024-03-01 12:30:00", " 06:07:08Z ", "2024-03-01T23:00:01.25Z", "T01:02:03", "12-30-45", "1:02:03", "2024-03-01", "90061"]
_CLOCK = f"CASE WHEN contains(v, 'T') THEN regexp_replace(trim(v, {BLANKS}), '^[^T]*T', '') ELSE trim(v, {BLANKS}) END"


@query("fn16_fn17_seconds_of_day", f"""
SELECT i, coalesce(CASE WHEN regexp_matches(c, '^\\d\\d.\\d\\d.\\d\\d') THEN substr(c, 1, 2)::DOUBLE * 3600 + substr(c, 4, 2)::DOUBLE * 60 + substr(c, 7, 2)::DOUBLE + coalesce(try_cast('0' || nullif(regexp_extract(c, '^.{{8}}(\\.\\d+)', 1), '') AS DOUBLE), 0) END,
 try_cast(v AS DOUBLE), epoch_us(CASE WHEN regexp_matches(v, '^\\d{{4}}-') THEN try_cast(v AS TIMESTAMP) END) / 1e6, 0.0)::DOUBLE AS seconds FROM (SELECT i, v, {_CLOCK} AS c FROM {_values(CLOCKS)})""")
def fn17(spark, d):
    return _inline(spark, CLOCKS).select("i", fn.seconds_of_day(F.col("v")).alias("seconds"))


@query("fn18_gaps_of_day", "SELECT i::INTEGER AS i, pos::INTEGER AS pos, gap::DOUBLE AS gap FROM (VALUES (0, 0, 0.0), (0, 1, 1.0), (0, 2, 0.5), (0, 3, 0.0), (1, 0, 0.0), (1, 1, 0.0), (1, 2, 0.0), (1, 3, 0.0)) AS t(i, pos, gap)")
def fn18(spark, d):
    t = spark.createDataFrame([(0, ["23:59:59.5", "00:00:00.5", "00:00:01"]), (1, [])], "i int, v array<string>")
    return t.select("i", F.posexplode(fn.gaps_of_day(F.col("v"), F.lit(4))).alias("pos", "gap"))


TIME_LISTS = ["2024-03-01T00:00:00Z|2024-03-01T00:00:01.5Z|x", "[1700000000|5]", "nan", "", None, "(2024-03-01 12:00:00||7)"]


@query("fn16_time_sequence", f"""
SELECT i, (unnest(range(len(p))))::INTEGER AS pos, round(unnest(list_transform(p, lambda q: coalesce(try_cast(q AS DOUBLE), epoch_us(try_cast(replace(q, 'Z', '') AS TIMESTAMP)) / 1e6, 0.0))), 6)::DOUBLE AS seconds FROM (
 SELECT i, list_filter(string_split(trim(v, '[]()'), '|'), lambda q: q <> '') AS p FROM {_values(TIME_LISTS)} WHERE v IS NOT NULL AND v NOT IN ('', 'nan'))""")
def fn16(spark, d):
    return _inline(spark, TIME_LISTS).select("i", F.posexplode(fn.time_sequence(F.col("v"))).alias("pos", "seconds")).withColumn("seconds", F.round("seconds", 6))


GAP_LISTS = ["23:59:58|00:00:01.5|00:00:01.25", "[10:00:00|10:00:00.25|10:00:04|11:00:00|11:00:01]", "none", None, "", "05:00:00"]


@query("fn18_gap_sequence", f"""
WITH p AS (SELECT i, unnest(range(len(parts))) AS pos, unnest(parts) AS c FROM (SELECT i, list_filter(string_split(trim(v, '[]()'), '|'), lambda q: q <> '') AS parts FROM {_values(GAP_LISTS)} WHERE v IS NOT NULL AND v NOT IN ('', 'none'))),
t AS (SELECT i, pos, substr(c, 1, 2)::DOUBLE * 3600 + substr(c, 4, 2)::DOUBLE * 60 + substr(c, 7)::DOUBLE AS s FROM p),
g AS (SELECT i, pos, s - lag(s) OVER (PARTITION BY i ORDER BY pos) AS g FROM t)
SELECT x.i, r.pos::INTEGER AS pos, coalesce(CASE WHEN g < 0 THEN g + 86400 ELSE g END, 0.0)::DOUBLE AS gap FROM {_values(GAP_LISTS).replace("AS t(", "AS x(")} CROSS JOIN range(4) AS r(pos) LEFT JOIN g ON g.i = x.i AND g.pos = r.pos""")
def fn18_text(spark, d):
    return _inline(spark, GAP_LISTS).select("i", F.posexplode(fn.gap_sequence(F.col("v"), F.lit(4))).alias("pos", "gap"))


@query("fn02_row_id", "SELECT o_orderkey, sha256(concat_ws('|', 'mining_dataset_v1', 'orders', '', o_orderkey::VARCHAR, 'tcp', '0', o_custkey::VARCHAR, '443', '', printf('%.6f', epoch_us(o_orderdate) / 1e6), '0.000000', '1')) AS sample_id FROM orders")
def fn02_row(spark, d):
    o = table(spark, d, "orders")
    parts = {"source": F.lit("orders"), "source_record_id": F.col("o_orderkey"), "proto": F.lit("tcp"), "src_ip_hash64": F.lit(0), "dst_ip_hash64": F.col("o_custkey"), "src_port": F.lit(443), "time_first": fn.epoch_seconds(F.col("o_orderdate")), "label": F.lit(1)}
    return o.select("o_orderkey", fn.row_id(parts).alias("sample_id"))


PATHS = ["/a/b/cap_01.pcap", "cap_02.pcap.gz", "/x/.hidden", "/x/plain", "/y/two.dots.csv", "/y/end."]


@query("pf13_stem_membership", f"SELECT i FROM {_values(PATHS)} WHERE regexp_replace(regexp_extract(v, '[^/]*$'), '([^.])\\.[^.]+$', '\\1') IN ('cap_01', 'cap_02.pcap', '.hidden', 'end.')")
def pf13(spark, d):
    stems = spark.createDataFrame([("cap_01",), ("cap_02.pcap",), (".hidden",), ("end.",), ("other",)], "stem string")
    return shaping.stem_among(F.col("v"), stems, _inline(spark, PATHS)).select("i")


@query("fn19_fn20_signed_lengths", "SELECT i::INTEGER AS i, pos::INTEGER AS pos, x::INTEGER AS x FROM (VALUES (0, 0, 100), (0, 1, -200), (1, 0, 7), (1, 1, 8), (1, 2, 9)) AS t(i, pos, x)")
def fn19(spark, d):
    t = spark.createDataFrame([(0, [100, 200, 300], [1, -1]), (1, [7, 8, 9], None)], "i int, n array<int>, s array<int>")
    s = F.when(F.col("s").isNull(), fn.signed_lengths(F.col("n"))).otherwise(fn.signed_lengths(F.col("n"), F.col("s")))
    return t.select("i", F.posexplode(s).alias("pos", "x"))


@query("fn30_exact_quantile", "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.1), 6) AS p10, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50, round(quantile_cont(l_extendedprice, 0.99), 6) AS p99 FROM lineitem GROUP BY 1")
def fn30(spark, d):
    out = quality.quantiles(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", (0.1, 0.5, 0.99))
    return out.select("l_returnflag", *[F.round(f"q{n[1:]}", 6).alias(n) for n in ("p10", "p50", "p99")])


@query("fn32_fn33_fingerprint_split", """
WITH f AS (SELECT p_partkey, sha256(concat_ws(chr(31), 'p_brand=' || p_brand, 'p_size=' || p_size, 'p_type=' || p_type)) AS fp FROM part)
SELECT p_partkey, fp, CASE WHEN ('0x' || substr(fp, 1, 12))::UBIGINT / 281474976710656.0 < 0.7 THEN 'train' WHEN ('0x' || substr(fp, 1, 12))::UBIGINT / 281474976710656.0 < 0.85 THEN 'validation' ELSE 'test' END AS split FROM f""")
def fn32(spark, d):
    p = table(spark, d, "part").withColumn("fp", fn.fingerprint({k: F.col(k) for k in ("p_brand", "p_size", "p_type")}))
    return p.select("p_partkey", "fp", fn.split_bucket(F.col("fp")).alias("split"))


@query("fn31_canonical_value", "SELECT l_orderkey, l_linenumber, printf('%.6g', l_extendedprice::DOUBLE) AS l_extendedprice_text, printf('%.6g', l_discount::DOUBLE) AS l_discount_text, l_returnflag AS l_returnflag_text, l_linenumber::VARCHAR AS l_linenumber_text FROM lineitem")
def fn31(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").cast("double").alias("l_extendedprice"), F.col("l_discount").cast("double").alias("l_discount"), "l_returnflag")
    return shaping.canonical_values(li, ["l_extendedprice", "l_discount", "l_returnflag", "l_linenumber"]).drop("l_extendedprice", "l_discount", "l_returnflag")


@query("fn34_file_group_id", "SELECT DISTINCT lang, source, substr(sha256(encode(lang) || '\\x00'::BLOB || encode(source)), 1, 16) AS gid FROM documents")
def fn34(spark, d):
    return table(spark, d, "documents").select("lang", "source").distinct().withColumn("gid", fn.file_group_id(F.col("lang"), F.col("source")))


@query("fn37_now", "SELECT true AS is_utc_second")
def fn37(spark, d):
    """The library's time text, read back: within the hour of the session's clock, and in its fixed form."""
    now = fn.now_iso()
    near = F.abs(fn.timestamp_or_zero(now) - F.unix_timestamp(F.current_timestamp())) < 3600
    return spark.range(1).select((near & now.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\+00:00$")).alias("is_utc_second"))


@query("sc21_is_one", f"SELECT i, coalesce(trim(v) IN ('1', '1.0', 'true', 'True', 'TRUE'), false) AS x FROM {_values(BOOLS)}")
def sc21(spark, d):
    return _inline(spark, BOOLS).select("i", fn.is_one(F.col("v")).alias("x"))


@query("pf01_first_present", f"SELECT i, coalesce(nullif(trim(v), ''), NULL) AS x FROM (SELECT i, CASE WHEN v IS NOT NULL AND trim(v) <> '' THEN v ELSE 'other' END AS v FROM {_values(BOOLS)})")
def pf01(spark, d):
    t = _inline(spark, BOOLS).select("i", F.col("v").alias("Value"), F.lit("other").alias("alias"))
    return t.select("i", F.trim(fn.first_present(*shaping.columns_named(t, ["value", "missing", "ALIAS"]))).alias("x"))


@query("pf21_endpoint_key", """
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN a < b OR (a = b AND l_linenumber <= l_suppkey) THEN a || ':' || l_linenumber || '-' || b || ':' || l_suppkey ELSE b || ':' || l_suppkey || '-' || a || ':' || l_linenumber END || '-' || lower(l_returnflag) AS k
FROM (SELECT *, '10.0.0.' || (l_partkey % 250) AS a, '10.0.0.' || (l_suppkey % 250) AS b FROM lineitem)""")
def pf21(spark, d):
    li = table(spark, d, "lineitem")
    a, b = (F.concat(F.lit("10.0.0."), (F.col(c) % 250).cast("string")) for c in ("l_partkey", "l_suppkey"))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", fn.endpoint_key(a, F.col("l_linenumber"), b, F.col("l_suppkey"), F.col("l_returnflag")).alias("k"))


@query("fn21_fn29_sequence_examples")
def fn21(spark, d):
    """Worked examples of the sequence features, held against numpy in the tests."""
    t = spark.createDataFrame([(0, [60, 1500, 40, 900], [1, -1, -1, 1], [0.0, 0.35, 2.5, 0.004]), (1, [], [], []), (2, [5], [1], [0.0]), (3, [1, 2, 3, 4, 5], [1, 1, -1, 1, -1], [5.0, 0.1, 1.0, 1.01, 0.2]), (4, [9, 9, 9, 9], [1, 1, 1, 1], [2.0, 2.0, 2.0, 2.0])], "i int, n array<int>, s array<int>, g array<double>")
    feats = seq.sequence_features(F.col("n"), F.col("s"), F.col("g"))
    return t.select("i", *[c.alias(k) for k, c in feats.items()])
