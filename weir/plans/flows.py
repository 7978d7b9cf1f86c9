"""Queries of flow assembly, joins and shaping. A user's events stand for a flow's packets."""

from __future__ import annotations

from pyspark.sql import functions as F

from weir.functions import scalars as fn
from weir.operators import flows, joins, shaping
from weir.plans.registry import query, table

_GAP = 3600.0


def _packets(spark, d):
    e = table(spark, d, "events")
    return e.select("user_id", "event_id", "event_type", fn.epoch_seconds(F.col("ts")).alias("t"), F.round(F.col("value") * 100).cast("long").alias("n"))


def _flows(spark, d):
    return flows.assemble(_packets(spark, d), ["user_id"], F.col("t"), F.col("event_id"), F.col("n"), F.col("event_type"))


_PACKETS = """
p AS (SELECT user_id, event_id, event_type, epoch_us(ts) / 1e6 AS t, round(value * 100)::BIGINT AS n FROM events),
o AS (SELECT *, row_number() OVER w AS i, first_value(event_type) OVER w AS e0, greatest(coalesce(t - lag(t) OVER w, 0.0), 0.0) AS iat FROM p WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
f AS (SELECT user_id, i, t, n, abs(n)::DOUBLE AS len, CASE WHEN event_type = e0 THEN 1 ELSE -1 END AS dir, iat FROM o WHERE i <= 256)"""


@query("wn_fn_flow_features", f"""
WITH {_PACKETS},
b AS (SELECT user_id, i, len, dir, iat, sum(CASE WHEN i > 1 AND iat > {_GAP} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY i) AS run FROM f),
r AS (SELECT user_id, count(*) AS k, avg(c) AS m, max(c) AS x FROM (SELECT user_id, run, count(*) AS c FROM b GROUP BY ALL) GROUP BY 1),
a AS (SELECT user_id, min(t) AS time_first, max(t) AS time_last, count(*) AS packet_count FROM o GROUP BY 1)
SELECT a.user_id, round(a.time_first, 3) AS time_first, round(a.time_last - a.time_first, 3) AS duration, a.packet_count,
 round(avg(len), 4) AS pkt_len_mean, round(stddev_pop(len), 4) AS pkt_len_std, round(quantile_cont(len, 0.5), 4) AS pkt_len_p50, round(quantile_cont(len, 0.9), 4) AS pkt_len_p90,
 round(avg(iat), 4) AS iat_mean, round(CASE WHEN avg(iat) > 0 THEN stddev_pop(iat) / avg(iat) ELSE 0 END, 6) AS iat_cv, round(avg((iat = 0)::INT), 6) AS iat_zero_ratio,
 round(coalesce(avg(iat) FILTER (dir = 1), 0), 4) AS fwd_iat_mean, round(coalesce(avg(iat) FILTER (dir = -1), 0), 4) AS bwd_iat_mean,
 any_value(r.k)::INTEGER AS burst_count, round(any_value(r.m), 6) AS burst_mean_packets, any_value(r.x)::INTEGER AS burst_max_packets
FROM b JOIN a USING (user_id) JOIN r USING (user_id) GROUP BY a.user_id, a.time_first, a.time_last, a.packet_count""")
def flow_features(spark, d):
    f = flows.with_features(_flows(spark, d), _GAP, 60.0)
    digits = {"pkt_len_mean": 4, "pkt_len_std": 4, "pkt_len_p50": 4, "pkt_len_p90": 4, "iat_mean": 4, "iat_cv": 6, "iat_zero_ratio": 6, "fwd_iat_mean": 4, "bwd_iat_mean": 4}
    return f.select(
        "user_id", F.round("time_first", 3).alias("time_first"), F.round(F.col("time_last") - F.col("time_first"), 3).alias("duration"), "packet_count",
        *[F.round(k, n).alias(k) for k, n in digits.items()], "burst_count", F.round("burst_mean_packets", 6).alias("burst_mean_packets"), "burst_max_packets",
    )


@query("ag01_ag02_wn04_flow_bounds", f"""
WITH {_PACKETS} SELECT user_id, round(min(t), 3) AS time_first, round(max(t), 3) AS time_last, count(*) AS packet_count, least(count(*), 256)::INTEGER AS seq_len FROM o GROUP BY 1""")
def ag01(spark, d):
    return _flows(spark, d).select("user_id", F.round("time_first", 3).alias("time_first"), F.round("time_last", 3).alias("time_last"), "packet_count", "seq_len")


@query("wn01_wn02_wn03_packet_order", f"WITH {_PACKETS} SELECT user_id, (i - 1)::INTEGER AS pos, n AS pkt_len, dir AS pkt_dir, round(iat, 3) AS pkt_iat FROM f")
def wn01(spark, d):
    f = _flows(spark, d).select("user_id", F.posexplode(F.arrays_zip("pkt_len", "pkt_dir", "pkt_iat")).alias("pos", "p"))
    return f.select("user_id", "pos", F.col("p.pkt_len").alias("pkt_len"), F.col("p.pkt_dir").alias("pkt_dir"), F.round("p.pkt_iat", 3).alias("pkt_iat"))


@query("ag03_flag_counts", "SELECT l_orderkey, count(*) FILTER (l_partkey & 2 <> 0) AS syn_count, count(*) FILTER (l_partkey & 16 <> 0) AS ack_count, count(*) FILTER (l_partkey & 8 <> 0) AS psh_count, count(*) FILTER (l_partkey & 4 <> 0) AS rst_count, count(*) FILTER (l_partkey & 1 <> 0) AS fin_count FROM lineitem GROUP BY 1")
def ag03(spark, d):
    return flows.flag_counts(table(spark, d, "lineitem"), ["l_orderkey"], "l_partkey")


@query("fn25_fn28_fn29_periodicity", f"""
WITH {_PACKETS},
s AS (SELECT user_id, count(*) AS cnt, min(iat) AS lo, max(iat) AS hi, avg(iat) AS m FROM f GROUP BY 1),
h AS (SELECT user_id, least(floor((iat - CASE WHEN hi > lo THEN lo ELSE lo - 0.5 END) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END * 10), 9) AS bin, any_value(cnt) AS n, count(*) AS k FROM f JOIN s USING (user_id) GROUP BY 1, 2),
e AS (SELECT user_id, sum(-(k / n::DOUBLE) * log2(k / n::DOUBLE)) AS bits FROM h GROUP BY 1),
y AS (SELECT user_id, i, cnt AS n, iat - m AS y FROM f JOIN s USING (user_id)),
z AS (SELECT user_id, sum(y * y) AS sq FROM y GROUP BY 1),
c AS (SELECT a.user_id, b.i - a.i AS lag, sum(a.y * b.y) AS v FROM y a JOIN y b ON a.user_id = b.user_id AND b.i > a.i AND b.i - a.i <= 64 GROUP BY 1, 2),
g AS (SELECT c.user_id, arg_max(lag, (v / sq, -lag)) AS lag, max(v / sq) AS score FROM c JOIN z USING (user_id) GROUP BY 1),
w AS (SELECT user_id, k, sqrt(pow(sum(y * cos(-2 * pi() * k * (i - 1) / n)), 2) + pow(sum(y * sin(-2 * pi() * k * (i - 1) / n)), 2)) AS v FROM y, range(1, 129) AS r(k) WHERE k <= n // 2 GROUP BY 1, 2),
x AS (SELECT user_id, max(v) AS peak FROM w GROUP BY 1)
SELECT user_id, round(CASE WHEN cnt > 1 THEN bits ELSE 0 END, 5) AS iat_entropy, (CASE WHEN cnt >= 4 AND sq > 0 THEN lag ELSE 0 END)::INTEGER AS lag, round(CASE WHEN cnt >= 4 AND sq > 0 THEN score ELSE 0 END, 5) AS score, round(CASE WHEN cnt >= 4 THEN peak ELSE 0 END, 1) AS fft_peak
FROM s JOIN e USING (user_id) JOIN z USING (user_id) LEFT JOIN g USING (user_id) LEFT JOIN x USING (user_id)""")
def periodicity(spark, d):
    f = flows.with_features(_flows(spark, d), _GAP, 60.0)
    return f.select("user_id", F.round("iat_entropy", 5).alias("iat_entropy"), F.col("periodicity_autocorr_lag").alias("lag"), F.round("periodicity_autocorr_score", 5).alias("score"), F.round("periodicity_fft_peak", 1).alias("fft_peak"))


@query("jn01_last_match_wins", """
WITH r AS (SELECT l_orderkey, l_shipdate, l_partkey, l_suppkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC) AS k FROM lineitem)
SELECT o_orderkey, o_custkey, l_partkey, l_suppkey, l_quantity FROM orders LEFT JOIN (SELECT * FROM r WHERE k = 1) ON o_orderkey = l_orderkey""")
def jn01(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate", "l_partkey", "l_suppkey", "l_quantity")
    return joins.last_match(table(spark, d, "orders").select("o_orderkey", "o_custkey"), li, ["o_orderkey"], ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity"]).drop("l_shipdate")


@query("jn02_first_in_list", """
WITH w AS (SELECT p_partkey, unnest(list_distinct(string_split(p_name, ' '))) AS word FROM part), r AS (SELECT unnest(string_split(p_name, ' ')) AS word, p_partkey AS other, p_size FROM part WHERE p_partkey % 7 = 0),
m AS (SELECT p_partkey, word, other, p_size, row_number() OVER (PARTITION BY p_partkey ORDER BY other, word) AS k FROM (SELECT DISTINCT * FROM w JOIN r USING (word)))
SELECT p.p_partkey, m.other, m.p_size, CASE WHEN m.other IS NULL THEN 0 ELSE 1 END::INTEGER AS observed FROM part p LEFT JOIN (SELECT * FROM m WHERE k = 1) m ON p.p_partkey = m.p_partkey""")
def jn02(spark, d):
    p = table(spark, d, "part")
    right = p.filter("p_partkey % 7 = 0").select(F.explode(F.split("p_name", " ")).alias("word"), F.col("p_partkey").alias("other"), "p_size").distinct()
    left = p.select("p_partkey", F.split("p_name", " ").alias("ids"))
    return joins.first_in_list(left, "ids", "p_partkey", right, "word", ["other", "word"]).select("p_partkey", "other", "p_size", "observed")


@query("jn02_first_in_whole_list", """
WITH w AS (SELECT p_partkey, unnest(list_distinct(string_split(p_name, ' '))) || '/' || (p_size + 1) AS id FROM part), r AS (SELECT unnest(string_split(p_name, ' ')) || '/' || p_size AS id, p_partkey AS other, p_size AS other_size FROM part),
f AS (SELECT id, min(other) AS other, arg_min(other_size, other) AS other_size FROM r GROUP BY id), m AS (SELECT p_partkey, min(other) AS other, arg_min(other_size, other) AS other_size FROM w JOIN f USING (id) GROUP BY p_partkey)
SELECT p.p_partkey, m.other, m.other_size, CASE WHEN m.other IS NULL THEN 0 ELSE 1 END::INTEGER AS observed FROM part p LEFT JOIN m ON p.p_partkey = m.p_partkey""")
def jn02_whole(spark, d):
    """Each part with the first of all parts that has one of its words and is a size larger; the largest sizes' list entries are in no row."""
    p = table(spark, d, "part")
    ids = lambda size: F.transform(F.split("p_name", " "), lambda w: F.concat(w, F.lit("/"), size.cast("string")))
    right = p.select(F.explode(ids(F.col("p_size"))).alias("id"), F.col("p_partkey").alias("other"), F.col("p_size").alias("other_size"))
    left = p.select("p_partkey", ids(F.col("p_size") + 1).alias("ids"))
    return joins.first_in_list(left, "ids", "p_partkey", right, "id", ["other", "id"]).select("p_partkey", "other", "other_size", "observed")


@query("jn03_best_in_tolerance", """
WITH l AS (SELECT o_orderkey, o_custkey, epoch_us(o_orderdate) / 8.64e10 AS s, epoch_us(o_orderdate) / 8.64e10 + 30 AS e, o_orderkey % 7 AS n FROM orders),
r AS (SELECT o_custkey, l_orderkey AS r_id, min(epoch_us(l_shipdate)) / 8.64e10 AS rs, max(epoch_us(l_shipdate)) / 8.64e10 AS re, count(*) AS rn FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
m AS (SELECT o_orderkey, r_id, row_number() OVER (PARTITION BY o_orderkey ORDER BY greatest(least(e, re) - greatest(s, rs), 0) DESC, abs(n - rn), r_id) AS k FROM l JOIN r USING (o_custkey) WHERE abs(s - rs) <= 60 OR abs(e - re) <= 60)
SELECT l.o_orderkey, m.r_id, CASE WHEN m.r_id IS NULL THEN 0 ELSE 1 END::INTEGER AS matched FROM l LEFT JOIN (SELECT * FROM m WHERE k = 1) m USING (o_orderkey)""")
def jn03(spark, d):
    day = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 8.64e10
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    left = o.select("o_orderkey", "o_custkey", day("o_orderdate").alias("start"), (day("o_orderdate") + 30).alias("end"), (F.col("o_orderkey") % 7).alias("n"))
    right = li.join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey", F.col("l_orderkey").alias("r_id")).agg(F.min(day("l_shipdate")).alias("r_start"), F.max(day("l_shipdate")).alias("r_end"), F.count("*").alias("r_packets"))
    return joins.best_in_tolerance(left, right, ["o_custkey"], "o_orderkey", 60.0, F.col("n"), ["r_id"]).select("o_orderkey", "r_id", "matched")


@query("jn04_key_semi_join", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def jn04(spark, d):
    keys = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").join(keys, "o_custkey", "left_semi").select("o_orderkey", "o_totalprice")


@query("jn05_required_match", "SELECT o_orderkey, max(l_quantity) AS q FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def jn05(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_quantity").alias("q"))
    return joins.last_match(table(spark, d, "orders").select("o_orderkey"), li, ["o_orderkey"], ["q"]).filter("q is not null")


@query("jn11_fold_membership", """
WITH s AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS fold FROM (SELECT DISTINCT source FROM documents))
SELECT fold::INTEGER AS fold, s.source AS heldout_source, doc_id, CASE WHEN d.source = s.source THEN 'test' ELSE 'train' END AS split FROM documents d, s""")
def jn11(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", F.lit(0).alias("label"))
    return joins.fold_membership(docs, "doc_id", "source", "label").select("fold", "heldout_source", "doc_id", "split")


@query("jn06_jn07_split_join", """
SELECT doc_id, n_chars, CASE WHEN ('0x' || substr(sha256(doc_id::VARCHAR), 1, 12))::UBIGINT / 281474976710656.0 < 0.7 THEN 'train' WHEN ('0x' || substr(sha256(doc_id::VARCHAR), 1, 12))::UBIGINT / 281474976710656.0 < 0.85 THEN 'validation' ELSE 'test' END AS split
FROM documents JOIN (SELECT DISTINCT doc_id FROM labels) USING (doc_id)""")
def jn06(spark, d):
    members = table(spark, d, "labels").select("doc_id").distinct().withColumn("split", fn.split_bucket(F.sha2(F.col("doc_id").cast("string"), 256)))
    return table(spark, d, "documents").select("doc_id", "n_chars").join(members, "doc_id")


@query("jn12_pairs", "WITH p AS (SELECT DISTINCT o_orderpriority AS p FROM orders) SELECT a.p AS source_a, b.p AS source_b FROM p a JOIN p b ON a.p < b.p")
def jn12(spark, d):
    p = table(spark, d, "orders").select("o_orderpriority").distinct().groupBy().agg(F.array_sort(F.collect_list("o_orderpriority")).alias("s"))
    a = p.select("s", F.posexplode("s").alias("i", "source_a"))
    return a.select("source_a", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("source_b"))


@query("pf03_flow_rates", """
WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS dur, l_extendedprice AS a, floor(l_tax * 1000) AS b, l_quantity AS p, l_discount * 100 AS q FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, round(a + b, 2) AS bytes_total, round((a + b) / greatest(dur, 1e-6) + 1e-7, 1) AS bytes_per_second, round((p + q) / greatest(dur, 1e-6) + 1e-7, 3) AS packets_per_second,
 round(a / greatest(a + b, 1), 6) AS forward_byte_share, round(p / greatest(p + q, 1), 6) AS forward_packet_share, round(100 + greatest(dur, 0), 4) AS time_last FROM f""")
def pf03(spark, d):
    li = table(spark, d, "lineitem")
    r = shaping.flow_rates(F.col("l_quantity"), F.col("l_extendedprice"), F.floor(F.col("l_tax") * 1000).cast("double"), F.col("l_quantity"), F.col("l_discount") * 100, F.lit(100.0))
    digits = {"bytes_total": 2, "bytes_per_second": 1, "packets_per_second": 3, "forward_byte_share": 6, "forward_packet_share": 6, "time_last": 4}
    return li.select("l_orderkey", "l_linenumber", "l_partkey", *[F.round(r[k] + (1e-7 if k.endswith("second") else 0), n).alias(k) for k, n in digits.items()])  # off the ties of rounding


@query("pf04_canonical_rows", """
WITH o AS (SELECT *, 1000.5 + o_custkey AS a, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1500 END AS z FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW'))
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'Miner' ELSE 'Other' END AS original_label, CASE o_orderpriority WHEN '1-URGENT' THEN 1 ELSE 0 END::INTEGER AS label, CASE o_orderkey % 4 WHEN 2 THEN 'udp' ELSE 'tcp' END AS proto,
 a::DOUBLE AS time_first, CASE WHEN z > 0 THEN z ELSE a + 12.5 END::DOUBLE AS time_last, CASE WHEN z > 0 THEN greatest(z - a, 0) ELSE 12.5 END::DOUBLE AS duration FROM o""")
def pf04(spark, d):
    label = F.when(F.col("o_orderpriority") == "1-URGENT", "Miner").when(F.col("o_orderpriority") == "5-LOW", "\tOther ").otherwise("miner")
    proto = F.element_at(F.array(F.lit("6"), F.lit("6.0"), F.lit("UDP"), F.lit(" ")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    last = F.when(F.col("o_orderkey") % 3 == 0, "").otherwise("1970-01-01T00:25:00Z")
    rows = table(spark, d, "orders").select("o_orderkey", label.alias("LABEL"), proto.alias("Protocol"), (F.col("o_custkey") + 1000.5).cast("string").alias("start_time"), last.alias("TIME_LAST"), F.lit("12.5").alias("duration"))
    return shaping.canonical_rows(rows).select("o_orderkey", "original_label", "label", "proto", "time_first", "time_last", "duration")


LABELS = ["Benign", "benign", "C&C", "XMRigMiner", "CoinMining", "", None, "PartOfAHorizontalPortScan", "benign mining"]


@query("pf05_pf08_pf09_labels", """
SELECT i::INTEGER AS i, v, coalesce(trim(v) <> '' AND NOT regexp_matches(lower(v), 'miner|mining|cryptomining|stratum|xmr|monero'), false) AS allowed, CASE WHEN contains(lower(v), 'benign') THEN 'benign' ELSE 'malware/attack' END AS class, coalesce(lower(trim(v)) = 'benign', false) AS is_benign
FROM (VALUES (0,'Benign'),(1,'benign'),(2,'C&C'),(3,'XMRigMiner'),(4,'CoinMining'),(5,''),(6,NULL),(7,'PartOfAHorizontalPortScan'),(8,'benign mining')) AS t(i, v)""")
def pf05(spark, d):
    t = spark.createDataFrame([*enumerate(LABELS)], "i int, v string")
    return t.select("i", "v", shaping.allowed_label(F.col("v")).alias("allowed"), shaping.negative_class(F.col("v")).alias("class"), F.coalesce(shaping.benign(F.col("v"), F.lit("0")), F.lit(False)).alias("is_benign"))


@query("pf06_pf07_tls_ports", "SELECT o_orderkey, 1::INTEGER AS possible_tls_port FROM orders WHERE o_orderkey % 500 IN (443 % 500, 8443 % 500, 9443 % 500)")
def pf06(spark, d):
    ports = (443 % 500, 8443 % 500, 9443 % 500)
    return table(spark, d, "orders").select("o_orderkey", fn.possible_tls_port(F.col("o_orderkey") % 500, F.lit(0), ports).alias("possible_tls_port")).filter("possible_tls_port = 1")


@query("pf10_sk04_rejects", "SELECT l_orderkey, count(*) AS packets, CASE WHEN count(*) < 3 THEN 'too_few_packets' ELSE 'kept' END AS outcome FROM lineitem GROUP BY 1")
def pf10(spark, d):
    f = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("packets"))
    kept, rejected = shaping.split_rejects(f, shaping.enough_packets(F.col("packets")), "too_few_packets")
    return kept.withColumn("outcome", F.lit("kept")).unionByName(rejected.withColumnRenamed("reject_reason", "outcome"))


@query("pf11_quality_filter", "SELECT doc_id, quality FROM labels WHERE quality = 1")
def pf11(spark, d):
    return shaping.split_rejects(table(spark, d, "labels"), F.col("quality") == 1, "quality")[0].select("doc_id", "quality")


@query("pf12_pf13_keep_or_all", "SELECT 'some' AS which, p_partkey FROM part WHERE p_size = 1 UNION ALL SELECT 'all', p_partkey FROM part")
def pf12(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_size")
    one = lambda c, n: shaping.keep_or_all(p, c).select(F.lit(n).alias("which"), "p_partkey")
    return one(F.col("p_size") == 1, "some").union(one(F.col("p_size") == -1, "all"))


@query("pf17_numeric", "SELECT i::INTEGER AS i, CASE WHEN x IS NULL OR isnan(x) OR isinf(x) THEN 0.0::FLOAT ELSE x END AS x FROM (SELECT i, try_cast(v AS FLOAT) AS x FROM (VALUES (0,'1.5'),(1,'x'),(2,'nan'),(3,'inf'),(4,NULL),(5,'-2')) AS t(i, v))")
def pf17(spark, d):
    return spark.createDataFrame([(0, "1.5"), (1, "x"), (2, "nan"), (3, "inf"), (4, None), (5, "-2")], "i int, v string").select("i", shaping.numeric(F.col("v")).alias("x"))


@query("pf18_category_codes", "SELECT p_partkey, p_type, (dense_rank() OVER (ORDER BY p_type) - 1)::INTEGER AS p_type_code FROM part")
def pf18(spark, d):
    return shaping.category_codes(table(spark, d, "part").select("p_partkey", "p_type"), "p_type")


@query("pf19_ag10_slices", """
WITH s AS (SELECT l_linenumber::VARCHAR AS o, CASE WHEN l_returnflag = 'A' THEN 'tls' ELSE 'non_tls' END AS a, CASE WHEN l_linestatus = 'F' THEN 'sequence_available' ELSE 'sequence_unavailable' END AS b FROM lineitem)
SELECT slice_type, slice_value, count(*) AS n FROM (SELECT 'source' AS slice_type, o AS slice_value FROM s UNION ALL SELECT 'tls_slice', a FROM s UNION ALL SELECT 'sequence_slice', b FROM s UNION ALL SELECT 'source_tls_sequence_slice', o || '__' || a || '__' || b FROM s) GROUP BY ALL""")
def pf19(spark, d):
    li = table(spark, d, "lineitem")
    s = shaping.slices(F.col("l_linenumber").cast("string"), (F.col("l_returnflag") == "A").cast("int"), (F.col("l_linestatus") == "F").cast("int"))
    # counted once by all slices, then spread to the few slice types
    c = li.groupBy(*[v.alias(k) for k, v in s.items()]).agg(F.count("*").alias("n"))
    parts = F.array(*[F.struct(F.lit(k).alias("slice_type"), F.col(k).alias("slice_value")) for k in s])
    return c.select(F.explode(parts).alias("s"), "n").groupBy("s.slice_type", "s.slice_value").agg(F.sum("n").alias("n"))


@query("pf20_ag08_source_roles", """
SELECT source, count(*) AS total, sum(toxic)::BIGINT AS label_1, (count(*) - sum(toxic))::BIGINT AS label_0, CASE WHEN sum(toxic) = count(*) THEN 'mining_source' WHEN sum(toxic) = 0 THEN 'non_mining_source' ELSE 'mixed_source' END AS role
FROM documents JOIN labels USING (doc_id) GROUP BY 1""")
def pf20(spark, d):
    x = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id").groupBy("source").agg(F.count("*").alias("total"), F.sum("toxic").cast("long").alias("label_1"))
    x = x.withColumn("label_0", F.col("total") - F.col("label_1"))
    return x.withColumn("role", shaping.source_role(F.col("label_1"), F.col("label_0")))


@query("pf22_placeholders", "SELECT 'nation:' || (row_number() OVER (ORDER BY n_nationkey) - 1) AS source_record_id, 'partial_feature_table' AS status, 1::INTEGER AS label FROM nation")
def pf22(spark, d):
    return shaping.placeholders(table(spark, d, "nation"), "nation", ["n_nationkey"], status="partial_feature_table", label=1)


@query("pf23_constants", "SELECT s_suppkey, 'supplier' AS source, 'benign' AS role, 0::INTEGER AS label FROM supplier")
def pf23(spark, d):
    return shaping.with_constants(table(spark, d, "supplier").select("s_suppkey"), source="supplier", role="benign", label=0)


@query("pf24_threshold", "SELECT l_orderkey, l_linenumber, l_partkey, (l_discount * 10 >= 0.5)::INTEGER AS predicted FROM lineitem")
def pf24(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", shaping.decide(F.col("l_discount") * 10).alias("predicted"))


@query("so01_so02_union_sources", "SELECT 'customer' AS source, c_custkey AS id, c_acctbal AS balance, NULL::VARCHAR AS segment FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_acctbal, NULL FROM supplier")
def so01(spark, d):
    c = table(spark, d, "customer").select(F.lit("customer").alias("source"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    s = table(spark, d, "supplier").select(F.lit("supplier").alias("source"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"), F.lit(None).cast("string").alias("segment"))
    return c.unionByName(s, allowMissingColumns=True)


@query("so07_distinct_lines", "SELECT DISTINCT line FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)")
def so07(spark, d):
    return table(spark, d, "documents").select(F.explode(F.split("text", "\n")).alias("line")).distinct()
