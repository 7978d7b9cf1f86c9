"""Packets to flows: order, direction, gaps, truncation and features in one shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weir.functions.scalars import let
from weir.functions.sequences import burst_lengths, cleaned, features_of, periodicity

#: Flag bits of TCP. Fixed values.
FLAGS = {"syn": 0x02, "ack": 0x10, "psh": 0x08, "rst": 0x04, "fin": 0x01}


def assemble(packets: DataFrame, keys: list[str], seconds: Column, tie: Column, length: Column, endpoint: Column, most: int = 256) -> DataFrame:
    """One row per flow: bounds, counts, and ordered arrays of its first ``most`` packets.

    ``endpoint`` says who sent a packet; direction is 1 where that is the first packet's sender, else -1. Gaps
    are seconds since the packet before, not under 0, and 0 for the first.
    """
    one = F.struct(seconds.alias("t"), tie.alias("k"), length.alias("n"), endpoint.alias("e"))
    rows = packets.select(*keys, one.alias("_p"))
    bounds = rows.groupBy(*keys).agg(F.min("_p.t").alias("time_first"), F.max("_p.t").alias("time_last"), F.count("*").alias("packet_count"))
    # a limit by rank cuts a long flow in every partition before the shuffle
    first = rows.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy("_p.t", "_p.k"))).filter(F.col("_i") <= most)
    first = first.groupBy(*keys).agg(F.array_sort(F.collect_list("_p")).alias("_p"))
    same = reduce(lambda a, b: a & b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])
    flows = bounds.alias("a").join(first.alias("b"), same).select("a.*", "b._p")
    gap = lambda a, b: F.greatest(b["t"] - a["t"], F.lit(0.0))
    after = F.zip_with(F.slice("_p", F.lit(1), F.size("_p") - 1), F.slice("_p", F.lit(2), F.size("_p") - 1), gap)
    return flows.select(
        *keys, "time_first", "time_last", "packet_count", F.size("_p").alias("seq_len"),
        F.transform("_p", lambda p: p["n"]).alias("pkt_len"),
        let(F.col("_p")[0]["e"], lambda e: F.transform("_p", lambda p: F.when(p["e"] == e, 1).otherwise(-1))).alias("pkt_dir"),
        F.concat(F.array(F.lit(0.0)), after).alias("pkt_iat"),
    )


def with_features(flows: DataFrame, burst_gap: float = 1.0, small: float = 0.010) -> DataFrame:
    """``flows`` with the features of its packets. What features have in common is worked out once, as columns."""
    size, gap = cleaned(F.col("pkt_len"), F.col("pkt_iat"))
    t = flows.withColumns({"_size": size, "_gap": gap})
    t = t.withColumns({"_size_sorted": F.array_sort("_size"), "_gap_sorted": F.array_sort("_gap"), "_bursts": burst_lengths(F.col("_gap"), burst_gap), "_peak": periodicity(F.col("_gap"))})
    feats = features_of(F.col("_size"), F.col("_size_sorted"), F.col("pkt_dir"), F.col("_gap"), F.col("_gap_sorted"), F.col("_bursts"), F.col("_peak"), small)
    return t.withColumns(feats).drop("_size", "_gap", "_size_sorted", "_gap_sorted", "_bursts", "_peak")


def flag_counts(packets: DataFrame, keys: list[str], flags: str) -> DataFrame:
    """Packets of each flow with each flag set."""
    return packets.groupBy(*keys).agg(*[F.sum((F.col(flags).bitwiseAND(bit) != 0).cast("long")).alias(f"{name}_count") for name, bit in FLAGS.items()])
