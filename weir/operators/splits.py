"""Leakage-safe splits, stratified samples and duplicate groups, all by hashes of ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SPLITS = {"train": 0.70, "validation": 0.15, "test": 0.15}


def hash_order(row: str, seed: int = 42) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(row).cast("string")), 256)


def _drawn(df: DataFrame, row: str, stratum: str, seed: int) -> DataFrame:
    """``df`` with ``_r``, a row's place in its stratum by a hash of its id, and ``_all``, the stratum's size.

    A hash's first three digits are even ranges, so a stratum is counted by range and numbered within each; no task has all of it.
    """
    rows = df.withColumn("_h", hash_order(row, seed)).withColumn("_part", F.substring("_h", 1, 3))
    sizes = rows.groupBy(stratum, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(stratum).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col(stratum).alias("_s"), F.col("_part").alias("_q"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(stratum)).alias("_all"))
    ranked = rows.withColumn("_i", F.row_number().over(Window.partitionBy(stratum, "_part").orderBy("_h")))
    both = ranked.join(sizes, F.col(stratum).eqNullSafe(F.col("_s")) & (F.col("_part") == F.col("_q")))
    return both.withColumn("_r", F.col("_i") + F.col("_before")).select(*df.columns, "_r", "_all")


def stratified_sample(df: DataFrame, row: str, stratum: str, total: int, keep_whole: Column, seed: int = 42) -> DataFrame:
    """Rows where ``keep_whole`` holds, and of the others ``total`` in proportion to their stratum, chosen by a hash of the id."""
    rest = df.filter(~keep_whole)
    whole = rest.agg(F.count("*").alias("_total"))
    drawn = _drawn(rest, row, stratum, seed).join(F.broadcast(whole))  # one row
    take = F.least(F.bround(F.lit(float(total)) * F.col("_all") / F.col("_total")).cast("long"), F.col("_all"))
    return df.filter(keep_whole).select(df.columns).unionByName(drawn.filter(F.col("_r") <= take).select(df.columns))


def stratified_split(df: DataFrame, row: str, stratum: str, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """``df`` with ``split``: in each stratum the first rows by a hash of the id are test."""
    test = F.col("_r") <= F.bround(F.col("_all") * test_share).cast("long")
    return _drawn(df, row, stratum, seed).withColumn("split", F.when(test, "test").otherwise("train")).select(*df.columns, "split")


def group_split(groups: DataFrame, group: str, size: str, targets: dict[str, float] = SPLITS) -> DataFrame:
    """``groups`` with ``split``: greedy in order of size and the hash of ``group`` (text), each to the split that it fills least.

    Groups are files, of which there are few; their order makes the assignment one after the other, so it runs as one
    fold over one sorted array. A split is chosen by projected, then current share of its target, then a hash of group and split.
    """
    total = F.aggregate("_g", F.lit(0.0), lambda a, g: a + g["n"].cast("double"))
    rows = groups.groupBy().agg(F.array_sort(F.collect_list(F.struct((-F.col(size)).alias("_o"), F.sha2(F.col(group), 256).alias("_h"), F.col(group).alias("g"), F.col(size).alias("n")))).alias("_g"))
    rows = rows.withColumn("_total", total)
    names = list(targets)
    goal = {k: F.greatest(F.col("_total") * v, F.lit(1.0)) for k, v in targets.items()}

    def step(a, g):
        options = F.array_min(F.array(*[
            F.struct(((a[k] + g["n"]) / goal[k]).alias("p"), (a[k] / goal[k]).alias("c"), F.sha2(F.concat(g["g"], F.lit(k)), 256).alias("h"), F.lit(k).alias("k")) for k in names
        ]))["k"]
        return F.struct(*[(a[k] + F.when(options == k, g["n"].cast("double")).otherwise(0.0)).alias(k) for k in names], F.array_append(a["done"], F.struct(g["g"].alias("g"), options.alias("s"))).alias("done"))

    kind = groups.schema[group].dataType.simpleString()
    start = F.struct(*[F.lit(0.0).alias(k) for k in names], F.array().cast(f"array<struct<g:{kind},s:string>>").alias("done"))
    done = rows.select(F.explode(F.aggregate("_g", start, step)["done"]).alias("x")).select(F.col("x.g").alias(group), F.col("x.s").alias("split"))
    return groups.join(F.broadcast(done), group)


def duplicate_groups(df: DataFrame, row: str, fingerprint: str, label: str) -> DataFrame:
    """One row per fingerprint: size, label counts, mixed flag, least id, and a dense number in order of the fingerprint.

    Numbers need a global order: fingerprints are range-partitioned, counted by range, and numbered within each.
    """
    groups = df.groupBy(fingerprint).agg(F.count("*").alias("group_size"), F.sum(F.col(label).cast("long")).alias("label_1"), F.min(row).alias("representative"))
    groups = groups.withColumn("label_0", F.col("group_size") - F.col("label_1")).withColumn("mixed", ((F.col("label_0") > 0) & (F.col("label_1") > 0)).cast("int"))
    # a hash's first three digits are even ranges
    part = F.substring(fingerprint, 1, 3)
    counted = groups.withColumn("_part", part)
    offsets = counted.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    numbered = counted.join(F.broadcast(offsets.select("_part", F.coalesce("_before", F.lit(0)).alias("_before"))), "_part")
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(fingerprint)) + F.col("_before")
    return numbered.withColumn("dedup_group_id", F.format_string("dedup_%07d", rank.cast("long"))).drop("_part", "_before")
