"""Joins with a rule: last or first match wins, best match within a tolerance, list membership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weir.operators.shaping import first_by


def last_match(left: DataFrame, right: DataFrame, on: list[str], order: list[str]) -> DataFrame:
    """Each left row with the last right row of its key by ``order``, if any. The right side shrinks to a row per key before the join."""
    rest = [c for c in right.columns if c not in on]
    one = right.groupBy(*on).agg(F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("_m"))
    return left.join(one.select(*on, *[F.col(f"_m.{c}").alias(c) for c in rest]), on, "left")


def first_in_list(left: DataFrame, ids: str, row: str, right: DataFrame, right_id: str, order: list[str]) -> DataFrame:
    """Each left row with the first right row, by ``order``, whose id is in the left row's list. ``row`` is unique on the left.

    Adds ``observed``, 1 where there is one. The right side shrinks to a row per id before the join, so a frequent id makes no pairs.
    """
    rest = [c for c in right.columns if c != right_id]
    first = first_by(right, [right_id], order)
    wide = left.select(row, F.explode(F.array_distinct(ids)).alias(right_id)).join(first, right_id)
    best = first_by(wide.select(row, right_id, *rest), [row], order)
    return left.join(best.withColumn("observed", F.lit(1)), row, "left").withColumn("observed", F.coalesce("observed", F.lit(0)))


def best_in_tolerance(left: DataFrame, right: DataFrame, on: list[str], row: str, tolerance: float, packets: Column, tie: list[str]) -> DataFrame:
    """Each left row with its best right row of the same key.

    Both sides have ``start`` and ``end`` (the right's as ``r_start``, ``r_end``, ``r_packets``); a pair counts if starts or ends lie within
    ``tolerance``. The longest overlap wins, then the nearest packet count, then ``tie``. Right rows may serve several. The best pair is
    a partial maximum, so a key's pairs never meet in one row.
    """
    pairs = left.join(right, on).filter((F.abs(F.col("start") - F.col("r_start")) <= tolerance) | (F.abs(F.col("end") - F.col("r_end")) <= tolerance))
    overlap = F.greatest(F.least("end", "r_end") - F.greatest("start", "r_start"), F.lit(0.0))
    rest = [c for c in right.columns if c not in on]
    best = pairs.groupBy(row).agg(F.min(F.struct((-overlap).alias("a"), F.abs(packets - F.col("r_packets")).alias("b"), *tie, *[c for c in rest if c not in tie])).alias("_m"))
    return left.join(best.select(row, *[F.col(f"_m.{c}").alias(c) for c in rest]), row, "left").withColumn("matched", F.col(rest[0]).isNotNull().cast("int"))


def fold_membership(rows: DataFrame, row: str, source: str, label: str) -> DataFrame:
    """(fold, heldout_source, row, split): every row in each fold, test where its source is held out.

    Folds are as many as sources; the fold list is one array, so rows are generated and not joined.
    """
    folds = rows.select(source).distinct().groupBy().agg(F.array_sort(F.collect_list(source)).alias("_folds"))
    wide = rows.select(row, source, label).join(F.broadcast(folds)).select(row, source, label, F.posexplode("_folds").alias("fold", "heldout_source"))  # one row
    return wide.withColumn("split", F.when(F.col(source) == F.col("heldout_source"), "test").otherwise("train"))
