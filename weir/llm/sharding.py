"""Byte-balanced sharding by histogram sort.

Rows are ordered by ``(group key, row key)``, two 64-bit values. Splitters are
found without sorting: each pass counts the exact bytes and rows below a set of
probe keys in every partition, adds the counts, and puts the next probes into the
gap that still holds each wanted boundary. When every boundary is within the
tolerance, or no key lies in its gap, rows move once.

Every shard is cut into several ranges, so that a shard of any size is sorted by
many tasks; a row's slot is the count of rows in earlier ranges of its shard plus
its place in its own range, and so it is gapless.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from weir.llm._scratch import Scratch, arrow_map

N_SHARDS = 24
_LO, _HI = -(2**63), 2**63 - 1


def _count(table: DataFrame, probes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact (bytes, rows) of keys below each probe; probes are sorted (hi, lo) pairs."""
    hi, lo = probes["hi"].copy(), probes["lo"].copy()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, rows = np.zeros(len(hi) + 1, np.int64), np.zeros(len(hi) + 1, np.int64)
        for b in batches:
            bin_ = _bins(hi, lo, *(np.asarray(b.column(k)) for k in (0, 1)))
            size += _sum(bin_, np.asarray(b.column(2)), len(hi) + 1)
            rows += np.bincount(bin_, minlength=len(hi) + 1)
        at = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(size[at]), pa.array(rows[at])], ["bin", "bytes", "n"])

    found = arrow_map(table.select("hi", "lo", "size"), count, "bin long, bytes long, n long").groupBy("bin").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")).collect()
    size, rows = np.zeros(len(hi) + 1, np.int64), np.zeros(len(hi) + 1, np.int64)
    for r in found:
        size[r["bin"]], rows[r["bin"]] = r["bytes"], r["n"]
    return np.cumsum(size)[:-1], np.cumsum(rows)[:-1]


def _sum(bin_: np.ndarray, size: np.ndarray, n: int) -> np.ndarray:
    """Exact integer sums by bin."""
    out = np.zeros(n, np.int64)
    if len(bin_):
        order = np.argsort(bin_, kind="stable")
        b = bin_[order]
        first = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
        out[b[first]] = np.add.reduceat(size[order], first)
    return out


def _bins(hi: np.ndarray, lo: np.ndarray, khi: np.ndarray, klo: np.ndarray) -> np.ndarray:
    """Number of probes at or below each key: a key equal to a probe belongs above it."""
    left, right = np.searchsorted(hi, khi, side="left"), np.searchsorted(hi, khi, side="right")
    tied = np.flatnonzero(right > left)
    out = left
    for run in np.unique(left[tied]):
        rows = tied[left[tied] == run]
        end = right[rows[0]]
        out[rows] = run + np.searchsorted(lo[run:end], klo[rows], side="right")
    return out


def _spread(a: tuple[int, int], b: tuple[int, int], n: int) -> list[tuple[int, int]]:
    """n keys evenly between a and b (exclusive); on the second value once the first is settled."""
    if b[0] - a[0] > 1:
        return [(h, _LO) for h in sorted({a[0] + 1 + (b[0] - a[0] - 1) * k // n for k in range(n)})]
    start = a if a[0] == b[0] or a[1] < _HI else (b[0], _LO)
    if start[0] == b[0]:
        lo, hi, at = start[1], b[1], b[0]
        return [(at, v) for v in sorted({lo + (hi - lo) * (k + 1) // (n + 1) for k in range(n)}) if a < (at, v) < b]
    lo = start[1]
    return [(start[0], v) for v in sorted({lo + (_HI - lo) * (k + 1) // (n + 1) for k in range(n)}) if a < (start[0], v) < b] + [(b[0], _LO)] * (a < (b[0], _LO) < b)


def splitters(table: DataFrame, n_ranges: int, tolerance: float, probes: int = 64) -> tuple[list[tuple[int, int]], int, int]:
    """Keys that cut ``table`` (hi, lo, size) into ``n_ranges`` of near equal size, with total bytes and rows.

    Each pass narrows the gap of every unsettled boundary by ``probes`` times at
    least; a boundary settles when its bytes are within ``tolerance`` of a range,
    or when one key alone fills its gap.
    """
    total = table.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("b"), F.count("*").alias("n")).first()
    goal = [total["b"] * k // n_ranges for k in range(1, n_ranges)]
    slack = max(1, int(total["b"] / n_ranges * tolerance))
    gaps = [((_LO, _LO), (_HI, _HI), 0, total["b"], 0, total["n"])] * len(goal)
    best: list[tuple[int, int] | None] = [None] * len(goal)
    dtype = np.dtype([("hi", np.int64), ("lo", np.int64)])
    keys = set(_spread((_LO, _LO), (_HI, _HI), probes * n_ranges))
    while total["n"] and any(b is None for b in best):
        at = np.array(sorted(keys), dtype)
        below, rows = _count(table, at)
        for k in (k for k, b in enumerate(best) if b is None):
            a, b, size_a, size_b, rows_a, rows_b = gaps[k]
            i = int(np.searchsorted(below, goal[k], side="right"))
            for j in (i - 1, i):
                if 0 <= j < len(at) and a < (key := (int(at["hi"][j]), int(at["lo"][j]))) < b:
                    if j < i:
                        a, size_a, rows_a = key, int(below[j]), int(rows[j])
                    else:
                        b, size_b, rows_b = key, int(below[j]), int(rows[j])
            gaps[k] = (a, b, size_a, size_b, rows_a, rows_b)
            if min(goal[k] - size_a, size_b - goal[k]) <= slack or rows_b - rows_a <= 1 or not _spread(a, b, probes):
                best[k] = a if goal[k] - size_a <= size_b - goal[k] else b
        keys = {key for k, b in enumerate(best) if b is None for key in _spread(*gaps[k][:2], probes)}
    return sorted(b for b in best if b is not None), total["b"], total["n"]


def shard(df: DataFrame, size: str, key: str, group: str, n_shards: int = N_SHARDS, tolerance: float = 0.002, range_bytes: int = 16 << 20, max_ranges: int = 12_000) -> DataFrame:
    """All rows of ``df`` with ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard).

    ``size`` names a non-negative long column, ``key`` and ``group`` columns of any
    type. Rows are ordered by (hash of group, hash of key), so that rows of a group lie side by
    side and are parted only where a shard's boundary falls among them. Shards'
    sizes differ by ``tolerance`` of a shard and one row. Rows equal in both keys
    stay in one shard, ordered by all their columns' hash. A null size
    counts 0; null keys form a key of their own. An empty table gives no rows.
    Other columns pass through; columns named ``shard`` or ``slot`` are replaced.

    Ranges: about ``range_bytes`` each, at most ``max_ranges`` in all, which bounds
    the splitters on the driver and in the plan of every task.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "shard")
    keyed = df.drop("shard", "slot")
    rest = [c for c in keyed.columns]
    hi, lo = F.xxhash64(F.col(f"`{group}`")), F.xxhash64(F.col(f"`{key}`"))
    weight = F.coalesce(F.col(f"`{size}`").cast("long"), F.lit(0).cast("long"))
    table = scratch.write(keyed.select(hi.alias("hi"), lo.alias("lo"), weight.alias("size")), "keys")
    total = table.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    per = int(max(1, min(max_ranges // n_shards, -(-total // (range_bytes * n_shards)))))
    at, _, _ = splitters(table, n_shards * per, tolerance)
    dtype = np.dtype([("hi", np.int64), ("lo", np.int64)])
    at = np.array(at, dtype)
    # of the rows before each range, those of its own shard
    before = np.concatenate([[0], _count(table, at)[1]]) if len(at) else np.zeros(1, np.int64)
    first = before[(np.arange(len(before)) // per) * per]
    offset = before - first
    phi, plo = at["hi"].copy(), at["lo"].copy()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            khi, klo = (np.asarray(b.column(b.schema.get_field_index(k))) for k in ("_weir_hi", "_weir_lo"))
            bin_ = _bins(phi, plo, khi, klo) if len(phi) else np.zeros(b.num_rows, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(bin_.astype(np.int32)), pa.array(offset[bin_])], names=[*b.schema.names, "_weir_range", "_weir_offset"])

    wide = keyed.withColumns({"_weir_hi": hi, "_weir_lo": lo})
    schema = T.StructType([*wide.schema.fields, T.StructField("_weir_range", T.IntegerType()), T.StructField("_weir_offset", T.LongType())])
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])
    placed = arrow_map(wide, place, schema)
    tie = F.xxhash64(*[F.col(f"`{c}`") for c in rest])
    win = Window.partitionBy("_weir_range").orderBy("_weir_hi", "_weir_lo", tie)
    return placed.select(
        *[F.col(f"`{c}`") for c in rest],
        F.floor(F.col("_weir_range") / F.lit(per)).cast("int").alias("shard"),
        (F.row_number().over(win) - 1 + F.col("_weir_offset")).cast("long").alias("slot"),
    )


def op1_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes; sizes, checksums and slots."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    sized = docs.withColumn("size", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long"))
    out = shard(sized, "size", "doc_id", "text", N_SHARDS)
    return out.select(
        "doc_id", "size", F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).cast("long").alias("text_crc32"),
        F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
