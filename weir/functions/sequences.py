"""Time-series features of arrays, as higher-order expressions.

An array of at most a few hundred values stays in one row, so none of these shuffles. What a function reads more
than once is bound first, as an expression in a lambda would be worked out again for each element. Correlations
and spectra, with their square of an array's length, go through Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from weir.functions.scalars import let


def _or(c: Column, ok: Column, other: float = 0.0) -> Column:
    return F.when(ok, c).otherwise(F.lit(other))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def mean(x: Column) -> Column:
    return _or(F.try_divide(total(x), F.size(x).cast("double")), F.size(x) > 0)


def std(x: Column) -> Column:
    """Population standard deviation; 0 for one value or none."""
    square = lambda m: F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - m) * (v - m))
    return _or(F.sqrt(F.try_divide(let(mean(x), square), F.size(x).cast("double"))), F.size(x) > 1)


def quantile(x: Column, q: float) -> Column:
    """Linear interpolation between order statistics; 0 for none."""
    return quantile_of_sorted(F.array_sort(x), q)


def quantile_of_sorted(s: Column, q: float) -> Column:
    at = (F.size(s) - 1) * F.lit(q)
    low = F.floor(at).cast("int")
    a, b = F.get(s, low), F.get(s, F.least(low + 1, F.size(s) - 1))
    return _or(a + (b - a) * (at - low), F.size(s) > 0)


def entropy(x: Column, bins: int = 10) -> Column:
    """Bits of the histogram over equal bins from least to greatest, the last one closed."""

    def places(e: Column) -> Column:
        # a constant series lies in a bin of width one around its value
        low, width = F.when(e["hi"] > e["lo"], e["lo"]).otherwise(e["lo"] - 0.5), F.when(e["hi"] > e["lo"], e["hi"] - e["lo"]).otherwise(F.lit(1.0))
        place = lambda w: F.transform(x, lambda v: F.least(F.floor((v - w["low"]) / w["width"] * bins), F.lit(bins - 1)).cast("int"))
        return let(F.struct(low.alias("low"), width.alias("width")), place)

    n = F.size(x).cast("double")
    in_bin = lambda p, k: F.size(F.filter(p, lambda v: v == k)).cast("double")
    share = lambda k: F.when(k > 0, (k / n) * F.log2(k / n)).otherwise(0.0)
    counts = let(let(F.struct(F.array_min(x).alias("lo"), F.array_max(x).alias("hi")), places), lambda p: F.array(*[in_bin(p, k) for k in range(bins)]))
    return _or(F.aggregate(counts, F.lit(0.0), lambda a, k: a - share(k)), F.size(x) > 1)


def periodicity(x: Column, most: int = 64) -> Column:
    """Struct (lag int, score double, peak double) of an array of doubles.

    The first greatest normalised autocorrelation at lags 1 to ``most``, and the greatest magnitude of the real Fourier transform of the demeaned series
    beside its constant term. (0, 0, 0) for under four values; without variance lag and score are 0. Rows of one length are worked on as a matrix.
    """
    def run(batch: pa.Array) -> pa.Array:
        n = len(batch)
        lag, score, peak = np.zeros(n, np.int32), np.zeros(n), np.zeros(n)
        size = np.asarray(batch.value_lengths().fill_null(0)).astype(np.int64)
        flat = np.asarray(batch.flatten(), np.float64)
        first = np.cumsum(size) - size
        for m in np.unique(size[size >= 4]).tolist():
            every = np.flatnonzero(size == m)
            for k in range(0, len(every), max(1, (1 << 20) // m)):
                rows = every[k : k + max(1, (1 << 20) // m)]
                y = flat[first[rows][:, None] + np.arange(m)]
                y -= y.mean(axis=1, keepdims=True)
                square = np.einsum("ij,ij->i", y, y)
                lags = min(m - 1, most)
                found = np.stack([np.einsum("ij,ij->i", y[:, : m - j], y[:, j:]) for j in range(1, lags + 1)], axis=1)
                moves = square > 0
                found[moves] /= square[moves][:, None]
                top = found.argmax(axis=1)
                lag[rows] = np.where(moves, top + 1, 0)
                score[rows] = np.where(moves, found[np.arange(len(rows)), top], 0.0)
                peak[rows] = np.abs(np.fft.rfft(y, axis=1))[:, 1:].max(axis=1)
        return pa.StructArray.from_arrays([pa.array(lag), pa.array(score), pa.array(peak)], ["lag", "score", "peak"])

    return F.arrow_udf(run, "lag int, score double, peak double")(x)


def autocorrelation_peak(x: Column, most: int = 64) -> Column:
    """Struct (lag, score) of ``periodicity``."""
    p = periodicity(x, most)
    return F.struct(p["lag"].alias("lag"), p["score"].alias("score"))


def spectrum_peak(x: Column) -> Column:
    """Greatest magnitude of the real Fourier transform of the demeaned series beside its constant term; 0 for under four values."""
    return periodicity(x)["peak"]


def burst_lengths(gaps: Column, threshold: float = 1.0) -> Column:
    """Sizes of runs in which no gap but the first exceeds ``threshold``; the very first gap is ignored."""
    start = F.array(F.lit(0.0)).cast("array<double>")
    runs = F.aggregate(
        F.slice(gaps, F.lit(2), F.greatest(F.size(gaps) - 1, F.lit(0))),
        F.struct(F.slice(start, F.lit(1), F.lit(0)).alias("done"), F.lit(1.0).alias("run")),
        lambda a, g: F.when(g <= threshold, F.struct(a["done"].alias("done"), (a["run"] + 1.0).alias("run"))).otherwise(F.struct(F.array_append(a["done"], a["run"]).alias("done"), F.lit(1.0).alias("run"))),
        lambda a: F.array_append(a["done"], a["run"]),
    )
    return F.when(F.size(gaps) > 0, runs).otherwise(F.slice(start, F.lit(1), F.lit(0)))


def by_direction(gaps: Column, directions: Column, sign: int) -> Column:
    both = F.filter(F.arrays_zip(gaps.alias("g"), directions.alias("d")), lambda x: (x["d"] == sign) & x["g"].isNotNull())
    return F.transform(both, lambda x: x["g"])


def cleaned(lengths: Column, gaps: Column) -> tuple[Column, Column]:
    """Sizes of packets and the gaps that count: lengths may be signed, negative gaps are 0."""
    return F.transform(lengths, lambda v: F.abs(v.cast("double"))), F.transform(gaps, lambda v: F.greatest(v.cast("double"), F.lit(0.0)))


def sequence_features(lengths: Column, directions: Column, gaps: Column, burst_gap: float = 1.0, small: float = 0.010) -> dict[str, Column]:
    """All features of a flow's packets by name; ``lengths`` may be signed, negative gaps count 0."""
    size, gap = cleaned(lengths, gaps)
    return features_of(size, F.array_sort(size), directions, gap, F.array_sort(gap), burst_lengths(gap, burst_gap), periodicity(gap), small)


def features_of(size: Column, size_sorted: Column, directions: Column, gap: Column, gap_sorted: Column, bursts: Column, peak: Column, small: float = 0.010) -> dict[str, Column]:
    """The features from what they have in common, which a frame can hold as columns."""
    out: dict[str, Column] = {}
    for name, x, s in (("pkt_len", size, size_sorted), ("iat", gap, gap_sorted)):
        out |= {
            f"{name}_mean": mean(x), f"{name}_std": std(x), f"{name}_min": F.coalesce(F.get(s, F.lit(0)), F.lit(0.0)), f"{name}_max": F.coalesce(F.get(s, F.size(s) - 1), F.lit(0.0)),
            f"{name}_p10": quantile_of_sorted(s, 0.1), f"{name}_p50": quantile_of_sorted(s, 0.5), f"{name}_p90": quantile_of_sorted(s, 0.9),
        }
    share = lambda test: _or(F.try_divide(F.size(F.filter(gap, test)).cast("double"), F.size(gap).cast("double")), F.size(gap) > 0)
    one_way = lambda sign: let(by_direction(gap, directions, sign), mean)
    forward, backward = one_way(1), one_way(-1)
    return out | {
        "iat_zero_ratio": share(lambda v: v == 0), "iat_small_ratio_10ms": share(lambda v: v <= small),
        "iat_cv": _or(F.try_divide(out["iat_std"], out["iat_mean"]), out["iat_mean"] > 0), "iat_entropy": entropy(gap),
        "fwd_iat_mean": forward, "bwd_iat_mean": backward, "fwd_bwd_iat_ratio": _or(F.try_divide(forward, backward), backward > 0),
        "burst_count": F.size(bursts), "burst_mean_packets": mean(bursts), "burst_max_packets": F.coalesce(F.array_max(bursts), F.lit(0.0)).cast("int"),
        "periodicity_autocorr_lag": peak["lag"], "periodicity_autocorr_score": peak["score"], "periodicity_fft_peak": peak["peak"],
    }
