"""Classification metrics, drift, exact quantiles and correlation as aggregations.

Curves, ranks and quantiles need only the counts at each distinct value, so rows meet once, pre-aggregated. Their running sums
are taken by ranges of values: steps around a middle that a sketch gives, each range summed up by itself, and the sums of
the ranges before it added. No result depends on where the ranges lie, so the figures are exact and no task holds a whole group.
"""

from __future__ import annotations

import math

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Ranges of values to a doubling or so of their distance from the middle.
RANGES = 1024


def spread(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """A middle and a scale of each column, from a sketch; one row comes to the driver. Both only steer how evenly ranges are filled."""
    levels = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    row = df.agg(*[F.percentile_approx(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), levels, 100).alias(f"c{k}") for k, c in enumerate(columns)]).first()
    out = {}
    for k, c in enumerate(columns):
        low, middle, high = row[k] or (0.0, 0.0, 0.0)
        scale = high - low or abs(middle) / 64 or 1.0
        out[c] = (middle, scale) if math.isfinite(middle) and math.isfinite(scale) else (0.0, 1.0)
    return out


def range_of(value: Column, at: tuple[float, float]) -> Column:
    """A number that never falls as ``value`` grows: even steps around the middle, steps of a factor far from it."""
    x = (value.cast("double") - F.lit(at[0])) / F.lit(at[1])
    return F.floor(F.greatest(F.least(F.signum(x) * F.log1p(F.abs(x)), F.lit(1000.0)), F.lit(-1000.0)) * RANGES).cast("int")


def _same(names: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in names], F.lit(True))


def _parts(rows: DataFrame, by: list[str], sums: list[str]) -> DataFrame:
    """(by, _part, <sum>_own, <sum>_before, <sum>_all): sums of each range, of those before it, and of the group. A group has a bounded number of ranges."""
    before, whole = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*by)
    parts = rows.groupBy(*by, "_part").agg(*[F.sum(c).alias(f"{c}_own") for c in sums])
    return parts.select("*", *[F.coalesce(F.sum(f"{c}_own").over(before), F.lit(0)).alias(f"{c}_before") for c in sums], *[F.sum(f"{c}_own").over(whole).alias(f"{c}_all") for c in sums])


def running(rows: DataFrame, by: list[str], value: str, sums: list[str], part: Column) -> DataFrame:
    """``rows`` (one for each of ``by`` and value) with ``<sum>_upto``, the sum over rows of no greater value, and ``<sum>_all``, that of the group. ``part`` never falls as the value grows."""
    rows = rows.withColumn("_part", part)
    inside = Window.partitionBy(*by, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    inner = rows.withColumns({f"{c}_in": F.sum(c).over(inside) for c in sums})
    both = inner.alias("l").join(_parts(rows, by, sums).alias("r"), _same([*by, "_part"]))
    return both.select(*[F.col(f"l.{c}").alias(c) for c in rows.columns if c != "_part"], *[(F.col(f"{c}_before") + F.col(f"{c}_in")).alias(f"{c}_upto") for c in sums], *[f"{c}_all" for c in sums])


def exact_quantiles(counts: DataFrame, by: list[str], value: str, n: str, steps: list[float], part: Column, few: bool = False) -> DataFrame:
    """(by, k, quantile): the linearly interpolated order statistic at each of ``steps``, by its place ``k``, of values that occur ``n`` times. ``few`` says that groups are few enough for their order statistics to be sent to all tasks.

    Only ranges that hold an order statistic are sorted.
    """
    rows = counts.withColumn("_part", part)
    parts = _parts(rows, by, [n])
    top = F.col(f"{n}_all") - 1
    wanted = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(q)).alias("q")) for k, q in enumerate(steps)]))
    ranks = parts.filter(F.col(f"{n}_before") == 0).select(*by, f"{n}_all", wanted.alias("x")).withColumn("_at", F.col("x.q") * top)
    ends = F.explode(F.array(*[F.struct(F.lit(side).alias("side"), f("_at").cast("long").alias("rank")) for side, f in ((0, F.floor), (1, F.ceil))]))
    ranks = ranks.select(*by, F.col("x.k").alias("k"), (F.col("_at") - F.floor("_at")).alias("t"), ends.alias("e")).select(*by, "k", "t", "e.side", "e.rank")
    # the range of each order statistic, and in it the value
    held = ranks.alias("l").join(parts.alias("r"), _same(by)).filter((F.col("rank") >= F.col(f"{n}_before")) & (F.col("rank") < F.col(f"{n}_before") + F.col(f"{n}_own")))
    held = held.select(*[F.col(f"l.{c}").alias(c) for c in [*by, "k", "t", "side"]], "_part", (F.col("rank") - F.col(f"{n}_before")).alias("_rest"))
    inside = Window.partitionBy(*by, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    held = F.broadcast(held) if few else held
    rows = rows.alias("l").join(held.alias("r"), _same([*by, "_part"]), "left_semi").select("l.*")
    inner = rows.select(*by, "_part", F.col(value).alias("_v"), F.col(n).alias("_n"), F.sum(n).over(inside).alias("_in"))
    found = inner.alias("l").join(held.alias("r"), _same([*by, "_part"])).filter("_rest < _in and _rest >= _in - _n")
    found = found.select(*[F.col(f"l.{c}").alias(c) for c in by], "k", "t", "side", F.col("_v").cast("double").alias("_v"))
    both = found.groupBy(*by, "k").agg(F.max(F.when(F.col("side") == 0, F.col("_v"))).alias("a"), F.max(F.when(F.col("side") == 1, F.col("_v"))).alias("b"), F.max("t").alias("t"))
    return both.select(*by, "k", (F.col("a") + (F.col("b") - F.col("a")) * F.col("t")).alias("quantile"))


def confusion(df: DataFrame, by: list[str], label: str, predicted: str) -> DataFrame:
    """Counts, precision, recall of both classes, F1 and false-positive rate; F1 and the cells are null and -1 where a class is absent."""
    cell = lambda y, p: F.sum(((F.col(label) == y) & (F.col(predicted) == p)).cast("long"))
    c = df.groupBy(*by).agg(cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp"))
    c = c.withColumns({"n_pos": F.col("tp") + F.col("fn"), "n_neg": F.col("tn") + F.col("fp")})
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    ratio = lambda a, b: F.try_divide(F.col(a).cast("double"), b)
    c = c.withColumns({
        "precision_pos": F.coalesce(ratio("tp", F.col("tp") + F.col("fp")), F.lit(0.0)), "recall_pos": ratio("tp", F.col("n_pos")), "recall_neg": ratio("tn", F.col("n_neg")),
        "fpr": ratio("fp", F.col("n_neg")), "f1_pos": F.when(both, F.coalesce(F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))),
    })
    return c.withColumns({k: F.when(both, F.col(k)).otherwise(F.lit(-1).cast("long")) for k in ("tn", "fp", "fn", "tp")})


def ranking(df: DataFrame, by: list[str], label: str, score: str) -> DataFrame:
    """ROC area (ties averaged) and average precision (by steps); null where a class is absent."""
    points = df.groupBy(*by, score).agg(F.sum(F.col(label).cast("long")).alias("p"), F.count("*").alias("n"))
    points = running(points, by, score, ["p", "n"], range_of(F.col(score), spread(df, [score])[score]))
    # counted from the greatest score down
    down = {f"c{k}": F.col(f"{k}_all") - F.col(f"{k}_upto") + F.col(k) for k in ("p", "n")}
    points = points.withColumns(down).withColumn("q", F.col("n") - F.col("p"))
    sums = points.groupBy(*by).agg(
        F.sum("p").alias("pos"), F.sum("q").alias("neg"),
        F.sum(F.col("q") * (F.col("cp") - F.col("p") + F.col("p") / 2.0)).alias("area"), F.sum(F.col("p") * F.col("cp") / F.col("cn")).alias("steps"),
    )
    both = (F.col("pos") > 0) & (F.col("neg") > 0)
    return sums.select(*by, "pos", "neg", F.when(both, F.try_divide("area", F.col("pos") * F.col("neg"))).alias("roc_auc"), F.when(both, F.try_divide("steps", F.col("pos").cast("double"))).alias("pr_auc"))


def drift(df: DataFrame, source: str, features: list[str], bins: int = 50) -> DataFrame:
    """(feature, source_a, source_b, jsd) for every feature and pair of sources; a report of that many rows, worked out at once.

    Jensen-Shannon distance (base 2) of histograms over the distinct quantiles of the pooled pair, the last bin closed; values that are not finite count nowhere.
    0 for a pool that hardly varies, NaN where a source has no value. Equal values are counted once, by source, before pairs are made. Sources and features are few.
    """
    session = df.sparkSession
    names = [r[0] for r in df.select(source).filter(F.col(source).isNotNull()).distinct().orderBy(source).collect()]
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names))]
    schema = T.StructType([T.StructField("feature", T.StringType()), *(T.StructField(c, df.schema[source].dataType) for c in ("source_a", "source_b")), T.StructField("jsd", T.DoubleType())])
    if not pairs:
        return session.createDataFrame([], schema)
    each = df.select(F.col(source).alias("_s"), F.posexplode(F.array(*[F.col(f).cast("double") for f in features])).alias("f", "value"))
    each = each.filter("value is not null and not isnan(value) and abs(value) < double('inf')")
    counts = each.groupBy("f", "value").agg(*[F.count(F.when(F.col("_s") == s, 1)).alias(f"n{i}") for i, s in enumerate(names)]).persist()
    try:
        of_pair = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.col(f"n{i}").alias("a"), F.col(f"n{j}").alias("b")) for p, (i, j) in enumerate(pairs)]))
        pooled = counts.select("f", "value", of_pair.alias("x")).select("f", "x.*", "value", (F.col("x.a") + F.col("x.b")).alias("n")).filter("n > 0")
        at = spread(df, features)
        part_of = lambda v: reduce(lambda c, k: c.when(F.col("f") == k, range_of(v, at[features[k]])), range(1, len(features)), F.when(F.col("f") == 0, range_of(v, at[features[0]])))
        edges = exact_quantiles(pooled, ["f", "p"], "value", "n", [k / bins for k in range(bins + 1)], part_of(F.col("value")), few=True)
        edges = edges.groupBy("f", "p").agg(F.array_sort(F.collect_set("quantile")).alias("edges"))
        edges = session.createDataFrame(edges.collect(), edges.schema)  # some bins for each row of the report
        found = _distances(pooled, edges, part_of).collect()
    finally:
        counts.unpersist()
    known = {(r["f"], r["p"]): r["jsd"] for r in found}
    return session.createDataFrame([(f, names[i], names[j], known.get((k, p), math.nan)) for k, f in enumerate(features) for p, (i, j) in enumerate(pairs)], schema)


def _distances(pooled: DataFrame, edges: DataFrame, part_of) -> DataFrame:
    """(f, p, jsd) of counts (f, p, value, a, b) in the bins between ``edges``."""
    key = ["f", "p"]
    each = edges.select(*key, F.posexplode("edges").alias("k", "edge")).withColumn("_part", part_of(F.col("edge")))
    # what lies below an edge: the ranges before its own, and in that the lesser values; the last bin is closed
    rows = pooled.withColumn("_part", part_of(F.col("value")))
    parts = rows.groupBy(*key, "_part").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    sums = lambda t: t.groupBy(*key, "k").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    inside = rows.join(F.broadcast(each), [*key, "_part"]).filter(F.col("value") < F.col("edge")).select(*key, "k", "a", "b")
    before = parts.withColumnRenamed("_part", "_p").join(each, key).filter("_p < _part").select(*key, "k", "a", "b")
    below = sums(inside.unionByName(before))
    total = parts.groupBy(*key).agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    points = edges.join(total, key).select(*key, "ta", "tb", F.size("edges").alias("m"), F.element_at("edges", 1).alias("lo"), F.element_at("edges", -1).alias("hi"), F.posexplode("edges").alias("k", "edge"))
    points = points.join(below, [*key, "k"], "left")
    closed = lambda c: F.when(F.col("k") == F.col("m") - 1, F.col(f"t{c}")).otherwise(F.coalesce(F.col(c), F.lit(0))).alias(c)
    points = points.select(*key, "ta", "tb", "m", "lo", "hi", F.struct("k", closed("a"), closed("b")).alias("x"))
    points = points.groupBy(*key, "ta", "tb", "m", "lo", "hi").agg(F.array_sort(F.collect_list("x")).alias("x"))
    eps, gaps = 1e-12, F.col("m") - 1
    share = lambda c, x, y: (y[c] - x[c] + eps) / (F.col(f"t{c}") + eps * gaps)

    def gain(x, y):
        p, q = share("a", x, y), share("b", x, y)
        m = (p + q) / 2
        return p * F.log2(p / m) + q * F.log2(q / m)

    gains = F.zip_with(F.slice("x", F.lit(1), gaps), F.slice("x", F.lit(2), gaps), gain)
    value = F.sqrt(F.greatest(F.aggregate(gains, F.lit(0.0), lambda s, x: s + x) / 2, F.lit(0.0)))
    flat = (F.col("m") < 2) | (F.col("hi") - F.col("lo") <= 1e-8 + 1e-5 * F.abs("lo"))
    return points.filter("ta > 0 and tb > 0").select(*key, F.when(flat, 0.0).otherwise(value).alias("jsd"))


def drift_by_group(drifts: DataFrame, groups: Column) -> DataFrame:
    """Mean, median, greatest and count of the distances of a group's features, those that are NaN left out; the median is over a row per feature."""
    known = drifts.withColumn("jsd", F.nanvl("jsd", F.lit(None).cast("double")))
    return known.groupBy(groups.alias("group"), "source_a", "source_b").agg(F.avg("jsd").alias("mean_jsd"), F.percentile("jsd", F.lit(0.5)).alias("median_jsd"), F.max("jsd").alias("max_jsd"), F.count("jsd").alias("n_features"))


def symmetric(drifts: DataFrame) -> DataFrame:
    """(a, b, value): pairs both ways and a zero diagonal."""
    one = drifts.filter(~F.isnan("jsd")).groupBy("source_a", "source_b").agg(F.avg("jsd").alias("value"))
    back = one.select(F.col("source_b").alias("source_a"), F.col("source_a").alias("source_b"), "value")
    both = one.unionByName(back)
    return both.unionByName(both.select("source_a", F.col("source_a").alias("source_b"), F.lit(0.0).alias("value")).distinct())


def correlations(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Pearson's r and Spearman's rho (average ranks) with the count of rows that have both values; null for under three rows."""
    df = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    linear = df.groupBy(*by).agg(F.count("*").alias("n"), F.corr(x, y).alias("pearson_r"))
    points, at = df.groupBy(*by, x, y).agg(F.count("*").alias("_w")), spread(df, [x, y])
    for c in (x, y):
        values = points.groupBy(*by, c).agg(F.sum("_w").alias("_n"))
        # an average rank, less the mean of all ranks
        rank = F.col("_n_upto") - (F.col("_n") - 1) / 2.0 - (F.col("_n_all") + 1) / 2.0
        ranks = running(values, by, c, ["_n"], range_of(F.col(c), at[c])).select(*by, c, rank.alias(f"_{c}"))
        points = points.alias("l").join(ranks.alias("r"), _same([*by, c])).select("l.*", f"r._{c}")
    total = lambda a, b: F.sum(F.col(a) * F.col(b) * F.col("_w"))
    rho = F.try_divide(total(f"_{x}", f"_{y}"), F.sqrt(total(f"_{x}", f"_{x}") * total(f"_{y}", f"_{y}")))
    ranked = points.groupBy(*by).agg(rho.alias("spearman_rho"))
    enough = lambda c: F.when(F.col("n") >= 3, F.col(c)).alias(c)
    return linear.alias("l").join(ranked.alias("r"), _same(by)).select("l.*", "spearman_rho").select(*by, "n", enough("pearson_r"), enough("spearman_rho"))


def correlation_p(r: float | None, n: int) -> float | None:
    """Two-sided p-value of a correlation under Student's t with n - 2 degrees of freedom."""
    if r is None or n < 3:
        return None
    if abs(r) >= 1:
        return 0.0
    df = n - 2
    return _beta(df / (df + r * r * df / (1 - r * r)), df / 2, 0.5)


def _beta(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(1 - x, b, a)
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / max(1 + num * d, tiny)
            c = max(1 + num / c, tiny)
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return front * h / a


def with_p_values(found: DataFrame) -> DataFrame:
    """``correlations`` with ``pearson_p`` and ``spearman_p``; a report of a row per group, which the driver fills in."""
    schema = T.StructType([*found.schema.fields, T.StructField("pearson_p", T.DoubleType()), T.StructField("spearman_p", T.DoubleType())])
    rows = [(*r, correlation_p(r["pearson_r"], r["n"]), correlation_p(r["spearman_rho"], r["n"])) for r in found.collect()]
    return found.sparkSession.createDataFrame(rows, schema)


def against_baseline(figures: DataFrame, baseline: Column, group: str, value: str) -> DataFrame:
    """``figures`` beside the baseline rows, with ``gap``: the baseline of their group less their own ``value``; null without one."""
    base = figures.filter(baseline).groupBy(group).agg(F.first(value).alias("_base"))
    return figures.filter(~baseline).join(base, group, "left").withColumn("gap", F.col("_base") - F.col(value)).drop("_base")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """n / (k * n_c) for each class."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    every = Window.partitionBy()
    return counts.select(label, "n", (F.sum("n").over(every) / (F.count("*").over(every) * F.col("n"))).alias("weight"))
