"""Statistics and data-quality rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weir.operators import metrics


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of each combination; null is one of its own."""
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


def joined_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Group sizes by a key joined by bars, null written ``nan``."""
    return df.groupBy(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in columns]).alias("key")).agg(F.count("*").alias("n"))


def quantiles(df: DataFrame, by: list[str], value: str, levels: tuple[float, ...]) -> DataFrame:
    """Exact quantiles ``q<percent>`` by linear interpolation; nulls and NaN are left out."""
    known = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    counts = known.groupBy(*by, value).agg(F.count("*").alias("_k"))
    out = metrics.exact_quantiles(counts, by, value, "_k", list(levels), metrics.range_of(F.col(value), metrics.spread(known, [value])[value]))
    return out.groupBy(*by).agg(*[F.max(F.when(F.col("k") == k, F.col("quantile"))).alias(f"q{round(x * 100)}") for k, x in enumerate(levels)])


def missing_rates(df: DataFrame) -> DataFrame:
    """(name, rate) of nulls by column, in one pass."""
    rates = df.agg(*[F.avg(F.col(f"`{c}`").isNull().cast("int")).alias(c) for c in df.columns])
    return rates.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").alias("rate")) for c in df.columns])).alias("x")).select("x.name", "x.rate")


def label_check(df: DataFrame, label: str) -> DataFrame:
    c = F.col(label)
    return df.agg(F.min(c.isin(0, 1)).alias("valid"), ((F.max(c) == 1) & (F.min(c) == 0)).alias("both"))


def id_check(df: DataFrame, id_col: str) -> DataFrame:
    """Rows, null ids and repeated ids; counted by id first, so one pass of partial sums."""
    c = df.groupBy(id_col).agg(F.count("*").alias("k"))
    null = F.col(id_col).isNull()
    total = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("long")
    return c.agg(total("k").alias("n"), total(F.when(null, F.col("k"))).alias("n_null"), total(F.when(~null, F.col("k") - 1)).alias("n_repeated"))


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    return df.agg(*[F.coalesce(F.sum(r.cast("long")), F.lit(0)).alias(n) for n, r in rules.items()])


def vocabulary(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, value, n) of each column's values."""
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.explode(pairs).alias("x")).groupBy("x.field", "x.value").agg(F.count("*").alias("n"))


def gap(df: DataFrame, by: list[str], inside: Column, value: str) -> DataFrame:
    """Mean inside less mean outside, with both counts."""
    i, o = F.avg(F.when(inside, F.col(value))), F.avg(F.when(~inside, F.col(value)))
    return df.groupBy(*by).agg(F.round(i - o, 4).alias("gap"), F.sum(inside.cast("long")).alias("n_in"), F.sum((~inside).cast("long")).alias("n_cross"))


def schema_differences(df: DataFrame, schema: T.StructType) -> dict[str, list[str]]:
    """Missing and extra column names, and whether the order differs."""
    have, want = df.columns, schema.fieldNames()
    return {"missing": [c for c in want if c not in have], "extra": [c for c in have if c not in want], "reordered": [c for c, w in zip(have, want) if c != w] if set(have) == set(want) else []}


def forbidden(df: DataFrame, names: set[str]) -> list[str]:
    return sorted(set(map(str.lower, df.columns)) & set(map(str.lower, names)))


def gate(df: DataFrame, schema: T.StructType, id_col: str, label: str, rules: dict[str, Column], banned: set[str]) -> list[str]:
    """Messages of all failed rules; none where the table is sound. A caller writes its report and then raises."""
    out = [f"columns {k}: {', '.join(v)}" for k, v in schema_differences(df, schema).items() if v]
    out += [f"forbidden columns: {', '.join(x)}" for x in [forbidden(df, banned)] if x]
    ids = id_check(df, id_col).first()
    out += ["no rows"] * (ids["n"] == 0) + [f"{ids['n_null']} null ids"] * (ids["n_null"] > 0) + [f"{ids['n_repeated']} repeated ids"] * (ids["n_repeated"] > 0)
    labels = label_check(df, label).first()
    out += ["labels other than 0 and 1"] * (labels["valid"] is False) + ["one label only"] * (labels["both"] is False)
    found = violations(df, rules).first().asDict()
    return out + [f"{k}: {n} rows" for k, n in found.items() if n]


class QualityError(ValueError):
    """A table that failed its gate, after its report was written."""


def enforce(messages: list[str]) -> None:
    if messages:
        raise QualityError("; ".join(messages))
