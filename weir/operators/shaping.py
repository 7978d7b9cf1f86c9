"""Column and row shaping: aliases, schema projection, encodings, caps and rejects."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from weir.functions.scalars import fingerprint, first_present, float_or_zero, parse_sequence, row_id, strip, timestamp_or_zero
from weir.functions.scalars import stem as file_stem
from weir.operators import metrics

#: Substrings of labels that speak of mining. Fixed values.
MINING = ("miner", "mining", "cryptomining", "stratum", "xmr", "monero")


def columns_named(df: DataFrame, names: list[str]) -> list[Column]:
    """Columns of ``df`` by case-insensitive names, in the order of ``names``; those that are missing are left out."""
    have = {c.lower(): c for c in reversed(df.columns)}
    return [F.col(f"`{have[n.lower()]}`") for n in names if n.lower() in have]


def normalize(df: DataFrame, schema: T.StructType, pad_nulls: bool = False, mint: str | None = None) -> DataFrame:
    """Columns of ``schema`` in its order and types.

    A column that ``df`` lacks takes the ``padding`` of its field's metadata. One that it has keeps its nulls,
    unless ``pad_nulls``. Text where the schema has an array of numbers is read as a sequence. ``mint`` names an id column: where it is
    missing or blank it gets the hash of the row's identity. Other columns go.
    """
    out = []
    for f in schema.fields:
        pad = F.lit(f.metadata.get("padding")).cast(f.dataType) if not isinstance(f.dataType, T.ArrayType) else F.array().cast(f.dataType)
        if f.name not in df.columns:
            out.append(pad.alias(f.name))
            continue
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.ArrayType) and isinstance(df.schema[f.name].dataType, T.StringType):
            c = parse_sequence(c)
        c = c.cast(f.dataType)
        out.append((F.coalesce(c, pad) if pad_nulls else c).alias(f.name))
    df = df.select(*out)
    if mint is None:
        return df
    return df.withColumn(mint, F.when(strip(F.col(mint)) != "", F.col(mint)).otherwise(row_id({c: F.col(f"`{c}`") for c in df.columns})))


def type_name(header: str) -> str:
    """The logical name of a typed header: its last word in lower case."""
    return header.split()[-1].lower() if header.split() else ""


def benign(category: Column, label: Column) -> Column:
    return (F.lower(F.trim(category)) == "benign") & F.lower(F.trim(label.cast("string"))).isin("0", "0.0", "benign")


def allowed_label(label: Column) -> Column:
    """Is a label present, and free of words about mining?"""
    return F.coalesce((F.trim(label) != "") & ~F.lower(label).rlike("|".join(map(re.escape, MINING))), F.lit(False))


def negative_class(label: Column) -> Column:
    return F.when(F.lower(label).contains("benign"), "benign").otherwise("malware/attack")


def flow_rates(duration: Column, sent: Column, received: Column, packets: Column, packets_back: Column, start: Column) -> dict[str, Column]:
    """Totals, rates over the duration and forward shares of a flow."""
    seconds = F.greatest(duration, F.lit(1e-6))
    total, count = sent + received, packets + packets_back
    return {
        "bytes_total": total, "packets_total": count, "bytes_per_second": total / seconds, "packets_per_second": count / seconds,
        "forward_byte_share": sent / F.greatest(total, F.lit(1)), "forward_packet_share": packets / F.greatest(count, F.lit(1)), "time_last": start + F.greatest(duration, F.lit(0.0)),
    }


#: Columns that give a capture away, and ports, which an ablation leaves out. Fixed values.
LEAKAGE, PORTS = ("time_first", "time_last"), ("src_port", "dst_port")
#: Labels of a flow CSV. Fixed values.
CSV_LABELS = {"Miner": 1, "Other": 0}


def canonical_rows(df: DataFrame, labels: dict[str, int] = CSV_LABELS) -> DataFrame:
    """Rows of a flow CSV of one of ``labels``, with original_label, label, proto, time_first, time_last and duration in canonical form.

    Columns go by their aliases in any case. Protocol 6 is tcp, and so is none. The duration is that between the times where there is an end, else the
    duration column's; without an end the row ends after its duration. Rows of other labels go.
    """

    def pick(*names: str) -> Column:
        found = columns_named(df, [*names])
        return first_present(*found) if found else F.lit(None).cast("string")

    label = strip(F.coalesce(pick("label"), F.lit("")))
    proto = F.lower(F.coalesce(pick("protocol", "proto"), F.lit("tcp")))
    first, last = timestamp_or_zero(pick("time_first", "start_time")), timestamp_or_zero(pick("time_last", "end_time"))
    duration = F.when(last != 0, F.greatest(last - first, F.lit(0.0))).otherwise(float_or_zero(pick("duration")))
    number = F.element_at(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]), label)
    return df.filter(label.isin(*labels)).withColumns({
        "original_label": label, "label": number, "proto": F.when(proto.isin("6", "6.0"), "tcp").otherwise(proto),
        "time_first": first, "time_last": F.when(last != 0, last).otherwise(first + duration), "duration": duration,
    })


def with_constants(df: DataFrame, **values) -> DataFrame:
    """``df`` with the same role, label or provenance in every row."""
    return df.withColumns({k: F.lit(v) for k, v in values.items()})


def decide(score: Column, cut: float = 0.5) -> Column:
    """1 where a score reaches the cut, else 0."""
    return (score >= cut).cast("int")


def feature_sets(schema: T.StructType, exclude: tuple[str, ...] = LEAKAGE) -> dict[str, list[str]]:
    """The four named sets of model features by their groups; sets without a column are left out."""
    of = lambda *groups: [f for g in groups for f in features(schema, {g}, {*exclude})]
    sets = {"flow_only": of("flow"), "flow_timing": of("flow", "timing"), "flow_tls": of("flow", "tls", "certificate"), "flow_timing_tls": of("flow", "timing", "tls", "certificate")}
    return {k: v for k, v in sets.items() if v}


def split_rejects(df: DataFrame, keep: Column, reason: str) -> tuple[DataFrame, DataFrame]:
    """Rows where ``keep`` holds, and the others with a ``reject_reason``; null counts as no."""
    ok = F.coalesce(keep, F.lit(False))
    return df.filter(ok), df.filter(~ok).withColumn("reject_reason", F.lit(reason))


def stem_among(path: Column, stems: DataFrame, df: DataFrame, stem: str = "stem") -> DataFrame:
    """Rows of ``df`` whose file name without folders and suffix is one of ``stems``."""
    return df.withColumn("_stem", file_stem(path)).join(stems.select(F.col(stem).alias("_stem")).distinct(), "_stem", "left_semi").drop("_stem")


def enough_packets(packets: Column, least: int = 3) -> Column:
    """Not between 1 and ``least`` - 1: a flow without a count is kept."""
    return ~((packets > 0) & (packets < least))


def keep_or_all(df: DataFrame, keep: Column) -> DataFrame:
    """Rows where ``keep`` holds; all rows if it holds nowhere."""
    some = df.agg(F.coalesce(F.max(keep.cast("int")), F.lit(0)).alias("_some"))
    return df.join(F.broadcast(some)).filter(F.coalesce(keep, F.lit(False)) | (F.col("_some") == 0)).drop("_some")  # one row


def category_codes(df: DataFrame, column: str) -> DataFrame:
    """``df`` with ``<column>_code``, the index of its text among the sorted distinct ones; null is the text ``None``.

    The distinct values meet in one task, as the codes need one order; the rows don't.
    """
    text = F.coalesce(F.col(column).cast("string"), F.lit("None"))
    codes = df.select(text.alias("_text")).distinct().withColumn(f"{column}_code", (F.row_number().over(Window.orderBy("_text")) - 1).cast("int"))
    return df.withColumn("_text", text).join(codes, "_text").drop("_text")


def numeric(c: Column) -> Column:
    """A float; null, NaN and infinity are 0."""
    x = c.cast("string").try_cast("float")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(0.0).cast("float")).otherwise(x)


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in a total order. Partial maxima go before the shuffle, so a frequent key is no hot task."""
    rest = [c for c in df.columns if c not in keys]
    rows = df.groupBy(*keys).agg(F.min(F.struct(F.struct(*order).alias("o"), F.struct(*rest).alias("r"))).alias("m"))
    return rows.select(*keys, "m.r.*").select(df.columns)


def row_caps(df: DataFrame, order: list, total: int | None = None, per: str | None = None, each: int | None = None) -> DataFrame:
    """The first ``each`` rows of every ``per`` and the first ``total`` of what is left, in a total order."""
    if each is not None:
        df = df.withColumn("_n", F.row_number().over(Window.partitionBy(per).orderBy(*order))).filter(F.col("_n") <= each).drop("_n")
    return df if total is None else df.orderBy(*order).limit(total)


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with ``_n``, its rows' places from 1 in the order of columns. Where the first is a number, ranges of it are numbered apart."""
    first = order[0]
    number = isinstance(df.schema[first].dataType, T.NumericType)
    parted = df.withColumn("_part", F.coalesce(metrics.range_of(F.col(first), metrics.spread(df, [first])[first]), F.lit(-(1 << 30))) if number else F.lit(0))
    sizes = parted.groupBy("_part").agg(F.count("*").alias("_k"))
    before = sizes.select("_part", F.coalesce(F.sum("_k").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row per range
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parted.withColumn("_in", inside).join(F.broadcast(before), "_part").withColumn("_n", F.col("_in") + F.col("_before")).drop("_in", "_before", "_part")


def placeholders(df: DataFrame, name: str, order: list, **constants) -> DataFrame:
    """One row per row of a table that has no mapping: constants and ids ``name:index`` in the order of the columns ``order``.

    Rows are counted by ranges first, so that no task numbers the whole table.
    """
    return numbered(df, order).select((F.col("_n") - 1).alias("_i")).select(F.concat(F.lit(name + ":"), F.col("_i").cast("string")).alias("source_record_id"), *[F.lit(v).alias(k) for k, v in constants.items()])


def canonical_values(df: DataFrame, columns: list[str], padding: dict | None = None) -> DataFrame:
    """``columns`` as canonical text ``<column>_text``: six significant digits for fractions, as C prints them; a missing or unfinite value takes its column's ``padding`` (0 for numbers, else blank).

    Whole numbers and text are cast. Java's formatter rounds ties the other way and keeps zeros, so fractions go through Arrow batches, each distinct value of a batch once.
    """
    def short(values: pa.Array) -> pa.Array:
        codes = pc.dictionary_encode(values)
        each = np.asarray(codes.dictionary, np.float64).tolist()
        return pa.array([f"{v:.6g}" for v in each], pa.string()).take(codes.indices)

    text = {}
    for c in columns:
        kind, pad, at = df.schema[c].dataType, (padding or {}).get(c), F.col(f"`{c}`")
        if isinstance(kind, T.FractionalType):
            known = F.when(F.abs(at.cast("double")) < F.lit(float("inf")), at.cast("double"))
            text[f"{c}_text"] = F.arrow_udf(short, "string")(F.coalesce(known, F.lit(float(pad or 0))))
        else:
            none = F.lit(str(pad if pad is not None else 0 if isinstance(kind, T.NumericType) else ""))
            text[f"{c}_text"] = F.coalesce(F.when(at.cast("string") != "", at.cast("string")), none)
    return df.withColumns(text)


def model_fingerprint(df: DataFrame, columns: list[str], padding: dict | None = None, name: str = "fingerprint") -> DataFrame:
    """``df`` with the hash of the canonical values of ``columns``, by which rows that a model can't tell apart are duplicates."""
    texts = canonical_values(df, columns, padding)
    return texts.withColumn(name, fingerprint({c: F.col(f"`{c}_text`") for c in columns})).drop(*[f"{c}_text" for c in columns])


def features(schema: T.StructType, groups: set[str] | None = None, exclude: set[str] = frozenset()) -> list[str]:
    """Scalar columns that a model may read, by their metadata ``group`` and ``model``."""
    return [f.name for f in schema.fields if f.metadata.get("model") and (groups is None or f.metadata.get("group") in groups) and f.name not in exclude and not isinstance(f.dataType, T.ArrayType)]


def slices(source: Column, has_tls: Column, sequence: Column) -> dict[str, Column]:
    """Reporting slices of a row: by source, TLS, sequence, and all three."""
    a = F.when(has_tls == 1, "tls").otherwise("non_tls")
    b = F.when(sequence == 1, "sequence_available").otherwise("sequence_unavailable")
    return {"source": source, "tls_slice": a, "sequence_slice": b, "source_tls_sequence_slice": F.concat_ws("__", source, a, b)}


def source_role(positive: Column, negative: Column) -> Column:
    return F.when((positive > 0) & (negative == 0), "mining_source").when((negative > 0) & (positive == 0), "non_mining_source").otherwise("mixed_source")
