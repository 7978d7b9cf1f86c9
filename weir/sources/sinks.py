"""Sinks: Parquet, scalar CSV, rejects, reports and exports."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns that say where a row came from. Fixed values.
PROVENANCE = ["source", "source_role", "source_file", "source_record_id", "original_label", "extract_status", "quality_notes", "hard_negative_type"]


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("compression", "zstd").parquet(path)


def scalar_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]


def write_scalar_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A gzipped CSV of the scalar columns; missing is blank."""
    df.select(*scalar_columns(df)).write.mode(mode).option("header", True).option("compression", "gzip").option("nullValue", "").option("emptyValue", "").csv(path)


def write_rejects(rejected: DataFrame, root: str, source: str, reason: str) -> None:
    write_parquet(rejected, f"{root}/{source}_{reason}", "overwrite")


def provenance(df: DataFrame, id_col: str = "sample_id", label: str = "label") -> DataFrame:
    """Id, label and provenance columns; those that ``df`` lacks are null."""
    return df.select(id_col, label, *[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in PROVENANCE])


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """One small text file at any path that Spark's file systems know."""
    put_bytes(spark, path, text.encode())


def put_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def to_json(value) -> str:
    return json.dumps(value, sort_keys=True, indent=2, ensure_ascii=False, default=str)


def schema_json(schema: T.StructType) -> str:
    """Columns with their type, group and padding, in order."""
    return to_json({"columns": [{"name": f.name, "type": f.dataType.simpleString(), "group": f.metadata.get("group"), "padding": f.metadata.get("padding")} for f in schema.fields]})


def vocabulary_json(counts: DataFrame) -> str:
    """Values and counts by field, of a vocabulary (field, value, n); a null value is ``null``."""
    out: dict[str, dict] = {}
    for r in counts.collect():  # as long as the vocabulary
        out.setdefault(r["field"], {})["null" if r["value"] is None else r["value"]] = r["n"]
    return to_json(out)


def write_report(df: DataFrame, path: str) -> None:
    """A report as one CSV file in the order of its rows, gzipped where its name says so; missing is blank."""
    import csv
    import gzip
    import io

    text = io.StringIO()
    rows = csv.writer(text, lineterminator="\n")
    rows.writerow(df.columns)
    rows.writerows(["" if v is None else v for v in r] for r in df.collect())
    data = text.getvalue().encode()
    put_bytes(df.sparkSession, path, gzip.compress(data) if path.endswith(".gz") else data)


def schema_document(schema: T.StructType) -> str:
    """A Markdown table of a schema's columns."""
    rows = [f"| {f.name} | {f.dataType.simpleString()} | {f.metadata.get('group', '')} | {f.metadata.get('padding', '')} |" for f in schema.fields]
    return "\n".join(["| name | type | group | padding |", "|---|---|---|---|", *rows])


def report(title: str, figures: dict) -> str:
    """A Markdown report of named figures."""
    return "\n".join([f"# {title}", "", *[f"- {k}: {v}" for k, v in sorted(figures.items())], ""])


def read_through(spark: SparkSession, path: str, build: Callable[[], DataFrame], rebuild: bool = False) -> DataFrame:
    """A table that is built and written on first use or on demand, and read from then on."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if rebuild or not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        write_parquet(build(), path, "overwrite")
    return spark.read.parquet(path)


def metric_template(spark: SparkSession, names: list[str]) -> DataFrame:
    """A table of no rows under the metrics' names."""
    return spark.createDataFrame([], ", ".join(f"{n} double" for n in names))


def ablation_table(df: DataFrame, id_col: str, label: str, features: list[str]) -> DataFrame:
    return df.select(id_col, label, *[c for c in features if c in df.columns])
