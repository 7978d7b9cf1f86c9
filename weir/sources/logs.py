"""Log sources: JSON lines or ``#fields`` tables, and labelled connection logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def log_path(spark: SparkSession, folder: str, name: str) -> str | None:
    """``name.log`` in a folder, else its gzipped form, else nothing."""
    for p in (f"{folder}/{name}.log", f"{folder}/{name}.log.gz"):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return p
    return None


def read_log(spark: SparkSession, path: str | None) -> DataFrame:
    """A log as text columns.

    The first line that isn't blank decides: a brace means JSON lines, else the ``#fields`` line names the
    columns; other ``#`` lines go, missing cells are blank, undecodable bytes are replaced. No path gives an empty table.
    """
    if path is None:
        return spark.createDataFrame([], "uid string")
    lines = spark.read.text(path)
    head = lines.filter(F.trim("value") != "").limit(1).collect()
    if not head:
        return spark.createDataFrame([], "uid string")
    if head[0][0].lstrip().startswith("{"):
        return spark.read.option("primitivesAsString", True).json(path)
    named = lines.filter(F.col("value").startswith("#fields")).limit(1).collect()
    if not named:
        raise ValueError(f"{path} names no fields")
    names = named[0][0].split("\t")[1:]
    cells = F.split("value", "\t")
    rows = lines.filter(~F.col("value").startswith("#") & (F.trim("value") != "")).select(cells.alias("c"))
    return rows.select(*[F.coalesce(F.get("c", F.lit(k)), F.lit("")).alias(n) for k, n in enumerate(names)])


def read_labelled_connections(spark: SparkSession, path: str) -> DataFrame:
    """A connection log whose last column glues label fields by two blanks or more; lines of another width go."""
    lines = spark.read.text(path)
    named = lines.filter(F.col("value").startswith("#fields")).limit(1).collect()
    if not named:
        return spark.createDataFrame([], "uid string")
    widen = r"\s{2,}"
    import re

    names = [x for part in named[0][0].split("\t")[1:] for x in re.split(widen, part.strip())]
    cells = F.split(F.regexp_replace("value", r" {2,}", "\t"), "\t")
    rows = lines.filter(~F.col("value").startswith("#")).select(cells.alias("c")).filter(F.size("c") == len(names))
    return rows.select(*[F.trim(F.get("c", F.lit(k))).alias(n) for k, n in enumerate(names)])
