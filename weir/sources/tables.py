"""Table sources: dispatch by suffix, typed headers, label files, manifests.

All go through Spark's readers, so any store that Spark knows will do; files are split by size, not by row chunks.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.functions.scalars import strip
from weir.operators.shaping import type_name

#: Columns of a label file without a header. Fixed values.
LABEL_COLUMNS = ["id", "timestamp", "mining_device_config", "is_complete", "encrypted", "hash_rate_1", "hash_rate_2", "hash_rate_3", "submission_number", "coin_type", "mining_software", "algo", "whether_cryptojacking", "length"]

#: Bytes of a file that a task may hold as one cell; longer files are read as streams, by blocks of BLOCK.
CELL = 64 << 20
BLOCK = 1 << 20


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet or CSV (also gzipped) table by its suffix; CSV columns are text."""
    low = path.lower()
    if low.endswith((".parquet", ".pq")):
        return spark.read.parquet(path)
    if low.endswith((".csv", ".csv.gz")):
        return spark.read.option("header", True).csv(path)
    raise ValueError(f"no reader for {path}")


def read_typed_csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A CSV whose headers are ``type NAME``, under its logical names; ``columns`` prunes the scan."""
    df = spark.read.option("header", True).csv(path)
    df = df.toDF(*[type_name(c) for c in df.columns])
    return df if columns is None else df.select(*[c for c in columns if c in df.columns])


def read_label_rows(spark: SparkSession, path: str) -> DataFrame:
    """A label CSV with or without a header line (one that starts with ``id`` or ``pcap_id``)."""
    first = spark.read.text(path).limit(1).collect()
    names = [x.strip() for x in first[0][0].split(",")] if first else []
    if names and names[0].lower() in ("id", "pcap_id"):
        return spark.read.option("header", True).csv(path)
    return spark.read.schema(", ".join(f"{c} string" for c in LABEL_COLUMNS)).csv(path)


def encrypted_flag(value: Column) -> Column:
    return F.when(F.lower(strip(value)).isin("yes", "1", "true"), "yes").otherwise("no")


def file_type(path: Column) -> Column:
    """Kind of a file by its suffixes; CSV is tested before archives, so a zipped CSV is CSV. Any other suffix is a kind of its own, and a name without one is ``unknown``."""
    name = F.regexp_replace(F.regexp_extract(F.lower(path), r"([^/]*)/*$", 1), r"^\.+", "")
    last = F.regexp_extract(name, r"\.([^.]+)$", 1)
    return (
        F.when(name.rlike(r"\.(pcap|pcapng|cap)$"), "pcap").when(name.rlike(r"\.csv(\.gz|\.zip)?$"), "csv").when(name.rlike(r"\.(parquet|pq)$"), "parquet")
        .when(name.rlike(r"\.(log|log\.gz|labeled)$"), "zeek_log").when(name.rlike(r"\.(tar\.gz|tgz|zip|7z)$"), "archive").when(last != "", last).otherwise("unknown")
    )


def source_for(path: Column, known: list[str]) -> Column:
    """The first path segment that is a known source, else ``unknown``."""
    return F.coalesce(F.get(F.filter(F.split(path, "/"), lambda s: s.isin(*known)), F.lit(0)), F.lit("unknown"))


def list_files(spark: SparkSession, root: str, pattern: str = "*", contains: list[str] | None = None) -> DataFrame:
    """(path, length) of files below ``root`` whose name matches a glob, without partial downloads; ``contains`` asks for one of some path parts."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("ignoreCorruptFiles", True).load(root)
    df = df.select("path", "length").filter(~F.col("path").endswith(".aria2"))
    if contains:
        df = df.filter(reduce(lambda a, b: a | b, [F.lower("path").contains(c.lower()) for c in contains]))
    return df.orderBy("path")


def partial_files(spark: SparkSession, root: str) -> DataFrame:
    """(path) of the companions of partial downloads below ``root``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.aria2").load(root).select("path")


def read_metadata(spark: SparkSession, path: str, flag: str) -> DataFrame:
    """Rows of a CSV, gzipped or not, whose column ``flag``, in any case, says yes or no in one spelling."""
    rows = read_table(spark, path)
    named = [c for c in rows.columns if c.lower() == flag.lower()]
    value = F.col(f"`{named[0]}`") if named else F.lit(None).cast("string")
    return rows.select(*[F.col(f"`{c}`") for c in rows.columns if c not in named], encrypted_flag(value).alias(flag))


def file_manifest(spark: SparkSession, root: str, known: list[str], licenses: dict[str, str]) -> DataFrame:
    """(path, size_bytes, sha256, file_type, source, license) of files below ``root``. Files of up to ``CELL`` bytes are read by tasks; of longer ones the driver's JVM reads a stream, some at a time."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).filter(~F.col("path").endswith(".aria2"))
    long = [tuple(r) for r in df.filter(F.col("length") > CELL).select("path", "length").collect()]
    rows = df.filter(F.col("length") <= CELL).select("path", "length", F.sha2("content", 256).alias("sha256"))
    if long:
        with ThreadPoolExecutor(4) as pool:
            sums = list(pool.map(lambda r: _checksum(spark, r[0]), long))
        rows = rows.unionByName(spark.createDataFrame([(*r, x) for r, x in zip(long, sums)], "path string, length long, sha256 string"))
    source = source_for(F.col("path"), known)
    pairs = [F.lit(x) for kv in licenses.items() for x in kv]
    license_ = F.coalesce(F.element_at(F.create_map(*pairs), source), F.lit("unknown")) if pairs else F.lit("unknown")
    return rows.select("path", F.col("length").alias("size_bytes"), "sha256", file_type(F.col("path")).alias("file_type"), source.alias("source"), license_.alias("license")).orderBy("path")


def _checksum(spark: SparkSession, path: str) -> str:
    """SHA-256 of a file in any store that Spark knows, by a stream."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).open(at, BLOCK)
    try:
        return jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
    finally:
        stream.close()


def complete_captures(files: DataFrame, partial: DataFrame) -> DataFrame:
    """Paths without a partial-download companion."""
    stems = partial.select(F.regexp_replace("path", r"\.aria2$", "").alias("path"))
    return files.join(stems, "path", "left_anti").select("path").distinct()


def side_file(spark: SparkSession, root: str) -> DataFrame:
    """(dir, source_file): the one line of each ``source_file.txt`` below ``root``."""
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "source_file.txt").option("wholetext", True).text(root)
    path = F.url_decode(F.regexp_replace(F.input_file_name(), r"\+", "%2B"))  # blanks and the like are coded in it
    return df.select(F.regexp_extract(path, r"([^/]+)/[^/]*$", 1).alias("dir"), strip(F.col("value")).alias("source_file"))


def with_source_file(rows: DataFrame, sides: DataFrame) -> DataFrame:
    """Rows (dir) with their directory's source file, or the directory's name."""
    return rows.join(sides, "dir", "left").withColumn("source_file", F.coalesce("source_file", "dir"))


def load_packet_rows(spark: SparkSession, root: str) -> DataFrame:
    """All packet-flow files of a source; a join by flow key takes the place of an in-memory index."""
    return spark.read.option("recursiveFileLookup", True).parquet(root)


def config(text: str) -> dict:
    """A JSON or YAML document; YAML only where its library is installed."""
    import json

    try:
        return json.loads(text)
    except json.JSONDecodeError:
        import yaml

        return yaml.safe_load(text)
