"""Intermediate tables in the folder that all executors share.

A written Parquet table cuts lineage as ``checkpoint()`` does, survives the loss
of any executor, and keeps its columns prunable, so iterative operators here use
tables rather than checkpointed RDDs.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from weir.llm._memory import tidy

_OPEN: list["Scratch"] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; on a local master without one, a temporary folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="weir-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


class Scratch:
    """A folder of written tables; ``drop`` frees one early, the rest go at exit."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/weir-{label}-{uuid.uuid4().hex}"
        self.n = 0
        _OPEN.append(self)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return the table as read back, with the path on ``.weir_path``."""
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.weir_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            _delete(self.spark, t.weir_path)

    def close(self) -> None:
        _delete(self.spark, self.root)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _close_all() -> None:
    for s in _OPEN:
        if s.spark.sparkContext._jsc is not None:
            try:
                s.close()
            except Exception:  # the JVM may be gone before Python is
                return


_SHIPPED: set[str] = set()
#: Bytes of a batch that goes to a Python worker, of which it and the JVM hold some copies; set where the session has Spark's own value.
BATCH, _OWN = "8m", ("64m", "67108864", "67108864b")


def ship(spark: SparkSession) -> None:
    """Give executors this package, for clusters whose Python path lacks it, and bound the batches that they get."""
    sc = spark.sparkContext
    if str(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", "64m")).lower() in _OWN:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    top = Path(__file__).resolve().parents[1]
    at = Path(tempfile.mkdtemp(prefix="weir-ship-")) / "weir.zip"
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(str(at))


def arrow_map(df: DataFrame, function, schema) -> DataFrame:
    """``mapInArrow`` with this package at hand on the executors."""
    ship(df.sparkSession)
    return df.mapInArrow(tidy(function), schema)
