"""The corpus pipeline: language ID, near-dedup, decontamination, PII, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's docs. All but the last return the columns
of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.llm._memory import shrink
from weir.llm._scratch import Scratch
from weir.llm.bpe import encode, public_vocabulary
from weir.llm.decontam import contamination
from weir.llm.langid import UNKNOWN, fold, identify, learn
from weir.llm.near_dedup import near_groups
from weir.llm.pii import replace_entities

#: SQL has none of the learned and keyed stages; the tests hold each stage's operator against brute force or held-out rows, and the stages against rules on rows of their own.
ORACLE_SQL = None

#: Bytes of dropped keys up to which they go to all tasks, which leaves texts where they are; beyond, both sides are shuffled.
BROADCAST = 32 << 20


def _keyed(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` with ``_key``: the id where it names one row; else, for null and repeated ids, a hash of id and text beyond usual ids, so that only rows that repeat both share it."""
    odd = F.xxhash64("doc_id", "text").bitwiseAND((1 << 62) - 1).bitwiseOR(1 << 62)
    ids = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("_n")).filter("_n > 1")
    ids = Scratch(spark, "repeated").write(ids, "ids")
    if ids.isEmpty():
        return docs.withColumn("_key", F.coalesce("doc_id", odd))
    return docs.join(ids, "doc_id", "left").withColumn("_key", F.when(F.col("doc_id").isNull() | F.col("_n").isNotNull(), odd).otherwise(F.col("doc_id"))).drop("_n")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows in no known language (null, without letters) and sets ``lang`` to the predicted one, row by row."""
    model = learn(docs.filter(fold() != 1))
    # a row's columns go along as its id, so null and repeated ids are no matter
    found = identify(docs.select(F.struct(*docs.columns).alias("_row"), "text"), model, id_col="_row").filter(F.col("lang") != UNKNOWN)
    return found.select(*[F.col("lang") if c == "lang" else F.col(f"id.{c}").alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the least id of each group of near duplicates, over five-word shingles at 0.8. Rows that repeat id and text stay once; other texts of an id, and rows without one, are documents of their own."""
    shrink(spark)  # of what the stage before took
    keyed = _keyed(spark, docs)
    near = Scratch(spark, "near")
    # rows of one key have one text and so one fate; few keys are dropped or repeat
    odd = near_groups(keyed.select(F.col("_key").alias("doc_id"), "text"), width=5, percent=80, scratch=near)
    odd = odd.groupBy(F.col("id").alias("_key")).agg(F.count("*").alias("n"), F.bool_and("kept").alias("kept")).filter("n > 1 or not kept")
    odd = Scratch(spark, "odd").write(odd, "odd")
    near.close()  # all that it said stands in ``odd``
    small = 16 * odd.count() <= BROADCAST
    known = lambda rows: F.broadcast(rows.select("_key")) if small else rows.select("_key")
    once = keyed.join(known(odd), "_key", "left_anti")
    more = keyed.join(known(odd.filter("kept")), "_key", "left_semi").dropDuplicates(["_key"])
    return once.unionByName(more).select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops contaminated rows."""
    shrink(spark)  # of what the stage before took
    keyed = _keyed(spark, docs)
    bad = contamination(keyed.select(F.col("_key").alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).filter("contaminated").select(F.col("id").alias("_key")).distinct()
    return keyed.join(bad, "_key", "left_anti").select(docs.columns)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts surrogates for personal data into every text; ``n_chars`` follows."""
    shrink(spark)  # of what the stage before took
    out = replace_entities(docs, spark.conf.get("weir.pii.key", "weir-demonstration-key"))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256) of every document."""
    shrink(spark)  # of what the stage before took
    out = encode(docs, public_vocabulary(), keep_ids=True)
    return out.select(F.col("id").alias("doc_id"), "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("private_data", private_data), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
