"""A corpus through five operators: quality, near copies, benchmarks, secrets, pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortveil.llm import decontaminate, near_dedup, pieces, quality_rules, secrets
from cohortveil.llm.batches import stored
from cohortveil.llm.queries import piece_model

#: The columns that every stage but the last takes and returns.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def documents(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def digest(*names: str) -> Column:
    """128 bits of columns' values, nulls apart from all others."""
    return F.unhex(F.md5(F.concat_ws("|", *(F.coalesce(F.md5(F.col(c).cast("string")), F.lit("")) for c in names))))


def row_key() -> Column:
    """A number for an id with its text; two documents may share it by chance."""
    return F.xxhash64("doc_id", "text")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; a null text goes, since it has too few words.

    A row is judged by all that its verdict depends on: its text, language and source.
    """
    own = documents(docs).withColumn("row_key", digest("doc_id", "text", "lang", "source"))
    judged = quality_rules.judge(own.select(F.col("row_key").alias("doc_id"), "text", "lang", "source"))
    kept = judged.where("kept").select(F.col("doc_id").alias("row_key"))
    return documents(own.join(kept, "row_key", "left_semi"))


def single_rows(own: DataFrame) -> DataFrame:
    """One row of each id and text, with row_key, which no other document has: of those that share one, all but the first get another."""
    twice = stored(own.groupBy("row_key").agg(F.count("*").alias("times")).where("times > 1").select("row_key"))
    again = own.join(twice, "row_key", "left_semi").groupBy("row_key", digest("doc_id", "text").alias("other")).agg(F.min(F.struct(*COLUMNS)).alias("least"))
    nth = F.row_number().over(Window.partitionBy("row_key").orderBy("other"))
    again = again.withColumn("nth", nth).select("least.*", F.when(F.col("nth") == 1, F.col("row_key")).otherwise(F.xxhash64("row_key", "nth")).alias("row_key"))
    return own.join(twice, "row_key", "left_anti").select(*COLUMNS, "row_key").unionByName(again)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that with the smallest id.

    A document is an id with its text: rows that repeat an id with another
    text, or have none, are documents of their own.  A missing id is smaller
    than the others; of equal ids, the text's hash decides.
    """
    own = single_rows(documents(docs).withColumn("row_key", row_key()))
    groups = near_dedup.near_groups(own.select(F.col("row_key").alias("doc_id"), "text")).select(F.col("doc_id").alias("row_key"), "component_id")
    least = own.select("row_key", "doc_id").join(groups, "row_key").groupBy("component_id").agg(F.min(F.struct("doc_id", "row_key")).alias("least")).select("least.row_key")
    return documents(own.join(least, "row_key", "left_semi"))


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark items don't contaminate; the others' texts are left as they are."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.decontaminate(docs, items, carry=("text", "lang", "source", "n_chars"))
    return documents(found.where("NOT contaminated"))


def masked_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; each secret in a text becomes [SECRET], and n_chars follows."""
    found = secrets.scan_secrets(docs, with_text=True, carry=("text", "lang", "source", "n_chars"))
    changed = F.col("spans") != ""
    return found.select(
        "doc_id", F.when(changed, F.col("clean_text")).otherwise(F.col("text")).alias("text"), "lang", "source",
        F.when(changed, F.length("clean_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"),
    )


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's piece ids, as digests, and how its decoding compares."""
    return pieces.encode_pieces(docs, piece_model())


STAGES = [
    ("quality rules", quality),
    ("MinHash near-dedup", near_copies),
    ("benchmark decontamination", benchmarks),
    ("secret scans", masked_secrets),
    ("SentencePiece encoding and decoding", encoded),
]

#: Near copies, agendas and robust estimates have no SQL; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, on documents."""
    out = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        out = stage(spark, out, sf_dir)
    return out
