"""Helpers shared by the operators: Arrow batches of texts and tables between jobs."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null doc_id where ids are compared: it sorts before all others.
NO_ID = -(2**63)


def as_bytes(column: pa.Array) -> list[bytes]:
    """The values of a string column as UTF-8 bytes; null becomes b''."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def as_text(column: pa.Array) -> list[str]:
    """The values of a string column; null becomes '', broken UTF-8 U+FFFD."""
    try:
        return [x or "" for x in column.to_pylist()]
    except UnicodeDecodeError:
        return [x.decode("utf-8", "replace") for x in as_bytes(column)]


def map_batches(df: DataFrame, work: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with a set-up: `work` runs once a task and returns the function for its batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = work()
        for batch in batches:
            if batch.num_rows:
                yield step(batch)

    return df.mapInArrow(run, schema)


def document_texts(docs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id and text, and as carried_0.. the columns to carry along, whatever other columns there are."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(F.col(c).alias(f"carried_{k}") for k, c in enumerate(carry)))


def map_texts(docs: DataFrame, carry: Sequence[str], work: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str) -> DataFrame:
    """map_batches over document_texts; carried columns come last, under their names in docs."""
    own = document_texts(docs, carry)
    extra = [f"carried_{k}" for k in range(len(carry))]

    def both():
        step = work()

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = step(batch)
            return pa.RecordBatch.from_arrays([*out.columns, *(batch.column(c) for c in extra)], [*out.schema.names, *extra])

        return run

    full = ", ".join([schema, *(f"{c} {own.schema[c].dataType.simpleString()}" for c in extra)])
    return map_batches(own, both, full).withColumnsRenamed(dict(zip(extra, carry, strict=True)))


def scratch_dir(spark: SparkSession) -> str:
    """A new path in the folder that the cluster shares, `spark.checkpoint.dir`.

    Where that isn't set, the warehouse takes its place on a single machine, as
    in tests; on a cluster it might be a folder that only the driver sees.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = f"{spark.conf.get('spark.sql.warehouse.dir')}/scratch"
    return f"{shared.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back, which cuts its lineage."""
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
