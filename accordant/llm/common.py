"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that one Arrow batch handed back to Spark holds at most, so that a
#: worker's memory does not follow the size of a partition.
ROWS_OUT = 512


def shared_folder(spark: SparkSession) -> None:
    """Make checkpoints possible: in the cluster's own folder; a local session without one gets a new folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="accordant-"))


def settled(df: DataFrame) -> DataFrame:
    """Cut lineage in the shared folder; an executor lost later costs nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The rows written as Parquet to the shared folder and read again."""
    spark = df.sparkSession
    shared_folder(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def text_of(name: str) -> Column:
    """The text column, null read as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def rows_in_slices(batch, rows: int = ROWS_OUT):
    """An Arrow batch in slices of few rows."""
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def hash_order(name: str, seed: int = 11) -> Column:
    """A fixed pseudo-random order of ids, for bounded samples of labelled rows."""
    return F.xxhash64(F.col(name), F.lit(seed))


def fitting(lengths: list[int], most: int) -> list[int]:
    """Places of the lengths that fit, taken in order."""
    out, held = [], 0
    for i, n in enumerate(lengths):
        if held + n <= most:
            out.append(i)
            held += n
    return out
