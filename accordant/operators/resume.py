"""Runs that go on where they were stopped: a ledger of finished stages, and answers kept chunk by chunk.

A stage is known by its name, its version and what it reads: its fingerprint is a
digest of those, and the next stage's input is its output's fingerprint.  A stage
writes its rows to a folder of its own; only then is a row appended to the ledger,
so that a folder without a row is as none, and a run that is started again skips what
the ledger has and does the rest.  Two runs that finish one stage at once leave two
rows, of which the first by path holds for all readers.

All of it is Parquet in shared storage; the driver holds a row per stage.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEDGER = "run_id string, stage string, fingerprint string, path string, n_rows long, content string"


@dataclass(frozen=True)
class Stage:
    """work: from the rows before it to its own; change version with what it does."""

    name: str
    work: Callable[[DataFrame], DataFrame]
    version: str = "1"


def content(rows: DataFrame) -> tuple[int, str]:
    """How many rows, and a digest of them that no order changes; one aggregation, combined before the shuffle.

    Equal rows count as often as they are there; columns count by name, in any order.
    """
    names = sorted(rows.columns)
    as_text = F.to_json(F.struct(*[F.col(f"`{n}`").alias(n) for n in names]), {"ignoreNullFields": "false"})
    wide = lambda seed: F.sum(F.xxhash64(as_text, F.lit(seed)).cast("decimal(20,0)"))
    n, a, b = rows.agg(F.count("*"), wide(1), wide(2)).first()
    return n, hashlib.sha256(f"{names}|{n}|{a}|{b}".encode()).hexdigest()


def read_ledger(spark: SparkSession, folder: str) -> DataFrame:
    try:
        return spark.read.schema(LEDGER).parquet(f"{folder}/ledger")
    except Exception as error:  # nothing is finished yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], LEDGER)


def run(rows: DataFrame, stages: list[Stage], folder: str, run_id: str, reads: str | None = None) -> DataFrame:
    """What the stages make of rows, each one written; finished ones are read instead of done.

    reads: a name for the content of rows where the caller knows one, such as a
    table's version; otherwise the rows are read once for their digest.
    """
    spark = rows.sparkSession
    reads = reads or content(rows)[1]
    for stage in stages:
        key = hashlib.sha256(f"{stage.name}|{stage.version}|{reads}".encode()).hexdigest()
        mine = (F.col("run_id") == run_id) & (F.col("stage") == stage.name) & (F.col("fingerprint") == key)
        done = read_ledger(spark, folder).where(mine).orderBy("path").first()
        if done is None:
            path = f"{folder}/{stage.name}-{uuid.uuid4().hex}"
            stage.work(rows).write.parquet(path)
            n, made = content(spark.read.parquet(path))
            spark.createDataFrame([(run_id, stage.name, key, path, n, made)], LEDGER).coalesce(1).write.mode("append").parquet(f"{folder}/ledger")
            done = read_ledger(spark, folder).where(mine).orderBy("path").first()
        rows, reads = spark.read.parquet(done.path), done.content
    return rows


def progress(spark: SparkSession, folder: str, run_id: str) -> DataFrame:
    """stage, n_rows, content of the finished stages of a run, each once."""
    own = read_ledger(spark, folder).where(F.col("run_id") == run_id)
    return own.groupBy("stage", "fingerprint").agg(F.min_by(F.struct("n_rows", "content"), "path").alias("x")).select("stage", "fingerprint", "x.*")


def answered(prompts: DataFrame, ask: Callable[[DataFrame], DataFrame], folder: str, chunk: int = 10_000) -> DataFrame:
    """call_key and the answer's columns for all prompts, of which no more than a chunk is ever asked twice.

    prompts: call_key and what ``ask`` reads; ask gives call_key and the answer, for
    example ``answers.ask`` over a model.  Equal keys are asked once.  What the
    folder's answers lack is dealt into chunks of about so many keys; a chunk is one
    append, which is there as a whole or not at all, and before each one the keys that
    have come meanwhile are left out.  A key that got two answers has one of them, the
    same for every reader.
    """
    spark, path = prompts.sparkSession, f"{folder}/answers"

    def held() -> DataFrame | None:
        try:
            return spark.read.parquet(path)
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
                raise
            return None

    once = prompts.dropDuplicates(["call_key"])
    before = held()
    open_ = once if before is None else once.join(before.select("call_key"), "call_key", "left_anti")
    chunks = max(1, math.ceil(open_.count() / chunk))
    due = f"{folder}/due-{uuid.uuid4().hex}"
    open_.withColumn("chunk", F.pmod(F.xxhash64("call_key"), F.lit(chunks)).cast("int")).write.partitionBy("chunk").parquet(due)
    dealt = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in open_.schema.fields)}, chunk int").parquet(due)
    for k in range(chunks):
        part, now = dealt.where(F.col("chunk") == k).drop("chunk"), held()
        if now is not None:
            part = part.join(now.select("call_key"), "call_key", "left_anti")
        ask(part).write.mode("append").parquet(path)
    found = spark.read.parquet(path)
    rest = [c for c in found.columns if c != "call_key"]
    one = found.groupBy("call_key").agg(F.min(F.struct(*rest)).alias("a")).select("call_key", "a.*")
    return one.join(prompts.select("call_key").distinct(), "call_key", "left_semi")
