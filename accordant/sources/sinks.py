"""Tables and documents out."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fresh_folder(spark: SparkSession) -> str:
    """A new folder's name in the cluster's shared one (spark.checkpoint.dir); a local session that names none gets a new one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="accordant-"))
    return f"{context.getCheckpointDir()}/{uuid.uuid4().hex}"


def stored(rows: DataFrame) -> DataFrame:
    """The rows written once as Parquet to the shared folder and read again, for work that takes them several times."""
    path = fresh_folder(rows.sparkSession)
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def replace_piles(rows: DataFrame, path: str) -> None:
    """Parquet, one folder per pile; the piles that rows has are replaced, all others stay, so that a write that is repeated changes nothing."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("pile_id").parquet(path)


def write_bucketed(rows: DataFrame, name: str, buckets: int = 64, keys: tuple[str, ...] = ("pile_id", "document")) -> None:
    """A table dealt and sorted by the keys: tables of one number of buckets join on the keys without a shuffle."""
    rows.repartition(buckets, *keys).write.mode("overwrite").format("parquet").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)


def write_table(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet, one folder per pile, so that a read of one pile prunes the rest."""
    rows.repartition("pile_id").write.mode(mode).partitionBy("pile_id").parquet(path)


def write_lines(lines: DataFrame, path: str) -> None:
    """lines (pile_id, section_key, at, line) as text files, one folder per pile, whose files in the order of their names have the lines in theirs; no text of a section is put together."""
    dealt = lines.repartitionByRange("pile_id", "section_key", "at").sortWithinPartitions("pile_id", "section_key", "at")
    dealt.select("pile_id", F.col("line").alias("value")).write.partitionBy("pile_id").text(path)


def rendered(sections: DataFrame, title: str = "Register") -> DataFrame:
    """pile_id, version, body: the register as one text per pile and version."""
    part = F.struct("ordinal", F.concat(F.lit("## "), F.col("heading"), F.lit("\n\n"), F.col("body")).alias("part"))
    ordered = F.transform(F.array_sort(F.collect_list(part)), lambda x: x["part"])
    return sections.groupBy("pile_id", "version").agg(F.concat(F.lit(f"# {title}\n\n"), F.array_join(ordered, "\n\n")).alias("body"))


def write_markdown(sections: DataFrame, path: str, title: str = "Register") -> None:
    rendered(sections, title).select("pile_id", "body").write.partitionBy("pile_id").text(path)
