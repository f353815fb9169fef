"""Documents in: scan, address, route, deduplicate, requeue, drift, piles.

Tables are keyed by pile; an id is a hash of its natural key, so that every run
gives the same ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from accordant.functions import text as X

SHIPPED_TO = "\f"


def scan(spark: SparkSession, folder: str, patterns: str = "*") -> DataFrame:
    """All files of a folder: path, name, content, modificationTime, length."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", patterns).option("recursiveFileLookup", "true").load(folder)
    return files.withColumn("name", F.element_at(F.split("path", "/"), -1))


def addressed(files: DataFrame, content: str = "content") -> DataFrame:
    return files.withColumn("content_sha256", F.sha2(F.col(content).cast("binary"), 256)).withColumn("byte_size", F.octet_length(F.col(content)).cast("long"))


def routed(files: DataFrame, name: str = "name", content: str = "content") -> DataFrame:
    """format, status (ingested, unsupported, empty) and a note; nothing is dropped."""
    fmt = X.detected_format(F.col(name), F.col(content).cast("binary"))
    out = files.withColumn("format", fmt).withColumn("text", F.when(F.col("format").isin(*X.READABLE), X.decoded(F.col(content).cast("binary"))))
    out = out.withColumn("text", F.when(F.col("format") == "html", X.html_to_text(F.col("text"))).otherwise(F.col("text")))
    blank = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")) == ""
    status = F.when(F.col("format").isNull() | ~F.col("format").isin(*X.READABLE), "unsupported").when(blank, "empty").otherwise("ingested")
    note = F.when(F.col("format").isNull(), F.concat(F.lit("unknown extension "), X.extension(F.col(name)))).when(~F.col("format").isin(*X.READABLE), F.concat(F.lit("no reader for "), F.col("format"))).when(
        blank, "no text in the file"
    )
    return out.withColumn("status", status).withColumn("ingest_note", note)


def pages(documents: DataFrame, text: str = "text", separator: str = SHIPPED_TO) -> DataFrame:
    """One row per non-blank page with its number and stripped text."""
    cut = documents.select("*", F.posexplode(F.split(text, separator)).alias("at", "page")).withColumn("page_no", F.col("at") + 1)
    return cut.withColumn("page", F.regexp_replace("page", r"^\s+|\s+$", "")).where("page <> ''").drop("at")


def deduplicated(arrivals: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """arrivals: pile_id, document_id, content_sha256. Adds outcome and original_id.

    The first id of each content in a pile wins; a content that the pile has
    already is a duplicate of what is there.
    """
    first = arrivals.groupBy("pile_id", "content_sha256").agg(F.min("document_id").alias("winner"))
    if known is not None:
        held = known.groupBy("pile_id", "content_sha256").agg(F.min("document_id").alias("held"))
        first = first.join(held, ["pile_id", "content_sha256"], "left").withColumn("winner", F.coalesce("held", "winner")).drop("held")
    both = arrivals.join(first, ["pile_id", "content_sha256"])
    return both.withColumn("outcome", F.when(F.col("document_id") == F.col("winner"), "ingested").otherwise("duplicate")).withColumnRenamed("winner", "original_id")


def unread(documents: DataFrame, arrivals: DataFrame) -> DataFrame:
    """Ids to work on: new ones, and those known that still wait."""
    waiting = documents.where("status = 'ingested'").select("pile_id", "document_id")
    again = arrivals.select("pile_id", "document_id").join(waiting, ["pile_id", "document_id"], "left_semi").withColumn("why", F.lit("waiting"))
    new = arrivals.select("pile_id", "document_id").join(documents.select("pile_id", "document_id"), ["pile_id", "document_id"], "left_anti").withColumn("why", F.lit("new"))
    return new.unionByName(again)


def listing(files: DataFrame, folder: str = "folder", name: str = "name") -> DataFrame:
    """Per folder: files, readable, unsupported; from names alone."""
    readable = F.coalesce(X.detected_format(F.col(name)).isin(*X.READABLE), F.lit(False))
    return files.groupBy(folder).agg(F.count("*").alias("files"), F.count_if(readable).alias("readable"), F.count_if(~readable).alias("refused"))


def drift(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """document_id and same, changed, missing or unrecorded."""
    r, c = recorded.select("document_id", F.col("content_sha256").alias("then")), current.select("document_id", F.col("content_sha256").alias("now"))
    state = F.when(F.col("then").isNull(), "unrecorded").when(F.col("now").isNull(), "missing").when(F.col("then") == F.col("now"), "same").otherwise("changed")
    return r.join(c, "document_id", "full_outer").select("document_id", state.alias("state"))


def ensured_piles(names: DataFrame, existing: DataFrame) -> DataFrame:
    """existing (pile_id, name) and one row for each further name."""
    new = names.select("name").distinct().join(existing.select("name"), "name", "left_anti")
    return existing.select("pile_id", "name").unionByName(new.select(F.sha2("name", 256).alias("pile_id"), "name"))


def undeclared(facts: DataFrame, schemas: dict) -> DataFrame:
    """Fields that facts state and their document's type does not declare, with counts: must be empty."""
    spark = facts.sparkSession
    declared = spark.createDataFrame([(t, f) for t, fs in schemas.items() for f in fs], "doc_type string, field string")
    used = facts.groupBy("doc_type", "field").agg(F.count("*").alias("n"))
    return used.join(F.broadcast(declared), ["doc_type", "field"], "left_anti")  # as many rows as the domain declares


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    return rows.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where("r = 1").drop("r")
