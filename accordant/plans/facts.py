"""The fact table that orders, customers and line items stand for, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from accordant.functions.agreement import precedence_of
from accordant.functions.normalize import with_value
from accordant.sources.sinks import stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per order: pile_id, document, doc_type, entity_key, status, day, o_orderkey."""
    t = lambda n: table(spark, sf_dir, n)
    regions = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("pile_id"))
    customers = t("customer").join(F.broadcast(regions), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "pile_id")  # as many nations as there are
    kind = F.substring("o_orderpriority", 1, 1)
    doc_type = F.when(kind == "1", "amendment").when(kind == "2", "msa").when(kind == "3", "sow").when(kind == "4", "notice").otherwise("invoice")
    orders = t("orders").select(
        "o_orderkey", "o_custkey", doc_type.alias("doc_type"), F.to_date("o_orderdate").alias("day"), F.when(F.col("o_orderstatus") == "P", "quarantined").otherwise("classified").alias("status")
    )
    entity = F.concat(F.lit("engagement:customer-"), F.col("o_custkey").cast("string"), F.lit("-"), F.year("day").cast("string"))
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        "pile_id", F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("document"), "doc_type", entity.alias("entity_key"), "status", "day", "o_orderkey"
    )


def ranked_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by order, in as many parts as shuffles have: a number that is given is not coalesced, as parts joined up to the advisory size are several times as large in the sorts of their task."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").repartition(parts, "l_orderkey").withColumn("rn", F.row_number().over(order))


def facts(spark: SparkSession, sf_dir: str, with_quarantined: bool = False) -> DataFrame:
    """The long fact table: one span per fact, value_raw as a document would state it.

    Documents meet their lines once; what a document itself states goes with its
    first line, or with the row of a document without lines, so that it is dealt over
    as many tasks as the lines.
    """
    docs = documents_of_orders(spark, sf_dir)
    if not with_quarantined:
        docs = docs.where("status <> 'quarantined'")
    is_ = lambda *kinds: F.col("doc_type").isin(*kinds)

    def stated(when, field, kind, raw, at):
        return F.when(when, F.struct(F.lit(field).alias("field"), F.lit(kind).alias("value_type"), raw.alias("value_raw"), at.cast("int").alias("char_start")))

    day, at = F.col("day").cast("string"), F.lit
    first, here = F.col("rn") == 1, 100 * F.col("rn")
    whole = first | F.col("rn").isNull()
    every = F.array(
        stated(is_("sow") & whole, "hours_cap", "number", F.lit("100"), at(10)),
        stated(is_("msa", "amendment") & whole, "effective_date", "date", day, at(20)),
        stated(is_("msa") & whole, "term_months", "number", F.lit("6"), at(30)),
        stated(is_("invoice") & whole, "invoice_date", "date", day, at(40)),
        stated(is_("notice") & whole, "notice_period_days", "number", F.concat((30 + 30 * (F.col("o_orderkey") % 3)).cast("string"), F.lit(" days")), at(50)),
        stated(is_("msa") & whole, "termination_notice_days", "number", F.lit("60 days"), at(60)),
        stated(is_("msa") & (F.col("o_orderkey") % 2 == 0) & whole, "liability_cap", "money", F.lit("USD 250,000"), at(70)),
        stated(is_("msa", "amendment", "invoice") & first, "hourly_rate", "money", F.concat(F.lit("USD "), (100 + 5 * (F.col("l_partkey") % 2)).cast("string")), here),
        stated(is_("msa", "invoice") & first, "payment_terms_days", "number", F.concat((30 + 15 * (F.col("l_suppkey") % 2)).cast("string"), F.lit(" days")), here + 1),
        stated(is_("invoice") & F.col("rn").isNotNull(), "hours_billed", "number", F.col("l_quantity").cast("int").cast("string"), here + 2),
    )
    keys = ["pile_id", "document", "doc_type", "entity_key", "status"]
    lines = docs.join(ranked_lines(spark, sf_dir), F.col("o_orderkey") == F.col("l_orderkey"), "left").where(is_("invoice") | whole)
    found = lines.select(*keys, F.explode(F.array_compact(every)).alias("f"))
    return found.select(*keys, "f.*").withColumn("char_end", F.col("char_start") + F.length("value_raw")).withColumn("page_no", F.lit(1))


def sourced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts with their value read anew and their document's rank: what every later operator takes."""
    return with_values(facts(spark, sf_dir))


def fact_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, written once: for operators that take the facts several times."""
    return stored(sourced(spark, sf_dir))


def with_values(rows: DataFrame) -> DataFrame:
    return with_value(rows).withColumn("rank", precedence_of(F.col("doc_type")))


DOCS_SQL = """
docs AS (
  SELECT r_name AS pile_id, 'order-' || o_orderkey AS document,
    CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'amendment' WHEN '2' THEN 'msa' WHEN '3' THEN 'sow' WHEN '4' THEN 'notice' ELSE 'invoice' END AS doc_type,
    'engagement:customer-' || o_custkey || '-' || year(CAST(o_orderdate AS DATE)) AS entity_key,
    CASE WHEN o_orderstatus = 'P' THEN 'quarantined' ELSE 'classified' END AS status,
    CAST(o_orderdate AS DATE) AS day, o_orderkey
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""

FACTS_SQL = (
    DOCS_SQL
    + """,
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS rn FROM lineitem
),
good AS (SELECT * FROM docs WHERE status <> 'quarantined'),
lines AS (SELECT * FROM good JOIN ranked ON o_orderkey = l_orderkey),
stated AS (
  SELECT pile_id, document, doc_type, entity_key, 'hours_cap' AS field, 'number' AS value_type, '100' AS value_raw, 10 AS char_start FROM good WHERE doc_type = 'sow'
  UNION ALL SELECT pile_id, document, doc_type, entity_key, 'effective_date', 'date', CAST(day AS VARCHAR), 20 FROM good WHERE doc_type IN ('msa', 'amendment')
  UNION ALL SELECT pile_id, document, doc_type, entity_key, 'term_months', 'number', '6', 30 FROM good WHERE doc_type = 'msa'
  UNION ALL SELECT pile_id, document, doc_type, entity_key, 'invoice_date', 'date', CAST(day AS VARCHAR), 40 FROM good WHERE doc_type = 'invoice'
  UNION ALL SELECT pile_id, document, doc_type, entity_key, 'notice_period_days', 'number', (30 + 30 * (o_orderkey % 3)) || ' days', 50 FROM good WHERE doc_type = 'notice'
  UNION ALL SELECT pile_id, document, doc_type, entity_key, 'termination_notice_days', 'number', '60 days', 60 FROM good WHERE doc_type = 'msa'
  UNION ALL SELECT pile_id, document, doc_type, entity_key, 'liability_cap', 'money', 'USD 250,000', 70 FROM good WHERE doc_type = 'msa' AND o_orderkey % 2 = 0
  UNION ALL SELECT pile_id, document, doc_type, entity_key, 'hourly_rate', 'money', 'USD ' || (100 + 5 * (l_partkey % 2)), CAST(100 * rn AS INT) FROM lines WHERE doc_type IN ('msa', 'amendment', 'invoice') AND rn = 1
  UNION ALL SELECT pile_id, document, doc_type, entity_key, 'payment_terms_days', 'number', (30 + 15 * (l_suppkey % 2)) || ' days', CAST(100 * rn + 1 AS INT) FROM lines WHERE doc_type IN ('msa', 'invoice') AND rn = 1
  UNION ALL SELECT pile_id, document, doc_type, entity_key, 'hours_billed', 'number', CAST(CAST(trunc(l_quantity) AS BIGINT) AS VARCHAR), CAST(100 * rn + 2 AS INT) FROM lines WHERE doc_type = 'invoice'
),
numbered AS (
  SELECT *, CASE WHEN value_type = 'date' THEN NULL ELSE CAST(replace(regexp_extract(value_raw, '([0-9][0-9,]*)', 1), ',', '') AS BIGINT) END AS number,
    CASE WHEN value_type = 'date' THEN CAST(value_raw AS DATE) END AS as_date,
    CASE doc_type WHEN 'invoice' THEN 1 WHEN 'notice' THEN 2 WHEN 'sow' THEN 3 WHEN 'msa' THEN 4 ELSE 5 END AS rank
  FROM stated
),
facts AS (
  SELECT *, CASE value_type WHEN 'money' THEN 'USD ' || number || '.00' WHEN 'date' THEN CAST(as_date AS VARCHAR) ELSE CAST(number AS VARCHAR) END AS canonical,
    char_start + length(value_raw) AS char_end
  FROM numbered
)"""
)
