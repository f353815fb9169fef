"""Tables that can be written again, and joins that need no shuffle."""

from pyspark.sql import functions as F

from accordant.operators import entities as J
from accordant.sources import sinks


def test_repeated_writes_change_nothing(spark, tmp_path):
    rows = spark.createDataFrame([("p", "a", 1), ("p", "b", 2), ("q", "c", 3)], "pile_id string, document string, n int")
    read = lambda: sorted((r.pile_id, r.document, r.n) for r in spark.read.parquet(str(tmp_path / "t")).collect())
    for _ in range(2):
        sinks.replace_piles(rows, str(tmp_path / "t"))
        assert read() == [("p", "a", 1), ("p", "b", 2), ("q", "c", 3)]
    sinks.replace_piles(rows.where("pile_id = 'p'").withColumn("n", F.lit(9)), str(tmp_path / "t"))
    assert read() == [("p", "a", 9), ("p", "b", 9), ("q", "c", 3)]


def test_bucketed_tables_join_without_a_shuffle(spark):
    facts = spark.range(3000).selectExpr("concat('p', id % 3) as pile_id", "concat('d', id % 500) as document", "'rate' as field", "cast(id as int) as char_start")
    docs = spark.range(500).selectExpr("explode(array('p0', 'p1', 'p2')) as pile_id", "concat('d', id) as document", "id as day")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for _ in range(2):
            sinks.write_bucketed(facts, "bucketed_facts", 8)
            sinks.write_bucketed(docs, "bucketed_docs", 8)
        joined = spark.table("bucketed_facts").join(spark.table("bucketed_docs"), ["pile_id", "document"])
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        made = J.with_provenance(spark.table("bucketed_facts"), spark.table("bucketed_docs"), "d7")
        assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
        want = facts.join(docs, ["pile_id", "document"])
        assert joined.count() == want.count() and made.count() == J.with_provenance(facts, docs, "d7").count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS bucketed_facts")
        spark.sql("DROP TABLE IF EXISTS bucketed_docs")
