"""Doubles as cents against DuckDB's cast, around halves of a cent."""

from pyspark.sql import functions as F

from accordant.functions.normalize import cents_of


def test_quotients_around_half_a_cent(spark, tmp_path):
    """Sums of cents, as tables hold them, divided by even quantities: about a hundred thousand halves, some a hair under."""
    import duckdb

    path = str(tmp_path / "q.parquet")
    duckdb.sql(f"COPY (SELECT (c / 100.0 + (c % 41) * 0.01) / q AS x FROM range(1, 1000000, 37) t(c), (SELECT unnest([2, 4, 6, 10, 20, 48]) AS q) UNION ALL SELECT unnest([1.005, -1.005, 0.0, 2.675, 8388608.125, NULL])) TO '{path}' (FORMAT parquet)")
    want = duckdb.sql(f"SELECT x, CAST(x AS DECIMAL(18,2)) FROM '{path}'").fetchall()
    rows = spark.read.parquet(path).select("x", cents_of(F.col("x")).alias("c"), F.col("x").cast("decimal(18,2)").alias("cast")).collect()
    assert sorted((r.x, r.c) for r in rows if r.x is not None) == sorted((x, c) for x, c in want if x is not None)
    assert [r.c for r in rows if r.x is None] == [None]
    assert any(r.c != r["cast"] for r in rows)  # what the plain cast gets wrong
