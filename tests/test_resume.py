"""Runs that are killed and started again: finished stages are not done twice, answers not asked twice."""

import os
import subprocess
import sys
import textwrap

import pytest
from pyspark.sql import functions as F

from accordant.operators import answers as A
from accordant.operators import resume as S

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def stages(calls, broken=None):
    def step(name, work):
        def run(rows):
            calls.append(name)
            out = work(rows)
            if name == broken:
                # fails in the middle of its write
                return out.withColumn("n", F.when(F.col("id") == 77, F.raise_error(F.lit("killed"))).otherwise(F.col("n")))
            return out

        return S.Stage(name, run)

    return [step("read", lambda r: r.selectExpr("id", "id * 2 as n")), step("keep", lambda r: r.where("id % 3 <> 1")), step("sum", lambda r: r.withColumn("n", F.col("n") + 1)), step("total", lambda r: r.agg(F.sum("n").alias("n")))]


def test_a_run_goes_on_after_its_third_stage_failed(spark, tmp_path):
    rows, calls = spark.range(100), []
    with pytest.raises(Exception, match="killed"):
        S.run(rows, stages(calls, "sum"), str(tmp_path), "r1")
    assert {(r.stage, r.n_rows) for r in S.progress(spark, str(tmp_path), "r1").collect()} == {("read", 100), ("keep", 67)}
    got = S.run(rows, stages(calls), str(tmp_path), "r1")
    assert calls == ["read", "keep", "sum", "sum", "total"]
    assert got.first().n == sum(2 * i + 1 for i in range(100) if i % 3 != 1)
    whole = S.run(rows, stages([]), str(tmp_path / "other"), "r1")
    assert whole.collect() == got.collect()
    both = [sorted(map(tuple, S.progress(spark, str(p), "r1").collect())) for p in (tmp_path, tmp_path / "other")]
    assert both[0] == both[1] and len(both[0]) == 4
    S.run(rows, stages(calls), str(tmp_path), "r1")
    assert calls[5:] == []


def test_other_inputs_versions_and_runs_are_done_anew(spark, tmp_path):
    calls = []
    S.run(spark.range(100), stages(calls), str(tmp_path), "r1")
    S.run(spark.range(103), stages(calls), str(tmp_path), "r1")
    S.run(spark.range(100), stages(calls), str(tmp_path), "r2")
    assert len(calls) == 12
    newer = [S.Stage(s.name, s.work, "2" if s.name == "total" else "1") for s in stages(calls)]
    S.run(spark.range(100), newer, str(tmp_path), "r1")
    assert calls[12:] == ["total"]


def test_content_is_of_the_rows_alone(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "x int, y string")
    same = rows.select("y", "x").repartition(3)
    assert S.content(rows) == S.content(same) and S.content(rows)[0] == 3
    assert len({S.content(r)[1] for r in (rows, rows.distinct(), rows.where("false"), rows.na.fill(""), rows.withColumnRenamed("y", "z"))}) == 5


def test_a_killed_process(spark, tmp_path):
    """The driver dies in the third stage; another one goes on."""
    code = f"""
        import os, sys
        sys.path.insert(0, {ROOT!r})
        from pyspark.sql import SparkSession
        from accordant.operators import resume as S
        spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
        def die(rows):
            os._exit(9)
        steps = [S.Stage("read", lambda r: r.selectExpr("id", "id * 2 as n")), S.Stage("keep", lambda r: r.where("id % 3 <> 1")), S.Stage("sum", die)]
        S.run(spark.range(100), steps, {str(tmp_path)!r}, "r1")
    """
    died = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], timeout=120, capture_output=True)
    assert died.returncode == 9
    calls = []
    got = S.run(spark.range(100), stages(calls), str(tmp_path), "r1")
    assert calls == ["sum", "total"] and got.first().n == sum(2 * i + 1 for i in range(100) if i % 3 != 1)


def test_answers_survive_a_kill(spark, tmp_path):
    """Of 40 prompts in chunks of 10, a failure loses the chunk in work at most."""
    prompts = spark.createDataFrame([(f"k{i:02d}", f"text {i}") for i in range(40)] * 2, "call_key string, user string")
    asked = spark.sparkContext.accumulator(0)
    last = prompts.where(F.pmod(F.xxhash64("call_key"), F.lit(4)) == 3).first().call_key  # of the fourth chunk

    def model(fail):
        def answer(batches):
            for batch in batches:
                asked.add(len(batch))
                if fail and (batch["call_key"] == last).any():
                    raise RuntimeError("killed")
                yield batch[["call_key"]].assign(answer=batch["user"].str.upper())

        return lambda rows: A.ask(rows, answer, "call_key string, answer string")

    with pytest.raises(Exception, match="killed"):
        S.answered(prompts, model(True), str(tmp_path), chunk=10).count()
    kept = spark.read.parquet(f"{tmp_path}/answers").count()
    assert kept == prompts.where(F.pmod(F.xxhash64("call_key"), F.lit(4)) < 3).distinct().count() > 20
    before = asked.value
    got = {r.call_key: r.answer for r in S.answered(prompts, model(False), str(tmp_path), chunk=10).collect()}
    assert got == {f"k{i:02d}": f"TEXT {i}" for i in range(40)} and asked.value - before == 40 - kept
    assert S.answered(prompts.where("call_key < 'k05'"), model(True), str(tmp_path)).count() == 5 and asked.value - before == 40 - kept
    assert S.answered(prompts.where("false"), model(True), str(tmp_path)).count() == 0
