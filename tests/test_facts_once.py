"""Facts are made in one pass over the orders, and values are read by code that the virtual machine compiles."""

import random

import pytest
from pyspark.sql import functions as F

from accordant import config as C
from accordant.functions.normalize import ambiguous_date, duration_unit, parse_date, with_value, word_number
from accordant.operators.reconcile import grouped
from accordant.plans.facts import facts, ranked_lines

#: Bytes of a method from which HotSpot does not compile it.
HUGE = 8000


def test_documents_meet_their_lines_once(spark, sf_dir):
    plan = facts(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("o_orderpriority") and plan.count("Relation") == 5


def test_lines_are_ranked_in_every_part(spark, sf_dir):
    """Lines are dealt once, for ranks and for the join, in parts that are not coalesced, though they are small."""
    made = ranked_lines(spark, sf_dir)
    plan = facts(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and plan.count("hashpartitioning(l_orderkey") == 1
    parts = {r[0] for r in made.select(F.spark_partition_id()).distinct().collect()}
    assert len(parts) == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
    assert made.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.countDistinct("rn").alias("d"), F.max("rn").alias("m")).where("n <> d OR n <> m").count() == 0


def test_documents_of_groups_are_counted_in_every_part(spark):
    """Nulls and repeats by hand; the parts are not coalesced, though they are small."""
    draw = random.Random(5)
    rows = [(draw.choice(["p", None]), f"e{draw.randrange(4)}", draw.choice("fg"), draw.choice([None, "a", "b", "c"])) for _ in range(300)]
    want = {}
    for *key, document in rows:
        want.setdefault(tuple(key), []).append(document)
    found = grouped(spark.createDataFrame(rows, "pile_id string, entity_key string, field string, document string"))
    assert {tuple(r)[:3]: (r.members, r.documents) for r in found.collect()} == {k: (len(v), len({*v} - {None})) for k, v in want.items()}
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()


def test_reading_a_value_is_compiled(spark):
    rows = with_value(spark.range(9).select(F.concat(F.lit("USD "), "id").alias("value_raw"), F.when(F.col("id") < 9, "money").alias("value_type")))
    plan = rows.select(F.hash("value"))._jdf.queryExecution().executedPlan()
    stages = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenStringSeq(plan)
    assert stages.size() and all(stages.apply(i)._3().maxMethodCodeSize() < HUGE for i in range(stages.size()))


@pytest.mark.parametrize("words, read", [(C.WORD_NUMBERS, word_number), (C.DURATION_UNITS, duration_unit)])
def test_the_longest_word_counts(spark, words, read):
    """Against a test for each word, longest first, over all pairs of words, in several surroundings, and over texts without any."""
    import re

    pairs = [sep.join(p) for a in words for b in words for p in [(a, b)] for sep in (" ", "-", "\n")]
    texts = [*pairs, *(w.upper() + "!" for w in words), *(f"x{w}" for w in words), "", "none", "$1", "one\\two"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(read(F.col("t"))).collect()]
    order = sorted(words, key=lambda w: -len(w))
    assert got == [next((words[w] for w in order if re.search(rf"\b{w}\b", t.lower())), None) for t in texts]


def test_dates_by_any_format_and_doubt(spark):
    raw = ["3 April 2026", "April 3, 2026", "2026-04-03", "4/3/2026", "13/4/2026", " 2026-04-03 ", "3 april 2026", "2026-4-3", "soon", "", None, "00/12/26", "10-12-2026", "13/12/2026"]
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, r string").orderBy("i")
    plain = F.coalesce(*[F.try_to_date(F.trim("r"), java) for java, _ in C.DATE_FORMATS])
    got = rows.select(parse_date(F.col("r")).alias("a"), plain.alias("b"), ambiguous_date(F.col("r")).alias("c")).collect()
    assert all(r.a == r.b for r in got) and sum(r.a is not None for r in got) >= 7
    assert [r.c for r in got] == [r in ("4/3/2026", "00/12/26", "10-12-2026") for r in raw]
