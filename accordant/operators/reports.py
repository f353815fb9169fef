"""Counts, listings and orders that people read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accordant.sources.sinks import stored


def placed(rows: DataFrame, group: str, *order: Column, out: str = "place", written: bool = False) -> DataFrame:
    """rows with their place (from 1) within the group by the order, where one group may be most of the table.

    The rows are written first unless they are (``written``), as the bounds of the ranges take them once more.  They are parted by range over group and order, so that a large group lies in
    many tasks, and written once; a row's place is its place in its task's share and
    what the tasks before hold of the group.  Those counts are a row per task and
    group.  Rows that the order does not tell apart stand in any order.  A null
    group is a group.
    """
    share = stored((rows if written else stored(rows)).repartitionByRange(F.col(group), *order).withColumn("_share", F.spark_partition_id()))
    before = Window.partitionBy(group).orderBy("_share").rowsBetween(Window.unboundedPreceding, -1)
    counts = share.groupBy(group, "_share").agg(F.count("*").alias("n")).withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    counts = counts.select(F.col(group).alias("_group"), F.col("_share").alias("_of"), "_before")
    inner = share.withColumn("_at", F.row_number().over(Window.partitionBy(group, "_share").orderBy(*order)))
    both = inner.join(counts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_share") == F.col("_of")))
    return both.withColumn(out, F.col("_at") + F.col("_before")).drop("_group", "_of", "_share", "_before", "_at")


def run_report(stages: DataFrame) -> DataFrame:
    """Per run and stage, and per run in all: calls, milliseconds, tokens, paths, first event.

    stages: run_id, stage, path_taken, ms, tokens_in, at.
    """
    out = stages.rollup("run_id", "stage").agg(
        F.grouping("stage").alias("total"), F.count("*").alias("calls"), F.round(F.coalesce(F.sum("ms"), F.lit(0.0)), 4).alias("ms"), F.coalesce(F.sum("tokens_in"), F.lit(0)).alias("tokens_in"),
        F.array_join(F.sort_array(F.collect_set("path_taken")), ",").alias("paths"), F.min("at").alias("first_at"),
    )
    return out.where("run_id is not null").withColumn("stage", F.when(F.col("total") == 1, "total").otherwise(F.col("stage"))).drop("total")


def paths_taken(stages: DataFrame) -> DataFrame:
    return stages.groupBy("run_id", F.concat_ws(":", "stage", "path_taken").alias("path")).agg(F.count("*").alias("n"))


def runs(all_runs: DataFrame, proposals: DataFrame) -> DataFrame:
    n = proposals.groupBy("run_id").agg(F.count_if(F.col("status") == "pending").alias("pending"), F.count("*").alias("proposals"))
    return all_runs.join(n, "run_id", "left").na.fill(0, ["pending", "proposals"])


def pile_overview(documents: DataFrame, gap_statuses=("quarantined", "unsupported", "escalated")) -> DataFrame:
    gap = F.col("status").isin(*gap_statuses)
    return documents.groupBy("pile_id").agg(F.count_if(~gap).alias("read"), F.count_if(gap).alias("gaps"))


def document_list(documents: DataFrame, pages: DataFrame, gap_statuses=("quarantined", "unsupported", "escalated")) -> DataFrame:
    n = pages.groupBy("document").agg(F.count("page_no").alias("pages"))
    return documents.join(n, "document", "left").select("document", F.coalesce("pages", F.lit(0)).alias("pages"), F.col("status").isin(*gap_statuses).alias("gap"))


def findings_with_citations(findings: DataFrame) -> DataFrame:
    """Citations as an ordered array, empty and not null where there are none."""
    return findings.withColumn("citations", F.array_sort(F.coalesce("citations", F.array().cast("array<struct<document:string,char_start:int,char_end:int>>"))))


def cited_findings(findings: DataFrame, quotes: DataFrame) -> DataFrame:
    """Findings with their citations as an ordered array of document, char_start, char_end and quote.

    findings: pile_id, rule_key, entity_key, citations and more; quotes: pile_id,
    document, char_start, char_end, quote.  A finding without citations has an empty
    array, a citation without a known passage a null quote.
    """
    keys = ["pile_id", "rule_key", "entity_key"]
    place = ["document", "char_start", "char_end"]
    each = findings.select(*keys, F.explode("citations").alias("c")).select(*keys, "c.*").distinct()
    known = quotes.groupBy("pile_id", *place).agg(F.min("quote").alias("quote"))
    nested = each.join(known, ["pile_id", *place], "left").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*place, "quote"))).alias("citations"))
    none = F.array().cast("array<struct<document:string,char_start:int,char_end:int,quote:string>>")
    return findings.drop("citations").join(nested, keys, "left").withColumn("citations", F.coalesce("citations", none))


def outcome_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("pile_id", "outcome").agg(F.count("*").alias("n"))


def usage(attempts: DataFrame, keys: list[str]) -> DataFrame:
    return attempts.groupBy(*keys).agg(F.sum("tokens_in").alias("tokens_in"), F.round(F.sum("cost_usd"), 6).alias("cost_usd"))


def run_outcome(documents: DataFrame, facts: DataFrame, disputes: DataFrame, gaps: DataFrame | None = None) -> DataFrame:
    """Per pile: documents, duplicates, quarantined, escalated, facts, gaps, conflicts and the outcome in a word; a pile without any is zero.

    documents: pile_id, status, and content (a hash of what was read) where repeats
    are to be counted: each further arrival of one content in a pile is a duplicate.
    gaps: pile_id, one row a gap.
    """
    status = lambda s: F.count_if(F.col("status") == s).alias(s)
    if "content" in documents.columns:
        each = documents.groupBy("pile_id", "content").agg(F.count("*").alias("n"), status("quarantined"), status("escalated"))
        again = F.sum(F.when(F.col("content").isNotNull(), F.col("n") - 1).otherwise(0)).alias("duplicates")
        d = each.groupBy("pile_id").agg(F.sum("n").alias("documents"), again, F.sum("quarantined").alias("quarantined"), F.sum("escalated").alias("escalated"))
    else:
        d = documents.groupBy("pile_id").agg(F.count("*").alias("documents"), F.lit(0).cast("long").alias("duplicates"), status("quarantined"), status("escalated"))
    f = facts.groupBy("pile_id").agg(F.count("*").alias("facts"))
    c = disputes.groupBy("pile_id").agg(F.count_if("disputed").alias("conflicts"))
    g = gaps.groupBy("pile_id").agg(F.count("*").alias("gaps")) if gaps is not None else f.select("pile_id", F.lit(0).cast("long").alias("gaps"))
    out = d
    for part in (f, c, g):
        out = out.join(part, "pile_id", "full_outer")
    numbers = ["documents", "duplicates", "quarantined", "escalated", "facts", "gaps", "conflicts"]
    word = F.when((F.col("facts") == 0) & (F.col("duplicates") > 0), "only duplicates").when(F.col("facts") == 0, "nothing read").when((F.col("conflicts") > 0) | (F.col("escalated") > 0), "to review").otherwise("agreed")
    return out.na.fill(0, numbers).select("pile_id", *numbers, word.alias("outcome"))


def facts_per_document(facts: DataFrame) -> DataFrame:
    return facts.groupBy("document").agg(F.count("*").alias("facts"))


def ranked_members(facts: DataFrame) -> DataFrame:
    w = Window.partitionBy("pile_id", "entity_key", "field").orderBy(F.desc("rank"), "document", "char_start")
    by_rank = Window.partitionBy("pile_id", "entity_key", "field").orderBy(F.desc("rank"))
    return facts.withColumn("place", F.row_number().over(w)).withColumn("standing", F.rank().over(by_rank))


def first_representative(facts: DataFrame) -> DataFrame:
    w = Window.partitionBy("pile_id", "entity_key", "field").orderBy("document", "char_start").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return facts.withColumn("first", F.first("value.canonical", ignorenulls=True).over(w))


def settled_files(scans: DataFrame) -> DataFrame:
    """Files whose size and time are the same in two scans that follow each other; scans: filename, scan, size, mtime."""
    w = Window.partitionBy("filename").orderBy("scan")
    before = scans.withColumn("was", F.lag(F.struct("scan", "size", "mtime")).over(w))
    return before.where((F.col("was.scan") == F.col("scan") - 1) & (F.col("was.size") == F.col("size")) & (F.col("was.mtime") == F.col("mtime"))).drop("was")


def review_queue(proposals: DataFrame) -> DataFrame:
    """Pending items, conflicts first, then findings by severity, then the rest, by name."""
    kind = F.when(F.col("kind") == "conflict", 0).when(F.col("kind") == "finding", 1).when(F.col("kind") == "escalation", 2).otherwise(3)
    grave = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    return placed(proposals.where("status = 'pending'"), "pile_id", kind, grave, F.col("proposal_id"))


def newest(rows: DataFrame, at: str, tie: str, limit: int = 50) -> DataFrame:
    return rows.orderBy(F.desc(at), F.desc(tie)).limit(limit)


def display_order(findings: DataFrame) -> DataFrame:
    shown = F.when(F.col("outcome") == "violated", 0).when(F.col("outcome") == "not_enough_evidence", 1).otherwise(2)
    return placed(findings, "pile_id", shown, F.col("rule_key"), F.col("entity_key"))


def severity_order(findings: DataFrame) -> DataFrame:
    """Findings in the order of a report: by severity's name downwards, then rule, then engagement."""
    return placed(findings, "pile_id", F.desc("severity"), F.col("rule_key"), F.col("entity_key"))
