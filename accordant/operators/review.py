"""Proposals, decisions, versions, audit: tables that are appended to or written anew.

A table format with merges is not assumed; an upsert is a full outer join that
gives the next snapshot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SECTION = ["pile_id", "section_key"]


def new_conflict_proposals(conflicts: DataFrame, asked: DataFrame) -> DataFrame:
    """conflicts (pile_id, ref_id, shown) that are neither pending nor decided with the same values."""
    a = asked.select("pile_id", "ref_id", F.col("shown").alias("asked"), "status")
    same = (conflicts["pile_id"] == a["pile_id"]) & (conflicts["ref_id"] == a["ref_id"]) & ((a["status"] == "pending") | conflicts["shown"].eqNullSafe(a["asked"]))
    return conflicts.join(a, same, "left_anti")


def new_finding_proposals(findings: DataFrame, asked: DataFrame) -> DataFrame:
    """Violations (pile_id, ref_id, detail) that are neither pending nor asked with the same detail."""
    a = asked.select("pile_id", "ref_id", F.col("detail").alias("asked"), "status")
    bad = findings.where("outcome = 'violated'")
    same = (bad["pile_id"] == a["pile_id"]) & (bad["ref_id"] == a["ref_id"]) & ((a["status"] == "pending") | bad["detail"].eqNullSafe(a["asked"]))
    return bad.join(a, same, "left_anti")


def new_section_patches(changes: DataFrame, asked: DataFrame) -> DataFrame:
    """Added or changed sections whose hash has not been asked about."""
    return changes.where("state in ('added', 'changed')").join(asked.select(*SECTION, "to_hash"), [*SECTION, "to_hash"], "left_anti")


def cause(arrived: DataFrame) -> DataFrame:
    """pile_id, cause_document: only where exactly one document arrived."""
    return arrived.groupBy("pile_id").agg(F.when(F.count("*") == 1, F.min("document")).alias("cause_document"))


def without_proposals(piles: DataFrame, proposals: DataFrame) -> DataFrame:
    quiet = piles.select("pile_id").distinct().join(proposals.select("pile_id"), "pile_id", "left_anti")
    return quiet.withColumn("path", F.lit("no_change")).withColumn("note", F.lit("nothing to review"))


def payloads(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.withColumn("payload", F.to_json(F.struct(*columns)))


#: What a decision may say besides its verdict: why, through which surface, when.
SAID = ("reason", "decided_via", "decided_at")


def decided(proposals: DataFrame, decisions: DataFrame) -> DataFrame:
    """proposals after review: the first decision on a pending item stands, later ones change nothing.

    decisions: proposal_id, seq, approved, decided_by, and those of SAID that the
    caller records; one without a decider or a verdict does not count.  What was
    said stays null for an item that this review did not decide.
    """
    said = ["decided_by", *[c for c in SAID if c in decisions.columns]]
    good = decisions.where("decided_by is not null and trim(decided_by) <> '' and approved is not null")
    first = good.groupBy("proposal_id").agg(F.min_by(F.struct("approved", *said), F.struct("seq", "decided_by", "approved", *said[1:])).alias("d"))
    both = proposals.drop(*said).join(first, "proposal_id", "left").withColumn("_now", (F.col("status") == "pending") & F.col("d").isNotNull())
    verdict = F.when(F.col("_now"), F.when(F.col("d.approved"), "approved").otherwise("rejected")).otherwise(F.col("status"))
    return both.withColumns({"status": verdict} | {c: F.when(F.col("_now"), F.col(f"d.{c}")) for c in said}).drop("d", "_now")


def decision_counts(after: DataFrame, keys: list[str]) -> DataFrame:
    """keys, approved, rejected, pending: how a review stands; ``after`` is what ``decided`` gives."""
    return after.groupBy(*keys).agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("approved", "rejected", "pending")])


def blocks_commit(proposals: DataFrame, sections: DataFrame) -> DataFrame:
    """What stands in the way of a commit: must be empty."""
    open_ = proposals.where("status = 'pending'").select("pile_id", F.col("section_key"), F.lit("pending").alias("why"))
    now = sections.select(*SECTION, F.col("content_hash").alias("now"))
    stale = proposals.where("status = 'approved'").join(now, SECTION).where("to_hash <> now").select(*SECTION, F.lit("stale").alias("why"))
    return open_.unionByName(stale)


def committed(previous: DataFrame, approved: DataFrame) -> DataFrame:
    """The next version: approved sections, and those of the last version that they leave alone.

    previous and approved: SECTION, body, content_hash; previous also version.
    """
    top, last = _last_version(previous)
    touched = approved.select("pile_id").distinct()
    kept = last.join(touched, "pile_id", "left_semi").join(approved.select(*SECTION), SECTION, "left_anti").select(*SECTION, "body", "content_hash", F.lit(True).alias("carried"))
    made = approved.select(*SECTION, "body", "content_hash", F.lit(False).alias("carried")).unionByName(kept)
    return made.join(top.withColumnRenamed("version", "was"), "pile_id", "left").withColumn("version", F.coalesce(F.col("was"), F.lit(0)) + 1).drop("was")


def _last_version(previous: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pile_id, version) of each pile's last version, and the sections of it."""
    top = previous.groupBy("pile_id").agg(F.max("version").alias("version"))
    return top, previous.join(top, ["pile_id", "version"], "left_semi")


#: What a row of the audit says of the change besides its hashes, where the approved sections have it.
CAUSES = ("run_id", "cause_document", "proposal_id")


def audit(previous: DataFrame, approved: DataFrame) -> DataFrame:
    """SECTION, to_hash, from_hash and those of CAUSES that approved has: a row per approved section, none for carried ones.

    previous: sections of any number of versions; from_hash is that of the pile's
    last one, null for a section that it lacks.
    """
    last = _last_version(previous)[1].select(*SECTION, F.col("content_hash").alias("from_hash"))
    return approved.select(*SECTION, F.col("content_hash").alias("to_hash"), *[c for c in CAUSES if c in approved.columns]).join(last, SECTION, "left")


def statuses_after(items: DataFrame, proposals: DataFrame, words=(("approved", "accepted"), ("rejected", "dismissed"))) -> DataFrame:
    """items (pile_id, ref_id, status) with the status that review gave them.

    An item that several runs proposed has the last decision on it, by proposal_id
    where the proposals have one; an undecided proposal takes none back.
    """
    known = dict(words)
    order = F.col("proposal_id") if "proposal_id" in proposals.columns else F.lit(0)
    said = proposals.where(F.col("status").isin(*known)).groupBy("pile_id", "ref_id").agg(F.max_by("status", F.struct(order, "status")).alias("said"))
    out = F.col("status")
    for decision, word in words:
        out = F.when(F.col("said") == decision, word).otherwise(out)
    return items.join(said, ["pile_id", "ref_id"], "left").withColumn("status", out).drop("said")


def merged_findings(held: DataFrame, new: DataFrame) -> DataFrame:
    """One row per (pile_id, rule_key, entity_key): a changed detail opens it again."""
    keys = ["pile_id", "rule_key", "entity_key"]
    n = new.select(*keys, F.col("outcome").alias("new_outcome"), F.col("detail").alias("new_detail"))
    both = held.join(n, keys, "full_outer")
    status = F.when(F.col("new_detail").isNull(), F.col("status")).when(~F.col("detail").eqNullSafe(F.col("new_detail")), "open").otherwise(F.col("status"))
    return both.select(*keys, F.coalesce("new_outcome", "outcome").alias("outcome"), F.coalesce("new_detail", "detail").alias("detail"), status.alias("status"))


def merged_conflicts(held: DataFrame, new: DataFrame) -> DataFrame:
    """One row per (pile_id, entity_key, field): the status stays, the rationale is the new one."""
    keys = ["pile_id", "entity_key", "field"]
    n = new.select(*keys, F.col("rationale").alias("new_rationale"))
    return held.join(n, keys, "full_outer").select(*keys, F.coalesce("status", F.lit("open")).alias("status"), F.coalesce("new_rationale", "rationale").alias("rationale"))


def run_status(events: DataFrame) -> DataFrame:
    """run_id, status, ended: the last status event of each run; events: run_id, status, at, seq."""
    last = events.groupBy("run_id").agg(F.max_by(F.struct("status", "at"), F.struct("at", "seq")).alias("e"))
    done = F.col("e.status").isin("done", "failed", "abandoned")
    return last.select("run_id", F.col("e.status").alias("status"), F.when(done, F.col("e.at")).alias("ended"))


def abandoned(run_id: str, who: str, why: str, at, spark) -> DataFrame:
    """The event that abandons a run; it needs who and why, and deletes nothing."""
    if not (who or "").strip() or not (why or "").strip():
        raise ValueError("abandoning a run needs who and why")
    return spark.createDataFrame([(run_id, "abandoned", at, who, why)], "run_id string, status string, at timestamp, who string, why string")


def event_log(events: DataFrame) -> DataFrame:
    return events.withColumn("place", F.row_number().over(Window.partitionBy("run_id").orderBy("at", "seq")))


def listed(proposals: DataFrame) -> DataFrame:
    """The proposals with their place in the list of their run and status."""
    return proposals.withColumn("place", F.row_number().over(Window.partitionBy("run_id", "status").orderBy("proposal_id")))
