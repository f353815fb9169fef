"""Screening text for instructions aimed at its reader, and routing by class.

All matches of all patterns are found with their offsets in code points: a
match's place is the running sum of what lies before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accordant import config as C
from accordant.functions.text import matches

# What an instruction to the reader looks like.
PATTERNS = {
    "instruction_override": r"\b(ignore|disregard|forget|override)\s+(all\s+|any\s+)?(previous|prior|above|earlier|preceding|the\s+following)?\s*(instruction|prompt|rule|directive|guideline|playbook|checklist)s?\b",
    "system_role_assertion": r"(^|\n)\s*(system|assistant|developer)\s*(instruction|prompt|message|note)s?\s*[:\-]",
    "addresses_the_reader_as_a_system": r"\byou\s+are\s+(an?\s+)?(automated|ai|a\.i\.|artificial|language\s+model|llm|agent|assistant|analysis\s+system|review\s+system)\b",
    "claims_prior_authorisation": r"\b(you\s+have|has|have)\s+(full\s+|complete\s+|explicit\s+)?(authorisation|authorization|permission|approval)\s+(from|to)\b[^.\n]{0,80}\b(approve|proceed|skip|bypass|without\s+review)\b",
    "claims_review_already_done": r"\b(requires?|needs?)\s+no\s+(further\s+)?(review|approval|verification|checking)\b",
    "directs_approval": r"\b(auto[-\s]?approve|approve\s+all|automatically\s+approve)\b|\bapprove\s+(all\s+)?(pending\s+)?(proposal|change|finding|conflict)s?\b",
    "suppresses_findings": r"\b(do\s+not|don't|never)\s+(raise|report|flag|surface|generate|produce)\s+(any\s+)?(finding|discrepanc|conflict|issue|exception|error)",
    "directs_omission_from_output": r"\b(omit|exclude|remove|leave\s+out|do\s+not\s+include)\b[^.\n]{0,60}\b(from\s+the\s+)?(register|report|output|deliverable|summary|analysis)\b",
    "dictates_the_conclusion": r"\breport\s+that\s+(no|there\s+are\s+no)\b|\bstate\s+that\s+(no|there\s+are\s+no)\b|\bmark\s+(all\s+)?[^.\n]{0,40}\bas\s+(resolved|approved|compliant|cleared)\b",
    "directs_configuration_change": r"\bset\s+(the\s+)?[^.\n]{0,40}\bto\s+(unlimited|infinite|zero|none|disabled)\b",
    "skips_comparison": r"\bdo\s+not\s+(compare|check|validate|verify|cross[-\s]?reference)\b",
}


def configured(patterns: list[str]) -> dict[str, str]:
    return {f"configured_{i}": p for i, p in enumerate(patterns)}


def hits(documents: DataFrame, patterns: dict[str, str] | None = None, keys: list[str] | None = None, text: str = "text") -> DataFrame:
    """keys, rule, char_start, char_end, hit: every match of every pattern."""
    keys, found = keys or ["document"], []
    for rule, pattern in (patterns or PATTERNS).items():
        p = f"(?i){pattern}"
        likely = F.when(F.col(text).rlike(p), matches(F.col(text), p)).otherwise(F.array().cast("array<struct<hit:string,gap:int>>"))
        found.append(_tagged(likely, rule))
    each = documents.select(*keys, F.explode(F.concat(*found)).alias("m")).select(*keys, "m.*")
    so_far = Window.partitionBy(*keys, "rule").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = each.withColumn("char_end", F.sum(F.col("gap") + F.length("hit")).over(so_far).cast("int"))
    return placed.select(*keys, "rule", (F.col("char_end") - F.length("hit")).alias("char_start"), "char_end", "hit")


def _tagged(found: Column, rule: str) -> Column:
    return F.transform(found, lambda x, i: F.struct(F.lit(rule).alias("rule"), i.alias("at"), x["hit"].alias("hit"), x["gap"].alias("gap")))


def verdicts(documents: DataFrame, found: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, suspicious, rules (sorted): clean documents stay, with false."""
    keys = keys or ["document"]
    fired = found.groupBy(*keys).agg(F.sort_array(F.collect_set("rule")).alias("rules"))
    none = F.array().cast("array<string>")
    return documents.select(*keys).join(fired, keys, "left").select(*keys, F.col("rules").isNotNull().alias("suspicious"), F.coalesce("rules", none).alias("rules"))


def statement(name: Column, rules: Column) -> Column:
    return F.concat(name, F.lit(" holds text that directs the reading system ("), F.array_join(rules, ", "), F.lit("); it is reported and not acted on"))


def quarantined(documents: DataFrame, judged: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """documents with status and note: suspicious ones leave every later input."""
    keys = keys or ["document"]
    both = documents.join(judged, keys)
    note = F.when(F.col("suspicious"), F.left(statement(F.concat_ws("/", *[F.col(k).cast("string") for k in keys]), F.col("rules")), F.lit(2000)))
    return both.withColumn("status", F.when(F.col("suspicious"), "quarantined").otherwise("screened")).withColumn("ingest_note", note).drop("suspicious", "rules")


def clamped(value: Column, default: float = 0.0) -> Column:
    """Into [0, 1]; what is no number is the default."""
    number = value.try_cast("double")
    return F.when(number.isNull() | F.isnan(number), F.lit(default)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)))


def classified(rows: DataFrame, floor: float = C.CLASSIFY_FLOOR) -> DataFrame:
    """rows: doc_type, confidence, flagged (model says so), readable, suspicious. Adds route and reason."""
    known = F.coalesce(F.col("doc_type").isin(*C.PRECEDENCE), F.lit(False))
    reason = (
        F.when(F.col("suspicious"), "screen")
        .when(~F.col("readable"), "unreadable answer")
        .when(F.coalesce("flagged", F.lit(False)), "model flag")
        .when(F.col("doc_type").isNull(), "no type")
        .when(~known, "unknown type")
        .when(clamped(F.col("confidence")) < floor, "low confidence")
        .otherwise("classified")
    )
    route = F.when(F.col("reason").isin("screen", "model flag"), "quarantine").when(F.col("reason") == "classified", "classified").otherwise("escalate")
    return rows.withColumn("reason", reason).withColumn("route", route)


def updated_types(documents: DataFrame, decided: DataFrame) -> DataFrame:
    """documents with the type and status that were decided, else their own."""
    d = decided.select("document", F.col("doc_type").alias("new_type"), F.col("status").alias("new_status"))
    return documents.join(d, "document", "left").withColumn("doc_type", F.coalesce("new_type", "doc_type")).withColumn("status", F.coalesce("new_status", "status")).drop("new_type", "new_status")
