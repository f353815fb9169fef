"""Secret scans through an incremental ledger of blobs.

Every version of every path is addressed by the SHA-256 of its content.  The
ledger has, per blob, the rule versions that scanned it and the spans they found,
each under its rule version; a scan looks only at pairs of blob and rule version
that are not in it, each blob once however many paths and versions carry it.
Hashes are held against the ledger before any text is moved.  The findings are
joined back to all paths, those of the rule versions in force only, so that a rule
that was replaced has no say.  Only DataFrame functions are used: a rule's matches
and the text between them come from the regular-expression functions, and offsets
are running sums of their lengths in code points.

Defined results for odd input: a null text is an empty one, without spans; equal
texts have equal spans; repeated rows give repeated rows; an empty table gives an
empty result, and an empty ledger is as none; further columns are ignored, or kept
where the rows of the table are returned, whatever their names; ids may be null.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accordant.llm.common import settled, text_of


@dataclass(frozen=True)
class Rule:
    """pattern: matches are leftmost and do not overlap; group, least: a match counts if the group has so many characters; hint: a cheap test for a text worth scanning."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    hint: str = ""
    version: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


# The base rules, in the order in which ties are listed.
BASE = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}", hint="AKIA"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
# A private key: from its first line to its last; without a last line, encapsulated headers, long runs of base64 and
# lines of nothing else. All loops are possessive, which the engine runs without recursion and without going back.
_BREAK = r"(?:\r?\n|\r|\\+r\\+n|\\+n)"
_EDGE = r"""[\x20\t"'>|#*,;]*+"""
PEM = (
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:"
    r"(?:[^-]++|-(?!----))*+-----END [A-Z ]*PRIVATE KEY-----|"
    r"""(?:(?:\s|\\+[nrt]|["'>|#*,;])*+(?:(?:Proc-Type|DEK-Info):\x20?[^\s\\]++|[A-Za-z0-9+/]{20,}+=*+)|"""
    rf"{_EDGE}{_BREAK}{_EDGE}[A-Za-z0-9+/]++=*+(?={_EDGE}(?:{_BREAK}|\z))|"
    r"\x20[A-Za-z0-9+/]++={1,2}+)*+)"
)
# What the method adds to them.
ADDED = (
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", hint="eyJ"),
    Rule("pem", PEM, hint="PRIVATE KEY-----", version=2),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}", hint="gh"),
)
RULES = BASE + ADDED
SPANS = "array<struct<start:long,rank:int,kind:string,end:long,rule:string>>"
LEDGER = f"blob string, rules array<string>, spans {SPANS}"
#: Hashes of unseen blobs that a broadcast holds (100 bytes each at most); more are joined by a shuffle.
FEW_BLOBS = 200_000


def _matches(rule: Rule, rank: int, text: Column, due: Column) -> Column:
    """All matches of a rule as (rank, kind, position, characters before it since the last, its length, whether it counts)."""
    pattern = F.lit(rule.pattern)
    likely = text.contains(rule.hint) & text.rlike(rule.pattern) if rule.hint else text.rlike(rule.pattern)
    whole, between = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, rule.pattern, -1)
    value = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else whole
    joined = F.arrays_zip(between.alias("between"), whole.alias("whole"), value.alias("value"))
    found = F.transform(
        F.slice(joined, F.lit(1), F.size(whole)),
        lambda x, i: F.struct(
            F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), F.lit(rule.name).alias("rule"), i.alias("at"), F.length(x["between"]).cast("long").alias("before"),
            F.length(x["whole"]).cast("long").alias("n"), (F.length(x["value"]) >= rule.least).alias("counts"),
        ),
    )
    return F.when(due & likely, found).otherwise(F.array().cast("array<struct<rank:int,kind:string,rule:string,at:int,before:long,n:long,counts:boolean>>"))


def versions_of(docs: DataFrame, path_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """path, blob, text: every version of every path under its content address."""
    return docs.select(F.col(path_col).alias("path"), text_of(text_col).alias("text")).withColumn("blob", F.sha2("text", 256))


def scan_unseen(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New rows for the ledger: each blob once, under the rule versions that have not scanned it."""
    wanted = F.array(*[F.lit(r.name) for r in rules])
    if ledger is None:
        due_texts = versions.select("blob", "text").withColumn("due", wanted)
    else:
        seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
        due = F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>")))
        hashes = versions.select("blob").distinct().join(seen, "blob", "left")
        unseen = settled(hashes.select(F.col("blob").alias("of"), due.alias("due")).where(F.size("due") > 0))
        unseen = F.broadcast(unseen) if unseen.count() <= FEW_BLOBS else unseen
        due_texts = versions.join(unseen, F.col("blob") == F.col("of")).select("blob", "text", "due")
    blobs = due_texts.groupBy("blob").agg(F.first("text").alias("text"), F.first("due").alias("due"))
    text = F.col("text")
    found = F.concat(*[_matches(r, i, text, F.array_contains("due", r.name)) for i, r in enumerate(rules)])
    each = blobs.select("blob", "due", F.explode_outer(found).alias("m"))
    so_far = Window.partitionBy("blob", "m.rank").orderBy("m.at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("m.before") + F.col("m.n")).over(so_far)
    span = F.struct((F.col("end") - F.col("m.n")).alias("start"), "m.rank", "m.kind", "end", "m.rule")
    spans = each.withColumn("end", end).select("blob", "due", F.when(F.col("m.counts"), span).alias("span"))
    return spans.groupBy("blob").agg(F.first("due").alias("rules"), F.sort_array(F.collect_list("span")).alias("spans"))


def in_force(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob, spans (by start, then the order of rules) of the blobs that have some under these rule versions."""
    order = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.name, i)])
    known = F.filter("spans", lambda s: F.try_element_at(order, s["rule"]).isNotNull())
    ranked = F.transform(known, lambda s: F.struct(s["start"].alias("start"), F.try_element_at(order, s["rule"]).alias("rank"), s["kind"].alias("kind"), s["end"].alias("end"), s["rule"].alias("rule")))
    return ledger.select("blob", ranked.alias("spans")).where(F.size("spans") > 0).groupBy("blob").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))


def findings_at_paths(versions: DataFrame, *ledgers: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """path, blob, spans of all paths, from the ledger's parts."""
    if len(ledgers) == 1:
        held = ledgers[0].where(F.size("spans") > 0).select("blob", "spans")
    else:
        parts = ledgers[0].select("blob", "spans")
        for more in ledgers[1:]:
            parts = parts.unionByName(more.select("blob", "spans"))
        held = in_force(parts, rules)
    found = _with_spans(versions.select("path", "blob"), held)
    return found.select("path", "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def _with_spans(rows: DataFrame, held: DataFrame) -> DataFrame:
    """rows, which have blob, with the spans of their blob.

    A second key makes Spark deal out both sides anew, so that it can split the rows of a blob with very many.
    """
    held = held.select(F.col("blob").alias("of"), F.left("blob", F.lit(4)).alias("of_head"), "spans")
    return rows.withColumn("head", F.left("blob", F.lit(4))).join(held, (F.col("blob") == F.col("of")) & (F.col("head") == F.col("of_head")), "left")


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digested(found: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans from the spans at paths, and more of their columns."""
    base = F.filter("spans", lambda s: s["kind"].isin(*[r.kind for r in BASE]))
    of_kind = lambda k: F.filter("spans", lambda s: s["kind"] == k)
    counts = [F.size(of_kind(r.kind)).cast("long").alias(f"n_{r.kind}") for r in BASE]
    return found.select(F.col("path").alias("doc_id"), *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), *more)


def scanned(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """What was found at every path, and the rows that the ledger gains (written once)."""
    versions = versions_of(docs, id_col, text_col)
    new = settled(scan_unseen(versions, ledger, rules))
    return findings_at_paths(versions, *([new] if ledger is None else [ledger, new]), rules=rules), new


def secrets(docs: DataFrame, ledger: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every whole text."""
    versions = versions_of(docs, id_col, text_col)
    new = scan_unseen(versions, ledger)
    return digested(findings_at_paths(versions, *([new] if ledger is None else [ledger, new])))


def without_secrets(text: Column, spans: Column, mask: str = "[secret]") -> Column:
    """The text with every span, or run of overlapping spans, replaced by the mask."""
    empty = F.array().cast("array<struct<start:long,end:long>>")
    merged = F.aggregate(
        spans, empty,
        lambda a, s: F.when(
            (F.size(a) > 0) & (s["start"] < F.try_element_at(a, F.lit(-1))["end"]),
            F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.struct(F.try_element_at(a, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(a, F.lit(-1))["end"], s["end"]).alias("end")))),
        ).otherwise(F.concat(a, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))),
    )
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform(merged, lambda m: m["end"]))
    ends = F.concat(F.transform(merged, lambda m: m["start"]), F.array(F.length(text).cast("long")))
    kept = F.zip_with(starts, ends, lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int")))
    return F.when(F.size(spans) > 0, F.array_join(kept, mask)).otherwise(text)


def redacted(docs: DataFrame) -> DataFrame:
    """All documents, secrets masked and n_chars counted anew where some were, in the columns of docs."""
    held = scan_unseen(versions_of(docs)).where(F.size("spans") > 0)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.sha2(text_of("text"), 256).alias("blob"))
    hit, masked = F.col("spans").isNotNull(), without_secrets(F.col("row.text"), F.col("spans"))
    rows = _with_spans(rows, held).select("row", hit.alias("hit"), F.when(hit, masked).otherwise(F.col("row.text")).alias("clean"))
    put = {"text": F.col("clean"), "n_chars": F.when(F.col("hit"), F.length("clean").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return rows.select(*[put[c].alias(c) if c in put else F.col("row")[c].alias(c) for c in docs.columns])
