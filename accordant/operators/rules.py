"""Checking facts against a playbook: violated, satisfied, not enough evidence.

The rules read the facts twice.  First, one aggregation over (pile, entity) keeps, for
all rules together, counts, sums, extremes and the leading facts: it combines before
the shuffle, and no list of an engagement's facts is made.  Then the facts that a rule
weighs meet the figures of their engagement and get a role (``evidence``); the counts
of roles settle the outcome.  ``outcomes`` has that, ``worded`` also the facts that are off in words,
``citations`` the rows that an outcome rests on, and ``examine`` puts all together.  The facts are written once before, as they are read twice.

Null piles and entities are groups of their own; a fact without a value is weighed by
no rule but counts as the statement of a field that has to be present; repeated facts
count each time and are cited once; an empty table has no findings.  Further columns of
the facts are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accordant import config as C
from accordant.functions.agreement import values_agree
from accordant.functions.normalize import plain
from accordant.sources.sinks import stored

ENTITY = ["pile_id", "entity_key"]
PLACE = ["document", "char_start", "char_end"]
VIOLATED, SATISFIED, UNJUDGED = "violated", "satisfied", "not_enough_evidence"
#: What a fact is to a rule: of the highest authority, in line with what it is held against, or off.
TOP, BOUND, OFF = "top", "bound", "off"
CITES = "array<struct<document:string,char_start:int,char_end:int>>"

#: A figure of an engagement by its name.
Figure = Callable[[str], Column]


def _shown() -> Column:
    return F.coalesce("value.display", "value_raw")


def _fact() -> Column:
    return F.struct(*PLACE, "doc_type", "rank", "value", _shown().alias("shown"))


def _first(when: Column, by: Column) -> Column:
    """Of the facts that hold, the one with the least ``by``; among these the first by document and place."""
    return F.min(F.when(when, F.struct(by.alias("by"), _fact().alias("fact"))))["fact"]


def _best(when: Column) -> Column:
    """Highest authority, first in load order."""
    return _first(when, -F.col("rank"))


def _read(name: str, part: str | None = None) -> Column:
    """Facts of a field whose value could be read."""
    value = F.col(f"value.{part}" if part else "value")
    return (F.col("field") == name) & value.isNotNull()


def _text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _said(c: Column) -> Column:
    return c.cast("string")


@dataclass(frozen=True)
class Check:
    """A kind of check, in terms of a rule, a fact and the figures of the fact's engagement.

    gathers: the figures, as aggregates over an engagement's facts; each must combine before a shuffle.
    judges: outcome, its words without the facts that are off, and the leading facts that it rests on.
    weighs: which facts are held against the figures (of the fact alone), and their role (of both); none: the figures say all.
    off: how the words name a fact that is off; none: they do not.

    Called with (facts, rule, domain) it is a check of its own.
    """

    gathers: Callable[[C.Rule], dict[str, Column]]
    judges: Callable[[C.Rule, C.Domain, Figure], tuple[Column, Column, list[Column]]]
    weighs: Callable[[C.Rule, Figure], tuple[Column, Column]] | None = None
    off: str | None = None

    def __call__(self, facts: DataFrame, rule: C.Rule, domain: C.Domain) -> DataFrame:
        return _Examined(facts, [(rule, self)], domain).findings()


def _gather_present(rule: C.Rule) -> dict[str, Column]:
    return {"best": _best(F.col("field") == rule.params["field"]), "authority": F.max_by(_fact(), F.struct("rank", "document", -F.col("char_start")))}


def _judge_present(rule: C.Rule, domain: C.Domain, figure: Figure) -> tuple[Column, Column, list[Column]]:
    name, best = rule.params["field"], figure("best")
    if not any(name in s for s in domain.schemas.values()):
        return F.lit(UNJUDGED), F.lit(f"no schema declares {name}, so nothing can answer this rule"), []
    detail = F.when(best.isNotNull(), _text(f"{name} is stated as ", best["shown"], " in ", best["document"])).otherwise(F.lit(f"no document states {name}"))
    return F.when(best.isNotNull(), SATISFIED).otherwise(VIOLATED), detail, [F.coalesce(best, figure("authority"))]


def _gather_governing(rule: C.Rule) -> dict[str, Column]:
    stated, rank, text = _read(rule.params["field"]), F.col("rank"), F.col("value.canonical").alias("text")
    return {
        "stated": F.count_if(stated),
        "lead": _best(stated),
        "low": F.min(F.when(stated, F.struct((-rank).alias("by"), text)))["text"],
        "high": F.max(F.when(stated, F.struct(rank.alias("by"), text)))["text"],
    }


def _weigh_governing(rule: C.Rule, figure: Figure) -> tuple[Column, Column]:
    must, top = rule.params.get("must_match") or [], figure("lead")["rank"]
    follows = F.col("doc_type").isin(*must) if must else F.lit(True)
    agrees = F.when(values_agree(figure("lead")["value"], F.col("value")), BOUND).otherwise(OFF)
    return _read(rule.params["field"]), F.when(F.col("rank") == top, TOP).when((F.col("rank") < top) & follows, agrees)


def _judge_governing(rule: C.Rule, domain: C.Domain, figure: Figure) -> tuple[Column, Column, list[Column]]:
    name, lead, off, follow = rule.params["field"], figure("lead"), figure(OFF), figure(BOUND) + figure(OFF)
    few, unsettled = figure("stated") < 2, ~figure("low").eqNullSafe(figure("high"))
    outcome = F.when(few | unsettled | (follow == 0), UNJUDGED).when(off == 0, SATISFIED).otherwise(VIOLATED)
    detail = (
        F.when(few, _text(_said(figure("stated")), f" document(s) state {name}; two are needed"))
        .when(unsettled, _text(_said(figure(TOP)), f" documents of equal authority differ on {name}; that is a conflict, not a finding"))
        .when(follow == 0, _text(f"nothing that has to follow {name} states it"))
        .when(off == 0, _text(f"all that follow {name} agree with ", lead["document"], " (", lead["shown"], ")"))
        .otherwise(_text(lead["doc_type"], " ", lead["document"], f" governs {name} at ", lead["shown"], ", but "))
    )
    return outcome, detail, [lead]


def _gather_sum(rule: C.Rule) -> dict[str, Column]:
    parts, caps, number = _read(rule.params["sum_of"], "number"), _read(rule.params["limit"], "number"), F.col("value.number")
    return {"parts": F.count_if(parts), "caps": F.count_if(caps), "total": F.sum(F.when(parts, number)).cast("decimal(38,10)"), "cap": _first(caps, number)}


def _weigh_sum(rule: C.Rule, figure: Figure) -> tuple[Column, Column]:
    return _read(rule.params["sum_of"], "number"), F.lit(BOUND)


def _judge_sum(rule: C.Rule, domain: C.Domain, figure: Figure) -> tuple[Column, Column, list[Column]]:
    part, limit, total, cap = rule.params["sum_of"], rule.params["limit"], figure("total"), figure("cap")
    least, none, open_ = cap["value"]["number"], figure("parts") == 0, figure("caps") == 0
    head = _text(f"{part} totals ", plain(total), " across ", _said(figure("parts")), " fact(s), ")
    detail = (
        F.when(none, F.lit(f"no document states {part}"))
        .when(open_, _text(_said(figure("parts")), f" fact(s) state {part} but none states {limit}"))
        .when(total <= least, _text(head, "within the ", plain(least), " of ", cap["document"]))
        .otherwise(_text(head, "over the ", plain(least), " of ", cap["document"], " by ", plain((total - least).cast("decimal(38,10)"))))
    )
    return F.when(none | open_, UNJUDGED).when(total <= least, SATISFIED).otherwise(VIOLATED), detail, [cap]


def _gather_least(rule: C.Rule) -> dict[str, Column]:
    return {"given": F.count_if(_read(rule.params["field"], "number")), "floor": _best(_read(rule.params["minimum"], "number"))}


def _weigh_least(rule: C.Rule, figure: Figure) -> tuple[Column, Column]:
    short = F.col("value.number") < figure("floor")["value"]["number"]
    return _read(rule.params["field"], "number"), F.when(short, OFF).otherwise(BOUND)


def _judge_least(rule: C.Rule, domain: C.Domain, figure: Figure) -> tuple[Column, Column, list[Column]]:
    name, minimum, floor = rule.params["field"], rule.params["minimum"], figure("floor")
    none, open_, least = figure("given") == 0, floor.isNull(), plain(floor["value"]["number"])
    detail = (
        F.when(none, F.lit(f"no document states {name}"))
        .when(open_, F.lit(f"no document states {minimum}, so there is no minimum"))
        .when(figure(OFF) == 0, _text(f"{name} meets the ", least, " of ", floor["document"]))
        .otherwise(_text(floor["document"], f" requires {minimum} of ", least, ", but "))
    )
    return F.when(none | open_, UNJUDGED).when(figure(OFF) == 0, SATISFIED).otherwise(VIOLATED), detail, [floor]


def _gather_dates(rule: C.Rule) -> dict[str, Column]:
    start, months = _read(rule.params["start"], "as_date"), rule.params.get("plus_months")
    ends = {"term": _best(_read(months, "number"))} if months else {}
    return {"dated": F.count_if(_read(rule.params["value"], "as_date")), "start": _first(start, F.col("value.as_date")), **ends}


def _term(rule: C.Rule, figure: Figure) -> tuple[Column, Column]:
    begins = figure("start")["value"]["as_date"]
    if not rule.params.get("plus_months"):
        return begins, F.lit(None).cast("date")
    return begins, F.add_months(begins, figure("term")["value"]["number"].cast("int"))


def _weigh_dates(rule: C.Rule, figure: Figure) -> tuple[Column, Column]:
    day, (begins, ends) = F.col("value.as_date"), _term(rule, figure)
    return _read(rule.params["value"], "as_date"), F.when((day < begins) | F.coalesce(day > ends, F.lit(False)), OFF).otherwise(BOUND)


def _judge_dates(rule: C.Rule, domain: C.Domain, figure: Figure) -> tuple[Column, Column, list[Column]]:
    name, start, months = rule.params["value"], rule.params["start"], rule.params.get("plus_months")
    begins, ends = _term(rule, figure)
    none, open_, endless = figure("dated") == 0, figure("start").isNull(), figure("term").isNull() if months else F.lit(False)
    window = _text(_said(begins), F.coalesce(_text(" to ", _said(ends)), F.lit(" onwards")))
    detail = (
        F.when(none, F.lit(f"no document states {name}"))
        .when(open_, F.lit(f"no document states {start}, so the term has no beginning"))
        .when(endless, F.lit(f"no document states {months}, so the term has no end"))
        .when(figure(OFF) == 0, _text(f"every {name} is in the term (", window, ")"))
        .otherwise(_text("the term runs ", window, ", but "))
    )
    outcome = F.when(none | open_ | endless, UNJUDGED).when(figure(OFF) == 0, SATISFIED).otherwise(VIOLATED)
    return outcome, detail, [figure("start"), *([figure("term")] if months else [])]


field_present = Check(_gather_present, _judge_present)
matches_governing = Check(_gather_governing, _judge_governing, _weigh_governing, " states ")
sum_within_limit = Check(_gather_sum, _judge_sum, _weigh_sum)
at_least = Check(_gather_least, _judge_least, _weigh_least, " gives ")
date_within = Check(_gather_dates, _judge_dates, _weigh_dates, " is dated ")

#: Kinds and their checks over facts; a domain may register more, as a Check or any function of (facts, rule, domain).
KINDS = {"field_present": field_present, "matches_governing": matches_governing, "sum_within_limit": sum_within_limit, "at_least": at_least, "date_within": date_within}


class _Examined:
    """What some checks find over some facts, as frames that share the figures and the evidence, each written once."""

    def __init__(self, facts: DataFrame, checks: list[tuple[C.Rule, Check]], domain: C.Domain):
        self.checks, self.domain = checks, domain
        # written first: inlined into so many aggregates, the reading of values would be planned and computed for each
        facts = stored(facts.select(*ENTITY, "field", *PLACE, "doc_type", "rank", "value", "value_raw"))
        figures = [c.alias(f"r{i}_{n}") for i, (rule, check) in enumerate(checks) for n, c in check.gathers(rule).items()]
        self.figures = stored(facts.groupBy(*ENTITY).agg(*figures))
        self.evidence = self._evidence(facts)

    def _heads(self, i: int) -> Column:
        """The passages of the leading facts, in order and once each."""
        rule, check = self.checks[i]
        cites = [F.struct(*[f[p].alias(p) for p in PLACE]) for f in check.judges(rule, self.domain, lambda n: F.lit(0) if n in (TOP, BOUND, OFF) else F.col(f"r{i}_{n}"))[2]]
        return F.array_distinct(F.array_compact(F.array(*cites))) if cites else F.array().cast(CITES)

    def _evidence(self, facts: DataFrame) -> DataFrame | None:
        """pile_id, entity_key, rule (its place), role, document, char_start, char_end, shown, ahead: whether the passage is a leading fact's.

        Facts and figures both come to the join by a plain exchange, so that a hot engagement is split; the rows are written as they
        leave the join, as an aggregation on its key would undo that.
        """
        weighed = {i: check.weighs(rule, lambda n, i=i: F.col(f"r{i}_{n}")) for i, (rule, check) in enumerate(self.checks) if check.weighs}
        if not weighed:
            return None
        here = F.struct(*PLACE)
        roles = [F.when(takes & role.isNotNull(), F.struct(F.lit(i).alias("rule"), role.alias("role"), F.array_contains(self._heads(i), here).alias("ahead"))) for i, (takes, role) in weighed.items()]
        asked = facts.where(reduce(or_, [takes for takes, _ in weighed.values()])).select(*ENTITY, "field", *PLACE, "doc_type", "rank", "value", _shown().alias("shown"))
        figures = self.figures.withColumnsRenamed({k: f"of_{k}" for k in ENTITY})
        met = asked.join(figures, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in ENTITY]))
        return stored(met.select(*ENTITY, *PLACE, "shown", F.explode(F.array_compact(F.array(*roles))).alias("r")).select(*ENTITY, "r.*", *PLACE, "shown"))

    def _judged(self, words: bool) -> DataFrame:
        """One row per rule and engagement: rule (its place), rule_key, severity, outcome, head (words), heads (leading passages), cites (the role cited), n_citations."""
        rows, counted = self.figures, self.evidence is not None
        if counted:
            # first by passage, which removes repeats and is no hot key, then by engagement
            places = self.evidence.groupBy(*ENTITY, "rule", "role", "ahead", *PLACE).agg(F.count("*").alias("n"))
            one = lambda i, role: (F.col("rule") == i) & (F.col("role") == role)
            sums = [F.sum(F.when(one(i, role), F.col("n"))).alias(f"n{i}_{role}") for i in range(len(self.checks)) for role in (TOP, BOUND, OFF)]
            cited = [F.count_if(one(i, role) & ~F.col("ahead")).alias(f"c{i}_{role}") for i in range(len(self.checks)) for role in (BOUND, OFF)]
            counts = places.groupBy(*ENTITY).agg(*sums, *cited).withColumnsRenamed({k: f"of_{k}" for k in ENTITY})
            rows = rows.join(counts, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in ENTITY]), "left")
        number = lambda name: F.coalesce(F.col(name), F.lit(0).cast("long")) if counted else F.lit(0).cast("long")
        found = []
        for i, (rule, check) in enumerate(self.checks):
            outcome, head, _ = check.judges(rule, self.domain, lambda n, i=i: number(f"n{i}_{n}") if n in (TOP, BOUND, OFF) else F.col(f"r{i}_{n}"))
            found.append(
                F.struct(
                    F.lit(i).alias("rule"), F.lit(rule.key).alias("rule_key"), F.lit(rule.severity).alias("severity"), outcome.alias("outcome"), (head if words else F.lit(None).cast("string")).alias("head"),
                    self._heads(i).alias("heads"), (number(f"n{i}_{OFF}") > 0).alias("some_off"), number(f"c{i}_{OFF}").alias("n_off"), number(f"c{i}_{BOUND}").alias("n_bound"),
                )
            )
        each = rows.select(*ENTITY, F.explode(F.array(*found)).alias("f")).select(*ENTITY, "f.*")
        open_, n = F.col("outcome") == UNJUDGED, F.size("heads") + F.when(F.col("some_off"), F.col("n_off")).otherwise(F.col("n_bound"))
        return each.select(
            *ENTITY, "rule", "rule_key", "severity", "outcome", "head", F.when(open_, F.array().cast(CITES)).otherwise(F.col("heads")).alias("heads"),
            F.when(open_, None).when(F.col("some_off"), OFF).otherwise(BOUND).alias("cites"), F.when(open_, 0).otherwise(n).cast("long").alias("n_citations"),
        )

    def outcomes(self) -> DataFrame:
        return self._judged(words=False).select("rule_key", "severity", *ENTITY, "outcome", "n_citations")

    def citations(self, judged: DataFrame | None = None) -> DataFrame:
        """rule (its place), rule_key, pile_id, entity_key, at (0 and up: leading facts, then one number for all others), document, char_start, char_end; each passage once."""
        judged = self._judged(words=False) if judged is None else judged
        leading = judged.select("rule", "rule_key", *ENTITY, F.posexplode("heads").alias("at", "c")).select("rule", "rule_key", *ENTITY, "at", "c.*")
        if self.evidence is None:
            return leading
        cited = judged.where("cites is not null").select(F.col("rule").alias("of_rule"), "rule_key", "cites", *[F.col(k).alias(f"of_{k}") for k in ENTITY])
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in ENTITY])
        rest = self.evidence.where("not ahead and role <> 'top'").join(cited, same & (F.col("rule") == F.col("of_rule")) & (F.col("role") == F.col("cites")))
        rest = rest.select("rule", "rule_key", *ENTITY, F.lit(len(self.checks) + 2).alias("at"), *PLACE).distinct()
        return leading.unionByName(rest)

    def _beside(self, out: DataFrame, part: DataFrame) -> DataFrame:
        keys = [*ENTITY, "rule"]
        theirs = part.withColumnsRenamed({k: f"of_{k}" for k in keys})
        return out.join(theirs, reduce(and_, [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in keys]), "left").drop(*[f"of_{k}" for k in keys])

    def _with_details(self, judged: DataFrame) -> DataFrame:
        """judged with detail: its head and, of a violation, the facts that are off."""
        words = {i: check.off for i, (_, check) in enumerate(self.checks) if check.off}
        if self.evidence is None or not words:
            return judged.withColumn("detail", F.col("head"))
        word = F.element_at(F.create_map(*[F.lit(x) for pair in words.items() for x in pair]), F.col("rule"))
        said = F.struct(*PLACE, _joined(word).alias("said"))
        listed = F.array_join(F.transform(F.sort_array(F.collect_list(said)), lambda m: m["said"]), ", ")
        part = self.evidence.where((F.col("role") == OFF) & F.col("rule").isin(*words)).groupBy(*ENTITY, "rule").agg(listed.alias("listed"))
        off = F.when(F.col("outcome") == VIOLATED, F.coalesce("listed", F.lit(""))).otherwise("")
        return self._beside(judged, part).withColumn("detail", F.concat("head", off))

    def worded(self) -> DataFrame:
        """The outcomes with their words, passages counted only."""
        return self._with_details(self._judged(words=True)).select("rule_key", "severity", *ENTITY, "outcome", "detail", "n_citations")

    def findings(self) -> DataFrame:
        """The outcomes with their words and their passages, each of them in one row."""
        cites = F.transform(F.array_sort(F.collect_list(F.struct("at", *PLACE))), lambda c: F.struct(*[c[p].alias(p) for p in PLACE]))
        judged = stored(self._judged(words=True))  # taken three times
        out = self._beside(self._with_details(judged), self.citations(judged).groupBy(*ENTITY, "rule").agg(cites.alias("citations")))
        return out.select("rule_key", "severity", *ENTITY, "outcome", "detail", F.coalesce("citations", F.array().cast(CITES)).alias("citations"))


def _joined(word: Column) -> Column:
    """document, word, shown; what is null is left out, and the word with it."""
    both = F.concat(F.col("document"), word, F.col("shown"))
    return F.coalesce(both, "document", "shown", F.lit(""))


def _constant(rows: DataFrame, rule: C.Rule, outcome: Column, detail: Column) -> DataFrame:
    """Findings that cite nothing."""
    return rows.select(F.lit(rule.key).alias("rule_key"), F.lit(rule.severity).alias("severity"), *ENTITY, outcome.alias("outcome"), detail.alias("detail"), F.array().cast(CITES).alias("citations"))


def no_quarantined_sources(documents: DataFrame, rule: C.Rule) -> DataFrame:
    """documents: pile_id, document, status, ingest_note."""
    bad = F.col("status") == "quarantined"
    note = F.when(bad, F.struct("document", F.concat_ws(": ", "document", F.left(F.coalesce("ingest_note", F.lit("no note")), F.lit(160))).alias("said")))
    rows = documents.groupBy("pile_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(note)).alias("bad")).withColumn("entity_key", F.lit("-"))
    detail = F.when(F.size("bad") == 0, _text("none of the ", _said(F.col("n")), " sources addresses the system")).otherwise(
        _text(_said(F.size("bad")), " source(s) address the system and were never used: ", F.array_join(F.transform("bad", lambda b: b["said"]), "; "))
    )
    return _constant(rows, rule, F.when(F.size("bad") == 0, SATISFIED).otherwise(VIOLATED), detail)


def _sources_outcome(documents: DataFrame, rule: C.Rule) -> DataFrame:
    """The same without the list, counted only."""
    rows = documents.groupBy("pile_id").agg(F.count_if(F.col("status") == "quarantined").alias("bad")).withColumn("entity_key", F.lit("-"))
    return _constant(rows, rule, F.when(F.col("bad") == 0, SATISFIED).otherwise(VIOLATED), F.lit(None).cast("string"))


def _over_all(facts: DataFrame, documents: DataFrame | None, domain: C.Domain | None, kinds, own, of_documents, as_outcome) -> DataFrame:
    domain, known, out = domain or C.Domain(), kinds or KINDS, []
    if together := [(rule, known[rule.kind]) for rule in domain.rules if isinstance(known.get(rule.kind), Check)]:
        out.append(own(_Examined(facts, together, domain)))
    for rule in domain.rules:
        if rule.kind == "no_quarantined_sources":
            if documents is not None:
                out.append(as_outcome(of_documents(documents, rule)))
        elif rule.kind not in known:
            piles = facts.select("pile_id").distinct().withColumn("entity_key", F.lit("-"))
            out.append(as_outcome(_constant(piles, rule, F.lit(UNJUDGED), F.lit(f"unknown check kind {rule.kind}"))))
        elif not isinstance(known[rule.kind], Check):
            out.append(as_outcome(known[rule.kind](facts, rule, domain)))
    return reduce(DataFrame.unionByName, out)


def examine(facts: DataFrame, documents: DataFrame | None = None, domain: C.Domain | None = None, kinds=None) -> DataFrame:
    """Every rule over every engagement, in one frame: rule_key, severity, pile_id, entity_key, outcome, detail, citations."""
    return _over_all(facts, documents, domain, kinds, _Examined.findings, no_quarantined_sources, lambda found: found)


def outcomes(facts: DataFrame, documents: DataFrame | None = None, domain: C.Domain | None = None, kinds=None) -> DataFrame:
    """The same without words and passages: rule_key, severity, pile_id, entity_key, outcome, n_citations.  Nothing of an engagement is put into one row."""
    counted = lambda found: found.select("rule_key", "severity", *ENTITY, "outcome", F.size("citations").cast("long").alias("n_citations"))
    return _over_all(facts, documents, domain, kinds, _Examined.outcomes, _sources_outcome, counted)


def worded(facts: DataFrame, documents: DataFrame | None = None, domain: C.Domain | None = None, kinds=None) -> DataFrame:
    """What ``examine`` finds with the number of passages in their stead: rule_key, severity, pile_id, entity_key, outcome, detail, n_citations."""
    counted = lambda found: found.withColumn("n_citations", F.size("citations").cast("long")).drop("citations")
    return _over_all(facts, documents, domain, kinds, _Examined.worded, no_quarantined_sources, counted)


def citations(facts: DataFrame, domain: C.Domain | None = None, kinds=None) -> DataFrame:
    """What the outcomes rest on as rows: rule_key, pile_id, entity_key, document, char_start, char_end."""
    domain, known = domain or C.Domain(), kinds or KINDS
    checks = [(rule, known[rule.kind]) for rule in domain.rules if isinstance(known.get(rule.kind), Check)]
    return _Examined(facts, checks, domain).citations().select("rule_key", *ENTITY, *PLACE)


def cited_documents(findings: DataFrame) -> DataFrame:
    """Findings with the documents that they cite, in order and once each."""
    return findings.withColumn("documents", F.array_distinct(F.transform("citations", lambda c: c["document"])))


def uncited_violations(found: DataFrame) -> DataFrame:
    """Of ``outcomes`` or ``examine``; must be empty: a violation rests on evidence, except where a source was never read."""
    n = F.col("n_citations") if "n_citations" in found.columns else F.size("citations")
    return found.where((F.col("outcome") == VIOLATED) & (n == 0) & (F.col("entity_key") != "-"))


def summary(findings: DataFrame) -> DataFrame:
    n = findings.groupBy("pile_id").agg(*[F.count_if(F.col("outcome") == o).alias(a) for o, a in ((VIOLATED, "violated"), (SATISFIED, "satisfied"), (UNJUDGED, "unjudged"))])
    words = F.when(F.col("violated") > 0, "violations to review").when(F.col("satisfied") > 0, "nothing violated").otherwise("nothing could be judged")
    return n.withColumn("verdict", words)
