"""Rules over random facts, against a plain loop over each engagement; plans without lists of facts."""

import random
from collections import defaultdict

import pytest

from accordant import config as C
from accordant.operators import rules as L
from accordant.plans.facts import with_values
from accordant.sources.sinks import stored

STATED = {
    "hourly_rate": ("money", ["USD 100", "USD 100.2", "USD 105", "EUR 100", "soon", None]),
    "payment_terms_days": ("number", ["30 days", "45 days", "thirty", None]),
    "hours_billed": ("number", ["10", "5", "60", "x"]),
    "hours_cap": ("number", ["100", "90"]),
    "notice_period_days": ("number", ["30 days", "60 days", "90 days"]),
    "termination_notice_days": ("number", ["60 days", "30 days"]),
    "liability_cap": ("money", ["USD 5", None]),
    "effective_date": ("date", ["2024-01-05", "2024-02-01", "never"]),
    "invoice_date": ("date", ["2024-03-01", "2023-12-01", "2024-09-01"]),
    "term_months": ("number", ["6", "5", "x"]),
}
SCHEMA = "pile_id string, entity_key string, document string, doc_type string, field string, value_type string, value_raw string, char_start int, char_end int, status string, role string, rule int, n long"


def _random_facts(spark, seed, n=900):
    rnd, rows = random.Random(seed), []
    for _ in range(n):
        field = rnd.choice(list(STATED))
        kind, raws = STATED[field]
        raw, at = rnd.choice(raws), rnd.choice([1, 5, 9])
        pile, entity = rnd.choice(["p", "q", None]), rnd.choice([*(f"e{k}" for k in range(25)), None])
        rows.append((pile, entity, f"d{rnd.randrange(8)}", rnd.choice(["msa", "amendment", "sow", "notice", "invoice", "other"]), field, kind, raw, at, at + len(raw or ""), "classified", "caller's", 7, 1))
    return stored(with_values(spark.createDataFrame(rows + rows[:30], SCHEMA)))


def _agree(a, b):
    if a.value_type != b.value_type:
        return False
    if a.value_type == "money":
        return a.currency == b.currency and abs(a.number - b.number) <= max(abs(a.number), abs(b.number)) * type(a.number)(C.MONEY_RELATIVE)
    return abs(a.number - b.number) <= max(abs(a.number), abs(b.number)) * type(a.number)(C.NUMBER_RELATIVE)


def _months_on(day, n):
    import calendar

    at = day.month - 1 + n
    year, month = day.year + at // 12, at % 12 + 1
    return day.replace(year=year, month=month, day=min(day.day, calendar.monthrange(year, month)[1]))


def _loop(facts, rule):
    """Outcome, the passages cited, and the documents that are named as off."""
    p, place = rule.params, lambda f: (f.document, f.char_start, f.char_end)
    order = lambda f: (*place(f), f.doc_type, f["rank"])
    facts = sorted(facts, key=order)
    of = lambda name, part: [f for f in facts if f.field == name and f.value is not None and (part is None or f.value[part] is not None)]
    best = lambda some: max(some, key=lambda f: f["rank"])  # noqa: E731  (the first of the greatest)
    none = ("not_enough_evidence", set(), [])
    if rule.kind == "field_present":
        if not any(p["field"] in s for s in C.SCHEMAS.values()):
            return none
        said = [f for f in facts if f.field == p["field"]]
        return ("satisfied", {place(best(said))}, []) if said else ("violated", None, [])
    if rule.kind == "matches_governing":
        said = of(p["field"], None)
        top = max((f["rank"] for f in said), default=0)
        lead, bound = [f for f in said if f["rank"] == top], [f for f in said if f["rank"] < top and f.doc_type in p["must_match"]]
        if len(said) < 2 or len({f.value.canonical for f in lead}) > 1 or not bound:
            return none
        heads, off = [lead[0]], [f for f in bound if not _agree(lead[0].value, f.value)]
    elif rule.kind == "sum_within_limit":
        bound, caps = of(p["sum_of"], "number"), of(p["limit"], "number")
        if not bound or not caps:
            return none
        heads = [min(caps, key=lambda f: f.value.number)]
        over = sum(f.value.number for f in bound) > heads[0].value.number
        return ("violated" if over else "satisfied", {place(f) for f in heads + bound}, [])
    elif rule.kind == "at_least":
        bound, floors = of(p["field"], "number"), of(p["minimum"], "number")
        if not bound or not floors:
            return none
        heads = [best(floors)]
        off = [f for f in bound if f.value.number < heads[0].value.number]
    else:
        bound, starts, terms = of(p["value"], "as_date"), of(p["start"], "as_date"), of(p["plus_months"], "number")
        if not bound or not starts or not terms:
            return none
        heads = [min(starts, key=lambda f: f.value.as_date), best(terms)]
        begins = heads[0].value.as_date
        off = [f for f in bound if not begins <= f.value.as_date <= _months_on(begins, int(heads[1].value.number))]
    return ("violated" if off else "satisfied", {place(f) for f in heads + (off or bound)}, [f.document for f in off])


@pytest.mark.parametrize("seed", [1, 2])
def test_every_rule_against_a_loop(spark, seed):
    facts = _random_facts(spark, seed)
    groups = defaultdict(list)
    for f in facts.collect():
        groups[f.pile_id, f.entity_key].append(f)
    found = {(r.rule_key, r.pile_id, r.entity_key): r for r in L.examine(facts).collect()}
    counted = {(r.rule_key, r.pile_id, r.entity_key): r for r in L.outcomes(facts).collect()}
    passages = defaultdict(set)
    for r in L.citations(facts).collect():
        passages[r.rule_key, r.pile_id, r.entity_key].add((r.document, r.char_start, r.char_end))
    rules = [r for r in C.RULES if r.kind != "no_quarantined_sources"]
    assert set(found) == set(counted) == {(r.key, *k) for r in rules for k in groups}
    seen = set()
    for rule in rules:
        for key, members in groups.items():
            row, (outcome, cited, off) = found[rule.key, *key], _loop(members, rule)
            got = [(c.document, c.char_start, c.char_end) for c in row.citations]
            assert row.outcome == counted[rule.key, *key].outcome == outcome, (rule.key, key)
            assert len(got) == len(set(got)) == counted[rule.key, *key].n_citations and set(got) == passages[rule.key, *key]
            assert set(got) == cited if cited is not None else len(got) == 1
            if off:
                tail = row.detail.split(", but ")[1].split(", ")
                assert [t.split(" ")[0] for t in tail] == off
            seen.add((rule.kind, outcome))
    assert len(seen) >= 11


def test_no_list_of_facts_before_the_outcome(spark):
    facts = _random_facts(spark, 3, 200)
    plan = L.outcomes(facts)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "collect_set" not in plan
    for check in L.KINDS.values():
        rule = next(r for r in C.RULES if L.KINDS.get(r.kind) is check)
        said = str([c._jc.toString() for c in check.gathers(rule).values()])
        assert "collect" not in said


def test_one_engagement_with_most_facts(spark):
    """Thousands of repeats of a few facts: counted each time, cited once."""
    facts = _random_facts(spark, 4, 300)
    many = facts.where("pile_id = 'p' and entity_key = 'e1'")
    for _ in range(3):
        many = many.unionByName(many).unionByName(many)
    many = stored(many)
    once = {r.rule_key: (r.outcome, r.n_citations) for r in L.outcomes(stored(many.distinct())).where("rule_key <> 'hours_within_sow_cap'").collect()}
    assert once == {r.rule_key: (r.outcome, r.n_citations) for r in L.outcomes(many).where("rule_key <> 'hours_within_sow_cap'").collect()}


def test_nothing(spark):
    facts = _random_facts(spark, 5, 50)
    assert L.examine(facts.where("false")).count() == L.outcomes(facts.where("false")).count() == L.citations(facts.where("false")).count() == 0


def test_words_without_passages_are_those_of_examine(spark):
    """Over random facts with nulls and repeats; nothing but the numbers of passages stands for them, and no plan nests them."""
    facts = _random_facts(spark, 11)
    key = lambda r: (r.rule_key, str(r.pile_id), str(r.entity_key))
    got = {key(r): (r.severity, r.outcome, r.detail, r.n_citations) for r in L.worded(facts).collect()}
    assert got and got == {key(r): (r.severity, r.outcome, r.detail, len(r.citations)) for r in L.examine(facts).collect()}


@pytest.mark.parametrize("name", ["a16_findings_per_outcome", "w8_finding_display", "u2_finding_proposals", "u12_finding_upsert", "r3_matches_governing", "r10_finding_order"])
def test_findings_are_not_judged_again_for_passages(spark, sf_dir, monkeypatch, name):
    """Queries that return no passages judge each fact once and gather no passages."""
    from accordant.plans import QUERIES

    calls, judged = [], L._Examined._judged
    monkeypatch.setattr(L._Examined, "_judged", lambda self, words: calls.append(words) or judged(self, words))
    monkeypatch.setattr(L._Examined, "citations", lambda self, *_: pytest.fail("passages are gathered"))
    QUERIES[name](spark, sf_dir)
    assert len(calls) == 1
