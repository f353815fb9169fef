"""The vendor-contract domain: taxonomy, schemas, normalization, precedence, rules, register."""

from __future__ import annotations

from dataclasses import dataclass, field

# Document types in ascending authority, and the fields each declares (name: type, required).
PRECEDENCE = {"invoice": 1, "notice": 2, "sow": 3, "msa": 4, "amendment": 5}
SCHEMAS: dict[str, dict[str, tuple[str, bool]]] = {
    "msa": {
        "counterparty": ("text", True), "effective_date": ("date", False), "term_months": ("number", False), "hourly_rate": ("money", False), "payment_terms_days": ("number", False),
        "termination_notice_days": ("number", False), "liability_cap": ("money", False), "auto_renews": ("text", False),
    },
    "amendment": {
        "counterparty": ("text", True), "amendment_number": ("number", False), "effective_date": ("date", False), "hourly_rate": ("money", False), "payment_terms_days": ("number", False),
        "termination_notice_days": ("number", False), "liability_cap": ("money", False), "term_months": ("number", False),
    },
    "sow": {
        "counterparty": ("text", True), "sow_number": ("text", False), "start_date": ("date", False), "end_date": ("date", False), "hours_cap": ("number", False), "hourly_rate": ("money", False),
        "total_value": ("money", False),
    },
    "invoice": {
        "counterparty": ("text", True), "invoice_number": ("text", False), "invoice_date": ("date", False), "service_period": ("text", False), "hourly_rate": ("money", False),
        "hours_billed": ("number", False), "amount_due": ("money", False), "payment_terms_days": ("number", False),
    },
    "notice": {"counterparty": ("text", True), "notice_type": ("text", False), "notice_date": ("date", False), "effective_date": ("date", False), "notice_period_days": ("number", False)},
}

# Normalization.
WORD_NUMBERS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12,
    "fifteen": 15, "twenty": 20, "thirty": 30, "forty": 40, "forty-five": 45, "fifty": 50, "sixty": 60, "ninety": 90, "one hundred": 100,
}
CURRENCY_CODES = ("USD", "EUR", "GBP", "INR", "CAD", "AUD", "JPY")
CURRENCY_SYMBOLS = {"US$": "USD", "$": "USD", "€": "EUR", "£": "GBP", "₹": "INR"}
DEFAULT_CURRENCY = "USD"
DURATION_UNITS = {
    "business days": "business_days", "business day": "business_days", "months": "months", "month": "months", "weeks": "weeks", "years": "years", "days": "days",
    "week": "weeks", "year": "years", "day": "days",
}
DAYS_IN = {"days": "1", "business_days": "1.4", "weeks": "7", "months": "30.44", "years": "365.25"}
DATE_FORMATS = (("d MMMM yyyy", "%d %B %Y"), ("MMMM d, yyyy", "%B %d, %Y"), ("yyyy-MM-dd", "%Y-%m-%d"), ("M/d/yyyy", "%m/%d/%Y"), ("d/M/yyyy", "%d/%m/%Y"))

# Reconciliation.
MONEY_RELATIVE, NUMBER_RELATIVE, DURATION_ABSOLUTE = "0.005", "0.001", "0"
INSTANCE_FIELDS = (
    "invoice_number", "invoice_date", "service_period", "hours_billed", "amount_due", "sow_number", "amendment_number", "start_date", "end_date",
    "effective_date", "notice_type", "notice_date", "notice_period_days", "total_value",
)
IDENTITY_FIELDS = ("counterparty",)
TIME_VARYING_FIELDS = ("hourly_rate", "payment_terms_days", "termination_notice_days", "liability_cap", "term_months")
EFFECTIVE_DATE_FIELD, ESCALATE_ABOVE = "effective_date", 25
STOPWORDS = ("inc", "incorporated", "llc", "llp", "ltd", "limited", "corp", "corporation", "co", "company", "plc", "gmbh", "pty", "and", "the")
NEAR_MATCH, SEARCH_FLOOR, CONFIDENT_MATCH = 0.55, 0.25, 0.35
CLASSIFY_FLOOR = 0.70


@dataclass(frozen=True)
class Rule:
    key: str
    severity: str
    kind: str
    params: dict = field(default_factory=dict)


# The playbook.
RULES = (
    Rule("rate_matches_current_agreement", "high", "matches_governing", {"field": "hourly_rate", "must_match": ["invoice"]}),
    Rule("hours_within_sow_cap", "high", "sum_within_limit", {"sum_of": "hours_billed", "limit": "hours_cap"}),
    Rule("payment_terms_consistent", "medium", "matches_governing", {"field": "payment_terms_days", "must_match": ["invoice"]}),
    Rule("termination_notice_observed", "high", "at_least", {"field": "notice_period_days", "minimum": "termination_notice_days"}),
    Rule("liability_cap_present", "medium", "field_present", {"field": "liability_cap"}),
    Rule("amendment_references_parent", "low", "field_present", {"field": "amends_agreement"}),
    Rule("invoice_within_term", "medium", "date_within", {"value": "invoice_date", "start": "effective_date", "plus_months": "term_months"}),
    Rule("no_instructions_in_sources", "high", "no_quarantined_sources"),
)
#: What each kind of check needs from a rule.
KINDS = {"field_present": ("field",), "matches_governing": ("field",), "sum_within_limit": ("sum_of", "limit"), "at_least": ("field", "minimum"), "date_within": ("value", "start"), "no_quarantined_sources": ()}

# Register sections (key, heading, fields).
SECTIONS = (
    ("parties", "Parties and Agreement", ("counterparty", "effective_date", "term_months", "auto_renews")),
    ("commercials", "Commercial Terms", ("hourly_rate", "payment_terms_days", "hours_cap", "total_value")),
    ("risk", "Risk and Exit", ("liability_cap", "termination_notice_days")),
    ("billing", "Billing Activity", ("invoice_number", "invoice_date", "service_period", "hours_billed", "amount_due")),
)
# Sections that are computed from disputes and from gaps (key, heading), after the others.
COMPUTED_SECTIONS = (("disagreements", "Where the Documents Disagree"), ("gaps", "What Could Not Be Established"))


@dataclass(frozen=True)
class Domain:
    """One configured domain; ``problems`` lists what it names and does not declare."""

    precedence: dict = field(default_factory=lambda: dict(PRECEDENCE))
    schemas: dict = field(default_factory=lambda: dict(SCHEMAS))
    rules: tuple = RULES
    sections: tuple = SECTIONS

    def problems(self) -> list[str]:
        out = [f"precedence names {t!r}, which has no schema" for t in self.precedence if t not in self.schemas]
        known = {f for fields in self.schemas.values() for f in fields}
        out += [f"section {key!r} has the undeclared field {f!r}" for key, _, fields in self.sections for f in fields if f not in known]
        for rule in self.rules:
            if rule.kind not in KINDS:
                out.append(f"rule {rule.key!r} has the unknown kind {rule.kind!r}")
            else:
                out += [f"rule {rule.key!r} lacks {p!r}" for p in KINDS[rule.kind] if p not in rule.params]
            out += [f"rule {rule.key!r} must match the undeclared type {t!r}" for t in rule.params.get("must_match", ()) if t not in self.schemas]
        return out

    def checked(self) -> "Domain":
        if found := self.problems():
            raise ValueError("; ".join(found))
        return self
