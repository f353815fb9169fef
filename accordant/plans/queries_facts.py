"""Values, agreement, conflicts and rules over the fact table."""

from __future__ import annotations

from pyspark.sql import functions as F

from accordant import config as C
from accordant.functions import normalize as N
from accordant.functions.agreement import values_agree
from accordant.operators import reconcile as R
from accordant.operators import reports as P
from accordant.operators import rules as E
from accordant.plans.facts import DOCS_SQL, FACTS_SQL, documents_of_orders, fact_table, facts, sourced, table
from accordant.plans.registry import query
from accordant.streaming.inbox import running_registry, updated

_SKIP = ", ".join(f"'{f}'" for f in (*C.INSTANCE_FIELDS, *C.IDENTITY_FIELDS))
_VARY = ", ".join(f"'{f}'" for f in C.TIME_VARYING_FIELDS)
WITH_FACTS = f"WITH {FACTS_SQL}"
CONFLICTS_SQL = f"""{FACTS_SQL},
comparable AS (SELECT * FROM facts WHERE field NOT IN ({_SKIP})),
against AS (
  SELECT *, first_value(number) OVER w AS n1, first_value(canonical) OVER w AS c1 FROM comparable
  WINDOW w AS (PARTITION BY pile_id, entity_key, field ORDER BY document, char_start)
),
conflicts AS (
  SELECT pile_id, entity_key, field, count(*) AS members, count(canonical) AS readable,
    bool_or(CASE value_type WHEN 'money' THEN abs(number - n1) > 0.005 * greatest(number, n1) WHEN 'number' THEN abs(number - n1) > 0.001 * greatest(number, n1) ELSE canonical <> c1 END) AS disputed
  FROM against GROUP BY ALL
),
members AS (SELECT c.* FROM comparable c JOIN conflicts k USING (pile_id, entity_key, field) WHERE k.disputed)"""
WITH_CONFLICTS = f"WITH {CONFLICTS_SQL}"


# ------------------------------------------------------------------ values


@query("SELECT l_orderkey, l_linenumber, l_partkey, CAST(trunc(l_quantity) AS BIGINT)::VARCHAR AS spoken, CAST(trunc(l_quantity) AS BIGINT) * 1000 AS bare FROM lineitem")
def n1_number(spark, sf_dir):
    q = F.col("l_quantity").cast("int").cast("string")
    rows = table(spark, sf_dir, "lineitem").withColumn("a", F.concat(F.lit("some ("), q, F.lit(") hours, 99 days"))).withColumn("b", F.concat(F.lit("USD "), q, F.lit(",000 a year")))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", N.plain(N.parse_number(F.col("a"))).alias("spoken"), N.parse_number(F.col("b")).cast("long").alias("bare"))


@query(
    """SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'EUR ' WHEN 1 THEN 'GBP ' WHEN 2 THEN 'USD ' ELSE 'JPY ' END
      || CAST(round_even(CAST(p_retailprice AS DECIMAL(18,3)) + 0.005, 2) AS DECIMAL(18,2)) AS canonical FROM part"""
)
def n2_money(spark, sf_dir):
    amount = (F.col("p_retailprice").cast("decimal(18,3)") + F.lit("0.005").cast("decimal(4,3)")).cast("string")
    kind = F.col("p_size") % 4
    raw = F.when(kind == 0, F.concat(F.lit("€"), amount)).when(kind == 1, F.concat(F.lit("gbp "), amount)).when(kind == 2, F.concat(F.lit("US$ "), amount)).otherwise(F.concat(amount, F.lit(" JPY")))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.lit("money").alias("value_type"), raw.alias("value_raw"))
    return N.with_value(rows).select("p_partkey", F.col("value.canonical").alias("canonical"))


@query(
    """SELECT p_partkey, p_size || CASE p_partkey % 4 WHEN 0 THEN ' days' WHEN 1 THEN ' business_days' WHEN 2 THEN ' months' ELSE '' END AS canonical,
      CASE p_partkey % 4 WHEN 3 THEN 'number' ELSE 'duration' END AS kind FROM part"""
)
def n3_duration(spark, sf_dir):
    unit = F.col("p_partkey") % 4
    raw = F.concat(F.lit("a term of "), F.col("p_size").cast("string"), F.when(unit == 0, " calendar days").when(unit == 1, " business days").when(unit == 2, " Months").otherwise(""))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.lit("duration").alias("value_type"), raw.alias("value_raw"))
    return N.with_value(rows).select("p_partkey", F.col("value.canonical").alias("canonical"), F.col("value.value_type").alias("kind"))


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 AND day(d) <= 12 THEN make_date(year(d), day(d), month(d)) ELSE d END AS day_read, (o_orderkey % 5 IN (3, 4) AND day(d) <= 12) AS doubtful
      FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)"""
)
def n4_date(spark, sf_dir):
    d, kind = F.to_date("o_orderdate"), F.col("o_orderkey") % 5
    shapes = [F.date_format(d, x) for x in ("d MMMM yyyy", "MMMM d, yyyy", "yyyy-MM-dd", "M/d/yyyy", "d/M/yyyy")]
    raw = F.when(kind == 0, shapes[0]).when(kind == 1, shapes[1]).when(kind == 2, shapes[2]).when(kind == 3, shapes[3]).otherwise(shapes[4])
    return table(spark, sf_dir, "orders").select("o_orderkey", N.parse_date(raw).alias("day_read"), N.ambiguous_date(raw).alias("doubtful"))


@query("SELECT c_custkey, lower(trim(c_name)) || ' of strasse' AS canonical, c_name || ' of Straße' AS display FROM customer")
def n5_text(spark, sf_dir):
    raw = F.concat(F.lit("  "), F.col("c_name"), F.lit(" \t of\n Straße "))
    rows = N.with_value(table(spark, sf_dir, "customer").select("c_custkey", F.lit("text").alias("value_type"), raw.alias("value_raw")))
    return rows.select("c_custkey", F.col("value.canonical").alias("canonical"), F.col("value.display").alias("display"))


@query("SELECT s_suppkey, rtrim(rtrim(CAST(CAST(s_acctbal AS DECIMAL(18,4)) AS VARCHAR), '0'), '.') AS shown FROM supplier")
def n6_plain(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", N.plain(F.col("s_acctbal").cast("decimal(18,4)")).alias("shown"))


@query(f"{WITH_FACTS} SELECT pile_id, field, value_type, count(*) AS n, count(canonical) AS readable, min(canonical) AS low, max(canonical) AS high FROM facts GROUP BY ALL")
def n7_dispatch(spark, sf_dir):
    # counted by text first: the extremes of texts are an aggregate by sorting, here of the distinct ones only
    keys = ["pile_id", "field", "value_type"]
    each = sourced(spark, sf_dir).groupBy(*keys, F.col("value.canonical").alias("canonical")).agg(F.count("*").alias("n"), F.count("value").alias("readable"))
    return each.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("readable").alias("readable"), F.min("canonical").alias("low"), F.max("canonical").alias("high"))


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, abs(a - b) <= 0.005 * greatest(a, b) AS agrees
      FROM (SELECT *, CAST(l_extendedprice / l_quantity AS DECIMAL(18,2)) AS a, CAST(p_retailprice AS DECIMAL(18,2)) AS b FROM lineitem JOIN part ON l_partkey = p_partkey)"""
)
def n8_agreement(spark, sf_dir):
    spoken = lambda c: F.concat(F.lit("$"), N.cents_of(c).cast("string"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.lit("money").alias("kind"), spoken(F.col("l_extendedprice") / F.col("l_quantity")).alias("paid"))
    parts = table(spark, sf_dir, "part").select("p_partkey", F.lit("money").alias("kind"), spoken(F.col("p_retailprice")).alias("listed"))
    # a price is read once: a part's before its lines meet it
    parts = N.with_value(parts, "kind", "listed", "b").select("p_partkey", "b")
    both = N.with_value(lines, "kind", "paid", "a").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return both.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", values_agree(F.col("a"), F.col("b")).alias("agrees"))


@query(f"{WITH_FACTS} SELECT document, field, char_start, canonical FROM facts WHERE field IN ('payment_terms_days', 'hourly_rate')")
def n9_renormalise(spark, sf_dir):
    rows = sourced(spark, sf_dir).where(F.col("field").isin("payment_terms_days", "hourly_rate"))
    return rows.select("document", "field", "char_start", F.col("value.canonical").alias("canonical"))


@query("SELECT c_custkey, trim(regexp_replace(lower(c_name || ' & Co., Ltd.'), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM customer")
def n10_slug(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", N.slug(F.concat("c_name", F.lit(" & Co., Ltd."))).alias("slug"))


@query("SELECT s_suppkey, regexp_replace(lower(s_name), '[^a-z0-9]+', ' ', 'g') || ' trading' AS tokens FROM supplier")
def n11_tokens(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(N.significant_tokens(F.concat(F.lit("The "), F.col("s_name"), F.lit(" Trading Company, Inc."))), " ").alias("tokens"))


@query("SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + to_months(CAST(o_orderkey % 25 AS INT)) AS DATE) AS ends FROM orders")
def n12_months(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.add_months(F.to_date("o_orderdate"), (F.col("o_orderkey") % 25).cast("int")).alias("ends"))


@query("SELECT doc_id, CASE WHEN length(f) > 72 THEN substr(f, 1, 71) || '…' ELSE f END AS cell FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS f FROM documents)")
def n13_trim(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", N.trimmed(F.col("text")).alias("cell"))


# ------------------------------------------------------- grouping and conflict


@query(f"{WITH_FACTS} SELECT pile_id, entity_key, field, count(*) AS members, count(DISTINCT document) AS documents FROM facts GROUP BY ALL")
def a1_group_facts(spark, sf_dir):
    return R.grouped(sourced(spark, sf_dir))


@query(f"{WITH_FACTS} SELECT pile_id, field, count(*) AS members FROM facts WHERE field IN ({_SKIP}) GROUP BY ALL")
def a2_per_document_fields(spark, sf_dir):
    return R.per_document(sourced(spark, sf_dir))


@query(f"{WITH_CONFLICTS} SELECT * FROM conflicts")
def a3_conflict_detect(spark, sf_dir):
    return R.conflicts(fact_table(spark, sf_dir))


@query(
    f"""{WITH_CONFLICTS}
    SELECT pile_id, entity_key, field, document, char_start, CAST(dense_rank() OVER (PARTITION BY pile_id, entity_key, field ORDER BY first_seen) AS INT) AS cluster
    FROM (SELECT *, min(document || lpad(CAST(char_start AS VARCHAR), 9, '0')) OVER (PARTITION BY pile_id, entity_key, field, canonical) AS first_seen FROM comparable)"""
)
def a4_cluster_ids(spark, sf_dir):
    return R.cluster_ids(fact_table(spark, sf_dir))


@query(
    f"""{WITH_CONFLICTS} SELECT pile_id, entity_key, field, document, doc_type, canonical, char_start FROM (
      SELECT c.*, row_number() OVER (PARTITION BY pile_id, entity_key, field ORDER BY rank DESC, document, char_start) AS r FROM comparable c JOIN conflicts k USING (pile_id, entity_key, field) WHERE NOT k.disputed
    ) WHERE r = 1"""
)
def a5_agreed(spark, sf_dir):
    return R.agreed(fact_table(spark, sf_dir)).select("pile_id", "entity_key", "field", "document", "doc_type", F.col("value.canonical").alias("canonical"), "char_start")


@query(f"{WITH_FACTS} SELECT pile_id, document, max_by(as_date, char_start) AS effective FROM facts WHERE field = 'effective_date' GROUP BY ALL")
def a6_effective_dates(spark, sf_dir):
    return R.effective_dates(fact_table(spark, sf_dir))


PROPOSALS_SQL = f"""{CONFLICTS_SQL},
eff AS (SELECT pile_id, document, max_by(as_date, char_start) AS effective FROM facts WHERE field = 'effective_date' GROUP BY ALL),
ranked_members AS (SELECT m.*, e.effective, max(rank) OVER (PARTITION BY m.pile_id, entity_key, field) AS top FROM members m LEFT JOIN eff e USING (pile_id, document)),
tied AS (
  SELECT pile_id, entity_key, field, count(DISTINCT canonical) AS kinds, count(*) AS n_top, count(*) FILTER (WHERE effective IS NULL) AS n_undated, max(effective) AS latest,
    min_by(doc_type, document || lpad(CAST(char_start AS VARCHAR), 9, '0')) AS top_type, min_by(document, document || lpad(CAST(char_start AS VARCHAR), 9, '0')) AS d1, min_by(canonical, document || lpad(CAST(char_start AS VARCHAR), 9, '0')) AS v1
  FROM ranked_members WHERE rank = top GROUP BY ALL
),
leads AS (
  SELECT r.pile_id, r.entity_key, r.field, count(DISTINCT canonical) AS lead_kinds, count(*) AS n_lead,
    min_by(document, document || lpad(CAST(char_start AS VARCHAR), 9, '0')) AS d2, min_by(canonical, document || lpad(CAST(char_start AS VARCHAR), 9, '0')) AS v2
  FROM ranked_members r JOIN tied t USING (pile_id, entity_key, field) WHERE rank = top AND effective = latest GROUP BY ALL
),
decided AS (
  SELECT t.*, lead_kinds, n_lead, d2, v2, CASE WHEN kinds <= 1 THEN 'authority' WHEN n_undated > 0 THEN 'undated' WHEN lead_kinds > 1 THEN 'same_date' ELSE 'dated' END AS outcome
  FROM tied t LEFT JOIN leads l USING (pile_id, entity_key, field)
),
chosen AS (SELECT *, CASE outcome WHEN 'authority' THEN d1 WHEN 'dated' THEN d2 END AS proposed_document, CASE outcome WHEN 'authority' THEN v1 WHEN 'dated' THEN v2 END AS proposed_value FROM decided),
other AS (
  SELECT m.pile_id, m.entity_key, m.field, string_agg(DISTINCT m.doc_type || ' says ' || m.canonical, ', ' ORDER BY m.doc_type || ' says ' || m.canonical) AS others
  FROM members m JOIN chosen c USING (pile_id, entity_key, field) WHERE m.canonical <> c.proposed_value GROUP BY ALL
),
sizes AS (SELECT pile_id, entity_key, field, count(*) AS members FROM members GROUP BY ALL)"""


@query(f"WITH {PROPOSALS_SQL} SELECT pile_id, entity_key, field, members, outcome, proposed_document, proposed_value FROM chosen JOIN sizes USING (pile_id, entity_key, field)")
def a7_proposals(spark, sf_dir):
    return R.proposals(fact_table(spark, sf_dir)).drop("rationale")


@query(
    f"""WITH {PROPOSALS_SQL} SELECT pile_id, entity_key, field,
    CASE WHEN outcome IN ('authority', 'dated') THEN top_type || ' ' || proposed_document || ' has the highest authority and states ' || proposed_value || '; ' || coalesce(others, '')
        || CASE outcome WHEN 'dated' THEN '; of equal authority, it is the later, effective ' || latest ELSE '' END
        || CASE WHEN field IN ({_VARY}) THEN '; this field changes over time, so compare effective dates' ELSE '' END
      WHEN outcome = 'same_date' THEN n_lead || ' documents of equal authority take effect on ' || latest || ' and differ; a person must choose'
      ELSE n_top || ' documents of equal authority (' || top_type || ') differ and ' || n_undated || ' state no effective date; a person must choose' END AS rationale
    FROM chosen LEFT JOIN other USING (pile_id, entity_key, field)"""
)
def a8_rationale(spark, sf_dir):
    return R.proposals(fact_table(spark, sf_dir)).select("pile_id", "entity_key", "field", "rationale")


@query(
    f"""{WITH_CONFLICTS} SELECT pile_id, entity_key, field, string_agg(canonical, ' | ' ORDER BY first_seen) AS shown FROM (
      SELECT pile_id, entity_key, field, canonical, min((9 - rank) || document || lpad(CAST(char_start AS VARCHAR), 9, '0')) AS first_seen FROM members GROUP BY ALL) GROUP BY ALL"""
)
def a9_distinct_values(spark, sf_dir):
    return R.distinct_values(fact_table(spark, sf_dir)).withColumn("shown", F.array_join("shown", " | "))


@query(
    f"""{WITH_CONFLICTS} SELECT pile_id, count(*) FILTER (WHERE disputed) AS conflicts, count(*) FILTER (WHERE disputed) > 25 AS escalate,
      CASE WHEN count(*) FILTER (WHERE disputed) > 25 THEN count(*) FILTER (WHERE disputed) || ' conflicts are more than 25; the run itself needs review' END AS note FROM conflicts GROUP BY ALL"""
)
def a10_volume(spark, sf_dir):
    return R.volume(R.conflicts(fact_table(spark, sf_dir)))


# ----------------------------------------------------------------------- rules


def _judged(found):
    return found.select("rule_key", "severity", "pile_id", "entity_key", "outcome", "detail", F.size("citations").cast("long").alias("n_citations"))


def _rule(key: str):
    return next(r for r in C.RULES if r.key == key)


PRESENT_SQL = f"""{FACTS_SQL},
everyone AS (SELECT DISTINCT pile_id, entity_key FROM facts),
best_cap AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pile_id, entity_key ORDER BY rank DESC, document, char_start) AS r FROM facts WHERE field = 'liability_cap') WHERE r = 1),
present AS (
  SELECT 'liability_cap_present' AS rule_key, 'medium' AS severity, pile_id, entity_key, CASE WHEN b.document IS NULL THEN 'violated' ELSE 'satisfied' END AS outcome,
    CASE WHEN b.document IS NULL THEN 'no document states liability_cap' ELSE 'liability_cap is stated as ' || b.canonical || ' in ' || b.document END AS detail, CAST(1 AS BIGINT) AS n_citations
  FROM everyone LEFT JOIN best_cap b USING (pile_id, entity_key)
)"""


@query(f"WITH {PRESENT_SQL} SELECT * FROM present")
def r2_field_present(spark, sf_dir):
    return _judged(E.field_present(sourced(spark, sf_dir), _rule("liability_cap_present"), C.Domain()))


def _matches_sql(rule: str, severity: str, field: str, relative: str) -> str:
    return f"""
g_{field} AS (SELECT *, max(rank) OVER (PARTITION BY pile_id, entity_key) AS top, count(*) OVER (PARTITION BY pile_id, entity_key) AS stated FROM facts WHERE field = '{field}'),
a_{field} AS (
  SELECT pile_id, entity_key, max(stated) AS stated, count(DISTINCT canonical) FILTER (WHERE rank = top) AS kinds, count(*) FILTER (WHERE rank = top) AS n_top,
    count(*) FILTER (WHERE rank < top AND doc_type = 'invoice') AS bound,
    min_by(struct_pack(document := document, doc_type := doc_type, canonical := canonical, number := number), document || lpad(CAST(char_start AS VARCHAR), 9, '0')) FILTER (WHERE rank = top) AS lead
  FROM g_{field} GROUP BY ALL
),
o_{field} AS (
  SELECT g.pile_id, g.entity_key, count(*) AS off, string_agg(g.document || ' states ' || g.canonical, ', ' ORDER BY g.document, g.char_start) AS listed
  FROM g_{field} g JOIN a_{field} a USING (pile_id, entity_key) WHERE rank < top AND doc_type = 'invoice' AND abs(g.number - a.lead.number) > {relative} * greatest(g.number, a.lead.number) GROUP BY ALL
),
m_{field} AS (
  SELECT '{rule}' AS rule_key, '{severity}' AS severity, pile_id, entity_key,
    CASE WHEN coalesce(stated, 0) < 2 OR kinds > 1 OR bound = 0 THEN 'not_enough_evidence' WHEN off IS NULL THEN 'satisfied' ELSE 'violated' END AS outcome,
    CASE WHEN coalesce(stated, 0) < 2 THEN coalesce(stated, 0) || ' document(s) state {field}; two are needed' WHEN kinds > 1 THEN n_top || ' documents of equal authority differ on {field}; that is a conflict, not a finding'
      WHEN bound = 0 THEN 'nothing that has to follow {field} states it' WHEN off IS NULL THEN 'all that follow {field} agree with ' || a.lead.document || ' (' || a.lead.canonical || ')'
      ELSE a.lead.doc_type || ' ' || a.lead.document || ' governs {field} at ' || a.lead.canonical || ', but ' || listed END AS detail,
    CAST(CASE WHEN coalesce(stated, 0) < 2 OR kinds > 1 OR bound = 0 THEN 0 ELSE 1 + coalesce(off, bound) END AS BIGINT) AS n_citations
  FROM (SELECT DISTINCT pile_id, entity_key FROM facts) LEFT JOIN a_{field} a USING (pile_id, entity_key) LEFT JOIN o_{field} USING (pile_id, entity_key)
)"""


RATE_SQL = _matches_sql("rate_matches_current_agreement", "high", "hourly_rate", "0.005")
TERMS_SQL = _matches_sql("payment_terms_consistent", "medium", "payment_terms_days", "0.001")


@query(f"WITH {FACTS_SQL},{RATE_SQL},{TERMS_SQL} SELECT * FROM m_hourly_rate UNION ALL SELECT * FROM m_payment_terms_days")
def r3_matches_governing(spark, sf_dir):
    both = C.Domain(rules=(_rule("rate_matches_current_agreement"), _rule("payment_terms_consistent")))
    return E.worded(sourced(spark, sf_dir), domain=both).select("rule_key", "severity", "pile_id", "entity_key", "outcome", "detail", "n_citations")


SUM_SQL = """
s AS (SELECT pile_id, entity_key, sum(number) FILTER (WHERE field = 'hours_billed') AS total, count(*) FILTER (WHERE field = 'hours_billed') AS parts, min(number) FILTER (WHERE field = 'hours_cap') AS cap FROM facts GROUP BY ALL),
caps AS (SELECT pile_id, entity_key, min(document) AS document FROM facts WHERE field = 'hours_cap' GROUP BY ALL),
limits AS (
  SELECT 'hours_within_sow_cap' AS rule_key, 'high' AS severity, pile_id, entity_key,
    CASE WHEN parts = 0 OR cap IS NULL THEN 'not_enough_evidence' WHEN total <= cap THEN 'satisfied' ELSE 'violated' END AS outcome,
    CASE WHEN parts = 0 THEN 'no document states hours_billed' WHEN cap IS NULL THEN parts || ' fact(s) state hours_billed but none states hours_cap'
      ELSE 'hours_billed totals ' || total || ' across ' || parts || ' fact(s), ' || CASE WHEN total <= cap THEN 'within the ' || cap || ' of ' || document ELSE 'over the ' || cap || ' of ' || document || ' by ' || (total - cap) END END AS detail,
    CAST(CASE WHEN parts = 0 OR cap IS NULL THEN 0 ELSE 1 + parts END AS BIGINT) AS n_citations
  FROM s LEFT JOIN caps USING (pile_id, entity_key)
)"""


@query(f"WITH {FACTS_SQL},{SUM_SQL} SELECT * FROM limits")
def r4_sum_within_limit(spark, sf_dir):
    return _judged(E.sum_within_limit(sourced(spark, sf_dir), _rule("hours_within_sow_cap"), C.Domain()))


LEAST_SQL = """
floors AS (SELECT pile_id, entity_key, min(document) AS document, min(number) AS least FROM facts WHERE field = 'termination_notice_days' GROUP BY ALL),
given AS (SELECT f.pile_id, f.entity_key, count(*) AS n, count(*) FILTER (WHERE number < least) AS short, string_agg(f.document || ' gives ' || f.number, ', ' ORDER BY f.document, f.char_start) FILTER (WHERE number < least) AS listed
  FROM facts f LEFT JOIN floors l USING (pile_id, entity_key) WHERE field = 'notice_period_days' GROUP BY ALL),
minimums AS (
  SELECT 'termination_notice_observed' AS rule_key, 'high' AS severity, pile_id, entity_key,
    CASE WHEN n IS NULL OR least IS NULL THEN 'not_enough_evidence' WHEN short = 0 THEN 'satisfied' ELSE 'violated' END AS outcome,
    CASE WHEN n IS NULL THEN 'no document states notice_period_days' WHEN least IS NULL THEN 'no document states termination_notice_days, so there is no minimum'
      WHEN short = 0 THEN 'notice_period_days meets the ' || least || ' of ' || l.document ELSE l.document || ' requires termination_notice_days of ' || least || ', but ' || listed END AS detail,
    CAST(CASE WHEN n IS NULL OR least IS NULL THEN 0 WHEN short = 0 THEN 1 + n ELSE 1 + short END AS BIGINT) AS n_citations
  FROM (SELECT DISTINCT pile_id, entity_key FROM facts) LEFT JOIN given USING (pile_id, entity_key) LEFT JOIN floors l USING (pile_id, entity_key)
)"""


@query(f"WITH {FACTS_SQL},{LEAST_SQL} SELECT * FROM minimums")
def r5_at_least(spark, sf_dir):
    return _judged(E.at_least(sourced(spark, sf_dir), _rule("termination_notice_observed"), C.Domain()))


TERM_SQL = """
terms AS (SELECT pile_id, entity_key, min(as_date) FILTER (WHERE field = 'effective_date') AS begins, count(*) FILTER (WHERE field = 'term_months') AS n_terms, min(document) FILTER (WHERE field = 'term_months') AS term_doc,
  min_by(document, CAST(as_date AS VARCHAR) || document) FILTER (WHERE field = 'effective_date') AS start_doc, count(*) FILTER (WHERE field = 'invoice_date') AS n FROM facts GROUP BY ALL),
spans AS (SELECT *, CASE WHEN n_terms > 0 THEN CAST(begins + to_months(6) AS DATE) END AS ends FROM terms),
outs AS (SELECT f.pile_id, f.entity_key, count(*) AS off, string_agg(f.document || ' is dated ' || f.as_date, ', ' ORDER BY f.document) AS listed FROM facts f JOIN spans s USING (pile_id, entity_key)
  WHERE field = 'invoice_date' AND (as_date < begins OR as_date > ends) GROUP BY ALL),
dated AS (
  SELECT 'invoice_within_term' AS rule_key, 'medium' AS severity, pile_id, entity_key,
    CASE WHEN n = 0 OR begins IS NULL OR n_terms = 0 THEN 'not_enough_evidence' WHEN off IS NULL THEN 'satisfied' ELSE 'violated' END AS outcome,
    CASE WHEN n = 0 THEN 'no document states invoice_date' WHEN begins IS NULL THEN 'no document states effective_date, so the term has no beginning' WHEN n_terms = 0 THEN 'no document states term_months, so the term has no end'
      WHEN off IS NULL THEN 'every invoice_date is in the term (' || begins || ' to ' || ends || ')' ELSE 'the term runs ' || begins || ' to ' || ends || ', but ' || listed END AS detail,
    CAST(CASE WHEN n = 0 OR begins IS NULL OR n_terms = 0 THEN 0 ELSE 2 + coalesce(off, n) END AS BIGINT) AS n_citations
  FROM spans LEFT JOIN outs USING (pile_id, entity_key)
)"""


@query(f"WITH {FACTS_SQL},{TERM_SQL} SELECT * FROM dated")
def r6_date_within(spark, sf_dir):
    return _judged(E.date_within(sourced(spark, sf_dir), _rule("invoice_within_term"), C.Domain()))


def _sources(spark, sf_dir):
    return documents_of_orders(spark, sf_dir).select("pile_id", "document", "status", F.when(F.col("status") == "quarantined", F.concat(F.lit("held on "), F.col("day").cast("string"))).alias("ingest_note"))


SOURCES_SQL = """
held AS (SELECT pile_id, count(*) AS n, count(*) FILTER (WHERE status = 'quarantined') AS bad, string_agg(document || ': held on ' || day, '; ' ORDER BY document) FILTER (WHERE status = 'quarantined') AS listed FROM docs GROUP BY ALL),
sources AS (
  SELECT 'no_instructions_in_sources' AS rule_key, 'high' AS severity, pile_id, '-' AS entity_key, CASE WHEN bad = 0 THEN 'satisfied' ELSE 'violated' END AS outcome,
    CASE WHEN bad = 0 THEN 'none of the ' || n || ' sources addresses the system' ELSE bad || ' source(s) address the system and were never used: ' || listed END AS detail, CAST(0 AS BIGINT) AS n_citations FROM held
)"""


@query(f"WITH {DOCS_SQL},{SOURCES_SQL} SELECT * FROM sources")
def r7_no_quarantined_sources(spark, sf_dir):
    return _judged(E.no_quarantined_sources(_sources(spark, sf_dir), _rule("no_instructions_in_sources")))


ALL_SQL = f"""{PRESENT_SQL},{RATE_SQL},{TERMS_SQL},{SUM_SQL},{LEAST_SQL},{TERM_SQL},{SOURCES_SQL},
found AS (
  SELECT 'amendment_references_parent' AS rule_key, 'low' AS severity, pile_id, entity_key, 'not_enough_evidence' AS outcome, 'no schema declares amends_agreement, so nothing can answer this rule' AS detail, CAST(0 AS BIGINT) AS n_citations FROM everyone
  UNION ALL SELECT * FROM present UNION ALL SELECT * FROM m_hourly_rate UNION ALL SELECT * FROM m_payment_terms_days UNION ALL SELECT * FROM limits UNION ALL SELECT * FROM minimums UNION ALL SELECT * FROM dated UNION ALL SELECT * FROM sources
)"""


def _worded(spark, sf_dir):
    return E.worded(sourced(spark, sf_dir), _sources(spark, sf_dir))


def _outcomes(spark, sf_dir):
    return E.outcomes(sourced(spark, sf_dir), _sources(spark, sf_dir))


@query(f"WITH {ALL_SQL} SELECT rule_key, severity, pile_id, entity_key, outcome, n_citations FROM found")
def r1_examine(spark, sf_dir):
    return _outcomes(spark, sf_dir)


@query(f"WITH {ALL_SQL} SELECT CAST(count(*) AS BIGINT) AS uncited FROM found WHERE outcome = 'violated' AND n_citations = 0 AND entity_key <> '-'")
def r8_uncited_violations(spark, sf_dir):
    return E.uncited_violations(_outcomes(spark, sf_dir)).agg(F.count("*").alias("uncited"))


@query(
    f"""WITH {ALL_SQL} SELECT pile_id, count(*) FILTER (WHERE outcome = 'violated') AS violated, count(*) FILTER (WHERE outcome = 'satisfied') AS satisfied, count(*) FILTER (WHERE outcome = 'not_enough_evidence') AS unjudged,
      CASE WHEN count(*) FILTER (WHERE outcome = 'violated') > 0 THEN 'violations to review' WHEN count(*) FILTER (WHERE outcome = 'satisfied') > 0 THEN 'nothing violated' ELSE 'nothing could be judged' END AS verdict FROM found GROUP BY ALL"""
)
def r9_examine_summary(spark, sf_dir):
    return E.summary(_outcomes(spark, sf_dir))


@query(
    f"""WITH {ALL_SQL} SELECT rule_key, severity, pile_id, entity_key, row_number() OVER (PARTITION BY pile_id ORDER BY severity DESC, rule_key, entity_key) AS place FROM found WHERE outcome = 'violated'"""
)
def r10_finding_order(spark, sf_dir):
    return P.severity_order(_outcomes(spark, sf_dir).where("outcome = 'violated'")).select("rule_key", "severity", "pile_id", "entity_key", "place")


# ------------------------------------------------------------------ updates


_ARRIVED = ("ASIA", "EUROPE")


_TOUCHED = ", ".join(f"'{p}'" for p in _ARRIVED)
#: The facts of touched piles only, before conflicts are looked for.
_TOUCHED_SQL = CONFLICTS_SQL.replace("\nfacts AS (", "\nevery AS MATERIALIZED (", 1).replace(
    ",\ncomparable AS",
    f""",
touched AS (SELECT DISTINCT pile_id FROM every WHERE pile_id IN ({_TOUCHED}) AND CAST(substr(document, 7) AS BIGINT) % 97 = 0),
facts AS MATERIALIZED (SELECT * FROM every SEMI JOIN touched USING (pile_id)),
comparable AS""",
    1,
)


@query(f"WITH {_TOUCHED_SQL} SELECT * FROM conflicts")
def t6_incremental_update(spark, sf_dir):
    """Some documents of two piles arrive; conflicts of the piles touched come anew, from all their facts."""
    every = fact_table(spark, sf_dir)
    new = F.col("pile_id").isin(*_ARRIVED) & (F.substring("document", 7, 20).cast("long") % 97 == 0)
    return updated(every.where(~new), every.where(new), R.conflicts)


@query(f"{WITH_FACTS} SELECT pile_id, entity_key, min(document) AS name, count(*) AS facts FROM facts GROUP BY ALL")
def t9_running_registry(spark, sf_dir):
    """In batch; tests hold the stream against it."""
    rows = facts(spark, sf_dir).select("pile_id", "entity_key", F.col("document").alias("name"), F.struct("document", "char_start").alias("seq"))
    return running_registry(rows)
