"""Entity resolution and vectors over names, documents and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from accordant import config as C
from accordant.operators import entities as J
from accordant.operators import vectors as V
from accordant.plans.facts import DOCS_SQL, FACTS_SQL, documents_of_orders, facts, table
from accordant.plans.registry import query
from accordant.sources.sinks import stored


def _known(spark, sf_dir):
    from accordant.functions.normalize import slug

    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("engagement:"), slug(F.col("s_name"))).alias("entity_key"), F.col("s_name").alias("name"))


def _candidates(spark, sf_dir):
    n, s = F.col("s_suppkey"), F.col("s_name")
    kinds = [s, F.concat(F.lit("The "), s, F.lit(" Group, Inc.")), F.concat(s, F.lit(" and "), F.lit("Supplier#"), F.lpad((n % 7 + 1).cast("string"), 9, "0")), F.concat(F.lit("Suplier#"), F.substring(s, 10, 9), F.lit("x")), F.lit(" "), F.concat(F.lit("Wholly other firm "), n.cast("string"))]
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("k"), name.alias("name")) for i, name in enumerate(kinds)]))
    return table(spark, sf_dir, "supplier").select("s_suppkey", each.alias("c")).select((F.col("s_suppkey") * 10 + F.col("c.k")).alias("candidate_id"), "c.name")


NAMES_SQL = """known AS (SELECT 'engagement:' || trim(regexp_replace(lower(s_name), '[^a-z0-9]+', '-', 'g'), '-') AS entity_key, s_name AS name FROM supplier),
candidates AS (
  SELECT s_suppkey * 10 AS candidate_id, s_name AS name FROM supplier UNION ALL SELECT s_suppkey * 10 + 1, 'The ' || s_name || ' Group, Inc.' FROM supplier
  UNION ALL SELECT s_suppkey * 10 + 2, s_name || ' and Supplier#' || lpad(CAST(s_suppkey % 7 + 1 AS VARCHAR), 9, '0') FROM supplier UNION ALL SELECT s_suppkey * 10 + 3, 'Suplier#' || substr(s_name, 10, 9) || 'x' FROM supplier
  UNION ALL SELECT s_suppkey * 10 + 4, ' ' FROM supplier UNION ALL SELECT s_suppkey * 10 + 5, 'Wholly other firm ' || s_suppkey FROM supplier
),
ct AS (SELECT DISTINCT candidate_id, unnest(string_split(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g'), ' ')) AS token FROM candidates),
kt AS (SELECT DISTINCT entity_key, unnest(string_split(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g'), ' ')) AS token FROM known),
ks AS (SELECT entity_key, count(*) AS n FROM kt WHERE token <> '' GROUP BY ALL),
held AS (SELECT candidate_id, entity_key FROM ct JOIN kt USING (token) JOIN ks USING (entity_key) WHERE token <> '' GROUP BY candidate_id, entity_key, n HAVING count(*) = n),
divided AS (SELECT candidate_id, count(*) AS matches, CASE WHEN count(*) = 1 THEN min(entity_key) END AS entity_key, string_agg(entity_key, ',' ORDER BY entity_key) AS candidates FROM held GROUP BY ALL)"""


def _vectors_sql(name: str, source: str, id_col: str, text: str) -> str:
    """CTEs w_, f_ and v_<name>: words, features, unit vectors."""
    return f"""w_{name} AS (SELECT id, w FROM (SELECT {id_col} AS id, unnest(string_split(regexp_replace(lower({text}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' ')) AS w FROM {source}) WHERE w <> ''),
g_{name} AS (SELECT id, ' ' || w || ' ' AS p, unnest(range(1, length(w) + 1)) AS i FROM w_{name}),
f_{name} AS (SELECT id, feature, sum(weight) AS weight FROM (SELECT id, 'w:' || w AS feature, 1.5 AS weight FROM w_{name} UNION ALL SELECT id, 'g:' || substr(p, i, 3), 1.0 FROM g_{name}) GROUP BY ALL),
s_{name} AS (SELECT id, CAST('0x' || substr(sha256(feature), 1, 8) AS BIGINT) % 1024 AS bucket, sum(CASE WHEN substr(sha256(feature), 9, 1) < '8' THEN CAST(weight AS DOUBLE) ELSE -CAST(weight AS DOUBLE) END) AS x FROM f_{name} GROUP BY ALL HAVING x <> 0),
v_{name} AS (SELECT id, bucket, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS weight FROM s_{name})"""


@query("SELECT DISTINCT 'engagement:' || trim(regexp_replace(lower(s_name), '[^a-z0-9]+', '-', 'g'), '-') AS entity_key, s_suppkey * 10 AS candidate_id FROM supplier")
def j2_exact_match(spark, sf_dir):
    """Also J1: the exact step without aliases."""
    found = J.resolved(_candidates(spark, sf_dir), _known(spark, sf_dir), near=_no_neighbours)
    return found.where("method = 'exact'").select("candidate_id", "entity_key")


def _no_neighbours(candidates, known):
    return candidates.select("candidate_id", F.lit(None).cast("string").alias("entity_key"), F.lit(None).cast("double").alias("sim")).where("false")


@query(f"WITH {NAMES_SQL} SELECT candidate_id, entity_key FROM held")
def j3_containment(spark, sf_dir):
    return J.contained(_candidates(spark, sf_dir), _known(spark, sf_dir))


@query(f"WITH {NAMES_SQL} SELECT candidate_id, matches, candidates FROM divided WHERE matches > 1")
def j4_ambiguity(spark, sf_dir):
    found = J.containment(_candidates(spark, sf_dir), _known(spark, sf_dir)).where("matches > 1")
    return found.select("candidate_id", "matches", F.array_join("candidates", ",").alias("candidates"))


NEAR_SQL = f"""{NAMES_SQL},{_vectors_sql('c', 'candidates', 'candidate_id', 'name')},{_vectors_sql('k', 'known', 'entity_key', 'name')},
pairs AS (SELECT q.id AS candidate_id, i.id AS entity_key, sum(q.weight * i.weight) AS sim FROM v_c q JOIN v_k i USING (bucket) GROUP BY ALL HAVING sum(q.weight * i.weight) >= 0.55),
near AS (SELECT candidate_id, entity_key, sim FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY round(sim, 9) DESC, entity_key DESC) AS r FROM pairs) WHERE r = 1)"""


@query(f"WITH {NEAR_SQL} SELECT candidate_id, entity_key, round(sim, 6) AS sim FROM near")
def j5_near_match(spark, sf_dir):
    """Also V7: the nearest entity."""
    found = J.nearest(_candidates(spark, sf_dir), _known(spark, sf_dir))
    return found.select("candidate_id", "entity_key", F.round("sim", 6).alias("sim"))


@query(
    f"""WITH {NEAR_SQL}, s AS (SELECT c.*, trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM candidates c),
    r AS (SELECT s.candidate_id, s.slug, CASE WHEN trim(s.name) = '' THEN 'escalate_blank' WHEN s.slug = 'supplier-000000003' THEN 'alias' WHEN k.entity_key IS NOT NULL THEN 'exact' WHEN d.matches = 1 THEN 'containment' WHEN d.matches > 1 THEN 'escalate_ambiguous'
        WHEN n.entity_key IS NOT NULL THEN 'escalate_near' ELSE 'new' END AS method, k.entity_key AS ek, d.entity_key AS dk
      FROM s LEFT JOIN known k ON 'engagement:' || s.slug = k.entity_key LEFT JOIN divided d ON s.candidate_id = d.candidate_id LEFT JOIN near n ON s.candidate_id = n.candidate_id)
    SELECT candidate_id, method, CASE method WHEN 'alias' THEN 'engagement:house' WHEN 'exact' THEN ek WHEN 'containment' THEN dk WHEN 'new' THEN 'engagement:' || slug END AS entity_key FROM r"""
)
def j7_staged_resolution(spark, sf_dir):
    """Also J1, J6 and H1: aliases, new names, blanks and the near function."""
    found = J.resolved(_candidates(spark, sf_dir), _known(spark, sf_dir), aliases={"supplier-000000003": "engagement:house"})
    return found.select("candidate_id", "method", "entity_key")


def _stopwords_sql():
    return ", ".join(f"'{w}'" for w in C.STOPWORDS)


@query(
    f"""WITH {NAMES_SQL}, d AS (SELECT CAST(candidate_id % 5 AS VARCHAR) AS pile_id, lpad(CAST(candidate_id AS VARCHAR), 12, '0') AS document, trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM candidates),
    seen AS (SELECT pile_id, slug, min(document) AS first, list_filter(list_distinct(string_split(slug, '-')), lambda w: w NOT IN ({_stopwords_sql()})) AS tokens FROM d WHERE slug <> '' GROUP BY ALL),
    within AS (SELECT a.pile_id, a.slug, b.slug AS other FROM seen a JOIN seen b ON a.pile_id = b.pile_id AND b.first < a.first AND len(b.tokens) > 0 AND list_has_all(a.tokens, b.tokens)),
    keys AS (SELECT * FROM seen ANTI JOIN within USING (pile_id, slug)),
    inside AS (SELECT d.pile_id, d.document, count(*) AS n, min(k.slug) AS slug FROM d JOIN seen s USING (pile_id, slug) JOIN keys k ON k.pile_id = d.pile_id AND k.first < d.document AND k.slug <> d.slug AND len(k.tokens) > 0 AND list_has_all(s.tokens, k.tokens) GROUP BY ALL),
    r AS (SELECT d.pile_id, d.document, d.slug, h.slug AS in_slug, CASE WHEN d.slug = '' THEN 'escalate_blank' WHEN k.first = d.document THEN 'new' WHEN k.first IS NOT NULL THEN 'exact' WHEN h.n = 1 THEN 'containment' ELSE 'escalate_ambiguous' END AS method
      FROM d LEFT JOIN keys k USING (pile_id, slug) LEFT JOIN inside h ON h.pile_id = d.pile_id AND h.document = d.document)
    SELECT pile_id, document, method, 'engagement:' || CASE WHEN method IN ('new', 'exact') THEN slug WHEN method = 'containment' THEN in_slug END AS entity_key FROM r"""
)
def j8_ordered_resolution(spark, sf_dir):
    rows = _candidates(spark, sf_dir).select((F.col("candidate_id") % 5).cast("string").alias("pile_id"), F.lpad(F.col("candidate_id").cast("string"), 12, "0").alias("document"), "name")
    return J.resolved_in_order(rows)


@query(f"WITH {FACTS_SQL} SELECT DISTINCT pile_id, entity_key FROM facts")
def j9_known_keys(spark, sf_dir):
    return J.known_keys(facts(spark, sf_dir))


@query(f"WITH {DOCS_SQL} SELECT pile_id, entity_key, min_by(document, o_orderkey) AS name FROM docs GROUP BY ALL")
def j10_name_registry(spark, sf_dir):
    named = documents_of_orders(spark, sf_dir).select("pile_id", "entity_key", F.col("document").alias("name"), F.col("o_orderkey").alias("seq"))
    early = J.registry(named.where("seq < 1000"))
    return J.registry(named.where("seq >= 1000"), early)


@query(f"WITH {FACTS_SQL} SELECT f.document, field, char_start, d.day FROM facts f JOIN docs d USING (pile_id, document) WHERE document <> 'order-1'")
def j11_provenance(spark, sf_dir):
    docs = documents_of_orders(spark, sf_dir).select("pile_id", "document", "day")
    return J.with_provenance(facts(spark, sf_dir), docs, "order-1").select("document", "field", "char_start", "day")


@query(f"WITH {FACTS_SQL} SELECT document, char_start, field FROM facts WHERE field = 'hourly_rate'")
def j12_citations(spark, sf_dir):
    rows = facts(spark, sf_dir)
    cites = rows.where("field = 'hourly_rate'").select("document", "char_start", "char_end")
    return J.cited_spans(cites, rows.select("document", "char_start", "char_end", "field").distinct()).select("document", "char_start", "field")


@query(
    f"""WITH {DOCS_SQL} SELECT pile_id, 's' || o_orderkey AS section_key, doc_type, row_number() OVER (PARTITION BY pile_id ORDER BY day DESC, 's' || o_orderkey) AS place FROM docs"""
)
def j13_audit_trail(spark, sf_dir):
    docs = documents_of_orders(spark, sf_dir)
    audit = docs.select("pile_id", F.concat(F.lit("s"), F.col("o_orderkey").cast("string")).alias("section_key"), F.col("document").alias("cause_document"), F.col("day").alias("at"))
    return J.audit_with_cause(audit, docs).select("pile_id", "section_key", "doc_type", F.col("place").cast("long").alias("place"))


@query(f"WITH {DOCS_SQL} SELECT document, status = 'quarantined' AS held FROM docs")
def j14_quarantine_split(spark, sf_dir):
    docs = documents_of_orders(spark, sf_dir)
    bad = docs.where("status = 'quarantined'").select("document")
    held = docs.join(bad, "document", "left_semi").select("document", F.lit(True).alias("held"))
    return held.unionByName(docs.join(bad, "document", "left_anti").select("document", F.lit(False).alias("held")))


# ----------------------------------------------------------------- vectors (V)

_DOCS_V = _vectors_sql("d", "documents", "doc_id", "text")


@query(f"WITH {_DOCS_V} SELECT id, count(*) AS features, round(CAST(sum(weight) AS DOUBLE), 3) AS weight FROM f_d GROUP BY ALL")
def v1_features(spark, sf_dir):
    made = V.text_features(table(spark, sf_dir, "documents"), "doc_id", "text")
    return made.select("id", F.size("features").cast("long").alias("features"), F.round(F.aggregate("weights", F.lit(0.0), lambda s, x: s + x), 3).alias("weight"))


@query(f"WITH {_DOCS_V} SELECT id, bucket, round(weight, 6) AS weight FROM v_d")
def v2_vectors(spark, sf_dir):
    """Also V4: one pass for all texts."""
    made = V.as_rows(V.text_vectors(table(spark, sf_dir, "documents"), "doc_id", "text"))
    millionths = F.col("weight") * 1e6  # rounded as SQL does it, half away from zero; F.round goes through decimal text, row by row
    return made.select("id", "bucket", ((millionths + F.signum(millionths) * 0.5).cast("long") / F.lit(1e6)).alias("weight"))


@query("SELECT doc_id AS id, doc_id % 10 = 0 OR NOT regexp_matches(text, '[\\p{L}\\p{N}]') AS is_null FROM documents")
def v3_null_vectors(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").withColumn("t", F.when(F.col("doc_id") % 10 == 0, "?! …").otherwise(F.col("text")))
    return V.row_vectors(rows, "doc_id", "t").select("id", F.col("at").isNull().alias("is_null"))


_BENCH_V = _vectors_sql("b", "benchmark", "item_id", "text")


@query(
    f"""WITH {_BENCH_V}, pairs AS (SELECT q.id AS query_id, i.id, sum(q.weight * i.weight) AS sim FROM v_b q JOIN v_b i USING (bucket) GROUP BY ALL HAVING sum(q.weight * i.weight) >= 0.25)
    SELECT query_id, id, round(sim, 6) AS sim FROM pairs WHERE round(sim, 6) >= 0.251"""
)
def v6_similarity(spark, sf_dir):
    vecs = V.vectors(V.features(table(spark, sf_dir, "benchmark"), "item_id", "text"))
    return V.similar(vecs, vecs).select("query_id", "id", F.round("sim", 6).alias("sim")).where("sim >= 0.251")


def _spans(spark, sf_dir):
    """Documents as spans of their source's pile, with where they are from; those of one length are without a vector."""
    spans = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("pile_id"), F.format_string("f%08d", "doc_id").alias("document"), F.col("lang").alias("doc_type"), F.lit(1).alias("page_no"), F.lit(0).alias("char_start"), F.length("text").alias("char_end"), "text")
    return spans, stored(V.text_vectors(spans.where("char_end % 10 <> 0"), "id", "text"))


@query(
    f"""WITH has AS (SELECT * FROM documents WHERE length(text) % 10 <> 0), {_vectors_sql('d', 'has', 'doc_id', 'text')}, piles AS (SELECT doc_id AS id, source AS pile_id FROM documents),
    scoped AS (SELECT pile_id, v.* FROM v_d v JOIN piles USING (id)),
    pairs AS (SELECT q.id AS query_id, i.id, sum(q.weight * i.weight) AS sim FROM scoped q JOIN scoped i USING (pile_id, bucket) WHERE q.id % 50 = 0 GROUP BY ALL HAVING sum(q.weight * i.weight) >= 0.25),
    best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 6) DESC, id) AS place FROM pairs)
    SELECT query_id, id, place, source AS pile_id, 'f' || lpad(CAST(id AS VARCHAR), 8, '0') AS document, lang AS doc_type, 1 AS page_no, 0 AS char_start, CAST(length(text) AS INT) AS char_end, round(sim, 5) AS sim FROM best JOIN documents ON id = doc_id WHERE place <= 8"""
)
def v6_span_search(spark, sf_dir):
    """Every fiftieth document as a query within its own pile, against all spans of that pile that have a vector."""
    spans, vecs = _spans(spark, sf_dir)
    queries = vecs.where("id % 50 = 0").join(spans.select("id", "pile_id"), "id")
    found = V.search(queries, spans, vecs, 8)
    return found.select("query_id", "id", "place", "pile_id", "document", "doc_type", "page_no", "char_start", "char_end", F.round("sim", 5).alias("sim"))


def _embedded(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


_TOP_SQL = """q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id % 50 = 0),
sims AS (SELECT query_id, vec_id AS id, list_dot_product(qv, CAST(embedding AS DOUBLE[])) / sqrt(list_dot_product(qv, qv)) / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS sim FROM q, embeddings)"""


@query(f"WITH {_TOP_SQL} SELECT query_id, id, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS place FROM sims) WHERE place <= 10")
def w7_top_k(spark, sf_dir):
    items = _embedded(spark, sf_dir)
    return V.top_k(V.dense_best(items.where("id % 50 = 0"), items, 10), 10).select("query_id", "id", F.col("place").cast("long").alias("place"))


@query()
def v8_approximate(spark, sf_dir):
    """The vectors of the tables are spread evenly over their sphere, so that two thirds of the lists are probed for nine tenths of the neighbours."""
    items = _embedded(spark, sf_dir)
    return V.top_k(V.approximate(items, items.where("id % 50 = 0"), probes=22, k=10), 10).select("query_id", "id", "place")


@query(f"WITH {_TOP_SQL} SELECT query_id, id, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS place FROM sims) WHERE place <= 10")
def v8_all_lists(spark, sf_dir):
    """With every list probed the inverted file gives the exact neighbours: each vector is in one list."""
    items = _embedded(spark, sf_dir)
    return V.top_k(V.approximate(items, items.where("id % 50 = 0"), probes=V.LISTS, k=10), 10).select("query_id", "id", F.col("place").cast("long").alias("place"))


@query("SELECT source AS pile_id, count(*) AS spans, count(*) FILTER (WHERE doc_id % 10 <> 0 AND regexp_matches(text, '[\\p{L}\\p{N}]')) AS embedded FROM documents GROUP BY ALL")
def v9_index_status(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("pile_id"), "text")
    return V.index_status(docs, V.text_vectors(docs.where("id % 10 <> 0"), "id", "text"))


@query(f"WITH {_DOCS_V} SELECT id, count(*) AS buckets FROM v_d GROUP BY ALL")
def v10_backfill(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    some = V.text_vectors(docs.where("id % 3 = 0"), "id", "text")
    return V.backfilled(docs, some).select("id", F.size("at").cast("long").alias("buckets"))


@query(f"WITH {_TOP_SQL} SELECT query_id, max(sim) FILTER (WHERE id <> query_id) IS NULL OR max(sim) FILTER (WHERE id <> query_id) < 0.35 AS weak FROM sims GROUP BY ALL")
def v12_weak_answers(spark, sf_dir):
    items = _embedded(spark, sf_dir)
    queries = items.where("id % 50 = 0")
    return V.weak(queries, V.dense_best(queries, items, 1, apart=True)).select("query_id", "weak")


@query(
    """SELECT doc_id AS id, CASE WHEN blank THEN NULL ELSE length(text) END AS size, CASE WHEN blank THEN NULL ELSE (length(text) - length(replace(text, 'e', ''))) / CAST(length(text) AS DOUBLE) END AS e,
      CASE WHEN blank THEN NULL ELSE (length(text) - length(replace(text, 'o', ''))) / CAST(length(text) AS DOUBLE) END AS o
    FROM (SELECT *, trim(coalesce(text, ''), ' ') = '' AS blank FROM documents)"""
)
def v11_embedder(spark, sf_dir):
    """An embedder of the caller's: length and two letters' shares."""
    share = lambda t, letter: (F.length(t) - F.length(F.replace(t, F.lit(letter)))) / F.length(t).cast("double")
    made = V.embedded(table(spark, sf_dir, "documents"), "doc_id", "text", lambda t: F.array(F.length(t).cast("double"), share(t, "e"), share(t, "o")))
    at = lambda i: F.get("embedding", F.lit(i))
    return made.select("id", at(0).cast("long").alias("size"), at(1).alias("e"), at(2).alias("o"))
