"""Which engagement a name belongs to: alias, exact, containment, near, new.

Each step works only on the names that the steps before it left.  Containment is
relational division over tokens, so that no name is compared with all others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from accordant import config as C
from accordant.functions.normalize import significant_tokens, slug
from accordant.operators import vectors as V
from accordant.operators.reports import placed
from accordant.sources.sinks import stored


def contained(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """candidate_id, entity_key: all significant tokens of a known name are in the candidate's.

    A token that very many known names share is not joined on: each known name is
    found through its rarest token, and its other tokens are then checked.
    """
    k = known.select("entity_key", significant_tokens(F.col("name")).alias("tokens")).where(F.size("tokens") > 0)
    each = k.select("entity_key", "tokens", F.explode("tokens").alias("token"))
    often = each.groupBy("token").agg(F.count("*").alias("n"))
    # dealt anew, so that the join has plain exchanges on both sides, which can be split where a token is in very many names
    rarest = each.join(often.repartition("n", "token"), "token").groupBy("entity_key").agg(F.min_by(F.struct("token", "tokens"), F.struct("n", "token")).alias("r")).select("entity_key", "r.token", "r.tokens")
    c = candidates.select("candidate_id", significant_tokens(F.col("name")).alias("has"))
    met = c.select("candidate_id", "has", F.explode("has").alias("token")).join(rarest, "token")
    return met.where(F.size(F.array_except("tokens", "has")) == 0).select("candidate_id", "entity_key")


def containment(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """candidate_id, matches, entity_key (only if there is one match), candidates (sorted)."""
    found = contained(candidates, known).groupBy("candidate_id").agg(F.sort_array(F.collect_set("entity_key")).alias("candidates"))
    return found.select("candidate_id", F.size("candidates").cast("long").alias("matches"), F.when(F.size("candidates") == 1, F.get("candidates", F.lit(0))).alias("entity_key"), "candidates")


def nearest(candidates: DataFrame, known: DataFrame, floor: float = C.NEAR_MATCH) -> DataFrame:
    """candidate_id, entity_key, sim: the most similar known name at or above the floor."""
    # written once: they are counted before they are dealt
    whole = lambda rows, key, name: stored(V.text_vectors(rows, key, "name")).select(F.lit(0).alias("scope"), F.col("id").alias(name), "at", "weights")
    found = V.closest_in_blocks(whole(candidates, "candidate_id", "query_id"), whole(known, "entity_key", "id"), floor, places=9)
    best = found.groupBy("query_id").agg(F.max_by(F.struct("id", "sim"), F.struct(F.round("sim", 9), "id")).alias("b"))
    return best.select(F.col("query_id").alias("candidate_id"), F.col("b.id").alias("entity_key"), F.col("b.sim").alias("sim"))


def resolved(candidates: DataFrame, known: DataFrame, aliases: dict[str, str] | None = None, near=nearest) -> DataFrame:
    """candidates: candidate_id, name. Adds method, entity_key, confidence and the rivals of an escalation.

    ``near`` is any function of (candidates, known) that gives candidate_id,
    entity_key and sim.
    """
    named = candidates.select("candidate_id", "name", slug(F.col("name")).alias("slug"))
    blank = F.trim(F.coalesce("name", F.lit(""))) == ""
    alias = F.try_element_at(F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv]), F.col("slug")) if aliases else F.lit(None).cast("string")
    keys = known.select(F.col("entity_key").alias("exact_key")).distinct()
    first = named.withColumn("alias_key", alias).join(keys, F.concat(F.lit("engagement:"), F.col("slug")) == F.col("exact_key"), "left")
    open_ = first.where(~blank & F.col("alias_key").isNull() & F.col("exact_key").isNull()).select("candidate_id", "name")
    held = containment(open_, known).select("candidate_id", "matches", F.col("entity_key").alias("held_key"), "candidates")
    left = open_.join(held.select("candidate_id"), "candidate_id", "left_anti")
    close = near(left, known).select("candidate_id", F.col("entity_key").alias("near_key"), "sim")
    all_ = first.join(held, "candidate_id", "left").join(close, "candidate_id", "left")
    method = (
        F.when(blank, "escalate_blank")
        .when(F.col("alias_key").isNotNull(), "alias")
        .when(F.col("exact_key").isNotNull(), "exact")
        .when(F.col("matches") == 1, "containment")
        .when(F.col("matches") > 1, "escalate_ambiguous")
        .when(F.col("near_key").isNotNull(), "escalate_near")
        .otherwise("new")
    )
    new = F.when(method == "new", F.concat(F.lit("engagement:"), F.col("slug")))
    confidence = F.when(F.col("method").isin("alias", "exact", "new"), 1.0).when(F.col("method") == "containment", 0.9).when(F.col("method") == "escalate_near", F.col("sim")).otherwise(0.0)
    rivals = F.when(F.col("method") == "escalate_ambiguous", F.col("candidates")).when(F.col("method") == "escalate_near", F.array("near_key")).otherwise(F.array().cast("array<string>"))
    out = all_.withColumn("entity_key", F.coalesce(F.when(~blank, F.coalesce("alias_key", "exact_key", "held_key")), new)).withColumn("method", method)
    return out.select("candidate_id", "name", "method", "entity_key", confidence.alias("confidence"), rivals.alias("rivals"))


def resolved_in_order(candidates: DataFrame, order: str = "document") -> DataFrame:
    """candidates: pile_id, document, name. Document k sees the keys made by those before it, pile by pile.

    A name makes a key unless a name seen earlier in its pile has no other tokens
    than it has.  "Earlier with a subset of the tokens" is transitive, so whether
    that earlier name made a key itself does not matter: below every such chain
    stands one that did.  This turns the order into two joins on (pile, rarest
    token), and no pile is put together in a task.  A null name is blank, a null
    pile is a pile, rows that repeat a document and name share their answer, and an
    empty table gives no rows.
    """
    at = F.struct(F.col(order).alias("order"), "document", F.col("name").alias("as_written"))
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce("name", F.lit(""))), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    rows = candidates.select(F.struct("pile_id").alias("pile"), "document", bare.alias("slug"), at.alias("at"))
    named = rows.where("slug <> ''")
    seen = named.groupBy("pile", "slug").agg(F.min("at").alias("first")).withColumn("tokens", significant_tokens(F.col("slug")))
    each = seen.where(F.size("tokens") > 0).withColumn("token", F.explode("tokens"))
    often = each.groupBy("pile", "token").agg(F.count("*").alias("n"))
    rarest = each.join(often.repartition("n", "pile", "token"), ["pile", "token"]).groupBy("pile", "slug").agg(F.min_by(F.struct("token", "tokens", "first"), F.struct("n", "token")).alias("r"))
    keys = rarest.select("pile", "r.token", F.col("slug").alias("key_slug"), F.col("r.tokens").alias("key_tokens"), F.col("r.first").alias("key_first"))
    pairs = each.join(keys, ["pile", "token"]).where((F.col("slug") != F.col("key_slug")) & (F.size(F.array_except("key_tokens", "tokens")) == 0))
    pairs = pairs.select("pile", "slug", "first", "key_slug", "key_first")
    dependent = pairs.where("key_first < first").select("pile", "slug").distinct()
    made = pairs.join(dependent, ["pile", "slug"], "left_semi").join(dependent.withColumnRenamed("slug", "key_slug"), ["pile", "key_slug"], "left_anti")
    by_time = Window.partitionBy("pile", "slug").orderBy("key_first", "key_slug")
    two = made.withColumn("n", F.row_number().over(by_time)).where("n <= 2")
    held = two.groupBy("pile", "slug").agg(F.max(F.when(F.col("n") == 1, F.col("key_slug"))).alias("held"), F.max(F.when(F.col("n") == 2, F.col("key_first"))).alias("second"))
    known = seen.select("pile", "slug", "first").join(held, ["pile", "slug"], "left")
    rivals = F.coalesce(F.col("second") < F.col("at"), F.lit(False))
    method = F.when(F.col("slug") == "", "escalate_blank").when(F.col("held").isNull(), F.when(F.col("at") == F.col("first"), "new").otherwise("exact")).when(rivals, "escalate_ambiguous").otherwise("containment")
    key = F.when(F.col("method").isin("new", "exact"), F.col("slug")).when(F.col("method") == "containment", F.col("held"))
    out = rows.join(known, ["pile", "slug"], "left").withColumn("method", method)
    return out.select("pile.pile_id", "document", "method", F.concat(F.lit("engagement:"), key).alias("entity_key"))


def known_keys(facts: DataFrame) -> DataFrame:
    return facts.select("pile_id", "entity_key").distinct()


def registry(named: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """named: pile_id, entity_key, name, seq. The first name of each key, 500 characters at most, unless it has one."""
    first = named.groupBy("pile_id", "entity_key").agg(F.left(F.min_by("name", F.struct("seq", "name")), F.lit(500)).alias("name"))
    return first if existing is None else existing.unionByName(first.join(existing, ["pile_id", "entity_key"], "left_anti"))


def with_provenance(facts: DataFrame, documents: DataFrame, without: str | None = None) -> DataFrame:
    """Facts joined to their documents, one document left out on request."""
    kept = documents.where(~F.col("document").eqNullSafe(F.lit(without))) if without else documents
    return facts.join(kept, ["pile_id", "document"])


def cited_spans(citations: DataFrame, spans: DataFrame) -> DataFrame:
    return citations.join(spans, ["document", "char_start", "char_end"], "left")


def audit_with_cause(audit: DataFrame, documents: DataFrame) -> DataFrame:
    joined = audit.join(documents.select(F.col("document").alias("cause_document"), "doc_type"), "cause_document", "left")
    return placed(joined, "pile_id", F.desc("at"), F.col("section_key"))
