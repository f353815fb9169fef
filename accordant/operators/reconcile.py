"""Grouping facts, finding disagreement, proposing which document governs.

Every order is total (document, then place), so results do not depend on how
rows are spread.  Groups are (pile, entity, field); counts and first
representatives are aggregates that combine before the shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accordant import config as C
from accordant.functions.agreement import values_agree
from accordant.sources.sinks import stored

KEYS = ["pile_id", "entity_key", "field"]
PLACE = F.struct


def load_order() -> Column:
    return F.struct("document", "char_start")


def grouped(facts: DataFrame) -> DataFrame:
    """KEYS, members, documents: counted by document first, which as many tasks share as shuffles have parts.

    A number that is given is not coalesced: parts that are joined up to the advisory
    size are more than ten times as large in the hash table of a count of distinct texts.
    """
    parts = int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = facts.select(*KEYS, "document").repartition(parts, *KEYS, "document").groupBy(*KEYS, "document").agg(F.count("*").alias("n"))
    return each.groupBy(*KEYS).agg(F.sum("n").alias("members"), F.count("document").alias("documents"))


def per_document(facts: DataFrame) -> DataFrame:
    """How many values the fields have that each document states for itself."""
    return facts.where(F.col("field").isin(*C.INSTANCE_FIELDS, *C.IDENTITY_FIELDS)).groupBy("pile_id", "field").agg(F.count("*").alias("members"))


def comparable(facts: DataFrame) -> DataFrame:
    return facts.where(~F.col("field").isin(*C.INSTANCE_FIELDS, *C.IDENTITY_FIELDS))


#: What agreement looks at.
MEANT = ("value_type", "number", "unit", "currency", "canonical")


def conflicts(facts: DataFrame) -> DataFrame:
    """KEYS, members, readable, disputed: some readable member disagrees with the first one.

    Clusters are greedy by first representative, so that is the same as more than
    one cluster.  What agrees with one value is an interval of numbers, or one text,
    so a group agrees with its first member if its least and greatest numbers, types,
    currencies and texts do, and none is missing.  Durations are compared per unit.
    All of these combine before the shuffle; no fact is joined, and a large group is
    a few rows for each task.
    """
    rows = comparable(facts)
    readable = F.col("value").isNotNull()
    both = lambda name: [F.min(f"value.{name}").alias(f"least_{name}"), F.max(f"value.{name}").alias(f"most_{name}"), F.count(f"value.{name}").alias(f"n_{name}")]
    first = F.min(F.when(readable, F.struct(load_order().alias("at"), *[F.col(f"value.{c}").alias(c) for c in MEANT])))
    by_unit = rows.groupBy(*KEYS, F.col("value.unit").alias("unit"), readable.alias("is_read")).agg(F.count("*").alias("n"), first.alias("first"), *[x for c in MEANT if c != "unit" for x in both(c)])
    end = lambda side: F.struct(*[F.col("unit") if c == "unit" else F.col(f"{side}_{c}").alias(c) for c in MEANT])
    read = F.when(F.col("is_read"), F.struct("n", end("least").alias("least"), end("most").alias("most"), *[f"n_{c}" for c in MEANT if c != "unit"]))
    groups = by_unit.groupBy(*KEYS).agg(F.sum("n").alias("members"), F.coalesce(F.sum(F.when(F.col("is_read"), F.col("n"))), F.lit(0)).alias("readable"), F.min("first").alias("first"), F.collect_list(read).alias("units"))

    def off(u: Column) -> Column:
        kind, first = F.col("first.value_type"), F.col("first")
        counted = F.when(kind.isin("money", "number") | ((kind == "duration") & u["least"]["unit"].eqNullSafe(first["unit"])), u["n_number"]).otherwise(u["n_canonical"])
        whole = (u["n_value_type"] == u["n"]) & (counted == u["n"]) & ((kind != "money") | (u["n_currency"] == u["n"]))
        return ~(F.coalesce(whole, F.lit(False)) & values_agree(first, u["least"]) & values_agree(first, u["most"]))

    return groups.select(*KEYS, "members", "readable", F.exists("units", off).alias("disputed"))


def disputed_members(facts: DataFrame) -> DataFrame:
    """All members of the groups in dispute."""
    return comparable(facts).join(conflicts(facts).where("disputed").select(*KEYS), KEYS, "left_semi")


def cluster_ids(facts: DataFrame) -> DataFrame:
    """KEYS, document, char_start, cluster: greedy assignment to the first cluster whose representative agrees.

    Members that mean the same are one row, at their first place.  Each round, the
    first open row of every group becomes the representative of its next cluster, and
    all open rows of the group that agree with it leave, so that there are as many
    rounds as the most clusters of a group; a row that agrees with nothing, not even
    itself, is a cluster to itself but in no cluster but 0.  Every round is written,
    so that both sides of its join come by exchanges that can be split.
    """
    members = stored(comparable(facts).where("value is not null").select(*KEYS, "document", "char_start", F.struct(*[F.col(f"value.{c}").alias(c) for c in MEANT]).alias("meant")))
    open_ = stored(members.groupBy(*KEYS, "meant").agg(F.min(load_order()).alias("at")))
    done, number = [], 0
    while not open_.isEmpty():
        number += 1
        lead = stored(open_.groupBy(*KEYS).agg(F.min_by("meant", "at").alias("lead"), F.min("at").alias("lead_at")))
        met = stored(open_.join(lead, KEYS).select(*KEYS, "meant", "at", values_agree(F.col("lead"), F.col("meant")).alias("same"), (F.col("at") == F.col("lead_at")).alias("leads")))
        done.append(met.where("same or leads").select(*[F.col(k).alias(f"of_{k}") for k in KEYS], F.col("meant").alias("of"), F.when(F.col("same"), number).otherwise(0).alias("cluster")))
        open_ = met.where("not same and not leads").select(*KEYS, "meant", "at")
    if not done:
        return members.select(*KEYS, "document", "char_start", F.lit(0).alias("cluster"))
    which = reduce(DataFrame.unionByName, done)
    same = [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in KEYS]
    return members.join(which, reduce(Column.__and__, [*same, F.col("meant").eqNullSafe(F.col("of"))])).select(*KEYS, "document", "char_start", "cluster")


def agreed(facts: DataFrame) -> DataFrame:
    """The member of highest authority, first in load order, of every group without dispute."""
    calm = comparable(facts).join(conflicts(facts).where("not disputed").select(*KEYS), KEYS, "left_semi")
    best = calm.groupBy(*KEYS).agg(F.min_by(F.struct("document", "doc_type", "value", "char_start"), F.struct(-F.col("rank"), "document", "char_start")).alias("m"))
    return best.select(*KEYS, "m.document", "m.doc_type", "m.value", "m.char_start")


def effective_dates(facts: DataFrame) -> DataFrame:
    """When each document takes effect: the last date that it states."""
    dated = facts.where((F.col("field") == C.EFFECTIVE_DATE_FIELD) & F.col("value.as_date").isNotNull())
    return dated.groupBy("pile_id", "document").agg(F.max_by("value.as_date", "char_start").alias("effective"))


def proposals(facts: DataFrame) -> DataFrame:
    """One row per dispute: outcome, the proposed document and value, the rationale.

    outcome: authority (one top-ranked value), dated (the latest of equal
    authority), same_date or undated (no proposal).
    """
    members = disputed_members(facts).join(effective_dates(facts), ["pile_id", "document"], "left")
    members = members.withColumn("shown", F.coalesce("value.canonical", "value_raw"))
    group = Window.partitionBy(*KEYS)
    tied = members.withColumn("top", F.max("rank").over(group)).withColumn("is_top", F.col("rank") == F.col("top"))
    top = F.when(F.col("is_top"), F.struct("document", "char_start", "doc_type", "shown", "effective"))
    tied = tied.groupBy(*KEYS).agg(
        F.array_sort(F.collect_list(top)).alias("top"),
        F.array_sort(F.collect_set(F.struct("doc_type", "shown"))).alias("said"),
        F.count("*").alias("members"),
    )
    several = F.size(F.array_distinct(F.transform("top", lambda m: m["shown"]))) > 1
    undated = F.filter("top", lambda m: m["effective"].isNull())
    latest = F.array_max(F.transform("top", lambda m: m["effective"]))
    out = tied.withColumn("several", several).withColumn("undated", undated).withColumn("latest", latest)
    out = out.withColumn("leaders", F.filter("top", lambda m: m["effective"] == F.col("latest")))
    split = F.size(F.array_distinct(F.transform("leaders", lambda m: m["shown"]))) > 1
    outcome = F.when(~F.col("several"), "authority").when(F.size("undated") > 0, "undated").when(split, "same_date").otherwise("dated")
    out = out.withColumn("outcome", outcome)
    chosen = F.when(F.col("outcome") == "authority", F.get("top", F.lit(0))).when(F.col("outcome") == "dated", F.get("leaders", F.lit(0)))
    out = out.withColumn("chosen", chosen)
    kind = F.get("top", F.lit(0))["doc_type"]
    others = F.array_join(F.array_sort(F.array_distinct(F.transform(F.filter("said", lambda s: s["shown"] != F.col("chosen.shown")), lambda s: F.concat_ws(" says ", s["doc_type"], s["shown"])))), ", ")
    first = F.concat(F.col("chosen.doc_type"), F.lit(" "), F.col("chosen.document"), F.lit(" has the highest authority and states "), F.col("chosen.shown"), F.lit("; "), others)
    later = F.concat(F.lit("; of equal authority, it is the later, effective "), F.col("latest").cast("string"))
    moving = F.when(F.col("field").isin(*C.TIME_VARYING_FIELDS), "; this field changes over time, so compare effective dates").otherwise("")
    text = (
        F.when(F.col("outcome") == "authority", F.concat(first, moving))
        .when(F.col("outcome") == "dated", F.concat(first, later, moving))
        .when(F.col("outcome") == "same_date", F.concat(F.size("leaders").cast("string"), F.lit(" documents of equal authority take effect on "), F.col("latest").cast("string"), F.lit(" and differ; a person must choose")))
        .otherwise(F.concat(F.size("top").cast("string"), F.lit(" documents of equal authority ("), kind, F.lit(") differ and "), F.size("undated").cast("string"), F.lit(" state no effective date; a person must choose")))
    )
    return out.select(*KEYS, "members", "outcome", F.col("chosen.document").alias("proposed_document"), F.col("chosen.shown").alias("proposed_value"), text.alias("rationale"))


def distinct_values(facts: DataFrame) -> DataFrame:
    """Values of each dispute in the order in which they are first met by authority."""
    order = F.struct(-F.col("rank"), "document", "char_start", F.coalesce("value.canonical", "value_raw").alias("shown"))
    met = disputed_members(facts).groupBy(*KEYS).agg(F.array_sort(F.collect_list(order)).alias("o"))
    return met.select(*KEYS, F.array_distinct(F.transform("o", lambda x: x["shown"])).alias("shown"))


def volume(found: DataFrame, ceiling: int = C.ESCALATE_ABOVE) -> DataFrame:
    """Per pile: conflicts, and whether there are too many to review one by one."""
    by_pile = found.groupBy("pile_id").agg(F.count_if("disputed").alias("conflicts"))
    note = F.when(F.col("conflicts") > ceiling, F.concat(F.col("conflicts").cast("string"), F.lit(f" conflicts are more than {ceiling}; the run itself needs review")))
    return by_pile.withColumn("escalate", F.col("conflicts") > ceiling).withColumn("note", note)
