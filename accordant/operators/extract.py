"""Typed fields out of answers, each bound to a place in its document, else a gap.

Cheap searches come first; the fuzzy one is for rows that all others missed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accordant.functions.text import quoted_pattern

FUZZY_FLOOR, ANCHORS, LENGTHS = 0.86, 400, (0.85, 1.0, 1.15)
SPAN = "struct<char_start:int,char_end:int,text:string,method:string,score:double>"


def _span(text: Column, found: Column, method: str, score: float) -> Column:
    start = F.call_function("locate", found, text) - 1
    return F.when(
        (F.coalesce(found, F.lit("")) != "") & (start >= 0),
        F.struct(start.cast("int").alias("char_start"), (start + F.length(found)).cast("int").alias("char_end"), found.alias("text"), F.lit(method).alias("method"), F.lit(score).alias("score")),
    )


def located(rows: DataFrame, text: str = "text", quote: str = "quote", out: str = "span") -> DataFrame:
    """The first place of the quote: as it stands, with other white space, in another case; null if there is none."""
    t, q = F.col(text), F.col(quote)
    staged = rows.withColumn("_p", quoted_pattern(q)).withColumn("_exact", _span(t, q, "exact", 1.0))
    loose = F.when(F.col("_exact").isNull() & (F.col("_p") != ""), F.call_function("regexp_extract", t, F.concat(F.lit("(?U)"), F.col("_p")), F.lit(0)))
    staged = staged.withColumn("_loose", _span(t, loose, "whitespace", 1.0))
    any_case = F.when(F.col("_exact").isNull() & F.col("_loose").isNull() & (F.col("_p") != ""), F.call_function("regexp_extract", t, F.concat(F.lit("(?iu)(?U)"), F.col("_p")), F.lit(0)))
    staged = staged.withColumn("_case", _span(t, any_case, "case_insensitive", 0.99))
    return staged.withColumn(out, F.coalesce("_exact", "_loose", "_case")).drop("_p", "_exact", "_loose", "_case")


def located_fuzzily(rows: DataFrame, keys: list[str], text: str = "text", quote: str = "quote", floor: float = FUZZY_FLOOR, anchors: int | None = None) -> DataFrame:
    """keys and span: windows that begin at the quote's first word, in any case and three lengths, the most similar one at or above the floor.

    Every place of that word is tried; anchors sets how many at most, for parity
    with engines that stop at ANCHORS.  Places and scores stay in the row, so a long
    text with many places is held once.  A quote without a word has no span.
    """
    t, q = F.col("_t"), F.col("_q")
    staged = rows.select(*keys, F.col(text).alias("_t"), F.col(quote).alias("_q"), F.regexp_extract(F.col(quote), r"(?U)(\w+)", 1).alias("_first")).where("_first <> '' and _t is not null")
    pieces = F.call_function("split", t, F.concat(F.lit("(?iu)"), F.col("_first")), F.lit(-1 if anchors is None else anchors + 1))
    lead, wide = F.instr(q, F.col("_first")) - 1, F.length("_first")
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found"))
    ends = F.aggregate(F.slice("_pieces", F.lit(1), F.size("_pieces") - 1), none, lambda a, x: F.struct((a["at"] + F.length(x) + wide).alias("at"), F.concat(a["found"], F.array(a["at"] + F.length(x))).alias("found")))
    once = lambda c: F.explode(F.array(c))  # noqa: E731 - a column made by explode is not evaluated again where it is used
    widths = F.array(*[F.greatest(F.lit(1), F.round((F.length("_q") - lead) * x).cast("int")) for x in LENGTHS])
    said = F.lower(F.substring(q, lead + 1, F.length(q)))
    staged = staged.withColumns({"_pieces": pieces, "_widths": widths, "_said": said})
    staged = staged.select(*keys, "_t", "_widths", "_said", once(ends["found"]).alias("_starts"))

    def scored(start: Column, longest: Column) -> Column:
        """The best of the windows that begin like the longest one."""
        # the distance stops where the floor is out of reach, and is -1 then; one more than what the floor allows, for its rounding
        far = lambda w: F.call_function("levenshtein", F.lower(w), F.col("_said"), (F.greatest(F.length(w), F.length("_said")) * (1 - floor)).cast("int") + 1)
        by_width = F.transform("_widths", lambda n: F.element_at(F.transform(F.array(F.left(longest, n)), lambda w: F.element_at(F.transform(F.array(far(w)), lambda d: F.struct(
            F.when(d >= 0, 1 - d / F.greatest(F.length(w), F.length("_said"))).otherwise(0.0).alias("score"), (-start).alias("start"), (-n).alias("n"))), 1)), 1))
        return F.array_max(by_width)

    most = F.array_max("_widths")
    best = F.array_max(F.transform("_starts", lambda start: F.element_at(F.transform(F.array(F.substring(F.col("_t"), start + 1, most)), lambda longest: scored(start, longest)), 1)))
    staged = staged.select(*keys, "_t", once(best).alias("_best")).where(F.col("_best.score") >= floor)
    window = F.substring(t, 1 - F.col("_best.start"), -F.col("_best.n"))
    start = -F.col("_best.start")
    span = F.struct(start.cast("int").alias("char_start"), (start + F.length(window)).cast("int").alias("char_end"), window.alias("text"), F.lit("fuzzy").alias("method"), F.col("_best.score").alias("score"))
    return staged.groupBy(*keys).agg(F.max_by(span, "_best").alias("span"))


def broken_spans(facts: DataFrame, text: str = "text") -> DataFrame:
    """Facts whose text is not what stands at their offsets: must be empty."""
    stands = F.substring(F.col(text), F.col("span.char_start") + 1, F.col("span.char_end") - F.col("span.char_start"))
    return facts.where(~stands.eqNullSafe(F.col("span.text")))


def entity_key(template: Column, counterparty: Column) -> Column:
    from accordant.functions.normalize import slug

    return F.replace(template, F.lit("{counterparty_slug}"), slug(counterparty))


def fields_of(answers: DataFrame, schema: DataFrame) -> DataFrame:
    """answers (document, doc_type, fields map) by the fields that the type declares: one row per declared field."""
    declared = schema.select(F.col("doc_type").alias("of_type"), "field", "value_type", "required")
    each = answers.join(F.broadcast(declared), F.col("doc_type") == F.col("of_type")).drop("of_type")  # as many rows as the domain declares
    return each.withColumn("said", F.try_element_at("fields", F.col("field")))


def reasons(found: DataFrame) -> DataFrame:
    """found: said (struct value, quote), required, span, value, fields. Adds reason (null: a fact) and detail; drops silent absences."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    reason = (
        F.when(F.col("fields").isNull(), "answer has no fields")
        .when(blank("said.value") & F.col("required"), "required field not stated")
        .when(blank("said.value"), "absent")
        .when(blank("said.quote"), "no quote")
        .when(F.col("span").isNull(), "quote not found")
        .when(F.col("value").isNull(), "value unreadable")
    )
    detail = F.when(F.col("reason") == "quote not found", F.left("said.quote", F.lit(120))).when(F.col("reason") == "value unreadable", F.col("said.value"))
    return found.withColumn("reason", reason).withColumn("detail", detail).where(F.coalesce(F.col("reason") != "absent", F.lit(True)))


def unattributed(facts: DataFrame) -> DataFrame:
    """One gap per document whose facts have no entity key."""
    n = facts.where("entity_key is null").groupBy("document").agg(F.count("*").alias("n"))
    return n.select("document", F.lit("*").alias("field_name"), F.lit("no entity").alias("reason"), F.concat(F.col("n").cast("string"), F.lit(" fact(s) left out")).alias("detail"))
