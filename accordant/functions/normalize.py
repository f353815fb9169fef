"""Numbers, money, durations, dates and text out of raw values, as columns.

``with_value`` adds one struct for every declared type; null is what cannot be
read.  Only built-in functions are used, so all of it stays inside one stage of
generated code.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accordant import config as C

DECIMAL = "decimal(38,10)"
VALUE = f"struct<raw:string,canonical:string,value_type:string,number:{DECIMAL},unit:string,currency:string,as_date:date,ambiguous:boolean,note:string,display:string>"


def some(text: Column) -> Column:
    """Null instead of an empty match."""
    return F.when(text != "", text)


def stripped(raw: Column) -> Column:
    return F.regexp_replace(raw.cast("string"), r"(?U)^\s+|\s+$", "")


def longest_word(text: Column, words: dict) -> Column:
    """What stands for the longest of the words that the text has.

    One expression for all words: a test for each makes a method so long that the
    virtual machine only interprets it.
    """
    order = sorted(words, key=lambda w: -len(w))
    any_of = "|".join(rf".*?\b({re.escape(w)})\b" for w in order)
    found = F.regexp_replace(F.lower(text), rf"(?sU)^(?:{any_of}).*$", "".join(f"${i + 1}" for i in range(len(order))))
    return F.try_element_at(F.create_map(*[F.lit(x) for w in order for x in (w, words[w])]), found)


def word_number(text: Column) -> Column:
    return longest_word(text, C.WORD_NUMBERS)


def parse_number(raw: Column) -> Column:
    return number_in(stripped(raw))


def number_in(text: Column) -> Column:
    """A numeral in parentheses, else the first bare one, else a spelled word; of a stripped text."""
    paren = F.regexp_extract(text, r"\(([0-9][0-9,]*([.][0-9]+)?)\)", 1)
    bare = F.regexp_extract(text, r"(^|[^0-9.])([0-9][0-9,]*([.][0-9]+)?)", 2)
    numeral = F.get(F.filter(F.array(paren, bare), lambda found: found != ""), F.lit(0))
    return F.coalesce(F.replace(numeral, F.lit(",")).try_cast(DECIMAL), word_number(text).cast(DECIMAL))


def plain(number: Column) -> Column:
    """Without exponent and trailing zeros."""
    text = number.cast("string")
    return F.when(F.contains(text, F.lit(".")), F.regexp_replace(F.regexp_replace(text, r"0+$", ""), r"[.]$", "")).otherwise(text)


def currency_of(text: Column) -> Column:
    code = some(F.upper(F.regexp_extract(text, rf"(?iU)\b({'|'.join(C.CURRENCY_CODES)})\b", 1)))
    symbol = None
    for s in sorted(C.CURRENCY_SYMBOLS, key=lambda s: -len(s)):
        hit = F.contains(text, F.lit(s))
        symbol = F.when(hit, C.CURRENCY_SYMBOLS[s]) if symbol is None else symbol.when(hit, C.CURRENCY_SYMBOLS[s])
    return F.coalesce(code, symbol, F.lit(C.DEFAULT_CURRENCY))


def cents(number: Column) -> Column:
    """Two decimals, half to even."""
    return F.bround(number, 2).cast("decimal(38,2)")


def cents_of(amount: Column) -> Column:
    """Two decimals of a double, halves away from zero.

    The double is multiplied by 100 and rounded, as SQL engines cast it; the cast of
    Spark rounds its shortest decimal digits, which differs where a quotient lies a
    hair under half a cent.
    """
    scaled = amount * 100
    whole = F.signum(scaled).cast("long") * F.floor(F.abs(scaled) + 0.5)
    return (whole.cast("decimal(18,0)") / 100).cast("decimal(18,2)")


def duration_unit(text: Column) -> Column:
    return longest_word(text, C.DURATION_UNITS)


def in_days(number: Column, unit: Column) -> Column:
    out = None
    for name, days in C.DAYS_IN.items():
        value = number.cast("decimal(24,4)") * F.lit(days).cast("decimal(10,2)")
        out = F.when(unit == name, value) if out is None else out.when(unit == name, value)
    return out


def parse_date(raw: Column) -> Column:
    return date_in(stripped(raw))


def date_in(text: Column) -> Column:
    """By the first format that fits a stripped text; one whose marks or month's letters the text lacks is not tried, as a failed try costs more than reading does."""
    tries = []
    for java, _ in C.DATE_FORMATS:
        marks = [F.contains(text, F.lit(c)) for c in sorted(set(re.sub(r"[A-Za-z\s]", "", java)))] + [text.rlike(r"\p{L}")] * ("MMM" in java)
        tries.append(F.when(reduce(and_, marks), F.try_to_date(text, java)) if marks else F.try_to_date(text, java))
    return F.coalesce(*tries)


def ambiguous_date(raw: Column) -> Column:
    return ambiguous_in(stripped(raw))


def ambiguous_in(text: Column) -> Column:
    """Day and month, of a stripped text, both of which could be a month."""
    return F.coalesce(text.rlike(r"^(0?[0-9]|1[0-2])[/-](0?[0-9]|1[0-2])[/-][0-9]{2,4}$"), F.lit(False))


def collapsed(raw: Column) -> Column:
    return stripped(F.regexp_replace(raw, r"(?U)\s+", " "))


def folded(raw: Column) -> Column:
    """For comparison: collapsed, lower case, and the one letter that folds to two."""
    return F.replace(F.lower(collapsed(raw)), F.lit("ß"), F.lit("ss"))


def slug(name: Column) -> Column:
    cut = F.regexp_replace(F.regexp_replace(F.lower(name), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.when(F.coalesce(cut, F.lit("")) == "", "unknown").otherwise(cut)


def significant_tokens(name: Column, stopwords=C.STOPWORDS) -> Column:
    words = F.filter(F.split(F.regexp_replace(F.lower(name), r"[^a-z0-9]+", " "), " "), lambda w: w != "")
    return F.array_distinct(F.array_except(words, F.array(*[F.lit(w) for w in stopwords])))


def trimmed(text: Column, limit: int = 72) -> Column:
    flat = collapsed(text)
    return F.when(F.length(flat) > limit, F.concat(F.left(flat, F.lit(limit - 1)), F.lit("…"))).otherwise(flat)


class Parsed:
    """What a raw value was read as, one column each, so that nothing is read twice."""

    def __init__(self, raw: Column, text: Column, number: Column, shown: Column, unit: Column, currency: Column, day: Column, doubt: Column):
        self.raw, self.text, self.number, self.shown, self.unit, self.currency, self.day, self.doubt = raw, text, number, shown, unit, currency, day, doubt


def _struct(p: Parsed, canonical, kind, number=None, unit=None, currency=None, as_date=None, ambiguous=None, note=None, display=None) -> Column:
    lit = lambda c, t: (F.lit(None) if c is None else c).cast(t)
    return F.struct(
        p.raw.alias("raw"), canonical.alias("canonical"), F.lit(kind).alias("value_type"), lit(number, DECIMAL).alias("number"), lit(unit, "string").alias("unit"),
        lit(currency, "string").alias("currency"), lit(as_date, "date").alias("as_date"), F.coalesce(lit(ambiguous, "boolean"), F.lit(False)).alias("ambiguous"),
        lit(note, "string").alias("note"), F.coalesce(lit(display, "string"), canonical).alias("display"),
    )


def money_value(p: Parsed) -> Column:
    amount = cents(p.number)
    return F.when(amount.isNotNull(), _struct(p, F.concat_ws(" ", p.currency, amount.cast("string")), "money", amount, currency=p.currency))


def number_value(p: Parsed) -> Column:
    return F.when(p.number.isNotNull(), _struct(p, p.shown, "number", p.number))


def duration_value(p: Parsed) -> Column:
    note = F.when(p.unit != "days", F.concat(plain(in_days(p.number, p.unit)), F.lit(" days equivalent")))
    spoken = _struct(p, F.concat_ws(" ", p.shown, p.unit), "duration", p.number, unit=p.unit, note=note)
    return F.when(p.number.isNotNull() & p.unit.isNotNull(), spoken).when(p.number.isNotNull(), _struct(p, p.shown, "number", p.number))


def date_value(p: Parsed) -> Column:
    note = F.when(p.doubt, F.concat(p.text, F.lit(" is ambiguous: day and month cannot be told apart in the document")))
    return F.when(p.day.isNotNull(), _struct(p, p.day.cast("string"), "date", as_date=p.day, ambiguous=p.doubt, note=note))


def text_value(p: Parsed) -> Column:
    return _struct(p, folded(p.raw), "text", display=collapsed(p.raw))


#: Value types and their handlers; a domain may pass more.
HANDLERS = {"money": money_value, "number": number_value, "duration": duration_value, "date": date_value, "text": text_value}
_NUMERIC = ("money", "number", "duration")


def with_value(rows: DataFrame, value_type: str = "value_type", raw: str = "value_raw", out: str = "value", handlers=None) -> DataFrame:
    """The table with the value in its declared type; null for a blank or unreadable value and for a type without a handler.

    Each part is read once, in a projection of its own, and only for the types
    that use it (types with handlers of their own get all parts).  The types'
    structs are taken from an array: as branches of one case they are generated code
    of a single method so long that the virtual machine never compiles it.
    """
    handlers = handlers or HANDLERS
    kind = F.col(value_type)
    own = [k for k in handlers if k not in HANDLERS]
    only = lambda kinds, c: F.when(kind.isin(*kinds, *own), c)
    staged = rows.withColumn("_text", stripped(F.col(raw)))
    staged = staged.withColumns(
        {
            "_number": only(_NUMERIC, number_in(F.col("_text"))),
            "_unit": only(("duration",), duration_unit(F.col("_text"))),
            "_currency": only(("money",), currency_of(F.col("_text"))),
            "_day": only(("date",), date_in(F.col("_text"))),
            "_doubt": only(("date",), ambiguous_in(F.col("_text"))),
        }
    )
    staged = staged.withColumn("_shown", plain(F.col("_number")))
    parsed = Parsed(*[F.col(c) for c in (raw, "_text", "_number", "_shown", "_unit", "_currency", "_day", "_doubt")])
    each = [F.when((kind == name) & (F.col("_text") != ""), handler(parsed)) for name, handler in handlers.items()]
    staged = staged.withColumn(out, F.get(F.filter(F.array(*each), lambda value: value.isNotNull()), F.lit(0)))
    return staged.drop("_text", "_number", "_unit", "_currency", "_day", "_doubt", "_shown")


def unknown_types(rows: DataFrame, value_type: str = "value_type", handlers=None) -> DataFrame:
    """Declared types without a handler, with counts: must be empty."""
    return rows.where(~F.col(value_type).isin(*(handlers or HANDLERS))).groupBy(value_type).agg(F.count("*").alias("n"))
