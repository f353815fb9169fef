"""When two normalised values count as the same value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from accordant import config as C


def within(a: Column, b: Column, relative: str | None = None, absolute: str | None = None) -> Column:
    gap, scale = F.abs(a - b), F.greatest(F.abs(a), F.abs(b))
    out = a == b
    if absolute is not None:
        out = out | (gap <= F.lit(absolute).cast("decimal(38,10)"))
    if relative is not None:
        # compared as a product: no quotient, no rounding
        out = out | (gap.cast("decimal(28,10)") <= scale.cast("decimal(28,10)") * F.lit(relative).cast("decimal(8,6)"))
    return F.coalesce(out, F.lit(False))


def values_agree(a: Column, b: Column) -> Column:
    """Same type, and equal within the type's tolerance; other currencies never agree."""
    kind = a["value_type"]
    money = F.coalesce(a["currency"] == b["currency"], F.lit(False)) & within(a["number"], b["number"], relative=C.MONEY_RELATIVE)
    number = within(a["number"], b["number"], relative=C.NUMBER_RELATIVE)
    spoken = F.when(a["unit"].eqNullSafe(b["unit"]), within(a["number"], b["number"], absolute=C.DURATION_ABSOLUTE)).otherwise(a["canonical"] == b["canonical"])
    same = F.when(kind == "money", money).when(kind == "number", number).when(kind == "duration", spoken).otherwise(a["canonical"] == b["canonical"])
    return F.coalesce((kind == b["value_type"]) & same, F.lit(False))


def precedence_of(doc_type: Column, precedence=None) -> Column:
    out = None
    for name, rank in (precedence or C.PRECEDENCE).items():
        out = F.when(doc_type == name, rank) if out is None else out.when(doc_type == name, rank)
    return out.otherwise(0)
