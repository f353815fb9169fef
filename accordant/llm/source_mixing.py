"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed per cell of source, language and topic.  Raking then scales
the cells in turn until the totals of every margin meet their targets.  A cell's
rate is its raked share over its share now.  Where the targets are to be exact, a
cell's inclusion probability is its rate, scaled so that the largest is one: the
most that can be kept with all margins in expectation on target, but as little as
the scarcest cell allows.  Where a share of the tokens is to be kept at least and
exact targets keep less, the rates are scaled to that share, cells beyond one are
kept whole, and the others are raked again; a category with fewer tokens than its
target asks for then has all it has, and the others share what it lacks in
proportion to their targets.  Each document is kept if a fixed hash of its id and
text falls below its cell's probability.  Raking ends when every margin meets its
targets, or when no cycle brings them nearer, since cells that the corpus lacks can
make targets impossible together; a miss is reported by a warning.

Targets are given per margin, or follow from the corpus: a category's share
raised to a power below one, which moves weight from large to small ones.  Topics
are a column of the caller's, or the form of the text stands for them.  Every
category is a cell of its own.  Up to FEW cells are raked in one partition and
broadcast; more are a distributed table, raked by sums per margin joined back.
Only DataFrame functions are used.

Defined results for odd input: a null text has no tokens and is kept by its
cell's probability; null sources and languages are the category ``(none)``; a
cell without tokens has probability one; ids may be null, and texts that share one
are drawn each for itself; rows alike in id and text count and are chosen alike; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accordant.llm.common import settled, text_of

MARGINS = ("mix_source", "mix_lang", "mix_topic")
#: Powers of the shares: one keeps a margin as it is, zero makes it even.
POWERS = {"mix_source": 0.7, "mix_lang": 0.85, "mix_topic": 0.9}
CYCLES, CYCLES_A_JOB, TOLERANCE, REPORTED = 600, 6, 1e-9, 1e-6
#: Raking stops when a job's cycles leave more than this share of the miss.
STALLED = 0.999
#: Cells that one partition rakes and a broadcast holds.
FEW = 20_000
NONE = "(none)"

# Forms of text that serve as topics, the first that holds.
TOPICS = (
    ("licensed", r"(?i)\b(licen[cs]e|copyright)\b"),
    ("contacts", r"[A-Za-z0-9._-]@[A-Za-z0-9-]+\."),
    ("tables", r"\|[^|\n]*\|"),
    ("figures", r"[0-9]{3}"),
)


def topic_of(text: Column) -> Column:
    out = F.when(text == "", "empty")
    for name, pattern in TOPICS:
        out = out.when(text.rlike(pattern), name)
    return out.otherwise("prose")


def n_tokens(text: Column) -> Column:
    """Runs of other characters than ASCII white space."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def weighed(docs: DataFrame, topic_col: str | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", seed: int = 7, keep_row: bool = False) -> DataFrame:
    """doc_id, the three margins, n_tokens, draw (from 0 to 1, by id and text), and the row itself if asked for.

    topic_col: the caller's own topics, else the form of the text stands for one.
    """
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(NONE))
    text = text_of(text_col)
    topic = known(topic_col) if topic_col else topic_of(text)
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), id_col, F.xxhash64(text)), 11) / F.lit(float(1 << 53))
    out = [F.col(id_col).alias("doc_id"), known(source_col).alias("mix_source"), known(lang_col).alias("mix_lang"), topic.alias("mix_topic"), n_tokens(text).alias("n_tokens"), draw.alias("draw")]
    return docs.select(*out, *[F.struct(*docs.columns).alias("row")] * keep_row)


def _with_sums(cells: DataFrame, margin: str, value: Column, few: bool) -> DataFrame:
    """cells with held: the sum of value over the cell's category."""
    if few:
        return cells.withColumn("held", F.sum(value).over(Window.partitionBy(margin)))
    sums = cells.groupBy(F.col(margin).alias("of")).agg(F.sum(value).alias("held"))
    return cells.join(sums, F.col(margin) == F.col("of")).drop("of")


def _scaled(cells: DataFrame, few: bool, whole: bool) -> tuple[DataFrame, float]:
    """cells with rate x scaled in turn to each margin's target, at one at most if whole; and how far the worst total is off."""
    kept, step, off, before = F.col("s") * F.col("x"), (lambda c: c) if few else settled, 0.0, float("inf")
    for _ in range(0, CYCLES, CYCLES_A_JOB):
        for _ in range(CYCLES_A_JOB):
            for m in MARGINS:
                x = F.col("x") * F.col(f"{m}_target") / F.col("held")
                x = F.when(F.col("held") > 0, F.least(F.lit(1.0), x) if whole else x).otherwise(0.0)
                cells = step(_with_sums(cells, m, kept, few).withColumn("x", x).drop("held"))
        cells = cells.withColumn("off", F.lit(0.0))
        for m in MARGINS:
            cells = step(_with_sums(cells, m, kept, few).withColumn("off", F.greatest("off", F.abs(F.col("held") - F.col(f"{m}_target")))).drop("held"))
        cells = settled(cells)
        off = cells.agg(F.max("off")).first()[0] or 0.0
        cells = (cells.coalesce(1) if few else cells).drop("off")
        if off < TOLERANCE or off < REPORTED and off > before / 2 or off > STALLED * before:
            break
        before = off
    return cells, off


def _within_stock(cells: DataFrame, margin: str, keep: float) -> DataFrame:
    """cells with the margin's targets for a kept share: no more than a category has, the rest in proportion to the targets."""
    stock = settled(cells.groupBy(F.col(margin).alias("of")).agg(F.sum(F.when(F.col("x") > 0, F.col("s")).otherwise(0.0)).alias("stock"), F.first(f"{margin}_target").alias("target")))
    level, before = keep, 0.0
    while level > before * (1 + 1e-12):
        short = F.col("stock") <= F.col("target") * level
        full, free = stock.agg(F.sum(F.when(short, F.col("stock")).otherwise(0.0)), F.sum(F.when(short, 0.0).otherwise(F.col("target")))).first()
        before, level = level, (keep - full) / free if free > 0 else level
    stock = stock.select("of", F.least("stock", F.col("target") * level).alias("bounded"))
    return cells.join(stock, F.col(margin) == F.col("of")).withColumn(f"{margin}_target", F.col("bounded")).drop("of", "bounded")


def raked(sums: DataFrame, targets: dict[str, dict[str, float]] | None = None, keep: float | None = None) -> DataFrame:
    """Cells with share and probability; sums has the margins and tokens, in any number of rows per cell. keep: share of the tokens to keep at least (none: exact targets)."""
    cells = settled(sums.groupBy(*MARGINS).agg(F.sum("tokens").cast("double").alias("tokens")).where("tokens > 0"))
    n, total = cells.agg(F.count("*"), F.sum("tokens")).first()
    few = n <= FEW
    cells = cells.withColumn("s", F.col("tokens") / F.lit(total or 1.0)).withColumn("x", F.lit(1.0))
    for m in MARGINS:
        shares = cells.groupBy(F.col(m).alias("of")).agg(F.sum("s").alias("held")).withColumn("target", F.pow("held", F.lit(POWERS[m])))
        if targets and m in targets:
            given = cells.sparkSession.createDataFrame([(k, float(v)) for k, v in targets[m].items()], "name string, given double")
            absent = [r.name for r in given.where("given > 0").join(shares, F.col("name") == F.col("of"), "left_anti").collect()]
            if absent and n:
                warnings.warn(f"{m}: no tokens for the targets of {sorted(absent)}", stacklevel=2)
            shares = shares.join(given, F.col("name") == F.col("of"), "left").withColumn("target", F.coalesce("given", F.lit(0.0)))
        shares = settled(shares.select("of", "target"))
        whole = shares.agg(F.sum("target")).first()[0]
        if n and not whole:
            raise ValueError(f"{m}: no target names a category of the corpus")
        cells = cells.join(shares, F.col(m) == F.col("of")).withColumn(f"{m}_target", F.col("target") / F.lit(whole or 1.0)).drop("of", "target")
    cells = settled(cells)
    cells, off = _scaled(cells.coalesce(1) if few else cells, few, False)
    top, stock = cells.agg(F.max("x"), F.sum(F.when(F.col("x") > 0, F.col("s")))).first()
    if off > REPORTED:
        warnings.warn(f"mixture: not all targets are met; a margin's share is off by {off:.2g}", stacklevel=2)
    if keep is not None and top and 1 / top < keep:
        keep = min(keep, stock)
        for m in MARGINS:
            cells = _within_stock(cells, m, keep)
        cells = settled(cells.withColumn("x", F.least(F.lit(1.0), F.col("x") * F.lit(keep))))
        exact = 1 / top
        cells, off = _scaled(cells.coalesce(1) if few else cells, few, True)
        kept = cells.agg(F.sum(F.col("s") * F.col("x"))).first()[0]
        warnings.warn(f"mixture: exact targets would keep {exact:.3g} of the tokens; {kept:.3g} are kept, scarce cells whole, shares off by {off / kept:.2g} from what the stock allows", stacklevel=2)
        top, held = 1.0, kept
    else:
        held = 1.0
    return cells.select(*MARGINS, "tokens", (F.col("s") * F.col("x") / F.lit(held)).alias("share"), (F.col("x") / F.lit(top or 1.0)).alias("probability"))


def mixed(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, seed: int = 7, keep: float | None = None, topic_col: str | None = None) -> DataFrame:
    """doc_id, source_class, lang_class, topic, n_tokens, probability, selected: one row per document."""
    rows = settled(weighed(docs, topic_col, seed=seed))
    cells = settled(raked(rows.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")), targets, keep))
    return _chosen(rows, cells).select("doc_id", F.col("mix_source").alias("source_class"), F.col("mix_lang").alias("lang_class"), F.col("mix_topic").alias("topic"), "n_tokens", "probability", "selected")


def _chosen(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """rows, as ``weighed`` gives them, with probability and selected."""
    held = cells.select(*[F.col(m).alias(f"of_{m}") for m in MARGINS], F.col("probability").alias("held"))
    same = [F.col(m) == F.col(f"of_{m}") for m in MARGINS]
    out = rows.join(F.broadcast(held) if held.count() <= FEW else held, same, "left").withColumn("probability", F.coalesce("held", F.lit(1.0)))
    return out.withColumn("selected", F.col("draw") < F.col("probability")).drop("held", *[f"of_{m}" for m in MARGINS])


def kept_mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, seed: int = 7, keep: float | None = None, topic_col: str | None = None) -> DataFrame:
    """The documents that the mixture selects, in the columns of docs."""
    cells = settled(raked(weighed(docs, topic_col, seed=seed).groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")), targets, keep))
    return _chosen(weighed(docs, topic_col, seed=seed, keep_row=True), cells).where("selected").select("row.*")
