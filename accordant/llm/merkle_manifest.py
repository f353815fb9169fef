"""A Merkle manifest of a table by nested-interval labels.

Every row is a leaf, the digest of its columns.  Within a part (a source) leaves
have ranks; a node of the tree covers an interval of leaf ranks and carries it as
its label.  Sixteen consecutive nodes of a level become one of the next, until one
is left, the part's subroot; the subroots, ranked by part, become the root in the
same way.

Ancestors are attached from the top: per level, a node meets its parent by
containment of its interval in the parent's, through buckets of the level's width,
so that it is an equi join with a check.  What the parent covers and the node does
not, an interval before it and one after it, are its siblings: they are read off
the parent's list of children by their labels.  Siblings, level by level, are the
proof of a leaf, which folds the leaf, or a changed one, up to the root again.

Ranks come from a range partitioning and the counts of its shares, so that a part
of any size lies in many tasks; no node has more than sixteen children, so no group
grows with the table; a tree over n leaves takes log16(n) rounds, each a sixteenth
of the one before, written to the shared folder.

Defined results for odd input: a null column is `-` in the leaf, so that it differs
from an empty text; a null part comes first; null ids come first within their part,
rows of one id in the order of their digests, and rows alike in all columns stand in
any order, which changes no digest; a part of one row has its leaf as subroot; an
empty table gives an empty result; further columns, whatever their names, are no
part of a leaf.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accordant.llm.common import written

#: Children of a node at most.
FAN = 16
#: What a leaf is made of, in this order.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(of: Column) -> Column:
    return F.sha2(of, 256)


def leaf(*values: Column) -> Column:
    """H of the values: `-` for null, else bytes, `:` and the value."""
    said = [v.cast("string") for v in values]
    return digest(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in said]))


def ranked(rows: DataFrame, part: str, *order: str) -> DataFrame:
    """rows with lo (their place within the part, from 0), hi (lo + 1) and n (rows of the part)."""
    dealt = rows.repartitionByRange(part, *order).sortWithinPartitions(part, *order)
    dealt = written(dealt.withColumn("share", F.spark_partition_id()).withColumn("nth", F.monotonically_increasing_id()))
    before = Window.partitionBy("of").orderBy("of_share").rowsBetween(Window.unboundedPreceding, -1)
    shares = dealt.groupBy(F.col(part).alias("of"), F.col("share").alias("of_share")).agg(F.count("*").alias("held"), F.min("nth").alias("first"))
    shares = shares.withColumn("before", F.coalesce(F.sum("held").over(before), F.lit(0))).withColumn("n", F.sum("held").over(Window.partitionBy("of")))
    placed = dealt.join(shares, (F.col(part) == F.col("of")) & (F.col("share") == F.col("of_share")))
    lo = F.col("nth") - F.col("first") + F.col("before")
    return placed.withColumn("lo", lo).withColumn("hi", F.col("lo") + 1).drop("share", "nth", "of", "of_share", "held", "first", "before")


def _bucket(lo: Column, level: int) -> Column:
    """The one interval of a level's full width that holds a rank."""
    return lo - F.pmod(lo, F.lit(FAN**level).cast("long"))


def grown(leaves: DataFrame) -> list[DataFrame]:
    """Per level from 1: part, n, lo, hi, digest, kids (lo, hi, digest, row of the children, in order).

    leaves: part, n, lo, hi, digest, row.
    """
    most = leaves.agg(F.max("n")).first()[0] or 0
    nodes, levels = leaves, []
    while FAN ** len(levels) < most:
        level = len(levels) + 1
        many = nodes.where(F.col("n") > FAN ** (level - 1))
        kids = F.array_sort(F.collect_list(F.struct("lo", "hi", "digest", "row")))
        groups = many.groupBy("part", _bucket(F.col("lo"), level).alias("bucket")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.first("n").alias("n"), kids.alias("kids"))
        groups = groups.select("part", "n", "lo", "hi", digest(F.array_join("kids.digest", "")).alias("digest"), "kids")
        levels.append(written(groups))
        nodes = levels[-1].select("part", "n", "lo", "hi", "digest", F.lit(None).cast("string").alias("row"))
    return levels


def _tops(leaves: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """part, digest: the node of each part that has no parent in it."""
    found = leaves.where("n = 1").select("part", "digest")
    for k, groups in enumerate(levels, 1):
        found = found.unionByName(groups.where(F.col("n") <= FAN**k).select("part", "digest"))
    return found


def _siblings(kids: Column, lo: Column, hi: Column) -> Column:
    """What the parent's interval has before and after the node's, as text."""
    joined = lambda test: F.array_join(F.transform(F.filter(kids, test), lambda k: k["digest"]), "")
    return F.struct(joined(lambda k: k["hi"] <= lo).alias("left"), joined(lambda k: k["lo"] >= hi).alias("right"))


def _paths(leaves: DataFrame, levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """Every leaf as row, digest, path and what tops carries; tops: part, path (above the part's top), carried."""
    at_top = tops.select(F.col("part").alias("of"), "path", "carried")
    above = None
    for k in range(len(levels), 0, -1):
        groups = levels[k - 1]
        here = groups.where(F.col("n") <= FAN**k).join(at_top, F.col("part") == F.col("of")).select("part", "lo", "hi", "kids", "path", "carried")
        if above is not None:
            up = above.select(F.col("part").alias("of"), F.col("lo").alias("p_lo"), F.col("hi").alias("p_hi"), F.col("kids").alias("p_kids"), F.col("path").alias("p_path"), "carried")
            within = (F.col("part") == F.col("of")) & (_bucket(F.col("lo"), k + 1) == _bucket(F.col("p_lo"), k + 1)) & (F.col("p_lo") <= F.col("lo")) & (F.col("hi") <= F.col("p_hi"))
            met = groups.where(F.col("n") > FAN**k).join(up, within)
            path = F.concat(F.array(_siblings(F.col("p_kids"), F.col("lo"), F.col("hi"))), F.col("p_path"))
            here = here.unionByName(met.select("part", "lo", "hi", "kids", path.alias("path"), "carried"))
        above = here
    found = leaves.where("n = 1").join(at_top, F.col("part") == F.col("of")).select("row", "digest", "path", "carried")
    if above is None:
        return found
    each = above.select("kids", "path", "carried", F.explode("kids").alias("kid"))
    path = F.concat(F.array(_siblings(F.col("kids"), F.col("kid.lo"), F.col("kid.hi"))), F.col("path"))
    return found.unionByName(each.select("kid.row", "kid.digest", path.alias("path"), "carried"))


def folded(path: Column, start: Column) -> Column:
    """The root that a leaf's digest gives with the siblings of its path."""
    return F.aggregate(path, start, lambda at, step: digest(F.concat(step["left"], at, step["right"])))


def proof_digest(path: Column) -> Column:
    return digest(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""))


def manifest(docs: DataFrame, presented: Column | None = None, columns: tuple[str, ...] = COLUMNS, id_col: str = "doc_id", part_col: str = "source") -> DataFrame:
    """doc_id, leaf, presented, subroot, root, path: one row per row of docs.

    presented: a digest in place of the leaf, null for none, that a later check folds;
    path: left and right siblings as joined digests, from the leaf's level to the root's.
    """
    spark = docs.sparkSession
    # a non-null part that sorts as the parts do, null first
    part = F.coalesce(F.concat(F.lit("="), F.col(part_col).cast("string")), F.lit(""))
    other = F.lit(None).cast("string") if presented is None else presented
    rows = written(docs.select(part.alias("part"), F.col(id_col).alias("id"), leaf(*[F.col(c) for c in columns]).alias("digest"), other.alias("presented")))
    leaves = written(ranked(rows, "part", "id", "digest").select("part", "n", "lo", "hi", "digest", F.struct("id", "presented").alias("row")))
    levels = grown(leaves)
    subroots = ranked(_tops(leaves, levels).select(F.lit("").alias("part"), F.col("part").alias("row"), "digest"), "part", "row")
    subroots = written(subroots.select("part", "n", "lo", "hi", "digest", "row"))
    upper = grown(subroots)
    root = _tops(subroots, upper).first()
    none = F.array().cast("array<struct<left:string,right:string>>")
    of_root = spark.range(1).select(F.lit("").alias("part"), none.alias("path"), F.lit(None).cast("string").alias("carried"))
    tops = written(_paths(subroots, upper, of_root).select(F.col("row").alias("part"), "path", F.col("digest").alias("carried")))
    found = _paths(leaves, levels, tops)
    return found.select(
        F.col("row.id").alias("doc_id"), F.col("digest").alias("leaf"), F.col("row.presented").alias("presented"), F.col("carried").alias("subroot"), F.lit(root.digest if root else None).cast("string").alias("root"), "path"
    )


def verified(docs: DataFrame, changed: dict[str, Column], when: Column, columns: tuple[str, ...] = COLUMNS, id_col: str = "doc_id", part_col: str = "source") -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: rows where `when` holds are presented with `changed` columns, the others as they are."""
    presented = F.when(when, leaf(*[changed.get(c, F.col(c)) for c in columns]))
    held = manifest(docs, presented, columns, id_col, part_col)
    back = folded(F.col("path"), F.coalesce("presented", "leaf"))
    out = held.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), back.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
