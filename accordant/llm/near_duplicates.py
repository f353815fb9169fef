"""SimHash near-duplicates by anchor-point covering.

Two 64-bit fingerprints link when they differ in at most three bits.  The first
62 bits are two blocks of 31; three differing bits leave at least one block with
at most one difference.  In a block the anchors are the words of the perfect
[31, 26] Hamming code, a covering code of radius 1.  A fingerprint is at home at
the one anchor within the covering radius, and is replicated to every anchor
within the radius plus the block's threshold (2): one anchor if it is an anchor
itself, else sixteen.  A pair with block distance of at most one therefore meets
at the home anchor of either one, and is compared there over all 64 bits.  The
search is exact: no link is lost and no bucket is capped.

Defined results for odd input: a null text is an empty one; a text without words
has fingerprint zero and links like any other; equal rows get equal rows back;
an empty table gives an empty result; further columns are ignored.  A group
whose ids are all null has a null component.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from accordant.llm.common import rows_in_slices, settled, text_of

BLOCK_BITS = 31
BLOCKS = 2
MAX_DISTANCE = 3


def simhash(text: str, shingle: int = 3, seed: int = 42) -> int:
    """Signed 64-bit fingerprint of one whole text."""
    import xxhash

    words = text.encode().lower().split()  # of bytes: only A-Z, only ASCII white space
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), seed)]
    else:
        line, digest = b" ".join(words), xxhash.xxh64_intdigest
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate(([0], ends[:-shingle])).tolist()
        hashes = [digest(line[a:b], seed) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist())]
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        part = np.array(hashes[i : i + 65536], "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): one row per row of docs, in one pass without a shuffle."""
    ids = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("doc_id", ids), T.StructField("fp", T.LongType())])

    def run(batches):
        for batch in batches:
            for part in rows_in_slices(batch):
                texts = part.column(1).to_pylist()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([simhash(t) for t in texts], pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, schema)


def _block(fp: Column, block: int) -> Column:
    return F.shiftrightunsigned(fp, block * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))


def _syndrome(value: Column) -> Column:
    """Position (1 to 31) of the bit that leads to the covering anchor, 0 at an anchor."""
    total = F.lit(0)
    for k in range(5):
        mask = sum(1 << (i - 1) for i in range(1, BLOCK_BITS + 1) if i >> k & 1)
        total = total + F.bit_count(value.bitwiseAND(F.lit(mask))).bitwiseAND(F.lit(1)) * (1 << k)
    return total


def _flipped(value: Column, position: Column) -> Column:
    return value.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), position - 1))


def homes_and_replicas(prints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per block: each fingerprint at its home anchor; each at all anchors within radius plus threshold."""
    blocks = F.array(*[F.struct(F.lit(b).alias("block"), _block(F.col("fp"), b).alias("value")) for b in range(BLOCKS)])
    by_block = prints.select("fp", F.explode(blocks).alias("b")).select("fp", "b.block", "b.value").withColumn("s", _syndrome(F.col("value")))
    home = F.when(F.col("s") == 0, F.col("value")).otherwise(_flipped(F.col("value"), F.col("s")))
    key = lambda anchor: anchor.bitwiseOR(F.call_function("shiftleft", F.col("block").cast("long"), F.lit(BLOCK_BITS + 1)))
    pairs = F.filter(F.sequence(F.lit(1), F.lit(BLOCK_BITS)), lambda i: (i != F.col("s")) & (i < i.bitwiseXOR(F.col("s"))))
    near = F.transform(pairs, lambda i: _flipped(_flipped(F.col("value"), i), i.bitwiseXOR(F.col("s"))))
    anchors = F.when(F.col("s") == 0, F.array(F.col("value"))).otherwise(F.concat(F.array(home), near))
    replicas = by_block.select("fp", "block", F.explode(anchors).alias("anchor"))
    return by_block.select("fp", key(home).alias("anchor")), replicas.select("fp", key(F.col("anchor")).alias("anchor"))


def links(prints: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(a, b), a < b: every pair of distinct fingerprints within max_distance (3 at most); a pair may come twice."""
    if max_distance > MAX_DISTANCE:
        raise ValueError("two blocks with radius-one anchors cover three differing bits at most")
    # a fixed number of tasks, since each row becomes up to 32: one exchange of distinct fingerprints that is not coalesced
    tasks = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    home, replica = homes_and_replicas(prints.select("fp").repartition(tasks, "fp"))
    h, r = home.alias("h"), replica.alias("r")
    close = F.bit_count(F.col("h.fp").bitwiseXOR(F.col("r.fp"))) <= max_distance
    met = h.join(r, (F.col("h.anchor") == F.col("r.anchor")) & (F.col("h.fp") < F.col("r.fp")) & close)
    return met.select(F.col("h.fp").alias("a"), F.col("r.fp").alias("b"))


def _dealt(found: DataFrame, *more: str) -> DataFrame:
    """An aggregate dealt anew by further columns, so that a join on its key has an exchange of its own on either side, which adaptive execution can split where the other side is hot."""
    return found.repartition(*more)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable, by alternating large and small stars.

    Each round is two joins on the node; a star's centre may be hot, so the sums that
    they meet are dealt anew, and both sides come by plain exchanges.  Rounds grow as
    the logarithm of the longest chain; each one is written to the shared folder.
    """
    edges, before = settled(edges.distinct()), None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.join(_dealt(least, "k", "m"), F.col("a") == F.col("k")).where("b > a").select(F.col("m").alias("a"), "b")
        large = large.where("a <> b").distinct()
        # each node of a small star is the larger end of its edges
        least = large.groupBy("b").agg(F.min("a").alias("m")).withColumnRenamed("b", "k")
        small = large.join(_dealt(least, "k", "m"), F.col("b") == F.col("k")).select("a", "b", "m")
        small = small.select(F.explode(F.array(F.struct(F.col("m").alias("a"), "b"), F.struct(F.col("m").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")
        edges = settled(small.where("a <> b").distinct())
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
        before = now
    raise RuntimeError("components did not settle")


def _component_of(prints: DataFrame) -> DataFrame:
    """(of, component_id): each distinct fingerprint with the smallest doc_id of its component."""
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(classes.select("fp")))
    rooted = settled(classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.select("fp", "root").join(_dealt(smallest, "root", "component_id"), "root").select(F.col("fp").alias("of"), "component_id")


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable)."""
    prints = settled(fingerprints(docs, id_col, text_col))
    named = _component_of(prints)
    return prints.join(_dealt(named, "of", "component_id"), F.col("fp") == F.col("of")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """Hash of a row's id, which may be null, and of its text."""
    known = F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit("-"))
    return F.sha2(F.concat(known, F.lit("\n"), F.sha2(text_of(text_col), 256)), 256)


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """Of each group one row stays, in the columns of docs: of the smallest id (null last), then of the smallest row key."""
    who = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", row_key().alias("key")).alias("who")
    prints = settled(fingerprints(docs.select(who, "text"), "who"))
    kept = _component_of(prints).select(F.col("component_id.key").alias("kept_key")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), row_key().alias("key"))
    # the key decides the group, so rows of one key are equal in id and text
    return rows.join(kept, F.col("key") == F.col("kept_key"), "left_semi").dropDuplicates(["key"]).select("row.*")
