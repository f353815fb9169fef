"""Hashed vectors of text, exact and approximate nearest neighbours.

A vector is sparse: (id, bucket, weight) rows of unit length.  ``similar`` is an
equi join on the bucket and a sum, so that pairs without a common bucket never
meet; it makes a row for each bucket that a pair shares.  ``best_in_blocks`` meets
blocks of queries and of items as products of matrices and gives each query's best
of a block, so that what is shuffled grows with the vectors and not with the pairs.
``closest_in_blocks`` gives the one best and passes over groups of items that cannot
hold it.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accordant import config as C

BUCKETS, WORD_WEIGHT, GRAM_WEIGHT, GRAM = 1024, 1.5, 1.0, 3
#: Lists of an inverted file, how many of them a query looks into, and vectors that their centres are fitted on.
LISTS, PROBES, FIT_ROWS = 32, 4, 20_000
#: Rows of a block on average, query rows of one product within it, and words whose buckets a task remembers.
BLOCK, TILE, WORDS = 4096, 512, 400_000
#: Rows of a block of items and of queries of ``closest_in_blocks``, entries that a row has there on average at most, items of a group, queries whose bounds are held at once, those of one product, and groups of a query that are met first.
ITEMS, ASKED, ENTRIES, GROUP, BATCH, ALIKE, TRIED = 196_608, 32_768, 32, 16, 2048, 64, 8
#: Texts, and bytes of them, whose words are counted together, and words whose features are summed at once.
SLICE, CHARS, SPREAD = 512, 4_000_000, 16_384


def spoken(text_col: str) -> Column:
    """A text's words between spaces."""
    return F.regexp_replace(F.lower(F.col(text_col)), r"[^\p{L}\p{N}]+", " ")


def spoken_texts(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, said: the words of an id's texts, between spaces; all of them in one row, so that what is made of it needs no shuffle of its own."""
    return rows.select(F.col(id_col).alias("id"), spoken(text_col).alias("said")).groupBy("id").agg(F.collect_list("said").alias("said"))


def made_of(words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Of distinct words: all their features; how many a word has; word by word their numbers, itself and then its trigrams between spaces, and weights."""
    letters = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le"), "<u4").astype(np.int64)
    middle = np.flatnonzero(letters != ord(" "))
    keys, which = np.unique(letters[middle - 1] << 42 | letters[middle] << 21 | letters[middle + 1], return_inverse=True)
    grams = np.stack([keys >> 42, keys >> 21 & 0x1FFFFF, keys & 0x1FFFFF], 1).astype("<u4").tobytes().decode("utf-32-le")
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    numbers = np.empty(sizes.sum(), np.int64)
    itself = np.zeros(len(numbers), bool)
    itself[np.cumsum(sizes) - sizes] = True
    numbers[itself], numbers[~itself] = np.arange(len(words)), len(words) + which
    return ["w:" + w for w in words] + ["g:" + grams[i : i + GRAM] for i in range(0, len(grams), GRAM)], sizes, numbers, np.where(itself, WORD_WEIGHT, GRAM_WEIGHT)


def in_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches of id and said in pieces of SLICE rows and CHARS bytes at most; a longer text is a piece of its own."""
    for batch in batches:
        said = batch.column("said")
        ends = np.cumsum(pc.fill_null(pc.binary_length(said.flatten()), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        ends = np.append(0, ends)[np.append(0, np.cumsum(pc.list_value_length(said).to_numpy(zero_copy_only=False), dtype=np.int64))]
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, min(start + SLICE, int(np.searchsorted(ends, ends[start] + CHARS, "right")) - 1))
            yield batch.slice(start, stop - start)
            start = stop


def spoken_words(said: pa.ListArray) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Of rows of texts: for each word the row that says it and its number among the distinct words, and these."""
    parts = pc.split_pattern(said.flatten(), " ")
    words = parts.flatten()
    row = pc.list_parent_indices(said).take(pc.list_parent_indices(parts))
    held = pc.not_equal(words, "")
    words = words.filter(held).dictionary_encode()
    return row.filter(held).to_numpy(), words.indices.to_numpy(), words.dictionary.to_numpy(zero_copy_only=False).tolist()


def spread(rows: np.ndarray, words: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of so many words said at once: for each of their features the row, and its place among the features of the distinct words; sizes: how many each of those has."""
    starts = np.cumsum(sizes) - sizes
    for at in range(0, len(words), SPREAD):
        row, word = rows[at : at + SPREAD], words[at : at + SPREAD]
        n = sizes[word]
        ends = np.cumsum(n)
        yield np.repeat(row, n), np.repeat(starts[word] - (ends - n), n) + np.arange(ends[-1])


def as_lists(sizes: np.ndarray, values: np.ndarray | pa.Array, none: np.ndarray | None = None) -> pa.ListArray:
    """Lists of so many values each; null where ``none``."""
    mask = None if none is None else pa.array(none)
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(values) if isinstance(values, np.ndarray) else values, mask=mask)


def text_features(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, features, weights: a row a text; no row without a feature."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            row, word, words = spoken_words(batch.column("said"))
            if not words:
                continue
            names, sizes, numbers, weights = made_of(words)
            parts = []
            for r, at in spread(row, word, sizes):
                keys, which = np.unique(r * len(names) + numbers[at], return_inverse=True)
                parts.append((keys, np.bincount(which, weights[at])))
            keys, which = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            sums = np.bincount(which, np.concatenate([x for _, x in parts]))
            sizes = np.bincount(keys // len(names), minlength=batch.num_rows)
            held = np.flatnonzero(sizes)
            found = pa.array(names).take(pa.array(keys % len(names)))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(held)), as_lists(sizes[held], found), as_lists(sizes[held], sums)], ["id", "features", "weights"])

    said = spoken_texts(rows, id_col, text_col)
    return said.mapInArrow(summed, f"id {said.schema['id'].dataType.simpleString()}, features array<string>, weights array<double>")


def features(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, feature, weight: whole words, and trigrams of each word between spaces."""
    each = text_features(rows, id_col, text_col).select("id", F.explode(F.arrays_zip("features", "weights")).alias("e"))
    return each.select("id", F.col("e.features").alias("feature"), F.col("e.weights").alias("weight"))


def vectors(feats: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """id, bucket, weight: features summed with a sign in hashed buckets, to unit length."""
    digest = F.sha2("feature", 256)
    bucket = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % buckets
    sign = F.when(F.conv(F.substring(digest, 9, 1), 16, 10).cast("int") < 8, 1.0).otherwise(-1.0)
    summed = feats.select("id", bucket.alias("bucket"), (sign * F.col("weight")).alias("x")).groupBy("id", "bucket").agg(F.sum("x").alias("x")).where("x <> 0")
    length = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("id")))
    return summed.select("id", "bucket", (F.col("x") / length).alias("weight"))


def hashed(names: list[str], buckets: int) -> np.ndarray:
    """Of each feature its bucket, or one's complement of it where its sign is negative: as ``vectors`` has them."""
    digests = np.frombuffer(b"".join([hashlib.sha256(f.encode()).digest() for f in names]), np.uint8).reshape(-1, 32)
    bucket = np.ascontiguousarray(digests[:, :4]).view(">u4")[:, 0].astype(np.int64) % buckets
    return np.where(digests[:, 4] < 128, bucket, ~bucket)


class Known:
    """The words that a task has met: word by word how many features they have, and the buckets and signed weights of these."""

    def __init__(self, buckets: int) -> None:
        self.buckets = buckets
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.gram: dict[str, int] = {}
        self.sizes, self.place, self.weights = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.float32)

    def numbers(self, words: list[str]) -> np.ndarray:
        """Of distinct words their places among those met; new ones are taken in, and all others forgotten before, if they or their features are too many."""
        if len(self.number) > WORDS or len(self.gram) > WORDS or len(self.place) > 16 * WORDS:
            self.forget()
        at = np.fromiter(map(self.number.get, words, itertools.repeat(-1)), np.int64, len(words))
        held = len(self.number)
        absent = np.flatnonzero(at < 0)
        if len(absent):
            new = [words[i] for i in absent]
            at[absent] = np.arange(held, held + len(new))
            names, sizes, numbers, weights = made_of(new)
            grams = names[len(new) :]
            unseen = [g for g in grams if g not in self.gram]
            made = hashed(names[: len(new)] + unseen, self.buckets)
            self.gram.update(zip(unseen, made[len(new) :].tolist()))
            place = np.append(made[: len(new)], np.array([self.gram[g] for g in grams], np.int64))[numbers]
            self.number.update(zip(new, range(held, held + len(new))))
            self.sizes = np.append(self.sizes, sizes)
            self.place = np.append(self.place, np.where(place < 0, ~place, place).astype(np.int32))
            self.weights = np.append(self.weights, np.where(place < 0, -weights, weights).astype(np.float32))
        return at


def summed_in(buckets: int, every: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of id and said to id, at and weights, a row a vector; for a row without a bucket null (``every``) or no row."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(buckets)
        for batch in in_slices(batches):
            row, word, words = spoken_words(batch.column("said"))
            if not words and not every:
                continue
            word = known.numbers(words)[word]
            x = np.zeros(batch.num_rows * buckets)
            for r, at in spread(row, word, known.sizes):
                low, high = r[0] * buckets, (r[-1] + 1) * buckets
                x[low:high] += np.bincount(r * buckets - low + known.place[at], known.weights[at], high - low)
            x = x.reshape(-1, buckets)
            r, found = np.nonzero(x)
            sizes = np.bincount(r, minlength=len(x))
            held = np.arange(len(x)) if every else np.flatnonzero(sizes)
            weights = x[r, found] / np.sqrt((x * x).sum(1))[r]
            none = sizes[held] == 0
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(held)), as_lists(sizes[held], found.astype("int32"), none), as_lists(sizes[held], weights, none)], ["id", "at", "weights"])

    return summed


def text_vectors(rows: DataFrame, id_col: str, text_col: str, buckets: int = BUCKETS) -> DataFrame:
    """id, at, weights: what ``vectors`` gives for the features of the texts, a row a vector; no row without a bucket.

    Texts are dealt by id, once; their words are counted and their buckets summed
    where they lie, so that no feature is a row of a shuffle.  Sums of halves are exact
    in any order.
    """
    said = spoken_texts(rows, id_col, text_col)
    return said.mapInArrow(summed_in(buckets, False), f"id {said.schema['id'].dataType.simpleString()}, at array<int>, weights array<double>")


def row_vectors(rows: DataFrame, id_col: str, text_col: str, buckets: int = BUCKETS) -> DataFrame:
    """id, at, weights: the vector of each row's own text; null, never zero, for a text without features.

    Rows are dealt by id and text, once, and stay rows: no vector is shuffled, and none
    has to meet its row again.
    """
    dealt = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).repartition("id", F.xxhash64("text"))
    said = dealt.select("id", F.array(spoken("text")).alias("said"))
    return said.mapInArrow(summed_in(buckets, True), f"id {said.schema['id'].dataType.simpleString()}, at array<int>, weights array<double>")


def as_rows(whole: DataFrame) -> DataFrame:
    """id, bucket, weight of vectors that are a row each."""
    each = whole.select("id", F.explode(F.arrays_zip("at", "weights")).alias("e"))
    return each.select("id", F.col("e.at").cast("long").alias("bucket"), F.col("e.weights").alias("weight"))


def as_whole(vecs: DataFrame) -> DataFrame:
    """id, at, weights of vectors that are rows of (id, bucket, weight)."""
    each = F.sort_array(F.collect_list(F.struct(F.col("bucket").cast("int").alias("at"), "weight")))
    return vecs.groupBy("id").agg(each.alias("e")).select("id", F.col("e.at").alias("at"), F.col("e.weight").alias("weights"))


def with_null_vectors(rows: DataFrame, id_col: str, vecs: DataFrame) -> DataFrame:
    """id and vector (map of bucket to weight): null for a text without features. vecs: whole or as rows."""
    if "at" in vecs.columns:
        whole = vecs.select("id", F.map_from_arrays(F.col("at").cast("array<long>"), "weights").alias("vector"))
    else:
        whole = vecs.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "weight"))).alias("vector"))
    return rows.select(F.col(id_col).alias("id")).join(whole, "id", "left")


def embedded(rows: DataFrame, id_col: str, text_col: str, embedder: Callable[[Column], Column]) -> DataFrame:
    """id, embedding by the caller's function of a text column (built-in functions or a pandas UDF that returns an array); null for a blank text, which the function never sees."""
    blank = F.trim(F.coalesce(F.col(text_col), F.lit(""))) == ""
    made = rows.where(~blank).select(F.col(id_col).alias("id"), embedder(F.col(text_col)).alias("embedding"))
    none = F.lit(None).cast(made.schema["embedding"].dataType).alias("embedding")
    return made.unionByName(rows.where(blank).select(F.col(id_col).alias("id"), none))


def similar(queries: DataFrame, items: DataFrame, floor: float = C.SEARCH_FLOOR) -> DataFrame:
    """query_id, id, sim: all pairs at or above the floor."""
    q = queries.select(F.col("id").alias("query_id"), "bucket", F.col("weight").alias("qw"))
    return q.join(items, "bucket").groupBy("query_id", "id").agg(F.sum(F.col("qw") * F.col("weight")).alias("sim")).where(F.col("sim") >= floor)


def rarest_first(vecs: DataFrame, often: DataFrame, floor: float) -> DataFrame:
    """id, bucket, weight, after: the rows of each vector, from the rarest bucket to where what is left is shorter than the floor; after: the square of what is left behind a row.

    often: bucket and n, how many vectors have it; at most BUCKETS rows.
    """
    ranked = vecs.join(F.broadcast(often), "bucket")
    last = Window.partitionBy("id").orderBy(F.desc("n"), F.desc("bucket")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    squares = F.col("weight") * F.col("weight")
    held = ranked.withColumn("left", F.sum(squares).over(last)).where(F.col("left") >= (floor - 1e-9) ** 2)
    return held.select("id", "bucket", "weight", F.greatest(F.lit(0.0), F.col("left") - squares).alias("after"))


def met_above(queries: DataFrame, items: DataFrame, floor: float) -> DataFrame:
    """query_id, id: the pairs that may reach the floor, of which the sums are still to be taken.

    Buckets are taken from the rarest to the most frequent, in one order for all.  A
    pair whose common buckets all lie behind the place where one of the two vectors
    has less than the floor left cannot reach it, so pairs meet only in buckets before
    that place in both.  What they have in common besides lies behind the last of
    those, where it is at most the product of what is left of the two; only pairs that
    may still reach the floor with that stay.
    """
    often = queries.select("bucket").unionByName(items.select("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))
    q = rarest_first(queries, often, floor).select(F.col("id").alias("query_id"), "bucket", F.col("weight").alias("qw"), F.col("after").alias("q_after"))
    both = q.join(rarest_first(items, often, floor), "bucket").groupBy("query_id", "id").agg(F.sum(F.col("qw") * F.col("weight")).alias("so_far"), F.min(F.col("q_after") * F.col("after")).alias("behind"))
    return both.where(F.col("so_far") + F.sqrt("behind") >= floor - 1e-9).select("query_id", "id")


def similar_above(queries: DataFrame, items: DataFrame, floor: float) -> DataFrame:
    """query_id, id, sim: what ``similar`` gives, for floors high enough that few pairs reach them; vectors of unit length."""
    whole = lambda vecs: vecs.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "weight"))).alias("vector"))
    pairs = met_above(queries, items, floor)
    q = whole(queries).select(F.col("id").alias("of_query"), F.col("vector").alias("qv"))
    held = pairs.join(q, F.col("query_id") == F.col("of_query")).join(whole(items), "id")
    dot = F.aggregate(F.map_entries("vector"), F.lit(0.0), lambda s, e: s + e["value"] * F.coalesce(F.try_element_at("qv", e["key"]), F.lit(0.0)))
    return held.select("query_id", "id", dot.alias("sim")).where(F.col("sim") >= floor)


def top_k(found: DataFrame, k: int) -> DataFrame:
    """The k most similar per query, k between 1 and 50; ties by id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("sim"), "id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= max(1, min(50, k)))


def _matrix(block: pd.DataFrame, width: int) -> np.ndarray:
    """A block's vectors, a row each; sparse ones as ``at`` and ``weights``, dense ones as ``v``."""
    if "v" in block:
        return np.stack(block["v"].to_list())
    made = np.zeros((len(block), width))
    made[np.repeat(np.arange(len(block)), block["at"].map(len)), np.concatenate(block["at"].to_list())] = np.concatenate(block["weights"].to_list())
    return made


def _in_order(q: np.ndarray, v: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Dot products of the pairs, summed from the first dimension to the last: equal for equal vectors wherever they lie."""
    out = np.zeros(len(rows))
    for d in range(q.shape[1]):
        out += q[rows, d] * v[cols, d]
    return out


def _met(queries: DataFrame, items: DataFrame, asked: int, held: int, entries: int | None = None):
    """Queries and items of each scope in blocks of about so many rows, by their ids, each pair of blocks a cogroup; and the types of the columns. entries: of sparse vectors, how many a row of a full block may have on average."""

    def dealt(rows, key, name, block):
        rows = rows.where("scope IS NOT NULL")
        full = F.count("*") / block if entries is None else F.greatest(F.count("*") / block, F.sum(F.size("at")) / (block * entries))
        n = rows.groupBy("scope").agg(F.ceil(full).alias(f"n_{name}"))
        return rows.join(n, "scope").withColumn(name, F.pmod(F.xxhash64(key), F.col(f"n_{name}"))), n

    queries = queries.select(*[F.col(c).alias(c) for c in queries.columns])  # of their own, where they come from the items
    q, q_held = dealt(queries, "query_id", "qb", asked)
    v, v_held = dealt(items, "id", "vb", held)
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    q = q.drop("n_qb").join(v_held, "scope").withColumn("vb", each("n_vb")).drop("n_vb")
    v = v.drop("n_vb").join(q_held, "scope").withColumn("qb", each("n_qb")).drop("n_qb")
    types = {f.name: f.dataType.simpleString() for f in [*queries.schema, *items.schema]}
    return q.groupBy("scope", "qb", "vb").cogroup(v.groupBy("scope", "qb", "vb")), types


def best_in_blocks(queries: DataFrame, items: DataFrame, k: int, floor: float | None = None, places: int | None = None, cosine: bool = False, last: bool = False, apart: bool = False, width: int = BUCKETS, block: int = BLOCK) -> DataFrame:
    """query_id, id, sim: of every block of items that a query meets its k best, which hold the k best of all.

    queries: scope, query_id and a vector; items: scope, id and a vector: ``at`` and
    ``weights``, or ``v`` (array of doubles).  A query meets the items of its scope
    (none, if null).  Within a scope queries and items are dealt by their ids into
    blocks of about ``block`` rows, and each pair of blocks is one product of matrices.
    The best come by sim (to ``places`` if given, as it is else) and then by the smaller
    id (``last``: the greater).  Similarities as they are come again, in the order of
    the dimensions, for all that the product puts among the best.  ``cosine`` divides
    by both lengths; ``apart`` leaves out the item with the query's id.
    """

    met, types = _met(queries, items, block, block)

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": left["query_id"][:0], "id": right["id"][:0], "sim": np.zeros(0)})
        if not len(left) or not len(right):
            return none
        right = right.sort_values("id", ascending=not last, kind="stable")
        b, ids = _matrix(right, width), right["id"].to_numpy()
        lengths = np.sqrt(_in_order(b, b, np.arange(len(b)), np.arange(len(b)))) if cosine else None
        out = []
        for start in range(0, len(left), TILE):
            part = left.iloc[start : start + TILE]
            a, names = _matrix(part, width), part["query_id"].to_numpy()
            sims = a @ b.T
            if cosine:
                of_query = np.sqrt(_in_order(a, a, np.arange(len(a)), np.arange(len(a))))
                with np.errstate(divide="ignore", invalid="ignore"):
                    sims /= of_query[:, None] * lengths[None, :]
                sims[np.isnan(sims)] = -np.inf
            if floor is not None:
                sims[sims < floor - 1e-9] = -np.inf
            if apart:
                sims[names[:, None] == ids[None, :]] = -np.inf
            if sims.shape[1] > k:
                least = sims.max(1) if k == 1 else np.partition(sims, sims.shape[1] - k, 1)[:, -k]
                rows, cols = np.nonzero((sims >= least[:, None] - (1e-9 if places is None else 1.01 * 10.0**-places)) & (sims > -np.inf))
            else:
                rows, cols = np.nonzero(sims > -np.inf)
            if places is None:
                score = _in_order(a, b, rows, cols)
                score = score / (of_query[rows] * lengths[cols]) if cosine else score
                key = score
            else:
                score = sims[rows, cols]
                key = np.floor(score * 10.0**places + 0.5)
            order = np.lexsort((cols, -key, rows))
            rows, cols, score = rows[order], cols[order], score[order]
            first = np.searchsorted(rows, rows)
            kept = np.arange(len(rows)) - first < k
            out.append(pd.DataFrame({"query_id": names[rows[kept]], "id": ids[cols[kept]], "sim": score[kept]}))
        return pd.concat(out) if out else none

    found = met.applyInPandas(best, f"query_id {types['query_id']}, id {types['id']}, sim double")
    return found if floor is None else found.where(F.col("sim") >= floor)


class _Sparse:
    """A block's sparse vectors, one behind the other: where each ends, and entry by entry row, bucket and weight."""

    def __init__(self, block: pd.DataFrame) -> None:
        sizes = block["at"].map(len).to_numpy(np.int64)
        self.ends, self.row = np.append(0, np.cumsum(sizes)), np.repeat(np.arange(len(block)), sizes)
        self.at, self.weights = np.concatenate(block["at"].to_list()), np.concatenate(block["weights"].to_list())

    def dense(self, start: int, stop: int, width: int) -> np.ndarray:
        of = slice(self.ends[start], self.ends[stop])
        made = np.zeros((stop - start, width))
        made[self.row[of] - start, self.at[of]] = self.weights[of]
        return made


class _Groups:
    """Items in groups of GROUP rows.

    boxes: the greatest and, below, the least weight that a group has in every bucket, a
    column a group; 0 where an item lacks the bucket and the weight would be beyond it.
    """

    def __init__(self, items: _Sparse, width: int) -> None:
        self.items, self.n = items, len(items.ends) - 1
        count = -(-self.n // GROUP)
        group = items.row // GROUP
        keys = group * width + items.at
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        cuts = np.flatnonzero(np.diff(keys, prepend=-1))
        sizes = np.diff(cuts, append=len(keys))
        self.has = keys[cuts] % width
        self.starts = np.searchsorted(keys[cuts] // width, np.arange(count + 1))
        self.local = np.empty(len(keys), np.int64)
        self.local[order] = np.repeat(np.arange(len(cuts)), sizes)
        self.local -= self.starts[group]
        boxes = np.zeros((2, width, count), np.float32)
        for box, ends in zip(boxes, (np.maximum, np.minimum)):
            found = ends.reduceat(items.weights[order], cuts)
            box[self.has, keys[cuts] // width] = np.where(sizes < GROUP, ends(found, 0), found)
        self.boxes = boxes.reshape(2 * width, count)

    def __getitem__(self, g: int) -> tuple[int, np.ndarray, np.ndarray]:
        """The first row of a group, its buckets, and its items over these."""
        first, last = g * GROUP, min(self.n, (g + 1) * GROUP)
        of = slice(self.items.ends[first], self.items.ends[last])
        has = self.has[self.starts[g] : self.starts[g + 1]]
        b = np.zeros((last - first, len(has)))
        b[self.items.row[of] - first, self.local[of]] = self.items.weights[of]
        return first, has, b


def _closest(left: pd.DataFrame, right: pd.DataFrame, floor: float, places: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Rows of left that reach the floor, of right the best for each, and its similarity; and how many pairs were multiplied. right: in the order in which equal ones stand."""
    asked, held, n = _Sparse(left), _Groups(_Sparse(right), width), len(right)
    boxes, out, met = held.boxes, [], 0
    least = np.floor((floor - 1e-9) * 10.0**places)
    loose = 4 * width * 2.0**-24 * GROUP**0.5  # single precision: twice 2 * width roundings of sums of at most the square root of GROUP
    for start in range(0, len(left), BATCH):
        stop = min(len(left), start + BATCH)
        a = asked.dense(start, stop, width)
        signed = np.concatenate([np.maximum(a, 0), np.minimum(a, 0)], 1, dtype=np.float32, casting="same_kind")
        bound = np.empty((len(a), boxes.shape[1]), np.float32)
        for at in range(0, len(a), ALIKE):
            part = signed[at : at + ALIKE]
            has = np.flatnonzero(part.any(0))
            np.matmul(part[:, has], boxes[has], out=bound[at : at + ALIKE])
        a = np.ascontiguousarray(a.T)
        best, key, sim = np.full(stop - start, n), np.full(stop - start, least), np.zeros(stop - start)

        def meet(rows: np.ndarray, groups: np.ndarray) -> int:
            """Queries with groups of items, group by group; a pair is left out where the query has found better since."""
            order, pairs = np.argsort(groups, kind="stable"), 0
            rows, groups = rows[order], groups[order]
            cuts = np.flatnonzero(np.diff(groups, prepend=-1))
            for cut, end in zip(cuts, np.append(cuts[1:], len(groups))):
                g, r = groups[cut], rows[cut:end]
                r = r[bound[r, g] >= key[r] / 10.0**places - loose]
                if not len(r):
                    continue
                first, has, b = held[g]
                sims = b @ a[has[:, None], r]
                keys = np.floor(sims * 10.0**places + 0.5)
                at = keys.argmax(0)
                found = keys[at, np.arange(len(r))]
                new = np.flatnonzero((found > key[r]) | (found == key[r]) & (first + at < best[r]))
                pairs += sims.size
                r, at = r[new], at[new]
                key[r], best[r], sim[r] = found[new], first + at, sims[at, new]
            return pairs

        tried = min(TRIED, bound.shape[1])
        first = np.argpartition(bound, -tried, 1)[:, -tried:]
        met += meet(np.repeat(np.arange(len(first)), tried), first.ravel())
        more = bound >= (key / 10.0**places - loose)[:, None]
        more[np.arange(len(first))[:, None], first] = False
        met += meet(*np.divmod(np.flatnonzero(more), more.shape[1]))
        rows = np.flatnonzero((best < n) & (sim >= floor - 1e-9))
        out.append((start + rows, best[rows], sim[rows]))
    return *(np.concatenate(x) for x in zip(*out)), met


def closest_in_blocks(queries: DataFrame, items: DataFrame, floor: float, places: int, width: int = BUCKETS) -> DataFrame:
    """query_id, id, sim: what ``best_in_blocks`` gives with k = 1 and ``last``, for sparse vectors of unit length and a floor above 0.

    Queries and items of a block are taken in the order of their ids, so that names with
    alike ids are together.  For every group the greatest and the least weight in each bucket
    bound what a query may have in common with any of its items: products of
    matrices, in single precision.  A query meets the groups of its
    greatest bounds first, and then only those whose bound reaches the best that it
    has found; every similarity that counts is taken in double precision.  Of equal
    vectors only the one of the greatest id is met.
    """
    met, types = _met(queries, items, ASKED, ITEMS, ENTRIES)

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": left["query_id"][:0], "id": right["id"][:0], "sim": np.zeros(0)})
        left, right = left.sort_values("query_id", kind="stable"), right.sort_values("id", ascending=False, kind="stable")
        right = right[~pd.Series([(a.tobytes(), w.tobytes()) for a, w in zip(right["at"], right["weights"])], right.index).duplicated()]
        rows, cols, sims, _ = _closest(left, right, floor, places, width)
        return pd.DataFrame({"query_id": left["query_id"].to_numpy()[rows], "id": right["id"].to_numpy()[cols], "sim": sims})

    return met.applyInPandas(best, f"query_id {types['query_id']}, id {types['id']}, sim double").where(F.col("sim") >= floor)


def search(queries: DataFrame, spans: DataFrame, vecs: DataFrame, k: int = 8, floor: float = C.SEARCH_FLOOR) -> DataFrame:
    """query_id, place, sim and the columns of spans: the k most similar spans of the query's own pile.

    queries: pile_id, id and a vector; spans: id, pile_id and whatever tells where
    they are from; vecs: id and a vector, as rows of bucket and weight or whole.  A span without a vector is not found, a
    query without features finds nothing; equal similarities (to six places) stand
    by id.  Piles do not meet, and the texts join only those that are found.
    """
    k = max(1, min(50, k))
    if "bucket" in queries.columns:
        queries = as_whole(queries).join(queries.select("id", "pile_id").distinct(), "id")
    vecs = as_whole(vecs) if "bucket" in vecs.columns else vecs
    q = queries.select(F.col("pile_id").alias("scope"), F.col("id").alias("query_id"), "at", "weights")
    items = vecs.join(spans.select("id", F.col("pile_id").alias("scope")), "id").select("scope", "id", "at", "weights")
    sims = best_in_blocks(q, items, k, floor, places=6)
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("sim", 6)), "id")
    best = sims.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= k)
    return best.join(spans, "id")


def dense_similar(queries: DataFrame, items: DataFrame, vector: str = "embedding", most: int = 4096) -> DataFrame:
    """query_id, id, sim of dense unit-length or other vectors.

    The queries are broadcast in blocks of at most ``most`` rows; an item's row
    meets each query of the block once.
    """
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    qs = queries.select(F.col("id").alias("query_id"), F.col(vector).alias("qv")).withColumn("qn", F.sqrt(dot(F.col("qv"), F.col("qv"))))
    n = qs.count()
    out = None
    for block in range(max(1, -(-n // most))):
        part = qs if n <= most else qs.where(F.pmod(F.xxhash64("query_id"), F.lit(-(-n // most))) == block)
        one = F.broadcast(part.agg(F.collect_list(F.struct("query_id", "qv", "qn")).alias("qs")))
        met = items.withColumn("n", F.sqrt(dot(F.col(vector), F.col(vector)))).join(one).select("id", vector, "n", F.explode("qs").alias("q"))
        made = met.select("q.query_id", "id", (dot(F.col("q.qv"), F.col(vector)) / (F.col("q.qn") * F.col("n"))).alias("sim"))
        out = made if out is None else out.unionByName(made)
    return out


def dense_best(queries: DataFrame, items: DataFrame, k: int, vector: str = "embedding", apart: bool = False) -> DataFrame:
    """query_id, id, sim: of the pairs of ``dense_similar`` those that hold each query's k best; nothing for vectors that are null or of length zero. ``apart``: without the pairs of one id."""
    one = lambda rows, name: rows.where(F.col(vector).isNotNull()).select(F.lit(0).alias("scope"), F.col("id").alias(name), F.col(vector).cast("array<double>").alias("v"))
    return best_in_blocks(one(queries, "query_id"), one(items, "id"), k, cosine=True, apart=apart)


def _units(rows: DataFrame, vector: str) -> DataFrame:
    """rows with v, the vector at unit length; rows without one, or of length zero, are left out."""
    dot = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)
    sized = rows.withColumn("v", F.transform(vector, lambda x: x.cast("double"))).withColumn("length", F.sqrt(dot(F.col("v")))).where("length > 0")
    return sized.withColumn("v", F.transform("v", lambda x: x / F.col("length"))).drop("length")


def fit_lists(items: DataFrame, lists: int = LISTS, vector: str = "embedding", seed: int = 3) -> list[list[float]]:
    """Centres of unit length of an inverted file: k-means over FIT_ROWS vectors at most, those that a hash of their id puts first."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    sample = _units(items.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(FIT_ROWS), vector).select(array_to_vector("v").alias("features"))
    model = KMeans(k=lists, seed=seed, distanceMeasure="cosine", initMode="random", maxIter=15).fit(sample)
    return [[float(x) for x in c / (c @ c) ** 0.5] for c in model.clusterCenters()]


def in_lists(rows: DataFrame, centres: list[list[float]], nearest: int = 1, vector: str = "embedding") -> DataFrame:
    """id, v, list, near: every row under its nearest centres, by similarity.

    An index is this for one centre, written as a table partitioned by list; further
    rows are appended to it under the same centres.
    """
    at = np.array(centres).T

    @F.pandas_udf("array<struct<list:int,near:double>>")
    def found(vs: pd.Series) -> pd.Series:
        near = np.stack(vs.to_list()) @ at if len(vs) else np.zeros((0, at.shape[1]))
        order = np.argsort(-near, axis=1, kind="stable")[:, :nearest]
        return pd.Series([[{"list": int(j), "near": float(n[j])} for j in o] for o, n in zip(order, near)])

    return _units(rows, vector).select("id", "v", F.explode(found("v")).alias("l")).select("id", "v", "l.list", "l.near")


def list_search(queries: DataFrame, index: DataFrame, centres: list[list[float]], probes: int, vector: str = "embedding", k: int | None = None) -> DataFrame:
    """query_id, id, sim: each query against the rows of its ``probes`` nearest lists: all pairs, or those that hold its k best, from blocks of the lists."""
    if k:
        q = in_lists(queries, centres, probes, vector).select(F.col("list").alias("scope"), F.col("id").alias("query_id"), "v")
        return best_in_blocks(q, index.select(F.col("list").alias("scope"), "id", "v"), k)
    dot = F.aggregate(F.zip_with("qv", "v", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    q = in_lists(queries, centres, probes, vector).select(F.col("id").alias("query_id"), F.col("v").alias("qv"), F.col("list").alias("probed"))
    return q.join(index, F.col("probed") == F.col("list")).select("query_id", "id", dot.alias("sim"))


def approximate(items: DataFrame, queries: DataFrame, vector: str = "embedding", lists: int = LISTS, probes: int = PROBES, seed: int = 3, k: int | None = None) -> DataFrame:
    """query_id, id, sim: neighbours out of an inverted file, ranked exactly; with k only those that hold each query's k best.

    Every vector is in the index; only the centres are fitted on a sample.  A pair
    meets once at most, in the list of the item.  How many lists must be probed for a
    recall depends on how much the vectors cluster.
    """
    centres = fit_lists(items, lists, vector, seed)
    return list_search(queries, in_lists(items, centres, 1, vector).drop("near"), centres, probes, vector, k)


def weak(queries: DataFrame, found: DataFrame, confident: float = C.CONFIDENT_MATCH) -> DataFrame:
    """query_id, best, weak: no hit, or the best below the confident similarity."""
    best = found.groupBy("query_id").agg(F.max("sim").alias("best"))
    return queries.select(F.col("id").alias("query_id")).distinct().join(best, "query_id", "left").withColumn("weak", F.coalesce(F.col("best") < confident, F.lit(True)))


def index_status(spans: DataFrame, vecs: DataFrame) -> DataFrame:
    has = vecs.select("id").distinct().withColumn("has", F.lit(1))
    return spans.join(has, "id", "left").groupBy("pile_id").agg(F.count("*").alias("spans"), F.count("has").alias("embedded"))


def backfilled(spans: DataFrame, vecs: DataFrame, text_col: str = "text") -> DataFrame:
    """Vectors, whole or as rows, with those of spans that had none."""
    absent = spans.join(vecs.select("id").distinct(), "id", "left_anti")
    return vecs.unionByName(text_vectors(absent, "id", text_col) if "at" in vecs.columns else vectors(features(absent, "id", text_col)))
