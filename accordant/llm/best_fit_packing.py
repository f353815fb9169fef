"""Packing token sequences by linear grouping and best fit.

1. Every whole text becomes ids (tokenizer ids, then one end id); a document
   longer than the capacity is cut into full pieces and a rest.
2. Rests are counted by length.  That table has as many rows as the capacity at
   most, however many documents there are; only it reaches the driver.
3. Large lengths are put in groups of equal cardinality, each rounded up to its
   largest length.  Configurations of these few sizes are optimised by a bounded
   subset-sum table that fills a sequence as far as it can, each used as often as
   its rarest size allows.  GROUPS has the numbers of groups that are tried.
4. Actual lengths are substituted group by group in descending order, which
   leaves each sequence with at least the planned room.
5. Small lengths go, largest first, where they fit best.
6. The plan is a table of runs (this length, ranks from .. to, sequences from ..);
   documents are numbered within their length in shards, so that a length shared
   by a third of all rows is numbered by many tasks, and look up their run.  Runs
   are cut at even steps of rank, about one a step, so that a row meets few.

Defined results for odd input: a null text is an empty one (its only id is the
end id); repeated rows are pieces of their own; an empty table gives an empty
result; other columns are ignored; a null id is kept.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from accordant.llm.common import settled, text_of

CAPACITY, END_ID = 4096, 1
#: Lengths over CAPACITY / LARGE_PART are grouped; a plan is made for each number of groups, and the one with fewest sequences holds.
LARGE_PART, GROUPS = 6, (32, 100, 400, 1600)
#: Words and parts whose ids a worker keeps, and the longest of them in bytes or characters.
KEPT_WORDS, KEPT_PARTS, KEPT_LENGTH = 400_000, 300_000, 48
#: Texts that are encoded together.
SLICE_ROWS, SLICE_BYTES = 2048, 6_000_000
#: Parts in one line for the tokenizer.
PARTS_A_LINE = 400

#: Words of these characters only are split here as the tokenizer splits them, so
#: that their parts can be encoded many at a time; all other words go to it whole.
_L, _CAPITALS = "a-zß-öø-ſ", "A-ZÀ-ÖØ-Þ"
PLAIN = re.compile(rf"[ -~{_CAPITALS}{_L}]*")
PARTS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[0-9]| |[^ {_L}0-9]+")
#: Stands between words in a run of ids; no id is as large.
BETWEEN = np.array([0xFFFFFFFF], "<u4")


class Kept:
    """Values of keys met lately: two generations, the older one dropped when the younger one holds half of what is kept."""

    def __init__(self, most: int):
        self.half, self.young, self.old = most // 2, {}, {}

    def missing(self, keys: set) -> set:
        """Those keys that are not kept; the others are young from now on."""
        keys -= self.young.keys()
        met = keys & self.old.keys()
        if met:
            self.young.update(zip(met, map(self.old.__getitem__, met)))
        return keys - met

    def settle(self, fresh) -> None:
        """Forget long keys among the fresh ones, and the older generation if there are too many."""
        for key in fresh:
            if len(key) > KEPT_LENGTH:
                del self.young[key]
        if len(self.young) > self.half:
            self.old, self.young = self.young, {}


class Encoder:
    """Ids of texts, by the ids of their words and of the words' parts.

    White space never joins tokens in this vocabulary, so the ids of a text are
    those of its words; a word's are those of its parts (runs of letters, digits,
    marks), and the last id of each part is one that ends a part.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs one task a core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.of_parts = Tokenizer.from_file(path), Tokenizer.from_file(path)
        # parts are in the vocabulary's own form and split already
        self.of_parts.normalizer = None
        self.of_parts.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words, self.parts = Kept(KEPT_WORDS), Kept(KEPT_PARTS)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn_parts(self, parts: list[str]) -> None:
        for i in range(0, len(parts), 20_000):
            some = parts[i : i + 20_000]
            lines = [" ".join(some[k : k + PARTS_A_LINE]) for k in range(0, len(some), PARTS_A_LINE)]
            ids = np.concatenate([np.array(e.ids, "<u4") for e in self.of_parts.encode_batch_fast(lines, add_special_tokens=False)])
            to = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(to) != len(some):
                raise RuntimeError("the vocabulary does not mark the end of every part")
            raw = ids.tobytes()
            self.parts.young.update(zip(some, map(raw.__getitem__, map(slice, [0, *to], to))))

    def plain(self, line: str) -> list[bytes]:
        """Ids of the words of a line, single spaces between them."""
        found = PARTS.findall(line.lower())
        fresh = self.parts.missing(set(found) - {" "})
        self.learn_parts(list(fresh))
        self.parts.young[" "] = BETWEEN.tobytes()
        raw = b"".join(map(self.parts.young.__getitem__, found)) + BETWEEN.tobytes()
        self.parts.settle(fresh)
        to = (4 * np.flatnonzero(np.frombuffer(raw, "<u4") == BETWEEN)).tolist()
        return [raw[a + 4 : b] for a, b in zip([-4, *to], to)]

    def is_plain(self, line: str) -> bool:
        return bool(PLAIN.fullmatch(line)) and not ("<|" in line and any(x in line for x in self.special))

    def learn(self, words: list[bytes]) -> None:
        if not words:
            return
        line = b" ".join(words).decode()
        if not self.is_plain(line):  # leave the other words to the tokenizer
            texts = line.split(" ")
            odd = [k for k, t in enumerate(texts) if not self.is_plain(t)]
            self.words.young.update(zip([words[k] for k in odd], self.whole([texts[k] for k in odd])))
            out = set(odd)
            texts, words = ([x for k, x in enumerate(xs) if k not in out] for xs in (texts, words))
            line = " ".join(texts)
        if words:
            self.words.young.update(zip(words, self.plain(line)))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        ids, ends = self.encode_run(pa.array(texts, pa.string()))
        return [ids[a:b].astype("<u4").tobytes() for a, b in zip(ends[:-1], ends[1:])]

    def encode_run(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one run, and where each text's begin and end: one place more than there are texts.

        Words are numbered by Arrow, so that each distinct one is looked up once.
        """
        split = pc.ascii_split_whitespace(texts)
        numbered = split.flatten().dictionary_encode()
        words = numbered.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        fresh = self.words.missing(set(words) - {b""})
        self.learn(list(fresh))
        self.words.young[b""] = b""
        ids = list(map(self.words.young.__getitem__, words))
        self.words.settle(fresh)
        of_word, held = np.array(list(map(len, ids)), np.int64) // 4, np.frombuffer(b"".join(ids), "<u4")
        index = numbered.indices.to_numpy(zero_copy_only=False)
        many = of_word[index]
        to = np.cumsum(many)
        # where a word's ids are held, less where they go
        shift = (np.cumsum(of_word) - of_word)[index] - (to - many)
        out = held[np.repeat(shift, many) + np.arange(len(shift) and to[-1])]
        ends = np.concatenate([[0], to])[split.offsets.to_numpy() - split.offsets[0].as_py()]
        return out, ends


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def in_slices(batch: pa.RecordBatch, column: int):
    """An Arrow batch in slices of at most SLICE_ROWS rows whose texts have SLICE_BYTES in all, or of one row."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    to, at = np.cumsum(size, dtype=np.int64), 0
    while at < batch.num_rows:
        end = int(np.searchsorted(to, (to[at - 1] if at else 0) + SLICE_BYTES, "right"))
        end = max(at + 1, min(end, at + SLICE_ROWS))
        yield batch.slice(at, end - at)
        at = end


def cut_texts(path: str, texts: pa.Array, capacity: int, with_ids: bool) -> list[list]:
    """Columns of the pieces of some texts: which text, piece, start, length, ids_crc32, ids."""
    ids, ends = encoder(path).encode_run(texts)
    raw = memoryview(np.insert(ids, ends[1:], END_ID).astype("<u4", copy=False)).cast("B")
    columns: list[list] = [[] for _ in range(6)]
    for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
        first, n = a + i, b - a + 1  # every text before has one end id
        for k, at in enumerate(range(0, n, capacity)):
            to = min(at + capacity, n)
            cut = raw[4 * (first + at) : 4 * (first + to)]
            for column, value in zip(columns, (i, k, at, to - at, zlib.crc32(cut), bytes(cut) if with_ids else None)):
                column.append(value)
    return columns


def pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and on request ids (binary, unsigned 32-bit little-endian)."""
    fields = [T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("piece", T.IntegerType()), *(T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32"))]
    schema = T.StructType(fields + [T.StructField("ids", T.BinaryType())] * with_ids)
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches):
        for batch in batches:
            for part in in_slices(batch, 1):
                which, *columns = cut_texts(vocabulary, part.column(1), capacity, with_ids)
                made = [part.column(0).take(pa.array(which, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, types))]
                yield pa.RecordBatch.from_arrays(made[: 5 + with_ids], schema.names)

    return docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, schema)


def _fullest(sizes: list[int], counts: list[int], first: int, capacity: int) -> list[int]:
    """Sizes by index, the first one included, whose sum comes as close to the capacity as can be.

    Bit s of a mask says that sum s can be reached; the masks before each further
    item lead back from the best sum to its items.
    """
    room = capacity - sizes[first]
    reach, within, steps = 1, (1 << room + 1) - 1, []
    for i in range(first, len(sizes)):
        for _ in range(min(counts[i] - (i == first), room // sizes[i])):
            more = (reach | reach << sizes[i]) & within
            if more == reach:
                break
            steps.append((i, reach))
            reach = more
        if reach >> room:
            break
    at, used = reach.bit_length() - 1, [first]
    for i, before in reversed(steps):
        if not before >> at & 1:
            at -= sizes[i]
            used.append(i)
    return used


def configurations(sizes: list[int], counts: list[int], capacity: int) -> list[tuple[list[int], int]]:
    """(indices of sizes, times): all counts used up, larger sizes first."""
    left, out = list(counts), []
    for first in range(len(sizes)):
        while left[first]:
            used = _fullest(sizes, left, first, capacity)
            need = {i: used.count(i) for i in used}
            times = min(left[i] // n for i, n in need.items())
            for i, n in need.items():
                left[i] -= n * times
            out.append((used, times))
    return out


def linear_groups(lengths: list[int], counts: list[int], groups: int) -> list[list[tuple[int, int]]]:
    """Descending lengths in groups of equal cardinality: (length, how many) per group."""
    total = sum(counts)
    if not total:
        return []
    size, out, room = -(-total // groups), [[]], -(-total // groups)
    for length, n in zip(lengths, counts):
        while n:
            if not room:
                out.append([])
                room = size
            take = min(n, room)
            out[-1].append((length, take))
            n, room = n - take, room - take
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """The plan with the fewest sequences over all numbers of groups."""
    return min((plan_of_groups(histogram, capacity, groups) for groups in GROUPS), key=lambda made: made[1])


def by_steps(runs: list[tuple[int, int, int, int, int, int]], counts: dict[int, int]) -> tuple[list[tuple], dict[int, int]]:
    """Runs cut at even steps of rank, with the step's number before them, and the width of a step per length.

    A length of R runs has R steps at most, so there are twice as many parts as runs at most.
    """
    many = Counter(r[0] for r in runs)
    width = {length: -(-counts[length] // n) for length, n in many.items()}
    parts = []
    for length, a, b, *where in runs:
        w = width[length]
        parts += [(length, step, a, b, *where) for step in range(a // w, (b - 1) // w + 1)]
    return parts, width


def plan_of_groups(histogram: dict[int, int], capacity: int, groups: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Runs (length, rank from, rank to, sequence from, per sequence, offset) and the number of sequences.

    Ranks rank .. rank to - 1 of a length go, per sequence at a time, to the
    sequences from the given one on, the first at the given offset.
    """
    large = sorted((n for n in histogram if n > capacity // LARGE_PART), reverse=True)
    grouped = linear_groups(large, [histogram[n] for n in large], groups)
    merged: dict[int, list[tuple[int, int]]] = {}
    for group in grouped:  # groups of one rounded size are one size
        merged.setdefault(group[0][0], []).extend(group)
    sizes = list(merged)
    queue = {s: [list(x) for x in merged[s]] for s in sizes}
    runs, taken, rooms, sequences = [], {}, [], 0
    for used, times in configurations(sizes, [sum(n for _, n in merged[s]) for s in sizes], capacity):
        while times:
            # as many sequences as the actual lengths at the heads of the groups last
            need = {i: used.count(i) for i in used}
            same = min([times, *(queue[sizes[i]][0][1] // n for i, n in need.items())])
            now, offset = max(same, 1), 0
            for i in need:
                take = need[i] * now
                while take:
                    head = queue[sizes[i]][0]
                    if now > 1 or head[1] >= take:
                        length, n, per = head[0], take, take // now
                    else:
                        length, n, per = head[0], head[1], head[1]
                    at = taken.get(length, 0)
                    runs.append((length, at, at + n, sequences, per, offset))
                    taken[length] = at + n
                    offset += length * per
                    head[1] -= n
                    take -= n
                    if not head[1]:
                        queue[sizes[i]].pop(0)
            rooms.append((capacity - offset, sequences, now, offset))
            sequences += now
            times -= now
    free: dict[int, list[tuple[int, int, int]]] = {}
    for room, first, n, offset in rooms:
        free.setdefault(room, []).append((first, n, offset))
    ordered = sorted(free)
    for length in sorted((n for n in histogram if n <= capacity // LARGE_PART), reverse=True):
        left, at = histogram[length], 0

        def put(room: int, first: int, n: int, offset: int) -> None:
            """Fill n sequences that have this room with as many of the length as fit; what is left of them is room again."""
            nonlocal left, at
            per = room // length
            full = min(n, left // per)
            for count, many in ((full, per), (1 if full < n and 0 < left - full * per < per else 0, left - full * per)):
                if count:
                    runs.append((length, at, at + count * many, first, many, offset))
                    at, left = at + count * many, left - count * many
                    rest = room - many * length
                    if rest:
                        if rest not in free:
                            bisect.insort(ordered, rest)
                        free.setdefault(rest, []).append((first, count, offset + many * length))
                    first, n = first + count, n - count
            if n:
                free.setdefault(room, []).append((first, n, offset))
                if room not in ordered[bisect.bisect_left(ordered, room) :][:1]:
                    bisect.insort(ordered, room)

        while left:
            i = bisect.bisect_left(ordered, length)
            if i == len(ordered):
                n = -(-left // (capacity // length))
                put(capacity, sequences, n, 0)
                sequences += n
                continue
            room = ordered.pop(i)
            for first, n, offset in free.pop(room):
                if left:
                    put(room, first, n, offset)
                else:
                    if room not in free:
                        bisect.insort(ordered, room)
                    free.setdefault(room, []).append((first, n, offset))
    return runs, sequences


def placed(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces, which must be settled, with sequence_id and offset; columns besides doc_id, piece, start, length, ids_crc32 are kept."""
    spark, names = cut.sparkSession, cut.columns
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = cut.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shards)).cast("int"))
    by_shard = cut.groupBy("length", "shard").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    starts = by_shard.select("length", "shard", F.coalesce(before, F.lit(0)).alias("before"))
    counts = {r.length: r.n for r in by_shard.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    parts, width = by_steps(plan(counts, capacity)[0], counts)
    longs = lambda *names: T.StructType([T.StructField(n, T.LongType()) for n in names])
    table = spark.createDataFrame(parts, longs("of_length", "of_step", "rank_from", "rank_to", "sequence_from", "per_sequence", "offset_from"))
    widths = spark.createDataFrame(list(width.items()), longs("length", "width"))
    within = Window.partitionBy("length", "shard").orderBy("doc_id", "piece")
    numbered = cut.withColumn("r", F.row_number().over(within)).join(starts.join(F.broadcast(widths), "length"), ["length", "shard"])
    numbered = numbered.withColumn("rank", F.col("before") + F.col("r") - 1).withColumn("step", F.floor(F.col("rank") / F.col("width")))
    met = numbered.join(F.broadcast(table), (F.col("length") == F.col("of_length")) & (F.col("step") == F.col("of_step")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")))
    k = F.col("rank") - F.col("rank_from")
    return met.select(
        *names,
        (F.col("sequence_from") + F.floor(k / F.col("per_sequence"))).cast("long").alias("sequence_id"),
        (F.col("offset_from") + k % F.col("per_sequence") * F.col("length")).cast("long").alias("offset"),
    )


def packed(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece."""
    return placed(settled(pieces(docs, vocabulary, id_col, text_col, capacity)), capacity)


def sequences(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """sequence_id, ids (array of long), doc_ids (one per piece): the packed training rows themselves, each text encoded once."""
    parts = placed(settled(pieces(docs, vocabulary, id_col, text_col, capacity, with_ids=True)), capacity).select("sequence_id", F.struct("offset", "ids", "doc_id").alias("part"))
    ordered = parts.groupBy("sequence_id").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    who = T.ArrayType(docs.schema[id_col].dataType)
    schema = T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("doc_ids", who)])
    joined = ordered.select("sequence_id", F.transform("parts", lambda p: p["ids"]).alias("ids"), F.transform("parts", lambda p: p["doc_id"]).alias("doc_ids"))

    def run(batches):
        for batch in batches:
            ids = [np.frombuffer(b"".join(parts), "<u4") for parts in batch.column(1).to_pylist()]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), pa.array(np.concatenate(ids) if ids else [], pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, batch.column(2)], schema.names)

    return joined.mapInArrow(run, schema)
