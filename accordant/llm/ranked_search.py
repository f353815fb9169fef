"""Ranked lexical search, best interval first, over range-maximum sparse tables.

The index is one row per shard, a run of at most SHARD_DOCS documents of one task,
written without a shuffle: the shard's ids in ascending order, the documents' term
counts, and its posting lists one after another.  A posting's impact is its share of
a document's score.  When a shard is searched, a sparse table over its impacts (for
each place and power of two, the place of the maximum of so many postings) answers
the maximum of any part of any posting list from two entries.

An interval of documents is bounded by the sum, over the query's terms, of the
maximum impacts of their lists within it.  The intervals with the highest bounds are
taken first, BATCH at a time; each is split at the document of its greatest impact,
which is scored exactly, into what lies before and after it.  An interval is dropped
when its bound is under the score of the k-th best document found so far, or equal to
it with higher ids only; what is left when no interval remains is exact.  The best
documents of one shard are the threshold of the task's next ones, and the shards'
best ones are ranked once more per item.

Statistics (documents, terms, documents with a term) are over all rows.  Items are
asked in blocks of about BLOCK_PAIRS distinct pairs of item and term, so that what a
task is told is bounded; if one block holds them all, the index keeps the postings of
their terms only, else those of every term.

Defined results for odd input: a null text has no terms and is never returned; an
item without terms, or whose terms no document has, gives no rows; rows with one item
id are one item; repeated documents are documents of their own, each with its rank; ids
are integers, a null id ranks after all others of its score; empty tables give an empty
result; further columns are ignored.
"""

from __future__ import annotations

import math
import string
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from accordant.llm.common import rows_in_slices, text_of, written

SHARD_DOCS = 8192
#: A shard is closed, too, when it has so many postings.
SHARD_POSTINGS = 2_000_000
#: Distinct pairs of item and term that are asked at once.
BLOCK_PAIRS = 200_000
#: Intervals that are split at once: so many at first, then twice as many each time, up to eight times.
BATCH = 32

#: Fixed value: a term is a maximal match.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_ALNUM = (string.ascii_letters + string.digits).encode()
#: Bytes of terms, A-Z lower-cased, and a space for all others; no byte of a longer UTF-8 sequence is ASCII.
_BYTES = bytes(ord(chr(b).lower()) if b in _ALNUM else b if b > 127 else 32 for b in range(256))

INDEX = "n_docs long, n_terms long, ids array<long>, lengths array<long>, terms array<string>, counts array<int>, docs array<int>, tfs array<int>"
LAST = np.iinfo(np.int64).max


class _Shard:
    """Documents of a task until they are a row of the index."""

    def __init__(self, most_docs: int):
        self.most_docs, self.ids, self.lengths = most_docs, [], array("q")
        self.of_term: dict[bytes, int] = {}
        self.term, self.doc, self.tf = array("i"), array("i"), array("i")

    def add(self, doc_id, text: bytes, only: frozenset | None) -> None:
        words = text.translate(_BYTES).split()
        if not words:
            return
        counts, at = Counter(words), len(self.ids)
        self.ids.append(doc_id)
        self.lengths.append(len(words))
        for word in counts if only is None else counts.keys() & only:
            self.term.append(self.of_term.setdefault(word, len(self.of_term)))
            self.doc.append(at)
            self.tf.append(counts[word])

    def full(self) -> bool:
        return len(self.ids) >= self.most_docs or len(self.term) >= SHARD_POSTINGS

    def row(self, schema: pa.Schema) -> pa.RecordBatch:
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        term, doc, tf = (np.array(x, np.int32) for x in (self.term, self.doc, self.tf))
        doc = place[doc]
        by = np.lexsort((doc, term))
        lengths = np.array(self.lengths, np.int64)[order]
        counts = np.bincount(term, minlength=len(self.of_term)).astype(np.int32)
        values = [len(order), int(lengths.sum()), [self.ids[i] for i in order], lengths, [t.decode() for t in self.of_term], counts, doc[by], tf[by]]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema)], schema=schema)


def index(docs: DataFrame, terms: frozenset[bytes] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The shards of docs, with the postings of these terms (UTF-8, lower-cased) or of all."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema, most = to_arrow_schema(T.StructType.fromDDL(INDEX)), SHARD_DOCS

    def run(batches):
        shard = _Shard(most)
        for batch in batches:
            for part in rows_in_slices(batch):
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1)):
                    shard.add(doc_id, text.as_py(), terms)
                    if shard.full():
                        yield shard.row(schema)
                        shard = _Shard(most)
        if shard.ids:
            yield shard.row(schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).cast("binary").alias("text")).mapInArrow(run, INDEX)


class Searcher:
    """A shard with impacts and their range-maximum tables; finds the best documents of a query."""

    def __init__(self, ids, lengths, terms, counts, docs, tfs, weights: dict[str, int], n_docs: int, n_terms: int):
        held = [i for i, t in enumerate(terms) if t in weights]
        ends = np.cumsum(counts, dtype=np.int64)
        wanted = np.zeros(len(counts), bool)
        wanted[held] = True
        use = np.repeat(wanted, counts)
        self.ids, self.n = np.array([LAST if i is None else i for i in ids], np.int64), len(ids)
        docs, tfs = docs[use].astype(np.int64), tfs[use].astype(np.int64)
        counts = np.asarray(counts, np.int64)[held] if held else np.zeros(0, np.int64)
        stops = np.cumsum(counts)
        self.lists = {terms[i]: (int(b - n), int(b), k) for k, (i, b, n) in enumerate(zip(held, stops, counts))}
        m = 10 + (90 * lengths * n_docs) // max(n_terms, 1)
        weight = np.repeat(np.array([weights[terms[i]] for i in held], np.int64), counts)
        self.impact = weight * ((1_000_000_000 * tfs) // (1000 * tfs + 8 * m[docs]))
        self.docs = docs
        #: list and document in one ascending key, so that one search finds a document in any list
        self.keys = np.repeat(np.arange(len(held), dtype=np.int64), counts) * self.n + docs
        longest, tables, half = int(counts.max(initial=0)), [np.arange(len(docs), dtype=np.int32)], 1
        while 2 * half <= longest:
            left, right = tables[-1][:-half], tables[-1][half:]
            tables.append(np.where(self.impact[left] >= self.impact[right], left, right))
            half *= 2
        self.table, self.begins = np.concatenate(tables), np.cumsum([0, *map(len, tables[:-1])])
        self.power = np.zeros(longest + 2, np.int64)
        self.power[1:] = np.log2(np.arange(1, longest + 2)).astype(np.int64)

    def maxima(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greatest impact in each of the parts lo to hi of the posting lists, 0 in an empty one, and its place."""
        empty = hi <= lo
        power = self.power[np.where(empty, 1, hi - lo)]
        base = self.begins[power]
        left = self.table[np.where(empty, 0, base + lo)]
        right = self.table[np.where(empty, 0, base + hi - (1 << power))]
        a, b = self.impact[left], self.impact[right]
        best, value = np.where(a >= b, left, right), np.maximum(a, b)
        value[empty] = 0
        return value, best

    def _bounded(self, lo, hi):
        """Bounds of intervals and the documents at which they are split."""
        value, at = self.maxima(lo, hi)
        return value.sum(1), self.docs[at[np.arange(len(at)), value.argmax(1)]]

    def best(self, terms: list[str], k: int, known: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """The k best of known and of the shard, each (minus score, id), a null id as LAST; known is sorted."""
        lists = [self.lists[t] for t in terms if t in self.lists]
        if not lists:
            return known
        starts, ends, which = (np.array(x, np.int64) for x in zip(*lists))
        base, top = which * self.n, known
        size = 256
        lows, highs, firsts = np.empty((size, len(lists)), np.int32), np.empty((size, len(lists)), np.int32), np.empty(size, np.int64)
        lows[0], highs[0], firsts[0] = starts, ends, 0
        used = 1
        bound, split = self._bounded(starts[None], ends[None])
        open_, batch = np.zeros(1, np.int64), BATCH
        while True:
            least, last = (-top[k - 1][0], top[k - 1][1]) if len(top) >= k else (1, LAST)
            good = (bound > least) | ((bound == least) & (self.ids[firsts[open_]] <= last))
            open_, bound, split = open_[good], bound[good], split[good]
            if not len(open_):
                return top
            if len(open_) > batch:
                chosen = np.argpartition(-bound, batch)
                now, later = chosen[:batch], chosen[batch:]
            else:
                now, later = np.arange(len(open_)), np.zeros(0, np.int64)
            batch = min(2 * batch, 8 * BATCH)
            rows, at = open_[now], split[now]
            lo, hi = lows[rows].astype(np.int64), highs[rows].astype(np.int64)
            place = np.searchsorted(self.keys, base + at[:, None])
            near = np.minimum(place, len(self.keys) - 1)
            hit = (place < hi) & (self.keys[near] == base + at[:, None])
            score = np.where(hit, self.impact[near], 0).sum(1)
            found = [(-int(s), int(i)) for s, i in zip(score, self.ids[at]) if s >= least]
            if found:
                top = sorted(top + found)[:k]
            lo, hi = np.concatenate((lo, place + hit)), np.concatenate((place, hi))
            inner, inner_split = self._bounded(lo, hi)
            least = -top[k - 1][0] if len(top) >= k else 1
            good = inner >= least
            n = int(good.sum())
            while used + n > len(lows):
                lows, highs, firsts = (np.concatenate((x, np.empty_like(x))) for x in (lows, highs, firsts))
            lows[used : used + n], highs[used : used + n] = lo[good], hi[good]
            # the least id of an interval is that of its first document
            firsts[used : used + n] = np.concatenate((firsts[rows], np.minimum(at + 1, self.n - 1)))[good]
            open_ = np.concatenate((open_[later], np.arange(used, used + n)))
            bound, split = np.concatenate((bound[later], inner[good])), np.concatenate((split[later], inner_split[good]))
            used += n


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, term: the distinct terms of each item."""
    lowered = F.translate(text_of(text_col), string.ascii_uppercase, string.ascii_lowercase)
    return items.select(F.col(id_col).alias("item_id"), F.explode(F.regexp_extract_all(lowered, F.lit(TERM), F.lit(0))).alias("term")).distinct()


def _found(shards: DataFrame, queries: list[list[str]], weights: dict[str, int], n_docs: int, n_terms: int, k: int) -> DataFrame:
    """query (its place in queries), doc_id, score: the best of each task."""
    schema = pa.schema([("query", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])
    said = shards.sparkSession.sparkContext.broadcast((queries, weights))

    def run(batches):
        queries, weights = said.value
        tops: list[list[tuple[int, int]]] = [[] for _ in queries]
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].values for name in ("ids", "lengths", "terms", "counts", "docs", "tfs")}
                numbers = {name: row[name].to_numpy() for name in ("lengths", "counts", "docs", "tfs")}
                shard = Searcher(row["ids"].to_pylist(), terms=row["terms"].to_pylist(), weights=weights, n_docs=n_docs, n_terms=n_terms, **numbers)
                for q, terms in enumerate(queries):
                    tops[q] = shard.best(terms, k, tops[q])
                del shard
        out = [(q, None if i == LAST else i, -s) for q, top in enumerate(tops) for s, i in top]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)

    return shards.select("ids", "lengths", "terms", "counts", "docs", "tfs").mapInArrow(run, "query int, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", block_pairs: int | None = None) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of each item with the highest scores above 0."""
    pairs = written(item_terms(items))
    n_pairs = pairs.count()
    blocks = max(1, math.ceil(n_pairs / (block_pairs or BLOCK_PAIRS)))
    block_of = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    only = None
    if blocks == 1:
        only = frozenset(r.term.encode() for r in pairs.select("term").distinct().collect())
    shards = written(index(docs, only, id_col, text_col))
    n_docs, n_terms = shards.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    holding = shards.select(F.explode(F.arrays_zip("terms", "counts")).alias("p")).groupBy(F.col("p.terms").alias("term")).agg(F.sum("p.counts").alias("df"))
    if blocks > 1:
        holding = written(holding)
    found = None
    for b in range(blocks):
        block = pairs.where(block_of == b) if blocks > 1 else pairs
        queries: dict[object, list[str]] = {}
        for r in block.collect():
            queries.setdefault(r.item_id, []).append(r.term)
        frequencies = holding.join(block.select("term").distinct(), "term").collect()
        weights = {r.term: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r.df + 1))) for r in frequencies}
        names = docs.sparkSession.createDataFrame(list(enumerate(queries)), T.StructType([T.StructField("q", T.IntegerType()), pairs.schema["item_id"]]))
        part = _found(shards, list(queries.values()), weights, n_docs, n_terms, k).join(F.broadcast(names), F.col("query") == F.col("q")).select("item_id", "doc_id", "score")
        found = part if found is None else found.unionByName(part)
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
