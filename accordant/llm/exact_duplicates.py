"""Exact duplicates by Patricia tries over whole texts.

Texts are equal when their UTF-8 bytes are.  Each task inserts the full bytes of
its own rows into a compressed radix trie whose terminals hold the owner of their
text (the smallest identifier, or the largest) and how many rows have it, so that
a text leaves a task once however often the task meets it.  The terminals are then
dealt by byte length and content hash, and the tries of those partitions, filled
the same way, hold the owners over all rows.  Every row gets its owner back by a
join of narrow rows on length and hash.

A trie that has grown past its bound spills by subtree: its largest subtrees, half
of what it holds, are handed on as terminals and forgotten.  In a task over the
input a text may then leave more than once, and meets its other part later.  The
partitions come sorted by length and hash, so there only texts that cannot come
again are spilled.  Two different texts of one length and hash would be two
terminals of one run: an error, never a merged group.

Defined results for odd input: a null text is an empty one, and equal to it; a
null id is the last choice as owner, and a group whose ids are all null has a null
owner; rows alike in id and text get equal rows back, and of them `deduplicated`
keeps one; an empty table gives an empty result; further columns are ignored, or
kept where the rows of the table are returned, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from accordant.llm.common import rows_in_slices, text_of, written

#: Bytes that a task's trie holds, edges and nodes, before it spills.
TRIE_BYTES = 96_000_000
#: What a node takes besides its edge.
NODE_BYTES = 400
#: Bytes of text that one Arrow batch handed back to Spark holds, one text at least.
BATCH_BYTES = 8_000_000


class Node:
    __slots__ = ("edge", "kids", "terminal")

    def __init__(self, edge: bytes, terminal=None):
        self.edge, self.kids, self.terminal = edge, {}, terminal


def _shared(edge: bytes, text: bytes, start: int) -> int:
    """How many bytes of edge stand in text from start; halves are compared as wholes."""
    low, high = 0, min(len(edge), len(text) - start)
    while low < high:
        middle = (low + high + 1) // 2
        if edge[low:middle] == text[start + low : start + middle]:
            low = middle
        else:
            high = middle - 1
    return low


class Trie:
    """A compressed radix trie over byte strings; a terminal is [owner, rows, mark]."""

    def __init__(self, keep: str = "smallest", most: int | None = None):
        if keep not in ("smallest", "largest"):
            raise ValueError("keep is smallest or largest")
        self.root, self.size, self.keep, self.most = Node(b""), 0, keep, most or TRIE_BYTES

    def insert(self, text: bytes, owner, rows: int = 1, mark=None) -> bool:
        """Count the rows of a text and let the better owner stay; whether the text is new."""
        node, at = self.root, 0
        while at < len(text):
            kid = node.kids.get(text[at])
            if kid is None:
                kid = node.kids[text[at]] = Node(text[at:])
                self.size += len(text) - at + NODE_BYTES
                at = len(text)
            elif text.startswith(kid.edge, at):
                at += len(kid.edge)
            else:
                same = _shared(kid.edge, text, at)
                upper = node.kids[text[at]] = Node(kid.edge[:same])
                upper.kids[kid.edge[same]] = kid
                kid.edge = kid.edge[same:]
                self.size += NODE_BYTES
                kid, at = upper, at + same
            node = kid
        held = node.terminal
        if held is None:
            node.terminal = [owner, rows, mark]
            return True
        held[1] += rows
        if owner is not None and (held[0] is None or (owner < held[0] if self.keep == "smallest" else owner > held[0])):
            held[0] = owner
        return False

    @staticmethod
    def below(node: Node, prefix: bytes) -> Iterator[tuple[bytes, list]]:
        """Every text of a subtree with its terminal; prefix ends with the node's edge."""
        stack = [(node, prefix)]
        while stack:
            node, prefix = stack.pop()
            if node.terminal is not None:
                yield prefix, node.terminal
            stack.extend((kid, prefix + kid.edge) for kid in node.kids.values())

    def drained(self) -> Iterator[tuple[bytes, list]]:
        yield from self.below(self.root, b"")
        self.root, self.size = Node(b""), 0

    def _weights(self) -> dict[int, int]:
        order, stack = [], [self.root]
        while stack:
            node = stack.pop()
            order.append(node)
            stack.extend(node.kids.values())
        weight: dict[int, int] = {}
        for node in reversed(order):
            weight[id(node)] = len(node.edge) + NODE_BYTES + sum(weight[id(k)] for k in node.kids.values())
        return weight

    def spilled(self) -> Iterator[tuple[bytes, list]]:
        """Cut off the largest subtrees, none of them over half of the trie if it has branches, until half is gone."""
        weight, half, gone = self._weights(), self.size // 2, 0
        cuts, n = [(-weight[id(k)], i, self.root, b"") for i, k in enumerate(self.root.kids.values())], len(self.root.kids)
        firsts = dict(enumerate(self.root.kids))
        heapq.heapify(cuts)
        while cuts and gone < half:
            less, i, parent, prefix = heapq.heappop(cuts)
            kid = parent.kids[firsts[i]]
            if -less > half and kid.kids:
                for first, inner in kid.kids.items():
                    firsts[n] = first
                    heapq.heappush(cuts, (-weight[id(inner)], n, kid, prefix + kid.edge))
                    n += 1
                continue
            del parent.kids[firsts[i]]
            gone -= less
            self.size += less
            yield from self.below(kid, prefix + kid.edge)


def _batches(terminals, schema: pa.Schema, with_text: bool) -> Iterator[pa.RecordBatch]:
    """Terminals as Arrow batches of few rows and bytes."""
    rows, held = [], 0

    def batch():
        return pa.RecordBatch.from_pylist(rows, schema)

    for text, (owner, n, mark) in terminals:
        row = {"n_bytes": len(text), "content": mark, "owner": owner, "n_rows": n}
        rows.append(row | {"text": text} if with_text else row)
        held += len(text) if with_text else 64
        if len(rows) >= 4096 or held >= BATCH_BYTES:
            yield batch()
            rows, held = [], 0
    if rows:
        yield batch()


def _content(text: Column) -> Column:
    return F.sha2(text, 256)


def partial_owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", most: int | None = None) -> DataFrame:
    """n_bytes, content, owner, n_rows, text: the terminals of each task's trie over its own rows; no shuffle."""
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("content", T.StringType()), T.StructField("owner", docs.schema[id_col].dataType), T.StructField("n_rows", T.LongType()), T.StructField("text", T.BinaryType())]
    schema = T.StructType(fields)
    arrow, most = to_arrow_schema(schema), most or TRIE_BYTES

    def run(batches):
        trie = Trie(keep, most)
        for batch in batches:
            for part in rows_in_slices(batch):
                for owner, content, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2)):
                    trie.insert(text.as_py(), owner, 1, content)
                    if trie.size > trie.most:
                        yield from _batches(trie.spilled(), arrow, True)
        yield from _batches(trie.drained(), arrow, True)

    text = text_of(text_col)
    return docs.select(F.col(id_col).alias("owner"), _content(text).alias("content"), text.cast("binary").alias("text")).mapInArrow(run, schema)


def owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", most: int | None = None) -> DataFrame:
    """n_bytes, content, owner, n_rows: one row per distinct text, from the tries of the length and hash partitions."""
    from pyspark.sql.pandas.types import to_arrow_schema

    partial = partial_owners(docs, id_col, text_col, keep, most)
    schema = T.StructType([f for f in partial.schema.fields if f.name != "text"])
    arrow, most = to_arrow_schema(schema), most or TRIE_BYTES

    def run(batches):
        trie, run_of, texts = Trie(keep, most), None, 0
        for batch in batches:
            for part in rows_in_slices(batch):
                for n_bytes, content, owner, rows, text in zip(*(part.column(i).to_pylist() for i in range(4)), part.column(4)):
                    if (n_bytes, content) != run_of:
                        run_of, texts = (n_bytes, content), 0
                        if trie.size > trie.most:
                            yield from _batches(trie.spilled(), arrow, False)
                    texts += trie.insert(text.as_py(), owner, rows, content)
                    if texts > 1:
                        raise ValueError(f"two different texts of {n_bytes} bytes have the SHA-256 {content}")
        yield from _batches(trie.drained(), arrow, False)

    return partial.repartition("n_bytes", "content").sortWithinPartitions("n_bytes", "content").mapInArrow(run, schema)


def _with_owners(rows: DataFrame, docs: DataFrame, id_col: str, text_col: str, keep: str) -> DataFrame:
    """rows, which have `content` and `n_bytes`, with owner and n_rows; the owners are written, so that both sides come by plain exchanges, which adaptive execution can split."""
    held = written(owners(docs, id_col, text_col, keep)).select(F.col("n_bytes").alias("of_bytes"), F.col("content").alias("of"), "owner", "n_rows")
    return rows.join(held, (F.col("content") == F.col("of")) & (F.col("n_bytes") == F.col("of_bytes")))


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """doc_id, keep_id (whose row stays), group_size, kept, text_sha256: one row per row of docs."""
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), _content(text).alias("content"), F.octet_length(text).cast("long").alias("n_bytes"))
    return _with_owners(rows, docs, id_col, text_col, keep).select(
        "doc_id", F.col("owner").alias("keep_id"), F.col("n_rows").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("owner")).alias("kept"), F.col("content").alias("text_sha256")
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of docs that own their text, in the columns of docs; of rows alike in id and text one stays."""
    text = text_of(text_col)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), _content(text).alias("content"), F.octet_length(text).cast("long").alias("n_bytes"))
    own = _with_owners(rows, docs, id_col, text_col, keep).where(F.col("id").eqNullSafe(F.col("owner")))
    return own.dropDuplicates(["content", "n_bytes"]).select("row.*")
