"""Quality rules: base counts, and lines labelled by a linear-chain random field.

Each line of a text that has a word is content or boilerplate.  A linear-chain
conditional random field over a few features of the line scores the labels;
Viterbi decoding gives the best sequence; the share of the words' characters that
lie in content lines decides retention.

The field is trained here, by gradient ascent on the conditional likelihood, from
a bounded sample of labelled documents: the SAMPLE_ROWS ids smallest in a fixed
hash order of either label, whole ones, taken in that order as long as their lines
fit in SAMPLE_LINES for the label.  Their lines' features are computed by tasks;
only those numbers reach the driver.  Lines of documents labelled good count as
content, unless they say licence or repeat a line above; lines of documents
labelled bad count as boilerplate.

Defined results for odd input: a null or blank text has no words, fails the base
rules and is not kept; repeated rows give repeated rows; an empty table gives an
empty result; other columns are ignored; an id with two labels that differ is not
learnt from, and of one with several texts the smallest is; without labels of both
kinds the verdict is that of the base rules.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from accordant.llm.common import fitting, hash_order, rows_in_slices, settled, text_of

WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
SAMPLE_ROWS, SAMPLE_LINES, SAMPLE_TASKS, STEPS, CONTENT_SHARE = 700, 20_000, 16, 150, 0.5
SYMBOLS = b"#*$%&|<>"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALPHA, UPPER = re.compile(r"[\W\d_]+"), re.compile(r"[A-ZÀ-ÖØ-Þ]")
LICENCE = re.compile(r"licen[cs]e|copyright", re.I)
N_FEATURES = 9
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(ids: np.ndarray, text_of_word: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For each word whether a window of words that holds it comes twice or more in its text.

    Windows of one, two, four and eight words are numbered in turn by pairs of
    the numbers of their halves, so that equal numbers are equal words.
    """
    n, width = len(ids), 1
    if n < window:
        return np.zeros(n, bool)
    code = ids.astype(np.int64)
    while width < window:
        code = np.unique(code[:-width] * (np.int64(code.max()) + 1) + code[width:], return_inverse=True)[1]
        width *= 2
    last = n - window + 1
    whole = text_of_word[:last] == text_of_word[window - 1 :]
    key = code[:last] * (np.int64(text_of_word.max()) + 1) + text_of_word[:last]
    _, back, times = np.unique(np.where(whole, key, -1 - np.arange(last)), return_inverse=True, return_counts=True)
    hit = np.concatenate([((times[back] > 1) & whole).astype(np.int64), np.zeros(window, np.int64)])
    starts = np.cumsum(hit)
    return (starts[:n] - np.concatenate([np.zeros(window, np.int64), starts])[:n]) > 0


def counted(texts: list[str]) -> np.ndarray:
    """The base counts of each text, in the order of COUNTS."""
    number: dict[str, int] = {}
    ids, lengths, out = [], [], np.zeros((len(texts), len(COUNTS)), np.int64)
    for i, text in enumerate(texts):
        words = WORD.findall(text)
        raw = text.encode()
        lengths.append(len(words))
        ids.extend([number.setdefault(w, len(number)) for w in words])
        lines = [x for x in text.split("\n") if WORD.search(x)]
        out[i, :4] = len(words), sum(map(len, words)), len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines))
    owner = np.repeat(np.arange(len(texts)), lengths)
    if len(ids) >= WINDOW:
        out[:, 4] = np.bincount(owner, repeated_words(np.array(ids), owner), minlength=len(texts)).astype(np.int64)
    return out


def line_features(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, characters in words, repeats a line above) of the lines that have a word."""
    rows, chars, again, above = [], [], [], set()
    for line in text.split("\n"):
        words = WORD.findall(line)
        if not words:
            continue
        n, joined = len(words), "".join(words)
        size = len(joined)
        raw = joined.encode()
        letters, upper = len(ALPHA.sub("", joined)), len(UPPER.findall(joined))
        rows.append(
            (
                1.0,
                min(np.log1p(n), 6.0) / 3,
                10 * (len(raw) - len(raw.translate(None, SYMBOLS))) / size,
                1 - letters / size,
                upper / max(letters, 1),
                4 * joined.count("!") / n,
                1 - len(set(words)) / n,
                1.0 if line in above else 0.0,
                1.0 if LICENCE.search(line) else 0.0,
            )
        )
        chars.append(size)
        again.append(line in above)
        above.add(line)
    return np.array(rows, float).reshape(-1, N_FEATURES), np.array(chars, np.int64), np.array(again, bool)


def viterbi(unary: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Best labels (0 boilerplate, 1 content) of one sequence."""
    n = len(unary)
    back, best = np.zeros((n, 2), np.int8), (float(unary[0, 0]), float(unary[0, 1]))
    p00, p01, p10, p11 = (float(x) for x in pairs.ravel())
    for t, (u0, u1) in enumerate(unary[1:].tolist(), 1):
        a, b, c, d = best[0] + p00, best[1] + p10, best[0] + p01, best[1] + p11
        back[t] = b > a, d >= c
        best = max(a, b) + u0, max(c, d) + u1
    labels = np.zeros(n, np.int8)
    labels[-1] = best[1] >= best[0]
    for t in range(n - 1, 0, -1):
        labels[t - 1] = back[t, labels[t]]
    return labels


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


class Padded:
    """Sequences of like length as arrays: features, labels, and where there is a line."""

    def __init__(self, sequences: list[tuple[np.ndarray, np.ndarray]]):
        longest = max(len(y) for _, y in sequences)
        self.x, y, self.there = np.zeros((len(sequences), longest, N_FEATURES)), np.zeros((len(sequences), longest), int), np.zeros((len(sequences), longest), bool)
        for i, (f, labels) in enumerate(sequences):
            self.x[i, : len(labels)], y[i, : len(labels)], self.there[i, : len(labels)] = f, labels, True
        self.both, self.y = self.there[:, 1:], y
        self.truth = np.eye(2)[y] * self.there[..., None]
        self.moved = np.einsum("ita,itb,it->ab", self.truth[:, :-1], self.truth[:, 1:], self.both.astype(float))

    def likelihood(self, w: np.ndarray, p: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Logarithm of the labels' likelihood, and its slopes by the weights and by the transitions."""
        u, there = self.x @ w, self.there
        longest = u.shape[1]
        ahead, behind = np.zeros_like(u), np.zeros_like(u)
        ahead[:, 0] = u[:, 0]
        for t in range(1, longest):
            ahead[:, t] = np.where(there[:, t, None], u[:, t] + _lse(ahead[:, t - 1, :, None] + p, 1), ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            behind[:, t] = np.where(there[:, t + 1, None], _lse((behind[:, t + 1] + u[:, t + 1])[:, None, :] + p, 2), 0.0)
        z = _lse(ahead[:, -1], 1)
        single = np.exp(ahead + behind - z[:, None, None]) * there[..., None]
        pair = np.exp(ahead[:, :-1, :, None] + p + (u + behind)[:, 1:, None, :] - z[:, None, None, None]) * self.both[..., None, None]
        said = (u * self.truth).sum() + (self.moved * p).sum() - z.sum()
        return float(said), np.einsum("itf,ita->fa", self.x, self.truth - single), self.moved - pair.sum((0, 1))


def padded(sequences: list[tuple[np.ndarray, np.ndarray]]) -> list[Padded]:
    """Groups of sequences of which none is over twice as long as another."""
    groups: dict[int, list] = {}
    for s in sequences:
        groups.setdefault(len(s[1]).bit_length(), []).append(s)
    return [Padded(groups[k]) for k in sorted(groups)]


def trained(sequences: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(weights: features x 2, transitions: 2 x 2) that make the labels of the sequences likely."""
    groups, total = padded(sequences), sum(len(y) for _, y in sequences)
    w, p = np.zeros((N_FEATURES, 2)), np.zeros((2, 2))
    means, squares = np.zeros(2 * N_FEATURES + 4), np.zeros(2 * N_FEATURES + 4)
    for step in range(1, STEPS + 1):
        slopes = [g.likelihood(w, p)[1:] for g in groups]
        gw, gp = sum(a for a, _ in slopes) / total, sum(b for _, b in slopes) / total
        g = np.concatenate([gw.ravel(), gp.ravel()]) - 1e-4 * np.concatenate([w.ravel(), p.ravel()])
        means, squares = 0.9 * means + 0.1 * g, 0.99 * squares + 0.01 * g * g
        move = 0.15 * (means / (1 - 0.9**step)) / (np.sqrt(squares / (1 - 0.99**step)) + 1e-8)
        w, p = w + move[: 2 * N_FEATURES].reshape(-1, 2), p + move[2 * N_FEATURES :].reshape(2, 2)
    return w, p


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, np.ndarray] | None:
    """Weights of the field, or None without labels of both kinds."""
    said = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most"))
    said = said.where("quality = most").select(F.col("doc_id").alias("k"), "quality", hash_order("doc_id", 5).alias("order"))
    chosen = said.where("quality = 0").orderBy("order").limit(SAMPLE_ROWS).unionByName(said.where("quality = 1").orderBy("order").limit(SAMPLE_ROWS))
    rows = docs.select(F.col(id_col).alias("k"), text_of(text_col).alias("text")).join(F.broadcast(chosen), "k")
    rows = rows.groupBy("k", "quality", "order").agg(F.min("text").alias("text")).repartition(SAMPLE_TASKS)
    schema = T.StructType([T.StructField("quality", T.IntegerType()), T.StructField("order", T.LongType()), T.StructField("n", T.LongType()), T.StructField("lines", T.BinaryType())])

    def run(batches):
        for batch in batches:
            for part in rows_in_slices(batch):
                made = [(x, again) for x, _, again in map(line_features, part.column(2).to_pylist())]
                packed = [np.column_stack([x, again]).astype("<f8").tobytes() for x, again in made]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int32()), part.column(1), pa.array([len(x) for x, _ in made], pa.int64()), pa.array(packed, pa.binary())], schema.names)

    sample = settled(rows.select("quality", "order", "text").mapInArrow(run, schema).where("n > 0"))
    sequences, kinds = [], set()
    for quality in (0, 1):
        of_kind = sample.where(F.col("quality") == quality)
        sizes = of_kind.select("order", "n").orderBy("order").collect()
        wanted = [sizes[i].order for i in fitting([r.n for r in sizes], SAMPLE_LINES)]
        for r in of_kind.where(F.col("order").isin(wanted)).orderBy("order").collect() if wanted else []:
            lines = np.frombuffer(r.lines, "<f8").reshape(r.n, N_FEATURES + 1)
            x, again = lines[:, :N_FEATURES], lines[:, N_FEATURES] > 0
            sequences.append((x, np.where(again | (x[:, 8] > 0), 0, 1) if quality else np.zeros(len(x), int)))
            kinds.add(quality)
    return trained(sequences) if len(kinds) == 2 else None


def content_share(text: str, field: tuple[np.ndarray, np.ndarray]) -> float:
    x, chars, _ = line_features(text)
    if not len(x):
        return 0.0
    return float(chars[viterbi(x @ field[0], field[1]) == 1].sum() / chars.sum())


def ruled(docs: DataFrame, field: tuple[np.ndarray, np.ndarray] | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the base counts, base_failed, kept, content_share of every whole text."""
    ids = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("doc_id", ids), *(T.StructField(n, T.LongType()) for n in COUNTS), *(T.StructField(n, T.BooleanType()) for n in ("base_failed", "kept")), T.StructField("content_share", T.DoubleType())])

    def run(batches):
        for batch in batches:
            for part in rows_in_slices(batch):
                texts = part.column(1).to_pylist()
                base = counted(texts)
                failed = (base[:, 0] < LEAST_WORDS) | (100 * base[:, 4] > MOST_REPEATED * base[:, 0])
                share = np.array([content_share(t, field) if field else 1.0 for t in texts], float)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.int64()) for c in base.T), pa.array(failed), pa.array(~failed & (share >= CONTENT_SHARE)), pa.array(share)], schema.names)

    return docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, schema)
