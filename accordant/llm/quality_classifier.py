"""Quality classifier by compression against labelled dictionaries.

Two zstandard dictionaries hold labelled good and bad documents.  A text is
compressed whole with either one and with none; the differences of the compressed
sizes, normalised by the length, by its root and by the plain size, become a
calibrated score through a logistic curve fitted on other labelled documents.
Nothing but these differences goes into the score.

Learning sees only labelled rows whose crc32(doc_id) mod FOLDS is not HELD_OUT,
and a bounded sample of those: the ids smallest in a fixed hash order, at most
DICTIONARY_ROWS of either label for the dictionaries, of which whole texts are
taken in that order as long as they fit in DICTIONARY_BYTES, and CALIBRATION_ROWS
others for the curve.  Every document is scored whole.

Defined results for odd input: a null text is an empty one and gets the score of
difference zero; repeated rows give repeated rows; an id with two labels that
differ is not learnt from, and of one with several texts the smallest is; where no
labelled row is left for the curve, or only of one label, the rows of the
dictionaries serve for it; documents may be an empty table; without labels of both
kinds every score is 0.5; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from accordant.llm.common import fitting, hash_order, rows_in_slices, settled, text_of

FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.3
DICTIONARY_ROWS, DICTIONARY_BYTES, LEVEL = 1400, 1_000_000, 9
CALIBRATION_ROWS, CALIBRATION_PERCENT, CURVE_TASKS = 4000, 40, 16


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == HELD_OUT


def shape(sizes: np.ndarray) -> np.ndarray:
    """Of (length, good size, bad size, plain size): what either dictionary saves, by the length, by its root, and by the plain size."""
    n, good, bad, plain = sizes.T.astype(float)
    saved = np.column_stack([plain - good, plain - bad])
    return np.hstack([saved / by[:, None] for by in (np.maximum(n, 1.0), np.sqrt(np.maximum(n, 1.0)), plain)])


class Compressors:
    """With the good dictionary, with the bad one and with none, made once in each worker."""

    def __init__(self, good: bytes, bad: bytes):
        import zstandard as z

        def one(content: bytes):
            held = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=LEVEL)
            return z.ZstdCompressor(dict_data=held, level=LEVEL)

        self.all = [one(good), one(bad), z.ZstdCompressor(level=LEVEL)]

    def sizes(self, texts: list[str]) -> np.ndarray:
        raw = [t.encode() for t in texts]
        return np.array([(len(r), *(len(c.compress(r)) for c in self.all)) for r in raw], np.int64).reshape(-1, 4)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Weights (bias last) over standardised columns, by Newton steps, given back for the raw columns."""
    mean, sd = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([(x - mean) / sd, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + ridge * len(x) * np.eye(len(w))
        step = np.linalg.solve(h, z.T @ (p - y) + ridge * len(x) * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return np.append(w[:-1] / sd, w[-1] - (w[:-1] * mean / sd).sum())


class Model:
    def __init__(self, good: bytes = b"", bad: bytes = b"", weights: np.ndarray | None = None):
        self.good, self.bad, self.weights, self.made = good, bad, weights, None

    def __getstate__(self):
        return self.__dict__ | {"made": None}

    def score(self, texts: list[str]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), 0.5)
        self.made = self.made or Compressors(self.good, self.bad)
        x = shape(self.made.sizes(texts))
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learn from bounded samples; ids with two labels that differ are left out."""
    said = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most"))
    said = said.where("quality = most").select("doc_id", "quality").withColumn("order", hash_order("doc_id"))
    # one labelled row is either in a dictionary or behind the curve, never both
    curve = F.pmod("order", F.lit(100)) < CALIBRATION_PERCENT
    chosen = [said.where(~curve & (F.col("quality") == q)).orderBy("order").limit(DICTIONARY_ROWS).withColumn("part", F.lit(f"d{q}")) for q in (0, 1)]
    chosen.append(said.where(curve).orderBy("order").limit(CALIBRATION_ROWS).withColumn("part", F.lit("c")))
    ids = chosen[0].unionByName(chosen[1]).unionByName(chosen[2]).select(F.col("doc_id").alias("k"), "quality", "order", "part")
    rows = docs.select(F.col(id_col).alias("k"), text_of(text_col).alias("text")).join(F.broadcast(ids), "k")
    rows = settled(rows.groupBy("k", "quality", "order", "part").agg(F.min("text").alias("text")))
    held = {}
    for part in ("d0", "d1"):
        of_part = rows.where(F.col("part") == part)
        sizes = of_part.select("order", "k", F.octet_length("text").alias("n")).orderBy("order", "k").collect()
        wanted = [sizes[i].k for i in fitting([r.n for r in sizes], DICTIONARY_BYTES)]
        texts = of_part.where(F.col("k").isin(wanted)).orderBy("order", "k").collect() if wanted else []
        held[part] = "\n".join(r.text for r in texts).encode()
    if min(map(len, held.values())) < 64:
        return Model()
    compressors = held["d1"], held["d0"]
    fields = [T.StructField(n, T.LongType()) for n in ("n", "good", "bad", "plain", "quality")]

    def run(batches):
        made = Compressors(*compressors)
        for batch in batches:
            for part in rows_in_slices(batch):
                sizes = made.sizes(part.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in sizes.T), part.column(1).cast(pa.int64())], [f.name for f in fields])

    for curve_rows in (rows.where("part = 'c'"), rows.where("part <> 'c'")):
        got = np.array([tuple(r) for r in curve_rows.select("text", "quality").repartition(CURVE_TASKS).mapInArrow(run, T.StructType(fields)).collect()], np.int64).reshape(-1, 5)
        if len(set(got[:, 4])) == 2:
            break
    got = got[np.lexsort(got.T)]
    return Model(held["d1"], held["d0"], logistic(shape(got[:, :4]), got[:, 4].astype(float)))


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text."""
    ids = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("doc_id", ids), T.StructField("score", T.DoubleType())])

    def run(batches):
        for batch in batches:
            for part in rows_in_slices(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.score(part.column(1).to_pylist()), pa.float64())], ["doc_id", "score"])

    made = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, schema)
    return made.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier does not reject, in the columns of docs."""
    model, at = fit(docs, labels), docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for part in rows_in_slices(batch):
                texts = [t or "" for t in part.column(at).to_pylist()]
                yield part.filter(pa.array(model.score(texts) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
