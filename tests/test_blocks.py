"""Best of blocks against all pairs, and vectors of texts against their features one by one."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from accordant.operators import vectors as V
from accordant.operators.entities import nearest


def test_best_in_blocks_by_brute_force(spark):
    """Small blocks, three scopes and none, copies, vectors of length zero, and ids that a query must not meet."""
    draw = np.random.default_rng(7)
    rows = [(i, [None, "p", "q", "r"][i % 4], [float(x) for x in draw.normal(size=8)]) for i in range(300)]
    rows = [(i, s, rows[(i // 40) * 4 + i % 4][2] if i >= 240 else v) for i, s, v in rows] + [(900, "p", [0.0] * 8)]
    items = spark.createDataFrame(rows, "id long, scope string, v array<double>")
    queries = items.where("id % 3 = 0").select("scope", F.col("id").alias("query_id"), "v")
    found = V.top_k(V.best_in_blocks(queries, items, 6, cosine=True, apart=True, block=16), 6).collect()
    want = {}
    for q, s, a in rows:
        if q % 3 or s is None or not any(a):
            continue
        sim = lambda b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5)
        want[q] = sorted((-sim(b), i) for i, t, b in rows if t == s and i != q and any(b))[:6]
    got = {}
    for r in found:
        got.setdefault(r.query_id, []).append((-r.sim, r.id))
    assert got.keys() == want.keys() and all([i for _, i in sorted(got[q])] == [i for _, i in want[q]] for q in want)


def test_equal_similarities_stand_by_the_greater_key(spark):
    known = spark.createDataFrame([(f"k{i:03}", "Acme Works") for i in range(50)] + [("z", "Other")], "entity_key string, name string")
    asked = spark.createDataFrame([(1, "acme works"), (2, " "), (3, None), (4, "qqq")], "candidate_id int, name string")
    assert [(r.candidate_id, r.entity_key, round(r.sim, 9)) for r in nearest(asked, known).collect()] == [(1, "k049", 1.0)]


def test_text_vectors_by_hand(spark):
    draw = random.Random(3)
    word = lambda: "".join(draw.choices("abcäß9Ж", k=draw.randrange(1, 7)))
    rows = [(i % 25, " ".join(word() for _ in range(draw.randrange(0, 60))) + draw.choice(["", "! ", " Ab-ab"])) for i in range(40)] + [(50, None), (51, " ?! "), (1, None)]
    table = spark.createDataFrame(rows, "id int, text string")
    want = {}
    for i, text in rows:
        for w in "".join(c if c.isalnum() else " " for c in (text or "").lower()).split():
            for feature, weight in [("w:" + w, 1.5)] + [("g:" + f" {w} "[j : j + 3], 1.0) for j in range(len(w))]:
                d = hashlib.sha256(feature.encode()).hexdigest()
                at = want.setdefault(i, {})
                at[int(d[:8], 16) % 1024] = at.get(int(d[:8], 16) % 1024, 0.0) + (weight if d[8] < "8" else -weight)
    want = {(i, b): x / sum(y * y for y in at.values()) ** 0.5 for i, at in want.items() for b, x in at.items() if x}
    for made in (V.as_rows(V.text_vectors(table, "id", "text")), V.vectors(V.features(table, "id", "text"))):
        got = {(r.id, r.bucket): r.weight for r in made.collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
    assert {(r.id, r.bucket): r.weight for r in V.as_rows(V.as_whole(V.vectors(V.features(table, "id", "text")))).collect()} == got


@pytest.mark.parametrize("name", ["v1_features", "v2_vectors"])
def test_texts_are_shuffled_once(spark, sf_dir, name):
    """No feature and no bucket is a row of a shuffle."""
    from accordant.plans import QUERIES

    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


@pytest.mark.parametrize("name", ["v1_features", "v2_vectors", "v3_null_vectors", "v9_index_status"])
def test_texts_are_taken_apart_once(spark, sf_dir, name):
    """A filter on what Python makes of a text must not make it a second time."""
    from accordant.plans import QUERIES

    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") + plan.count("MapInArrow") == 1


def test_each_row_has_its_own_vector_or_null(spark):
    """Rows of one id and of none do not mix; the vectors are those of the texts by themselves, and null for texts without features, whatever else is in their slice."""
    texts = ["Ab-ab acme", "?! …", None, "", "Ж ß9", "acme", " ", "Ab-ab acme"]
    rows = spark.createDataFrame([([1, 1, 2, None][i % 4], i, t) for i, t in enumerate(texts)], "id int, n int, t string")
    alone = {r.id: (r["at"], r.weights) for r in V.text_vectors(rows, "n", "t").collect()}
    got = sorted(((r.id, r["at"], r.weights) for r in V.row_vectors(rows, "id", "t").collect()), key=repr)
    assert got == sorted(((r.id, *alone.get(r.n, (None, None))) for r in rows.collect()), key=repr) and sum(a is None for _, a, _ in got) == 4
    assert [tuple(r) for r in V.row_vectors(rows.where("n = 1"), "n", "t").collect()] == [(1, None, None)]


def test_null_vectors_stay_with_their_rows(spark, sf_dir):
    """Texts are shuffled once, and no vector is shuffled to meet its row."""
    from accordant.plans import QUERIES

    plan = QUERIES["v3_null_vectors"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and plan.count("MapInArrow") == 1


def test_texts_are_cut_in_slices_and_words_keep_their_rows(monkeypatch):
    said = [["a b", " c "], [], ["long " * 30], ["Ж ß", ""], [" "], ["a"], ["a a"], ["b"]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(said, pa.list_(pa.string()))], ["id", "said"])
    monkeypatch.setattr(V, "SLICE", 3), monkeypatch.setattr(V, "CHARS", 10), monkeypatch.setattr(V, "SPREAD", 2)
    found, ids = [], []
    for piece in V.in_slices(iter([batch, batch.slice(0, 0)])):
        rows, at, words = V.spoken_words(piece.column("said"))
        here = piece.column("id").to_pylist()
        ids.append(here)
        found += [(here[r], words[w]) for r, w in zip(rows, at)]
        if words:
            names, sizes, numbers, weights = V.made_of(words)
            each = [(here[r], names[numbers[p]], weights[p]) for rs, ps in V.spread(rows, at, sizes) for r, p in zip(rs, ps)]
            assert sorted(each) == sorted((here[r], *f) for r, w in zip(rows, at) for f in [("w:" + words[w], 1.5)] + [("g:" + f" {words[w]} "[i : i + 3], 1.0) for i in range(len(words[w]))])
    assert ids == [[0, 1], [2], [3, 4, 5], [6, 7]] and found == [(i, w) for i, texts in enumerate(said) for t in texts for w in t.split()]


@pytest.mark.parametrize("name", ["j5_near_match", "w7_top_k", "v6_span_search", "v12_weak_answers", "v8_all_lists", "v8_approximate"])
def test_pairs_meet_in_blocks(spark, sf_dir, name):
    """No join makes a row for each pair, or for each bucket that a pair shares."""
    from accordant.plans import QUERIES

    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "zip_with" not in plan and "(bucket" not in plan


@pytest.mark.parametrize("digits", [True, False])
def test_closest_by_brute_force(monkeypatch, digits):
    """Numbered names, which are alike in most of their trigrams, and names of any sort, with copies: the best of the greatest place, and few of the pairs are multiplied."""
    import pandas as pd

    draw = random.Random(11)
    word = lambda: "".join(draw.choices("abcdefgh", k=draw.randrange(3, 8)))
    names = [f"supplier {n:09}" if digits else f"{word()} {word()}" for n in range(3000)]
    names += names[::50]
    asked = [draw.choice([f"the {s} group inc", s, s.replace("pp", "p") + "x", f"{s} and supplier 000000003", "wholly other firm", s[::-1]]) for s in draw.sample(names, 400)]

    def made(texts):
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([[t] for t in texts], pa.list_(pa.string()))], ["id", "said"])
        return pd.concat([b.to_pandas() for b in V.summed_in(V.BUCKETS, False)(iter([batch]))], ignore_index=True)

    left, right = made(asked), made(names)
    monkeypatch.setattr(V, "BATCH", 150), monkeypatch.setattr(V, "ALIKE", 40)
    rows, cols, sims, met = V._closest(left, right, 0.55, 9, V.BUCKETS)
    every = V._matrix(left, V.BUCKETS) @ V._matrix(right, V.BUCKETS).T
    keys = np.floor(every * 1e9 + 0.5)
    want = {i: int(keys[i].argmax()) for i in range(len(left)) if every[i].max() >= 0.55}
    assert dict(zip(rows.tolist(), cols.tolist())) == want and 150 < len(want) < 400
    assert all(s == pytest.approx(every[i, j], abs=1e-12) for i, j, s in zip(rows, cols, sims))
    assert met < 0.25 * every.size
    assert len(V._closest(left, right[:1], 0.55, 9, V.BUCKETS)[0]) < 400
    assert [tuple(map(len, V._closest(made(["zzzz qqqq"]), right, 0.55, 9, V.BUCKETS)[:3]))] == [(0, 0, 0)]
