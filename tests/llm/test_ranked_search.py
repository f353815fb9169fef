"""Ranked search against scoring every document, with odd input."""

import collections
import math
import random
import re

import numpy as np
import pytest
from compare import differ, duck

from accordant.llm import ranked_search as R
from accordant.llm.registry import ORACLES, QUERIES

TERM = re.compile(R.TERM)
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    """docs: (doc_id, text); items: (item_id, text)."""
    counted = [(i, collections.Counter(words(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n_docs, n_terms = len(counted), sum(sum(c.values()) for _, c in counted)
    df = collections.Counter(t for _, c in counted for t in c)
    w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for t, d in df.items()}
    asked = collections.defaultdict(set)
    for i, t in items:
        asked[i] |= set(words(t))
    out = set()
    for item, terms in asked.items():
        scored = []
        for i, c in counted:
            m = 10 + (90 * sum(c.values()) * n_docs) // n_terms
            score = sum(w[t] * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out |= {(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scored)[:k], 1)}
    return out


def found(df):
    rows = [(r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("few", [False, True])
def test_search(spark, odd, documents, sf_dir, few, monkeypatch):
    """few: small shards, an index of all terms and many blocks of items."""
    docs = odd.select("doc_id", "text").unionByName(documents.selectExpr("doc_id + 1000 as doc_id", "text"))
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    more = spark.createDataFrame([(-1, None), (-2, ""), (-3, "zzzunknown"), (None, "the lazy fox ÜNÏ Ünï 日本語 long"), (-4, "words ONE two"), (-4, "three col"), (-5, "long " * 5000)], "item_id long, text string")
    items = items.select("item_id", "text").unionByName(more)
    if few:
        monkeypatch.setattr(R, "SHARD_DOCS", 7)
    got = found(R.ranked(docs, items, block_pairs=300 if few else None))
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])


def test_nothing(odd, nothing):
    items = odd.selectExpr("doc_id as item_id", "text")
    assert R.ranked(nothing, items).count() == R.ranked(odd, items.where("false")).count() == 0


def test_ties_go_to_the_smallest_ids(spark):
    rows = [(i, "same words here" if i % 2 else f"other {i}") for i in random.Random(1).sample(range(3000), 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    items = spark.createDataFrame([(1, "same"), (2, "other here")], "item_id long, text string")
    assert found(R.ranked(docs, items)) == brute(rows, [(1, "same"), (2, "other here")])


@pytest.mark.parametrize("seed", range(8))
def test_searcher(seed):
    """Random postings: the best are exact, maxima are, and most documents are never scored."""
    draw = random.Random(seed)
    n, terms = draw.choice([1, 2, 50, 3000]), [f"t{i}" for i in range(12)]
    held = {t: sorted(draw.sample(range(n), draw.randrange(1, n + 1))) for t in terms}
    counts, docs = np.array([len(held[t]) for t in terms], np.int32), np.array([d for t in terms for d in held[t]], np.int32)
    tfs, lengths = np.array([draw.choice([1, 1, 2, 9]) for _ in docs], np.int32), np.array([draw.randrange(1, 500) for _ in range(n)], np.int64)
    weights = {t: draw.randrange(0, 9000) for t in terms[:-1]}
    shard = R.Searcher(list(range(100, 100 + n)), lengths, terms, counts, docs, tfs, weights, n, int(lengths.sum()))
    for _ in range(50):
        lo = draw.randrange(len(shard.impact))
        hi = min(len(shard.impact), lo + draw.randrange(0, int(counts.max()) + 1))
        value, at = shard.maxima(np.array([[lo]]), np.array([[hi]]))
        assert value[0, 0] == max(shard.impact[lo:hi], default=0) and (lo == hi or lo <= at[0, 0] < hi)
    for asked in (terms, terms[:3], ["t11", "none"]):
        total = collections.Counter()
        for t in asked:
            start, stop, _ = shard.lists.get(t, (0, 0, 0))
            for d, x in zip(shard.docs[start:stop], shard.impact[start:stop]):
                total[int(d) + 100] += int(x)
        want = sorted((-s, d) for d, s in total.items() if s > 0)[:10]
        assert shard.best(asked, 10, []) == want
        assert shard.best(asked, 10, want) == sorted(want + want)[:10]


def test_sql(spark, sf_dir):
    assert differ(QUERIES["op11_ranked_search"](spark, sf_dir), duck(sf_dir), ORACLES["op11_ranked_search"]) == ""
