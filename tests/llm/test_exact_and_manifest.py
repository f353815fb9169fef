"""Exact duplicates and the Merkle manifest against brute force, with odd input."""

import collections
import hashlib
import random
import string
import zlib

import pytest
from compare import differ, duck
from pyspark.sql import functions as F

from accordant.llm import exact_duplicates as D
from accordant.llm import merkle_manifest as M
from accordant.llm.registry import ORACLES, QUERIES


def bag(rows):
    return collections.Counter(tuple(r) for r in rows)


# ---------------------------------------------------------------------- op12


def groups_of(rows, keep):
    """rows of (id, text)."""
    held = collections.defaultdict(list)
    for i, text in rows:
        held[text or ""].append(i)
    best = {t: (min if keep == "smallest" else max)([i for i in ids if i is not None], default=None) for t, ids in held.items()}
    return bag((i, best[t or ""], len(held[t or ""]), i == best[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_groups(odd, documents, keep):
    docs = odd.select("doc_id", "text", "source").unionByName(documents.select(F.col("doc_id") + 1000, "text", "source").toDF("doc_id", "text", "source"))
    assert bag(D.duplicate_groups(docs, keep=keep).collect()) == groups_of([(r.doc_id, r.text) for r in docs.collect()], keep)


def test_groups_of_odd_columns_and_of_nothing(spark, odd, nothing):
    assert D.duplicate_groups(nothing).count() == D.deduplicated(nothing).count() == 0
    named = spark.createDataFrame([("b", "x"), ("a", "x"), (None, "x"), (None, "y"), (None, "y")], "doc_id string, text string")
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in D.duplicate_groups(named).collect()} == {("b", "a", 3, False), ("a", "a", 3, True), (None, "a", 3, False), (None, None, 2, True)}
    clash = named.selectExpr("doc_id", "text", "1 as content", "2 as owner", "3 as `row`", "4 as n_bytes")
    kept = D.deduplicated(clash)
    assert kept.columns == clash.columns and sorted((r.doc_id or "", r.text) for r in kept.collect()) == [("", "y"), ("a", "x")]
    assert D.deduplicated(odd).count() == odd.select(F.coalesce("text", F.lit(""))).distinct().count()


def test_tries_that_spill_lose_nothing(spark, monkeypatch):
    draw = random.Random(3)
    pool = ["".join(draw.choices("ab", k=draw.randrange(0, 30))) for _ in range(300)] + ["x" * n for n in range(0, 400, 7)] + ["é" * 900 + str(i) for i in range(9)]
    rows = [(i, draw.choice(pool) if i % 3 else pool[7]) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    monkeypatch.setattr(D, "TRIE_BYTES", 9_000)
    assert D.partial_owners(docs).count() > len(set(pool))  # texts left more than once
    assert bag(D.duplicate_groups(docs, keep="largest").collect()) == groups_of(rows, "largest")


@pytest.mark.parametrize("seed", range(6))
def test_trie(seed):
    draw = random.Random(seed)
    texts = [bytes(draw.choices(b"abc", k=draw.randrange(0, 12))) for _ in range(600)]
    trie, want, got = D.Trie("smallest"), {}, {}
    for i, t in enumerate(texts):
        owner = draw.randrange(1000)
        assert trie.insert(t, owner) == (t not in want)
        want.setdefault(t, []).append(owner)
    before = trie.size
    first = [(t, tuple(x)) for t, x in trie.spilled()]
    assert trie.size <= before - before // 2 + 1 and first
    assert sum(len(n.edge) + D.NODE_BYTES for n in nodes(trie.root)) - D.NODE_BYTES == trie.size
    for t, (owner, n, _) in [*first, *trie.drained()]:
        assert t not in got
        got[t] = (owner, n)
    assert got == {t: (min(o), len(o)) for t, o in want.items()}


def nodes(node):
    yield node
    for first, kid in node.kids.items():
        assert kid.edge[0] == first and (kid.terminal is not None or len(kid.kids) > 1)
        yield from nodes(kid)


def test_prefix_chains_are_not_recursive():
    trie = D.Trie()
    for n in range(3000):
        trie.insert(b"x" * n, n)
    assert sum(1 for _ in trie.spilled()) + sum(1 for _ in trie.drained()) == 3000


# ---------------------------------------------------------------------- op13


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(values):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree_of(leaves):
    """Root, and per leaf the siblings of each level."""
    paths, held, level = [[] for _ in leaves], list(leaves), 1
    while len(held) > 1:
        for i in range(len(leaves)):
            own = i // level
            run = own // 16 * 16
            paths[i].append(("".join(held[run:own]), "".join(held[own + 1 : run + 16])))
        held, level = [digest("".join(held[i : i + 16])) for i in range(0, len(held), 16)], level * 16
    return held[0], paths


def manifest_of(rows):
    """rows of (doc_id, source, lang, n_chars, text)."""
    parts, out = collections.defaultdict(list), []
    for r in rows:
        parts[(r[1] is not None, (r[1] or "").encode())].append((r[0] is not None, r[0] or 0, leaf_of(r), r))
    subroots, below = [], []
    for key in sorted(parts):
        held = sorted(parts[key], key=lambda x: x[:3])
        top, paths = tree_of([x[2] for x in held])
        subroots.append(top)
        below.append((held, paths))
    root, above = tree_of(subroots)
    for (held, paths), up, subroot in zip(below, above, subroots):
        for (_, _, leaf, r), path in zip(held, paths):
            at = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                lowered = None if r[4] is None else r[4].translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
                at = leaf_of([*r[:4], lowered])
            for left, right in path + up:
                at = digest(left + at + right)
            out.append((r[0], leaf, subroot, root, digest("".join(a + b for a, b in path + up)), at, at == root))
    return bag(out)


def checked(docs):
    tampered = {"text": F.translate("text", string.ascii_uppercase, string.ascii_lowercase)}
    return M.verified(docs, tampered, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)


def test_manifest_of_odd_rows(odd, nothing):
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in odd.collect()]
    assert bag(checked(odd).collect()) == manifest_of(rows)
    assert checked(nothing).count() == 0


@pytest.mark.parametrize("sizes", [[1], [2], [16], [17, 1, 256], [700, 1, 3], [1] * 40 + [20]], ids=str)
def test_manifest_of_parts_of_any_size(spark, sizes):
    rows = [(1000 * p + i * 3 % 997, f"s{p}é" if p else None, "en", i, f"Text {i}") for p, n in enumerate(sizes) for i in range(n)]
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(3)
    assert bag(checked(docs).collect()) == manifest_of(rows)


def test_labels_cover_what_the_children_cover(spark):
    docs = spark.range(600).selectExpr("id as doc_id", "'one' as source", "id as n_chars", "null as lang", "cast(id as string) as text")
    rows = M.ranked(docs.select(F.lit("p").alias("part"), F.col("doc_id").alias("row"), F.sha2("text", 256).alias("digest")), "part", "row")
    for k, groups in enumerate(M.grown(rows), 1):
        held = sorted((g.lo, g.hi, [(x.lo, x.hi) for x in g.kids]) for g in groups.collect())
        assert [h[0] for h in held] == list(range(0, 600, 16**k)) and all(lo == kids[0][0] and hi == kids[-1][1] and all(a[1] == b[0] for a, b in zip(kids, kids[1:])) for lo, hi, kids in held)


@pytest.mark.parametrize("name", ["op12_exact_duplicates", "op13_merkle_manifest"])
def test_sql(spark, sf_dir, name):
    assert differ(QUERIES[name](spark, sf_dir), duck(sf_dir), ORACLES[name]) == ""
