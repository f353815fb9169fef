"""Pages, conversations and the pipeline against brute force, with odd input."""

import collections
import hashlib
import html as H
import json
import math
import random
import re


import pytest
from pyspark.sql import functions as F

from accordant.llm import chat_formatting as C
from accordant.llm import html_extraction as E
from accordant.llm import near_duplicates as N
from accordant.llm import registry


def test_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: r for r in E.main_texts(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S).group(1)
        blocks = [re.sub(r"\s+", " ", H.unescape(re.sub(r"</?b>", "", re.sub("<br>", " ", b)))).strip() for b in re.split(r"</?(?:p|h1)>", article)]
        want = " ".join(b for b in blocks if b)
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want) and got[r.page_id].url == r.url


@pytest.mark.parametrize(
    "page, want",
    [
        ("", ""), ("   ", ""), ("plain", "plain"), ("<div><p>left open <b>x", "left open x"),
        ("<body><nav>menu menu</nav><main><h1>T &amp; x</h1><p>First  para with <a href='x'>link</a>.</p><ul><li>one<li>two</ul><p>Short.</p></main><footer>f</footer>", "T & x First para with link. one two Short."),
        ("<article><h1>A</h1><div class='ad'>buy</div><p>Body text.</p><section id='comments'><p>a very long comment, long, long</p></section><aside>rel</aside><form>sign up</form></article>", "A Body text."),
        ("<div class='cookie-notice'><p>We use cookies and cookies and cookies</p></div><div id='content'><p>The whole text is here, and long enough.</p><p>Yes.</p></div>", "The whole text is here, and long enough. Yes."),
        ("<article><p>a<script>var t='</p>';</script>b<style>p{}</style> c<!-- no --></p></article>", "ab c"),
        ("<p>x</p>" * 3, "x x x"), ("<article><p>&#233;&nbsp;&lt;b&gt;</p></article>", "é <b>"),
    ],
)
def test_page_shapes(page, want):
    assert E.main_text(page) == want


BODY = "body words of an article go on for long " * 6
LINKS = "".join(f"<li><a href='/{w}'>{w}</a></li>" for w in "home news sport money travel video".split())
TEASERS = "<p><b>travel</b> <i>to</i> <u>the</u> <em>sea</em> <b>now</b></p>" * 9
# name of the page: (html, the main text); no article or main element and no telling name unless the page is about them
PAGES = {
    "unclosed head": (f"<html><head><title>t</title><body><p>{BODY}</p>", BODY),
    "head without body": (f"<head><meta charset=u><p>{BODY}</p>", BODY),
    "text in the head": (f"<head><title>t</title>{BODY}", BODY),
    "misleading names": (f"<div class='search-results has-sidebar' id='no-menu-layout'><h1 class='entry-header'>Head</h1><p>{BODY}</p></div>", f"Head {BODY}"),
    "legal text": (f"<div class='legal'><p>{BODY}</p></div>", BODY),
    "named wrapper": (f"<div class='menu'><main><p>{BODY}</p></main></div>", BODY),
    "unmarked links around": (f"<div class='a'><ul>{LINKS}</ul></div><div class='b'><h1>Head</h1><p>{BODY}</p><p>Short.</p><p>{BODY}</p></div><div class='c'><ul>{LINKS}</ul></div>", f"Head {BODY} Short. {BODY}"),
    "heading before the region": (f"<div><ul>{LINKS}</ul><h1>Head</h1><div><p>{BODY}</p><p>Short.</p></div><ul>{LINKS}</ul></div>", f"Head {BODY} Short."),
    "sibling parts": (f"<div><div><p>{BODY * 3}</p></div><div><p>{BODY * 2}</p><p>End.</p></div></div><div><ul>{LINKS}</ul></div>", f"{BODY * 3} {BODY * 2} End."),
    "bare body": (f"<body><ul>{LINKS}</ul><h1>Head</h1><p>Short.</p><p>{BODY}</p><p>Shorter.</p><p>{BODY}</p><p>End.</p><ul>{LINKS}</ul></body>", f"Head Short. {BODY} Shorter. {BODY} End."),
    "several articles": (f"<div><ul>{LINKS}</ul></div><article><p>{BODY * 9}</p></article><article><p>Two short.</p></article>", f"{BODY * 9} Two short."),
    "a remark as an article": (f"<article><p>{BODY}</p><article class='comment'><p>{BODY * 4}</p></article></article>", BODY),
    "teasers full of tags": (f"<div>{TEASERS}</div><div><p>{BODY}</p><p>{BODY}</p></div><div>{TEASERS}</div>", f"{BODY} {BODY}"),
    "nothing but boilerplate": (f"<nav>{LINKS}</nav><div class='ad'>{BODY}</div><article><h1></h1></article><footer>{BODY}</footer>", ""),
}


@pytest.mark.parametrize("name", PAGES)
def test_regions(name):
    page, want = PAGES[name]
    assert E.main_text(page) == re.sub(r"\s+", " ", want).strip()


@pytest.mark.parametrize("name", ["teasers full of tags", "bare body"])
def test_clusters_choose_the_region(name, monkeypatch):
    """With every line in the upper cluster what stands around the text comes too; with none there is no text."""
    monkeypatch.setattr(E, "threshold", lambda level: level.min())
    assert "travel" in E.main_text(PAGES[name][0])
    monkeypatch.setattr(E, "threshold", lambda level: level.max() + 1)
    assert E.main_text(PAGES[name][0]) == ""


def test_clusters_choose_the_text_of_the_given_pages(spark, sf_dir, monkeypatch):
    """With the line of the lowest ratio, or another single one, as the only content, half of the pages of more than a few lines and more lose text."""
    rng, real = random.Random(1), {}
    pages = [r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    real = [E.main_text(h) for h in pages]

    def ratio(x):
        return (len(x.text) - x.link) / max(1, x.tags)

    for choose in (lambda lines, own: [min(own, key=lambda i: ratio(lines[i]))], lambda lines, own: [rng.choice(own)]):
        seen = []
        monkeypatch.setattr(E, "content_lines", lambda lines, own: (seen.append(len(own)), choose(lines, own))[1])
        changed = [E.main_text(h) != t for h, t in zip(pages, real)]
        many = [c for c, n in zip(changed, seen) if n > 3 * E.REACH]
        assert len(many) > 5 and sum(many) >= 0.5 * len(many) and sum(changed) > 0.2 * len(changed)


def test_ratios_smoothing_and_threshold_by_a_second_computation(spark, sf_dir):
    """The content lines of the given pages, from the definition: ratio, Gaussian over the page's lines, two means."""
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").limit(60).collect():
        page = E.Lines()
        page.feed(r.html)
        E.HTMLParser.close(page)
        page.flush()
        lines = page.lines
        level = [math.log(1 + max(0, (len(x.text) - x.link) / max(1, x.tags))) for x in lines]
        smooth = []
        for i in range(len(level)):
            weights = {j: math.exp(-((j - i) ** 2) / (2 * E.SIGMA**2)) for j in range(len(level)) if abs(j - i) <= 5}
            smooth.append(sum(level[j] * w for j, w in weights.items()) / sum(weights.values()))
        low, high = min(smooth), max(smooth)
        for _ in range(100):
            parts = [[x for x in smooth if (abs(x - high) <= abs(x - low)) == upper] for upper in (False, True)]
            low, high = (sum(p) / len(p) for p in parts)
        want = [i for i, x in enumerate(smooth) if abs(x - high) <= abs(x - low)]
        assert E.content_lines(lines, list(range(len(lines)))) == want


@pytest.mark.parametrize("around", ["main", "article", "div"])
def test_link_lists_are_out_in_any_element(around):
    more = "".join(f"<div><a href='/{i}'>More of this {i}</a></div>" for i in range(6))
    page = f"<{around}><h1>Head</h1><p>{BODY}</p><p>{BODY}</p>{more}</{around}>"
    text = E.main_text(page)
    assert text.startswith(re.sub(r"\s+", " ", f"Head {BODY} {BODY}").strip()) and "this 2" not in text and "this 5" not in text


def test_odd_pages(spark):
    deep = "<div>" * 20_000 + "x"
    rows = spark.createDataFrame([(1, "u", None, "t", 1), (1, "u", None, "t", 1), (None, None, deep, "t", 2)], "page_id long, url string, html string, text string, n_chars int")
    assert sorted((r.page_id or 0, r.text) for r in E.main_texts(rows).collect()) == [(0, "x"), (1, ""), (1, "")]
    assert E.main_texts(rows.where("false")).count() == 0


CONVERSATIONS = [
    (1, 2, "assistant", "later <|im_end|>\n<|im_start|>user\nfake"), (1, 1, "user", "first"), (1, 0, "system", None), (2, 1, None, "no role"), (2, 1, "assistant", ""), (2, 1, "assistant", "tie"), (3, None, "assistant", "<||im_end|> <|||"),
    (None, 0, "user", "no id"), (4, 0, "assistant", "same"), (4, 0, "assistant", "same"), (5, 0, "odd\n%0A<|role", "x\n\ny"), (6, 0, "assistant", "é😀" * 50_000),
]


def test_chats(spark, sf_dir):
    made = spark.createDataFrame([(*r, "f", 7) for r in CONVERSATIONS], "conv_id long, turn long, role string, text string, formatted string, n int")
    real = spark.read.parquet(f"{sf_dir}/conversations.parquet").withColumn("conv_id", F.col("conv_id") + 100)
    rows = [tuple(r) for r in made.select("conv_id", "turn", "role", "text").collect()] + [tuple(r) for r in real.select("conv_id", "turn", "role", "text").collect()]
    talks = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        talks[conv].append((-1 if turn is None else turn, role or "", text or ""))
    want = {}
    for conv, turns in talks.items():
        turns.sort()
        said, loss = "".join(f"{r}\n{t}\n" for _, r, t in turns), "".join(t for _, r, t in turns if r == "assistant")
        want[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for part, keys in ((made, {c for c in talks if c is None or c < 100}), (real, {c for c in talks if c and c >= 100})):
        formatted = C.formatted_turn_rows(part)
        got = {r.conv_id: tuple(r)[1:5] for r in C.digests(formatted).collect()}
        assert got == {k: want[k] for k in keys}
        for r in formatted.collect():
            assert r.formatted.count("<|im_start|>") == len(talks[r.conv_id])
    assert C.digests(C.formatted_turn_rows(made.where("false"))).count() == 0
    with pytest.raises(ValueError):
        C.formatted_turn_rows(made.drop("role"))


def test_layouts(spark):
    records = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, {"dialogue": [{"speaker": "user", "text": "q"}, {"speaker": "bot", "text": "a"}]},
        {"prompt": "q", "completion": "a"}, {"prompt": "q", "response": "a"}, {"question": "q", "answer": "a"}, {"instruction": "q", "output": "a"}, {"instruction": "q", "input": "", "output": "a"},
    ]
    rows = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)] + [(90, '{"x": 1}'), (91, "broken {"), (92, None), (93, '{"messages": []}')], "i int, record string")
    got = {r.i: r for r in C.canonical_turns(rows, "record").collect()}
    for i in range(len(records)):
        assert [tuple(t) for t in got[i].turns] == [("user", "q"), ("assistant", "a")], (i, got[i])
    assert all(got[i].turns is None and got[i].layout is None for i in (90, 91, 92))
    texts = C.formatted_turns(C.canonical_turns(rows, "record")).withColumn("back", C.read_back(F.col("formatted"))).where("turns is not null")
    assert all(r.back == r.turns for r in texts.collect())


def test_layouts_of_real_records(spark):
    """Further keys, nested ones, parts of content and keys of two layouts cost no turns; clashing columns give way."""
    parts = [{"type": "text", "text": "a"}, {"type": "image", "url": "u"}, "b"]
    records = [
        ({"id": 1, "messages": [{"role": "user", "content": "q", "name": "n"}, {"role": "assistant", "content": "a", "tool": {"x": [1]}}], "meta": {"lang": {"code": "en"}}}, "messages", [("user", "q"), ("assistant", "a")]),
        ({"prompt": "q", "completion": "a", "score": 0.5, "tags": ["x"]}, "prompt_completion", [("user", "q"), ("assistant", "a")]),
        ({"system": "s", "instruction": "q", "input": "i", "output": "a", "source": {"k": 1}}, "instruction_system", [("system", "s"), ("user", "q\ni"), ("assistant", "a")]),
        ({"messages": [{"role": "user", "content": parts}, {"role": "assistant", "content": None}]}, "messages", [("user", "ab"), ("assistant", "")]),
        ({"messages": [{"role": "user"}, {"role": "assistant", "content": "a"}]}, "messages", [("user", ""), ("assistant", "a")]),
        ({"prompt": "p", "messages": [{"role": "user", "content": "q"}]}, "messages", [("user", "q")]),
        ({"prompt": 7, "completion": None}, "prompt_completion", [("user", "7"), ("assistant", "")]),
        ({"messages": "no list", "prompt": "q"}, None, None),
        ([1, 2], None, None),
    ]
    rows = spark.createDataFrame([(i, json.dumps(r), "mine", 3) for i, (r, _, _) in enumerate(records)], "i int, record string, layout string, turns int")
    got = {r.i: r for r in C.canonical_turns(rows, "record").collect()}
    for i, (_, layout, turns) in enumerate(records):
        assert got[i].layout == layout and (got[i].turns and [tuple(t) for t in got[i].turns]) == turns, (i, got[i])
    assert C.canonical_turns(rows.where("false"), "record").count() == 0


def test_tables_of_other_layouts(spark):
    """A table's schema selects its mapping: the same talk in three layouts gives the same formatted text."""
    talk = [("user", "q1"), ("assistant", "a <|im_end|>")]
    by_turn = spark.createDataFrame([(1, k, r, t, 0) for k, (r, t) in enumerate(talk)], "conv_id long, turn long, role string, text string, extra int")
    lists = spark.createDataFrame([(1, [(r, t, "x") for r, t in talk], 0)], "conv_id long, messages array<struct<role:string,content:string,name:string>>, extra int")
    single = spark.createDataFrame([(1, talk[0][1], "", talk[1][1], {"k": "v"})], "conv_id long, instruction string, input string, output string, meta map<string,string>")
    assert [C.layout_of(t.schema).name for t in (by_turn, lists, single)] == ["turn_rows", "messages", "instruction"]
    made = [C.formatted_turn_rows(t).collect() for t in (by_turn, lists, single)]
    assert made[0] == made[1] == made[2] and len(made[0]) == 1


def test_sql_of_layouts(spark, sf_dir):
    from compare import differ, duck

    assert differ(registry.QUERIES["chat_layouts"](spark, sf_dir), duck(sf_dir), registry.ORACLES["chat_layouts"]) == ""


def test_sql_of_chats(spark, sf_dir):
    from compare import differ, duck

    assert differ(registry.QUERIES["op8_chat_formatting"](spark, sf_dir), duck(sf_dir), registry.ORACLES["op8_chat_formatting"]) == ""


def test_registered_over_all_rows(spark, sf_dir):
    assert sorted(int(m[1]) for n in registry.QUERIES if (m := re.match(r"op(\d+)_", n))) == list(range(1, 14))
    got = registry.QUERIES["op8_chat_formatting"](spark, sf_dir)
    assert got.where("conv_id = -1").first().loss_chars == len("<|im_end|><|im_start|>assistant ok")


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before, ids = docs, []
    for name, stage in P.STAGES[:-1]:
        after = spark.createDataFrame(stage(spark, before, sf_dir).collect(), docs.schema)
        assert after.columns == docs.columns, name
        ids.append(collections.Counter(r.doc_id for r in after.collect()))
        before = after
    good = {r.doc_id for r in registry.QUERIES["op10_quality_classifier"](spark, sf_dir).where("predicted = 1").collect()}
    assert set(ids[0]) == good
    groups = N.near_duplicate_groups(docs.where(F.col("doc_id").isin(*good))).collect()
    assert set(ids[1]) == {r.component_id for r in groups}
    assert ids[2] == ids[1] and set(ids[3]) <= set(ids[2]) and len(ids[3]) > 0
    placed = P.run(spark, sf_dir).collect()
    assert {r.doc_id for r in placed} == set(ids[3])
    assert sum(r.piece == 0 for r in placed) == len(ids[3]) and P.ORACLE_SQL is None


def test_pipeline_over_odd_rows(spark, sf_dir, odd, tmp_path):
    """Nulls, empty and very long texts, ties and repeated rows among the documents; every stage by its contents."""
    import zlib

    import corpus_pipeline as P
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    both = docs.unionByName(odd.selectExpr("doc_id + 100000 as doc_id", "text", "lang", "source", "n_chars"))
    both.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    before, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for _, stage in P.STAGES[:-1]:
        rows = [tuple(r) for r in stage(spark, before, str(tmp_path)).select(docs.columns).collect()]
        kept.append(collections.Counter(rows))
        before = spark.createDataFrame(rows, docs.schema).repartition(3)
    good, unique, masked, mixed = kept
    assert good <= collections.Counter(tuple(r) for r in both.select(docs.columns).collect())
    # one row of each component of fingerprints, of the smallest id (null last)
    prints = collections.defaultdict(list)
    for r in good:
        prints[N.simhash(r[1] or "") & (2**64 - 1)].append(r)
    left, groups = set(prints), []
    while left:
        group, todo = set(), [left.pop()]
        while todo:
            a = todo.pop()
            group.add(a)
            near = {b for b in left if (a ^ b).bit_count() <= 3}
            left -= near
            todo += near
        groups.append([r for fp in group for r in prints[fp]])
    assert len(groups) == sum(unique.values()) == len(unique)
    for group in groups:
        own = [r for r in group if r in unique]
        assert len(own) == 1 and (own[0][0] is None, own[0][0] or 0) == min((r[0] is None, r[0] or 0) for r in group)
    # masking changes texts and their lengths alone, and those of secrets only
    assert sorted((str(r[0]), str(r[2:4])) for r in masked) == sorted((str(r[0]), str(r[2:4])) for r in unique)
    secret = re.compile(r"AKIA[A-Z0-9]{14,}|[0-9a-f]{16,}")
    assert not any(secret.search(r[1] or "") for r in masked)
    assert {r for r in unique if r[1] is None or not re.search(r"[0-9a-f]{16}|AKIA|[:=]|PRIVATE|eyJ|gh[a-z]_|xox|glpat", r[1])} <= set(masked)
    assert mixed <= masked and sum(mixed.values()) > 0
    tokenizer, want = Tokenizer.from_file(registry.public_vocabulary("word_bpe_49k.json")), collections.Counter()
    for r, n in mixed.items():
        ids = tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 4096):
            cut = b"".join(i.to_bytes(4, "little") for i in ids[k : k + 4096])
            want[r[0], k // 4096, k, len(cut) // 4, zlib.crc32(cut)] += n
    got = P.run(spark, str(tmp_path)).select("doc_id", "piece", "start", "length", "ids_crc32").collect()
    assert collections.Counter(map(tuple, got)) == want


@pytest.mark.parametrize("name", ["op1_token_counts", "op3_best_fit_packing", "op4_quality_rules", "op5_media_columns", "op6_near_duplicates", "op7_html_extraction", "op9_source_mixing"])
def test_registered_queries_have_a_row_for_every_row(spark, sf_dir, name):
    made = registry.QUERIES[name](spark, sf_dir).collect()
    of, key = ("pages", "page_id") if name.startswith("op7") else ("documents", "doc_id")
    want = collections.Counter(r[key] for r in spark.read.parquet(f"{sf_dir}/{of}.parquet").select(key).collect())
    seen = collections.Counter(r[key] for r in made if name != "op3_best_fit_packing" or r.piece == 0)
    assert seen == want
