"""Style tree, both searches and quotation linking against brute force and on odd rows."""

import math
import random
import re
from html import unescape

import numpy as np
from pyspark.sql import functions as F

from timberflow.llm import bit_sliced, permutation_index, quotation, site_style_tree
from timberflow.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.01"


def article_text(page):
    inside = page[page.index("<article>") + 9 : page.index("</article>")]
    blocks = (" ".join(unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:h1|p)>", inside))
    return "\n".join(b for b in blocks if b)


def test_pages_give_their_articles(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    rows = QUERIES["op4_html_extraction"](spark, SMALL).collect()
    assert len(rows) == len(pages)
    for r in rows:
        page = pages[r.page_id]
        assert r.url == page.url and r.n_chars == len(r.text)
        if page.html and page.html.count("<article>") == 1:
            assert r.text == article_text(page.html)


def test_odd_pages(spark):
    rows = [
        (1, "http://a.org/1", None),
        (2, None, ""),
        (3, "nonsense", "a &lt; b &amp;&amp; c"),
        (4, "http://a.org/2", "<p>unclosed <b>x<p>next"),
        (5, "http://a.org/3", "<script>if (a<b) {</script><p>q</p></div></p>"),
        (6, "http://a.org/4", "<div>" * 3000 + "deep" + "</div>" * 3000),
        (None, None, "<p>" + "long " * 50_000 + "</p>"),
        (4, "http://a.org/2", "<p>unclosed <b>x<p>next"),
    ]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, removed string")
    got = sorted((str(r.page_id), r.text) for r in site_style_tree.main_text(pages).collect())
    long = " ".join(["long"] * 50_000)
    assert got == sorted([("1", ""), ("2", ""), ("3", "a < b && c"), *[("4", "unclosed x\nnext")] * 2, ("5", "q"), ("6", "deep"), ("None", long)])
    assert site_style_tree.main_text(pages.limit(0)).count() == 0


def test_tree_removes_what_all_pages_share(spark):
    rng = random.Random(1)
    page = "<body><div class='top'>Welcome to the site</div><div class='text'><p>{}</p></div><div class='end'>Made by us</div></body>"
    own = [" ".join(rng.choice("oak elm ash fir yew".split()) for _ in range(12)) + f" {k}" for k in range(30)]
    rows = [(k, f"https://x.org/{k}", page.format(t)) for k, t in enumerate(own)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in site_style_tree.main_text(frame).collect()} == dict(enumerate(own))
    importance = [r.importance for r in site_style_tree.style_tree(frame).collect()]
    assert min(importance) < 0.01 and max(importance) > 0.99


def vectors(spark, rng, n=300, size=16):
    rows = [(k, [float(x) for x in rng.normal(size=size)], "clash") for k in range(n)]
    rows += [(n, rows[0][1], "copy"), (n + 1, rows[20][1], "copy"), (1000, None, None), (1020, [], None)]
    rows += [(1040, [math.nan] * size, None), (1060, [math.inf] * size, None), (1080, [None, *[1.0] * (size - 1)], None), (None, [1.0] * size, None)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")


def usable(rows):
    return {r[0]: r[1] for r in rows if r[0] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1])}


def test_bit_sliced_equals_brute_force(spark):
    rows, frame = vectors(spark, np.random.default_rng(4))
    known = {k: [math.floor(256 * x) for x in v] for k, v in usable(rows).items()}
    expected = []
    for q in (k for k in known if k % 50 == 0):
        best = sorted((-sum(a * b for a, b in zip(known[q], v)), k) for k, v in known.items() if k != q)[:5]
        expected += [(q, rank, k, -s) for rank, (s, k) in enumerate(best, 1)]
    for block in (8192, 64):
        got = bit_sliced.search(frame, every=50, k=5, row_block=block).collect()
        assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == sorted(expected)
    assert bit_sliced.search(frame.limit(0)).count() == 0


def test_permutation_index_recall_and_scores(spark):
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    known = {k: np.array(v, float) for k, v in usable([tuple(r) for r in table.select("vec_id", F.col("embedding").cast("array<double>")).collect()]).items() if np.any(v)}
    got = {}
    for r in QUERIES["op7_permutation_index"](spark, SMALL).collect():
        assert abs(r.score - float((known[r.query_id] * known[r.vec_id]).sum())) < 1e-9 and r.vec_id != r.query_id
        got.setdefault(r.query_id, {})[r.vec_id] = r.rank
    hits = total = 0
    for q in (k for k in known if k % 20 == 0):
        best = sorted((-float((known[q] * v).sum()), k) for k, v in known.items() if k != q)[:20]
        assert sorted(got[q].values()) == list(range(1, len(best) + 1))
        hits, total = hits + sum(k in got[q] for _, k in best), total + len(best)
    assert hits / total >= 0.9


def test_permutation_index_odd_rows(spark):
    rows, frame = vectors(spark, np.random.default_rng(6), n=60)
    known = usable(rows)
    got = permutation_index.search(frame, every=20, k=100).collect()
    assert {r.query_id for r in got} == {k for k in known if k % 20 == 0}
    assert all(r.vec_id in known for r in got)
    assert len(got) == len({r.query_id for r in got}) * (len(known) - 1)
    assert permutation_index.search(frame.limit(0)).count() == 0


def brute_links(rows):
    """{(conv, turn): (quoted or previous turn)} by plain loops over (conv, turn, text)."""
    up = {}
    for conv, turn, text in rows:
        own = quotation.passages(text)
        earlier = sorted({t for c, t, _ in rows if c == conv and t < turn})
        votes = {}
        for level, passage in own:
            sayers = [t for c, t, x in rows if c == conv and (0, passage) in quotation.passages(x)]
            if level > 0 and sayers and min(sayers) < turn:
                votes[(level, min(sayers))] = votes.get((level, min(sayers)), 0) + len(passage)
        best = max(votes, key=lambda v: (-v[0], votes[v], v[1]), default=None)
        up[(conv, turn)] = best[1] if best else (earlier[-1] if earlier else None)
    return up


def test_links_equal_brute_force(spark):
    rng = random.Random(9)
    rows = []
    for conv in range(12):
        said = []
        for turn in range(rng.randint(1, 14)):
            lines = []
            if said and rng.random() < 0.6:
                old = rng.choice(said)
                lines += ["Ann wrote:", *("> " + x for x in old.split("\n"))]
                if rng.random() < 0.4:
                    lines += [">> " + x for x in rng.choice(said).split("\n")]
            own = "\n".join(f"Say {rng.randint(0, 40)} of {rng.choice('abc')}. And so on." for _ in range(rng.randint(1, 3)))
            said.append(own)
            rows.append((conv, turn * (1 if conv % 2 else 5000), "user", "\n".join([*lines, own])))
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = quotation.link(frame).collect()
    up = brute_links([(c, t, x) for c, t, _, x in rows])
    assert {(r.conv_id, r.turn): r.reply_to for r in got} == up
    heirs = {}
    for (conv, turn), to in sorted(up.items()):
        heirs.setdefault((conv, to), turn)
    for r in got:
        head, place = r.turn, 0
        while up[(r.conv_id, head)] is not None and heirs[(r.conv_id, up[(r.conv_id, head)])] == head:
            head, place = up[(r.conv_id, head)], place + 1
        assert (r.thread, r.place) == (head, place)
        assert ">" not in r.body and "wrote:" not in r.body
    whole = quotation.chats(quotation.link(frame), messages=3).collect()
    assert sum(r.chat.count("<|end|>") for r in whole) == len(rows) and all(r.chat.count("<|end|>") <= 3 for r in whole)


def test_quotes_wrapped_anew_and_odd_messages(spark):
    rows = [
        (1, None, "system", "Be kind."),
        (1, 0, "user", "How tall is an oak? I ask for a friend."),
        (1, 1, "assistant", "About thirty metres. It grows slowly, though."),
        (1, 2, "user", "Bot wrote:\n> > How tall is an\n> > oak?\n> About thirty\n> metres.\n\nThanks."),
        (1, 3, "user", "> How tall is an oak?\nI would know as well."),
        (1, 4, "user", None),
        (1, 5, None, "> nobody said this"),
        (None, 0, "user", ""),
        (None, 0, "user", ""),
        (2, 0, "user", "> " * 5000 + "deep\n" + "word " * 50_000),
    ]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, thread string")
    got = {(r.conv_id, r.turn): r for r in quotation.link(frame).collect()}
    assert len(quotation.link(frame).collect()) == len(rows)
    assert [got[(1, t)].reply_to for t in (0, 1, 2, 3, 4, 5)] == [None, 0, 1, 0, 3, 4]
    assert got[(1, 2)].body == "Thanks." and got[(1, 4)].body is None and got[(1, 5)].body == ""
    assert (got[(1, 3)].thread, got[(1, 3)].place) == (3, 0) and got[(1, 5)].place == 2
    assert quotation.link(frame.limit(0)).count() == 0


def test_conversations_keep_every_message(spark):
    table = spark.read.parquet(f"{SMALL}/conversations.parquet")
    rows = QUERIES["op9_quotation_linking"](spark, SMALL).collect()
    assert sorted((r.conv_id, r.turn, r.role, r.body) for r in rows) == sorted((r.conv_id, r.turn, r.role, quotation.own_text(r.text)) for r in table.collect())


def test_self_closing_drawings_and_formulas_keep_the_page():
    page = '<article><p>a</p><svg/><p>b <svg class="x" /> c</p><svg><text>drawn</text></svg><p>d <math><mi>x</mi></math></p><math/><p>e</p></article>'
    assert site_style_tree.extract(page) == "a\nb c\nd x\ne"
