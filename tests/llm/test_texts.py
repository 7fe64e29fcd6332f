import hashlib
import html.parser
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetrail.llm import ann, chat, html_text, license_scan, mixing, quality, queries
from kinetrail.llm.common import table

from . import helpers as H

# --- HTML -------------------------------------------------------------------
PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice"><p>We use cookies, many of them, and ask you.</p></div>
<aside class="sidebar"><p>Sidebar text, long enough to matter, with commas, indeed.</p></aside>
<main><article><h1>Head &amp; line</h1><p>First   para, with
a break and <b>bold</b> text.<p>Second &lt;para&gt;, unclosed.<ul><li>one</li><li>two</li></ul><form><input name="x"><button>Go</button></form></article></main>
<section id="comments"><p>Reader comment, very long, with, many, commas, in, it, to tempt the scorer away.</p></section>
<footer>&copy; 2020</footer><script>var a = "</p>";</script></body></html>"""


def test_article_alone():
    assert html_text.main_text(PAGE) == "Head & line\nFirst para, with a break and bold text.\nSecond <para>, unclosed.\none\ntwo"


def test_broken_pages():
    assert html_text.main_text(None) == "" == html_text.main_text("") == html_text.main_text("<html><body></body></html>")
    assert html_text.main_text("<article><p>Cut off in the mid") == "Cut off in the mid"
    assert html_text.main_text("<p>one</b></div><p>two &amp; three <") .startswith("one\ntwo & three")
    assert html_text.main_text("<article>" + "<div>" * 5000 + "deep, text" + "</div>" * 5000 + "</article>") == "deep, text"


def test_link_lists_lose():
    links = "".join(f'<p><a href="#">Link text number {i}, with, commas, and, length</a></p>' for i in range(30))
    page = f"<body><div>{links}</div><div><p>A real paragraph, of some length, with commas and no links at all in it.</p></div></body>"
    assert "real paragraph" in html_text.main_text(page) and "Link text" not in html_text.main_text(page)


def test_parts_of_a_long_article_stay():
    for n in (1, 8, 40):
        text = [f"Paragraph {i}, of some length, " + "word " * 54 + "end." for i in range(n)]
        body = "".join(f"<p>{p}</p>" for p in text)
        rest = "<ul><li>one</li><li>two</li></ul><table><tr><td>cell</td></tr></table><figure><figcaption>caption</figcaption></figure><p>Short.</p><section><p>Last.</p></section>"
        want = "\n".join(["Title", *text, "one", "two", "cell", "caption", "Short.", "Last."])
        links = '<div><a href="/">One more page</a> <a href="/">and one more</a></div>' if n > 8 else ""
        assert html_text.main_text(f"<body><article><h1>Title</h1><div class='entry-content'>{body}</div>{rest}{links}</article></body>") == want
        assert html_text.main_text(f"<body><div><h1>Title</h1><div class='entry-content'>{body}</div>{rest}</div></body>") == want


def test_a_name_does_not_drop_most_of_the_page():
    text = "A paragraph, of some length, with commas and no links in it at all."
    page = f"<body><div class='sidebar'><p>Aside.</p></div><div class='with-sidebar'><h1>Title</h1><p>{text}</p></div></body>"
    assert html_text.main_text(page) == f"Title\n{text}"
    thread = f"<div id='comments'><p>{text * 9}</p></div>"
    assert html_text.main_text(f"<body><article><p>{text}</p></article>{thread}</body>") == text
    assert html_text.main_text(f"<body><div class='post'><p>{text}</p></div>{thread}</body>") == text


def test_a_state_is_no_name():
    text = "A paragraph, of some length, with commas and no links in it at all."
    for name in ("layout has-sidebar", "site no-comments", "content header-fixed", "without_menu"):
        inner = f"<p>{text}</p>"
        assert html_text.main_text(f"<body><div class='{name}'>{inner}</div></body>") == text
        # another part named as content, as small as it may be
        assert html_text.main_text(f"<body><div class='{name}'><div class='post'>{inner * 3}</div></div><div class='content'><p>x</p></div></body>").startswith(text)


def test_a_form_around_the_page():
    text = "A paragraph, of some length, with commas and no links in it at all."
    assert html_text.main_text(f"<body><form id='page'><nav><a href='/'>Home</a></nav><p>{text}</p><button>Go</button></form></body>") == text
    assert html_text.main_text(f"<body><article><p>Short.</p></article><form><p>{text * 9}</p></form></body>") == "Short."
    assert html_text.main_text("<body><form>Name <input name='n'> Password <input name='p'></form></body>") == ""


def test_deep_pages_in_linear_time():
    began = time.time()
    for page in ("<div>" * 100_000 + "deep, text" + "</div>" * 100_000, "<div>" * 100_000 + "</b>" * 100_000 + "deep, text",
                 "<span>" * 50_000 + "<h1></h1>" * 50_000 + "deep, text", "<i><p>" * 50_000 + "deep, text"):
        assert html_text.main_text(page) == "deep, text"
    assert time.time() - began < 30


WORDS = "Long words of this chapter, which any reader would miss, and some more of them to fill a line."


@pytest.mark.parametrize(
    "part",
    [
        "<h2 id='search'>{}</h2>", "<h2 id='related-work'>{}</h2>", "<section id='related-work'><p>{}</p></section>",
        "<section id='side-effects'><p>{}</p></section>", "<p id='share-price'>{}</p>", "<div class='social-history'><p>{}</p></div>",
        "<pre class='language-nav menu'>{}</pre>", "<p>{} <code class='login shell'>sh</code> ends.</p>", "<section id='search'><p>{}</p></section>",
    ],
)
def test_html_names_of_chapters(part):
    shown = re.sub(r"<[^>]*>", "", part).format(WORDS)
    for page in (f"<body><article><p>{WORDS * 2}</p>{part.format(WORDS)}<p>The end.</p></article></body>", f"<body><main><p>{WORDS}</p>{part.format(WORDS)}</main></body>"):
        assert shown in html_text.main_text(page)
    if "<section" not in part and "<div" not in part:
        assert shown in html_text.main_text(f"<body><div><p>{WORDS * 2}</p>{part.format(WORDS)}<p>The end.</p></div></body>")


@pytest.mark.parametrize(
    "part",
    [
        "<div class='related-posts'><a href='/x'>{}</a></div>", "<div class='ad-slot'>{}</div>", "<section id='comments'><p>{}</p></section>",
        "<div class='share-buttons'><a href='/x'>{}</a></div>", "<div class='newsletter box'><p>{}</p></div>", "<ul class='social'><li><a href='/x'>{}</a></li></ul>",
    ],
)
def test_html_boilerplate_in_an_article(part):
    assert html_text.main_text(f"<body><article><p>{WORDS * 3}</p>{part.format('Away with this, please.')}</article></body>") == WORDS * 3


def test_html_what_is_no_raw_text():
    for tag in ("select", "svg"):
        assert html_text.main_text(f"<body><article><{tag}><option>x<p>{WORDS}</article>") == WORDS
    assert html_text.main_text(f"<body><article><object>fallback</object><p>{WORDS}</p></article>") == WORDS
    assert html_text.main_text(f"<article><p>{WORDS}</p><template><p>x</p></template></article>") == WORDS
    assert html_text.main_text("<article><p>super<wbr>cali</p></article>") == "supercali"
    assert html_text.main_text("<article><p>a\u2003b\x85c\u2009\xa0d</p></article>") == "a b c d"
    assert html_text.main_text(f"<article><p>{WORDS}</p><!-- never ended <p>x</p> y") == WORDS
    assert html_text.main_text(f"<article><p>{WORDS}</p><script>if (a > b) never ended") == WORDS
    assert html_text.main_text(f"<article><p>{WORDS} 1 < 2 <a href='x") == WORDS + " 1 < 2"


def test_html_many_starts_take_linear_time():
    def took(n):
        began = time.perf_counter()
        html_text.main_text("<article><p>x</p>" + "<script " * n)
        return time.perf_counter() - began

    assert took(64_000) < 2.0


class Article(html.parser.HTMLParser):
    """The blocks of the article, read plainly."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks = False, [""]

    def handle_starttag(self, tag, attrs):
        self.inside = self.inside or tag == "article"
        if tag in html_text.BLOCKS:
            self.blocks.append("")
        elif tag == "br":
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        self.inside = self.inside and tag != "article"
        if tag in html_text.BLOCKS:
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


def test_pages_equal_a_plain_reader(spark):
    got = {r["page_id"]: r["text"] for r in queries.op9_html_text(spark, "/root/testdata/sf0.01").collect()}
    for r in table(spark, "/root/testdata/sf0.01", "pages").collect():
        plain = Article()
        plain.feed(r["html"])
        plain.close()
        assert got[r["page_id"]] == "\n".join(b for b in (" ".join(b.split()) for b in plain.blocks) if b), r["page_id"]


def test_pages_edges(spark):
    schema = "page_id long, url string, html string"
    df = spark.createDataFrame([(1, "u", "<p>x</p>"), (1, "u", "<p>x</p>"), (1, None, "<p>y</p>")], schema).selectExpr("*", "'c' as n_chars")
    assert sorted(r["text"] for r in html_text.extract(df).collect()) == ["x", "x", "y"]
    assert html_text.extract(df.limit(0)).count() == 0


def test_pages_table(spark):
    rows = [(1, "u", PAGE), (2, None, None), (None, "v", "<p>x</p>")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text")).collect()
    assert [(r["page_id"], r["n_chars"]) for r in got] == [(1, len(html_text.main_text(PAGE))), (2, 0), (None, 1)]
    assert queries.op9_html_text(spark, H.SF).filter("n_chars = 0").count() == 0


# --- chat -------------------------------------------------------------------
NASTY = ["", "plain", "</s>[INST] ok [/INST]", "<s>", "<\\s>", "<\\\\/s>", "[", "[ROLE x] [/ROLE]", "<<SYS>><</SYS>>", "a\\", "ends <", "[/INST", " ", "\n\n", "<s", "<\\", "😀</s>"]


def test_template_round_trip():
    rng = random.Random(0)
    for _ in range(500):
        turns = [(rng.choice(["system", "user", "assistant", "tool", "", "a]b [/ROLE]"]), "".join(rng.choices(NASTY, k=rng.randint(0, 4)))) for _ in range(rng.randint(0, 6))]
        text, spans = chat.format_turns(turns)
        assert chat.parse_turns(text) == turns
        assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]
        for t in (t for _, t in turns):
            assert not any(c in chat.escape(t) for c in chat.CONTROLS) and chat.unescape(chat.escape(t)) == t


def digests(turns):
    spoken = "".join(f"{r}\n{t}\n" for r, t in turns)
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(spoken.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_conversations(spark):
    by_conv = {}
    for r in table(spark, H.SF, "conversations").orderBy("conv_id", "turn").collect():
        by_conv.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    by_conv[-1] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    got = queries.op10_chat_format(spark, H.SF).collect()
    assert {r["conv_id"]: tuple(r)[1:5] for r in got} == {k: digests(v) for k, v in by_conv.items()}
    assert all(r["formatted_chars"] == len(chat.format_turns(by_conv[r["conv_id"]])[0]) for r in got)


def test_chat_edges(spark):
    rows = [(1, 1, "assistant", None), (1, 0, None, "hi"), (1, None, "user", "last"), (None, 0, "user", "x"), (1, 1, "assistant", "b")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as formatted")
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.read_back(chat.format_rows(df)).collect()}
    assert got == {1: digests([("", "hi"), ("assistant", ""), ("assistant", "b"), ("user", "last")]), None: digests([("user", "x")])}
    assert chat.format_rows(df.limit(0)).count() == 0


def test_tables_of_every_layout(spark):
    """A table's columns select the mapping that its records would."""
    tables = {
        "conv_id long, messages array<struct<role string, content string>>, x int": [(1, [("user", "q"), (None, None), None], 0)],
        "conv_id long, system string, messages array<struct<role string, content string>>": [(1, "s", [("user", "q")])],
        "conv_id long, conversations array<struct<`from` string, value string>>": [(1, [("human", "h"), ("gpt", "g"), ("tool", "t")])],
        "conv_id long, turns array<struct<speaker string, text string>>": [(1, [("bot", "b")])],
        "conv_id long, prompt string, response string, formatted int": [(1, "p", None, 3)],
        "conv_id long, prompt string, completion string": [(1, "p", "c")],
        "conv_id long, system string, prompt string, response string": [(1, None, "p", "r")],
        "conv_id long, instruction string, output string": [(1, "i", "o")],
        "conv_id long, instruction string, input string, output string": [(1, "i", "in", "o"), (2, "i", "", "o"), (3, "i", None, "o")],
        "conv_id long, question string, answer string": [(1, "q", "a")],
    }
    seen = set()
    for schema, data in tables.items():
        df = spark.createDataFrame(data, schema)
        seen.add(chat.mapping_of(df.schema).paths)
        got = {r["conv_id"]: chat.parse_turns(r["formatted"]) for r in chat.format_rows(df).collect()}
        assert got == {r["conv_id"]: chat.record_turns({k: v for k, v in r.asDict(True).items() if k != "conv_id"}) for r in df.collect()}, schema
    assert seen == {m.paths for m in chat.MAPPINGS[1:]}
    assert chat.format_rows(spark.createDataFrame([(1, None)], "conv_id long, messages array<struct<role string, content string>>")).count() == 0
    with pytest.raises(ValueError, match="no mapping"):
        chat.format_rows(spark.createDataFrame([(1, 2)], "conv_id long, odd int"))


def test_layouts(spark):
    records = ['{"prompt": "p", "response": "r"}', '{"instruction": "i", "input": "in", "output": "o"}', '{"messages": [{"role": "user", "content": "q"}], "id": 7}',
               '{"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}]}', '{"odd": 1}', None, "no json"]
    df = spark.createDataFrame([(str(i), r) for i, r in enumerate(records)], "id string, record string")
    got = {r["id"]: r["formatted"] and chat.parse_turns(r["formatted"]) for r in chat.format_records(df).collect()}
    assert got == {"0": [("user", "p"), ("assistant", "r")], "1": [("user", "i\nin"), ("assistant", "o")], "2": [("user", "q")], "3": [("user", "h"), ("assistant", "g")], "4": None, "5": None, "6": None}


# --- neighbours ---------------------------------------------------------------
def recall(rows, got, every):
    """The share of the true neighbours that were found; ranks and scores must hold."""
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], dtype=float)
    by_query, hit, total = {}, 0, 0
    for r in got:
        by_query.setdefault(r["query_id"], []).append(r)
    asked = ids[ids % every == 0]
    assert set(by_query) == set(asked)
    for q in asked:
        d = np.sqrt(((x - x[ids == q]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        want = ids[np.lexsort((ids, d))[:10]]
        mine = sorted(by_query[q], key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 11))
        assert [(r["score"], r["vec_id"]) for r in mine] == sorted((r["score"], r["vec_id"]) for r in mine)
        assert all(abs(d[ids == r["vec_id"]][0] - r["score"]) < 1e-12 for r in mine)
        hit, total = hit + len({r["vec_id"] for r in mine} & set(want)), total + 10
    return hit / total


@pytest.mark.parametrize("sf", ["0.001", "0.01", "0.1"])
def test_recall_and_scores(spark, sf):
    folder = f"/root/testdata/sf{sf}"
    assert recall(table(spark, folder, "embeddings").collect(), queries.op2_nearest_neighbours(spark, folder).collect(), 100) >= 0.9


def test_recall_with_lists_split_again(spark, monkeypatch):
    monkeypatch.setattr(ann, "MOST_CENTROIDS", 16)
    monkeypatch.setattr(ann, "LIST_ROWS", 20)
    monkeypatch.setattr(ann, "BLOCK_ROWS", 8)
    monkeypatch.setattr(ann, "BROADCAST_ROWS", 0)
    rows = table(spark, "/root/testdata/sf0.1", "embeddings")
    assert recall(rows.collect(), ann.search(rows).collect(), 100) >= 0.9


def test_very_large_and_small_components(spark):
    rows = [(0, [1e300, 0.0]), (1, [-1e300, 1e300]), (2, [1e300, 1e300]), (3, [1e-200, 0.0]), (4, [1e-200, 3e-200]), (100, [0.0, 1e-200]), (5, [1.5e308, -1.5e308])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in ann.search(df).collect()}
    assert len(got) == 12 and got[0, 2] == 1e300 and got[0, 1] == pytest.approx(5**0.5 * 1e300)
    assert got[100, 3] == pytest.approx(2**0.5 * 1e-200) and got[100, 4] == pytest.approx(5**0.5 * 1e-200)
    assert got[0, 5] == pytest.approx(2.0518e308, rel=1e-3) or got[0, 5] == float("inf")


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0, None]), (7, [1.0]), (None, [1.0, 1.0]), (100, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as list", "2 as score")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 6)) for r in ann.search(df).collect())
    assert got == [(0, 1, 1, 0.0), (0, 2, 100, 1.414214), (100, 1, 0, 1.414214), (100, 2, 1, 1.414214)]
    assert ann.search(df.limit(0)).count() == 0


# --- licenses -----------------------------------------------------------------
def best_fit(template, words):
    """Most template words matched in order, without a band."""
    row = [0] * (len(words) + 1)
    for t in template:
        new = [0]
        for j, w in enumerate(words, 1):
            new.append(max(new[-1], row[j], row[j - 1] + 1 if t == w else 0))
        row = new
    return row[-1]


def test_alignment_equals_full_table():
    rng = random.Random(5)
    for _ in range(60):
        template = [rng.randrange(30) for _ in range(25)]
        words = [w for w in template if rng.random() > 0.1]
        for _ in range(3):
            words.insert(rng.randrange(len(words)), 99)
        got, first, last = license_scan.align(template, words, 0, 12)
        assert got == best_fit(template, words) and best_fit(template, words[first:last]) == got


def test_scan(spark):
    mit, own = license_scan.TEMPLATES["mit-text"], "Licensed under CC BY-NC 4.0."
    texts = ["abc. " + own + "\nmore", mit.replace("without restriction", "with some restriction"), None, "", "nothing here", own + " x y z " * 50 + own]
    got = license_scan.scan(H.documents(spark, texts)).collect()
    assert [(r["doc_id"], r["license"]) for r in got] == [(0, "cc-by-nc-4.0"), (1, "mit-text"), (5, "cc-by-nc-4.0"), (5, "cc-by-nc-4.0")]
    assert texts[0][got[0]["start"] : got[0]["end"]] == "Licensed under CC BY-NC 4.0" and got[0]["coverage"] == 1
    assert 0.9 < got[1]["coverage"] < 1


def test_adjacent_notices_are_rows_each():
    index = license_scan.Index(license_scan.TEMPLATES)
    for name, line in license_scan.TEMPLATES.items():
        for n in (1, 2, 5, 9):
            text = " ".join([line] * n)
            got = license_scan.scan_text(text, index)
            assert [r[0] for r in got] == [name] * n and all(r[3] == 1 for r in got), (name, n)
            assert all(a[5] <= b[4] for a, b in zip(got, got[1:], strict=False))
    near = license_scan.scan_text("Released under the MIT. Released under the MIT License.", index)
    assert [(r[0], r[2]) for r in near] == [("mit", 4), ("mit", 5)]


def test_spans_are_those_of_the_original():
    index = license_scan.Index(license_scan.TEMPLATES)
    text = "x İ y İİ All rights reserved. İ Released under the MIT License."
    assert [text[r[4] : r[5]] for r in license_scan.scan_text(text, index)] == ["All rights reserved", "Released under the MIT License"]


def test_many_notices_in_a_text():
    index = license_scan.Index(license_scan.TEMPLATES)
    began = time.time()
    assert len(license_scan.scan_text("All rights reserved. foo bar. " * 20_000, index)) == 20_000
    assert time.time() - began < 20


def test_scan_edges(spark):
    same = {"a": "one two three four", "b": "one two three four"}
    df = H.documents(spark, ["x one two three four y"] * 2).selectExpr("*", "'c' as license", "1 as start")
    got = license_scan.scan(df.withColumn("doc_id", F.lit(7)), same).collect()
    assert [(r["doc_id"], r["license"], r["start"]) for r in got] == [(7, "a", 2)] * 2  # a tie goes to the first name
    assert license_scan.scan(df.limit(0)).count() == 0


def test_longer_licenses_win(spark):
    for name in ("bsd-2-clause", "bsd-3-clause", "gpl-3.0-header", "agpl-3.0-header", "lgpl-2.1-header", "mpl-2.0-header", "unlicense"):
        got = license_scan.scan_text("Copyright. " + license_scan.TEMPLATES[name] + " End.", license_scan.Index(license_scan.TEMPLATES))
        assert [r[0] for r in got] == [name] and got[0][3] == 1


def test_scan_finds_every_notice(spark):
    lines = {k: license_scan.TEMPLATES[k] for k in ("mit", "cc-by-nc-4.0", "gpl-3.0", "apache-2.0", "all-rights-reserved")}
    docs = table(spark, H.SF, "documents").collect()
    want = sorted((r["doc_id"], k) for r in docs for k, line in lines.items() for _ in range(r["text"].count(line)))
    got = queries.op4_license_scan(spark, H.SF).filter("coverage = 1").collect()
    assert sorted((r["doc_id"], r["license"]) for r in got) == want and want


# --- quality ------------------------------------------------------------------
def test_quality_on_labels_that_were_not_fitted(spark):
    labels = table(spark, "/root/testdata/sf0.01", "labels")
    held = {r["doc_id"]: r["quality"] == 1 for r in labels.filter(quality.held_out()).collect()}
    assert 0.15 < len(held) / labels.count() < 0.35
    got = {r["doc_id"]: r for r in queries.op5_quality(spark, "/root/testdata/sf0.01").collect()}
    right = lambda view: sum((got[d][view] >= 0.5) == t for d, t in held.items()) / len(held)
    both = right("score")
    assert both > 0.97 and both >= max(right("p_content"), right("p_metadata")) - 0.01
    assert min(right("p_content"), right("p_metadata")) > 0.8
    assert sum(got[d]["kept"] for d, t in held.items() if t) / sum(held.values()) > 0.98


def test_quality_edges(spark):
    docs = H.documents(spark, H.edge_texts())
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.classify(docs, none).filter("kept").count() == docs.count()
    one = spark.createDataFrame([(0, 0, 0), (1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.classify(docs, one).count() == docs.count()
    assert quality.classify(docs.limit(0), none).count() == 0


# --- mixing -------------------------------------------------------------------
def targets(sizes):
    """Resharing as it is told: cap, hand the rest out by weight, again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, done = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in done]
        level = (total - sum(done.values())) / max(1, sum(weight[s] for s in free))
        over = [s for s in free if weight[s] * level > 2 * sizes[s]]
        if not over:
            return done | {s: weight[s] * level for s in free}
        done |= {s: 2.0 * sizes[s] for s in over}


def test_mix(spark):
    got = queries.op7_mix(spark, H.SF).collect()
    docs = {r["doc_id"]: r for r in table(spark, H.SF, "documents").collect()}
    assert {r["doc_id"]: r["size"] for r in got} == {i: len(H.WORD.findall(d["text"])) for i, d in docs.items()}
    assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in got)
    sizes, taken, target = {}, {}, {}
    for r in got:
        s = docs[r["doc_id"]]["source"]
        sizes[s], taken[s], target[s] = sizes.get(s, 0) + r["size"], taken.get(s, 0) + r["taken"], r["target"]
    assert target == pytest.approx(targets(sizes))
    assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] + 3 for s in sizes)
    assert sorted(got) == sorted(queries.op7_mix(spark, H.SF).collect())


def test_mix_edges(spark):
    texts = [None, "", "a b", "c", "d e f", "g h i j", "k", "l m"]
    sources = ["b", "b", None, None, "a", "a", "c", "é"]
    df = H.documents(spark, texts, sources)
    got = mixing.mix(df).collect()
    sizes = {s: sum(len(H.WORD.findall(t or "")) for t, o in zip(texts, sources, strict=True) if o == s) for s in set(sources)}
    want = targets(sizes)
    assert {r["doc_id"]: r["target"] for r in got} == pytest.approx({i: want[s] for i, s in enumerate(sources)})
    assert mixing.mix(df.limit(0)).count() == 0


def test_words_are_counted_in_linear_time(spark):
    texts = ["a \x85", "a \u2028", "\u2029 b\n", "a" + " " * 1_000_000 + "b", " " * 1_000_000, "\x1c \xa0\x0b", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string").persist()
    df.count()
    began = time.time()
    assert [r[0] for r in df.select(mixing.word_count(F.col("t"))).collect()] == [len(H.WORD.findall(t)) for t in texts] == [2, 2, 2, 2, 0, 2, 0]
    assert time.time() - began < 5


def test_turns_are_the_same_in_ranges(spark, monkeypatch):
    rows = [(s, b, p, (7 * b + p) % 11) for s in ("a", "b", None) for b in range(40) for p in (0, 1)]
    blocks = spark.createDataFrame(rows, "source string, block long, pass int, words long")
    whole = sorted(map(str, mixing.in_turns(blocks, 40, 5).collect()))
    monkeypatch.setattr(mixing, "TURNS_PER_TASK", 3)
    parts = mixing.in_turns(blocks, 40, 5).collect()
    assert sorted(map(str, parts)) == whole
    for s in ("a", "b", None):
        own = sorted((r for r in parts if r["source"] == s), key=lambda r: r["turn"])
        assert [r["turn"] for r in own] == list(range(1, 81)) and [r["pass"] for r in own] == [0] * 40 + [1] * 40
        assert all(b["before"] == a["before"] + a["words"] for a, b in zip(own, own[1:], strict=False)) and own[0]["before"] == 0


def test_sources_of_another_type(spark):
    df = spark.createDataFrame([(i, "a b", i % 2) for i in range(8)], "doc_id long, text string, source int")
    assert mixing.mix(df).count() == 8 and mixing.mixed_documents(df).schema["source"].dataType.simpleString() == "int"


def test_splitting_tree_is_exact():
    counts = np.array([500, 0, 37, 1200, 3])
    parts = [mixing.split_counts(counts, s, 7, 1) for s in range(7)]
    assert (sum(parts) == counts).all()
    assert all(abs(p.sum() - counts.sum() / 7) <= 1 for p in parts)


def test_mixed_documents_follow_the_plan(spark):
    docs = table(spark, H.SF, "documents")
    want = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix(docs).collect() if r["size"]}
    out = mixing.mixed_documents(docs)
    got = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert out.columns == docs.columns and got == {d: n for d, n in want.items() if n}


def repeated(spark, tmp_path):
    """Repeated rows and rows without an id in small sources; a scan and no scan."""
    texts = [("w " * (i % 7 + 1)).strip() for i in range(60)]
    rows = [(None if i % 3 else i // 9, t, "en", "ab"[i % 2], len(t)) for i, t in enumerate(texts)] * 2
    df = spark.createDataFrame(rows, H.SCHEMA)
    df.write.parquet(str(tmp_path / "docs"))
    return [df, spark.read.parquet(str(tmp_path / "docs"))]


def test_mix_and_documents_agree_on_repeated_and_null_ids(spark, tmp_path):
    for docs in repeated(spark, tmp_path):
        words, rows = {}, {}
        for r in mixing.mix(docs).collect():
            words[r["doc_id"]] = words.get(r["doc_id"], 0) + r["taken"]
        for r in mixing.mixed_documents(docs).collect():
            rows[r["doc_id"]] = rows.get(r["doc_id"], 0) + len(r["text"].split())
        assert rows == {d: n for d, n in words.items() if n}


def test_the_tree_decides_what_is_taken(spark, monkeypatch):
    monkeypatch.setattr(mixing, "shard_plan", lambda blocks, seed: shard_plan(blocks, seed).filter("shard < 0"))
    assert mixing.mix(table(spark, H.SF, "documents")).filter("taken > 0").count() == 0


shard_plan = mixing.shard_plan
