"""Pages as the training grammar does not make them, and broken markup."""

import time

import pytest

from shardwright.llm import html_blocks, html_crf

SF = "/root/testdata/sf0.01"
TITLE = "Bridge plans approved"
A = "The committee met on Tuesday to discuss the new bridge across the river, which has been planned for many years."
B = "Engineers said that the work would start in spring, as soon as the ground has dried and the money is there."
C = "Local people were asked for their opinion, and most of them were glad about the news."
PARTS = [f"{A} {B}", f"{B} {C}", f"{C} {A}"]
P, D = ("".join(f"<{t}>{x}</{t}>" for x in PARTS) for t in ("p", "div"))
NAV = "<ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li><li><a href=/c>Contact</a></li></ul>"
FOOT = "© 2024 Example Press. All rights reserved."
REMARK = "<div class=comment><p>Anna</p><p>I have waited for this bridge for a long time and am glad.</p></div>"
LAYOUTS = {
    "divs without names": f"<div id=a><div>{NAV}</div><div><h1>{TITLE}</h1>{D}</div><footer>{FOOT}</footer></div>",
    "no wrapper": f"<h1>{TITLE}</h1>{P}",
    "table": f"<table><tr><td>{NAV}</td><td><h1>{TITLE}</h1>{P}</td></tr></table>",
    "old table": f"<center><table><tr><td><h1>{TITLE}</h1>{P}<hr></td></tr></table></center><div class=footer>{FOOT}</div>",
    "story": f"<nav>{NAV}</nav><div class=story><h1>{TITLE}</h1>{P}</div><aside><p>Read also: other news of the week</p></aside>",
    "cms": f"<body class='home page-template single logged-in'><div id=page class='site hfeed'><div class=site-branding>Example Press</div><div id=content>"
           f"<div class=entry-content><h1>{TITLE}</h1>{P}</div></div><div class=widget-area><h3>Recent posts</h3>{NAV}</div><div class=site-footer>{FOOT}</div></div>",
    "comments": f"<article><h1>{TITLE}</h1>{P}</article><div id=comments><h3>2 comments</h3>{REMARK}</div>",
    "cookie": f"<div class=cookie-banner><p>We use cookies to improve this site. <button>Accept</button></p></div><main><h1>{TITLE}</h1>{P}</main>",
    "ids": f"<div id=header><h2>Example Press</h2></div><div id=leftcol>{NAV}</div><div id=maincol><h1>{TITLE}</h1>{P}</div><div id=footer><p>{FOOT}</p></div>",
    "deep": f"<div><div><div><div><h1>{TITLE}</h1>{D}</div></div></div></div>",
}
# the heading of these has no sign of its own and may be lost; the paragraphs stay, and nothing else does
UNMARKED = {
    "all divs": f"<div id=w1><div id=w2><div>{TITLE}</div>{D}</div></div>",
    "section": f"<header>{NAV}</header><section><h2>{TITLE}</h2>{P}</section><footer><p>{FOOT}</p></footer>",
}


@pytest.fixture(scope="module")
def model(spark):
    return html_crf.fit(spark.read.parquet(f"{SF}/documents.parquet"))


def test_foreign_layouts(spark, model):
    names = [*LAYOUTS, *UNMARKED]
    rows = [(k, "u", f"<html><head><title>x</title></head>{ {**LAYOUTS, **UNMARKED}[n]}</html>") for k, n in enumerate(names)]
    got = {names[r.page_id]: r.text.split("\n") for r in html_crf.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string"), model).collect()}
    assert {n: got[n] for n in LAYOUTS} == {n: [TITLE, *PARTS] for n in LAYOUTS}
    assert all([x for x in got[n] if x != TITLE] == PARTS for n in UNMARKED)


@pytest.mark.parametrize("page,want", [
    ('<p title="oops>text</p>', ["text"]),
    ("<p title='a>b' class=\"c>d\">text</p>", ["text"]),
    ('<p don"t>one</p><p it\'s>two</p>', ["one", "two"]),
    ("a < b <i and > c <p>1 <2</p>", ["a < b c", "1 <2"]),
    ("<p>one</p><p class", ["one"]),
    ("x <y and more <p>z", ["x z"]),
    ("<p>one</p></div></p><div>two", ["one", "two"]),
])
def test_broken_markup(page, want):
    assert [b.text for b in html_blocks.blocks(page)] == want


@pytest.mark.parametrize("page", ["<div>" * 100_000 + "x", "<div>t" * 20_000, '<a "' * 50_000, '<a ="' * 50_000, "<a " * 50_000 + '=" >"', "<" * 50_000, "<li>a" * 30_000,
                                  "<div>" * 20_000 + "</p>" * 20_000, "<!--" * 50_000, "<script>" * 20_000, "<title>" * 20_000, "<svg>" * 20_000, "<" + "x<" * 50_000])
def test_time_is_linear(page):
    start = time.process_time()
    html_crf.page_features(html_blocks.blocks(page))
    html_blocks.declared_language(page)
    assert time.process_time() - start < 5   # quadratic steps take minutes
