"""Main text of pages: what is told by rules, and the article of every page of the test tables by another way."""

import html
import re

import pytest

from querysieve.llm import queries
from querysieve.llm.htmltext import blocks, extract, main_text

PROSE = "The man of the house was in the garden with the dog, and it was for that a very long day in the sun of the year."
MORE = "It was the best of times, it was the worst of times, it was the age of wisdom, it was the age of foolishness."


@pytest.mark.parametrize(
    "page, want",
    [
        ("", ""),
        ("no tags", "no tags"),
        (f"<article><h1>A &amp; B</h1><p>{PROSE}</p><p>Short.</p></article><div>{MORE}</div>", ["A & B", PROSE, "Short."]),
        (f"<nav><ul><li><a href=/>Home</a></ul></nav><p>{PROSE}<p>Short  one\n here.</p><div class='cookie-notice'>{MORE}</div><footer>{MORE}</footer>", [PROSE, "Short one here."]),
        (f"<h2>Title</h2><p>{PROSE}</p><ul><li><a href=a>Other stories of the day</a></ul><p>Copyright 2020 The House</p>", ["Title", PROSE]),
        (f"<article><p>{PROSE}<section id=comments><h3>Comments</h3><article class=comment><p>{MORE}</p></article></section></article>", [PROSE]),
        (f"<article><p>{PROSE}</p><h3>Reader comments</h3><p>{MORE}</p></article>", [PROSE]),
        (f"<form id=all><div><div class=menu><a href=x>Home</a></div><article><p>{PROSE}</p></article></div></form>", [PROSE]),
        (f"<nav><a href=a>x</a><main><p>{PROSE}<p>Left open.</main>", [PROSE, "Left open."]),
        (f"<script>var t='</p>{MORE}';</script><style>p{{}}</style><p>{PROSE}</p><!-- {MORE} --><aside>{MORE}</aside>", [PROSE]),
        (f"<p title='a > b'>{PROSE}</p><p hidden>{MORE}</p><p style='display: none'>{MORE}</p>", [PROSE]),
        (f"<p>{PROSE}</p><script>{MORE}", [PROSE]),
        (f"<p>{PROSE} 1 < 2<br>and<b>so&nbsp;on</b> <a href='cut", [f"{PROSE} 1 < 2 andso on"]),
        ("<p>" + "字" * 210 + "</p><p>短</p><nav>x</nav>", ["字" * 210, "短"]),
    ],
)
def test_rules(page, want):
    assert main_text(page) == (want if isinstance(want, str) else "\n\n".join(want))


def test_open_blocks_take_the_nearest_label():
    page = f"<div class=menu><p>{MORE}</p></div><div><p>First.</p><p>{PROSE}</p><p>Last.</p></div><div class=ad>Buy it.</div>"
    assert main_text(page) == f"First.\n\n{PROSE}\n\nLast."


def test_links_left_open_end_with_their_container():
    got = list(blocks("<div><a href=x>linked</div><p>not linked</p>"))
    assert [b.linked for b in got] == [1.0, 0.0]


@pytest.mark.parametrize("odd", ["<", "<a ", "<b>", "<li><b>", "<p title=\"x", "<!--", "<div></p>", "<script>", "&amp", "</div>", "<h1>x<article>"])
def test_malformed_pages_take_linear_time(odd):
    main_text(odd * 20_000)


def test_every_article_of_the_tables(spark, sf_dir):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = queries.QUERIES["op12_blockrules"](spark, sf_dir).collect()
    assert len(got) == len(pages)
    for r in got:
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        pieces = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", x))).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n\n".join(p for p in pieces if p) and r.n_chars == len(r.text)


def test_odd_rows(spark):
    long = f"<p>{PROSE}</p>" * 5_000
    rows = [(1, "u", None, "x"), (None, None, "", "x"), (1, "u", None, "x"), (2, "v", long, None)]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [(0, 0), (1, 0), (1, 0), (2, 5_000 * (len(PROSE) + 2) - 2)]
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
