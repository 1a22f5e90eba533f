"""Articles without article or main, split over unequal siblings."""

import pytest

from rowmill.llm.html_extract import extract, main_text

INTRO = "An introduction of some length that stands before the rest of the text. " * 3
MORE = "The rest of the text, which is longer by far than what comes before it. " * 9
LINKS = "<ul>" + "".join(f"<li><a href='/{k}'>Another page of this site, number {k}</a></li>" for k in range(9)) + "</ul>"


@pytest.mark.parametrize("split", [
    "<div class=post><p>{}</p><div class=more>{}</div></div>",
    "<div class=post><div>{}</div><div class=more><div>{}</div></div></div>",
    "<div class=lead>{}</div><div class=a><div class=b>{}</div></div>"])
def test_both_parts_are_kept(split):
    page = f"<body>{split.format(INTRO, MORE)}</body>"
    assert extract(page, None) == f"{INTRO.strip()}\n{MORE.strip()}"


def test_links_and_short_lines_are_left_behind():
    page = f"<body><div class=top>Date: today</div><div class=list>{LINKS}</div><div class=post>{{}}<p>{MORE}</p></div></body>"
    assert extract(page.format(f"<p>{INTRO}</p>"), None) == f"{INTRO.strip()}\n{MORE.strip()}"


def test_article_and_main_end_the_walk():
    for tag in ("article", "main"):
        page = f"<body><div class=top>{INTRO}</div><div class=wrap><{tag}><p>{MORE}</p></{tag}></div></body>"
        assert extract(page, None) == MORE.strip()


def test_split_articles_of_a_host(spark):
    page = f"<body><div class=post><p>{INTRO}</p><div class=more>{MORE}</div></div></body>"
    pages = spark.createDataFrame([(k, "http://h.example/", page) for k in range(4)], "page_id long, url string, html string")
    assert {r.main_text for r in main_text(pages).collect()} == {f"{INTRO.strip()}\n{MORE.strip()}"}
