"""What is article text and what is not, and the given pages against html.parser."""

import re
from html.parser import HTMLParser

import pytest

from rowmill.llm.html_extract import extract, main_text

PARAS = [f"Paragraph {k} of the article says something that is long enough to be read." for k in range(4)]
BODY = "".join(f"<p>{p}</p>" for p in PARAS)
TEXT = "\n".join(PARAS)
TALK = "<p>A reader's remark on the article that is long enough to be taken for a part of it.</p>"


@pytest.mark.parametrize("talk", [
    f"<article class='comment'>{TALK}</article>", f"<article>{TALK}</article>", f"<article id=reply-7>{TALK}</article>",
    f"<section id=comments>{TALK}</section>", f"<div class=\"comment-list\">{TALK}</div>", f"<div id=disqus_thread>{TALK}</div>"])
def test_remarks_go(talk):
    assert extract(f"<body><article>{BODY}{talk * 9}</article></body>", None) == TEXT
    main = f"<body><main><article>{BODY}</article>{talk}</main></body>"
    if talk != f"<article>{TALK}</article>":                       # beside the article it is a second article
        assert extract(main, None) == TEXT


@pytest.mark.parametrize("inside,text", [
    ("<h2 id='search'>Search</h2>", "Search"), ("<h2 id='related-work'>Related work</h2>", "Related work"),
    ("<h3 class='header'>A heading</h3>", "A heading"), ("<p><b id='footer-1'>Bold</b> words</p>", "Bold words"),
    ("<section class='related-work'><p>Others wrote of this before us.</p></section>", "Others wrote of this before us."),
    ("<section id='search'><p>How the search is done.</p></section>", "How the search is done."),
    ("<pre><code>x = 1 <span class=\"comment\"># one</span></code></pre>", "x = 1 # one"),
    ("<p data-id=\"share\">A paragraph with data.</p>", "A paragraph with data."),
    ("<div data-role='nav' title='class=\"ad\"'>Still the article.</div>", "Still the article."),
    ("<p>See <a href=\"/x?id=share&class=ad\">this page</a> for more.</p>", "See this page for more."),
    ("<p>One <svg width='9' viewBox='0 0 1/2 3'/>two</p>", "One two"), ("<p>One <svg><path d='M'/><text>no</text></svg>two</p>", "One two"),
    ("<p>One <svg><p>two</p>", "One\ntwo"), ("<p>One <select><p>two</p>", "One\ntwo")])
def test_article_text_stays(inside, text):
    assert extract(f"<body><article>{BODY}{inside}</article></body>", None) == f"{TEXT}\n{text}"


@pytest.mark.parametrize("inside", [
    "<div hidden>Not shown to anyone who reads the page</div>", "<p style='color:red; display: none'>Not shown</p>",
    "<div style=\"visibility:hidden\"><p>Not shown</p></div>", "<span hidden>not</span>", "<a class='ad' href=/>Buy this</a>",
    "<ins class=\"adsbygoogle ad-slot\">Buy that</ins>", "<p class='notice'>Terms apply</p>", "<ul id=share-links><li>Send it</ul>",
    "<div class='related-posts'><p>Another post that you may like to read some day soon</p></div>",
    "<div role='search'>Find</div>", "<script>var x='</p>'</script>", "<textarea>typed"])
def test_other_things_go(inside):
    assert extract(f"<body><article>{BODY}{inside}</article></body>", None) == TEXT


def test_article_in_a_bare_article():
    assert extract(f"<body><article class=page><article class=post><h1>Title</h1>{BODY}</article></article></body>", None) == f"Title\n{TEXT}"


class Plain(HTMLParser):
    """Text of the article elements, by the standard library's parser."""

    BREAKS = {"p", "h1", "h2", "h3", "div", "ul", "ol", "li", "blockquote", "section", "table", "tr", "td", "article", "pre"}
    GONE = {"nav", "header", "footer", "aside", "form", "script", "style"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.gone, self.blocks = 0, [], [""]

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.depth += 1
        if tag in self.GONE or (tag in self.BREAKS and re.search(r"\b(ad|comments?|cookie|notice|share|sidebar|related)\b",
                                                                dict(attrs).get("class") or "")):
            self.gone.append(tag)
        elif self.gone and tag == self.gone[-1]:
            self.gone.append(tag)
        if tag in self.BREAKS:
            self.blocks.append("")
        elif tag == "br":
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        if self.gone and tag == self.gone[-1]:
            self.gone.pop()
        if tag == "article":
            self.depth -= 1
        if tag in self.BREAKS:
            self.blocks.append("")

    def handle_data(self, data):
        if self.depth and not self.gone:
            self.blocks[-1] += data

    def text(self):
        return "\n".join(x for x in (re.sub(r"\s+", " ", b).strip() for b in self.blocks) if x)


def test_given_pages_against_the_standard_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {}
    for r in pages.collect():
        p = Plain()
        p.feed(r.html or "")
        p.close()
        want[r.page_id] = p.text()
    got = {r.row.page_id: r.main_text for r in main_text(pages).collect()}
    assert got == want


def test_odd_columns(spark):
    rows = [(k, "http://a.example/", f"<article>{BODY}</article>", 1, 2, "x") for k in range(3)] + [(None, None, None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, `content-type` int, `my col` int, host string")
    got = main_text(pages.repartition(2)).collect()
    assert {r.row["page_id"]: r.main_text for r in got} == {None: "", 0: TEXT, 1: TEXT, 2: TEXT}
    assert got[0].row.asDict().keys() == {"page_id", "url", "content-type", "my col", "host"}
