"""Articles inside a form or a block whose class only mentions a noise word."""

import pytest

from rowmill.llm.html_extract import extract

PARAS = [f"Paragraph {k} of the article says something that is long enough to be read." for k in range(4)]
BODY = "".join(f"<p>{p}</p>" for p in PARAS)
TEXT = "\n".join(PARAS)
SIDE = "<nav><a href=/>Home</a></nav><div class='sidebar'><p>Other posts that you may like to read some day soon</p></div>"


@pytest.mark.parametrize("inner", [f"<article>{BODY}</article>", f"<div class='text'>{BODY}</div>", BODY])
@pytest.mark.parametrize("wrap", ["<form id=aspnetForm>{}</form>", "<div class='content with-sidebar'>{}</div>",
                                  "<div id='layout no-sidebar'>{}</div>", "<div class='ad-free'>{}</div>",
                                  "<div class='sidebar-layout'>{}</div>", "<form><div class='menuPage'>{}</div></form>"])
def test_wrappers_keep_the_article(wrap, inner):
    assert extract(f"<body>{wrap.format(inner + SIDE)}</body>", None) == TEXT


def test_plain_noise_around_an_article_or_main():
    assert extract(f"<body><div class='page sidebar'><article>{BODY}</article>{SIDE}</div></body>", None) == TEXT
    assert extract(f"<body><div class='page sidebar'><main>{BODY}</main>{SIDE}</div></body>", None) == TEXT


def test_noise_stays_out():
    talk = "".join(f"<article class='comment'><p>A comment, number {k}, that is longer than the article.</p></article>" for k in range(30))
    for block in (f"<div class='post-comments'>{talk}</div>", f"<div id='comment-list'>{talk}</div>",
                  f"<section class='related'><article>{PARAS[0]}</article></section>",
                  "<form class='search'>Search this site <button>Go</button></form>"):
        assert extract(f"<body><div class='text'>{BODY}</div>{block}</body>", None) == TEXT
        assert extract(f"<body><form id=f><div class='text'>{BODY}</div>{block}</form></body>", None) == TEXT
    cookie = "<div class='cookie-banner'><p>We use cookies on this site to make it better for you.</p></div>"
    assert extract(f"<body>{cookie}</body>", None) == ""
