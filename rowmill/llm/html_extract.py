"""Main text of web pages by consensus paths per host.

1. Every page is parsed once for votes. Its containers (body, main, article,
   section, div, table cells, ...) are scored by the characters of their clean
   text, links counted against them; from the body the walk goes down while one
   child holds at least ``SHARE`` of the score and no running text is left behind
   (or a main or article element inside it holds the share), and stops at an
   article, or at a main element without one. The generalised path of the place it ends at (tags with classes,
   digits as N) gets the score as its vote.
2. Votes are summed per host and path in Spark (partial sums first), and each
   host's best path wins.
3. Pages are parsed again and the text is taken from the elements of the winning
   path; a page without such an element uses its own best container.

Left out everywhere: scripts, styles and other elements without prose, hidden
elements, nav, header, footer, aside, form and dialog elements, and blocks whose
class, id or role has one of the words in ``NOISE`` (not 'with-sidebar',
'no-sidebar', 'ad-free' or 'related-work'). Headings and inline elements are kept
whatever their names, but for inline adverts. An article inside an article, or
with a remark's name, is a reader's comment. A form or a noisy block around the
article is a wrapper and left out itself only (``wrappers``). White space in a
block becomes one space, blocks are joined by a newline, nothing is capped.

Defined results: null html or html without text gives the empty text; a null
url belongs to the host ''; repeated rows vote as often as they occur; ties go
to the path first in order; empty table, empty result; other columns are
carried untouched whatever their names.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from rowmill.llm.common import ship_package, written

SHARE = 0.7
BROADCAST_BYTES = 32 << 20       # winners are broadcast up to this size, joined by shuffle beyond

# Elements by what they do to the text.
RAW = "script style noscript template textarea title".split()                # read to their end, or the page's
EMBEDDED = "svg math iframe object select canvas video audio".split()        # skipped if they are closed
FOREIGN = "svg math".split()                                                 # may be closed in their own tag
SILENT = {"nav", "header", "footer", "aside", "form", "dialog", "menu", "head", "button", "fieldset"}
CONTAINERS = {"body", "main", "article", "section", "div", "td", "center"}
BLOCKS = CONTAINERS | SILENT | set(
    "html p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr th caption blockquote pre figure figcaption "
    "address hr details summary".split())
NAMED = CONTAINERS | {"ul", "ol", "dl", "table"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
NOISE = set(
    "nav navbar navigation menu menubar header masthead footer sidebar aside ad ads advert adverts advertisement "
    "advertising banner sponsor sponsored promo promotion cookie cookies consent notice notices alert popup modal overlay "
    "comment comments reply replies disqus respond share sharing social related recommended breadcrumb breadcrumbs "
    "pagination pager newsletter subscribe signup login search widget toolbar complementary contentinfo "
    "gdpr paywall skip copyright disclaimer".split())

REMARKS = set("comment comments reply replies disqus respond".split())
ADS = set("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion".split())
# After a noise word: 'related-posts' is noise, 'related-work' is not.
PARTS = set(
    "area articles author avatar bar block body bottom box button buttons card cell closed col column container content "
    "count counter entry field foot footer form frame group head holder icon icons inner input item items label layout left "
    "line link links list main meta module msg message new node open outer page pages panel parent placeholder policy pop "
    "popup post posts rail region results right row section separator settings slot stories story strip table tab tabs text "
    "thread title toggle top tree unit view wrap wrapper zone".split())

WITHOUT, FREE = set("with without no non not has hide".split()), {"free", "less"}    # before and after a word that is no noise
WRAP = {"form", "fieldset"}      # silent unless around the article
PROSE = 40                       # unlinked characters from which a block counts as running text

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?:" + "|".join(FOREIGN) + r")\b(?:[^>\"'/]++|/(?!>)|\"[^\"]*+\"|'[^']*+')*+/>"
    r"|<(?P<raw>" + "|".join(RAW) + r")\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<skip>" + "|".join(EMBEDDED) + r")\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?</(?P=skip)\s*>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs2>[^>]*)>"
    r"|<[!?/][^>]*>", re.S | re.I)
ATTR = re.compile(r"([^\s=\"'/>][^\s=/>]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?|[\"']")
UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)
PIECES = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")
SPACE = re.compile(r"\s+")


@dataclass
class Node:
    """A container of a page."""

    tag: str
    path: str
    parent: int
    own: float = 0.0
    total: float = 0.0
    prose: float = 0.0
    marked: float = 0.0                  # the largest total of a main or article element in it
    children: list[int] = field(default_factory=list)


@dataclass
class Soft:
    """A form or noisy block: silent unless it is around the article."""

    parent: int
    noise: int
    main: bool = False
    article: bool = False
    heading: bool = False
    weight: float = 0.0
    wraps: bool = False


def _noise(name: str, among: set[str] = NOISE) -> int:
    """2 if a class or id name says noise, 1 if it has such a word before a part of a page ('sidebar-layout'), 0 without."""
    words = [w for w in PIECES.split(name) if w and not w.isdigit()]
    level = 0
    for k, w in enumerate(words):
        if w in among and not (k and words[k - 1] in WITHOUT) and not (k + 1 < len(words) and words[k + 1] in FREE):
            last = k + 1 == len(words)
            level = max(level, 2 if last else int(words[k + 1] in PARTS | NOISE or w in REMARKS))
    return level


@dataclass
class Attributes:
    """What the attributes of a tag say: generalised classes, how far class, role or
    id mark noise, and remarks or adverts above all, and whether it is shown."""

    classes: str = ""
    noise: int = 0
    remark: int = 0
    advert: int = 0
    hidden: bool = False


PLAIN = Attributes()


def attributes(tag: str, text: str) -> Attributes:
    """Attributes in order by name, the first of a name counts. Ids mark noise on
    ``NAMED`` elements alone (those of headings and others are made from their
    text), on sections only as remarks."""
    values: dict[str, str] = {}
    for m in ATTR.finditer(text):
        if m[1]:
            values.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    out = Attributes(hidden="hidden" in values or bool(UNSEEN.search(entities.unescape(values.get("style", "")))))
    for key in ("class", "role", "id"):
        value = entities.unescape(values.get(key, ""))
        if key == "class":
            out.classes = ".".join(sorted(re.sub(r"\d+", "N", value.lower()).split()))
        if not value or key == "id" and tag not in NAMED:
            continue
        for name in re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower().split():
            out.remark = max(out.remark, _noise(name, REMARKS))
            if key != "id" or tag != "section":
                out.noise, out.advert = max(out.noise, _noise(name)), max(out.advert, _noise(name, ADS))
    out.noise = max(out.noise, out.remark)
    return out


def wrappers(softs: list[Soft], blocks: list[tuple[int, str, int, int]]) -> None:
    """Marks the forms and noisy blocks that are around the article.

    A main element inside makes one; so does an article of its own, in a form or
    with most of the page's unlinked text; so does most of the text in a form, or
    in a noisy block if no running text is outside and no name plainly says noise
    or it holds the page's h1."""
    weigh = [max(len(line) - 2 * linked, 0) for _, line, linked, _ in blocks]
    if any(w >= PROSE for w in weigh):
        weigh = [w if w >= PROSE else 0 for w in weigh]
    total = sum(weigh)
    for w, (_, _, _, k) in zip(weigh, blocks, strict=True):
        while k >= 0:
            softs[k].weight += w
            k = softs[k].parent
    direct = [0] * (len(softs) + 1)                                # the last is the text outside of all
    for w, b in zip(weigh, blocks, strict=True):
        direct[b[3]] += w
    seen = direct[-1]
    for k, s in enumerate(softs):
        if s.parent >= 0 and not softs[s.parent].wraps:
            continue
        most = 2 * s.weight > total
        s.wraps = s.main or (s.article and (most or not s.noise)) or (most and not s.noise) or (
            most and not seen and (s.noise == 1 or s.heading))
        if s.wraps:
            seen += direct[k]


def parse(page: str) -> tuple[list[Node], list[tuple[int, str, int]]]:
    """Containers, and text blocks as (container, text, characters in links)."""
    nodes = [Node("html", "html", -1)]
    blocks: list[tuple[int, str, int, int]] = []
    softs: list[Soft] = []
    stack: list[tuple[str, int, bool, int]] = [("html", 0, False, -1)]     # open block elements: tag, container, silent, soft
    text: list[str] = []
    link, linked, inline_noise = 0, 0, []

    def close_block() -> None:
        nonlocal linked
        if text:
            line = SPACE.sub(" ", entities.unescape("".join(text))).strip()
            if line:
                blocks.append((stack[-1][1], line, min(linked, len(line)), stack[-1][3]))
            text.clear()
        linked = 0

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at and not stack[-1][2] and not inline_noise:
            piece = page[at:m.start()]
            text.append(piece)
            linked += len(piece) * bool(link)
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if not tag:
            continue
        tag = tag.lower()
        ends = bool(m["end"] or m["end2"])
        if tag not in BLOCKS:
            if tag == "br":
                text.append(" ")
            elif tag == "a":
                link = 0 if ends else 1
            if tag not in VOID:
                if ends:
                    if inline_noise and inline_noise[-1] == tag:
                        inline_noise.pop()
                elif inline_noise:
                    if tag == inline_noise[-1]:
                        inline_noise.append(tag)
                else:
                    attrs = m["attrs"] or m["attrs2"] or ""
                    if attrs:
                        said = attributes(tag, attrs)
                        if said.hidden or said.advert:
                            inline_noise.append(tag)
            continue
        close_block()
        inline_noise.clear()
        link = 0
        if ends:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
                if stack[k][0] in CONTAINERS | SILENT and tag not in CONTAINERS | SILENT:
                    break                                          # a stray end tag leaves outer elements open
            continue
        if tag in VOID:
            continue
        if stack[-1][0] in ("p", "h1", "h2", "h3", "h4", "h5", "h6") or tag == stack[-1][0] and tag in ("li", "dt", "dd", "tr", "td", "th"):
            stack.pop()                                            # its end tag is implied
        _, inside, silent, soft = stack[-1]
        if tag == "body":
            inside, silent, soft = 0, False, -1
        attrs = m["attrs"] or m["attrs2"] or ""
        said = attributes(tag, attrs) if attrs else PLAIN
        noisy = 0 if tag in HEADINGS else said.noise
        if tag == "article":                                       # an article in an article is a remark on it
            noisy = max(said.remark, int(any(x[0] == "article" for x in stack)))
        silent = silent or tag in SILENT - WRAP or (said.hidden and tag not in ("html", "body"))
        if not silent:
            if tag in ("main", "article", "h1"):
                k = soft
                while k >= 0:
                    softs[k].main |= tag == "main"
                    softs[k].article |= tag == "article" and not noisy
                    softs[k].heading |= tag == "h1"
                    k = softs[k].parent
            if tag in WRAP or (noisy and tag not in ("body", "main", "html")):
                softs.append(Soft(soft, noisy))
                soft = len(softs) - 1
        if tag in CONTAINERS and not silent:
            nodes.append(Node(tag, f"{nodes[inside].path}/{tag}" + (f".{said.classes}" if said.classes else ""), inside))
            nodes[inside].children.append(len(nodes) - 1)
            inside = len(nodes) - 1
        stack.append((tag, inside, silent, soft))
    if at < len(page) and not stack[-1][2] and not inline_noise:
        text.append(page[at:])
    close_block()
    if softs:
        wrappers(softs, blocks)
    return nodes, [(c, line, linked) for c, line, linked, k in blocks if k < 0 or softs[k].wraps]


def best_container(nodes: list[Node], blocks: list[tuple[int, str, int]]) -> int:
    """Where the walk from the root ends."""
    for c, line, linked in blocks:
        w = max(len(line) - 2 * linked, 0)
        nodes[c].own += w
        nodes[c].prose += w if w >= PROSE else 0
    for k in range(len(nodes) - 1, -1, -1):
        n = nodes[k]
        n.total += n.own
        if n.tag in ("main", "article"):
            n.marked = n.total
        if n.parent >= 0:
            up = nodes[n.parent]
            up.total += n.total
            up.prose += n.prose
            up.marked = max(up.marked, n.marked)
    at = 0
    while nodes[at].tag != "article":
        best = max(nodes[at].children, key=lambda c: nodes[c].total, default=None)
        if best is None or nodes[best].total < SHARE * nodes[at].total or not nodes[best].total:
            break
        if nodes[at].tag == "main" and nodes[best].tag != "article":
            break
        if nodes[best].prose < nodes[at].prose and nodes[best].marked < SHARE * nodes[at].total:
            break
        at = best
    return at


def extract(page: str | None, path: str | None) -> str:
    """Text of the elements of ``path``, or of the page's own best container."""
    nodes, blocks = parse(page or "")
    if not blocks:
        return ""
    roots = {k for k, n in enumerate(nodes) if n.path == path}
    if not any(_within(nodes, c, roots) for c, _, _ in blocks):
        roots = {best_container(nodes, blocks)}
    inside = {c: _within(nodes, c, roots) for c in {b[0] for b in blocks}}
    return "\n".join(line for c, line, _ in blocks if inside[c])


def _within(nodes: list[Node], k: int, roots: set[int]) -> bool:
    while k >= 0:
        if k in roots:
            return True
        k = nodes[k].parent
    return False


def _votes(batches):
    for batch in batches:
        found = {}
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html"), strict=True):
            nodes, blocks = parse(page.as_py() or "")
            if blocks:
                k = best_container(nodes, blocks)
                key = host, nodes[k].path
                found[key] = found.get(key, 0.0) + nodes[k].total
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()),
             pa.array(list(found.values()), pa.float64())], names=["host", "path", "score"])


def _extract(batches):
    for batch in batches:
        out = [extract(page.as_py(), path) for page, path in
               zip(batch.column("html"), batch.column("path").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.string())], names=["row", "main_text"])


def host_of(url: str):
    """Lower-cased host of a url column, '' for null or other strings."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def main_text(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(row, main_text)``; ``row`` has every input column but the html."""
    spark = pages.sparkSession
    ship_package(spark)
    others = [F.col(f"`{c}`") for c in pages.columns if c != html_col]
    p = pages.select(host_of(url_col).alias("host"), F.col(html_col).cast("string").alias("html"),
                     F.struct(*others).alias("row"))
    votes = p.select("host", "html").mapInArrow(_votes, "host string, path string, score double")
    winners = written(votes.groupBy("host", "path").agg(F.sum("score").alias("score"))
                      .groupBy("host").agg(F.min_by("path", F.struct(-F.col("score"), "path")).alias("path")),
                      "host-paths")
    size = winners.agg(F.sum(F.octet_length("host") + F.octet_length("path") + 64)).first()[0] or 0
    small = size <= BROADCAST_BYTES
    joined = p.join(F.broadcast(winners) if small else winners, "host", "left")
    return joined.select("row", "html", "path").mapInArrow(
        _extract, StructType([p.schema["row"], StructField("main_text", StringType())]))
