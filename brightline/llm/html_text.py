"""HTML extraction: flat text blocks classified by a decision tree.

A page is read once into text blocks, each with its number of words, its link density (share of words within links) and those
of its neighbours, and with what encloses it. A decision tree, fitted with Spark ML on a small labelled table, tells
main text from boilerplate. Names of classes only mark what may be outside: a mark that lies round an article, or round most
of the page's words, says nothing. Pages are independent: there is no shuffle, and a page is whole in one task.

Defined results. A null or empty page has empty text, as has one whose blocks are all boilerplate. A page that is cut off is read
to its end; a tag without an end is text. Rows that repeat a page are rows of the result each. Other columns pass by unread.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightline.llm.trees import Tree, parsed, votes

# Element names by what they mean for text.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style noscript template iframe svg canvas object textarea title math noframes xmp".split())
OUTSIDE_TAGS = frozenset("nav aside footer form menu dialog button select fieldset head noscript".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What the words of class, id and role say of an element that is not part of the article.
OUTSIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising aside banner breadcrumb breadcrumbs byline comment comments complementary consent contentinfo "
    "cookie cookies copyright disqus footer form gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notification "
    "overlay pager pagination popup promo promotion related reply replies respond search share sharing sidebar signup skip social sponsor sponsored "
    "subscribe subscription tags toolbar widget".split()
)
#: Words that leave open whether the element is one of those or lies round the article: they count unless the page's text is in it.
OPEN_WORDS = frozenset("form header notice promo promotion related search share sharing social tags widget".split())
#: A name that begins so tells what a page has, and one that ends so that something lies round more.
HAVING, ROUND = frozenset("has have no not with without hide show is".split()), frozenset("body container inner layout outer page root site wrap wrapper".split())
ARTICLE_WORDS = frozenset("article content entry main page post story".split())
#: Share of a page's words, links and what is surely outside apart, from which an open mark lies round the article.
MOST_OF_PAGE = 0.6
_NOTICE = re.compile(r"\xa9|\(c\)|copyright|rights reserved|cookies?\b|privacy policy|terms of (?:use|service)|subscribe|newsletter|sign (?:in|up)|log ?in\b|advert|sponsored|share this|follow us", re.I)
NOTICE_WORDS = 40

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "outside", "beside", "inside", "notice")
LABELLED_PAGES = 600


def labelled_page(r: random.Random) -> str:
    """A page of one of many layouts; the texts of main text begin with m, those of boilerplate with b."""
    text = lambda kind, low, high: " ".join([kind] + ["w"] * (r.randint(low, high) - 1))
    link = lambda t: f'<a href="#">{t}</a>'
    menu = lambda n: "<ul>" + "".join(f"<li>{link(text('b', 1, 4))}</li>" for _ in range(n)) + "</ul>"
    marked = r.random() < 0.5
    top = menu(r.randint(2, 8))
    top = f"<nav>{top}</nav>" if marked else f"<div>{top}</div>"
    aside = lambda: r.choice(('<div class="ad">', '<section class="comments">', '<div id="cookie-banner">', "<aside>")) + text("b", 1, r.choice((6, 20, 120))) + "<br>"
    if r.random() < 0.6:
        top += f"<div>{aside()}</div>"
    if r.random() < 0.5:  # an advert or notice in the open, among links
        top += f"<div>{text('b', 3, 14)}{' &copy;' if r.random() < 0.4 else ''}</div>{menu(r.randint(1, 3))}"
    before, after = r.choice((("<article>", "</article>"), ("<main>", "</main>"), ("<div>", "</div>"), ('<div class="content has-sidebar">', "</div>"), ('<form id="aspnetForm">', "</form>"), ('<div id="page-wrapper"><section>', "</section></div>")))
    body = f"<h1>{text('m', 2, 12)}</h1>" if r.random() < 0.8 else ""
    for _ in range(r.randint(1, 9)):
        kind = r.random()
        if kind < 0.3 and before in ("<article>", "<main>"):  # where the article is marked, all of it is main text
            body += f"<p>{text('m', 1, r.choice((3, 20, 60)))}{' &copy;' if r.random() < 0.5 else ''}</p><p>{link(text('m', 1, 20)) if r.random() < 0.5 else text('m', 1, 3)}</p>"
        elif kind < 0.4:
            body += f"<div>{aside()}</div>"
        elif kind < 0.7:
            linked = " " + link(" ".join(["w"] * r.randint(1, 4))) if r.random() < 0.3 else ""
            body += f"<p>{text('m', r.choice((1, 8, 25)), r.choice((30, 60, 120)))}{linked}</p>"
        elif kind < 0.8:
            body += f"<h2>{text('m', 1, 8)}</h2><p>{text('m', 10, 80)}</p>"
        else:
            body += "<ul>" + "".join(f"<li>{text('m', 1, 12)}</li>" for _ in range(r.randint(2, 5))) + "</ul>"
    end = ""
    if r.random() < 0.5:
        end += f"<div><h3>{text('b', 1, 3)}</h3>{menu(r.randint(3, 7))}</div>" if not marked else f"<aside><h3>{text('b', 1, 3)}</h3>{menu(4)}</aside>"
    if r.random() < 0.3:
        end += f'<div class="comments"><p>{text("b", 3, 60)}</p><p>{text("b", 3, 60)}</p></div>'
    if r.random() < 0.7:
        foot = text("b", 2, 14)
        end += f"<footer>{foot}</footer>" if marked else f"<div>{foot} &copy;</div>"
    return f"<body>{top}{before}{body}{after}{end}</body>"


def labelled_blocks() -> list[tuple[float, ...]]:
    """The labelled table: the blocks of LABELLED_PAGES pages as FEATURES, read as any page is, then 1 for main text."""
    r = random.Random(17)
    rows = []
    for _ in range(LABELLED_PAGES):
        found = blocks(labelled_page(r))
        rows += [(*f, float(b.text.startswith("m"))) for f, b in zip(features(found).tolist(), found, strict=True)]
    return rows


_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
_IN_TAG = re.compile(r"[^>\"']*")
_ATTRIBUTE = re.compile(r"""([A-Za-z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none", re.I)


@dataclass
class Block:
    text: str
    words: int
    links: float
    outside: int
    in_article: int


@dataclass
class Open:
    """An open element: whether anything from it upwards is surely outside, its innermost open mark, and what it lies in."""

    tag: str
    surely: bool
    mark: int
    article: bool
    heading: bool
    header: bool


def says(attributes: str) -> tuple[bool, bool]:
    """Whether a tag's attributes tell that it surely encloses no main text, and whether they may do."""
    may = False
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "")
        if name in ("class", "id", "role"):
            for token in value.split():
                words = [w.lower() for w in _NAME_WORD.findall(token)]
                told = OUTSIDE_WORDS.intersection(words)
                if not told or words[0] in HAVING or ("header" in told and len(told) == 1 and ARTICLE_WORDS.intersection(words)):
                    continue
                if told <= OPEN_WORDS or words[-1] in ROUND:
                    may = True
                else:
                    return True, may
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and _HIDDEN.search(value)):
            return True, may
    return False, may


class Reader:
    """Tokens of a page in one pass: what is searched for in vain is not searched for again."""

    def __init__(self, html: str):
        self.html, self.gone = html, set()

    def find(self, what: str, at: int) -> int:
        if what in self.gone:
            return -1
        place = self.html.find(what, at)
        if place < 0:
            self.gone.add(what)
        return place

    def tag_end(self, at: int) -> int:
        """Place of the > that ends a tag, quoted values passed over; -1 if there is none."""
        start = at
        if self.find(">", at) < 0 or "end" in self.gone:
            return self.find(">", at)
        while True:
            at = _IN_TAG.match(self.html, at).end()
            if at >= len(self.html):
                self.gone.add("end")  # every > that is left stands in quotes: from here on the next one ends a tag
                return self.find(">", start)
            if self.html[at] == ">":
                return at
            quote = self.find(self.html[at], at + 1)
            if quote < 0:
                return self.find(">", at)
            at = quote + 1

    def raw_end(self, tag: str, at: int) -> int:
        """Place after the end tag of an element whose content is no markup."""
        while (place := self.find("</", at)) >= 0:
            if self.html[place + 2 : place + 2 + len(tag)].lower() == tag and not self.html[place + 2 + len(tag) : place + 3 + len(tag)].isalnum():
                end = self.find(">", place)
                return end + 1 if end >= 0 else len(self.html)
            at = place + 2
        return len(self.html)


def blocks(html: str) -> list[Block]:
    """The text blocks of a page in order, in time in proportion to its length."""
    found: list[Block] = []
    marks: list[int] = []  # of each block its innermost open mark, or -1
    stack = [Open("", False, -1, False, False, False)]
    open_tags: Counter = Counter()
    above: list[int] = []  # of each open mark the one round it
    holds: list[bool] = []  # and whether an article lies in it
    parts: list[tuple[str, bool]] = []
    links, raw_ends = 0, {}
    reader, at, size = Reader(html), 0, len(html)

    def close() -> None:
        nonlocal parts
        if parts:
            text = " ".join("".join(t for t, _ in parts).split())
            if text:
                linked = len(" ".join(t for t, a in parts if a).split())
                words, top = text.count(" ") + 1, stack[-1]
                outside = top.surely or (top.header and not (top.article and top.heading))
                found.append(Block(text, words, min(1.0, linked / words), int(outside), int(top.article)))
                marks.append(top.mark)
            parts = []

    def pop() -> None:
        open_tags[stack.pop().tag] -= 1

    while at < size:
        less = reader.find("<", at)
        if less < 0:
            less = size
        if less > at:
            parts.append((unescape(html[at:less]), links > 0))
            at = less
            continue
        if html.startswith(("<!", "<?"), at):
            kind = next((k for k in ("<!--", "<![CDATA[") if html.startswith(k, at)), "")
            end = reader.find({"<!--": "-->", "<![CDATA[": "]]>", "": ">"}[kind], at + max(2, len(kind)))
            if kind == "<![CDATA[":
                parts.append((html[at + 9 : end if end >= 0 else size], links > 0))
            at = size if end < 0 else end + (1 if not kind else 3)
            continue
        if reader.find(">", at) < 0:  # a tag without an end is text, and so is all that follows
            parts.append((unescape(html[at:]), links > 0))
            break
        m = _TAG.match(html, at)
        if not m:
            parts.append(("<", links > 0))
            at += 1
            continue
        end = reader.tag_end(m.end())
        ends, tag, attrs = m[1], m[2].lower(), html[m.end() : end]
        at = end + 1
        if ends:
            if tag == "a":
                links = max(0, links - 1)
            if tag in BLOCK_TAGS:
                close()
            if open_tags[tag]:
                while stack[-1].tag != tag:
                    pop()
                pop()
            continue
        if tag in RAW_TAGS:
            at = raw_ends[tag] = reader.raw_end(tag, at) if raw_ends.get(tag, 0) < size else size
            if tag in BLOCK_TAGS:
                close()
            continue
        if tag in BLOCK_TAGS:
            close()
            if tag != "br":
                links = 0
                if stack[-1].tag == "p" or (tag in ("li", "dd", "dt", "tr", "td", "th", "option") and stack[-1].tag == tag):
                    pop()
        if tag == "a":
            links += 1
        if tag not in VOID_TAGS and not attrs.endswith("/"):
            top, body = stack[-1], tag in ("html", "body", "article", "main")
            surely, may = (False, False) if body else says(attrs)
            surely |= tag in OUTSIDE_TAGS and tag != "form"
            may |= tag == "form"
            if tag in BLOCK_TAGS or surely or may:
                mark = top.mark
                if may and not surely:
                    above.append(mark), holds.append(False)
                    mark = len(above) - 1
                article = top.article or tag in ("article", "main")
                if article and not top.article and mark >= 0 and not (top.surely or surely):
                    holds[mark] = True
                stack.append(Open(tag, top.surely or surely, mark, article, top.heading or tag in HEADINGS, top.header or tag == "header"))
                open_tags[tag] += 1
    close()
    _judge_marks(found, marks, above, holds)
    return found


def _judge_marks(found: list[Block], marks: list[int], above: list[int], holds: list[bool]) -> None:
    """Blocks under an open mark are outside, unless the mark lies round an article or most of the page's words."""
    inside, free = [0.0] * len(above), 0.0
    for b, mark in zip(found, marks, strict=True):
        if not b.outside:
            free += b.words * (1 - b.links)
            if mark >= 0:
                inside[mark] += b.words * (1 - b.links)
    for mark in range(len(above) - 1, -1, -1):
        if above[mark] >= 0:
            inside[above[mark]] += inside[mark]
            holds[above[mark]] |= holds[mark]
    out: list[bool] = []
    for mark, up in enumerate(above):
        out.append((up >= 0 and out[up]) or not (holds[mark] or inside[mark] > MOST_OF_PAGE * free))
    for b, mark in zip(found, marks, strict=True):
        b.outside |= int(mark >= 0 and out[mark])


def features(found: list[Block]) -> np.ndarray:
    """A row of FEATURES for each block."""
    page = float(any(b.in_article and not b.outside for b in found))
    edge = [(0, 0.0)]
    size = edge + [(b.words, b.links) for b in found] + edge
    rows = [
        [b.words, b.links, *size[i], *size[i + 2], b.outside, page * (not b.in_article), b.in_article, b.words <= NOTICE_WORDS and bool(_NOTICE.search(b.text))]
        for i, b in enumerate(found)
    ]
    return np.array(rows, float).reshape(-1, len(FEATURES))


def fitted_tree(spark: SparkSession) -> list[Tree]:
    """The decision tree, fitted on the labelled table."""
    rows = spark.createDataFrame(labelled_blocks(), [*FEATURES, "label"])
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
    return parsed(DecisionTreeClassifier(maxDepth=8, minInstancesPerNode=5, seed=1).fit(data).toDebugString)


def main_text(html: str | None, tree: list[Tree]) -> str:
    found = blocks(html) if html else []
    if not found:
        return ""
    return " ".join(b.text for b, keep in zip(found, votes(tree, features(found)) > 0.5, strict=True) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each page (page_id, url, html)."""
    tree = fitted_tree(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(html, tree) for html in batch.column("html").to_pylist()]
            columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    columns = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return columns.mapInArrow(run, "page_id long, url string, text string, n_chars long")
