"""Operator 11: the main text of web pages by tree scoring.

1. A page is read into a tree of its block elements; tags are matched as
   browsers do (implied ends of p, li, dd, dt, td and tr, unclosed and
   misnested tags).  Text between block boundaries is a paragraph of the
   innermost block; inline tags only tell which characters are links.
2. What cannot be main text is cut: menus, page headers and footers, asides,
   forms and controls, dialogs, hidden elements, and elements whose role,
   class or id says menu, advert, notice, sidebar, comments and the like,
   unless such an element holds the page's article.
3. Every paragraph left passes points - for its length and its commas,
   discounted by its share of link characters - to its block in full, to the
   next ancestor by half, and less to those above.  A block's points are
   discounted by the link density of all its text.  The best block wins; it
   grows to an ancestor that holds clearly more paragraph points, and siblings
   that score well are kept with it.
4. In what is kept, link lists go; the other paragraphs are joined in page
   order, each with its white space as single spaces.

Cases: a null or empty page and a page without text give the empty string;
tags and comments without an end reach to the end of the page (an unclosed
``<`` is text); pages of any length are taken whole; repeated rows each give a
row; no rows give no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardinal.llm.common import arrow_map

BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table tbody td tfoot th thead"
    " tr ul caption".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe noembed noframes xmp".split())
CUT_TAGS = frozenset("nav header footer aside form button dialog menu search datalist map select template object audio video"
                     " canvas svg math".split())
CUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
CUT_WORDS = frozenset(
    "ad ads adv advert advertisement advertising adsbygoogle sponsor sponsored promo promotion banner sidebar comment comments"
    " commentlist disqus respond replies cookie cookies consent gdpr notice newsletter subscribe subscription signup popup"
    " overlay modal share sharing social related recommended breadcrumb breadcrumbs menu nav navbar navigation topnav toc"
    " pagination pager paging login search skip toolbar footer masthead outbrain taboola".split())
SOFT_WORDS = frozenset("header tags links side aside widget".split())  # speak against a block without a good word
GOOD_WORDS = frozenset("article body content entry main page post story text blog hentry column".split())
LAYOUT_WORDS = frozenset("has with no layout".split())  # has-sidebar and its like describe the page, not the element
GOOD_TAGS = {"article": 25.0, "main": 15.0, "div": 5.0, "section": 5.0, "pre": 3.0, "td": 3.0, "blockquote": 3.0,
             "ul": -3.0, "ol": -3.0, "dl": -3.0, "li": -3.0, "address": -3.0}
ROWS = ("table", "tbody", "thead", "tfoot", "tr", "td", "th", "caption")
#: What a start tag ends if it is open, and the elements beyond which it is not looked for.
CLOSES = {"li": (("li",), ("ul", "ol", "menu")), "dd": (("dd", "dt"), ("dl",)), "dt": (("dd", "dt"), ("dl",)),
          "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tr": (("td", "th", "tr"), ("table",)),
          "tbody": (ROWS[1:], ("table",)), "thead": (ROWS[1:], ("table",)), "tfoot": (ROWS[1:], ("table",))}
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
SCOPES = frozenset(("td", "th", "caption", "button"))
PARAGRAPHS = frozenset(("p", "pre", "li", "dd", "dt", "figcaption", "caption", "td", "th", *HEADINGS))
SHARES = (1.0, 1 / 2, 1 / 6, 1 / 9, 1 / 12)  # of a paragraph's points for its container and the ancestors of that
GROWS, SIBLING = 1.3, 0.2  # an ancestor with so many times the points takes over; siblings with this share are kept
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]+|=\s*"[^"]*"|=\s*'[^']*'|=)*+)>""")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
COMMAS = re.compile("[,;،、，；]")
TALK = re.compile(r"(\d+ )?((reader|user) )?(comments?|responses|replies)( \(?\d+\)?)?:?|(leave|post|add) a (comment|reply)", re.IGNORECASE)


class Block:
    """A block element: its tag, parent, paragraphs and blocks in page order, and what is known against or for it."""

    __slots__ = ("cut", "items", "linked", "links", "parent", "points", "rescued", "score", "size", "sum", "tag")

    def __init__(self, tag: str, parent: Block | None, cut: str, score: float):
        self.tag, self.parent, self.cut, self.score = tag, parent, cut, score
        self.items: list = []  # (text, link characters) or Block
        self.rescued = False
        self.points = self.sum = 0.0
        self.size = self.links = self.linked = 0  # characters, link characters, paragraphs that are links


def judged(tag: str, attributes: str) -> tuple[str, float]:
    """Why an element may be cut ("tag", "name", or "" if nothing speaks for it), and its points for tag and names."""
    score = GOOD_TAGS.get(tag, 0.0)
    if tag in CUT_TAGS:
        return "tag", score
    if not attributes.strip():
        return "", score
    said: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(attributes):
        said.setdefault(name.lower(), value.strip("\"'"))
    style = said.get("style", "").replace(" ", "").lower()
    names = f"{said.get('class', '')} {said.get('id', '')}"
    if (said.get("role", "").lower() in CUT_ROLES or "hidden" in said or said.get("aria-hidden") == "true"
            or "display:none" in style or "visibility:hidden" in style or "hidden" in names.split()):
        return "tag", score
    words = {w.lower() for w in WORDS.findall(names)}
    good = words & GOOD_WORDS
    if not words & LAYOUT_WORDS and not (tag in ("article", "main") and good - {"body", "text"}):
        if words & CUT_WORDS or (words & SOFT_WORDS and not good and tag in BLOCKS):
            return "name", score - 25.0
    return "", score + 25.0 * bool(good)


class Reader:
    """Builds the tree of one page from its tags and texts."""

    def __init__(self):
        self.root = self.block = Block("body", None, "", 0.0)
        self.stack: list[tuple] = []  # (tag, block or None for inline, link and mute around it)
        self.open: list[dict] = [{}]  # open block tags by name, one table for each cell or button around
        self.inline: list[dict] = [{}]  # open inline tags by name, one table for each block around
        self.link = self.mute = False
        self.text: list[str] = []
        self.linked = 0

    def end_paragraph(self) -> None:
        if self.text:
            said = " ".join("".join(self.text).split())
            if said:
                self.block.items.append((said, min(self.linked, len(said))))
            self.text, self.linked = [], 0

    def add(self, text: str) -> None:
        if not self.mute:
            self.text.append(text)
            if self.link:
                self.linked += len(" ".join(text.split()))

    def pop(self) -> str:
        tag, block, link, mute = self.stack.pop()
        if block is None:
            self.inline[-1][tag] -= 1
        else:
            self.end_paragraph()
            self.block = block.parent
            self.inline.pop()
        if tag in SCOPES:
            self.open.pop()
        if block is not None:
            self.open[-1][tag] -= 1
        self.link, self.mute = link, mute
        return tag

    def pop_to(self, tag: str) -> None:
        while self.pop() != tag:
            pass

    def push(self, tag: str, attributes: str) -> None:
        cut, score = judged(tag, attributes)
        block, table = None, self.inline[-1]
        if tag in BLOCKS:
            self.end_paragraph()
            block = Block(tag, self.block, cut, score)
            self.block.items.append(block)
            self.block, table = block, self.open[-1]
            self.inline.append({})
        self.stack.append((tag, block, self.link, self.mute))
        table[tag] = table.get(tag, 0) + 1
        if tag in SCOPES:
            self.open.append({})
        if block is None and cut:
            self.mute = True
        if tag == "a":
            self.link = True

    def start(self, tag: str, attributes: str) -> None:
        if tag in CLOSES:
            ends, holders = CLOSES[tag]
            found = None
            for k in range(len(self.stack) - 1, -1, -1):
                name = self.stack[k][0]
                if name in ends:
                    found = k
                elif name in holders or (tag not in ROWS and name in BLOCKS and name not in ("address", "div", "p")):
                    break
            while found is not None and len(self.stack) > found:
                self.pop()
        if tag in BLOCKS and tag not in ROWS[1:]:
            if self.open[-1].get("p"):
                self.pop_to("p")
            if tag in HEADINGS and self.stack and self.stack[-1][0] in HEADINGS:
                self.pop()
        elif tag == "a" and self.inline[-1].get("a"):
            self.pop_to("a")
        if tag == "hr":
            self.end_paragraph()
        elif tag not in VOID:
            self.push(tag, attributes)

    def end(self, tag: str) -> None:
        if tag in BLOCKS:
            if tag in HEADINGS and not self.open[-1].get(tag):
                tag = next((h for h in HEADINGS if self.open[-1].get(h)), tag)
            tables = self.open if tag in ROWS else self.open[-1:]
            if any(t.get(tag) for t in tables):
                self.pop_to(tag)
            elif tag == "p":
                self.end_paragraph()
        elif self.inline[-1].get(tag):
            self.pop_to(tag)

    def read(self, html: str) -> Block:
        at, n = 0, len(html)
        last = html.rfind(">")
        while at < n:
            lt = html.find("<", at)
            if lt < 0 or lt > last:
                self.add(unescape(html[at:]))
                break
            if lt > at:
                self.add(unescape(html[at:lt]))
            follows = html[lt + 1]
            if html.startswith("<!--", lt):
                empty = html.startswith(("<!-->", "<!--->"), lt)
                close = html.find(">" if empty else "-->", lt + 4)
                at = n if close < 0 else close + (1 if empty else 3)
            elif follows in "!?" or (follows == "/" and not html[lt + 2].isalpha()):
                at = html.find(">", lt) + 1
            elif got := TAG.match(html, lt):
                at = got.end()
                tag = got[2].lower()
                if tag == "br":
                    self.add(" ")
                elif got[1]:
                    self.end(tag)
                elif tag in RAW:
                    close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(html, at)
                    at = close.end() if close else n
                elif tag not in ("html", "head", "body") and not (tag in ("svg", "math") and got[3].endswith("/")):
                    self.start(tag, got[3])
            else:
                self.add("<")
                at = lt + 1
        while self.stack:
            self.pop()
        self.end_paragraph()
        return self.root


def walk(root: Block) -> list[Block]:
    """All blocks, parents before children, in page order."""
    out, todo = [], [root]
    while todo:
        block = todo.pop()
        out.append(block)
        todo += [x for x in reversed(block.items) if isinstance(x, Block)]
    return out


def points(text: str, links: int) -> float:
    """Points of one paragraph: a little for any text, one for a sentence's length, one a comma, up to three for length."""
    size = len(text)
    return (0.04 * min(size, 25) + len(COMMAS.findall(text)) + min(size / 100, 3.0)) * (1 - links / size)


def density(block: Block) -> float:
    return block.links / block.size if block.size else 0.0


def first_words(block: Block) -> str:
    """The first paragraph of a block, if a heading or the block itself holds it."""
    for _ in range(2):
        if block.items and not isinstance(block.items[0], Block):
            return block.items[0][0]
        if not block.items or block.items[0].tag not in HEADINGS:
            break
        block = block.items[0]
    return ""


def score_tree(root: Block) -> list[Block]:
    """The blocks that are not cut, parents first, with points passed up, sums, sizes and link characters."""
    every = walk(root)
    for block in every:
        if block.cut != "tag" and block.tag in ("section", "div", "ol", "ul") and TALK.fullmatch(first_words(block)):
            block.cut = "talk"
        if block.tag in ("article", "main") and not block.cut:
            up = block.parent
            while up is not None and not up.rescued:
                up.rescued, up = up.cut == "name", up.parent
    dead = set()
    for block in every:
        if id(block.parent) in dead or (block.cut and not block.rescued):
            dead.add(id(block))
    kept = [b for b in every if id(b) not in dead]
    for block in reversed(kept):
        block.items = [x for x in block.items if not isinstance(x, Block) or id(x) not in dead]
        # A p, heading or cell is a paragraph itself: its container is the block around it.
        container = block.parent if block.tag in PARAGRAPHS else block
        for item in block.items:
            if isinstance(item, Block):
                size, links, linked, gain = item.size, item.links, item.linked, item.sum
            else:
                size, links = len(item[0]), item[1]
                linked, gain, up = int(links > 0.5 * size), points(*item), container
                for share in SHARES:
                    if up is None:
                        break
                    up.points, up = up.points + gain * share, up.parent
            block.size, block.links, block.linked, block.sum = (
                block.size + size, block.links + links, block.linked + linked, block.sum + gain)
    return kept


def link_list(block: Block) -> bool:
    """A list, table or box that is mostly links, and several of them."""
    return block.tag in ("ul", "ol", "dl", "div", "section", "table") and density(block) > 0.5 and block.linked >= 2


def paragraphs(block: Block) -> list[str]:
    """The texts of a kept block in page order, without the link lists in it."""
    out, todo = [], [block]
    while todo:
        item = todo.pop()
        if not isinstance(item, Block):
            out.append(item[0])
        elif item is block or not link_list(item):
            todo += reversed(item.items)
    return out


def main_text(html: str | None) -> str:
    """The paragraphs of the page's main container and the siblings kept with it, joined by line feeds."""
    if not html:
        return ""
    root = Reader().read(html)
    kept = [b for b in score_tree(root) if b.sum > 0]
    if not kept:
        return "\n".join(paragraphs(root))
    best = max(kept, key=lambda b: (b.points + (b.score if b.points else 0.0)) * (1 - density(b)))
    up = best.parent
    while up is not None:
        if up.sum * (1 - density(up)) >= GROWS * best.sum * (1 - density(best)):
            best = up
        up = up.parent
    if best.parent is None:
        return "\n".join(paragraphs(best))
    bar = SIBLING * best.sum
    out = []
    for item in best.parent.items:
        if item is best:
            out += paragraphs(best)
        elif isinstance(item, Block) and item.sum * (1 - density(item)) >= max(bar, 1.0) and density(item) < 0.25:
            out += paragraphs(item)
    return "\n".join(out)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", carry: tuple[str, ...] = ("url",)) -> DataFrame:
    """Per row: the id, the carried columns, ``text`` and its length ``n_chars`` in code points."""
    kept = [id_col, *carry]
    kinds = [f"c{k} {pages.schema[c].dataType.simpleString()}" for k, c in enumerate(kept)]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(h.as_py()) for h in batch.column(len(kept))]
        said = pa.array([t.encode("utf-8", "replace").decode() for t in texts], pa.string())
        return pa.RecordBatch.from_arrays(
            [*batch.columns[:len(kept)], said, pa.array([len(t) for t in texts], pa.int64())],
            names=[*(f"c{k}" for k in range(len(kept))), "text", "n_chars"])

    read = pages.select(*[F.col(c).alias(f"c{k}") for k, c in enumerate(kept)], F.col(html_col).cast("string").alias("h"))
    out = arrow_map(read, run, ", ".join([*kinds, "text string", "n_chars bigint"]), rows=200)
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(kept)], "text", "n_chars")
