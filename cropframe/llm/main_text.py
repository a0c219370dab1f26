"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. The first pass judges every
block by itself: link density, length and the share of stop words make it good
or bad, and leave short blocks, headings and middling ones undecided. In the
second pass an undecided block takes the label of the nearest decided blocks
before and after it; if they differ, the one that shares the deeper enclosing
element wins, then the nearer one.

What the page says about itself goes first: text in menus, page headers and
footers, asides, forms, scripts and the like, in hidden elements, and in
elements whose class or id names them an advert, sidebar, notice or comment is
bad whatever its words. Inside an ``article`` or ``main`` element long blocks
without many links need no stop words, and an undecided block with no decided
one beside it in that element is good. Elements around an ``article`` or
``main`` are not judged by name (themes put such words on whole pages).

Defined results
* A null or empty page, and one without a good block, gives an empty text.
* References are decoded once, after tags are taken out. White space (as
  Unicode has it, so no-break spaces too) inside a block becomes one space; a
  line break is white space; other inline tags add nothing. Blocks are joined in
  page order by one space.
* Broken markup is read as browsers do: unclosed elements, stray end tags,
  quotes with ``>`` in them, comments and scripts that the page's end cuts off.
* Where the good blocks inside ``article`` and ``main`` elements hold at least as
  many characters as those outside, the outside ones are not part of the text.
* A page without any decided block is all main text, or what its ``article`` or
  ``main`` elements hold. Elements nested over 512
  deep count as their parent, as in browsers.
* On a page whose long blocks hold no stop words at all (another language, or
  none), the stop-word rules are off and length and links decide.
* Every row is judged by itself: repeated rows and repeated or null ids return
  one result each; an empty table gives an empty result. Only the id, the page
  and the columns asked for in ``carry`` are read.
* Whole pages are read; the work is linear in their length.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Frequent function words of four languages.
STOP_WORDS = {
    "en": "a about after all also an and are as at be been but by can for from had has have he her his if in into is it "
          "its more not of on one or she that the their they this to was we were which who will with would you",
    "de": "als am an auch auf aus bei bis das dass dem den der des die durch ein eine einen einer er es für hat ich im "
          "in ist mit nach nicht noch nur oder sich sie sind so über um und von vor war was wie wir zu zum zur",
    "fr": "au aux avec ce ces dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas "
          "plus pour qu que qui sa se ses son sont sur un une vous",
    "es": "al como con de del el en entre es esta este ha la las le lo los más me no o para pero por que se ser si "
          "sin sobre son su sus también un una y ya",
}

# Element names.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol optgroup option p pre search section select "
    "summary table tbody td tfoot th thead tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED_TAGS = frozenset(
    "applet audio canvas head iframe math noembed noframes noscript object script style svg template textarea title "
    "video".split())
RAW_TAGS = frozenset("iframe noembed noframes noscript script style textarea title".split())
PAGE_TAGS = frozenset("aside button dialog footer form menu nav search select".split())
MAIN_TAGS = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSED_BY = {"li": frozenset("ul ol menu dir".split()), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]),
             "tr": frozenset(["table"]), "td": frozenset(["table"]), "th": frozenset(["table"]),
             "option": frozenset(["select"])}
SIBLINGS = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}

# Words of class and id that name something beside the main text, and roles that do.
ASIDE_WORDS = frozenset(
    "ad ads adsense advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments commentlist "
    "cookie cookies consent copyright disclaimer disqus footer gdpr menu modal nav navbar navigation newsletter "
    "notice notification pager pagination popup promo promoted promotion related replies reply respond share sharing "
    "sidebar sidenav signup skyscraper social sponsor sponsored subscribe subscription tags teaser toolbar widget "
    "widgets".split())
ASIDE_ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
# Names that describe the page header unless they stand in the main element, and first parts of
# names that only say what a page has or where an article is filed.
HEADER_WORDS = frozenset("header masthead topbar".split())
FILING_WORDS = frozenset("category has is no not tag type with without".split())

#: A tag, comment or declaration. Quotes hide ``>``; a quote that never closes is an ordinary character.
TAG = re.compile(r"""<(?:(!--)|(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"']++|["'])*+)>|[!?/][^>]*>)""")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NO_COMMENT, COMMENT_END = re.compile(r"-?>"), re.compile(r"--!?>")
UNFINISHED = re.compile(r"<[a-zA-Z/!?]")
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in RAW_TAGS}
WORD = re.compile(r"[^\W\d_]+")
NAME_PART = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+(?![a-z])")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

GOOD, BAD, OPEN = 1, 0, None

#: Elements deeper than this count as their parent.
DEEPEST = 512


class Rules:
    """Thresholds of the first pass: characters, and shares of link characters and of stop words."""

    def __init__(self, short: int = 70, long: int = 200, links: float = 0.3, main_links: float = 0.5,
                 few: float = 0.15, many: float = 0.25, stop_words: Sequence[str] | None = None):
        self.short, self.long, self.few, self.many = short, long, few, many
        self.links, self.main_links = links, main_links
        words = " ".join(STOP_WORDS.values()).split() if stop_words is None else stop_words
        self.stop = frozenset(w.lower() for w in words)


class Node:
    """An open element that later rules ask for."""

    __slots__ = ("name", "parent", "depth", "aside", "body", "heading", "holds")

    def __init__(self, name: str, parent: Node | None, aside: bool):
        self.name, self.parent, self.aside, self.holds = name, parent, aside, False
        self.depth = parent.depth + 1 if parent else 0
        #: the nearest article or main element, itself included
        self.body = self if name in MAIN_TAGS else parent.body if parent else None
        self.heading = name in HEADINGS or bool(parent and parent.heading)


class Block:
    """Text between two block-level tags."""

    __slots__ = ("node", "pieces", "linked", "text", "label")

    def __init__(self, node: Node):
        self.node, self.pieces, self.linked = node, [], 0
        self.text, self.label = "", OPEN


def _names(value: str) -> set[str]:
    """The words that a class or id is put together from, without those that only file the page."""
    parts = [NAME_PART.findall(token) for token in value.split()]
    return {w.lower() for p in parts if p and p[0].lower() not in FILING_WORDS for w in p}


def says_aside(attributes: str, in_main: bool) -> bool:
    """Whether the attributes hide the element or name it something beside the main text."""
    if "=" not in attributes and "hidden" not in attributes.lower():
        return False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "style" and HIDDEN.search(value) or name == "role" and value.lower() in ASIDE_ROLES:
            return True
        if name in ("class", "id") and (found := _names(value)):
            if found & ASIDE_WORDS or not in_main and found & HEADER_WORDS:
                return True
    return False


def blocks(page: str) -> list[Block]:
    """The blocks of a page that hold any text, in page order."""
    root = Node("", None, False)
    stack, out, open_ = [root], [], Counter()
    block = Block(root)
    pos, end = 0, page.rfind(">") + 1
    link_depth = None  # length of the stack where a link is open
    dropped = 0  # stack length from which text is dropped; 0: none is

    def text(raw: str) -> None:
        if raw and not dropped:
            block.pieces.append((raw, link_depth is not None))

    def cut() -> None:
        nonlocal block
        if block.pieces:
            out.append(block)
        block = Block(stack[-1])

    def close(size: int) -> None:
        nonlocal link_depth, dropped
        open_.subtract(n.name for n in stack[size:])
        del stack[size:]
        if link_depth is not None and len(stack) < link_depth:
            link_depth = None
        if dropped and len(stack) < dropped:
            dropped = 0

    while m := TAG.search(page, pos, end):
        text(page[pos:m.start()])
        pos = m.end()
        if m[1]:
            shut = NO_COMMENT.match(page, pos) or COMMENT_END.search(page, pos)
            pos = shut.end() if shut else len(page)
            continue
        if not m[3]:
            continue
        name, closing = m[3].lower(), m[2] == "/"
        if name == "a":
            link_depth = None if closing else len(stack)
            continue
        if name == "br":
            text("\n")
            continue
        inline = name not in BLOCK_TAGS and name not in DROPPED_TAGS
        if closing:
            at = open_[name] and next((i for i in range(len(stack) - 1, 0, -1) if stack[i].name == name), 0)
            if at:
                close(at)
            if at or not inline:
                cut()
            continue
        if name in RAW_TAGS:
            shut = RAW_END[name].search(page, pos)
            pos = shut.end() if shut else len(page)
            continue
        body = stack[-1].body
        aside = says_aside(m[4], body is not None) if name not in ("html", "body", "main") else False
        if name in VOID_TAGS or inline and not aside and name not in PAGE_TAGS and not open_[name]:
            if not inline:
                cut()
            continue
        if name in BLOCK_TAGS:
            if dropped and stack[dropped - 1].name == "head":  # a head that was never closed
                close(dropped - 1)
            p = open_["p"] and next((i for i in range(len(stack) - 1, max(0, len(stack) - 4), -1)
                                     if stack[i].name == "p"), 0)
            if p:
                close(p)
            same = SIBLINGS.get(name, (name,))
            if name in CLOSED_BY and any(open_[t] for t in same):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].name in CLOSED_BY[name]:
                        break
                    if stack[i].name in same:
                        close(i)
                        break
        if m[4].endswith("/") and name in DROPPED_TAGS or len(stack) >= DEEPEST:
            cut()
            continue
        aside = aside or name in PAGE_TAGS or name == "header" and body is None
        node = Node(name, stack[-1], aside)
        for n in stack if name in MAIN_TAGS else ():
            n.holds = True
        for n in stack if name == "h1" else ():  # a form around the whole page
            n.holds = n.holds or n.name == "form"
        stack.append(node)
        open_[name] += 1
        if name in DROPPED_TAGS and not dropped:
            dropped = len(stack)
        cut()
    tail = page[pos:]
    if pos < len(page):
        unfinished = UNFINISHED.search(tail)
        text(tail[:unfinished.start()] if unfinished else tail)
    cut()
    return [b for b in out if measured(b)]


def measured(b: Block) -> bool:
    """Decode the block's text and count its characters in links; whether there is any."""
    decoded = [(html.unescape(raw) if "&" in raw else raw, link) for raw, link in b.pieces]
    if any(link for _, link in decoded):
        b.linked = sum(len("".join(t.split())) for t, link in decoded if link)
    # a reference may be cut by no tag, so the pieces of one run of text decode alone
    b.text = " ".join("".join(t for t, _ in decoded).split())
    b.pieces = []
    return bool(b.text)


def is_aside(node: Node | None) -> bool:
    """Whether an element around the block is no part of the main text.

    A flag on an element that holds an article or main element says nothing about it.
    """
    while node:
        if node.aside and not node.holds:
            return True
        node = node.parent
    return False


def stop_share(text: str, stop: frozenset[str]) -> float:
    words = WORD.findall(text.lower())
    return sum(w in stop for w in words) / len(words) if words else 0.0


def first_pass(found: list[Block], rules: Rules) -> None:
    """Label every block by itself: good, bad or open."""
    aside: dict[int, bool] = {}
    waiting = []
    for b in found:
        node, size = b.node, len(b.text)
        if id(node) not in aside:
            aside[id(node)] = is_aside(node)
        if aside[id(node)]:
            b.label = BAD
        elif node.body and node.heading or not b.linked and size < rules.short and "©" not in b.text:
            b.label = OPEN
        elif b.linked > (rules.main_links if node.body else rules.links) * size:
            b.label = BAD
        elif not node.body and size < rules.long and ("©" in b.text or size < rules.short):
            b.label = BAD  # a short block with links, or a copyright line
        elif not node.heading and size >= rules.short:
            waiting.append(b)
    share = [stop_share(b.text, rules.stop) for b in waiting]
    spoken = any(s > 0 and len(b.text) >= rules.long for b, s in zip(waiting, share, strict=True))
    for b, s in zip(waiting, share, strict=True):
        long = len(b.text) >= rules.long
        if b.node.body or not spoken:
            b.label = GOOD if long or b.node.body and s >= rules.few else OPEN
        elif s >= rules.many:
            b.label = GOOD if long else OPEN
        elif s < rules.few:
            b.label = BAD


def shared_depth(a: Node, b: Node) -> int:
    while a.depth > b.depth:
        a = a.parent
    while b.depth > a.depth:
        b = b.parent
    while a is not b:
        a, b = a.parent, b.parent
    return a.depth


def second_pass(found: list[Block]) -> None:
    """Undecided blocks inherit from the nearest decided ones on both sides."""
    n = len(found)
    before, after, last = [-1] * n, [-1] * n, -1
    for i, b in enumerate(found):
        before[i] = last
        last = i if b.label is not OPEN else last
    last = -1
    for i in range(n - 1, -1, -1):
        after[i] = last
        last = i if found[i].label is not OPEN else last
    final, has_body = [], any(b.node.body for b in found)
    for i, b in enumerate(found):
        label, body = b.label, b.node.body
        if label is OPEN:
            sides = [(found[j], abs(i - j)) for j in (before[i], after[i]) if j >= 0]
            own = [s for s in sides if body and s[0].node.body is body and not is_aside(s[0].node)]
            if body and not own:
                label = GOOD
            elif not sides:
                label = BAD if has_body else GOOD
            else:
                label = max(own or sides, key=lambda s: (shared_depth(b.node, s[0].node), -s[1], s[0].label))[0].label
        final.append(label)
    for b, label in zip(found, final, strict=True):
        b.label = label


def main_text(page: str | None, rules: Rules) -> str:
    """The good blocks of a page, joined by one space."""
    if not page:
        return ""
    found = blocks(page)
    first_pass(found, rules)
    second_pass(found)
    good = [b for b in found if b.label == GOOD]
    inside = [b for b in good if b.node.body]
    if 2 * sum(len(b.text) for b in inside) >= sum(len(b.text) for b in good):
        good = inside or good
    return " ".join(b.text for b in good)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", carry: Sequence[str] = ("url",),
            rules: Rules | None = None) -> DataFrame:
    """id, the carried columns, text and n_chars (code points) of every page."""
    rules, names = rules or Rules(), [f"c{i}" for i in range(len(carry) + 1)]
    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, *carry)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [main_text(p.as_py(), rules) for p in batch.column("page")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(text, pa.string()),
                 pa.array([len(t) for t in text], pa.int64())], [*names, "text", "n_chars"])

    rows = pages.select(*[F.col(c).alias(n) for c, n in zip((id_col, *carry), names, strict=True)],
                        F.col(html_col).cast("string").alias("page"))
    schema = ", ".join([*(f"{n} {k}" for n, k in zip(names, kinds, strict=True)), "text string", "n_chars long"])
    return rows.mapInArrow(run, schema).toDF(id_col, *carry, "text", "n_chars")
