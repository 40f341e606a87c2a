"""Main text of web pages by two passes of block rules.

A page is read tag by tag into blocks (paragraphs, headings, list items, table rows, bare text
in containers). Elements whose tag names a page part that is never main text (menus, headers,
footers, sidebars, forms, scripts) or that are hidden are left out with all they hold. So are
elements that a class, id or role names as such a part, if a whole token of it does ("sidebar",
"left-sidebar", "comment-list", "cookie-notice", but not "has-sidebar" or "related-work"), unless they
hold the page's article or, on a page without one, most of the stop words: these are layout, not
parts. The page's article is the one with most stop words of those that lie in no other, so comments
and teasers that are articles too go with the part they are in, or by their own class.

Pass one labels each remaining block by its own text: a high share of link text makes it bad; a
long block with many stop words is good, a long one without is bad unless it lies in an
article; short blocks stay undecided. Stop words are known for four languages. On a page that is
in none of them (its long blocks with few links have a low share of known stop words in all) length
and links decide alone: a long block with few links is good. A block in another script than Latin
is undecided if its page is in a known language. Pass two gives an undecided block the label of the nearest
decided one, first inside its own section (article or not), then on the page; of two equally
near ones the good one counts. With nothing decided, a block of an article is good and any
other bad. Then the good blocks are the text.

Pages are independent rows, so the work is one pass without an exchange; memory is bounded by
the largest page of a batch. Reading takes time in proportion to the page, however deep it nests.

Defined cases: null or empty html gives an empty text; unclosed and misnested tags close what a
browser would close; repeated rows are read each for itself; result columns replace input
columns of the same name.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass
from typing import Optional

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietgrove.llm.common import bound_batches, free_name, replacing

LONG = 60
MAX_LINK_SHARE = 0.5
MIN_STOP_SHARE = 0.08
#: Share of known stop words in the running text of a page, below which its language is unknown.
KNOWN_SHARE = 0.2

# Frequent function words of four languages; pages in others do without.
STOP_WORDS = frozenset("""
a about after all also an and are as at be been but by can could for from had has have he her his
if in into is it its more no not of on one or other our out she so some than that the their them
then there these they this to up was we were what when which who will with would you
aber als am an auch auf aus bei bin bis da das dass dem den der des die doch du durch ein eine einem
einen einer es für hat ich ihr im in ist ja kann mit nach nicht noch nur oder sein sich sie sind so
über um und uns vom von vor war was wenn wer wie wir wird zu zum zur
au aux avec ce ces cette comme dans de des du elle en est et eux il ils je la le les leur lui ma mais
me même mes moi mon ne nos notre nous on ou où par pas pour qu que qui sa se ses son sont sur ta te tu
un une vos votre vous
al algo como con cuando de del desde donde el ella ellos en entre era es esta este esto ha hasta hay
la las le les lo los más me mi muy no nos o para pero por que quien se ser si sin sobre son su sus
también te tiene todo tu un una uno y ya yo
""".split())

#: Elements without content of their own.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are left out with all they hold.
_DROPPED = frozenset(
    "head script style noscript template iframe object svg canvas nav footer aside form button "
    "select option textarea menu dialog audio video map math title datalist".split())
#: Elements that begin and end a block.
_BLOCKS = frozenset(
    "address article blockquote body caption center dd details div dl dt fieldset figcaption "
    "figure footer form aside dialog menu nav h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main "
    "ol p pre section summary table tbody tfoot thead tr ul".split())
#: Elements that set words apart without beginning a block.
_SPACES = frozenset("br td th wbr".split())
#: Words in a class, id or role that name a page part.
_PARTS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion "
    "breadcrumb breadcrumbs comment comments disqus cookie cookies consent gdpr footer header masthead "
    "login signin signup subscribe subscription newsletter menu nav navbar navigation navi notice notices "
    "alert pager pagination popup modal overlay related recommended recommendations replies reply respond "
    "search share sharing sidebar sidenav skip social tags toolbar topbar widget widgets complementary "
    "contentinfo".split())
#: Words that may stand beside them in a token and only say where the part is.
_PLACES = frozenset("site page main left right top bottom side global primary secondary post".split())
#: Words that may follow them and only say what the part looks like.
_SHAPES = frozenset(
    "area bar block box buttons column container group holder icons inner items links list module panel posts "
    "row section slot stories thread unit wrap wrapper zone".split())
#: Of the parts, words that inside an article only name a part of it.
_OWN_PARTS = frozenset(("header",))
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'=<>`]+))?""")
_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"""
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*(?:"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)""", re.S)
_RAW = frozenset("script style textarea title noscript iframe".split())
_RAW_END = {tag: re.compile(f"</{tag}\\s*>", re.I) for tag in _RAW}
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    text: str
    link_chars: int
    in_article: bool


def _hidden(attributes: str) -> bool:
    """Whether an element's attributes say that nobody sees it."""
    for name, value in _ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name == "hidden" or name == "aria-hidden" and "true" in value.lower() \
                or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
    return False


def _names_part(attributes: str, in_article: bool) -> bool:
    """Whether a whole token of an element's class, id or role names a page part."""
    for name, value in _ATTRIBUTE.findall(attributes):
        if name.lower() in ("class", "id", "role"):
            for token in value.strip("\"'").split():
                words = set(re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", token).lower())) - {""}
                named = words & _PARTS
                if words <= _PARTS | _PLACES | _SHAPES and named - (_OWN_PARTS if in_article else frozenset()):
                    return True
    return False


def _weight(text: str) -> float:
    """Number of stop words; where there are none at all, the number of characters counts."""
    return sum(w in STOP_WORDS for w in _WORD.findall(text.lower())) + 1e-9 * len(text)


@dataclass
class _Part:
    """An element that its class, id or role names a part, and the open part around it."""

    around: Optional[int]
    weight: float


@dataclass
class _Article:
    """An article that lies in no other, and the innermost part that holds (or is) it."""

    part: Optional[int]
    weight: float


def blocks(page: str) -> list[Block]:
    """Blocks of a page in order, without those of left-out elements."""
    reader = _Reader(page, frozenset())
    parts = reader.parts
    if not parts:
        return reader.blocks
    layout = set()
    if reader.articles:
        i = max(reader.articles, key=lambda a: a.weight).part
        while i is not None:
            layout.add(i)
            i = parts[i].around
    else:
        layout = {i for i, p in enumerate(parts) if 2 * p.weight > reader.weight}
    return _Reader(page, frozenset(layout)).blocks if layout else reader.blocks


@dataclass
class _Open:
    tag: str
    left_out: bool
    part: Optional[int]
    article: Optional[int]


class _Reader:
    """One pass over a page: its blocks, the elements that are named as parts, in order, and its
    articles. Parts whose numbers are in ``layout`` are kept, others left out.

    ``weight`` counts the stop words of what no tag or attribute hides, in parts or not.
    """

    def __init__(self, page: str, layout: frozenset[int]):
        self.layout = layout
        self.blocks: list[Block] = []
        self.parts: list[_Part] = []
        self.articles: list[_Article] = []
        self.weight = 0.0
        self.words: list[str] = []
        self.links = 0
        self.stack: list[_Open] = []
        self.count: dict[str, int] = {}  # open elements by tag
        self.bounds: list[int] = []  # places of the open elements that stop a paragraph's end
        self.open_parts: list[int] = []
        self.dropped = self.hard = self.article = 0
        self._read(page)

    def _close_block(self) -> None:
        text = " ".join(html.unescape("".join(self.words)).split())
        if text:
            self.blocks.append(Block(text, self.links, self.article > 0))
        self.words, self.links = [], 0

    def _add(self, text: str) -> None:
        if not text:
            return
        if not self.hard:
            self.weight += _weight(html.unescape(text))
        if not self.dropped:
            self.words.append(text)
            if self.count.get("a"):
                self.links += len("".join(html.unescape(text).split()))

    def _push(self, tag: str, left_out: bool, part: Optional[int]) -> None:
        article = None
        if tag == "article" and not self.count.get("article") and not self.hard and (not left_out or part is not None):
            article = len(self.articles)
            self.articles.append(_Article(part if part is not None else
                                          self.open_parts[-1] if self.open_parts else None, -self.weight))
        if tag in _BLOCKS or tag in _DROPPED:
            self.bounds.append(len(self.stack))
        self.stack.append(_Open(tag, left_out, part, article))
        self.count[tag] = self.count.get(tag, 0) + 1
        if part is not None:
            self.open_parts.append(part)
        self.hard += left_out and part is None
        self.dropped += left_out
        self.article += tag in ("article", "main")

    def _pop(self) -> str:
        top = self.stack.pop()
        self.count[top.tag] -= 1
        if self.bounds and self.bounds[-1] == len(self.stack):
            self.bounds.pop()
        if top.part is not None:
            self.open_parts.pop()
            self.parts[top.part].weight += self.weight
        if top.article is not None:
            self.articles[top.article].weight += self.weight
        self.hard -= top.left_out and top.part is None
        if top.tag in _BLOCKS and not self.dropped:
            self._close_block()
        self.dropped -= top.left_out
        self.article -= top.tag in ("article", "main")
        return top.tag

    def _end(self, tag: str) -> None:
        if self.count.get(tag):
            while self._pop() != tag:
                pass
        elif tag == "p" and not self.dropped:
            self._close_block()

    def _begin(self, tag: str, attributes: str) -> None:
        if tag in _BLOCKS:
            # an open paragraph ends where a block begins, and inline elements end with it
            if self.bounds:
                inner = self.stack[self.bounds[-1]].tag
                if inner == "p" or tag == inner and tag in ("li", "tr") or tag in ("dd", "dt") and inner in ("dd", "dt"):
                    while self._pop() != inner:
                        pass
            if not self.dropped:
                self._close_block()
        elif tag == "a" and self.count.get("a"):
            while self._pop() != "a":
                pass
        part, left_out = None, tag in _DROPPED or (tag == "header" and not self.article)
        if not left_out and tag not in ("html", "body") and attributes and not attributes.isspace():
            if _hidden(attributes):
                left_out = True
            elif tag != "main" and _names_part(attributes, self.article > 0):
                part, left_out = len(self.parts), len(self.parts) not in self.layout
                self.parts.append(_Part(self.open_parts[-1] if self.open_parts else None, -self.weight))
        if left_out and not self.dropped and tag not in _BLOCKS:
            self._add(" ")
        self._push(tag, left_out, part)

    def _read(self, page: str) -> None:
        at = 0
        while True:
            found = _TAG.search(page, at)
            if not found:
                self._add(page[at:])
                break
            self._add(page[at:found.start()])
            at = found.end()
            if found.group(2) is None:
                continue
            tag, attributes = found.group(2).lower(), found.group(3)
            if found.group(1):
                self._end(tag)
                continue
            if tag in _SPACES:
                self._add(" ")
            if tag in _VOID:
                if tag == "hr" and not self.dropped:
                    self._close_block()
            elif tag in _RAW:
                end = _RAW_END[tag].search(page, at)
                at = end.end() if end else len(page)
            elif tag in _BLOCKS or not attributes.endswith("/"):
                self._begin(tag, attributes)
        self._close_block()
        while self.stack:
            self._pop()


def _linked(block: Block) -> bool:
    return block.link_chars > MAX_LINK_SHARE * len(block.text.replace(" ", ""))


def _stops(block: Block) -> tuple[int, int]:
    """Stop words and words of a block; where words are not set apart, letters are words."""
    words = _WORD.findall(block.text.lower())
    return sum(w in STOP_WORDS for w in words), max(len(words), sum(map(len, words)) // 15)


def known_language(page: list[Block]) -> bool:
    """Whether the stop words explain the running text of a page; true if it has none."""
    found = [_stops(b) for b in page if len(b.text) >= LONG and not _linked(b)]
    return sum(s for s, _ in found) >= KNOWN_SHARE * sum(n for _, n in found)


def _other_script(text: str) -> bool:
    letters = [c for c in text if c.isalpha()]
    return 2 * sum(c > "\u024f" for c in letters) > len(letters)


def first_label(block: Block, known: bool = True) -> Optional[bool]:
    """Good, bad, or undecided by the block's own text; ``known``: the page's language is."""
    if _linked(block):
        return None if block.in_article else False
    if len(block.text) < LONG:
        return None
    stops, words = _stops(block)
    if words and stops >= MIN_STOP_SHARE * words:
        return True
    if not known and words:
        return True
    return None if block.in_article or _other_script(block.text) else False


def labels(page: list[Block]) -> list[bool]:
    """Both passes."""
    known = known_language(page)
    first = [first_label(b, known) for b in page]

    def nearest(same_section: bool) -> list[Optional[bool]]:
        """Per block the label of the nearest decided one; good wins ties."""
        best: list[tuple[int, bool]] = [(1 << 60, False)] * len(page)
        for order in (range(len(page)), range(len(page) - 1, -1, -1)):
            seen: dict[bool, tuple[int, bool]] = {}
            for i in order:
                section = page[i].in_article if same_section else True
                if section in seen:
                    where, label = seen[section]
                    if (abs(i - where), not label) < (best[i][0], not best[i][1]):
                        best[i] = (abs(i - where), label)
                if first[i] is not None:
                    seen[section] = (i, first[i])
        return [label if gap < 1 << 60 else None for gap, label in best]

    near, anywhere = nearest(True), nearest(False)
    out = []
    for block, own, section, whole in zip(page, first, near, anywhere):
        if own is not None:
            out.append(own)
        elif section is not None:
            out.append(section)
        elif block.in_article or whole is None:
            out.append(block.in_article)
        else:
            out.append(whole)
    return out


def main_text(page: Optional[str]) -> str:
    """Good blocks of a page in order, joined by two line feeds."""
    if not page:
        return ""
    found = blocks(page)
    return "\n\n".join(b.text for b, good in zip(found, labels(found)) if good)


def extract(df: DataFrame, page: str = "html") -> DataFrame:
    """Every row with ``text``, the main text of its page, and ``n_chars``."""
    bound_batches(df.sparkSession)

    @F.pandas_udf("string")
    def text_of(pages: pd.Series) -> pd.Series:
        return pages.map(main_text, na_action=None)

    name = free_name(df, "found")
    found = df.withColumn(name, text_of(F.coalesce(F.col(f"`{page}`"), F.lit(""))))
    return replacing(found, {"text": F.col(name), "n_chars": F.length(name).cast("bigint")}, keep=df.columns)
