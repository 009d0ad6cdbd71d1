"""Main text of web pages by tag-path ratios.

A page is read once into blocks of text, each with its path of tags from the root. Parts that are never article text
(scripts, navigation, forms, and elements whose class, id or role names an advert, a notice, comments and the like)
are left out with all that is in them; forms and elements left out for their class or id are read nevertheless if they
turn out to wrap the content. The other blocks are pooled by path: characters outside links and punctuation
marks per block, averaged over all blocks of the path. A path's ratios are smoothed with those of the paths beside it
in page order, and fused with the share of the page's text that the best container around it holds, so that headings,
short paragraphs, lists, tables and captions stand with the article around them. Paths below a share of the best are
dropped, whole.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Set
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenspark.llm.common import numbered_columns

#: Elements without content, elements left out with their content, elements that do not end a block of text, and what
#: the opening of an element closes if it is open (up to the nearest of the third group).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LEFT_OUT = frozenset(
    "head title script style noscript template nav header footer aside button select textarea option menu dialog "
    "iframe object svg math canvas audio video map label fieldset".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
#: Elements that can stand inside running text: left out, they leave the block around them open.
INSIDE = frozenset("script style noscript template iframe svg math button select input textarea canvas audio video object map label output meter progress datalist".split())
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "template", "svg")
CLOSED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table"}),
    "th": ({"td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPH_BARRIER = frozenset("button table td th article section div body blockquote li".split())
#: An open paragraph ends where one of these begins.
ENDS_PARAGRAPH = HEADINGS | frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form header "
    "hgroup hr main menu nav ol p pre search section summary table ul".split()
)
_NAME = (
    r"(?:ads?|adverts?|advertis\w+|adsense|banners?|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|"
    r"alerts?|popups?|modal|overlay|newsletter|subscri\w+|sidebars?|side|widgets?|menus?|nav|navbar|navigation|"
    r"breadcrumbs?|toolbar|header|masthead|footer|copyright|comments?|commentlist|respond|disqus|replies|related|"
    r"recommend\w*|share|sharing|social|tags|pagination|pager|login|signup|search)(?=$|[\s_\-\d])"
)
#: Words after a name that leave it a name, and class tokens that say how a page is laid out, not what an element is.
_ADDED = r"[_\-]?(?:wrapper|wrap|container|area|list|box|section|bar|block|items?|inner|outer|holder|group|top|bottom|left|right|content|body|links?|buttons?|form|panel|row|column|col|title|text|module|region|slot|unit|\d)"
_LAYOUT = r"(?:has|no|not|with|without|is|hide|show|js)[_\-]|\w+[_\-](?:open|closed|enabled|disabled)(?=$|\s)|content[_\-]sidebars?(?:[_\-]|$|\s)|sidebars?[_\-]content[_\-]"
#: Whole class tokens that begin with a name, or end with one.
NAMES = re.compile(rf"(?:^|(?<=\s))(?!{_LAYOUT})(?:{_NAME}|\S*[_\-]{_NAME}(?:{_ADDED})*+(?=$|\s))", re.I)
#: Names that a class token may also begin with because the text is about them, if other words than the added ones follow.
_TOPICS = r"(?:social|related|search|side|notices?|alerts?|navigation|copyright|consent|recommend\w*|share|sharing|tags|promo\w*|header|footer|login)"
TOPICAL = re.compile(rf"{_TOPICS}(?:[_\-]\w+)+$", re.I)
_WHOLLY_NAMED = re.compile(rf"{_NAME}(?:{_ADDED}|[_\-](?:posts?|articles?|stories|news|media|icons?|bar|nav|menu|us|this))*+$", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())

# Possessive repetition: a broken tag is given up at once, so the time is linear in the page.
_INSIDE = r"""(?:(?:[^<>"']++|"[^"]*+"|'[^']*+')*+>|[^<>]*+>)"""
_TOKEN = re.compile(
    r"<!--(?:-?>|.*?--!?>|.*\Z)|<[!?][^>]*>?"
    rf"|<(?P<raw>{'|'.join(RAW)})(?=[\s/>]){_INSIDE}.*?(?:</(?P=raw)\s*>|\Z)"
    rf"|<(?P<end>/)?(?P<tag>[a-zA-Z][^\s/<>]*)(?P<attributes>{_INSIDE})"
    r"|</[^a-zA-Z>][^>]*>|</>"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_SPACE = re.compile(r"[\s\x1c-\x1f]+")
_MARKS = re.compile(r"""[.,;:!?…。，！？]""")

#: The page as a whole; elements that are content with all that is in them; parts of running text, and those of them that
#: stand between paragraphs.
PAGE = frozenset(("", "html", "body"))
CONTENT = frozenset(("article", "main"))
EMBEDDED = frozenset("ul ol dl table figure pre blockquote".split())
RUNNING = EMBEDDED | HEADINGS | frozenset(("p",))

#: Weight of a punctuation mark against a character, and the fused score below which a path is dropped.
MARK_WEIGHT, LEAST_SCORE = 10.0, 0.25
#: Shares of the neighbours in the smoothed ratio, and of links in a path's characters above which it is a list of links.
NEIGHBOURS, LINK_SHARE = 0.25, 0.6


#: A path of tags: the number of its parent path and its last tag. Number 0 is the root's.
Paths = list[tuple[int, str]]


@dataclass
class Block:
    path: int
    mark: int  # the innermost mark around it, -1 for none
    content: int  # the innermost mark around the innermost article or main element around it; -2 without such an element
    pieces: list[str] = field(default_factory=list)
    linked: int = 0

    def text(self) -> str:
        return _SPACE.sub(" ", "".join(self.pieces)).strip()


#: What an element's tag and attributes say: nothing, a form or a name (left out unless the content is in it), left out. In an
#: article, its header (left out unless it holds the only main heading), and a name that may be a topic (left out unless it is prose).
PLAIN, FORM, NAMED, OUT, OWN, TOPIC = range(6)


def _kind(tag: str, attributes: str, in_article: bool) -> int:
    if tag == "header" and in_article:
        return OWN
    if tag in LEFT_OUT:
        return OUT
    kind = FORM if tag == "form" else PLAIN
    if not attributes or tag in ("html", "body"):
        return kind
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return OUT
        if name == "role" and value.lower() in ROLES:
            if value.lower() != "form":
                return OUT
            kind = max(kind, FORM)
        if name == "id" and tag in HEADINGS:
            continue  # the heading's words, as an anchor
        if name in ("class", "id") and tag not in CONTENT and NAMES.search(value):
            topical = in_article and all(TOPICAL.match(x) and not _WHOLLY_NAMED.match(x) for x in value.split() if NAMES.search(x))
            kind = TOPIC if topical and kind != NAMED else NAMED
    return kind


class _OpenTags:
    """The open elements, innermost last, and the path number of each; every step takes constant or amortised time."""

    def __init__(self) -> None:
        self.paths: Paths = [(-1, "")]
        self.known: dict[tuple[int, str], int] = {}
        self.tags: list[str] = []
        self.at: list[int] = [0]
        self.number: Counter[str] = Counter()
        self.under: list[int] = [-1]  # the innermost mark
        self.content: list[int] = [-2]  # the mark around the innermost article or main element
        self.marks: list[tuple[int, int]] = []  # the mark around each mark, and its kind
        self.out_since = -1  # how many tags were open where the outermost left-out element began

    def open(self, tag: str, kind: int) -> None:
        here = self.at[-1]
        if tag not in INLINE:
            step = (here, tag)
            if step not in self.known:
                self.known[step] = len(self.paths)
                self.paths.append(step)
            here = self.known[step]
        self.tags.append(tag)
        self.at.append(here)
        self.number[tag] += 1
        if kind in (FORM, NAMED, OWN, TOPIC):
            self.marks.append((self.under[-1], kind))
            self.under.append(len(self.marks) - 1)
        else:
            self.under.append(self.under[-1])
        self.content.append(self.under[-1] if tag in CONTENT else self.content[-1])

    def close(self, size: int) -> None:
        """Close all but the outermost ``size`` elements."""
        while len(self.tags) > size:
            self.number[self.tags.pop()] -= 1
            self.at.pop()
            self.under.pop()
            self.content.pop()
        if size <= self.out_since:
            self.out_since = -1

    def close_last(self, wanted: Set[str], barrier: Set[str]) -> None:
        """Close the innermost of the wanted elements unless a barrier is inside it."""
        if any(self.number[tag] for tag in wanted):
            for k in range(len(self.tags) - 1, -1, -1):
                if self.tags[k] in wanted:
                    return self.close(k)
                if self.tags[k] in barrier:
                    return None
        return None

    def end(self, tag: str) -> None:
        """An end tag; a stray one of an inline element does not close the blocks inside it."""
        if self.number[tag]:
            for k in range(len(self.tags) - 1, -1, -1):
                if self.tags[k] == tag:
                    return self.close(k)
                if tag in INLINE and self.tags[k] not in INLINE:
                    return None
        return None


def blocks_of(page: str) -> tuple[list[tuple[int, str, int]], Paths]:
    """(path, text, characters in links) of the page's blocks outside left-out elements, in page order; the paths."""
    stack = _OpenTags()
    found: list[Block] = []
    block: Block | None = None

    for token in _TOKEN.finditer(page):
        if token["raw"]:
            block = block if token["raw"].lower() in INSIDE else None
            continue
        if (raw := token["text"]) is not None:
            if stack.out_since >= 0:
                continue
            if block is None:
                if not raw.strip():
                    continue
                block = Block(stack.at[-1], stack.under[-1], stack.content[-1])
                found.append(block)
            text = html.unescape(raw)
            block.pieces.append(text)
            if stack.number["a"]:
                block.linked += len(text.strip())
            continue
        if not token["tag"]:
            continue
        tag, attributes = token["tag"].lower(), token["attributes"][:-1]
        out, ends_block = stack.out_since >= 0, tag not in INLINE and tag not in INSIDE
        if ends_block and not out:
            block = None
        elif tag == "br" and block is not None and not out:
            block.pieces.append(" ")
        if token["end"]:
            stack.end(tag)
            if out and stack.out_since < 0 and ends_block:
                block = None  # the left-out element ended with one around it
            continue
        if tag in ENDS_PARAGRAPH:
            stack.close_last({"p"}, PARAGRAPH_BARRIER)
        if tag in HEADINGS and stack.tags and stack.tags[-1] in HEADINGS:
            stack.close(len(stack.tags) - 1)
        if tag in CLOSED_BY:
            stack.close_last(*CLOSED_BY[tag])
        if tag == "a":
            stack.close_last({"a"}, PARAGRAPH_BARRIER)
        if tag in ("html", "body") and stack.number[tag] or tag in VOID:
            continue
        if attributes.endswith("/") and tag not in ENDS_PARAGRAPH | INLINE:
            continue
        if tag == "body" and stack.number["head"]:
            stack.close(stack.tags.index("head"))
        if out and stack.out_since < 0 and ends_block:
            block = None
        in_article = any(stack.number[c] for c in CONTENT)
        kind = _kind(tag, attributes, in_article) if stack.out_since < 0 else PLAIN
        if kind == OUT:
            stack.out_since = len(stack.tags)
        stack.open(tag, kind)
    read = [(b, text) for b in found if (text := b.text())]
    spared = _spared(read, stack.marks, stack.paths)
    return [(b.path, text, b.linked) for b, text in read if spared[b.mark + 1]], stack.paths


def _spared(read: list[tuple[Block, str]], marks: list[tuple[int, int]], paths: Paths) -> list[bool]:
    """For the page and each mark: is its text read? That of a mark is if it wraps the content: if no text of an article
    or main element is outside it, and it holds one with more text than there is outside, or most of the page's text
    (and, if it is marked for a name, also the only main heading, or nearly all of the text). Beside such text only a
    form with nearly all of the text is read. An article's header is read if all main headings are in it, and a part of an
    article whose name may be its topic if it is prose: few links, and a punctuation mark per block."""
    own, articles, titles, held, links, blocks, stops = ([0] * (len(marks) + 1) for _ in range(7))  # place 0 is the page's
    for b, text in read:
        plain = max(0, len(text) - b.linked)
        own[b.mark + 1] += plain
        titles[b.mark + 1] += paths[b.path][1] == "h1"
        links[b.mark + 1] += min(b.linked, len(text))
        blocks[b.mark + 1] += 1
        stops[b.mark + 1] += len(_MARKS.findall(text))
        if b.content > -2:
            articles[b.mark + 1] += plain * (paths[b.path][1] not in HEADINGS)
            held[b.content + 1] += plain
    total, all_titles, all_held = own[:], titles[:], held[:]
    for k in range(len(marks), 0, -1):  # a mark comes after the one around it
        for sums in (total, all_titles, all_held, links, blocks, stops):
            sums[marks[k - 1][0] + 1] += sums[k]
    outside, spared = [own[0], articles[0], titles[0]], [True] + [False] * len(marks)
    for k, (around, kind) in enumerate(marks, 1):
        if not spared[around + 1]:
            continue
        if kind == OWN:
            if not all_titles[k] or all_titles[k] != all_titles[0]:
                continue
        elif kind == TOPIC:
            if 10 * links[k] > 3 * (total[k] + links[k]) or stops[k] < blocks[k]:
                continue
        elif outside[1]:
            if kind == NAMED or 10 * outside[0] >= total[k]:
                continue
        elif all_held[k] <= outside[0]:
            titled = kind == FORM or all_titles[k] and not outside[2]
            if 2 * total[k] <= total[0] or not titled and 10 * outside[0] >= total[k]:
                continue
        spared[k] = True
        outside = [x + y[k] for x, y in zip(outside, (own, articles, titles))]
    return spared


def _shares(inside: dict[int, float], total: list[float], paths: Paths) -> tuple[list[float], list[int]]:
    """Per path: the plain text of the best container around it, and that container's path.

    A container counts with the text directly in it, an article or main element with all of its text. Everything below
    takes over its share, but from the page as a whole only parts of running text do, not further divisions. Lists,
    tables, figures and the like also count with all the text of the element that they stand in.
    """
    share, source = [0.0] * len(paths), [0] * len(paths)
    best, at = [0.0] * len(paths), [0] * len(paths)  # of the container that a path is for those below it
    share[0], best[0] = inside[-1], inside[0]
    for k in range(1, len(paths)):
        above, tag = paths[k]
        outer = paths[above][1] in PAGE
        share[k], source[k] = (best[above], at[above]) if not outer or tag in RUNNING else (inside[above], above)
        if tag in EMBEDDED and not outer and total[above] > share[k]:
            share[k], source[k] = total[above], above
        own = total[k] if tag in CONTENT else inside[k]
        begins = own > share[k] or outer and tag not in RUNNING
        best[k], at[k] = (own, k) if begins else (share[k], source[k])
    return share, source


def kept_paths(blocks: list[tuple[int, str, int]], paths: Paths) -> set[int]:
    """Paths of the content: those whose fused score is a fair share of the best, but for lists of links. In an article, links
    of a numbered list, or with two punctuation marks each, are references and stay."""
    chars: dict[int, float] = defaultdict(float)
    marks: dict[int, float] = defaultdict(float)
    linked: dict[int, float] = defaultdict(float)
    number: dict[int, int] = defaultdict(int)
    inside: dict[int, float] = defaultdict(float)
    total = [0.0] * len(paths)
    order: list[int] = []  # paths in page order, runs of one path once
    cited: dict[int, float] = defaultdict(float)
    for path, text, in_links in blocks:
        plain = max(0, len(text) - in_links)
        chars[path] += plain
        stops = len(_MARKS.findall(text))
        marks[path] += stops if plain else 0
        cited[path] += stops
        linked[path] += min(in_links, len(text))
        number[path] += 1
        inside[paths[path][0]] += plain
        total[path] += plain
        if not order or order[-1] != path:
            order.append(path)
    for k in range(len(paths) - 1, 0, -1):  # a path comes after its parent
        total[paths[k][0]] += total[k]
    share, source = _shares(inside, total, paths)
    ratio = {p: (chars[p] + MARK_WEIGHT * marks[p]) / number[p] for p in number}
    beside: dict[int, list[float]] = defaultdict(list)
    for a, b in zip(order, order[1:]):
        if paths[a][0] == paths[b][0] or source[a] == source[b]:  # only within one element or container
            beside[a].append(ratio[b])
            beside[b].append(ratio[a])
    smooth = {p: (1 - NEIGHBOURS) * r + NEIGHBOURS * (sum(x) / len(x) if (x := beside[p]) else r) for p, r in ratio.items()}
    best, most = max(smooth.values(), default=0.0), max((share[p] for p in number), default=0.0)
    if not best or not most:
        return set()
    fused = {p: 0.5 * smooth[p] / best + 0.5 * share[p] / most for p in number}
    least = LEAST_SCORE * max(fused.values())

    def references(path: int) -> bool:
        p, around = path, set()
        while p > 0:
            around.add(paths[p][1])
            p = paths[p][0]
        return bool(around & CONTENT) and ("ol" in around or cited[path] >= 2 * number[path])

    return {p for p, s in fused.items() if s >= least and (linked[p] <= LINK_SHARE * (chars[p] + linked[p]) or references(p))}


def main_text(page: str | None) -> str:
    """Main text of a page: the blocks of its content paths, in page order, with an empty line between them."""
    blocks, paths = blocks_of(page or "")
    kept = kept_paths(blocks, paths)
    return "\n\n".join([text for path, text, _ in blocks if path in kept])


def extracted(pages: DataFrame, markup: str = "html") -> DataFrame:
    """``pages`` with text and n_chars, its code points, instead of the markup; whole pages, row by row.

    NULL and empty markup, and pages without content, have the empty text. Repeated rows each get theirs; columns
    named text or n_chars are replaced; an empty table gives none.
    """

    @F.pandas_udf("string")
    def text_of(column: pd.Series) -> pd.Series:
        return pd.Series([main_text(x) for x in column], dtype=object)

    inner, (m,) = numbered_columns(pages, markup)
    kept = [k for k, c in enumerate(pages.columns) if f"c{k}" != m and c.lower() not in ("text", "n_chars")]
    found = inner.select(*[f"c{k}" for k in kept], text_of(F.col(m)).alias("text")).withColumn("n_chars", F.length("text").cast("bigint"))
    return found.toDF(*[pages.columns[k] for k in kept], "text", "n_chars")


def page_texts(pages: DataFrame) -> DataFrame:
    """Main text of every page."""
    return extracted(pages.select("page_id", "url", "html"))
