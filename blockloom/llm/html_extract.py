"""Main text of web pages by site style trees.

The pages of a host are merged into one tree. Its nodes are the block elements by their chain of tags and classes; a node knows the
sequences of children that it has on the pages, its presentations, and the texts, words, links and images that are
its content there. Importance comes from entropy over the pages:

* of a content node (one text at one style node): 1 - log n / log m, if n of the node's m pages have it;
* of a style node's own content: 1 less the mean entropy of its words, links and images over its pages, so 0 if all pages have the same, 1 if
  each has its own;
* of its presentations: their entropy, which has the more weight the more there are;
* of a branch: all of these, from the leaves up, each child by the number of pages that have it.

What little a node's importance falls short of 1 on few pages proves nothing, so the lack is weighted by the number of pages. A branch goes if it lacks
RATIO times what the host's main content lacks, that of most words of importance, or more; what pages declare as
article goes only if it is of hardly any importance, and so does a content node. What the standard's own elements
and roles mark as menus, forms and so on has no importance by declaration. A class name that is common for adverts,
comments and so on lowers a node's importance to its share of the page's text, so that it goes unless it holds most of
the text; articles are not lowered. Where the articles that a page marks hold most of what is left, they are the text.

Pages are parsed once, and their blocks and style nodes written. The features go to the counts as packed arrays, by hash, so a host's or a word's many pages are few rows.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockloom.llm.common import checkpointed, looked_up, written
from blockloom.llm.hashing import mixed

#: The importance below which a content node goes, and articles do.
LEAST_IMPORTANCE = 0.05
#: A branch goes if it lacks so many times the importance that the host's main content lacks, or more, and so much at least.
RATIO, FLOOR = 2.0, 0.05
#: A lack of importance counts by 1 - m ** -EVIDENCE on m pages; a node's children count by GAMMA to the power of its presentations but one.
EVIDENCE, GAMMA = 1.3, 0.9
#: Low nodes and texts up to which their list is broadcast, and entries that a task adds up at a time.
BROADCAST_LOW, HELD = 200_000, 2_000_000
#: Open elements of a page, block elements around a style node and style nodes of a page at most. What lies deeper, or comes after so many, is
#: part of the style node around it: its text is a block all the same. So a page's entries are bounded, whatever its markup.
OPEN, DEPTH, NODES = 5_000, 64, 20_000
#: Pages whose entries are made at once.
AT_ONCE = 512

# Names of elements of the HTML standard, of ARIA roles, and words in the wild's class names.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title iframe noscript xmp noembed noframes".split())
FOREIGN = {"svg", "math"}  # where elements are never raw and may close themselves
SILENT = set("nav footer aside form button select dialog template svg canvas object head menu option datalist".split()) | RAW
IN_HEAD = set("base basefont bgsound head link meta noframes noscript script style template title".split())
BLOCKS = set("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split())
CLOSES_P = BLOCKS - set("body br caption dd dt head html legend li summary tbody td tfoot th thead title tr".split())
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
ROLES = set("navigation banner complementary contentinfo search form alert alertdialog dialog menu menubar toolbar".split())
NOISE = set("ad ads advert adverts advertisement advertisements advertising adsense adbox adslot banner banners sponsor sponsors sponsored promo promos promotion cookie cookies consent gdpr notice notices nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars sidenav masthead footer comment comments commentlist reply replies respond disqus share sharing social related recommended recommendations newsletter subscribe subscription signup login popup modal overlay widget widgets pagination pager toolbar alert alerts announcement announcements toast paywall skip adsbygoogle".split())
COMMENTS = set("comment comments commentlist reply replies respond disqus".split())
NOT_AFTER = set("no has with without hide is".split())

_TOKEN = re.compile(r"[^<]+|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<!--.*?(?:-->|\Z)|<[!?][^>]*>|<", re.S)
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>")
_NAME_END, _SPECIAL = re.compile(r"[\s/>]"), re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"([^\s=/\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Where a raw element ends; in scripts, also what opens and ends a comment in which a script may stand.
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW - {"script"}} | {"script": re.compile(r"<!--|-->|<(/?)script(?=[\s/>])", re.I)}
_NAME_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_MAIN_ROLE = re.compile(r"\brole\s*=\s*[\"']?main\b", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text) >> 1


class Block:
    """A text of its own: all of it, what name-lowered elements leave of it, the style node it lies in, and what is declared there."""

    __slots__ = ("all", "article", "node", "noise", "parts", "text")

    def __init__(self, node: int, noise: bool, article: bool, parts: list[tuple[str, int]]) -> None:
        self.node, self.noise, self.article, self.parts = node, noise, article, parts
        self.all = " ".join("".join(part for part, _ in parts).split())
        self.text = self.all

    def place(self) -> int:
        """The content node: the text at its style node."""
        return _digest(f"{self.node} {self.all}")


#: What is declared of a style node: noise, article, or that it is the page itself and no branch.
NOISE_NODE, ARTICLE_NODE, PAGE_NODE = 1, 2, 4


class Style:
    """A style node on one page: the one around it, what it declares, its presentations, and its links and images."""

    __slots__ = ("declared", "depth", "links", "node", "shows", "up")

    def __init__(self, node: int, up: Style | None, declared: int) -> None:
        self.node, self.up, self.declared = node, up, declared
        self.depth: int = up.depth + 1 if up else 0
        self.shows: set[int] = set()  # digests of sequences of children; 0 has none
        self.links: list[str] = []

    @property
    def above(self) -> tuple[int, ...]:
        """Itself and those around it, from the inside out."""
        out, at = [], self
        while at:
            out.append(at.node)
            at = at.up
        return tuple(out)


class _Tags:
    """The tags of a page, each found in time of its own length.

    A tag ends at the first > outside quotes, and is none if there is no such. Whether there is one is looked at by trying; once
    that has failed, which may take the whole page, it is worked out for all places at once, from the page's end.
    """

    def __init__(self, page: str) -> None:
        self.page, self.last, self.name_end = page, page.rfind(">"), -1
        self.specials: list[int] | None = None
        self.ends: list[bool] = []

    def match(self, at: int) -> re.Match | None:
        """The tag that begins at a place, if it ends anywhere."""
        if at > self.last:
            return None
        if self.specials is None:
            if m := _TAG.match(self.page, at):
                return m
            self.look()
        if self.name_end <= at:
            m = _NAME_END.search(self.page, at)
            self.name_end = m.start() if m else len(self.page)
        k = bisect_left(self.specials, self.name_end)
        return _TAG.match(self.page, at) if k < len(self.ends) and self.ends[k] else None

    def look(self) -> None:
        """Of each >, " and ', whether a > outside quotes follows for one who comes to it outside quotes."""
        at = self.specials = [m.start() for m in _SPECIAL.finditer(self.page)]
        self.ends = [False] * len(at)
        later = {"'": -1, '"': -1}  # the next of its kind
        for k in range(len(at) - 1, -1, -1):
            c = self.page[at[k]]
            if c == ">":
                self.ends[k] = True
            else:
                twin = later[c]
                self.ends[k] = 0 <= twin < len(at) - 1 and self.ends[twin + 1]
                later[c] = k


#: What an element's names say of it.
PLAIN, NAMED, COMMENT = range(3)


def _silent(tag: str, attributes: str, in_article: bool) -> tuple[bool, int, str]:
    """Whether an element is noise by what it declares, whether its names say so, and its class for the style path."""
    if not attributes.strip():
        return tag in SILENT or tag == "header" and not in_article, PLAIN, ""
    found = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes)}
    style = found.get("class", "")
    if tag in SILENT or tag == "header" and not in_article or "hidden" in found or found.get("aria-hidden") == "true" or _HIDDEN.search(found.get("style", "")):
        return True, PLAIN, style
    if found.get("role", "").lower() in ROLES:
        return True, PLAIN, style
    if tag not in ("html", "body", "main", "article") and found.get("role", "").lower() not in ("main", "article"):
        for name in (*style.split(), found.get("id", "")):
            words = [w.lower() for w in _NAME_WORDS.findall(name)]
            for k, w in enumerate(words):
                if (w in NOISE or w == "header" and not in_article) and NOT_AFTER.isdisjoint(words[:k]):
                    return False, COMMENT if w in COMMENTS else NAMED, style
    return False, PLAIN, style


def _raw_end(page: str, tag: str, at: int, tags: _Tags) -> int:
    """Where the raw element whose content begins at a place is over: behind its end tag, or the page's end.

    A script in a comment of a script has an end tag of its own, as the standard has it.
    """
    find = _RAW_END[tag].search
    comment = inner = False
    while m := find(page, at):
        at = m.end()
        if tag != "script" or m[1] and not inner:
            end = tags.match(m.start())
            return end.end() if end else m.start() + 1 if m.start() < tags.last else len(page)
        if m[0] == "-->":
            comment = inner = False
        elif m[0] == "<!--":
            comment, at = True, at if comment else at - 2  # its dashes may end it
        else:
            inner = comment and not m[1]
    return len(page)


class _Open:
    """An open element; kids are the styles of the block elements and texts in it, repeats left out."""

    __slots__ = ("article", "block", "kids", "low", "noise", "node", "tag")

    def __init__(self, tag: str, node: int, block: bool, noise: bool, article: bool, low: int) -> None:
        self.tag, self.node, self.block, self.noise, self.article, self.low = tag, node, block, noise, article, low
        self.kids: list[str] | None = [] if block else None

    def has(self, kid: str) -> None:
        if self.kids[-1:] != [kid]:
            self.kids.append(kid)


class _Stack(list):
    """The open elements of a page, with the places of those of each name, of blocks and of blocks but paragraphs."""

    def __init__(self, top: _Open) -> None:
        super().__init__([top])
        self.places: dict[str, list[int]] = {}
        self.blocks, self.solid, self.foreign = [0], [0], 0

    def push(self, e: _Open) -> None:
        k, tag = len(self), e.tag
        if tag in self.places:
            self.places[tag].append(k)
        else:
            self.places[tag] = [k]
        if e.block:
            self.blocks.append(k)
            if tag != "p":
                self.solid.append(k)
        elif tag in FOREIGN:
            self.foreign += 1
        self.append(e)

    def cut(self, k: int) -> None:
        """Take away the elements from place k on."""
        while len(self) > k:
            e = self.pop()
            if e.tag:
                self.places[e.tag].pop()
            if e.block:
                self.blocks.pop()
                if e.tag != "p":
                    self.solid.pop()
            elif e.tag in FOREIGN:
                self.foreign -= 1

    def innermost(self, tags: Iterable[str]) -> int:
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=0)


def _weighed(blocks: list[Block], around: list[tuple[int, int, bool]]) -> None:
    """Take from the blocks' texts the elements whose names lower them, but for those with most of the text.

    around has for each such element, by number, the one around it, what its names say and whether an article is around it;
    number 0 is the page. Where an article has text that no names lower, those outside it go whatever their size, and comments inside it
    too, unless an article of their own is in them.
    """
    if len(around) == 1:
        return
    size, gone, articles = [0] * len(around), [False] * len(around), [False] * len(around)
    for b in blocks:
        for part, low in b.parts if not b.noise else ():
            n = sum(map(len, part.split()))
            size[low] += n
            articles[low] |= b.article and n > 0
    marked = articles[0]
    for k in range(len(around) - 1, 0, -1):
        size[around[k][0]] += size[k]
        if not around[k][2]:
            articles[around[k][0]] |= articles[k]
    for k in range(1, len(around)):
        up, says, inside = around[k]
        gone[k] = gone[up] or 2 * size[k] <= size[0] or marked and (says == COMMENT if inside else not articles[k])
    for b in blocks:
        b.text = " ".join("".join(part for part, low in b.parts if not gone[low]).split())


def parsed(page: str, site: str = "") -> tuple[list[Block], dict[int, Style]]:
    """The page's blocks of text, and its style nodes in the site's tree, in time of the page's length.

    Elements left open end where the standard ends them: the head before what it may not hold, paragraphs before
    blocks, items before items, and everything else with the element around it. Inline elements are part of the block around them;
    inline ones that are noise by declaration, and raw elements, have no text. What looks like a tag but never ends is text, or
    nothing where no > follows; an end tag of nothing open is passed over; of elements nested deeper than OPEN only the text counts.
    """
    blocks: list[Block] = []
    top = _digest(site)
    styles = {top: Style(top, None, PAGE_NODE)}
    stack = _Stack(_Open("", top, True, False, False, 0))
    text, seen = [], []
    lows: list[tuple[int, int, bool]] = [(0, PLAIN, False)]
    too_deep: Counter = Counter()

    def end_block() -> None:
        around = stack[stack.blocks[-1]]
        if text:
            b = Block(around.node, around.noise, around.article, text.copy())
            if b.all:
                blocks.append(b)
                around.has("#text")
            text.clear()
        if seen:
            styles[around.node].links.extend(seen)
            seen.clear()

    def close(k: int) -> None:
        """Close the element at place k and all inside it."""
        if (text or seen) and stack.blocks[-1] >= k:
            end_block()
        for e in stack[k:]:
            if e.block:
                styles[e.node].shows.add(_digest(" ".join(e.kids)) if any(x != "#text" for x in e.kids) else 0)
        stack.cut(k)

    def shown(token: str) -> None:
        if stack[-1].tag == "head" and not token.isspace():
            close(len(stack) - 1)
        e = stack[-1]
        if e.block or not e.noise or stack[stack.blocks[-1]].noise:
            text.append((html.unescape(token) if "&" in token else token, e.low))

    def begun(tag: str, attributes: str) -> bool:
        """Open an element; whether it is a raw one, whose content is no markup."""
        block = tag in BLOCKS
        if block and (text or seen):
            end_block()
        if tag in CLOSES_P and (p := places.get("p")) and p[-1] > stack.solid[-1]:
            close(p[-1])
        elif tag in ENDED_BY and (k := stack.innermost(ENDED_BY[tag])) > stack.innermost(SCOPES[tag]):
            close(k)
        if stack[-1].tag == "head" and tag not in IN_HEAD:
            close(len(stack) - 1)
        up = stack[-1]
        foreign = stack.foreign > 0 and (tag in RAW or attributes.endswith("/"))
        if tag in RAW and not foreign:
            return True
        if tag in ("a", "img"):
            seen.extend(f"{x[1].lower()}={html.unescape(x[2] or x[3] or x[4] or '')}" for x in _ATTRIBUTE.finditer(attributes) if x[1].lower() in ("href", "src"))
        if tag in VOID or foreign and attributes.endswith("/"):
            return False
        if len(stack) >= OPEN:
            too_deep[tag] += 1
            return False
        silent, named, style = _silent(tag, attributes, up.article)
        if named and not up.noise:
            lows.append((up.low, named, up.article))
        noise = up.noise or silent
        article = up.article or not noise and (tag in ("article", "main") or bool(attributes) and _MAIN_ROLE.search(attributes) is not None)
        node, kid = up.node, f"{tag}.{style}"
        if block:
            stack[stack.blocks[-1]].has(kid)
            inner = _digest(f"{up.node}>{kid}")
            if inner in styles:
                node = inner
            elif styles[up.node].depth < DEPTH and len(styles) < NODES:
                node = inner
                styles[node] = Style(node, styles[up.node], NOISE_NODE * noise | ARTICLE_NODE * article | PAGE_NODE * (tag in ("html", "body")))
        stack.push(_Open(tag, node, block, noise, article, len(lows) - 1 if named and not up.noise else up.low))
        return False

    def ended(tag: str) -> None:
        block = tag in BLOCKS
        if too_deep and too_deep[tag]:
            too_deep[tag] -= 1
            if block:
                end_block()
        elif (p := places.get(tag)) and (block or p[-1] > stack.blocks[-1]):
            close(p[-1])

    at, tags, places = 0, _Tags(page), stack.places
    while at < len(page) and tags.specials is None:
        for m in _TOKEN.finditer(page, at):
            at = m.end()
            if tag := m[2]:
                if m[1]:
                    ended(tag.lower())
                elif begun(tag := tag.lower(), m[3]):  # all is the element's text until its end tag
                    at = _raw_end(page, tag, at, tags)
                    break
            elif m[0] == "<" and (page[at : at + 1] in ("/", "!", "?") or page[at : at + 1].isascii() and page[at : at + 1].isalpha()):
                at -= 1
                tags.look()  # a tag that does not end: from here on each is looked up before it is tried
                break
            elif m[0] == "<" or m[0][0] != "<":
                shown(m[0])
    while at < len(page):
        second = page[at + 1 : at + 2]
        like = second == "/" or second.isascii() and second.isalpha()
        if page[at] != "<":
            end = page.find("<", at)
            end = end if end >= 0 else len(page)
            shown(page[at:end])
            at = end
        elif page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = end + 3 if end >= 0 else len(page)
        elif second in ("!", "?") and second:
            end = page.find(">", at)
            at = end + 1 if end >= 0 else len(page)
        elif m := tags.match(at) if like else None:
            at, tag = m.end(), m[2].lower()
            if m[1]:
                ended(tag)
            elif begun(tag, m[3]):
                at = _raw_end(page, tag, at, tags)
        elif like and at > tags.last:
            at = len(page)
        else:
            shown("<")
            at += 1
    close(0)
    _weighed(blocks, lows)
    return blocks, styles


def kept_blocks(blocks: list[Block], low: Iterable[int] = ()) -> list[Block]:
    """The blocks that are no declared noise, not low by their style node or text, and of articles only, if these hold most of that."""
    gone = set(low)
    blocks = [b for b in blocks if not b.noise and b.text and b.node not in gone and b.place() not in gone]
    article = [b for b in blocks if b.article]
    return article if 2 * sum(len(b.text) for b in article) > sum(len(b.text) for b in blocks) else blocks


def main_blocks(page: str) -> list[Block]:
    """The blocks of a page that says all there is to know of its site."""
    return kept_blocks(parsed(page)[0])


# What the tree counts, as entries (kind, node, what, n, s): a word, link or image of a node (uses, and the sum of uses on a page times
# their logarithm), a presentation (pages), a text (pages), an ancestor (pages, distance), content (pages, characters).
WORDS, SHOWS, TEXTS, ABOVE, CONTENT = range(5)
_ENTRY = np.dtype([("kind", "u1"), ("declared", "u1"), ("node", "<u8"), ("what", "<u8"), ("n", "<i8"), ("s", "<f4")])
#: Bits of a word's, link's or image's hash: two of a node are taken for one once in 10 ** 10 pairs.
WORD_BITS = 36


def _rows(kind: int, node: np.ndarray, what: object, n: object, s: object, declared: object = 0) -> np.ndarray:
    out = np.empty(len(node), _ENTRY)
    for name, column in zip(_ENTRY.names, (kind, declared, node, what, n, s), strict=True):
        out[name] = column
    return out


def entries(pages: pa.RecordBatch, known: dict[int, tuple[tuple[int, ...], int]]) -> np.ndarray:
    """The entries of pages (blocks, styles). known holds what is above a style node and declared of it, for all that were met before."""
    blocks, styles = pages.column(0), pages.column(1)
    b, s = blocks.flatten(), styles.flatten()
    page = lambda x: np.repeat(np.arange(pages.num_rows), x.value_lengths().to_numpy(zero_copy_only=False))
    node = s.field("node").to_numpy()
    for k, (x, up) in enumerate(zip(node.tolist(), s.field("parent").to_pylist(), strict=True)):  # those around come before those inside
        if x not in known:
            known[x] = (x, *(known[up][0] if up is not None else ())), s.field("declared")[k].as_py()
    # Of each block, the row of its style node on its page.
    names, of_style = np.unique(node, return_inverse=True)
    place_of = page(styles) * len(names) + of_style
    order = np.argsort(place_of)
    row = order[np.searchsorted(place_of, page(blocks) * len(names) + np.searchsorted(names, b.field("node").to_numpy()), sorter=order)]
    tokens, words, chars = [], [], []
    for text, whole in zip(b.field("text").to_pylist(), b.field("whole").to_pylist(), strict=True):
        text = text if whole is None else whole
        mine = text.split()
        tokens += mine
        words.append(len(mine))
        chars.append(len(text))
    links, shows = s.field("links"), s.field("shows")
    tokens += links.flatten().to_pylist()
    lengths = lambda x: np.repeat(np.arange(len(s)), x.value_lengths().to_numpy(zero_copy_only=False))
    owner = np.concatenate([np.repeat(row, np.array(words, np.int64)), lengths(links)]).astype(np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, tokens), np.uint64, len(tokens)) & np.uint64((1 << WORD_BITS) - 1)
    used, n = np.unique(owner << np.uint64(WORD_BITS) | hashes, return_counts=True)
    with_words = (used >> np.uint64(WORD_BITS)).astype(np.int64)
    full = np.unique(with_words)
    at = np.lexsort((b.field("place").to_numpy(), row))
    texts = np.stack([row[at], b.field("place").to_numpy()[at]])
    texts = texts[:, np.append(True, (texts[:, 1:] != texts[:, :-1]).any(axis=0))[: texts.shape[1]]]
    times = np.bincount(of_style, minlength=len(names)).tolist()
    above = [(x, w, m, k, known[x][1]) for x, m in zip(names.tolist(), times, strict=True) for k, w in enumerate(known[x][0])]
    up = np.array(above, np.int64).reshape(-1, 5)
    return np.concatenate([
        _rows(WORDS, node[with_words], used & np.uint64((1 << WORD_BITS) - 1), n, n * np.log(n)),
        _rows(SHOWS, node[lengths(shows)], shows.flatten().to_numpy(), 1, 0),
        _rows(TEXTS, node[texts[0]], texts[1], 1, 0),
        _rows(ABOVE, up[:, 0], up[:, 1], up[:, 2], up[:, 3], up[:, 4]),
        _rows(CONTENT, node[full], 0, 1, np.bincount(row, chars, len(s))[full]),
    ])


def _added(rows: np.ndarray) -> np.ndarray:
    """Entries that are alike added up; distances are not."""
    order = np.lexsort((rows["what"], rows["node"], rows["kind"]))
    rows = rows[order]
    fresh = np.ones(len(rows), bool)
    for c in ("kind", "node", "what"):
        same = rows[c][1:] == rows[c][:-1]
        fresh[1:] = ~same if c == "kind" else fresh[1:] | ~same
    first = np.flatnonzero(fresh)
    if not len(first):
        return rows
    out = rows[first]
    out["n"] = np.add.reduceat(rows["n"], first)
    out["s"] = np.where(out["kind"] == ABOVE, out["s"], np.add.reduceat(rows["s"].astype(np.float64), first))
    return out


def _packed(rows: np.ndarray) -> bytes:
    """Sorted entries, field by field and byte by byte, the hashes as differences, so that what is alike lies together."""
    planes = []
    for c in _ENTRY.names:
        values = np.diff(rows[c], prepend=np.zeros(1, _ENTRY[c])) if c == "what" else np.ascontiguousarray(rows[c])
        planes.append(values.view(np.uint8).reshape(len(rows), _ENTRY[c].itemsize).T.tobytes())
    return zstandard.ZstdCompressor(level=3).compress(b"".join(planes))


def _unpacked(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    n, at = len(raw) // _ENTRY.itemsize, 0
    out = np.empty(n, _ENTRY)
    for c in _ENTRY.names:
        kind = _ENTRY[c]
        out[c] = np.ascontiguousarray(raw[at : at + n * kind.itemsize].reshape(kind.itemsize, n).T).view(kind).ravel()
        at += n * kind.itemsize
    out["what"] = np.cumsum(out["what"])
    return out


class _Tally:
    """The entries of many pages, added up and dealt to buckets by a hash of what they count."""

    def __init__(self, bits: int) -> None:
        self.bits, self.held, self.n = bits, [], 0

    def add(self, rows: np.ndarray) -> bool:
        """Whether there are so many now that they must be dealt."""
        self.held.append(rows)
        self.n += len(rows)
        return self.n >= HELD

    def dealt(self) -> tuple[list[int], list[bytes]]:
        if not self.n:
            return [], []
        rows = _added(np.concatenate(self.held))
        self.held, self.n = [], 0
        bucket = (mixed(rows["node"] * np.uint64(0x9E3779B97F4A7C15) + rows["what"]) >> np.uint64(64 - self.bits)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        found, start = np.unique(bucket[order], return_index=True)
        return found.tolist(), [_packed(x) for x in np.split(rows[order], start[1:])]


_COUNTS = "kind int, declared int, node long, what long, n long, s double"
_COUNTS_ARROW = pa.schema([("kind", pa.int32()), ("declared", pa.int32()), ("node", pa.int64()), ("what", pa.int64()), ("n", pa.int64()), ("s", pa.float64())])


def _counted(table: pa.Table) -> pa.Table:
    """A bucket's entries added up: of words and presentations, their number and sums of logarithms for each node."""
    rows = _added(np.concatenate([_unpacked(x) for x in table["entries"].to_pylist()]))
    n, s, what = rows["n"], rows["s"].astype(np.float64), rows["what"].copy()
    declared = rows["declared"].astype(np.int64)
    words, shows = rows["kind"] == WORDS, rows["kind"] == SHOWS
    s = np.where(words, np.log(n) - s / n, np.where(shows, n * np.log(n), s))  # a word's entropy; a presentation's part of that of all
    declared = np.where(shows, what != 0, declared)  # how many presentations have children
    n = np.where(words, 1, n)
    what[words | shows] = 0
    keep = (rows["kind"] != TEXTS) | (rows["n"] > 1)
    key = np.flatnonzero(keep)
    kind, node, what = rows["kind"][key], rows["node"][key], what[key]
    new = np.ones(len(key), bool)
    new[1:] = (kind[1:] != kind[:-1]) | (node[1:] != node[:-1]) | (what[1:] != what[:-1])
    first = np.flatnonzero(new)
    total = lambda x: np.add.reduceat(x[key], first) if len(first) else x[:0]
    columns = [kind[first].astype(np.int32), total(declared).astype(np.int32), node[first].view(np.int64), what[first].view(np.int64), total(n), total(s)]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, _COUNTS_ARROW, strict=True)], schema=_COUNTS_ARROW)


def tree_bits(total: int) -> int:
    """So many bits of a hash choose a bucket of entries that it gets those of 16 million characters of text; 16 buckets at least."""
    return max(4, math.ceil(math.log2(max(1, total) / 16e6)))


def _proof(m: Column) -> Column:
    return 1 - F.pow(m, F.lit(-EVIDENCE))


def importance(counts: DataFrame) -> DataFrame:
    """A row for each style node: node, site, m (pages), declared, chars, own (of its content, or null), importance (of its branch)."""
    of = lambda kind, c: F.sum(F.when(F.col("kind") == kind, F.col(c)))
    itself = (F.col("kind") == ABOVE) & (F.col("s") == 0)
    stats = counts.where(F.col("kind") != TEXTS).groupBy("node").agg(
        F.max(F.when((F.col("kind") == ABOVE) & (F.col("s") == 1), F.col("what"))).alias("parent"), F.sum(F.when(itself, F.col("n"))).alias("m"), F.max(F.when(itself, F.col("declared"))).alias("declared"),
        F.max(F.when(F.col("kind") == ABOVE, F.struct("s", F.col("what").alias("site"))))["site"].alias("site"),
        F.coalesce(of(CONTENT, "n"), F.lit(0)).alias("with_content"), F.coalesce(of(CONTENT, "s"), F.lit(0.0)).alias("chars"),
        of(WORDS, "s").alias("entropy"), of(WORDS, "n").alias("features"), of(SHOWS, "n").alias("shown"), of(SHOWS, "s").alias("nlogn"), F.coalesce(of(SHOWS, "declared"), F.lit(0)).alias("kinds"),
    )
    stats = checkpointed(stats)
    kids = stats.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.sum("m").alias("with_kids"))
    own = F.when(F.col("features") > 0, F.when(F.col("m") < 2, 1.0).otherwise(1 - F.col("entropy") / F.col("features") / F.log("m")))
    show = F.when(F.col("shown") < 2, 1.0).otherwise((F.log("shown") - F.col("nlogn") / F.col("shown")) / F.log("shown"))
    weight = F.pow(F.lit(GAMMA), F.greatest(F.col("kinds") - 1, F.lit(0)))
    parts = F.greatest(F.coalesce("with_kids", F.lit(0)) + F.col("with_content"), F.lit(1))
    found = stats.join(kids, "node", "left").withColumn("own", own)
    found = found.withColumn("part", (1 - weight) * show + weight * F.coalesce(F.col("own") * F.col("with_content"), F.lit(0.0)) / parts).withColumn("share", F.log(weight / parts))
    found = checkpointed(found.select("node", "parent", "site", "m", "declared", "chars", "own", "part", "share"))
    # A branch's importance adds up the parts of all nodes in it, each times the shares from there up to the branch: products, taken from the root on.
    step = looked_up(found, "parent", found.select(F.col("node").alias("parent"), F.col("share").alias("of_parent")))
    step = checkpointed(step.select("node", (F.coalesce(F.col("of_parent") + F.log("m"), F.lit(0.0))).alias("log"), "part"))
    above = checkpointed(counts.where(F.col("kind") == ABOVE).groupBy("node", "what").agg(F.max("s").alias("s")).select("node", "what"))
    logs = step.select(F.col("node").alias("what"), "log")
    down = checkpointed(looked_up(above, "what", logs).groupBy("node").agg(F.sum("log").alias("down")))
    inside = above.join(down.join(step.select("node", "part"), "node"), "node").select("what", (F.col("part") * F.exp("down")).alias("x"))
    whole = inside.groupBy(F.col("what").alias("node")).agg(F.sum("x").alias("x")).join(down, "node").select("node", (F.col("x") * F.exp(-F.col("down"))).alias("importance"))
    return checkpointed(found.join(whole, "node").select("node", "site", "m", "declared", "chars", "own", F.least(F.col("importance"), F.lit(1.0)).alias("importance")))


def low_branches(counts: DataFrame, tree: DataFrame) -> DataFrame:
    """site, what: the style nodes that lie in branches of low importance, and the content nodes that are of low importance. tree is importance() of counts."""
    says = lambda bit: F.col("declared").bitwiseAND(F.lit(bit)) != 0
    best = tree.where(F.col("own").isNotNull() & ~says(NOISE_NODE)).groupBy("site").agg(F.max(F.struct((F.col("chars") * F.col("own")).alias("mass"), F.col("own").alias("own")))["own"].alias("main"))
    ruled = looked_up(tree, "site", best)
    lack = _proof(F.col("m")) * (1 - F.col("importance"))
    limit = F.when(says(ARTICLE_NODE), 1 - LEAST_IMPORTANCE).otherwise(F.least(F.greatest(F.lit(FLOOR), RATIO * (1 - F.coalesce("main", F.lit(1.0)))), F.lit(1 - LEAST_IMPORTANCE)))
    low = checkpointed(ruled.where(~says(PAGE_NODE) & (lack > limit)).select(F.col("node").alias("what"), F.lit(True).alias("low")))
    above = looked_up(counts.where(F.col("kind") == ABOVE).select("node", "what"), "what", low).where("low").select("node").distinct()
    nodes = above.join(tree.select("node", "site"), "node").select("site", F.col("node").alias("what"))
    texts = looked_up(counts.where(F.col("kind") == TEXTS).select("node", "what", "n"), "node", tree.select("node", "site", "m"))
    return nodes.unionByName(texts.where((F.col("m") > 1) & (_proof(F.col("m")) * F.log("n") / F.log("m") > 1 - LEAST_IMPORTANCE)).select("site", "what"))


_BLOCKS = pa.list_(pa.struct([("node", pa.int64()), ("place", pa.int64()), ("article", pa.bool_()), ("noise", pa.bool_()), ("text", pa.string()), ("whole", pa.string())]))
_STYLES = pa.list_(pa.struct([("node", pa.int64()), ("parent", pa.int64()), ("declared", pa.int8()), ("shows", pa.list_(pa.int64())), ("links", pa.list_(pa.string()))]))
_PAGES = (
    "site long, same long, number long, blocks array<struct<node: long, place: long, article: boolean, noise: boolean, text: string, whole: string>>, "
    "styles array<struct<node: long, parent: long, declared: tinyint, shows: array<long>, links: array<string>>>"
)


def _parse(keys: int) -> Callable:
    """Of each page, after the kept columns: its site, a digest of its text, its number, its blocks and its style nodes with something in them.

    whole is all of a block's text, where text is what name-lowered elements leave of it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            site, same, blocks, nodes = [], [], [], []
            for host, page in zip(batch.column(keys).to_pylist(), batch.column(keys + 1).to_pylist(), strict=True):
                found, styles = parsed(page or "", host)
                site.append(_digest(host))
                same.append(_digest("\n".join(b.text for b in found if not b.noise and b.text)))
                blocks.append([{"node": b.node, "place": b.place(), "article": b.article, "noise": b.noise, "text": b.text, "whole": None if b.all == b.text else b.all} for b in found])
                full: set[int] = set()
                for x in (styles[n] for n in {b.node for b in found} | {n for n, x in styles.items() if x.links}):
                    while x and x.node not in full:
                        full.add(x.node)
                        x = x.up  # noqa: PLW2901
                nodes.append([{"node": n, "parent": x.up.node if x.up else None, "declared": x.declared, "shows": list(x.shows), "links": x.links} for n, x in styles.items() if n in full])
            numbers = np.arange(number, number + len(site))
            number += len(site)
            yield pa.record_batch([*batch.columns[:keys], pa.array(site, pa.int64()), pa.array(same, pa.int64()), pa.array(numbers), pa.array(blocks, _BLOCKS), pa.array(nodes, _STYLES)], names=[*batch.schema.names[:keys], "site", "same", "number", "blocks", "styles"])

    return run


def _tallied(bits: int) -> Callable:
    """The entries of pages (blocks, styles), by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = _Tally(bits)
        send = lambda: pa.record_batch([pa.array(c, t) for c, t in zip(tally.dealt(), (pa.int64(), pa.binary()), strict=True)], names=["bucket", "entries"])
        known: dict[int, tuple[tuple[int, ...], int]] = {}
        for batch in batches:
            for k in range(0, batch.num_rows, AT_ONCE):
                if tally.add(entries(batch.slice(k, AT_ONCE), known)):
                    yield send()
        yield send()

    return run


def site_counts(read: DataFrame, bits: int) -> DataFrame:
    """The entries of all different pages of read, which _parse makes, added up. Of pages of a site with the same text the first counts.

    The numbers of the others are broadcast up to BROADCAST_LOW; more are joined, for which the pages' blocks are shuffled.
    """
    key = F.struct("site", "same")
    first = read.groupBy(key.alias("key")).agg(F.min("number").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    others = checkpointed(looked_up(read.select(key.alias("key"), "number"), "key", first).where("number <> first").select("number"))
    n = others.count()
    once = read.join(F.broadcast(others) if n <= BROADCAST_LOW else others, "number", "left_anti") if n else read
    dealt = once.select("blocks", "styles").mapInArrow(_tallied(bits), "bucket long, entries binary")
    parts = max(int(read.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return checkpointed(dealt.repartition(max(parts, min(2**bits, 4 * parts)), "bucket").groupBy("bucket").applyInArrow(_counted, _COUNTS))


def extract_main_text(pages: DataFrame, url_col: str = "url", html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The kept columns and text: a row for each page.

    Character references are decoded, white space inside a block becomes one space, blocks are joined in page
    order by one space. A null or empty page, one that has no text, and one that has only what all pages of its site
    have, gives an empty text. Pages without a host are one site. Pages of a site with the same text count once
    in the site's tree and are returned each. An empty table gives an empty result. A very long page is parsed by one task, as a row.
    """
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[A-Za-z][\w+.-]*://([^/?#]*)", 1))
    kept = [F.col(f"`{c}`").alias(f"k{n}") for n, c in enumerate(keep)]
    rows = pages.select(*kept, host.alias("host"), F.col(html_col).alias("html"))
    kinds = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keep)]), _PAGES])
    read = written(rows.mapInArrow(_parse(len(keep)), kinds), "zstd")
    chars = lambda blocks: F.aggregate(blocks, F.lit(0).cast("long"), lambda n, b: n + F.length(b["text"]))
    counts = site_counts(read, tree_bits(read.agg(F.sum(chars(F.col("blocks")))).first()[0] or 0))
    low = checkpointed(low_branches(counts, importance(counts)).groupBy("site").agg(F.collect_set("what").alias("low")))  # a site's templates, not its pages
    if (low.agg(F.sum(F.size("low"))).first()[0] or 0) <= BROADCAST_LOW:
        low = F.broadcast(low)
    gone = lambda c: F.coalesce(F.array_contains("low", c), F.lit(False))
    left = F.filter("blocks", lambda b: ~b["noise"] & (b["text"] != "") & ~gone(b["node"]) & ~gone(b["place"]))
    joined = read.drop("styles", "same", "number").join(low, "site", "left").withColumn("left", left)
    article = F.filter("left", lambda b: b["article"])
    text = F.when(2 * chars(article) > chars(F.col("left")), F.array_join(article["text"], " ")).otherwise(F.array_join(F.col("left")["text"], " "))
    return joined.select(*(F.col(f"k{n}").alias(c) for n, c in enumerate(keep)), text.alias("text"))
