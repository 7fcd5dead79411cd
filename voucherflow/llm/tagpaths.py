"""Operator 4: main text of a page by tag-path ratios.

The page is cut into blocks of text at block-level tags; each block belongs to an element with its root-to-leaf tag path. Per path, over the whole page, the length of
the text and its punctuation are added up and divided by the path's blocks; text inside links counts against a path, an ``article`` or ``main`` element
above counts for it. The two ratios are laid along the page in block order, smoothed with a Gaussian window, and fused by a product, with each other and with the path's own ratios. Paths
whose fused value reaches a share of the standard deviation select their blocks as content nodes; the others' blocks are not content.

The content root is the element that the selected weight leads down to: from the top to the heaviest child, as long as that holds most of the whole weight, and no further than an ``article`` (or ``main`` without one).
Text of the root in paths below the threshold comes back only where it belongs to the selected nodes: all but lists of links inside an article or main; elsewhere what stands
between selected nodes, headings right before the first one, and lists, tables and short blocks in the very container that holds selected nodes. At both ends of a root that is neither,
selected text right in a generic container (div, td) goes if it is far shorter than what was selected.

What cannot be article text by its element (scripts, styles, menus, headers and footers of the page, sidebars, forms) or by the words in its class,
id or role (adverts, notices, comments, shares) takes no part in the ratios. A form that wraps the page's prose is no form but a wrapper.

The scanner reads the page once from left to right and keeps what it needs of open elements by name, so its time is linear in the page's length, whatever the markup.

Defined cases: a null or empty html gives an empty text; markup that is cut off, unclosed or nested wrongly is read on as browsers
do, as far as blocks go; a tag that never ends goes, with what follows it; a link is an ``a`` with an href, up to its end tag or, where another ``a`` or nothing comes before one, to the end of its
block; a ``<`` that starts no tag is text; white space in a block becomes one space; rows that repeat come back as often.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, table

# Element names as HTML defines them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table "
    "tbody td tfoot th thead tr ul".split()
)
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
MUTED = frozenset("button select datalist template noscript".split())
SKIP = frozenset("head nav footer aside menu dialog".split())
LISTS = frozenset("ul ol dl dir table".split())
ITEMS = frozenset("li dt dd tr td th option".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
NESTS = frozenset("ul ol dl li dd dt table tbody thead tfoot tr td th caption blockquote pre figure figcaption details".split())
TOPS = frozenset(["", "html", "body"])
GENERIC = TOPS | frozenset("div td th center section fieldset form".split())
# Words in class, id and role that mark what is no article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner popup modal overlay cookie cookies consent gdpr notice notices alert "
    "nav navigation navbar menu menubar breadcrumb breadcrumbs sidebar aside complementary widget widgets related recommended recommendations share sharing social "
    "comment comments reply replies disqus respond footer contentinfo masthead header newsletter subscribe subscription signup login search toolbar pagination pager skip hidden".split()
)
COMMENTING = frozenset("ad ads advert comment comments reply replies related recommended sponsored promo".split())
LAYOUT = frozenset("sidebar aside menu nav navigation navbar footer toolbar widget hidden skip notice notices".split())
WRAPS = frozenset("with has no content main article post entry layout wrapper page".split())
HEADS = frozenset("header site-header page-header top-header global-header main-header".split())
NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
ATTR = re.compile(r"[\s/]*+([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"'][^\s>]*+)|))?+")  # a value is consumed with its name
REST = re.compile(r"[\s/]*+")
ANCHOR = re.compile(r"<(/?)a(?=[\s/>])", re.I)
STOPS = {n: re.compile(rf"</{n}(?=[\s/>])", re.I) for n in RAW}
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
SPACES = re.compile(r"\s+")
MARKING = re.compile(r"[.,;:!?…。，、；：！？]")
LONG_REFERENCE = re.compile(r"&#(?:[0-9]{9,}|[xX][0-9a-fA-F]{9,});?")
CLOSES_P = BLOCKS - {"br", "option", "optgroup", "legend", "caption", "body", "html", "head"}


def _decoded(piece: str) -> str:
    """Character references decoded; numbers too long for any character as U+FFFD."""
    return html.unescape(LONG_REFERENCE.sub("�", piece)) if "&" in piece else piece


def _marked(name: str, attributes: dict[str, str], inside: bool) -> bool:
    """Whether the element's attributes say that it is no article text; ``inside``: it stands in an article."""
    if name in ("html", "body"):
        return False
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true":
        return True
    if name == "main":
        return False
    for attribute in ("class", "id", "role"):
        if value := attributes.get(attribute):
            words = {w.lower() for w in WORDS.findall(value)}
            found = words & (COMMENTING if name == "article" else MARKS)
            if found - LAYOUT or (found and not words & WRAPS) or (not inside and value.lower() in HEADS):
                return True
    return False


class Page:
    """Elements (parent before child; 0 is the document) and the blocks of text in page order."""

    def __init__(self, page: str):
        self.name, self.parent, self.path, self.fit, self.inside, self.form = [""], [0], [0], [True], [False], [0]
        self.paths: dict[tuple[int, str], int] = {}
        self.blocks: list[tuple[int, str, float]] = []  # element, text, share of it inside links
        self._open: list[tuple[str, int, bool]] = [("", 0, False)]  # name, element, whether it is muted
        self._at: dict[str, list[int]] = defaultdict(list)  # by name: places among the open ones
        self._block, self._bar, self._list = [0], [0], [0]  # places of blocks; of article, main and body; of lists
        self._muted = 0
        self._text: list[str] = []
        self._linked = 0
        self._links = self._unclosed = False
        self._scan(page)

    def _add(self, piece: str) -> None:
        if not self._muted:
            self._text.append(piece)
            if self._links:
                self._linked += len(piece)

    def _flush(self) -> None:
        if self._text:
            size = sum(map(len, self._text))
            text = SPACES.sub(" ", "".join(map(_decoded, self._text))).strip()
            if text:
                self.blocks.append((self._open[self._block[-1]][1], text, self._linked / max(1, size)))
            self._text.clear()
        self._linked = 0

    def _pop(self, to: int) -> None:
        """Closes all open elements from this place on."""
        while len(self._open) > to:
            name, _, muted = self._open.pop()
            place = len(self._open)
            self._muted -= muted
            self._at[name].pop()
            for places in (self._block, self._bar, self._list):
                if places[-1] == place:
                    places.pop()

    def _push(self, name: str, attributes: dict[str, str]) -> None:
        if name in CLOSES_P and self._open[self._block[-1]][0] == "p":
            self._pop(self._block[-1])
        if name in ITEMS and self._at[name] and self._at[name][-1] > self._list[-1]:
            self._pop(self._at[name][-1])
        up = self._open[-1][1]
        place, block = len(self._open), name in BLOCKS
        inside = self.inside[up]
        marked = bool(attributes) and _marked(name, attributes, inside)
        muted = name in MUTED or (not block and ("hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true"))
        skip = name in SKIP or (name == "header" and not inside) or marked
        new = len(self.name)
        self.name.append(name)
        self.parent.append(up)
        self.path.append(self.paths.setdefault((self.path[up], name), len(self.paths) + 1) if block else self.path[up])
        self.fit.append(self.fit[up] and not skip)
        self.inside.append(inside or name in ("article", "main"))
        self.form.append(self.form[up] or (new if name == "form" else 0))
        self._open.append((name, new, muted))
        self._at[name].append(place)
        self._muted += muted
        if block:
            self._block.append(place)
        if name in ("article", "main", "body"):
            self._bar.append(place)
        if name in LISTS:
            self._list.append(place)

    def _close(self, name: str) -> None:
        if not self._at[name]:
            return
        place = self._at[name][-1]
        if name in BLOCKS:
            if place < self._bar[-1] and name not in ("body", "html", "article", "main"):
                return  # a stray end tag closes nothing outside
        elif place < self._block[-1]:
            return  # an inline element does not end the blocks in it
        self._pop(place)

    def _scan(self, page: str) -> None:
        at, end, anchors = 0, len(page), True
        while at < end:
            start = page.find("<", at)
            if start < 0:
                self._add(page[at:])
                break
            if start > at:
                self._add(page[at:start])
            at = start + 1
            kind = page[at : at + 1]
            if kind in ("!", "?") or (kind == "/" and not NAME.match(page, at + 1)):
                stop, size = (page.find("-->", at + 1), 3) if page.startswith("!--", at) else (page.find(">", at), 1)
                if stop < 0:
                    break
                at = stop + size
                continue
            closing = kind == "/"
            m = NAME.match(page, at + closing)
            if m is None:
                self._add("<")
                continue
            name, at = m[0].lower(), m.end()
            attributes: dict[str, str] = {}
            closed = False
            if page[at : at + 1] != ">":
                while m := ATTR.match(page, at):
                    at = m.end()
                    if not closing:
                        attributes.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
                before, at = at, REST.match(page, at).end()
                if at >= end:
                    break  # a tag that is cut off
                closed = at > before and page[at - 1] == "/"  # a slash right after an unquoted value is part of that
            at += 1
            if name in BLOCKS:
                self._flush()
                self._links = self._links and not self._unclosed
            if name == "a":
                self._links = not closing and not closed and "href" in attributes
                if self._links:
                    after = ANCHOR.search(page, at) if anchors else None
                    anchors = after is not None
                    self._unclosed = after is None or not after[1]
            elif closing:
                self._close(name)
            elif name in VOID or closed:
                continue
            elif name in RAW:
                after = STOPS[name].search(page, at)
                at = page.find(">", after.start()) + 1 if after else 0
                if not at:
                    break
            else:
                self._push(name, attributes)
        self._flush()


def blocks(page: str) -> Iterator[tuple[int, bool, str, float]]:
    """(path, whether it may be article text, text, share of it inside links) of every block that has text, in page order."""
    read = Page(page)
    for element, text, share in read.blocks:
        yield read.path[element], read.fit[element], text, share


def _without_forms(page: Page, found: list[tuple[int, str, float]], most_links: float) -> list[tuple[int, str, float]]:
    """The blocks outside forms, and those in a form that holds the page's article, or most of its prose where no article is elsewhere."""
    prose: dict[int, int] = defaultdict(int)
    article: set[int] = set()
    for e, text, share in found:
        f = page.form[e]
        if len(text) >= 50 and share <= most_links:
            prose[f] += len(text)
        if page.inside[e] and not (f and page.inside[f]):
            article.add(f)
    whole = sum(prose.values())
    wraps = {f for f in {*prose, *article} if f and (f in article or (0 not in article and prose[f] >= 200 and 2 * prose[f] > whole))}
    return [b for b in found if not page.form[b[0]] or page.form[b[0]] in wraps]


def path_values(page: Page, found: list[tuple[int, str, float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each block: its path's number, and by that number the fused value and the share of links."""
    _, path = np.unique([page.path[e] for e, *_ in found], return_inverse=True)
    length = np.array([len(t) for _, t, _ in found], float)
    marks = np.array([len(MARKING.findall(t)) for _, t, _ in found], float)
    share = np.array([s for *_, s in found])
    inside = np.array([page.inside[e] for e, *_ in found])
    n = np.bincount(path)
    total = np.bincount(path, length)
    linked = np.bincount(path, length * share) / total
    prior = (1 - linked) * np.where(np.bincount(path, inside) > 0, 10.0, 1.0)
    ratio = np.stack([total / n, np.bincount(path, marks) / n])
    k = np.exp(-0.5 * np.arange(-2, 3) ** 2)
    weight = np.convolve(np.ones(len(path)), k)[2:-2]
    smooth = np.stack([np.convolve(r[path], k)[2:-2] / weight for r in ratio])
    smoothed = np.bincount(path, smooth[0] * (1 + smooth[1])) / n
    return path, np.sqrt(ratio[0] * (1 + ratio[1]) * smoothed) * prior, linked


def _root(page: Page, found: list[tuple[int, str, float]], weight: np.ndarray, beside: float) -> int:
    """The element that the weight leads down to."""
    of = np.zeros(len(page.name))
    np.add.at(of, [e for e, *_ in found], weight)
    heaviest: dict[int, int] = {}
    parent = page.parent
    for e in range(len(parent) - 1, 0, -1):
        of[parent[e]] += of[e]
        if of[e] > 0 and (parent[e] not in heaviest or of[e] >= of[heaviest[parent[e]]]):
            heaviest[parent[e]] = e
    chain = [0]
    while (child := heaviest.get(chain[-1])) is not None and of[child] * (1 + beside) >= of[0]:
        chain.append(child)
    for name in ("article", "main"):
        for e in chain:
            if page.name[e] == name:
                return e
    return chain[-1]


def main_text(html_text: str, share: float = 0.5, beside: float = 0.2, most_links: float = 0.6, short: float = 0.3) -> str:
    page = Page(html_text)
    found = _without_forms(page, [b for b in page.blocks if page.fit[b[0]]], most_links)
    if not found:
        return ""
    path, value, linked = path_values(page, found)
    spread = value[path]
    content = ((value >= min(share * spread.std(), value.max())) & (linked <= most_links))[path]
    if not content.any():
        content = np.array([page.inside[e] for e, *_ in found])
        if not content.any():
            return ""
    root = _root(page, found, np.where(content, np.maximum(spread, 1e-9) * [len(t) for _, t, _ in found], 0.0), beside)
    below = np.zeros(len(page.name), bool)
    below[root] = True
    for e in range(root + 1, len(page.name)):
        below[e] = below[page.parent[e]]
    at = [i for i, (e, *_) in enumerate(found) if below[e] and (linked[path[i]] <= most_links or (content[i] and page.name[root] == "article"))]
    if not page.inside[root]:
        at = _belonging(page, found, at, content, short)
    return "\n".join(found[i][1] for i in at)


def _belonging(page: Page, found: list[tuple[int, str, float]], at: list[int], content: np.ndarray, short: float) -> list[int]:
    """Of the root's blocks: the selected ones, cut at both ends, and what belongs to them."""
    chosen = [i for i in at if content[i]]
    own = {i: (1 - found[i][2]) * len(found[i][1]) * (1 + len(MARKING.findall(found[i][1]))) for i in chosen}
    least = short * float(np.median(list(own.values())))
    trims = lambda i: page.name[found[i][0]] in GENERIC and own[i] < least
    while chosen and trims(chosen[0]):
        del chosen[0]
    while chosen and trims(chosen[-1]):
        chosen.pop()
    if not chosen:
        return []
    holders = {page.parent[found[i][0]] for i in chosen if page.name[found[i][0]] not in GENERIC}
    known: dict[int, bool] = {}  # so that no element is climbed over twice

    def held(e: int) -> bool:
        way = []
        while (answer := known.get(e)) is None:
            way.append(e)
            nested = page.name[e] in NESTS or page.name[e] in ("p", *HEADINGS)
            e = page.parent[e] if nested else e
            if e in holders or not nested:
                answer = e in holders and page.name[e] not in TOPS
                break
        known.update(dict.fromkeys(way, answer))
        return answer

    first, last = chosen[0], chosen[-1]
    before = [i for i in at if i < first]
    heads: list[int] = []
    for i in reversed(before):
        if page.name[found[i][0]] not in HEADINGS:
            break
        heads.append(i)
    ends = set(heads) | {i for i in at if (i < first or i > last) and not content[i] and held(found[i][0])}
    return sorted({i for i in at if first <= i <= last} | ends)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = [main_text(x or "") for x in batch["html"].to_pylist()]
        yield pa.record_batch([batch["page_id"], batch["url"], pa.array(text, pa.string()), pa.array(list(map(len, text)), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    return pick(pages, "page_id", "url", "html").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))
