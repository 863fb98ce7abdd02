"""The main text of web pages by composite text density.

A page becomes a tree, as a browser would read it where tags are missing. Every node gets its link-adjusted characters per tag
(composite text density):

    density = C / T * log(C / LC * T / LT) / log(log(C / (C - LC) * LC + LC_body / C_body * C + e))

with C characters and T tags below the node, LC and LT those of links, each taken as 1 where it is 0. A node's sum is that of its
children's densities, its own text counting as a
child. The node with the largest sum is the main one; the least density on its path to the body is the threshold: other nodes at or
above it mark the largest sum below them as well.
The marked subtrees, or the article that holds the main one, are the text, without what a page marks as something else: menus,
headers, footers, sidebars, notices, adverts, forms, scripts, styles, comments of readers.

Pages are rows on their own, so nothing is shuffled; a task holds a slice of a batch at a time.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import modest

TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*>|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*>|<(?P<start>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*)>",
    re.S,
)
#: A comment that nothing ends.
COMMENT = re.compile(r"<!--.*(?P<end>(?!))?(?P<start>(?!))?\Z", re.S)
#: A tag that nothing ends.
UNENDED = re.compile(r"<[a-zA-Z/!?].*\Z", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
#: What these hold is text up to their end tag, whatever it looks like.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li listing main menu nav ol optgroup option p plaintext"
    " pre search section summary table tbody tfoot thead tr ul".split()
)
CELL = frozenset(("td", "th"))
ENDS_P = BLOCK - frozenset("body caption dd dt legend li option optgroup tbody tfoot thead tr".split())
#: A start tag ends open elements of these kinds, up to one of those.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th", "caption"), ("table",)),
    "thead": (("tbody", "thead", "tfoot", "tr", "td", "th", "caption"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot", "tr", "td", "th", "caption"), ("table",)),
    "option": (("option",), ("select", "datalist")),
    "a": (("a",), ("td", "th", "table")),
}
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
ARTICLE = frozenset(("article", "main"))

#: Elements that hold no article text, wherever they stand.
OUT = frozenset(
    "script style textarea title xmp iframe noembed noframes noscript template head nav aside footer form search dialog menu select datalist button svg canvas video audio object map applet".split()
)
OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert status form menu menubar toolbar tablist tooltip".split())
#: Words of classes and ids that say what a part of a page is for.
OUT_WORDS = frozenset(
    "ad ads adv adbox adslot adsense adunit advert adverts advertisement advertisements advertising banner banners sponsor sponsored sponsors promo promos promotion promoted dfp outbrain taboola"
    " nav navbar navigation menu menus submenu breadcrumb breadcrumbs masthead topbar footer colophon sidebar sidebars sidenav rail aside widget widgets"
    " related recommended recommendation recommendations share sharing sharebar social comment comments commentlist commentform disqus respond reply replies"
    " cookie cookies consent gdpr ccpa notice notices notification notifications alert alerts popup modal overlay lightbox paywall newsletter subscribe subscription signup signin login register"
    " pagination pager toolbar skip skiplink copyright legal form search searchbox".split()
)
#: Headings over readers' comments.
COMMENTS = re.compile(r"^\W*(?:\d+\W+)?(?:reader(?:s|'s|s')? |user )?(?:comments?|replies|responses|kommentare?|leserkommentare|commentaires?|comentarios?)\b(?:.{0,12})$", re.I | re.S)
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
WORDS = re.compile(r"[a-z]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
LABELLED = re.compile(r"class|id|role|hidden|style", re.I)


class Page:
    """A page as a tree. Nodes are numbers, parents before their children; 0 is the body. ``events`` has the page's order: (node,
    None) where one starts or ends, (node, text) for its text."""

    def __init__(self, source: str):
        self.tag: list[str] = ["body"]
        self.parent: list[int] = [-1]
        self.attrs: list[str] = [""]
        self.events: list[tuple[int, str | None]] = []
        self.open = [0]
        self.opened: Counter[str] = Counter()  # of each kind, how many are open
        self._read(source)

    def _start(self, tag: str, attrs: str) -> int:
        self.tag.append(tag)
        self.parent.append(self.open[-1])
        self.attrs.append(attrs)
        self.events.append((len(self.tag) - 1, None))
        return len(self.tag) - 1

    def _close(self, at: int) -> None:
        """The open elements from the at-th on end."""
        for node in reversed(self.open[at:]):
            self.opened[self.tag[node]] -= 1
            self.events.append((node, None))
        del self.open[at:]

    def _leave(self, at: int) -> None:
        """The at-th open element ends, those within it go on."""
        self.opened[self.tag[self.open.pop(at)]] -= 1

    def _find(self, tags: tuple[str, ...], until: tuple[str, ...]) -> int:
        if not any(self.opened[t] for t in tags):
            return -1
        for at in range(len(self.open) - 1, 0, -1):
            name = self.tag[self.open[at]]
            if name in tags:
                return at
            if name in until:
                break
        return -1

    def _text(self, text: str) -> None:
        if text:
            if self.tag[self.open[-1]] == "head" and not text.isspace():
                self._close(len(self.open) - 1)
            self.events.append((self.open[-1], html.unescape(text) if "&" in text else text))

    def _end(self, tag: str) -> None:
        at = self._find((tag,), ("td", "th", "caption", "table") if tag not in ("table", "tr", "td", "th", "tbody", "thead", "tfoot", "caption") else ())
        if at < 0 and tag in HEADINGS:
            at = self._find(tuple(HEADINGS), ())
        if at < 0:
            if tag == "br":
                self.events.append((self.open[-1], "\n"))
            return
        if tag in BLOCK or tag in CELL or not any(self.tag[n] in BLOCK or self.tag[n] in CELL for n in self.open[at + 1 :]):
            self._close(at)
        else:  # an inline element ends amid a block: the block goes on
            self._leave(at)

    def _read(self, source: str) -> None:
        at, size, lower, last = 0, len(source), None, source.rfind(">")
        while at < size:
            found = TOKEN.search(source, at) if at <= last else COMMENT.search(source, at)
            if not found:
                break
            self._text(source[at : found.start()])
            at = found.end()
            end, start = found.group("end"), found.group("start")
            if end:
                end = end.lower()
                if end == "head" or end not in ("html", "body"):
                    self._end(end)
            elif start:
                tag = start.lower()
                if tag in ("html", "body"):
                    if tag == "body" and (head := self._find(("head",), ())) > 0:
                        self._close(head)
                    continue
                if tag == "image":
                    tag = "img"
                if tag not in HEAD and (head := self._find(("head",), ())) > 0:
                    self._close(head)
                if tag in ENDS_P and (p := self._find(("p",), ("td", "th", "caption", "table", "button", "object"))) > 0:
                    self._close(p)
                if tag in HEADINGS and self.tag[self.open[-1]] in HEADINGS:
                    self._close(len(self.open) - 1)
                if tag in IMPLIED:
                    kinds, until = IMPLIED[tag]
                    while (old := self._find(kinds, until)) > 0:
                        if tag == "a" and any(self.tag[n] in BLOCK for n in self.open[old + 1 :]):
                            self._leave(old)
                        else:
                            self._close(old)
                attrs = found.group("attrs")
                node = self._start(tag, attrs)
                if tag in VOID or (attrs.endswith("/") and tag in ("svg", "path")):
                    if tag == "br":
                        self.events.append((node, "\n"))
                    self.events.append((node, None))
                elif tag in RAW:
                    if lower is None:
                        lower = source.lower() if len(source.lower()) == size else re.sub("[A-Z]", lambda m: m[0].lower(), source)
                    stop = lower.find("</" + tag, at)
                    self.events.append((node, None))
                    at = size if stop < 0 else stop
                    if stop >= 0:
                        close = source.find(">", stop)
                        at = size if close < 0 else close + 1
                else:
                    self.open.append(node)
                    self.opened[tag] += 1
        self._text(UNENDED.sub("", source[at:]))
        self._close(1)


def labels(attrs: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(attrs):
        out.setdefault(name.lower(), html.unescape(a or b or c))
    return out


def left_out(page: Page) -> list[bool]:
    """Whether a node is, or stands in, something other than article text."""
    n = len(page.tag)
    holds = [t in ARTICLE for t in page.tag]  # an article stands below, or is the node
    inside = [False] * n
    for k in range(n - 1, 0, -1):
        if holds[k]:
            holds[page.parent[k]] = True
    out, header = [False] * n, [False] * n
    for k in range(1, n):
        up, tag = page.parent[k], page.tag[k]
        inside[k] = inside[up] or tag in ARTICLE
        header[k] = header[up]
        if out[up] or tag in OUT:
            out[k] = True
            continue
        words: set[str] = set()
        role = ""
        if page.attrs[k] and LABELLED.search(page.attrs[k]):
            said = labels(page.attrs[k])
            role = said.get("role", "").lower()
            words = set(WORDS.findall(CAMEL.sub(" ", f"{said.get('class', '')} {said.get('id', '')}").lower()))
            if "hidden" in said or said.get("aria-hidden", "").lower() == "true" or HIDDEN.search(said.get("style", "")) or role in OUT_ROLES:
                out[k] = True
                continue
        frame = holds[k] and not inside[up]  # the frame around an article isn't its sidebar
        if words & OUT_WORDS and not (frame and not (tag == "article" and words & {"comment", "comments", "reply"})):
            out[k] = True
        elif tag == "header" or words & {"header", "masthead"} and not frame and tag not in HEADINGS:
            if not inside[up]:
                out[k] = not frame
            else:
                header[k] = True  # an article's own: its headings stay
        if tag in HEADINGS:
            header[k] = False
    for k in range(1, n):
        out[k] = out[k] or out[page.parent[k]]
    texts: dict[int, list[str]] = {}
    for node, text in page.events:
        if text is not None:
            while node > 0 and page.tag[node] not in HEADINGS and page.tag[node] not in BLOCK:
                node = page.parent[node]
            if page.tag[node] in HEADINGS and not out[node]:
                texts.setdefault(node, []).append(text)
    for node, said in texts.items():
        up = page.parent[node]
        if COMMENTS.match("".join(said)) and not holds[up] and up and page.tag[up] in ("section", "div", "ol", "ul"):
            out[up] = True
    page.header = header  # type: ignore[attr-defined]
    for k in range(1, n):
        out[k] = out[k] or out[page.parent[k]]
    return out


def densities(page: Page, out: list[bool]) -> tuple[list[float], list[float], list[int], list[int], list[int]]:
    """For each node its density, the sum of its children's, its characters, its links' characters and its links."""
    n = len(page.tag)
    chars, own, link_chars, tags, links = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    in_link = [False] * n
    for k in range(1, n):
        in_link[k] = in_link[page.parent[k]] or page.tag[k] == "a"
    for node, text in page.events:
        if text is not None and not out[node]:
            own[node] += len(text.strip())
    for k in range(n - 1, -1, -1):
        if out[k]:
            continue
        chars[k] += own[k]
        link_chars[k] += own[k] if in_link[k] else 0
        if k:
            up = page.parent[k]
            chars[up] += chars[k]
            link_chars[up] += link_chars[k]
            tags[up] += tags[k] + 1
            links[up] += links[k] + (page.tag[k] == "a")
    share = link_chars[0] / max(chars[0], 1)

    def density(c: int, lc: int, t: int, lt: int) -> float:
        if not c:
            return 0.0
        base = math.log(c / max(c - lc, 1) * max(lc, 1) + share * c + math.e)
        ratio = math.log(max(c / max(lc, 1) * max(t, 1) / max(lt, 1), 1.0))
        return c / max(t, 1) * ratio / math.log(base)

    dense = [density(*x) for x in zip(chars, link_chars, tags, links, strict=True)]
    sums = [density(own[k], own[k] if in_link[k] else 0, 1, int(in_link[k])) for k in range(n)]
    for k in range(1, n):
        if not out[k]:
            sums[page.parent[k]] += dense[k]
    return dense, sums, chars, link_chars, links


def chosen(page: Page, out: list[bool]) -> list[bool]:
    """Whether a node's text is the page's main text."""
    n = len(page.tag)
    dense, sums, chars, link_chars, links = densities(page, out)
    keep = [False] * n
    if not chars[0]:
        return keep
    main = max(range(n), key=lambda k: (sums[k], -k))
    path, k = [], main
    while k >= 0:
        path.append(k)
        k = page.parent[k]
    threshold = min(dense[k] for k in path)
    articles = [k for k in path if page.tag[k] == "article"] or [k for k in path if page.tag[k] == "main"]
    if articles:
        keep[articles[-1]] = True
    elif any(page.tag[k] in ARTICLE and not out[k] and chars[k] and not link_chars[k] * 2 > chars[k] for k in range(n)):  # an article that the sums pass over
        keep[max((k for k in range(n) if page.tag[k] in ARTICLE and not out[k]), key=lambda k: (sums[k], -k))] = True
    else:
        keep[main] = True
        below = list(range(n))  # of each node the largest sum at or below it
        for k in range(n - 1, 0, -1):
            up = page.parent[k]
            if not out[k] and (sums[below[k]], -below[k]) > (sums[below[up]], -below[up]):
                below[up] = below[k]
        reached = [False] * n
        for k in range(n):
            reached[k] = not out[k] and dense[k] >= threshold and (k == 0 or reached[page.parent[k]])
            if reached[k] and page.tag[below[k]] in BLOCK:
                keep[below[k]] = True
        for k in range(1, main):  # the title before it
            keep[k] = keep[k] or (page.tag[k] == "h1" and not out[k])
    for k in range(1, n):
        menu = links[k] >= 3 and page.tag[k] in ("ul", "ol", "div", "section", "table", "dl", "p") and link_chars[k] * 5 >= chars[k] * 4
        keep[k] = (keep[k] or keep[page.parent[k]]) and not out[k] and not menu
    return keep


def main_text(source: str | None) -> str:
    """Blocks in page order, two line ends between them; white space within a block is one space."""
    if not source:
        return ""
    page = Page(source)
    out = left_out(page)
    keep = chosen(page, out)
    blocks: list[str] = []
    held: list[str] = []

    def ended() -> None:
        if held:
            text = " ".join("".join(held).split())
            if text:
                blocks.append(text)
            held.clear()

    for node, text in page.events:
        tag = page.tag[node]
        if text is None:
            if tag in BLOCK:
                ended()
            elif tag in CELL and held:
                held.append(" ")
        elif keep[node] and not page.header[node]:
            held.append(text)
    ended()
    return "\n\n".join(blocks)


def extracted(pages: DataFrame, page_id: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """page_id, url, text (the main text, empty if there is none) and n_chars (its code points) of each row.

    Null and empty sources, and pages of nothing but menus and the like, have an empty text. Character references are decoded.
    ``<br>`` and the border of two cells of a table's row are white space within a block. Rows that
    repeat are read each; null ids and urls stay. Broken markup is read as browsers do; a page without any tag is one block. Nothing
    is cut off. Other columns are not read. No row: no row.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(source).alias("html"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in modest(batches, 256):
            texts = [main_text(h) for h in b.column("html").to_pylist()]
            columns = [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
