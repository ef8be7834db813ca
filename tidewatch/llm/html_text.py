"""Main text of web pages by removing what recurs across a site."""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Container, Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tidewatch.llm.common import pieces, stage

# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th tr tbody thead figcaption".split())
NEVER = frozenset("head script style textarea title noscript iframe template xmp noembed noframes nav aside footer form button select option dialog menu svg object canvas audio video map label input fieldset".split())
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table div section article aside main body html td th blockquote select form nav header footer".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
# Names that pages give to parts beside the article: a whole class or id, so has-sidebar, no-comments or related-work name none.
BESIDE = re.compile(r"(?:(?:site|page|main|primary|secondary|global)-)?(?:(?:ad|ads|adbox|advert|adverts|advertisements?|advertising|sponsor|sponsors|sponsored|promos?|promotions?|banners?|nav|navbar|navigation|menu|menubar|breadcrumbs?|sidebars?|footer|masthead|topbar|cookies?|consent|gdpr|popup|modal|newsletter|subscribe|signup|login|comments?|disqus|share|sharing|socials?|recommended|recommendations|widgets?|toolbar|pagination|pager)(?:-(?:bar|box|area|block|list|links?|buttons?|icons?|container|wrap|wrapper|banner|popup|modal|form|thread|widget|\d+))*|related(?:-(?:posts?|articles?|links?|stories|news))?|(?:site|page)-?header|skip-?link)", re.I)
# Names that also belong to articles: inside one they count only for elements without text of their own beside links.
LOOSE = re.compile(r"(?:share|sharing|socials?|promos?|promotions?|recommended|recommendations|widgets?|toolbar|login|signup|banners?|menu|popup)", re.I)
WRAPPERS = frozenset("form fieldset label button".split())  # may be put around a whole page
COMMENTS = re.compile(r"(?:div-)?comments?(?:-(?:area|block|box|list|container|wrap|wrapper|thread|body|item|form|reply|respond|\d+))*", re.I)
ROLES = frozenset("navigation banner complementary contentinfo search dialog alert alertdialog menu menubar toolbar form".split())

TOKEN = re.compile(r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>""", re.S)
# One attribute: names and values are read in turn, so no name is found inside a value.
ATTRIBUTE = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*)(?:"|\Z)|'([^']*)(?:'|\Z)|([^\s"'>][^\s>]*)))?""")


class Page:
    """Elements of a page as they close: subtree hashes, and text blocks outside the elements left out.

    A single pass with a stack, so neither depth nor length of a page matters. Hashes of paragraphs, headings, list items and
    table cells are odd, unless they stand outside an article and hold links only; all others are even and name the
    place of the element, too: the tags around it.
    """

    def __init__(self, html: str | None, recurring: Container[int] = frozenset()):
        self.recurring, self.hashes, self.events = recurring, set(), []
        self.spans: dict[str, list[tuple[int, int]]] = {"article": [], "main": []}
        self.comments: list[tuple[int, int]] = []  # elements named so that hold articles
        self.beside: list[tuple[int, int]] = []  # sidebars and the like that hold an article or main
        self.hidden: list[tuple[int, int]] = []  # hidden elements and elements of such roles that hold one
        self.stack: list[list] = []  # tag, names, first event, parts of the hash, why it is left out, whether it has text, what its name says, whether text beside links, place
        self.open: Counter[str] = Counter()
        self.inside = 0  # open article and main elements
        self._read(html or "")

    def _read(self, html: str) -> None:
        at = 0
        for m in iter(lambda: TOKEN.search(html, at), None):
            self._text(html[at : m.start()])
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            if m[1] or m[4]:
                self._end(tag)
            else:
                attributes = m[3] or m[6] or ""
                self._start(tag, attributes)
                if tag in RAW and not attributes.endswith("/"):
                    close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, at)
                    at = close.start() if close else len(html)
        self._text(html[at:])
        while self.stack:
            self._close()

    def _text(self, text: str) -> None:
        if text and text.strip():
            text = unescape(text)
            if self.stack:
                self.stack[-1][3].append(" ".join(text.split()))
                self.stack[-1][5] = True
                self.stack[-1][7] |= not self.open["a"]
        if text:
            self.events.append(text)

    def _start(self, tag: str, attributes: str) -> None:
        if tag == "br" or tag in VOID and tag not in BLOCK:
            self.events.append(" ")
            return
        if tag in BLOCK:
            self._pop_until({"p"})
            if tag in ENDS:
                self._pop_until(ENDS[tag])
            self.events.append(None)
        if tag in VOID:
            return
        names, out, named = "", "beside" if tag in NEVER else "", ""
        for name, *values in ATTRIBUTE.findall(attributes) if attributes else ():
            name, value = name.lower(), next(filter(None, values), "")
            if name in ("class", "id"):
                names += f" {value}"
                named = named or self._named(tag, name, value)
            elif name == "role":
                out = out or ("hidden" if value.lower() in ROLES else "")
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                out = out or "hidden"
        if tag == "header" and not self.inside:
            out = "beside"
        self.inside += tag in self.spans
        self.open[tag] += 1
        place = xxhash.xxh3_64_intdigest(tag, self.stack[-1][8] if self.stack else 0)
        self.stack.append([tag, names, len(self.events), [], out, False, named, False, place])

    def _named(self, tag: str, name: str, value: str) -> str:
        """"comments", "beside" or "loose" where a class or an id names a part beside the article, else nothing.

        Ids of headings and sections are targets of links, and so are those of text inside an article or main element.
        """
        if tag in ("html", "body", "main") or tag in HEADING or tag == "section" and (self.inside or name == "id") or name == "id" and self.inside and (tag in PROSE or tag not in BLOCK):
            return ""
        tokens = [re.sub("[_-]+", "-", x) for x in value.split()]
        if any(COMMENTS.fullmatch(x) for x in tokens):
            return "comments"
        found = [] if tag == "article" else [x for x in tokens if BESIDE.fullmatch(x)]
        return "" if not found else "loose" if all(LOOSE.fullmatch(x) for x in found) else "beside"

    def _end(self, tag: str) -> None:
        if self.open[tag]:
            while self._close() != tag:
                pass

    def _pop_until(self, tags: set[str]) -> None:
        for e in reversed(self.stack):
            if e[0] in tags:
                while self._close() != e[0]:
                    pass
                return
            if e[0] in SCOPE:
                return

    def _close(self) -> str:
        tag, names, first, parts, why, has_text, named, plain, place = self.stack.pop()
        self.inside -= tag in self.spans
        self.open[tag] -= 1
        h = xxhash.xxh3_64_intdigest("\x00".join((tag, names, *parts)).encode("utf-8", "surrogatepass")) - (1 << 63)
        if self.stack:
            self.stack[-1][3].append(f"\x01{h}")
            self.stack[-1][5] |= has_text
            self.stack[-1][7] |= plain
        holds = {kind for kind, spans in self.spans.items() if spans and spans[-1][0] >= first}
        out = why != "" and not holds
        if tag in BLOCK and has_text and tag not in ("html", "body", "main", "article"):
            prose = tag in PROSE and (plain or self.inside > 0)
            key = h | 1 if prose else (h ^ place) & ~1
            key = (key + (1 << 63)) % (1 << 64) - (1 << 63)
            self.hashes.add(key)
            out |= key in self.recurring and not holds
        if not holds and named:
            out |= not plain or not self.inside or named == "beside" or named == "comments" and tag not in PROSE
        if out:
            del self.events[first:]
            for spans in (*self.spans.values(), self.comments, self.beside, self.hidden):
                while spans and spans[-1][0] >= first:
                    spans.pop()
        else:
            span = (first, len(self.events))
            if holds and tag not in WRAPPERS and why:
                (self.beside if why == "beside" else self.hidden).append(span)
            if tag in self.spans:
                self.spans[tag].append(span)
            if named == "comments" and holds == {"article"}:
                self.comments.append(span)
        if tag in BLOCK:
            self.events.append(None)
        return tag

    def text(self) -> str:
        """Blocks of the article and main elements, or else of the page, one a line.

        Articles in elements named as comments count for nothing, those in sidebars and hidden elements only if there is no
        other article or main text; and if there is none at all, the page is taken.
        """
        for without in ((self.comments, self.beside, self.hidden), (self.comments, self.beside), (self.comments,)):
            events = self.events
            if any(without):
                events = list(events)
                for spans in without:
                    for a, b in self._top(spans):
                        events[a:b] = [None] * (b - a)
            top = self._chosen(events)
            if top:
                return self._lines(events, top)
        return self._lines(self.events, [(0, len(self.events))])

    def _chosen(self, events: list[str | None]) -> list[tuple[int, int]]:
        """The articles inside the main element if they make up half of it, else the main element; or all articles, where they have more text."""
        articles, mains = self._top(self.spans["article"]), self._top(self.spans["main"])
        if not mains:
            return articles if any(x and not x.isspace() for a, b in articles for x in events[a:b]) else []
        size = lambda spans: sum(len("".join(x.split())) for a, b in spans for x in events[a:b] if x)
        within = [s for s in articles if any(a <= s[0] and s[1] <= b for a, b in mains)] if len(mains) == 1 else articles
        whole, inner = size(mains), size(within)
        best, most = (within, inner) if 2 * inner >= whole else (mains, whole)
        if len(within) < len(articles) and size(articles) > most:
            return articles
        return best if most else []

    @staticmethod
    def _lines(events: list[str | None], top: list[tuple[int, int]]) -> str:
        blocks, block = [], []
        for a, b in top:
            for x in (*events[a:b], None):
                if x is None:
                    if line := " ".join("".join(block).split()):
                        blocks.append(line)
                    block = []
                else:
                    block.append(x)
        return "\n".join(blocks)

    @staticmethod
    def _top(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """The outermost of nested spans."""
        top: list[tuple[int, int]] = []
        for a, b in sorted(spans, key=lambda s: (s[0], -s[1])):
            if not top or a >= top[-1][1]:
                top.append((a, b))
        return top

def host_of(url):
    """Host of a URL column, lower-cased, without user and port; null where there is none."""
    host = F.lower(F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.when(host != "", host)


class Keys:
    """Hashes of a site's subtrees among the sorted hashes of all sites."""

    def __init__(self, keys: array, site: int):
        self.keys, self.site = keys, site

    def __contains__(self, h: int) -> bool:
        h ^= self.site
        i = bisect_left(self.keys, h)
        return i < len(self.keys) and self.keys[i] == h


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches, 200):
        sites, hashes, owners = [], [], []
        for site, html, page in zip(b.column("site").to_pylist(), b.column("html").to_pylist(), b.column("page").to_pylist(), strict=True):
            own = Page(html).hashes
            sites += [site] * len(own)
            owners += [page] * len(own)
            hashes += [h ^ site for h in own]
        yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.int64)) for x in (sites, hashes, owners)], names=["site", "h", "page"])


def site_subtrees(pages: DataFrame) -> DataFrame:
    """(site, h, page): block subtrees of the different pages of each site; h is mixed with the site, so it names both."""
    return pages.where("site is not null and html is not null").select("site", "html", "page").mapInArrow(_subtrees, "site long, h long, page long").distinct()


def site_templates(pages: DataFrame, share: float, least: int, many: int, nearly: float) -> DataFrame:
    """(h): subtrees found in at least `least` pages of a site, and in `many` of them or a `share` of the site's pages.

    Prose (odd hashes) must be in the share `nearly` of the site's pages instead. Equal pages of a
    site count once. Counts are taken per task before they are shuffled, so a site with most of the pages is spread over them.
    """
    sizes = pages.where("site is not null and html is not null").select("site", "page").distinct().groupBy("site").agg(F.count("*").alias("pages"))
    often = site_subtrees(pages).groupBy("site", "h").agg(F.count("*").alias("n")).where(F.col("n") >= least).join(sizes, "site")
    enough = F.when(F.col("h").bitwiseAND(1) == 1, F.col("pages") * nearly).otherwise(F.least(F.col("pages") * share, F.lit(float(many))))
    return often.where(F.col("n") >= enough).select("h")


def _extract(recurring_of: Callable[[pa.RecordBatch], Iterator[Container[int]]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 200):
            texts = [Page(html, recurring).text() for html, recurring in zip(b.column("html").to_pylist(), recurring_of(b), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return run


def _listed(b: pa.RecordBatch) -> Iterator[Container[int]]:
    for site, own in zip(b.column("site").to_pylist(), b.column("recurring").to_pylist(), strict=True):
        yield frozenset(h ^ site for h in own or ())


def main_text(pages: DataFrame, share: float = 0.1, least: int = 5, broadcast_hashes: int = 2_000_000, many: int = 50, nearly: float = 0.9, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text): blocks of the main text in page order, one a line.

    Element subtrees are hashed bottom-up (tag, class, id, texts and children), counted per host, and those recurring across
    the host's pages are deleted: from `least` pages on where that is a `share` of the host's pages, and from `many` pages on
    however large the host is. Only containers are deleted so, at the same place (the tags around them); paragraphs, headings, list items
    and table cells themselves go where the share `nearly` of the host's pages has them, or outside articles if they are links only.
    Elements that are never text (scripts, forms, navigation and the like) or are named as beside the text go too, by a whole class
    or id. Nothing that holds an article or main element goes; inside one, names that articles use themselves count only for
    elements without text of their own. Of the rest, the articles or the main element are taken, whichever is the text (`Page._chosen`),
    else the page. Character references are decoded, white space in a block becomes one blank.

    Up to `broadcast_hashes` recurring subtrees go to every task as one sorted array; beyond that they are rows joined to the
    subtrees of the pages, and a page gets the list of its own.

    Null html is empty text. Pages without a host share no template. Repeated rows come back each; extra columns are
    ignored. Broken markup is read leniently; unclosed elements end with their parent or the page.
    """
    pages = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    # Sites are even: the last bit of a hash tells prose.
    site = F.when(F.col("host").isNotNull(), F.xxhash64("host").bitwiseAND(-2))
    pages = pages.withColumns({"site": site, "page": F.xxhash64("host", "html")}).drop("host")
    recurring = stage(site_templates(pages, share, least, many, nearly), "site-templates")
    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string"
    if recurring.count() <= broadcast_hashes:
        keys = array("q", np.sort(recurring.toArrow()["h"].to_numpy()).tobytes())
        known = pages.sparkSession.sparkContext.broadcast(keys)

        def in_array(b: pa.RecordBatch) -> Iterator[Container[int]]:
            return (frozenset() if site is None else Keys(known.value, site) for site in b.column("site").to_pylist())

        return pages.select("page_id", "url", "html", "site").mapInArrow(_extract(in_array), schema)
    own = site_subtrees(pages).join(recurring, "h").groupBy("page").agg(F.collect_list("h").alias("recurring"))
    joined = pages.join(own, "page", "left").select("page_id", "url", "html", "site", "recurring")
    return joined.mapInArrow(_extract(_listed), schema)
