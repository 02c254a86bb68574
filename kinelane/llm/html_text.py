"""Main text of web pages: paragraphs give points to their ancestors, the best container and its siblings are kept."""

from __future__ import annotations

import re
from html import unescape

from pyspark.sql import DataFrame

from kinelane.llm.common import arrow_pass, text_of

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>""", re.S
)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math select object canvas".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr img".split())
#: Elements that are never part of an article's text.
BOILERPLATE = frozenset("head nav footer aside form button dialog menu fieldset video audio".split())
#: Words of class, id or role that mark what is not part of an article's text, if all of a name is such words,
UNLIKELY = frozenset(
    "ad ads advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments commentlist complementary consent contentinfo cookie cookies"
    " discussion disqus foot footer form gdpr login masthead menu menubar modal nav navbar navigation newsletter notice notices notification pager pagination"
    " popup promo promoted promotion recommended related replies reply respond rss search share sharing sidebar signup skip social sponsor sponsored"
    " subscribe subscription toolbar topbar widget widgets".split()
)
#: or these words of place and kind beside them ("site-footer"; not "has-sidebar" or "story-with-ads").
_PLACE = frozenset(
    "area article bar block bottom box buttons center container entry footer form global group header inner inline left link links list main message middle mobile"
    " outer overlay page panel post posts primary right secondary section site slot sticky text the top unit wrap wrapper".split()
)
_COMMENTS = frozenset("comment comments commentlist discussion disqus replies reply respond".split())
_HEADER = re.compile(r"(?:^|[\s_-])header(?=$|[\s_-])")
_LIKELY = re.compile(r"(?:^|[\s_-])(?:article|body|content|entry|main|post|story|text)(?=$|[\s_-])")
#: Blocks that are paragraphs of what holds them; text right inside other blocks counts for the block itself.
PARAGRAPH = frozenset("p pre blockquote li dd dt td th h1 h2 h3 h4 h5 h6 figcaption address summary".split())
#: Boilerplate kinds that some pages are wrapped in as a whole.
_WRAPS = frozenset("form fieldset dialog header".split())
#: Share of a page's text outside links from which an element is the page's content, whatever its class.
MOST = 0.75
#: An open element of the first kind ends where one of the second kind begins.
_ENDS = {
    "p": frozenset("p div ul ol dl li table section article aside header footer nav form blockquote pre h1 h2 h3 h4 h5 h6 hr main address figure fieldset details".split()),
    "li": frozenset(["li"]),
    "dt": frozenset("dt dd".split()),
    "dd": frozenset("dt dd".split()),
    "tr": frozenset("tr tbody thead tfoot".split()),
    "td": frozenset("td th tr tbody thead tfoot".split()),
    "th": frozenset("td th tr tbody thead tfoot".split()),
    "option": frozenset("option optgroup".split()),
}
_HOLDERS = frozenset("ul ol dl table body html div section article main".split())
LEAST_CHARS = 25
#: Points for kinds of container, before paragraphs add theirs.
KIND_POINTS = {"article": 10.0, "main": 8.0, "div": 5.0, "section": 3.0, "td": 3.0, "blockquote": 3.0, "ul": -3.0, "ol": -3.0, "dl": -3.0, "body": -5.0, "#": -5.0, "html": -10.0}


def _unlikely(marks: str) -> set[str]:
    """Unlikely words of the names in ``marks`` that consist of such words, words of place and numbers."""
    found: set[str] = set()
    for name in marks.split():
        words = {w.rstrip("0123456789") for w in re.split(r"[_-]+", name)} - {""}
        if words <= UNLIKELY | _PLACE:
            found |= words & UNLIKELY
    return found


class _Page:
    """Elements in page order with their parents, and the blocks of text in them.

    Elements in ``exempt`` are not dropped for their kind or class; with ``classes`` false, none is for its class.
    """

    def __init__(self, html: str, exempt: frozenset[int] = frozenset(), classes: bool = True):
        self.tag, self.parent, self.last, self.out, self.likely, self.inside = ["#"], [0], [0], [False], [False], [False]
        self.exempt, self.classes = exempt, classes
        self.dropped: dict[int, bool] = {}  # elements dropped for their class or as a wrapper, and whether they are comments
        self.plain: dict[int, int] = {}  # characters right in an element and outside links, dropped or not
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters of it inside links
        self._read(html)

    def _open(self, name: str, attributes: str, parent: int) -> int:
        marks = " ".join(a or b or c for a, b, c in _NAMED.findall(attributes)).lower() if attributes else ""
        inside = self.inside[parent] or name in ("article", "main")
        own = name in BOILERPLATE or (name == "header" and not self.inside[parent])
        wrapper, comments = own and name in _WRAPS, False
        if not own and self.classes and marks and name not in ("html", "body", "article", "main"):
            words = _unlikely(marks)
            wrapper, comments = bool(words) or (not inside and bool(_HEADER.search(marks))), bool(words & _COMMENTS)
        if wrapper and len(self.tag) not in self.exempt:
            self.dropped[len(self.tag)] = comments
        drop = self.out[parent] or (own and not wrapper) or len(self.tag) in self.dropped
        self.tag.append(name)
        self.parent.append(parent)
        self.last.append(len(self.tag) - 1)
        self.out.append(drop)
        self.likely.append(bool(marks) and bool(_LIKELY.search(marks)))
        self.inside.append(inside)
        return len(self.tag) - 1

    def _read(self, html: str) -> None:
        stack, at = [0], 0  # open elements, blocks and inline ones alike
        buffer: list[str] = []
        links, in_link = [0], 0

        def holder() -> int:
            return next(e for e in reversed(stack) if self.tag[e] not in INLINE)

        def flush() -> None:
            if buffer:
                text = " ".join(unescape("".join(buffer)).split())
                if text and not self.out[stack[-1]]:
                    self.blocks.append((holder(), text, min(links[0], len(text))))
                buffer.clear()
            links[0] = 0

        def add(text: str) -> None:
            if text and not in_link:
                self.plain[stack[-1]] = self.plain.get(stack[-1], 0) + len(text.strip())
            if text and not self.out[stack[-1]]:
                buffer.append(text)
                if in_link:
                    links[0] += len(text)

        def close(k: int) -> None:
            for e in stack[k:]:
                self.last[e] = len(self.tag) - 1
            del stack[k:]

        size = len(html)
        while at < size:
            found = _TOKEN.search(html, at)
            if found is None:
                add(html[at:])
                break
            add(html[at : found.start()])
            at = found.end()
            ending, name, attributes = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
            if not name:
                continue
            name = name.lower()
            if name in RAW:
                if not ending and not attributes.endswith("/"):
                    end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(html, at)
                    at = end.end() if end else size
                if name not in ("script", "style"):
                    add(" ")
                continue
            if name == "br":
                add(" ")
                continue
            if name not in INLINE:
                flush()
            if ending:
                for k in range(len(stack) - 1, 0, -1):
                    here = self.tag[stack[k]]
                    if here == name:
                        close(k)
                        break
                    if name in INLINE and here not in INLINE:
                        break  # an inline end does not close blocks
                in_link = sum(self.tag[e] == "a" for e in stack)
                continue
            if name in VOID:
                continue
            if name not in INLINE:
                for k in range(len(stack) - 1, 0, -1):
                    here = self.tag[stack[k]]
                    if name in _ENDS.get(here, ()):
                        close(k)
                        break
                    if here in _HOLDERS:
                        break
                in_link = sum(self.tag[e] == "a" for e in stack)
            if not attributes.endswith("/"):
                stack.append(self._open(name, attributes, stack[-1]))
                in_link += name == "a"
        flush()
        close(1)

    def ancestors(self, element: int):
        while element:
            yield element
            element = self.parent[element]
        yield 0

    def content(self) -> frozenset[int]:
        """Dropped elements that hold the article: the largest main or else article, or most of the page's text."""
        if not self.dropped:
            return frozenset()
        plain = [self.plain.get(e, 0) for e in range(len(self.tag))]
        for e in range(len(plain) - 1, 0, -1):
            plain[self.parent[e]] += plain[e]
        for kind in ("main", "article"):
            found = [e for e, tag in enumerate(self.tag) if tag == kind and plain[e]]
            if found:
                return frozenset(self.dropped).intersection(self.ancestors(max(found, key=lambda e: (plain[e], -e))))
        return frozenset(e for e, comments in self.dropped.items() if not comments and plain[e] >= MOST * plain[0] > 0)

    def container(self, element: int) -> int:
        """What a block's points go to."""
        while element and (self.tag[element] in PARAGRAPH or self.tag[element] in INLINE):
            element = self.parent[element]
        return element


def main_text(html: str) -> str:
    """Text blocks of the article of a page, joined by an empty line; empty if the page has no text.

    Boilerplate and elements of unlikely classes are dropped, unless they hold the article; if next to nothing is left
    and no article is marked as one, the page is read again without regard to classes.
    """
    page = _Page(html)
    if exempt := page.content():
        page = _Page(html, exempt)
    text = _article(page)
    if len(text) < LEAST_CHARS and page.dropped and not any(page.inside[e] for e, _, _ in page.blocks):
        again = _article(_Page(html, frozenset([*exempt, *page.dropped]), False))
        if len(again) >= LEAST_CHARS:
            return again
    return text


def _article(page: _Page) -> str:
    if not page.blocks:
        return ""
    points: dict[int, float] = {}
    chars, linked = [0] * len(page.tag), [0] * len(page.tag)
    for element, text, link in page.blocks:
        for e in page.ancestors(element):
            chars[e] += len(text)
            linked[e] += link
        if len(text) < LEAST_CHARS:
            continue
        gain = 1 + text.count(",") + text.count("，") + min(len(text) / 100, 3)
        gain *= 1 - link / len(text)
        for level, e in enumerate(page.ancestors(page.container(element))):
            if level > 5:
                break
            if e not in points:
                points[e] = KIND_POINTS.get(page.tag[e], 0.0) + (10.0 if page.likely[e] else 0.0)
            points[e] += gain / (1 if level == 0 else 2 if level == 1 else 3 * level)
    density = lambda e: linked[e] / max(chars[e], 1)
    score = {e: p * (1 - density(e)) for e, p in points.items()}
    if score:
        best = max(score, key=lambda e: (score[e], -e))
        # A parent that nearly reaches the best has other good parts beside it.
        while (up := page.parent[best]) and score.get(up, 0.0) >= 0.75 * score[best] and page.tag[up] not in ("body", "html", "#"):
            best = up
        # An article is kept as a whole: its parts may be of very different length.
        best = next((e for e in page.ancestors(best) if page.tag[e] in ("article", "main")), best)
        keep = [best]
        if page.tag[best] not in ("#", "body", "html", "article", "main"):
            bar = max(10.0, 0.2 * score[best])
            prose = {a for e, text, _ in page.blocks if page.tag[e] in ("p", "pre", "blockquote") or len(text) >= LEAST_CHARS for a in _upto(page, e, page.parent[best])}
            like = lambda e: e in prose and page.tag[e] == page.tag[best]
            keep += [e for e in range(1, len(page.tag)) if page.parent[e] == page.parent[best] and e != best and _sibling(page, e, score, bar, chars, density, like(e))]
    else:
        keep = [next((e for e, t in enumerate(page.tag) if t in ("article", "main") and chars[e] and not page.out[e]), 0)]
    spans = [(e, page.last[e]) for e in keep] if keep != [0] else [(0, len(page.tag))]
    menus = _menus(page, chars, linked)
    return "\n\n".join(text for e, text, _ in page.blocks if any(a <= e <= b for a, b in spans) and not any(m in menus for m in page.ancestors(e)))


def _upto(page: _Page, element: int, parent: int) -> list[int]:
    """The child of ``parent`` that ``element`` is or is in, if any."""
    while element > parent:
        if page.parent[element] == parent:
            return [element]
        element = page.parent[element]
    return []


def _sibling(page: _Page, e: int, score: dict[int, float], bar: float, chars: list[int], density, like: bool) -> bool:
    """Whether a sibling of the best container stays; ``like`` is one of the same kind that holds paragraphs."""
    if page.out[e]:
        return False
    if score.get(e, 0.0) >= bar:
        return True
    if page.tag[e] in ("h1", "h2", "h3"):
        return chars[e] > 0 and density(e) < 0.5
    return (like or page.tag[e] in ("p", "pre", "blockquote")) and chars[e] > 0 and (density(e) < 0.25 if chars[e] > 80 else density(e) == 0)


def _menus(page: _Page, chars: list[int], linked: list[int]) -> set[int]:
    """Lists and tables of which most characters are links, with two links at least."""
    anchors: dict[int, int] = {}
    for a, tag in enumerate(page.tag):
        if tag == "a":
            for e in page.ancestors(page.parent[a]):
                anchors[e] = anchors.get(e, 0) + 1
    return {e for e, n in anchors.items() if n > 1 and page.tag[e] in ("ul", "ol", "dl", "table") and linked[e] > 0.6 * max(chars[e], 1)}


def extract(df: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``df``: main text of the whole html and its code points.

    Null html is empty: empty text, 0. Null ids and urls stay; repeated rows repeat; an empty table gives no rows; other
    columns are not read. Pages of any length are read whole, one after the other.
    """

    def work(rows: dict[str, list]) -> dict[str, object]:
        texts = [main_text(h) for h in rows["text"]]
        return {"page_id": rows["page_id"], "url": rows["url"], "text": texts, "n_chars": [len(t) for t in texts]}

    kind = df.schema[id_column].dataType.simpleString()
    slim = df.select(df[id_column].alias("page_id"), df[url_column].cast("string").alias("url"), text_of(html_column).alias("text"))
    return arrow_pass(slim, work, f"page_id {kind}, url string, text string, n_chars long")
