"""Operator 4: main text of HTML pages by line-block distribution.

A page is read once by a tag tokenizer into *lines*: one for each block of
text, inline markup dissolved, white space folded, character references
decoded.  Lines inside elements that never hold an article (navigation, page
header and footer, sidebars, forms, scripts, styles, notices, adverts, reader
comments, by tag, role, class or id) are *furniture*.

The line-block distribution sums the text length of the lines in a sliding
window, furniture left out and link text counting nothing.  Text surges where
the window sum rises from nothing to the page's largest block, or to any
further one of at least ``SURGE``, and dives where it falls back to nothing for
good; what stands between the first surge and the last dive is the main text.

Marks of the page are weights: the article with most text, its weight doubled,
is compared with the block that the distribution finds in the text outside
articles, and likewise the main part with the text outside it.  The heavier one
is the main text.  A marked part that wins is taken to its ends, as short
paragraphs there belong to it: its marks tell where it begins and ends better
than window sums do.  One that loses is text as any other: it stays if it
stands within the block or surges by itself.  Lines of ``MENU`` or more in a row that
are links only have no weight, so surge and dive cut menus at a marked part's ends.

Inline furniture (an advert, a button, a share link, hidden text) is taken out of the
block around it, whose text goes on after it.  Quotes have a meaning in a tag only
after "=", and names of attributes are read as such, not in values.

One row at a time: no shuffle, no state.  Work is linear in the page.

Defined results: null or empty html, and pages without text, give '' and 0;
broken or cut off pages are read as far as they go, an unfinished tag at the
end is dropped; an unclosed script or style takes the rest of the page, an
unclosed drawing or media element ends with the element around it; repeated
rows and ids stay; a null page_id or url stays null; other columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
#: Least window sum of a further run of text: about a long line.
SURGE = 86
#: A marked article or main part weighs so much against unmarked text.
MARKED = 2

#: So many lines of links only are a menu.
MENU = 3

#: Elements whose content is never text of the page.
RAW = frozenset("script style noscript template textarea title iframe svg math object canvas audio video select option datalist head".split())
#: Of these, elements whose content is no markup, so that an unclosed one takes what follows.
NO_MARKUP = frozenset("script style noscript textarea title iframe".split())
#: Elements that never belong to an article.
FURNITURE = frozenset("nav aside footer form dialog menu button fieldset label input".split())
#: Outside an article only: inside, a header holds its heading.
HEADER = frozenset(["header"])
#: Elements that begin and end a block of text.
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Closed by the start of another one of the same kind.
SELF_CLOSING = {"p": BLOCK, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "tr": frozenset(["tr"])}
#: Words of class, id and role that mark furniture.
MARK = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|advertising|adbox|adslot|banner|sponsor|sponsored|promo|promoted|promotion|cookie|cookies|consent|gdpr|notice|notices|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|paywall|"
    r"nav|navbar|navigation|menu|menubar|breadcrumb|breadcrumbs|pagination|pager|sidebar|side-bar|aside|widget|widgets|related|recommended|recommendations|trending|popular|footer|masthead|topbar|toolbar|share|sharing|social|"
    r"comment|comments|commentlist|disqus|respond|reply|replies|discussion|search|skip|complementary|contentinfo|hidden)(?:$|[\s_-])",
    re.I,
)
#: Inside an article an element's own text may be named by such words ("search-results", "notice-of-copyright"):
#: there a whole class must be one, or one with a word of place or shape around it.
_SHAPE = r"(?:area|bar|bars|block|blocks|box|button|buttons|card|cards|container|content|form|group|icon|icons|inner|item|items|label|link|links|list|nav|panel|placeholder|section|slot|strip|thread|title|top|bottom|left|right|unit|wrap|wrapper|zone|\d+)"
_PLACE = r"(?:article|bottom|content|entry|footer|global|header|inline|js|left|main|mobile|page|post|reader|right|side|site|sticky|top|user|native|google|in|the)"
INSIDE = re.compile(
    rf"(?:{_PLACE}[_-])*(?:ad|ads|advert|adverts|advertisement|advertising|adbox|adslot|banner|sponsor|sponsored|promo|promoted|promotion|cookie|cookies|consent|gdpr|notice|notices|cookie[_-]notice|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|paywall|"
    rf"nav|navbar|navigation|menu|menubar|breadcrumb|breadcrumbs|pagination|pager|sidebar|side-bar|aside|widget|widgets|related|related[_-](?:articles|posts|stories|reading)|recommended|recommendations|trending|popular|masthead|topbar|toolbar|share|sharing|social|"
    rf"comment|comments|commentlist|disqus|respond|reply|replies|skip|complementary|contentinfo|hidden)(?:[_-]{_SHAPE})*",
    re.I,
)
#: Sections and headings of an article are named by their ids; only these words tell of a reader's part.
_REPLIES = re.compile(r"(?:^|[\s_-])(?:comment|comments|commentlist|disqus|respond)(?:$|[\s_-])", re.I)
_NAMED = frozenset("section h1 h2 h3 h4 h5 h6 hgroup".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+)*+)>|<[!?][^>]*(?:>|\Z)|<(?=[a-zA-Z/!?])[^>]*\Z", re.S)
#: An attribute: name and value, in quotes or not.
_ATTR = re.compile(r"""([^\s=/>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*)))?""")
_TELLING = re.compile(r"class|id|role|hidden|style", re.I)
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_EVENTS = {tag: re.compile(rf"<(/?){tag}\b[^>]*(?:>|\Z)", re.I) for tag in RAW}
_SPACE = re.compile(r"\s+")
#: Parts of class names that tell what else the page has.
_BESIDE = re.compile(r"\b(?:has|have|with|without|no)[-_][\w-]+", re.I)


@dataclass
class Line:
    text: str
    linked: int  # characters in links
    furniture: bool
    article: int  # number of the enclosing article, -1: the main part only, 0: none


def _marked(tag: str, attrs: str, inside: bool) -> bool:
    if not attrs or tag in ("html", "body", "article", "main") or not _TELLING.search(attrs):
        return False
    for name, a, b, c in _ATTR.findall(attrs):
        value = a or b or c
        name = name.lower()
        if name == "class" and inside:
            if any(INSIDE.fullmatch(word) for word in value.split()):
                return True
        elif name in ("class", "id", "role"):
            words = _REPLIES if inside and name == "id" and tag in _NAMED else MARK
            if words.search(_BESIDE.sub("", value)):
                return True
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _UNSEEN.search(value):
            return True
    return False


class Ends:
    """Where elements whose content is passed over end: all of one kind are found by one search of the page."""

    def __init__(self, page: str):
        self.page = page
        self.found: dict[str, dict[int, int]] = {}

    def of(self, tag: str, at: int) -> int | None:
        """End of the element whose start tag ends at ``at``; None if it is never closed."""
        if tag not in self.found:
            ends: dict[int, int] = {}
            open_: list[int] = []
            for m in _EVENTS[tag].finditer(self.page):
                if not m[1]:
                    open_.append(m.end())
                elif open_ and tag in NO_MARKUP:
                    ends.update((a, m.end()) for a in open_)
                    open_ = []
                elif open_:
                    ends[open_.pop()] = m.end()
            self.found[tag] = ends
        return self.found[tag].get(at)


def lines(page: str) -> list[Line]:
    """The page's blocks of text in page order."""
    out: list[Line] = []
    stack: list[tuple[str, bool, int, tuple[list[str], int] | None]] = []  # tag, furniture, article, for inline furniture the text before it
    blocks: list[int] = []  # places of blocks in the stack
    depth: Counter = Counter()  # open elements by tag
    ends = Ends(page)
    parts: list[str] = []
    links = linked = articles = 0
    at = 0

    def state() -> tuple[bool, int]:
        return (stack[-1][1], stack[-1][2]) if stack else (False, 0)

    def flush() -> None:
        nonlocal linked
        text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
        if text:
            out.append(Line(text, min(linked, len(text)), *state()))
        parts.clear()
        linked = 0

    def push(tag: str, furniture: bool, article: int) -> None:
        nonlocal parts, linked
        block = tag in BLOCK
        if block:
            blocks.append(len(stack))
        stack.append((tag, furniture, article, None if block else (parts, linked)))
        depth[tag] += 1
        if not block:
            parts, linked = [], 0

    def pop() -> str:
        """Ends the innermost element; the text around inline furniture goes on."""
        nonlocal parts, linked
        flush()
        tag, _, _, before = stack.pop()
        depth[tag] -= 1
        if before is None:
            blocks.pop()
        else:
            parts, linked = before
        return tag

    def text(until: int) -> None:
        nonlocal linked
        if until > at:
            piece = page[at:until]
            parts.append(piece)
            if links:
                linked += len(piece)

    while m := _TOKEN.search(page, at):
        text(m.start())
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:  # an end tag
            if tag == "a" and not depth["a"]:
                links = max(0, links - 1)
            if tag in BLOCK and not depth[tag]:
                flush()
            while depth[tag] and pop() != tag:
                pass
            continue
        if tag in RAW:
            end = None if m[3].endswith("/") else ends.of(tag, at)
            if end:
                if tag in ("iframe", "select", "textarea", "title"):
                    parts.append(" ")
                at = end
            elif tag in NO_MARKUP and not m[3].endswith("/"):
                at = len(page)
            elif tag not in ("head", "option") and not m[3].endswith("/"):  # never closed: it ends with the element around it
                flush()
                push(tag, True, state()[1])
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in BLOCK:
            # through inline furniture that was not closed, by one of its own kind only: other blocks stand in that furniture
            while blocks and tag in SELF_CLOSING.get(over := stack[blocks[-1]][0], ()) and (tag == over or blocks[-1] == len(stack) - 1):
                for _ in range(len(stack) - blocks[-1]):
                    pop()
            flush()
        if tag in VOID or m[3].endswith("/"):
            continue
        furniture, article = state()
        if tag == "article" and article <= 0 and not furniture:
            articles += 1
            article = articles
        elif tag == "main" and not article and not furniture:
            article = -1
        furniture = furniture or tag in FURNITURE or tag in HEADER and article <= 0 or _marked(tag, m[3], article != 0)
        if tag in BLOCK or furniture != state()[0] or depth[tag]:  # one inside inline furniture of its kind has an end of its own
            push(tag, furniture, article)
        elif tag == "a":
            links += 1
    text(len(page))
    while stack:
        pop()
    flush()
    return out


def runs(weights: list[int], window: int = WINDOW) -> list[tuple[int, int, int]]:
    """Runs of lines over which no window sum falls to nothing: (first, last exclusive, largest window sum)."""
    out: list[tuple[int, int, int]] = []
    for k, w in enumerate(weights):
        if not w:
            continue
        heavy = sum(weights[k : k + window])
        if out and k - out[-1][1] < window:
            out[-1] = (out[-1][0], k + 1, max(out[-1][2], heavy))
        else:
            out.append((k, k + 1, heavy))
    return out


def surge_and_dive(weights: list[int], window: int = WINDOW) -> tuple[int, int]:
    """First and last line (exclusive) of the text: the run with the largest window sum, and all others that surge."""
    found = runs(weights, window)
    if not found:
        return 0, 0
    surge = min(SURGE, max(r[2] for r in found))
    text = [r for r in found if r[2] >= surge]
    return text[0][0], text[-1][1]


def main_text(page: str | None) -> str:
    found = [x for x in lines(page or "") if not x.furniture]
    weights = [max(0, len(x.text) - x.linked) for x in found]
    parts: dict[int, list[int]] = {}
    for w, x in zip(weights, found, strict=True):
        parts.setdefault(x.article, []).append(w)
    size = {a: sum(of) for a, of in parts.items()}

    def block(rows: list[int]) -> tuple[list[int], int]:
        """Those of the lines that stand between surge and dive, and their weight."""
        surge, dive = surge_and_dive([weights[k] for k in rows])
        return rows[surge:dive], sum(weights[k] for k in rows[surge:dive])

    article = max((k for k in size if k > 0), key=lambda k: (size[k], -k), default=0)
    beside, rival = block([k for k, x in enumerate(found) if x.article <= 0])
    if article and size[article] and MARKED * size[article] >= rival:
        keep = _between_menus([x for x in found if x.article == article])
    else:
        main = [k for k, x in enumerate(found) if x.article == -1]
        rival = block([k for k, x in enumerate(found) if not x.article])[1]
        marked = bool(size.get(-1)) and MARKED * size[-1] >= rival
        part = main if marked else beside
        surging = {a for a, of in parts.items() if a > 0 and any(r[2] >= SURGE for r in runs(of))}
        keep = [x for k, x in enumerate(found) if part and part[0] <= k <= part[-1] or x.article in surging]
        if not marked:
            keep = _no_menus(keep)
    return "\n\n".join(x.text for x in keep)


def _between_menus(found: list[Line]) -> list[Line]:
    """From the first surge of text to the last dive: every line weighs what it has, but those of a menu nothing."""
    weights: list[int] = []
    for linked, some in groupby(found, key=lambda x: x.linked >= len(x.text)):
        rows = list(some)
        weights += [0 if linked and len(rows) >= MENU else len(x.text) for x in rows]
    spans = runs(weights)
    return found[spans[0][0] : spans[-1][1]] if spans else found


def _no_menus(found: list[Line]) -> list[Line]:
    """Without ``MENU`` or more lines in a row that are links only; fewer are paragraphs of the text."""
    out: list[Line] = []
    for linked, some in groupby(found, key=lambda x: x.linked >= len(x.text)):
        rows = list(some)
        if not linked or len(rows) < MENU:
            out += rows
    return out


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h) for h in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "url")), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of ``pages(page_id, url, html)``."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
