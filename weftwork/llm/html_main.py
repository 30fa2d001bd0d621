"""Main text of web pages by a maximum-scoring run of tokens.

A page becomes a sequence of words and tags.  Plain words score positive, tags,
link words and words inside boilerplate elements negative; the weights are log
odds counted on labelled pages.  One linear scan finds the contiguous run of the
highest total, the content region.  Its words are returned block by block, without
those inside boilerplate elements.

What an element is follows from the log odds of its names and from where it
stands, never from its size.  An element is hard boilerplate (menus, headers,
footers, comments, notices, adverts), mixed (its name also says something else)
or soft (sidebars, forms, and names that are often given to content too).  An
article within an article is a comment.  A form around a heading or main, and a
soft element around main, only wrap the page.  Where the region has no plain word,
soft elements are read as content, and if it still has none, mixed ones; hard ones
never are.

An element without an end tag counts only if it is hard: comments, footers and
others that follow an article end with their parent, the rest at the next main,
article or h1, without which they are no elements.  A quoted
attribute ends at its quote; if there is none on the rest of the page, its tag
ends at the next ``>``.

Null html is empty.  A page without words has an empty text.  Pages are
independent, so repeated rows or urls do not matter.  Time is linear in a page's
length, whatever its markup.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_PIECES = re.compile(r"[a-z]+")
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r">|=\s*([\"'])")
_RAW_END = {x: re.compile(rf"</{x}[\s/>]", re.I) for x in "script style noscript template textarea svg iframe object".split()}

# HTML's void elements, and its elements that do not break a line.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())

#: Names of elements, classes, ids and roles with which the labelled pages mark boilerplate that no page's text is in,
HARD = (
    "nav menu navbar navigation header masthead topbar footer contentinfo comment comments commentlist commentform respond replies discussion disqus ad ads advert advertisement adsense "
    "sponsor sponsored promo banner cookie cookies consent notice gdpr subscribe newsletter related recommended breadcrumb breadcrumbs pagination pager popup modal dialog alertdialog toolbar copyright"
).split()
#: boilerplate that some pages put their text in,
SOFT = "sidebar aside complementary widget form search login signup share social legal head title button select figure".split()
#: and content.
CONTENT = "article main content post entry story body text page section".split()

#: Boilerplate as elements, but not as pieces of a class or id (entry-title, card-head).
ELEMENTS_ONLY = set("head title button select figure legal form".split())
#: Hard boilerplate that follows an article.
AFTER = set("comment comments commentlist commentform respond replies discussion disqus footer contentinfo related recommended copyright".split())
#: Elements that only a whole hard name makes boilerplate; names that stand for content if they are a whole name's only known pieces.
KEPT, STRONG = {"article", "main"} | HEADINGS, set("article main content post entry story".split())
#: What follows such a piece tells what an element has beside it, what precedes ``free`` what it lacks, not what it is.
_BESIDE = re.compile(r"(?:^|[-_])(?:has|with|without|no|category|tag)[-_].*$")


def tokens(page: str) -> list[tuple[bool, str | None, str]]:
    """(is an end tag, name or None for text, attributes or text) of a page's tags and texts."""
    out: list[tuple[bool, str | None, str]] = []
    at, size, lacking = 0, len(page), set()  # quotes and ends that the rest of the page lacks
    cut = page.rfind(">") + 1  # behind it no tag can end
    text = 0  # where the text before ``at`` begins

    def flush(to: int) -> None:
        if to > text:
            out.append((False, None, page[text:to]))

    while (at := page.find("<", at, cut)) >= 0:
        if page.startswith("<!--", at):
            flush(at)
            end = page.find("-->", at + 2)
            text = at = size if end < 0 else end + 3
            if end < 0:  # a comment that does not end hides what is left
                return out
            continue
        match = _TAG.match(page, at, cut)
        if not match:
            flush(at)
            if page[at + 1 : at + 2] in ("!", "?", "/"):
                text = at = page.index(">", at) + 1
            else:  # no markup
                text, at = at, at + 1
            continue
        flush(at)
        end = _tag_end(page, match.end(), lacking)
        name = match[2].lower()
        out.append((bool(match[1]), name, page[match.end() : end - 1]))
        text = at = end
        if not match[1] and name in _RAW_END and name not in lacking:
            close = _RAW_END[name].search(page, end)
            if close:
                text = at = page.find(">", close.start(), size) + 1 or size
                out[-1] = (False, "wbr", "")  # what is not read only parts inline texts
                continue
            if name in ("script", "style"):
                return out[:-1]
            lacking.add(name)
    flush(size)
    return out


def _tag_end(page: str, at: int, lacking: set[str]) -> int:
    """The place behind the ``>`` of a tag, of which there is one."""
    while stop := _STOP.search(page, at):
        if stop[1] is None:
            return stop.end()
        at = page.find(stop[1], stop.end()) + 1 if stop[1] not in lacking else 0
        if not at:
            lacking.add(stop[1])
            at = page.find(">", stop.end())
            break
    return at + 1 if 0 < at < len(page) and page[at] == ">" else len(page)


#: Sentences of the labelled pages.
_PROSE = ("The council met on Monday and heard what the engineers had found", "Nobody had expected the river to rise that fast", "A second survey is planned for the spring, when the ground is dry")


#: Labelled pages for each name.
ROUNDS = 8


def labelled_pages() -> Iterator[list[tuple[list[str], str, bool]]]:
    """Labelled pages by rule: segments (pieces of the element's name, html inside, is it content).

    Each page has a menu of links, an article of some paragraphs with a link here
    and there, and boilerplate as it is found around articles: link lists, short
    notices, and comments of whole sentences, some under names that also hold a
    piece of the content's.  All names take turns in all places.
    """
    marks = [*HARD, *SOFT]
    n = len(marks)
    for i in range(n * ROUNDS):
        body = CONTENT[i % len(CONTENT)]
        prose = [f"<p>{_PROSE[(i + j) % 3]}. {_PROSE[(i + j + 1) % 3]}{', <a>as reported</a>' if j % 3 == 1 else ''}.</p>" for j in range(3 + i % 4)]
        if i % 2:
            prose.append(f"<ul><li>{_PROSE[i % 3]}</li><li><a>What the survey found</a></li></ul>")
        links = "".join(f"<li><a>{x}</a></li>" for x in ("Home", "World news", "Sports", "About us")[: 2 + i % 3])
        said = f"<div><b>A reader</b><p>{_PROSE[i % 3]}, I think{', see <a>this page</a>' if i % 3 == 0 else ''}.</p></div><div><b>Another</b><p>I agree.</p></div>"
        yield [
            ([marks[i % n]], f"<ul>{links}</ul>", False),
            ([body], f"<h1>{_PROSE[i % 3]}</h1>{''.join(prose)}", True),
            ([body, marks[(i + n // 3) % n]], f"<div><span>Short words</span> <a>and a link</a></div><ul>{links}</ul>", False),
            ([marks[(i + 2 * n // 3) % n]], said, False),
        ]


def _kinds(page: list[tuple[bool, str | None, str]]) -> Iterator[tuple[str, int, str | None]]:
    """(kind, words or 1, text or None) of each token: word, cited (of a link in a paragraph or heading), link, inline or block."""
    link = prose = False
    for end, tag, text in page:
        if tag is None:
            yield "word" if not link else "cited" if prose else "link", len(text.split()), text
        elif tag in INLINE:
            if tag == "a":
                link = not end
            yield "inline", 1, None
        else:
            prose = not end and (tag == "p" or tag in HEADINGS)
            yield "block", 1, None


class Weights:
    """Log odds of content for names of elements, for words and for tags, counted on labelled pages."""

    def __init__(self) -> None:
        names, seen = {True: Counter(), False: Counter()}, {True: Counter(), False: Counter()}
        for page in labelled_pages():
            for own, segment, content in page:
                names[content].update(own)
                for what, n, _ in _kinds(tokens(segment)):
                    seen[content][what] += n

        def odds(table: dict[bool, Counter], x: str) -> float:
            return math.log((table[True][x] + 0.5) / (sum(table[True].values()) + 1)) - math.log((table[False][x] + 0.5) / (sum(table[False].values()) + 1))

        self.names = {x: odds(names, x) for x in {*names[True], *names[False]}}
        # a tag stands for all words of its element, so its odds are shared out over the words that content has for each such tag
        self.scores = {x: odds(seen, x) * (seen[True][x] / seen[True]["word"] if x in ("inline", "block") else 1.0) for x in ("word", "cited", "link", "inline", "block")}

    def piece(self, text: str) -> str:
        """The known name that a piece of a class or id stands for, else the piece."""
        return text if text in self.names else text[:-1] if text.endswith("s") and text[:-1] in self.names else text

    def kind(self, tag: str, attributes: str) -> str | None:
        """hard, mixed or soft for a boilerplate element, None for others."""
        total = 0.0 if tag in KEPT else self.names.get(tag, 0.0)
        hard, mixed = tag not in KEPT and tag in _HARD, False
        for match in _NAMES.finditer(attributes):
            for name in (match[1] or match[2] or match[3] or "").lower().split():
                pieces = [self.piece(x) for x in _PIECES.findall(_BESIDE.sub("", name))]
                known = [x for x in pieces if x in self.names and x not in ELEMENTS_ONLY]
                bad = [x for x in known if x in _HARD]
                if bad and len(bad) == len(pieces):
                    return "hard"
                if known and len(known) == len(pieces) and all(x in STRONG for x in known):
                    return None
                mixed = mixed or bool(bad)
                total += sum(self.names[x] for x in known)
        if tag in KEPT or total > -1.0:
            return None
        return "hard" if hard else "mixed" if mixed else "soft"

    def follows(self, tag: str, attributes: str) -> bool:
        """Whether names say what stands behind an article."""
        return tag in AFTER or any(self.piece(x) in AFTER for match in _NAMES.finditer(attributes) for x in _PIECES.findall((match[1] or match[2] or match[3] or "").lower()))


_HARD = set(HARD)
WEIGHTS = Weights()


def extents(page: list[tuple[bool, str | None, str]]) -> tuple[list[int], list[bool], list[int]]:
    """Where each element ends, whether its own end tag does so (others end with what holds them), and the element that holds it (-1: none)."""
    until, closed, parent = [len(page)] * len(page), [False] * len(page), [-1] * len(page)
    held: list[int] = []
    places: dict[str, list[int]] = {}  # of each name in ``held``
    for i, (end, tag, _) in enumerate(page):
        if tag is None or tag in VOID:
            continue
        own = places.setdefault(tag, [])
        if not end:
            parent[i] = held[-1] if held else -1
            own.append(len(held))
            held.append(i)
        elif own:
            at = own[-1]
            closed[held[at]] = True
            for j in held[at:]:
                until[j] = i
                places[page[j][1]].pop()
            del held[at:]
    return until, closed, parent


class Hidden:
    """Which tokens lie in boilerplate elements."""

    def __init__(self, page: list[tuple[bool, str | None, str]], weights: Weights):
        self.page, self.weights = page, weights
        self.until, self.closed, self.parent = extents(page)
        self.prose = {self.parent[i] for i, (end, tag, _) in enumerate(page) if tag == "p" and not end}  # elements with paragraphs of their own
        self.kinds = {i: kind for i, (end, tag, text) in enumerate(page) if tag is not None and not end and tag not in VOID and tag not in ("html", "body") and (kind := weights.kind(tag, text))}
        self.mains = self._before({"main"})
        self.titles = self._before({"main", "h1"})
        self.heads = self._before({"main", "article", "h1"})

    def _before(self, tags: set[str]) -> list[int]:
        """How many elements of these names begin before each token."""
        out = [0]
        for end, tag, _ in self.page:
            out.append(out[-1] + (not end and tag in tags))
        return out

    def _wraps(self, i: int, tag: str) -> bool:
        counts = self.titles if tag == "form" else self.mains
        return counts[self.until[i]] > counts[i + 1]

    def _ends(self, i: int, kind: str, tag: str, text: str) -> int:
        """Where a boilerplate element ends: without an end tag, with its parent if it follows articles, else at the next main, article or h1, or nowhere."""
        if self.closed[i] or kind == "hard" and self.weights.follows(tag, text):
            return self.until[i]
        if kind == "hard" and self.heads[self.until[i]] > self.heads[i + 1]:
            return bisect_right(self.heads, self.heads[i + 1]) - 1
        return i

    def flags(self, read: frozenset[str] = frozenset()) -> list[int]:
        """For each token 0, or if it is hidden 1, or 2 if it parts content: in an article, main, or among an element's paragraphs.

        Elements of the kinds ``read`` are not hidden.
        """
        out, hidden, article, main, how = [], 0, 0, 0, 1  # the tokens until which all is hidden, in an article, and in main
        for i, (end, tag, text) in enumerate(self.page):
            if i >= hidden and tag is not None and not end:
                kind = self.kinds.get(i)
                if tag == "article" and i < article:
                    kind = "hard"
                elif kind == "soft" and self._wraps(i, tag) or kind in read or tag in ("header", "figure", "hgroup") and i < article:
                    kind = None
                ends = self._ends(i, kind, tag, text) if kind else i
                if ends > i:
                    hidden = ends
                    how = 2 if i < article or i < main or self.parent[i] in self.prose else 1
                elif tag == "article":
                    article = max(article, self.until[i])
                elif tag == "main":
                    main = max(main, self.until[i])
            out.append(how if i < hidden else 0)
        return out


def token_scores(kinds: list[tuple[str, int, str | None]], flags: list[int], weights: Weights) -> list[float]:
    """What the scan adds up: boilerplate outside content costs as much as its words would give, within content it costs as one tag."""
    out, before = [], 0
    for (kind, n, text), flag in zip(kinds, flags):
        if flag == 2:
            out.append(weights.scores["block"] if before != 2 else 0.0)
        elif flag == 1 and text is not None:
            out.append(-weights.scores["word"] * n)
        else:
            out.append(weights.scores[kind] * n)
        before = flag
    return out


def best_run(scores: list[float]) -> tuple[int, int]:
    """The bounds of the contiguous run of the highest total, the first of equal ones; empty if none is above 0."""
    best = total = 0.0
    start = first = last = 0
    for i, score in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += score
        if total > best:
            best, first, last = total, start, i + 1
    return first, last


def main_text(page: str, weights: Weights = WEIGHTS) -> str:
    """The text of the content region, one line for each block."""
    found = tokens(page)
    kinds = list(_kinds(found))
    hidden = Hidden(found, weights)
    for read in (frozenset(), frozenset({"soft"}), frozenset({"soft", "mixed"})):
        flags = hidden.flags(read)
        first, last = best_run(token_scores(kinds, flags, weights))
        if any(n and text is not None and not flag and kind == "word" for (kind, n, text), flag in zip(kinds[first:last], flags[first:last])):
            break
    else:
        return ""
    blocks, block = [], []
    for (end, tag, text), flag in [*zip(found[first:last], flags[first:last]), ((False, "div", ""), False)]:
        if tag is None:
            if not flag:
                block.append(text)
        elif tag == "br":
            block.append(" ")
        elif tag not in INLINE:
            line = " ".join(html.unescape("".join(block)).split())
            if line:
                blocks.append(line)
            block = []
    return "\n".join(blocks)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x or "") for x in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_main_text(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, the main text and its length in code points."""
    return pages.select("page_id", "url", "html").mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")
