"""Text of the first element that a CSS selector picks.

A selector is compiled once and matched while a page is read: each open element
holds which steps of the selector end at it, so a page takes time linear in its
length and no tree is kept.  All selectors of a column share one reading, which
ends when each has its text.

Known are types, ``*``, ``#id``, ``.class``, attributes with all operators,
``:not()``, ``:is()`` and ``:where()`` of compounds, ``:root``, ``:first-child``,
``:first-of-type``, ``:nth-child()`` and ``:nth-of-type()``, the combinators space,
``>``, ``+`` and ``~``, and lists.  What depends on what follows an element
(``:last-child``, ``:has()``) is not, and counts as an invalid selector.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from weftwork.functions.pages import UNREAD, Stream, clean, in_slices

_NAME = r"(?:[\w\-\u0080-\U0010ffff]|\\.)+"
_PART = re.compile(
    rf"""(?P<all>\*)|\#(?P<id>{_NAME})|\.(?P<cls>{_NAME})|(?P<tag>{_NAME})
    |\[\s*(?P<attr>{_NAME})\s*(?:(?P<op>[~|^$*]?=)\s*(?:"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<bare>{_NAME}))\s*(?P<flag>[iIsS]?)\s*)?\]
    |:(?P<pseudo>[a-z-]+)(?:\((?P<args>[^()]*)\))?""",
    re.X,
)
_COMBINATOR = re.compile(r"\s*([>+~])\s*|\s+")
_NTH = re.compile(r"\s*(?:(odd|even)|([+-]?\d*)n(?:\s*([+-])\s*(\d+))?|([+-]?\d+))\s*", re.I)


class SelectorError(ValueError):
    """A selector that cannot be read, or asks for what is not known."""


def _plain(name: str) -> str:
    return re.sub(r"\\(.)", r"\1", name)


def _nth(args: str | None) -> tuple[int, int]:
    """(a, b) of an+b."""
    m = _NTH.fullmatch(args or "")
    if not m:
        raise SelectorError(f"not a position: {args!r}")
    if m[1]:
        return 2, int(m[1].lower() == "odd")
    if m[5]:
        return 0, int(m[5])
    a = int(m[2] + "1") if m[2] in ("", "+", "-") else int(m[2])
    return a, int((m[3] or "+") + (m[4] or "0"))


class Compound:
    """Tests of one element."""

    def __init__(self) -> None:
        self.tag: str | None = None
        self.tests: list = []

    def add(self, m: re.Match) -> None:
        if m["tag"]:
            self.tag = _plain(m["tag"]).lower()
        elif m["id"]:
            self.tests.append(lambda e, v=_plain(m["id"]): e.attrs.get("id") == v)
        elif m["cls"]:
            self.tests.append(lambda e, v=_plain(m["cls"]): v in e.attrs.get("class", "").split())
        elif m["attr"]:
            self._attribute(m)
        elif m["pseudo"]:
            self._pseudo(m["pseudo"], m["args"])

    def _attribute(self, m: re.Match) -> None:
        name, op, low = _plain(m["attr"]).lower(), m["op"], (m["flag"] or "").lower() == "i"
        value = next((x for x in (m["dq"], m["sq"]) if x is not None), None)
        value = _plain(m["bare"] or "") if value is None else value
        value = value.lower() if low else value
        fits = {
            None: lambda x: True,
            "=": lambda x: x == value,
            "~=": lambda x: value in x.split(),
            "|=": lambda x: x == value or x.startswith(value + "-"),
            "^=": lambda x: value != "" and x.startswith(value),
            "$=": lambda x: value != "" and x.endswith(value),
            "*=": lambda x: value != "" and value in x,
        }[op]
        self.tests.append(lambda e: name in e.attrs and fits(e.attrs[name].lower() if low else e.attrs[name]))

    def _pseudo(self, name: str, args: str | None) -> None:
        if name in ("not", "is", "where") and args is not None:
            inner = [_compound(x) for x in args.split(",")]
            self.tests.append(lambda e: any(x.fits(e) for x in inner) != (name == "not"))
        elif name == "root" and args is None:
            self.tests.append(lambda e: e.depth == 1)
        elif name in ("nth-child", "nth-of-type", "first-child", "first-of-type"):
            if name.startswith("first") != (args is None):
                raise SelectorError(f"wrong arguments of :{name}")
            a, b = (0, 1) if args is None else _nth(args)
            place = "of_type" if name.endswith("type") else "place"

            def fits(e) -> bool:
                off = getattr(e, place) - b
                return off == 0 if a == 0 else off % a == 0 and off // a >= 0

            self.tests.append(fits)
        else:
            raise SelectorError(f"unknown: :{name}")

    def fits(self, element) -> bool:
        return (self.tag is None or element.tag == self.tag) and all(test(element) for test in self.tests)


def _read_compound(text: str, at: int) -> tuple[Compound, int]:
    out, begin = Compound(), at
    while m := _PART.match(text, at):
        if (m["tag"] or m["all"]) and at > begin:
            break
        out.add(m)
        at = m.end()
    if at == begin:
        raise SelectorError(f"nothing to select at {text[at:]!r}")
    return out, at


def _compound(text: str) -> Compound:
    text = text.strip()
    out, at = _read_compound(text, 0)
    if at < len(text):
        raise SelectorError(f"not one compound: {text!r}")
    return out


class Selector:
    """A compiled list of selectors; its steps are numbered throughout."""

    def __init__(self, text: str):
        self.steps: list[tuple[str | None, Compound]] = []  # combinator before it, None for a first step
        self.ends = 0  # bits of the last steps
        at, fresh = 0, True
        text = text.strip()
        while True:
            before = None
            if not fresh:
                m = _COMBINATOR.match(text, at)
                if not m:
                    raise SelectorError(f"unexpected: {text[at:]!r}")
                before, at = m[1] or " ", m.end()
            made, at = _read_compound(text, at)
            self.steps.append((before, made))
            fresh = False
            if m := re.compile(r"\s*,\s*").match(text, at):
                self.ends |= 1 << len(self.steps) - 1
                at, fresh = m.end(), True
            elif at == len(text):
                self.ends |= 1 << len(self.steps) - 1
                return

    def mask(self, element, parent: int, above: int, sibling: int, siblings: int) -> int:
        """The steps that end at an element, by those of its parent, all ancestors, the sibling before it and all of those."""
        held = {">": parent, " ": above, "+": sibling, "~": siblings}
        out = 0
        for i, (before, compound) in enumerate(self.steps):
            if (before is None or held[before] >> i - 1 & 1) and compound.fits(element):
                out |= 1 << i
        return out


class Element:
    """An open element: its masks (one for each selector), those above it, and what is known of its children so far."""

    __slots__ = ("tag", "attrs", "depth", "place", "of_type", "masks", "above", "last", "before", "children", "types")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None, n: int):
        self.tag, self.attrs = tag, attrs
        self.masks, self.above, self.last, self.before = [0] * n, [0] * n, [0] * n, [0] * n
        self.children, self.types = 0, Counter()
        self.depth = self.place = self.of_type = 0
        if parent is not None:
            parent.children += 1
            parent.types[tag] += 1
            self.depth, self.place, self.of_type = parent.depth + 1, parent.children, parent.types[tag]


class _Done(Exception):
    pass


class Picked(Stream):
    """The texts of the first elements that the selectors pick; None where there is none."""

    def __init__(self, page: str, selectors: Sequence[Selector | None]):
        self.selectors = selectors
        self.found: list[tuple[Element, list[str]] | None] = [None] * len(selectors)
        self.within: list[int] = []  # selectors whose element is open
        self.waiting = sum(x is not None for x in selectors)
        try:
            super().__init__(page)
        except _Done:
            pass
        self.texts = [None if x is None else " ".join(x[1]) for x in self.found]

    def entered(self, tag, attrs, parent):
        element = Element(tag, attrs, parent, len(self.selectors))
        if parent is None:
            if not self.waiting:
                raise _Done
            return element
        for i, selector in enumerate(self.selectors):
            if selector is not None and self.found[i] is None:
                mask = selector.mask(element, parent.masks[i], parent.above[i], parent.last[i], parent.before[i])
                element.masks[i], element.above[i] = mask, parent.above[i] | mask
                parent.last[i], parent.before[i] = mask, parent.before[i] | mask
                if mask & selector.ends:
                    self.found[i] = element, []
                    self.within.append(i)
        return element

    def left(self, element):
        for i in [x for x in self.within if self.found[x][0] is element]:
            self.within.remove(i)
            self.waiting -= 1
        if not self.waiting:
            raise _Done

    def read(self, element, text):
        if self.within and element.tag not in UNREAD and (text := clean(text)):
            for i in self.within:
                self.found[i][1].append(text)


def compiled(selectors: Sequence[str]) -> list[Selector | None]:
    """Compiled selectors, None for those that are not valid."""
    out: list[Selector | None] = []
    for x in selectors:
        try:
            out.append(Selector(x))
        except SelectorError:
            out.append(None)
    return out


def selected_texts(page: Column, selectors: Sequence[str]) -> Column:
    """An array with the text of the first element for each selector; empty if there is none, or for an invalid selector."""
    names = list(selectors)

    @F.arrow_udf("array<string>")
    def run(pages: pa.Array) -> pa.Array:
        made = compiled(names)
        return in_slices(lambda some: [[x or "" for x in Picked(p or "", made).texts] for p in some], pa.list_(pa.string()), pages)

    return run(page)
