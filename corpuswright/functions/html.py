"""HTML pages as flat event lists; runs on Arrow batches of pages.

A page is read once into events in document order. Every element knows where its
subtree ends, so an area is a range of events and a dropped element a jump.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from itertools import accumulate
from typing import NamedTuple
from urllib.parse import urljoin

VOID = frozenset(
    "area base br col embed hr img input keygen link menuitem meta param source track wbr "
    "basefont bgsound command frame image isindex nextid spacer".split()
)
TEXT_DROP = frozenset(("script", "style", "nav", "footer", "header"))
CONTENT_DROP = TEXT_DROP | {"aside"}
UNSEEN = frozenset(("script", "style", "template"))
VERBATIM = frozenset(("pre", "textarea"))
BLOCKS = frozenset("p div section h1 h2 h3 h4 h5 h6 blockquote pre ul ol li br hr".split())
AREA_CLASS = re.compile(r"(content|article|post|entry)", re.I)

#: Areas that may hold the main content, the best first.
AREAS: tuple[Callable[[Event], bool], ...] = (
    lambda e: e.tag == "article",
    lambda e: e.tag == "main",
    lambda e: e.attrs.get("id") == "js_content",
    lambda e: any(map(AREA_CLASS.search, e.attrs.get("class", "").split())),
    lambda e: e.tag == "body",
)


class Event(NamedTuple):
    """``tag`` is empty for text and ``!`` for a comment; ``parent`` is an event's number."""

    tag: str
    attrs: dict
    text: str
    parent: int


class Page(HTMLParser):
    """Events of a page with ``end``, the number after each one's subtree."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.events: list[Event] = [Event("html-page", {}, "", -1)]
        self.end: list[int] = [0]
        self._open, self._data = [0], []
        self.feed(html)
        self.close()
        self._close_to(0)
        self.end[0] = len(self.events)

    def _add(self, tag: str, attrs: dict, text: str) -> None:
        self.events.append(Event(tag, attrs, text, self._open[-1]))
        self.end.append(len(self.events))

    def _text(self) -> None:
        data = "".join(self._data)
        self._data.clear()
        if data and not data.strip() and not any(self.events[i].tag in VERBATIM for i in self._open):
            data = "\n" if "\n" in data else " "
        if data:
            self._add("", {}, data)

    def _close_to(self, depth: int) -> None:
        """Close all elements above ``depth`` open ones; an element ends where the page stands now."""
        self._text()
        for i in self._open[depth + 1 :]:
            self.end[i] = len(self.events)
        del self._open[depth + 1 :]

    def handle_starttag(self, tag, attrs):
        self._text()
        self._add(tag, {k: v or "" for k, v in reversed(attrs)}, "")
        if tag not in VOID:
            self._open.append(len(self.events) - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._close_to(len(self._open) - 2)

    def handle_endtag(self, tag):
        depths = [d for d, i in enumerate(self._open) if d and self.events[i].tag == tag]
        self._close_to(depths[-1] - 1 if depths else len(self._open) - 1)

    def handle_data(self, data):
        self._data.append(data)

    def handle_comment(self, data):
        self._text()
        self._add("!", {}, data)

    def inside(self, top: int, drop=frozenset()) -> Iterator[int]:
        """Numbers of the events below ``top``, without dropped elements."""
        at = top + 1
        while at < self.end[top]:
            if self.events[at].tag in drop:
                at = self.end[at]
            else:
                yield at
                at += 1

    def texts(self, top: int, drop=frozenset()) -> list[str]:
        return [self.events[i].text for i in self.inside(top, drop | UNSEEN) if not self.events[i].tag]

    def find(self, test: Callable[[Event], bool], drop=frozenset(), top: int = 0) -> int | None:
        return next((i for i in self.inside(top, drop) if self.events[i].tag not in ("", "!") and test(self.events[i])), None)


def page_text(html: str) -> str:
    """Visible text: trimmed phrases, one per line, blank ones dropped."""
    page = Page(html)
    phrases = (p.strip() for line in "".join(page.texts(0, TEXT_DROP)).splitlines() for p in line.strip().split("  "))
    return "\n".join(filter(None, phrases))


def _image(page: Page, at: int, base_url: str):
    attrs = page.events[at].attrs
    src = attrs.get("src") or attrs.get("data-src") or ""
    if src and base_url and not src.startswith("http"):
        src = urljoin(base_url, src)
    return ("image", (src, attrs.get("alt", ""))) if src else None


def _code(page: Page, at: int, _: str):
    inner = page.find(lambda e: e.tag == "code", CONTENT_DROP, at)
    if inner is None:
        return None
    named = re.findall(r"(?:^|\s)lang(?:uage)?-(\S*)", page.events[inner].attrs.get("class", ""))
    return "code", (named[0] if named else "", "".join(page.texts(inner, CONTENT_DROP)))


def _heading(page: Page, at: int, _: str):
    text = "".join(map(str.strip, page.texts(at, CONTENT_DROP)))
    return ("heading", (int(page.events[at].tag[1]), text)) if text else None


def _plain(page: Page, at: int, _: str):
    text = page.events[at].text.strip()
    return ("text", text) if text else None


READERS = {"": _plain, "!": _plain, "img": _image, "pre": _code, **{f"h{i}": _heading for i in range(1, 7)}}


def page_material(html: str, base_url: str) -> dict:
    """Title, ordered text with image marks, images, code blocks and headings."""
    page = Page(html)
    area = next((i for i in (page.find(test, CONTENT_DROP) for test in AREAS) if i is not None), 0)
    title = page.find(lambda e: e.tag == "title")
    found = [READERS[page.events[i].tag](page, i, base_url) for i in page.inside(area, CONTENT_DROP) if page.events[i].tag in READERS]
    found = [f for f in found if f]
    images = [value for kind, value in found if kind == "image"]
    numbers = accumulate((kind == "image" for kind, _ in found), initial=0)
    shown = {
        "text": lambda value, n: value,
        "image": lambda value, n: f"[IMAGE_{n}: {value[1] or 'image'}]",
        "code": lambda value, n: f"\n```{value[0]}\n{value[1]}\n```\n",
    }
    parts = [(kind, shown[kind](value, n)) for (kind, value), n in zip(found, numbers, strict=False) if kind in shown]
    # text up to and with each image; parts are joined by line breaks
    ends = accumulate(len(text) + (i > 0) for i, (_, text) in enumerate(parts))
    places = [end for (kind, _), end in zip(parts, ends, strict=True) if kind == "image"]
    return {
        "title": "" if title is None else "".join(e.text for e in page.events[title : page.end[title]] if not e.tag and e.parent == title),
        "content": "\n".join(text for _, text in parts),
        "images": [
            {"url": src, "alt": alt, "local_path": "", "description": "", "idx": n, "position": place}
            for n, ((src, alt), place) in enumerate(zip(images, places, strict=True))
        ],
        "code_blocks": [{"language": v[0], "code": v[1], "comment": ""} for kind, v in found if kind == "code"],
        "headings": [{"level": v[0], "text": v[1]} for kind, v in found if kind == "heading"],
    }


def article_pieces(html: str) -> list[dict]:
    """The article area as pieces: some text, then an image (none in the last piece).

    Each image comes with what the decoration rules ask for. Pages without an
    article area give their visible text as one piece.
    """
    page = Page(html)
    none = {"src": None, "data_type": "", "width": "", "context": "", "position": 0.0}
    area = page.find(lambda e: e.attrs.get("id") == "js_content")
    if area is None:
        return [{"text": page_text(html), **none}]
    hidden = frozenset(("script", "style"))
    order = list(page.inside(area, hidden))
    # what is written when an event opens, and when a block's subtree ends
    closing: dict[int, int] = {}
    pieces, text = [], ["\n"] if page.events[area].tag in BLOCKS else []
    for rank, at in enumerate(order):
        text += ["\n"] * closing.pop(rank, 0)
        event = page.events[at]
        if event.tag in ("", "!"):
            text.append(event.text.strip())
        elif event.tag == "img":
            src = event.attrs.get("data-src") or event.attrs.get("src") or ""
            if src.startswith("http"):
                pieces.append(
                    {
                        "text": "".join(text),
                        "src": src,
                        "data_type": event.attrs.get("data-type", ""),
                        "width": event.attrs.get("data-w") or event.attrs.get("width") or "0",
                        "context": event.attrs.get("class", "") + "".join(page.texts(event.parent)),
                        "position": rank / len(order),
                    }
                )
                text = []
        elif event.tag in BLOCKS:
            text.append("\n")
            # the next visible event at or behind the end takes the closing break
            after = bisect_left(order, page.end[at])
            closing[after] = closing.get(after, 0) + 1
    text += ["\n"] * (closing.pop(len(order), 0) + (page.events[area].tag in BLOCKS))
    return [*pieces, {"text": "".join(text), **none}]
