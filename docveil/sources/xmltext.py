"""XML parts as a flat list of tokens, rewritten with a stack of open elements; untouched text stays as it is."""

from __future__ import annotations

import re
from collections.abc import Callable
from enum import Enum

LEXER = re.compile(r"""<!--.*?-->|<!\[CDATA\[.*?\]\]>|<[?!][^>]*>|<(?P<close>/?)(?P<name>[^\s/>!?]+)(?P<rest>(?:[^>"']|"[^"]*"|'[^']*')*)>""", re.S)
PAIR = re.compile(r"""([^\s=/"']+)\s*=\s*("[^"]*"|'[^']*')""")


class Do(Enum):
    KEEP = 0
    DROP = 1  # the element with all that is in it
    UNWRAP = 2  # its tags only


class Tag:
    """A start tag; ``write`` sets attributes and keeps the others in their places."""

    def __init__(self, text: str, name: str, rest: str) -> None:
        self.text, self.name, self.empty = text, name.lower(), rest.rstrip().endswith("/")
        self.rest = rest

    def get(self, name: str) -> str:
        for m in PAIR.finditer(self.rest):
            if m[1].rpartition(":")[2].lower() == name.lower():
                return m[2][1:-1]
        return ""

    def write(self, **values: str) -> None:
        left = {k.lower(): (k, v) for k, v in values.items()}
        cells: list[str] = []
        at = 0
        for m in PAIR.finditer(self.rest):
            if found := left.pop(m[1].rpartition(":")[2].lower(), None):
                cells += [self.rest[at : m.start(2)], f'"{found[1]}"']
                at = m.end(2)
        tail = self.rest[at:]
        body = tail.rstrip().removesuffix("/").rstrip()
        cells += [body, *(f' {k}="{v}"' for k, v in left.values()), tail[len(body) :]]
        start = len(self.text) - len(self.rest) - 1
        self.rest = "".join(cells)
        self.text = f"{self.text[:start]}{self.rest}>"


def rewrite(xml: str, decide: Callable[[Tag], Do]) -> str:
    """The part with every element kept, dropped or unwrapped as ``decide`` says of its start tag, whatever is nested in it."""
    out: list[str] = []
    open_: list[tuple[str, Do]] = []
    dropped = at = 0  # how many open elements are dropped
    for m in LEXER.finditer(xml):
        if not dropped:
            out.append(xml[at : m.start()])
        at = m.end()
        if m["name"] is None:
            out += [] if dropped else [m[0]]
        elif m["close"]:
            name, place = m["name"].lower(), len(open_) - 1
            while place >= 0 and open_[place][0] != name:
                place -= 1
            if place < 0:  # closes nothing
                out += [] if dropped else [m[0]]
                continue
            kept = open_[place][1] is Do.KEEP
            dropped -= sum(what is Do.DROP for _, what in open_[place:])
            del open_[place:]
            if kept and not dropped:
                out.append(m[0])
        else:
            tag = Tag(m[0], m["name"], m["rest"])
            what = Do.DROP if dropped else decide(tag)
            if not tag.empty:
                open_.append((tag.name, what))
                dropped += what is Do.DROP
            if what is Do.KEEP and not dropped:
                out.append(tag.text)
    if not dropped:
        out.append(xml[at:])
    return "".join(out)


def without_hollow(xml: str, element: str, ignored: str) -> str:
    """The part without the elements in which nothing but one ``ignored`` element and blanks is left."""
    out: list[str] = []
    starts: list[int] = []  # where open elements of that name begin in out
    full: list[bool] = []
    skipping = at = 0

    def put(text: str, counts: bool) -> None:
        out.append(text)
        if counts and not skipping:
            full[:] = [True] * len(full)

    for m in LEXER.finditer(xml):
        put(xml[at : m.start()], bool(xml[at : m.start()].strip()))
        at = m.end()
        name = (m["name"] or "").lower()
        empty = bool(m["name"]) and not m["close"] and m["rest"].rstrip().endswith("/")
        if name == element and not m["close"] and not empty:
            full[:] = [True] * len(full)
            starts.append(len(out))
            full.append(False)
            out.append(m[0])
        elif name == element and m["close"] and starts:
            begin, kept = starts.pop(), full.pop()
            if kept:
                out.append(m[0])
            else:
                del out[begin:]
        elif name == ignored and starts:
            skipping += 0 if empty else -1 if m["close"] else 1
            out.append(m[0])
        else:
            put(m[0], True)
    return "".join(out) + xml[at:]
