"""Main text of web pages by differencing each page with its nearest neighbour on the same host.

Pages are ordered by host, URL path and id (a range partitioning: a large host spans many tasks). A page's partner is
the page before or after it on its host whose path has more in common with its own; one with other lines than the page itself goes
before a copy. Both pages become lines, one per block element, and the longest common subsequence of the two lists is what
the site's template put there: it is deleted, on every page.

Differencing alone can't give right results: menus and adverts change from page to page, and articles of one site may
share whole paragraphs. So markup guards its result in two ways: a line inside ``article`` or ``main`` is deleted only if it is nothing
but links, and lines of elements that HTML, ARIA roles or usual class names mark as navigation, headers, footers, sidebars,
notices, adverts, forms or comments never become text, shared or not. All other lines are decided by differencing. If
it leaves nothing of a page without an article (a copy of its partner), all unmarked lines stay.

The first and last page of each partition are decided in a second step, which sees the neighbours across the border, so the
number of partitions doesn't matter. Null and empty pages give an empty text. A page without a partner is not differenced. A null URL is a
host of its own. Repeated rows are pages of their own; null ids stay null; no rows give no rows; other columns aren't read.
Scanning takes time in proportion to a page's length, whatever is unclosed in it.
"""

from __future__ import annotations

import html as html_lib
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import give_back_memory, materialize

NAME = re.compile(r"/?([a-zA-Z][\w:-]*)")
PLAIN = re.compile(r"[^>\"']*")
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?![\w-])""", re.I)
WORD = re.compile(r"[a-z]+")
HIDDEN = re.compile(r"display\s*:\s*none")

LISTS = ("ul", "ol", "menu", "dir")
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "object", "svg", "math", "select", "button", "head", "audio", "video", "canvas"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr caption ul".split()
)
BOILERPLATE = {"nav", "footer", "aside", "form", "menu", "dialog", "fieldset"}
MAIN = {"article", "main"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "alertdialog", "menu", "menubar"}
NAMES = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice notices popup modal overlay newsletter "
    "subscribe signup social share sharing comment comments disqus replies respond sidebar widget menu nav navbar navigation breadcrumb breadcrumbs footer related "
    "pagination pager toolbar login search".split()
)
PAGE_NAMES = {"header", "masthead", "topbar", "banner", "alert"}  # only outside of an article
#: Words that may stand beside these in a class name, as in cookie-banner; with any other word it means something else.
BESIDE = set("area bar block body bottom box button buttons container content footer global group header inner item items left link links list main module page panel right section site sticky text title top wrap wrapper".split())
MARKED, INSIDE, LINKS = 1, 2, 4  # in a boilerplate element; in an article; nothing but links


def telling(token: str, names: set[str]) -> bool:
    words = set(WORD.findall(token))
    return bool(words & names) and words <= names | BESIDE


def marked(tag: str, attributes: str, inside: bool) -> bool:
    """Whether an element is boilerplate; inside: it stands in an article."""
    if tag in BOILERPLATE or (tag == "header" and not inside):
        return True
    if not attributes.strip(" /\t\n") or tag in MAIN or tag in ("body", "html"):
        return False
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name in ("class", "id"):
            names = NAMES if inside else NAMES | PAGE_NAMES
            if any(telling(token, names) for token in value.split()):
                return True
        elif name == "role" and value in ROLES or name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and HIDDEN.search(value):
            return True
    return False


class Scanner:
    """One pass over a page; every search that comes to the end of the page without finding is remembered."""

    def __init__(self, page: str) -> None:
        self.page, self.quotes = page, True
        self.lines: list[str] = []
        self.flags: list[int] = []
        self.stack: list[tuple[str, int]] = []  # tag and flags
        self.open_at: dict[str, list[int]] = {}
        self.held: list[str] = []
        self.plain, self.link, self.never = False, 0, set()

    def find(self, what: str, at: int) -> int:
        if what in self.never:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.never.add(what)
        return found

    def text(self, piece: str) -> None:
        self.held.append(piece)
        self.plain |= not self.link and not piece.isspace() and piece != ""

    def flush(self) -> None:
        if self.held:
            line = " ".join(html_lib.unescape("".join(self.held)).split())
            if line:
                self.lines.append(line)
                self.flags.append((self.stack[-1][1] if self.stack else 0) | (0 if self.plain else LINKS))
        self.held, self.plain = [], False

    def push(self, tag: str, flags: int) -> None:
        self.open_at.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, flags))

    def cut(self, place: int) -> None:
        while len(self.stack) > place:
            self.open_at[self.stack.pop()[0]].pop()

    def last(self, *tags: str) -> int:
        return max((self.open_at[t][-1] for t in tags if self.open_at.get(t)), default=-1)

    def tag_end(self, at: int) -> int:
        """Where the tag closes; quotes count until one tag of the page turns out to be unclosed because of them."""
        start = at
        while self.quotes:
            at = PLAIN.match(self.page, at).end()
            if at >= len(self.page):
                self.quotes = False
            elif self.page[at] == ">":
                return at
            else:
                end = self.find(self.page[at], at + 1)
                at = (end if end >= 0 else at) + 1
        return self.find(">", start)

    def run(self) -> tuple[list[str], list[int]]:
        page, at = self.page, 0
        while (start := self.find("<", at)) >= 0:
            self.text(page[at:start])
            if page.startswith("<!--", start):
                end = self.find("-->", start + 4)
                at = end + 3 if end >= 0 else len(page)
                continue
            name = NAME.match(page, start + 1)
            if name is None and page[start + 1 : start + 2] not in ("!", "?", "/"):
                self.text("<")
                at = start + 1
                continue
            end = self.tag_end(name.end() if name else start + 1)
            if end < 0:  # nothing closes any more
                at = start if name is None else len(page)
                break
            at = end + 1
            if name and page[start + 1] == "/":
                self.close(name[1].lower())
            elif name:
                at = self.open(name[1].lower(), page[name.end() : end], at)
        if at < len(page):
            self.text(page[at:])
        self.flush()
        return self.lines, self.flags

    def close(self, tag: str) -> None:
        if tag == "a":
            self.link = max(0, self.link - 1)
        place = self.last(tag)
        if tag in BLOCKS:
            self.flush()
            if place >= 0:
                self.cut(place)
        elif place >= 0 and place == len(self.stack) - 1:
            self.flush()
            self.cut(place)

    def open(self, tag: str, attributes: str, at: int) -> int:
        if tag in VOID:
            self.text(" ")
            if tag == "hr":
                self.flush()
            return at
        if tag in RAW:
            return self.raw(tag, attributes, at)
        flags = self.stack[-1][1] if self.stack else 0
        own = marked(tag, attributes, bool(flags & INSIDE))
        if tag in BLOCKS:
            self.flush()
            self.link = 0
            if self.stack and self.stack[-1][0] == "p":
                self.cut(len(self.stack) - 1)
            if tag == "li" and self.last("li") > self.last(*LISTS):
                self.cut(self.last("li"))
            flags = self.stack[-1][1] if self.stack else 0
            self.push(tag, flags | (MARKED if own else 0) | (INSIDE if tag in MAIN else 0))
        elif own:
            self.flush()
            self.push(tag, flags | MARKED)
        elif tag == "a":
            self.link += 1
        elif tag in ("td", "th"):
            self.text(" ")
        return at

    def raw(self, tag: str, attributes: str, at: int) -> int:
        """Past an element whose content isn't text; without an end it takes the rest, but for an unclosed head."""
        if not attributes.endswith("/") and ("/" + tag) not in self.never:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(self.page, at)
            if end is None:
                self.never.add("/" + tag)
            at = end.end() if end else at if tag == "head" else len(self.page)
        if tag not in ("script", "style", "noscript", "template"):
            self.text(" ")
        return at


def lines(page: str) -> tuple[list[str], list[int]]:
    """The page's lines and their flags."""
    return Scanner(page).run()


def shared(a: list[str], b: list[str]) -> set[int]:
    """Positions of a in a longest common subsequence of a and b (matches by position, then longest increasing run)."""
    where: dict[str, list[int]] = {}
    for j, line in enumerate(b):
        where.setdefault(line, []).append(j)
    tails: list[int] = []
    links: list[tuple] = []
    for i, line in enumerate(a):
        for j in reversed(where.get(line, ())):
            k = bisect_left(tails, j)
            link = (i, links[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                links.append(link)
            else:
                tails[k], links[k] = j, link
    out, link = set(), links[-1] if links else None
    while link:
        out.add(link[0])
        link = link[1]
    return out


def in_common(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def keys_of(texts: list[str]) -> np.ndarray:
    """A 64-bit hash for each line: all that a partner needs."""
    return pd.util.hash_array(np.array(texts, dtype=object), categorize=False).astype(np.uint64) if texts else np.zeros(0, np.uint64)


def text_of(texts: list[str], flags: bytes, keys: list[int], partner: list[int] | None) -> str:
    """texts: of the unmarked lines; flags and keys: of all lines."""
    gone = shared(keys, partner) if partner else set()
    unmarked = [i for i, f in enumerate(flags) if not f & MARKED]
    kept = [t for i, t in zip(unmarked, texts, strict=True) if i not in gone or flags[i] & (INSIDE | LINKS) == INSIDE]
    return "\n".join(kept if kept or any(f & INSIDE for f in flags) else texts)


def best_partner(host: str, path: str, keys: list[int], near: list[tuple | None]) -> list[int] | None:
    """Lines of the candidate (host, path, keys) on the same host with the nearest path; copies come last, the first of equals wins."""
    there = [p for p in near if p is not None and p[0] == host]
    return max(there, key=lambda p: (p[2] != keys, in_common(p[1], path)))[2] if there else None


def packed_lines(texts: list[str]) -> bytes:
    """Lines, none of which is empty or holds a line end, as one compressed cell: what is shuffled is half as long."""
    return zstandard.compress("\n".join(texts).encode("utf-8", "surrogatepass"), 3) if texts else b""


def unpacked_lines(raw: bytes) -> list[str]:
    return zstandard.decompress(raw).decode("utf-8", "surrogatepass").split("\n") if raw else []


PAGE = "host string, path string, keys binary"
PARSED = "id long, u string, host string, path string, lines binary, flags binary, keys binary"
OUT = f"page_id long, url string, text string, part int, last boolean, host string, path string, lines binary, flags binary, own struct<{PAGE}>, inner struct<{PAGE}>"


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", partitions: int | None = None) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Lines instead of markup, and only hashes of boilerplate ones: all that is shuffled."""
        give_back_memory()
        for batch in batches:
            found = [lines(page if isinstance(page, str) else "") for page in batch["h"]]
            kept = [[t for t, f in zip(*x, strict=True) if not f & MARKED] for x in found]
            yield pd.DataFrame({
                "id": batch["id"].astype("Int64"), "u": batch["u"], "host": batch["host"], "path": batch["path"], "lines": [packed_lines(x) for x in kept],
                "flags": [bytes(f) for _, f in found], "keys": [keys_of(t).astype("<u8").tobytes() for t, _ in found],
            })

    def unpack(page) -> tuple | None:
        return None if page is None else (page["host"], page["path"], np.frombuffer(page["keys"], "<u8").tolist())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        before = now = None  # rows of PARSED

        def of(page) -> dict | None:
            return None if page is None else {"host": page.host, "path": page.path, "keys": page.keys}

        def inside(page, after) -> tuple:
            own = np.frombuffer(page.keys, "<u8").tolist()
            text = text_of(unpacked_lines(page.lines), page.flags, own, best_partner(page.host, page.path, own, [unpack(of(before)), unpack(of(after))]))
            return (page.id, page.u, text, *[None] * 8)

        def border(page, last: bool | None, inner) -> tuple:
            return (page.id, page.u, None, part, last, page.host, page.path, page.lines, page.flags, of(page), of(inner))

        for batch in batches:
            out = []
            for new in batch.astype({"id": "Int64"}).itertuples(index=False):
                if now is not None:
                    out.append(inside(now, new) if before is not None else border(now, False, new))
                before, now = now, new
            yield frame(out)
        if now is not None:
            yield frame([border(now, None if before is None else True, before)])

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["page_id", "url", "text", "part", "last", "host", "path", "lines", "flags", "own", "inner"])
        return out.assign(page_id=out["page_id"].astype("Int64"), part=out["part"].astype("Int32"), last=out["last"].astype("boolean"))

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples():
                host, path, own = unpack(r.own)
                out.append(text_of(unpacked_lines(r.lines), r.flags, own, best_partner(host, path, own, [unpack(r.before), unpack(r.after)])))
            yield pd.DataFrame({"page_id": batch["page_id"].astype("Int64"), "url": batch["url"], "text": out})

    url = F.coalesce(F.col(url_col), F.lit(""))
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("u"), F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)).alias("host"),
        F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1).alias("path"), F.col(html_col).alias("h"),
    )
    keys = ["host", "path", "id"]
    parsed = rows.mapInPandas(parse, PARSED)
    ordered = parsed.repartitionByRange(partitions, *keys) if partitions else parsed.repartitionByRange(*keys)
    done = materialize(ordered.sortWithinPartitions(*keys).mapInPandas(run, OUT), "pages", "zstd")
    # at most two rows of each partition: a page alone has a null ``last`` and sees both sides
    order = Window.orderBy("part", F.coalesce("last", F.lit(False)))
    borders = done.where("part is not null").withColumn("over", F.lag("own").over(order)).withColumn("under", F.lead("own").over(order))
    borders = borders.select("page_id", "url", "lines", "flags", "own", F.when(F.col("last"), F.col("inner")).otherwise(F.col("over")).alias("before"), F.when(~F.col("last"), F.col("inner")).otherwise(F.col("under")).alias("after"))
    out = done.where("part is null").select("page_id", "url", "text").unionByName(borders.mapInPandas(finish, "page_id long, url string, text string"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
