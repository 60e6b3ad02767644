"""Main-text extraction by nearest-URL page differencing.

A page becomes lines: the texts of its blocks in page order, with what is never text (scripts, styles, forms, comments in
the markup) left out. Pages are dealt by range of host and URL path, so that a host of any size spreads over tasks, and
each page is paired with that neighbour in its host whose path shares the longer prefix. Lines of a pair are aligned by
longest common subsequence, and the shared ones are deleted: menus, notices, teasers and footers repeat on the neighbour.

Three things are beyond what differencing can tell, and rules of their own decide them, in this order:

- Sentences that several articles of a host have are text. So a shared line inside the page's article is deleted only
  where both neighbours have it at the same place, in one stretch with the article's start (or the title there) or its end,
  as templates do; and where an article is a near copy of a neighbour's (over half of its characters are shared), it is
  kept whole.
- Adverts and comments differ from page to page, and some hosts have a single page. So of the lines that no neighbour shares
  those in menus, headers, footers, asides, adverts, notices and reader comments are dropped (by element, role, or a class
  or id whose words all say so), unless no other line is there.
- Of what is left, a page keeps the lines inside its article or main element where these are at least half of it.

Copies of a page share all of its lines, so a page is paired with the next page that has another text.
"""

from __future__ import annotations

import functools
import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import even_keys, materialize, partitions, released, small_batches, table

_SILENT = set("script style noscript template svg math canvas iframe object audio video head title select textarea button option datalist input".split())
#: Elements that a page's head may hold; any other ends it.
_HEAD = set("head title meta link base basefont bgsound style script noscript template".split())
#: Urls that are sampled to find the ranges' borders: so many a range, or, if that is more, so many in all or three a range.
SAMPLE, SAMPLE_MOST = 40, 200_000
_CHROME = set("nav footer aside menu dialog header".split())
_ROLES = set("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
_WORDS = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside widget "
    "cookie cookies consent notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations "
    "comment comments commentlist reply replies respond responses remarks discussion disqus pagination pager toolbar".split()
)
#: Words that name a part of a page whatever it holds: beside one of _WORDS they leave its meaning as it is.
_PARTS = set(
    "box block wrapper wrap container content inner outer bar strip panel list links link item items group section area region zone slot unit holder form body title heading label button icon top bottom left right "
    "main primary secondary sub site page global local mobile desktop fixed sticky small large user users reader readers visitor visitors post posts article articles story stories".split()
)
_MAIN = {"article", "main"}
_BLOCKS = set(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_SCOPES = set("article main nav aside section header footer div table td th form body html menu dialog figure ul ol blockquote".split())
#: Elements whose start ends an open one of the listed kinds.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SPLIT = re.compile(r"[^a-z]+")
#: Classes that say what an element has, not what it is.
_HAS = re.compile(r"(?<!\S)(?:has|with|without|no)[-_]\S*")


def _known(word: str) -> set[str]:
    """The listed words that a word is, or is run together from (topnav, navlist)."""
    if word in _WORDS or word in _PARTS:
        return {word}
    for i in range(2, len(word) - 1):
        if {word[:i], word[i:]} <= _WORDS | _PARTS and len(word[:i]) + len(word[i:]) > 4:
            return {word[:i], word[i:]}
    return set()


@functools.lru_cache(maxsize=4096)
def _names_chrome(names: str) -> bool:
    """Whether one of the names of a class or id attribute says that this is no text: all of its words are listed, and one of
    them is such a word. A name with any other word (notice-period, share-price) says something else."""
    for name in _HAS.sub("", names.lower()).split():
        words = [w for w in _SPLIT.split(name) if w]
        known = [_known(w) for w in words]
        if words and all(known) and _WORDS.intersection(*[set().union(*known)]):
            return True
    return False


class _Lines(HTMLParser):
    """Collects (text, in main element, in chrome) of each block."""

    def __init__(self, silent_forms: bool = True):
        super().__init__(convert_charrefs=True)
        self.silent_forms = silent_forms
        self.stack: list[tuple[str, int, bool, bool]] = []  # element, silent (1: by a form only), chrome, main: inherited
        self.lines: list[tuple[str, bool, bool]] = []
        self.text: list[str] = []

    def flush(self) -> None:
        if self.text:
            line = " ".join("".join(self.text).split())
            if line:
                _, _, chrome, main = self.stack[-1] if self.stack else ("", 0, False, False)
                self.lines.append((line, main, chrome))
            self.text = []

    def _end_head(self) -> None:
        """A head's end tag may be left out: what cannot be in a head ends it."""
        for i, (name, *_) in enumerate(self.stack[:3]):
            if name == "head":
                del self.stack[i:]
                return

    def handle_starttag(self, tag, attrs):
        block = tag in _BLOCKS
        if tag not in _HEAD:
            self._end_head()
        if block:
            self.flush()
            self._imply(tag)
        if tag in _VOID:
            return
        _, silent, chrome, main = self.stack[-1] if self.stack else ("", 0, False, False)
        names = dict(attrs)
        article = tag in _MAIN or names.get("role") == "main" or names.get("itemprop") == "articleBody"
        if tag in _SILENT:
            silent = 2
        elif article and silent == 1:  # a form around the whole page
            silent = 0
        elif tag == "form" and self.silent_forms:
            silent = max(silent, 1)
        if not silent:
            named = ("class" in names or "id" in names) and _names_chrome(f"{names.get('class') or ''} {names.get('id') or ''}")
            inside = main and tag == "header"  # an article's own heading
            if not inside and tag not in ("html", "body") and (tag in _CHROME or (names.get("role") or "") in _ROLES or ("hidden" in names) or named):
                chrome = True
            main = main or article
        self.stack.append((tag, silent, chrome, main))

    def _imply(self, tag: str) -> None:
        """A block ends an open paragraph; list items, cells and the like end their forerunners."""
        if tag == "br":
            return
        ends = _ENDS.get(tag, set()) | {"p"}
        for i in range(len(self.stack) - 1, -1, -1):
            name = self.stack[i][0]
            if name in ends:
                del self.stack[i:]
                return
            if name in _SCOPES:
                return

    def handle_startendtag(self, tag, attrs):
        if tag in _BLOCKS:
            self.flush()
        if tag not in _VOID:  # the slash means nothing to HTML
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in _BLOCKS:
            self.flush()
        scope = tag in _SCOPES
        for i in range(len(self.stack) - 1, -1, -1):
            name = self.stack[i][0]
            if name == tag:
                del self.stack[i:]
                return
            if not scope and name in _SCOPES:
                return

    def handle_data(self, data):
        if self.stack and self.stack[-1][0] == "head" and data.strip():
            self._end_head()
        if not (self.stack and self.stack[-1][1]):
            self.text.append(data)


_OPEN, _CLOSE = re.compile(r"<form[\s/>]", re.I), re.compile(r"</form[\s/>]", re.I)


def page_lines(html: str | None) -> list[tuple[str, bool, bool]]:
    """(text, in main element, in chrome) of the blocks of a page; none for null or empty. Forms are left out, but where one
    is never closed, or nothing stands outside, only their controls are."""
    if not html:
        return []
    forms = len(_OPEN.findall(html))
    for silent in (True, False) if forms and forms <= len(_CLOSE.findall(html)) else (False,):
        p = _Lines(silent)
        p.feed(html)
        p.close()
        p.flush()
        if p.lines:
            break
    return p.lines


def _lengths(a: list[str], b: list[str]) -> np.ndarray:
    """The longest common subsequence's length of a with each prefix of b, by bits: a step of a costs len(b) / 64 words."""
    masks: dict[str, int] = defaultdict(int)
    for j, x in enumerate(b):
        masks[x] |= 1 << j
    every = (1 << len(b)) - 1
    row = every
    for x in a:
        hit = row & masks.get(x, 0)
        row = (row + hit | row - hit) & every
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def shared_lines(a: list[str], b: list[str]) -> set[int]:
    """Indices of a on a longest common subsequence with b. Lines that repeat often are halved (Hirschberg) with lengths by
    bits, so that equal rows of a table cost neither their product in memory nor in steps."""
    out: set[int] = set()
    parts = [(0, len(a), 0, len(b))]
    while parts:
        lo, n, x, m = parts.pop()
        while lo < n and x < m and a[lo] == b[x]:
            out.add(lo)
            lo, x = lo + 1, x + 1
        while n > lo and m > x and a[n - 1] == b[m - 1]:
            n, m = n - 1, m - 1
            out.add(n)
        if lo == n or x == m:
            continue
        where = defaultdict(list)
        for j in range(x, m):
            where[b[j]].append(j)
        if sum(len(where.get(t, ())) for t in a[lo:n]) <= 16 * (n - lo + m - x):
            out |= _chain(a, lo, n, where)
            continue
        half = (lo + n) // 2
        if half == lo:
            out.add(lo)  # it has a match, as it repeats often
            continue
        ahead, behind = _lengths(a[lo:half], b[x:m]), _lengths(a[half:n][::-1], b[x:m][::-1])
        at = x + int(np.argmax(ahead + behind[::-1]))
        parts += [(lo, half, x, at), (half, n, at, m)]
    return out


def _chain(a: list[str], lo: int, n: int, where: dict[str, list[int]]) -> set[int]:
    """Indices of a[lo:n] on a longest increasing chain of matching places."""
    tails: list[int] = []
    ends: list[tuple] = []
    for i in range(lo, n):
        for j in reversed(where.get(a[i], ())):
            k = bisect_left(tails, j)
            node = (i, ends[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                ends.append(node)
            else:
                tails[k], ends[k] = j, node
    out, node = set(), ends[-1] if ends else None
    while node:
        out.add(node[0])
        node = node[1]
    return out


def _content(lines: list[tuple[str, bool, bool]]) -> list[int]:
    """The lines outside chrome. Where there are none, the lines of an article in an element that looks like chrome, most
    often one left open; without an article, all lines: the page stands in a wrapper that looks like chrome."""
    every = range(len(lines))
    return [i for i in every if not lines[i][2]] or [i for i in every if lines[i][1]] or list(every)


def _same(lines: list[tuple[str, bool, bool]]) -> list[str]:
    """What copies of a page share: the text of its articles, or else of its content."""
    content = _content(lines)
    return [lines[i][0] for i in content if lines[i][1]] or [lines[i][0] for i in content]


def main_text(lines: list[tuple[str, bool, bool]], near: list[list[tuple[str, bool, bool]]]) -> tuple[str, int, int]:
    """The text that stays, and how many lines differencing and the other rules took. near: the lines of the neighbours, the
    nearest first."""
    texts = [t for t, _, _ in lines]
    gone = shared_lines(texts, [t for t, _, _ in near[0]]) if near else set()
    here = _content(lines)
    article = [i for i in here if lines[i][1]]
    size = lambda at: sum(len(lines[i][0]) for i in at)
    if near and article and gone.intersection(article):
        inside = gone.intersection(article)
        if 2 * size(inside) <= size(article):
            others = [[n[i][0] for i in _content(n) if n[i][1]] for n in near]
            k = len(article)
            ahead = [all(i < len(o) and o[i] == texts[article[i]] for o in others) for i in range(k)]
            behind = [all(k - i <= len(o) and o[i - k] == texts[article[i]] for o in others) for i in range(k)]
            skip = len(near) > 1 and not ahead[0]  # below a title; with one neighbour a chance repeat is likelier
            inside -= {i for at, i in enumerate(article) if (at >= skip and all(ahead[skip : at + 1])) or all(behind[at:])}
        gone = gone - inside
    left = [i for i in here if i not in gone]
    if not left:
        left, gone = here, gone.difference(here)
    kept = [i for i in left if lines[i][1]]
    if not kept or 2 * size(kept) < size(left):  # else that is a teaser beside the text
        kept = left
    return "\n".join(texts[i] for i in kept), len(gone), len(lines) - len(gone) - len(kept)


def _close(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def _pack(lines: list[tuple[str, bool, bool]]) -> bytes:
    """Lines as bytes: a digit for each (main, chrome), then the texts, which hold no line break."""
    flags = "".join(str(main + 2 * chrome) for _, main, chrome in lines)
    return zstandard.compress("\n".join([flags, *(t for t, _, _ in lines)]).encode("utf-8", errors="replace"))


def _unpack(packed: bytes) -> list[tuple[str, bool, bool]]:
    flags, *texts = zstandard.decompress(packed).decode().split("\n")
    return [(t, f in "13", f in "23") for t, f in zip(texts, flags)]


def _copied(lines: list[tuple[str, bool, bool]]) -> bytes:
    """What is equal for pages with the same text in their articles, or else in their content."""
    return hashlib.sha256("\n".join(_same(lines)).encode("utf-8", errors="replace")).digest()


def _nearest(path: str, near: list[tuple[str | None, bytes | None]]) -> list[list[tuple[str, bool, bool]]]:
    """The lines of the neighbours (path, packed lines), first of that whose path shares the longest prefix, the former of
    equals."""
    return [_unpack(x[1]) for x in sorted((x for x in near if x[1] is not None), key=lambda x: -_close(x[0], path))]


_PARSED = [("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("path", pa.string()), ("lines", pa.binary()), ("copied", pa.binary()), ("part", pa.int32())]
_TEXT = [("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("shared", pa.int32()), ("marked", pa.int32())]
_NEAR = [("before_path", pa.string()), ("before_lines", pa.binary()), ("after_path", pa.string()), ("after_lines", pa.binary())]
_SETTLED = [*_TEXT, ("edge", pa.int32()), ("part", pa.int32()), ("last", pa.int32()), ("host", pa.string()), ("path", pa.string()), ("lines", pa.binary()), ("copied", pa.binary()), *_NEAR]
_KINDS = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.binary(): "binary"}


def _ddl(fields: list) -> str:
    return ", ".join(f"{n} {_KINDS[k]}" for n, k in fields)


def _rows(out: list[tuple], fields: list) -> pa.RecordBatch:
    cols = list(zip(*out)) if out else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(cols, fields)], names=[n for n, _ in fields])


def _references(ends: DataFrame) -> DataFrame:
    """(part, edge, side, at_part, at_edge, what): for each run at an edge of its range and each side the page next to it: the
    page at the near end of a run in another range (what: page), or what the ranges' rows hold as the run's own neighbour
    (before or after). One small task: a few numbers and a digest for two runs of each range, whatever the table's size."""
    names = ["part", "edge", "host", "copied"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = [{"at": (r[0], r[1]), "edge": r[1], "host": r[2], "copied": r[3]} for b in batches for r in zip(*(b.column(n).to_pylist() for n in names))]
        out = []
        for seq, bit, side in ((runs, 1, "before"), (runs[::-1], 2, "after")):
            former = None
            for x in seq:
                x["ref"] = (*x["at"], side)
                if x["edge"] & bit:
                    if former is None or former["host"] != x["host"]:
                        x["ref"] = None
                    else:
                        x["ref"] = former["ref"] if former["copied"] == x["copied"] else (*former["at"], "page")
                if x["ref"]:
                    out.append((*x["at"], side, *x["ref"]))
                former = x
        fields = [("part", pa.int32()), ("edge", pa.int32()), ("side", pa.string()), ("at_part", pa.int32()), ("at_edge", pa.int32()), ("what", pa.string())]
        yield _rows(out, fields)

    one = ends.filter("last = 0").select(*names).coalesce(1).sortWithinPartitions("part", F.col("edge") == 2)
    return one.mapInArrow(released(run), "part int, edge int, side string, at_part int, at_edge int, what string")


def _pages_at_edges(ends: DataFrame) -> DataFrame:
    """(part, edge, before_path, before_lines, after_path, after_lines) for each run at an edge of its range."""
    page = lambda last: ends.filter(F.col("last") == last)
    known = page(1).select("part", "edge", F.lit("before").alias("side"), F.lit("page").alias("what"), "path", "lines")
    known = known.unionByName(page(0).select("part", "edge", F.lit("after").alias("side"), F.lit("page").alias("what"), "path", "lines"))
    for side in ("before", "after"):
        own = page(0).select("part", "edge", F.lit(side).alias("side"), F.lit(side).alias("what"), F.col(f"{side}_path").alias("path"), F.col(f"{side}_lines").alias("lines"))
        known = known.unionByName(own.filter("lines is not null"))
    known = known.withColumnsRenamed({"part": "at_part", "edge": "at_edge"})
    found = _references(ends).join(known, ["at_part", "at_edge", "side", "what"])
    of = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c))).alias(f"{side}_{c}")
    return found.groupBy("part", "edge").agg(*(of(s, c) for s in ("before", "after") for c in ("path", "lines")))


def extract_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, shared, marked) for each input row, repeated or not: the main text, and how many lines
    differencing and the other rules took.

    Null or empty html gives an empty text. A null or relative url belongs to the host ''. Pages without another of their
    host are not differenced. Other columns are ignored.

    Copies next to each other are a run, whose pages are differenced with the pages next to the run. The runs at the edges
    of a range of the shuffle wait for the pages next to them in other ranges: a small step finds where these are from two
    rows a range, and the runs' pages are then joined with them.
    """
    spark = pages.sparkSession
    small_batches(spark)
    ranges = partitions(spark)
    url = F.col("url").cast("string")
    at = F.regexp_extract(F.coalesce(url, F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), url.alias("url"), F.lower(at).alias("host"),
        F.regexp_replace(F.coalesce(url, F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "").alias("path"), F.col("html").cast("string").alias("html"),
    )
    order = ("host", "path", "page_id")
    place = lambda host, path, i: (host, path, i is not None, i or 0)
    # borders from a sample of the urls alone: a range shuffle would parse every page twice
    keys = rows.select(*order)
    wanted = min(SAMPLE * ranges, max(SAMPLE_MOST, 3 * ranges))
    sample = sorted(place(*r) for r in keys.sample(min(1.0, wanted / max(1, keys.count())), 5).collect())
    borders = [sample[len(sample) * i // ranges] for i in range(1, ranges)] if len(sample) >= ranges else sample
    homes = even_keys(spark, ranges)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [page_lines(x.as_py()) for x in b.column("html")]
            part = [homes[bisect_right(borders, place(*r))] for r in zip(*(b.column(c).to_pylist() for c in ("host", "path", "page_id")))]
            cols = [pa.array(map(_pack, found), pa.binary()), pa.array(map(_copied, found), pa.binary()), pa.array(part, pa.int32())]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n, _ in _PARSED[:4]), *cols], names=[n for n, _ in _PARSED])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = (r for b in batches for r in zip(*(b.column(n).to_pylist() for n, _ in _PARSED)))
        for part, group in groupby(every, key=lambda r: r[6]):
            yield from settle_range(homes.index(part), group)

    def settle_range(part: int, group: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        runs = (list(g) for _, g in groupby(group, key=lambda r: (r[2], r[5])))
        before, now, out, size = None, next(runs, None), [], 0
        while now is not None:
            after = next(runs, None)
            host = now[0][2]
            near = [(*x[3:5],) if x is not None and x[2] == host else (None, None) for x in (before, after and after[0])]
            edge = (before is None) + 2 * (after is None)
            for i, url, _, path, lines, *_ in now:
                if edge:
                    out.append((i, url, *[None] * 3, edge, part, None, None, path, lines, *[None] * 5))
                    size += len(lines)
                else:
                    text, *taken = main_text(_unpack(lines), _nearest(path, near))
                    out.append((i, url, text, *taken, 0, *[None] * 10))
                    size += len(text)
                size += 100
                if size > 2 << 20:
                    yield _rows(out, _SETTLED)
                    out, size = [], 0
            # both ends of a run at the edge, for the ranges next to it
            for k, x in enumerate([now[0], now[-1]] if edge else []):
                out.append((*[None] * 5, edge, part, k, host, *x[3:6], *near[0], *near[1]))
            before, now = now[-1], after
        yield _rows(out, _SETTLED)

    def settle_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = zip(*(b.column(n).to_pylist() for n in ("page_id", "url", "path", "lines", *(n for n, _ in _NEAR))))
            yield _rows([(i, url, *main_text(_unpack(lines), _nearest(path, [(bp, bl), (ap, al)]))) for i, url, path, lines, bp, bl, ap, al in got], _TEXT)

    dealt = rows.mapInArrow(released(parse), _ddl(_PARSED)).repartition(ranges, "part").sortWithinPartitions("part", *order)
    settled = materialize(dealt.mapInArrow(released(settle), _ddl(_SETTLED)), "settled", "zstd")
    near_rows = materialize(_pages_at_edges(settled.filter("last is not null")), "ends", "zstd")
    edges = settled.filter("edge > 0 and last is null").select("page_id", "url", "edge", "part", "path", "lines").join(near_rows, ["part", "edge"], "left")
    return settled.filter("edge = 0").select(*(n for n, _ in _TEXT)).unionByName(edges.mapInArrow(released(settle_edges), _ddl(_TEXT)))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), F.col("shared").alias("n_shared_lines"), F.col("marked").alias("n_marked_lines"))
