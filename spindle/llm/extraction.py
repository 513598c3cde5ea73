"""Main text of web pages by differencing each page against its nearest page by URL.

A page becomes lines, one for each block of visible text, each with its place: inside the article, elsewhere, or inside
an element that is never article text (menus, footers, forms, adverts, comments ...). Pages are put in order of host and
URL path, so that a page's nearest page stands beside it; the longest common subsequence of the two pages' lines is what
the template gives both, and is deleted. Where the markup names an article, its lines stay even if a mirror has them
too, and lines elsewhere go; a page without such markup is what differencing leaves of it.

The order is cut into parts, so that a host of any size is spread over tasks. A first pass over the keys alone finds
where the parts end; the pages there are sent to the part beside theirs as well, so the result does not depend on how
many parts there are.
"""

from __future__ import annotations

import html
import json
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, tidy

#: Elements whose content is not text of the page.
RAW = "script|style|template|noscript|textarea|title|svg|iframe|math|object|select"
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<({RAW})\b[^>]*?(?:/>|>.*?(?:</\1\s*>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S | re.I)
#: Elements and names of classes, ids and roles that are never article text.
ASIDE = frozenset("nav footer aside form menu dialog button header".split())
NAMES = re.compile(r"(?:^|[\s_-])(ads?|advert\w*|banner|sponsor\w*|promo\w*|sidebar|side|cookies?|consent|notices?|alert|comments?|disqus|replies|nav\w*|menu|breadcrumbs?|share|sharing|social|related|newsletter|subscribe|popup|modal|footer|complementary|contentinfo|search)(?:$|[\s_-])", re.I)
ATTR = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:$|[\s=>/])|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
BLOCKS = frozenset("address article blockquote body caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 head hr html legend li main ol option p pre section summary table tbody td tfoot th thead tr ul nav footer aside form menu dialog header".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSED = re.compile(r"</([a-zA-Z][^\s/>]*)")
MAIN, OTHER, NEVER = 0, 1, 2
#: Bits of the table of a subsequence; larger ones are halved.
TABLE = 1 << 27


def lines(page: str) -> list[tuple[int, str]]:
    """(place, text) of each block with text, in page order."""
    out: list[tuple[int, str]] = []
    text: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # element, never article text from here on, article from here on
    at = 0
    last = {m[1].lower(): m.start() for m in CLOSED.finditer(page)}  # where each element is closed for the last time

    def flush() -> None:
        if text:
            s = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if s:
                never, main = (stack[-1][1], stack[-1][2]) if stack else (False, False)
                out.append((NEVER if never else MAIN if main else OTHER, s))

    for m in TOKEN.finditer(page):
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            continue
        if name == "br":
            text.append(" ")
            continue
        if name in BLOCKS:
            flush()
        if m[2]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    if stack[-1][1:] != (stack[k - 1][1:] if k else (False, False)):
                        flush()  # text before and after is of different places
                    del stack[k:]
                    break
            continue
        if name in VOID or m[4].endswith("/"):
            continue
        if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option"):
            # an open one of the same kind ends here; what it opened inside ends with it
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
                if stack[k][0] in BLOCKS:
                    break
        never, main = (stack[-1][1], stack[-1][2]) if stack else (False, False)
        marks = " ".join(x for a in ATTR.findall(m[4]) for x in a[1:]) if m[4] else ""
        if not never and name not in ("html", "body", "article", "main"):
            never = name in ASIDE and not (name == "header" and main) or bool(marks and NAMES.search(marks)) or bool(m[4] and HIDDEN.search(m[4]))
            if never and last.get(name, -1) < at:
                never = False  # never closed: it can't be told what it holds
        main = main or name in ("article", "main") or "articleBody" in m[4]
        if (never, main) != (stack[-1][1:] if stack else (False, False)):
            flush()
        stack.append((name, never, main))
    if at < len(page):
        text.append(page[at:])
    flush()
    return out


def sweep(a: list[str], b: list[str]) -> Iterator[int]:
    """After each line of b, the bits of the positions in a that add nothing to the longest common subsequence so far."""
    where: dict[str, int] = {}
    for k, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << k
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
        yield v


def lengths(a: list[str], b: list[str]) -> list[int]:
    """Of each prefix of a, the length of its longest common subsequence with b."""
    v = (1 << len(a)) - 1
    for v in sweep(a, b):  # noqa: B007
        pass
    out = [0]
    for bit in bin(v | 1 << len(a))[:2:-1]:
        out.append(out[-1] + (bit == "0"))
    return out


def common(a: list[str], b: list[str]) -> set[int]:
    """Positions in a of one longest common subsequence of a and b, by bit-parallel rows; a table that is too large is
    avoided by halving b and cutting a where the halves together are longest."""
    head = 0
    while head < len(a) and head < len(b) and a[head] == b[head]:
        head += 1
    found, work = set(range(head)), [(head, a[head:], b[head:])]
    while work:
        at, x, y = work.pop()
        if not x or not y:
            continue
        if len(x) * len(y) > TABLE and len(y) > 1:
            mid = len(y) // 2
            left, right = lengths(x, y[:mid]), lengths(x[::-1], y[mid:][::-1])[::-1]
            cut = max(range(len(x) + 1), key=lambda k: left[k] + right[k])
            work += [(at, x[:cut], y[:mid]), (at + cut, x[cut:], y[mid:])]
            continue
        rows = list(sweep(x, y))
        row, col = len(y), len(x)
        while row and col:
            if rows[row - 1] >> (col - 1) & 1:
                col -= 1
                continue
            row -= 1
            if not row or rows[row - 1] >> (col - 1) & 1:
                col -= 1
                found.add(at + col)
    return found


def main_text(page: list[tuple[int, str]], near: list[tuple[int, str]] | None) -> str:
    shared = common([s for _, s in page], [s for _, s in near]) if near else set()
    left = [(place, s) for k, (place, s) in enumerate(page) if place != NEVER and (place == MAIN or k not in shared)]
    article = any(place == MAIN for place, _ in left)
    return "\n".join(s for place, s in left if place == MAIN or not article)


PARSED = pa.schema([("part", pa.int32()), ("host", pa.string()), ("path", pa.string()), ("k", pa.int64()), ("h", pa.int64()), ("ghost", pa.bool_()), ("id", pa.int64()), ("url", pa.string()), ("z", pa.binary())])
PARSED_SQL = "part int, host string, path string, k long, h long, ghost boolean, id long, url string, z binary"
KEY = ["host", "path", "k", "h"]


def parser(firsts: list[tuple], lasts: list[tuple]):
    """(id, url, html, key) -> the lines of each page, for its part; a page at an end of its part also for the one beside it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstd.ZstdCompressor(level=3)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                out: list[tuple] = []
                for i, url, page, *key in zip(*(c.to_pylist() for c in b.slice(at, 500).columns), strict=True):
                    key = tuple(key)
                    part = min(bisect_left(lasts, key), len(lasts) - 1)
                    z = pack.compress(json.dumps(lines(page or "")).encode())
                    out.append((part, *key, False, i, url, z))
                    if part and key == firsts[part]:
                        out.append((part - 1, *key, True, i, url, z))
                    if part + 1 < len(lasts) and key == lasts[part]:
                        out.append((part + 1, *key, True, i, url, z))
                yield batch(PARSED, list(zip(*out, strict=True)))

    return run


TEXT = pa.schema([("id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n", pa.int64())])


def shared_prefix(a: str, b: str) -> int:
    return next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages in the order of their keys, part by part -> main texts. The nearest page is the one beside it, of the same
    host and with other lines, that shares more of its path; the one before where both share as much."""
    unpack = zstd.ZstdDecompressor()
    last: tuple[bytes, list] = (b"", [])

    def rows() -> Iterator[tuple]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                yield from zip(*(c.to_pylist() for c in b.slice(at, 500).columns), strict=True)

    def plain(z: bytes) -> list:
        nonlocal last
        if z != last[0]:
            last = (z, json.loads(unpack.decompress(z)))
        return last[1]

    def done(x: tuple, *beside: tuple | None) -> tuple:
        beside = [p for p in beside if p is not None and p[:2] == x[:2] and p[8] != x[8]]
        near = max(beside, key=lambda p: shared_prefix(p[2], x[2]), default=None)
        t = main_text(plain(x[8]), plain(near[8]) if near else None)
        return x[6], x[7], t, len(t)

    out: list[tuple] = []
    before = page = None
    for after in rows():
        if page is not None and not page[5]:
            out.append(done(page, before, after))
        before, page = page, after
        if len(out) >= 500:
            yield batch(TEXT, list(zip(*out, strict=True)))
            out = []
    if page is not None and not page[5]:
        out.append(done(page, before, None))
    if out:
        yield batch(TEXT, list(zip(*out, strict=True)))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) for each row. A null html is empty and gives an empty text; pages with a null or broken
    url have no host and are paired among themselves; a page alone in its host, or between copies of itself, keeps what
    its markup leaves; rows that repeat a page each give a row; null ids stay null; other columns are ignored; empty
    tables give none. No task holds more than three pages at a time, and the driver two keys for each part."""
    src = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    host, path = (F.regexp_extract("url", rf"^[A-Za-z][A-Za-z0-9+.\-]*://{x}", 1) for x in ("([^/?#\\[\\]]*)", "[^/?#\\[\\]]*([^?#]*)"))
    keyed = src.select("*", F.coalesce(F.lower(host), F.lit("")).alias("host"), F.coalesce(F.regexp_replace(path, "/+$", ""), F.lit("")).alias("path"), F.coalesce("id", F.lit(-(2**63))).alias("k"), F.xxhash64("html").alias("h"))
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = keyed.select(*KEY).repartitionByRange(parts, *KEY).groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct(*KEY)).alias("lo"), F.max(F.struct(*KEY)).alias("hi"))
    ends = sorted((tuple(r["lo"]), tuple(r["hi"])) for r in ordered.collect()) or [(("", "", 0, 0),) * 2]
    firsts, lasts = map(list, zip(*ends, strict=True))
    parsed = keyed.select("id", "url", "html", *KEY).mapInArrow(tidy(parser(firsts, lasts)), PARSED_SQL)
    beside = parsed.repartitionById(len(ends), F.col("part")).sortWithinPartitions("part", *KEY, "ghost")
    out = beside.mapInArrow(tidy(difference), "id long, url string, text string, n long")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.col("n").alias("n_chars"))
