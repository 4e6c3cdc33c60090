"""Main text of web pages by nearest-URL page differencing.

Each page is cut into text lines, one for each block, with character references
decoded and white space made single. Lines in elements that are never main text
(menus, headers, footers, sidebars, adverts, forms, scripts, styles, reader
comments) go at once. Pages are laid out by host and URL path; each is compared
with the two nearest of its neighbours, those whose paths share the most leading
parts with its own and which are no copies of it. The pages' lines are aligned by
longest common subsequence, and a line that both neighbours have (or the only
one) is template and deleted. A neighbour that shares most of the page's text is
a copy, not a page of the same template, and says nothing.

Markup breaks ties: where a page has `article` or `main`, lines outside it are
not main text, and a paragraph, heading, list item, quotation or cell inside it
stays even if neighbours have it, as articles may quote the same passage; there
its class or id is not asked, only those of its containers are. All other lines are decided by differencing. Pages whose lines all are decided by
markup give their text at once; the others travel with it, and for comparison
each page sends 12 bytes a line.

A hot host is spread over as many ranges of paths as its pages need, and each
range gets the two rows before it and after it, so the result does not depend
on the ranges.

Defined results: null or empty html, or a page without main text, gives an empty
text; a null or malformed url has an empty host and is compared among such; a
page alone on its host loses no line to comparison; repeated pages stay rows of
their own; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator
from itertools import chain
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import trimmed
from .store import bounded_batches, written

BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dd dt figcaption caption summary".split())
RAW = frozenset("script style noscript template textarea title iframe object svg canvas audio video".split())
NEVER = frozenset("nav aside footer form head menu button select dialog".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MAIN = frozenset(("article", "main"))
#: What differs from page to page or stands on few pages, so that comparison cannot see it; a class or id of such words, alone or with neutral ones. Fixed values.
NAMES = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo sidebar menu nav navbar navigation breadcrumb breadcrumbs footer topbar cookie cookies consent gdpr notice popup newsletter subscribe signup login share sharing social related recommended comment comments disqus respond pagination pager".split())
NEUTRAL = frozenset("area bar block bottom box container content inner item left links list main outer page reader readers right section site slot top unit user users widget wrap wrapper".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form".split())
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACE = re.compile(r"\s+")
_PART = re.compile(r"[-_\d]+")
OUTSIDE, INSIDE, BODY = range(3)  # where a line stands: outside main elements, inside, in a text block inside


def _named(value: str) -> bool:
    """Whether a class or id is made of names of boilerplate and neutral words."""
    for token in value.lower().split():
        parts = [x for x in _PART.split(token) if x]
        if any(x in NAMES for x in parts) and all(x in NAMES or x in NEUTRAL for x in parts):
            return True
    return False


def _boilerplate(tag: str, attrs: str, inside_main: bool) -> bool:
    if tag in NEVER or tag == "header" and not inside_main:
        return True
    if attrs and tag not in ("html", "body", "article", "main"):
        for name, *values in _ATTR.findall(attrs):
            value, name = "".join(values), name.lower()
            named = name in ("class", "id") and not (inside_main and tag in TEXT) and _named(value)
            if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or named or name == "role" and value.lower() in ROLES:
                return True
    return False


def page_lines(page: str) -> list[tuple[str, int]]:
    """(line, place) of the lines that may be main text."""
    out: list[tuple[str, int]] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # open tag, is it boilerplate, is it a main element
    bad = main = at = 0

    def end_line() -> None:
        line = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
        parts.clear()
        if line:
            block = next((t for t, _, _ in reversed(stack) if t in BLOCKS), "")
            out.append((line, OUTSIDE if not main else BODY if block in TEXT else INSIDE))

    while at < len(page):
        m = _TAG.search(page, at)
        if not bad:
            parts.append(page[at : m.start() if m else len(page)])
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            if page.startswith("<![CDATA[", m.start()) and not bad:
                parts.append(html.escape(m[0][9:].removesuffix("]]>"), quote=False))
            continue
        if tag in BLOCKS and not bad:
            end_line()
        if m[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    for _, b, x in stack[i:]:
                        bad -= b
                        main -= x
                    del stack[i:]
                    break
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else len(page)
            continue
        if tag in VOID or m[3].endswith("/"):
            continue
        b, x = _boilerplate(tag, m[3], main > 0), tag in MAIN
        stack.append((tag, b, x))
        bad += b
        main += x
    if not bad:
        end_line()
    return out


def candidates(lines: list[tuple[str, int]]) -> list[tuple[str, bool]]:
    """(line, in doubt) of the lines that markup leaves: in a page with a main element only lines inside it, in doubt if they are no text blocks."""
    if any(place != OUTSIDE for _, place in lines):
        return [(x, place == INSIDE) for x, place in lines if place != OUTSIDE]
    return [(x, True) for x, _ in lines]


def common_lines(a: list[str], b: list[str]) -> list[bool]:
    """Which lines of a are in a longest common subsequence of a and b.

    Bit-parallel: one integer of len(b) bits for each line of a (Hyyro, 2004).
    """
    mask: dict[str, int] = {}
    for j, x in enumerate(b):
        mask[x] = mask.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v, rows = full, [full]
    for x in a:
        u = v & mask.get(x, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    out, j = [False] * len(a), len(b)
    for i in range(len(a), 0, -1):
        low = (1 << j) - 1
        zeros = j - (rows[i] & low).bit_count()
        if zeros == j - (rows[i - 1] & low).bit_count():
            continue
        place = mask[a[i - 1]] & low  # the step up is at the last match that keeps the length
        while place:
            k = place.bit_length() - 1
            if k - (rows[i - 1] & ((1 << k) - 1)).bit_count() == zeros - 1:
                out[i - 1], j = True, k
                break
            place &= (1 << k) - 1
    return out


def shared_parts(a: str, b: str) -> int:
    """Leading parts that two paths share."""
    n = 0
    for x, y in zip(a.split("/"), b.split("/"), strict=False):
        if x != y:
            break
        n += 1
    return n


def template_lines(own: list, sizes: list[int], path: str, neighbours: list[tuple[str, list]], copy_share: float = 0.5) -> list[bool]:
    """Which lines the two nearest neighbours (path, lines) that are no copies have in common with the page."""
    votes, asked = [0] * len(own), 0
    for _, lines in sorted(neighbours, key=lambda x: -shared_parts(path, x[0])):
        shared = common_lines(own, lines)
        if sum(n for n, s in zip(sizes, shared, strict=True) if s) > copy_share * sum(sizes):
            continue
        votes = [v + s for v, s in zip(votes, shared, strict=True)]
        asked += 1
        if asked == 2:
            break
    return [asked > 0 and v == asked for v in votes]


def host_and_path(url: str | None) -> tuple[str, str]:
    try:
        parts = urlsplit((url or "").strip())
        return (parts.hostname or "").lower(), parts.path.rstrip("/") or "/"
    except ValueError:
        return "", url or ""


_PAGE = "key long, page_id long, url string, host string, path string, text string, lines array<string>, doubt array<boolean>, hashes array<bigint>"
_NAMES = [x.split()[0] for x in _PAGE.split(", ")]


def _line_hash(line: str) -> int:
    return xxhash.xxh64_intdigest(line) - (1 << 63)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages as lines; `text` where no line is in doubt, else the lines."""
    for b in trimmed(batches):
        every = [page_lines(x or "") for x in b.column(3).to_pylist()]
        left = [candidates(x) for x in every]
        clear = [not any(d for _, d in x) for x in left]
        urls = b.column(2).to_pylist()
        places = [host_and_path(u) for u in urls]
        hashes = [[_line_hash(t) for t, _ in x] for x in every]
        texts = ["\n".join(t for t, _ in x) if c else None for x, c in zip(left, clear, strict=True)]
        lines = [None if c else [t for t, _ in x] for x, c in zip(left, clear, strict=True)]
        doubt = [None if c else [d for _, d in x] for x, c in zip(left, clear, strict=True)]
        cols = [b.column(0), b.column(1), b.column(2), pa.array([h for h, _ in places], pa.string()), pa.array([p for _, p in places], pa.string()), pa.array(texts, pa.string()), pa.array(lines, pa.list_(pa.string())), pa.array(doubt, pa.list_(pa.bool_())), pa.array(hashes, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(cols, names=_NAMES)


_ROW = "range int, place int, host string, path string, key long, page_id long, url string, lines array<string>, doubt array<boolean>, hashes array<bigint>"
_ROW_NAMES = [x.split()[0] for x in _ROW.split(", ")]


def _with_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a sorted range; its first two also go, for comparison, behind the range before (place 1), its last two before the next one (place -1)."""
    own = TaskContext.get().partitionId()
    first, last = [], deque(maxlen=2)

    def placed(b: pa.RecordBatch, step: int) -> pa.RecordBatch:
        n = b.num_rows
        return pa.RecordBatch.from_arrays([pa.array([own + step] * n, pa.int32()), pa.array([-step] * n, pa.int32()), *b.columns], names=_ROW_NAMES)

    for b in trimmed(batches):
        first += [b.slice(i, 1) for i in range(min(2 - len(first), b.num_rows))]
        last.extend(b.slice(i, 1) for i in range(max(0, b.num_rows - 2), b.num_rows))
        yield placed(b, 0)
    for rows, step in ((first, -1), (last, 1)):
        for r in rows:
            yield placed(r, step)


def _differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by range and place: the texts of the pages in doubt, with two neighbours on either side."""

    def texts(row: dict, others: list[dict]) -> str:
        near = [(x["path"], x["hashes"]) for x in others if x["range"] == row["range"] and x["host"] == row["host"]]
        own = [_line_hash(t) for t in row["lines"]]
        gone = template_lines(own, [len(t) for t in row["lines"]], row["path"], near)
        return "\n".join(t for t, d, g in zip(row["lines"], row["doubt"], gone, strict=True) if not (d and g))

    window = deque([None, None], maxlen=5)
    for b in chain(trimmed(batches), [None, None]):
        out = []
        for row in [None] if b is None else b.to_pylist():
            window.append(row)
            if len(window) == 5 and (mid := window[2]) is not None and not mid["place"] and mid["lines"] is not None:
                out.append((mid["page_id"], mid["url"], texts(mid, [x for i, x in enumerate(window) if i != 2 and x is not None])))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string()))], names=["page_id", "url", "text"])


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of each page."""
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = written(pages.select(F.monotonically_increasing_id().alias("key"), "page_id", "url", "html").mapInArrow(_cut, _PAGE), "pages")
    asked = F.col("lines").isNotNull()
    rows = cut.select("host", "path", "key", F.when(asked, F.col("page_id")).alias("page_id"), F.when(asked, F.col("url")).alias("url"), "lines", "doubt", "hashes")
    # a page without a page in doubt on its host has nobody to compare it with
    rows = rows.join(cut.where(asked).select("host").distinct(), "host", "left_semi")
    laid = rows.repartitionByRange(max(1, min(parts, cut.count() // 1000)), "host", "path", "key").sortWithinPartitions("host", "path", "key")
    edged = laid.select(*_ROW_NAMES[2:]).mapInArrow(_with_edges, _ROW).repartition("range").sortWithinPartitions("range", "place", "host", "path", "key")
    compared = edged.mapInArrow(_differ, "page_id long, url string, text string")
    out = cut.where(~asked).select("page_id", "url", "text").unionByName(compared)
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


def op3_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


__all__ = ["candidates", "common_lines", "extract_main_text", "op3_html_main_text", "page_lines", "template_lines"]
