"""Main text of web pages, by site templates and page structure.

A page is read once by a tolerant tree reader (unclosed paragraphs, items and inline elements are closed as browsers
do). Three things decide what stays:

1. Site templates: element subtrees are hashed (tag, class, text), the hashes are counted per host in Spark over pages
   of distinct content, and subtrees that recur on many of them are deleted: on MIN_PAGES at least, and on as many as the
   square root of the number of the host's pages, so that a section's template is found on a large host too. Copies of a
   page count once. Inside an article, paragraphs, headings, inline elements, list items and table cells are its text
   and are never deleted as templates, however often a site quotes them.
2. Elements that never hold article text by their tag (FIXED sets below) go: scripts, styles, navigation, footers, side
   columns, forms, and headers of the page; and containers that name themselves so: every part of one word of their
   class, id or role, numbers aside, is an aside word (`cookie-notice`, `advert-1`), a neutral one (`main-nav`) or two such
   written together (`cookiebar`); `social-science` is not.
3. Where a page has `article` or `main` elements that hold text, and no less than a quarter of what stands outside, only what
   stands in them stays.

Text: character references are decoded, white space inside a block becomes one space, blocks are joined by one space.
Reading takes time in proportion to the page, however deep it is nested. Counting shuffles (host, hash) pairs, combined
first; page text is shuffled only for pages that hold a subtree which might be deleted, by page, never by host.

Defined results: null html counts as empty and gives empty text and n_chars 0; a null url has host ""; equal rows give
equal results; empty tables give empty results; extra columns are ignored. Pages of equal 64-bit content hashes on one
host count as copies.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.storage import materialise

MIN_PAGES = 5
#: Up to so many rows of (host, hash) the templates are broadcast; more are joined by a shuffle.
BROADCAST_TEMPLATES = 100_000
#: Pages that a task hands on at once.
HANDED = 256
#: Element names and class words.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe".split())
DROPPED = frozenset("head script style noscript template title nav footer aside form button select textarea option iframe object svg canvas dialog menu audio video map datalist".split())
BLOCKS = frozenset("address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
INLINE_FORMAT = frozenset("a abbr b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
CLOSES = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option", "tbody": "tr td th thead tbody tfoot", "thead": "tr td th thead tbody tfoot", "tfoot": "tr td th thead tbody tfoot"}
CLOSE_LIMIT = frozenset("ul ol dl table menu dir div section article main body".split())
CELLS = frozenset("li dt dd td th tr tbody thead tfoot caption br".split())
ASIDE_WORDS = frozenset("ad ads advert adverts advertisement advertising adsense banner banners breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr header login menu menus modal nav navbar navigation newsletter notice notices pagination popup promo promos promoted related responses search share sharing sidebar signup social sponsor sponsored sponsors subscribe toolbar widget widgets".split())
NEUTRAL_WORDS = frozenset("area bar block bottom box center column container content foot global head holder inner item items left link links list main outer page panel primary region right row secondary section site slot sticky strip text thread top unit user users wrap wrapper zone".split())
#: Neutral beside an aside word only, since articles have them as well.
BESIDE_WORDS = frozenset("form list post reply replies".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^"'>]|"[^"]*"|'[^']*')*+)>|<[!?][^>]*+(?:>|\Z)""", re.S)
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_CUT_TAG = re.compile(r"<[/!?A-Za-z][^<>]*\Z")

_LOWER = {k: k + 32 for k in range(65, 91)}


class _Open:
    """An element that is being read. `parts` are what its hash is made of, `first` is its first piece of text."""

    __slots__ = ("tag", "label", "parts", "gone", "kept", "removable", "first")

    def __init__(self, tag: str, label: str, gone: bool, kept: bool, removable: bool, first: int) -> None:
        self.tag, self.label, self.gone, self.kept, self.removable, self.first = tag, label, gone, kept, removable, first
        self.parts: list[str] = []


def host_of(url: str | None) -> str:
    place = (url or "").partition("://")[2]
    return re.split(r"[/?#]", place, maxsplit=1)[0].translate(_LOWER)


def _known(part: str) -> list[str]:
    """The listed words that a part of a name is made of: itself, or two of them written together."""
    listed = ASIDE_WORDS | NEUTRAL_WORDS | BESIDE_WORDS
    if part in listed:
        return [part]
    cuts = [[part[:k], part[k:]] for k in range(2, len(part) - 1) if part[:k] in listed and part[k:] in listed]
    return cuts[0] if cuts else []


def _aside_name(name: str) -> bool:
    """Numbers aside, whether a name is made of aside words and neutral ones, one aside word at least."""
    parts = [_known(p) for p in re.split(r"[^a-z]+", name) if p]
    return all(parts) and any(w in ASIDE_WORDS for words in parts for w in words)


def _judge(tag: str, attributes: str, in_article: bool) -> tuple[bool, bool, str]:
    """Whether a start tag opens a part that goes, whether it opens a main part, and its label."""
    names, main, label = [], tag in ("article", "main"), ""
    if attributes:
        for m in _NAMED.finditer(attributes):
            value = (m[2] or m[3] or m[4] or "").lower()
            if m[1].lower() == "class":
                label = value
            main = main or (m[1].lower() == "role" and value == "main")
            names += value.split()
    gone = tag in DROPPED or (tag == "header" and not in_article)
    container = tag in BLOCKS and tag not in PROSE and tag not in CELLS if in_article else True
    if not gone and not main and container and tag not in ("html", "body"):
        gone = any(_aside_name(n) and not (n == "header" and in_article) for n in names)
    return gone, main, label


def read(page: str | None) -> tuple[list[str], list[tuple[int, int, int]], list[int]]:
    """The pieces of text that stay unless a template goes (an empty one marks a break between blocks), (hash, first, end)
    of each removable subtree that holds some of them, and the hashes of all removable subtrees that hold text."""
    page = page or ""
    pieces: list[str] = []
    inside: list[bool] = []
    ranges: list[tuple[int, int, int]] = []
    stack = [_Open("", "", False, False, False, 0)]
    places: dict[str, list[int]] = {}  # by tag, and of all blocks and limits of closing, the depths of open elements

    def last(name: str) -> int:
        held = places.get(name)
        return held[-1] if held else 0

    def put(raw: str, kept: bool) -> None:
        pieces.append(raw)
        inside.append(kept)

    def close() -> None:
        top = stack.pop()
        places[top.tag].pop()
        if top.tag in CLOSE_LIMIT:
            places["#limit"].pop()
        if top.tag in BLOCKS:
            places["#block"].pop()
            put("", top.kept)
        if top.parts:
            mark = xxhash.xxh64_intdigest(f"{top.tag}\x1f{top.label}\x1e" + "\x1e".join(top.parts)) >> 1
            stack[-1].parts.append(f"{mark:x}")
            if top.removable:
                ranges.append((mark, top.first, len(pieces)))

    def close_to(depth: int) -> None:
        while len(stack) > depth:
            close()

    def text(raw: str) -> None:
        top = stack[-1]
        if raw and not raw.isspace():
            top.parts.append(" ".join(raw.split()))
        if raw and not top.gone:
            put(raw, top.kept)

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if not m:
            break
        text(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag == "br":
            put("", stack[-1].kept)
            continue
        if m[1]:
            depth = last(tag)
            if depth and not (tag in INLINE_FORMAT and last("#block") > depth):
                close_to(depth)
            continue
        if tag in BLOCKS:
            put("", stack[-1].kept)
            if last("p") > last("#limit"):  # a block ends an open paragraph
                close_to(last("p"))
            depth = max((last(t) for t in CLOSES.get(tag, "").split()), default=0)
            if depth > last("#limit"):
                close_to(depth)
        if tag in VOID:
            continue
        top = stack[-1]
        gone, main, label = _judge(tag, m[3], top.kept)
        kept = top.kept or (main and not top.gone)
        removable = tag in BLOCKS and tag not in ("html", "body", "article", "main", "head") and not main and not (top.kept and (tag in PROSE or tag in CELLS))
        if m[3].endswith("/") and tag not in BLOCKS and tag not in RAW:
            continue
        places.setdefault(tag, []).append(len(stack))
        if tag in CLOSE_LIMIT:
            places.setdefault("#limit", []).append(len(stack))
        if tag in BLOCKS:
            places.setdefault("#block", []).append(len(stack))
        stack.append(_Open(tag, label, top.gone or gone, kept, removable, len(pieces)))
        if tag in RAW:
            stop = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
            at = stop.start() if stop else end
    if at < end:
        text(_CUT_TAG.sub("", page[at:]))
    close_to(1)
    found = sorted({mark for mark, _, _ in ranges})
    size = [sum(len(raw) - raw.count(" ") for raw, k in zip(pieces, inside, strict=True) if k == kept) for kept in (True, False)]
    if size[0] and 4 * size[0] >= size[1]:
        place = np.concatenate([[0], np.cumsum(inside)])
        ranges = [(mark, int(place[a]), int(place[b])) for mark, a, b in ranges if place[b] > place[a]]
        pieces = [raw for raw, k in zip(pieces, inside, strict=True) if k]
    spoken = np.concatenate([[0], np.cumsum([bool(raw.strip()) for raw in pieces])]).astype(int)
    return pieces, [(mark, a, b) for mark, a, b in ranges if spoken[b] > spoken[a]], found


def assemble(pieces: list[str]) -> str:
    """Text of pieces: references decoded within a block, white space folded, blocks joined by one space."""
    blocks, block = [], []
    for raw in [*pieces, ""]:
        if raw:
            block.append(raw)
        elif block:
            folded = " ".join(references.unescape("".join(block)).split())
            if folded:
                blocks.append(folded)
            block = []
    return " ".join(blocks)


def without(pieces: list[str], ranges: list[tuple[int, int, int]], gone: set[int]) -> list[str]:
    """`pieces` without the subtrees of the hashes `gone`; a break stands where one was."""
    depth = np.zeros(len(pieces) + 1, int)
    for mark, a, b in ranges:
        if mark in gone:
            depth[a] += 1
            depth[b] -= 1
    return [raw if level == 0 else "" for raw, level in zip(pieces, np.cumsum(depth)[:-1].tolist(), strict=True)]


OUTLINE = "page_id {id}, url string, host string, content long, marks array<long>, text string, pieces array<string>, subtrees array<struct<mark:long,first:int,end:int>>"


def outline(pages: DataFrame) -> DataFrame:
    """Of every page: host, hash of its html, hashes of its removable subtrees, and its text or, where that depends on
    templates, pieces and subtrees; and `row`, a number of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("mark", pa.int64()), ("first", pa.int32()), ("end", pa.int32())]))
        kinds = {"host": pa.string(), "content": pa.int64(), "marks": pa.list_(pa.int64()), "text": pa.string(), "pieces": pa.list_(pa.string()), "subtrees": span}
        for whole in batches:
            for k in range(0, max(1, whole.num_rows), HANDED):
                batch = whole.slice(k, HANDED)
                out: dict[str, list] = {c: [] for c in kinds}
                for url, value in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                    page = value.as_py()
                    pieces, ranges, found = read(page)
                    out["host"].append(host_of(url))
                    out["content"].append(xxhash.xxh64_intdigest((page or "").encode("utf-8", "surrogatepass")) >> 1)
                    out["marks"].append(found)
                    out["text"].append(None if ranges else assemble(pieces))
                    out["pieces"].append(pieces if ranges else None)
                    out["subtrees"].append([{"mark": m, "first": a, "end": b} for m, a, b in ranges] if ranges else None)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(v, kinds[c]) for c, v in out.items())], names=["page_id", "url", *out])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, OUTLINE.format(id=kind)).withColumn("row", F.monotonically_increasing_id())


def templates(outlined: DataFrame) -> DataFrame:
    """(host, mark): subtrees that recur on many pages of distinct content of their host."""
    distinct = materialise(outlined.groupBy("host", "content").agg(F.first("marks").alias("marks")))
    totals = materialise(distinct.groupBy("host").agg(F.count("*").alias("pages")))
    counted = distinct.select("host", F.explode("marks").alias("mark")).groupBy("host", "mark").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_PAGES)
    return materialise(materialise(counted).join(totals, "host").where(F.col("n") >= F.sqrt("pages")).select("host", "mark"))


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    outlined = materialise(outline(pages))
    found = templates(outlined)
    pending = outlined.where("pieces IS NOT NULL")
    some = F.broadcast(found) if found.count() <= BROADCAST_TEMPLATES else found
    marks = pending.select("row", "host", F.explode(F.array_distinct(F.col("subtrees.mark"))).alias("mark"))
    gone = materialise(marks.join(some, ["host", "mark"]).groupBy("row").agg(F.collect_set("mark").alias("gone")))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for pieces, subtrees, marks in zip(*(batch.column(k) for k in (2, 3, 4)), strict=True):
                ranges = [(x["mark"], x["first"], x["end"]) for x in subtrees.as_py()]
                texts.append(assemble(without(pieces.as_py(), ranges, set(marks.as_py() or ()))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    settled = outlined.where("pieces IS NULL").select("page_id", "url", "text")
    open_ = pending.join(gone, "row", "left").select("page_id", "url", "pieces", "subtrees", "gone")
    both = settled.unionByName(open_.mapInArrow(finish, settled.schema))
    return both.withColumn("n_chars", F.length("text").cast("long"))


def op7_main_text(spark, sf_dir):
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
