"""HTML extraction: main text by structure, boilerplate by repeated runs of a host's pages.

``blocks`` walks over a page's tags once.  Scripts, styles, forms, navigation, headers,
footers, sidebars, adverts, notices and comments, told by element or by words of their class
and id, are left out; text inside ``article`` or ``main`` is the page's main text.  A header
inside an article that holds a heading keeps the heading.

Pages without such an element keep their other blocks as loose text.  What a host repeats
is looked for on every page, in main and in loose text apart.  The different texts of a host
are dealt into slices; a task orders the suffixes of a slice's tokens by their first ``run``
tokens, whose intervals are the runs with the pages they stand on.  A run on ``percent`` of a
host's texts stands on ``percent`` of some slice's, so the slices propose runs, sums over
them settle most, and the rest is counted on all of the host's pages.  A longer repeat is
covered by its runs.  Runs on at least ``pages`` and ``percent`` of the host's different
texts are boilerplate.

Tokens that they cover are cut from loose blocks.  In main text only whole paragraphs of
``run`` tokens or more go, such as notices that no class tells.  There a run must also stand
mostly on articles with other text, of which boilerplate makes up ``most`` percent or less;
articles that share more are versions of one another, and their text stays.  An article of
nothing else stays, too.  A repeated heading goes only if nothing stays of what it heads.  All
else stays.  Loose text around main text is evidence for the host's other pages.

White space in a block becomes one space, ``br`` counts as white space, character references
are decoded, blocks are joined by a line break.

Edge cases: a null page is empty; unclosed elements end with their parent; text with no
markup is one block; a null url is a host of its own; pages of a host with the
same blocks, whatever their urls, count as one page, and their text stays, as do articles with
the same blocks; an empty table stays empty.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.llm import common


@dataclass(frozen=True)
class ExtractOptions:
    run: int = 6  # tokens of the shortest repeated run; a shorter block is compared whole
    pages: int = 3  # different pages of a host that boilerplate stands on at least
    percent: int = 50  # and of the host's different pages with such text
    most: int = 50  # percent of an article's tokens that boilerplate makes up where it tells of a run
    slice_pages: int = 250  # pages of a host that are dealt to one group, about
    slice_bytes: int = 1 << 20  # of text whose suffixes are ordered at once, twice that at most, or one page's


_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^"'>]|"[^"]*"|'[^']*')*)>"""
    r"|</[^>]*>",
    re.S,
)
_RAW = {"script", "style", "textarea", "noscript", "template", "iframe", "svg", "math", "canvas", "object", "audio", "video", "title", "xmp", "noembed", "noframes"}
_DROP = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "head", "fieldset", "datalist", "search"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "output", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_MAIN = {"article", "main"}
_MAIN_NAMES = {"article", "articlebody", "main", "maincontent", "content", "post", "postcontent", "entry", "entrycontent", "story", "storybody"}
_DROP_NAMES = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "banner", "sponsor", "sponsored", "promo", "promotion",
    "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "aside", "widget", "footer", "header", "masthead", "topbar",
    "cookie", "cookies", "consent", "gdpr", "notice", "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "login", "alert",
    "comment", "comments", "disqus", "replies", "respond", "related", "recommended", "share", "sharing", "social", "pagination", "pager", "toolbar", "hidden",
    "discussion", "discussions", "responses", "feedback", "guestbook", "disclaimer", "copyright", "privacy", "announcement", "notices", "alerts", "menus",
}
_DROP_START = re.compile(r"(?:comment(?!ary)|advert|sidebar|breadcrumb|newsletter|cookie|footer|navbar|sponsor|popup|subscri)[a-z]*$|ad(?:box|slot|unit|wrap|block|space|banner|sense)[a-z]*$|[a-z]+(?:footer|sidebar|navbar)$")
_TITLE_NAMES = {"header", "masthead"}  # inside a main part they hold its heading
_MODIFIERS = {"with", "has", "no", "without", "is", "js"}
_NOT_MAIN = {"comment", "comments", "reply", "replies", "ad", "ads", "advert", "advertisement", "sponsored", "promo", "related", "recommended"}
_DROP_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "form", "menu", "menubar", "note"}
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_VALUE = re.compile(r"""=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]*)""")
_NAME = re.compile(r"[a-z]+")
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_CLOSES_P = {"p", "div", "article", "section", "aside", "header", "footer", "nav", "main", "ul", "ol", "dl", "table", "form", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "figure", "hr", "fieldset", "address", "details"}


def _kind(name: str, attributes: str, main: bool) -> str:
    """"drop", "main" or "" for an element."""
    if name in _RAW or name in _DROP:
        return "drop"
    if name == "header" and not main:
        return "drop"
    if name in ("body", "html"):
        return ""
    if "=" in attributes:
        words: list[str] = []
        for key, *values in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), next((v for v in values if v), "")
            names, value = value.split(), value.lower()
            if key in ("class", "id"):
                for part in names:
                    found = _NAME.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", part).lower())
                    if found and found[0] not in _MODIFIERS:  # "with-sidebar" tells of the layout
                        words += [*found, "".join(found)]
            elif key == "role" and value in _DROP_ROLES or key == "aria-hidden" and value == "true":
                return "drop"
            elif key == "style" and "display:none" in value.replace(" ", ""):
                return "drop"
            elif key == "role" and value in ("main", "article") or key == "itemprop" and value == "articlebody":
                return "main"
        if name in _MAIN:
            if not _NOT_MAIN.isdisjoint(words):
                return "drop"
        elif any((w in _DROP_NAMES or _DROP_START.match(w)) and not (main and w in _TITLE_NAMES) for w in words):
            return "drop"
        if name in ("div", "section", "td") and not _MAIN_NAMES.isdisjoint(words):
            return "loose main"
    if "hidden" in attributes.lower() and "hidden" in _VALUE.sub(" ", attributes).lower().replace("/", " ").split():
        return "drop"
    return "main" if name in _MAIN else ""


def blocks(page: str | None) -> tuple[list[str], list[str]]:
    """(main, loose) blocks of text in page order."""
    return _blocks(page)[:2]


def _blocks(page: str | None) -> tuple[list[str], list[str], list[bool], list[bool]]:
    """(main, loose) blocks of text in page order, and whether each main and each loose one is a heading.

    An ``article`` or ``main`` element, or one with that role, outranks elements that are
    only named like content; the named ones count where there is no other.
    """
    found: list[tuple[int, str, bool]] = []  # rank of the place, text, heading
    text: list[str] = []
    stack: list[tuple[str, int, int]] = []  # open element, drop depth and rank inside it
    drop = rank = 0
    at = 0
    page = page or ""

    def flush() -> None:
        if text:
            joined = " ".join(entities.unescape("".join(text)).split())
            if joined and not drop:
                found.append((rank, joined, any(x[0] in _HEADINGS for x in stack)))
            text.clear()

    def close(place: int) -> None:
        nonlocal drop, rank
        flush()
        drop, rank = stack[place][1], stack[place][2]
        del stack[place:]

    end = len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            if not drop:
                text.append(page[at:])
            break
        if m.start() > at and not drop:
            text.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            if name in _INLINE:
                # an inline element that was dropped or changed rank stands on the stack
                place = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
                if place is not None and all(x[0] in _INLINE for x in stack[place:]):
                    close(place)
                continue
            if name in _VOID:
                continue
            place = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
            if place is not None:
                close(place)
            else:
                flush()
            continue
        if name == "br":
            text.append(" ")
            continue
        if name in _VOID:
            if name == "hr":
                flush()
            continue
        attributes = m[3]
        if name in _RAW and not attributes.rstrip().endswith("/"):
            closing = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = closing.end() if closing else end
            continue
        if name in _INLINE:
            if not attributes or _kind(name, attributes, rank > 0) != "drop":
                continue
            flush()
            stack.append((name, drop, rank))
            drop += 1
            continue
        flush()
        if name in _CLOSES_P:
            place = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == "p" or stack[k][0] not in _INLINE), None)
            if place is not None and stack[place][0] == "p":
                close(place)
        elif name in ("li", "dt", "dd", "tr", "td", "th", "option"):
            same = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}[name]
            place = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] in ("ul", "ol", "dl", "table", "select", "div", *same)), None)
            if place is not None and stack[place][0] in same:
                close(place)
        stack.append((name, drop, rank))
        kind = _kind(name, attributes, rank > 0)
        if kind == "drop":
            drop += 1
        elif kind == "main":
            rank = max(rank, 2)
        elif kind:
            rank = max(rank, 1)
    flush()
    best = max((r for r, _, _ in found), default=0)
    main = [x for x in found if best and x[0] == best]
    loose = [x for x in found if x[0] < best or not best]
    return [t for _, t, _ in main], [t for _, t, _ in loose], [h for _, _, h in main], [h for _, _, h in loose]


STEP_ROWS = 128  # pages that are parsed before their blocks leave the task


def hosted(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, html) of every page."""
    common.bounded_batches(pages.sparkSession)
    host = F.regexp_replace(F.lower(F.coalesce("url", F.lit(""))), r"^[a-z][a-z0-9+.\-]*:/*|[/?#].*$", "")
    return pages.select("page_id", "url", F.regexp_replace(host, r"^.*@|:\d*$", "").alias("host"), "html")


def _streams(page: str | None) -> Iterator[tuple[bool, int, list[str]]]:
    """(whether main, key, blocks) of a page's main and loose text; equal keys are equal texts.

    The key of loose text covers the main text too.
    """
    main, loose, _, _ = _blocks(page)
    for part, told, texts in ((True, main, main), (False, [*main, "", *loose], loose)):
        if texts:
            yield part, int.from_bytes(blake2b("\n".join(told).encode(), digest_size=8).digest(), "big", signed=True), texts


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, str, bool, int, list[str]]]]]:
    """(pages, their streams) of rows that start with host and html, step by step.

    A stream is (row, host, main, key, blocks); each goes out once in a task, as its copies count once.
    """
    told: dict[str, set[tuple[bool, int]]] = defaultdict(set)
    for batch in batches:
        for k in range(0, batch.num_rows, STEP_ROWS):
            part, out = batch.slice(k, STEP_ROWS), []
            for row, (host, page) in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist())):
                for main, key, texts in _streams(page):
                    if (main, key) not in told[host]:
                        told[host].add((main, key))
                        out.append((row, host, main, key, texts))
            yield part, out


def _numbers(column: pa.Array) -> list[np.ndarray]:
    """The lists of a column of lists of whole numbers; null is empty."""
    ends, values = column.offsets.to_numpy(), column.values.to_numpy()
    return [values[a:b] for a, b in zip(ends, ends[1:])]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


# ---------------------------------------------------------------- repeated runs of a host


def _tokens(lists: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes of all blocks, the page of each block, and the first token of each block."""
    flat = [b.encode() for x in lists for b in x]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in flat])]).astype(np.int64)
    words, _, begin = common.word_hashes(np.frombuffer(b"".join(flat), np.uint8), offsets, common.NON_SPACE)
    return words, np.repeat(np.arange(len(lists)), [len(x) for x in lists]), begin


def _windows(begin: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """First token and length of every window of ``run`` tokens, then of the shorter blocks as they are."""
    sizes = np.diff(begin)
    left = np.repeat(begin[1:], sizes) - np.arange(begin[-1])
    full, short = np.flatnonzero(left >= run), np.flatnonzero((sizes > 0) & (sizes < run))
    return np.concatenate([full, begin[short]]), np.concatenate([np.full(len(full), run), sizes[short]])


def _ranks(words: np.ndarray, begin: np.ndarray, hosts: np.ndarray, run: int) -> np.ndarray:
    """Ranks of a slice's suffixes by their first ``run`` tokens, within hosts; equal runs get equal ranks.

    Doubling: the rank by k tokens and the rank of the suffix k further on give the rank by
    2k; a block's end stops the comparison, so a shorter suffix ranks by what it has.
    """
    left = np.repeat(begin[1:], np.diff(begin)) - np.arange(len(words))
    rank = np.unique(common.mix(words) ^ common.mix(hosts.astype(np.uint64)), return_inverse=True)[1].astype(np.int64)
    width = 1
    while width < run:
        step = min(width, run - width)
        follow = np.where(left > step, rank[np.minimum(np.arange(len(words)) + step, len(words) - 1)] + 1, 0)
        rank = np.unique(rank * (len(words) + 2) + follow, return_inverse=True)[1].astype(np.int64)
        width += step
    return rank


def _names(words: np.ndarray, at: np.ndarray, sizes: np.ndarray, run: int) -> np.ndarray:
    """Hashes of the windows at ``at``, as ``common.shingles`` gives them; full windows first."""
    first = np.concatenate([[0], np.cumsum(sizes)])
    place = np.arange(first[-1]) - np.repeat(first[:-1], sizes) + np.repeat(at, sizes)
    return common.shingles(words[place], first, run)[0].view(np.int64)


def _intervals(owners: list[list[list[str]]], need: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, run, pages) of the runs on at least ``need`` pages of an owner; an owner is a list of its pages' blocks.

    Windows of one interval of the ordered suffixes share their run; the interval's pages are counted.
    """
    words, page, begin = _tokens([texts for pages in owners for texts in pages])
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    of = np.repeat(np.arange(len(owners)), [len(pages) for pages in owners])  # of each page
    sizes = np.diff(begin)
    at, length = _windows(begin, run)
    on = np.repeat(page, sizes)[at]
    rank = _ranks(words, begin, np.repeat(of[page], sizes), run)[at]
    order = np.lexsort((on, rank))
    head, fresh = np.ones(len(order), bool), np.ones(len(order), bool)
    head[1:] = rank[order][1:] != rank[order][:-1]
    fresh[1:] = head[1:] | (on[order][1:] != on[order][:-1])
    cut = np.flatnonzero(head)
    pages, own = np.add.reduceat(fresh.astype(np.int64), cut), order[cut]
    enough = pages >= need[of[on[own]]]
    own, pages = own[enough], pages[enough]
    by_size = np.argsort(length[own] < run, kind="stable")
    own, pages = own[by_size], pages[by_size]
    return of[on[own]], _names(words, at[own], length[own], run), pages


def _slices(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[str, bool, bool, list[list[str]]]]:
    """(host, main, whether all of the host, blocks of its pages) from streams in the order of host, main and slot.

    A group of more than twice ``limit`` bytes makes several slices; copies of a page count once.
    """
    mark: tuple | None = None
    seen: set[int] = set()
    held: list[list[str]] = []
    sizes: list[int] = []
    total, whole = 0, True
    for batch in batches:
        for host, main, slot, slots, key, texts in zip(*(c.to_pylist() for c in batch.columns)):
            if (host, main, slot) != mark:
                if mark is not None:
                    yield mark[0], mark[1], whole, held
                mark, seen, held, sizes, total, whole = (host, main, slot), set(), [], [], 0, slots == 1
            if key in seen:
                continue
            seen.add(key)
            held.append(texts)
            sizes.append(sum(map(len, texts)))
            total += sizes[-1]
            if total >= 2 * limit and len(held) > 1:
                stop = max(int(np.searchsorted(np.cumsum(sizes), limit)), 1)
                whole = False
                yield host, main, whole, held[:stop]
                held, sizes, total = held[stop:], sizes[stop:], total - sum(sizes[:stop])
    if mark is not None:
        yield mark[0], mark[1], whole, held


_LOCAL = "host string, main boolean, whole boolean, run long, on long, of long"


def _local(rows: DataFrame, options: ExtractOptions) -> DataFrame:
    """What the slices tell: runs of hosts in one slice (``whole``) are settled; else runs that a slice proposes, and a row without run for each slice."""
    crowds = rows.groupBy("host").agg(F.count("*").alias("n")).where(F.col("n") > options.slice_pages)
    crowds = common.staged(crowds.select("host", F.ceil(F.col("n") / options.slice_pages).cast("int").alias("slots")))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [("host", pa.string()), ("main", pa.bool_()), ("slot", pa.int32()), ("slots", pa.int32()), ("key", pa.int64()), ("texts", pa.list_(pa.string()))]
        for part, streams in _parts(batches):
            slots, out = part.column(2).to_pylist(), []
            for row, host, main, key, texts in streams:
                able = [b for b in texts if b.count(" ") >= options.run - 1] if main else texts  # to hold a run
                out.append((host, main, key % slots[row], slots[row], key, able))
            yield _batch(out, pa.schema(kinds))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, bool, bool, list[list[str]]]] = []

        def found() -> pa.RecordBatch:
            of = np.array([len(pages) for *_, pages in held])
            whole = np.array([w for _, _, w, _ in held], bool)
            need = -(-options.percent * of // 100)
            need = np.maximum(np.where(whole, np.maximum(need, options.pages), need), 1)
            owner, run, on = _intervals([pages for *_, pages in held], need, options.run)
            parts = np.flatnonzero(~whole)  # rows without run
            at = np.concatenate([parts, owner])
            empty, none = np.zeros(len(parts), np.int64), np.arange(len(at)) < len(parts)
            columns = [
                pa.array([held[k][0] for k in at], pa.string()),
                pa.array([held[k][1] for k in at], pa.bool_()),
                pa.array(whole[at]),
                pa.array(np.concatenate([empty, run]), mask=none),
                pa.array(np.concatenate([empty, on])),
                pa.array(np.concatenate([of[parts], np.zeros(len(owner), np.int64)])),
            ]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, ["host", "main", "whole", "run", "on", "of"])

        size = 0
        for host, main, whole, pages in _slices(batches, options.slice_bytes):
            if whole and len(pages) < options.pages:
                continue
            held.append((host, main, whole, pages))
            size += sum(len(b) for texts in pages for b in texts)
            if size >= options.slice_bytes:
                yield found()
                size = 0
        if held:
            yield found()

    dealt = rows.join(crowds, "host", "left").select("host", "html", F.coalesce("slots", F.lit(1)).alias("slots"))
    dealt = dealt.mapInArrow(deal, "host string, main boolean, slot int, slots int, key long, texts array<string>")
    return common.staged(dealt.repartition("host", "main", "slot").sortWithinPartitions("host", "main", "slot").mapInArrow(find, _LOCAL))


def _counted(rows: DataFrame, wanted: DataFrame, options: ExtractOptions) -> DataFrame:
    """(host, main, run, on, apart): on how many different texts of a host each wanted run stands, and on how many that are mostly other text."""

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [("host", pa.string()), ("main", pa.bool_()), ("key", pa.int64()), ("apart", pa.int32()), ("runs", pa.list_(pa.int64()))]
        for part, streams in _parts(batches):
            runs, out = {True: _numbers(part.column(2)), False: _numbers(part.column(3))}, []
            marks = _marks([x[4] for x in streams], [runs[x[2]][x[0]] for x in streams], options.run)
            for (_, host, main, key, _), (here, of, gone) in zip(streams, marks):
                if len(here):
                    out.append((host, main, key, int(100 * of[gone].sum() <= options.most * of.sum()), np.unique(here)))
            yield _batch(out, pa.schema(kinds))

    some = rows.join(_by_host(wanted), "host").select("host", "html", "main_runs", "loose_runs")
    some = some.mapInArrow(present, "host string, main boolean, key long, apart int, runs array<long>").dropDuplicates(["host", "main", "key"])
    some = some.select("host", "main", "apart", F.explode("runs").alias("run"))
    return some.groupBy("host", "main", "run").agg(F.count("*").alias("on"), F.sum("apart").alias("apart"))


def _by_host(runs: DataFrame) -> DataFrame:
    """(host, main_runs, loose_runs), stored, so that its size is known where it is joined."""
    lists = [F.collect_list(F.when(F.col("main") == part, F.col("run"))).alias(name) for part, name in ((True, "main_runs"), (False, "loose_runs"))]
    return common.staged(runs.groupBy("host").agg(*lists))


def repeated(rows: DataFrame, options: ExtractOptions) -> DataFrame:
    """(host, main, run): hashes of runs in main or loose text that stand on enough of a host's different pages."""
    local = _local(rows, options)
    settled = local.where("whole").select("host", "main", "run")
    pieces = local.where("not whole").groupBy("host", "main", "run").agg(F.sum("on").alias("on"), F.sum("of").alias("of"))
    need = F.greatest(F.lit(options.pages), F.ceil(options.percent * F.col("of") / 100)).alias("need")
    hosts = common.staged(pieces.where("run is null").select("host", "main", "of", need).where("need <= of").drop("of"))
    proposed = common.staged(pieces.where("run is not null").select("host", "main", "run", "on").join(hosts, ["host", "main"]))
    settled = settled.unionByName(proposed.where("on >= need").select("host", "main", "run"))
    doubtful = proposed.where("on < need").select("host", "main", "run")
    if not doubtful.isEmpty():
        counted = _counted(rows, doubtful, options).join(hosts, ["host", "main"]).where("on >= need")
        settled = settled.unionByName(counted.select("host", "main", "run"))
    settled = common.staged(settled)
    inside = settled.where("main")
    if inside.isEmpty():
        return settled
    told = _counted(rows, inside, options).where((F.col("apart") >= options.pages) & (100 * F.col("apart") >= options.percent * F.col("on")))
    return settled.where("not main").unionByName(told.select("host", "main", "run"))


# ---------------------------------------------------------------- what stays of a page


def _covered(lists: list[list[str]], runs: list[np.ndarray], run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of pages with the runs of each: which tokens they cover, the first token and the page of every block, and page and hash of the runs found."""
    words, page, begin = _tokens(lists)
    hashes = common.shingles(words, begin, run)[0].view(np.int64)
    at, length = _windows(begin, run)
    wanted = np.concatenate([*runs, np.zeros(0, np.int64)])
    hit = np.flatnonzero(np.isin(hashes, wanted))
    on, hashes = np.repeat(page, np.diff(begin))[at[hit]], hashes[hit]
    # of its own page; pairs of run and page are numbered
    values, place = np.unique(wanted, return_inverse=True)
    own = place * len(lists) + np.repeat(np.arange(len(runs)), [len(r) for r in runs])
    own = np.isin(np.searchsorted(values, hashes) * len(lists) + on, own)
    hit, on, hashes = hit[own], on[own], hashes[own]
    edges = np.zeros(begin[-1] + 1, np.int64)
    np.add.at(edges, at[hit], 1)
    np.add.at(edges, (at + length)[hit], -1)
    return np.cumsum(edges[:-1]) > 0, begin, page, on, hashes


def _marks(lists: list[list[str]], runs: list[np.ndarray], run: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of every page: the runs found, the tokens of each block, and whether runs cover it and it has ``run`` tokens or more."""
    if not any(map(len, runs)):
        yield from ((np.zeros(0, np.int64), np.zeros(len(x), np.int64), np.zeros(len(x), bool)) for x in lists)
        return
    covered, begin, page, on, hashes = _covered(lists, runs, run)
    order = np.argsort(on, kind="stable")
    found = np.split(hashes[order], np.searchsorted(on[order], np.arange(1, len(lists))))
    sums, sizes = np.concatenate([[0], np.cumsum(covered)]), np.diff(begin)
    gone = (sizes >= run) & (sums[begin[1:]] - sums[begin[:-1]] == sizes)
    first = np.searchsorted(page, np.arange(1, len(lists)))
    yield from zip(found, np.split(sizes, first), np.split(gone, first))


def _headed(whole: list[str], left: list[str], heads: list[bool]) -> list[str]:
    """What is left of a page's blocks, with its headings whole where anything stays below them."""
    out, alive, after = list(left), False, False  # after: the block that follows is a heading
    for k in range(len(out) - 1, -1, -1):
        if heads[k]:
            out[k] = whole[k] if alive else left[k]
            alive |= bool(out[k])
        else:
            alive = bool(out[k]) or (alive and not after)
        after = heads[k]
    return out


def _loose_left(lists: list[list[str]], heads: list[list[bool]], runs: list[np.ndarray], run: int) -> list[list[str]]:
    """Loose blocks of pages without the tokens that runs cover."""
    if not any(map(len, runs)):
        return lists
    covered, begin, page, _, _ = _covered(lists, runs, run)
    first, out = np.searchsorted(page, np.arange(len(lists) + 1)), []
    for k, texts in enumerate(lists):
        a, b = first[k], first[k + 1]
        if covered[begin[a] : begin[b]].any():
            marks = [covered[begin[j] : begin[j + 1]] for j in range(a, b)]
            texts = _headed(texts, [" ".join(w for w, gone in zip(t.split(), c) if not gone) for t, c in zip(texts, marks)], heads[k])
        out.append(texts)
    return out


def _main_left(lists: list[list[str]], heads: list[list[bool]], runs: list[np.ndarray], run: int) -> list[list[str]]:
    """Main blocks of pages without the paragraphs that runs cover; a page of nothing else keeps them."""
    out = []
    for texts, head, (_, _, gone) in zip(lists, heads, _marks(lists, runs, run)):
        out.append(_headed(texts, ["" if g else t for t, g in zip(texts, gone)], head) if gone.any() and not gone.all() else texts)
    return out


def extract(pages: DataFrame, options: ExtractOptions = ExtractOptions()) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    rows = hosted(pages)
    runs = _by_host(repeated(rows, options))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, STEP_ROWS):
                part = batch.slice(k, STEP_ROWS)
                got, texts = [_blocks(page) for page in part.column(2).to_pylist()], [""] * part.num_rows
                for kind, left in enumerate((_main_left, _loose_left)):
                    own, wanted = [i for i, x in enumerate(got) if bool(x[0]) != bool(kind)], _numbers(part.column(3 + kind))
                    kept = left([got[i][kind] for i in own], [got[i][2 + kind] for i in own], [wanted[i] for i in own], options.run)
                    for i, stays in zip(own, kept):
                        texts[i] = "\n".join(b for b in stays if b)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url {pages.schema['url'].dataType.simpleString()}, text string"
    whole = rows.join(runs, "host", "left").select("page_id", "url", "html", "main_runs", "loose_runs")
    return whole.mapInArrow(cut, schema).withColumn("n_chars", F.length("text").cast("long"))
