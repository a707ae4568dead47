"""The main text of web pages, by differencing pages of neighbouring URLs and by their markup.

A page is cut into *lines*: the text between the borders of block elements. All
pages of a host are sorted by URL path, each is paired with its nearest
neighbour, all lines of the two are aligned by a longest common subsequence, and
what they share - the template - goes.

The markup checks what differencing leaves. Lines of menus, headers, footers,
sidebars, forms, adverts, notices and reader comments (by element, role, or a word
of the class or id) go, shared or not, and so do those around a declared main
region (an article, else ``main``, else a block named so). A line of a declared
article is the article's own however often it is repeated, so it is no template,
neither here nor in the neighbour.

Shared lines say nothing if both pages have one article, so copies (equal
outlines) count as one page before pages are paired, and of its two neighbours a
page takes the nearer one that it doesn't share the larger part of its text with,
as far as markup leaves that text.
"""

from __future__ import annotations

import hashlib
import html
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quillgrid.llm import storage

_TAG = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*+>?|<(/?)([A-Za-z][^\s/>]*+)((?:=\s*+(?:\"[^\"]*+\"|'[^']*+')|[^>])*+)>?", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")

# --- fixed values: names of HTML elements, and the words that sites use for parts of a page ---
_RAW = "script style title textarea xmp iframe noembed noframes noscript".split()
_VOID = "area base br col embed hr img input link meta param source track wbr".split()
_BLOCK = "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
_GONE = "nav footer aside form script style head title noscript template iframe object svg canvas button select textarea dialog menu search noembed noframes xmp audio video map math".split()
_GONE_ROLES = "navigation banner contentinfo complementary search form menu menubar alert alertdialog dialog".split()
_GONE_WORDS = "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promoted cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup sidebar side aside rail menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager header masthead topbar footer foot colophon copyright legal comment comments commentlist disqus replies reply respond discussion share sharing social related recommended recommendations widget widgets form login signin search searchbox toolbar skip hidden tags".split()
_MAIN_NAMES = "content main article main-content page-content site-content post-content entry-content article-content article-body post-body story-body article-text maincontent articlebody".split()
_GONE_ARTICLES = "comment comments reply teaser related promo ad sponsored".split()
# --- end of fixed values ---

_RAW, _VOID, _BLOCK, _GONE = frozenset(_RAW), frozenset(_VOID), frozenset(_BLOCK), frozenset(_GONE)
_GONE_ROLES, _GONE_WORDS, _MAIN_NAMES, _GONE_ARTICLES = frozenset(_GONE_ROLES), frozenset(_GONE_WORDS), frozenset(_MAIN_NAMES), frozenset(_GONE_ARTICLES)
#: Elements that end when one of the same kind or a block begins.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = frozenset("ul ol dl table menu".split())
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+>?", re.I) for name in _RAW}
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")

KEPT, OPEN, DROPPED = 1, 0, -1
#: How sure a main region is: an article, a main element, or a block that is named so.
_ARTICLE, _MAIN, _NAMED = 3, 2, 1


def _standing(name: str, raw: str, inside: int) -> tuple[bool, int]:
    """(whether the element's text goes, how sure a main region it is), by its name and attributes."""
    gone, sure = name in _GONE or (name == "header" and not inside), _ARTICLE if name == "article" else _MAIN if name == "main" else 0
    if "=" not in raw and "hidden" not in raw:
        return gone, sure
    for key, a, b, c in _ATTRIBUTE.findall(raw):
        key, value = key.lower(), html.unescape(a or b or c).strip()
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and _UNSEEN.search(value)):
            gone = True
        elif key == "role":
            role = value.lower()
            gone = gone or role in _GONE_ROLES
            sure = max(sure, _ARTICLE if role == "article" else _MAIN if role == "main" else 0)
        elif key == "itemprop" and value.lower() == "articlebody":
            sure = _ARTICLE
        elif key in ("class", "id") and name not in ("html", "body"):
            names = _HUMP.sub("-", value).lower().replace("_", "-").split()
            words = {w for x in names for w in x.split("-")}
            if name == "article":
                gone = gone or bool(words & _GONE_ARTICLES)
            elif words & _GONE_WORDS:
                # a heading or header of the main region may be named so and still be the article's own
                gone = gone or not (name == "main" or (inside and name in ("header", "h1", "h2", "h3")))
            elif name in ("div", "section", "td") and _MAIN_NAMES.intersection(names):
                sure = max(sure, _NAMED)
    return gone, sure


def lines(page: str) -> tuple[list[str], list[int]]:
    """The text lines of a page in order, and what its markup says of each: KEPT, OPEN or DROPPED.

    Unclosed and crossing elements are taken much as browsers take them: an end
    tag closes what it names and all within, one that names nothing open is
    passed over; a block ends a paragraph. Character references are decoded,
    white space is one space, and a line break element is white space.
    """
    # (text, -1 if it goes or how sure the main region around it is, whether it's all links)
    out: list[tuple[str, int, bool]] = []
    shown: list[str] = []
    lost: list[str] = []
    stack: list[tuple[str, bool, int]] = []
    count: dict[str, int] = {}
    gone, sure = False, 0
    plain = linked = False

    def flush():
        nonlocal plain, linked
        for parts, standing in ((shown, sure), (lost, -1)):
            if parts:
                text = " ".join("".join(parts).split())
                if text:
                    out.append((text, standing, linked and not plain))
                parts.clear()
        plain = linked = False

    def close(names: frozenset[str] | set[str], scope: frozenset[str] = frozenset()) -> bool:
        nonlocal gone, sure
        for k in range(len(stack) - 1, -1, -1):
            name = stack[k][0]
            if name in names:
                for x, _, _ in stack[k:]:
                    count[x] -= 1
                del stack[k:]
                gone, sure = stack[-1][1:] if stack else (False, 0)
                return True
            if name in scope:
                return False
        return False

    def text(piece: str):
        nonlocal plain, linked
        piece = html.unescape(piece) if "&" in piece else piece
        (lost if gone else shown).append(piece)
        if not piece.isspace():
            if count.get("a"):
                linked = True
            else:
                plain = True

    at, n = 0, len(page)
    while at < n:
        tag = _TAG.search(page, at)
        start = tag.start() if tag else n
        if start > at:
            text(page[at:start])
        if not tag:
            break
        at, name = tag.end(), (tag[2] or "").lower()
        block = name in _BLOCK
        if not name:
            continue
        if block:
            flush()
        if tag[1]:
            if count.get(name):
                close({name})
            continue
        if name in _RAW:
            end = _RAW_END[name].search(page, at)
            at = end.end() if end else n
            continue
        if name == "br":
            (lost if gone else shown).append(" ")
            continue
        if name in _VOID:
            continue
        if block:
            if count.get("p"):
                close({"p"})
            ends = _CLOSES.get(name)
            if ends and any(count.get(x) for x in ends):
                while close(ends, _SCOPE) and name == "tr":
                    pass
        raw = tag[3]
        if block or name == "a" or count.get(name) or any(x in raw for x in ("class", "id", "role", "style")):
            own_gone, own_sure = _standing(name, raw, sure)
            gone, sure = gone or own_gone, max(sure, own_sure) if block else sure
            stack.append((name, gone, sure))
            count[name] = count.get(name, 0) + 1
    flush()
    return [t for t, _, _ in out], _settle(out)


def _settle(out: list[tuple[str, int, bool]]) -> list[int]:
    """KEPT, OPEN or DROPPED of each line: those around the surest main region go; in it, an article's are its own and others open; without one, rows of three links or more go and the rest is open."""
    size = [0, 0, 0, 0]
    for text, sure, _ in out:
        if sure >= 0:
            size[sure] += len(text)
    best = next((k for k in (_ARTICLE, _MAIN) if size[k]), 0)
    if not best and 2 * size[_NAMED] >= sum(size) > 0:
        best = _NAMED
    if best:
        inside = KEPT if best == _ARTICLE else OPEN
        return [inside if sure == best else DROPPED for _, sure, _ in out]
    verdicts = [DROPPED if sure < 0 else OPEN for _, sure, _ in out]
    k = 0
    while k < len(out):
        end = k
        while end < len(out) and out[end][2]:
            end += 1
        if end - k >= 3:
            verdicts[k:end] = [DROPPED] * (end - k)
        k = max(end, k + 1)
    return verdicts


def _common(a: list[int], b: list[int]) -> list[int]:
    """``after[j]``: the length of a longest common subsequence of ``a`` and the first j items of ``b`` (bit-parallel)."""
    places: dict[int, int] = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | (1 << j)
    every = (1 << len(b)) - 1
    row = every
    for x in a:
        at = places.get(x, 0)
        if at:
            u = row & at
            row = ((row + u) | (row - u)) & every
    bits = np.unpackbits(np.frombuffer((~row & every).to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return [0, *np.cumsum(bits, dtype=np.int64).tolist()]


def aligned(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """The places in ``a`` and ``b`` of a longest common subsequence, in memory that is linear in both (divide and conquer)."""
    found: list[tuple[int, int]] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        i, j, k, m = work.pop()
        while i < j and k < m and a[i] == b[k]:
            found.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            found.append((j, m))
        if i == j or k == m:
            continue
        if j - i == 1:
            if a[i] in b[k:m]:
                found.append((i, b.index(a[i], k, m)))
            continue
        mid = (i + j) // 2
        head, tail = _common(a[i:mid], b[k:m]), _common(a[mid:j][::-1], b[k:m][::-1])
        width = m - k
        cut = max(range(width + 1), key=lambda x: head[x] + tail[width - x])
        work += [(i, mid, k, k + cut), (mid, j, k + cut, m)]
    return sorted(found)


def shared(a: list[int], b: list[int]) -> list[int]:
    """Places of ``a`` on a longest common subsequence of ``a`` and ``b``."""
    return [i for i, _ in aligned(a, b)]


# --- on Spark ---

_OUTLINED = "host string, path string, outline binary, hashes array<long>, sizes array<int>, verdicts array<tinyint>"
_LINED = "host string, outline binary, verdicts array<tinyint>, lines binary"


def _address(url: str | None) -> tuple[str, str]:
    """Host and path of a URL; a null or unreadable one is on no host, under its own text."""
    m = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)([^?#]*)", url or "")
    return (m[1].rsplit("@", 1)[-1].lower(), m[2] or "/") if m else ("", url or "")


def _outline(texts: list[str], verdicts: list[int]) -> bytes:
    """A digest of a page's lines and of what its markup says of each."""
    marks = np.array(verdicts, np.int8).tobytes()
    return hashlib.blake2b(len(marks).to_bytes(8, "little") + marks + "\n".join(texts).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _hash(line: str) -> int:
    return int.from_bytes(hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _outlines(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The outline of each page: hashes of all its lines, what its markup says of them, and their sizes (0 if they go)."""
    for batch in batches:
        rows: list[list] = [[] for _ in schema]
        for url, page in zip(batch.column("_url").to_pylist(), batch.column("_page").to_pylist()):
            texts, verdicts = lines(page or "")
            sizes = [0 if v == DROPPED else len(t) for t, v in zip(texts, verdicts)]
            for column, value in zip(rows, (*_address(url), _outline(texts, verdicts), [_hash(t) for t in texts], sizes, verdicts)):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(rows, schema)], schema=schema)


def _lined(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The lines of each page that its markup leaves, compressed, beside its row and outline."""
    for batch in batches:
        rows: list[list] = [[] for _ in range(4)]
        for url, page in zip(batch.column("_url").to_pylist(), batch.column("_page").to_pylist()):
            texts, verdicts = lines(page or "")
            left = "\n".join(t for t, v in zip(texts, verdicts) if v != DROPPED)
            for column, value in zip(rows, (_address(url)[0], _outline(texts, verdicts), verdicts, zlib.compress(left.encode("utf-8", "surrogatepass")))):
                column.append(value)
        yield pa.RecordBatch.from_arrays([batch.column("_row"), *[pa.array(c, t.type) for c, t in zip(rows, list(schema)[1:])]], schema=schema)


def _without(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Each page's text: the lines that its markup leaves, without its template."""
    for batch in batches:
        texts = []
        for verdicts, packed, template in zip(*(batch.column(c).to_pylist() for c in ("verdicts", "lines", "template"))):
            gone = set(template or ())
            left = zlib.decompress(packed).decode("utf-8", "surrogatepass").split("\n")
            places = [k for k, v in enumerate(verdicts) if v != DROPPED]
            texts.append("\n".join(t for k, t in zip(places, left) if k not in gone))
        yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(texts, pa.string())], schema=schema)


def _prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def _template(row: dict, other: dict) -> list[int] | None:
    """The lines of ``row`` that ``other`` has too, but those of a declared article in either; None if the two share the larger part of either's text, as copies do."""
    pairs = aligned(row["hashes"], other["hashes"])
    size = sum(row["sizes"][k] for k, _ in pairs)
    if 2 * size > min(sum(row["sizes"]), sum(other["sizes"])):
        return None
    return [k for k, j in pairs if KEPT not in (row["verdicts"][k], other["verdicts"][j])]


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The template of each outline that has one, from its neighbours in the order of host and path. Guests from other tasks are neighbours only."""

    def decide(row, before, after):
        near = [o for o in (before, after) if o and o["host"] == row["host"] and row["host"]]
        near.sort(key=lambda o: -_prefix(row["path"], o["path"]))
        for other in near:
            found = _template(row, other)
            if found is not None:
                return found
        return []

    def every():
        window: list[dict] = []
        for batch in batches:
            for r in batch.to_pylist():
                if window and r["task"] != window[-1]["task"]:
                    if not window[-1]["guest"]:
                        yield window[-1], window[-2] if len(window) > 1 else None, None
                    window = []
                window.append(r)
                if len(window) > 1 and not window[-2]["guest"]:
                    yield window[-2], window[-3] if len(window) > 2 else None, r
                del window[:-2]
        if window and not window[-1]["guest"]:
            yield window[-1], window[-2] if len(window) > 1 else None, None

    held: list[tuple] = []

    def batch():
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), (pa.string(), pa.binary(), pa.list_(pa.int32())))], names=["host", "outline", "template"])
        held.clear()
        return made

    for row, before, after in every():
        if template := decide(row, before, after):
            held.append((row["host"], row["outline"], template))
            if len(held) >= 2000:
                yield batch()
    if held:
        yield batch()


def templates(outlined: DataFrame) -> DataFrame:
    """(host, outline, template): places, among all lines of a page, of those that its nearest neighbour has too; pages without any have no row.

    Pages of one host with equal outlines are one row. Rows are sorted by ranges of host and
    path, which cut a hot host into many tasks; the last outline before a task's
    range and the first one after it are added as guests, so that neighbours are
    the same however the rows are dealt.
    """
    one = outlined.groupBy("host", "outline").agg(F.min("path").alias("path"), F.first("hashes").alias("hashes"), F.first("sizes").alias("sizes"), F.first("verdicts").alias("verdicts"))
    dealt = one.repartitionByRange("host", "path", "outline").sortWithinPartitions("host", "path", "outline")
    dealt = storage.materialise(dealt.withColumn("task", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "outlines")
    edges = dealt.groupBy("task").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    # one row a task: a window over them is bounded by the number of tasks
    order = Window.orderBy("task")
    edges = edges.select(F.lag("task").over(order).alias("before"), F.lead("task").over(order).alias("after"), "first", "last")
    guests = F.broadcast(edges.select(F.explode(F.array(F.struct(F.col("first").alias("at"), F.col("before").alias("_to")), F.struct(F.col("last").alias("at"), F.col("after").alias("_to")))).alias("_g")).select("_g.*").where("_to is not null"))
    added = dealt.join(guests, "at").withColumn("task", F.col("_to")).drop("_to").withColumn("guest", F.lit(True))
    rows = dealt.withColumn("guest", F.lit(False)).unionByName(added).repartition("task").sortWithinPartitions("task", "at")
    return rows.mapInArrow(_differences, "host string, outline binary, template array<int>")


def extract(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """The columns of ``pages`` but the page, and ``text``: the main text of each, lines joined by a line feed.

    A null, empty or contentless page has an empty text. A null URL is on no host
    and so has no neighbours; its open lines stay. A page that is alone on its host, or
    whose neighbours are all copies of it, keeps its open lines. Repeated rows
    have equal texts, an input column called text is replaced, and an empty table
    gives an empty one.

    Pages are parsed twice, once for their outlines and once for their lines, so that
    the lines, compressed, are written to disk only by the join with the templates.
    The join's other side has one row for an outline, so that a hot outline can be split.
    """
    kept = [c for c in pages.columns if c not in (page, "text")]
    source = pages.select(F.struct(*[F.col(c) for c in kept]).alias("_row"), F.col(url).alias("_url"), F.col(page).alias("_page"))
    row = source.schema["_row"]
    outlined, lined, texts = T._parse_datatype_string(_OUTLINED), T.StructType([row, *T._parse_datatype_string(_LINED).fields]), T.StructType([row, T.StructField("text", T.StringType())])

    def mapped(df: DataFrame, step, schema: T.StructType) -> DataFrame:
        arrow = to_arrow_schema(schema)
        return df.mapInArrow(lambda batches: step(batches, arrow), schema)

    found = templates(mapped(source.select("_url", "_page"), _outlines, outlined))
    joined = mapped(source, _lined, lined).join(found, ["host", "outline"], "left").select("_row", "verdicts", "lines", "template")
    return mapped(joined, _without, texts).select("_row.*", "text")
