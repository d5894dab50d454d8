"""Main text of web pages: structure first, nearest-URL differencing for the rest.

A page is cut into blocks. What stands in an element that names itself as page
furniture is left out; what stands in a main element (article, main and the
like) is the article. The blocks of a page without a main element are open: the
page is paired with the page of its host whose URL path shares the longest
beginning with its own, the lines of the two are aligned by their longest common
subsequence, and shared lines go.

Differencing decides open blocks only. By itself it would delete what articles
share with their neighbours and keep menus and adverts that differ from page to
page; ``structure=False`` runs it so, and README has the figures.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.llm.common import bounded_batches, columns_only, join_per_key, stored
from kinweave.llm.url_filter import host_of, path_of

#: Elements whose content isn't text.
RAW = ("script", "style", "noscript", "template", "iframe", "svg", "canvas", "object", "textarea", "title")
#: Elements that are furniture by name.
FURNITURE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "head", "fieldset"}
#: Elements that a new paragraph or list item ends, if their own end tag is missing.
INLINE = {"b", "i", "em", "strong", "a", "span", "u", "font", "small", "p", "li"}
#: Words in class, id or role by which an element says that it is furniture.
_REMARK = r"comments?|replies|disqus|respond"
_ADVERT = r"ads?|ads?(?:bygoogle|sense|box|slot|unit|wrap|wrapper|container|banner|block|space|frame)|advert\w*|sponsor\w*|promo\w*"
_NOTICE = r"banner|cookies?|consent|notices?|alert|newsletter|subscribe"
_MARK = (
    rf"(?:{_REMARK}|{_ADVERT}|{_NOTICE}|related|recommended|nav|navbar|navigation|menu|breadcrumbs?|sidebar|side|complementary|"
    r"footer|contentinfo|header|masthead|popup|modal|overlay|signup|login|"
    r"search|share|sharing|social|pagination|pager|toolbar|widget)"
)
#: What may stand beside them in a token of several parts. Others tell of a state, as in ``comments-open`` or ``no-sidebar``.
_BESIDE = (
    r"(?:site|page|main|global|top|bottom|left|right|inner|outer|primary|secondary|sticky|list|box|bar|area|wrap|wrapper|container|section|"
    r"links?|items?|block|slot|unit|form|thread|icons?|buttons?|panel|posts?|articles?|stor(?:y|ies)|content|users?|readers?|visitors?|google|\d+(?:x\d+)?)"
)
MARKS = re.compile(rf"(?:{_BESIDE}[_-]+)*{_MARK}(?:[_-]+(?:{_MARK}|{_BESIDE}))*")
COMMENTS = re.compile(rf"(?:{_BESIDE}[_-]+)*(?:{_REMARK})(?:[_-]+(?:{_MARK}|{_BESIDE}))*")
#: Whole tokens that count on a main element too.
OWN = re.compile(rf"{_REMARK}|{_ADVERT}|related|recommended")
#: What counts on a paragraph, which is no menu or sidebar whatever its class.
ON_TEXT = re.compile(rf"(?:{_BESIDE}[_-]+)*(?:{_REMARK}|{_ADVERT}|{_NOTICE})(?:[_-]+(?:{_REMARK}|{_ADVERT}|{_NOTICE}|{_BESIDE}))*")
MAIN = {"article", "main"}
#: Tokens of an article element that only hints at another page, unless it holds most of this one's text.
TEASER = re.compile(r"(?:[a-z0-9]+[_-]+)*(?:teaser|card|preview|excerpt)(?:[_-]+[a-z0-9]+)*")
#: Inline styles by which an element isn't shown.
UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b")
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
# Attributes end at the first > outside quotes; where a quote is never closed, at the first > of all.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>"
    rf"|<(?P<raw>{'|'.join(RAW)})\b(?P<raw_attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*(?=>)|[^<>]*)>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*(?=>)|[^<>]*)>"
    r"|(?P<text>[^<]+|<)",
    re.IGNORECASE | re.DOTALL,
)
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?|"[^"]*"|'[^']*'""")
NONE, FURNISHED, COMMENTED = 0, 1, 2
#: How sure an element is of being the page's main one.
OPEN, HINT, SURE = 0, 1, 2


def _kind(name: str, attrs: str) -> tuple[int, int]:
    """What an element's tag says: furniture or comments, and whether it is a main element."""
    found: dict[str, str] = {}
    for key, value in _ATTR.findall(attrs) if attrs else ():
        found.setdefault(key.lower(), value.strip("\"'").lower())
    words = [w for k in ("class", "id", "role") for w in found.get(k, "").split()]
    main = name in MAIN or found.get("role") == "main" or found.get("itemprop") == "articlebody"
    if main:
        main = HINT if name == "article" and any(TEASER.fullmatch(w) for w in words) else SURE
    else:
        main = OPEN
    if name in ("html", "body"):
        return NONE, main  # the whole page can't be furniture
    if main:
        words = [w for w in words if OWN.fullmatch(w)]
    if name == "p":
        words = [w for w in words if ON_TEXT.fullmatch(w)]
    if any(COMMENTS.fullmatch(w) for w in words):
        return COMMENTED, OPEN
    unseen = "hidden" in found or found.get("aria-hidden") == "true" or UNSEEN.search(found.get("style", ""))
    if name in FURNITURE or unseen or any(MARKS.fullmatch(w) for w in words):
        return FURNISHED, OPEN
    return NONE, main


def blocks(page: str | None, structure: bool = True) -> tuple[list[str], bool]:
    """The page's text blocks and whether they are its main elements' (else they are open).
    Without ``structure`` elements say nothing: all text is open."""
    out: list[tuple[str, int]] = []
    stack: list[tuple[str, int, int]] = []  # name, what it or an element around it is, how sure of a main element around it
    text: list[str] = []
    main = OPEN

    def end_block() -> None:
        line = " ".join(html.unescape("".join(text)).split())
        if line:
            out.append((line, main))
        text.clear()

    for token in _TOKEN.finditer(page or ""):
        kind, main = (stack[-1][1], stack[-1][2]) if stack else (NONE, OPEN)
        if (plain := token["text"]) is not None:
            if kind == NONE:
                text.append(plain)
            continue
        name = (token["name"] or "").lower()
        if not name:
            continue
        if name == "br" or name in ("td", "th"):
            text.append(" ")
        if name in BLOCKS:
            end_block()
        if token["close"]:
            for at in range(len(stack) - 1, -1, -1):
                if stack[at][0] == name:
                    # Ends what is open inside; but an inline or paragraph end doesn't end a section around it.
                    if name in BLOCKS or all(s[0] not in BLOCKS for s in stack[at + 1 :]):
                        del stack[at:]
                    break
            continue
        if name in VOID or (token["attrs"] or "").rstrip().endswith("/"):
            continue
        if name in ("p", "li"):
            at = len(stack)
            while at and stack[at - 1][0] in INLINE and stack[at - 1][0] != name:
                at -= 1
            if at and stack[at - 1][0] == name:
                del stack[at - 1 :]
            kind, main = (stack[-1][1], stack[-1][2]) if stack else (NONE, OPEN)
        own, is_main = _kind(name, token["attrs"]) if structure else (NONE, OPEN)
        if is_main == SURE and kind == FURNISHED:
            kind, main = NONE, OPEN  # an article inside an advert or menu means that its end tag is missing
        stack.append((name, max(kind, own), max(main, is_main)))
    main = stack[-1][2] if stack else OPEN
    end_block()
    size = [0, 0, 0]
    for line, m in out:
        size[m] += len(line)
    if size[SURE] or size[HINT] > size[OPEN]:
        return [line for line, m in out if m == (SURE if size[SURE] else HINT)], True
    return [line for line, _ in out], False


#: Bits of the table of one alignment; a larger one is halved.
CELLS = 1 << 26


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Places in ``a`` of a longest common subsequence with ``b``.

    By bit rows; what the two begin and end with alike, and lines that one of
    them doesn't have, are settled before. Beyond CELLS the longer alignment is
    cut where two halves of ``a`` do best, so memory follows the number of lines.
    """
    first, most = 0, min(len(a), len(b))
    while first < most and a[first] == b[first]:
        first += 1
    last = 0
    while last < most - first and a[-1 - last] == b[-1 - last]:
        last += 1
    in_a, in_b = set(a[first : len(a) - last]), set(b[first : len(b) - last])
    places = [i for i in range(first, len(a) - last) if a[i] in in_b]
    middle = _align_rows([a[i] for i in places], [x for x in b[first : len(b) - last] if x in in_a])
    return [*range(first), *(places[i] for i in middle), *range(len(a) - last, len(a))]


def _masks(b: list[int]) -> dict[int, int]:
    at: dict[int, list[int]] = {}
    for j, x in enumerate(b):
        at.setdefault(x, []).append(j)
    out = {}
    for x, places in at.items():
        bits = bytearray(len(b) // 8 + 1)
        for j in places:
            bits[j >> 3] |= 1 << (j & 7)
        out[x] = int.from_bytes(bits, "little")
    return out


def _rows(a: list[int], b: list[int]) -> Iterator[int]:
    """After each line of ``a``: the bits of ``b`` that are off are where the alignment grows."""
    masks, full = _masks(b), (1 << len(b)) - 1
    v = full
    yield v
    for x in a:
        u = v & masks.get(x, 0)
        v = ((v + u) | (v - u)) & full
        yield v


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """The longest alignment of ``a`` with each beginning of ``b``."""
    for v in _rows(a, b):
        pass
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def _align_rows(a: list[int], b: list[int]) -> list[int]:
    if not a or not b:
        return []
    if len(a) > 1 and len(a) * len(b) > CELLS:
        half = len(a) // 2
        cut = int((_lengths(a[:half], b) + _lengths(a[half:][::-1], b[::-1])[::-1]).argmax())
        return _align_rows(a[:half], b[:cut]) + [half + i for i in _align_rows(a[half:], b[cut:])]
    rows = list(_rows(a, b))
    i, j, out = len(a), len(b), []
    while i and j:
        bit = 1 << (j - 1)
        if rows[i] & bit:
            j -= 1
        elif not rows[i - 1] & bit:
            i -= 1
        else:
            out.append(i - 1)
            i, j = i - 1, j - 1
    return out[::-1]


def _hash(line: str) -> int:
    return xxhash.xxh3_64_intdigest(line) - (1 << 63)


def _parse(structure: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [blocks(t, structure) for t in part.column("_html").to_pylist()]
                open_ = [None if m else lines for lines, m in found]
                hosts = part.column("_host").to_pylist()
                keys = [None if x is None else hashlib.sha256("\n".join([h, *x]).encode()).digest() for h, x in zip(hosts, open_, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        *[part.column(c) for c in ("_id", "_url", "_host", "_path")],
                        pa.array([lines for lines, _ in found], pa.list_(pa.string())),
                        pa.array(keys, pa.binary()),
                        pa.array([None if x is None else [_hash(line) for line in x] for x in open_], pa.list_(pa.int64())),
                    ],
                    ["_id", "_url", "_host", "_path", "lines", "list_key", "marks"],
                )

    return run


def beginning(a: str, b: str) -> int:
    """How many characters two paths begin with alike."""
    n, most = 0, min(len(a), len(b))
    while n < most and a[n] == b[n]:
        n += 1
    return n


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left = []
        for path, own, *near in zip(*(batch.column(c).to_pylist() for c in ("_path", "marks", "up", "down")), strict=True):
            # Of pages equally near the one before in the order of paths counts.
            near = [x for x in near if x is not None]
            best = max(near, key=lambda x: beginning(path, x["_path"]), default=None)
            shared = set(common_lines(own, best["marks"])) if best else ()
            left.append([i for i in range(len(own)) if i not in shared] if shared else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("list_key"), batch.column("copies"), pa.array(left, pa.list_(pa.int32()))], ["list_key", "copies", "left"]
        )


def own_lines(open_pages: DataFrame) -> DataFrame:
    """``list_key, copies, left``: places of the lines that a list doesn't share with its nearest neighbour's; null if all.

    Lists that several pages of a host have are taken once, so copies don't
    delete each other. All lists are put in order of host and path over the
    whole cluster; a host of any size is spread over many ordered partitions.
    The first and last list of each are lent to the partitions beside it: a
    table of one row per partition, of digests only, says which, and a join
    with it finds the lists. The page that shares the longest beginning of its
    path stands next to a page in that order.
    """
    once = open_pages.groupBy("list_key").agg(
        F.min("_host").alias("_host"), F.min("_path").alias("_path"), F.any_value("marks").alias("marks"), F.count(F.lit(1)).alias("copies")
    )
    order = ["_host", "_path", "list_key"]
    ordered = once.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered = stored(ordered.withColumn("part", F.spark_partition_id()), "ordered")
    key = F.struct(*order)
    ends = ordered.groupBy("part").agg(F.min_by("list_key", key).alias("first"), F.max_by("list_key", key).alias("last"))
    over = Window.orderBy("part")  # one row per partition of the table
    ends = ends.select("part", F.lag("last").over(over).alias("before"), F.lead("first").over(over).alias("after"))
    wanted = ends.select(F.col("part").alias("to"), F.explode(F.array("before", "after")).alias("list_key"))
    lent = ordered.join(F.broadcast(wanted), "list_key").withColumn("part", F.col("to")).drop("to")
    whole = ordered.withColumn("own", F.lit(True)).unionByName(lent.withColumn("own", F.lit(False)))
    slot = F.struct("_host", "_path", "marks")
    w = Window.partitionBy("part").orderBy(*order)
    placed = whole.select("*", F.lag(slot).over(w).alias("up"), F.lead(slot).over(w).alias("down")).filter("own")
    here = lambda side: F.when(F.col(f"{side}._host") == F.col("_host"), F.struct(f"{side}._path", f"{side}.marks")).alias(side)
    return placed.select("list_key", "_path", "marks", "copies", here("up"), here("down")).mapInArrow(
        _align, "list_key binary, copies bigint, left array<int>"
    )


def extract_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", structure: bool = True
) -> DataFrame:
    """``id, url, text, n_chars`` for every row.

    A null or empty page has an empty text. Character references are decoded,
    white space in a block is one space, blocks are joined by a line break in
    page order; long pages are read whole, once. Repeated rows are extracted each. A
    page without a main element that has no neighbour on its host keeps all its
    open blocks, as does a page whose URL has no host. Without ``structure``
    all pages are open and only differencing decides. Extra columns aren't
    read; an empty table gives an empty result.
    """
    url = F.col(url_col)
    rows = bounded_batches(columns_only(pages, id_col, url_col, html_col)).select(
        F.col(id_col).alias("_id"), url.alias("_url"), F.col(html_col).alias("_html"), host_of(url).alias("_host"), path_of(url).alias("_path")
    )
    schema = f"_id {dict(rows.dtypes)['_id']}, _url string, _host string, _path string, lines array<string>, list_key binary, marks array<bigint>"
    cut = stored(rows.mapInArrow(_parse(structure), schema), "page-blocks")
    out = cut.filter("list_key is null").select("_id", "_url", "lines")
    open_ = cut.filter("list_key is not null")
    n = open_.count()
    if n:
        named = open_.filter("_host <> '' and size(marks) > 0")
        masks = own_lines(named.select("_host", "_path", "list_key", "marks")).filter("left is not null")
        joined = join_per_key(open_.select("_id", "_url", "lines", "list_key"), stored(masks, "masks"), "list_key", "copies", n)
        left = F.coalesce(F.transform("left", lambda i: F.get("lines", i)), F.col("lines"))
        out = out.unionByName(joined.select("_id", "_url", left.alias("lines")))
    text = F.array_join("lines", "\n")
    return out.select(F.col("_id").alias(id_col), F.col("_url").alias(url_col), text.alias("text")).withColumn(
        "n_chars", F.length("text").cast("bigint")
    )
