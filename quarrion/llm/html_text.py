"""Main text of HTML pages by nearest-URL page differencing.

Pages of a host stand in order of their URL path, and each is paired with the neighbour whose path begins most like
its own. Text lines (blocks) of the two pages are aligned by longest common subsequence; shared lines are template and are
deleted, unless an <article> or <main> element holds them: there repeated sentences belong to the text. Two pages
that share most of their text are copies, and say nothing about their template: the other neighbour is asked then.

Differencing cannot see furniture that differs from page to page (rotating adverts, menus of the day). Where markup
says what it is, it is left out beforehand: by elements (menus, forms, scripts), or by class, id and role.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .neighbours import bucket_of, cuts, dealt, ends, partitions_for

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<close2>/?)(?P<name2>[a-zA-Z][a-zA-Z0-9:-]*+)[^>]*>",
    re.S,
)
_ATTR = re.compile(r"""([a-zA-Z_:][-a-zA-Z0-9_:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")

# Elements of HTML by what they mean for the text.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
NEVER = {"head", "nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "template", "svg", "canvas", "object", "audio", "video", "noscript", "map", "fieldset"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "summary", "table",
    "tbody", "tfoot", "thead", "tr", "ul",
}
#: Elements whose begin and end are followed; others may be left open.
CONTAINERS = {"article", "main", "section", "div", "header", "ul", "ol", "dl", "table", "figure", "details", "blockquote", "body", "html"} | NEVER
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Names in class, id or role that mark what isn't main text.
_SIDE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|cookies?|consent|notices?|popup|modal|overlay|newsletter|subscri\w*|sidebar|menu|nav|navbar|navigation|breadcrumbs?|"
    r"footer|comments?|commentlist|disqus|respond|reply|replies|share|sharing|social|related|recommend\w*|pagination|pager|widget|login|search|contentinfo|complementary|dialog|alert)(?:$|[\s_-])",
    re.I,
)
#: Names that mark the top of a page; inside <article> and <main> they mark the head of the text, which has its title.
_TOP = re.compile(r"(?:^|[\s_-])(?:header|masthead|banner)(?:$|[\s_-])", re.I)
#: Pages that share more of their text than this are copies of each other.
COPY_SHARE = 0.5


def _is_side(name: str, attrs: str, inside: bool) -> bool:
    """Whether attributes mark an element as no main text; inside: of an <article> or <main>."""
    if not attrs or name in ("html", "body", "article", "main") or re.fullmatch("h[1-6]", name):
        return False
    found = {k.lower(): v.strip("\"'") for k, v in _ATTR.findall(attrs)}
    if "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", ""):
        return True
    return any(_SIDE.search(found[k]) or (not inside and _TOP.search(found[k])) for k in ("class", "id", "role") if k in found)


def lines(html: str) -> list[tuple[str, bool]]:
    """Text blocks of a page in order, with whether an <article> or <main> element holds each."""
    out: list[tuple[str, bool]] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # element, whether it hides its text, whether it is main content
    hidden, main = 0, 0
    aside = False  # in a block of its own (a paragraph, an item) that isn't main text
    at = 0

    def text(piece: str) -> None:
        if piece and not hidden and not aside:
            parts.append(unescape(piece) if "&" in piece else piece)

    def end_block() -> None:
        if parts:
            if block := " ".join("".join(parts).split()):
                out.append((block, main > 0))
            parts.clear()

    while m := _TAG.search(html, at):
        text(html[at : m.start()])
        at = m.end()
        name = m["name"] or m["name2"]
        if not name:
            if html.startswith("<![CDATA[", m.start()):
                text(html[m.start() + 9 : at - 3])
            continue
        name = name.lower()
        closing = bool(m["close"] or m["close2"])
        attrs = m["attrs"] or ""
        if name in RAW and not closing:
            if not attrs.endswith("/"):
                tail = re.compile(f"</{name}(?=[\\s/>])[^>]*>", re.I).search(html, at)
                at = tail.end() if tail else len(html)
            continue
        if name in BLOCKS or name in NEVER:
            end_block()
            aside = not closing and name not in CONTAINERS and name not in VOID and _is_side(name, attrs, main > 0)
        elif name in ("br", "td", "th", "img"):
            text(" ")
        if name in VOID or name not in CONTAINERS:
            continue
        if not closing:
            if attrs.endswith("/"):
                continue
            hides = name in NEVER or _is_side(name, attrs, main > 0) or (name == "header" and not main)
            holds = name in ("article", "main") and not hides and not hidden
            stack.append((name, hides, holds))
            hidden += hides
            main += holds
        elif any(x[0] == name for x in stack):
            while True:
                popped, hides, holds = stack.pop()
                hidden -= hides
                main -= holds
                if popped == name:
                    break
    text(html[at:])
    end_block()
    return out


def _row(places: dict[str, int], a: list[str], m: int) -> int:
    """The last row of the LCS table of a and m lines, as bits: column j adds one to the length where bit j is 0."""
    full = (1 << m) - 1
    v = full
    for x in a:
        if u := v & places.get(x, 0):
            v = ((v + u) | (v - u)) & full
    return v


def _places(b: list[str]) -> dict[str, int]:
    at: dict[str, list[int]] = {}
    for j, x in enumerate(b):
        at.setdefault(x, []).append(j)
    out = {}
    for x, js in at.items():
        bits = bytearray((js[-1] >> 3) + 1)
        for j in js:
            bits[j >> 3] |= 1 << (j & 7)
        out[x] = int.from_bytes(bits, "little")
    return out


def _lengths(v: int, m: int) -> np.ndarray:
    """LCS lengths with the first 0, 1, ..., m lines."""
    bits = np.unpackbits(np.frombuffer(v.to_bytes((m >> 3) + 1, "little"), np.uint8), bitorder="little")[:m]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def common(a: list[str], b: list[str]) -> list[int]:
    """Places in a of a longest common subsequence of a and b.

    Bit-parallel rows halve a, and each half goes with the part of b that suits it best, so that memory grows
    with the number of lines and not with its square. Lines that only one side has can't matter and go first.
    """
    known_a, known_b = set(a), set(b)
    keep = [i for i, x in enumerate(a) if x in known_b]
    a, b = [a[i] for i in keep], [x for x in b if x in known_a]
    out: list[int] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        lo, hi, first, last = todo.pop()
        while lo < hi and first < last and a[lo] == b[first]:
            out.append(keep[lo])
            lo, first = lo + 1, first + 1
        while lo < hi and first < last and a[hi - 1] == b[last - 1]:
            hi, last = hi - 1, last - 1
            out.append(keep[hi])
        if lo >= hi or first >= last:
            continue
        if hi - lo == 1:
            if a[lo] in b[first:last]:
                out.append(keep[lo])
            continue
        half, m = (lo + hi) // 2, last - first
        piece = b[first:last]
        front = _lengths(_row(_places(piece), a[lo:half], m), m)
        piece.reverse()
        back = _lengths(_row(_places(piece), a[half:hi][::-1], m), m)[::-1]
        cut = first + int(np.argmax(front + back))
        todo += [(lo, half, first, cut), (half, hi, cut, last)]
    return sorted(out)


def differ(page: list[tuple[str, bool]], others: list[list[tuple[str, bool]]]) -> tuple[list[str], int]:
    """(lines left, lines deleted as template) of a page beside the first of others that is no copy of it."""
    size = sum(len(x) for x, _ in page)
    for other in others:
        shared = common([x for x, _ in page], [x for x, _ in other])
        if sum(len(page[i][0]) for i in shared) <= COPY_SHARE * size:
            gone = {i for i in shared if not page[i][1]}
            return [x for i, (x, _) in enumerate(page) if i not in gone], len(gone)
    return [x for x, _ in page], 0


def _prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars, n_deleted): the main text of each page, its blocks joined by line feeds.

    Null and empty pages have an empty text. Pages without a URL are paired with none. Rows that repeat are pages
    of their own. Pages at equal distance from both neighbours are paired with the one before; a page whose
    two neighbours are copies of it loses nothing. Alignment takes memory in proportion to a page's lines. Other
    columns, whatever their names, are left behind.
    """
    spark = pages.sparkSession
    partitions = partitions_for(spark)
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", "")
    # the id makes keys of repeated URLs differ, so that they needn't share a task
    key = F.concat_ws("\x01", host, path, F.format_string("%020d", F.coalesce(F.col(id_col).cast("long"), F.lit(0))))
    given = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"), host.alias("host"), path.alias("path"), key.alias("key"))
    keys = pages.select(key.alias("key"))
    bounds = cuts(keys, "key", 8 * partitions)
    spans = ends(keys, "key", bucket_of(F.col("key"), bounds, "string"))
    to: dict[str, list[int]] = {}
    for (b, _, hi), (c, lo, _) in zip(spans, spans[1:], strict=False):
        if hi.split("\x01")[0] == lo.split("\x01")[0]:
            to.setdefault(hi, []).append(c)
            to.setdefault(lo, []).append(b)
    rows = dealt(given, "key", "string", bounds, to, partitions).sortWithinPartitions("bucket", "key", "copy", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stream():
            for batch in batches:
                columns = {c: batch.column(batch.schema.get_field_index(c)) for c in ("page_id", "url", "html", "host", "path", "bucket", "copy")}
                for i in range(batch.num_rows):
                    r = {k: v[i].as_py() for k, v in columns.items()}
                    r["lines"] = lines(r.pop("html"))
                    yield r

        def near(r, other):
            return other is not None and other["bucket"] == r["bucket"] and other["host"] == r["host"] != "" and r["url"] is not None

        def done(before, r, after):
            close = sorted((o for o in (before, after) if near(r, o)), key=lambda o: -_prefix(r["path"], o["path"]))
            kept, deleted = differ(r["lines"], [o["lines"] for o in close])
            text = "\n".join(kept)
            out.append((r["page_id"], r["url"], text, len(text), deleted))

        def flush():
            kinds = [("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64()), ("n_deleted", pa.int64())]
            got = pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*out, strict=True), kinds, strict=True)], [n for n, _ in kinds])
            out.clear()
            return got

        out: list[tuple] = []
        before = held = None
        for r in stream():
            if held is not None and not held["copy"]:
                done(before, held, r)
            before, held = held, r
            if len(out) >= 256:
                yield flush()
        if held is not None and not held["copy"]:
            done(before, held, None)
        if out:
            yield flush()

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long, n_deleted long")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
