"""Main text of web pages by nearest-URL page differencing.

Pages are read into lines, one a block, each with its zone: inside an article,
outside one, or inside a part that its markup names as not of the article (a
menu, footer, sidebar, form, advert, comment list and the like).  Within a host
pages stand in the order of their URL's path; each is paired with the one
before it (the first with the one after it), their lines are aligned by longest
common subsequence, and shared lines are deleted as template.

Differencing alone can't give right results: articles quote the same passages,
and a site's menus and adverts may differ from page to page.  So lines inside an
article element (or, without one, the main element) are never deleted for being shared, and lines whose markup names
them go even if no neighbour shares them.  All other lines, on pages with an
article too, stay unless they are shared.

The lines are shuffled once, by host.  Hosts that hold more than one page in
``HOT_SHARE`` (so there are at most that many) and more than ``GROUP`` pages are
cut into ranges of about that size in the order of pages.  The page that ends a
range is shipped to the next one too, so each page keeps its nearest page
whatever the ranges are.  Pages without any line are nobody's nearest page.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import ship, text_bytes

HOT_SHARE, GROUP, SAMPLED = 1000, 512, 8  # SAMPLED: pages looked at for each cut of a host

# Element and class names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe object svg math select canvas audio video noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
SCOPES = frozenset("article aside body div footer form header html main nav section table td th".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
DROPPED_ELEMENTS = frozenset("nav aside footer form menu dialog button head".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert dialog".split())
DROPPED_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar menu nav navbar navigation "
    "breadcrumb breadcrumbs masthead footer comment comments commentlist disqus reply replies respond cookie cookies consent gdpr notice notices "
    "alert popup modal overlay newsletter subscribe signup login share sharing social related recommended widget skip".split()
)
NAME_OF_HEADER = frozenset(["header"])
IN_HEAD = frozenset("base link meta title style script noscript template".split())

NAME_END, TAG_PART = re.compile(r"[\s/>]"), re.compile(r"[>\"']")
#: A whole tag without another angle bracket in it, as nearly all are; it never looks past the next one.
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>\"'<]*+)((?:[^>\"'<]|\"[^\"<]*+\"|'[^'<]*+')*+)>")
ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORD = re.compile(r"[a-z0-9]+")

ARTICLE, OUTSIDE, DROPPED, MAIN = 0, 1, 2, 3


def _names(attributes: str) -> tuple[set[str], str]:
    """The words of class and id, and the role."""
    words, role = set(), ""
    for m in ATTRIBUTE.finditer(attributes):
        value = m[2] or m[3] or m[4] or ""
        if m[1].lower() == "role":
            role = value.strip().lower()
        else:
            words.update(WORD.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value).lower()))
    return words, role


def tags(html: str) -> Iterator[tuple[int, int, bool, str | None, str]]:
    """(start, end, whether it closes, name, attributes) of a page's markup in order; comments and declarations have no name.

    An angle bracket that begins no whole tag is text, as is one in whose tag a
    quote isn't closed.  Linear for any page: what is looked for ahead is
    remembered until it is passed, and so is each quote after which no tag ends.
    """
    size, pos = len(html), 0
    name_end = part = ends = -1
    hopeless: set[int] = set()

    def ahead(pattern: re.Pattern, at: int) -> int:
        m = pattern.search(html, at)
        return m.start() if m else size

    while (start := html.find("<", pos)) >= 0:
        if m := PLAIN_TAG.match(html, start):
            pos = m.end()
            yield start, pos, bool(m[1]), m[2], m[3]
            continue
        pos = start + 1
        first = html[pos : pos + 1]
        if html.startswith("<!--", start):
            end = html.find("-->", start + 4)
            pos = size if end < 0 else end + 3
            yield start, pos, False, None, ""
            continue
        if first in ("!", "?"):
            if ends < pos:
                ends = html.find(">", pos)
                ends = size if ends < 0 else ends
            if ends < size:
                pos = ends + 1
                yield start, pos, False, None, ""
            continue
        begin = pos + (first == "/")
        letter = html[begin : begin + 1]
        if not (letter.isascii() and letter.isalpha()):
            continue
        if name_end < begin:
            name_end = ahead(NAME_END, begin)
        if part < name_end:
            part = ahead(TAG_PART, name_end)
        at, quotes = part, []
        while at < size and html[at] != ">" and at not in hopeless:
            quotes.append(at)
            closed = html.find(html[at], at + 1)
            at = size if closed < 0 else ahead(TAG_PART, closed + 1)
        if at == size or html[at] != ">":
            hopeless.update(quotes)
            continue
        pos = at + 1
        yield start, pos, begin > start + 1, html[begin:name_end], html[name_end:at]


def page_lines(html: str) -> list[tuple[str, int]]:
    """(line, zone) of a page's blocks, in order.  Never fails, whatever the markup.

    An element outside an article that is dropped for its class or id only is a
    wrapper: it is kept if all the page's article elements with text (without
    one, its main elements) are in wrappers, and one of the least nested is in it.
    """
    lines: list[tuple[str, int, int]] = []  # text, zone, innermost wrapper
    parts: list[str] = []
    wrappers: list[tuple[int, int, int]] = [(-1, 0, OUTSIDE)]  # wrapper around, depth, zone around; the first is none
    stack: list[tuple[str, int, int | None, int]] = [("", OUTSIDE, None, 0)]  # name, zone, the zone around the article's header that it is in, wrapper

    opened: Counter[str] = Counter()  # elements of the stack by name

    def flush() -> None:
        text = " ".join(unescape("".join(parts)).split())
        parts.clear()
        if text:
            lines.append((text, stack[-1][1], stack[-1][3]))

    def close(k: int) -> None:
        if any(e[0] in BLOCK for e in stack[k:]) or stack[-1][1::2] != stack[k - 1][1::2]:
            flush()
        opened.subtract(e[0] for e in stack[k:])
        del stack[k:]

    pos, lower = 0, None
    for start, end, closes, tag, attributes in tags(html):
        if start < pos:  # inside what a script or the like holds
            continue
        if start > pos:
            parts.append(html[pos:start])
        pos = end
        if tag is None:
            continue
        name = tag.lower()
        if closes:
            if opened[name] <= 0 and name != "p":
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    close(k)
                    break
                if stack[k][0] in SCOPES and name not in SCOPES:
                    if name == "p":
                        flush()
                    break
            continue
        if stack[-1][0] == "head" and name not in IN_HEAD:  # its end tag may be left out
            close(len(stack) - 1)
        if name == "br":
            parts.append("\n")
            continue
        if name in RAW:
            if not attributes.endswith("/"):
                lower = html.lower() if lower is None else lower
                end = lower.find(f"</{name}", pos) if len(lower) == len(html) else html.find(f"</{tag}", pos)
                close_at = html.find(">", end) if end >= 0 else -1
                pos = close_at + 1 if close_at >= 0 else len(html)
            continue
        if name in BLOCK:
            for k in range(len(stack) - 1, 0, -1):  # a new block ends an open paragraph, and a list item the one before
                if stack[k][0] == "p" or stack[k][0] == name and name in ("li", "dt", "dd", "tr", "td", "th", "option"):
                    close(k)
                    break
                if stack[k][0] in SCOPES or stack[k][0] in ("ul", "ol", "dl"):
                    break
            flush()
        if name in VOID or attributes.endswith("/"):
            continue
        _, zone, held, wrapper = stack[-1]
        words, role = _names(attributes) if attributes else (set(), "")
        if held is not None:  # of an article: only its headings are text of the article
            zone = held if zone == held or name in HEADINGS else DROPPED
        elif zone != DROPPED and name not in ("html", "body"):
            inside = zone in (ARTICLE, MAIN)
            named = words & DROPPED_NAMES and name not in ("article", "main") or words & {"comment", "comments"}
            if name in DROPPED_ELEMENTS or role in DROPPED_ROLES or named and (zone == ARTICLE or name in ("article", "main")) or not inside and name == "header":
                zone = DROPPED
            elif named or not inside and words & NAME_OF_HEADER and name not in ("article", "main"):
                wrappers.append((wrapper, wrappers[wrapper][1] + 1, zone))
                wrapper = len(wrappers) - 1
                if role == "article":
                    zone = ARTICLE
                elif not inside and role == "main":
                    zone = MAIN
            elif not inside and words & NAME_OF_HEADER:
                zone = DROPPED
            elif name == "article" or role == "article":
                zone = ARTICLE
            elif not inside and (name == "main" or role == "main"):
                zone = MAIN
            elif inside and name == "header":
                zone, held = DROPPED, zone
        if (zone, wrapper) != stack[-1][1::2]:
            flush()
        stack.append((name, zone, held, wrapper))
        opened[name] += 1
    parts.append(html[pos:])
    flush()
    kept = {0}
    for own in (ARTICLE, MAIN):
        # A wrapper inside the main element doesn't contain it.
        around = {w for _, zone, w in lines if zone == own and (w == 0 or own == ARTICLE or wrappers[w][2] != MAIN)}
        if around:
            least = min(wrappers[w][1] for w in around)
            for w in around:
                while w not in kept and wrappers[w][1] <= least:
                    kept.add(w)
                    w = wrappers[w][0]
            if own == ARTICLE and any(zone == MAIN and w in kept and wrappers[w][1] < least for _, zone, w in lines):
                # The main element has text of its own around the wrapper: the article counts as a part of it.
                lines = [(text, MAIN if zone == ARTICLE else zone, w) for text, zone, w in lines]
            break
    return [(text, zone if w in kept else DROPPED) for text, zone, w in lines]


def _vectors(a: list, places: dict, size: int) -> Iterator[int]:
    """Bit vectors of the LCS of ever longer beginnings of ``a`` with b; a zero at j: there the length grows."""
    full = (1 << size) - 1
    v = full
    for x in a:
        u = v & places.get(x, 0)
        v = ((v + u) | (v - u)) & full
        yield v


def _places(b: list) -> dict:
    places: dict = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    return places


def shared_lines(a: list, b: list, limit_bits: int = 1 << 27) -> set[int]:
    """Indexes into ``a`` of a longest common subsequence with ``b``.

    Bit-parallel; the vectors of all rows are kept up to ``limit_bits``, and
    larger cases are halved first, so memory stays bounded for any length.
    """
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    got = set(range(head)) | set(range(len(a) - tail, len(a)))
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if not a or not b:
        return got
    if len(a) == 1:
        return got | ({head} if a[0] in b else set())
    if len(a) * len(b) > limit_bits:
        half = len(a) // 2
        for v in _vectors(a[:half], _places(b), len(b)):
            pass
        for w in _vectors(a[half:][::-1], _places(b[::-1]), len(b)):
            pass
        best = suffix = len(b) - w.bit_count()
        cut = prefix = 0
        for j in range(len(b)):
            prefix += not v >> j & 1
            suffix -= not w >> len(b) - 1 - j & 1
            if prefix + suffix > best:
                best, cut = prefix + suffix, j + 1
        left, right = shared_lines(a[:half], b[:cut], limit_bits), shared_lines(a[half:], b[cut:], limit_bits)
        return got | {head + k for k in left} | {head + half + k for k in right}
    rows, j = list(_vectors(a, _places(b), len(b))), len(b) - 1
    i = len(a) - 1
    while i >= 0 and j >= 0:  # a row's zero that isn't in the row before is a line that this row matched
        if rows[i] >> j & 1:
            j -= 1
        elif i > 0 and not rows[i - 1] >> j & 1:
            i -= 1
        else:
            got.add(head + i)
            i, j = i - 1, j - 1
    return got


def main_text(lines: list[tuple[str, int]], neighbour: list[str] | None) -> str:
    """The main text of a page, given its lines and those of its nearest page.

    A page without a neighbour has only its own zone's lines: nothing tells the others from template.
    """
    zones = {zone for _, zone in lines}
    own = next((zone for zone in (ARTICLE, MAIN) if zone in zones), None)
    if not neighbour:
        return "\n".join(text for text, zone in lines if zone == (OUTSIDE if own is None else own))
    if zones <= {own, DROPPED}:  # differencing has nothing to decide
        shared = set()
    else:
        shared = shared_lines([text for text, _ in lines], neighbour)
    return "\n".join(text for k, (text, zone) in enumerate(lines) if zone == own or zone != DROPPED and k not in shared)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: id, url, ``text`` (empty if none) and ``n_chars`` (its code points).

    Null html: empty text.  Null or odd URLs: a host of their own (the empty
    one).  Repeated rows, null ids: a row each; ties in the path are ordered by
    url, id and the page itself, so the result doesn't depend on partitions.
    Empty table: no row.  Other columns aren't read.  A task holds two pages.
    """
    ship(pages.sparkSession)
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    rest = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^?#]*)", 1)
    host, path = F.lower(F.substring_index(rest, "/", 1)), F.regexp_extract(rest, r"^[^/]*/(.*)$", 1)

    counts = pages.select(host.alias("host")).groupBy("host").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    size = F.greatest(F.col("total") / HOT_SHARE, F.lit(GROUP))
    hot = counts.join(F.broadcast(total)).where(F.col("n") > size).select("host", F.ceil(size).alias("size"))

    out_id = pages.schema[id_col]
    parsed = T.StructType([T.StructField("texts", T.ArrayType(T.StringType())), T.StructField("zones", T.ArrayType(T.IntegerType()))])

    @F.pandas_udf(parsed)
    def read(column):
        import pandas as pd

        rows = []
        for data in column:
            lines = page_lines(data.decode("utf-8", "replace"))
            rows.append(([t for t, _ in lines], [z for _, z in lines]))
        return pd.DataFrame(rows, columns=["texts", "zones"])

    data = text_bytes(html_col)
    keyed = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), host.alias("host"), path.alias("path"), data.alias("data"), F.xxhash64(data).alias("mark"))
    key = F.struct("path", "url", "id", "mark")
    # Cuts are pages of a sample, every so many in order; only pages with lines, so that a range begins after one.
    # At most HOT_SHARE hosts hold more than one page in HOT_SHARE, with about that many cuts in all: that bounds what is broadcast.
    looked_at = F.pmod(F.xxhash64("path", "url", "id", "mark"), "size") < SAMPLED
    read_late = read(F.when(looked_at, F.col("data")).otherwise(F.lit(b"")))  # naming ``size`` keeps it from moving before the join
    sample = keyed.join(F.broadcast(hot), "host").where(looked_at).where(F.size(read_late["texts"]) > 0)
    every = lambda k, i: i % SAMPLED == SAMPLED - 1
    cuts = sample.groupBy("host").agg(F.sort_array(F.collect_list(key)).alias("keys")).select("host", F.array_distinct(F.filter("keys", every)).alias("cuts"))

    # The number of cuts before a page, by halving.
    steps = F.array(*[F.lit(1 << k) for k in range(10, -1, -1)])
    part = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get("cuts", at + step - 1) < F.col("key"), at + step).otherwise(at))
    own, next_too = F.struct(F.col("part"), F.lit(False).alias("ended")), F.struct((F.col("part") + 1).alias("part"), F.lit(True).alias("ended"))
    lines = (
        keyed.select("id", "url", "host", "path", "mark", read("data").alias("p"))
        .join(F.broadcast(cuts), "host", "left")
        .withColumn("key", key)
        .withColumn("part", part)
        .withColumn("copies", F.when(F.get("cuts", F.col("part")).eqNullSafe(F.col("key")), F.array(own, next_too)).otherwise(F.array(own)))
        .select("host", F.explode("copies").alias("c"), "path", "url", "id", "mark", "p")
        .select("host", "c.part", "path", "url", "id", "p.texts", "p.zones", "c.ended", "mark")
    )
    order = ["host", "part", "path", "url", "id", "mark", "texts"]
    dealt = lines.repartition("host", "part").sortWithinPartitions(*order)
    out = T.StructType([T.StructField(id_col, out_id.dataType), T.StructField(url_col, T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        before = None  # the page that waits: group, id, url, lines, texts of its neighbour, whether it ended the range before
        for batch in batches:
            groups = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            ids, texts_out, pending_ids, pending_urls = batch.column(4), [], [], []

            def put(page, neighbour):
                if not page[5]:
                    pending_ids.append(page[1])
                    pending_urls.append(page[2])
                    texts_out.append(main_text(page[3], neighbour))

            for k in range(batch.num_rows):
                lines = list(zip(batch.column(5)[k].as_py(), batch.column(6)[k].as_py()))
                now = [groups[k], ids.slice(k, 1), batch.column(3)[k].as_py(), lines, None, batch.column(7)[k].as_py()]
                if not lines:
                    put(now, None)
                    continue
                if before is not None:
                    same = before[0] == now[0]
                    if same:
                        now[4] = [t for t, _ in before[3]]
                    put(before, before[4] or ([t for t, _ in lines] if same else None))
                before = now
            if texts_out:
                yield _rows(pending_ids, pending_urls, texts_out, id_col, url_col)
        if before is not None and not before[5]:
            yield _rows([before[1]], [before[2]], [main_text(before[3], before[4])], id_col, url_col)

    return dealt.mapInArrow(run, out)


def _rows(ids: list, urls: list, texts: list[str], id_col: str, url_col: str) -> pa.RecordBatch:
    arrays = [pa.concat_arrays(ids), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())]
    return pa.RecordBatch.from_arrays(arrays, [id_col, url_col, "text", "n_chars"])
