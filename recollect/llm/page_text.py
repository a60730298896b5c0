"""Main text of web pages: page structure first, then differencing against the nearest URL."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recollect.llm.common import measured_side
from recollect.llm.url_filter import url_parts
from recollect.operators.ordering import with_index
from recollect.operators.skew import lookup_join
from recollect.operators.staging import scope, stage

# A template line is on this many different pages of a host, or on both of a host that has two, and
# on this part of the pages that carry the page's commonest line: articles are copied a few times.
TEMPLATE_PAGES = 3
TEMPLATE_SHARE = 0.25
# A line inside marked articles is a template line if this part of the host's articles carries it:
# it is inside what the page calls its text, so it has to be of the site and not of a few articles.
ARTICLE_SHARE = 0.5
# Bits of the table of an alignment that are kept at a time.
TABLE_BITS = 1 << 26
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|svg|textarea|iframe|object|math|canvas)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attributes>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|</?[a-zA-Z!?][^>]*>",
    re.S | re.I,
)
# One attribute; a value is consumed with its name, so nothing is sought inside it.
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)))?")
_PART = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
# Elements of HTML that never hold the article.
_DROPPED = frozenset("head nav footer aside form menu dialog select button fieldset audio video map datalist".split())
_BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead "
    "title tr ul".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_TITLE = frozenset(["h1"])
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
# Words of class and id names that mark what surrounds an article.
_MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist "
    "consent cookie cookies copyright disclaimer disqus footer gdpr login masthead menu modal nav navbar navigation newsletter "
    "notice notification pager pagination popup promo promotion promoted recommended related replies reply responses share "
    "sharing sidebar signup social sponsor sponsored subscribe subscription topbar toolbar widget widgets".split()
)
# Marks that may as well be what an article is about: alone they count only where no other name stands beside them.
_TOPICS = frozenset(
    "banner comment cookie cookies copyright disclaimer login menu notice notification promotion related reply responses "
    "share sharing social subscription widget".split()
)
# Words that say where an element lies or how it looks, not what it holds; a name of these and marks is a mark.
_FRAME = frozenset(
    "ajax area article bar blog block body bottom box btn button buttons center col column container content css desktop entry "
    "fixed global google grid group header heading icon icons inline inner item items js large left link links list main message "
    "middle mobile outer overlay page pane panel post posts primary reader right row secondary section site slot small sticky "
    "story text title top unit user wp wrap wrapper zone".split()
)
# Words after which a class or id says that something is missing there or lies next to it.
_LAYOUT = frozenset("has have no non not with without hide exclude".split())
_MAIN, _ARTICLE, _OPEN, _NONE = 3, 2, 1, 0
_BY_STRUCTURE, _BY_NAME = 2, 1


def _attributes(text: str) -> dict[str, str]:
    """Attributes of a tag by lower-cased name; of repeated ones the first, as in HTML."""
    found: dict[str, str] = {}
    for name, double, single, bare in _ATTRIBUTE.findall(text) if text else ():
        value = double or single or bare
        found.setdefault(name.lower(), html.unescape(value) if "&" in value else value)
    return found


def _words(name: str) -> list[str]:
    return [word for word in _PART.findall(_CAMEL.sub(" ", name).lower()) if len(word) > 1]


def _named(value: str) -> bool:
    """True if a class or id has a name that is a mark as a whole.

    Such a name has a mark and else only frame words. If it is a single word of _TOPICS, all names
    beside it have to be marks and frame words too: "recipe cookie" isn't marked, nor is "share-price".
    """
    names = [words for name in value.split() if (words := _words(name))]
    framed = [all(word in _MARKS or word in _FRAME for word in words) for words in names]
    return any(
        frame and not _MARKS.isdisjoint(words) and (all(framed) or len(words) > 1 or words[0] not in _TOPICS)
        for words, frame in zip(names, framed)
    )


def _holds_title(attributes: dict[str, str]) -> bool:
    """True if the only marks of a class and id are those of what may stand around a title."""
    words = {word for key in ("class", "id") for word in _words(attributes.get(key, ""))}
    return words & _MARKS <= {"banner", "masthead"}


def _marked(name: str, attributes: dict[str, str]) -> int:
    """_BY_STRUCTURE if name, role or style of an element, _BY_NAME if only its class or id, say that
    it isn't part of an article; else _NONE.
    """
    if name in _DROPPED:
        return _BY_STRUCTURE
    if name in ("html", "body", "main", "article") or not attributes:
        return _NONE
    if "hidden" in attributes or attributes.get("role", "").strip().lower() in _ROLES:
        return _BY_STRUCTURE
    if attributes.get("aria-hidden", "").strip().lower() == "true":
        return _BY_STRUCTURE
    if "display:none" in "".join(attributes.get("style", "").split()).lower():
        return _BY_STRUCTURE
    return _BY_NAME if any(_named(attributes.get(key, "")) for key in ("class", "id")) else _NONE


def blocks(page: str) -> list[tuple[int, str]]:
    """(kind, text) of every block outside marked elements, in page order.

    A block ends at every block-level tag; white space in it is one space, references are decoded.
    Kind is _ARTICLE inside ``article``, ``main`` or a main role, and _OPEN elsewhere; beside a
    ``main`` with text, other articles are teasers and _OPEN. A header is marked, but inside an
    article its headings count, and so does the h1 of a banner. Unclosed elements end with the one
    around.

    Where articles lie only inside elements that class or id mark, those elements are no longer
    marked; where one lies outside, such an element holds teasers or comments and stays marked. An
    element inside the article isn't marked by class or id either, if without it only headings remain.
    """
    unmarked: frozenset[int] = frozenset()
    found, holders, held, body = _walk(page, unmarked)
    if holders and not any(kind >= _ARTICLE for kind, _ in found):
        unmarked |= holders
        found, _, held, body = _walk(page, unmarked)
    while held and not body and any(kind >= _ARTICLE for kind, _ in found):
        unmarked |= {max(held, key=lambda place: (held[place], -place))}
        found, _, held, body = _walk(page, unmarked)
    if any(kind == _MAIN for kind, _ in found):
        found = [(_ARTICLE if kind == _MAIN else _OPEN, text) for kind, text in found]
    return found


def _walk(page: str, unmarked: frozenset[int]) -> tuple[list[tuple[int, str]], frozenset[int], dict[int, int], bool]:
    """Blocks as above but for _MAIN, and what decides which elements class and id mark.

    That is: where the elements begin that class or id mark and that hold an article; where those
    begin that they mark inside an article, with the characters of text in each; and whether an
    article has text besides headings. Elements that begin at a place in ``unmarked`` aren't marked
    by class or id.
    """
    found: list[tuple[int, str]] = []
    parts: list[str] = []
    holders: set[int] = set()
    held: dict[int, int] = {}
    body = False
    # (name, marked, kind, headings that count though marked, place if marked by class or id, else -1)
    # of every open element that matters.
    stack: list[tuple[str, bool, int, frozenset[str], int]] = [("", False, _OPEN, frozenset(), -1)]

    def flush() -> None:
        nonlocal body
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            found.append((stack[-1][2], text))
            body = body or stack[-1][2] >= _ARTICLE and not any(x[0] in _HEADINGS for x in stack)

    def close(depth: int) -> None:
        del stack[depth:]

    position = 0
    for tag in _TAG.finditer(page):
        name = (tag["name"] or "").lower()
        if tag.start() > position:
            if not stack[-1][1]:
                parts.append(html.unescape(page[position:tag.start()]))
            elif stack[-1][2] >= _ARTICLE and not body:
                place = next(x[4] for x in stack if x[1])
                if place >= 0:
                    held[place] = held.get(place, 0) + len(page[position:tag.start()].split())
        position = tag.end()
        if not name:
            continue
        is_block = name in _BLOCKS
        if name == "br":
            parts.append(" ")
        elif tag["close"]:
            depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == name), 0)
            if is_block:
                flush()
            if depth:
                close(depth)
        else:
            if is_block:
                flush()
                # A paragraph, item or cell that was left open ends where the next one begins.
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == "p" or stack[k][0] == name and name in ("li", "tr", "td", "th", "dt", "dd", "option"):
                        close(k)
                        break
                    if stack[k][0] in ("div", "section", "article", "main", "ul", "ol", "table", "aside", "nav", "td", "li"):
                        break
            if name in _VOID or tag["attributes"].endswith("/") and not is_block:
                continue
            _, marked, kind, header, _ = stack[-1]
            attributes = _attributes(tag["attributes"])
            how = _marked(name, attributes)
            by_name = how == _BY_NAME
            own = how == _BY_STRUCTURE or by_name and tag.start() not in unmarked
            if name in ("article", "main") or attributes.get("role", "").strip().lower() == "main":
                kind = kind if name == "article" and kind == _MAIN else _ARTICLE if name == "article" else _MAIN
                holders.update(x[4] for x in stack if x[4] >= 0)
                if by_name:
                    holders.add(tag.start())
            if name == "header":
                header = _HEADINGS if kind >= _ARTICLE and not marked and (not by_name or _holds_title(attributes)) else frozenset()
                marked = True
            elif own:
                header = _TITLE if by_name and kind >= _ARTICLE and not marked and _holds_title(attributes) else frozenset()
            elif name in header:
                marked = False
            if is_block or own or any(x[0] == name for x in stack[1:]):
                stack.append((name, marked or own, kind, header, tag.start() if by_name else -1))
    if not stack[-1][1]:
        parts.append(html.unescape(page[position:]))
    flush()
    return found, frozenset(holders), {place: words for place, words in held.items() if words}, body


def shared_lines(mine: Sequence[int], other: Sequence[int]) -> set[int]:
    """Places in ``mine`` of one longest common subsequence with ``other``.

    Equal ends belong to one in any case. Between them, a row of the table of lengths is one integer
    with a bit per line of ``other``, and a line of ``mine`` is a few operations on it. Rows are kept
    while they fit TABLE_BITS; a larger table is halved (Hirschberg): lengths from the front and from
    the back say where the halves of ``mine`` part in ``other``, so memory is linear at any size.
    """
    found: set[int] = set()
    todo = [(0, len(mine), 0, len(other))]
    while todo:
        low, high, start, stop = todo.pop()
        while low < high and start < stop and mine[low] == other[start]:
            found.add(low)
            low, start = low + 1, start + 1
        while low < high and start < stop and mine[high - 1] == other[stop - 1]:
            high, stop = high - 1, stop - 1
            found.add(high)
        if low == high or start == stop:
            continue
        if (high - low) * (stop - start) <= TABLE_BITS or high - low == 1:
            found.update(low + k for k in _traced(mine[low:high], other[start:stop]))
            continue
        middle = (low + high) // 2
        front = _lengths(mine[low:middle], other[start:stop])
        back = _lengths(mine[middle:high][::-1], other[start:stop][::-1])[::-1]
        cut = start + int(np.argmax(front + back))
        todo += [(low, middle, start, cut), (middle, high, cut, stop)]
    return found


def _rows(mine: Sequence[int], other: Sequence[int]) -> Iterator[int]:
    """For each line of ``mine`` the row of the table: bit j is 0 where the length grows at other[j]."""
    places: dict[int, int] = {}
    for j, line in enumerate(other):
        places[line] = places.get(line, 0) | 1 << j
    full = (1 << len(other)) - 1
    row = full
    for line in mine:
        hit = row & places.get(line, 0)
        row = (row + hit | row - hit) & full
        yield row


def _traced(mine: Sequence[int], other: Sequence[int]) -> set[int]:
    """Places in ``mine`` of a longest common subsequence, by walking the kept rows back."""
    rows = list(_rows(mine, other))
    found: set[int] = set()
    i, j = len(mine), len(other)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
        elif i > 1 and not rows[i - 2] >> (j - 1) & 1:
            i -= 1
        else:
            i, j = i - 1, j - 1
            found.add(i)
    return found


def _lengths(mine: Sequence[int], other: Sequence[int]) -> np.ndarray:
    """Length of the longest common subsequence of ``mine`` with each beginning of ``other``."""
    row = (1 << len(other)) - 1
    for row in _rows(mine, other):
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes(-(-len(other) // 8), "little"), np.uint8), bitorder="little")
    return np.append(0, np.cumsum(1 - bits[: len(other)].astype(np.int64)))


def _is_article(found: list[tuple[int, str]]) -> bool:
    """True if the page marks its article; the text is then the article's blocks."""
    return any(kind == _ARTICLE for kind, _ in found)


def _lines(found: list[tuple[int, str]]) -> list[str]:
    """Texts of the blocks that differencing aligns: all outside marked elements, in articles or not."""
    return [text for _, text in found]


def _codes(lines: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(line) for line in lines], np.uint64).view(np.int64)


def open_lines(pages: DataFrame) -> DataFrame:
    """page_id, url, the hashed lines of pages that have any, whether the page marks its ``article``,
    and ``digest`` of both.
    """
    schema = "page_id long, url string, lines array<long>, article boolean, digest binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [blocks(page.as_py() or "") for page in batch.column(2)]
            coded = [_codes(_lines(x)) for x in found]
            article = [_is_article(x) for x in found]
            has = pa.array([len(x) > 0 for x in coded], pa.bool_())
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(coded, pa.list_(pa.int64())), pa.array(article, pa.bool_()),
                pa.array([xxhash.xxh3_128_digest(x.tobytes() + bytes([y])) for x, y in zip(coded, article)], pa.binary()),
            ], names=["page_id", "url", "lines", "article", "digest"]).filter(has)

    return pages.select("page_id", "url", "html").mapInArrow(run, schema)


def _aligned(classes: DataFrame) -> DataFrame:
    """host, digest, article, ``line`` and ``few`` for every line that a class shares with a neighbour.

    Classes are ordered by host, path, URL and id over the whole table (ranges, so a hot host is cut
    over many tasks). Lines are aligned with both neighbours of the same host by longest common
    subsequence. ``few`` marks hosts of two classes.
    """
    ordered = stage(with_index(classes, ["host", "path", "url", "page_id", "digest"], name="place"), "page-order")
    both = ordered
    for side, step in (("before", -1), ("behind", 1)):
        moved = ordered.select(
            (F.col("place") - step).alias("place"), F.struct(F.col("host").alias("near_host"), F.col("lines").alias("near")).alias(side)
        )
        both = both.join(moved, "place", "left")
    for side, step in (("before2", -2), ("behind2", 2)):
        both = both.join(ordered.select((F.col("place") - step).alias("place"), F.col("host").alias(side)), "place", "left")

    schema = "host string, digest binary, article boolean, few boolean, line long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, digests, article, few, lines = [], [], [], [], []
            for row in batch.to_pylist():
                host, mine = row["host"], row["lines"]
                sides = [s["near"] for s in (row["before"], row["behind"]) if s and s["near_host"] == host]
                found = {mine[k] for near in sides for k in shared_lines(mine, near)}
                hosts += [host] * len(found)
                digests += [row["digest"]] * len(found)
                article += [row["article"]] * len(found)
                few += [len(sides) == 1 and host not in (row["before2"], row["behind2"])] * len(found)
                lines += sorted(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts, pa.string()), pa.array(digests, pa.binary()), pa.array(article, pa.bool_()),
                 pa.array(few, pa.bool_()), pa.array(lines, pa.int64())],
                names=["host", "digest", "article", "few", "line"],
            )

    return both.select("host", "digest", "article", "lines", "before", "behind", "before2", "behind2").mapInArrow(run, schema)


def template_lines(lines: DataFrame) -> DataFrame:
    """page_id and ``shared``: the hashed lines that differencing deletes from the page.

    Pages of a host with equal lines are one class, so neighbours are the nearest different pages.
    A line shared with one is deleted if enough different pages of the host carry it. From a page
    without a marked article: TEMPLATE_PAGES (both, on a host of two) and TEMPLATE_SHARE of the pages
    with the commonest line shared. So a template goes however much of the page it is, and lines that
    an article shares with a few copies stay. From a page that marks its article: TEMPLATE_PAGES and
    ARTICLE_SHARE of all different pages of the host that mark one. All counts are grouped sums over
    the whole table.
    """
    parts = url_parts(F.col("url"))
    placed = lines.withColumns({name: parts[name] for name in ("host", "path")})
    classes = stage(
        placed.groupBy("host", "digest").agg(
            F.min(F.struct("path", "url", "page_id")).alias("first"), F.first("lines").alias("lines"), F.first("article").alias("article")
        ).select("host", "digest", "first.*", "lines", "article"), "page-classes",
    )
    aligned = stage(_aligned(classes), "aligned-lines")
    marked = F.sum(F.col("article").cast("long"))
    carried = classes.select("host", "article", F.explode(F.array_distinct("lines")).alias("line")).groupBy("host", "line").agg(
        F.count(F.lit(1)).alias("pages"), marked.alias("articles")
    ).where("pages > 1")
    counted = lookup_join(aligned, stage(carried, "carried-lines"), ["host", "line"], "inner", spread=["digest"])
    hosts = stage(classes.groupBy("host").agg(marked.alias("of_host")), "hosts")
    counted = lookup_join(counted, hosts, ["host"], "inner", spread=["digest", "line"], count_in=aligned)
    site = (F.col("articles") >= TEMPLATE_PAGES) & (F.col("articles") >= ARTICLE_SHARE * F.col("of_host"))
    enough = lambda x, top: F.when(F.col("article"), x["site"]).otherwise(
        (F.col("few") | (x["pages"] >= TEMPLATE_PAGES)) & (x["pages"] >= TEMPLATE_SHARE * F.col(top))
    )
    deleted = counted.groupBy("host", "digest", "article", "few").agg(
        F.collect_list(F.struct("line", "pages", site.alias("site"))).alias("found"), F.max("pages").alias("top")
    ).select("host", "digest", F.transform(F.filter("found", lambda x: enough(x, "top")), lambda x: x["line"]).alias("shared"))
    deleted = stage(deleted.where(F.size("shared") > 0), "deleted-lines")
    return lookup_join(placed.select("page_id", "host", "digest"), deleted, ["host", "digest"], "inner", spread=["page_id"]).select(
        "page_id", "shared"
    )


def extract(pages: DataFrame) -> DataFrame:
    """Per row: page_id, url, text, n_chars (code points); null html counts as empty.

    Blocks inside marked elements (menus, headers, footers, sidebars, notices, adverts, forms,
    scripts, comments) are left out. Where a page marks its article, the text is the article's
    blocks; otherwise all other blocks are open. From either, differencing deletes the lines that
    the page shares with its nearest different page of the same host and that enough different
    pages of the host carry (``template_lines``). Rows that share an id (null is one) lose
    the shared lines of any of them.
    """
    with scope() as keep:
        shared = keep(template_lines(stage(open_lines(pages), "open-lines")), "template-lines")
    merged = shared.groupBy(F.col("page_id").alias("of")).agg(F.flatten(F.collect_list("shared")).alias("shared"))
    if measured_side(shared, 8 * F.size("shared") + 32) is not None:
        merged = F.broadcast(merged)
    marked = pages.select("page_id", "url", "html").join(merged, F.col("page_id").eqNullSafe(F.col("of")), "left")
    schema = T.StructType([
        *marked.select("page_id", "url").schema.fields, T.StructField("text", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for page, gone in zip(batch.column(2), batch.column(3).to_pylist()):
                found = blocks(page.as_py() or "")
                kept = [text for kind, text in found if kind == _ARTICLE] if _is_article(found) else _lines(found)
                if gone:
                    gone = set(gone)
                    kept = [text for text, code in zip(kept, _codes(kept).tolist()) if code not in gone]
                texts.append("\n\n".join(kept))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return marked.select("page_id", "url", "html", "shared").mapInArrow(run, schema)
