"""Main text of web pages: the marked article, or all unmarked lines; undecided lines go where the nearest page of the host has them too."""

from __future__ import annotations

import bisect
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.ranks import global_rank
from docloom.llm.scratch import Scratch

#: Share of its characters that a page has in common with a page that counts as its copy, not as another page of the same layout.
COPY = 0.9
#: Distinct page contents with shared lines that may be broadcast (some 50 bytes each); longer lists are joined by shuffle.
BROADCAST_ROWS = 200_000

# Elements that are never main text, and words in class, id or role that say the same.
_HIDDEN = frozenset("head nav header footer aside form button select dialog noscript iframe svg canvas video audio object menu fieldset datalist".split())
_SIDE = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead footer sidebar aside ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social comment comments respond reply replies discussion disqus "
    "related recommended recommendations pagination pager widget toolbar skip search form complementary contentinfo".split()
)
#: Words of article elements that hold what readers say, or point to other articles: these mark no article.
_OTHERS = frozenset("comment comments related recommended recommendations".split())
#: Words that only say where or how something stands, in names of several words.
_PLAIN = frozenset("article post posts entry story page site main top bottom left right inner outer inline box block bar button buttons list item items slot unit area section container wrapper wrap group link links icon icons count in".split())
_RAW = frozenset("script style textarea title template xmp noembed noframes".split())
_BLOCKS = frozenset(
    "html body p div section article main h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption hr address details summary center".split()
) | _HIDDEN
_VOID = frozenset("br hr img input meta link area base col embed param source track wbr".split())
_CLOSED_BY = {"p": _BLOCKS - {"html", "body"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}
_SCOPE = frozenset("ul ol dl table article section div main body html blockquote".split())
_HEAD = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_STOP = re.compile("[>\"']")
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in _RAW}
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_SPLIT = re.compile(r"[^a-z0-9]+")

ARTICLE, OTHER, SIDE = 0, 1, 2


def _is_side(tag: str, attrs: str, in_article: bool) -> bool:
    """Whether an element is marked as no main text.

    In an article a name counts by all of its words (share-bar; form-factor is no form), and its own header holds its
    title, so that is not marked; elsewhere one of its words will do (cookie-law). An article element is marked by the
    words of _OTHERS only (comment-12, related-post), wherever it stands: a post may well be a notice or an advert.
    """
    if tag in ("html", "body", "main") or not attrs:
        return False
    named = [x for groups in _NAMES.findall(attrs) for x in "".join(groups).lower().split()]
    if in_article or tag == "article":
        words = [{w for w in _SPLIT.split(x) if w and not w.isdigit()} for x in named]
        marks = _OTHERS if tag == "article" else _SIDE - {"header"}
        return any(w & marks and w <= _SIDE | _PLAIN for w in words)
    return any(not _SIDE.isdisjoint(_SPLIT.split(x)) for x in named)


def _is_doubtful(attrs: str) -> bool:
    """Whether a name of an element in an article holds a word of _SIDE beside words of its own (share-this, form-factor): zones can't tell what it is."""
    named = [x for groups in _NAMES.findall(attrs) for x in "".join(groups).lower().split()] if attrs else []
    return any(not (_SIDE - {"header"}).isdisjoint(_SPLIT.split(x)) for x in named)


def tags(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """Where markup begins and ends, whether it closes an element, the element's lower-case name and its attributes; comments and raw elements have no name.

    The page is read once, forward. A tag ends at the first > outside quotes; a quote that nothing closes before the
    page's last > is a character like others, so whatever looks like a tag ends there at the latest, and behind
    that > nothing is a tag. An unclosed comment or raw element runs to the page's end.
    """
    last = page.rfind(">")
    quotes = {q: page.rfind(q, 0, max(last, 0)) for q in "\"'"}
    at = page.find("<")
    while at >= 0:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = end + 3 if end >= 0 else len(page)
            yield at, end, False, "", ""
        elif at >= last:
            return
        elif page.startswith(("<!", "<?"), at):
            end = page.index(">", at) + 1
            yield at, end, False, "", ""
        elif (m := _HEAD.match(page, at)) is None:
            end = at + 1
        else:
            where = m.end()
            while page[(stop := _STOP.search(page, where)).start()] != ">":
                where = stop.end()
                if quotes[stop[0]] >= where:
                    where = page.index(stop[0], where) + 1
            end, name = stop.end(), m[2].lower()
            if name in _RAW and not m[1]:
                close = _RAW_END[name].search(page, end)
                end = close.end() if close else len(page)
                yield at, end, False, "", ""
            else:
                yield at, end, bool(m[1]), name, page[m.end() : stop.start()]
        at = page.find("<", end)


def blocks(page: str | None) -> list[tuple[str, int]]:
    """Text and zone of each block, in page order: in the article, elsewhere, or marked as no main text."""
    return [(text, zone) for text, zone, _ in zoned(page)]


def zoned(page: str | None) -> list[tuple[str, int, bool]]:
    """Text and zone of each block, in page order, and whether it stands in a doubtful element of an article."""
    page = page or ""
    out: list[tuple[str, int, bool]] = []
    parts: list[str] = []
    stack: list[tuple[str, int, bool]] = []  # open elements with the zone inside, and whether that is in doubt
    places: dict[str, list[int]] = {}  # of the open elements by name, in the stack
    scopes: list[int] = []  # places of those that nothing inside can close from outside
    zone, doubt, at = OTHER, False, 0

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append((text, zone, doubt))
            parts.clear()

    def close(k: int) -> None:
        nonlocal zone, doubt
        flush()
        for name, _, _ in stack[k:]:
            places[name].pop()
        del stack[k:]
        while scopes and scopes[-1] >= k:
            scopes.pop()
        zone, doubt = stack[-1][1:] if stack else (OTHER, False)

    for start, end, closing, tag, attrs in tags(page):
        if start > at:
            parts.append(page[at:start])
        at = end
        if not tag:
            continue
        if tag == "br":
            parts.append(" ")
        elif closing:
            if places.get(tag):
                close(places[tag][-1])
            elif tag in _BLOCKS:
                flush()
        else:
            block = tag in _BLOCKS
            if block:
                flush()
            ends = max((places[x][-1] for x, by in _CLOSED_BY.items() if tag in by and places.get(x)), default=-1)
            if ends >= 0 and ends > (scopes[-1] if scopes else -1):  # the innermost element that this one closes
                close(ends)
            if tag in _VOID or attrs.rstrip().endswith("/"):
                continue
            in_article = zone == ARTICLE
            side = (tag in _HIDDEN and not (tag == "header" and in_article)) or _is_side(tag, attrs, in_article)
            unsure = block and in_article and not side and _is_doubtful(attrs)
            if block or side:
                if side and not block:
                    flush()
                inside = SIDE if zone == SIDE or side else ARTICLE if in_article or tag in ("article", "main") else OTHER
                places.setdefault(tag, []).append(len(stack))
                if tag in _SCOPE:
                    scopes.append(len(stack))
                zone, doubt = inside, (doubt or unsure) and inside == ARTICLE
                stack.append((tag, zone, doubt))
    if at < len(page):
        parts.append(page[at:])
    flush()
    return out


def common_lines(a: list, b: list) -> list[bool]:
    """Which lines of a lie on a longest common subsequence of a and b (Hunt and Szymanski's thresholds between equal ends)."""
    least, low, high = min(len(a), len(b)), 0, 0
    while low < least and a[low] == b[low]:
        low += 1
    while high < least - low and a[-1 - high] == b[-1 - high]:
        high += 1
    if low or high:
        return [True] * low + common_lines(a[low : len(a) - high], b[low : len(b) - high]) + [True] * high
    places: dict = {}
    for j, line in enumerate(b):
        places.setdefault(line, []).append(j)
    ends: list[int] = []  # ends[n]: smallest place in b where a common subsequence of n + 1 lines can end
    chain: list[tuple] = []
    for i, line in enumerate(a):
        for j in reversed(places.get(line, ())):
            n = bisect.bisect_left(ends, j)
            node = (i, chain[n - 1] if n else None)
            if n == len(ends):
                ends.append(j)
                chain.append(node)
            else:
                ends[n] = j
                chain[n] = node
    shared, node = [False] * len(a), chain[-1] if chain else None
    while node:
        shared[node[0]] = True
        node = node[1]
    return shared


def main_lines(page: list[tuple[str, int, bool]]) -> tuple[list[str], bool, list[bool]]:
    """The lines that may be main text, whether they are those of a marked article, and which of them its zones leave undecided (all, without one)."""
    article = [(x, d) for x, z, d in page if z == ARTICLE]
    if article:
        return [x for x, _ in article], True, [d for _, d in article]
    other = [x for x, z, _ in page if z == OTHER]
    return other, False, [True] * len(other)


def shared_lines(a: list, b: list, sizes: list[int], open_: list[bool]) -> list[int]:
    """Places of the undecided (``open_``) lines of a (or of their hashes; ``sizes`` are their lengths) that go, as the nearest page b has them too.

    The lines on the longest common subsequence are those of the layout. Of an unmarked page all of them go, of a
    marked article those in doubtful elements: what the rest of two articles has in common are sentences, at
    their ends too (the README has the figures). Nothing goes out of a copy.
    """
    shared = common_lines(a, b)
    if sum(n for n, s in zip(sizes, shared, strict=True) if s) >= COPY * sum(sizes):
        return []
    return [i for i, (s, o) in enumerate(zip(shared, open_, strict=True)) if s and o]


def _parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, host, path, key (digest of the lines, null without any), undecided (whether any line is), hashes and sizes of the lines, which are open, packed (the lines as a zstd frame)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                hosts, paths, keys, marks, hashes, sizes, opens, packed = [], [], [], [], [], [], [], []
                for url, page in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    m = re.match(r"(?:[a-z][a-z0-9+.-]*:)?//([^/?#]*)([^?#]*)", url or "", re.IGNORECASE)
                    hosts.append(m[1].lower() if m else "")
                    paths.append(m[2] if m else url or "")
                    lines, marked, undecided = main_lines(zoned(page))
                    raw = "\n".join(lines).encode("utf-8", "surrogatepass")  # a line holds no line break
                    keys.append(xxhash.xxh3_128_digest(raw + bytes([marked]) + (bytes(undecided) if marked and any(undecided) else b"")) if lines else None)
                    marks.append(any(undecided))
                    hashes.append([xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) - (1 << 63) for x in lines])
                    sizes.append([len(x) for x in lines])
                    opens.append(undecided)
                    packed.append(pack(raw))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(keys, pa.binary()), pa.array(marks, pa.bool_()), pa.array(hashes, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int32())), pa.array(opens, pa.list_(pa.bool_())), pa.array(packed, pa.binary())],
                    names=["page_id", "url", "host", "path", "key", "undecided", "hashes", "sizes", "open", "packed"],
                )

    return pages.mapInArrow(run, "page_id long, url string, host string, path string, key binary, undecided boolean, hashes array<long>, sizes array<int>, open array<boolean>, packed binary")


def _opened(packed: list[bytes]) -> Iterator[list[str]]:
    import zstandard

    open_ = zstandard.ZstdDecompressor().decompress
    for x in packed:
        text = open_(x).decode("utf-8", "surrogatepass")
        yield text.split("\n") if text else []


def _nearness(path: Column, other: Column) -> Column:
    """Leading path segments in common."""
    same = F.zip_with(F.split(path, "/"), F.split(other, "/"), lambda x, y: F.coalesce(x == y, F.lit(False)))
    apart = F.array_position(same, F.lit(False))
    return F.when(apart > 0, apart - 1).otherwise(F.size(same))


def nearest_contents(parsed: DataFrame, scratch: Scratch) -> DataFrame:
    """host, key, partner: for each distinct content of a host, the content of its nearest page by URL path.

    A content stands at the first of its pages' paths. Of the two that stand next to it in the order of paths,
    the one with more leading path segments in common is nearer; of equal ones, the one before.
    """
    contents = parsed.where("host <> '' and key is not null").groupBy("host", "key").agg(F.min("path").alias("path"))
    ranked = scratch.save(global_rank(contents, [F.col("host"), F.col("path"), F.col("key")], scratch))
    side = lambda name, step: ranked.select((F.col("rank") + step).alias("rank"), F.col("host").alias(f"{name}_host"), F.col("path").alias(f"{name}_path"), F.col("key").alias(f"{name}_key"))
    near = ranked.join(side("before", 1), "rank", "left").join(side("after", -1), "rank", "left")
    score = {x: F.when(F.col(f"{x}_host") == F.col("host"), _nearness(F.col("path"), F.col(f"{x}_path"))).otherwise(-1) for x in ("before", "after")}
    near = near.select("host", "key", "before_key", "after_key", score["before"].alias("b"), score["after"].alias("a")).where("b >= 0 or a >= 0")
    return near.select("host", "key", F.when(F.col("b") >= F.col("a"), F.col("before_key")).otherwise(F.col("after_key")).alias("partner"))


def _gone(pairs: DataFrame) -> DataFrame:
    """host, key, gone: places of the lines of each content that its partner shares, where there are any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                gone = pa.array([shared_lines(a, b, sizes, open_) or None for open_, a, sizes, b in zip(*(part.column(i).to_pylist() for i in range(2, 6)), strict=True)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), gone], names=["host", "key", "gone"]).filter(gone.is_valid())

    return pairs.select("host", "key", "open", "hashes", "sizes", "other").mapInArrow(run, "host string, key binary, gone array<int>")


def _texts(pages: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                texts, shared = [], []
                for lines, gone in zip(_opened(part.column(2).to_pylist()), part.column(3).to_pylist(), strict=True):
                    out = set(gone or ())
                    texts.append("\n\n".join(x for i, x in enumerate(lines) if i not in out))
                    shared.append(len(out))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64()), pa.array(shared, pa.int32())], names=["page_id", "url", "text", "n_chars", "n_shared"]
                )

    return pages.select("page_id", "url", "packed", "gone").mapInArrow(run, "page_id long, url string, text string, n_chars long, n_shared int")


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars and n_shared (lines that went, as the nearest page has them) for each row of ``pages``.

    1. Every page is parsed whole, once, into its lines: the blocks of a marked article, or of a page without one
       all blocks. Blocks marked as menus, headers, footers, sidebars, notices, adverts, forms or comments are left out.
       Inside an article a name with a word of a layout and others (share-this, form-factor) leaves its lines undecided.
    2. Hosts with undecided lines, of an article or of a page without one, take part in the differencing.
       Pages of a host with the same lines are one content. Contents are numbered by host and URL path over all
       tasks, and each is paired with the nearer of its two neighbours on its host; only keys are sorted.
    3. A pair's lines are aligned by longest common subsequence, and shared undecided ones go (``shared_lines``). Lines are
       compared by 64-bit hashes, so texts are not shuffled.

    The result does not depend on how rows are dealt to tasks. Ties: of equally near neighbours the one before
    counts; contents of one path are ordered by digest; of several longest subsequences the first found counts.
    A host with a third of all pages is spread over many tasks, since nothing is grouped by host alone. The
    alignment of two pages is quadratic only in the lines that repeat inside both.

    A null or empty page has an empty text; a page without host, or with the only content of its host, has no
    partner; null ids and repeated rows are rows like others; an empty table gives an empty table; other columns
    are not read.
    """
    spark: SparkSession = pages.sparkSession
    scratch = Scratch(spark, "pages")
    parsed = scratch.save(_parsed(pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].alias("url"), pages[html_col].alias("html"))))
    hosts = parsed.where("host <> '' and key is not null and undecided").select("host").distinct()
    paired = scratch.save(parsed.join(hosts, "host", "left_semi").drop("page_id", "url", "packed"))
    partners = scratch.save(nearest_contents(paired, scratch))
    contents = paired.where("host <> '' and key is not null").select("host", "key", "undecided", "open", "hashes", "sizes").dropDuplicates(["host", "key"])
    pairs = contents.where("undecided").join(partners, ["host", "key"]).join(contents.select("host", F.col("key").alias("partner"), F.col("hashes").alias("other")), ["host", "partner"])
    gone = scratch.save(_gone(pairs))
    return _texts(parsed.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, ["host", "key"], "left"))
