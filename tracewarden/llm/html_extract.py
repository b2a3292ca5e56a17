"""Main-text extraction by nearest-URL page differencing (operator 6).

A page is read into lines (one per block) with a role that the markup gives it:
article, page furniture, or unknown. The distinct URL paths of a host are put in
order and each is paired with the neighbour that has the longest common start; the
lines of a page and of its pair are aligned by a longest common subsequence, and
what the two share is furniture of the site and goes, on every page. A shared line
that the markup itself puts into the article stays: two copies of one article would
otherwise delete each other. What the markup calls furniture goes with or without a
twin; where its words contradict each other (a class "post tags") the differencing
decides. Of an article's own header the headings stay.

Scale: the alignment needs only hashes of lines, so html is never shuffled, and it
is parsed twice: for the outline and for the text. One page stands for a URL path
(partial aggregates, so a hot path costs nothing), the paths are range-sorted, a
host with a third of all pages being cut into many ranges, and the edge rows of
each range are handed to its neighbours. Deletions come back by page id and hash.

Cases: null or empty html gives an empty text; null urls share one host and path;
markup that is not closed is read to the end, an unbalanced quote to the next ">";
pages of one URL path are not paired with each other, nor is a page with one of
equal lines where the other neighbour differs; a page alone in its host has no
pair; null and repeated page_ids are told apart by their html; extra columns are
ignored.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewarden.llm import common as C

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(?:/?)(?:[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)", re.S)
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)", re.S)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I | re.S)
SPACES = re.compile(r"\s+")
#: Elements whose content is text for a program, read up to their own end tag.
RAW = frozenset("script style noscript template iframe object svg math canvas textarea select title".split())
#: Elements that are page furniture whatever they hold.
FURNITURE = frozenset("head nav header footer aside form button menu dialog fieldset label option datalist".split())
#: Furniture of which an article or main element inside is none: it wraps whole pages too.
WRAPPERS = frozenset(("form", "fieldset"))
#: Tokens of class, id or role that name furniture: made of such words, after words of place.
FURNITURE_WORDS = re.compile(
    r"(?:(?:site|page|global|main|primary|secondary|top|bottom|left|right)[_-])*(?:(?:nav[^\W_]*|menu[^\W_]*|header|footer|foot|sidebar[^\W_]*|side|aside|ads?|advert[^\W_]*|sponsor[^\W_]*|promo[^\W_]*|banner|cookie[^\W_]*|consent|notice[^\W_]*|popup|modal|overlay|newsletter|subscribe[^\W_]*|signup|login|share[^\W_]*|social[^\W_]*|related[^\W_]*|recommend[^\W_]*|breadcrumb[^\W_]*|pagination|pager|comments?\w*|disqus|respond|reply|replies|tags?|widget[^\W_]*|search[^\W_]*|toolbar|skip[^\W_]*|copyright|legal|contentinfo|complementary|navigation|form)(?:[_-]|$))+"
    # what a page's readers say, what else there is to read and ways to pass it on, whatever the name goes on to say
    r"|(?:(?:article|post|entry|user|reader)[_-])?(?:comments?|discussion|disqus|replies|related|recommended|share|sharing)(?:[_-][\w-]*)?",
    re.I,
)
MAIN = frozenset(("article", "main"))
MAIN_WORDS = re.compile(r"(?:(?:article|main|content|post|entry|story|body)(?:[_-]|$))+", re.I)
#: Elements that begin and end a block.
BLOCKS = frozenset("address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption legend".split())
#: Blocks inside which a line goes on: a line break is white space inside its block.
INSIDE = frozenset(("br",))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: CHROME ends at an article or main element inside, TITLES (an article's header) at a heading, HIDDEN does not end.
ARTICLE, UNKNOWN, CHROME, HIDDEN, TITLES = 2, 1, 0, -1, -2


def _role(tag: str, attributes: str, around: int = UNKNOWN) -> int | None:
    """Role that an element gives its content, None where it leaves that of its parent (``around``)."""
    if tag == "header" and around == ARTICLE:
        return TITLES
    if around == TITLES and tag in HEADINGS:
        return ARTICLE
    if tag in FURNITURE:
        return CHROME if tag in WRAPPERS else HIDDEN
    named: list[str] = []
    for name, value in ATTRIBUTE.findall(attributes):
        name = name.lower()
        value = value.strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            return HIDDEN
        if name in ("class", "id", "role"):
            named += entities.unescape(value).split()
    if tag in ("body", "html"):
        return None
    furniture, main = (any(words.fullmatch(x) for x in named) for words in (FURNITURE_WORDS, MAIN_WORDS))
    if furniture and main:
        return ARTICLE if tag in MAIN else None
    if furniture:
        return CHROME
    if around == TITLES:
        return None
    return ARTICLE if main or tag in MAIN else None


def page_lines(html: str | None) -> list[tuple[str, int]]:
    """The blocks of a page in page order, each with the role of what encloses it: furniture wins, also inside an article,
    up to an article or main element inside it where the furniture is one by its class or a form."""
    lines: list[tuple[str, int]] = []
    buffer: list[str] = []
    stack: list[tuple[str, int]] = []
    role = UNKNOWN
    at, text = 0, html or ""

    def close() -> None:
        if buffer:
            line = SPACES.sub(" ", entities.unescape("".join(buffer))).strip()
            buffer.clear()
            if line:
                lines.append((line, role))

    while at < len(text):
        m = TOKEN.search(text, at)
        if m is None:
            buffer.append(text[at:])
            break
        if m.start() > at:
            buffer.append(text[at : m.start()])
        at = m.end()
        if m.group(2) is None and m.group(0)[1] not in "!?":  # a quote that never ends
            m = TAG.match(text, m.start())
        tag = (m.group(2) or "").lower()
        if not tag:
            continue
        if m.group(1):
            if tag in BLOCKS and tag not in INSIDE:
                close()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if stack[i][1] != role:
                        close()
                    role = stack[i][1]
                    del stack[i:]
                    break
            continue
        if tag in RAW:
            if (m.group(3) or "").endswith("/"):
                continue
            end = re.compile(rf"</{re.escape(tag)}\s*(?:>|\Z)", re.I).search(text, at)
            at = end.end() if end else len(text)
            continue
        if tag in INSIDE:
            buffer.append(" ")
        elif tag in BLOCKS:
            close()
        if tag == "p":  # a paragraph ends an open one
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    role = stack[i][1]
                    del stack[i:]
                    break
                if stack[i][0] in BLOCKS:
                    break
        if tag in VOID or (m.group(3) or "").endswith("/"):
            continue
        given = _role(tag, m.group(3) or "", role)
        inside = role == HIDDEN or (role == CHROME and given != HIDDEN and tag not in MAIN)
        new = role if given is None or inside else given
        if new != role:
            close()
        stack.append((tag, role))
        role = new
    close()
    return lines


def url_parts(url: str | None) -> tuple[str, str]:
    """Host in lower case and path with query; the fragment goes."""
    rest = re.sub(r"^[a-zA-Z][a-zA-Z0-9+.-]*://", "", url or "").split("#")[0]
    host, _, path = rest.partition("/")
    return host.rpartition("@")[2].lower(), "/" + path


def line_hash(line: str) -> int:
    return xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass")) - (1 << 63)


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Positions in ``a`` of a longest common subsequence with ``b`` (Hunt-Szymanski, after equal ends are cut off)."""
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    stop = 0
    while stop < min(len(a), len(b)) - start and a[-1 - stop] == b[-1 - stop]:
        stop += 1
    where: dict[int, list[int]] = {}
    for j in range(len(b) - stop - 1, start - 1, -1):
        where.setdefault(b[j], []).append(j)
    tails: list[int] = []
    links: list = []
    for i in range(start, len(a) - stop):
        for j in where.get(a[i], ()):
            k = bisect_left(tails, j)
            node = (i, links[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                links.append(node)
            elif j < tails[k]:
                tails[k], links[k] = j, node
    found, node = [], links[-1] if links else None
    while node:
        found.append(node[0])
        node = node[1]
    return [*range(start), *found[::-1], *range(len(a) - stop, len(a))]


def _outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """page_id, h, host, path, hashes of the lines and their roles."""
    for p in C.pieces(batches, "html"):
        hosts, paths, hashes, roles = [], [], [], []
        for url, html in zip(p.column("url").to_pylist(), p.column("html").to_pylist(), strict=True):
            host, path = url_parts(url)
            lines = page_lines(html)
            hosts.append(host)
            paths.append(path)
            hashes.append([line_hash(x) for x, _ in lines])
            roles.append([r for _, r in lines])
        yield pa.RecordBatch.from_arrays([p.column("page_id"), p.column("h"), pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(hashes, pa.list_(pa.int64())), pa.array(roles, pa.list_(pa.int32()))], names=["page_id", "h", "host", "path", "hashes", "roles"])


def _start(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """page_id, h and the hashes of the shared lines that go."""
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            twins = [x for x in (r["before"], r["after"]) if x is not None and x["host"] == r["host"]]
            # a page of equal lines only where there is no other; then the longest common start; the one before wins a tie
            twins.sort(key=lambda x: (x["hashes"] == r["hashes"], -_start(x["path"], r["path"])))
            lost = [r["hashes"][i] for i in common_lines(r["hashes"], twins[0]["hashes"]) if r["roles"][i] == UNKNOWN] if twins else []
            if lost:
                rows.append((r["page_id"], r["h"], lost))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.int64()), pa.array([x[2] for x in rows], pa.list_(pa.int64()))], names=["page_id", "h", "gone"])


def neighbours(outline: DataFrame) -> DataFrame:
    """host, path with the page before and after it among the distinct paths in order (structs host, path, hashes)."""
    n = C.parts(outline.sparkSession)
    one = F.min_by("hashes", F.struct(F.col("page_id").isNull(), "page_id", "h")).alias("hashes")
    paths = outline.groupBy("host", "path").agg(one)
    ranged = C.stored(paths.repartitionByRange(n, "host", "path").sortWithinPartitions("host", "path").withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), "paths")
    page = F.struct("host", "path", "hashes")
    edges = ranged.groupBy("part").agg(F.min_by(page, "at").alias("first"), F.max_by(page, "at").alias("last"))
    by_part = W.orderBy("part")  # one row for each range
    edges = edges.select("part", F.lag("last").over(by_part).alias("last_before"), F.lead("first").over(by_part).alias("first_after"))
    inside = W.partitionBy("part").orderBy("at")
    paired = ranged.withColumns({"before": F.lag(page).over(inside), "after": F.lead(page).over(inside)}).join(F.broadcast(edges), "part")  # as many rows as ranges
    return paired.select("host", "path", F.coalesce("before", "last_before").alias("before"), F.coalesce("after", "first_after").alias("after"))


def shared_lines(pages: DataFrame) -> DataFrame:
    """page_id, h, gone: hashes of each page's lines of unknown role that its nearest page shares."""
    schema = "page_id long, h long, host string, path string, hashes array<long>, roles array<int>"
    outline = C.stored(pages.mapInArrow(_outline, schema), "outline")
    # pages with no line to decide need no pair
    open_ = outline.where(F.exists("roles", lambda r: r == UNKNOWN))
    return open_.join(neighbours(outline), ["host", "path"]).mapInArrow(_differences, "page_id long, h long, gone array<long>")


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for p in C.pieces(batches, "html"):
        out = []
        for html, gone in zip(p.column("html").to_pylist(), p.column("gone").to_pylist(), strict=True):
            lines, lost = page_lines(html), set(gone or ())
            kept = [x for x, role in lines if role == ARTICLE or (role == UNKNOWN and not (lost and line_hash(x) in lost))]
            out.append("\n".join(kept))
        yield pa.RecordBatch.from_arrays([p.column("page_id"), p.column("url"), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each page."""
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html", F.xxhash64("html").alias("h"))
    gone = C.stored(shared_lines(base), "gone").groupBy(F.col("page_id").alias("_id"), F.col("h").alias("_h")).agg(F.flatten(F.collect_set("gone")).alias("gone"))
    same = base["page_id"].eqNullSafe(gone["_id"]) & (base["h"] == gone["_h"])
    return base.join(C.sized_broadcast(gone), same, "left").select("page_id", "url", "html", "gone").mapInArrow(_texts, "page_id long, url string, text string, n_chars long")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
