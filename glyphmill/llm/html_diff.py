"""HTML extraction (operator 1): nearest-URL page differencing, confirmed by element roles.

Pages are sorted by host and URL path; each page is compared with its neighbour of the longest common path and their lines
are aligned by a longest common subsequence. Lines that both share are deleted, unless they stand in an article or main
element: an article that is published twice on a host would vanish otherwise. What differencing leaves outside the article
goes where an element of a known role holds it (navigation, footers, adverts ...): a notice that differs on every page is
shared by none. n_deleted counts the first, n_role the second.
"""

from __future__ import annotations

import bisect
import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from itertools import groupby, islice
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEEP, NEUTRAL, DROP = 2, 1, 0
#: Two neighbours that share this much of their lines of no role are copies, not one template: nothing is deleted.
COPY_SHARE = 0.9

#: A tag's quotes count only after an equals sign, so an unpaired one can't swallow the page; all repeats are possessive, so
#: the tokenizer only moves forward.
_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[A-Za-z][^\s/>]*+)(?P<attrs>(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.DOTALL,
)
#: Elements whose content isn't text of the page. Without an end tag the first ones last to the page's end; of the others
#: only the tag goes.
TO_THE_END = frozenset("script style textarea title noscript iframe".split())
RAW = TO_THE_END | frozenset("template svg select annotation annotation-xml".split())
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*+(?:>|\Z)", re.IGNORECASE) for name in RAW}
#: Raw elements that stand between words.
_SPACED = frozenset("title textarea select svg iframe".split())
_ATTR = re.compile(r"(?<![\w-])(class|id|role|aria-label|itemprop)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"']++))", re.IGNORECASE)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:[\s=/]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.IGNORECASE)
_SPACE = re.compile(r"[\s ]+")
_NAME_PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*")

#: Formulas and the text that stands in for an object are part of the line.
MATH = "math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder munderover mstyle mspace mpadded menclose mfenced mtable mtr mtd mmultiscripts merror semantics".split()
INLINE = frozenset("object a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark param q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split() + MATH)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROP_TAGS = frozenset("head nav header footer aside form button dialog menu fieldset".split())
KEEP_TAGS = frozenset("article main".split())
#: Parts of class, id and role names of what isn't the article.
DROP_PARTS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside ad ads advert adverts advertisement banner sponsor sponsored promo cookie cookies consent notice notices"
    " newsletter subscribe subscription signup login comment comments disqus respond replies share sharing social related recommended popup modal overlay pagination pager toolbar widget complementary contentinfo search copyright".split()
)
#: Parts that may stand beside them in such a name: a box, or where it stands. Any other part makes it a name of something else.
BESIDE_PARTS = frozenset(
    "article post entry content story body main page site top bottom left right global list box container wrapper wrap inner outer block section area bar buttons button links link posts articles slot unit form"
    " thread item items message panel row col column text js sticky fixed primary secondary fluid google".split()
)
#: Elements that can be a box of another role within an article; headings and paragraphs there are the article's own.
BOXES = frozenset("div section ul ol dl table details figure center".split())
#: What an id says of a box in an article; other ids there are anchors of its own sections.
ID_PARTS = frozenset("ad ads advert adverts advertisement comment comments disqus newsletter related replies respond share sharing sidebar".split())


def _closed(attrs: str) -> bool:
    """Whether a tag closes itself; the slash that ends an unquoted value doesn't."""
    return attrs.endswith("/") and (attrs[-2:-1] in ("", '"', "'") or attrs[-2:-1].isspace() or "=" not in attrs[-200:].split()[-1])


def _names_a_role(name: str, known: frozenset[str] = DROP_PARTS) -> bool:
    parts = [p.lower() for p in _NAME_PARTS.findall(name) if len(p) > 1]
    return any(p in known for p in parts) and all(p in known or p in BESIDE_PARTS for p in parts)


def _role(tag: str, attrs: str, within: int = 1) -> int | None:
    """DROP, KEEP, or None for the role of what stands around the element, `within`. In an article only boxes are told by
    name, and by few ids."""
    if tag in DROP_TAGS or attrs and _HIDDEN.search(attrs):
        return DROP
    if attrs and tag not in ("body", "html"):
        for kind, *values in _ATTR.findall(attrs):
            for word in "".join(values).split():
                if (within != KEEP or tag in BOXES) and _names_a_role(word, ID_PARTS if within == KEEP and kind.lower() == "id" else DROP_PARTS):
                    return DROP
                if word.lower() in ("main", "articlebody", "article"):
                    return KEEP
    return KEEP if tag in KEEP_TAGS else None


def lines_of(page: str | None) -> list[tuple[str, int]]:
    """The page's text blocks in order, each with its role: a block ends where a block element begins or ends. Linear in the
    page, whatever its markup."""
    out: list[tuple[str, int]] = []
    stack: list[tuple[str, int]] = []
    opened: Counter[str] = Counter()  # how often a name is on the stack
    text: list[str] = []
    role, at = NEUTRAL, 0
    page = page or ""
    endless: set[str] = set()  # raw elements that have no end tag from here on

    def flush() -> None:
        if text:
            line = _SPACE.sub(" ", entities.unescape("".join(text))).strip(" ")
            if line:
                out.append((line, role))
            text.clear()

    def push(tag: str) -> None:
        stack.append((tag, role))
        opened[tag] += 1

    def pop_to(tag: str) -> int:
        while True:
            name, before = stack.pop()
            opened[name] -= 1
            if name == tag:
                return before

    while m := _TOKEN.search(page, at):
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            if m["cdata"]:
                text.append(m["cdata"])
            continue
        attrs, ends = m["attrs"], m["close"] == "/"
        if tag in RAW:
            if tag in _SPACED:
                text.append(" ")
            if not ends and not _closed(attrs):
                end = None if tag in endless else _RAW_END[tag].search(page, at)
                if end:
                    at = end.end()
                elif tag in TO_THE_END:
                    at = len(page)
                else:
                    endless.add(tag)
            continue
        if tag in INLINE:
            if tag in ("br", "mtd"):
                text.append(" ")
            if ends:
                if opened[tag]:
                    flush()
                    role = pop_to(tag)
            elif attrs and tag not in VOID and not (tag in ("math", "object") and _closed(attrs)) and _role(tag, attrs, role) == DROP:
                flush()
                push(tag)
                role = DROP
            continue
        flush()
        if ends:
            if opened[tag]:
                role = pop_to(tag)
        elif tag not in VOID and not _closed(attrs):
            if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option"):
                while stack and stack[-1][0] == tag:  # their end tags may be left out
                    role = pop_to(tag)
            own = _role(tag, attrs, role)
            push(tag)
            if own == DROP or role == DROP:
                role = DROP
            elif own == KEEP:
                role = KEEP
    if at < len(page):
        text.append(page[at:])
    flush()
    return out


def url_key(url: str | None) -> tuple[str, str]:
    """(host, path), lower-cased, without scheme, www, query, fragment and trailing slash; an unreadable URL is all path."""
    try:
        parts = urlsplit((url or "").strip())
        host, path = (parts.hostname or ""), parts.path
    except ValueError:
        host, path = "", url or ""
    return host.removeprefix("www."), "/" + path.strip("/").lower()


def common_lines(a: list[int], b: list[int], most_bytes: int = 32 << 20) -> list[int]:
    """The positions in a of a longest common subsequence of a and b.

    Rows of the table are bit vectors in Python's integers (a carry adds the whole row at once); where they would take
    over most_bytes, b is halved and a is cut where the two halves' lengths sum to the most (Hirschberg).
    """
    head = 0
    while head < len(a) and head < len(b) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < len(a) - head and tail < len(b) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    mid_a, mid_b = a[head : len(a) - tail], b[head : len(b) - tail]
    inner = [head + i for i in _align(mid_a, mid_b, most_bytes)] if mid_a and mid_b else []
    return [*range(head), *inner, *range(len(a) - tail, len(a))]


def _rows(a: list[int], b: list[int]) -> Iterator[int]:
    at: dict[int, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        both = row & at.get(y, 0)
        row = ((row + both) | (row - both)) & full
        yield row


def _align(a: list[int], b: list[int], most_bytes: int) -> list[int]:
    if not a or not b:
        return []
    if len(b) > 1 and len(a) * len(b) // 8 > most_bytes:
        half = len(b) // 2
        n = len(a)

        def prefix_lengths(x: list[int], y: list[int]) -> np.ndarray:
            row = (1 << len(x)) - 1
            for row in _rows(x, y):  # noqa: B007  the last row counts
                pass
            bits = np.unpackbits(np.frombuffer(row.to_bytes(-(-len(x) // 8), "little"), np.uint8), bitorder="little")[: len(x)]
            return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])

        score = prefix_lengths(a, b[:half]) + prefix_lengths(a[::-1], b[half:][::-1])[::-1]
        cut = int(np.argmax(score[: n + 1]))
        return _align(a[:cut], b[:half], most_bytes) + [cut + i for i in _align(a[cut:], b[half:], most_bytes)]
    rows = [(1 << len(a)) - 1, *_rows(a, b)]
    i, j, out = len(a), len(b), []
    while i and j:
        if a[i - 1] == b[j - 1]:
            out.append(i - 1)
            i, j = i - 1, j - 1
        elif rows[j] >> (i - 1) & 1:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def kept_text(lines: list[tuple[str, int]], own: list[int], partners: list[list[int]]) -> tuple[str, int, int, int]:
    """(text, shared lines, lines that differencing deletes, lines that a role deletes): what is left after the first partner
    that isn't a copy of the page.

    A page that shares nearly all its text of no known role, and marks no article, is a copy of its partner, not one of its
    template: the next partner tells them apart, and without one the shared lines of no role stay.
    """
    neutral = [i for i, (_, role) in enumerate(lines) if role == NEUTRAL]
    marked = any(role == KEEP for _, role in lines)
    size = sum(len(lines[i][0]) for i in neutral)
    shared: set[int] = set()
    copied = False
    for other in partners:
        if other == own:
            continue
        shared = set(common_lines(own, other))
        copied = not marked and size > 0 and sum(len(lines[i][0]) for i in neutral if i in shared) >= COPY_SHARE * size
        if not copied:
            break
    gone = {i for i in shared if lines[i][1] == DROP or lines[i][1] == NEUTRAL and not copied}
    named = {i for i, (_, role) in enumerate(lines) if role == DROP and i not in gone}
    return "\n\n".join(line for i, (line, _) in enumerate(lines) if i not in gone and i not in named), len(shared), len(gone), len(named)


def _line_hashes(lines: list[tuple[str, int]]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass")) for line, _ in lines), np.uint64, len(lines))


#: What a page sends on: its lines that may stay (roles, texts) and the hashes of all its lines, not its markup.
_PARSED = "part int, page_id long, url string, host string, path string, roles binary, hashes binary, texts array<string>"
#: Pages of a range of the sort, at most about, and sampled keys for each range.
RANGE_ROWS = 20_000
KEYS_A_RANGE = 40


def _key(host: str, path: str, page_id: int | None) -> tuple:
    """The order of the pages; it agrees with Spark's (nulls first, texts by code points)."""
    return host, path, page_id is not None, page_id or 0


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [url_key(u) for u in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string())], ["page_id", "host", "path"])


def range_bounds(pages: DataFrame, parts: int) -> list[tuple]:
    """At most parts - 1 keys of pages that cut them into ranges of about equal size, from about KEYS_A_RANGE sampled keys a range.
    The html isn't read. A range holds its own bound, so none but the last can be empty; no result depends on the cuts."""
    if parts < 2:
        return []
    share = parts * KEYS_A_RANGE / max(1, pages.count())  # counts come from the files' footers
    some = pages.select(F.col("page_id").cast("long"), "url").filter(F.rand(1) < share)  # a task sends its share of the sample only
    keys = some.mapInArrow(_keys, "page_id long, host string, path string").collect()
    sample = sorted(_key(r["host"], r["path"], r["page_id"]) for r in keys)
    return sorted({sample[len(sample) * i // parts] for i in range(1, parts)}) if sample else []


def _parse(bounds: list[tuple]):
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                found = [lines_of(p) for p in batch.column(2).to_pylist()]
                keys = [url_key(u) for u in batch.column(1).to_pylist()]
                parts = [bisect.bisect_left(bounds, _key(host, path, page_id)) for (host, path), page_id in zip(keys, batch.column(0).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(parts, pa.int32()),
                        batch.column(0),
                        batch.column(1),
                        pa.array([k[0] for k in keys], pa.string()),
                        pa.array([k[1] for k in keys], pa.string()),
                        pa.array([bytes(role for _, role in lines) for lines in found], pa.binary()),
                        pa.array([_line_hashes(lines).tobytes() for lines in found], pa.binary()),
                        pa.array([[line for line, role in lines if role] for lines in found], pa.list_(pa.string())),
                    ],
                    ["part", "page_id", "url", "host", "path", "roles", "hashes", "texts"],
                )

    return parse


def _common_prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


class _Page:
    """A page of the sorted stream; pages in a row of equal run (host and lines) are copies of each other."""

    __slots__ = ("row", "key", "hashes", "run")

    def __init__(self, row: dict) -> None:
        self.row, self.key = row, (row["host"], row["path"])
        self.hashes = np.frombuffer(row["hashes"], np.uint64).tolist()
        self.run = xxhash.xxh64_intdigest(row["host"].encode("utf-8", "surrogatepass") + b"\0" + row["hashes"]) - (1 << 63)


class _Run:
    """A run of copies: its first page whole, one list of texts for each distinct list of roles, and the names of its pages."""

    def __init__(self) -> None:
        self.texts: dict[bytes, list[str]] = {}
        self.names: list[tuple] = []
        self.head: _Page | None = None
        self.done: dict[tuple, tuple] = {}

    def add(self, page: _Page) -> None:
        self.head = self.head or page
        self.texts.setdefault(page.row["roles"], page.row["texts"])
        self.names.append((page.row["page_id"], page.row["url"], page.key[1], page.row["roles"]))

    def results(self, before: _Page | None, after: _Page | None) -> Iterator[dict]:
        """The pages' results against the nearest pages before and after the run; copies with equal roles and the same first
        partner are worked out once."""
        host = self.head.key[0]
        near = [p for p in (before, after) if p is not None and p.key[0] == host and host]
        for page_id, url, path, roles in self.names:
            order = sorted(near, key=lambda p: -_common_prefix(p.key[1], path))  # stable: the page before it first
            known = roles, bool(order) and order[0] is near[0]
            if known not in self.done:
                left = iter(self.texts[roles])
                self.done[known] = kept_text([(next(left) if role else "", role) for role in roles], self.head.hashes, [p.hashes for p in order])
            text, shared, deleted, named = self.done[known]
            yield {"page_id": page_id, "url": url, "text": text, "n_chars": len(text), "n_shared": shared, "n_deleted": deleted, "n_role": named}


_RESULT = "page_id long, url string, text string, n_chars long, n_shared long, n_deleted long, n_role long"
_RESULT_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64()), ("n_shared", pa.int64()), ("n_deleted", pa.int64()), ("n_role", pa.int64())])

#: What a range's ends are: pages of its first and last run, which may go on in other ranges, and the lines of the pages that
#: can be partners of those: its first page, the first after its first run, the last before its last run, its last.
OF_FIRST, OF_LAST, FIRST, SECOND, PREVIOUS, LAST = range(6)
_ENDS = "kind int, part int, run long, page_id long, url string, host string, path string, roles binary, hashes binary, texts array<string>"
_ENDS_ARROW = pa.schema(
    [("kind", pa.int32()), ("part", pa.int32()), ("run", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("path", pa.string()), ("roles", pa.binary()), ("hashes", pa.binary()), ("texts", pa.list_(pa.string()))]
)


def _batched(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    while some := list(islice(rows, 256)):
        yield pa.RecordBatch.from_pylist(some, schema)


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            yield from batch.slice(at, 256).to_pylist()


def _runs(pages: Iterator[_Page]) -> Iterator[tuple[_Page | None, _Run, _Page | None]]:
    """The runs of a sorted range, each with the pages before and after it. One run is held: its lines and its pages' names."""
    before, run, here = None, _Run(), None
    for page in pages:
        if here is not None and page.run != here.run:
            yield before, run, page
            before, run = here, _Run()
        run.add(page)
        here = page
    yield before, run, None


def _inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of all runs of each sorted range but its first and last."""

    def results() -> Iterator[dict]:
        for _, pages in groupby(map(_Page, _rows_of(batches)), key=lambda page: page.row["part"]):
            for before, run, after in _runs(pages):
                if before is not None and after is not None:
                    yield from run.results(before, after)

    return _batched(results(), _RESULT_ARROW)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first and last run of each sorted range, and the pages that can be partners of these or of other ranges' runs.
    Lines go with the first of the copies that share their roles; the others send their names."""

    def partner(kind: int, page: _Page) -> dict:
        return {"kind": kind, "part": page.row["part"], "run": page.run, "host": page.key[0], "path": page.key[1], "hashes": page.row["hashes"]}

    def ends() -> Iterator[dict]:
        for part, pages in groupby(map(_Page, _rows_of(batches)), key=lambda page: page.row["part"]):
            last: _Page | None = None

            def noted() -> Iterator[_Page]:
                nonlocal last
                for last in pages:  # noqa: B023  used before the next group
                    yield last

            for before, run, after in _runs(noted()):
                if before is None:
                    yield partner(FIRST, run.head)
                    if after is not None:
                        yield partner(SECOND, after)
                elif after is None:
                    yield partner(PREVIOUS, before)
                if after is None:
                    yield partner(LAST, last)
                if before is None or after is None:
                    sent: set[bytes] = set()
                    for page_id, url, path, roles in run.names:
                        lines = {} if roles in sent else {"hashes": run.head.row["hashes"], "texts": run.texts[roles]}
                        sent.add(roles)
                        yield {"kind": OF_LAST if before else OF_FIRST, "part": part, "run": run.head.run, "page_id": page_id, "url": url, "host": run.head.key[0], "path": path, "roles": roles, **lines}

    return _batched(ends(), _ENDS_ARROW)


def _as_they_are(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return batches


def _needs(partners: DataFrame) -> DataFrame:
    """goes, side, place, part, kind: which partner stands before (place 0) and after (place 1) the first (side 0) and the
    last run (side 1) of each range. A run that fills ranges has the partners of all of it.

    The windows run over a row of a few numbers for each range of RANGE_ROWS pages.
    """

    def run(kind: int) -> F.Column:
        return F.max(F.when(F.col("kind") == kind, F.col("run")))

    ranges = partners.groupBy("part").agg(run(FIRST).alias("first"), run(LAST).alias("last"), (F.count_if(F.col("kind") == SECOND) == 0).alias("single"))

    def at(part: F.Column, kind: int) -> F.Column:
        return F.struct(part.alias("part"), F.lit(kind).alias("kind"))

    def beyond(order: F.Column, near: str, far: str, nearest: int, next_run: int) -> F.Column:
        w = Window.orderBy(order)
        beside = F.lag("part").over(w)
        found = F.when(beside.isNull(), at(F.lit(-1), nearest)).when(F.lag(near).over(w) != F.col(far), at(beside, nearest)).when(~F.lag("single").over(w), at(beside, next_run))
        return found

    ranges = ranges.withColumn("before", beyond(F.asc("part"), "last", "first", LAST, PREVIOUS)).withColumn("after", beyond(F.desc("part"), "first", "last", FIRST, SECOND))
    so_far = Window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranges = ranges.withColumn("before", F.last("before", True).over(so_far.orderBy("part"))).withColumn("after", F.last("after", True).over(so_far.orderBy(F.desc("part"))))

    def need(side: int, place: int, who: F.Column) -> F.Column:
        return F.struct(F.lit(side).alias("side"), F.lit(place).alias("place"), who["part"].alias("part"), who["kind"].alias("kind"))

    first = F.array(need(0, 0, F.col("before")), need(0, 1, F.when(F.col("single"), F.col("after")).otherwise(at(F.col("part"), SECOND))))
    last = F.array(need(1, 0, at(F.col("part"), PREVIOUS)), need(1, 1, F.col("after")))
    wanted = F.explode(F.when(F.col("single"), first).otherwise(F.concat(first, last)))
    return ranges.select(F.col("part").alias("goes"), wanted.alias("n")).select("goes", "n.*")


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of the open runs of each group, whose partners come first; then, for each list of roles, the copy with lines."""

    def results() -> Iterator[dict]:
        for _, rows in groupby(_rows_of(batches), key=lambda row: (row["goes"], row["side"])):
            beside: list[_Page | None] = [None, None]
            run = _Run()
            for row in rows:
                if row["place"] < 2:
                    beside[row["place"]] = _Page(row)
                    continue
                if row["texts"] is not None:
                    run = _Run()
                    run.add(_Page(row))
                run.names = [(row["page_id"], row["url"], row["path"], row["roles"])]
                yield from run.results(*beside)

    return _batched(results(), _RESULT_ARROW)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_shared (lines shared with the neighbour), n_deleted (by differencing), n_role (by their
    role alone) of every page. A header within an article counts as a header and goes.

    Null html gives an empty text; a null or unreadable url has no neighbour; a run of pages with equal lines is compared
    with the pages before and after it, so a copy never deletes its original and copies keep the same; further columns are
    ignored; an empty table gives an empty one. One shuffle of all lines: a range sort by host and path, which splits a large
    host over many tasks. The first and last run of each range, a page each as a rule, meet their partners, which may be
    ranges away, in groups, one for each range.
    """
    parts = max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-pages.count() // RANGE_ROWS))
    bounds = range_bounds(pages, parts)
    parsed = pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(_parse(bounds), _PARSED)
    placed = parsed.repartitionById(len(bounds) + 1, "part").sortWithinPartitions("part", "host", "path", "page_id", "hashes")
    # both branches read one exchange, and so do the parts of the second: a function between keeps their columns alike
    ends = placed.mapInArrow(_ends, _ENDS).repartition("part").mapInArrow(_as_they_are, _ENDS)
    partners = ends.filter(F.col("kind") >= FIRST)
    lines = ("host", "path", "hashes")
    near = _needs(partners).join(partners.select("part", "kind", *lines), ["part", "kind"]).select("goes", "side", "place", *lines)
    runs = ends.filter(F.col("kind").isin(OF_FIRST, OF_LAST))
    runs = runs.select(F.col("part").alias("goes"), (F.col("kind") - OF_FIRST).alias("side"), F.lit(2).alias("place"), *lines, "page_id", "url", "roles", "texts")
    met = runs.unionByName(near, allowMissingColumns=True).repartition("goes", "side").sortWithinPartitions("goes", "side", "place", "roles", F.col("texts").isNull())
    return placed.mapInArrow(_inner, _RESULT).unionByName(met.mapInArrow(_close, _RESULT))


def op1_html_diff(pages: DataFrame) -> DataFrame:
    return extract(pages)
