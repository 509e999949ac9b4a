"""Main text of web pages, with site templates found by counting element subtrees per host.

Each page is read once into its text blocks. Every element that holds text gives two hashes: of its subtree (what it
says) and of its slot (the names, classes, ids and roles from the page's root down to it, digits apart). Spark counts
on a host

* for each subtree, under how many articles it stands: it goes where ``LEAST`` of them and ``SHARE`` of the host's do;
* for each slot, how many different subtrees fill it and how many of these recur under two articles or more: a
  place that a site fills from a stock, as a menu or a notice that changes now and then, goes with all its fillings
  if ``STOCK`` of them recur and are ``STOCK_SHARE`` of all (``INNER_SHARE`` in an article, and on pages without one).

Names only lower these floors. An element whose class, id or role has the word of a template in a longer name
(``site-footer``) goes if its slot stands under ``MARKED`` articles, inside an article only if fillings recur, too.
Elements that name themselves one (nav, footer, aside and forms by tag, ``comments`` or ``ad`` as a whole class) need no
count, but are hashed and counted like all others; a header in an article, headings and names that may stand for
contents (``header``, ``related``) do not count there as naming themselves. ``marks=False`` leaves all to counts.
Scripts, styles and controls hold no text.

What counts as one: a subtree in an article or main element counts once for each distinct text of the innermost of
these, others once for each distinct text of the page's lead (of these elements the one with the most text of its own)
or, without any, of the page, so that copies of an article on one host do not delete each other. Subtrees that hold
such an element are not judged, as they recur only with all of it.

Edge cases: null html is empty and gives an empty text. Unclosed and stray tags are tolerated, a cut tag at the end is
no text, and any nesting costs no more than as many tags side by side: what an end tag or the next item of a list
closes is known from counts of open elements. Repeated rows and repeated or null page_ids each give a row. A null
url is a host of its own. Extra columns are ignored. Counts are sums made map-side, so a host with a third of all
pages is no hot key.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from warraq.session import discard, materialize

SHARE, LEAST = 0.4, 5
STOCK, STOCK_SHARE, INNER_SHARE = 3, 0.15, 0.5
MARKED = 2
#: Recurring subtrees and slots that are sent to every task; more of them are joined by a shuffle.
BROADCAST_ROWS = 200_000

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>?|<\?[^>]*>?|<(script|style|noscript|template|textarea|title|svg|iframe)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.S | re.I,
)
#: Elements without content of their own.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var td th".split()) | _VOID - {"hr"}
_TEXTLESS = frozenset("script style noscript template button select option input textarea iframe object svg canvas head title".split())
_TEMPLATE = frozenset("nav header footer aside form dialog menu".split())
_OWN = frozenset(("article", "main"))
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Items that close each other: for each, the names an item closes and those that bound the search.
_ITEMS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPES = frozenset("ul ol dl table tbody thead select tr".split())
_GROUPS = sorted(set(_ITEMS.values()))
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Classes, ids and roles of what is not main text, in any place; and those that may name a part of an article.
_PLAIN = frozenset(
    "ad ads advert adverts advertisement breadcrumb breadcrumbs comment comments complementary contentinfo cookie cookies consent disqus login masthead menubar nav navbar navigation newsletter pager pagination popup promoted sidebar signup social sponsor sponsored subscribe toolbar".split()
)
_DOUBTFUL = frozenset("banner footer form header menu notice notices promo promotion related reply replies search share sharing widget".split())
_WORDS = re.compile(r"[a-z0-9]+")
_DIGITS = re.compile(r"[0-9]+")
_SPACE = re.compile(r"\s+")
#: After these, a word names what a layout has or lacks, not what the element is.
_LAYOUT = frozenset(("with", "has", "no", "without"))
_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:[\s=/]|$)", re.I)

#: How an element is marked: not at all, by a word in a longer name, by name.
NO, WEAK, STRONG = 0, 1, 2


def _named(name: str, attributes: str, inside: bool) -> tuple[str, int]:
    """What an element's tag, classes, id and role make of its slot, and how they mark it."""
    label, mark = [name], NO
    if name in _TEMPLATE and not (name == "header" and inside):
        mark = STRONG
    if attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            tokens = (m[2] or m[3] or m[4] or "").lower().split()
            label += sorted(_DIGITS.sub("0", x) for x in tokens)
            for token in tokens:
                if token in _PLAIN or token in _DOUBTFUL and not inside:
                    mark = STRONG
                elif mark == NO:
                    words = _WORDS.findall(token)
                    if any((w in _PLAIN or w in _DOUBTFUL) and (not k or words[k - 1] not in _LAYOUT) for k, w in enumerate(words)):
                        mark = WEAK
        if _HIDDEN.search(_QUOTED.sub("", attributes)):
            mark = STRONG
    free = name in _HEADINGS or name in _OWN or name in ("html", "body")
    return " ".join(label), NO if free else mark


class _Element:
    __slots__ = ("name", "skip", "own", "at", "size", "pending", "holds", "slot", "mark", "hidden")

    def __init__(self, name: str, skip: bool, own: bool, at: int, slot: int, mark: int):
        self.name, self.skip, self.own, self.at, self.slot, self.mark = name, skip, own, at, slot, mark
        #: Of an article or main: the length of its own text, and the subtrees in it that wait for its hash.
        self.size, self.pending = 0, []
        #: Whether an article or main with text stands inside.
        self.holds = False
        #: Of an element that marks itself: the hash of its text, which is not kept.
        self.hidden = None


class _Prefixes:
    """Hashes of any run of blocks in constant time, from a polynomial over the blocks' own hashes."""

    PRIME, BASE = (1 << 61) - 1, 0x1F3D5B79A2C4E68

    def __init__(self):
        self.totals, self.powers = [0], [1]

    def add(self, text: str) -> None:
        self.totals.append((self.totals[-1] * self.BASE + xxhash.xxh64_intdigest(text)) % self.PRIME)
        self.powers.append(self.powers[-1] * self.BASE % self.PRIME)

    def of(self, name: str, a: int, z: int) -> int:
        run = (self.totals[z] - self.totals[a] * self.powers[z - a]) % self.PRIME
        return _signed(f"{name} {z - a} {run}")


def _signed(x: str) -> int:
    return xxhash.xxh64_intdigest(x) - (1 << 63)


class _Open:
    """Which open elements an end tag or the next item of a list closes, without a look at the others."""

    def __init__(self):
        self.names = Counter()
        #: For each group of items, how many are open since the last element that bounds them.
        self.items = {g: [0] for g in _GROUPS}
        #: Inline elements open since the last block, and where on the stack the blocks are.
        self.inline, self.blocks = [Counter()], [0]

    def push(self, name: str, at: int) -> None:
        self.names[name] += 1
        if name in _INLINE:
            self.inline[-1][name] += 1
        else:
            self.inline.append(Counter())
            self.blocks.append(at)
        if name in _ITEMS or name in _SCOPES:
            for group, counts in self.items.items():
                if name in group:
                    counts[-1] += 1
                elif name in _SCOPES:
                    counts.append(0)

    def pop(self, name: str) -> None:
        self.names[name] -= 1
        if name in _INLINE:
            self.inline[-1][name] -= 1
        else:
            self.inline.pop()
            self.blocks.pop()
        if name in _ITEMS or name in _SCOPES:
            for group, counts in self.items.items():
                if name in group:
                    counts[-1] -= 1
                elif name in _SCOPES:
                    counts.pop()


def blocks(source: str, marks: bool = True) -> tuple[list[str], list[tuple[int, int, int, int, int, int]], int]:
    """The page's text blocks in order; the subtrees that counts may judge, each as the hashes of subtree and slot, what
    it counts once for, its mark doubled plus one inside an article, and the blocks it spans (from, to; none for one
    that marks itself); the hash of the page's lead. One pass, whatever the nesting."""
    root = _Element("", False, False, 0, 0, NO)
    stack, found, text, holders = [root], [], [], []
    subtrees: list[list] = []
    hashes, opened = _Prefixes(), _Open()
    lead: tuple[int, int | None] = (0, None)

    def end_block() -> None:
        if text:
            joined = _SPACE.sub(" ", html.unescape("".join(text))).strip()
            text.clear()
            if not joined:
                return
            if stack[-1].hidden is not None:
                stack[-1].hidden.update(joined.encode() + b"\n")
            elif not stack[-1].skip:
                found.append(joined)
                hashes.add(joined)
                if holders:
                    holders[-1].size += len(joined)

    def judged(e: _Element, h: int, a: int, z: int) -> None:
        subtrees.append([h, e.slot, None, 2 * e.mark + bool(holders), a, z])
        if holders:
            holders[-1].pending.append(subtrees[-1])

    def close(upto: int) -> None:
        nonlocal lead
        while len(stack) > upto:
            e = stack[-1]
            if e.name not in _INLINE:
                end_block()
            stack.pop()
            opened.pop(e.name)
            if e.own:
                holders.pop()
            stack[-1].holds |= e.holds or (e.own and e.at < len(found))
            if e.hidden is not None and e.hidden is not stack[-1].hidden:
                judged(e, _signed(f"{e.name} {e.hidden.intdigest()}"), 0, 0)
            if e.name in _INLINE or e.skip or e.at == len(found):
                continue
            h = hashes.of(f"{e.name} {e.mark}", e.at, len(found))
            if e.own:
                for x in e.pending:
                    x[2] = h
                if e.size > lead[0]:
                    lead = (e.size, h)
            elif not e.holds:
                judged(e, h, e.at, len(found))

    def listens() -> bool:
        return stack[-1].hidden is not None or not stack[-1].skip

    at = 0
    for m in _TOKEN.finditer(source):
        if m.start() > at and listens():
            text.append(source[at : m.start()])
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            continue
        inline = name in _INLINE
        if m[2]:
            if (opened.inline[-1] if inline else opened.names)[name] > 0:
                close(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].name == name))
            elif not inline:
                end_block()
            continue
        if inline:
            if name in ("br", "td", "th", "img"):
                text.append(" ")
        else:
            end_block()
            if name in _CLOSES_P and stack[opened.blocks[-1]].name == "p":
                close(opened.blocks[-1])
        if name in _ITEMS and opened.items[_ITEMS[name]][-1] > 0:
            close(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].name in _ITEMS[name]))
        if name in _VOID or m[4].endswith("/") and name not in _CLOSES_P:
            continue
        above = stack[-1]
        if above.skip:
            slot, mark, skip, hidden = above.slot, NO, True, None if name in _TEXTLESS else above.hidden
        else:
            label, mark = _named(name, m[4], bool(holders))
            mark = mark if marks else NO
            slot = above.slot if inline and mark == NO else _signed(f"{above.slot} {label} {mark}")
            skip = name in _TEXTLESS or mark == STRONG
            # Inline, it would cut a block in two; its text is left out uncounted.
            hidden = xxhash.xxh64() if mark == STRONG and not inline and name not in _TEXTLESS else None
        stack.append(_Element(name, skip, name in _OWN and not skip, len(found), slot, mark))
        stack[-1].hidden = hidden
        opened.push(name, len(stack) - 1)
        if stack[-1].own:
            holders.append(stack[-1])
    rest = source[at:]
    if rest and listens():
        text.append(rest)
    close(1)
    end_block()
    whole = hashes.of("", 0, len(found))
    # Without an article of its own, the page itself is what a template must leave alone.
    alone, of_page = lead[1] is None, whole if lead[1] is None else lead[1]
    return found, [(h, slot, of_page if once is None else once, kind | alone, a, z) for h, slot, once, kind, a, z in subtrees], of_page


def host(url) -> object:
    """The host part of a URL column, in lower case; empty without one."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#]*)", 1))


_PARTS = ("hash", "slot", "once", "kind", "a", "z")


def parse(pages: DataFrame, marks: bool = True) -> DataFrame:
    """(page_id, url, host, blocks, subtrees, lead) of every page."""
    judged = pa.struct([("hash", pa.int64()), ("slot", pa.int64()), ("once", pa.int64()), ("kind", pa.int8()), ("a", pa.int32()), ("z", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [blocks(x or "", marks) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"),
                    batch.column("url"),
                    batch.column("host"),
                    pa.array([b for b, _, _ in done], pa.list_(pa.string())),
                    pa.array([[dict(zip(_PARTS, x, strict=True)) for x in s] for _, s, _ in done], pa.list_(judged)),
                    pa.array([x for _, _, x in done], pa.int64()),
                ],
                ["page_id", "url", "host", "blocks", "subtrees", "lead"],
            )

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), host(F.col("url")).alias("host"), "html")
    return rows.mapInArrow(run, "page_id bigint, url string, host string, blocks array<string>, subtrees array<struct<hash:bigint,slot:bigint,once:bigint,kind:tinyint,a:int,z:int>>, lead bigint")


def templates(parsed: DataFrame, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """(host, hash) of the subtrees and slots that belong to a host's templates."""
    sizes = parsed.select("host", "lead").distinct().groupBy("host").agg(F.count("*").alias("n_articles"))
    each = F.array_distinct(F.transform("subtrees", lambda s: F.struct(*[s[c].alias(c) for c in _PARTS[:4]])))
    told = parsed.select("host", F.explode(each).alias("s")).select("host", "s.*")
    # Where a subtree is (its slot, and whether in an article) goes with it; a slot holds one mark only.
    found = materialize(told.groupBy("host", "hash", "slot", "once").agg(F.max("kind").alias("kind")).groupBy("host", "hash", "slot").agg(F.count("*").alias("k"), F.max("kind").alias("kind")))
    # Under one article a subtree may stand in two slots, so articles are counted apart where it has more than one.
    once = found.groupBy("host", "hash").agg(F.sum("k").alias("k"), F.count("*").alias("slots"))
    several = told.join(once.filter("slots > 1").select("host", "hash"), ["host", "hash"]).select("host", "hash", "once").distinct().groupBy("host", "hash").agg(F.count("*").alias("n"))
    counts = once.filter("slots = 1").select("host", "hash", F.col("k").alias("n")).unionByName(several)
    counted = materialize(counts)
    subtrees = counted.filter(F.col("n") >= least).join(sizes, "host").filter(F.col("n") >= share * F.col("n_articles")).select("host", "hash")
    recurring = counted.filter("n >= 2").withColumn("again", F.lit(1))
    filled = found.join(recurring, ["host", "hash"], "left").groupBy("host", "slot").agg(F.count("*").alias("fills"), F.count("again").alias("again"), F.sum("k").alias("k"), F.max("kind").alias("kind"))
    inner, marked = (F.col("kind") % 2 == 1), (F.floor(F.col("kind") / 2) >= WEAK)
    stock = (F.col("again") >= STOCK) & (F.col("again") >= F.when(inner, INNER_SHARE).otherwise(STOCK_SHARE) * F.col("fills"))
    slots = filled.filter(stock | marked & (F.col("k") >= MARKED) & (~inner | (F.col("again") >= 1))).select("host", F.col("slot").alias("hash"))
    out = materialize(subtrees.unionByName(slots).distinct())
    discard(found)
    discard(counted)
    return out


def extract(pages: DataFrame, share: float = SHARE, least: int = LEAST, marks: bool = True) -> DataFrame:
    """(page_id, url, text, n_chars): the blocks of each page without those of its host's templates."""
    parsed = materialize(parse(pages, marks))
    gone = templates(parsed, share, least)
    if gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        joined = parsed.join(F.broadcast(gone.groupBy("host").agg(F.collect_list("hash").alias("gone"))), "host", "left")
    else:
        # Which of its hashes are gone is looked up for a distinct (host, hashes) pair, not for each page.
        keyed = parsed.withColumn("hashes", F.array_sort(F.array_union("subtrees.hash", "subtrees.slot")))
        looked = keyed.select("host", "hashes").distinct().select("host", "hashes", F.explode("hashes").alias("hash")).join(gone, ["host", "hash"]).groupBy("host", "hashes").agg(F.collect_set("hash").alias("gone"))
        joined = keyed.join(looked, ["host", "hashes"], "left")
    # What is named by an arrow is evaluated once a page.
    kept = F.expr("""transform(array(array_intersect(array_union(subtrees.hash, subtrees.slot), coalesce(gone, cast(array() AS array<bigint>)))), here ->
      transform(array(filter(subtrees, s -> s.z > s.a AND (array_contains(here, s.hash) OR array_contains(here, s.slot)))), spans -> filter(blocks, (b, i) -> not exists(spans, s -> s.a <= i and i < s.z)))[0])[0]""")
    text = F.array_join(kept, "\n\n")
    return joined.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op9(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
