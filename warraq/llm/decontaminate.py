"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact check.

A window of a document, as many words long as a benchmark item, is contaminated by that item where the
weighted Jaccard similarity of their 5-word shingles (sum of least over sum of greatest counts) is at
least 0.75. The sum of both lists' sizes is known, so a similar window holds at least a known number of
shingles of items of its length, wherever they stand in it: every window with so many is laid, and no other
can be similar. Which item a window is near, its fingerprint tells.

A fingerprint is a SimHash of ``BITS`` = 256 bits. The k-th occurrence of a shingle is a feature of its own, so the
angle between two fingerprints follows the weighted similarity. It is cut into 16 blocks of 16 bits; an item is
indexed under every value within ``PROBE`` = 2 bits of each of its blocks, and a window is looked up by its 16
blocks. Every pair within a Hamming distance of 16 * 3 - 1 = 47 agrees with such a value by the pigeonhole
principle; a farther pair, up to ``RADIUS``, does with a chance that falls slowly. At the threshold a bit differs
with chance 0.172, so the distance is 44 on average with a deviation of 6: the chance that all blocks miss is
1 in 20,000, that the distance is above the radius 1 in 25,000, and both fall fast with more similarity. An unrelated
pair meets in one of its blocks in 3 of 100 cases.

What fingerprints leave to chance, an exact path provides: of two lists with similarity 0.75 or more, each holds at least
that share of its own features in common, so the first quarter of the one's features and one more, by hash, meets that of the
other. Windows and items meet by these, too, so no similar pair is missed. Shingle lists then decide exactly.

Scale. Documents meet the shingles of the benchmark by a hash join (broadcast only below
``BROADCAST_ROWS`` and, where rows hold lists, ``BROADCAST_LONGS`` values in all; else shuffled), texts and windows by content, so a passage, or a text, that a third of all
documents share is fingerprinted and looked up once. All texts are read twice: once cut into runs of all the items' sizes, once
to fetch the few that hold enough of an item, of which alone the windows are laid. Words and shingles never leave their row otherwise.

Edge cases: null or blank texts and items match nothing. Items of fewer than five words are one shingle
of their length, and are sought as runs of that many words. A document shorter than an item is one
window. A long item costs a sort and a set of its shingles a pair, as a short one does. Ties take the first window. Repeated rows of a document give one row, and so do rows of one doc_id with
different texts (their best window); a null doc_id is reported as null, once an item. ``clean`` judges each row by
its own text, whatever its doc_id. Repeated items are reported one each by their item_id. Extra columns are
ignored, and kept by ``clean``; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from warraq.llm.quality_rules import words_of
from warraq.session import materialize, settled

SIZE, PERCENT, BROADCAST_ROWS, BROADCAST_LONGS = 5, 75, 200_000, 8_000_000
WORDS, BLOCK, PROBE, RADIUS = 4, 16, 2, 68
BITS = 64 * WORDS


def _runs(words: str, size: str) -> str:
    """SQL for the hashes of all runs of ``size`` words, in order."""
    return f"if(size({words}) < {size}, array(), transform(sequence(0, size({words}) - {size}), i -> xxhash64({', '.join(f'if({k} < {size}, get({words}, i + {k}), null)' for k in range(SIZE))})))"


def _features(hashes: str) -> str:
    """SQL for hashes of which the k-th occurrence of one is another feature than the first.

    Equal hashes stand together once sorted; each run is numbered from where it begins, so the work is that of one sort."""
    begins = "filter(sequence(0, size(s) - 1), i -> i = 0 or get(s, i) != get(s, i - 1))"
    run = "transform(sequence(0, coalesce(get(b, j + 1), size(s)) - a - 1), k -> if(k = 0, get(s, a), xxhash64(get(s, a), k)))"
    numbered = f"transform(array(sort_array({hashes})), s -> transform(array({begins}), b -> flatten(transform(b, (a, j) -> {run})))[0])[0]"
    return f"if(size(array_distinct({hashes})) = size({hashes}), {hashes}, {numbered})"


def fingerprint(hashes: str) -> str:
    """SQL for the SimHash of a list of shingle hashes, as an array of longs.

    Four counters of 16 bits share a long, so one fold counts four bits of all features; longer lists are counted bit by bit."""
    lanes = "aggregate(f, 0L, (s, h) -> s + (shiftrightunsigned(h, k) & 281479271743489L))"
    most = " | ".join(f"if(2 * (shiftrightunsigned(c, {16 * l}) & 65535L) > size(f), {1 << 16 * l}L, 0L)" for l in range(4))  # noqa: E741
    short = f"aggregate(sequence(0, 15), 0L, (acc, k) -> acc | shiftleft(transform(array({lanes}), c -> {most})[0], k))"
    long = "aggregate(sequence(0, 63), 0L, (acc, b) -> acc | if(aggregate(f, 0, (s, h) -> s + 2 * cast(getbit(h, b) AS int) - 1) > 0, shiftleft(1L, b), 0L))"
    return f"transform(array({_features(hashes)}), d -> transform(sequence(1, {WORDS}), j -> transform(array(transform(d, h -> xxhash64(h, j))), f -> if(size(f) < 65536, {short}, {long}))[0]))[0]"


#: What a block within ``PROBE`` bits of another differs by.
_MASKS = [sum(1 << b for b in c) for n in range(PROBE + 1) for c in combinations(range(BLOCK), n)]
_BLOCK = f"cast(shiftrightunsigned(get(fp, k div {64 // BLOCK}), {BLOCK} * (k % {64 // BLOCK})) & {(1 << BLOCK) - 1}L AS int)"
#: SQL for the (number, value) pairs under which an item's fingerprint ``fp`` is indexed, and those by which a window's is looked up.
INDEXED = f"flatten(transform(sequence(0, {BITS // BLOCK - 1}), k -> transform(array({', '.join(map(str, _MASKS))}), m -> named_struct('k', k, 'v', {_BLOCK} ^ m))))"
LOOKED_UP = f"transform(sequence(0, {BITS // BLOCK - 1}), k -> named_struct('k', k, 'v', {_BLOCK}))"
DISTANCE = " + ".join(f"bit_count(get(fp, {j}) ^ get(item_fp, {j}))" for j in range(WORDS))


def _all_runs(sizes: list[int]) -> str:
    """SQL for the hashes of all runs of all these sizes, one size after another."""
    return f"concat({', '.join(_runs('w', str(x)) for x in sizes)})"


def _size_at(sizes: list[int]) -> str:
    """SQL for the size and place of the run at ``q`` of ``_all_runs``, from the number of words ``n``."""
    out, before = "", "0"
    for size in sizes:
        own = f"named_struct('size', {size}, 'p', q - ({before}))"
        before += f" + greatest(0, n - {size - 1})"
        out += own if size == sizes[-1] else f"if(q < {before}, {own}, "
    return out + ")" * (len(sizes) - 1)


def _lower_words(text: str) -> Column:
    return words_of(F.lower(F.col(text)))


def items_of(benchmark: DataFrame) -> DataFrame:
    """(item_id, length, size, item): the shingles of every item that has words."""
    rows = benchmark.select("item_id", _lower_words("text").alias("w")).filter("size(w) > 0")
    return rows.select("item_id", F.size("w").alias("length"), F.least(F.size("w"), F.lit(SIZE)).alias("size"), "w").withColumn("item", F.expr(_runs("w", "size"))).drop("w")


#: SQL for the starts of all windows of ``length`` words that hold ``need`` of the ascending places ``at``
#: or more: start is above the place before the k-th and not above the k-th, and the need-th from there is inside.
_STARTS = """flatten(transform(filter(transform(if(size(at) < need, array(), sequence(0, size(at) - need)),
  k -> named_struct('a', greatest(0, coalesce(get(at, k - 1), -1) + 1, get(at, k + need - 1) - (length - size)), 'b', least(get(at, k), greatest(0, n - length)))), x -> x.a <= x.b), x -> sequence(x.a, x.b)))"""
#: SQL for the least number of shared shingles at the threshold.
_NEED = f"({PERCENT} * (least(n, length) - size + 1 + length - size + 1) + {100 + PERCENT - 1}) div {100 + PERCENT}"


def _near(df: DataFrame, longs: str = "0") -> DataFrame:
    """A broadcast of a frame of few rows whose lists, of so many ``longs`` a row, are short in all; else the frame."""
    told = df.select(F.expr(longs).cast("long").alias("n")).limit(BROADCAST_ROWS + 1).agg(F.count("*").alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("longs")).first()
    return F.broadcast(df) if told["rows"] <= BROADCAST_ROWS and told["longs"] <= BROADCAST_LONGS else df


def _shared(a: str, b: str) -> str:
    """SQL for the sum of the least counts of each shingle in two lists: the features that both have."""
    return f"size(array_intersect({_features(a)}, {_features(b)}))"


def _row() -> Column:
    """Rows with one text are one."""
    return F.xxhash64("text")


def _windows(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """(row, length, start, win, key) of every window that may be similar to an item of its length, and (row,
    doc_id) of the documents they are in; none without items."""
    sizes = sorted(r[0] for r in items.select("size").distinct().collect())  # five at most
    if not sizes:
        return None
    seeds = materialize(items.select("length", "size", F.explode("item").alias("h")).distinct())
    texts = docs.select("doc_id", _row().alias("row"), "text")
    worded = texts.select("row", _lower_words("text").alias("w")).select("row", F.size("w").alias("n"), F.posexplode(F.expr(_all_runs(sizes))).alias("q", "h"))
    runs = worded.select("row", "n", "h", F.expr(_size_at(sizes)).alias("x")).select("row", "n", "h", "x.size", "x.p")
    hits = runs.join(_near(seeds), ["size", "h"])
    held = hits.groupBy("row", "n", "length", "size").agg(F.array_sort(F.collect_set("p")).alias("at")).withColumn("need", F.expr(f"cast({_NEED} as int)"))
    places = materialize(held.select("row", "length", "size", F.expr(_STARTS).alias("starts")).filter("size(starts) > 0"))
    per_row = places.groupBy("row").agg(F.collect_list(F.struct("length", "size", "starts")).alias("at"))
    found = materialize(texts.join(_near(per_row, "aggregate(at, 0, (s, x) -> s + size(x.starts))"), "row").select("row", "doc_id", _lower_words("text").alias("w"), "at"))
    once = found.drop("doc_id").dropDuplicates(["row"])
    windows = None
    for size in sizes:
        laid = once.select("row", F.size("w").alias("n"), F.expr(_runs("w", str(size))).alias("runs"), F.explode(F.expr(f"filter(at, x -> x.size = {size})")).alias("x"))
        part = laid.select("row", "n", "runs", "x", F.explode("x.starts").alias("start")).select("row", "x.length", "start", F.expr("slice(runs, start + 1, least(n, x.length) - x.size + 1)").alias("win"))
        windows = part if windows is None else windows.unionByName(part)
    return materialize(windows.withColumn("key", F.xxhash64("win"))), found.select("row", "doc_id")


def _leading(hashes: str) -> str:
    """SQL for the least features of a list, by hash, of which every list that is similar has one among its own."""
    return f"transform(array({_features(hashes)}), f -> slice(sort_array(f), 1, size(f) - (size(f) * {PERCENT} + 99) div 100 + 1))[0]"


def _sharing(distinct: DataFrame, items: DataFrame) -> DataFrame:
    """(length, key, item_id): windows and items that have a leading feature in common, as every similar pair has."""
    mine = items.select("item_id", "length", F.explode(F.expr(_leading("item"))).alias("h"))
    theirs = distinct.select("length", "key", F.explode(F.expr(_leading("win"))).alias("h"))
    return theirs.join(_near(mine), ["length", "h"]).select("length", "key", "item_id")


def _near_pairs(distinct: DataFrame, items: DataFrame) -> DataFrame:
    """(length, key, item_id): windows (length, key, win) and items whose fingerprints are within the radius, by block,
    and those that share a leading feature."""
    printed = materialize(distinct.select("length", "key", F.expr(fingerprint("win")).alias("fp")))
    indexed = materialize(items.select("item_id", "length", F.expr(fingerprint("item")).alias("fp")))
    blocks = indexed.select("item_id", "length", F.explode(F.expr(INDEXED)).alias("b")).select("item_id", "length", "b.k", "b.v")
    probes = printed.select("length", "key", F.explode(F.expr(LOOKED_UP)).alias("b")).select("length", "key", "b.k", "b.v")
    met = probes.join(_near(blocks), ["length", "k", "v"]).select("length", "key", "item_id").distinct()
    both = met.join(printed, ["length", "key"]).join(_near(indexed.select("item_id", "length", F.col("fp").alias("item_fp"))), ["item_id", "length"])
    return both.filter(F.expr(DISTANCE) <= RADIUS).select("length", "key", "item_id").unionByName(_sharing(distinct, items)).distinct()


def _hits(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """(row, item_id, start, similarity) of every similar window, and (row, doc_id)."""
    items = materialize(items_of(benchmark))
    laid = _windows(docs, items)
    if laid is None:
        return None
    windows, found = laid
    distinct = windows.groupBy("length", "key").agg(F.first("win").alias("win"))
    near = _near_pairs(distinct, items)
    judged = near.join(distinct, ["length", "key"]).join(_near(items.select("item_id", "length", "item"), "size(item)"), ["item_id", "length"]).withColumn("least", F.expr(_shared("win", "item"))).withColumn("most", F.expr("size(win) + size(item) - least"))
    alike = judged.filter(F.col("least") * 100 >= F.col("most") * PERCENT).select("length", "key", "item_id", (F.col("least") / F.col("most")).alias("similarity"))
    return materialize(windows.drop("win").join(alike, ["length", "key"]).select("row", "item_id", "start", "similarity")), found


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, similarity): the best window of each document for each item in it."""
    told = _hits(docs, benchmark)
    if told is None:
        return docs.select("doc_id", F.lit(0).cast("long").alias("item_id"), F.lit(0).alias("start"), F.lit(0.0).alias("similarity")).filter("false")
    pairs, found = told
    best = F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("best")
    per_row = pairs.groupBy("row", "item_id").agg(best).select("row", "item_id", "best.similarity", (-F.col("best.back")).alias("start"))
    return found.join(_near(per_row), "row").groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", (-F.col("best.back")).alias("start"), "best.similarity")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a contaminated window."""
    told = _hits(docs, benchmark)
    if told is None:
        return docs
    gone = told[0].select(F.col("row").alias("__row")).distinct()
    return docs.withColumn("__row", _row()).join(_near(gone), "__row", "left_anti").select(*docs.columns)


def op6(spark, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return settled(spark, lambda: contaminated(docs.select("doc_id", "text"), benchmark))


#: The same by definition, without fingerprints: every window of a document is compared with an item, unless the
#: whole document holds too few of its shingles for any window.
OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^ 	-
]+') AS w FROM documents),
i AS (SELECT item_id, w, len(w) AS length, least(len(w), 5) AS size FROM (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[^ 	-
]+') AS w FROM benchmark) WHERE len(w) > 0),
s AS (SELECT item_id, length, size, array_to_string(w[q + 1 : q + size], ' ') AS g FROM (SELECT *, unnest(range(0, length - size + 1)) AS q FROM i)),
r AS (SELECT doc_id, len(w) AS n, p, size, array_to_string(w[p + 1 : p + size], ' ') AS g
  FROM (SELECT doc_id, w, size, unnest(range(0, len(w) - size + 1)) AS p FROM d, (SELECT DISTINCT size FROM s))),
b AS (SELECT item_id, length, size, g, count(*) AS y FROM s GROUP BY ALL),
t AS (SELECT item_id, sum(y) AS total FROM b GROUP BY ALL),
o AS (SELECT doc_id, n, item_id, length, b.size, sum(least(x, y)) AS held FROM (SELECT doc_id, n, size, g, count(*) AS x FROM r GROUP BY ALL) x JOIN b ON x.size = b.size AND x.g = b.g GROUP BY ALL),
c AS (SELECT o.*, unnest(range(0, greatest(n - length, 0) + 1)) AS start FROM o JOIN t USING (item_id) WHERE 100 * held >= 75 * (least(n, length) - size + 1 + total - held)),
v AS (SELECT c.doc_id, item_id, start, g FROM (SELECT *, unnest(range(0, least(n, length) - size + 1)) AS k FROM c) c JOIN r ON r.doc_id = c.doc_id AND r.size = c.size AND r.p = start + k),
a AS (SELECT doc_id, item_id, start, g, count(*) AS x FROM v GROUP BY ALL),
m AS (SELECT doc_id, a.item_id, start, sum(least(x, coalesce(y, 0))) AS low, sum(x) AS mine FROM a LEFT JOIN b ON a.item_id = b.item_id AND a.g = b.g GROUP BY ALL),
f AS (SELECT doc_id, m.item_id, start, low::DOUBLE / (mine + total - low) AS similarity FROM m JOIN t ON m.item_id = t.item_id WHERE 100 * low >= 75 * (mine + total - low))
SELECT doc_id, item_id, start::INTEGER AS start, similarity FROM f
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) = 1
"""
