"""Near-duplicate groups by bottom-k sketches from one hash function.

A text's set of hashed shingles is sketched by its ``K`` smallest hashes. Texts with equal sets form
one class. Classes that share a sketch value meet in that value's inverted list; the sketch of their
union estimates the similarity, and what is not far below the threshold is verified on the full sets
as integers: ``100 * intersection >= 75 * union``. Links form components, labelled by their smallest
doc_id.

Scale. One pass hashes the texts; 16 values a class travel, not texts, and 128 for members of long
lists. Lists of at most ``SHORT`` classes are joined pairwise. A longer list, as a common passage makes, is taken apart:
its members meet anew by the values of their wide sketches, rarest first, and only by as many as a partner cannot do
without (a prefix filter), so texts with nothing but the passage in common do not meet. What is still long is a family
of near copies. All lists of a family are one crowd, whose pairs are looked at once, unless its lists hold fewer
pairs: then each list is a crowd, and a pair is looked at only in the first list that it shares. A crowd is
cut into blocks; each pair of blocks is compared inside one task as an incidence matrix, which first
names the members that may have a partner and then, for those alone, verifies full sets and gives
out links that join them (a tree of small fan-out for each group), so no step gives out all pairs of a crowd.
Nothing is capped: a pair at the
threshold shares no value, or fewer than ``LEAST`` of them, once in about four million cases, and
falls ``SLACK`` deviations below the threshold in a wide sketch once in a million. A crowd of M classes is sent
out M / ``BLOCK`` times, which is the price of an exact answer where M different texts are so alike.

Sets count as equal if two 64-bit hashes of them are.

Edge cases: null or blank texts have an empty set and link with nothing; with fewer than five words
the whole sequence is one shingle. Repeated rows fall into one class; a null doc_id takes its
component's label where others name it, and is kept only if none does. Extra columns are ignored.
An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from warraq.llm.shingles import set_hash, sets
from warraq.session import discard, materialize

K, WIDE, SHORT, BLOCK, PERCENT = 16, 128, 48, 1024, 75
#: Edges below a member of a group's tree.
FAN = 32
#: Shared values among the K smallest of a union, below which a pair isn't verified.
LEAST = 3
#: Standard deviations below the threshold at which an estimate from wide sketches still goes on to be verified.
SLACK = 4.75
#: Shared values of two wide sketches, one of them full, below which no estimate goes on.
ENOUGH = math.ceil(PERCENT / 100 * WIDE - SLACK * math.sqrt(PERCENT / 100 * (1 - PERCENT / 100) * WIDE))


def row_key() -> Column:
    """Rows that agree in doc_id and text are one."""
    return F.xxhash64("doc_id", "text")


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, row_key, n, node, check, sketch, wide): the size of the set, two hashes of it and its K and WIDE smallest hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, node, check, sketch, wide = [], [], [], [], []
            for s in sets(batch.column("text")):
                n.append(len(s))
                node.append(set_hash(s) if len(s) else None)
                check.append(set_hash(s, other=True) if len(s) else None)
                sketch.append(s[:K])
                wide.append(s[:WIDE].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column("row_key"), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(check, pa.int64()), pa.array(sketch, pa.list_(pa.int64())), pa.array(wide, pa.binary())],
                ["doc_id", "row_key", "n", "node", "check", "sketch", "wide"],
            )

    return docs.select("doc_id", "text", row_key().alias("row_key")).mapInArrow(run, "doc_id bigint, row_key bigint, n bigint, node bigint, check bigint, sketch array<bigint>, wide binary")


def told_apart(rows: DataFrame) -> DataFrame:
    """Rows whose sets differ though their first hash is the same: all but one kind take their second as node."""
    seen = rows.filter("node is not null").groupBy("node").agg(F.min("check").alias("least"), F.max("check").alias("most"))
    clash = materialize(seen.filter("least <> most").select("node", "least"))
    if clash.isEmpty():
        return rows
    return rows.join(clash, "node", "left").withColumn("node", F.when(F.col("check") != F.col("least"), F.col("check")).otherwise(F.col("node"))).drop("least")


def _full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, hashes) of the nodes wanted, each from the text of the row named as its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, hashes = [], []
            for want, s in zip(batch.column("node").to_pylist(), sets(batch.column("text")), strict=True):
                if len(s) and want in (set_hash(s), set_hash(s, other=True)):
                    node.append(want)
                    hashes.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(hashes, pa.binary())], ["node", "hashes"])

    rows = docs.select(row_key().alias("row_key"), "text").join(wanted, "row_key").select("node", "text")
    return rows.mapInArrow(run, "node bigint, hashes binary").dropDuplicates(["node"])


def _estimate(a, b):
    """Shared values among the K smallest of the union of two sketches."""
    smallest = F.slice(F.array_sort(F.array_union(a, b)), 1, K)
    return F.size(F.array_intersect(F.array_intersect(a, b), smallest))


def _incidence(values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each value in a matrix of members by distinct values; values of one member are left out."""
    sizes = np.fromiter(map(len, values), np.int64, len(values))
    flat = np.concatenate(values) if len(values) else np.empty(0, np.int64)
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(values)), sizes)
    shared = count[column] > 1
    return row[shared], np.unique(column[shared], return_inverse=True)[1] if shared.any() else column[shared]


def overlaps(values: list[np.ndarray], width: int = 8192) -> np.ndarray:
    """Sizes of all pairwise intersections of a block's sets."""
    row, column = _incidence(values)
    out = np.zeros((len(values), len(values)), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    top = int(column[-1]) + 1 if len(column) else 0
    for lo in range(0, top, width):
        a, b = np.searchsorted(column, [lo, lo + width])
        m = np.zeros((len(values), min(width, top - lo)), np.float32)
        m[row[a:b], column[a:b] - lo] = 1
        out += m @ m.T
    return out


def _across(side: np.ndarray) -> np.ndarray:
    """The pairs a block pair is in charge of: across its two sides, or all within one."""
    two = len(set(side.tolist())) == 2
    return (side[:, None] != side[None, :]) if two else ~np.eye(len(side), dtype=bool)


def _may_link(before: list[np.ndarray], wide: list[np.ndarray], n: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Pairs of a crowd that the wide sketches don't rule out, and that share none of the values before its own.

    Up to the lesser of two sketches' ends both sets are known, so the shared part of their union there
    estimates the similarity; where it ends both sets, it is the similarity."""
    pairs = _across(side) & (np.minimum.outer(n, n) * 100 >= np.maximum.outer(n, n) * PERCENT)
    pairs &= overlaps(before) == 0
    shared = overlaps(wide).astype(np.float64)
    ends = np.array([s[-1] if k > WIDE else np.iinfo(np.int64).max for s, k in zip(wide, n.tolist(), strict=True)])
    end = np.minimum.outer(ends, ends)
    below = np.stack([np.searchsorted(s, row, "right") for s, row in zip(wide, end, strict=True)])
    union = below + below.T - shared
    whole = end == np.iinfo(np.int64).max
    share = PERCENT / 100
    return pairs & (shared >= share * union - np.where(whole, 0, SLACK * np.sqrt(share * (1 - share) * union)))


def _members(frame: DataFrame) -> DataFrame:
    """Spreads a crowd's members over the pairs of its blocks."""
    blocks = frame.withColumn("nb", F.ceil(F.col("m") / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("node", F.lit(7)), F.col("nb")).cast("int"))
    other = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    return other.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("other", "nb", "m")


def _lists(postings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The postings (v, node, n) of short lists, and of long ones with their length m."""
    counts = postings.groupBy("v").agg(F.count("*").alias("m")).filter("m > 1")
    return postings.join(counts.filter(F.col("m") <= SHORT).select("v"), "v"), postings.join(counts.filter(F.col("m") > SHORT), "v")


def _rare_first(nodes: DataFrame) -> DataFrame:
    """(node, n, rare) as a written table: of the values in each wide sketch those, rarest first, one of which it shares with
    every partner. A pair that ``_may_link`` lets through shares 3/4 of the larger set, or ``ENOUGH`` values where one
    set is cut; a value with fewer after it is not the first one shared. A node with fewer values that others hold has no partner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 1000):
                part = batch.slice(lo, 1000)
                values = [np.frombuffer(x.as_buffer(), np.int64) for x in part.column("wide")]
                at = pa.array(np.repeat(np.arange(len(values)), [len(x) for x in values]))
                yield pa.RecordBatch.from_arrays([part.column("node").take(at), part.column("n").take(at), pa.array(np.concatenate(values))], ["node", "n", "v"])

    values = materialize(nodes.select("node", "n", "wide").mapInArrow(run, "node bigint, n bigint, v bigint"))
    seen = values.groupBy("v").agg(F.count("*").alias("m")).filter("m > 1")
    shared = values.hint("merge").join(seen, "v").groupBy("node").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("m", "v"))).alias("shared"))
    free = F.size("shared") - F.least(F.ceil(F.col("n") * PERCENT / 100), F.lit(ENOUGH)).cast("int")
    out = materialize(shared.filter(free >= 0).select("node", "n", F.slice("shared.v", F.lit(1), free + 1).alias("rare")))
    discard(values)
    return out


def _crowds(many: DataFrame, rare: DataFrame) -> DataFrame:
    """(v, node, m, before) as a written table: nodes that long lists (v, node, n, m) join are one crowd of m, or one a
    list where that makes fewer pairs; before: the values that no pair of this crowd may share."""
    heads = materialize(many.groupBy("v", "m").agg(F.min("node").alias("node")))
    roots = materialize(components(many.select("v", "node").join(heads.select("v", F.col("node").alias("a")), "v").select("a", F.col("node").alias("b"))))
    pairs = heads.join(roots, "node").groupBy("root").agg(F.sum(F.col("m").cast("double") * F.col("m")).alias("apart"))
    kinds = roots.groupBy("root").agg(F.count("*").alias("size")).join(pairs, "root")
    kinds = materialize(kinds.select("root", "size", (F.col("size").cast("double") * F.col("size") <= F.col("apart")).alias("whole")))
    of = roots.join(kinds, "root")
    whole = of.filter("whole").select(F.col("root").alias("v"), "node", F.col("size").alias("m"), F.array().cast("array<bigint>").alias("before"))
    # Files of postings and arrays are far smaller than their rows, so Spark would broadcast too much.
    apart = many.hint("merge").join(of.filter("not whole").select("node"), "node").join(rare.select("node", "rare").hint("merge"), "node")
    crowds = materialize(whole.union(apart.select("v", "node", "m", F.slice("rare", F.lit(1), F.array_position("rare", F.col("v")).cast("int") - 1))))
    for used in (heads, roots, kinds):
        discard(used)
    return crowds


def _long_lists(crowds: DataFrame, nodes: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    spread = _members(crowds.hint("merge").join(nodes.select("node", "n", "wide"), "node"))

    def flag(keys: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        v, i, j = keys
        may = _may_link([np.asarray(x, np.int64) for x in frame["before"]], [np.frombuffer(x, np.int64) for x in frame["wide"]], frame["n"].to_numpy(), frame["own"].to_numpy())
        kept = frame.loc[may.any(axis=1), ["node", "n", "own"]]
        return kept.assign(v=v, i=i, j=j)[["v", "i", "j", "own", "node", "n"]]

    flagged = materialize(spread.groupBy("v", "i", "j").applyInPandas(flag, "v bigint, i int, j int, own int, node bigint, n bigint"))
    wanted = flagged.select("node").distinct().join(nodes, "node").select("node", "row_key")
    full = flagged.join(_full_sets(docs, wanted), "node")

    def verify(keys: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        members = [np.frombuffer(x, np.int64) for x in frame["hashes"]]
        n, node = np.fromiter(map(len, members), np.int64, len(members)), frame["node"].to_numpy()
        both = overlaps(members).astype(np.int64)
        linked = _across(frame["own"].to_numpy()) & (both * 100 >= (n[:, None] + n[None, :] - both) * PERCENT)
        # What is linked, directly or not, is given out as a tree in which no member has many edges.
        left, edges = set(range(len(members))), []
        while left:
            group = [left.pop()]
            for at in group:
                near = [k for k in np.flatnonzero(linked[at]).tolist() if k in left]
                left.difference_update(near)
                group += near
            held = sorted(node[group].tolist())
            edges += [(held[(k - 1) // FAN], held[k]) for k in range(1, len(held))]
        return pd.DataFrame(edges, columns=["a", "b"]).astype("int64")

    return flagged, full.groupBy("v", "i", "j").applyInPandas(verify, "a bigint, b bigint")


def _short_lists(postings: DataFrame, nodes: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    a, b = postings.select("v", F.col("node").alias("a"), F.col("n").alias("na")), postings.select("v", F.col("node").alias("b"), F.col("n").alias("nb"))
    met = a.join(b, "v").filter((F.col("a") < F.col("b")) & (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * PERCENT)).select("a", "b").distinct()
    sketch = nodes.select("node", "n", "sketch")
    with_a = met.join(sketch.toDF("a", "na", "sa"), "a")
    both = with_a.join(sketch.toDF("b", "nb", "sb"), "b")
    pairs = materialize(both.filter((F.least("na", "nb") < K) | (_estimate(F.col("sa"), F.col("sb")) >= LEAST)).select("a", "b"))
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(nodes, "node").select("node", "row_key")
    full = materialize(_full_sets(docs, wanted))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("ha"), batch.column("hb"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.int64), np.frombuffer(y.as_buffer(), np.int64)
                z = np.concatenate((x, y))
                z.sort(kind="stable")
                both = int((z[1:] == z[:-1]).sum())
                ok.append(100 * both >= PERCENT * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    checked = pairs.hint("merge").join(full.toDF("a", "ha"), "a").join(full.toDF("b", "hb"), "b").mapInArrow(verify, "a bigint, b bigint")
    return pairs, full, checked


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge, the root being the smallest node it can reach, by
    alternating large-star and small-star steps until nothing changes (some log2(n)**2 rounds at most; each
    lowers the sum of the edges' ends or is the last).

    A node's least neighbour is a written table, so both sides of the join are plain shuffles and Spark's skew
    join splits a hub's edges over tasks; what is summed up per node is summed before it travels."""
    both = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    tables: list[DataFrame] = []

    def kept(df: DataFrame) -> DataFrame:
        tables.append(materialize(df))
        return tables[-1]

    def large(e: DataFrame) -> DataFrame:
        near = both(e)
        least = kept(near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        # Only a neighbour above the node moves.
        return near.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()

    def small(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = kept(down.groupBy("a").agg(F.min("b").alias("m")))
        return down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()

    state = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    now = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while (after := state(now)) != seen:
        seen = after
        then = materialize(small(large(now)))
        for used in (now, *tables):
            discard(used)
        tables.clear()
        now = then
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def near_dups(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, row_key) for every row of ``docs``."""
    rows = told_apart(materialize(sketches(docs)))
    nodes = materialize(rows.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("row_key").alias("row_key"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("wide").alias("wide")))
    few, many = _lists(nodes.select(F.explode("sketch").alias("v"), "node", "n"))
    met = materialize(many.select("node").distinct())
    rare = _rare_first(nodes.join(met, "node"))
    rare_few, rare_many = _lists(rare.select(F.explode("rare").alias("v"), "node", "n"))
    postings = materialize(few.union(rare_few.select(F.xxhash64("v"), "node", "n")))
    pairs, full, checked = _short_lists(postings, nodes, docs)
    short = materialize(checked)
    for used in (met, postings, pairs, full):
        discard(used)
    lists = materialize(rare_many)
    crowds = _crowds(lists, rare)
    flagged, linked = _long_lists(crowds, nodes, docs)
    long = materialize(linked)
    for used in (rare, lists, crowds, flagged):
        discard(used)
    edges = short.union(long)
    roots = components(edges)
    named = roots.join(nodes.select("node", "doc_id"), "node")
    labels = named.join(named.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").select("node", "component_id")
    # A written table, so that the join below is of two plain shuffles and Spark can split a text with many copies.
    alone = materialize(nodes.select("node", "doc_id").join(labels, "node", "left").select("node", F.coalesce("component_id", "doc_id").alias("component_id")))
    out = rows.select("doc_id", "row_key", "n", "node").join(alone, "node", "left")
    label = F.coalesce("component_id", "doc_id")
    told = materialize(out.select("doc_id", F.col("n").alias("n_shingles"), label.alias("component_id"), F.coalesce(F.col("doc_id") == label, label.isNull()).alias("kept"), "row_key"))
    for used in (rows, nodes, short, long, alone):
        discard(used)
    return told


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group, with the columns it came with; repeated rows become one."""
    kept = near_dups(docs).filter("kept").select(F.col("row_key").alias("__key")).distinct()
    return docs.withColumn("__key", row_key()).join(kept, "__key", "left_semi").dropDuplicates(["__key"]).select(*docs.columns)


def op10(spark, sf_dir: str) -> DataFrame:
    return near_dups(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("row_key")


#: The same by definition: all pairs with a shingle in common, and the closure of their links.
OP10_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(g) AS g FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS g FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
l AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT l.y, r.c FROM r JOIN l ON r.doc_id = l.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m USING (doc_id)
"""
