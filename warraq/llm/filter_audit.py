"""What each filter of a chain removes, in every order of the filters, from one pass over the texts.

Native expressions give each document a mask of the filters it fails; a group-by of text digests gives the
least doc_id of each text, which the copies' filter needs. Documents with one mask behave alike in every
order, so counts by part and mask (32 cells for five filters) hold all there is to know, and every order,
step and Shapley value is a sum over a part's cells. Only (part, digest, doc_id, mask) is shuffled, no text.

A row is the first of its text if it joins its text's least doc_id on digest and doc_id together, so a
text that a third of all rows share is dealt out by doc_id, and its minimum is taken map-side before.

Edge cases: null text counts as empty, null part as the empty string. A null doc_id is smaller than none and
larger than none, so its row is never a copy and makes none; rows that repeat a doc_id with the same text are
not copies of each other either. Labels of one doc_id count once: good or toxic if any of them says so; a
null label or doc_id says nothing. Extra columns are ignored, whatever their names. An empty table has no
parts and gives no rows.
"""

from __future__ import annotations

from itertools import permutations
from math import lcm

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from warraq.session import materialize

MIN_WORDS, DISTINCT_PERCENT, UPPER_PERCENT = 200, 50, 3
#: Characters that filter D refuses, and those that end a word, as patterns (fixed values).
REFUSED, SPACE = r"[#$%&*|]", r"[\x20\x09-\x0D]+"
#: The filters by letter; the copies' filter is decided table-wide and not by the text alone.
LETTERS, COPIES = "ABCDE", "E"


def failures(text: Column) -> dict[str, Column]:
    """For each filter that looks at the text alone, whether the text fails it."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    # The words are split once: what an array of one element holds is evaluated before its elements are.
    counts = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("all"), F.size(F.array_distinct(w)).alias("distinct")))[0]
    upper = F.octet_length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": counts["all"] < MIN_WORDS,
        "B": 100 * counts["distinct"] < DISTINCT_PERCENT * counts["all"],
        "C": 100 * upper > UPPER_PERCENT * F.length(text),
        "D": text.rlike(REFUSED),
    }


def _bit(letter: str, letters: str) -> int:
    return 1 << letters.index(letter)


def masks(docs: DataFrame, part: str = "lang") -> DataFrame:
    """(part, doc_id, mask) of every row, as a plan over a written table."""
    text = F.coalesce(F.col("text"), F.lit(""))
    alone = F.lit(0)
    for letter, fails in failures(F.col("text")).items():
        alone = alone + F.when(fails, _bit(letter, LETTERS)).otherwise(0)
    named = docs.select(F.coalesce(F.col(part), F.lit("")).alias("part"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = materialize(named.select("part", "doc_id", F.unhex(F.sha2("text", 256)).alias("digest"), alone.alias("alone")))
    first = rows.filter(F.col("doc_id").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    joined = rows.join(first, ["digest", "doc_id"], "left")
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return joined.select("part", "doc_id", (F.col("alone") + F.when(copy, _bit(COPIES, LETTERS)).otherwise(0)).alias("mask"))


def cells(masked: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): the histogram of masks, at most 32 rows a part."""
    said = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    each = masked.join(said, "doc_id", "left")
    total = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0))).cast("long").alias(c)
    return each.groupBy("part", "mask").agg(F.count("*").alias("n"), total("good"), total("toxic"))


def orders(counted: DataFrame, letters: str = LETTERS) -> DataFrame:
    """A row for each part, order and step, from the cells alone.

    A filter's Shapley sum needs no orders: of a document that fails k filters, each removes it in one k-th of them."""
    every = ["".join(p) for p in permutations(letters)]
    if len(every) % lcm(*range(1, len(letters) + 1)):
        raise ValueError("the number of orders must divide by every number of failing filters")
    parts = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    rows = parts.select("part", "cells", F.explode(F.split(F.lit(" ".join(every)), " ")).alias("filter_order"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step"))
    bit = lambda at: f"shiftleft(1, locate(substring(filter_order, {at}, 1), '{letters}') - 1)"
    rows = rows.withColumn("own", F.expr(bit("step"))).withColumn("before", F.expr(f"aggregate(slice(sequence(1, {len(letters)}), 1, step - 1), 0, (m, i) -> m | {bit('i')})"))

    def total(what: str, where: str) -> Column:
        return F.expr(f"aggregate(cells, CAST(0 AS BIGINT), (x, c) -> x + IF({where}, {what}, 0))")

    here, none_before = "(c.mask & own) <> 0", "(c.mask & before) = 0"
    return rows.select(
        "part", "filter_order", "step",
        total("c.n", "(c.mask & (before | own)) = 0").alias("kept"),
        total("c.n", f"{here} AND {none_before}").alias("removed"),
        total("c.n", f"{here} AND NOT {none_before}").alias("redundant"),
        total("c.n", "c.mask = own").alias("unique_fails"),
        total("c.good", f"{here} AND {none_before}").alias("good_lost"),
        total("c.toxic", f"{here} AND {none_before}").alias("toxic_lost"),
        total(f"c.n * ({len(every)} div bit_count(c.mask))", here).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)."""
    return orders(cells(masks(docs, part), labels))


def op13(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return audit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic"))


#: The same by applying every order to every mask.
OP13_SQL = """
WITH d AS (SELECT coalesce(lang, '') AS part, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
said AS (SELECT doc_id, max((quality = 1)::INTEGER) AS good, max((toxic = 1)::INTEGER) AS toxic FROM labels GROUP BY 1),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  {'A': len(words) < 200, 'B': 100 * len(list_distinct(words)) < 50 * len(words), 'C': 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 3 * length(text),
   'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)} AS f
  FROM d LEFT JOIN said USING (doc_id)),
flat AS (SELECT part, good, toxic, list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: CASE x WHEN 'A' THEN f.A WHEN 'B' THEN f.B WHEN 'C' THEN f.C WHEN 'D' THEN f.D ELSE f.E END) AS fails FROM m),
h AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM flat GROUP BY 1, 2),
l(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step::INTEGER AS step, filter_order[step] AS letter, string_split(filter_order[1:step - 1], '') AS before FROM o, range(1, 6) AS r(step)),
e AS (SELECT part, filter_order, step, letter, n, good, toxic, fails, list_contains(fails, letter) AS here, list_has_any(fails, before) AS gone FROM h, s),
out AS (SELECT part, filter_order, step, letter, coalesce(sum(n) FILTER (WHERE NOT here AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (WHERE here AND NOT gone), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (WHERE here AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (WHERE here AND len(fails) = 1), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (WHERE here AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (WHERE here AND NOT gone), 0)::BIGINT AS toxic_lost FROM e GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM out
"""
