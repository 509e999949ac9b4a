"""A stored inverted index of chunks, and ranking that reads it instead of texts.

The index has three tables, in parts that follow the chunk table's, so that a commit writes the parts of its own
versions only. A block is ``BLOCK`` consecutive orders of ingest of one part, and a list is four numbers: a bit for
each chunk of a block.

* ``lists``: for each block and word the chunks that hold it in their text or in their section; and for each run of
  one to three letters the same, and the chunks that hold it in any case.
* ``heads``: for each block what ranking needs of its chunks: id, order, work, status, number.
* ``words``: the distinct words of a part, as written and in lower case, with their runs of three letters.

A term consists of word characters, so it stands in a text exactly if it stands in one of its words. A term of up to
three letters is itself a run and reads one list a block; a longer one reads the lists of the words that hold it, which
its rarest run finds. From these come hits, matched terms and section hits of a chunk, and bounds for the rest of its score:
term hits are at least the terms in the text and count up to 20, a phrase can stand only where all its terms do. A
search has four steps:

1. terms meet runs and words, and these their lists;
2. each task goes through its blocks and keeps the best candidates of each query so far. A block whose lists can't lift
   a chunk over the last of them is passed over, and no more than the candidates leave the task;
3. candidates whose score can't reach what the first ``limit`` have at least go;
4. those left, few more than are asked for, fetch their chunks, whose texts tell the exact score.

Words that only lower-casing a whole text makes (a sign that becomes a letter) are listed beside its own words, for
candidates are found in lower case and scored as written.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from warraq.functions import text as T
from warraq.operators import lexical
from warraq.session import materialize

#: Orders of ingest of a block, 64 a number; queries whose terms a task holds at once; letters of a run at most.
BLOCK, QUERIES, RUN = 256, 500, 3
#: What term hits count up to, and what three phrases, and two in a section, add to a score at most.
TERM_MOST, PHRASE_MOST, SECTION_PHRASE_MOST = 20, 75.0, 40.0
#: Orders of ingest that a chunk table is asked for by name.
PUSHED = 5_000
#: Texts read at first, in multiples of what is asked for.
AHEAD = 2
#: What a list is of: words as written, in text or section; words that lower-casing makes; runs in any case.
TEXT, SECTION, LOWERED, ANY_CASE = 0, 1, 2, 3
_BITS = tuple(f"b{k}" for k in range(BLOCK // 64))


@dataclass(frozen=True)
class Index:
    """The tables, as they are read."""

    lists: DataFrame
    heads: DataFrame
    words: DataFrame


def _runs(word: Column) -> Column:
    """The distinct runs of one to ``RUN`` letters of a word."""
    every = lambda c: F.flatten(F.transform(F.sequence(F.lit(1), F.lit(RUN)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size(c) - n + 1, F.lit(1))), lambda i: F.concat_ws("", F.slice(c, i, n)))))
    return F.array_distinct(F.transform(F.array(F.split(word, "")), every)[0])


def _merged() -> list[Column]:
    return [F.bit_or(b).alias(b) for b in _BITS]


def lists(chunks: DataFrame) -> DataFrame:
    """(part, block, run, key, field, bits) of the words and runs of chunks (chunk columns and ``part``)."""
    keys, at = ["part", "block"], F.pmod("ingest_order", F.lit(BLOCK)).cast("int")
    own = [F.when(F.floor(at / 64) == k, F.expr(f"shiftleft(1L, CAST(pmod(ingest_order, {BLOCK}) AS INT) % 64)")).otherwise(F.lit(0).cast("long")).alias(b) for k, b in enumerate(_BITS)]
    rows = chunks.select("part", F.floor(F.col("ingest_order") / BLOCK).alias("block"), *own, F.coalesce("text_normalized", F.lit("")).alias("text"), F.coalesce("section_text_normalized", F.lit("")).alias("section"))
    each = lambda df, words, field: df.select(*keys, *_BITS, F.lit(field).alias("field"), F.explode(F.array_distinct(words)).alias("key"))
    lowered = lambda *c: F.concat(*[F.transform(T.tokens(F.col(x)), F.lower) for x in c])
    after = F.concat(T.tokens(F.lower("text")), T.tokens(F.lower("section")))
    # Letters of ASCII and Arabic are words of the same letters in lower case; only other signs can turn into some.
    odd = rows.filter(F.concat("text", "section").rlike("[^\\x00-\\x7f\\u0600-\\u06ff]"))
    told = each(rows, T.tokens(F.col("text")), TEXT).unionByName(each(rows, T.tokens(F.col("section")), SECTION)).unionByName(each(odd, F.array_except(after, lowered("text", "section")), LOWERED))
    words = materialize(told.groupBy(*keys, "key", "field").agg(*_merged()))
    as_written = words.filter(F.col("field") < LOWERED).select(*keys, "field", *_BITS, F.explode(_runs(F.col("key"))).alias("key"))
    any_case = words.select(*keys, F.lit(ANY_CASE).alias("field"), *_BITS, F.explode(_runs(F.lower("key"))).alias("key"))
    runs = as_written.unionByName(any_case).groupBy(*keys, "key", "field").agg(*_merged())
    column = ["part", "block", "run", "key", "field", *_BITS]
    return words.withColumn("run", F.lit(False)).select(column).unionByName(runs.withColumn("run", F.lit(True)).select(column))


def heads(chunks: DataFrame) -> DataFrame:
    """(part, block, heads) of the chunks, in order of ingest."""
    one = F.struct(F.col("ingest_order").cast("long").alias("place"), "chunk_id", "work_uri", "quality_status", F.col("sequence_no").cast("long").alias("sequence_no"))
    return chunks.groupBy("part", F.floor(F.col("ingest_order") / BLOCK).alias("block")).agg(F.sort_array(F.collect_list(one)).alias("heads"))


def words(listed: DataFrame) -> DataFrame:
    """(part, key, field, word, parts): the distinct words of each part, of more letters than a run, as written and in
    lower case."""
    one = listed.filter(~F.col("run")).select("part", "key", "field", F.lower("key").alias("word")).filter(F.length("word") > RUN).distinct()
    return one.withColumn("parts", lexical.parts(F.col("word")))


def build(chunks: DataFrame) -> Index:
    """An index of chunks as written tables of this program; ``store.Store`` keeps one by part, commit by commit."""
    held = chunks.withColumn("part", F.lit(0))
    listed = materialize(lists(held))
    return Index(listed, materialize(heads(held)), materialize(words(listed)))


def wanted(index: Index, terms: DataFrame) -> DataFrame:
    """(run, key, field, terms): which lists the ``terms`` (number, term, low) read, and the numbers of the terms that each
    holds; a number stands twice over, odd if the list holds the term as written, even if in any case."""
    short, long = terms.filter(F.length("term") <= RUN), terms.filter(F.length("term") > RUN)
    own = lambda key, field, odd: short.select(F.lit(True).alias("run"), F.col(key).alias("key"), F.lit(field).alias("field"), (2 * F.col("number") + odd).alias("number"))
    told = own("term", TEXT, 1).unionByName(own("term", SECTION, 1)).unionByName(own("low", ANY_CASE, 0))
    if not long.isEmpty():
        known = index.words.select("word", "parts").dropDuplicates(["word"])
        found = lexical.words_holding(known, materialize(long.select("low").distinct())).join(long, "low")
        held = materialize(found.groupBy("word").agg(F.collect_list(F.struct("number", "term")).alias("of")))
        keyed = index.words.select("key", "field", "word").distinct()
        every = keyed.join(lexical.small(held), "word").select(F.lit(False).alias("run"), "key", "field", F.explode("of").alias("of"))
        even = F.array(2 * F.col("of.number"))
        written = F.when(F.contains("key", F.col("of.term")) & (F.col("field") < LOWERED), F.concat(even, F.array(2 * F.col("of.number") + 1))).otherwise(even)
        told = told.unionByName(every.select("run", "key", "field", F.explode(written).alias("number")))
    return told.groupBy("run", "key", "field").agg(F.sort_array(F.collect_list(F.col("number").cast("int"))).alias("terms"))


class _Best:
    """The candidates of one query so far: hits, then order of ingest, and what bounds their scores."""

    NUMBERS = ("hits", "place", "matched_terms", "text_terms", "section_hits", "may_phrase", "may_section", "sequence_no")

    def __init__(self, most: int):
        self.most, self.rows, self.ids = most, np.empty((len(self.NUMBERS), 0), np.int64), np.empty(0, object)

    def worst(self) -> tuple[int, int | None]:
        """Hits and place that a chunk must beat."""
        return (0, None) if len(self.ids) < self.most else (int(self.rows[0, -1]), int(self.rows[1, -1]))

    def add(self, rows: np.ndarray, ids: np.ndarray) -> None:
        rows, ids = np.concatenate((self.rows, rows), 1), np.concatenate((self.ids, ids))
        order = np.lexsort((rows[1], -rows[0]))[: self.most]
        self.rows, self.ids = rows[:, order], ids[order]


class _Block:
    """Which chunks of a block hold which of the asked terms: in any case, in the text and in the section as written."""

    def __init__(self, rows: pa.Table, local: np.ndarray, terms: int):
        told = next(x for x in rows.column("heads").to_pylist() if x)
        self.places = np.array([x["place"] for x in told], np.int64)
        self.ids = np.array([x["chunk_id"] for x in told], object)
        self.works = np.array([x["work_uri"] for x in told], object)
        self.sequence = np.array([-1 if x["sequence_no"] is None else x["sequence_no"] for x in told], np.int64)
        self.open = np.array([x["quality_status"] != "REJECTED" for x in told], bool)
        field = rows.column("field").to_numpy()
        bits = np.stack([rows.column(b).to_numpy().view(np.uint64) for b in _BITS], 1)
        column = rows.column("terms").combine_chunks()
        of = np.repeat(np.arange(len(rows)), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        number = column.flatten().to_numpy(zero_copy_only=False)
        term, written = local[number >> 1], (number & 1) == 1
        at = self.places % BLOCK

        def held(pick: np.ndarray) -> np.ndarray:
            """The union of the picked lists by term, as (term, chunk)."""
            pick = pick[term[pick] >= 0]
            pick = pick[np.argsort(term[pick], kind="stable")]
            out = np.zeros((terms, len(_BITS)), np.uint64)
            if len(pick):
                first = np.flatnonzero(np.concatenate(([True], term[pick][1:] != term[pick][:-1])))
                out[term[pick][first]] = np.bitwise_or.reduceat(bits[of[pick]], first)
            return np.unpackbits(out.view(np.uint8).reshape(terms, -1), axis=1, bitorder="little")[:, at].astype(bool)

        self.any = held(np.flatnonzero(~written))
        self.text, self.section = (held(np.flatnonzero(written & (field[of] == f))) for f in (TEXT, SECTION))


_FOUND = "asked bigint, chunk_id string, " + ", ".join(f"{c} bigint" for c in _Best.NUMBERS)
_SCHEMA = pa.schema([("asked", pa.int64()), ("chunk_id", pa.string())] + [(c, pa.int64()) for c in _Best.NUMBERS])


def _reader(asked: list[dict], numbers: dict[str, int], most: int, rejected: bool):
    """What a task does with its posting rows, in order of part, block and word."""
    mine = sorted({t for q in asked for t in q["terms"]})
    local = np.full(len(numbers), -1)
    local[[numbers[t] for t in mine]] = np.arange(len(mine))
    at = [local[[numbers[t] for t in q["terms"]]] for q in asked]
    telling = [local[[numbers[t] for t in q["terms"] if t in q["normalized"]]].astype(np.int64) for q in asked]

    def weigh(block: _Block, best: list[_Best]) -> None:
        there = block.any.any(1)
        for q, t, told, kept in zip(asked, at, telling, best, strict=True):
            least, last = kept.worst()
            bound = int(there[t].sum())
            if bound < max(least, 1) or bound == least and last is not None and block.places[0] > last:
                continue
            hits = block.any[t].sum(0)
            fits = (hits > 0) & (hits >= least)
            if not rejected:
                fits &= block.open
            if q["work_uri"] is not None:
                fits &= block.works == q["work_uri"]
            pick = np.flatnonzero(fits)
            pick = pick[np.lexsort((block.places[pick], -hits[pick]))[:most]]
            if not len(pick):
                continue
            text, section = block.text[np.ix_(t, pick)], block.section[np.ix_(t, pick)]
            phrase, in_section = block.text[np.ix_(told, pick)].all(0), block.section[np.ix_(told, pick)].all(0)
            kept.add(np.stack([hits[pick], block.places[pick], (text | section).sum(0), text.sum(0), section.sum(0), phrase, in_section, block.sequence[pick]]).astype(np.int64), block.ids[pick])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, held, key = [_Best(most) for _ in asked], [], None
        for batch in batches:
            part, block = batch.column("part").to_numpy(), batch.column("block").to_numpy()
            turns = np.flatnonzero((part[1:] != part[:-1]) | (block[1:] != block[:-1])) + 1
            for lo, hi in zip([0, *turns.tolist()], [*turns.tolist(), len(part)], strict=True):
                if lo == hi:
                    continue
                if held and key != (part[lo], block[lo]):
                    weigh(_Block(pa.Table.from_batches(held), local, len(mine)), best)
                    held = []
                key = (part[lo], block[lo])
                held.append(batch.slice(lo, hi - lo))
        if held:
            weigh(_Block(pa.Table.from_batches(held), local, len(mine)), best)
        for q, kept in zip(asked, best, strict=True):
            if len(kept.ids):
                yield pa.RecordBatch.from_arrays([pa.array([q["asked"]] * len(kept.ids), pa.int64()), pa.array(kept.ids, pa.string()), *[pa.array(x) for x in kept.rows]], schema=_SCHEMA)

    return run


def candidates(index: Index, queries: DataFrame, most: int, include_rejected: bool = False) -> DataFrame:
    """The first ``most`` chunks of each analyzed query by hits, then by order of ingest, with what their scores are made
    of. ``queries`` is told to every task, ``QUERIES`` of them at once."""
    if queries.limit(lexical.SMALL_ROWS + 1).count() > lexical.SMALL_ROWS:
        raise ValueError(f"one search takes {lexical.SMALL_ROWS} queries at most")
    asked = [r.asDict() | {"asked": k} for k, r in enumerate(queries.select("query_id", "work_uri", "normalized", "terms").collect())]
    numbers = {t: k for k, t in enumerate(sorted({t for q in asked for t in q["terms"]}))}
    spark = queries.sparkSession
    terms = spark.createDataFrame(list(numbers.items()), "term string, number int").withColumn("low", F.lower("term"))
    read = index.lists.join(lexical.small(materialize(wanted(index, terms))), ["run", "key", "field"]).select("part", "block", "field", *_BITS, "terms")
    # A block without a list of the queries has no candidates, so heads are read for the others only where they meet.
    told = index.heads.select("part", "block", F.lit(0).alias("field"), *[F.lit(0).cast("long").alias(b) for b in _BITS], F.array().cast("array<int>").alias("terms"), "heads")
    laid = read.withColumn("heads", F.lit(None).cast(index.heads.schema["heads"].dataType)).unionByName(told).repartition("part", "block").sortWithinPartitions("part", "block")
    found = None
    for k in range(0, len(asked), QUERIES):
        part = laid.mapInArrow(_reader(asked[k : k + QUERIES], numbers, most, include_rejected), _FOUND)
        found = part if found is None else found.unionByName(part)
    kind = queries.schema["query_id"].dataType.simpleString()
    if found is None:
        return spark.createDataFrame([], f"query_id {kind}, " + _FOUND.removeprefix("asked bigint, ") + ", candidate int")
    found = found.join(F.broadcast(spark.createDataFrame([(q["asked"], q["query_id"]) for q in asked], f"asked bigint, query_id {kind}")), "asked").drop("asked")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("hits"), "place"))
    return found.withColumn("candidate", place).filter(F.col("candidate") <= most)


def bounded(found: DataFrame, limit: int) -> DataFrame:
    """The candidates (with total_terms) that may be among the first ``limit`` of their query."""
    total = F.col("total_terms")
    sure = 100.0 * F.col("matched_terms") / total + 8.0 * F.col("section_hits") + 35.0 * F.col("section_hits") / total
    low = sure + 2.0 * F.least("text_terms", F.lit(TERM_MOST))
    # No term in the text, no hits there; a phrase needs all its terms.
    high = sure + 2.0 * F.when(F.col("text_terms") > 0, TERM_MOST).otherwise(0) + PHRASE_MOST * F.col("may_phrase") + SECTION_PHRASE_MOST * F.col("may_section")
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("low")))
    cut = F.max(F.when(F.col("nth") == limit, F.col("low"))).over(Window.partitionBy("query_id"))
    scored = found.withColumn("low", low).withColumn("high", high).withColumn("nth", nth).withColumn("cut", cut)
    # Doubles: what differs by rounding alone counts as reached.
    return scored.filter(F.col("cut").isNull() | (F.col("high") >= F.col("cut") - 1e-6)).drop("nth", "cut")


def contenders(index: Index, queries: DataFrame, limit: int = 10, candidate_limit: int | None = None, include_rejected: bool = False) -> DataFrame:
    """(query_id, chunk_id, hits, place, bounds): the pairs of which a search reads the text."""
    limit, most = lexical.limits(limit, candidate_limit)
    asked = queries.select("query_id", F.size("terms").alias("total_terms"))
    return bounded(candidates(index, queries, most, include_rejected).join(lexical.small(asked), "query_id"), limit)


def _scored(chunks: DataFrame, pairs: DataFrame, queries: DataFrame) -> DataFrame:
    """Pairs with their chunks and exact scores. A few chunks are asked for by order of ingest, which skips files."""
    few = [r["place"] for r in pairs.select("place").distinct().limit(PUSHED + 1).collect()]
    held = chunks.filter(F.col("ingest_order").isin(few)) if len(few) <= PUSHED else chunks
    return lexical.score(held.join(lexical.small(pairs), "chunk_id").join(lexical.small(queries.drop("work_uri")), "query_id"))


def search_batch(index: Index, chunks: DataFrame, queries: DataFrame, limit: int = 10, candidate_limit: int | None = None, include_rejected: bool = False) -> DataFrame:
    """``lexical.search_batch`` over a stored index: the same rows, without a scan of texts for terms. ``chunks`` is the
    table that the index is of; filters are the queries' work_uri and ``include_rejected``.

    The ``AHEAD`` times ``limit`` pairs with the highest bounds fetch their texts first. The score that the last of the
    first ``limit`` has then is what the other contenders' bounds must reach to be read, too."""
    pairs = materialize(contenders(index, queries, limit, candidate_limit, include_rejected).select("query_id", "chunk_id", "hits", "place", "low", "high"))
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("high"), F.desc("low"), "place"))
    placed = materialize(pairs.withColumn("nth", nth))
    rank = lambda last: F.row_number().over(Window.partitionBy("query_id").orderBy(*lexical.ranking("hits", last)))
    first = materialize(_scored(chunks, placed.filter(F.col("nth") <= AHEAD * limit), queries))
    cut = first.withColumn("rank", rank("place")).filter(F.col("rank") == limit).select("query_id", F.col("score").alias("cut"))
    more = materialize(placed.filter(F.col("nth") > AHEAD * limit).join(lexical.small(cut), "query_id").filter(F.col("high") >= F.col("cut") - 1e-6).drop("cut"))
    both = first if more.isEmpty() else first.unionByName(_scored(chunks, more, queries))
    return both.withColumn("rank", rank("place")).filter(F.col("rank") <= limit).drop("place", "nth", "low", "high")


def holding(index: Index, chunks: DataFrame, term: str) -> DataFrame:
    """The chunks that hold one term of word characters in any case, found by the lists alone."""
    spark = chunks.sparkSession
    terms = spark.createDataFrame([(0, term, term.lower())], "number int, term string, low string")
    read = index.lists.join(lexical.small(materialize(wanted(index, terms))), ["run", "key", "field"]).filter(F.exists("terms", lambda x: x % 2 == 0))
    bit = lambda c: F.array(*[F.expr(f"{b} & shiftleft(1L, CAST({c} % 64 AS INT)) <> 0 AND {k} = {c} div 64") for k, b in enumerate(_BITS)])
    at = read.groupBy("part", "block").agg(*_merged()).withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(BLOCK - 1)))).filter(F.exists(bit("at"), lambda x: x))
    return chunks.join(at.select((F.col("block") * BLOCK + F.col("at")).alias("ingest_order")), "ingest_order", "left_semi")
