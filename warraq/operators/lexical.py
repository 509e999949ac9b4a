"""Deterministic lexical ranking: candidates by coverage, then an exact score.

Chunks carry chunk_id, ingest_order, sequence_no, text_normalized, section_path and
section_text_normalized; queries carry query_id and query, and a work_uri that may be null.

A term consists of word characters, so it can stand in a text only within one of the text's words. Substring
search thus runs over the distinct words of the corpus, by joins on three-letter parts, and reaches chunks by
joins on words (``word_index``); no text is scanned for terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from warraq.functions import text as T
from warraq.session import materialize

SMALL_ROWS = 100_000
#: Bounds of a request.
MAX_QUERY, MAX_URI, MAX_RESULTS = 500, 255, 50


def check_request(query: str, limit: int = 10, work_uri: str | None = None) -> str:
    """The query of a request without blanks around it, after the bounds that requests have."""
    for name, value, least, most in (("query", len(query), 1, MAX_QUERY), ("limit", limit, 1, MAX_RESULTS), ("work_uri", len(work_uri or ""), 0, MAX_URI)):
        if not least <= value <= most:
            raise ValueError(f"{name} must be between {least} and {most}" + " characters long" * (name != "limit"))
    if not T.trimmed(query):
        raise ValueError("the query is blank")
    return T.trimmed(query)


def limits(limit: int, candidate_limit: int | None = None) -> tuple[int, int]:
    """The checked limit and the number of candidates that are scored."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be between 1 and 100")
    return limit, min(max(candidate_limit or max(limit * 50, 250), limit), 5000)


def analyze(queries: DataFrame, composed: bool = False) -> DataFrame:
    """Adds normalized and terms; a query without terms is an error."""
    out = queries.withColumn("normalized", T.normalize(F.col("query"), composed)).withColumn("terms", T.query_terms(F.col("normalized")))
    return out.withColumn("terms", F.when(F.size("terms") > 0, F.col("terms")).otherwise(F.raise_error(F.lit("The search query does not contain any searchable terms"))))


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """A broadcast of a frame that is small by count, else the frame."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def allowed(chunks: DataFrame, work_uri: str | None = None, include_rejected: bool = False) -> DataFrame:
    """The filters that reach the scan."""
    if work_uri is not None:
        chunks = chunks.filter(F.col("work_uri") == work_uri)
    return chunks if include_rejected else chunks.filter(F.col("quality_status") != "REJECTED")


def word_index(chunks: DataFrame) -> DataFrame:
    """(chunk_id, work_uri, ingest_order, words): the distinct words of each chunk and its section in lower case.
    A table to be stored with the chunks; whoever has none gets one made for a search."""
    words = F.array_distinct(F.concat(*[T.tokens(F.lower(F.coalesce(c, F.lit("")))) for c in ("text_normalized", "section_text_normalized")]))
    return chunks.select("chunk_id", "work_uri", "ingest_order", words.alias("words"))


def parts(word: Column) -> Column:
    """The distinct runs of three letters of a word, the word itself where it has fewer."""
    letters = F.split(word, "")
    runs = lambda c: F.transform(F.sequence(F.lit(0), F.greatest(F.size(c) - 3, F.lit(0))), lambda i: F.concat_ws("", F.slice(c, i + 1, 3)))
    return F.array_distinct(F.transform(F.array(letters), runs)[0])


def words_holding(words: DataFrame, terms: DataFrame) -> DataFrame:
    """(low, word) of the ``words`` (word, and ``parts`` where they are stored) that hold a term ``low``. A term of three letters or more is looked up by its
    rarest part, a shorter one by itself among all letters and pairs of letters."""
    short = lambda w: F.array_distinct(F.transform(F.array(F.split(w, "")), lambda c: F.concat(c, F.transform(F.sequence(F.lit(1), F.greatest(F.size(c) - 1, F.lit(1))), lambda i: F.concat_ws("", F.slice(c, i, 2)))))[0])
    long_terms, short_terms = terms.filter(F.length("low") >= 3), terms.filter(F.length("low") < 3)
    asked = materialize(long_terms.select("low", F.explode(parts(F.col("low"))).alias("part")))
    held = materialize(words.select("word", F.explode("parts" if "parts" in words.columns else parts(F.col("word"))).alias("part")).join(small(asked.select("part").distinct()), "part"))
    rare = asked.join(held.groupBy("part").agg(F.count("*").alias("n")), "part").groupBy("low").agg(F.min_by("part", F.struct("n", "part")).alias("part"))
    # A term with a part that no word has is in no word.
    whole = asked.join(held.select("part").distinct(), "part").groupBy("low").agg(F.count("*").alias("k")).join(asked.groupBy("low").agg(F.count("*").alias("of")), "low").filter("k = of").select("low")
    found = held.join(small(rare.join(whole, "low")), "part").filter(F.contains("word", "low")).select("low", "word")
    if short_terms.isEmpty():
        return found
    return found.union(words.select("word", F.explode(short(F.col("word"))).alias("low")).join(small(short_terms), "low").select("low", "word"))


def matches(chunks: DataFrame, queries: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, ingest_order, hits) of the chunks that hold a term of a query, in any case.

    ``index``: the stored ``word_index`` of these chunks. Each distinct term is looked for once among the distinct
    words, and hits go back to queries by term."""
    index = materialize(word_index(chunks)) if index is None else index
    terms = queries.select("query_id", "work_uri", F.explode("terms").alias("term")).withColumn("low", F.lower("term"))
    words = materialize(index.select(F.explode("words").alias("word")).distinct())
    lows = materialize(words_holding(words, materialize(terms.select("low").distinct())).groupBy("word").agg(F.collect_set("low").alias("lows")))
    # Dealt by chunk once, so that the words, the terms and the queries of a chunk are counted where they are.
    words_of = index.repartition("chunk_id").select("chunk_id", F.col("work_uri").alias("__work"), "ingest_order", F.explode("words").alias("word"))
    found = words_of.join(small(lows), "word").select("chunk_id", "__work", "ingest_order", F.explode("lows").alias("low")).distinct()
    asked = terms.groupBy("low", "query_id", "work_uri").agg(F.countDistinct("term").alias("n"))
    by_query = found.join(small(asked), "low").filter(F.col("work_uri").isNull() | (F.col("work_uri") == F.col("__work")))
    return by_query.groupBy("query_id", "chunk_id", "ingest_order").agg(F.sum("n").alias("hits"))


def candidates(chunks: DataFrame, queries: DataFrame, candidate_limit: int, index: DataFrame | None = None) -> DataFrame:
    """The first chunks of each query by coverage, then by order of ingest."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("hits"), "ingest_order"))
    return matches(chunks, queries, index).withColumn("candidate", place).filter(F.col("candidate") <= candidate_limit)


def score_columns(text: Column, section: Column, normalized: Column, terms: Column) -> dict[str, Column]:
    """Score and its parts; all tests are case-sensitive here."""
    total = F.size(terms)
    told = F.transform(F.array(F.transform(terms, lambda t: F.struct(T.occurrences(text, t).alias("n"), F.contains(section, t).alias("s")))), lambda of: F.struct(
        F.size(F.filter(of, lambda x: (x["n"] > 0) | x["s"])).alias("matched"), F.aggregate(of, F.lit(0), lambda n, x: n + x["n"]).alias("hits"), F.size(F.filter(of, lambda x: x["s"])).alias("sections")))[0]
    matched, term_hits, section_hits = told["matched"], told["hits"], told["sections"]
    phrase, section_phrase = T.occurrences(text, normalized), T.occurrences(section, normalized)
    score = (
        100.0 * matched / total + 25.0 * F.least(phrase, F.lit(3)) + 2.0 * F.least(term_hits, F.lit(20)) + 8.0 * section_hits + 35.0 * section_hits / total + 20.0 * F.least(section_phrase, F.lit(2))
    )
    return {"score": score, "matched_terms": matched, "total_terms": total.cast("int"), "phrase_hits": phrase, "term_hits": term_hits, "section_hits": section_hits}


def score(pairs: DataFrame) -> DataFrame:
    """Scores rows that hold a chunk and an analyzed query; coverage is matched over total."""
    told = lambda c: F.coalesce(F.col(c), F.lit(""))
    out = pairs.withColumns(score_columns(told("text_normalized"), told("section_text_normalized"), F.col("normalized"), F.col("terms")))
    return out.withColumn("coverage", F.when(F.col("total_terms") > 0, F.col("matched_terms") / F.col("total_terms")).otherwise(0.0))


def ranking(*ties: str) -> list[Column]:
    return [F.desc("score"), F.desc("matched_terms"), F.desc("phrase_hits"), F.desc("term_hits"), F.asc("sequence_no"), *[F.desc(x) if x == "hits" else F.asc(x) for x in ties]]


def search_batch(chunks: DataFrame, queries: DataFrame, limit: int = 10, candidate_limit: int | None = None, index: DataFrame | None = None) -> DataFrame:
    """The ranking of every query in one plan: (query_id, rank, score and parts, chunk columns).
    ``queries`` is analyzed. Only candidates are scored, and where they are few by count they go to the
    chunks, so texts stay where they are read."""
    limit, most = limits(limit, candidate_limit)
    held = materialize(candidates(chunks, queries, most, index).drop("ingest_order"))
    scored = score(chunks.join(small(held), "chunk_id").join(small(queries.drop("work_uri")), "query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*ranking("hits", "ingest_order")))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= limit)


def search(chunks: DataFrame, query: DataFrame, terms: list[str], limit: int = 10, candidate_limit: int | None = None) -> DataFrame:
    """The ranking of one analyzed query, whose terms are known: a chunk's text is in lower case once for all
    terms, and both cuts are top-k without a shuffle of the corpus."""
    if not terms:
        raise ValueError("The search query does not contain any searchable terms")
    limit, most = limits(limit, candidate_limit)
    wanted = F.array(*[F.lit(t.lower()) for t in terms])
    both = F.struct(F.lower("text_normalized").alias("text"), F.lower("section_text_normalized").alias("section"))
    hits = F.transform(F.array(both), lambda c: F.size(F.filter(wanted, lambda t: F.contains(c["text"], t) | F.contains(c["section"], t))))[0]
    # The filter stands after the cut, where it changes nothing and asks for no second count.
    cut = chunks.withColumn("hits", hits).orderBy(F.desc("hits"), "ingest_order").limit(most).filter("hits > 0")
    scored = score(cut.crossJoin(F.broadcast(query.drop("work_uri").limit(1))))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*ranking("hits", "ingest_order")))
    return scored.orderBy(*ranking("hits", "ingest_order")).limit(limit).withColumn("rank", rank)


def trigrams(chunks: DataFrame) -> DataFrame:
    """(trigram, chunk_id): the derived table that finds substring candidates without a scan."""
    both = F.lower(F.concat_ws("\n", "text_normalized", "section_text_normalized"))
    letters = F.transform(F.array(F.split(both, "")), lambda c: F.transform(F.sequence(F.lit(0), F.greatest(F.size(c) - 3, F.lit(0))), lambda i: F.concat_ws("", F.get(c, i), F.get(c, i + 1), F.get(c, i + 2))))
    parts = letters[0]
    return chunks.select("chunk_id", F.explode(F.array_distinct(parts)).alias("trigram"))


def holding(chunks: DataFrame, term: str) -> DataFrame:
    """The chunks that hold ``term`` in any case, by one pass over their texts."""
    low = F.lit(term.lower())
    return chunks.filter(F.contains(F.lower("text_normalized"), low) | F.contains(F.lower("section_text_normalized"), low))


def by_trigram(chunks: DataFrame, index: DataFrame, term: str) -> DataFrame:
    """The chunks that hold ``term`` in any case, found by its trigrams and checked; a term of fewer
    than three characters is looked for in all chunks."""
    low = term.lower()
    parts = sorted({low[i : i + 3] for i in range(len(low) - 2)})
    if not parts:
        return holding(chunks, term)
    found = index.filter(F.col("trigram").isin(*parts)).groupBy("chunk_id").agg(F.count("*").alias("n")).filter(F.col("n") == len(parts)).select("chunk_id")
    return holding(chunks.join(found, "chunk_id", "left_semi"), term)
