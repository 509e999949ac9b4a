"""Quality rules: a threshold table compiled into one Spark projection.

Every measure is a built-in expression over the whole text of one row, so the plan is a scan and a
projection: no shuffle, no user function, nothing that grows with the number of rows.

Stop words are those of four languages; a row whose ``lang`` names another one is not held to their ratio, and a
null or missing ``lang`` is.

Edge cases: a null or blank text has no words, so every count is 0 and ``base_failed`` is true.
Repeated rows are judged each on its own. Extra columns pass through ``annotate`` untouched unless
they carry the name of a measure, which then is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space between words: space and U+0009 to U+000D.
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"

#: Frequent function words of the corpus languages (English, French, German, Spanish).
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with",
    "au", "avec", "ce", "dans", "des", "du", "est", "et", "la", "le", "les", "par", "pas", "pour", "que", "qui", "sur", "un", "une",
    "auf", "das", "dem", "den", "der", "die", "ein", "eine", "ist", "mit", "nicht", "sich", "und", "von", "zu",
    "con", "de", "del", "el", "en", "las", "los", "no", "o", "para", "se", "su", "una", "y",
)
STOP_LANGS = ("en", "fr", "de", "es")
#: A stop word that stands as a word of its own, whatever its case.
_STOP_PATTERN = r"(?<![^\x20\x09-\x0D])(?iu:" + "|".join(STOP_WORDS) + r")(?![^\x20\x09-\x0D])"


@dataclass(frozen=True)
class Threshold:
    """A document fails where ``low <= part / whole <= high`` does not hold; a null bound does not
    bind, and the ratio is 0 where ``whole`` is 0."""

    name: str
    part: str
    whole: str
    low: float | None = None
    high: float | None = None
    #: The languages that the rule can judge; a row said to be in another one isn't held to it.
    langs: tuple[str, ...] = ()


THRESHOLDS = (
    Threshold("word_length", "word_chars", "n_words", 2.0, 15.0),
    Threshold("symbol_ratio", "n_symbols", "n_words", None, 0.3),
    Threshold("stop_word_ratio", "n_stop_words", "n_words", 0.06, None, STOP_LANGS),
    Threshold("dup_line_ratio", "n_dup_lines", "n_lines", None, 0.5),
    Threshold("upper_ratio", "n_upper_words", "n_words", None, 0.5),
    Threshold("shout_ratio", "n_shouts", "n_words", None, 0.3),
)

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


def words_of(text: Column) -> Column:
    """Runs of anything but white space; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows found twice or more.

    Equal windows meet by sorting (hash, position) pairs. The flagged positions, in order, cover
    min(3, distance to the next flagged position) words each, the last one 3."""
    last = F.size(words) - 3

    def windows(w: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(w) - 3),
            lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")),
        )

    def flagged(s: Column) -> Column:
        same = F.transform(
            s,
            lambda x, j: F.when(
                (x["h"] == F.get(s, j - 1)["h"]) | (x["h"] == F.get(s, j + 1)["h"]),
                x["i"],
            ),
        )
        return F.sort_array(F.filter(same, lambda x: x.isNotNull()))

    def covered(p: Column) -> Column:
        return F.aggregate(
            F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))),
            F.lit(0).cast("long"),
            lambda a, x: a + x,
        )

    def some(s: Column) -> Column:
        return F.when(F.size(F.array_distinct(s["h"])) == F.size(s), F.lit(0).cast("long")).otherwise(
            _let(F.sort_array(s), lambda t: _let(flagged(t), covered))
        )

    return F.when(last < 1, F.lit(0).cast("long")).otherwise(_let(windows(words), some))


MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_upper_words", "n_shouts")


def measures(text: Column, words: Column) -> dict[str, Column]:
    """The measures by name; ``words`` is the bound value of ``words_of(text)``."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: F.length(F.trim(F.translate(x, "\t\x0b\x0c\r", "    "))) > 0)
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": (F.length(whole) - F.length(F.regexp_replace(whole, SYMBOLS, ""))).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": _repeat_words(words),
        "n_stop_words": F.regexp_count(whole, F.lit(_STOP_PATTERN)).cast("long"),
        "n_upper_words": F.size(F.filter(words, lambda w: w.rlike(r"^\p{P}*\p{Lu}{2,}\p{P}*$"))).cast("long"),
        "n_shouts": (F.length(whole) - F.length(F.replace(whole, F.lit("!"), F.lit("")))).cast("long"),
    }


def verdict(m: Column, thresholds=THRESHOLDS, lang: Column | None = None) -> Column:
    """The table as one boolean expression over a struct of measures."""
    held = F.lit(True)
    for t in thresholds:
        ratio = F.coalesce(m[t.part] / F.nullif(m[t.whole], F.lit(0)), F.lit(0.0))
        fits = F.lit(True)
        if t.low is not None:
            fits = fits & (ratio >= t.low)
        if t.high is not None:
            fits = fits & (ratio <= t.high)
        if t.langs and lang is not None:
            fits = fits | F.coalesce(~lang.isin(*t.langs), F.lit(False))
        held = held & fits
    return held


def judgement(text: Column, thresholds=THRESHOLDS, lang: Column | None = None) -> Column:
    """One struct of all measures, ``base_failed`` and ``kept``. Words, and then measures, are bound
    to lambda variables, so that no optimizer rule can copy their evaluation."""

    def judge(m: Column) -> Column:
        failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])
        return F.struct(*[m[c].alias(c) for c in MEASURES], failed.alias("base_failed"), (~failed & verdict(m, thresholds, lang)).alias("kept"))

    def measured(words: Column) -> Column:
        return F.struct(*[c.alias(k) for k, c in measures(text, words).items()])

    return _let(words_of(text), lambda w: _let(measured(w), judge))


def passes(text: Column, thresholds=THRESHOLDS, lang: Column | None = None) -> Column:
    """``kept`` of the judgement; repeated windows, the dearest measure, are counted only where all else holds."""

    def rest(words: Column) -> Column:
        cheap = {k: c for k, c in measures(text, words).items() if k != "n_repeat_words"}
        few = lambda m: 100 * _repeat_words(words) <= MAX_REPEAT_PERCENT * m["n_words"]
        return _let(F.struct(*[c.alias(k) for k, c in cheap.items()]), lambda m: F.when(verdict(m, thresholds, lang), few(m)).otherwise(F.lit(False)))

    return _let(words_of(text), lambda w: F.when(F.size(w) >= MIN_WORDS, rest(w)).otherwise(F.lit(False)))


def _lang(docs: DataFrame) -> Column | None:
    return F.col("lang") if "lang" in docs.columns else None


def annotate(docs: DataFrame, text: str = "text", thresholds=THRESHOLDS) -> DataFrame:
    """``docs`` with the measures, ``base_failed`` and ``kept``."""
    out = (*MEASURES, "base_failed", "kept")
    others = [F.col(c) for c in docs.columns if c not in out]
    return docs.select(*others, judgement(F.col(text), thresholds, _lang(docs)).alias("__judgement")).select(
        *others, *[F.col(f"__judgement.{c}").alias(c) for c in out]
    )


def keep(docs: DataFrame, text: str = "text", thresholds=THRESHOLDS) -> DataFrame:
    """The rows that pass, with the columns they came with."""
    return docs.filter(passes(F.col(text), thresholds, _lang(docs)))


def op5(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return annotate(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _in_list(names) -> str:
    return ", ".join(f"'{x}'" for x in names)


def judged_sql(source: str) -> str:
    """DuckDB SQL for ``annotate`` over a relation with distinct doc_id, text and lang."""
    conditions = []
    for t in THRESHOLDS:
        ratio = f"coalesce({t.part}::DOUBLE / nullif({t.whole}, 0), 0)"
        fits = [f"{ratio} >= {t.low}"] * (t.low is not None) + [f"{ratio} <= {t.high}"] * (t.high is not None)
        conditions.append(f"({' AND '.join(fits)}{f' OR coalesce(lang NOT IN ({_in_list(t.langs)}), false)' * bool(t.langs)})")
    return f"""
WITH split AS (
  SELECT doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM {source}
), windows AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM split)
), found AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1
), repeated AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM found, (VALUES (0), (1), (2)) AS d(k) GROUP BY doc_id
), counted AS (
  SELECT s.doc_id, lang, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
    len(list_filter(w, lambda x: lower(x) IN ({_in_list(STOP_WORDS)}))) AS n_stop_words,
    len(list_filter(w, lambda x: regexp_matches(x, '^\\p{{P}}*\\p{{Lu}}{{2,}}\\p{{P}}*$'))) AS n_upper_words,
    length(text) - length(replace(text, '!', '')) AS n_shouts
  FROM split s LEFT JOIN repeated r USING (doc_id)
), based AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM counted
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {" AND ".join(conditions)} AS kept FROM based
"""


OP5_SQL = judged_sql("documents")
