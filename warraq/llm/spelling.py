"""Spelling variants: words one edit apart, the more frequent form of each, and the root its forms lead to.

1. Texts are cut into runs of letters; each Arrow batch is counted inside its task before words are shuffled.
2. Words are put in order of falling frequency (``session.ranked``): a word's place stands for it from there on,
   and of two words the smaller place is the better form.
3. Symmetric deletes: each word gives out itself and its distinct single deletions, hashed to 128 bits, which
   prefix sums give in constant time each, so a word of a million letters costs as much as many short ones. A key
   holds 90 words for each of its letters at most, as it names a string that one more letter completes.
4. Words that share a key are one edit apart exactly if one of them is the key itself, or if both lose a letter at a
   common place; a deletion knows the places that give it, one run of equal letters. Words one edit apart share
   exactly one key, so sums and minima over keys are exact without a distinct.
5. Forms are followed by pointer doubling: counts double at each step, so a chain has fewer than 64 words and a
   handful of joins finds all roots.

Edge cases: null text has no words. A null doc_id counts as the empty string in the check that plants
misspellings. Repeated rows count each. Ties go to the smaller word in code-point order. Extra columns are ignored.
Texts and runs may have any length; counts are passed on whenever a task holds ``HELD`` of them or as many bytes.
Tables of words are joined by merging: Spark sizes keys like the words they come from, and written tables by their
compressed files, so it would broadcast far more than the driver holds.
An empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from warraq.llm.shingles import mix, powers
from warraq.session import discard, materialize, ranked

#: Letters of a run (fixed pattern), after A-Z were lower-cased; one in ``EVERY`` runs of a document loses a letter.
RUN, EVERY = re.compile("[a-zÀ-ÿ]+"), 97
LEAST_LENGTH, LEAST_COUNT, RATIO = 5, 3, 2
#: Distinct words, or bytes of them, that a task counts before it passes them on; keys in one Arrow batch.
HELD, HELD_BYTES, BATCH = 400_000, 64 << 20, 200_000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def words_of(doc_id: str, text: str) -> Counter:
    """The words of one text, A-Z lower-cased already, and how often they occur."""
    found, out = Counter(RUN.findall(text)), Counter()
    salt = zlib.crc32(f"{doc_id}:".encode())
    for run, n in found.items():
        h = zlib.crc32(run.encode(), salt)
        if h % EVERY == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        if len(run) >= LEAST_LENGTH:
            out[run] += n
    return out


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) of the words that occur often enough, over all texts."""

    def told(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, size = Counter(), 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                if not text.is_valid:
                    continue
                one = words_of(doc_id.as_py() or "", text.as_buffer().to_pybytes().translate(_LOWER).decode())
                size += sum(len(w) for w in one if w not in counts)
                counts.update(one)
                if len(counts) > HELD or size > HELD_BYTES:
                    yield told(counts)
                    counts, size = Counter(), 0
        yield told(counts)

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return rows.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def deletions(words: list[str]) -> tuple[np.ndarray, ...]:
    """For all keys of some words: the word's number, two hashes, and the first and last place whose letter is deleted
    to give it (-1 for the word itself)."""
    sizes = np.array([len(w) for w in words], np.int64)
    letters = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.uint64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    up, down = powers(len(letters) + 2)
    of = np.repeat(np.arange(len(words)), sizes)
    # Of a run of equal letters any deletion gives the same string: one key, from its first place to its last.
    first = np.ones(len(letters), bool)
    first[1:] = (letters[1:] != letters[:-1]) | (of[1:] != of[:-1])
    at = np.flatnonzero(first)
    last = np.append(at[1:], len(letters)) - 1
    s, e = starts[of[at]], ends[of[at]]
    hashes = []
    for k in (1, 2):
        total = np.empty(len(letters) + 1, np.uint64)
        total[0] = 0
        np.cumsum(mix(letters + np.uint64(k << 40)) * up[: len(letters)], out=total[1:])
        whole = (total[ends] - total[starts]) * down[starts] + sizes.astype(np.uint64)
        less = (total[at] - total[s]) * down[s] + (total[e] - total[at + 1]) * down[s + 1] + (e - s - 1).astype(np.uint64)
        hashes.append(mix(np.concatenate((whole, less))).view(np.int64))
    none = np.full(len(words), -1, np.int64)
    return np.concatenate((np.arange(len(words)), of[at])), *hashes, np.concatenate((none, at - s)), np.concatenate((none, last - s))


_KEYS = "h1 bigint, h2 bigint, place bigint, n bigint, a bigint, z bigint"


def keys(words: DataFrame) -> DataFrame:
    """Step 3: a row for each word (place, n, word) and key."""

    def some(column: list[str]) -> Iterator[tuple[int, int]]:
        lo, held = 0, 0
        for k, w in enumerate(column):
            held += len(w)
            if held >= BATCH:
                yield lo, k + 1
                lo, held = k + 1, 0
        if lo < len(column):
            yield lo, len(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("word").to_pylist()
            place, n = (batch.column(c).to_numpy() for c in ("place", "n"))
            for lo, hi in some(column):
                with np.errstate(over="ignore"):
                    of, h1, h2, a, z = deletions(column[lo:hi])
                of = of + lo
                for k in range(0, len(of), BATCH):
                    cut = slice(k, k + BATCH)
                    yield pa.RecordBatch.from_arrays([pa.array(x[cut]) for x in (h1, h2, place[of], n[of], a, z)], ["h1", "h2", "place", "n", "a", "z"])

    return words.select("place", "n", "word").mapInArrow(run, _KEYS)


def neighbours(words: DataFrame) -> DataFrame:
    """(place, n_near, near, near_n) of every word with words one edit away: how many, and the best of them."""
    given = keys(words)
    left = given.select("h1", "h2", *[F.col(c).alias(f"l_{c}") for c in ("place", "n", "a", "z")])
    right = given.select("h1", "h2", *[F.col(c).alias(f"r_{c}") for c in ("place", "n", "a", "z")])
    # Different words with one key: at most one of them is the key itself.
    one_edit = F.expr("l_a < 0 OR r_a < 0 OR greatest(l_a, r_a) <= least(l_z, r_z)")
    pairs = left.hint("merge").join(right, ["h1", "h2"]).filter((F.col("l_place") < F.col("r_place")) & one_edit)
    both = pairs.select(F.explode(F.array(*[F.struct(F.col(f"{x}_place").alias("place"), F.struct(F.col(f"{y}_place").alias("place"), F.col(f"{y}_n").alias("n")).alias("best")) for x, y in ("lr", "rl")])).alias("p")).select("p.*")
    return both.groupBy("place").agg(F.count("*").alias("n_near"), F.min("best").alias("best")).select("place", "n_near", F.col("best.place").alias("near"), F.col("best.n").alias("near_n"))


def roots(links: DataFrame) -> DataFrame:
    """(place, root): where each link (place, to) leads in the end. Links must not form circles."""
    now = materialize(links.select("place", F.col("to").alias("root")))
    while True:
        onward = now.select(F.col("place").alias("root"), F.col("root").alias("next"))
        after = materialize(now.hint("merge").join(onward, "root", "left").select("place", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        discard(now)
        now = after
        if after.filter("moved").isEmpty():
            return now.select("place", "root")


def variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word."""
    counts = count_words(docs).withColumn("less", -F.col("n"))
    words = materialize(ranked(counts, "less", "word").select(F.col("__place").alias("place"), "word", "n"))
    near = materialize(neighbours(words))
    formed = near.hint("merge").join(words.select("place", "n"), "place").filter(F.col("near_n") >= RATIO * F.col("n"))
    linked = materialize(formed.select("place", F.col("near").alias("to"), F.col("near_n").alias("form_n")))
    ends = roots(linked)
    named = lambda c: words.select(F.col("place").alias(c), F.col("word").alias(f"{c}_word")).hint("merge")
    told = linked.hint("merge").join(ends, "place").join(named("to"), "to").join(named("root"), "root").select("place", F.col("to_word").alias("form"), F.col("root_word").alias("root"), "form_n")
    out = words.hint("merge").join(near.select("place", "n_near").hint("merge"), "place", "left").join(told.hint("merge"), "place", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def op12(spark, sf_dir: str) -> DataFrame:
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
