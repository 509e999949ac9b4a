"""Removal of every byte under a 200-byte string that starts at two places or more.

The difference-cover algorithm with period ``V`` = 133 in place of 3, bounded at the depth of 200 bytes
that the question asks for. The places of a text whose number modulo V lies in the cover ``COVER`` are
sampled; every residue modulo V is a difference of two members, so for any two places i and j some
shift d < V puts both i + d and j + d in the sample. Two equal 200-byte strings thus hold a sampled
tuple of 200 - V + 1 = 68 bytes at the same distance from their starts.

1. Sampled tuples are named by hash and brought together by name (buckets of the name, sorted inside).
2. Names recur to longer ones: a tuple's context, the 132 bytes before it and all that a 200-byte string
   over it can reach, is named too. Neighbours in order of (name, context) with equal contexts agree on
   every string over the tuple, which settles the inside of repeats, and such a class goes on as one.
3. Neighbours with one name but different contexts lie at the edge of a repeat. Only there the places off
   the sample are merged in: each start whose string holds such a tuple gets its string's name.
4. Neighbours of equal name in that order mark both strings as repeated; spans are joined per text.

Texts are split only at 3. and 4., and travel there compressed. All buckets have a size of their own
that does not grow with the input (``BUCKET`` entries or ``TEXT_BUCKET`` bytes; there are more of them
instead). Beyond ``COARSE`` buckets a task that sees little of each would send rows of a few entries, so entries are
dealt to coarse buckets first and, ``HOLD`` of them at once and in order of the coarse bucket, to the fine ones. A name that a sample of the texts shows to be hot is dealt over many buckets by text (``Hot``): a part of a
class that stands alone in its bucket goes on as an edge, and a hot string, seen twice in the sample, needs no
neighbour. So a passage in a third of all texts is split like any other load. Removal is decided by 128 bits inside repeats (name and
context) and by 96 at their edges (name and check): over 10**12 strings, chance equality is expected 6 times in a
million runs.

Edge cases: null counts as empty, and what is shorter than 200 bytes has no string. Matches never cross
texts. Repeated rows are found in each other; rows that agree in doc_id and text share one result, and where there are
very many of them (``COPIES``) one goes through the steps for all. Extra
columns are ignored by ``repeated_spans`` and kept by ``cut_repeats``. An empty table stays empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from warraq.llm.shingles import mix, powers
from warraq.session import discard, materialize

LENGTH, V = 200, 133
#: A perfect difference set modulo 133 (fixed values).
COVER = (0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109)
TUPLE = LENGTH - V + 1
BUCKET, TEXT_BUCKET, SLICE = 600_000, 8 << 20, 5 << 20
#: Buckets of one shuffle at most; entries that a task then deals out at once.
COARSE, HOLD = 4096, 2_000_000
#: Rows that agree in doc_id and text are one beyond so many copies, and beyond one row in so many: few enough to broadcast.
COPIES, COPIES_SHARE = 16, 1_000_000
_COVER = np.array(COVER)


def _frames():
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress, zstandard.ZstdDecompressor().decompress


#: A permutation of the byte values, by which the same sums name a string anew.
_OTHER = (mix(np.arange(256, dtype=np.uint64) + np.uint64(1)).argsort() * 257 + 1).astype(np.uint64)


def prefix_names(raw: np.ndarray) -> np.ndarray:
    """Running sums from which ``names`` takes the name of any string of the text."""
    total = np.empty(len(raw) + 1, np.uint64)
    total[0] = 0
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers(len(raw) + 1)[0][: len(raw)], out=total[1:])
    return total


def names(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((total[end] - total[start]) * powers(len(total))[1][start])


def checks(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A second name of 32 bits for strings of the text, from another function of its bytes."""
    other = prefix_names(_OTHER[raw])
    return (names(other, start, end) >> np.uint64(32)).astype(np.uint32)


def context(at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the 200-byte strings over a sampled tuple begin and end at most."""
    return np.maximum(at - (V - 1), 0), np.minimum(at + LENGTH, n)


def sampled(n: int) -> np.ndarray:
    places = (np.arange(0, n, V)[:, None] + _COVER[None, :]).ravel()
    return places[places <= n - TUPLE]


class Lists:
    """Numbers by text, packed: ids, counts, and the numbers of each text as differences."""

    @staticmethod
    def pack(ids: np.ndarray, values: np.ndarray) -> dict:
        """Entries must stand in order of text; values may have any order within it."""
        compress, _ = _frames()
        first = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1]))) if len(ids) else np.empty(0, np.int64)
        counts = np.diff(np.append(first, len(ids)))
        steps = np.diff(values.astype(np.int64), prepend=0).astype("<i8").view(np.uint8).reshape(-1, 8).T
        return {"ids": ids[first].astype("<i8").tobytes(), "counts": compress(counts.astype("<u4").tobytes()), "at": compress(np.ascontiguousarray(steps).tobytes())}

    @staticmethod
    def open(ids: bytes, counts: bytes, at: bytes) -> tuple[np.ndarray, np.ndarray]:
        _, decompress = _frames()
        steps = np.frombuffer(decompress(at), np.uint8).reshape(8, -1).T
        return np.repeat(np.frombuffer(ids, "<i8"), np.frombuffer(decompress(counts), "<u4")), np.cumsum(np.ascontiguousarray(steps).view("<i8").ravel())

    @staticmethod
    def unpack(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        parts = [Lists.open(a, b, c) for a, b, c in zip(frame["ids"], frame["counts"], frame["at"], strict=True)]
        ids, values = zip(*parts, strict=True) if parts else ((np.empty(0, np.int64),), (np.empty(0, np.int64),))
        return np.concatenate(ids), np.concatenate(values)


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The entries of each bucket that has any, in their order."""
    order = np.argsort(bucket, kind="stable")
    held = bucket[order]
    edges = np.flatnonzero(np.concatenate(([True], held[1:] != held[:-1]))) if len(held) else np.empty(0, np.int64)
    for a, z in zip(edges.tolist(), [*edges[1:].tolist(), len(held)], strict=True):
        yield int(held[a]), order[a:z]


def _bucket_of(name: np.ndarray, n: int) -> np.ndarray:
    return ((name >> np.uint64(32)) % np.uint64(n)).astype(np.int64)


def _slices(column: pa.Array) -> Iterator[tuple[int, int]]:
    lo, held = 0, 0
    sizes = pa.compute.binary_length(column).fill_null(0).to_pylist()
    for k, x in enumerate(sizes):
        held += x
        if held >= SLICE:
            yield lo, k + 1
            lo, held = k + 1, 0
    if lo < len(sizes):
        yield lo, len(sizes)


class Hot:
    """Names that a sample shows to fill more than a quarter of a bucket: their entries are dealt over ``extra``
    buckets of their own by text. Which names are here changes where work is done, never its result."""

    def __init__(self, names: list[int], counts: list[int], checks: list[int] | None = None):
        order = np.argsort(np.array(names, np.int64).view(np.uint64))
        self.names = np.array(names, np.int64).view(np.uint64)[order]
        self.checks = None if checks is None else np.array(checks, np.int64).astype(np.uint32)[order]
        self.extra = -(-sum(counts) // (BUCKET // 4)) if names else 0

    def holds(self, cols: dict[str, np.ndarray]) -> np.ndarray:
        if not len(self.names):
            return np.zeros(len(cols["name"]), bool)
        at = np.minimum(np.searchsorted(self.names, cols["name"]), len(self.names) - 1)
        found = self.names[at] == cols["name"]
        return found if self.checks is None else found & (self.checks[at] == cols["check"])


#: One text in so many is looked at for hot names; of these, so many are told apart at most, the most frequent first.
SAMPLE, HOT_NAMES = 64, 100_000


def _hot(named: DataFrame, share: int, keys: list[str]) -> Hot:
    """The hot ones of a sample's names (rows of ``keys``), of which one in ``share`` is seen."""
    counts = named.groupBy(*keys).agg(F.count("*").alias("n")).filter((F.col("n") * share > BUCKET // 4) & (F.col("n") > 1))
    found = counts.orderBy(F.desc("n"), *keys).limit(HOT_NAMES).collect()
    return Hot([r["name"] for r in found], [r["n"] * share for r in found], [r["check"] for r in found] if "check" in keys else None)


def _named(ids, ats, keys: dict[str, list], buckets: int, hot: Hot, coarse: int | None = None) -> Iterator[dict]:
    """Rows of one slice, dealt by name, or by coarse buckets of names; hot names go to buckets beyond the others."""
    if not ids:
        return
    ids, ats = np.concatenate(ids), np.concatenate(ats)
    cols = {k: np.concatenate(v) for k, v in keys.items()}
    bucket = _bucket_of(cols["name"], buckets)
    if hot.extra:
        held = hot.holds(cols)
        with np.errstate(over="ignore"):
            bucket[held] = buckets + (mix(ids[held].view(np.uint64) + cols["name"][held]) % np.uint64(hot.extra)).astype(np.int64)
    for b, pick in _by_bucket(bucket % coarse if coarse else bucket):
        yield {"bucket": b} | Lists.pack(ids[pick], ats[pick]) | {k: v[pick].tobytes() for k, v in cols.items()}


_NAMED = "bucket int, ids binary, counts binary, at binary, name binary"


def _tuples(batch: pa.RecordBatch) -> Iterator[tuple[list, list, dict[str, list]]]:
    """Ids, places, names and contexts of all sampled tuples, slice by slice."""
    for lo, hi in _slices(batch.column("text")):
        ids, ats, keys = [], [], {"name": [], "context": []}
        for uid, x in zip(batch.column("uid")[lo:hi].to_pylist(), batch.column("text")[lo:hi], strict=True):
            raw = np.frombuffer(x.as_buffer(), np.uint8) if x.is_valid else np.empty(0, np.uint8)
            n = len(raw)
            if n < LENGTH:
                continue
            with np.errstate(over="ignore"):
                total, at = prefix_names(raw), sampled(n)
                a, z = context(at, n)
                keys["name"].append(names(total, at, at + TUPLE))
                keys["context"].append(mix(names(total, a, z) + (at - a).astype(np.uint64) * np.uint64(1 << 32) + (z - a).astype(np.uint64)))
            ids.append(np.full(len(at), uid, np.int64))
            ats.append(at)
        if ids:
            yield ids, ats, keys


def _finer(packed: DataFrame, key: str, keys: dict[str, type], deal, schema: str, types: pa.Schema, entries: int) -> DataFrame:
    """Rows of coarse buckets dealt anew: ``deal`` gets ids, places, kinds and keys of many entries of one such bucket. It
    takes as many tasks as there are ``entries``, whatever the number of buckets."""
    salts = max(1, entries // (COARSE * 10 * HOLD))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                ids, at = Lists.open(row["ids"], row["counts"], row["at"])
                held.append((ids, at, np.full(len(ids), row.get("kind", 0)), {k: np.frombuffer(row[k], t) for k, t in keys.items()}))
                n += len(ids)
                if n >= HOLD:
                    yield pa.RecordBatch.from_pylist(deal(held), types)
                    held, n = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(deal(held), types)

    return packed.repartition(key, F.pmod(F.xxhash64("ids"), F.lit(salts))).sortWithinPartitions(key).mapInArrow(run, schema)


def _binaries(first: str, *names: str) -> pa.Schema:
    return pa.schema([(first, pa.int32())] + [(k, pa.int32() if k == "kind" else pa.binary()) for k in names])


def _fine_names(packed: DataFrame, keys: dict[str, type], buckets: int, hot: Hot, schema: str, entries: int) -> DataFrame:
    def deal(held: list) -> list[dict]:
        return list(_named([x[0] for x in held], [x[1] for x in held], {k: [x[3][k] for x in held] for k in keys}, buckets, hot))

    return _finer(packed, "bucket", keys, deal, schema, _binaries("bucket", "ids", "counts", "at", *keys), entries)


def _fine_texts(packed: DataFrame, texts: int, entries: int) -> DataFrame:
    def deal(held: list) -> list[dict]:
        return _dealt(*(np.concatenate([x[k] for x in held]) for k in range(3)), texts)

    return _finer(packed, "home", {}, deal, _DEALT, _binaries("home", "kind", "ids", "counts", "at"), entries)


def _hot_tuples(rows: DataFrame) -> Hot:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, keys in _tuples(batch):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys["name"]).view(np.int64))], ["name"])

    return _hot(rows.filter(F.pmod(F.xxhash64("uid"), F.lit(SAMPLE)) == 0).select("uid", "text").mapInArrow(run, "name bigint"), SAMPLE, ["name"])


def _anchors(rows: DataFrame, buckets: int, hot: Hot) -> DataFrame:
    """Step 1: the names and contexts of all sampled tuples, by bucket of the name."""
    coarse = COARSE if buckets + hot.extra > COARSE else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, ats, keys in _tuples(batch):
                done = list(_named(ids, ats, keys, buckets, hot, coarse))
                yield pa.RecordBatch.from_pylist(done, _binaries("bucket", "ids", "counts", "at", "name", "context"))

    named = rows.select("uid", "text").mapInArrow(run, _NAMED + ", context binary")
    return _fine_names(named, {"name": np.uint64, "context": np.uint64}, buckets, hot, _NAMED + ", context binary", buckets * BUCKET) if coarse else named


#: What a list says of its places: strings over them repeat, or their strings must be looked at, or start repeated strings.
INSIDE, EDGE, STARTS = 0, 1, 2


def _dealt(ids: np.ndarray, at: np.ndarray, kind: np.ndarray, texts: int, coarse: int | None = None) -> list[dict]:
    """Rows of lists by the texts' buckets, or by coarse buckets of these."""
    order = np.lexsort((at, ids, kind))
    ids, at, kind = ids[order], at[order], kind[order]
    home = ids % texts % coarse if coarse else ids % texts
    return [{"home": b, "kind": k} | Lists.pack(ids[pick], at[pick]) for k in np.unique(kind).tolist() for b, sub in _by_bucket(home[kind == k]) for pick in [np.flatnonzero(kind == k)[sub]]]


_DEALT = "home int, kind int, ids binary, counts binary, at binary"
_DEALT_COLUMNS = ["home", "kind", "ids", "counts", "at"]


def _settle(anchors: DataFrame, texts: int, buckets: int) -> DataFrame:
    """Step 2: neighbours in order of name and context. A hot name is in several buckets, so there one place of each
    class counts as an edge: if its like are in other buckets, step 4 finds its strings beside theirs."""
    coarse = COARSE if texts > COARSE else None

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        pa.default_memory_pool().release_unused()
        ids, at = Lists.unpack(frame)
        name, ctx = (np.concatenate([np.frombuffer(x, np.uint64) for x in frame[k]]) for k in ("name", "context"))
        order = np.lexsort((ctx, name))
        name, ctx = name[order], ctx[order]
        new_name = np.concatenate(([True], name[1:] != name[:-1]))
        new_class = new_name | np.concatenate(([True], ctx[1:] != ctx[:-1]))
        of_class, of_name = np.cumsum(new_class) - 1, np.cumsum(new_name) - 1
        inside = np.bincount(of_class)[of_class] > 1
        classes = np.bincount(of_name[new_class])
        edge = new_class & ((classes[of_name] > 1) | (int(frame["bucket"].iloc[0]) >= buckets))
        picked = np.concatenate((order[inside], order[edge]))
        kind = np.concatenate((np.full(inside.sum(), INSIDE), np.full(edge.sum(), EDGE)))
        return pd.DataFrame(_dealt(ids[picked], at[picked], kind, texts, coarse), columns=_DEALT_COLUMNS)

    lists = anchors.groupBy("bucket").applyInPandas(run, _DEALT)
    return _fine_texts(lists, texts, buckets * BUCKET) if coarse else lists


def _packed(rows: DataFrame) -> DataFrame:
    """(home, uid, doc_id, body): texts as they travel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress, _ = _frames()
        for batch in batches:
            body = [compress(x.as_buffer().to_pybytes()) if x.is_valid else compress(b"") for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("home"), batch.column("uid"), batch.column("doc_id").cast(pa.int64()), pa.array(body, pa.binary())], ["home", "uid", "doc_id", "body"])

    return rows.select("home", "uid", "doc_id", "text").mapInArrow(run, "home int, uid bigint, doc_id bigint, body binary")


def _per_text(lists: pd.DataFrame, kind: int) -> dict[int, np.ndarray]:
    ids, at = Lists.unpack(lists[lists["kind"] == kind])
    order = np.lexsort((at, ids))
    ids, at = ids[order], at[order]
    first = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1]))) if len(ids) else np.empty(0, np.int64)
    return dict(zip(ids[first].tolist(), np.split(at, first[1:]), strict=True)) if len(ids) else {}


def _merge(packed: DataFrame, lists: DataFrame, buckets: int, hot: Hot) -> DataFrame:
    """Step 3: the names of all strings over edge tuples, by bucket of the name."""
    coarse = COARSE if buckets + hot.extra > COARSE else None

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        pa.default_memory_pool().release_unused()
        _, decompress = _frames()
        edges, done = _per_text(right, EDGE), []
        ids, ats, keys, seen, held = [], [], {"name": [], "check": []}, set(), 0
        for uid, body in zip(left["uid"].tolist(), left["body"], strict=True):
            if uid not in edges or uid in seen:
                continue
            seen.add(uid)
            raw = np.frombuffer(decompress(body), np.uint8)
            covered = np.zeros(len(raw) + 1, np.int32)
            at = edges[uid]
            np.add.at(covered, np.maximum(at - (V - 1), 0), 1)
            np.add.at(covered, np.minimum(at, len(raw) - LENGTH) + 1, -1)
            starts = np.flatnonzero(np.cumsum(covered)[: len(raw) - LENGTH + 1] > 0)
            with np.errstate(over="ignore"):
                keys["name"].append(names(prefix_names(raw), starts, starts + LENGTH))
                keys["check"].append(checks(raw, starts, starts + LENGTH))
            ids.append(np.full(len(starts), uid, np.int64))
            ats.append(starts)
            held += len(starts)
            if held > BUCKET:
                done += _named(ids, ats, keys, buckets, hot, coarse)
                ids, ats, keys, held = [], [], {"name": [], "check": []}, 0
        done += _named(ids, ats, keys, buckets, hot, coarse)
        return pd.DataFrame(done, columns=["bucket", "ids", "counts", "at", "name", "check"])

    strings = packed.groupBy("home").cogroup(lists.filter(F.col("kind") == EDGE).groupBy("home")).applyInPandas(run, _NAMED + ", check binary")
    return _fine_names(strings, {"name": np.uint64, "check": np.uint32}, buckets, hot, _NAMED + ", check binary", buckets * BUCKET) if coarse else strings


def _hot_strings(packed: DataFrame, lists: DataFrame, share: int) -> Hot:
    """Strings that a sample of the texts holds so often that all of them would fill a good part of a bucket."""
    sample = lambda df: df.filter(F.col("home") % share == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, check in zip(batch.column("name"), batch.column("check"), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(name.as_buffer(), np.int64)), pa.array(np.frombuffer(check.as_buffer(), np.uint32).astype(np.int64))], ["name", "check"])

    some = _merge(sample(packed), sample(lists), 8, Hot([], [])).select("name", "check")
    return _hot(some.mapInArrow(run, "name bigint, check bigint"), share, ["name", "check"])


def _pair(strings: DataFrame, texts: int, buckets: int) -> DataFrame:
    """Step 4: neighbours in order of the strings' names. A hot string was seen twice before."""
    coarse = COARSE if texts > COARSE else None

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        pa.default_memory_pool().release_unused()
        ids, at = Lists.unpack(frame)
        if int(frame["bucket"].iloc[0]) >= buckets:
            return pd.DataFrame(_dealt(ids, at, np.full(len(ids), STARTS), texts, coarse), columns=_DEALT_COLUMNS)
        name, check = (np.concatenate([np.frombuffer(x, t) for x in frame[k]]) for k, t in (("name", np.uint64), ("check", np.uint32)))
        order = np.lexsort((check, name))
        name, check = name[order], check[order]
        same = (name[1:] == name[:-1]) & (check[1:] == check[:-1])
        twice = np.zeros(len(name), bool)
        twice[1:] |= same
        twice[:-1] |= same
        picked = order[twice]
        return pd.DataFrame(_dealt(ids[picked], at[picked], np.full(len(picked), STARTS), texts, coarse), columns=_DEALT_COLUMNS)

    lists = strings.groupBy("bucket").applyInPandas(run, _DEALT)
    return _fine_texts(lists, texts, buckets * BUCKET) if coarse else lists


def spans(n: int, inside: np.ndarray | None, starts: np.ndarray | None) -> np.ndarray:
    """(start, end) of the maximal removed runs of a text of n bytes."""
    change = np.zeros(n + 1, np.int64)
    if inside is not None:
        a, z = context(inside, n)
        long = z - a >= LENGTH
        np.add.at(change, a[long], 1)
        np.add.at(change, z[long], -1)
    if starts is not None:
        np.add.at(change, starts, 1)
        np.add.at(change, starts + LENGTH, -1)
    gone = np.concatenate(([0], (np.cumsum(change)[:n] > 0).astype(np.int8), [0]))
    turn = np.flatnonzero(np.diff(gone))
    return turn.reshape(-1, 2)


def _applied(docs: DataFrame, result, schema: str, carried: list[str]) -> tuple[DataFrame, list[DataFrame]]:
    """``result(raw bytes, spans)`` for every row, as the columns of ``schema``; and the tables it reads."""
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("uid"))
    seen = materialize(keyed.groupBy("uid").agg(F.count("*").alias("copies"), F.sum(F.octet_length("text")).alias("n")))
    n_bytes, n_rows = (x or 0 for x in seen.agg(F.sum("n"), F.sum("copies")).first())
    texts = max(8, -(-n_bytes // TEXT_BUCKET))
    tuples = max(8, -(-n_bytes * len(COVER) // (V * BUCKET)))
    placed = keyed.withColumn("home", F.pmod("uid", F.lit(texts)).cast("int"))
    many = seen.filter(F.col("copies") > max(COPIES, n_rows // COPIES_SHARE)).select("uid")
    plain = rows = placed
    copied = None
    if not many.isEmpty():
        # Each string of theirs recurs in the other copies; one of them stays for other texts to be found in.
        plain, copied = placed.join(F.broadcast(many), "uid", "left_anti"), placed.join(F.broadcast(many), "uid", "left_semi")
        rows = plain.unionByName(copied.dropDuplicates(["uid"]))
    hot = _hot_tuples(rows)
    lists = materialize(_settle(_anchors(rows, tuples, hot), texts, tuples))
    strings = max(8, -(-n_bytes // (8 * BUCKET)))
    # No string is more frequent than a tuple in it.
    frequent = _hot_strings(_packed(rows), lists, min(SAMPLE, max(1, texts // 8))) if hot.extra else Hot([], [])
    more = materialize(_pair(_merge(_packed(rows), lists, strings, frequent), texts, strings))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        pa.default_memory_pool().release_unused()
        _, decompress = _frames()
        inside, starts = _per_text(right, INSIDE), _per_text(right, STARTS)
        out = []
        for doc_id, uid, body in zip(left["doc_id"], left["uid"].tolist(), left["body"], strict=True):
            raw = decompress(body)
            doc_id = None if pd.isna(doc_id) else int(doc_id)
            out.append((doc_id, uid, *result(raw, spans(len(raw), inside.get(uid), starts.get(uid)))))
        return pd.DataFrame(out, columns=["doc_id", "uid", *carried])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, uid, x in zip(batch.column("doc_id").to_pylist(), batch.column("uid").to_pylist(), batch.column("text"), strict=True):
                raw = x.as_buffer().to_pybytes() if x.is_valid else b""
                out.append((doc_id, uid, *result(raw, np.array([[0, len(raw)]] if len(raw) >= LENGTH else [], np.int64).reshape(-1, 2))))
            yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=["doc_id", "uid", *carried]).astype({"doc_id": "Int64"}), preserve_index=False)

    told = lists.filter(F.col("kind") == INSIDE).union(more)
    schema = f"doc_id bigint, uid bigint, {schema}"
    out = _packed(plain).groupBy("home").cogroup(told.groupBy("home")).applyInPandas(run, schema)
    if copied is not None:
        out = out.unionByName(copied.select(F.col("doc_id").cast("long"), "uid", "text").mapInArrow(whole, schema))
    return out, [lists, more, seen]


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""

    def result(raw: bytes, gone: np.ndarray) -> tuple:
        kept, last = hashlib.sha256(), 0
        for a, z in gone.tolist():
            kept.update(raw[last:a])
            last = z
        kept.update(raw[last:])
        return len(raw), int((gone[:, 1] - gone[:, 0]).sum()), len(gone), kept.hexdigest()

    columns = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return _applied(docs, result, "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string", columns)[0].drop("uid")


def cut_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated spans cut from ``text`` and ``n_chars`` counted anew. A character of
    which only a part lies in a span stays."""

    def result(raw: bytes, gone: np.ndarray) -> tuple:
        if not len(gone):
            return None, False
        parts, last = [], 0
        for a, z in gone.tolist():
            while a < z and raw[a] & 0xC0 == 0x80:
                a += 1
            while z > a and z < len(raw) and raw[z] & 0xC0 == 0x80:
                z -= 1
            parts.append(raw[last:a])
            last = z
        parts.append(raw[last:])
        return b"".join(parts).decode(), True

    every, read = _applied(docs, result, "left string, cut boolean", ["left", "cut"])
    changed = materialize(every.filter("cut").select("uid", "left").dropDuplicates(["uid"]))
    for used in read:
        discard(used)
    joined = docs.withColumn("__uid", F.xxhash64("doc_id", "text")).join(changed.withColumnsRenamed({"uid": "__uid", "left": "__left"}), "__uid", "left")
    text = F.coalesce("__left", "text")
    out = {"text": text} | ({"n_chars": F.coalesce(F.length(text), F.lit(0)).cast("long")} if "n_chars" in docs.columns else {})
    return joined.select(*[out[c].alias(c) if c in out else F.col(c) for c in docs.columns])


def op8(spark, sf_dir: str) -> DataFrame:
    return repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
