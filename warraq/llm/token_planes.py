"""Token-id files: blocks of ids in byte or bit planes, each plane compressed, with a chunk index.

A file set is a folder with two Parquet tables. ``chunks`` has a row for each block of ``BLOCK`` ids:
its part and number, the first id's place in the part, and one zstandard frame for each plane of the
transposed block. ``index`` has a row for each document piece in a chunk, without the payload, so a
reader finds a document's chunks without touching the others. Parts follow the order of doc_id.

Ids are the library's defaults without its start and end tokens: a text that holds the string of an added
token has that token's id there.

Edge cases: null counts as empty, so the document is its end id alone. Repeated or null doc_ids are
documents of their own (nulls first). A text of any length spans as many chunks as it needs and no
buffer holds more than a chunk and an Arrow batch. An empty table gives empty files. Only the two
named columns are read.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from warraq.session import materialize, new_path

BLOCK = 1 << 16
TOKENIZER = "byte_bpe_50k.json"
#: Bytes of text in a part, where a row counts for some of its own.
PART_BYTES, ROW_BYTES = 16 << 20, 16
#: How many totals are summed up at once.
FAN = 1024
#: Bytes of words and ids, in columns, beyond which a worker keeps but those of its last texts, and the characters
#: beyond which a word is not kept.
CACHE_BYTES, LONGEST = 32 << 20, 64
LEVEL = 1
#: New words that the library sees as one text.
RUN = 256

#: White space that may join with a blank before it, and what marks the first word of a text and one after a line feed.
_ODD = "\x00\x01\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u180e\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Before a blank after what is white space to nobody.
_CUT = re.compile("(?<=[^\\s\u180e])(?= )")
#: What no word has that can be told apart in a run.
_WHITE = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in _ODD + " \n" if c != "\1") + "]"


@lru_cache(1)
def _tokenizer(path: str):
    """The library's tokenizer, as it is by default, the strings that it takes for tokens wherever they stand, and of each id
    whether its bytes begin with a blank or a line feed."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    added = tuple(t.content for t in tokenizer.get_added_tokens_decoder().values() if t.content)
    names = tokenizer.get_vocab()
    opens = np.zeros(max(names.values(), default=0) + 1, bool)
    opens[[k for name, k in names.items() if name[:1] in ("\u0120", "\u010a")]] = not any(" " in x or "\n" in x for x in added)
    return tokenizer, added, opens


class _Known:
    """The words that a job's tasks have met in this worker, and the ids of each, as Arrow columns."""

    def __init__(self):
        self.words, self.told = pa.array([], pa.large_string()), pa.array([], pa.large_binary())

    @property
    def ids(self) -> dict[str, bytes]:
        return dict(zip(self.words.to_pylist(), self.told.to_pylist(), strict=True))

    @property
    def size(self) -> int:
        return self.words.nbytes + self.told.nbytes


@lru_cache(1)
def _known(path: str, job: str) -> _Known:
    """Another job starts anew."""
    return _Known()


class PieceEncoder:
    """Ids of texts by the tokenizers library, which sees a distinct word once a worker and job while it is kept.

    Every scan of the byte-level split pattern cuts before a blank that follows another character than
    white space, and before a line feed that does, so what comes from one such place to the next may be encoded apart. A text
    that holds an added token's string is encoded as a whole. Short words are kept, up to ``CACHE_BYTES``, then those of the last texts alone; texts
    and long words never are. New words without white space are put one after another, ``RUN`` at a time, as one
    text, which costs the library less than half of what so many texts do; a word's ids begin where one begins with a blank or a line feed.

    Words are cut, numbered, looked up and put together as Arrow columns; none is a Python object on the way but the few that go to the library alone."""

    def __init__(self, path: str, job: str = ""):
        (self.tokenizer, self.added, self.opens), self.known = _tokenizer(path), _known(path, job)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        odd = [self._odd(x) for x in texts]
        # After a line feed a word has a one before it, the first of a text a zero.
        plain = ["\0" + x.replace("\n", " \1") for x, o in zip(texts, odd, strict=True) if x and not o]
        split = [self._split(x) for x, o in zip(texts, odd, strict=True) if o]
        words = pa.array([x for pieces in split for x in pieces], pa.large_string())
        if plain:
            words = pa.concat_arrays([pc.split_pattern(pa.array([" ".join(plain)], pa.large_string()), " ").flatten(), words])
        words = words.dictionary_encode()
        ids = self._ids(words.dictionary).take(words.indices)
        ends, data = _bytes(ids)
        cuts = ends[np.cumsum([0, *(x.count(" ") + 1 for x in plain), *map(len, split)])].tolist()
        of_plain, of_odd = zip(cuts, cuts[1:]), zip(cuts[len(plain) :], cuts[len(plain) + 1 :])
        return [b"" if not x else bytes(data[slice(*next(of_odd if o else of_plain))]) for x, o in zip(texts, odd, strict=True)]

    def _ids(self, words: pa.Array) -> pa.Array:
        """The ids of distinct words, known or new."""
        known = self.known
        at = pc.index_in(words, value_set=known.words)
        absent = at.is_null().to_numpy(zero_copy_only=False)
        new = words.filter(pa.array(absent))
        learned = self._learn(new)
        at = at.fill_null(0).to_numpy().astype(np.int64)
        at[absent] = len(known.words) + np.arange(len(new))
        ids = pa.concat_arrays([known.told, learned]).take(pa.array(at))
        fits = _fitting(new)
        known.words, known.told = pa.concat_arrays([known.words, new.filter(fits)]), pa.concat_arrays([known.told, learned.filter(fits)])
        if known.size > CACHE_BYTES:
            fits = _fitting(words)
            known.words, known.told = words.filter(fits), ids.filter(fits)
        if known.size > CACHE_BYTES:
            known.__init__()
        return ids

    def _learn(self, words: pa.Array) -> pa.Array:
        """The ids of new words: in runs of those that can be told apart there, the others each for itself."""
        length = pc.utf8_length(words).to_numpy()
        plain = (length > 0) & (length < LONGEST) & ~pc.match_substring_regex(words, _WHITE).to_numpy(zero_copy_only=False) & pc.not_equal(words, "\1").to_numpy(zero_copy_only=False)
        places, others, ids, sizes = np.flatnonzero(plain), [np.flatnonzero(~plain)], [], []
        learned = []
        cuts = np.append(np.arange(0, len(places), RUN), len(places))
        runs = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), words.take(pa.array(places))), pa.scalar(" ", pa.large_string())).to_pylist()
        for at in range(0, len(runs), 64):
            done = self.tokenizer.encode_batch_fast([(" " + x).replace(" \1", "\n") for x in runs[at : at + 64]], add_special_tokens=False)
            for k, e in enumerate(done, at):
                own, found = places[cuts[k] : cuts[k + 1]], np.array(e.ids, "<u4")
                begins = np.flatnonzero(self.opens[found])
                if len(begins) != len(own) or begins[0]:
                    others.append(own)
                    continue
                learned.append(own)
                ids.append(found)
                sizes.append(np.diff(begins, append=len(found)))
        others = np.concatenate(others)
        for at in range(0, len(others), 20_000):
            part = others[at : at + 20_000]
            done = self.tokenizer.encode_batch_fast([_piece(x) for x in words.take(pa.array(part)).to_pylist()], add_special_tokens=False)
            learned.append(part)
            ids += [np.array(e.ids, "<u4") for e in done]
            sizes.append(np.array([len(e.ids) for e in done], np.int64))
        if not learned:
            return pa.array([], pa.large_binary())
        ends = 4 * np.cumsum(np.concatenate([[0], *sizes]), dtype=np.int64)
        told = pa.Array.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(ends), pa.py_buffer(np.concatenate(ids).tobytes())])
        return told.take(pa.array(np.argsort(np.concatenate(learned))))

    def _odd(self, text: str) -> bool:
        """Whether blanks and line feeds alone do not tell a text's words."""
        return text != "" and ("  " in text or " \n" in text or "\n " in text or "\n\n" in text or text[0] == " " or text[-1] == " " or any(x in text for x in self.added) or any(x in text for x in _ODD))

    def _split(self, text: str) -> list[str]:
        """Pieces of an odd text: they stand for themselves with a blank before them; after a one, with a line feed; after a zero, for themselves
        alone; after two, for themselves and not to be kept."""
        if any(x in text for x in self.added):
            return ["\0\0" + text]
        return ["\0\0" + x if "\0" in x or "\1" in x else x[1:] if x[0] == " " else "\0" + x for x in _CUT.split(text)]


def _fitting(words: pa.Array) -> pa.Array:
    """Which words are to be kept."""
    return pc.and_(pc.less_equal(pc.utf8_length(words), LONGEST), pc.invert(pc.starts_with(words, "\0\0")))


def _bytes(column: pa.Array) -> tuple[np.ndarray, memoryview]:
    """Where the values begin and end in what they are one after another."""
    _, ends, data = column.buffers()
    if not len(column):
        return np.zeros(1, np.int64), memoryview(b"")
    return np.frombuffer(ends, np.int64)[: len(column) + 1], memoryview(data if data is not None else b"")


def _piece(key: str) -> str:
    return key[2:] if key[:2] == "\0\0" else key[1:] if key[:1] == "\0" else "\n" + key[1:] if key[:1] == "\1" else " " + key


def pack(ids: np.ndarray, planes: str = "byte") -> list[bytes]:
    """One zstandard frame for each plane of the block: four byte planes, or 32 bit planes."""
    import zstandard

    compress = zstandard.ZstdCompressor(level=LEVEL).compress
    data = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4).T
    if planes == "bit":
        data = np.concatenate([np.unpackbits(row.reshape(-1, 1), axis=1, bitorder="little").T for row in data])
        return [compress(np.packbits(row).tobytes()) for row in data]
    return [compress(np.ascontiguousarray(row).tobytes()) for row in data]


def unpack(frames, n: int) -> np.ndarray:
    import zstandard

    decompress = zstandard.ZstdDecompressor().decompress
    if len(frames) == 32:
        bits = np.stack([np.unpackbits(np.frombuffer(decompress(x), np.uint8), count=n) for x in frames])
        data = np.stack([np.packbits(bits[8 * k : 8 * k + 8].T, axis=1, bitorder="little")[:, 0] for k in range(4)])
    else:
        data = np.stack([np.frombuffer(decompress(x), np.uint8) for x in frames])
    return np.ascontiguousarray(data.T).view("<u4").reshape(-1)


CHUNKS = "part int, chunk int, n_ids int, first long, planes array<binary>, pieces array<struct<doc_id:bigint,ordinal:bigint,at:int,n:int,start:bigint,whole:boolean>>"


def write(docs: DataFrame, path: str, tokenizer_path: str | None = None, end_id: int = 0, planes: str = "byte", block: int = BLOCK) -> None:
    """Writes the ids of ``text``, each document ended by ``end_id``, in ascending doc_id order."""
    tokenizer_path = tokenizer_path or public_tokenizers.path(TOKENIZER)
    docs = docs.select("doc_id", "text")
    n_bytes = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES)).first()[0] or 0
    parts = max(1, -(-n_bytes // PART_BYTES))
    order = ("doc_id", F.xxhash64("text"))
    ordered = docs.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encoder = TaskContext.get().partitionId(), PieceEncoder(tokenizer_path, path)
        held: list[np.ndarray] = []
        pieces: list[dict] = []
        state = {"held": 0, "chunk": 0, "first": 0, "ordinal": 0}

        def flush() -> pa.RecordBatch:
            ids = np.concatenate(held)
            row = {"part": [part], "chunk": [state["chunk"]], "n_ids": [len(ids)], "first": [state["first"]], "planes": [pack(ids, planes)], "pieces": [list(pieces)]}
            state["chunk"] += 1
            state["first"] += len(ids)
            state["held"] = 0
            held.clear()
            pieces.clear()
            return pa.RecordBatch.from_pydict(row, _ARROW)

        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            for lo, hi in _slices(texts):
                found = encoder.encode(texts[lo:hi])
                for doc_id, packed in zip(batch.column("doc_id")[lo:hi].to_pylist(), found, strict=True):
                    ids = np.append(np.frombuffer(packed, "<u4"), np.uint32(end_id)).astype("<u4")
                    done, start = 0, state["first"] + state["held"]
                    while done < len(ids):
                        take = min(len(ids) - done, block - state["held"])
                        pieces.append({"doc_id": doc_id, "ordinal": state["ordinal"], "at": state["held"], "n": take, "start": start, "whole": take == len(ids)})
                        held.append(ids[done : done + take])
                        done += take
                        state["held"] += take
                        if state["held"] == block:
                            yield flush()
                    state["ordinal"] += 1
        if held:
            yield flush()

    ordered.mapInArrow(chunks, CHUNKS).write.parquet(f"{path}/chunks")
    spark = docs.sparkSession
    spark.read.parquet(f"{path}/chunks").select("part", "chunk", "first", "n_ids", F.explode("pieces").alias("p")).select("part", "chunk", "first", "n_ids", "p.*").write.parquet(f"{path}/index")


_PIECE = pa.struct([("doc_id", pa.int64()), ("ordinal", pa.int64()), ("at", pa.int32()), ("n", pa.int32()), ("start", pa.int64()), ("whole", pa.bool_())])
_ARROW = pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("n_ids", pa.int32()), ("first", pa.int64()), ("planes", pa.list_(pa.binary())), ("pieces", pa.list_(_PIECE))])


def _slices(texts: list[str], most: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``most`` characters."""
    lo, held = 0, 0
    for k, x in enumerate(texts):
        held += len(x)
        if held >= most:
            yield lo, k + 1
            lo, held = k + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def read_pieces(spark, path: str) -> DataFrame:
    """Every document piece with its ids, from the files: (part, ordinal, doc_id, chunk, start, n, whole, ids)."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack(row["planes"], row["n_ids"])
                p = row["pieces"]
                yield pa.RecordBatch.from_pydict(
                    {"part": [row["part"]] * len(p), "chunk": [row["chunk"]] * len(p), "ids": [ids[x["at"] : x["at"] + x["n"]].tobytes() for x in p]} | {k: [x[k] for x in p] for k in ("ordinal", "doc_id", "start", "n", "whole")},
                    _PIECES_OUT,
                )

    return spark.read.parquet(f"{path}/chunks").mapInArrow(pieces, "part int, chunk int, ids binary, ordinal bigint, doc_id bigint, start bigint, n int, whole boolean")


_PIECES_OUT = pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("ids", pa.binary()), ("ordinal", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n", pa.int32()), ("whole", pa.bool_())])


def documents(spark, path: str) -> DataFrame:
    """(part, ordinal, doc_id, start, n_tokens, ids_crc32) of every document, checked against the files.

    The checksum of a document that lies in one chunk is taken where the chunk is unpacked; only the
    few that span chunks bring their pieces together."""

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack(row["planes"], row["n_ids"])
                p = row["pieces"]
                cut = [ids[x["at"] : x["at"] + x["n"]].tobytes() for x in p]
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": [row["part"]] * len(p),
                        "chunk": [row["chunk"]] * len(p),
                        "ids_crc32": [zlib.crc32(c) if x["whole"] else None for c, x in zip(cut, p, strict=True)],
                        "ids": [None if x["whole"] else c for c, x in zip(cut, p, strict=True)],
                    }
                    | {k: [x[k] for x in p] for k in ("ordinal", "doc_id", "start", "n")},
                    _CHECKED,
                )

    chunks = spark.read.parquet(f"{path}/chunks")
    found = chunks.mapInArrow(checked, "part int, chunk int, ids_crc32 bigint, ids binary, ordinal bigint, doc_id bigint, start bigint, n int")
    piece = F.when(F.col("ids").isNotNull(), F.struct("chunk", F.hex("ids").alias("ids")))
    joined = found.groupBy("part", "ordinal").agg(F.first("doc_id").alias("doc_id"), F.first("start").alias("start"), F.sum("n").alias("n_tokens"), F.max("ids_crc32").alias("whole"), F.sort_array(F.collect_list(piece)).alias("p"))
    crc = F.coalesce("whole", F.crc32(F.unhex(F.array_join(F.col("p.ids"), ""))))
    before = starts(chunks.groupBy("part").agg(F.sum("n_ids").alias("n")))
    return joined.join(before, "part").select("part", "ordinal", "doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", crc.alias("ids_crc32"))


def starts(totals: DataFrame, fan: int = FAN) -> DataFrame:
    """(part, before): the sum of ``n`` over all lesser parts. Runs of ``fan`` parts are summed first, and their
    sums in the same way, so no task has more than ``fan`` rows of one run."""
    totals = materialize(totals)
    run = F.floor(F.col("part") / fan).cast("int")
    inside = totals.withColumns({"run": run, "before": F.coalesce(F.sum("n").over(Window.partitionBy(run).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    if (totals.agg(F.max("part")).first()[0] or 0) < fan:
        return inside.select("part", "before")
    above = starts(totals.groupBy(run.alias("part")).agg(F.sum("n").alias("n")), fan)
    return inside.join(above.select(F.col("part").alias("run"), F.col("before").alias("above")), "run").select("part", (F.col("before") + F.col("above")).alias("before"))


_CHECKED = pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("ids_crc32", pa.int64()), ("ids", pa.binary()), ("ordinal", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n", pa.int32())])


def op3(spark, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-planes")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return documents(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")
