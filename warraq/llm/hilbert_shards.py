"""Sharding along a Hilbert curve, so that shards are small boxes in several metadata dimensions.

Size, language and source are quantised to ``BITS`` bits each; a row's cell on the grid has an index
on the curve. A value of language or source is a step of its own, in order of value, where there are no
more than 2**BITS values; more of them share steps by equal shares of the rows. Rows are put in the order
(curve index, SHA-256 of the text, doc_id, size) and cut into runs whose row counts differ by one at most, so
equal texts of one cell stand side by side and are cut at a shard's edge only.

Indices of texts that have several are found by a sum a text, made map-side, and joined to rows by digest: broadcast
up to ``BROADCAST_ROWS``, else by a merge whose hot digests Spark splits. The order is one sort by ranges of all its columns (``session.ranked``): a cell, or a text, that holds a third
of all rows is split by the columns after it, and no task sees more than its range.

Edge cases: a null text has no bytes and the checksum of the empty string, and is equal to it; null metadata
and a missing column are step 0 of their dimension. Repeated rows and repeated ids each get a slot of their
own. With fewer rows than shards, the last shards stay empty; an empty table gives an empty result. Extra
columns are ignored by ``place`` and kept by ``write_shards``, unless they carry the name of a result column
(cell, shard, slot), which then is replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from warraq.session import materialize, ranked

BITS, SHARDS = 5, 24
DIMENSIONS = ("lang", "source")
#: Texts with rows in several cells that are sent to every task (of 80 bytes each); more of them are joined by a shuffle.
BROADCAST_ROWS = 200_000


def steps(df: DataFrame, column: str, bits: int = BITS) -> list[str]:
    """The least value of each step above 0 of a text column, ascending: 2**bits - 1 values at most."""
    most = 1 << bits
    counts = materialize(df.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("v")).agg(F.count("*").alias("n")))
    if counts.limit(most + 1).count() <= most:
        return sorted((r.v for r in counts.collect()), key=lambda v: v.encode())[1:]
    # Rows before a value: those of the ranges of values before its own, and those before it in its range.
    laid = materialize(counts.repartitionByRange("v").withColumn("part", F.spark_partition_id()))
    parts = laid.groupBy("part").agg(F.sum("n").alias("n"))
    starts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("first"), F.sum("n").over(Window.partitionBy(F.lit(0))).alias("total"))
    before = laid.join(F.broadcast(starts), "part").withColumn("before", F.col("first") + F.sum("n").over(Window.partitionBy("part").orderBy("v")) - F.col("n"))
    least = before.groupBy(F.floor(F.col("before") * most / F.col("total")).alias("step")).agg(F.min("v").alias("v"))
    return sorted((r.v for r in least.collect()), key=lambda v: v.encode())[1:]


def _axes(df: DataFrame, bits: int = BITS) -> list[Column]:
    """Steps of the size (by octaves from 64 bytes on) and of each dimension."""
    octave = F.least(F.floor(F.log2(_size())).cast("int") - 6, F.lit((1 << bits) - 1))
    axes = [F.greatest(octave, F.lit(0))]
    for column in DIMENSIONS:
        least = steps(df, column, bits) if column in df.columns else []
        value = F.col(column).cast("string") if column in df.columns else F.lit(None)
        found = reduce(lambda n, v, x=value: n + (x >= v).cast("int"), least, F.lit(0))
        axes.append(F.coalesce(F.when(value.isNotNull(), found), F.lit(0)))
    return axes


def _whole() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def _size() -> Column:
    return F.octet_length(_whole()) + 8


def hilbert_index(axes: list[Column], bits: int = BITS) -> Column:
    """Skilling's transform of grid coordinates to a distance along the curve, as folds over the bits."""
    n = len(axes)
    state = F.array(*[a.cast("int") for a in axes])

    def put(x: Column, i: int, v: Column, first: Column | None = None) -> Column:
        return F.array(*[first if k == 0 and first is not None else v if k == i else F.get(x, F.lit(k)) for k in range(n)])

    def stepper(q: int, i: int):
        def step(x: Column) -> Column:
            here, first = F.get(x, F.lit(i)), F.get(x, F.lit(0))
            t = first.bitwiseXOR(here).bitwiseAND(F.lit(q - 1))
            swapped = put(x, i, here.bitwiseXOR(t), first.bitwiseXOR(t)) if i else x
            return F.when(here.bitwiseAND(F.lit(q)) != 0, put(x, 0, first.bitwiseXOR(F.lit(q - 1)))).otherwise(swapped)

        return step

    for q in [1 << b for b in range(bits - 1, 0, -1)]:
        for i in range(n):
            state = F.transform(F.array(state), stepper(q, i))[0]
    # Gray code: each axis takes in the one before it, then the last one's parity goes to all.
    running = lambda x: F.array(*[_xor([F.get(x, F.lit(k)) for k in range(i + 1)]) for i in range(n)])
    state = F.transform(F.array(state), running)[0]

    def parity(x: Column) -> Column:
        last = F.get(x, F.lit(n - 1))
        t = _xor([F.when(last.bitwiseAND(F.lit(1 << b)) != 0, F.lit((1 << b) - 1)).otherwise(F.lit(0)) for b in range(bits - 1, 0, -1)])
        return F.transform(x, lambda a: a.bitwiseXOR(t))

    state = F.transform(F.array(state), parity)[0]

    def interleave(x: Column) -> Column:
        out = F.lit(0)
        for b in range(bits - 1, -1, -1):
            for i in range(n):
                out = out + F.shiftright(F.get(x, F.lit(i)), b).bitwiseAND(F.lit(1)) * (1 << (b * n + n - 1 - i))
        return out

    return F.transform(F.array(state), interleave)[0]


def _xor(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out.bitwiseXOR(p)
    return out


def _cut(rows: DataFrame, shards: int) -> DataFrame:
    """Adds shard and slot to rows with their place, by counts that differ by one at most."""
    total = rows.count()
    low, more = total // shards, total % shards
    edge, place = more * (low + 1), F.col("__place")
    early, width = place < edge, max(low, 1)
    return rows.withColumns(
        {
            "shard": F.when(early, F.floor(place / (low + 1))).otherwise(more + F.floor((place - edge) / width)).cast("int"),
            "slot": F.when(early, place % (low + 1)).otherwise((place - edge) % width).cast("long"),
        }
    ).drop("__place")


def _keyed(docs: DataFrame) -> DataFrame:
    measured = {"__cell": hilbert_index(_axes(docs)), "__hash": F.sha2(_whole().cast("binary"), 256), "__size": _size().cast("long"), "__crc": F.crc32(_whole().cast("binary"))}
    return docs.withColumns(measured)


def _as_groups(keyed: DataFrame, keys: DataFrame) -> DataFrame:
    """``keyed`` with the least cell of each text in all its rows; ``keys`` has the same __hash and __cell."""
    ends = keys.groupBy("__hash").agg(F.min("__cell").alias("__least"), F.max("__cell").alias("__most"))
    several = materialize(ends.filter("__least < __most").select("__hash", "__least"))
    few = several.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    joined = keyed.join(F.broadcast(several) if few else several.hint("merge"), "__hash", "left")
    return joined.withColumn("__cell", F.coalesce("__least", "__cell")).drop("__least")


_ORDER = ("__cell", "__hash", "doc_id", "__size")


def place(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, lang, source, cell, shard, slot) for every row."""
    dimensions = [(F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string")).alias(c) for c in DIMENSIONS]
    # Written first: the sort reads its rows twice, once for the bounds of the ranges.
    rows = materialize(_keyed(docs).select("doc_id", *dimensions, *[c for c in (*_ORDER, "__crc") if c != "doc_id"]))
    return _cut(ranked(_as_groups(rows, rows), *_ORDER), shards).select("doc_id", F.col("__size").alias("size"), F.col("__crc").alias("text_crc32"), *DIMENSIONS, F.col("__cell").alias("cell"), "shard", "slot")


def manifest(placed: DataFrame) -> DataFrame:
    """What a reader prunes shards by: the least and greatest value of each dimension, the range of the
    curve, and the rows and bytes of each shard. A null bound tells that the shard has no value there."""
    ends = [end(c).alias(f"{name}_{c}") for c in ("cell", "size", *DIMENSIONS) for name, end in (("min", F.min), ("max", F.max))]
    return placed.groupBy("shard").agg(*ends, F.count("*").alias("n_rows"), F.sum("size").alias("n_bytes"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Writes the rows of ``docs`` with their cell and slot under ``path/rows``, one folder for each shard and each file
    in order of slot, and the manifest under ``path/manifest``. Texts are shuffled once, or twice where more than
    ``BROADCAST_ROWS`` of them have rows in several cells."""
    docs = docs.drop("cell", "shard", "slot")
    keyed = _keyed(docs)
    laid = _cut(ranked(_as_groups(keyed, keyed.select("__hash", "__cell")), *_ORDER), shards).withColumnRenamed("__cell", "cell")
    laid.select(*docs.columns, "cell", "shard", "slot").write.partitionBy("shard").parquet(f"{path}/rows")
    dimensions = [(F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string")).alias(c) for c in DIMENSIONS]
    manifest(docs.sparkSession.read.parquet(f"{path}/rows").select("shard", "cell", _size().cast("long").alias("size"), *dimensions)).write.parquet(f"{path}/manifest")


def op4(spark, sf_dir: str) -> DataFrame:
    placed = place(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _hilbert_sql(source: str, bits: int = BITS) -> tuple[str, str]:
    """CTEs that take ``source`` (x0, x1, x2 and other columns) to ``curve`` with the cell added."""
    parts, now = [], source
    for q in [1 << b for b in range(bits - 1, 0, -1)]:
        for i in range(3):
            t = f"CASE WHEN x{i} & {q} <> 0 THEN {q - 1} ELSE xor(x0, x{i}) & {q - 1} END"
            other = f", CASE WHEN x{i} & {q} <> 0 THEN x{i} ELSE xor(x{i}, {t}) END AS x{i}" if i else ""
            parts.append(f"h{q}_{i} AS (SELECT * REPLACE (xor(x0, {t}) AS x0{other}) FROM {now})")
            now = f"h{q}_{i}"
    parts.append(f"gray AS (SELECT * REPLACE (xor(x0, x1) AS x1, xor(xor(x0, x1), x2) AS x2) FROM {now})")
    parity = "0"
    for b in range(1, bits):
        parity = f"xor({parity}, CASE WHEN x2 & {1 << b} <> 0 THEN {(1 << b) - 1} ELSE 0 END)"
    parts.append(f"flat AS (SELECT * REPLACE (xor(x0, p) AS x0, xor(x1, p) AS x1, xor(x2, p) AS x2) FROM (SELECT *, {parity} AS p FROM gray))")
    bit = [f"((x{i} >> {b}) & 1) * {1 << (b * 3 + 2 - i)}" for b in range(bits) for i in range(3)]
    parts.append(f"curve AS (SELECT *, {' + '.join(bit)} AS cell FROM flat)")
    return ",\n".join(parts), "curve"


def _steps_sql(column: str, most: int = 1 << BITS) -> str:
    return f"""{column}_steps AS (SELECT v, dense_rank() OVER (ORDER BY CASE WHEN many THEN before * {most} // total ELSE r END) - 1 AS step FROM (
  SELECT v, row_number() OVER (ORDER BY v) AS r, sum(n) OVER (ORDER BY v) - n AS before, sum(n) OVER () AS total, count(*) OVER () > {most} AS many FROM (SELECT {column} AS v, count(*) AS n FROM documents WHERE {column} IS NOT NULL GROUP BY 1)))"""


#: The same by one sort. DuckDB has no CRC-32, so its table comes from the rule and a fold goes over the bytes.
OP4_SQL = f"""
WITH RECURSIVE entries AS (SELECT n, n::BIGINT AS c, 0 AS k FROM range(256) AS r(n)
  UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM entries WHERE k < 8),
crc AS (SELECT list(c ORDER BY n) AS m FROM entries WHERE k = 8),
{_steps_sql("lang")},
{_steps_sql("source")},
d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, octet_length(encode(coalesce(text, ''))) + 8 AS size FROM documents),
axes AS (SELECT doc_id, size::BIGINT AS size, sha256(text) AS hash, text,
  greatest(least(floor(log2(size))::INTEGER - 6, {(1 << BITS) - 1}), 0)::BIGINT AS x0, coalesce(l.step, 0)::BIGINT AS x1, coalesce(s.step, 0)::BIGINT AS x2
  FROM d LEFT JOIN lang_steps l ON l.v = lang LEFT JOIN source_steps s ON s.v = source),
{_hilbert_sql("axes")[0]},
grouped AS (SELECT * REPLACE (min(cell) OVER (PARTITION BY hash) AS cell) FROM curve),
placed AS (SELECT *, row_number() OVER (ORDER BY cell, hash, doc_id NULLS FIRST, size) - 1 AS place, count(*) OVER () AS total FROM grouped),
cut AS (SELECT *, total // {SHARDS} AS low, total % {SHARDS} AS more, (total % {SHARDS}) * (total // {SHARDS} + 1) AS edge FROM placed)
SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT)), lambda a, b: xor(a >> 8, m[(xor(a, b) & 255) + 1])), 4294967295) AS text_crc32, 'rows' AS law,
  (CASE WHEN place < edge THEN place // (low + 1) ELSE more + (place - edge) // greatest(low, 1) END)::INTEGER AS shard,
  (CASE WHEN place < edge THEN place % (low + 1) ELSE (place - edge) % greatest(low, 1) END)::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM cut, crc
"""
