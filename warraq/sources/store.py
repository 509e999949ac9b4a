"""Immutable relational tables as snapshots: merge rules, guards and numbered states."""

from __future__ import annotations

import json
import time
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from warraq.functions.identity import root, version_digests
from warraq.operators import lexical, postings, present
from warraq.session import discard, materialize, ranked

STATUSES = ("UNREVIEWED", "REVIEW_REQUIRED", "ACCEPTED", "REJECTED")
SOURCE_RULES = {"provider": "new", "source_url": "new", "release": "new", "license": "coalesce", "copyright_status": "coalesce", "commercial_use_allowed": "coalesce", "attribution_required": "coalesce"}
AUTHOR_RULES = {"name_display": "coalesce", "death_year_ah": "coalesce", "metadata": "unless_empty", "metadata_sha256": "coalesce"}
WORK_RULES = {"author_uri": "new", "title_display": "coalesce", "genres": "coalesce", "metadata": "unless_empty", "metadata_sha256": "coalesce"}
VERSION_RULES = {
    "work_uri": "new", "source_key": "new", "version_id": "new", "language_code": "new", "quality_status": "reviewed", "quality_issues": "new", "metadata": "new", "text_header": "new", "source_text_sha256": "new", "source_metadata_sha256": "new",
}
KEYS = {"sources": ("source_key", SOURCE_RULES), "authors": ("author_uri", AUTHOR_RULES), "works": ("work_uri", WORK_RULES), "text_versions": ("version_uri", VERSION_RULES)}


def _merged(rule: str, new: Column, old: Column) -> Column:
    if rule == "coalesce":
        return F.coalesce(new, old)
    if rule == "unless_empty":
        return F.when(F.size(new) > 0, new).otherwise(F.coalesce(old, new))
    if rule == "reviewed":
        return F.when(new == "UNREVIEWED", F.coalesce(old, new)).otherwise(new)
    return new


def upsert(stored: DataFrame, incoming: DataFrame, key: str, rules: dict[str, str]) -> DataFrame:
    """Stored rows with incoming ones merged in by the rule of each column; untouched rows stay as they are."""
    old = stored.select(key, F.struct(*[F.col(c) for c in rules]).alias("old"))
    new = incoming.select(key, F.struct(*[F.col(c) for c in rules]).alias("new"))
    both = old.join(new, key, "full_outer")
    merged = [F.when(F.col("new").isNull(), F.col(f"old.{c}")).otherwise(_merged(rule, F.col(f"new.{c}"), F.col(f"old.{c}"))).alias(c) for c, rule in rules.items()]
    return both.select(key, *merged)


def version_conflicts(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Versions that come again with another text; a version's text never changes."""
    old = stored.select("version_uri", F.col("source_text_sha256").alias("stored_sha256"))
    return incoming.select("version_uri", "source_text_sha256").join(old, "version_uri").filter(F.col("source_text_sha256") != F.col("stored_sha256"))


def replace_chunks(stored: DataFrame, incoming: DataFrame, versions: DataFrame) -> DataFrame:
    """All chunks of the versions that came, and no older chunk of theirs."""
    return stored.join(versions.select("version_uri").distinct(), "version_uri", "left_anti").unionByName(incoming)


def index_rows(chunks: DataFrame, versions: DataFrame, works: DataFrame) -> DataFrame:
    """What an index is built from: the chunks of versions that are not rejected, with their work, status and hash."""
    told = versions.filter(F.col("quality_status") != "REJECTED").select("version_uri", "work_uri", "quality_status", "source_text_sha256")
    return chunks.drop("work_uri").join(told.join(works.select("work_uri", "title_display"), "work_uri"), "version_uri")


#: Parts of the chunk table and its index, by work; a commit writes anew those of its versions.
BUCKETS = 64
#: Seconds after which an unfinished state file is what a writer that died has left.
UNFINISHED = 600
#: Orders of ingest: of a version in its commit, and of a chunk in its version, at most these many bits each.
_VERSION_BITS, _SEQUENCE_BITS = 22, 22
_INDEX = ("lists", "heads", "words")


def _bucket(work_uri: Column) -> Column:
    return F.pmod(F.xxhash64(work_uri), F.lit(BUCKETS)).cast("int")


def _missing(*names: str) -> dict[str, Column]:
    return {f"{n} is missing": F.col(n).isNull() for n in names}


def row_rules(table: str) -> dict[str, Column]:
    """What is wrong with a row of a table, by rule."""
    c = F.col
    return {
        "sources": lambda: _missing("source_key", "provider", "source_url"),
        "authors": lambda: _missing("author_uri", "metadata"),
        "works": lambda: _missing("work_uri", "author_uri", "metadata"),
        "text_versions": lambda: _missing("version_uri", "work_uri", "source_key", "version_id", "quality_issues", "metadata", "text_header", "source_text_sha256", "source_metadata_sha256")
        | {"quality_status is unknown": ~F.coalesce(c("quality_status").isin(*STATUSES), F.lit(False))},
        "chunks": lambda: _missing("chunk_id", "version_uri", "sequence_no", "text_original", "text_normalized", "text_hash", "section_path", "content_kind")
        | {
            "source_start is negative": F.coalesce(c("source_start") < 0, F.lit(True)), "source_end is not behind source_start": F.coalesce(c("source_end") <= c("source_start"), F.lit(True)),
            "page_side is neither A nor B": ~F.coalesce(c("page_side").isin("A", "B"), F.lit(True)), "a hash is not of 64 characters": F.coalesce((F.length("chunk_id") != 64) | (F.length("text_hash") != 64), F.lit(False)),
        },
    }[table]()


def table_rules(tables: dict[str, DataFrame]) -> DataFrame:
    """(rule, n, example) of the keys that repeat and the references that lead nowhere. One plan: each rule gives the
    keys that break it, and all are counted together."""

    def repeated(table: str, *keys: str) -> DataFrame:
        twice = tables[table].groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
        return twice.select(F.lit(f"{table}: {', '.join(keys)} is not unique").alias("rule"), F.concat_ws(" ", *[F.col(k).cast("string") for k in keys]).alias("key"))

    def dangling(table: str, key: str, to: str) -> DataFrame:
        lost = tables[table].filter(F.col(key).isNotNull()).select(key).distinct().join(tables[to].select(key), key, "left_anti")
        return lost.select(F.lit(f"{table}: {key} is not among {to}").alias("rule"), F.col(key).alias("key"))

    found = [repeated("chunks", "chunk_id"), repeated("chunks", "version_uri", "sequence_no")]
    found += [dangling(*x) for x in (("works", "author_uri", "authors"), ("text_versions", "work_uri", "works"), ("text_versions", "source_key", "sources"), ("chunks", "version_uri", "text_versions"))]
    return reduce(DataFrame.unionByName, found).groupBy("rule").agg(F.count("*").alias("n"), F.min("key").alias("example"))


class Store:
    """Tables under one path, with the inverted index of the chunks (``operators.postings``). A commit writes new
    snapshots of the small tables, of the parts of chunks and index that its works fall into, and then its state: which
    folder each table and part is in. Rules of rows are observed by the writes themselves, those of keys and
    references by one plan after them, and what breaks any names all rules that it breaks before it is made current.

    States are numbered files that never change, and one is whole from its last character on. Whoever creates the next
    number's file has made the commit, so of two made from one state the second fails and can be made again. A file
    that its writer left unfinished is no state; after ``UNFINISHED`` seconds another commit takes its number."""

    def __init__(self, spark: SparkSession, path: str, indexed: bool = True):
        self.spark, self.path, self.indexed = spark, path.rstrip("/"), indexed

    def _fs(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def _states(self) -> list[str]:
        """Names of the state files, ascending."""
        fs, target = self._fs(f"{self.path}/states")
        return sorted(n for x in fs.listStatus(target) if (n := x.getPath().getName()).isdigit()) if fs.exists(target) else []

    def _told(self, name: str) -> str:
        rows = self.spark.read.text(f"{self.path}/states/{name}", wholetext=True).collect()
        return rows[0][0] if rows else ""

    def current(self) -> str | None:
        """The name of the last state."""
        return next((n for n in reversed(self._states()) if self._told(n).endswith("}\n")), None)

    def _state(self, name: str | None) -> dict:
        return json.loads(self._told(name)) if name else {}

    def read(self, table: str) -> DataFrame | None:
        return self._read(self._state(self.current()), table)

    def _read(self, state: dict, table: str, parts: list[str] | None = None) -> DataFrame | None:
        folders = sorted(x for b, x in state.get(table, {}).items() if parts is None or b in parts)
        return self.spark.read.parquet(*[f"{self.path}/{x}" for x in folders]) if folders else None

    def chunks_of(self, work_uri: str) -> DataFrame | None:
        """The chunks of one work, from the files of its part alone; in these, rows stand in order of work."""
        part = self.spark.range(1).select(_bucket(F.lit(work_uri))).first()[0]
        held = self._read(self._state(self.current()), "chunks", [str(part)])
        return None if held is None else held.filter(F.col("work_uri") == work_uri)

    def index(self) -> postings.Index | None:
        """The inverted index of the current state."""
        state = self._state(self.current())
        tables = [self._read(state, t) for t in _INDEX]
        return None if any(t is None for t in tables) else postings.Index(*tables)

    def search(self, queries: DataFrame, limit: int = 10, candidate_limit: int | None = None, include_rejected: bool = False) -> DataFrame:
        """``lexical.search_batch`` of analyzed queries over the current chunks, by the index that is stored."""
        index = self.index()
        if index is None:
            raise ValueError("this store has no chunks, or no index of them")
        return postings.search_batch(index, self.read("chunks"), queries, limit, candidate_limit, include_rejected)

    def fingerprint(self) -> Row:
        """``identity.tree_fingerprint`` of the chunks that are not rejected, from the digests that commits keep: one
        row a version is read, and no chunk."""
        state = self._state(self.current())
        held = self._read(state, "digests")
        if held is None:
            held = self.spark.createDataFrame([], "work_uri string, version_uri string, digest string, n_chunks long") if "digests" in state or "chunks" not in state else self._digests(state)
        return root(held)

    def _digests(self, state: dict, parts: list[str] | None = None, came: DataFrame | None = None) -> DataFrame:
        """The digests of a state's versions, or of those that came."""
        chunks, versions, works = self._read(state, "chunks", parts), self._read(state, "text_versions"), self._read(state, "works")
        return version_digests(index_rows(chunks if came is None else chunks.join(came, "version_uri", "left_semi"), versions, works))

    def cited(self, results: DataFrame) -> DataFrame:
        """Results with what a citation says of their version, source, work and author."""
        state = self._state(self.current())
        versions, works, authors, sources = (self._read(state, t) for t in ("text_versions", "works", "authors", "sources"))
        held = versions.select("version_uri", "source_key", "quality_status", "quality_issues", "source_text_sha256", "source_metadata_sha256")
        named = works.select("work_uri", "author_uri", F.col("title_display").alias("work_title"))
        out = lexical.small(results).join(held, "version_uri").join(sources, "source_key").drop("source_key")
        return out.join(named, "work_uri").join(authors.select("author_uri", F.col("name_display").alias("author_name")), "author_uri")

    def answer(self, query: str, limit: int = 10, work_uri: str | None = None, include_rejected: bool = False, preview_chars: int | None = None) -> DataFrame:
        """One row, ``json``: the answer to one request, which is held to the bounds of requests first. It has ranked
        passages with their citations, and no generated text."""
        asked = lexical.check_request(query, limit, work_uri)
        queries = lexical.analyze(self.spark.createDataFrame([(0, asked, work_uri)], "query_id int, query string, work_uri string"))
        found = materialize(self.search(queries, limit, include_rejected=include_rejected).drop("query", "normalized", "terms"))
        told = present.payload(self.cited(found), present.catalog(self.spark), preview_chars)
        return present.response(told, queries).select(F.to_json(F.struct(*present.ANSWER), {"ignoreNullFields": "false"}).alias("json"))

    def _publish(self, base: str | None, state: dict) -> str:
        name, told = f"{int(base or 0) + 1:012d}", json.dumps(state | {"commit": {"id": uuid.uuid4().hex}}) + "\n"
        fs, final = self._fs(f"{self.path}/states/{name}")
        fs.mkdirs(final.getParent())
        if fs.exists(final) and not self._told(name).endswith("}\n") and time.time() - fs.getFileStatus(final).getModificationTime() / 1000 > UNFINISHED:
            fs.delete(final, False)
        try:
            out = fs.create(final, False)
        except Py4JJavaError as error:
            raise RuntimeError(f"another commit was made from state {base}") from error
        out.write(bytearray(told.encode()))
        out.close()
        if self._told(name) != told:
            raise RuntimeError(f"another commit took the number {name}")
        return name

    def _write(self, df: DataFrame, table: str, path: str, partition_by: str | None = None) -> list[str]:
        """Writes rows, and tells the rules that some of them break."""
        rules = row_rules(table)
        seen = Observation()
        writer = df.observe(seen, *[F.count_if(broken).alias(rule) for rule, broken in rules.items()]).write
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
        return [f"{table}: {rule} ({n} rows)" for rule, n in seen.get.items() if n]

    def commit(self, tables: dict[str, DataFrame], batch: tuple[str, int] | None = None) -> str:
        """Merges what came into the current state and makes the result current. ``batch``: the stream that it comes
        from and its number there; a state remembers the last of each stream, and a batch given again changes nothing."""
        base = self.current()
        state = self._state(base)
        if batch and state.get("batches", {}).get(batch[0], -1) >= batch[1]:
            return base
        # What came is derived once for each table: for the checks here, and by the writes below.
        versions, old = materialize(tables["text_versions"].select("version_uri", "source_text_sha256")), self._read(state, "text_versions")
        twice = versions.groupBy("version_uri").agg(F.count_distinct("source_text_sha256").alias("n")).filter("n > 1").limit(1).collect()
        if twice:
            raise ValueError(f"version {twice[0]['version_uri']} came with two texts")
        if old is not None:
            changed = version_conflicts(old, versions).limit(1).collect()
            if changed:
                raise ValueError(f"version {changed[0]['version_uri']} is stored with another text")
        name, new, broken, merged = uuid.uuid4().hex, {k: v for k, v in state.items() if k != "commit"}, [], {}
        for table, (key, rules) in KEYS.items():
            stored = self._read(state, table)
            rows = tables[table].select(key, *rules) if stored is None else upsert(stored, tables[table], key, rules)
            broken += self._write(rows.dropDuplicates([key]), table, f"{self.path}/snapshots/{name}/{table}")
            new[table] = {"all": f"snapshots/{name}/{table}"}
            merged[table] = self._read(new, table)
        works = merged["text_versions"].select("version_uri", "work_uri", "quality_status")
        came = versions.select("version_uri").distinct()
        # A version may have changed its work: the part it was in is written anew, too.
        homes = came.join(works, "version_uri").select("work_uri")
        homes = homes if old is None else homes.union(came.join(old, "version_uri").select("work_uri"))
        touched = sorted(str(r[0]) for r in homes.select(_bucket(F.col("work_uri"))).distinct().collect())  # BUCKETS at most
        number = int(base or 0) + 1
        order = F.lit(number).cast("long") * (1 << (_VERSION_BITS + _SEQUENCE_BITS)) + F.col("__place") * (1 << _SEQUENCE_BITS) + F.col("sequence_no")
        incoming = tables["chunks"].join(ranked(came, "version_uri"), "version_uri", "left").withColumn("ingest_order", order).drop("__place")
        stored = self._read(state, "chunks", touched)
        chunks = incoming if stored is None else replace_chunks(stored.drop("work_uri"), incoming, versions)
        placed = chunks.join(works.select("version_uri", "work_uri"), "version_uri", "left").withColumn("bucket", _bucket(F.col("work_uri")))
        broken += self._write(placed.repartition("bucket").sortWithinPartitions("bucket", "work_uri", "version_uri", "sequence_no"), "chunks", f"{self.path}/snapshots/{name}/chunks", "bucket")
        merged["chunks"] = self.spark.read.schema(placed.schema).parquet(f"{self.path}/snapshots/{name}/chunks")
        broken += [f"{r['rule']} ({r['n']}, such as {r['example']})" for r in table_rules(merged).collect()]
        if broken:
            discard(versions)
            raise ValueError("; ".join(sorted(broken)))
        fs, _ = self._fs(self.path)

        def laid(table: str, parts: list[str] = touched) -> None:
            there = {b: f"snapshots/{name}/{table}/bucket={b}" for b in parts}
            new[table] = {b: x for b, x in state.get(table, {}).items() if b not in there} | {b: x for b, x in there.items() if fs.exists(self._fs(f"{self.path}/{x}")[1])}

        laid("chunks")
        if self.indexed:
            part = self._read(new, "chunks", touched)
            if part is not None:
                told = part.join(works.select("version_uri", "quality_status"), "version_uri").withColumn("part", _bucket(F.col("work_uri")))
                listed = materialize(postings.lists(told))
                for table, rows in zip(_INDEX, (listed, postings.heads(told), postings.words(listed)), strict=True):
                    rows.withColumn("bucket", F.col("part")).repartition("bucket").sortWithinPartitions("bucket", "part", *([] if table == "heads" else ["key"])).write.partitionBy("bucket").parquet(f"{self.path}/snapshots/{name}/{table}")
                discard(listed)
            for table in _INDEX:
                laid(table)
        # A state that has no digests yet gets those of all its versions.
        had, parts = "digests" in state or "chunks" not in state, touched if "digests" in state else sorted(new["chunks"])
        if any(b in new["chunks"] for b in parts):
            rows = self._digests(new, parts, came if had else None)
            kept = self._read(state, "digests", parts)
            rows = rows if kept is None else rows.unionByName(kept.select(*rows.columns).join(came, "version_uri", "left_anti"))
            rows.withColumn("bucket", _bucket(F.col("work_uri"))).repartition("bucket").sortWithinPartitions("bucket", "work_uri").write.partitionBy("bucket").parquet(f"{self.path}/snapshots/{name}/digests")
        laid("digests", parts)
        if batch:
            new["batches"] = state.get("batches", {}) | {batch[0]: batch[1]}
        discard(versions)
        return self._publish(base, new)
