"""From tagged text to chunks and the store."""

import datetime
import decimal
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from warraq.functions.identity import chunk_id, tree_fingerprint
from warraq.operators import dense, ingest, lexical
from warraq.queries import QUERIES
from warraq.session import materialize
from warraq.sources import store as store_module
from warraq.sources import tagged
from warraq.sources.store import Store, index_rows
from warraq.streaming.ingest import watch

TEXT = """######OpenITI#
#META# made for tests
#META#Header#End#

### | باب الأنهار
# تجري المِيَاهُ في الوادي
~~ ثم تصل إلى البحر
PageV03P041

# وتزرع القرى حولها.
### || فصل الجسور
# جسر من خشب وجسر من حجر.
PageV03P042

# سطر أخير بلا رقم.
"""
VERSION = "00#VERS#URI######: 0700Someone.KitabAnhar.Lib0001-ara1\n90#VERS#ISSUES###: MISSING_PAGES, NO_NOTES\n80#VERS#COMMENT##: typed twice\n   note: compared\n"
BOOK = "00#BOOK#URI######: 0700Someone.KitabAnhar\n10#BOOK#GENRES###: RIVERS@geo\n10#BOOK#TITLEA#AR: Kitāb al-muʾallif\n"
AUTHOR = "00#AUTH#URI######: 0700Someone\n10#AUTH#SHUHRA#AR: فلان\n30#AUTH#DIED###AH: 0701-XX-XX\n"


def raw(spark, text):
    return spark.createDataFrame([("k", text)], "key string, raw string")


def documents(spark, text=TEXT, version=VERSION, book=BOOK, author=AUTHOR):
    return tagged.documents(*[raw(spark, x) for x in (text, version, book, author)])


def test_document(spark):
    d = documents(spark).first()
    assert (d.version_uri, d.work_uri, d.language_code, d.death_year_ah) == ("0700Someone.KitabAnhar.Lib0001-ara1", "0700Someone.KitabAnhar", "ara1", 701)
    assert d.quality_issues == ["MISSING_PAGES", "NO_NOTES"] and d.title_display is None and d.genres == "RIVERS@geo" and d.name_display == "فلان"
    assert d.source_text_sha256 == hashlib.sha256(TEXT.encode()).hexdigest() and d.text_header.endswith("#META#Header#End#")
    assert d.version_metadata["80#VERS#COMMENT##"] == "typed twice\nnote: compared"


@pytest.mark.parametrize(("changed", "said"), [({"book": BOOK.replace("Anhar", "Other")}, "does not match"), ({"version": "x"}, "missing ':'"), ({"version": " x"}, "preceding key"), ({"text": "no mark"}, "header end mark")])
def test_bad_documents(spark, changed, said):
    with pytest.raises(Exception, match=said):
        documents(spark, **changed).collect()


def test_chunks(spark):
    body = documents(spark).select("version_uri", "body")
    whole = body.first().body
    found = ingest.chunk_all(body).orderBy("sequence_no").collect()
    assert [c.sequence_no for c in found] == list(range(len(found)))
    for c in found:
        assert whole[c.source_start : c.source_end] == c.text_original and "PageV" not in c.text_original
        assert c.text_hash == hashlib.sha256(c.text_original.encode()).hexdigest()
        assert c.chunk_id == hashlib.sha256(f"{c.version_uri}\n{c.sequence_no}\n{c.text_hash}".encode()).hexdigest()
    at = lambda page: " ".join(c.text_normalized for c in found if c.page == page)
    assert "تجري المياه في الوادي" in at(41) and "وجسر من حجر" in at(42) and "سطر اخير بلا رقم" in at(None)
    assert {c.section_title for c in found if c.page == 41} == {"باب الأنهار"} and "فصل الجسور" in {c.section_title for c in found if c.page == 42}


def test_legacy_sections_only_without_explicit_ones(spark):
    body = "# | كتاب الجبال\n# سطر ms0011\nPageV02P001\n# | باب في وصف ms0012 الوديان\n# سطر\nPageV02P002"
    df = spark.createDataFrame([("a", body), ("b", body + "\n### | x\n# y")], "version_uri string, body string")
    found = ingest.chunk_all(df).collect()
    a = [c for c in found if c.version_uri == "a" and c.page == 2 and c.section_title != "كتاب الجبال"][0]
    assert a.section_path == ["كتاب الجبال", "باب في وصف الوديان"] and a.content_kind == "main_legacy_inferred"
    assert not any("ms00" in c.text_normalized for c in found if c.version_uri == "a")
    assert {c.content_kind for c in found if c.version_uri == "b"} == {"main"}


def test_packing_and_splitting(spark):
    def sizes(body, most=200):
        return [(c.source_start, c.source_end) for c in ingest.chunk(spark.createDataFrame([("v", body)], "version_uri string, body string"), most).orderBy("source_start").collect()]

    assert sizes("# " + "a" * 97 + "\n# " + "b" * 97 + "\n") == [(0, 200)]
    assert sizes("# " + "a" * 97 + "\n# " + "b" * 98 + "\n") == [(0, 100), (100, 201)]
    assert sizes("x" * 450) == [(0, 200), (200, 400), (400, 450)]
    assert sizes("x" * 150 + " " + "y" * 100) == [(0, 151), (151, 251)]
    assert sizes("x" * 100 + " " + "y" * 150) == [(0, 200), (200, 251)]
    with pytest.raises(ValueError):
        sizes("x", 199)


def test_skipped_levels_and_paratext(spark):
    body = "### | a\n# p\n### ||| c\n# q\n### |EDITOR|\n# r\n### | b\n# s"
    found = ingest.chunk(spark.createDataFrame([("v", body)], "version_uri string, body string")).orderBy("sequence_no").collect()
    assert [(c.section_path, c.content_kind) for c in found] == [(["a"], "main"), (["a", "c"], "main"), (["EDITOR"], "editor"), (["b"], "main")]


def test_files_lose_mark_and_carriage_returns(spark, tmp_path):
    (tmp_path / "t.txt").write_bytes("﻿a\r\nb\rc".encode())
    assert tagged.read_files(spark, str(tmp_path / "t.txt")).first().raw == "a\nb\nc"


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), indexed=False)
    make = lambda docs, **more: tagged.tables(docs, "p", "http://x", **more)
    store.commit(make(documents(spark), quality_status="ACCEPTED", license="L"))
    n = store.read("chunks").count()
    store.commit(make(documents(spark, author=AUTHOR.replace("10#AUTH#SHUHRA#AR: فلان\n", ""))))
    assert store.read("chunks").count() == n
    assert store.read("authors").first().name_display == "فلان" and store.read("text_versions").first().quality_status == "ACCEPTED" and store.read("sources").first().license == "L"
    with pytest.raises(ValueError, match="another text"):
        store.commit(make(documents(spark, text=TEXT + "x")))
    two = documents(spark).unionByName(documents(spark, text=TEXT + "x"))
    with pytest.raises(ValueError, match="two texts"):
        Store(spark, str(tmp_path / "other")).commit(make(two))


def test_commits_keep_what_they_do_not_touch(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), indexed=False)
    made = [tagged.tables(documents(spark, version=VERSION.replace("KitabAnhar", f"Kitab{k}"), book=BOOK.replace("KitabAnhar", f"Kitab{k}")), "p", "http://x") for k in range(3)]
    for k, tables in enumerate(made):
        assert store.commit(tables) == f"{k + 1:012d}"
    per = {r.version_uri: r["count"] for r in store.read("chunks").groupBy("version_uri").count().collect()}
    assert len(per) == 3 and len(set(per.values())) == 1 and store.read("text_versions").count() == 3
    rows = index_rows(*[store.read(t) for t in ("chunks", "text_versions", "works")])
    assert rows.count() == sum(per.values()) and {r.source_text_sha256 for r in rows.collect()} == {hashlib.sha256(TEXT.encode()).hexdigest()}
    assert index_rows(store.read("chunks"), store.read("text_versions").withColumn("quality_status", F.lit("REJECTED")), store.read("works")).count() == 0
    folders = store._state(store.current())["chunks"]
    assert len({x.split("/")[1] for x in folders.values()}) > 1
    with pytest.raises(RuntimeError, match="another commit"):
        store._publish("000000000002", {})
    assert store.current() == "000000000003"


def test_a_writer_that_dies_locks_nothing(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "store"), indexed=False)
    assert store._publish(None, {"chunks": {}}) == "000000000001"
    left = tmp_path / "store/states/000000000002"
    left.write_text('{"chunks": {')
    assert store.current() == "000000000001" and store.read("text_versions") is None
    with pytest.raises(RuntimeError, match="another commit"):
        store._publish("000000000001", {})
    monkeypatch.setattr(store_module, "UNFINISHED", -1)
    assert store._publish("000000000001", {}) == "000000000002" == store.current()
    with pytest.raises(RuntimeError, match="another commit"):
        store._publish("000000000001", {})


def test_every_broken_rule_is_named(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), indexed=False)
    good = tagged.tables(documents(spark), "p", "http://x")
    chunks = good["chunks"]
    bad = good | {
        "text_versions": good["text_versions"].withColumn("quality_status", F.lit("FINE")).withColumn("source_key", F.lit("none")),
        "works": good["works"].withColumn("author_uri", F.lit("nobody")),
        "chunks": chunks.withColumn("page_side", F.lit("C")).withColumn("source_end", F.col("source_start")).unionByName(chunks.withColumn("version_uri", F.lit("other"))),
    }
    with pytest.raises(ValueError) as error:
        store.commit(bad)
    for said in ("quality_status is unknown (1 rows)", "page_side is neither", "source_end is not behind", "author_uri is not among authors (1, such as nobody)", "source_key is not among sources", "chunks: version_uri is not among text_versions (1, such as other)", "chunks: chunk_id is not unique"):
        assert said in str(error.value)
    assert store.current() is None and store.commit(good) == "000000000001"


def test_a_work_is_read_from_its_own_files(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), indexed=False)
    named = lambda k: [x.replace("KitabAnhar", f"Kitab{k}") for x in (VERSION, BOOK)]
    for k in (1, 2):
        version, book = named(k)
        store.commit(tagged.tables(documents(spark, version=version, book=book), "p", "http://x"))
    every, one = store.read("chunks"), store.chunks_of("0700Someone.Kitab2")
    assert len(one.inputFiles()) == 1 < len(every.inputFiles())
    assert one.count() == every.filter("work_uri = '0700Someone.Kitab2'").count() > 0
    assert "PushedFilters: [IsNotNull(work_uri), EqualTo(work_uri" in one._jdf.queryExecution().executedPlan().toString()


def test_the_index_follows_commits(spark, tmp_path):
    """A commit lists the parts of its own versions anew; the ranking is that of a scan, with the status there is now."""
    store = Store(spark, str(tmp_path / "store"))
    make = lambda k, status="UNREVIEWED": tagged.tables(documents(spark, version=VERSION.replace("KitabAnhar", f"Kitab{k}"), book=BOOK.replace("KitabAnhar", f"Kitab{k}"), text=TEXT + f"# نهر كبير {'ابيض ' * k}\n"), "p", "http://x", quality_status=status)
    asked = materialize(lexical.analyze(spark.createDataFrame([(1, "النهر الكبير", None), (2, "ابيض", None), (3, "تجري المياه", "0700Someone.Kitab1")], "query_id long, query string, work_uri string")))
    before = {}
    for k in (1, 2):
        store.commit(make(k))
        now = store._state(store.current())["lists"]
        assert sum(now[b] != before.get(b) for b in now) == 1
        before = now

    def same():
        told = store.read("text_versions").select("version_uri", "quality_status")
        chunks = store.read("chunks").join(told, "version_uri")
        columns = ("query_id", "rank", "chunk_id", "score", "hits", "matched_terms")
        assert sorted(map(tuple, store.search(asked, 5).select(*columns).collect())) == sorted(map(tuple, lexical.search_batch(lexical.allowed(chunks), asked, 5).select(*columns).collect()))
        return {r.version_uri for r in store.search(asked, 50).collect()}

    assert len(same()) == 2
    store.commit(make(2, "REJECTED"))
    assert len(same()) == 1


def test_files_go_in_by_one_call(spark, tmp_path):
    for name, text in (("t", TEXT), ("v", VERSION), ("b", BOOK), ("a", AUTHOR)):
        (tmp_path / name).write_text(text)
    paths = [[str(tmp_path / n)] for n in "tvba"]
    store = Store(spark, str(tmp_path / "store"))
    dry = tagged.ingest_files(spark, None, *paths, dry_run=True)
    assert dry["mode"] == "dry-run" and store.current() is None
    told = dry["versions"]["0700Someone.KitabAnhar.Lib0001-ara1"]
    assert (told["n_pages"], told["n_inferred"], told["n_headings"]) == (2, 0, 0)
    done = tagged.ingest_files(spark, store, *paths, provider="p", source_url="http://x", quality_status="ACCEPTED")
    assert done["versions"] == dry["versions"] and store.read("chunks").count() == told["n_chunks"]
    assert store.read("text_versions").first().source_metadata_sha256 == hashlib.sha256(VERSION.encode()).hexdigest()
    with pytest.raises(ValueError, match="source_url"):
        tagged.ingest_files(spark, store, *paths)
    with pytest.raises(ValueError, match="one file of each"):
        tagged.ingest_files(spark, store, paths[0], [], dry_run=True)


def test_headings_of_the_older_form_are_counted(spark):
    df = spark.createDataFrame([("a", "# | كتاب x\n# | y\n# | باب z"), ("b", "### | x\n# | كتاب x"), ("c", "")], "version_uri string, body string")
    assert {r.version_uri: r.n_headings for r in ingest.legacy_headings(df).collect()} == {"a": 2, "b": 0, "c": 0}


def test_stored_section_paths_and_metadata(spark):
    raw = [None, "[", '["a", "", null, 0, 1, false, "0"]', '"x"', "7", "[]", "plain"]
    df = spark.createDataFrame([(x,) for x in raw], "raw string")
    assert [r[0] for r in df.select(ingest.section_path(F.col("raw"))).collect()] == [[], ["["], ["a", "1", "0"], ["x"], ["7"], [], ["plain"]]
    assert spark.range(1).select(ingest.metadata_json(F.create_map(F.lit("b"), F.lit("1"), F.lit("a"), F.lit("é")))).first()[0] == '{"a":"é","b":"1"}'


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "t.txt").write_text(TEXT)
    store = Store(spark, str(tmp_path / "store"), indexed=False)

    def tables(batch):
        one = lambda x: batch.select("key", F.lit(x).alias("raw"))
        return tagged.tables(tagged.documents(batch, one(VERSION), one(BOOK), one(AUTHOR)), "p", "http://x")

    watch(spark, str(tmp_path / "in"), store, tables, str(tmp_path / "checkpoint")).awaitTermination(120)
    assert store.read("text_versions").count() == 1 and store.read("chunks").count() > 0
    ((stream, number),) = store._state(store.current())["batches"].items()
    assert len(stream) == 36 and number == 0
    # The batch again, as after a writer that died before its stream took note: no second state.
    again = {t: materialize(rows) for t, rows in tables(raw(spark, TEXT)).items()}
    assert store.commit(again, (stream, 0)) == store.current() == "000000000001"
    assert store.commit(again, (stream, 1)) == "000000000002" and store.commit(again, ("other", 0)) == "000000000003"
    assert store._state(store.current())["batches"] == {stream: 1, "other": 0}


def test_legacy_structure_reads_whole_texts(spark, tmp_path):
    words = [f"w{i % 97}" for i in range(3000)]
    made = [(i, " ".join(words[: i * 1000]) or "x", "en", "src1") for i in range(4)]
    spark.createDataFrame(made, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {}
    for r in QUERIES["legacy_structure"](spark, str(tmp_path)).orderBy("version_uri", "sequence_no").collect():
        found.setdefault(int(r.version_uri), []).append((r.source_start, r.source_end, r.text_hash))
    for i, text, lang, source in made:
        head = f"# | كتاب {source} ms0067 ب\n# نص ms0007 {lang}\n"
        body, cuts = f"{head}# | باب {lang}\n{text}\n", [0, len(head)]
        while len(body) - cuts[-1] > 1800:
            cuts.append(max(body.rfind(x, cuts[-1], cuts[-1] + 1800) for x in " \n") + 1)
        cuts.append(len(body))
        assert found[i] == [(a, b, hashlib.sha256(body[a:b].encode()).hexdigest()) for a, b in zip(cuts, cuts[1:], strict=False)]


_BASE = {}


def several(spark, k, status="ACCEPTED", **told):
    """The tables of one work, made once and named anew."""
    if not _BASE:
        docs = materialize(documents(spark, version=VERSION.replace("KitabAnhar", "Kitab0"), book=BOOK.replace("KitabAnhar", "Kitab0")))
        _BASE.update({"docs": docs} | {t: materialize(rows) for t, rows in tagged.tables(docs, "p", "http://x").items()})
    named = lambda df, *columns: df.withColumns({c: F.replace(F.col(c), F.lit("Kitab0"), F.lit(f"Kitab{k}")) for c in columns})
    chunks = named(_BASE["chunks"], "version_uri")
    return {
        "sources": tagged.tables(_BASE["docs"], "p", "http://x", **told)["sources"], "authors": _BASE["authors"], "works": named(_BASE["works"], "work_uri"),
        "text_versions": named(_BASE["text_versions"], "version_uri", "work_uri").withColumn("quality_status", F.lit(status)),
        "chunks": chunks.withColumn("chunk_id", chunk_id(F.col("version_uri"), F.col("sequence_no"), F.col("text_hash"))),
    }


def test_digests_follow_commits(spark, tmp_path, monkeypatch):
    """The digest of the store equals one made of all chunks after every commit, and a commit reads its own versions only."""
    store, read = Store(spark, str(tmp_path / "store"), indexed=False), []
    kept = lambda: index_rows(*[store.read(t) for t in ("chunks", "text_versions", "works")])
    assert store.fingerprint() == tree_fingerprint(spark.createDataFrame([], "chunk_id string, quality_status string, sequence_no int, text_hash string, version_uri string, work_uri string"))
    make = store_module.version_digests
    monkeypatch.setattr(store_module, "version_digests", lambda chunks: read.append({r.version_uri for r in chunks.select("version_uri").distinct().collect()}) or make(chunks))
    monkeypatch.setattr(store_module, "BUCKETS", 2)
    seen = []
    for k, status in ((0, "ACCEPTED"), (1, "REJECTED"), (0, "REVIEW_REQUIRED")):
        store.commit(several(spark, k, status))
        seen.append(store.fingerprint())
        assert seen[-1] == tree_fingerprint(kept()) and seen[-1].n_chunks == kept().count()
        assert read.pop() <= {f"0700Someone.Kitab{k}.Lib0001-ara1"} and not read
    assert len({r.fingerprint for r in seen}) == 2  # a version that is rejected from the start changes nothing
    # An index is held against the stored digest, and what came after it makes it stale.
    path = str(tmp_path / "vectors")
    dense.build(kept(), F.array(F.lit(1.0), F.lit(2.0)), path, "c", "m", 2)
    dense.check_fresh(store.read("chunks"), path, "c", store.fingerprint())
    store.commit(several(spark, 4))
    with pytest.raises(ValueError, match="stale"):
        dense.check_fresh(store.read("chunks"), path, "c", store.fingerprint())
    # A state from before there were digests gets all of them by its next commit.
    state = {k: v for k, v in store._state(store.current()).items() if k not in ("digests", "commit")}
    store._publish(store.current(), state)
    assert store.fingerprint() == tree_fingerprint(kept())
    store.commit(several(spark, 5))
    assert "digests" in store._state(store.current()) and store.fingerprint() == tree_fingerprint(kept())


def test_answers_are_whole_and_requests_are_bounded(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.commit(several(spark, 0, license="L", commercial_use_allowed="no", attribution_required="unknown"))
    store.commit(several(spark, 1, "REJECTED"))
    told = json.loads(store.answer("  جسر من خشب ", 5).first().json)
    assert list(told) == ["query", "normalized_query", "terms", "count", "retrieval", "generated_answer", "results"]
    assert (told["query"], told["retrieval"], told["generated_answer"], told["count"]) == ("جسر من خشب", "deterministic_lexical_v2", None, len(told["results"]))
    first, works = told["results"][0], {r["citation"]["work_uri"] for r in told["results"]}
    assert works == {"0700Someone.Kitab0"} and [r["rank"] for r in told["results"]] == list(range(1, told["count"] + 1))
    assert list(first) == ["rank", "score", "coverage", "matched_terms", "total_terms", "phrase_hits", "term_hits", "section_hits", "citation", "passage_original", "passage_normalized"]
    assert first["phrase_hits"] == 1 and "جسر من خشب" in first["passage_original"]
    cited = first["citation"]
    assert cited["rights"] == {"license": "L", "copyright_status": None, "commercial_use_allowed": False, "attribution_required": None}
    assert (cited["author"], cited["provider"], cited["source_url"], cited["section_title"], cited["page"]) == ("فلان", "p", "http://x", "فصل الجسور", 42)
    assert cited["source_text_sha256"] == hashlib.sha256(TEXT.encode()).hexdigest() and cited["bibliographic_provenance"]["verification_status"] == "UNVERIFIED"
    both = json.loads(store.answer("جسر", 5, include_rejected=True).first().json)
    assert {r["citation"]["quality_status"] for r in both["results"]} == {"ACCEPTED", "REJECTED"}
    none = json.loads(store.answer("غائب", work_uri="0700Someone.Kitab0").first().json)
    assert (none["count"], none["results"]) == (0, [])
    for query, bounds, said in ((" ", {}, "blank"), ("", {}, "query"), ("x" * 501, {}, "query"), ("x", {"limit": 51}, "limit"), ("x", {"limit": 0}, "limit"), ("x", {"work_uri": "u" * 256}, "work_uri"), ("جسر", {"preview_chars": 99}, "preview_chars")):
        with pytest.raises(ValueError, match=said):
            store.answer(query, **bounds)
    with pytest.raises(Exception, match="searchable terms"):
        store.answer("!").collect()


@pytest.mark.parametrize(("told", "held"), [("yes", True), (" No ", False), ("UNKNOWN", None), (True, True), (None, None)])
def test_rights_are_told_in_three_ways(spark, told, held):
    assert several(spark, 0, commercial_use_allowed=told)["sources"].first().commercial_use_allowed is held


def test_bad_rights_and_status(spark, tmp_path):
    with pytest.raises(Exception, match="yes, no, or unknown"):
        tagged.ingest_files(spark, None, ["t"], ["v"], dry_run=True, attribution_required="perhaps")
    with pytest.raises(ValueError, match="quality_status"):
        tagged.ingest_files(spark, None, ["t"], ["v"], dry_run=True, quality_status="GOOD")


def test_values_as_json_can_hold_them(spark):
    day, time = datetime.date(2026, 1, 2), datetime.datetime(2026, 1, 2, 3, 4, 5)
    kind = "a date, b timestamp, c timestamp, d map<int,date>, e array<struct<x:decimal(5,2),y:double>>, f string, g boolean, h binary, i struct<z:date>"
    row = (day, time, time.replace(microsecond=250000), {1: day}, [(decimal.Decimal("1.50"), 0.5)], "t", True, b"q", (day,))
    df = spark.createDataFrame([row, (None,) * 9], kind)
    out = df.select(F.to_json(ingest.json_safe(F.struct(*df.columns), df.schema), {"ignoreNullFields": "false"}))
    full, empty = (json.loads(r[0]) for r in out.collect())
    assert full == {"a": "2026-01-02", "b": "2026-01-02T03:04:05", "c": "2026-01-02T03:04:05.250000", "d": {"1": "2026-01-02"}, "e": [{"x": "1.50", "y": 0.5}], "f": "t", "g": True, "h": "q", "i": {"z": "2026-01-02"}}
    assert set(empty.values()) == {None}
