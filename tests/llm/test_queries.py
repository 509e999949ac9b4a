"""Queries with SQL against DuckDB, and the pipeline against slow versions of its stages."""

import base64
import glob
import hashlib
import os

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from tests.llm import brute
from warraq.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    c = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, connection, name):
    df = QUERIES[name](spark, FOLDER)
    out = connection.execute(ORACLES[name])
    names = [d[0] for d in out.description]
    told = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    expected = sorted([told(dict(zip(names, r, strict=True))[c]) for c in sorted(names)] for r in out.fetchall())
    assert sorted(names) == sorted(df.columns) and sorted([told(r[c]) for c in sorted(names)] for r in df.collect()) == expected


def test_pipeline(spark, connection):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, FOLDER).cache()
        after[name] = docs.collect()
        assert name == "byte_bpe" or docs.columns == before.columns
    kept = {r[0] for r in connection.execute(f"SELECT doc_id FROM ({ORACLES['op5_quality_rules']}) WHERE kept").fetchall()}
    assert {r.doc_id for r in after["quality_rules"]} == kept
    rows = [(r.doc_id, r.text) for r in after["quality_rules"]]
    groups, _ = brute.near_groups(rows)
    assert sorted(r.doc_id for r in after["near_dedup"]) == sorted(i for (i, _), g in zip(rows, groups, strict=True) if i == g)
    before = {r.doc_id: r.text for r in after["near_dedup"]}
    gone = brute.removed_marks(list(before.items()))
    for r in after["span_dedup"]:
        assert r.n_chars == len(r.text) and r.text == brute.left_of(before[r.doc_id], gone[r.doc_id])
    items = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    words = lambda text: brute.WORD.findall((text or "").lower())
    clean = {r.doc_id: r.text for r in after["span_dedup"] if not any(brute.alike(words(r.text), words(x)) for x in items)}
    assert {r.doc_id: r.text for r in after["decontamination"]} == clean
    assert {r.doc_id: encoded(r) for r in after["byte_bpe"]} == {i: by_library(t) for i, t in clean.items()}


def encoded(r):
    return r.n_tokens, bytes(r.ids), r.ids_sha256, r.decoded_sha256


def by_library(text):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))} if not ENCODING else None
    if ranks:
        ENCODING.append(tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}))
    ids = np.array(ENCODING[0].encode_ordinary(text or ""), "<u4").tobytes()
    return len(ids) // 4, ids, hashlib.sha256(ids).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


ENCODING = []


def test_pipeline_on_edge_cases(spark, edge_docs, no_docs):
    item = spark.read.parquet(f"{FOLDER}/benchmark.parquet").first().text
    clean = " ".join(f"the word{i} of text{i} and line{i}" for i in range(40))
    more = [(50, clean), (50, clean), (51, clean + " x"), (None, clean), (None, "the end of and " + item + " " + clean[:400]), (52, "the start of and " + item + " the end of and " + clean[300:900])]
    docs = edge_docs.unionByName(spark.createDataFrame([(i, t, "en", None, "h", "clash") for i, t in more], edge_docs.schema))
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, FOLDER).cache()
        after[name] = [(r.doc_id, r.text if name != "byte_bpe" else None) for r in docs.collect()]
        assert name == "byte_bpe" or docs.columns == before.columns
    assert sorted(i for i, _ in after["quality_rules"] if i and i >= 50) == [50, 50, 51, 52] and sum(i is None for i, _ in after["quality_rules"]) >= 2
    assert [i for i, _ in after["near_dedup"] if i in (50, 51)] == [50]
    assert not any(item in t for _, t in after["decontamination"])
    assert sorted(after["byte_bpe"], key=str) == sorted(((i, None) for i, _ in after["decontamination"]), key=str)
    empty = no_docs
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, FOLDER)
    assert empty.collect() == []
