"""Exact dedup, spelling variants and the filter audit: edge cases, slow versions, what an index keeps."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import pytest

from tests.llm import brute
from tests.llm.conftest import edge_rows
from warraq.llm import digest_index, filter_audit, spelling
from warraq.session import new_path

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, digest string, batch int"


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def by_hand(said):
    """Of each row, its group's kept id and size; groups are of equal texts."""
    groups = collections.defaultdict(list)
    for i, t in said:
        groups[lowered(t)].append(i)
    best = lambda ids: max((i for i in ids if i is not None), default=None)
    return groups, [(i, best(groups[lowered(t)]), len(groups[lowered(t)]), hashlib.sha256(lowered(t).encode()).hexdigest()) for i, t in said]


def plain(row):
    return tuple((x is not None, x) for x in row)


# 11 exact dedup

CASES = [*edge_rows(), (20, "ÄB c"), (21, "äb c"), (22, "äB C"), (23, None), (None, "alone"), (None, "alone"), (24, "twice"), (24, "twice"), (24, "TWICE"), (25, "x" * 200_000 + "É")]


@pytest.mark.parametrize("batches", [1, 3])
def test_duplicates(spark, no_docs, batches):
    docs = spark.createDataFrame([(i, t, "en", "clash", 9) for i, t in CASES], SCHEMA)
    out = digest_index.duplicates(docs, digest_index.DigestIndex(spark, new_path(spark)), batches).collect()
    groups, expected = by_hand(CASES)
    assert sorted(plain((r.doc_id, r.keep_id, r.group_size, r.text_sha256)) for r in out) == sorted(map(plain, expected))
    assert all(not r.kept or r.doc_id == r.keep_id for r in out)
    assert collections.Counter(r.text_sha256 for r in out if r.kept) == dict.fromkeys({x[3] for x in expected}, 1)
    assert digest_index.duplicates(no_docs, digest_index.DigestIndex(spark, new_path(spark))).collect() == []


def test_an_index_remembers(spark):
    path = new_path(spark)
    docs = lambda *rows: spark.createDataFrame([(*r, "en", "clash", 9) for r in rows], SCHEMA)
    index = digest_index.DigestIndex(spark, path, 3)
    first = digest_index.fresh(docs((1, "A"), (2, "a"), (3, "b"), (None, "c"), (None, "c"), (4, None)), index, 0)
    assert first.columns == docs((1, "A")).columns
    kept = sorted((plain((r.doc_id, r.text)) for r in first.collect()))
    assert kept == sorted(map(plain, [(2, "a"), (3, "b"), (None, "c"), (4, None)]))
    index.close()
    # Another program: the same folder, without what this one knew.
    again = digest_index.DigestIndex(spark, path)
    assert again.buckets == 3 and again.rows().count() == 4
    more = docs((9, "B"), (8, "d"), (7, ""), (6, "D"))
    assert [(r.doc_id, r.text) for r in digest_index.fresh(more, again, 1).collect()] == [(8, "d")]
    # A batch that is given again gives its rows again, and the index has them once.
    assert [(r.doc_id, r.text) for r in digest_index.fresh(more, again, 1).collect()] == [(8, "d")]
    assert again.rows().count() == 5
    with pytest.raises(ValueError, match="3 buckets"):
        digest_index.DigestIndex(spark, path, 5)
    moved = again.moved_to(new_path(spark), 5)
    assert moved.buckets == 5 and {bytes(r.digest) for r in moved.rows().collect()} == {bytes(r.digest) for r in again.rows().collect()}
    assert [(r.doc_id, r.text) for r in digest_index.fresh(docs((10, "b"), (11, "e")), moved, 1).collect()] == [(11, "e")]


def test_new_rows_alone_are_moved(spark):
    """The index is read in its buckets: of the two sides of the anti-join only the new one is dealt out."""
    index = digest_index.DigestIndex(spark, new_path(spark))
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(20)], "doc_id long, text string").selectExpr("doc_id", "text", "doc_id AS row")
    index.add(rows.select(digest_index.digest(rows["text"]).alias("digest"), "doc_id", "row"), 0)
    plan = index.joined(rows.select(digest_index.digest(rows["text"]).alias("digest"), "doc_id", "row"), 1)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" in plan and "Bucketed: true" in plan


# 12 spelling variants


def counted(said):
    out = collections.Counter()
    for i, t in said:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def one_apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def expected_variants(said):
    words = counted(said)
    near = {w: [v for v in words if one_apart(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w] or "", root(w), n, len(near[w]), words[form[w]] if form[w] else -1) for w, n in words.items())


def variants(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in spelling.variants(df).collect())


def test_variants(spark, no_docs):
    draw = random.Random(5)
    base = ["aabbcc", "spelling", "éèàñö", "aaaaa", "tests÷", "ababab", "wörter"]
    said = list(CASES)
    for i in range(400):
        w = list(draw.choice(base))
        for _ in range(draw.choice((0, 0, 1, 1, 2))):
            k = draw.randrange(len(w))
            w[k : k + draw.randint(0, 1)] = draw.choice((["a"], ["b"], ["é"], ["ÿ"], []))
        said.append((draw.choice((None, i)), " ".join(["".join(w), draw.choice(base).upper()] * draw.randint(1, 3))))
    long = "xyz" * 3000
    said += [(900 + k, long + " " + long[:-1] + "," + long[1:]) for k in range(3)] + [(910 + k, long + "\n" + "q" * 5000) for k in range(4)]
    docs = spark.createDataFrame([(i, t, "en", "clash", 9) for i, t in said], SCHEMA)
    assert variants(docs) == expected_variants(said)
    assert spelling.variants(no_docs).collect() == []


def test_variants_of_a_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert variants(docs) == expected_variants([(r.doc_id, r.text) for r in docs.collect()])


def test_counts_are_passed_on_in_parts(spark, monkeypatch):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    whole = sorted(map(tuple, spelling.count_words(docs).collect()))
    monkeypatch.setattr(spelling, "HELD", 10)
    assert sorted(map(tuple, spelling.count_words(docs).collect())) == whole


def test_roots_follow_chains(spark):
    links = spark.createDataFrame([(k, k - 1) for k in range(1, 40)] + [(100, 1), (101, 100)], "place long, to long")
    assert sorted(map(tuple, spelling.roots(links).collect())) == [(k, 0) for k in range(1, 40)] + [(100, 0), (101, 0)]
    assert spelling.roots(links.limit(0)).collect() == []


# 13 filter audit


def audited(said, labels):
    """Every order applied to every row of (doc_id, text, part)."""
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    least = {}
    for i, t, _ in said:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    fails = []
    for i, t, part in said:
        t = t or ""
        w = brute.WORD.findall(t)
        f = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
            "D": any(c in "#$%&*|" for c in t), "E": i is not None and i > least[t],
        }
        fails.append((part or "", {k for k, v in f.items() if v}, i in good, i in toxic))
    out, shapley = [], collections.Counter()
    for part in {p for p, *_ in fails}:
        for order in itertools.permutations("ABCDE"):
            there = [x for x in fails if x[0] == part]
            for step, f in enumerate(order, 1):
                gone = [x for x in there if f in x[1]]
                there = [x for x in there if f not in x[1]]
                failing = [x for x in fails if x[0] == part and f in x[1]]
                shapley[part, f] += len(gone)
                out.append((part, "".join(order), step, len(there), len(gone), len(failing) - len(gone), sum(x[1] == {f} for x in failing), sum(x[2] for x in gone), sum(x[3] for x in gone)))
    return sorted((*x, shapley[x[0], x[1][x[2] - 1]]) for x in out)


NAMES = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def test_audit(spark, no_docs):
    draw = random.Random(3)
    said = [(i, t, draw.choice(("en", None, "", "fr"))) for i, t in CASES]
    for i in range(60):
        t = " ".join(draw.choice(("w", "X", "#")) + str(draw.randrange(300)) for _ in range(draw.choice((5, 250)))).replace("#", draw.choice("#a"))
        said += [(draw.choice((None, i, i + 300)), t, draw.choice(("en", "fr")))] * draw.randint(1, 3) + [(i + 700, t, "de")] * draw.randint(0, 1)
    labels = [(draw.choice((None, i, i, i)), draw.choice((0, 1, None)), draw.choice((0, 1, None))) for i in range(400)] * 2
    docs = spark.createDataFrame([(*r, "clash", 9) for r in said], "doc_id long, text string, lang string, digest string, part int")
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = filter_audit.audit(docs, told)
    assert out.columns == list(NAMES)
    assert sorted(map(tuple, out.collect())) == audited(said, labels)
    assert filter_audit.audit(no_docs, told).collect() == []
    none = filter_audit.audit(docs, told.limit(0)).collect()
    assert len(none) == 600 * 4 and not any(r.good_lost or r.toxic_lost for r in none)


def test_audit_shuffles_no_text(spark, edge_docs):
    plan = filter_audit.masks(edge_docs)._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan and "hashpartitioning(digest" in plan
