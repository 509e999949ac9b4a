"""Decontamination finds similar windows whatever their fingerprints say."""

import random

from warraq.llm import decontaminate


def test_no_pair_is_left_to_fingerprints(spark, monkeypatch):
    draw = random.Random(5)
    items = [" ".join(f"w{draw.randrange(10**6)}" for _ in range(n)) for n in (3, 12, 30, 40, 40)]
    items.append("a b c d e f " * 6)
    near = []
    for text in items:
        words = text.split()
        words[-1] = words[-1] if len(words) < 30 else "other"
        near.append("before it " + " ".join(words) + " and after")
    docs = spark.createDataFrame(list(enumerate(near)), "doc_id long, text string")
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    expected = {(k, k) for k in range(len(items))}
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, benchmark).collect()} == expected
    monkeypatch.setattr(decontaminate, "RADIUS", -1)
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, benchmark).collect()} == expected
