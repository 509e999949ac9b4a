"""Texts of op10 that have a common passage and nothing else do not meet; a family meets once."""

import random

from tests.llm import brute
from warraq.llm import near_dups


def test_a_common_passage_brings_no_texts_together(spark, monkeypatch):
    monkeypatch.setattr(near_dups, "SHORT", 6)
    monkeypatch.setattr(near_dups, "BLOCK", 16)
    draw, passage, family = random.Random(3), [f"p{k}" for k in range(30)], [f"f{k}" for k in range(100)]
    made = [(i, " ".join(passage + [f"o{i}x{k}" for k in range(60)])) for i in range(150)]
    for i in range(40):
        words = list(family)
        for _ in range(draw.randint(1, 3)):
            words[draw.randrange(100)] = f"e{i}x{draw.randrange(10**6)}"
        made.append((1000 + i, " ".join(words)))
    sent, members = [], near_dups._members
    monkeypatch.setattr(near_dups, "_members", lambda frame: sent.append(frame.count()) or members(frame))
    found = {r.doc_id: r.component_id for r in near_dups.near_dups(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    groups, _ = brute.near_groups(made)
    assert found == {i: i if g is None else g for (i, _), g in zip(made, groups, strict=True)}
    assert sum(sent) <= 40


def test_lists_are_one_crowd_where_that_makes_fewer_pairs(spark):
    lists = {1: range(1, 11), 2: range(10, 20), 5: range(30, 40), 6: range(30, 40), 7: range(30, 39)}
    held = {}
    for v, nodes in lists.items():
        for node in nodes:
            held.setdefault(node, []).append(v)
    many = spark.createDataFrame([(v, node, 100, len(nodes)) for v, nodes in lists.items() for node in nodes], "v long, node long, n long, m long")
    rare = spark.createDataFrame([(node, 100, [3, *vs]) for node, vs in held.items()], "node long, n long, rare array<long>")
    found = {(r.v, r.node, r.m, tuple(r.before)) for r in near_dups._crowds(many, rare).collect()}
    apart = {(v, node, 10, (3, 1) if (v, node) == (2, 10) else (3,)) for v in (1, 2) for node in lists[v]}
    assert found == apart | {(30, node, 10, ()) for node in range(30, 40)}
