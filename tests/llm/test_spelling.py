"""Joins of op12 do not rest on Spark's guess of a table's size."""

from warraq.llm import spelling


def test_tables_of_words_are_not_broadcast(spark):
    docs = spark.createDataFrame([(k, "bettern letter letters better bitter " * 4 + "lettersx") for k in range(8)], "doc_id long, text string")
    words = spark.createDataFrame([(0, "better", 9), (1, "bitter", 4)], "place long, word string, n long")
    links = spark.createDataFrame([(1, 0), (2, 1)], "place long, to long")
    near = spelling.neighbours(words)
    assert [tuple(x) for x in near.orderBy("place").collect()] == [(0, 1, 1, 4), (1, 1, 0, 9)]
    assert {tuple(x) for x in spelling.roots(links).collect()} == {(1, 0), (2, 0)}
    found = spelling.variants(docs)
    for frame in (near, found):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert {x.word: (x.form, x.root) for x in found.collect()}["lettersx"] == ("letters", "letters")
