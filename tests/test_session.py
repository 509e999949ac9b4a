"""Places, written tables and what becomes of them."""

import os

import pytest
from pyspark.sql import functions as F

from warraq import session


def test_ranked_places_follow_the_order(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("a"), F.when(F.col("id") % 7 > 0, F.col("id") % 11).alias("b"), "id")
    rows = session.ranked(df, "a", "b", "id").orderBy("__place").collect()
    assert [r["__place"] for r in rows] == list(range(500))
    key = lambda r: (r.a, r.b is not None, r.b or 0, r.id)
    assert list(map(key, rows)) == sorted(map(key, rows))
    assert session.ranked(df.limit(0), "a").count() == 0


def test_settled_keeps_the_result_only(spark):
    before = set(session._written)
    inner = []

    def make():
        inner.append(session.materialize(spark.range(5)))
        inner.append(session.settled(spark, lambda: session.materialize(inner[0]).selectExpr("id + 1 AS id")))
        return inner[1].filter("id > 2")

    out = session.settled(spark, make)
    assert sorted(r.id for r in out.collect()) == [3, 4, 5]
    assert {x for _, x in session._written - before} == {out._warraq_path}
    assert not os.path.exists(inner[0]._warraq_path) and not os.path.exists(inner[1]._warraq_path)
    session.discard(out)
    assert set(session._written) == before and not os.path.exists(out._warraq_path)


def test_the_setting_comes_back_after_nested_writers(spark):
    held = spark.conf.get(session._CLEANUP)
    with session._dropping_shuffles(spark):
        with session._dropping_shuffles(spark):
            assert spark.conf.get(session._CLEANUP) == "true"
        assert spark.conf.get(session._CLEANUP) == "true"
    assert spark.conf.get(session._CLEANUP) == held


def test_only_small_scans_are_dealt_anew(spark, tmp_path):
    spark.range(100).repartition(9).write.parquet(str(tmp_path / "many"))
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "one"))
    cores = spark.sparkContext.defaultParallelism
    assert session.spread(spark.read.parquet(str(tmp_path / "one"))).rdd.getNumPartitions() == cores
    many = spark.read.parquet(*[str(tmp_path / "many")] * 5)
    assert session.spread(many) is many or many.rdd.getNumPartitions() < cores


def test_a_cluster_must_name_its_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="checkpoint.dir"):
        session.shared_dir(Session())
