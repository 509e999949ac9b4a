"""Composition takes one text of a batch at a time, never a batch as Python strings."""

from pyspark.sql import functions as F
from pyspark.util import PythonEvalType

from warraq.functions import text as T


def test_composition_reads_arrow(spark):
    assert T.nfkc.evalType == PythonEvalType.SQL_SCALAR_ARROW_UDF
    df = spark.createDataFrame([("ｈｕｗ é",), (None,), ("",), ("ﷲ\U0001f600",)], "x string").coalesce(1)
    assert [r.y for r in df.select(T.nfkc("x").alias("y")).collect()] == ["huw é", None, "", "الله\U0001f600"]
    assert df.select(F.count(T.nfkc("x"))).first()[0] == 3
