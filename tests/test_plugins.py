"""Detectors and scores added by name."""

import pytest
from pyspark.sql import functions as F

from evtrace.functions import plugins


def test_detector_gives_any_number_of_rows(spark):
    plugins.register_detector("twice", lambda df: df.loc[df.index.repeat(df["n"])], "id long, n long")
    df = spark.createDataFrame([(1, 0), (2, 2), (3, 1)], "id long, n long")
    assert sorted(r["id"] for r in plugins.detect(df, "twice").collect()) == [2, 2, 3]
    assert plugins.detect(df.limit(0), "twice").count() == 0
    with pytest.raises(KeyError):
        plugins.detect(df, "unknown")


def test_score_stays_a_column(spark):
    plugins.register_score("half", lambda c: F.coalesce(c, F.lit(0.0)) / 2)
    got = spark.sql("select * from values (1, 3d), (2, null) t(id, x)").select(plugins.score("half", F.col("x")).alias("s")).collect()
    assert [r["s"] for r in got] == [1.5, 0.0]
