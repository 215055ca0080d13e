import math

import pytest
from pyspark.sql import functions as F

from tesselq.functions import text, transforms
from tesselq.operators import annotations, grids


def test_transforms(spark):
    d = spark.createDataFrame([(1.0, 0.0, 2.0)], "x double, y double, z double")
    p = (F.col("x"), F.col("y"))
    assert d.select(*transforms.rigid2d(p, math.pi / 2, [1, 1])).first()[:] == pytest.approx((1, 2))
    half_turn = transforms.rigid3d((*p, F.col("z")), (0, 0, 2, 0), [0, 0, 0])
    assert d.select(*half_turn).first()[:] == pytest.approx((-1, 0, 2))
    assert d.select(transforms.normal_density(F.lit(0.0), 0, 1)).first()[0] == pytest.approx(1 / math.sqrt(2 * math.pi))
    i = transforms.linear_index(F.lit(2), F.lit(3), 5)
    assert d.select(i, *transforms.from_linear_index(i, 5)).first()[:] == (12, 2, 3)


def test_text(spark):
    d = spark.createDataFrame([("a.b,,c",)], "t string")
    row = d.select(text.tokens(F.col("t"), ".,"), text.padded(F.lit(7), 3), text.padded(F.lit(12345), 3), text.duration_seconds(F.lit("1:02:03")), text.duration_seconds(F.lit("x")), text.setting(F.lit("a: 1\n b : two words\n"), "b")).first()
    assert row[:] == (["a", "b", "c"], "007", "12345", 3723.0, None, "two words")


def test_annotations(spark):
    d = spark.createDataFrame([("p", 0.0, 0.0, 4.0, 10.0, 0), ("p", 0.0, 0.0, 4.0, 2.0, 0), ("q", 0.0, 0.0, 4.0, 9.0, 0), ("r", 0.0, 0.0, 1.0, 1.0, 0)], "label string, x double, y double, w double, h double, ignore int")
    rows = annotations.flag_out_of_range(d, {"h": (5, 20)}, ["q"], ["p"]).collect()
    assert [(r["label"], r["h"], r["ignore"]) for r in rows] == [("p", 10.0, False), ("p", 2.0, True), ("q", 9.0, True)]
    t = spark.createDataFrame([(1, 0, 9, "x"), (1, 10, 19, "a"), (1, 20, 29, "x"), (1, 30, 39, "b"), (1, 40, 49, "x")], "k int, a long, b long, label string")
    out = annotations.delete_intervals(t, ["k"], "a", "b", F.col("label") == "x").orderBy("a").collect()
    assert [(r["a"], r["b"], r["label"]) for r in out] == [(0, 29, "a"), (30, 49, "b")]


def test_consistency_and_samples(spark):
    f = spark.createDataFrame([(0, 0, 2.0, 0.0), (5, 5, 1.0, 1.0)], "x long, y long, u double, v double")
    b = spark.createDataFrame([(2, 0, -2.0, 0.5), (6, 6, 3.0, 0.0)], "x long, y long, u double, v double")
    assert [r["x"] for r in grids.consistency(f, b, 1.0).collect()] == [0]
    d = spark.range(2000).select("id", F.when(F.col("id") < 1000, 9.0).otherwise(1.0).alias("w"))
    s = grids.weighted_sample(d, "id", "w", 300)
    assert s.count() == 300 and s.where("id < 1000").count() > 240
