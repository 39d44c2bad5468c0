"""Rules of rasters against plain Python."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.functions import color, text
from tessella.functions import geometry as G
from tessella.operators import region, requests, stats


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_rounding_and_clamping(spark):
    values = [-1.0, 0.5, 1.5, 2.5, 254.5, 300.0, float("nan"), float("inf")]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(color.to_byte("v")).collect()] == [0, 0, 2, 2, 254, 255, 0, 255]


def test_tone_ranges(spark):
    zero = [F.lit(float(x)) for x in (3, 9, 4, 8)]
    for how, want in ((("minmax", 16, False, False, True), (3, 9)), (("percentile", 16, False, False, True), (4, 8)), (("full", 16, False, False, True), (0, 65535)), (("full", 16, True, False, True), (-32768, 32767)), (("full", 32, False, True, True), (3, 9)), (("minmax", 12, False, False, False), (0, 4095))):
        lo, hi = color.tone_range(*how, *zero)
        assert tuple(one(spark, lo=lo, hi=hi)) == want


def test_index_rule_of_percentiles(spark):
    got = stats.stats(spark.range(10).select(F.col("id").cast("double").alias("v")), ["v"]).first()
    assert tuple(got) == (0.0, 9.0, 0.0, 8.0)
    empty = stats.stats(spark.createDataFrame([(float("nan"),), (float("inf"),)], "v double"), ["v"]).first()
    assert tuple(empty) == (0.0, 1.0, 0.0, 1.0)
    assert stats.stats(spark.createDataFrame([(5.0,), (7.0,)], "v double"), ["v"], nodata=7.0).first()["hi"] == 5.0


def test_band_zero_masks_means(spark):
    rows = [(0, 0, 7.0, 1.0), (1, 0, 2.0, 5.0), (0, 1, float("nan"), 9.0), (1, 1, 4.0, 7.0)]
    df = spark.createDataFrame(rows, "x long, y long, v0 double, v1 double")
    got = region.box_mean(df, (0, 0, 2, 2), (1, 1), ["v0", "v1"], color.is_empty("v0", 7.0)).first()
    assert (got["v0"], got["v1"]) == (3.0, 6.0)


def test_plan_choice(spark):
    df = spark.createDataFrame([(x, y, float(x + y)) for x in range(4) for y in range(4)], "x long, y long, v double")
    assert region.read_region(df, (1, 1, 3, 3), (2, 2), ["v"]).count() == 4
    palette = {(r["ox"], r["oy"]): r["v"] for r in region.read_region(df, (0, 0, 4, 4), (2, 2), ["v"], is_palette=True).collect()}
    assert palette[0, 0] == 2.0  # the sample at (1, 1), not a mean


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 50), st.integers(1, 60), st.integers(1, 40))
def test_geometry_like_python(spark, lo, span, out):
    hi = lo + span
    got = one(spark, n=G.nearest_source(F.lit(out - 1), lo, hi, out), b=G.box_cell(F.lit(span - 1), span, out), a=G.tile_span(F.lit(lo), F.lit(hi), 16)[0], z=G.tile_span(F.lit(lo), F.lit(hi), 16)[1])
    assert got["n"] == min(hi - 1, lo + math.floor((out - 0.5) * span / out))
    assert got["b"] == min(out - 1, (span - 1) * out // span)
    assert (got["a"], got["z"]) == (lo // 16, -(-hi // 16))


def test_texts(spark):
    got = one(spark, t=text.tag_text(F.lit("  a b\x00\x00")), n=text.tag_text(F.lit(" \x00")), c=text.code_name(F.lit(5), text.COMPRESSION), u=text.code_name(F.lit(999), text.COMPRESSION), r=text.rational(F.lit(1), F.lit(3)), z=text.rational(F.lit(7), F.lit(0)))
    assert tuple(got) == ("a b", None, "LZW", "Unknown (999)", 0.333, 7.0)


def test_lru_keeps_the_newest(spark):
    uses = spark.createDataFrame([("k", 1, 1, 60), ("k", 2, 2, 50), ("k", 1, 3, 60), ("k", 3, 4, 30)], "k string, id int, seq int, bytes int")
    assert {r["id"] for r in requests.kept_in_cache(uses, ["k"], 100).collect()} == {3, 1}


def test_pages_of_masks_only(spark):
    from tessella.operators import pages

    ifds = spark.createDataFrame([("f", 0, 4, 10, 1), ("f", 1, 4, 10, 1)], "path string, ifd int, subfile int, width long, spp long")
    assert [(r["role"], r["page"]) for r in pages.classify(ifds).orderBy("ifd").collect()] == [("page", 0), ("page", 1)]


@pytest.mark.parametrize("mean", [True, False])
def test_mean_of_means(spark, mean):
    df = spark.createDataFrame([(x, y, float(x * 3 + y * y)) for x in range(8) for y in range(8)], "x long, y long, v double")
    direct = {(r["ox"], r["oy"]): r["v"] for r in region.box_mean(df, (0, 0, 8, 8), (2, 2), ["v"]).collect()}
    half = region.box_mean(df, (0, 0, 8, 8), (4, 4), ["v"]).select(F.col("ox").alias("x"), F.col("oy").alias("y"), "v")
    assert {(r["ox"], r["oy"]): r["v"] for r in region.box_mean(half, (0, 0, 4, 4), (2, 2), ["v"]).collect()} == direct
