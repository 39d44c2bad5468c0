"""Every raster query against DuckDB on the smallest tables, and the plans of the main ones."""

import math
import random
from datetime import datetime
from functools import reduce
from pathlib import Path

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessella.operators import views
from tessella.plans import raster
from tessella.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the test tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def _rows(rows):
    plain = [tuple(None if isinstance(x, float) and math.isnan(x) else round(x, 9) if isinstance(x, float) else x for x in r) for r in rows]
    return sorted(plain, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, db, name):
    got = QUERIES[name](spark, SF)
    want = db.sql(ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    frame = got.select(*columns).toPandas().astype(object)
    names = ", ".join(f'"{c}"' for c in columns)
    assert _rows(frame.where(frame.notna(), None).itertuples(index=False, name=None)) == _rows(want.select(names).fetchall())


@pytest.mark.parametrize("name", ["box_mean_uneven", "nearest_downsample", "tile_prune_window", "point_lookup"])
def test_region_plans_have_no_product(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_only_needed_columns_are_read(spark):
    plan = QUERIES["box_mean_uneven"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "label" not in plan.split("ReadSchema")[1][:120]


def test_whole_image_grows_with_the_table(spark, tmp_path):
    """Rows of the image beyond the five hundredth count."""
    n = 1200
    pixels = {y: [float(y + x + 10000 * (y >= 500)) for x in range(64)] for y in range(n)}
    spark.createDataFrame(list(pixels.items()), "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.range(600).select(F.col("id").alias("event_id")).write.parquet(f"{tmp_path}/events.parquet")
    run = lambda name: QUERIES[name](spark, str(tmp_path)).collect()
    means = {(r.ox, r.oy): r.v for r in run("box_mean_exact_division")}
    assert means == pytest.approx({(i, j): sum(sum(pixels[y][8 * i : 8 * i + 8]) for y in range(24 * j, 24 * j + 24)) / 192 for i in range(8) for j in range(50)})
    assert max(r.oy for r in run("box_mean_uneven") if r.v is not None) == 32 and max(r.v for r in run("box_mean_uneven")) > 1200
    assert max(r.y for r in run("nearest_downsample")) == 1185 and len(run("nearest_downsample")) == 360
    for name in ("tone_minmax", "tone_percentile"):
        assert max(r.gray for r in run(name) if r.oy <= 12) < 20  # the first 472 rows are the dark ones
    assert len(run("point_lookup")) == sum(k * 7 % 70 < 64 for k in range(600))
    assert run("diff_metrics")[0].max_diff > 3000  # a cell holds rows 492 to 503


@pytest.fixture(scope="module")
def tied(tmp_path_factory):
    """2000 cells of 32 line items, half of them in each of two files. Discount and tax have means between two sixth decimals, and the files' sums, added, fall short of them."""
    path, rng, bands = tmp_path_factory.mktemp("tied"), random.Random(5), []
    for most in (10, 8):
        while True:
            cents = [rng.randrange(most + 1) for _ in range(32)]
            first, last = (reduce(float.__add__, [c / 100 for c in half]) for half in (cents[:16], cents[16:]))
            straight = reduce(float.__add__, [c / 100 for c in cents[16:]], first)
            if sum(cents) % 2 and (first + last) / 32 < sum(cents) / 3200 <= straight / 32:
                break
        bands.append([c / 100 for c in cents])
    (path / "lineitem.parquet").mkdir()
    for k, half in enumerate((slice(0, 16), slice(16, 32))):
        rows = [(50 * i, 1 + i * 0.0245, 40000.0 + i, datetime(1995, 1, 2), discount, tax) for i in range(2000) for discount, tax in zip(bands[0][half], bands[1][half], strict=True)]
        columns = dict(zip(("l_partkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_discount", "l_tax"), map(list, zip(*rows, strict=True)), strict=True))
        pq.write_table(pa.table(columns), path / "lineitem.parquet" / f"{k}.parquet")
    return str(path), [(sum(round(v * 100) for v in band) * 10**4 + 16) // 32 / 1e6 for band in bands]


def _against_sql(spark, path, name):
    c = duckdb.connect(config={"threads": 1})
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{path}/lineitem.parquet/*.parquet'")
    got, want = QUERIES[name](spark, path), c.sql(ORACLE_SQL[name])
    return sorted(got.select(*want.columns).toPandas().itertuples(index=False, name=None)), sorted(want.fetchall())


def test_cmyk_of_means_between_two_decimals(spark, tied):
    path, (discount, tax) = tied
    assert {(r.b2, r.b3) for r in views.item_grid(spark, path).select("b2", "b3").distinct().collect()} == {(discount, tax)}
    got, want = _against_sql(spark, path, "cmyk_to_rgb")
    assert len(got) == 2000 and got == want


def test_lab_of_means_between_two_decimals(spark, tied):
    got, want = _against_sql(spark, tied[0], "lab_to_rgb")
    assert len(got) == 2000 and got == want


def test_channels_round_as_sql(spark, tmp_path):
    """Quotients halfway between two sixth decimals, where the double's own text rounds the other way."""
    prices = [52733.503, 52575.515, 52332.477, 40000.0002, 40000.0006]
    rows = [(50 * i, 25.0, v, datetime(1995, 1, 2), 0.05, 0.04) for i, v in enumerate(prices)]
    spark.createDataFrame(rows, "l_partkey long, l_quantity double, l_extendedprice double, l_shipdate timestamp_ntz, l_discount double, l_tax double").write.parquet(f"{tmp_path}/lineitem.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    got = raster._scaled(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(c.sql(f"SELECT x, y, c0, c1, c2, c3 FROM {raster._SCALED} s").fetchall())


def test_means_of_odd_values_are_as_sql(spark):
    """Null, not finite, too large for exact sums, negative, and of more than six decimals."""
    inf, nan = float("inf"), float("nan")
    cells = [[None, None], [None, 2.5], [nan, 1.0], [inf, 1.0], [-inf, inf], [-inf], [1e15, 0.25], [3e9, -3e9, 0.75], [1e12 + 0.123456], [-0.0000015, -0.0000015], [1 / 3, 2 / 3, 1e-9], [12.3456785] * 3, [0.0]]
    rows = [(k, v) for k, cell in enumerate(cells) for v in cell]
    df = spark.createDataFrame(rows, "k int, v double")
    got = df.groupBy("k").agg(views.exact_mean("v").alias("m")).collect()
    c = duckdb.connect(config={"threads": 1})
    c.execute("CREATE TABLE t (k INT, v DOUBLE)")
    c.executemany("INSERT INTO t VALUES (?, ?)", rows)
    assert _rows(map(tuple, got)) == _rows(c.sql("SELECT k, round(avg(v), 6) FROM t GROUP BY k").fetchall())
