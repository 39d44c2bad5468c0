"""Queries on pixels: regions, statistics, tones, colours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import color
from tessella.functions import geometry as G
from tessella.operators import region, stats, views
from tessella.plans.registry import E_SQL, L_SQL, STATS_SQL, T_SQL, box_sql, byte_sql, query

S = SparkSession
#: The whole embedding image in SQL; its height comes from the table.
HEIGHT = "(SELECT coalesce(max(vec_id) + 1, 1) FROM embeddings)"
WHOLE = (0, 0, 64, HEIGHT)


def _whole(spark: S, d: str) -> tuple[int, int, int, int]:
    """The window of the whole embedding image."""
    most = views.table(spark, d, "embeddings").agg(F.max("vec_id")).first()[0]
    return 0, 0, 64, 1 if most is None else most + 1


def _grid_size(spark: S, d: str) -> tuple[int, int]:
    """Width and height of the grid of line items."""
    most = views.item_grid(spark, d).agg(F.max("x").alias("x"), F.max("y").alias("y")).first()
    return (most["x"] or 0) + 1, (most["y"] or 0) + 1


_GRID_SQL = f"(SELECT max(x) + 1 AS gw, max(y) + 1 AS gh FROM {L_SQL} l)"


def _rounded(df: DataFrame, *bands: str) -> DataFrame:
    return df.select("ox", "oy", *[F.round(b, 6).alias(b) for b in bands or ("v",)])


def _round_sql(inner: str, bands: str = "v") -> str:
    return f"SELECT ox, oy, {', '.join(f'round({b}, 6) AS {b}' for b in bands.split())} FROM ({inner})"


@query(_round_sql(box_sql(E_SQL, WHOLE, (8, 50))))
def box_mean_exact_division(spark: S, d: str) -> DataFrame:
    return _rounded(region.box_mean(views.embedding_raster(spark, d), _whole(spark, d), (8, 50), ["v"]))


@query(_round_sql(box_sql(E_SQL, WHOLE, (7, 33))))
def box_mean_uneven(spark: S, d: str) -> DataFrame:
    return _rounded(region.read_region(views.embedding_raster(spark, d), _whole(spark, d), (7, 33), ["v"]))


@query(_round_sql(box_sql(E_SQL, (3, 5, 13, 15), (12, 12))))
def box_mean_upsample_holes(spark: S, d: str) -> DataFrame:
    return _rounded(region.box_mean(views.embedding_raster(spark, d), (3, 5, 13, 15), (12, 12), ["v"]))


def _nearest_sql(window: tuple, out: tuple[int, int]) -> str:
    x0, y0, x1, y1 = window
    return f"""SELECT ox, oy, x, y, v FROM (SELECT gx.i AS ox, gy.i AS oy, least({x1} - 1, {x0} + floor((gx.i + 0.5::DOUBLE) * ({x1} - {x0}) / {out[0]})::BIGINT) AS x,
        least({y1} - 1, {y0} + floor((gy.i + 0.5::DOUBLE) * ({y1} - {y0}) / {out[1]})::BIGINT) AS y FROM range({out[0]}) gx(i) CROSS JOIN range({out[1]}) gy(i)) g JOIN {E_SQL} e USING (x, y)"""


@query(_nearest_sql(WHOLE, (9, 40)))
def nearest_downsample(spark: S, d: str) -> DataFrame:
    return region.nearest(views.embedding_raster(spark, d), _whole(spark, d), (9, 40), ["v"])


@query(_nearest_sql((10, 20, 17, 31), (25, 40)))
def nearest_upsample(spark: S, d: str) -> DataFrame:
    return region.nearest(views.embedding_raster(spark, d), (10, 20, 17, 31), (25, 40), ["v"])


@query(f"SELECT x - 5 AS ox, y - 7 AS oy, v FROM {E_SQL} e WHERE x >= 5 AND x < 29 AND y >= 7 AND y < 107")
def window_exact(spark: S, d: str) -> DataFrame:
    return region.read_region(views.embedding_raster(spark, d), (5, 7, 29, 107), (24, 100), ["v"])


@query(f"SELECT 0 AS level, x, y, round(v, 6) AS v FROM {E_SQL} e UNION ALL SELECT 1, x // 2, y // 2, round(avg(v), 6) FROM {E_SQL} e GROUP BY 2, 3 UNION ALL SELECT 2, x, y, round(avg(v), 6) FROM (SELECT x // 4 AS x, y // 4 AS y, avg(v) AS v FROM {E_SQL} e GROUP BY x // 4, y // 4, x // 2, y // 2) GROUP BY 2, 3")
def pyramid_build(spark: S, d: str) -> DataFrame:
    return region.pyramid(views.embedding_raster(spark, d), 64, 500, 3).select("level", "x", "y", F.round("v", 6).alias("v"))


@query("SELECT round(lo, 6) AS lo, round(hi, 6) AS hi, round(p02, 6) AS p02, round(p98, 6) AS p98 FROM " + STATS_SQL.format(f"(SELECT v FROM {E_SQL} e WHERE (y * 64 + x) % greatest(1, 64 * {HEIGHT} // 1048576) = 0) p"))
def stats_gray(spark: S, d: str) -> DataFrame:
    return stats.stats(views.embedding_raster(spark, d), ["v"], place=F.col("y") * 64 + F.col("x"), count=F.lit(64 * _whole(spark, d)[3])).select(*[F.round(c, 6).alias(c) for c in ("lo", "hi", "p02", "p98")])


@query("SELECT round(lo, 6) AS lo, round(hi, 6) AS hi, round(p02, 6) AS p02, round(p98, 6) AS p98 FROM " + STATS_SQL.format(f"(SELECT unnest([b0, b2, b3]) AS v FROM {L_SQL} l, {_GRID_SQL} g WHERE (y * gw + x) % greatest(1, gw * gh * 3 // 1048576) = 0) p"))
def stats_pooled_rgb(spark: S, d: str) -> DataFrame:
    w, h = _grid_size(spark, d)
    return stats.stats(views.item_grid(spark, d), ["b0", "b2", "b3"], place=F.col("y") * w + F.col("x"), count=F.lit(w * h)).select(*[F.round(c, 6).alias(c) for c in ("lo", "hi", "p02", "p98")])


@query(f"SELECT x, y, v FROM {E_SQL} e WHERE (y * 64 + x) % greatest(1, 64 * {HEIGHT} // 4096) = 0")
def systematic_sample(spark: S, d: str) -> DataFrame:
    """Every step-th cell of the embedding image, the step such that fewer than 8192 stay."""
    return stats.systematic(views.embedding_raster(spark, d), F.col("y") * 64 + F.col("x"), F.lit(64 * _whole(spark, d)[3]), most=4096)


_REGION = box_sql(E_SQL, WHOLE, (7, 33))


def _tone(spark: S, d: str, mode: str) -> DataFrame:
    cells = region.box_mean(views.embedding_raster(spark, d), _whole(spark, d), (7, 33), ["v"]).withColumn("v", F.round("v", 6))
    one = stats.stats(cells, ["v"], place=F.col("oy") * 7 + F.col("ox"), count=F.lit(7 * 33))
    lo, hi = color.tone_range(mode, 32, False, True, True, "lo", "hi", "p02", "p98")
    return stats.with_stats(cells, one).select("ox", "oy", color.to_byte(F.round(color.stretch("v", lo, hi), 6)).alias("gray"))


def _tone_sql(lo: str, hi: str) -> str:
    cells = f"(SELECT ox, oy, round(v, 6) AS v FROM ({_REGION}))"
    return f"SELECT ox, oy, {byte_sql(f'round((v - {lo}) * (255.0::DOUBLE / ({hi} - {lo})), 6)')} AS gray FROM {cells} c CROSS JOIN {STATS_SQL.format(cells + ' c2')} s"


@query(_tone_sql("lo", "hi"))
def tone_minmax(spark: S, d: str) -> DataFrame:
    return _tone(spark, d, "minmax")


@query(_tone_sql("p02", "p98"))
def tone_percentile(spark: S, d: str) -> DataFrame:
    return _tone(spark, d, "percentile")


@query(f"SELECT page_id, x, y, {byte_sql('v * (255.0::DOUBLE / 65535)')} AS gray, {byte_sql('255.0::DOUBLE - v * (255.0::DOUBLE / 65535)')} AS inverted FROM {T_SQL} t")
def tone_full(spark: S, d: str) -> DataFrame:
    lo, hi = color.tone_range("full", 16, False, False, True, F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0))
    v = color.stretch("v", lo, hi)
    return views.page_raster(spark, d).select("page_id", "x", "y", color.to_byte(v).alias("gray"), color.to_byte(color.white_is_zero(v)).alias("inverted"))


@query(f"SELECT page_id, x, y, {byte_sql('255 - v')} AS gray FROM {T_SQL} t WHERE v < 256")
def white_is_zero(spark: S, d: str) -> DataFrame:
    return views.page_raster(spark, d).where("v < 256").select("page_id", "x", "y", color.to_byte(color.white_is_zero("v")).alias("gray"))


@query("SELECT vec_id AS id, 128 AS gray FROM embeddings")
def flat_image_mid_grey(spark: S, d: str) -> DataFrame:
    flat = views.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.lit(7.0).alias("v"))
    return stats.with_stats(flat, stats.stats(flat, ["v"], place=F.col("id"), count=F.lit(_whole(spark, d)[3]))).select("id", color.to_byte(color.stretch("v", "lo", "hi")).alias("gray"))


@query(f"SELECT x, y, CASE WHEN empty THEN 0 ELSE {byte_sql('b0 * 5')} END AS gray, CASE WHEN empty THEN 0 ELSE 255 END AS a FROM (SELECT *, b0 = 25 AS empty FROM {L_SQL} l)")
def nodata_mask_gray(spark: S, d: str) -> DataFrame:
    rows = views.item_grid(spark, d).withColumn("empty", color.is_empty("b0", 25.0))
    return rows.select("x", "y", F.when(F.col("empty"), 0).otherwise(color.to_byte(F.col("b0") * 5)).alias("gray"), F.when(F.col("empty"), 0).otherwise(255).alias("a"))


@query(f"SELECT x, y, (q0 = 2 AND q1 = 2 AND q2 = 2)::INT AS all_equal, (q0 = 2)::INT AS first_equal FROM (SELECT x, y, floor(b0 / 10)::BIGINT AS q0, floor(b1 / 10000)::BIGINT AS q1, floor(b2 * 50)::BIGINT AS q2 FROM {L_SQL} l)")
def nodata_mask_rgb(spark: S, d: str) -> DataFrame:
    """On display all three bands must equal NoData; in means the first alone decides."""
    q = views.item_grid(spark, d).select("x", "y", F.floor(F.col("b0") / 10).cast("double").alias("q0"), F.floor(F.col("b1") / 10000).cast("double").alias("q1"), F.floor(F.col("b2") * 50).cast("double").alias("q2"))
    empty = [color.is_empty(c, 2.0) for c in ("q0", "q1", "q2")]
    return q.select("x", "y", (empty[0] & empty[1] & empty[2]).cast("int").alias("all_equal"), empty[0].cast("int").alias("first_equal"))


@query(_round_sql(box_sql(L_SQL, (0, 0, f"(SELECT max(x) + 1 FROM {L_SQL} w)", f"(SELECT max(y) + 1 FROM {L_SQL} h)"), (8, 6), "b0 b1", "NOT b0 = 25"), "b0 b1"))
def nodata_mean(spark: S, d: str) -> DataFrame:
    return _rounded(region.box_mean(views.item_grid(spark, d), (0, 0, *_grid_size(spark, d)), (8, 6), ["b0", "b1"], color.is_empty("b0", 25.0)), "b0", "b1")


@query(f"SELECT p_partkey, least(39, greatest(0, p_size)) AS idx, {byte_sql('(least(39, greatest(0, p_size)) * 1500) / 257.0::DOUBLE')} AS r, {byte_sql('(least(39, greatest(0, p_size)) * 700 + 9) / 257.0::DOUBLE')} AS g, {byte_sql('(60000 - least(39, greatest(0, p_size)) * 1000) / 257.0::DOUBLE')} AS b FROM part")
def palette_lookup(spark: S, d: str) -> DataFrame:
    table = F.lit([i * 1500 for i in range(40)] + [i * 700 + 9 for i in range(40)] + [60000 - i * 1000 for i in range(40)])
    rows = views.table(spark, d, "part")
    return rows.select("p_partkey", F.least(F.lit(39), F.greatest(F.lit(0), F.col("p_size"))).alias("idx"), *[color.to_byte(color.palette("p_size", table, k, 40)).alias(c) for k, c in enumerate("rgb")])


_SCALED = f"(SELECT x, y, round(b0 * 5, 6) AS c0, round(b1 / 400, 6) AS c1, round(b2 * 2500, 6) AS c2, round(b3 * 3000, 6) AS c3 FROM {L_SQL} l)"


def _scaled(spark: S, d: str) -> DataFrame:
    """Four bands of about 0 to 255."""
    return views.item_grid(spark, d).select("x", "y", G.rounded(F.col("b0") * 5).alias("c0"), G.rounded(F.col("b1") / 400).alias("c1"), G.rounded(F.col("b2") * 2500).alias("c2"), G.rounded(F.col("b3") * 3000).alias("c3"))


def _bytes(rgb: tuple) -> list:
    return [color.to_byte(G.rounded(v)).alias(n) for n, v in zip("rgb", rgb, strict=True)]


def _bytes_sql(r: str, g: str, b: str) -> str:
    return ", ".join(f"{byte_sql(f'round({v}, 6)')} AS {n}" for n, v in zip("rgb", (r, g, b), strict=True))


@query(f"SELECT x, y, {_bytes_sql(*(f'(255 - {c}) * (1 - c3 / 255)' for c in ('c0', 'c1', 'c2')))} FROM {_SCALED} s")
def cmyk_to_rgb(spark: S, d: str) -> DataFrame:
    return _scaled(spark, d).select("x", "y", *_bytes(color.cmyk("c0", "c1", "c2", "c3")))


@query(f"SELECT x, y, {_bytes_sql('c0 + 1.402::DOUBLE * (c2 - 128)', 'c0 - 0.344136::DOUBLE * (c1 - 128) - 0.714136::DOUBLE * (c2 - 128)', 'c0 + 1.772::DOUBLE * (c1 - 128)')} FROM {_SCALED} s")
def ycbcr_to_rgb(spark: S, d: str) -> DataFrame:
    return _scaled(spark, d).select("x", "y", *_bytes(color.ycbcr("c0", "c1", "c2")))


_LAB = """WITH f AS (SELECT x, y, fy + (c1 - 128) / 500 AS fx, fy, fy - (c2 - 128) / 200 AS fz FROM (SELECT x, y, c1, c2, (least(100, c0 / 2.55::DOUBLE) + 16) / 116 AS fy FROM {0} s)),
    xyz AS (SELECT x, y, 0.96422::DOUBLE * {1} AS px, {2} AS py, 0.82521::DOUBLE * {3} AS pz FROM f),
    lin AS (SELECT x, y, 3.1338561::DOUBLE * px - 1.6168667::DOUBLE * py - 0.4906146::DOUBLE * pz AS lr, -0.9787684::DOUBLE * px + 1.9161415::DOUBLE * py + 0.033454::DOUBLE * pz AS lg, 0.0719453::DOUBLE * px - 0.2289914::DOUBLE * py + 1.4052427::DOUBLE * pz AS lb FROM xyz)
    SELECT x, y, {4} AS r, {5} AS g, {6} AS b FROM lin""".format(
    _SCALED,
    *(f"CASE WHEN {v} * {v} * {v} > 0.008856::DOUBLE THEN {v} * {v} * {v} ELSE ({v} - 16::DOUBLE / 116) / 7.787::DOUBLE END" for v in ("fx", "fy", "fz")),
    *(byte_sql(f"round(255 * CASE WHEN {v} > 0.0031308::DOUBLE THEN 1.055::DOUBLE * pow(greatest({v}, 0), 1::DOUBLE / 2.4::DOUBLE) - 0.055::DOUBLE ELSE 12.92::DOUBLE * {v} END, 6)") for v in ("lr", "lg", "lb")),
)


@query(_LAB)
def lab_to_rgb(spark: S, d: str) -> DataFrame:
    return _scaled(spark, d).select("x", "y", *_bytes(color.lab(F.least(F.lit(100.0), F.col("c0") / F.lit(2.55)), F.col("c1") - 128, F.col("c2") - 128)))


@query(f"SELECT x, y, {_bytes_sql(*(f'CASE WHEN c3 > 0 AND c3 < 255 THEN {c} * 255 / c3 ELSE {c} END' for c in ('c0', 'c1', 'c2')))}, {byte_sql('c3')} AS a FROM {_SCALED} s")
def alpha_associated(spark: S, d: str) -> DataFrame:
    return _scaled(spark, d).select("x", "y", *_bytes(tuple(color.unpremultiply(c, "c3") for c in ("c0", "c1", "c2"))), color.to_byte("c3").alias("a"))


@query(f"SELECT x, y, {_bytes_sql('c0', 'c1', 'c2')}, {byte_sql('c3')} AS a FROM {_SCALED} s")
def alpha_unassociated(spark: S, d: str) -> DataFrame:
    return _scaled(spark, d).select("x", "y", *_bytes((F.col("c0"), F.col("c1"), F.col("c2"))), color.to_byte("c3").alias("a"))


@query(f"SELECT q.id, q.x, q.y, round(e.v, 6) AS v FROM (SELECT event_id AS id, (event_id * 7) % 70 AS x, (event_id * 13) % 600 AS y FROM events) q JOIN {E_SQL} e ON e.x = q.x AND e.y = q.y WHERE q.x < 64 AND q.y < {HEIGHT}")
def point_lookup(spark: S, d: str) -> DataFrame:
    """Points within bounds, one sample each; the others ask for nothing."""
    points = views.table(spark, d, "events").select(F.col("event_id").alias("id"), (F.col("event_id") * 7 % 70).alias("x"), (F.col("event_id") * 13 % 600).alias("y"))
    x0, y0, x1, y1 = _whole(spark, d)
    inside = points.where(f"x >= {x0} AND x < {x1} AND y >= {y0} AND y < {y1}")
    return inside.join(views.embedding_raster(spark, d), ["x", "y"]).select("id", "x", "y", F.round("v", 6).alias("v"))


@query(f"SELECT page_id, x, y, v, (sum(diff) OVER (PARTITION BY page_id, y ORDER BY x) % 65536 + 65536)::BIGINT % 65536 AS undone FROM (SELECT *, (CASE WHEN x = 0 THEN v ELSE v - lag(v) OVER (PARTITION BY page_id, y ORDER BY x) END)::BIGINT AS diff FROM {T_SQL} t)")
def predictor2_undo(spark: S, d: str) -> DataFrame:
    """Rows stored as differences to the left come back as running sums modulo 2^16."""
    row = Window.partitionBy("page_id", "y").orderBy("x")
    stored = views.page_raster(spark, d).withColumn("diff", F.when(F.col("x") == 0, F.col("v")).otherwise(F.col("v") - F.lag("v").over(row)).cast("long"))
    return stored.select("page_id", "x", "y", "v", F.pmod(F.sum("diff").over(row), F.lit(65536)).alias("undone"))


@query(f"SELECT page_id, min(i) AS at, max(i) + 1 AS after, any_value(v) AS v FROM (SELECT page_id, y * 64 + x AS i, v, (y * 64 + x) - row_number() OVER (PARTITION BY page_id, v ORDER BY y, x) AS k FROM {T_SQL} t) GROUP BY page_id, v, k HAVING count(*) > 1")
def packbits_runs(spark: S, d: str) -> DataFrame:
    """Runs of two and more equal samples, which a run-length codec writes as one."""
    rows = views.page_raster(spark, d).withColumn("i", F.col("y") * 64 + F.col("x"))
    marked = rows.withColumn("k", F.col("i") - F.row_number().over(Window.partitionBy("page_id", "v").orderBy("i")))
    return marked.groupBy("page_id", "v", "k").agg(F.min("i").alias("at"), (F.max("i") + 1).alias("after"), F.count("*").alias("n")).where("n > 1").select("page_id", "at", "after", "v")


@query(f"""SELECT round(max(abs(a.v - b.v)), 6) AS max_diff, round(avg(abs(a.v - b.v)), 6) AS mean_diff, count(*) FILTER (WHERE abs(a.v - b.v) > 0.5) AS mismatches
    FROM ({box_sql(E_SQL, WHOLE, (16, 100))}) a JOIN ({_nearest_sql(WHOLE, (16, 100))}) b USING (ox, oy)""")
def diff_metrics(spark: S, d: str) -> DataFrame:
    pixels, whole = views.embedding_raster(spark, d), _whole(spark, d)
    mean = region.box_mean(pixels, whole, (16, 100), ["v"]).withColumnRenamed("v", "a")
    gap = F.abs(F.col("a") - F.col("v"))
    both = mean.join(region.nearest(pixels, whole, (16, 100), ["v"]), ["ox", "oy"])
    return both.agg(F.round(F.max(gap), 6).alias("max_diff"), F.round(F.avg(gap), 6).alias("mean_diff"), F.count_if(gap > 0.5).alias("mismatches"))


@query(f"SELECT x // 16 AS tx, y // 32 AS ty, count(*) AS n, round(sum(v), 4) AS total FROM {E_SQL} e WHERE x >= 10 AND x < 40 AND y >= 30 AND y < 200 GROUP BY 1, 2")
def tile_prune_window(spark: S, d: str) -> DataFrame:
    """A window's tiles by their keys; then the window's pixels of each."""
    request = spark.createDataFrame([(10, 30, 40, 200)], "x0 int, y0 int, x1 int, y1 int")
    keys = region.tile_keys(request, 16, 32)
    tiled = views.embedding_raster(spark, d).withColumn("tx", F.floor(F.col("x") / 16).cast("long")).withColumn("ty", F.floor(F.col("y") / 32).cast("long"))
    hit = tiled.join(F.broadcast(keys), ["tx", "ty"]).where("x >= x0 AND x < x1 AND y >= y0 AND y < y1")
    return hit.groupBy("tx", "ty").agg(F.count("*").alias("n"), F.round(F.sum("v"), 4).alias("total"))


_SPARSE = "(SELECT event_id, 5 + event_id % 9 AS n, event_id % 40 AS lo, event_id % 40 + 30 + event_id % 25 AS hi FROM events)"
_SPARSE_TILES = f"(SELECT DISTINCT event_id, least(hi - 1, lo + floor((i + 0.5::DOUBLE) * (hi - lo) / n)::BIGINT) // 4 AS tile FROM {_SPARSE} q, unnest(range(n)) r(i))"


def _sparse(spark: S, d: str) -> DataFrame:
    e = F.col("event_id")
    return views.table(spark, d, "events").select("event_id", (5 + e % 9).alias("n"), (e % 40).alias("lo"), (e % 40 + 30 + e % 25).alias("hi"))


@query(f"SELECT event_id, tile FROM {_SPARSE_TILES} t")
def tile_prune_sparse(spark: S, d: str) -> DataFrame:
    """Tiles of each request along one side that hold at least one nearest sample."""
    return region.sampled_tiles(_sparse(spark, d), "lo", "hi", "n", 4).select("event_id", "tile")


@query(f"SELECT event_id, min(tile) AS first, max(tile) + 1 AS after FROM (SELECT event_id, tile, tile - row_number() OVER (PARTITION BY event_id ORDER BY tile) AS k FROM {_SPARSE_TILES} t) GROUP BY event_id, k")
def tile_islands(spark: S, d: str) -> DataFrame:
    from tessella.operators.requests import islands

    return islands(region.sampled_tiles(_sparse(spark, d), "lo", "hi", "n", 4), "tile", ["event_id"]).select("event_id", "first", "after")


_ENTRIES = "(SELECT o_orderkey, o_orderkey % 3 AS plane, o_orderkey % 7 AS ty, o_orderkey % 5 AS tx, 5 + o_orderkey % 60 AS w, 7 + o_orderkey % 50 AS h FROM orders)"


@query(f"SELECT o_orderkey, ty * ((w * 16 + 15) // 16) + tx AS chunky, plane * ((w * 16 + 15) // 16) * ((h * 32 + 31) // 32) + ty * ((w * 16 + 15) // 16) + tx AS planar FROM {_ENTRIES} q")
def tile_offsets_chunky_planar(spark: S, d: str) -> DataFrame:
    """Where a tile stands in the offset table of pages of 16 x 32 tiles, chunky and planar."""
    k = F.col("o_orderkey")
    rows = views.table(spark, d, "orders").select(k, (k % 3).alias("plane"), (k % 7).alias("ty"), (k % 5).alias("tx"), ((5 + k % 60) * 16).alias("w"), ((7 + k % 50) * 32).alias("h"))
    across, down = G.tile_count(F.col("w"), 16), G.tile_count(F.col("h"), 32)
    return rows.select("o_orderkey", G.tile_index("tx", "ty", "plane", across, down, False).alias("chunky"), G.tile_index("tx", "ty", "plane", across, down, True).alias("planar"))
