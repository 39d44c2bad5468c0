"""Queries on what is shown: views, clips, scales, sample arrays and whole cells as RGBA."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import arrays, color
from tessella.functions import geometry as G
from tessella.operators import display, views
from tessella.operators import requests as R
from tessella.plans.raster import _SCALED, _scaled
from tessella.plans.registry import byte_sql, query

S = SparkSession


def _events(spark: S, d: str) -> DataFrame:
    return views.table(spark, d, "events")


# -- views

_FIT = "least(800 / w::DOUBLE, 600 / h::DOUBLE)"


@query(f"""WITH q AS (SELECT o_orderkey, 300 + o_orderkey % 9000 AS w, 200 + o_orderkey * 7 % 5000 AS h, (1 + o_orderkey % 40) / 16.0::DOUBLE AS scale, -(o_orderkey % 700)::DOUBLE AS offs, (o_orderkey % 80) / 4.0::DOUBLE AS wish FROM orders),
    f AS (SELECT *, {_FIT} AS fit FROM q), g AS (SELECT *, least(greatest(64, fit * 4), greatest(least(fit * 0.5::DOUBLE, 1), wish)) AS next FROM f), z AS (SELECT *, 400 - (400 - offs) * next / scale AS moved, w * next AS size FROM g)
    SELECT o_orderkey, round(fit, 6) AS fit, round(next, 6) AS next, round(CASE WHEN size <= 800 THEN (800 - size) / 2 ELSE least(0, greatest(800 - size, moved)) END, 6) AS offs FROM z""")
def fit_views(spark: S, d: str) -> DataFrame:
    """The scale at which a page fits, a zoom held within its bounds around the middle, and the offset after it."""
    k = F.col("o_orderkey")
    q = views.table(spark, d, "orders").select(k, (300 + k % 9000).alias("w"), (200 + k * 7 % 5000).alias("h"), ((1 + k % 40) / F.lit(16.0)).alias("scale"), (-(k % 700)).cast("double").alias("offs"), ((k % 80) / F.lit(4.0)).alias("wish"))
    q = q.withColumn("fit", G.fit_scale("w", "h", 800, 600))
    least, most = G.zoom_bounds("fit")
    q = q.withColumn("next", F.least(most, F.greatest(least, "wish")))
    moved = G.zoom_offset("offs", F.lit(400.0), "scale", "next")
    return q.select("o_orderkey", F.round("fit", 6).alias("fit"), F.round("next", 6).alias("next"), F.round(G.clamp_offset(moved, F.col("w") * F.col("next"), 800), 6).alias("offs"))


_EDGES = "(SELECT event_id, floor(ox + 512 * t * s + 0.5::DOUBLE)::BIGINT AS e0, floor(ox + 512 * (t + 1) * s + 0.5::DOUBLE)::BIGINT AS e1 FROM (SELECT event_id, -(event_id % 900) + 0.25::DOUBLE AS ox, event_id % 5 AS t, (1 + event_id % 24) / 16.0::DOUBLE AS s FROM events))"


def _edges(spark: S, d: str) -> DataFrame:
    e = F.col("event_id")
    q = _events(spark, d).select(e, (-(e % 900) + F.lit(0.25)).alias("ox"), (e % 5).alias("t"), ((1 + e % 24) / F.lit(16.0)).alias("s"))
    return q.select("event_id", G.device_edge("ox", F.col("t") * 512, "s").alias("e0"), G.device_edge("ox", (F.col("t") + 1) * 512, "s").alias("e1"))


@query(f"SELECT event_id, e0, e1 FROM {_EDGES} q")
def device_edges(spark: S, d: str) -> DataFrame:
    """Device places of a tile's edges, rounded so that tiles meet."""
    return _edges(spark, d)


@query(f"SELECT event_id, round((greatest(0, e0) - e0) / (e1 - e0)::DOUBLE * 512, 6) AS s0, round((least(800, e1) - e0) / (e1 - e0)::DOUBLE * 512, 6) AS s1 FROM {_EDGES} q WHERE least(800, e1) > greatest(0, e0)")
def bitmap_clips(spark: S, d: str) -> DataFrame:
    """The part of a tile's bitmap that the canvas shows."""
    first, last = G.bitmap_clip("e0", "e1", 800, 512)
    shown = _edges(spark, d).where("least(800, e1) > greatest(0, e0)")
    return shown.select("event_id", F.round(first, 6).alias("s0"), F.round(last, 6).alias("s1"))


@query("SELECT event_id, least(event_id % 7, greatest(0, floor(log2(1 / ((1 + event_id % 50) / 16.0::DOUBLE * (1 + event_id % 2))))))::INT AS z FROM events")
def view_levels(spark: S, d: str) -> DataFrame:
    e = F.col("event_id")
    return _events(spark, d).select("event_id", G.view_level((1 + e % 50) / F.lit(16.0), 1 + e % 2, (e % 7).cast("int")).cast("int").alias("z"))


_TILES = "(SELECT event_id, event_id % 6 AS z, event_id * 31 % 4000 AS x0, event_id * 31 % 4000 + 512 AS x1, event_id * 17 % 3000 AS y0, event_id * 17 % 3000 + 256 AS y1, event_id % 5 AS view, 1000 AS vx0, 500 AS vy0, 2800 AS vx1, 1700 AS vy1 FROM events)"


@query(f"SELECT event_id, z FROM {_TILES} t WHERE x0 < vx1 AND x1 > vx0 AND y0 < vy1 AND y1 > vy0 AND z >= view - 2")
def visible_stack(spark: S, d: str) -> DataFrame:
    """Tiles that are drawn: in view, and no finer than two levels below the view's."""
    e = F.col("event_id")
    x, y = e * 31 % 4000, e * 17 % 3000
    tiles = _events(spark, d).select(e, (e % 6).alias("z"), x.alias("x0"), (x + 512).alias("x1"), y.alias("y0"), (y + 256).alias("y1"), (e % 5).alias("view"), *[F.lit(v).alias(n) for n, v in (("vx0", 1000), ("vy0", 500), ("vx1", 2800), ("vy1", 1700))])
    return R.visible(tiles, F.col("view")).select("event_id", "z")


_G = "(SELECT event_id, event_id // 100 AS generation, event_id * 31 % 60 AS tile, event_id % 3 > 0 AS final, event_id % 11 = 0 AS bad FROM events)"


@query(f"""SELECT DISTINCT generation, tile FROM {_G} w WHERE (generation, tile) NOT IN (SELECT generation, tile FROM {_G} t WHERE final AND event_id % 2 = 0) AND tile NOT IN (SELECT tile FROM {_G} b WHERE bad AND tile % 7 = 0)""")
def still_wanted(spark: S, d: str) -> DataFrame:
    """Wanted tiles without those that are here, final and of this generation, or have failed."""
    e = F.col("event_id")
    q = _events(spark, d).select(e, F.floor(e / 100).alias("generation"), (e * 31 % 60).alias("tile"), (e % 3 > 0).alias("final"), (e % 11 == 0).alias("bad"))
    return R.still_wanted(q.select("generation", "tile").distinct(), q.where("event_id % 2 = 0"), q.where("bad AND tile % 7 = 0").distinct(), ["tile"])


@query("SELECT q.event_id, a.event_id * 3 AS answer FROM events q LEFT JOIN (SELECT event_id FROM events WHERE event_id % 4 > 0) a ON a.event_id = q.event_id WHERE q.event_id % 2 = 0")
def request_answers(spark: S, d: str) -> DataFrame:
    """Requests with their answers, or null while they wait; answers that nobody asked for go."""
    e = _events(spark, d).select("event_id")
    return R.answers(e.where("event_id % 2 = 0"), e.where("event_id % 4 > 0").withColumn("answer", F.col("event_id") * 3), ["event_id"]).select("event_id", "answer")


@query("SELECT event_id, ms + delay AS fires FROM (SELECT event_id, ms, delay, lead(ms) OVER (PARTITION BY viewer ORDER BY ms, event_id) AS following FROM (SELECT event_id, user_id % 20 AS viewer, epoch_us(ts) // 1000 AS ms, CASE WHEN event_id % 4 = 0 THEN 0 ELSE 600000 END AS delay FROM events)) WHERE following IS NULL OR following >= ms + delay")
def view_requests(spark: S, d: str) -> DataFrame:
    """Changes of a view after which its tiles are asked for: those that none follows within their delay."""
    e = F.col("event_id")
    q = _events(spark, d).select(e, (F.col("user_id") % 20).alias("viewer"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), F.when(e % 4 == 0, 0).otherwise(600_000).alias("delay"))
    return R.fires(q, "viewer").select("event_id", "fires")


@query("SELECT user_id % 20 AS viewer, bool_or(event_id // 100 = last) AS current, bool_or(event_id % 5 <> 1) AS odd FROM events, (SELECT max(event_id // 100) AS last FROM events) GROUP BY 1")
def existence(spark: S, d: str) -> DataFrame:
    """Whether a viewer has any tile of the current generation, and any whose factor is not one."""
    e = F.col("event_id")
    top = _events(spark, d).agg(F.max(F.floor(e / 100)).alias("last"))
    q = _events(spark, d).select((F.col("user_id") % 20).alias("viewer"), F.floor(e / 100).alias("generation"), F.array(e % 5).alias("factors")).crossJoin(F.broadcast(top))
    return q.groupBy("viewer").agg(F.bool_or(F.col("generation") == F.col("last")).alias("current"), F.bool_or(F.exists("factors", lambda x: x != 1)).alias("odd"))


# -- reads

@query("SELECT event_id, least(hi - 1, greatest(lo, t + place * s + s // 2)) AS centre, (lo - t) // s AS first, (hi - t + s - 1) // s AS after FROM (SELECT event_id, event_id % 50 * 16 AS t, event_id % 16 AS place, (2 ** (event_id % 4))::BIGINT AS s, event_id % 50 * 16 + event_id % 5 AS lo, event_id % 50 * 16 + 16 - event_id % 3 AS hi FROM events)")
def reduced_centres(spark: S, d: str) -> DataFrame:
    """The source place of a reduced tile's place, and the places that a window touches."""
    e = F.col("event_id")
    t = e % 50 * 16
    q = _events(spark, d).select(e, t.alias("t"), (e % 16).alias("place"), (e % 4).alias("shift"), (t + e % 5).alias("lo"), (t + 16 - e % 3).alias("hi"))
    first, after = G.reduced_span("t", "shift", "lo", "hi")
    return q.select("event_id", G.reduced_centre("t", "place", "shift", "lo", "hi").alias("centre"), first.alias("first"), after.alias("after"))


_ROWS = "(SELECT event_id, event_id % 90 AS lo, event_id % 90 + 40 + event_id % 30 AS hi, 5 + event_id % 20 AS n, event_id % 90 + 1 + event_id % 75 AS bottom FROM events)"


@query(f"""SELECT event_id, CASE WHEN bottom >= hi THEN n ELSE least(n - 1, (bottom - lo) * n // (hi - lo)) END AS mean, len(list_filter(range(n), lambda i: least(hi - 1, lo + floor((i + 0.5::DOUBLE) * (hi - lo) / n)::BIGINT) < bottom)) AS sampled FROM {_ROWS} q""")
def running_rows(spark: S, d: str) -> DataFrame:
    """Output rows that are final when the source is read to a row."""
    e = F.col("event_id")
    q = _events(spark, d).select(e, (e % 90).alias("lo"), (e % 90 + 40 + e % 30).alias("hi"), (5 + e % 20).alias("n"), (e % 90 + 1 + e % 75).alias("bottom"))
    return q.select("event_id", G.final_rows("bottom", "lo", "hi", "n", True).alias("mean"), G.final_rows("bottom", "lo", "hi", "n", False).alias("sampled"))


@query("SELECT viewer, generation, sum(w * h * bands * size)::BIGINT AS bytes FROM (SELECT user_id % 20 AS viewer, event_id // 100 AS generation, 1 + event_id % 64 AS w, 1 + event_id % 32 AS h, 1 + event_id % 4 AS bands, (2 ** (event_id % 4))::BIGINT AS size FROM events) GROUP BY 1, 2")
def region_bytes(spark: S, d: str) -> DataFrame:
    """Bytes that read regions hold: the sum over their bands."""
    e = F.col("event_id")
    one = (1 + e % 64) * (1 + e % 32) * F.pow(F.lit(2.0), e % 4).cast("long")
    bands = F.transform(F.sequence(F.lit(1).cast("long"), 1 + e % 4), lambda _: one)
    q = _events(spark, d).select((F.col("user_id") % 20).alias("viewer"), F.floor(e / 100).alias("generation"), F.aggregate(bands, F.lit(0).cast("long"), lambda n, x: n + x).alias("bytes"))
    return q.groupBy("viewer", "generation").agg(F.sum("bytes").alias("bytes"))


# -- samples

@query("SELECT p_partkey, bits, is_float, round(CASE WHEN is_float THEN 255 WHEN bits = 8 THEN 1 ELSE 255 / (2.0::DOUBLE ** bits - 1) END, 9) AS scale, round(CASE WHEN is_float THEN 255 WHEN bits = 8 THEN 1 WHEN bits = 16 THEN 1 / 257.0::DOUBLE ELSE 255 / (2.0::DOUBLE ** bits - 1) END, 9) AS alpha FROM (SELECT p_partkey, [1, 4, 8, 12, 16, 32][1 + p_partkey % 6] AS bits, p_partkey % 5 = 0 AS is_float FROM part)")
def sample_scales(spark: S, d: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = views.table(spark, d, "part").select(k, F.element_at(F.lit([1, 4, 8, 12, 16, 32]), (k % 6).cast("int") + 1).alias("bits"), (k % 5 == 0).alias("is_float"))
    bits, is_float = F.col("bits"), F.col("is_float")
    return rows.select("p_partkey", "bits", "is_float", F.round(color.byte_scale_of(bits, is_float), 9).alias("scale"), F.round(color.alpha_scale(bits, is_float), 9).alias("alpha"))


def _signed(v: str, bits: int, unit: str) -> str:
    return f"round((CASE WHEN {v} >= {2 ** (bits - 1)} THEN {v} - {2**bits} ELSE {v} END) * {unit}, 6)"


@query(f"""SELECT x, y, round(s0 / 255.0::DOUBLE * 100, 6) AS l8, {_signed('s1', 8, '1.0::DOUBLE')} AS a8, {_signed('s2', 8, '1.0::DOUBLE')} AS b8, round(s0 * 257 / 65535.0::DOUBLE * 100, 6) AS l16, {_signed('s1 * 257', 16, '(1 / 256.0::DOUBLE)')} AS a16, {_signed('s2 * 257', 16, '(1 / 256.0::DOUBLE)')} AS b16
    FROM (SELECT x, y, {byte_sql('c0')} AS s0, {byte_sql('c1')} AS s1, {byte_sql('c2')} AS s2 FROM {_SCALED} s)""")
def lab_integers(spark: S, d: str) -> DataFrame:
    """Lab samples stored as whole numbers of 8 and 16 bits."""
    rows = _scaled(spark, d).select("x", "y", *[color.to_byte(f"c{k}").alias(f"s{k}") for k in range(3)])
    out = []
    for bits, factor in ((8, 1), (16, 257)):
        made = color.lab_samples(*[(F.col(f"s{k}") * factor).cast("double") for k in range(3)], F.lit(bits), F.lit(False))
        out += [F.round(v, 6).alias(f"{n}{bits}") for n, v in zip("lab", made, strict=True)]
    return rows.select("x", "y", *out)


@query("SELECT vec_id, CASE vec_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 4 ELSE 0 END AS many, label % 8 = 0 AS none, len(embedding[1:(label % 8) * 8]) AS prefix FROM embeddings")
def sample_arrays(spark: S, d: str) -> DataFrame:
    """A number, an array or nothing as an array, and the first rows of a raster eight wide."""
    k = F.col("vec_id")
    many = arrays.one_or_many(F.when(k % 3 == 0, F.col("label")), F.when(k % 3 == 1, F.slice("embedding", 1, 4)))
    prefix = arrays.first_rows("embedding", F.col("label") % 8, F.lit(8))
    return views.table(spark, d, "embeddings").select("vec_id", F.size(many).alias("many"), (F.size(prefix) == 0).alias("none"), F.size(prefix).cast("long").alias("prefix"))


@query("""SELECT vec_id, k.i AS at, CASE WHEN (k.i // 3) % 5 < 4 THEN round(embedding[((k.i // 15) * 4 + (k.i // 3) % 5) * 4 + k.i % 3 + 1]::DOUBLE, 6) ELSE 0 END AS v FROM embeddings, range(60) k(i)""")
def packed_samples(spark: S, d: str) -> DataFrame:
    """Four by four RGBA pixels as three samples in rows of five."""
    packed = arrays.from_rgba(F.transform("embedding", lambda v: v.cast("double")), F.lit(4), F.lit(4), F.lit(5), F.lit(3))
    return views.table(spark, d, "embeddings").select("vec_id", F.posexplode(packed).alias("at", "v")).select("vec_id", F.col("at").cast("long").alias("at"), F.round("v", 6).alias("v"))


_CELLS = f"(SELECT *, ['gray', 'rgb', 'cmyk', 'ycbcr'][1 + ((x + y) % 4)::INT] AS kind, (x * 7 + y) % 3 = 0 AS white, (x + 2 * y) % 5 < 2 AS has_alpha FROM {_SCALED} s)"
_STRETCH = "(({0}) - 10) * (255.0::DOUBLE / 190)"


def _by_kind(k: int) -> str:
    c = f"c{k}"
    gray = _STRETCH.format("c0")
    ycc = ("c0 + 1.402::DOUBLE * (c2 - 128)", "c0 - 0.344136::DOUBLE * (c1 - 128) - 0.714136::DOUBLE * (c2 - 128)", "c0 + 1.772::DOUBLE * (c1 - 128)")[k]
    made = f"CASE kind WHEN 'gray' THEN CASE WHEN white THEN 255 - {gray} ELSE {gray} END WHEN 'rgb' THEN {_STRETCH.format(c)} WHEN 'cmyk' THEN (255 - {c}) * (1 - c3 / 255) ELSE {ycc} END"
    return f"CASE WHEN has_alpha AND kind <> 'cmyk' AND a > 0 AND a < 255 THEN ({made}) * 255 / a ELSE {made} END"


@query(f"""WITH q AS (SELECT *, CASE WHEN NOT has_alpha OR kind = 'cmyk' THEN 255 WHEN kind = 'gray' THEN c1 ELSE c3 END AS a FROM {_CELLS} c),
    e AS (SELECT *, c0 = 127.5::DOUBLE AND (kind = 'gray' OR kind = 'rgb' AND c1 = 127.5::DOUBLE AND c2 = 127.5::DOUBLE) AS empty, {', '.join(f'{_by_kind(k)} AS v{k}' for k in range(3))} FROM q)
    SELECT x, y, {', '.join(f'CASE WHEN empty THEN 0 ELSE {byte_sql(f"v{k}")} END AS {n}' for k, n in enumerate('rgb'))}, CASE WHEN empty THEN 0 ELSE {byte_sql('a')} END AS a FROM e""")
def display_cells(spark: S, d: str) -> DataFrame:
    """Cells of all kinds with alpha and NoData by the one display operator."""
    cells = _scaled(spark, d).withColumn("kind", F.element_at(F.lit(["gray", "rgb", "cmyk", "ycbcr"]), ((F.col("x") + F.col("y")) % 4).cast("int") + 1))
    alpha = (F.col("x") + 2 * F.col("y")) % 5 < 2
    wide = F.when(F.col("kind") == "gray", F.array("c0", "c1")).when(F.col("kind") == "cmyk", F.array("c0", "c1", "c2", "c3")).otherwise(F.array("c0", "c1", "c2", "c3"))
    page = {
        "v": wide, "bits": F.lit(8), "sample_format": F.lit(1), "nodata": F.lit(127.5), "color_map": F.lit(None).cast("array<int>"), "white_is_zero": (F.col("x") * 7 + F.col("y")) % 3 == 0,
        "has_alpha": alpha, "alpha_associated": F.lit(True), "tone_adjustable": F.lit(True), "lo": F.lit(10.0), "hi": F.lit(200.0), "p02": F.lit(0.0), "p98": F.lit(0.0),
    }
    return display.rgba(cells.withColumns(page), "minmax").select("x", "y", "r", "g", "b", "a")
