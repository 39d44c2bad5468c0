"""Queries on pages, levels, views and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import geometry as G
from tessella.functions import text
from tessella.operators import pages, region, views
from tessella.plans.registry import query

S = SparkSession
LEVELS = [(p, lv, w >> (2 * lv)) for p, w in ((0, 64000), (1, 5000), (2, 300)) for lv in range(4)]
_LEVELS_SQL = "(VALUES " + ", ".join(map(str, LEVELS)) + ") l(page, level, level_w)"
_PAGE_W, _PAGE_H = "(300 + o_orderkey % 90000)", "(200 + (o_orderkey * 7) % 50000)"


@query(f"""WITH q AS (SELECT event_id, event_id % 3 AS page, 100 + (event_id * 37) % 900 AS w, 20 + (event_id * 11) % 500 AS out_w FROM events)
    SELECT q.event_id, q.page, coalesce(min(m.level), 0)::INT AS level FROM q LEFT JOIN (SELECT q.event_id, arg_min(l.level, l.level_w) AS level FROM q JOIN {_LEVELS_SQL} ON l.page = q.page
    JOIN {_LEVELS_SQL.replace(' l(', ' f(')} ON f.page = q.page AND f.level = 0 WHERE l.level_w >= 0.98::DOUBLE * f.level_w * q.out_w / q.w GROUP BY 1) m USING (event_id) GROUP BY 1, 2""")
def level_choice(spark: S, d: str) -> DataFrame:
    levels = spark.createDataFrame(LEVELS, "page long, level int, level_w long")
    requests = views.table(spark, d, "events").select("event_id", (F.col("event_id") % 3).alias("page"), (100 + F.col("event_id") * 37 % 900).alias("w"), (20 + F.col("event_id") * 11 % 500).alias("out_w"))
    return region.choose_level(requests, levels).select("event_id", "page", F.col("level").cast("int").alias("level"))


@query("SELECT event_id, x0, x1, lx0, greatest(lx0 + 1, least(250, ceil(x1 * 0.25::DOUBLE)::BIGINT)) AS lx1 FROM (SELECT event_id, x0, x1, least(249, floor(x0 * 0.25::DOUBLE)::BIGINT) AS lx0 FROM (SELECT event_id, event_id % 1000 AS x0, event_id % 1000 + 1 + event_id % 17 AS x1 FROM events))")
def level_windows(spark: S, d: str) -> DataFrame:
    q = views.table(spark, d, "events").select("event_id", (F.col("event_id") % 1000).alias("x0"), (F.col("event_id") % 1000 + 1 + F.col("event_id") % 17).alias("x1"))
    lo, hi = G.level_window("x0", "x1", F.lit(0.25), F.lit(250).cast("long"))
    return q.select("event_id", "x0", "x1", lo.alias("lx0"), hi.alias("lx1"))


@query(f"SELECT o_orderkey, {_PAGE_W} AS w, {_PAGE_H} AS h, greatest(0, ceil(log2(greatest({_PAGE_W}, {_PAGE_H}) / 32.0::DOUBLE)))::INT AS top FROM orders")
def top_level(spark: S, d: str) -> DataFrame:
    return views.table(spark, d, "orders").select("o_orderkey", F.expr(_PAGE_W).alias("w"), F.expr(_PAGE_H).alias("h")).withColumn("top", G.top_level("w", "h"))


@query("SELECT z.i::INT AS z, t.i AS tile, t.i * (512 * 2 ** z.i)::BIGINT AS x0, least(9000, (t.i + 1) * (512 * 2 ** z.i)::BIGINT) AS x1, greatest(1, ceil((least(9000, (t.i + 1) * (512 * 2 ** z.i)::BIGINT) - t.i * (512 * 2 ** z.i)::BIGINT) / 2 ** z.i)::BIGINT) AS cells FROM range(6) z(i), range(18) t(i) WHERE t.i * (512 * 2 ** z.i)::BIGINT < 9000")
def tile_windows(spark: S, d: str) -> DataFrame:
    """Display tiles of a page 9000 wide, by level."""
    levels = spark.range(6).select(F.col("id").cast("int").alias("z"))
    first, after = G.display_tiles(F.lit(0), F.lit(9000), F.col("z"))
    tiles = levels.withColumn("tile", F.explode(F.sequence(first, after - 1)))
    span = G.display_span(F.col("z"))
    edges = tiles.withColumn("x0", F.col("tile") * span).withColumn("x1", F.least(F.lit(9000).cast("long"), (F.col("tile") + 1) * span))
    return edges.withColumn("cells", G.display_size("x0", "x1", "z"))


@query("SELECT event_id, greatest(0, floor(-off / 0.5::DOUBLE)::BIGINT) AS lo, least(3000, ceil((800 - off) / 0.5::DOUBLE)::BIGINT) AS hi FROM (SELECT event_id, (event_id * 31) % 2000 - 1200 AS off FROM events) WHERE greatest(0, floor(-off / 0.5::DOUBLE)::BIGINT) < least(3000, ceil((800 - off) / 0.5::DOUBLE)::BIGINT)")
def visible_window(spark: S, d: str) -> DataFrame:
    q = views.table(spark, d, "events").select("event_id", (F.col("event_id") * 31 % 2000 - 1200).alias("off"))
    lo, hi = G.visible("off", 800, F.lit(0.5), 3000)
    return q.select("event_id", lo.alias("lo"), hi.alias("hi")).where("lo < hi")


_VIEW = "(SELECT event_id, 300 + (event_id * 91) % 4000 AS cx, 200 + (event_id * 57) % 3000 AS cy FROM events)"


@query(f"""SELECT event_id, i, j, (row_number() OVER (PARTITION BY event_id ORDER BY dist, j, i) - 1)::INT AS urgency FROM (SELECT event_id, tx.i AS i, ty.i AS j, round(sqrt(((tx.i + 0.5::DOUBLE) * 512 - cx) ** 2 + ((ty.i + 0.5::DOUBLE) * 512 - cy) ** 2), 6) AS dist
    FROM {_VIEW} q, range(10) tx(i), range(8) ty(i) WHERE tx.i >= floor((cx - 300) / 512.0::DOUBLE) AND tx.i < ceil((cx + 300) / 512.0::DOUBLE) AND ty.i >= floor((cy - 200) / 512.0::DOUBLE) AND ty.i < ceil((cy + 200) / 512.0::DOUBLE))""")
def visible_tiles_ranked(spark: S, d: str) -> DataFrame:
    """Tiles in view, those nearest to the centre first; ties in row order."""
    q = views.table(spark, d, "events").select("event_id", (300 + F.col("event_id") * 91 % 4000).alias("cx"), (200 + F.col("event_id") * 57 % 3000).alias("cy"))
    windows = q.withColumns({"x0": F.col("cx") - 300, "x1": F.col("cx") + 300, "y0": F.col("cy") - 200, "y1": F.col("cy") + 200})
    tiles = region.tile_keys(windows, 512, 512)
    dist = F.round(G.distance((F.col("tx") + F.lit(0.5)) * 512 - F.col("cx"), (F.col("ty") + F.lit(0.5)) * 512 - F.col("cy")), 6)
    order = Window.partitionBy("event_id").orderBy(dist, "ty", "tx")
    return tiles.select("event_id", F.col("tx").alias("i"), F.col("ty").alias("j"), (F.row_number().over(order) - 1).alias("urgency"))



@query("""WITH v AS (SELECT o_orderkey AS id, (o_orderkey * 131) % 20000 AS lo, (o_orderkey * 131) % 20000 + 1500 AS hi, greatest(0, least(10, floor(log2(1 + o_orderkey % 60))))::INT AS z FROM orders),
    t AS (SELECT id, v.z AS z0, l.i::INT AS z, lo, hi, (512 * 2 ** l.i)::BIGINT AS span FROM v, range(11) l(i) WHERE l.i >= v.z),
    s AS (SELECT id, z0, z, k.i * span AS x0, least(40000, (k.i + 1) * span) AS x1 FROM t, unnest(range(lo // span, (hi + span - 1) // span)) k(i)),
    c AS (SELECT id, z0, z, sum(least(ceil(x1 / 256.0::DOUBLE) - floor(x0 / 256.0::DOUBLE), ceil((x1 - x0) / 2 ** z)) * 65536)::BIGINT AS cost FROM s WHERE x0 < 40000 GROUP BY 1, 2, 3)
    SELECT c.id, c.z, c.cost, (row_number() OVER (PARTITION BY c.id ORDER BY CASE WHEN c.z = 10 THEN 0 WHEN c.z = c.z0 THEN 2 ELSE 1 END, c.z DESC) - 1)::INT AS place
    FROM c JOIN c t ON t.id = c.id AND t.z = t.z0 WHERE c.z = 10 OR c.z = c.z0 OR c.cost <= t.cost / 8.0::DOUBLE""")
def lod_plan(spark: S, d: str) -> DataFrame:
    """Levels to fetch for a view of a strip without pyramid: the overview, coarse levels of at most an eighth of the cost, then the target."""
    key = F.col("o_orderkey")
    v = views.table(spark, d, "orders").select(key.alias("id"), (key * 131 % 20000).alias("lo"), (key * 131 % 20000 + 1500).alias("hi"), F.greatest(F.lit(0), F.least(F.lit(10), F.floor(F.log2(1 + key % 60)))).cast("int").alias("z0"))
    levels = v.withColumn("z", F.explode(F.sequence("z0", F.lit(10)))).withColumn("span", G.display_span(F.col("z")))
    tiles = levels.withColumn("k", F.explode(F.sequence(F.floor(F.col("lo") / F.col("span")), F.ceil(F.col("hi") / F.col("span")).cast("long") - 1)))
    edges = tiles.withColumn("x0", F.col("k") * F.col("span")).withColumn("x1", F.least(F.lit(40000).cast("long"), (F.col("k") + 1) * F.col("span"))).where("x0 < 40000")
    one = G.region_cost("x0", "x1", F.lit(0), F.lit(1), F.lit(1.0), F.lit(1.0), F.lit(256), F.lit(256), G.display_size("x0", "x1", "z"), F.lit(1), F.lit(1))
    cost = edges.groupBy("id", "z0", "z").agg(F.sum(one).cast("long").alias("cost"))
    target = F.max(F.when(F.col("z") == F.col("z0"), F.col("cost"))).over(Window.partitionBy("id"))
    turn = F.when(F.col("z") == 10, 0).when(F.col("z") == F.col("z0"), 2).otherwise(1)
    kept = cost.withColumn("target", target).withColumn("turn", turn).where("turn <> 1 OR cost <= target / 8D")
    return kept.select("id", "z", "cost", (F.row_number().over(Window.partitionBy("id").orderBy("turn", F.col("z").desc())) - 1).alias("place"))


@query("SELECT o_orderkey, w, h, greatest(1, floor(w * 512.0::DOUBLE / greatest(w, h) + 0.5::DOUBLE)::BIGINT) AS ow, greatest(1, floor(h * 512.0::DOUBLE / greatest(w, h) + 0.5::DOUBLE)::BIGINT) AS oh FROM (SELECT o_orderkey, " + _PAGE_W + " AS w, " + _PAGE_H + " AS h FROM orders)")
def stats_overview_size(spark: S, d: str) -> DataFrame:
    q = views.table(spark, d, "orders").select("o_orderkey", F.expr(_PAGE_W).alias("w"), F.expr(_PAGE_H).alias("h"))
    return q.withColumn("ow", G.overview_side("w", "h")).withColumn("oh", G.overview_side("h", "w"))


@query("SELECT o_orderkey, step, tw, (CASE WHEN step >= 8 AND tw % 8 = 0 AND 64 % 8 = 0 THEN 8 WHEN step >= 4 AND tw % 4 = 0 THEN 4 WHEN step >= 2 AND tw % 2 = 0 THEN 2 ELSE 1 END)::INT AS reduction, greatest(1, least(16, floor(67108864 / (tw * tw * 3.0::DOUBLE))::BIGINT)) AS batch FROM (SELECT o_orderkey, 1 + o_orderkey % 12 AS step, 60 + (o_orderkey * 4) % 5000 AS tw FROM orders)")
def decode_batches(spark: S, d: str) -> DataFrame:
    q = views.table(spark, d, "orders").select("o_orderkey", (1 + F.col("o_orderkey") % 12).alias("step"), (60 + F.col("o_orderkey") * 4 % 5000).alias("tw"))
    return q.withColumn("reduction", G.jpeg_reduction("step", "tw", 64)).withColumn("batch", G.batch_tiles(F.col("tw") * F.col("tw") * 3).cast("long"))


_SUBFILE = "CASE o_orderkey % 6 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 4 WHEN 4 THEN 5 ELSE 2 END"
_IFDS = f"""(SELECT path, ifd, {_SUBFILE} AS subfile, 1000 - (ifd % 7) * 90 AS width, 700 - (ifd % 7) * 60 AS height, CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 3 END AS spp, 5000 + o_custkey * 37 AS size
    FROM (SELECT 'f' || o_custkey AS path, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, o_totalprice)::INT - 1 AS ifd, o_orderkey FROM orders))"""


def _ifds(spark: S, d: str) -> DataFrame:
    """Directories of a file for each customer: a page, its levels, masks, and odd ones."""
    order = Window.partitionBy("o_custkey").orderBy("o_orderkey", "o_totalprice")
    rows = views.table(spark, d, "orders").select(F.concat(F.lit("f"), F.col("o_custkey").cast("string")).alias("path"), "o_custkey", (F.row_number().over(order) - 1).alias("ifd"), "o_orderkey")
    columns = {"subfile": F.expr(_SUBFILE).cast("int"), "width": F.expr("1000 - (ifd % 7) * 90").cast("long"), "height": F.expr("700 - (ifd % 7) * 60").cast("long"), "spp": F.expr("CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 3 END").cast("long"), "size": F.expr("5000 + o_custkey * 37")}
    return rows.select("path", "ifd", *[v.alias(k) for k, v in columns.items()])


#: Roles and pages of the directories, by a walk from each to the next.
_ROLES = f"""WITH RECURSIVE i AS (SELECT * FROM {_IFDS} o),
    f AS (SELECT path, -1 AS ifd, '' AS role, -1 AS page, -1 AS pos, 0 AS pw, 0 AS ps FROM i WHERE ifd = 0 UNION ALL
      SELECT path, ifd, role, CASE WHEN role = 'mask' THEN -1 WHEN role = 'page' THEN pos + 1 ELSE pos END, CASE WHEN role = 'page' THEN pos + 1 ELSE pos END, CASE WHEN role = 'page' THEN width ELSE pw END, CASE WHEN role = 'page' THEN spp ELSE ps END
      FROM (SELECT i.path, i.ifd, i.width, i.spp, f.pos, f.pw, f.ps, CASE WHEN i.subfile % 2 = 1 AND f.pos >= 0 AND i.width < f.pw AND i.spp = f.ps THEN 'level' WHEN i.subfile % 2 = 0 AND i.subfile % 8 >= 4 THEN 'mask' ELSE 'page' END AS role
        FROM f JOIN i ON i.path = f.path AND i.ifd = f.ifd + 1)),
    g AS (SELECT *, max(pos) OVER (PARTITION BY path) AS last FROM f WHERE ifd >= 0),
    r AS (SELECT path, ifd::INT AS ifd, CASE WHEN role = 'mask' AND last < 0 THEN 'page' ELSE role END AS role, (CASE WHEN role = 'mask' AND last < 0 THEN ifd ELSE page END)::INT AS page FROM g),
    l AS (SELECT i.*, r.page, (row_number() OVER (PARTITION BY i.path, r.page ORDER BY i.width DESC, i.ifd) - 1)::INT AS level FROM i JOIN r USING (path, ifd) WHERE r.role <> 'mask')"""


@query(f"{_ROLES} SELECT path, ifd, role, page FROM r")
def page_classification(spark: S, d: str) -> DataFrame:
    return pages.classify(_ifds(spark, d))


@query(f"{_ROLES} SELECT path, page, level, ifd, width, first_value(width) OVER (PARTITION BY path, page ORDER BY level) AS page_w FROM l")
def level_table(spark: S, d: str) -> DataFrame:
    """Levels of each page by width."""
    return pages.levels(_ifds(spark, d)).select("path", "page", "level", "ifd", "width", "page_w")


@query(f"{_ROLES} SELECT path, sum(width * height)::BIGINT AS pixels, round(max(size) / sum(width * height)::DOUBLE, 9) AS bytes_per_pixel FROM l GROUP BY path")
def page_pixels(spark: S, d: str) -> DataFrame:
    return pages.bytes_per_pixel(pages.levels(_ifds(spark, d))).select("path", "pixels", F.round("bytes_per_pixel", 9).alias("bytes_per_pixel"))


@query(f"{_ROLES}, c AS (SELECT path, page, count(*) AS n FROM l GROUP BY 1, 2) SELECT path, (SELECT count(*) FROM i WHERE i.path = c.path) AS ifds, count(*) AS pages, string_agg(n::VARCHAR, ',' ORDER BY page) AS levels FROM c GROUP BY path")
def page_counts(spark: S, d: str) -> DataFrame:
    return pages.counts(_ifds(spark, d)).select("path", "ifds", "pages", F.array_join(F.col("levels").cast("array<string>"), ",").alias("levels"))


_CODES = "(SELECT p_partkey, [0, 1, 2, 3, 4, 5, 6, 8, 32844][1 + p_partkey % 9] AS ph, 1 + p_partkey % 5 AS spp, p_partkey % 2 = 0 AS has_map, p_partkey % 3 = 0 AS alpha FROM part)"
_KIND = "CASE WHEN ph = 2 AND spp >= 3 THEN 'rgb' WHEN ph = 3 AND has_map THEN 'palette' WHEN ph = 5 AND spp >= 4 THEN 'cmyk' WHEN ph = 6 AND spp >= 3 THEN 'ycbcr' WHEN ph = 8 AND spp >= 3 THEN 'lab' WHEN ph < 9 THEN 'gray' WHEN spp >= 3 THEN 'rgb' ELSE 'gray' END"


@query(f"""SELECT p_partkey, kind, array_to_string(list_concat(list_slice(names, 1, len(names)), list_transform(range(len(names), greatest(spp, len(names))), lambda i: CASE WHEN alpha AND i = len(names) THEN 'A' ELSE 'S' || i END)), ' ') AS labels,
    coalesce(map {{0: 'WhiteIsZero', 1: 'BlackIsZero', 2: 'RGB', 3: 'Palette', 4: 'Transparency mask', 5: 'Separated (CMYK)', 6: 'YCbCr', 8: 'CIE L*a*b*', 32844: 'LogL'}}[ph], '') AS photometric
    FROM (SELECT *, CASE kind WHEN 'rgb' THEN ['R', 'G', 'B'] WHEN 'cmyk' THEN ['C', 'M', 'Y', 'K'] WHEN 'ycbcr' THEN ['Y', 'Cb', 'Cr'] WHEN 'lab' THEN ['L*', 'a*', 'b*'] WHEN 'palette' THEN ['Index'] ELSE ['Value'] END AS names FROM (SELECT *, {_KIND} AS kind FROM {_CODES} c))""")
def page_kind_labels(spark: S, d: str) -> DataFrame:
    key = F.col("p_partkey")
    codes = F.lit([0, 1, 2, 3, 4, 5, 6, 8, 32844])
    rows = views.table(spark, d, "part").select("p_partkey", F.element_at(codes, (key % 9).cast("int") + 1).alias("ph"), (1 + key % 5).cast("int").alias("spp"), (key % 2 == 0).alias("has_map"), (key % 3 == 0).alias("alpha"))
    kinds = rows.withColumn("kind", pages.kind(F.col("ph"), F.col("spp"), F.col("has_map")))
    return kinds.select("p_partkey", "kind", pages.labels(F.col("kind"), F.col("spp"), F.col("alpha")).alias("labels"), text.code_name("ph", text.PHOTOMETRIC).alias("photometric"))


_NAMES_SQL = "map {" + ", ".join(f"{k}: '{v}'" for k, v in sorted(text.COMPRESSION.items())) + "}"
_COMP = [*sorted(text.COMPRESSION), 999]


@query(f"""SELECT p_partkey, comp, coalesce(CASE WHEN comp NOT IN {text.supported()} THEN coalesce({_NAMES_SQL}[comp], 'Unknown (' || comp || ')') || ' compression is not supported.'
    WHEN f AND bits NOT IN (16, 32, 64) THEN bits || '-bit floating point samples are not supported.' WHEN y AND comp <> 7 AND sub THEN 'Uncompressed chroma-subsampled YCbCr is not supported.' END, '') AS reason
    FROM (SELECT p_partkey, {_COMP}[1 + p_partkey % {len(_COMP)}] AS comp, p_partkey % 2 = 0 AS f, [8, 16, 24, 32, 64][1 + p_partkey % 5] AS bits, p_partkey % 3 = 0 AS y, p_partkey % 7 < 4 AS sub FROM part)""")
def unsupported_reasons(spark: S, d: str) -> DataFrame:
    key = F.col("p_partkey")
    rows = views.table(spark, d, "part").select(
        "p_partkey", F.element_at(F.lit(_COMP), (key % len(_COMP)).cast("int") + 1).alias("comp"), (key % 2 == 0).alias("f"), F.element_at(F.lit([8, 16, 24, 32, 64]), (key % 5).cast("int") + 1).alias("bits"), (key % 3 == 0).alias("y"), (key % 7 < 4).alias("sub")
    )
    return rows.select("p_partkey", "comp", F.coalesce(pages.unsupported(F.col("comp"), F.col("f"), F.col("bits"), F.col("y"), F.col("sub")), F.lit("")).alias("reason"))


@query("SELECT doc_id, n, round(CASE WHEN n >= 1073741824 THEN n / 1073741824.0::DOUBLE WHEN n >= 1048576 THEN n / 1048576.0::DOUBLE WHEN n >= 1024 THEN n / 1024.0::DOUBLE ELSE n END, 6) AS value, CASE WHEN n >= 1073741824 THEN 'GB' WHEN n >= 1048576 THEN 'MB' WHEN n >= 1024 THEN 'KB' ELSE 'B' END AS unit FROM (SELECT doc_id, n_chars * (doc_id % 4 * 700 + 1) AS n FROM documents)")
def format_bytes(spark: S, d: str) -> DataFrame:
    rows = views.table(spark, d, "documents").select("doc_id", (F.col("n_chars") * (F.col("doc_id") % 4 * 700 + 1)).alias("n"))
    value, unit = text.byte_size("n")
    return rows.select("doc_id", "n", F.round(value, 6).alias("value"), unit.alias("unit"))


@query("SELECT doc_id, round(CASE WHEN p < 10 THEN floor(p * 10 + 0.5::DOUBLE) / 10 ELSE floor(p) END, 6) AS shown FROM (SELECT doc_id, (doc_id * 37 % 1000) / 10.0::DOUBLE + 0.03::DOUBLE AS p FROM documents)")
def format_percent(spark: S, d: str) -> DataFrame:
    rows = views.table(spark, d, "documents").select("doc_id", ((F.col("doc_id") * 37 % 1000) / F.lit(10.0) + F.lit(0.03)).alias("p"))
    return rows.select("doc_id", F.round(text.percent("p"), 6).alias("shown"))


@query("SELECT page_id, list_last(string_split(url, '/')) AS name FROM pages")
def base_name(spark: S, d: str) -> DataFrame:
    return views.table(spark, d, "pages").select("page_id", text.base_name("url").alias("name"))


@query("SELECT doc_id, CASE WHEN length(t) > 1500 THEN left(t, 1500) || '… (' || length(t) || ' characters)' ELSE t END AS shown FROM (SELECT doc_id, trim(text, ' ') AS t FROM documents) WHERE length(t) > 0")
def tag_text(spark: S, d: str) -> DataFrame:
    return views.table(spark, d, "documents").select("doc_id", text.tag_text("text").alias("shown")).where("shown IS NOT NULL")


@query("SELECT p_partkey, 'R ' || p_size || '  G ' || (p_size * 2) || '  S2 ' || (p_size + 1) AS many, 'Value: ' || p_size AS one, round(CASE WHEN p_size % 4 = 0 THEN p_partkey::DOUBLE ELSE floor(p_partkey / (p_size % 4)::DOUBLE * 1000 + 0.5::DOUBLE) / 1000 END, 6) AS ratio FROM part")
def sample_texts(spark: S, d: str) -> DataFrame:
    size = F.col("p_size")
    many = text.sample_text(["R", "G", "S2"], [size.cast("string"), (size * 2).cast("string"), (size + 1).cast("string")])
    return views.table(spark, d, "part").select("p_partkey", many.alias("many"), text.sample_text(["Value"], [size.cast("string")]).alias("one"), F.round(text.rational("p_partkey", size % 4), 6).alias("ratio"))
