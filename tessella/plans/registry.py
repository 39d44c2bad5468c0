"""Queries by name, each with SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: SQL of the raster views.
E_SQL = "(SELECT vec_id AS y, i - 1 AS x, embedding[i]::DOUBLE AS v FROM embeddings, range(1, 65) r(i))"
T_SQL = "(SELECT page_id, (i - 1) % 64 AS x, (i - 1) // 64 AS y, unicode(substr(html, i::BIGINT, 1))::DOUBLE AS v FROM pages, unnest(range(1, length(html) + 1)) r(i))"
L_SQL = "(SELECT floor(l_partkey / 50)::BIGINT AS x, floor(date_diff('day', DATE '1990-01-01', l_shipdate::DATE) / 30)::BIGINT AS y, round(avg(l_quantity), 6) AS b0, round(avg(l_extendedprice), 6) AS b1, round(avg(l_discount), 6) AS b2, round(avg(l_tax), 6) AS b3, count(*) AS n FROM lineitem GROUP BY 1, 2)"


def query(sql: str | None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return add


def box_sql(source: str, window: tuple, out: tuple[int, int], bands: str = "v", where: str = "TRUE") -> str:
    """Box means with the whole output grid. The window's edges are numbers or SQL."""
    x0, y0, x1, y1 = window
    means = ", ".join(f"avg({b}) AS {b}" for b in bands.split())
    return f"""SELECT gx.i AS ox, gy.i AS oy, {', '.join(bands.split())} FROM range({out[0]}) gx(i) CROSS JOIN range({out[1]}) gy(i) LEFT JOIN (
        SELECT least({out[0] - 1}, (x - {x0}) * {out[0]} // ({x1} - {x0})) AS ox, least({out[1] - 1}, (y - {y0}) * {out[1]} // ({y1} - {y0})) AS oy, {means} FROM {source} s
        WHERE x >= {x0} AND x < {x1} AND y >= {y0} AND y < {y1} AND {where} GROUP BY 1, 2) m ON m.ox = gx.i AND m.oy = gy.i"""


STATS_SQL = "(SELECT coalesce(min(v), 0) AS lo, coalesce(max(v), 1) AS hi, coalesce(list_sort(list(v))[floor(0.02::DOUBLE * (count(*) - 1))::INT + 1], 0) AS p02, coalesce(list_sort(list(v))[floor(0.98::DOUBLE * (count(*) - 1))::INT + 1], 1) AS p98 FROM {} WHERE NOT isnan(v) AND abs(v) < 'Infinity'::DOUBLE)"


def byte_sql(v: str) -> str:
    return f"round_even(least(255, greatest(0, {v})), 0)::INT"
