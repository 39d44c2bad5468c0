"""Pixel, tile and viewport arithmetic as Column expressions. Intervals are half open."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

C = Column | int | float


def col(x: C | str) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def floor_long(x: Column) -> Column:
    return F.floor(x).cast("long")


def rounded(v: C | str, digits: int = 6) -> Column:
    """To so many decimals as SQL rounds: the scaled double's halves go away from zero."""
    unit = F.lit(10.0**digits)
    return F.round(col(v) * unit) / unit


def nearest_source(i: C, lo: C, hi: C, out: C) -> Column:
    """The source coordinate that output cell i shows when [lo, hi) is sampled to ``out`` cells."""
    span = col(hi) - col(lo)
    return F.least(col(hi) - 1, col(lo) + floor_long((col(i) + F.lit(0.5)) * span / col(out)))


def box_cell(i: C, span: C, out: C) -> Column:
    """The output cell that source offset i falls in when ``span`` cells are averaged to ``out``."""
    return F.least(col(out).cast("long") - 1, floor_long(col(i).cast("long") * col(out) / col(span)))


def level_window(lo: C, hi: C, scale: C, size: C) -> tuple[Column, Column]:
    """A full-resolution interval in a level whose size is ``scale`` times the page's; never empty."""
    first = F.least(col(size) - 1, floor_long(col(lo) * col(scale)))
    last = F.greatest(first + 1, F.least(col(size).cast("long"), F.ceil(col(hi) * col(scale)).cast("long")))
    return first, last


def tile_span(lo: C, hi: C, tile: C) -> tuple[Column, Column]:
    """First tile and the one after the last that [lo, hi) touches."""
    return floor_long(col(lo) / col(tile)), F.ceil(col(hi) / col(tile)).cast("long")


def tile_count(size: C, tile: C) -> Column:
    return F.ceil(col(size) / col(tile)).cast("long")


def tile_index(tx: C, ty: C, plane: C, across: C, down: C, planar: bool) -> Column:
    """Place of a tile in the offset table; planes follow one another in planar files only."""
    at = col(ty) * col(across) + col(tx)
    return at + col(plane) * col(across) * col(down) if planar else at


def jpeg_reduction(step: C, width: C, height: C) -> Column:
    """The largest of 8, 4, 2 that is not above the step and divides the tile's sides; else 1."""
    out = F.lit(1)
    for r in (2, 4, 8):
        out = F.when((col(step) >= r) & (col(width) % r == 0) & (col(height) % r == 0), r).otherwise(out)
    return out


def batch_tiles(tile_bytes: C, reduction: C = 1, budget: int = 64 << 20, most: int = 16) -> Column:
    return F.greatest(F.lit(1), F.least(col(reduction) * most, floor_long(F.lit(budget) / col(tile_bytes))))


def top_level(width: C, height: C) -> Column:
    """The display level at which the longer side is at most 32 cells."""
    return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(col(width), col(height)) / F.lit(32.0))).cast("int"))


def view_level(scale: C, ratio: C, top: C) -> Column:
    return F.least(col(top), F.greatest(F.lit(0), F.floor(F.log2(F.lit(1.0) / (col(scale) * col(ratio)))).cast("int")))


def display_span(z: C, tile: int = 512) -> Column:
    return (F.lit(float(tile)) * F.pow(F.lit(2.0), col(z))).cast("long")


def display_tiles(lo: C, hi: C, z: C, tile: int = 512) -> tuple[Column, Column]:
    return tile_span(lo, hi, display_span(z, tile))


def display_size(lo: C, hi: C, z: C) -> Column:
    """Cells of a display tile's side."""
    return F.greatest(F.lit(1), F.ceil((col(hi) - col(lo)) / F.pow(F.lit(2.0), col(z))).cast("long"))


def visible(offset: C, client: C, scale: C, size: C) -> tuple[Column, Column]:
    """The part of a page's side that a viewport shows."""
    lo = F.greatest(F.lit(0).cast("long"), floor_long(-col(offset) / col(scale)))
    hi = F.least(col(size).cast("long"), F.ceil((col(client) - col(offset)) / col(scale)).cast("long"))
    return lo, hi


def distance(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def round_half_up(x: Column) -> Column:
    return floor_long(x + F.lit(0.5))


def device_edge(offset: C, place: C, scale: C) -> Column:
    return round_half_up(col(offset) + col(place) * col(scale))


def overview_side(side: C, other: C, most: C = 512.0) -> Column:
    """A side of the overview that statistics are taken from, its longer side ``most``."""
    return F.greatest(F.lit(1).cast("long"), round_half_up(col(side) * col(most).cast("double") / F.greatest(col(side), col(other))))


def reduced_centre(tile: C, place: C, shift: C, lo: C, hi: C) -> Column:
    """The source place that stands for a place of a tile decoded at 1 / 2^shift: the middle of what it covers, within [lo, hi)."""
    span = F.shiftleft(F.lit(1).cast("long"), shift) if isinstance(shift, int) else F.pow(F.lit(2.0), col(shift)).cast("long")
    middle = col(tile) + col(place) * span + F.floor(span / 2).cast("long")
    return F.least(col(hi) - 1, F.greatest(col(lo), middle))


def reduced_span(tile: C, shift: C, lo: C, hi: C) -> tuple[Column, Column]:
    """First place and the one after the last of a reduced tile that [lo, hi) touches; the end is rounded up."""
    span = F.pow(F.lit(2.0), col(shift)).cast("long")
    return floor_long((col(lo) - col(tile)) / span), floor_long((col(hi) - col(tile) + span - 1) / span)


def final_rows(bottom: C, lo: C, hi: C, out: C, mean: bool) -> Column:
    """Output rows that are final once the source rows above ``bottom`` are read: a mean's half-filled row is not, a sampled row is when its source is."""
    if mean:
        return F.when(col(bottom) >= col(hi), col(out).cast("long")).otherwise(box_cell(col(bottom) - col(lo), col(hi) - col(lo), out))
    rows = F.sequence(F.lit(0).cast("long"), col(out).cast("long") - 1)
    return F.size(F.filter(rows, lambda i: nearest_source(i, lo, hi, out) < col(bottom))).cast("long")


def fit_scale(page_w: C, page_h: C, client_w: C, client_h: C) -> Column:
    return F.least(col(client_w) / col(page_w), col(client_h) / col(page_h))


def zoom_bounds(fit: C, most: C = 64.0) -> tuple[Column, Column]:
    """Least and greatest scale of a view whose page fits at ``fit``."""
    return F.least(col(fit) * F.lit(0.5), F.lit(1.0)), F.greatest(col(most), col(fit) * F.lit(4.0))


def clamp_offset(offset: C, size: C, client: C) -> Column:
    """A view's offset along one side: a page smaller than the view stands in its middle, a larger one leaves no gap."""
    return F.when(col(size) <= col(client), (col(client) - col(size)) / F.lit(2.0)).otherwise(F.least(F.lit(0.0), F.greatest(col(client) - col(size), col(offset))))


def zoom_offset(offset: C, anchor: C, scale: C, after: C) -> Column:
    """The offset after a change of scale that leaves the anchor's place where it is."""
    return col(anchor) - (col(anchor) - col(offset)) * col(after) / col(scale)


def bitmap_clip(edge0: C, edge1: C, client: C, size: C) -> tuple[Column, Column]:
    """The part of a bitmap's side that shows where its device edges reach beyond the canvas."""
    span = F.nullif(col(edge1) - col(edge0), F.lit(0).cast("long"))
    first, last = F.greatest(F.lit(0).cast("long"), col(edge0)), F.least(col(client).cast("long"), col(edge1))
    return (first - col(edge0)) / span * col(size), (last - col(edge0)) / span * col(size)


def region_cost(lo_x: C, hi_x: C, lo_y: C, hi_y: C, fx: C, fy: C, tile_w: C, tile_h: C, out_w: C, out_h: C, bytes_per_pixel: C) -> Column:
    """Estimated bytes to read for a region: whole tiles of the level, at most one for each output cell."""
    across = F.ceil(col(hi_x) * col(fx) / col(tile_w)) - F.floor(col(lo_x) * col(fx) / col(tile_w))
    down = F.ceil(col(hi_y) * col(fy) / col(tile_h)) - F.floor(col(lo_y) * col(fy) / col(tile_h))
    return F.least(across, col(out_w)) * F.least(down, col(out_h)) * col(tile_w) * col(tile_h) * col(bytes_per_pixel)
