"""Image tiling arithmetic as expressions; pixels are someone else's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def grids(most: int, least: int = 1) -> list[tuple[int, int]]:
    """All (columns, rows) with so many tiles, the fewest tiles first."""
    found = {(c, r) for c in range(1, most + 1) for r in range(1, most + 1) if least <= c * r <= most}
    return sorted(found, key=lambda g: (g[0] * g[1], g))


def best_grid(width: Column, height: Column, most: int, size: int = 448) -> Column:
    """struct(cols, rows) whose aspect ratio is nearest.

    Of equally near grids, in order of tiles, a later one wins if the image
    covers more than half of its area.
    """
    options = F.array(*(F.struct(F.lit(c).alias("cols"), F.lit(r).alias("rows")) for c, r in grids(most)))
    ratio = width / height
    start = F.struct(F.lit(float("inf")).alias("far"), F.lit(1).alias("cols"), F.lit(1).alias("rows"))

    def step(best: Column, g: Column) -> Column:
        far = F.abs(ratio - g["cols"] / g["rows"])
        larger = width * height > F.lit(0.5 * size * size) * g["cols"] * g["rows"]
        new = F.struct(far.alias("far"), g["cols"].alias("cols"), g["rows"].alias("rows"))
        return F.when((far < best["far"]) | ((far == best["far"]) & larger), new).otherwise(best)

    return F.aggregate(options, start, step, lambda b: F.struct(b["cols"], b["rows"]))


def patch_count(grid: Column, thumbnail: bool = True) -> Column:
    """Tiles, and one for the thumbnail if there are several."""
    n = grid["cols"] * grid["rows"]
    return n + F.when(n > 1, 1).otherwise(0) if thumbnail else n


def tile_boxes(grid: Column, size: int = 448) -> Column:
    """array<struct(left, top, right, bottom)> in row order."""

    def box(i: Column) -> Column:
        left, top = i % grid["cols"] * size, F.floor(i / grid["cols"]).cast("int") * size
        return F.struct(left.alias("left"), top.alias("top"), (left + size).alias("right"), (top + size).alias("bottom"))

    return F.transform(F.sequence(F.lit(0), grid["cols"] * grid["rows"] - 1), box)


def platform_size(width: Column, height: Column, most: int = 576) -> Column:
    """struct(width, height): even, at most so high, aspect ratio kept, halves to even."""
    h = F.greatest(F.lit(2), F.least(height, F.lit(most)) - F.least(height, F.lit(most)) % 2)
    w = F.greatest(F.lit(2), F.rint(width * h / height / 2).cast("int") * 2)
    return F.struct(w.alias("width"), h.alias("height"))


def patch_total(counts: Column) -> Column:
    """Patches of all images of one prediction."""
    return F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, x: a + x)
