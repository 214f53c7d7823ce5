"""Arithmetic on times in milliseconds and on rectangles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def frames(ms, fps: int = 30, up: bool = False) -> Column:
    """Milliseconds in frames, to the nearest (or the next) whole frame."""
    x = ms * fps / 1000.0
    return (F.ceil(x) if up else F.floor(x + 0.5)).cast("long")


def trim_window(first_start, last_end, duration, before: int = 60, after: int = 90) -> Column:
    """struct(start_ms, end_ms): speech with a margin, the whole if that is empty."""
    start, end = F.greatest(F.lit(0), first_start - before), F.least(duration, last_end + after)
    ok = first_start.isNotNull() & (end > start)
    return F.struct(F.when(ok, start).otherwise(F.lit(0)).cast("long").alias("start_ms"), F.when(ok, end).otherwise(duration).cast("long").alias("end_ms"))


def overlap_ms(a_start, a_end, b_start, b_end) -> Column:
    """Length of the common part of two half-open intervals."""
    return F.greatest(F.lit(0), F.least(a_end, b_end) - F.greatest(a_start, b_start))


def box_distance(a: Column, b: Column) -> Column:
    """Distance of two rectangles struct(x, y, w, h); 0 if they touch."""
    dx = F.greatest(F.lit(0.0), a["x"] - (b["x"] + b["w"]), b["x"] - (a["x"] + a["w"]))
    dy = F.greatest(F.lit(0.0), a["y"] - (b["y"] + b["h"]), b["y"] - (a["y"] + a["h"]))
    return F.hypot(dx, dy)


def box_area(a: Column) -> Column:
    return a["w"] * a["h"]


def ticks_to_ms(ticks) -> Column:
    """100-nanosecond ticks in milliseconds, halves up."""
    return F.floor(ticks / 10_000.0 + 0.5).cast("long")


def font_fit(letters, width: int, most: int) -> Column:
    """The largest size up to ``most`` at which ``letters`` fit into ``width``."""
    return F.least(F.lit(most), F.floor(F.lit(width) / F.greatest(letters, F.lit(1)))).cast("int")


def flip_scaled(box: Column, from_width: float, from_height: float, to_width: float, to_height: float) -> Column:
    """A rectangle of an image, y from the top, on a page, y from the bottom,
    with three decimals."""
    kx, ky = to_width / from_width, to_height / from_height
    three = lambda x: F.floor(x * 1000 + 0.5) / 1000
    return F.struct(three(box["x"] * kx).alias("x"), three(to_height - (box["y"] + box["h"]) * ky).alias("y"), three(box["w"] * kx).alias("w"), three(box["h"] * ky).alias("h"))


def matrix_product(left: tuple, right: tuple) -> tuple:
    """Two affine maps (a, b, c, d, e, f) as one, the right one first."""
    a, b, c, d, e, f = left
    return (a * right[0] + c * right[1], b * right[0] + d * right[1], a * right[2] + c * right[3], b * right[2] + d * right[3], a * right[4] + c * right[5] + e, b * right[4] + d * right[5] + f)


def transform_bounds(matrix: tuple, box: Column) -> Column:
    """The rectangle around a rectangle's corners under an affine map."""
    a, b, c, d, e, f = matrix
    corners = [(box["x"] + dx, box["y"] + dy) for dx in (F.lit(0.0), box["w"]) for dy in (F.lit(0.0), box["h"])]
    xs, ys = [a * x + c * y + e for x, y in corners], [b * x + d * y + f for x, y in corners]
    x, y = F.least(*xs), F.least(*ys)
    return F.struct(x.alias("x"), y.alias("y"), (F.greatest(*xs) - x).alias("w"), (F.greatest(*ys) - y).alias("h"))


def is_visual(box: Column, page_width: float, page_height: float, least: float = 400, most: float = 0.8) -> Column:
    """A rectangle with an area of ``least`` or more that isn't most of the page."""
    return (box["w"] > 0) & (box["h"] > 0) & (box_area(box) >= least) & (box_area(box) < most * page_width * page_height)


def beat_frames(frames: Column, fps: int, count: Column) -> Column:
    """Frames of ``count`` beats between a begin (a third of a second in) and
    an end (four fifths before the last), nearer in short scenes."""
    n = F.greatest(count, frames)
    part = F.floor(n / (count + 1))
    first = F.least(F.lit(round(fps * 0.35 + 1e-9)), part)
    last = F.greatest(first, n - F.least(F.lit(int(fps * 0.8 + 0.5)), part))
    each = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.floor(first + (last - first) * i / F.greatest(count - 1, F.lit(1)) + 0.5).cast("long"))
    return F.when(count == 1, F.array(first.cast("long"))).otherwise(each)


def fade(frame: Column, frames: Column, enter: int = 8, leave: int = 6, far: int = 24) -> Column:
    """struct(opacity, shift) of a caption that comes in and goes out."""
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    inside = unit(frame / enter)
    return F.struct(F.least(inside, unit((frames - frame - 1) / leave)).alias("opacity"), (far * (1 - inside)).alias("shift"))
