"""Column expressions of plane geometry and boxes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def distance(x0, y0, x1, y1) -> Column:
    """Euclidean distance."""
    return F.sqrt((col(x0) - col(x1)) * (col(x0) - col(x1)) + (col(y0) - col(y1)) * (col(y0) - col(y1)))


def clamp(v, low, high) -> Column:
    """Null stays null."""
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
    return F.when(col(v).isNotNull(), F.least(F.greatest(col(v), low), high))


def project(x, y, h: Sequence[float] | Column) -> tuple[Column, Column]:
    """PRJ1: a point through a 3x3 homography, row by row in ``h``; null where the divisor is 0."""
    x, y = col(x), col(y)
    m = [h[i] if isinstance(h, Column) else F.lit(float(h[i])) for i in range(9)]
    w = F.nullif(m[6] * x + m[7] * y + m[8], F.lit(0.0))
    return (m[0] * x + m[1] * y + m[2]) / w, (m[3] * x + m[4] * y + m[5]) / w


def box_distance(px, py, x0, y0, x1, y1) -> Column:
    """PRJ4: from a point to a rectangle, 0 inside."""
    px, py, zero = col(px), col(py), F.lit(0.0)
    dx, dy = F.greatest(col(x0) - px, zero, px - col(x1)), F.greatest(col(y0) - py, zero, py - col(y1))
    return F.sqrt(dx * dx + dy * dy)


def in_head_zone(px, py, x, y, w, h, part_h: float = 0.18, part_w: float = 0.60) -> Column:
    """PRJ5: within the top of a box and the middle of its width."""
    px, py = col(px), col(py)
    margin = col(w) * ((1 - part_w) / 2)
    return px.between(col(x) + margin, col(x) + col(w) - margin) & py.between(col(y), col(y) + col(h) * part_h)


def iou(a: Sequence, b: Sequence) -> Column:
    """Overlap of two boxes (x, y, w, h) over their union, 0 where they don't meet."""
    ax, ay, aw, ah = map(col, a)
    bx, by, bw, bh = map(col, b)
    zero = F.lit(0.0)
    iw = F.greatest(zero, F.least(ax + aw, bx + bw) - F.greatest(ax, bx))
    ih = F.greatest(zero, F.least(ay + ah, by + bh) - F.greatest(ay, by))
    union = aw * ah + bw * bh - iw * ih
    return F.when(union > 0, iw * ih / union).otherwise(zero)


def to_corners(x, y, w, h) -> list[Column]:
    """PRJ14: top-left and size to two corners."""
    return [col(x), col(y), col(x) + col(w), col(y) + col(h)]


def to_centre(x, y, w, h, width: float = 1.0, height: float = 1.0) -> list[Column]:
    """PRJ14: top-left and size to centre and size, in parts of the image where its size is given."""
    return [(col(x) + col(w) / 2) / width, (col(y) + col(h) / 2) / height, col(w) / width, col(h) / height]


def from_centre(cx, cy, w, h, width: float = 1.0, height: float = 1.0) -> list[Column]:
    return [(col(cx) - col(w) / 2) * width, (col(cy) - col(h) / 2) * height, col(w) * width, col(h) * height]


def sub_box(x, y, w, h, left: float, right: float, top: float, bottom: float) -> list[Column]:
    """PRJ21: a part of a box, such as the torso (0.25, 0.75, 0.20, 0.55)."""
    return [col(x) + col(w) * left, col(y) + col(h) * top, col(w) * (right - left), col(h) * (bottom - top)]


def square_crop(x, y, w, h, scale: float, width: int, height: int) -> list[Column]:
    """PRJ21: corners of a square about a box, kept inside the image."""
    side = F.greatest(col(w), col(h)) * scale / 2
    cx, cy = col(x) + col(w) / 2, col(y) + col(h) / 2
    return [F.greatest(F.lit(0.0), F.bround(cx - side)), F.greatest(F.lit(0.0), F.bround(cy - side)), F.least(F.lit(float(width)), F.bround(cx + side)), F.least(F.lit(float(height)), F.bround(cy + side))]


def clamp_centre(c, crop: float, size: float) -> Column:
    """PRJ19: keep a crop of a given extent inside the picture."""
    return clamp(c, crop / 2, size - crop / 2)


def band(v, bounds: Sequence[float], names: Sequence[str]) -> Column:
    """The first name whose bound is above ``v``; the last for all beyond."""
    out = F.lit(names[-1])
    for b, n in reversed(list(zip(bounds, names))):
        out = F.when(col(v) < b, n).otherwise(out)
    return out


def bin_of(v, low: float, high: float, n: int) -> Column:
    """Equal bins from 0; the last one is closed, and values outside have none."""
    v = col(v)
    return F.when((v >= low) & (v <= high), F.least(F.floor((v - low) * n / (high - low)), F.lit(n - 1)).cast("bigint"))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a, b) -> Column:
    """Null if either vector is zero."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def squared_distance(a, b) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
