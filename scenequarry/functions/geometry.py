"""Row-local geometry as column expressions; all run inside generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Zeroth spherical-harmonics constant, 1 / (2 * sqrt(pi)).
SH_C0 = 0.28209479177387814


def half_even(c: Column) -> Column:
    """Round to the nearest integer, halves to even."""
    return F.rint(c)


def norm(*parts: Column) -> Column:
    return F.sqrt(reduce(lambda a, b: a + b, [p * p for p in parts]))


def distance(a: tuple[str, str, str], b: tuple[str, str, str]) -> Column:
    return norm(*[F.col(p) - F.col(q) for p, q in zip(a, b, strict=True)])


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def rgb_to_dc(c: Column) -> Column:
    """Colour in [0, 1] to its zeroth harmonic coefficient."""
    return (c - 0.5) / SH_C0


def dc_to_rgb(c: Column) -> Column:
    """The inverse, clipped to [0, 1]."""
    return clip(c * SH_C0 + 0.5, 0.0, 1.0)


def conf_to_logit(c: Column) -> Column:
    """Confidence as a logit, clipped to [0.1, 0.99] first."""
    p = clip(c, 0.1, 0.99)
    return F.log(p / (1 - p))


def surfel_scales(depth: Column, focal: Column, footprint: float = 4.0) -> tuple[Column, Column]:
    """Log scale along the surface and along the normal."""
    along = F.greatest(depth * footprint / focal, F.lit(1e-6))
    return F.log(along), F.log(F.greatest(along * 0.3, F.lit(1e-6)))


def cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[(i + 1) % 3] * b[(i + 2) % 3] - a[(i + 2) % 3] * b[(i + 1) % 3] for i in range(3)]


def surfel_basis(du: list[Column], dv: list[Column]) -> tuple[list[Column], list[Column], list[Column]]:
    """Orthonormal (e1, e2, n) from the world derivatives along u and v, by Gram-Schmidt; each norm has 1e-9 added."""
    unit = lambda v: [x / (norm(*v) + 1e-9) for x in v]
    e1 = unit(du)
    along = reduce(lambda a, b: a + b, [x * y for x, y in zip(dv, e1, strict=True)])
    e2 = unit([x - along * y for x, y in zip(dv, e1, strict=True)])
    return e1, e2, unit(cross(e1, e2))


def matrix_to_quaternion(m: list[list[Column]]) -> list[Column]:
    """Unit quaternion (w, x, y, z) of a rotation matrix given by rows, from its largest component."""
    trace = m[0][0] + m[1][1] + m[2][2]
    big0 = (m[0][0] >= m[1][1]) & (m[0][0] >= m[2][2])
    big1 = m[1][1] >= m[2][2]
    # Four times the square of each component, plus what the other branch would divide by.
    s = F.when(trace > 0, trace + 1).when(big0, 1 + m[0][0] - m[1][1] - m[2][2]).when(big1, 1 + m[1][1] - m[0][0] - m[2][2]).otherwise(1 + m[2][2] - m[0][0] - m[1][1])
    s = F.sqrt(F.greatest(s, F.lit(1e-12))) * 2
    wx, wy, wz = (m[2][1] - m[1][2]) / s, (m[0][2] - m[2][0]) / s, (m[1][0] - m[0][1]) / s
    xy, xz, yz = (m[0][1] + m[1][0]) / s, (m[0][2] + m[2][0]) / s, (m[1][2] + m[2][1]) / s
    pick = lambda w, x, y, z: F.when(trace > 0, w).when(big0, x).when(big1, y).otherwise(z)
    q = [pick(s / 4, wx, wy, wz), pick(wx, s / 4, xy, xz), pick(wy, xy, s / 4, yz), pick(wz, xz, yz, s / 4)]
    return [c / (norm(*q) + 1e-9) for c in q]


def flip_point(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Between the stored frame (y down, z forward) and the viewer's (y up, z back)."""
    return x, -y, -z


def flip_box(lo: list[Column], hi: list[Column]) -> tuple[list[Column], list[Column]]:
    """A box between the two frames: low and high change places where the axis is negated."""
    return [lo[0], -hi[1], -hi[2]], [hi[0], -lo[1], -lo[2]]


def crop_box(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column, pad: float = 0.08) -> list[Column]:
    """Corners of a pixel box (left, top, wide, high) grown by ``pad`` of its size, truncated, inside the frame."""
    dx, dy, zero = (w * pad).cast("int"), (h * pad).cast("int"), F.lit(0)
    return [F.greatest(zero, x - dx), F.greatest(zero, y - dy), F.least(width, x + w + dx), F.least(height, y + h + dy)]


def proposal_rectangle(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> list[Column]:
    """A normalised box as a pixel rectangle (left, top, wide, high): halves to even, at least one pixel."""
    left, top = F.greatest(half_even(x * width), F.lit(0.0)), F.greatest(half_even(y * height), F.lit(0.0))
    wide = F.greatest(F.least(half_even(w * width), width - left), F.lit(1.0))
    high = F.greatest(F.least(half_even(h * height), height - top), F.lit(1.0))
    return [c.cast("int") for c in (left, top, wide, high)]


def box_center(x: Column, y: Column, w: Column, h: Column) -> list[Column]:
    """A box by its upper left corner as one by its centre."""
    return [x + w / 2, y + h / 2, w, h]


def corners_to_box(x0: Column, y0: Column, x1: Column, y1: Column) -> list[Column]:
    """Corners as (left, top, wide, high) in whole pixels, halves to even."""
    return [half_even(c).cast("int") for c in (x0, y0, x1 - x0, y1 - y0)]


def scaled_size(width: Column, height: Column, longest: int = 1920) -> tuple[Column, Column]:
    """Frame size with the long side at most ``longest``; the other side keeps the aspect and is even."""
    fits = F.greatest(width, height) <= longest
    even = lambda c: (half_even(c / 2) * 2).cast("int")
    return (
        F.when(fits, width).when(width >= height, F.lit(longest)).otherwise(even(width * longest / height)).cast("int"),
        F.when(fits, height).when(width >= height, even(height * longest / width)).otherwise(F.lit(longest)).cast("int"),
    )


def parse_rate(c: Column) -> Column:
    """``num/den`` as a number: 0 if den is 0; a plain number as it is; null if it's neither."""
    parts = F.split(c, "/")
    top, bottom = F.trim(F.get(parts, F.lit(0))).try_cast("double"), F.trim(F.get(parts, F.lit(1))).try_cast("double")
    return F.when(F.size(parts) == 1, top).when(bottom == 0, F.lit(0.0)).otherwise(F.try_divide(top, bottom))


#: Coefficients of the cubic colour map, by channel, constant first.
TURBO = {
    "r": (0.13572138, -152.94239396, 564.13539948, 53.97720359),
    "g": (4.61539260, 459.30493940, -198.21580373, -16.20987022),
    "b": (-42.66032258, -700.74832297, -23.96587314, 12.02644739),
}


def turbo(t: Column) -> dict[str, Column]:
    """Colour of t, clipped to [0, 1], by the polynomial map; each channel is clipped to [0, 1]."""
    t = clip(t, 0.0, 1.0)
    return {k: clip(reduce(lambda a, b: a * t + b, [F.lit(x) for x in reversed(p)]), 0.0, 1.0) for k, p in TURBO.items()}
