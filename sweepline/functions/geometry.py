"""Column expressions for geometry, colour and number formats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def fan(angle_deg: Column, range_m: Column) -> tuple[Column, Column, Column]:
    """A polar return in the plane of its fan."""
    a = F.radians(angle_deg)
    return -range_m * F.sin(a), range_m * F.cos(a), F.lit(0.0)


def fan_angle(x: Column, y: Column) -> Column:
    """The angle of a point of the fan, in [0, 360)."""
    degrees = F.degrees(F.atan2(-x, y))
    return F.when(degrees < 0, degrees + 360).otherwise(degrees)


def transformed(m: Sequence, x: Column, y: Column, z: Column) -> list[Column]:
    """A point under a row-major 4 x 4 rigid matrix (numbers or columns)."""
    return [m[4 * i] * x + m[4 * i + 1] * y + m[4 * i + 2] * z + m[4 * i + 3] for i in range(3)]


def composed(a: Sequence, b: Sequence) -> list:
    """The matrix of b followed by a."""
    return [sum((a[4 * i + k] * b[4 * k + j] for k in range(1, 4)), a[4 * i] * b[j]) for i in range(4) for j in range(4)]


def inverse(m: Sequence) -> list:
    """The inverse of a rigid matrix: transposed rotation, and the shift turned back."""
    turned = [m[4 * j + i] for i in range(3) for j in range(3)]
    shift = [-(turned[3 * i] * m[3] + turned[3 * i + 1] * m[7] + turned[3 * i + 2] * m[11]) for i in range(3)]
    rows = [[*turned[3 * i : 3 * i + 3], shift[i]] for i in range(3)]
    return [*rows[0], *rows[1], *rows[2], 0.0, 0.0, 0.0, 1.0]


Quaternion = tuple[Column, Column, Column, Column]


def multiplied(a: Quaternion, b: Quaternion) -> Quaternion:
    """Hamilton product, (x, y, z, w)."""
    ax, ay, az, aw = a
    bx, by, bz, bw = b
    return (
        aw * bx + ax * bw + ay * bz - az * by,
        aw * by - ax * bz + ay * bw + az * bx,
        aw * bz + ax * by - ay * bx + az * bw,
        aw * bw - ax * bx - ay * by - az * bz,
    )


def conjugate(q: Quaternion) -> Quaternion:
    return -q[0], -q[1], -q[2], q[3]


def normalised(q: Quaternion) -> Quaternion:
    n = F.sqrt(sum((c * c for c in q[1:]), q[0] * q[0]))
    return tuple(c / n for c in q)  # type: ignore[return-value]


def rotated(q: Quaternion, x: Column, y: Column, z: Column) -> tuple[Column, ...]:
    """A vector turned by a unit quaternion."""
    return multiplied(multiplied(q, (x, y, z, F.lit(0.0))), conjugate(q))[:3]


def let(value: Column, body) -> Column:
    """body(value), value being computed once. Without it, an expression used often is written out, and computed, often."""
    return F.transform(F.array(value), body)[0]


def slerp(a: Quaternion, b: Quaternion, u: Column, linear_above: float = 0.9995) -> Quaternion:
    """The short arc from a to b; close to each other, a normalised line."""
    names = [f"{s}{c}" for s in "ab" for c in "xyzw"]
    ends = F.struct(*[v.alias(n) for n, v in zip(names, (*a, *b), strict=True)], u.alias("u"))

    def weights(e: Column) -> Column:
        return let(e["ax"] * e["bx"] + e["ay"] * e["by"] + e["az"] * e["bz"] + e["aw"] * e["bw"], lambda dot: let(F.least(F.abs(dot), F.lit(1.0)), lambda c: let(F.acos(c), lambda angle: F.struct(
            F.when(c > linear_above, 1 - e["u"]).otherwise(F.sin((1 - e["u"]) * angle) / F.nullif(F.sin(angle), F.lit(0.0))).alias("p"),
            (F.when(c > linear_above, e["u"]).otherwise(F.sin(e["u"] * angle) / F.nullif(F.sin(angle), F.lit(0.0))) * F.when(dot < 0, -1.0).otherwise(1.0)).alias("q"),
        ))))

    def mixed(e: Column) -> Column:
        return let(weights(e), lambda w: F.struct(*[(w["p"] * e[f"a{c}"] + w["q"] * e[f"b{c}"]).alias(c) for c in "xyzw"]))

    def unit(m: Column) -> Column:
        return let(F.sqrt(m["x"] * m["x"] + m["y"] * m["y"] + m["z"] * m["z"] + m["w"] * m["w"]), lambda n: F.struct(*[(m[c] / n).alias(c) for c in "xyzw"]))

    arc = let(ends, lambda e: let(mixed(e), unit))
    return tuple(arc[c] for c in "xyzw")  # type: ignore[return-value]


def turn_degrees(a: Quaternion, b: Quaternion) -> Column:
    """The angle between two attitudes; exact for small ones."""
    x, y, z, w = multiplied(conjugate(a), b)
    return F.degrees(2 * F.atan2(F.sqrt(x * x + y * y + z * z), F.abs(w)))


def luma(r: Column, g: Column, b: Column) -> Column:
    """Grey of 8-bit colours, as an integer."""
    return F.floor((299 * r + 587 * g + 114 * b + 500) / 1000).cast("int")


def widened(v8: Column) -> Column:
    """An 8-bit value spread over 16 bits."""
    return v8 * 257


def scalar_of(v: Column, low: float, high: float, gamma: float = 1.0, invert: bool = False) -> Column:
    """A display scalar in [0, 1]: clamped, then inverted, then gamma."""
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (v - low) / (high - low)))
    return F.pow(1 - t if invert else t, F.lit(gamma))


def in_band(v: Column, low: float, high: float) -> Column:
    """Inclusive at both ends; false for a null or NaN."""
    return F.coalesce(v.between(low, high) & ~F.isnan(v), F.lit(False))


def region_mask(x: Column, y: Column, include: Sequence[tuple], exclude: Sequence[tuple]) -> Column:
    """Rectangles (min_x, min_y, max_x, max_y): excludes win; if there are includes, one must hold the point."""
    inside = lambda r: x.between(r[0], r[2]) & y.between(r[1], r[3])
    kept = F.lit(True)
    for r in exclude:
        kept = kept & ~inside(r)
    if include:
        some = F.lit(False)
        for r in include:
            some = some | inside(r)
        kept = kept & some
    return kept


def projected(axis: str, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """(horizontal, horizontal, height) for the axis that points up."""
    return {"z": (x, y, z), "y": (z, x, y), "x": (y, z, x)}[axis]


def quantised(v: Column, offset: Column, scale: float) -> Column:
    """An integer coordinate of a point file, rounded half away from zero."""
    return F.round((v - offset) / scale).cast("long")


def bits(word: Column, low: int, n: int) -> Column:
    return F.shiftright(word, low).bitwiseAND(F.lit((1 << n) - 1))


def sanitised(text: Column, most: int = 200) -> Column:
    """Printable ASCII without quotes and backslashes, white space as one space, cut to a length."""
    plain = F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r'[^ -~]|["\\]', "")
    return F.substring(F.trim(plain), 1, most)
