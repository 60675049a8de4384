"""Expressions over vectors, quaternions and texture sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratasift.rules.exports import AXES

#: Bytes of a 4x4 block, or bits of a pixel.
BLOCK_BYTES = {"DXT1": 8, "BC1": 8, "BC4": 8, "DXT3": 16, "DXT5": 16, "BC2": 16, "BC3": 16, "BC5": 16, "BC6H": 16, "BC7": 16}
PIXEL_BYTES = {"BGRA": 4, "RGBA": 4, "RGB24": 3, "RGB565": 2, "R8": 1, "A8": 1, "RHALF": 2, "RGBAHALF": 8, "RGBAFLOAT": 16}


def mip_size(kind: Column, width: Column, height: Column) -> Column:
    """Bytes of a mip level; 0 for an unknown format."""
    blocks = F.greatest(F.lit(1), F.ceil(width / 4)) * F.greatest(F.lit(1), F.ceil(height / 4))
    per_block = F.create_map(*[F.lit(x) for kv in BLOCK_BYTES.items() for x in kv])[kind]
    per_pixel = F.create_map(*[F.lit(x) for kv in PIXEL_BYTES.items() for x in kv])[kind]
    return F.coalesce(blocks * per_block, width * height * per_pixel, F.lit(0)).cast("long")


def quaternion_product(a: Column, b: Column) -> Column:
    """Product of two (x, y, z, w) arrays."""
    ax, ay, az, aw = (a[i] for i in range(4))
    bx, by, bz, bw = (b[i] for i in range(4))
    return F.array(aw * bx + ax * bw + ay * bz - az * by, aw * by - ax * bz + ay * bw + az * bx, aw * bz + ax * by - ay * bx + az * bw, aw * bw - ax * bx - ay * by - az * bz)


def mirrored_z(vector: Column) -> Column:
    """A point or normal from a left-handed system to a right-handed one."""
    return F.array(vector[0], vector[1], -vector[2])


def mirrored_quaternion(q: Column) -> Column:
    return F.array(-q[0], -q[1], q[2], q[3])


def y_up_from_z_up(vector: Column, scale: float = 1.0) -> Column:
    return F.array(vector[0] * scale, vector[2] * scale, -vector[1] * scale)


def normalised(weights: Column) -> Column:
    """Weights over their sum; unchanged where the sum is 0."""
    total = F.aggregate(weights, F.lit(0.0), lambda s, w: s + F.coalesce(w.cast("double"), F.lit(0.0)))
    return F.transform(weights, lambda w: w.cast("double") / F.when(total == 0, F.lit(1.0)).otherwise(total))


def normalise_vertex(vector: Column, up: str, hand: str, scale: float = 1.0) -> Column:
    """A Y-up, right-handed point in another system of axes, or back: the swaps are their own inverses but for the sign."""
    return F.array(*[vector[axis] * (sign * scale) for axis, sign in AXES[up, hand]])


def mirrored(up: str, hand: str) -> bool:
    """Whether a change to that system turns triangles over, by the signs of its axes."""
    sign = 1
    for _, s in AXES[up, hand]:
        sign *= s
    return sign < 0


def winding(place: Column, up: str, hand: str) -> Column:
    """Where the index at a place of a triangle list goes: the second and third of a triangle change places in a mirrored system."""
    turned = F.when(place % 3 == 1, place + 1).when(place % 3 == 2, place - 1).otherwise(place)
    return turned if mirrored(up, hand) else place
