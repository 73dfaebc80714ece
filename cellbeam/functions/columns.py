"""Row-wise functions as Column expressions: they stay in generated code and push down like any projection."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def real(x) -> Column:
    return (F.lit(x) if not isinstance(x, Column) else x).cast("double")


def r6(x: Column) -> Column:
    """Rounded for comparison between engines; adding 0 turns -0.0 into 0.0."""
    return F.round(x, 6) + F.lit(0.0)


def activation(x: Column, kind: str, beta: float = 1.0) -> Column:
    """relu, abs, softplus, id, none, sigmoid, leaky_relu or sin; anything else is an error."""
    kinds = {
        "relu": lambda: F.greatest(x, real(0)),
        "abs": lambda: F.abs(x),
        "softplus": lambda: F.when(x * beta > 20, x).otherwise(F.log1p(F.exp(F.least(x * beta, real(20)))) / beta),
        "id": lambda: x,
        "none": lambda: x,
        "sigmoid": lambda: 1 / (1 + F.exp(-x)),
        "leaky_relu": lambda: F.when(x < 0, x * 0.01).otherwise(x),
        "sin": lambda: F.sin(x * beta),
    }
    if kind not in kinds:
        raise ValueError(f"unknown activation {kind!r}")
    return kinds[kind]()


def activation_slope(x: Column, kind: str, beta: float = 1.0) -> Column:
    """Derivative of ``activation``; at a kink that of the right side, but 0 for relu and abs at 0."""
    kinds = {
        "relu": lambda: F.when(x > 0, real(1)).otherwise(0.0),
        "abs": lambda: F.signum(x),
        "softplus": lambda: F.when(x * beta > 20, real(1)).otherwise(1 / (1 + F.exp(-x * beta))),
        "id": lambda: real(1),
        "none": lambda: real(1),
        "sigmoid": lambda: 1 / (1 + F.exp(-x)) * (1 - 1 / (1 + F.exp(-x))),
        "leaky_relu": lambda: F.when(x < 0, real(0.01)).otherwise(1.0),
        "sin": lambda: F.cos(x * beta) * beta,
    }
    if kind not in kinds:
        raise ValueError(f"unknown activation {kind!r}")
    return kinds[kind]()


def xray_log(raw: Column, low: float, high: float, factor: float = 1.0, log_space: bool = False, base10: bool = False) -> Column:
    """Line integral from a transmission value, scaled so that ``low`` maps to ``factor``."""
    if log_space:
        return raw / real(high)
    log = F.log10 if base10 else F.log
    return -log(F.greatest(raw, real(1e-5)) / real(high)) * factor / -log(real(low) / real(high))


def xray_inverse(v: Column, low: float, high: float, log_space: bool = False) -> Column:
    return v * real(high) if log_space else F.exp(-F.log(real(high) / real(low)) * v)


def finite(v: Column) -> Column:
    """Fails the job on NaN or infinite values, else the value."""
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), F.raise_error(F.lit("value is not finite"))).otherwise(v)


def pixel_to_uv(p: Column, size, aligned: bool = True, check: bool = False) -> Column:
    """Place in [0, 1] of a pixel; with ``check`` a pixel outside the image fails the job."""
    if check:
        p = F.when((p < 0) | (p >= real(size)), F.raise_error(F.lit("pixel outside the image"))).otherwise(p)
    return p / (real(size) - 1) if aligned else (p + 0.5) / real(size)


def uv_to_pixel(uv: Column, size, aligned: bool = True) -> Column:
    return uv * (real(size) - 1) if aligned else uv * real(size) - 0.5


def rotate(q: tuple[Column, ...], v: tuple[Column, ...]) -> tuple[Column, Column, Column]:
    """v turned by the unit quaternion (x, y, z, w)."""
    qx, qy, qz, qw = q
    x, y, z = v
    tx, ty, tz = 2 * (qy * z - qz * y), 2 * (qz * x - qx * z), 2 * (qx * y - qy * x)
    return x + qw * tx + (qy * tz - qz * ty), y + qw * ty + (qz * tx - qx * tz), z + qw * tz + (qx * ty - qy * tx)


def normalise(v: tuple[Column, ...]) -> tuple[Column, ...]:
    n = F.sqrt(reduce(lambda a, b: a + b, [c * c for c in v]))
    return tuple(c / n for c in v)


def delinearize(i: Column, size: tuple[int, ...], last_fastest: bool = False) -> list[Column]:
    """Digits of a linear index; the first dimension runs fastest unless told otherwise."""
    order = list(range(len(size)))
    out: list = [None] * len(size)
    for k in reversed(order) if last_fastest else order:
        out[k] = F.pmod(i, F.lit(size[k]))
        i = F.floor(i / size[k]).cast("long")
    return out


def contains(box: str = "", point: tuple[str, ...] = AXES) -> Column:
    """Closed box x0..z1 against a point."""
    return reduce(lambda a, b: a & b, [F.col(p).between(F.col(f"{box}{a}0"), F.col(f"{box}{a}1")) for p, a in zip(point, AXES, strict=True)])


def in_roi(lo: tuple[float, ...], hi: tuple[float, ...], midpoint: str = "sum", widen_y: float = 0.0) -> Column:
    """A node touches the region: on every axis its lower side, upper side or middle lies strictly inside.

    ``midpoint='sum'`` takes lower + upper as the middle, as older data expect; 'half' takes the true middle.
    """
    tests = []
    for a, l, h in zip(AXES, lo, hi, strict=True):
        w = widen_y if a == "y" else 0.0
        c0, c1 = F.col(f"{a}0"), F.col(f"{a}1")
        mid = (c0 + c1) * (1.0 if midpoint == "sum" else 0.5)
        tests.append(reduce(lambda p, q: p | q, [(c > l - w) & (c < h + w) for c in (c0, c1, mid)]))
    return reduce(lambda p, q: p & q, tests)


def slab(lo: str = "0", hi: str = "1") -> tuple[Column, Column, Column]:
    """Entry, exit and hit of the ray (ox..dz) in the box (x0..z1).

    A zero direction misses unless its origin lies in the half-open side; a box behind the ray is a miss.
    """
    near, far, ok = [], [], F.lit(True)
    for a in AXES:
        o, d, b0, b1 = (F.col(c) for c in (f"o{a}", f"d{a}", f"{a}{lo}", f"{a}{hi}"))
        t0, t1 = (b0 - o) / F.when(d != 0, d), (b1 - o) / F.when(d != 0, d)
        near.append(F.coalesce(F.least(t0, t1), real(-1e30)))
        far.append(F.coalesce(F.greatest(t0, t1), real(1e30)))
        ok = ok & ((d != 0) | ((o >= b0) & (o < b1)))
    tmin, tmax = F.greatest(*near), F.least(*far)
    return tmin, tmax, ok & (tmin <= tmax) & (tmax >= 0)


def tone_exposure(v: Column, shift: Column | None = None, factor: Column | None = None) -> Column:
    return v + shift if shift is not None else v * factor


def hash_corner(coords: tuple[Column, ...], primes: tuple[int, ...], size: int) -> Column:
    """XOR of coordinate times prime in 32 bits, modulo the table size."""
    parts = [(c.cast("long") * F.lit(p)).bitwiseAND(F.lit(4294967295)) for c, p in zip(coords, primes, strict=True)]
    return F.pmod(reduce(lambda a, b: a.bitwiseXOR(b), parts), F.lit(size))


def loss_weight(p: Column, kind: str) -> Column:
    """'none', 'inverse' (1 / (p + 1e-3)^2) or 'square' ((p + 1e-3)^2)."""
    s = (p + 1e-3) * (p + 1e-3)
    return {"none": real(1), "inverse": 1 / s, "square": s}[kind]


def keyed_uniform(seed: int, *keys: Column | int | str) -> Column:
    """A number in [0, 1) that depends on the seed and the keys only, so it is the same in any partitioning and retry.

    The first 52 bits of the MD5 of ``seed|key|..``, as any engine can give them.
    """
    text = F.concat_ws("|", F.lit(str(seed)), *[(k if isinstance(k, Column) else F.lit(k)).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def keyed_normal(seed: int, *keys: Column | int | str) -> Column:
    """A standard normal number by key, from two uniform ones."""
    return F.sqrt(-2.0 * F.log(1.0 - keyed_uniform(seed, *keys, "r"))) * F.cos(keyed_uniform(seed, *keys, "a") * (2.0 * math.pi))
