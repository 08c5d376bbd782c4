"""Scalar transforms as column expressions: percent changes, quantizers, the lattice, escapes, sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-9
MU = 255.0
#: A pixel holds residuals of -INLINE to INLINE as r + CENTER; ESCAPE says that the exact value is beside it.
INLINE, CENTER, ESCAPE = 126, 128, 255
#: Bit depths of the uniform quantizer.
BITS = (2, 3, 4, 5, 6, 7, 8, 16)


def finite(x: Column) -> Column:
    """True for a number; null, NaN and infinities are missing."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def finite_or_null(x: Column) -> Column:
    return F.when(finite(x), x)


def pct_change_base(cur: Column, prev: Column, eps: float = EPS) -> Column:
    return (cur - prev) / (prev + eps) * 100.0


def pct_change_safe(cur: Column, prev: Column, eps: float = EPS) -> Column:
    return (cur - prev) / F.greatest(F.abs(prev), F.lit(eps)) * 100.0


def log_ratio(cur: Column, prev: Column, eps: float = EPS) -> Column:
    """Hundred times the log ratio of magnitudes, signed by the product of signs (0 counts as 1)."""
    sign = F.signum(cur) * F.signum(prev)
    size = F.log(F.greatest(F.abs(cur), F.lit(eps)) / F.greatest(F.abs(prev), F.lit(eps))) * 100.0
    return F.when(sign == 0, F.lit(1.0)).otherwise(sign) * size


def clip(x: Column, bound: Column | float) -> Column:
    bound = F.lit(bound) if isinstance(bound, (int, float)) else bound
    return F.least(F.greatest(x, -bound), bound)


def mu_law(x: Column, mu: float = MU) -> Column:
    return F.signum(x) * F.log1p(F.lit(mu) * F.abs(x)) / F.log1p(F.lit(mu))


def mu_law_inv(y: Column, mu: float = MU) -> Column:
    return F.signum(y) * (F.pow(F.lit(1.0 + mu), F.abs(y)) - 1.0) / mu


def asinh_scale(x: Column, s: Column) -> Column:
    return F.asinh(x / s)


def asinh_scale_inv(y: Column, s: Column) -> Column:
    return s * F.sinh(y)


def steps_of(bits: int) -> int:
    if bits not in BITS:
        raise ValueError(f"bits must be one of {BITS}, not {bits}")
    return (1 << bits) - 1


def quantize_uniform(pct: Column, clamp: Column | float, steps: Column | int) -> Column:
    clamp = F.lit(clamp) if isinstance(clamp, (int, float)) else clamp
    return F.rint((clip(pct, clamp) + clamp) / (clamp * 2.0) * steps).cast("int")


def dequantize_uniform(q: Column, clamp: Column | float, steps: Column | int) -> Column:
    clamp = F.lit(clamp) if isinstance(clamp, (int, float)) else clamp
    return q / steps * (clamp * 2.0) - clamp


def quantize_mu_law(pct: Column, clamp: Column, steps: int, mu: float = MU) -> Column:
    return F.rint((mu_law(clip(pct, clamp) / clamp, mu) + 1.0) / 2.0 * steps).cast("int")


def dequantize_mu_law(q: Column, clamp: Column, steps: int, mu: float = MU) -> Column:
    return mu_law_inv(q / steps * 2.0 - 1.0, mu) * clamp


def lattice_quantize(y: Column, q: Column) -> Column:
    """Nearest lattice point, ties to even.  Beyond 2**53 rounding isn't exact and the row fails."""
    m = F.rint(y / q)
    return F.when(F.abs(m) >= float(1 << 53), F.raise_error(F.lit("lattice coordinate beyond 2**53: eps is too small"))).otherwise(m).cast("long")


def lattice_value(m: Column, q: Column) -> Column:
    return m * q


def pixel(r: Column) -> Column:
    return F.when(F.abs(r) <= INLINE, r + CENTER).otherwise(ESCAPE).cast("short")


def escaped(r: Column) -> Column:
    """The exact residual where the pixel can't hold it."""
    return F.when(F.abs(r) > INLINE, r)


def residual(pixel_: Column, esc: Column) -> Column:
    return F.coalesce(esc, pixel_.cast("long") - CENTER)


def round_to_int(x: Column) -> Column:
    return F.rint(x).cast("long")


def zigzag_varint_len(v: Column) -> Column:
    """Bytes of a number in zigzag form, seven bits to a byte."""
    v = v.cast("long")
    zigzag = F.shiftleft(v, 1).bitwiseXOR(F.shiftright(v, 63))
    return F.greatest(F.ceil(F.length(F.bin(zigzag)) / F.lit(7.0)), F.lit(1)).cast("int")


def intensity(x: Column, low: Column, high: Column) -> Column:
    """Place between low and high, 0..1; a flat grid is 0."""
    return F.when(high > low, (x - low) / (high - low)).otherwise(0.0)


def heat(pct: Column, clamp: Column | float) -> Column:
    """Magnitude of a change as 0..255."""
    clamp = F.lit(clamp) if isinstance(clamp, (int, float)) else clamp
    return F.least(F.rint(F.abs(pct) / clamp * 255.0), F.lit(255.0)).cast("int")
