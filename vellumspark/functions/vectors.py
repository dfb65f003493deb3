"""Array columns as rows of matrices: every function stays within one row, so nothing
is shuffled. Arithmetic is in double precision unless a step says float."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of the error-function polynomial 7.1.26 of Abramowitz and Stegun (fixed values).
ERF_P, ERF_A = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row, however often it is used."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def argmax(v: Column) -> Column:
    """0-based; the lowest index wins ties, NaN never wins, 0 if nothing can."""
    real = F.filter(v, lambda x: x.isNotNull() & ~F.isnan(x))
    return F.when(F.size(real) > 0, F.array_position(v, F.array_max(real)) - 1).otherwise(0).cast("int")


def argmax_except(v: Column, banned: Column) -> Column:
    """argmax over the positions that ``banned`` (0-based) does not hold."""
    free = F.transform(v, lambda x, i: F.when(~F.array_contains(banned, i) & ~F.isnan(x), F.struct((-x).alias("s"), i.alias("i"))))
    return F.coalesce(F.array_min(F.filter(free, lambda s: s.isNotNull()))["i"], F.lit(0)).cast("int")


def margin(v: Column) -> Column:
    """Best less second best, subtracted as floats."""
    top = F.sort_array(v, False)
    return (top[0] - top[1]).cast("double")


def softmax(v: Column) -> Column:
    def over(e: Column) -> Column:
        return let(total(e), lambda s: F.transform(e, lambda x: x / s))

    return let(doubles(v), lambda d: let(F.array_max(d), lambda m: let(F.transform(d, lambda x: F.exp(x - m)), over)))


def rms_norm(v: Column, eps: float = 1e-6) -> Column:
    def scaled(d: Column) -> Column:
        return let(F.sqrt(total(F.transform(d, lambda y: y * y)) / F.size(d) + eps), lambda r: F.transform(d, lambda x: x / r))

    return let(doubles(v), scaled)


def layer_norm(v: Column, eps: float = 1e-6) -> Column:
    def scaled(c: Column) -> Column:
        return let(F.sqrt(total(F.transform(c, lambda y: y * y)) / F.size(c) + eps), lambda r: F.transform(c, lambda x: x / r))

    return let(doubles(v), lambda d: let(total(d) / F.size(d), lambda mean: let(F.transform(d, lambda y: y - mean), scaled)))


def top_k(scores: Column, k: int) -> Column:
    """array<struct<index, score>> of the k best, ties to the lower index. Fewer than k
    finite scores are an error."""

    def best(v: Column) -> Column:
        finite = F.size(F.filter(v, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))))
        ranked = F.slice(F.array_sort(F.transform(v, lambda x, i: F.struct((-x).alias("n"), i.alias("i")))), 1, k)
        checked = F.when(finite < k, F.raise_error(F.lit("fewer finite scores than asked for")).cast("array<struct<n:double,i:int>>")).otherwise(ranked)
        return F.transform(checked, lambda s: F.struct(s["i"].alias("index"), (-s["n"]).alias("score")))

    return let(doubles(scores), best)


def _float(x: Column) -> Column:
    return x.cast("float").cast("double")


def int8(v: Column) -> Column:
    """struct<q, scale>: absmax / 127 per row, half to even, at most 127 either way."""

    def packed(d: Column, scale: Column) -> Column:
        q = F.transform(d, lambda x: F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.rint(_float(x / scale)))).cast("tinyint"))
        return F.struct(q.alias("q"), scale.cast("float").alias("scale"))

    def scaled(d: Column) -> Column:
        most = F.array_max(F.transform(d, F.abs))
        return let(F.coalesce(F.nullif(_float(most / 127), F.lit(0.0)), F.lit(1.0)), lambda s: packed(d, s))

    return let(doubles(v), scaled)


def int8_values(q: Column) -> Column:
    return F.transform(q["q"], lambda x: x.cast("double") * q["scale"].cast("double"))


def int8_dot(a: Column, b: Column) -> Column:
    """Integer dot product of two int8 rows, then both scales."""

    def product(a: Column, b: Column) -> Column:
        whole = F.aggregate(F.zip_with(a["q"], b["q"], lambda x, y: x.cast("long") * y.cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
        return whole * a["scale"].cast("double") * b["scale"].cast("double")

    return let(a, lambda p: let(b, lambda q: product(p, q)))


def uint8(v: Column) -> Column:
    """struct<q, scale, zero>: the range widened to hold 0, over 255."""
    v = doubles(v)
    low, high = F.least(F.lit(0.0), F.array_min(v)), F.greatest(F.lit(0.0), F.array_max(v))
    scale = F.when(high == low, F.lit(1.0)).otherwise(_float((high - low) / 255))
    zero = F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.rint(_float(-low / scale))))
    q = F.transform(v, lambda x: F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.rint(_float(x / scale)) + zero)).cast("smallint"))
    return F.struct(q.alias("q"), scale.cast("float").alias("scale"), zero.cast("int").alias("zero"))


def uint8_values(q: Column) -> Column:
    return F.transform(q["q"], lambda x: (x - q["zero"]).cast("double") * q["scale"].cast("double"))


def int4(v: Column, group: int = 16) -> Column:
    """struct<q, scales>: groups of ``group`` columns, absmax / 7 each, half to even."""
    if group not in (16, 32):
        raise ValueError("groups have 16 or 32 columns")
    v = doubles(v)
    starts = F.sequence(F.lit(1), F.size(v), F.lit(group))
    scales = F.transform(starts, lambda s: F.coalesce(F.nullif(_float(F.array_max(F.transform(F.slice(v, s, group), F.abs)) / 7), F.lit(0.0)), F.lit(1.0)))
    q = F.transform(v, lambda x, i: F.greatest(F.lit(-7.0), F.least(F.lit(7.0), F.rint(_float(x / F.element_at(scales, (F.floor(i / group) + 1).cast("int")))))).cast("int"))
    return F.struct(q.alias("q"), scales.alias("scales"))


def nibbles(q: Column) -> Column:
    """Two signed columns a byte, the even one low: bytes as integers."""
    return F.transform(F.sequence(F.lit(1), F.size(q), F.lit(2)), lambda i: F.element_at(q, i).bitwiseAND(15).bitwiseOR(F.shiftleft(F.element_at(q, i + 1).bitwiseAND(15), 4)))


def from_nibbles(packed: Column) -> Column:
    sign = lambda n: n.bitwiseXOR(8) - 8
    return F.flatten(F.transform(packed, lambda b: F.array(sign(b.bitwiseAND(15)), sign(F.shiftrightunsigned(b, 4)))))


def erf(x: Column) -> Column:
    t = 1 / (1 + ERF_P * F.abs(x))
    series = F.lit(0.0)
    for a in reversed(ERF_A):
        series = (series + a) * t
    return F.signum(x) * (1 - series * F.exp(-x * x))


def silu(x: Column) -> Column:
    return x / (1 + F.exp(-x))


def gelu(x: Column) -> Column:
    return 0.5 * x * (1 + erf(x / 2**0.5))


def quick_gelu(x: Column) -> Column:
    return x / (1 + F.exp(-1.702 * x))


def cosine(a: Column, b: Column) -> Column:
    """1 if both are zero, 0 if one is."""
    x, y = dot(a, a), dot(b, b)
    return F.when((x == 0) & (y == 0), 1.0).when((x == 0) | (y == 0), 0.0).otherwise(dot(a, b) / (F.sqrt(x) * F.sqrt(y)))


def max_abs_diff(a: Column, b: Column) -> Column:
    """Infinite if a difference is not a number."""
    d = F.zip_with(doubles(a), doubles(b), lambda x, y: F.abs(x - y))
    return F.when(F.exists(d, F.isnan), float("inf")).otherwise(F.coalesce(F.array_max(d), F.lit(0.0)))


def rotate(v: Column, position: Column, theta: float = 10000.0) -> Column:
    """Rotary embedding of halves by absolute position."""
    v = doubles(v)
    half = (F.size(v) / 2).cast("int")

    def angle(i: Column) -> Column:
        return position * F.pow(F.lit(theta), -2.0 * (i % half) / F.size(v))

    def turned(x: Column, i: Column) -> Column:
        other = F.when(i < half, -F.element_at(v, i + half + 1)).otherwise(F.element_at(v, F.greatest(i - half + 1, F.lit(1))))
        return x * F.cos(angle(i)) + F.when(i < half, -F.element_at(v, F.least(i + half + 1, F.size(v)))).otherwise(other) * F.sin(angle(i))

    return F.transform(v, turned)
