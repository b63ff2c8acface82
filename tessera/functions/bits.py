"""Integer decoding primitives as column expressions."""

from pyspark.sql import Column, functions as F


def wrap32(v: Column) -> Column:
    """A 64-bit sum as a wrapped 32-bit sample."""
    return (v + (1 << 31)).bitwiseAND(F.lit((1 << 32) - 1)) - (1 << 31)


def zigzag(u: Column) -> Column:
    """Unsigned to signed: 0, -1, 1, -2, ..."""
    return F.shiftright(u, 1).bitwiseXOR(-u.bitwiseAND(F.lit(1)))


def shift_left(v: Column, n: Column) -> Column:
    return F.call_function("shiftleft", v, n.cast("int"))


def hybrid_uint(token: Column, rest: Column, split_exponent: int, msb: int, lsb: int) -> Column:
    """Value of a token whose low `n` extra bits are in `rest`; small tokens are their value."""
    split = 1 << split_exponent
    n = (split_exponent - msb - lsb + F.shiftright(token - split, msb + lsb)).bitwiseAND(F.lit(31))
    low = token.bitwiseAND(F.lit((1 << lsb) - 1))
    high = F.shiftright(token, lsb).bitwiseAND(F.lit((1 << msb) - 1)).bitwiseOR(F.lit(1 << msb))
    extra = rest.bitwiseAND(shift_left(F.lit(1).cast("long"), n) - 1)
    value = F.shiftleft(shift_left(high, n).bitwiseOR(extra), lsb).bitwiseOR(low)
    return F.when(token < split, token).otherwise(value)


def half_float(bits: Column) -> Column:
    """IEEE half precision; infinities and NaN are errors: null."""
    sign = F.when(bits.bitwiseAND(F.lit(0x8000)) != 0, -1.0).otherwise(1.0)
    exponent, mantissa = F.shiftright(bits, 10).bitwiseAND(F.lit(31)), bits.bitwiseAND(F.lit(1023)).cast("double")
    normal = F.pow(F.lit(2.0), (exponent - 15).cast("double")) * (1 + mantissa / 1024)
    return F.when(exponent < 31, sign * F.when(exponent == 0, mantissa / (1 << 24)).otherwise(normal))


#: Width to height of each ratio code (fixed values of the format).
RATIOS = {1: (1, 1), 2: (12, 10), 3: (4, 3), 4: (3, 2), 5: (16, 9), 6: (5, 4), 7: (2, 1)}


def ratio_width(ratio: Column, height: Column) -> Column:
    out = F.lit(None).cast("long")
    for code, (a, b) in RATIOS.items():
        out = F.when(ratio == code, F.call_function("div", height * a, F.lit(b))).otherwise(out)
    return out


def lehmer(code: Column) -> Column:
    """The permutation of a Lehmer code: entry i takes the code[i]-th of the numbers left."""
    start = F.struct(F.sequence(F.lit(0).cast("long"), F.size(code).cast("long") - 1).alias("left"), F.array().cast("array<bigint>").alias("out"))

    def take(acc: Column, c: Column) -> Column:
        at = c.cast("int")
        left = F.concat(F.slice(acc["left"], 1, at), F.slice(acc["left"], at + 2, F.size(acc["left"])))
        return F.struct(left.alias("left"), F.concat(acc["out"], F.array(F.get(acc["left"], at))).alias("out"))

    return F.when(F.size(code) == 0, F.array().cast("array<bigint>")).otherwise(F.aggregate(code, start, take, lambda acc: acc["out"]))


def mirror(at: Column, size: Column) -> Column:
    """Coordinates beyond an edge reflected into the image."""
    return F.when(at < 0, -at - 1).when(at >= size, 2 * size - 1 - at).otherwise(at)


def orient(code: int, x: Column, y: Column, w: Column, h: Column) -> tuple[Column, Column]:
    """Source coordinate of output (x, y) for the eight orientations; w, h: the output's size."""
    right, down = w - 1 - x, h - 1 - y
    return {1: (x, y), 2: (right, y), 3: (right, down), 4: (x, down), 5: (y, x), 6: (y, right), 7: (down, right), 8: (down, x)}[code]
