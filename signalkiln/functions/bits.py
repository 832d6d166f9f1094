"""Integers and bit fields of binary columns, as plain column expressions (no UDF).

Offsets count from 0. A read beyond the end of the bytes gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WIDE = "decimal(20,0)"


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def let(value: Column, body) -> Column:
    """Bind ``value`` once inside ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def reverse_bytes(b: Column, size: int) -> Column:
    """The first ``size`` bytes in reverse order (the built-in reverse works on characters)."""
    return F.concat(*(F.substring(b, k, 1) for k in range(size, 0, -1)))


def uint(b: Column, offset, size: int, little: bool = False) -> Column:
    """Unsigned integer of ``size`` bytes; 8 bytes give decimal(20,0), fewer a bigint."""
    start = _col(offset)
    part = F.substring(b, (start + 1).cast("int"), F.lit(size))
    text = F.hex(reverse_bytes(part, size) if little else part)
    return F.when(F.octet_length(b) >= start + size, F.conv(text, 16, 10).cast(_WIDE if size > 7 else "bigint"))


def sint(b: Column, offset, size: int, little: bool = False) -> Column:
    """Two's-complement integer of up to 7 bytes."""
    v = uint(b, offset, size, little)
    return F.when(v >= 1 << (8 * size - 1), v - (1 << 8 * size)).otherwise(v)


def u8(b: Column, offset) -> Column:
    return uint(b, offset, 1)


def u16(b: Column, offset, little: bool = False) -> Column:
    return uint(b, offset, 2, little)


def u32(b: Column, offset, little: bool = False) -> Column:
    return uint(b, offset, 4, little)


def int_bytes(value: Column, size: int, little: bool = False) -> Column:
    """The low ``size`` bytes of a bigint, either endianness."""
    out = F.unhex(F.right(F.concat(F.lit("0" * 2 * size), F.hex(value.cast("bigint"))), F.lit(2 * size)))
    return reverse_bytes(out, size) if little else out


def join_bytes(parts: Column) -> Column:
    """array<binary> as one value; through text, so that each byte is copied a few times and not once a part."""
    return F.unhex(F.array_join(F.transform(parts, lambda b: F.hex(b)), ""))


def bits_msb(b: Column, bit_offset: int, count: int) -> Column:
    """``count`` bits (up to 48) from ``bit_offset``, most significant first."""
    first, last = bit_offset // 8, (bit_offset + count - 1) // 8
    n = last - first + 1
    return F.shiftright(uint(b, first, n), n * 8 - bit_offset % 8 - count).bitwiseAND(F.lit((1 << count) - 1))


def bits_lsb(b: Column, bit_offset: int, count: int) -> Column:
    """``count`` bits (up to 48) where bit 0 of the stream is the lowest bit of the first byte."""
    first, last = bit_offset // 8, (bit_offset + count - 1) // 8
    return F.shiftright(uint(b, first, last - first + 1, little=True), bit_offset % 8).bitwiseAND(F.lit((1 << count) - 1))


def write_bits_msb(b: Column, bit_offset: int, count: int, value: Column) -> Column:
    """``b`` with the bits replaced, most significant first."""
    first, last = bit_offset // 8, (bit_offset + count - 1) // 8
    n = last - first + 1
    shift = n * 8 - bit_offset % 8 - count
    mask = ((1 << count) - 1) << shift
    kept = uint(b, first, n).bitwiseAND(F.lit(((1 << 8 * n) - 1) ^ mask))
    new = kept.bitwiseOR(F.shiftleft(value.cast("bigint"), shift).bitwiseAND(F.lit(mask)))
    return F.overlay(b, int_bytes(new, n), F.lit(first + 1), F.lit(n))


def octets(b: Column) -> Column:
    """array<int> of the bytes."""
    return F.when(F.octet_length(b) > 0, F.transform(F.sequence(F.lit(1), F.octet_length(b)), lambda i: F.conv(F.hex(F.substring(b, i, F.lit(1))), 16, 10).cast("int"))).otherwise(F.array().cast("array<int>"))


def reverse_bits8(v: Column) -> Column:
    return F.conv(F.reverse(F.lpad(F.bin(v.cast("bigint")), 8, "0")), 2, 10).cast("int")


def is_bit_palindrome8(v: Column) -> Column:
    return reverse_bits8(v) == v


def roll64(v: Column, amount: int) -> Column:
    """Rotate left; a negative amount rotates right."""
    k = amount % 64
    return v if not k else F.shiftleft(v, k).bitwiseOR(F.shiftrightunsigned(v, 64 - k))


def get_bit(v: Column, index: int) -> Column:
    return F.shiftright(v, index).bitwiseAND(F.lit(1)) == 1


def set_bit(v: Column, index: int, on: bool = True) -> Column:
    bit = F.lit(1 << index).cast("bigint")
    return v.bitwiseOR(bit) if on else v.bitwiseAND(F.bitwise_not(bit))


def toggle_bit(v: Column, index: int) -> Column:
    return v.bitwiseXOR(F.lit(1 << index).cast("bigint"))


def clamp(v: Column, low, high) -> Column:
    return F.least(F.greatest(v, _col(low)), _col(high))


def is_power_of_two(v: Column) -> Column:
    return (v > 0) & (v.bitwiseAND(v - 1) == 0)


def divide_ceil(a: Column, b) -> Column:
    """(a + b - 1) div b for integers that aren't negative; also bits to bytes (b = 8)."""
    n = _col(b)
    return ((a + n - 1) - F.pmod(a + n - 1, n)) / n


def log2_floor(v: Column) -> Column:
    """Place of the highest set bit; 0 for 0 and below."""
    return F.when(v > 0, F.length(F.bin(v.cast("bigint"))) - 1).otherwise(0)


def gcd(a: Column, b: Column) -> Column:
    """Euclid's algorithm as a bounded fold (92 steps suffice for 64-bit integers)."""
    zero = F.struct(F.abs(a.cast("bigint")).alias("a"), F.abs(b.cast("bigint")).alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), zero, lambda s, _: F.when(s.b == 0, s).otherwise(F.struct(s.b.alias("a"), (s.a % F.nullif(s.b, F.lit(0))).alias("b"))), lambda s: s.a)


def lcm(a: Column, b: Column) -> Column:
    return let(gcd(a, b), lambda g: F.when(g == 0, F.lit(0).cast("bigint")).otherwise(F.abs(a.cast("bigint")) / F.nullif(g, F.lit(0)) * F.abs(b.cast("bigint")))).cast("bigint")


def rational(num: Column, den: Column) -> Column:
    """struct<num, den> in lowest terms with a positive denominator; null for den = 0."""
    sign = F.when(den < 0, -1).otherwise(1)
    return let(gcd(num, den), lambda g: F.when(den != 0, F.struct((sign * num / F.nullif(g, F.lit(0))).cast("bigint").alias("num"), (sign * den / F.nullif(g, F.lit(0))).cast("bigint").alias("den"))))


def rational_add(x: Column, y: Column) -> Column:
    return rational(x["num"] * y["den"] + y["num"] * x["den"], x["den"] * y["den"])


def rational_multiply(x: Column, y: Column) -> Column:
    return rational(x["num"] * y["num"], x["den"] * y["den"])


def rational_subtract(x: Column, y: Column) -> Column:
    return rational(x["num"] * y["den"] - y["num"] * x["den"], x["den"] * y["den"])


def rational_divide(x: Column, y: Column) -> Column:
    """Null for a divisor of zero."""
    return rational(x["num"] * y["den"], x["den"] * y["num"])


def rational_compare(x: Column, y: Column) -> Column:
    """-1, 0 or 1; denominators are positive in lowest terms."""
    return F.signum((x["num"] * y["den"] - y["num"] * x["den"]).cast("double")).cast("int")


def fourcc(b: Column, offset=0) -> Column:
    return F.decode(F.substring(b, (_col(offset) + 1).cast("int"), F.lit(4)), "ISO-8859-1")


def contains_bytes(b: Column, needle: Column) -> Column:
    """Place of the first occurrence, -1 without one; a latin-1 view keeps one character a byte."""
    return F.position(F.decode(needle, "ISO-8859-1"), F.decode(b, "ISO-8859-1")) - 1
