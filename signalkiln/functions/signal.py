"""Signal kernels over array columns: companding, resampling, waveforms, colour, quantisation, small transforms.

Everything is a column expression; the 8x8 cosine transforms run as Arrow batches in ``kernels``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bits import clamp, let


def _and(c: Column, m: int) -> Column:
    return c.bitwiseAND(F.lit(m))


# --- companding (ITU-T G.711) ---------------------------------------------------------------------


def mulaw_encode(pcm: Column) -> Column:
    """One 16-bit sample to one byte: clip 32635, bias 132, exponent of the top bit, inverted."""
    sign = F.when(pcm < 0, 128).otherwise(0)

    def pack(m: Column) -> Column:
        e = F.greatest(F.length(F.bin(m.cast("bigint"))) - 8, F.lit(0))
        return _and(F.bitwise_not(sign.bitwiseOR(e * 16).bitwiseOR(_and(F.floor(m / F.pow(F.lit(2), e + 3)).cast("int"), 15)).cast("int")), 255)

    return let(F.least(F.abs(pcm.cast("int")), F.lit(32635)) + 132, pack)


def mulaw_decode(code: Column) -> Column:
    def unpack(u: Column) -> Column:
        mag = (_and(u, 15) * 8 + 132) * F.pow(F.lit(2), _and(F.shiftright(u, 4), 7)).cast("int") - 132
        return F.when(_and(u, 128) != 0, -mag).otherwise(mag)

    return let(_and(F.bitwise_not(code.cast("int")), 255), unpack)


def alaw_encode(pcm: Column) -> Column:
    """One 16-bit sample to one byte: clip 32635, even bits inverted."""
    s = pcm.cast("int")
    mark = F.when(s >= 0, 0xD5).otherwise(0x55)

    def pack(m: Column) -> Column:
        e = F.length(F.bin(m.cast("bigint"))) - 8
        big = (e * 16).bitwiseOR(_and(F.floor(m / F.pow(F.lit(2), e + 3)).cast("int"), 15))
        return F.when(m >= 256, big).otherwise(F.shiftright(m, 4)).cast("int").bitwiseXOR(mark)

    return let(F.least(F.when(s >= 0, s).otherwise(-s - 1), F.lit(32635)), pack)


def alaw_decode(code: Column) -> Column:
    def unpack(a: Column) -> Column:
        e, m = _and(F.shiftright(a, 4), 7), _and(a, 15) * 16
        mag = F.when(e == 0, m + 8).otherwise((m + 264) * F.pow(F.lit(2), F.greatest(e - 1, F.lit(0))).cast("int"))
        return F.when(_and(a, 128) != 0, mag).otherwise(-mag)

    return let(code.cast("int").bitwiseXOR(F.lit(0x55)), unpack)


# --- sample arrays --------------------------------------------------------------------------------


def repeat_samples(a: Column, factor: int) -> Column:
    """Integer up-sampling without a filter; factor 0 or 1 changes nothing."""
    return a if factor < 2 else F.flatten(F.transform(a, lambda x: F.array_repeat(x, factor)))


def decimate(a: Column, factor: int) -> Column:
    """Every factor-th sample, from the first."""
    return a if factor < 2 else F.filter(a, lambda x, i: i % factor == 0)


def channel(a: Column, channels: int, first: int, count: int = 1) -> Column:
    """Channels first .. first + count - 1 of interleaved samples."""
    return F.filter(a, lambda x, i: (i % channels).between(first, first + count - 1))


def to_planar(a: Column, channels: int) -> Column:
    """c0 c1 c0 c1 ... to c0 c0 ... c1 c1 ..."""
    return F.flatten(F.array(*(channel(a, channels, c) for c in range(channels))))


def to_packed(a: Column, channels: int) -> Column:
    """The reverse of ``to_planar``."""
    n = F.floor(F.size(a) / channels).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n * channels - 1), lambda i: F.element_at(a, ((i % channels) * n + F.floor(i / channels) + 1).cast("int")))).otherwise(a)


def to_semi_planar(a: Column) -> Column:
    """y u v y u v ... to y y ... u v u v ..."""
    return F.concat(channel(a, 3, 0), channel(a, 3, 1, 2))


def stereo(left: Column, right: Column) -> Column:
    return F.flatten(F.zip_with(left, right, lambda x, y: F.array(x, y)))


def l1_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0).cast("bigint"), lambda s, x: s + x)


def sine(t: Column, amplitude=1.0, frequency=1.0, phase=0.0, damping=0.0) -> Column:
    return amplitude * F.exp(-damping * t) * F.sin(2 * math.pi * frequency * t + phase)


def saw(t: Column, amplitude=1.0, frequency=1.0, mode: str = "spec") -> Column:
    """A rising ramp over each period; ``compat`` feeds the ramp into a sine."""
    ramp = 2 * (t * frequency - F.floor(t * frequency + 0.5))
    return amplitude * (F.sin(ramp) if mode == "compat" else ramp)


def triangle(t: Column, amplitude=1.0, frequency=1.0, mode: str = "spec") -> Column:
    ramp = 2 * F.abs(2 * (t * frequency - F.floor(t * frequency + 0.5))) - 1
    return amplitude * (F.sin(ramp) if mode == "compat" else ramp)


def square(t: Column, amplitude=1.0, frequency=1.0) -> Column:
    """Sign of a sine; 0 at time 0."""
    return F.when(t == 0, F.lit(0.0)).otherwise(amplitude * F.signum(F.sin(2 * math.pi * frequency * t)))


#: Row and column tones of the keys, in Hz (fixed values of ITU-T Q.23).
DTMF_ROWS, DTMF_COLUMNS, DTMF_KEYS = (697, 770, 852, 941), (1209, 1336, 1477, 1633), "123A456B789C*0#D"


def dtmf(key: Column, t: Column, amplitude=0.5) -> Column:
    at = F.instr(F.lit(DTMF_KEYS), key) - 1 if isinstance(key, str) else F.position(key, F.lit(DTMF_KEYS)) - 1
    tone = lambda tones, i: F.element_at(F.array(*map(F.lit, tones)), i + 1)
    low, high = tone(DTMF_ROWS, F.floor(at / 4).cast("int")), tone(DTMF_COLUMNS, (at % 4).cast("int"))
    return amplitude * (F.sin(2 * math.pi * low * t) + F.sin(2 * math.pi * high * t))


#: Nominal bit rates of AC-3 frames in kbit/s, two frame size codes each (fixed values of ATSC A/52).
AC3_RATES = (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384, 448, 512, 576, 640)


def ac3_bit_rate(size_code: Column) -> Column:
    return F.try_element_at(F.array(*map(F.lit, AC3_RATES)), F.floor(size_code / 2).cast("int") + 1)


def ac3_frame_bytes(rate_code: Column, size_code: Column) -> Column:
    """Bytes of a frame: 1536 samples at 48, 44.1 (odd codes carry one word more) or 32 kHz."""
    kbit = ac3_bit_rate(size_code)
    words441 = F.floor(kbit * 1536000 / 44100 / 16).cast("int") + (size_code % 2).cast("int")
    return F.when(rate_code == 0, kbit * 4).when(rate_code == 1, words441 * 2).when(rate_code == 2, kbit * 6).cast("int")


# --- colour ---------------------------------------------------------------------------------------


def byte(c: Column) -> Column:
    """Clamped to 0 .. 255, then cut to an integer."""
    return F.floor(clamp(c, F.lit(0.0), F.lit(255.0))).cast("int")


def rgb_to_yuv(r: Column, g: Column, b: Column) -> Column:
    """BT.601, full range, chroma about 128."""
    return F.struct(byte(0.299 * r + 0.587 * g + 0.114 * b).alias("y"), byte(-0.14713 * r - 0.28886 * g + 0.436 * b + 128).alias("u"), byte(0.615 * r - 0.51499 * g - 0.10001 * b + 128).alias("v"))


def rgb_to_yuv_int(r: Column, g: Column, b: Column) -> Column:
    """Studio range by integers: sums of 66/129/25 and so on, shifted by 8."""
    f = lambda x, y, z, o: (F.shiftright(x * r.cast("int") + y * g.cast("int") + z * b.cast("int") + 128, 8) + o).cast("int")
    return F.struct(f(66, 129, 25, 16).alias("y"), f(-38, -74, 112, 128).alias("u"), f(112, -94, -18, 128).alias("v"))


def yuv_to_rgb(y: Column, u: Column, v: Column) -> Column:
    d, e = u - 128, v - 128
    return F.struct(byte(y + 1.13983 * e).alias("r"), byte(y - 0.39465 * d - 0.58060 * e).alias("g"), byte(y + 2.03211 * d).alias("b"))


def jpeg_yuv_to_rgb(y: Column, cb: Column, cr: Column) -> Column:
    d, e = cb - 128, cr - 128
    return F.struct(byte(y + 1.402 * e).alias("r"), byte(y - 0.344136 * d - 0.714136 * e).alias("g"), byte(y + 1.772 * d).alias("b"))


def rgb_to_xyz(r: Column, g: Column, b: Column) -> Column:
    """Linear 0..1 components of the sRGB primaries, without a gamma step, as doubles."""
    x, y, z = r / 255.0, g / 255.0, b / 255.0
    return F.struct((0.4124 * x + 0.3576 * y + 0.1805 * z).alias("x"), (0.2126 * x + 0.7152 * y + 0.0722 * z).alias("y"), (0.0193 * x + 0.1192 * y + 0.9505 * z).alias("z"))


WHITE = (0.95047, 1.0, 1.08883)


def xyz_to_lab(x: Column, y: Column, z: Column, mode: str = "spec") -> Column:
    """CIE 1976 about D65; ``compat`` takes the power 0.75 for the cube root."""
    root = (lambda c: F.pow(c, F.lit(0.75))) if mode == "compat" else F.cbrt
    f = lambda c, w: let(c / w, lambda t: F.when(t > 216 / 24389, root(t)).otherwise((24389 / 27 * t + 16) / 116))
    fx, fy, fz = f(x, WHITE[0]), f(y, WHITE[1]), f(z, WHITE[2])
    return F.struct((116 * fy - 16).alias("l"), (500 * (fx - fy)).alias("a"), (200 * (fy - fz)).alias("b"))


def lab_to_xyz(l: Column, a: Column, b: Column) -> Column:  # noqa: E741
    fy = (l + 16) / 116
    g = lambda f: let(f, lambda t: F.when(t * t * t > 216 / 24389, t * t * t).otherwise((116 * t - 16) * 27 / 24389))
    return F.struct((g(fy + a / 500) * WHITE[0]).alias("x"), (g(fy) * WHITE[1]).alias("y"), (g(fy - b / 200) * WHITE[2]).alias("z"))


def yuv420_planes(pixels):
    """(image_id, luma, u, v): arrays of bytes by rows; chroma is the mean of blocks of 2 x 2 pixels. One aggregation by block and one by image."""
    byte = lambda c: F.floor(F.least(F.greatest(c, F.lit(0.0)), F.lit(255.0))).cast("int")
    c = [F.col(f"c{i}") for i in range(3)]
    y = 0.299 * c[0] + 0.587 * c[1] + 0.114 * c[2]
    u = -0.14713 * c[0] - 0.28886 * c[1] + 0.436 * c[2] + 128
    v = 0.615 * c[0] - 0.51499 * c[1] - 0.10001 * c[2] + 128
    blocks = pixels.groupBy("image_id", F.expr("y div 2").alias("by"), F.expr("x div 2").alias("bx")).agg(F.collect_list(F.struct("y", "x", byte(y).alias("v"))).alias("luma"), byte(F.avg(u)).alias("u"), byte(F.avg(v)).alias("v"))
    got = blocks.groupBy("image_id").agg(F.array_sort(F.flatten(F.collect_list("luma"))).alias("luma"), F.array_sort(F.collect_list(F.struct("by", "bx", "u", "v"))).alias("chroma"))
    return got.select("image_id", F.transform("luma", lambda p: p["v"]).alias("luma"), F.transform("chroma", lambda p: p["u"]).alias("u"), F.transform("chroma", lambda p: p["v"]).alias("v"))


# --- images as pixel rows -------------------------------------------------------------------------


def crop(pixels, x0: int, y0: int, width: int, height: int):
    """The sub-rectangle with its corner moved to 0, 0. A filter that reaches the scan; no shuffle."""
    inside = pixels.where(F.col("x").between(x0, x0 + width - 1) & F.col("y").between(y0, y0 + height - 1))
    return inside.withColumns({"x": F.col("x") - x0, "y": F.col("y") - y0})


def resize(pixels, old: tuple[int, int], new: tuple[int, int]):
    """Nearest neighbour. Each source pixel emits the targets that map to it, so no join is needed."""
    (w, h), (nw, nh) = old, new
    first = lambda c, n, o: F.ceil(c * n / o).cast("int")
    span = lambda c, n, o: F.when(first(c, n, o) <= first(c + 1, n, o) - 1, F.sequence(first(c, n, o), first(c + 1, n, o) - 1))
    rows = pixels.withColumn("__x", F.explode(span(F.col("x"), nw, w))).withColumn("__y", F.explode(span(F.col("y"), nh, h)))
    return rows.drop("x", "y").withColumnsRenamed({"__x": "x", "__y": "y"}).select(pixels.columns)


def rotate(pixels, size: tuple[int, int], angle: float, mode: str = "spec"):
    """Nearest by the inverse map about the centres; targets without a source are left out (they are 0).

    ``pixels`` has image_id, x, y. Each source pixel emits the targets that map to it, so no join is needed:
    of the targets near its own place those whose inverse map gives it. ``compat`` takes degrees, centres on
    whole pixels and cuts places towards zero.
    """
    compat = mode == "compat"
    w, h = size
    angle = math.radians(angle) if compat else angle
    c, s = math.cos(angle), math.sin(angle)
    nw, nh = int(w * abs(c) + h * abs(s)), int(w * abs(s) + h * abs(c))
    half = (lambda n: n // 2) if compat else (lambda n: n / 2)
    # the places that are cut to a pixel lie up to half a pixel from its centre, those cut to 0 up to a whole one
    reach, middle = (1 if compat else 0.5) * (abs(c) + abs(s)) + 1e-6, 0 if compat else 0.5
    near_x, near_y = F.col("__x") + middle - half(w), F.col("__y") + middle - half(h)

    def span(at: Column, n: int) -> Column:
        low, high = F.greatest(F.ceil(at - reach), F.lit(0)).cast("int"), F.least(F.floor(at + reach), F.lit(n - 1)).cast("int")
        return F.when(low <= high, F.sequence(low, high))

    rows = pixels.where(F.col("image_id").isNotNull()).withColumnsRenamed({"x": "__x", "y": "__y"})
    rows = rows.withColumn("x", F.explode(span(near_x * c - near_y * s + half(nw), nw))).withColumn("y", F.explode(span(near_x * s + near_y * c + half(nh), nh)))
    dx, dy = F.col("x") - half(nw), F.col("y") - half(nh)
    place = (lambda v: v.cast("int")) if compat else (lambda v: F.when(v >= 0, F.floor(v).cast("int")))
    hit = (place(dx * c + dy * s + half(w)) == F.col("__x")) & (place(-dx * s + dy * c + half(h)) == F.col("__y"))
    return rows.where(hit).select(pixels.columns)


# --- 8x8 blocks -----------------------------------------------------------------------------------


def _zigzag() -> list[int]:
    """Places of an 8x8 block in order of the diagonals, direction alternating."""
    return sorted(range(64), key=lambda k: ((k // 8) + (k % 8), (k // 8) if ((k // 8) + (k % 8)) % 2 else (k % 8)))


ZIGZAG = _zigzag()

#: Luminance and chrominance tables of ITU-T T.81 annex K (fixed values).
LUMINANCE = (
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
)
CHROMINANCE = (17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99, *[99] * 32)


def zigzag(a: Column) -> Column:
    return F.transform(F.array(*map(F.lit, ZIGZAG)), lambda i: F.element_at(a, i + 1))


def unzigzag(a: Column) -> Column:
    back = sorted(range(64), key=ZIGZAG.__getitem__)
    return F.transform(F.array(*map(F.lit, back)), lambda i: F.element_at(a, i + 1))


def quantiser_scale(quality: Column) -> Column:
    """5000 / q below 50, else 200 - 2 q."""
    return F.when(quality < 50, F.floor(5000 / quality)).otherwise(200 - 2 * quality).cast("int")


def scaled_table(table: Column, scale: Column) -> Column:
    return F.transform(table, lambda t: clamp(F.floor((t * scale + 50) / 100).cast("int"), F.lit(1), F.lit(255)))


def quantise(block: Column, table: Column) -> Column:
    return F.zip_with(block, table, lambda x, q: F.round(x / q).cast("int"))


def dequantise(block: Column, table: Column) -> Column:
    return F.zip_with(block, table, lambda x, q: x * q)


def quality_estimate(table: Column, reference: Column) -> Column:
    """The quality whose scale the mean ratio of a table to the reference table stands for."""
    ratio = F.aggregate(F.zip_with(table, reference, lambda x, r: 100.0 * x / r), F.lit(0.0), lambda s, x: s + x) / F.size(table)
    return F.when(ratio <= 100, (200 - ratio) / 2).otherwise(5000 / ratio)


def magnitude_bits(v: Column) -> Column:
    """Bits that an entropy coder spends on a coefficient: 0 for 0."""
    return F.when(v == 0, 0).otherwise(F.length(F.bin(F.abs(v).cast("bigint"))))


def v210_unpack(word: Column) -> Column:
    """Three 10-bit components of a little-endian 32-bit word that is given as a bigint."""
    return F.array(*(F.shiftright(word, s).bitwiseAND(F.lit(1023)).cast("int") for s in (0, 10, 20)))


def v210_pack(a: Column, b: Column, c: Column) -> Column:
    return a.cast("bigint") + F.shiftleft(b.cast("bigint"), 10) + F.shiftleft(c.cast("bigint"), 20)
