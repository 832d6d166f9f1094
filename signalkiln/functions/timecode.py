"""Clocks: NTP, program clock reference, RTP clock rates, PCM durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bits import bits_msb, uint

#: Seconds from 1900-01-01 and from 2036-02-07T06:28:16 to 1970-01-01 (RFC 4330).
ERA0, ERA1 = 2208988800, -2085978496
_WIDE = "decimal(20,0)"
#: Ticks after which a 33-bit field of 90 kHz begins anew.
ROUND = 1 << 33


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp, with or without zone (read as UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def ntp_from_timestamp(ts: Column) -> Column:
    """64-bit NTP time as decimal(20,0): seconds of the era in the upper, fraction in the lower 32 bits."""
    us = micros(ts)
    sec, rest = F.floor(us / F.lit(1_000_000).cast("decimal(20,0)")).cast("bigint"), F.pmod(us, F.lit(1_000_000))
    era = F.when(sec < -ERA1, sec + ERA0).otherwise(sec + ERA1)
    fraction = ((rest * F.lit(1 << 32)) - F.pmod(rest * F.lit(1 << 32), F.lit(1_000_000))) / F.lit(1_000_000)
    return (era.cast(_WIDE) * F.lit(1 << 32).cast("decimal(10,0)") + fraction.cast("decimal(10,0)")).cast(_WIDE)


def timestamp_from_ntp(ntp: Column) -> Column:
    """Timestamp of a 64-bit NTP time; a clear top bit means the era that began in 2036."""
    two32 = F.lit(1 << 32).cast("decimal(10,0)")
    sec = F.floor(ntp.cast(_WIDE) / two32).cast("bigint")
    fraction = (ntp.cast(_WIDE) % two32).cast("bigint")
    unix = F.when(sec >= 1 << 31, sec - ERA0).otherwise(sec - ERA1)
    us = F.shiftright(fraction * 1_000_000 + (1 << 31), 32)
    return F.timestamp_micros(unix * 1_000_000 + us)


def add_micros(ts: Column, n: Column) -> Column:
    return F.timestamp_micros(micros(ts) + n)


def add_nanos(ts: Column, n: Column) -> Column:
    """Nanoseconds are cut to whole microseconds."""
    return add_micros(ts, F.floor(n / 1000).cast("bigint"))


def clock_seconds(ticks: Column, rate) -> Column:
    return ticks / rate


def frame_duration(first: Column, last: Column, rate, mode: str = "spec") -> Column:
    """Seconds between two RTP timestamps; ``compat`` keeps the precedence of last - first * rate."""
    return (last - first * rate).cast("double") if mode == "compat" else (last - first) / rate


def pcr(b: Column, offset: int = 0) -> Column:
    """27 MHz ticks of a 6-byte program clock reference: 33-bit base in 90 kHz, 9-bit extension."""
    return bits_msb(b, offset * 8, 33) * 300 + bits_msb(b, offset * 8 + 39, 9)


def pcr_seconds(b: Column, offset: int = 0) -> Column:
    return pcr(b, offset) / 27_000_000


def scr(b: Column, offset: int = 4) -> Column:
    """27 MHz ticks of the system clock reference of an MPEG-2 pack header, marker bits skipped."""
    at = offset * 8
    base = F.shiftleft(bits_msb(b, at + 2, 3), 30) + F.shiftleft(bits_msb(b, at + 6, 15), 15) + bits_msb(b, at + 22, 15)
    return base * 300 + bits_msb(b, at + 38, 9)


def pts(b: Column, offset: int) -> Column:
    """90 kHz ticks of a 5-byte PTS or DTS field of a PES header."""
    at = offset * 8
    return F.shiftleft(bits_msb(b, at + 4, 3), 30) + F.shiftleft(bits_msb(b, at + 8, 15), 15) + bits_msb(b, at + 24, 15)


def unwrapped(ticks: Column, near: Column, period: int) -> Column:
    """The time nearest to ``near`` that a counter which begins anew after ``period`` shows as ``ticks``.

    The field of a clock tells no more than its bits (33 at 90 kHz are 26.5 hours), so a clock that is right
    to less than half a period tells the rounds.
    """
    half = period // 2
    return near + F.pmod(ticks - near + half, F.lit(period)) - half


def pcm_bytes(ms: Column, rate: int, channels: int, bits: int) -> Column:
    """Whole sample frames of a duration, in bytes."""
    frame = channels * bits // 8
    return F.floor(ms * rate / 1000).cast("bigint") * frame


def pcm_ms(n_bytes: Column, rate: int, channels: int, bits: int) -> Column:
    return n_bytes / (rate * channels * bits / 8) * 1000


def midi_delta(b: Column) -> Column:
    """Variable-length quantity of 1 to 4 bytes: 7 bits each, the top bit continues."""
    v = [uint(b, i, 1) for i in range(4)]
    low = [x.bitwiseAND(F.lit(127)) for x in v]
    out = low[0]
    result = F.when(v[0] < 128, out)
    for i in range(1, 4):
        out = out * 128 + low[i]
        result = result.when(v[i] < 128, out)
    return result
