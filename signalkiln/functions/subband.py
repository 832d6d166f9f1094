"""Sub-band adaptive differential coding of 16 kHz speech at 64 kbit/s (ITU-T G.722), many signals at once.

Each sample depends on all before it, so time is a loop; the signals of an Arrow batch are columns of one
array, and every step runs over all of them in numpy.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed values of the recommendation. Half of the symmetric mirror filter:
FILTER = (3, -11, 12, 32, -210, 951, 3876, -805, 362, -156, 53, -11)
#: Decision levels of the lower band, and its codes for negative and positive differences.
LEVELS = (0, 35, 72, 110, 150, 190, 233, 276, 323, 370, 422, 473, 530, 587, 650, 714, 786, 858, 940, 1023, 1121, 1219, 1339, 1458, 1612, 1765, 1980, 2195, 2557, 2919)
NEGATIVE = (0, 63, 62, *range(31, 3, -1))
POSITIVE = (0, *range(61, 31, -1))
#: Values of the codes of 6, 4 and 2 bits.
VALUES_6 = (
    -136, -136, -136, -136, -24808, -21904, -19008, -16704, -14984, -13512, -12280, -11192, -10232, -9360, -8576, -7856, -7192, -6576, -6000, -5456, -4944, -4464, -4008, -3576, -3168, -2776, -2400, -2032, -1688, -1360, -1040, -728,
    24808, 21904, 19008, 16704, 14984, 13512, 12280, 11192, 10232, 9360, 8576, 7856, 7192, 6576, 6000, 5456, 4944, 4464, 4008, 3576, 3168, 2776, 2400, 2032, 1688, 1360, 1040, 728, 432, 136, -432, -136,
)
VALUES_4 = (0, -20456, -12896, -8968, -6288, -4240, -2584, -1200, 20456, 12896, 8968, 6288, 4240, 2584, 1200, 0)
VALUES_2 = (-7408, -1616, 7408, 1616)
#: How the logarithm of the step of each band moves by code, its largest value, and the shift of the step.
LOG_4 = (-60, 3042, 1198, 538, 334, 172, 58, -30, 3042, 1198, 538, 334, 172, 58, -30, -60)
LOG_2 = (798, -214, 798, -214)
LOW, HIGH = (18432, 8), (22528, 10)

_LEVELS, _NEG, _POS, _V6, _V4, _V2, _L4, _L2 = (np.array(x, np.int64) for x in (LEVELS, NEGATIVE, POSITIVE, VALUES_6, VALUES_4, VALUES_2, LOG_4, LOG_2))
_MANTISSA = np.rint(2048 * 2 ** (np.arange(32) / 32)).astype(np.int64)
_MIRROR = np.array(FILTER, np.int64)


def _sat(x: np.ndarray) -> np.ndarray:
    return np.clip(x, -32768, 32767)


class Band:
    """The adaptive predictor and step of one band of ``n`` signals."""

    def __init__(self, n: int, step: int, bounds: tuple[int, int]):
        zero = lambda *s: np.zeros((n, *s), np.int64)
        self.log, self.step, self.bounds = zero(), np.full(n, step, np.int64), bounds
        self.poles, self.zeros = zero(2), zero(6)  # coefficients
        self.past, self.parts, self.differences = zero(2), zero(2), zero(6)  # newest first
        self.guess, self.by_zeros = zero(), zero()

    def adapt_step(self, move: np.ndarray) -> None:
        top, shift = self.bounds
        self.log = np.clip((self.log * 127 >> 7) + move, 0, top)
        size, left = _MANTISSA[self.log >> 6 & 31], shift - (self.log >> 11)
        self.step = np.where(left < 0, size << np.maximum(-left, 0), size >> np.maximum(left, 0)) << 2

    def follow(self, d: np.ndarray) -> None:
        """Take the quantised difference of a sample and predict the next."""
        value, part = _sat(self.guess + d), _sat(self.by_zeros + d)
        alike = (part < 0)[:, None] == (self.parts < 0)
        a1, a2 = self.poles[:, 0], self.poles[:, 1]
        lean = _sat(a1 * 4)
        lean = np.minimum(np.where(alike[:, 0], -lean, lean), 32767)
        a2 = np.clip(np.where(alike[:, 1], 128, -128) + (lean >> 7) + (a2 * 32512 >> 15), -12288, 12288)
        most = _sat(15360 - a2)
        a1 = np.clip(_sat(np.where(alike[:, 0], 192, -192) + (a1 * 32640 >> 15)), -most, most)
        pull = np.where(d == 0, 0, 128)[:, None]
        self.zeros = _sat(np.where((self.differences < 0) == (d < 0)[:, None], pull, -pull) + (self.zeros * 32640 >> 15))
        self.poles = np.stack([a1, a2], axis=1)
        self.differences = np.concatenate([d[:, None], self.differences[:, :-1]], axis=1)
        self.past = np.stack([value, self.past[:, 0]], axis=1)
        self.parts = np.stack([part, self.parts[:, 0]], axis=1)
        by_poles = _sat((self.poles * _sat(2 * self.past) >> 15).sum(axis=1))
        self.by_zeros = _sat((self.zeros * _sat(2 * self.differences) >> 15).sum(axis=1))
        self.guess = _sat(by_poles + self.by_zeros)


def encode(samples: np.ndarray) -> np.ndarray:
    """Codes (signals, n / 2) of 16-bit samples (signals, n)."""
    n, length = samples.shape
    low, high = Band(n, 32, LOW), Band(n, 8, HIGH)
    line = np.zeros((n, 24), np.int64)
    out = np.zeros((n, length // 2), np.uint8)
    for t in range(length // 2):
        line = np.concatenate([line[:, 2:], samples[:, 2 * t : 2 * t + 2].astype(np.int64)], axis=1)
        odd, even = line[:, ::2] @ _MIRROR, line[:, 1::2] @ _MIRROR[::-1]
        x, y = even + odd >> 14, even - odd >> 14
        e = _sat(x - low.guess)
        size = np.where(e >= 0, e, -(e + 1))
        level = np.minimum((size[:, None] >= (_LEVELS[None, 1:] * low.step[:, None] >> 12)).sum(axis=1) + 1, len(_LEVELS))
        code = np.where(e < 0, _NEG[level], _POS[level])
        difference = low.step * _V4[code >> 2] >> 15
        low.adapt_step(_L4[code >> 2])
        low.follow(difference)
        e = _sat(y - high.guess)
        far = np.where(e >= 0, e, -(e + 1)) >= (564 * high.step >> 12)
        upper = np.where(e < 0, np.where(far, 0, 1), np.where(far, 2, 3))
        difference = high.step * _V2[upper] >> 15
        high.adapt_step(_L2[upper])
        high.follow(difference)
        out[:, t] = upper << 6 | code
    return out


def decode(codes: np.ndarray) -> np.ndarray:
    """Samples (signals, 2 n) of codes (signals, n)."""
    n, length = codes.shape
    low, high = Band(n, 32, LOW), Band(n, 8, HIGH)
    line = np.zeros((n, 24), np.int64)
    out = np.zeros((n, 2 * length), np.int16)
    for t in range(length):
        code, upper = codes[:, t].astype(np.int64) & 63, codes[:, t].astype(np.int64) >> 6
        x = np.clip(low.guess + (low.step * _V6[code] >> 15), -16384, 16383)
        difference = low.step * _V4[code >> 2] >> 15
        low.adapt_step(_L4[code >> 2])
        low.follow(difference)
        difference = high.step * _V2[upper] >> 15
        y = np.clip(high.guess + difference, -16384, 16383)
        high.adapt_step(_L2[upper])
        high.follow(difference)
        line = np.concatenate([line[:, 2:], (x + y)[:, None], (x - y)[:, None]], axis=1)
        out[:, 2 * t], out[:, 2 * t + 1] = _sat(line[:, 1::2] @ _MIRROR[::-1] >> 11), _sat(line[:, ::2] @ _MIRROR >> 11)
    return out


def transcode(rows: DataFrame, column: str, to: str) -> DataFrame:
    """``column`` by the codec: array<int> samples to binary codes (``encode``), or codes to samples (``decode``). Nulls stay null.

    The signals of a slice are coded side by side, those shorter than the longest with silence behind them.
    """
    from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

    kind = BinaryType() if to == "encode" else ArrayType(IntegerType())
    schema = StructType([StructField(f.name, kind) if f.name == column else f for f in rows.schema.fields])
    work = encode if to == "encode" else decode

    def run(batches):
        for b in batches:
            at = b.schema.get_field_index(column)
            for first in range(0, b.num_rows, 256):
                part = b.slice(first, 256)
                values = [None if not v.is_valid else np.frombuffer(v.as_py(), np.uint8) if to == "decode" else np.array(v.as_py(), np.int64) for v in part.column(at)]
                longest = max((len(v) for v in values if v is not None), default=0)
                table = np.zeros((len(values), longest), np.int64)
                for i, v in enumerate(values):
                    if v is not None:
                        table[i, : len(v)] = v
                got = work(table)
                if to == "encode":
                    done = pa.array([None if v is None else got[i, : len(v) // 2].tobytes() for i, v in enumerate(values)], pa.binary())
                else:
                    done = pa.array([None if v is None else got[i, : 2 * len(v)].tolist() for i, v in enumerate(values)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([done if i == at else part.column(i) for i in range(part.num_columns)], names=schema.names)

    return rows.mapInArrow(run, schema)
