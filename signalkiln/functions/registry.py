"""Registries that users extend: codecs and transforms by name, readers by file extension, handlers by request method."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import signal


class Registry:
    """Names to functions; a name is taken once unless it is replaced on purpose. Names compare without case."""

    def __init__(self, **known: Callable):
        self._known = {k.lower(): v for k, v in known.items()}

    def register(self, name: str, function: Callable, replace: bool = False) -> bool:
        """Whether the name is now the function's: false where it was taken."""
        if name.lower() in self._known and not replace:
            return False
        self._known[name.lower()] = function
        return True

    def get(self, name: str) -> Callable | None:
        return self._known.get(name.lower())

    def names(self) -> list[str]:
        return sorted(self._known)


#: Encoders and decoders of one 16-bit sample as column functions.
CODECS = Registry(pcmu=signal.mulaw_encode, pcma=signal.alaw_encode, pcmu_decode=signal.mulaw_decode, pcma_decode=signal.alaw_decode)


def encode_samples(samples: Column, name: str) -> Column:
    """An array of samples by the codec of a name."""
    codec = CODECS.get(name)
    if codec is None:
        raise KeyError(f"no codec {name!r}; known: {', '.join(CODECS.names())}")
    return F.transform(samples, codec)


def by_extension(files: DataFrame, readers: dict[str, str], path: str = "path") -> DataFrame:
    """Adds format: what the registry says of the file's extension (without case), null for others."""
    extension = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    known = F.create_map(*(F.lit(x) for k, v in readers.items() for x in (k.lower().lstrip("."), v)))
    return files.withColumn("format", F.try_element_at(known, extension))


#: Formats of file extensions; users may add to it.
EXTENSIONS = {"wav": "riff", "avi": "riff", "mp4": "bmff", "mov": "bmff", "m4a": "bmff", "mkv": "ebml", "webm": "ebml", "ogg": "ogg", "ogv": "ogg", "wmv": "asf", "mxf": "mxf", "gxf": "gxf", "rm": "real", "nut": "nut", "mpg": "mpeg", "ts": "ts", "flac": "flac", "png": "png", "jpg": "jpeg", "jpeg": "jpeg", "bmp": "bmp", "rtp": "dump"}


def transform_arrays(rows: DataFrame, column: str, function: Callable[[np.ndarray], np.ndarray], kind: str = "array<double>") -> DataFrame:
    """A user's transform of arrays (samples of a buffer, components of an image row), in Arrow batches."""

    @F.pandas_udf(kind)
    def apply(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else function(np.asarray(v)))

    return rows.withColumn(column, apply(column))


def handle(messages: DataFrame, handlers: dict[str, Callable[[DataFrame], DataFrame]], method: str = "method", otherwise: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame | None:
    """Messages by a user's handler of their method, results united; methods without one go to ``otherwise``, or are left out."""
    known = [m.upper() for m in handlers]
    parts = [f(messages.where(F.upper(method) == m.upper())) for m, f in handlers.items()]
    if otherwise:
        parts.append(otherwise(messages.where(~F.coalesce(F.upper(method).isin(known), F.lit(False)))))
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return out


#: Units of length, time and data to their base unit (metre, second, bit): fixed values.
UNITS = {"mm": ("length", 0.001), "cm": ("length", 0.01), "m": ("length", 1.0), "km": ("length", 1000.0), "in": ("length", 0.0254), "ft": ("length", 0.3048), "us": ("time", 1e-6), "ms": ("time", 0.001), "s": ("time", 1.0), "min": ("time", 60.0), "h": ("time", 3600.0), "bit": ("data", 1.0), "byte": ("data", 8.0), "kib": ("data", 8192.0)}


def convert(value: Column, source: str, target: str) -> Column:
    """A value of one unit in another of the same kind."""
    (a, x), (b, y) = UNITS[source], UNITS[target]
    if a != b:
        raise ValueError(f"{source} is {a}, {target} is {b}")
    return value * F.lit(x / y)


def register_sql(spark: SparkSession, name: str, function: Callable, kind: str) -> None:
    """Make a vectorised function callable from SQL under a name."""
    spark.udf.register(name, F.pandas_udf(function, kind))
