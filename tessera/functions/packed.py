"""Small encodings in columns: dotted integers, segments as JSON, byte matrices in base64, the size in a JPEG's header."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SEGMENTS = "array<struct<start:double,end:double,label:string>>"


def dotted(text: Column) -> Column:
    """'1.5.8' as integers; no text as none."""
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<int>")).otherwise(F.transform(F.split(text, r"\."), lambda x: x.cast("int")))


def to_dotted(tokens: Column) -> Column:
    return F.array_join(F.transform(tokens, lambda x: x.cast("string")), ".")


def segments(text: Column) -> Column:
    return F.from_json(text, SEGMENTS)


def parallel(*arrays: Column) -> Column:
    """Arrays in step, cut to the shortest."""
    n = F.least(*map(F.size, arrays)) if len(arrays) > 1 else F.size(arrays[0])
    return F.slice(F.arrays_zip(*arrays), F.lit(1), n)


def byte_rows(text: Column, width: int) -> Column:
    """A base64 matrix of bytes as rows of `width` integers."""
    digits = F.regexp_extract_all(F.hex(F.unbase64(text)), F.lit(".."), 0)
    values = F.transform(digits, lambda d: F.conv(d, 16, 10).cast("int"))
    from tessera.operators.sequences import let

    cut = lambda v: F.when(F.size(v) >= width, F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / width).cast("int") - 1), lambda i: F.slice(v, i * width + 1, F.lit(width)))).otherwise(F.array().cast("array<array<int>>"))
    return let(values, cut)


def jpeg_size(content: Column) -> Column:
    """struct(width, height) from the frame header; null if there is none."""

    def one(data: bytes | None) -> tuple[int | None, int | None]:
        if not data or data[:2] != b"\xff\xd8":
            return None, None
        at = 2
        while at + 9 <= len(data):
            if data[at] != 0xFF:
                return None, None
            kind = data[at + 1]
            if kind == 0xFF or 0xD0 <= kind <= 0xD8 or kind == 1:  # fill, restart and other marks stand alone
                at += 1 if kind == 0xFF else 2
                continue
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                return int.from_bytes(data[at + 7 : at + 9], "big"), int.from_bytes(data[at + 5 : at + 7], "big")
            at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
        return None, None

    @F.pandas_udf("width int, height int")
    def size(data: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(d) for d in data], columns=["width", "height"]).astype("Int32")

    return size(content)
