"""Column functions for the format's values: dates, times, packed numbers, strings, and compact JSON.

All are built-in expressions, but for the two page codings, which are sequential
and run as Arrow batches. Bad values give null and never raise, also under ANSI.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.codec import pages

EPOCH = "1800-12-28"


def day_count(n: Column) -> Column:
    """The date of a day count; 0 is none."""
    return F.when(n != 0, F.date_add(F.lit(EPOCH).cast("date"), n.cast("int")))


def _clock(h: Column, m: Column, s: Column) -> Column:
    return F.format_string("%02d:%02d:%02d", h.cast("int"), m.cast("int"), s.cast("int"))


def centiseconds(n: Column) -> Column:
    """HH:mm:ss.cc of hundredths of a second since midnight."""
    s = F.floor(n / 100)
    return F.when(n.between(0, 8_639_999), F.concat(_clock(F.floor(s / 3600), F.floor(s / 60) % 60, s % 60), F.format_string(".%02d", (n % 100).cast("int"))))


def packed_date(n: Column) -> Column:
    """yyyy-MM-dd of year << 16 | month << 8 | day, if plausible."""
    year, month, day = F.shiftright(n, 16), F.shiftright(n, 8).bitwiseAND(255), n.bitwiseAND(255)
    return F.when((year > 1900) & month.between(1, 12) & day.between(1, 31), F.format_string("%04d-%02d-%02d", year.cast("int"), month.cast("int"), day.cast("int")))


def packed_time(n: Column) -> Column:
    """HH:mm:ss of hour << 24 | minute << 16 | second << 8; 0 is none."""
    byte = lambda k: F.shiftright(n, k).bitwiseAND(255)
    return F.when((n != 0) & (byte(24) < 24) & (byte(16) < 60) & (byte(8) < 60), _clock(byte(24), byte(16), byte(8)))


def digit_date(n: Column) -> Column:
    """yyyy-MM-dd of the digits YYYYMMDD; fewer digits are none."""
    s = n.cast("string")
    return F.when(n >= 10_000_000, F.concat_ws("-", F.substring(s, 1, 4), F.substring(s, 5, 2), F.substring(s, 7, 2)))


def digit_time(n: Column) -> Column:
    """HH:mm:ss of the digits HHMMSS, with leading zeros left out."""
    s = F.lpad(n.cast("string"), 6, "0")
    return F.when(n > 0, F.concat_ws(":", F.substring(s, 1, 2), F.substring(s, 3, 2), F.substring(s, 5, 2)))


def unsigned_le(raw: Column, size: int) -> Column:
    """The unsigned number of little-endian bytes."""
    swapped = F.concat(*[F.substring(raw, i, 1) for i in range(size, 0, -1)])
    return F.conv(F.hex(swapped), 16, 10).cast("long")


def to_unsigned_le(n: Column, size: int) -> Column:
    """The little-endian bytes of an unsigned number."""
    digits = F.lpad(F.hex(n), 2 * size, "0")
    return F.unhex(F.concat(*[F.substring(digits, 2 * i - 1, 2) for i in range(size, 0, -1)]))


def packed_decimal(raw: Column, precision: int, decimals: int) -> Column:
    """The number of packed digits whose first half byte is F for negative."""
    digits = F.hex(raw)
    sign = F.when(F.left(digits, F.lit(1)) == "F", F.lit("-")).otherwise(F.lit(""))
    return (F.concat(sign, F.substring(digits, 2, 2 * 19)).try_cast(f"decimal({precision},0)") / F.lit(10**decimals)).cast(f"decimal({precision},{decimals})")


def to_packed_decimal(value: Column, size: int, decimals: int) -> Column:
    scaled = F.round(value * 10**decimals).cast("long")
    return F.unhex(F.concat(F.when(scaled < 0, F.lit("F")).otherwise(F.lit("0")), F.lpad(F.abs(scaled).cast("string"), 2 * size - 1, "0")))


def cut_at_zero(text: Column) -> Column:
    return F.substring_index(text, "\0", 1)


def clean_text(text: Column) -> Column:
    """Without zero characters at the end; null if nothing is left."""
    return F.nullif(F.rtrim(text, F.lit("\0")), F.lit(""))


def default_text(value: Column, kind: T.DataType) -> Column:
    """A value of a type that a target does not know, as text: bytes in hex, arrays and structs as JSON, others as they print."""
    if isinstance(kind, T.BinaryType):
        return F.lower(F.hex(value))
    return F.to_json(value) if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)) else value.cast("string")


def normal_text(text: Column) -> Column:
    """For comparing: without zero characters at the end and white space around."""
    return F.trim(F.rtrim(text, F.lit("\0")))


def compact_json(raw: Column, table: str) -> Column:
    """A JSON envelope of opaque bytes: base64, size, and the first and last of them by size."""
    n = F.length(raw)
    edge = F.when(n > 2000, 16).when(n > 1000, 8).otherwise(4)
    part = lambda at, size: F.lower(F.hex(F.substring(raw, at, size)))
    return F.to_json(
        F.struct(
            F.base64(raw).alias("data"),
            n.alias("size"),
            F.lit(table).alias("table"),
            F.when(n >= 4, part(F.lit(1), edge)).alias("first"),
            F.when(n > 1000, part(n - edge + 1, edge)).alias("last"),
            F.when(n > 2000, F.crc32(raw)).alias("checksum"),
        )
    )


@F.pandas_udf(T.BinaryType())
def rle_compress(raw: pd.Series) -> pd.Series:
    return raw.map(lambda b: None if b is None else pages.rle_compress(bytes(b)))


@F.pandas_udf(T.BinaryType())
def rle_decompress(raw: pd.Series) -> pd.Series:
    return raw.map(lambda b: None if b is None else pages.rle_decompress(bytes(b)))


@F.pandas_udf(T.ArrayType(T.StringType()))
def delta_round_trip(values: pd.Series) -> pd.Series:
    """Strings of a page, prefix-delta coded and decoded again."""

    def run(items):
        coded = pages.join_records([((x or "").encode(), 4) for x in items])
        return [raw.decode() for raw, _ in pages.split_records(coded, len(items))]

    return values.map(lambda v: None if v is None else run(list(v)))
