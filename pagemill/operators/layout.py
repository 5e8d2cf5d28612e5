"""Slices, portions, names and rates as column functions and small aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def field_slice(body: Column, offset: int, size: int) -> Column:
    """The bytes of a field in a record; fewer where the record ends inside it."""
    return F.substring(body, offset + 1, size)


def is_numeric_text(c: Column) -> Column:
    """Whether a value's text is all digits but for points and minus signs; null is not."""
    return F.coalesce(c.cast("string").rlike(r"^[0-9.\-]*[0-9][0-9.\-]*$"), F.lit(False))


def clean_key(name: Column, prefix: str) -> Column:
    """A key without the prefix that its table's keys share, and without colons."""
    return F.replace(F.when(name.startswith(prefix), F.substr(name, F.lit(len(prefix) + 1))).otherwise(name), F.lit(":"), F.lit(""))


def assemble(df: DataFrame, keys: list[str], portion: str, body: str) -> DataFrame:
    """Portions of each key's text joined in order of their number; portions of equal number in order of their text.

    A group is one definition, of a few portions by the format.
    """
    ordered = F.array_sort(F.collect_list(F.struct(F.col(portion), F.col(body).alias("part"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda p: p["part"]), "").alias("definition"))


def first_of_each(names: Column) -> Column:
    """Names in order, each where it comes first."""
    return F.array_distinct(names)


def field_differences(left: Column, right: Column) -> Column:
    """Names that the right side misses, and names that only it has, each in order."""
    return F.struct(F.array_except(left, right).alias("missing"), F.array_except(right, left).alias("extra"))


def fill_counts(df: DataFrame, column: str, by: str) -> DataFrame:
    """Rows, filled and empty values of a column in each group."""
    c = F.col(column)
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("total"), F.count(c).alias("filled"), F.count_if(c.isNull()).alias("empty"))


def rates(df: DataFrame, by: str, records: str, size: str, seconds: str) -> DataFrame:
    """Records and MB a second and KB a record of each group; null where the divisor is 0 or null."""
    n, b, s = (F.sum(c) for c in (records, size, seconds))
    return df.groupBy(by).agg(
        F.try_divide(n.cast("double"), s).alias("records_per_second"), F.try_divide(b / 1048576, s).alias("mb_per_second"), F.try_divide(b / 1024, n.cast("double")).alias("kb_per_record")
    )
