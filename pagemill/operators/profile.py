"""Column profiles: one aggregation for all columns of a table and one for each distinct count, then an unpivot."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def profile(df: DataFrame, columns: list[str] | None = None, approximate: bool = False) -> DataFrame:
    """Return one row per column: counts, distinct values, and ranges.

    Numeric columns get min, max and mean; text columns get those of their
    lengths. ``approximate`` swaps the exact distinct count, which shuffles
    the values of each task once, for a sketch of fixed size; use it beyond a few
    billion rows. Exact counts group one column each: in one aggregation every row
    would be multiplied by the columns, and every value carry all columns and ranges.
    Nulls count in ``null_count`` only. An empty table gives zero counts and
    null ranges.
    """
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    aggs, null = [], F.lit(None).cast("double")
    for i, field in enumerate(fields):
        col = F.col(f"`{field.name}`")
        numeric, text = isinstance(field.dataType, NUMERIC), isinstance(field.dataType, T.StringType)
        value = col.cast("double") if numeric else F.length(col).cast("double")
        ranged = numeric or text
        aggs.append(
            F.struct(
                F.lit(i).alias("place"),
                F.lit(field.name).alias("column_name"),
                F.lit(field.dataType.simpleString()).alias("declared_type"),
                F.count(F.lit(1)).alias("total_count"),
                F.count_if(col.isNull()).alias("null_count"),
                (F.approx_count_distinct(col) if approximate else F.lit(0).cast("bigint")).alias("distinct_count"),
                (F.min(value) if numeric else null).alias("min_value"),
                (F.max(value) if numeric else null).alias("max_value"),
                (F.avg(value) if numeric else null).alias("avg_value"),
                (F.min(value) if ranged and text else null).alias("min_length"),
                (F.max(value) if ranged and text else null).alias("max_length"),
                (F.avg(value) if ranged and text else null).alias("avg_length"),
            ).alias(f"c{i}")
        )
    made = df.agg(*aggs).select(F.inline(F.array(*[F.col(f"c{i}") for i in range(len(fields))])))
    if approximate:
        return made.drop("place")
    groups = [df.select(F.col(f"`{f.name}`").alias("v")).where("v IS NOT NULL").distinct().agg(F.count(F.lit(1)).alias("n")).select(F.lit(i).alias("place"), "n") for i, f in enumerate(fields)]
    counts = reduce(DataFrame.union, groups)
    names = [c for c in made.columns if c != "place"]
    return made.join(F.broadcast(counts), "place", "left").select(*[F.coalesce("n", F.lit(0).cast("bigint")).alias(c) if c == "distinct_count" else c for c in names])
