"""Whole-table orders without one task that holds the table: numbers and running maxima by ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.sinks import store


def ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """The rows sorted within ranges of the order, with __range, the number of the range; written to the shared folder, as ranges come from a sample and must not be made twice."""
    path = store.shared_path(df.sparkSession, "ranged")
    sorted_ = df.repartitionByRange(*[F.col(f"`{c}`") for c in order]).sortWithinPartitions(*[F.col(f"`{c}`") for c in order])
    sorted_.withColumn("__range", F.spark_partition_id()).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def numbered(df: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """The rows with their number, from 1, in the order: counts of the ranges come to the driver, a number for each."""
    rows = ranged(df, order)
    before, offsets = 0, []
    for r in rows.groupBy("__range").agg(F.count(F.lit(1)).alias("n")).orderBy("__range").collect():
        offsets.append((r["__range"], before))
        before += r["n"]
    table = df.sparkSession.createDataFrame(offsets, "__range int, __before long")
    nth = F.row_number().over(Window.partitionBy("__range").orderBy(*[F.col(f"`{c}`") for c in order]))
    return rows.join(F.broadcast(table), "__range").withColumn(name, F.col("__before") + nth).drop("__range", "__before")


def furthest_before(df: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """The rows with the greatest value of those before them in the order, null for the first: a maximum of each range comes to the driver."""
    rows = ranged(df.withColumn("__value", value), order)
    kind = rows.schema["__value"].dataType
    best, offsets = None, []
    for r in rows.groupBy("__range").agg(F.max("__value").alias("m")).orderBy("__range").collect():
        offsets.append((r["__range"], best))
        best = r["m"] if best is None or (r["m"] is not None and tuple(r["m"]) > tuple(best)) else best
    table = df.sparkSession.createDataFrame(offsets, f"__range int, __best {kind.simpleString()}")
    own = F.max("__value").over(Window.partitionBy("__range").orderBy(*[F.col(f"`{c}`") for c in order]).rowsBetween(Window.unboundedPreceding, -1))
    return rows.join(F.broadcast(table), "__range").withColumn(name, F.greatest(F.col("__best"), own)).drop("__range", "__best", "__value")
