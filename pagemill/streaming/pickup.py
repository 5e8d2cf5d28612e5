"""Incremental pick-up: databases that appear in a folder are read once, by a file stream with a checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.sources import read


FILES = "path string, modificationTime timestamp, length long, content binary"


def follow(spark: SparkSession, folder: str, table: str, out: str, checkpoint: str, **options) -> None:
    """Append the rows of a table in the databases that are new since the last call to a Parquet folder.

    The stream carries the names of new files only; each batch reads them with the
    batch source and replaces what an earlier try of the same batch wrote.
    """
    read.register(spark)
    names = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.{phd,PHD,mod,MOD,tps,TPS,phz,PHZ}").load(folder).select("path")

    def land(batch: DataFrame, number: int) -> None:
        paths = [r["path"] for r in batch.select(F.regexp_replace("path", "^file:/*", "/").alias("path")).distinct().toLocalIterator()]
        if paths:
            read.read_table(spark, ",".join(sorted(paths)), table, **options).write.mode("overwrite").parquet(f"{out}/batch={number}")

    names.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
