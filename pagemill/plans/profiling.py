"""Profile queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagemill.operators import profile as profiles

LINEITEM_TYPES = {
    "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int", "l_quantity": "double",
    "l_extendedprice": "double", "l_discount": "double", "l_tax": "double", "l_returnflag": "string", "l_linestatus": "string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def profile_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.profile(table(spark, sf_dir, "lineitem"), list(LINEITEM_TYPES))


def profile_sql(name: str, types: dict[str, str]) -> str:
    parts = []
    for column, kind in types.items():
        ranges = ["NULL::DOUBLE"] * 6
        if kind == "string":
            ranges[3:] = [f"{f}(length({column})::DOUBLE)" for f in ("min", "max", "avg")]
        else:
            ranges[:3] = [f"{f}({column}::DOUBLE)" for f in ("min", "max", "avg")]
        names = ("min_value", "max_value", "avg_value", "min_length", "max_length", "avg_length")
        parts.append(
            f"SELECT '{column}' AS column_name, '{kind}' AS declared_type, count(*) AS total_count, "
            f"count(*) FILTER (WHERE {column} IS NULL) AS null_count, count(DISTINCT {column}) AS distinct_count, "
            + ", ".join(f"{r} AS {n}" for r, n in zip(ranges, names, strict=True))
            + f" FROM {name}"
        )
    return " UNION ALL ".join(parts)


QUERIES = {"profile_lineitem": profile_lineitem}
ORACLES = {"profile_lineitem": profile_sql("lineitem", LINEITEM_TYPES)}
