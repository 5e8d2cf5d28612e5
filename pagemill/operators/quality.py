"""Reconciling and diffing tables: DataFrames in, DataFrames out, without collecting rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.operators.ordered import furthest_before, numbered
from pagemill.operators.profile import NUMERIC, profile


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name and row_count of each table."""
    return reduce(DataFrame.unionAll, [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count") for name, df in tables.items()])


def reconcile(left: DataFrame, right: DataFrame) -> DataFrame:
    """Row counts of two sets of tables side by side, with what is missing, extra or different."""
    a, b = left.withColumnRenamed("row_count", "left_count"), right.withColumnRenamed("row_count", "right_count")
    status = F.when(F.col("right_count").isNull(), "missing").when(F.col("left_count").isNull(), "extra").when(F.col("left_count") != F.col("right_count"), "different").otherwise("equal")
    return a.join(b, "table_name", "full_outer").withColumn("status", status)


def missing_keys(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Rows of the left whose key the right lacks."""
    return left.join(right.select(F.col(right_key).alias("__key")).distinct(), F.col(left_key) == F.col("__key"), "left_anti")


def full_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows, with repeats, that one side has and the other lacks; ``side`` tells which. One shuffle on the whole row."""
    names = left.columns
    both = left.select("*", F.lit(1).alias("__w")).unionByName(right.select("*", F.lit(-1).alias("__w")))
    surplus = both.groupBy(*names).agg(F.sum("__w").alias("__w")).where("__w <> 0")
    return surplus.select(F.when(F.col("__w") > 0, "left").otherwise("right").alias("side"), *names, F.abs("__w").alias("copies"))


def schema_diff(left: DataFrame, right: DataFrame) -> list[tuple[str, str | None, str | None]]:
    """(column, left type, right type) where the schemas differ."""
    a, b = dict(left.dtypes), dict(right.dtypes)
    return [(c, a.get(c), b.get(c)) for c in {**a, **b} if a.get(c) != b.get(c)]


def as_text(df: DataFrame, column: str) -> Column:
    """A value as comparable text."""
    kind = dict(df.dtypes)[column]
    text = F.to_json(F.col(column)) if kind.startswith(("array", "struct", "map")) else F.hex(F.col(column)) if kind == "binary" else F.col(column).cast("string")
    return F.trim(F.rtrim(text, F.lit("\0")))


def cells(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys, column_name and value of every cell."""
    values = [c for c in df.columns if c not in keys]
    return df.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), as_text(df, c).alias("value")) for c in values])).alias("c")).select(*keys, "c.column_name", "c.value")


def cell_diff(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Cells that differ between rows of one key. Rows are joined once; only differing cells are made rows."""
    values = [c for c in left.columns if c not in keys]
    a = left.select(*keys, F.struct(*[as_text(left, c).alias(c) for c in values]).alias("a"))
    b = right.select(*keys, F.struct(*[as_text(right, c).alias(c) for c in values]).alias("b"))
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"a.`{c}`").alias("left_value"), F.col(f"b.`{c}`").alias("right_value")) for c in values])
    differing = F.filter(pairs, lambda p: ~p["left_value"].eqNullSafe(p["right_value"]))
    return a.join(b, keys).select(*keys, F.explode(differing).alias("d")).select(*keys, "d.*")


def positional_diff(left: DataFrame, right: DataFrame, order: list[str], limit: int | None = 100) -> DataFrame:
    """Cells that differ between the n-th rows of both sides in an order; the first ``limit`` rows, as a sample, or all with None.

    Where both sides have a key, prefer :func:`cell_diff`.
    """

    def placed(df: DataFrame) -> DataFrame:
        if limit is None:
            return numbered(df, order)
        return df.orderBy(*order).limit(limit).withColumn("position", F.row_number().over(Window.orderBy(*order)))

    return cell_diff(placed(left), placed(right), ["position"])


def null_ratio(df: DataFrame, columns: list[str], flag_over: float = 0.5) -> DataFrame:
    """Nulls of each column, and whether their share is over a bound."""
    parts = [F.struct(F.lit(c).alias("column_name"), F.count(F.lit(1)).alias("total_count"), F.count_if(F.col(c).isNull()).alias("null_count")).alias(f"c{i}") for i, c in enumerate(columns)]
    rows = df.agg(*parts).select(F.inline(F.array(*[F.col(f"c{i}") for i in range(len(columns))])))
    return rows.withColumn("mostly_null", F.coalesce(F.col("null_count") / F.nullif(F.col("total_count"), F.lit(0)) > flag_over, F.lit(False)))


def validate(source: dict[str, DataFrame], landed: dict[str, DataFrame], level: str = "comprehensive", keys: dict[str, list[str]] | None = None) -> dict[str, DataFrame]:
    """Check a landing: counts (basic), differing cells by key or differing rows (integrity), profiles (comprehensive)."""
    if level not in ("basic", "integrity", "comprehensive"):
        raise ValueError(f"no validation level {level!r}")
    out = {"counts": reconcile(row_counts(source), row_counts(landed))}
    common = [t for t in source if t in landed]
    if level != "basic":
        for t in common:
            by = (keys or {}).get(t)
            out[f"diff:{t}"] = cell_diff(source[t], landed[t], by) if by else full_diff(source[t], landed[t])
    if level == "comprehensive":
        for t in common:
            out[f"profile:{t}"] = profile(landed[t])
    return out


def shared_tables(catalog: DataFrame, file: str, table: str) -> DataFrame:
    """Tables that more than one file has, with their files."""
    return catalog.groupBy(table).agg(F.array_sort(F.collect_set(file)).alias("files")).where(F.size("files") > 1)


def file_similarity(catalog: DataFrame, file: str, table: str, over: float = 0.5) -> DataFrame:
    """Jaccard similarity of the table names of each pair of files that share one, above a bound.

    A pair above the bound shares one of the rarest names of both: of n names the
    first n - ceil(bound * n) + 1, so only those are joined, and a name that many
    files have makes no pairs among them unless it is all that they have.
    """
    own = catalog.select(F.col(file).alias("f"), F.col(table).alias("t")).distinct()
    common = own.groupBy("t").agg(F.count(F.lit(1)).alias("k"))
    # the names of one file, rarest first
    names = own.join(common, "t").groupBy("f").agg(F.array_sort(F.collect_list(F.struct("k", "t"))).alias("names"))
    names = names.select("f", F.transform("names", lambda x: x["t"]).alias("names"))
    n = F.size("names")
    prefix = names.select("f", F.explode(F.slice("names", 1, n - F.ceil(n * over).cast("int") + 1)).alias("t"))
    a, b = prefix.withColumnRenamed("f", "file_a"), prefix.withColumnRenamed("f", "file_b")
    pairs = a.join(b, "t").where("file_a < file_b").select("file_a", "file_b").distinct()
    both = pairs.join(names.select(F.col("f").alias("file_a"), F.col("names").alias("na")), "file_a").join(names.select(F.col("f").alias("file_b"), F.col("names").alias("nb")), "file_b")
    return both.select("file_a", "file_b", (F.size(F.array_intersect("na", "nb")) / F.size(F.array_union("na", "nb"))).alias("similarity")).where(F.col("similarity") > over)


def overlaps(spans: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Adjacent pairs of a sweep: each span that begins before the furthest end so far, with that end. Linear, for any nesting, and by ranges of the order."""
    reach = furthest_before(spans, [start, end, key], F.struct(F.col(end).alias("end"), F.col(key).alias("key")), "reach")
    return reach.where(F.col(start) < F.col("reach.end")).select(F.col(key), F.col("reach.key").alias("overlapped"))


def overlap_pairs(spans: DataFrame, key: str, start: str, end: str, width: int) -> DataFrame:
    """All pairs of overlapping spans of whole numbers, by buckets of a width: an equi-join, each pair once."""
    cells_ = spans.select(F.col(key).alias("k"), F.col(start).alias("s"), F.col(end).alias("e"), F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))).alias("cell")).where("s < e")
    a, b = (cells_.select("cell", *[F.col(c).alias(f"{c}_{side}") for c in ("k", "s", "e")]) for side in "ab")
    first = F.col("cell") == F.floor(F.greatest("s_a", "s_b") / width)
    return a.join(b, "cell").where((F.col("k_a") < F.col("k_b")) & (F.col("s_a") < F.col("e_b")) & (F.col("s_b") < F.col("e_a")) & first).select("k_a", "k_b")


def checksums(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, row_count and a checksum of the rows of each table, the same in whatever order and partitions they come."""

    def one(name: str, df: DataFrame) -> DataFrame:
        total = F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("decimal(20,0)"))
        return df.agg(F.count(F.lit(1)).alias("row_count"), F.coalesce(total, F.lit(0)).cast("decimal(38,0)").alias("checksum")).select(F.lit(name).alias("table_name"), "row_count", "checksum")

    return reduce(DataFrame.unionAll, [one(name, df) for name, df in tables.items()])


def violations(df: DataFrame, unique: list[str] = (), required: list[str] = (), rules: dict[str, str] | None = None) -> DataFrame:
    """rule and n: rows beyond the first of a repeated key, nulls in required columns, and rows that break a rule, a SQL condition; null conditions are not broken."""
    parts = []
    if unique:
        repeats = df.groupBy(*[F.col(f"`{c}`") for c in unique]).agg(F.count(F.lit(1)).alias("__n"))
        parts.append(repeats.agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("n")).select(F.lit(f"unique {', '.join(unique)}").alias("rule"), "n"))
    checks = [(f"required {c}", F.col(f"`{c}`").isNull()) for c in required] + [(name, ~F.expr(rule)) for name, rule in (rules or {}).items()]
    if checks:
        counted = df.agg(*[F.struct(F.lit(name).alias("rule"), F.count_if(F.coalesce(broken, F.lit(False))).alias("n")).alias(f"c{i}") for i, (name, broken) in enumerate(checks)])
        parts.append(counted.select(F.inline(F.array(*[F.col(f"c{i}") for i in range(len(checks))]))))
    if not parts:
        return df.sparkSession.createDataFrame([], "rule string, n long")
    return reduce(DataFrame.unionAll, parts)


def anomalies(df: DataFrame, columns: list[str], deviations: float = 3.0) -> DataFrame:
    """column_name, low, high and n: how many values lie further from the mean than so many standard deviations. Means and deviations are pre-aggregated and joined as one row."""
    stats = df.agg(*[f(F.col(f"`{c}`")).alias(f"{k}{i}") for i, c in enumerate(columns) for k, f in (("m", F.avg), ("s", F.stddev_pop))])
    bounds = [(f"m{i}", f"s{i}") for i in range(len(columns))]
    row = stats.first()
    parts = []
    for c, (m, s) in zip(columns, bounds, strict=True):
        mean, spread = row[m], row[s]
        low, high = (None, None) if mean is None else (mean - deviations * spread, mean + deviations * spread)
        outside = F.lit(False) if mean is None else ~F.col(f"`{c}`").between(F.lit(low), F.lit(high))
        parts.append(F.struct(F.lit(c).alias("column_name"), F.lit(low).cast("double").alias("low"), F.lit(high).cast("double").alias("high"), F.count_if(F.coalesce(outside, F.lit(False))).alias("n")))
    return df.agg(*[p.alias(f"c{i}") for i, p in enumerate(parts)]).select(F.inline(F.array(*[F.col(f"c{i}") for i in range(len(parts))])))


def distribution(df: DataFrame, columns: list[str], shares: tuple[float, ...] = (0.0, 0.25, 0.5, 0.75, 1.0), accuracy: int = 100_000) -> DataFrame:
    """column_name, share and value: quantiles of each column, from a sketch of fixed size, exact up to 1 / accuracy of the rows."""
    quantiles = [F.percentile_approx(F.col(f"`{c}`").cast("double"), list(shares), accuracy).alias(f"q{i}") for i, c in enumerate(columns)]

    def named(column: str) -> Callable[[Column], Column]:
        return lambda x: F.struct(F.lit(column).alias("column_name"), x["share"].alias("share"), x["value"].alias("value"))

    share = F.array(*map(F.lit, shares)).alias("share")
    pairs = F.flatten(F.array(*[F.transform(F.arrays_zip(share, F.col(f"q{i}").alias("value")), named(c)) for i, c in enumerate(columns)]))
    return df.agg(*quantiles).select(F.inline(pairs))


def common_fields(fields: DataFrame, table: str = "table_name", field: str = "field_name") -> DataFrame:
    """table_a, table_b and their common fields, for each pair of tables that share one. Pairs come from the names that tables share."""
    own = fields.select(F.col(table).alias("t"), F.col(field).alias("f")).distinct()
    a, b = own.withColumnRenamed("t", "table_a"), own.withColumnRenamed("t", "table_b")
    return a.join(b, "f").where("table_a < table_b").groupBy("table_a", "table_b").agg(F.array_sort(F.collect_set("f")).alias("common_fields"))


def relations(catalog: DataFrame, fields: DataFrame, over: float = 0.5) -> dict[str, DataFrame]:
    """How files hang together: tables that several files have, files with similar tables, and tables with common fields."""
    return {
        "table_overlaps": shared_tables(catalog, "source_file", "table_name"),
        "schema_similarities": file_similarity(catalog, "source_file", "table_name", over),
        "data_relationships": common_fields(fields),
    }


def check_values(df: DataFrame, keys: list[str] = (), required: list[str] = (), rules: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """All checks of one table's values: checksum, nulls, broken rules, values far from the mean, distribution."""
    numbers = [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC) and f.name not in keys]
    out = {"data_checksums": checksums({"table": df}), "null_value_analysis": null_ratio(df, df.columns), "constraint_violations": violations(df, list(keys), list(required), rules)}
    if numbers:
        out |= {"anomaly_detection": anomalies(df, numbers), "data_distribution": distribution(df, numbers)}
    return out
