"""Queries through the binary format: a table of the driver is written as database files, read back, landed or reversed, and must be what it was."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.codec.types import FieldDef, IndexDef, MemoDef, TableDef
from pagemill.functions import decode
from pagemill.operators import ddl, errors, ordered, quality
from pagemill.plans.profiling import table
from pagemill.sinks import landing, store
from pagemill.sources import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


ORDERS = "SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus, o_orderdate::DATE AS o_orderdate, o_orderpriority FROM orders"


def _orders(spark: SparkSession, d: str) -> DataFrame:
    keys = [F.col(c).cast("int").alias(c) for c in ("o_orderkey", "o_custkey")]
    return table(spark, d, "orders").select(*keys, "o_totalprice", "o_orderstatus", F.col("o_orderdate").cast("date").alias("o_orderdate"), "o_orderpriority")


def _wide(df: DataFrame, *keys: str) -> DataFrame:
    """The keys as bigint again."""
    return df.select(*[F.col(c).cast("bigint").alias(c) if c in keys else F.col(c) for c in df.columns])


def _customers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").cast("int").alias("c_custkey"), "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


def _nations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")


def _files(spark: SparkSession, df: DataFrame, name: str, **options) -> str:
    folder = store.shared_path(spark, f"tps-{name.lower()}")
    landing.write_parts(df, folder, name, rows_per_file=5_000, **options)
    return folder


@query(ORDERS)
def tps_scan(spark, d):
    return _wide(read.read_table(spark, _files(spark, _orders(spark, d), "ORDERS"), "orders"), "o_orderkey", "o_custkey")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def tps_encrypted(spark, d):
    folder = _files(spark, _orders(spark, d), "ORDERS", password="pass word")
    some = read.read_table(spark, folder, "ORDERS", password="pass word", columns="o_orderkey,o_totalprice,o_orderstatus")
    return _wide(some.where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice"), "o_orderkey")


@query("SELECT c_custkey, [c_acctbal, c_acctbal * 2, c_nationkey::DOUBLE][2] AS second, 3::BIGINT AS n, [c_acctbal, c_acctbal * 2][1] AS first FROM customer WHERE c_acctbal * 2 > 1000.0")
def tps_arrays(spark, d):
    values = F.array("c_acctbal", F.col("c_acctbal") * 2, F.col("c_nationkey").cast("double"))
    made = table(spark, d, "customer").select(F.col("c_custkey").cast("int").alias("c_custkey"), values.alias("PROD")).withMetadata("PROD", {"elements": 3})
    read.read_table(spark, _files(spark, made, "MONHIST"), "MONHIST").createOrReplaceTempView("pagemill_monhist")
    return spark.sql("SELECT CAST(c_custkey AS bigint) AS c_custkey, PROD[1] AS second, CAST(size(PROD) AS bigint) AS n, PROD[0] AS first FROM pagemill_monhist WHERE PROD[1] > 1000.0")


@query("SELECT p_partkey, [p_size, p_size * 2, p_size * 3]::VARCHAR AS sizes FROM part")
def tps_array_fields(spark, d):
    size = F.col("p_size")
    made = table(spark, d, "part").select(F.col("p_partkey").cast("int").alias("p_partkey"), size.alias("SZE1"), (size * 2).alias("SZE2"), (size * 3).alias("SZE3"))
    got = read.read_table(spark, _files(spark, made, "PARTS"), "PARTS")  # three like fields side by side are one array
    return _wide(got, "p_partkey").select("p_partkey", F.concat(F.lit("["), F.array_join("SZE", ", "), F.lit("]")).alias("sizes"))


@query("SELECT item_id, repeat(text, 4) AS note FROM benchmark")
def tps_memos(spark, d):
    made = table(spark, d, "benchmark").select(F.col("item_id").cast("int").alias("item_id"), F.repeat("text", F.lit(4)).alias("note"))
    got = read.read_table(spark, _files(spark, made, "NOTES", encoding="utf-8"), "NOTES", encoding="utf-8")
    return _wide(got, "item_id").select("item_id", "note")


@query("SELECT * FROM (SELECT 'CUSTOMERS' AS table_name, count(*) AS n_rows, 5::BIGINT AS n_fields FROM customer) UNION ALL SELECT 'NATIONS', count(*), 3::BIGINT FROM nation")
def tps_catalog(spark, d):
    folders = [_files(spark, _customers(spark, d), "CUSTOMERS"), _files(spark, _nations(spark, d), "NATIONS")]
    found = read.catalog(spark, ",".join(folders))
    return found.groupBy("table_name").agg(F.sum("stated_rows").alias("n_rows"), F.max("n_fields").cast("bigint").alias("n_fields"))


@query("SELECT level, sum(n)::BIGINT AS n_rows FROM (SELECT unnest(['all', 'file', 'table']) AS level, count(*) AS n FROM nation) GROUP BY level")
def catalog_totals(spark, d):
    totals = read.catalog_totals(read.catalog(spark, _files(spark, _nations(spark, d), "NATIONS")))
    level = F.when(F.col("source_file").isNull(), "all").when(F.col("table_name").isNull(), "file").otherwise("table")
    return totals.groupBy(level.alias("level")).agg(F.sum("n_rows").alias("n_rows"))


@query("SELECT 'DATA' AS kind, count(*) AS n, 0::BIGINT AS damaged, 0::BIGINT AS warnings FROM customer")
def tps_raw(spark, d):
    folder = _files(spark, _customers(spark, d), "CUSTOMERS")
    read.register(spark)
    raw = spark.read.format("tps").load(folder).where("kind = 'DATA'").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    damaged = read.damage(spark, folder, "CUSTOMERS").agg(F.count(F.lit(1)).alias("damaged"))
    warnings = read.page_warnings(spark, folder).agg(F.count(F.lit(1)).alias("warnings"))
    return raw.join(F.broadcast(damaged.withColumn("kind", F.lit("DATA"))), "kind").join(F.broadcast(warnings.withColumn("kind", F.lit("DATA"))), "kind")


@query(ORDERS)
def tps_landing(spark, d):
    out = store.shared_path(spark, "landed")
    landing.land(spark, _files(spark, _orders(spark, d), "ORDERS"), out, mode="PERMISSIVE")
    return _wide(spark.read.parquet(f"{out}/ORDERS").drop("_source_file"), "o_orderkey", "o_custkey")


@query("SELECT * FROM (SELECT 'file_1_NATIONS' AS table_name, count(*) AS n_rows FROM nation) UNION ALL SELECT 'file_2_CUSTOMERS', count(*) FROM customer")
def tps_merge(spark, d):
    out, folder = store.shared_path(spark, "merged"), store.shared_path(spark, "tps-two")
    local = folder.removeprefix("file://").removeprefix("file:")
    landing.write_database({"NATIONS": _nations(spark, d)}, f"{local}/a.tps")
    landing.write_database({"CUSTOMERS": _customers(spark, d)}, f"{local}/b.tps")
    done = landing.land(spark, f"{folder}/a.tps,{folder}/b.tps", out, strategy="prefix", threads=2)
    return quality.row_counts({name: spark.read.parquet(f"{out}/{name}") for name in done.tables}).withColumnRenamed("row_count", "n_rows")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def tps_reverse(spark, d):
    path = store.shared_path(spark, "reversed").removeprefix("file://").removeprefix("file:") + "/nations.phd"
    landing.write_database({"NATIONS": _nations(spark, d)}, path)
    return read.read_table(spark, path, "NATIONS")


@query("SELECT 'c_custkey,c_name,c_nationkey,c_acctbal,c_mktsegment' AS columns, 0::BIGINT AS n_rows")
def schema_only(spark, d):
    out = store.shared_path(spark, "schemas")
    landing.land(spark, _files(spark, _customers(spark, d), "CUSTOMERS"), out, schema_only=True)
    made = spark.read.parquet(f"{out}/CUSTOMERS").drop("_source_file")
    return made.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(",".join(made.columns)).alias("columns"), "n_rows")


@query("SELECT count(*) AS estimated_records, 'small' AS recommendation, 100::BIGINT AS optimal_batch_size FROM nation")
def size_estimate(spark, d):
    found = read.estimate(_files(spark, _nations(spark, d), "NATIONS"), "NATIONS")
    return spark.createDataFrame([(found["estimated_records"], found["recommendation"], found["optimal_batch_size"])], "estimated_records long, recommendation string, optimal_batch_size long")


INDEXED = TableDef(
    1, "Order", 20, (FieldDef("ORD:ID", "LONG", 0, 4), FieldDef("ORD:NAME", "STRING", 4, 8), FieldDef("ORD:SUM", "DOUBLE", 12, 8)),
    (MemoDef("NOTE", 0),), (IndexDef("ORD:BY-NAME", ((1, False), (0, True), (9, False)), unique=True), IndexDef("ORD:NONE", ((7, False),))),
)


@query(
    """SELECT * FROM (VALUES (0::BIGINT, 'CREATE TABLE Order_TABLE (ID INTEGER, NAME TEXT, SUM REAL, NOTE BLOB);'), (1::BIGINT, 'CREATE INDEX Order_TABLE_BY_NAME ON Order_TABLE (NAME, ID);'),
    (2::BIGINT, 'CREATE UNIQUE INDEX Order_TABLE_BY_NAME ON Order_TABLE (NAME, ID DESC);')) AS t(place, statement)"""
)
def index_ddl(spark, d):
    lines = ddl.script([INDEXED]).splitlines() + [ddl.create_index(INDEXED.indexes[0], INDEXED, faithful=True)]
    return spark.createDataFrame(list(enumerate(lines)), "place long, statement string")


@query("SELECT event_type, priority, count(*) AS n FROM (SELECT event_type, user_id % 4 AS priority FROM events) GROUP BY GROUPING SETS ((event_type), (priority))")
def error_summary(spark, d):
    return errors.summary(table(spark, d, "events").select("event_type", (F.col("user_id") % 4).alias("priority")), "event_type", "priority")


@query("SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 10")
def last_errors(spark, d):
    return errors.last(table(spark, d, "events").select("event_id", "event_type"), "event_id", 10)


@query(
    """SELECT 'unique l_orderkey' AS rule, count(*) - count(DISTINCT l_orderkey) AS n FROM lineitem
    UNION ALL SELECT 'required l_tax', count(*) FILTER (WHERE l_tax IS NULL) FROM lineitem
    UNION ALL SELECT 'cheap', count(*) FILTER (WHERE NOT (l_extendedprice < 50000)) FROM lineitem"""
)
def constraint_violations(spark, d):
    return quality.violations(table(spark, d, "lineitem"), ["l_orderkey"], ["l_tax"], {"cheap": "l_extendedprice < 50000"})


@query(
    """SELECT 'o_totalprice' AS column_name, round(m - 1.5 * s, 2) AS low, round(m + 1.5 * s, 2) AS high, (SELECT count(*) FROM orders WHERE o_totalprice NOT BETWEEN m - 1.5 * s AND m + 1.5 * s) AS n
    FROM (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM orders)"""
)
def value_anomalies(spark, d):
    found = quality.anomalies(table(spark, d, "orders"), ["o_totalprice"], 1.5)
    return found.select("column_name", F.round("low", 2).alias("low"), F.round("high", 2).alias("high"), "n")


@query(" UNION ALL ".join(f"SELECT 'l_quantity' AS column_name, {s}::DOUBLE AS share, quantile_disc(l_quantity, {s}) AS value FROM lineitem" for s in (0.0, 0.5, 1.0)))
def value_distribution(spark, d):
    return quality.distribution(table(spark, d, "lineitem"), ["l_quantity"], (0.0, 0.5, 1.0))


@query("SELECT count(*) AS row_count, true AS same FROM customer")
def data_checksums(spark, d):
    source = _customers(spark, d)
    back = read.read_table(spark, _files(spark, source, "CUSTOMERS"), "CUSTOMERS")
    sums = quality.checksums({"source": source, "landed": back})
    return sums.agg(F.max("row_count").alias("row_count"), ((F.min("checksum") == F.max("checksum")) & (F.min("row_count") == F.max("row_count"))).alias("same"))


@query(
    """SELECT a.t AS table_a, b.t AS table_b, string_agg(a.f, ',' ORDER BY a.f) AS fields FROM (SELECT DISTINCT event_type AS t, (user_id % 20)::VARCHAR AS f FROM events) a
    JOIN (SELECT DISTINCT event_type AS t, (user_id % 20)::VARCHAR AS f FROM events) b ON a.f = b.f AND a.t < b.t GROUP BY 1, 2"""
)
def common_fields(spark, d):
    fields = table(spark, d, "events").select(F.col("event_type").alias("table_name"), (F.col("user_id") % 20).cast("string").alias("field_name"))
    return quality.common_fields(fields).select("table_a", "table_b", F.array_join("common_fields", ",").alias("fields"))


@query("SELECT c_custkey, lower(hex(encode(c_name))) AS bytes, '[' || c_nationkey || ',' || c_nationkey || ']' AS list, c_nationkey::VARCHAR AS plain FROM customer")
def default_text(spark, d):
    made = table(spark, d, "customer").select("c_custkey", F.encode("c_name", "UTF-8").alias("bytes"), F.array("c_nationkey", "c_nationkey").alias("list"), F.col("c_nationkey").alias("plain"))
    return made.select("c_custkey", *[decode.default_text(F.col(f.name), f.dataType).alias(f.name) for f in made.schema.fields[1:]])


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS place FROM orders")
def positions(spark, d):
    return ordered.numbered(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], "place").select("o_orderkey", "place")


@query("SELECT p_partkey, p_name AS normal FROM part")
def compare_normal(spark, d):
    return table(spark, d, "part").select("p_partkey", decode.normal_text(F.concat(F.lit(" "), F.col("p_name"), F.lit(" \0"))).alias("normal"))
