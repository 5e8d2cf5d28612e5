"""Queries of slices, portions, names and rates over the driver's tables, each beside its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.operators import layout
from pagemill.plans.profiling import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


@query("SELECT c_custkey, substr(c_name, 4, 6) AS part FROM customer")
def field_slice(spark, d):
    return table(spark, d, "customer").select("c_custkey", layout.field_slice(F.encode("c_name", "UTF-8"), 3, 6).cast("string").alias("part"))


@query(
    r"""SELECT o_orderkey, coalesce(regexp_matches(o_orderpriority, '^[0-9.\-]*[0-9][0-9.\-]*$'), false) AS of_priority,
    coalesce(regexp_matches(left(o_orderpriority, 2), '^[0-9.\-]*[0-9][0-9.\-]*$'), false) AS of_start FROM orders"""
)
def numeric_text(spark, d):
    priority = F.col("o_orderpriority")
    return table(spark, d, "orders").select("o_orderkey", layout.is_numeric_text(priority).alias("of_priority"), layout.is_numeric_text(F.left(priority, F.lit(2))).alias("of_start"))


@query("SELECT p_partkey, replace(CASE WHEN starts_with(k, 'P:') THEN substr(k, 3) ELSE k END, ':', '') AS clean_name FROM (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'P:' ELSE 'Q:' END || p_type AS k FROM part)")
def clean_keys(spark, d):
    key = F.concat(F.when(F.col("p_size") % 2 == 0, "P:").otherwise("Q:"), "p_type")
    return table(spark, d, "part").select("p_partkey", layout.clean_key(key, "P:").alias("clean_name"))


@query("SELECT l_orderkey, string_agg(l_returnflag || l_linestatus, '' ORDER BY l_linenumber, l_returnflag || l_linestatus) AS definition FROM lineitem GROUP BY l_orderkey")
def portions_in_order(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat("l_returnflag", "l_linestatus").alias("body"))
    return layout.assemble(rows, ["l_orderkey"], "l_linenumber", "body")


@query(
    """SELECT p_partkey, array_to_string(list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: list_position(w, x[1]) = x[2]), lambda x: x[1]), ' ') AS names
    FROM (SELECT p_partkey, string_split(p_name || ' ' || p_type || ' ' || p_name, ' ') AS w FROM part)"""
)
def names_once(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(layout.first_of_each(F.split(F.concat_ws(" ", "p_name", "p_type", "p_name"), " ")), " ").alias("names"))


@query(
    """SELECT p_partkey, array_to_string(list_filter(['size', 'type', b], lambda x: NOT list_contains(['size', t, 'name'], x)), ',') AS missing,
    array_to_string(list_filter(['size', t, 'name'], lambda x: NOT list_contains(['size', 'type', b], x)), ',') AS extra FROM (SELECT p_partkey, p_brand AS b, p_type AS t FROM part)"""
)
def field_differences(spark, d):
    left, right = F.array(F.lit("size"), F.lit("type"), "p_brand"), F.array(F.lit("size"), "p_type", F.lit("name"))
    found = table(spark, d, "part").select("p_partkey", layout.field_differences(left, right).alias("d"))
    return found.select("p_partkey", F.array_join("d.missing", ",").alias("missing"), F.array_join("d.extra", ",").alias("extra"))


@query("SELECT event_type, count(*) AS total, count(props) AS filled, count(*) FILTER (WHERE props IS NULL) AS empty FROM events GROUP BY event_type")
def fill_counts(spark, d):
    return layout.fill_counts(table(spark, d, "events"), "props", "event_type")


@query(
    """SELECT o_orderstatus, n / nullif(s, 0) AS records_per_second, b / 1048576 / nullif(s, 0) AS mb_per_second, b / 1024 / nullif(n, 0) AS kb_per_record FROM
    (SELECT o_orderstatus, count(*)::DOUBLE AS n, sum(o_custkey)::DOUBLE AS b, sum(o_orderkey % 7)::DOUBLE AS s FROM orders GROUP BY o_orderstatus)"""
)
def conversion_rates(spark, d):
    rows = table(spark, d, "orders").select("o_orderstatus", F.lit(1).alias("records"), "o_custkey", (F.col("o_orderkey") % 7).alias("seconds"))
    return layout.rates(rows, "o_orderstatus", "records", "o_custkey", "seconds")


@query("SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 100.0 AND c_mktsegment LIKE '%BUILD%'")
def landed_predicates(spark, d):
    return table(spark, d, "customer").where("c_acctbal > 100.0 AND c_mktsegment LIKE '%BUILD%'").select("c_custkey", "c_name")
