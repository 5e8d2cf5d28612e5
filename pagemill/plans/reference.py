"""Queries over the driver's tables, one for each operator, each beside its oracle in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import decode
from pagemill.operators import naming, quality, sizing
from pagemill.operators.profile import profile
from pagemill.plans.profiling import profile_sql, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


COUNTED = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in COUNTED))
def row_counts(spark, d):
    return quality.row_counts({t: table(spark, d, t) for t in COUNTED})


ORDER_TEXT = {"o_orderstatus": "string", "o_orderpriority": "string"}


@query(profile_sql("orders", ORDER_TEXT))
def profile_orders_text(spark, d):
    return profile(table(spark, d, "orders"), list(ORDER_TEXT))


@query(
    """SELECT column_name, total_count, null_count, coalesce(null_count / nullif(total_count, 0) > 0.5, false) AS mostly_null FROM (
    SELECT 'value' AS column_name, count(*) AS total_count, count(*) FILTER (WHERE value IS NULL) AS null_count FROM events
    UNION ALL SELECT 'props', count(*), count(*) FILTER (WHERE props IS NULL) FROM events)"""
)
def null_ratio_events(spark, d):
    return quality.null_ratio(table(spark, d, "events"), ["value", "props"])


@query(
    """SELECT 'orders' AS table_name, a.n AS left_count, b.n AS right_count, CASE WHEN a.n <> b.n THEN 'different' ELSE 'equal' END AS status
    FROM (SELECT count(*) AS n FROM orders) a, (SELECT count(DISTINCT l_orderkey) AS n FROM lineitem) b"""
)
def count_reconcile(spark, d):
    seen = table(spark, d, "lineitem").agg(F.count_distinct("l_orderkey").alias("row_count")).select(F.lit("orders").alias("table_name"), "row_count")
    return quality.reconcile(quality.row_counts({"orders": table(spark, d, "orders")}), seen)


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def missing_keys(spark, d):
    return quality.missing_keys(table(spark, d, "customer"), table(spark, d, "orders"), "c_custkey", "o_custkey").select("c_custkey", "c_name")


@query("SELECT c_nationkey AS nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def common_keys(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("nationkey")).intersect(table(spark, d, "supplier").select("s_nationkey"))


def _changed(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    return part, part.where("p_partkey % 97 <> 0").withColumn("p_size", F.when(F.col("p_partkey") % 50 == 1, F.col("p_size") + 1).otherwise(F.col("p_size")))


CHANGED = "a AS (SELECT p_partkey, p_brand, p_size FROM part), b AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 50 = 1 THEN p_size + 1 ELSE p_size END AS p_size FROM part WHERE p_partkey % 97 <> 0)"


@query(
    f"""WITH {CHANGED} SELECT side, p_partkey, p_brand, p_size, count(*) AS copies FROM (
    SELECT 'left' AS side, * FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT 'right', * FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) GROUP BY ALL"""
)
def full_diff(spark, d):
    return quality.full_diff(*_changed(spark, d))


@query(f"WITH {CHANGED} SELECT a.p_partkey, 'p_size' AS column_name, a.p_size::VARCHAR AS left_value, b.p_size::VARCHAR AS right_value FROM a JOIN b USING (p_partkey) WHERE a.p_size IS DISTINCT FROM b.p_size")
def cell_diff(spark, d):
    return quality.cell_diff(*_changed(spark, d), ["p_partkey"])


@query(
    f"""WITH {CHANGED}, x AS (SELECT row_number() OVER (ORDER BY p_partkey) AS position, * FROM a QUALIFY position <= 100), y AS (SELECT row_number() OVER (ORDER BY p_partkey) AS position, * FROM b QUALIFY position <= 100)
    SELECT position, c AS column_name, l AS left_value, r AS right_value FROM (
      SELECT position, 'p_partkey' AS c, x.p_partkey::VARCHAR AS l, y.p_partkey::VARCHAR AS r FROM x JOIN y USING (position)
      UNION ALL SELECT position, 'p_brand', x.p_brand, y.p_brand FROM x JOIN y USING (position)
      UNION ALL SELECT position, 'p_size', x.p_size::VARCHAR, y.p_size::VARCHAR FROM x JOIN y USING (position)) WHERE l IS DISTINCT FROM r"""
)
def positional_diff(spark, d):
    return quality.positional_diff(*_changed(spark, d), ["p_partkey"])


@query("SELECT 'customer' AS source_table, c_name AS name, c_acctbal AS acctbal, c_mktsegment AS segment FROM customer UNION ALL SELECT 'supplier', s_name, s_acctbal, NULL FROM supplier")
def union_files(spark, d):
    a = table(spark, d, "customer").select(F.lit("customer").alias("source_table"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("acctbal"), F.col("c_mktsegment").alias("segment"))
    b = table(spark, d, "supplier").select(F.lit("supplier").alias("source_table"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("acctbal"))
    return a.unionByName(b, allowMissingColumns=True)


@query("SELECT n_nationkey, 'file_' || n_regionkey || '_' || n_name AS by_file, 'db_' || n_regionkey || '_' || n_name AS by_database, n_name AS own, CASE n_regionkey WHEN 0 THEN 'phd_' WHEN 1 THEN 'mod_' WHEN 2 THEN 'tps_' ELSE 'file_' || n_nationkey || '_' END AS file_prefix FROM nation")
def merge_names(spark, d):
    t, n = F.col("n_name"), F.col("n_regionkey")
    path = F.concat(F.lit("/data/x."), F.element_at(F.array(*map(F.lit, ("PHD", "mod", "tps", "dat", "bin"))), n + 1))
    named = {"by_file": naming.merged_expr(t, n, "prefix"), "by_database": naming.merged_expr(t, n, "namespace"), "own": naming.merged_expr(t, n, "separate"), "file_prefix": naming.prefix_expr(path, F.col("n_nationkey"))}
    return table(spark, d, "nation").select("n_nationkey", *[c.alias(a) for a, c in named.items()])


@query("SELECT p_brand, array_to_string(list_sort(list(DISTINCT p_type)), ',') AS files FROM part GROUP BY 1 HAVING count(DISTINCT p_type) > 1")
def table_overlap(spark, d):
    return quality.shared_tables(table(spark, d, "part"), "p_type", "p_brand").select("p_brand", F.array_join("files", ",").alias("files"))


@query(
    """WITH o AS (SELECT DISTINCT p_brand AS f, p_size AS t FROM part), n AS (SELECT f, count(*) AS n FROM o GROUP BY 1)
    SELECT a.f AS file_a, b.f AS file_b, count(*) / (any_value(x.n) + any_value(y.n) - count(*)) AS similarity FROM o a JOIN o b ON a.t = b.t AND a.f < b.f JOIN n x ON x.f = a.f JOIN n y ON y.f = b.f GROUP BY 1, 2 HAVING similarity > 0.5"""
)
def jaccard(spark, d):
    return quality.file_similarity(table(spark, d, "part"), "p_brand", "p_size")


SPANS = "s AS (SELECT p_partkey AS k, p_partkey * 100 AS a, p_partkey * 100 + p_size * 6 AS b FROM part)"


@query(f"WITH {SPANS} SELECT x.k AS k_a, y.k AS k_b FROM s x JOIN s y ON x.k < y.k AND x.a < y.b AND y.a < x.b")
def page_overlap(spark, d):
    spans = table(spark, d, "part").select(F.col("p_partkey").alias("k"), (F.col("p_partkey") * 100).alias("a"), (F.col("p_partkey") * 100 + F.col("p_size") * 6).alias("b"))
    return quality.overlap_pairs(spans, "k", "a", "b", 300)


@query("SELECT l_orderkey, l_linenumber, CASE WHEN n <> 0 THEN DATE '1800-12-28' + n END AS day FROM (SELECT l_orderkey, l_linenumber, ((l_orderkey * 7 + l_linenumber) % 90000)::INT AS n FROM lineitem)")
def clarion_date(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", decode.day_count((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 90000).alias("day"))


@query("SELECT event_id, printf('%02d:%02d:%02d.%02d', (n // 360000)::INT, (n // 6000 % 60)::INT, (n // 100 % 60)::INT, (n % 100)::INT) AS t FROM (SELECT event_id, event_id * 7919 % 8640000 AS n FROM events)")
def clarion_time(spark, d):
    return table(spark, d, "events").select("event_id", decode.centiseconds(F.col("event_id") * 7919 % 8640000).alias("t"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def hex_date(spark, d):
    o = F.col("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", decode.packed_date(F.shiftleft(F.year(o), 16) + F.shiftleft(F.month(o), 8) + F.dayofmonth(o)).alias("day"))


@query("SELECT event_id, CASE WHEN extract(hour FROM ts) + extract(minute FROM ts) + extract(second FROM ts) > 0 THEN strftime(ts, '%H:%M:%S') END AS t FROM events")
def hex_time(spark, d):
    t = F.col("ts")
    return table(spark, d, "events").select("event_id", decode.packed_time(F.shiftleft(F.hour(t).cast("long"), 24) + F.shiftleft(F.minute(t), 16) + F.shiftleft(F.second(t), 8)).alias("t"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def digit_date(spark, d):
    return table(spark, d, "orders").select("o_orderkey", decode.digit_date(F.date_format("o_orderdate", "yyyyMMdd").cast("int")).alias("day"))


@query("SELECT event_id, CASE WHEN strftime(ts, '%H%M%S') <> '000000' THEN strftime(ts, '%H:%M:%S') END AS t FROM events")
def digit_time(spark, d):
    return table(spark, d, "events").select("event_id", decode.digit_time(F.date_format("ts", "HHmmss").cast("int")).alias("t"))


@query("SELECT o_orderkey, o_orderkey AS decoded FROM orders")
def le_int_roundtrip(spark, d):
    return table(spark, d, "orders").select("o_orderkey", decode.unsigned_le(decode.to_unsigned_le(F.col("o_orderkey"), 4), 4).alias("decoded"))


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice, 2)::DOUBLE AS decoded FROM lineitem")
def bcd_roundtrip(spark, d):
    packed = decode.to_packed_decimal(F.col("l_extendedprice"), 8, 2)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", decode.packed_decimal(packed, 15, 2).cast("double").alias("decoded"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice AS decoded FROM lineitem")
def double_roundtrip(spark, d):
    @F.pandas_udf("binary")
    def pack(v: pd.Series) -> pd.Series:
        return pd.Series([x.tobytes() for x in v.to_numpy(dtype="<f8")])

    @F.pandas_udf("double")
    def unpack(v: pd.Series) -> pd.Series:
        return pd.Series(np.frombuffer(b"".join(v), dtype="<f8"))

    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", unpack(pack("l_extendedprice")).alias("decoded"))


@query("SELECT doc_id, strlen(text) AS n_bytes, true AS same FROM documents")
def rle_roundtrip(spark, d):
    raw = F.col("text").cast("binary")
    return table(spark, d, "documents").select("doc_id", raw.alias("raw"), decode.rle_decompress(decode.rle_compress(raw)).alias("back")).select("doc_id", F.octet_length("back").cast("long").alias("n_bytes"), (F.col("raw") == F.col("back")).alias("same"))


@query("SELECT c_custkey, c_name FROM customer")
def delta_roundtrip(spark, d):
    # a page is a bounded group of keys that follow each other
    by_page = table(spark, d, "customer").groupBy(F.floor(F.col("c_custkey") / 64).alias("page")).agg(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name"))).alias("rows"))
    back = by_page.select("rows", decode.delta_round_trip(F.col("rows.c_name")).alias("names"))
    return back.select(F.explode(F.arrays_zip(F.col("rows.c_custkey").alias("k"), F.col("names").alias("v"))).alias("r")).select(F.col("r.k").alias("c_custkey"), F.col("r.v").alias("c_name"))


@query("SELECT p_partkey, p_name AS cut, p_name AS cleaned, NULLIF('', '') AS emptied FROM part")
def cstring_cut(spark, d):
    padded = F.concat(F.col("p_name"), F.lit("\0\0\0"))
    return table(spark, d, "part").select("p_partkey", decode.cut_at_zero(F.concat(padded, F.lit("rest"))).alias("cut"), decode.clean_text(padded).alias("cleaned"), decode.clean_text(F.lit("\0\0")).alias("emptied"))


@query("SELECT p_partkey, TRY_CAST(p_brand AS BIGINT) AS as_int, TRY_CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS DOUBLE) AS as_float FROM part")
def safe_cast(spark, d):
    return table(spark, d, "part").select("p_partkey", F.col("p_brand").try_cast("bigint").alias("as_int"), F.regexp_extract("p_brand", "([0-9]+)", 1).try_cast("double").alias("as_float"))


@query("SELECT p_partkey, left(regexp_replace(p_type, '[-\\s./\\\\]', '_', 'g'), 64) AS field_name FROM part")
def sanitize_names(spark, d):
    return table(spark, d, "part").select("p_partkey", naming.field_expr(F.concat(F.lit("DAT:"), F.col("p_type"))).alias("field_name"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'Order_TABLE' ELSE left('_' || n_nationkey || '_' || n_name, 64) END AS table_name FROM nation")
def sanitize_tables(spark, d):
    raw = F.when(F.col("n_nationkey") % 2 == 0, F.lit("Order")).otherwise(F.concat_ws("-", F.col("n_nationkey").cast("string"), F.col("n_name")))
    return table(spark, d, "nation").select("n_nationkey", naming.table_expr(raw).alias("table_name"))


@query(
    r"""SELECT p_partkey, regexp_replace(regexp_replace(left(CASE WHEN regexp_matches(b, '^[0-9]') THEN 'FIELD_' || b ELSE b END, 50), '_+', '_', 'g'), '^_|_$', '', 'g') AS field_name
    FROM (SELECT p_partkey, regexp_replace(p_size || ' ' || p_type, '[^A-Za-z0-9_]', '_', 'g') AS b FROM part)"""
)
def recover_names(spark, d):
    raw = F.concat(F.lit("PRE:"), F.col("p_size").cast("string"), F.lit(" "), F.col("p_type"), F.lit("_1_22"))
    return table(spark, d, "part").select("p_partkey", naming.recovered_expr(raw).alias("field_name"))


PRICES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(f"SELECT l_orderkey, l_linenumber, a[2] AS second, len(a) AS n, list_sum(a) AS total FROM (SELECT l_orderkey, l_linenumber, [{', '.join(PRICES)}] AS a FROM lineitem)")
def array_build(spark, d):
    a = F.array(*PRICES)
    total = F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.get(a, F.lit(1)).alias("second"), F.size(a).cast("long").alias("n"), total.alias("total"))


@query("SELECT vec_id, embedding[1]::DOUBLE AS first FROM embeddings WHERE embedding[1] > 0")
def array_element(spark, d):
    return table(spark, d, "embeddings").where(F.get("embedding", F.lit(0)) > 0).select("vec_id", F.get("embedding", F.lit(0)).cast("double").alias("first"))


@query("SELECT vec_id, len(embedding) AS n FROM embeddings")
def array_length(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.size("embedding").cast("long").alias("n"))


@query("SELECT l_orderkey, l_linenumber, json_extract(to_json([l_quantity, NULL, l_tax]), '$[0]')::DOUBLE AS element, 3::BIGINT AS n FROM lineitem")
def array_json(spark, d):
    text = F.to_json(F.array("l_quantity", F.lit(None).cast("double"), "l_tax"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.get(F.from_json(text, "array<double>"), F.lit(0)).alias("element"), F.json_array_length(text).cast("long").alias("n"))


@query("SELECT p_partkey, list_transform([p_size % 2, p_size % 3, 0], lambda x: x <> 0)::VARCHAR AS flags FROM part")
def bool_array(spark, d):
    flags = F.transform(F.array(F.col("p_size") % 2, F.col("p_size") % 3, F.lit(0)), lambda x: x != 0)
    return table(spark, d, "part").select("p_partkey", F.concat(F.lit("["), F.array_join(F.transform(flags, lambda x: x.cast("string")), ", "), F.lit("]")).alias("flags"))


@query("SELECT vec_id, place - 1 AS place, x::DOUBLE AS x FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS place FROM embeddings)")
def array_unnest(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.posexplode_outer("embedding").alias("place", "x"))
    return rows.select("vec_id", F.col("place").cast("long").alias("place"), F.col("x").cast("double").alias("x"))


SIZES = "(SELECT doc_id, n_chars, (n_chars % 250)::INT AS f FROM documents)"


@query(f"SELECT doc_id, CASE WHEN n_chars > 10000 THEN 5 WHEN n_chars > 5000 THEN 10 WHEN n_chars > 1000 THEN 25 WHEN n_chars < 100 THEN 400 WHEN f > 200 THEN 5 WHEN f > 100 THEN 10 WHEN f > 50 THEN 50 ELSE 100 END AS batch FROM {SIZES}")
def batch_size(spark, d):
    n = F.col("n_chars")
    return table(spark, d, "documents").select("doc_id", sizing.batch_size(n, (n % 250).cast("int")).alias("batch"))


@query("SELECT o_orderkey, CASE WHEN mb > 10000 OR n > 1000000 THEN 'enterprise' WHEN mb > 1000 OR n > 100000 THEN 'large' WHEN mb > 100 OR n > 10000 THEN 'medium' ELSE 'small' END AS category FROM (SELECT o_orderkey, o_totalprice / 20 AS mb, o_orderkey * 10 AS n FROM orders)")
def size_category(spark, d):
    return table(spark, d, "orders").select("o_orderkey", sizing.size_category(F.col("o_totalprice") / 20, F.col("o_orderkey") * 10).alias("category"))


RECOMMENDED = "(SELECT o_orderkey, (o_orderkey % 7) * 20000 AS n, o_totalprice / 300 AS mb FROM orders)"


def _recommended(spark, d):
    return table(spark, d, "orders").select("o_orderkey", ((F.col("o_orderkey") % 7) * 20000).alias("n"), (F.col("o_totalprice") / 300).alias("mb"))


@query(f"SELECT o_orderkey, CASE WHEN n = 0 THEN 'skip' WHEN n > 100000 OR mb > 1000 THEN 'enterprise' WHEN n > 50000 OR mb > 500 THEN 'large' WHEN n > 10000 OR mb > 100 THEN 'medium' ELSE 'small' END AS advice FROM {RECOMMENDED}")
def recommendation(spark, d):
    return _recommended(spark, d).select("o_orderkey", sizing.recommendation(F.col("n"), F.col("mb")).alias("advice"))


@query(f"SELECT o_orderkey, CASE WHEN n > 100000 OR mb > 1000 THEN 10 WHEN n > 50000 OR mb > 500 THEN 25 WHEN n > 10000 OR mb > 100 THEN 50 ELSE 100 END AS batch FROM {RECOMMENDED}")
def optimal_batch(spark, d):
    return _recommended(spark, d).select("o_orderkey", sizing.optimal_batch(F.col("n"), F.col("mb")).alias("batch"))


@query(f"SELECT doc_id, n_chars > 10000 OR n_chars % 3000 > 2000 OR f > 100 AS streams FROM {SIZES}")
def streaming_flag(spark, d):
    n = F.col("n_chars")
    return table(spark, d, "documents").select("doc_id", sizing.use_streaming(n, n % 3000, n % 250).alias("streams"))


@query("SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 100")
def sample_rows(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_name").orderBy("p_partkey").limit(100)


@query("SELECT l_suppkey, arg_max(l_orderkey * 10 + l_linenumber, (l_quantity, l_orderkey, l_linenumber)) AS best FROM lineitem GROUP BY 1")
def best_by(spark, d):
    key = F.struct("l_quantity", "l_orderkey", "l_linenumber")
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.max_by(F.col("l_orderkey") * 10 + F.col("l_linenumber"), key).alias("best"))


@query("SELECT p_partkey, base64(encode(p_name)) AS data, strlen(p_name) AS size, 'part' AS table_name, lower(hex(encode(p_name))[1:8]) AS first FROM part")
def compact_json(spark, d):
    made = table(spark, d, "part").select("p_partkey", F.from_json(decode.compact_json(F.col("p_name").cast("binary"), "part"), "data string, size long, `table` string, first string").alias("j"))
    return made.select("p_partkey", "j.data", "j.size", F.col("j.table").alias("table_name"), "j.first")
