from pyspark.sql import functions as F

from pagemill.operators import layout


def test_slices_and_numbers(spark):
    df = spark.createDataFrame([(bytearray(b"\x01\x02\x03\x04"), "-1.5"), (bytearray(b"\x01"), "."), (None, None)], "body binary, v string")
    got = df.select(layout.field_slice(F.col("body"), 1, 2).alias("part"), layout.is_numeric_text(F.col("v")).alias("numeric")).collect()
    assert [(None if r["part"] is None else bytes(r["part"]), r["numeric"]) for r in got] == [(b"\x02\x03", True), (b"", False), (None, False)]


def test_clean_keys(spark):
    df = spark.createDataFrame([("TIT:A:B",), ("A:TIT:",), ("",), (None,)], "k string")
    assert [r["n"] for r in df.select(layout.clean_key(F.col("k"), "TIT:").alias("n")).collect()] == ["AB", "ATIT", "", None]


def test_assemble_orders_portions_and_keeps_equal_ones(spark):
    df = spark.createDataFrame([(1, 1, "b"), (1, 0, "a"), (1, 1, "b"), (2, 0, None)], "t int, place int, body string")
    assert {r["t"]: r["definition"] for r in layout.assemble(df, ["t"], "place", "body").collect()} == {1: "abb", 2: ""}
    assert layout.assemble(df.limit(0), ["t"], "place", "body").count() == 0


def test_rates_of_no_time_are_null(spark):
    df = spark.createDataFrame([("a", 10, 2048, 2.0), ("b", 0, 0, 0.0)], "g string, n long, b long, s double")
    got = {r["g"]: (r["records_per_second"], r["kb_per_record"]) for r in layout.rates(df, "g", "n", "b", "s").collect()}
    assert got == {"a": (5.0, 0.2), "b": (None, None)}
