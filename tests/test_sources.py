import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F

from pagemill import cli
from pagemill.codec import files
from pagemill.codec.types import FieldDef, MemoDef, TableDef
from pagemill.operators import quality, sizing
from pagemill.sinks import landing
from pagemill.sources import read
from pagemill.streaming import pickup

MONHIST = TableDef(1, "MONHIST", 100, (FieldDef("DAT:LSE_ID", "LONG", 0, 4), FieldDef("DAT:PROD1", "DOUBLE", 4, 96, 12, element_size=8)))
NOTED = TableDef(2, "NOTED", 14, (FieldDef("N:ID", "LONG", 0, 4), FieldDef("N:NAME", "STRING", 4, 10)), (MemoDef("TEXT", 100), MemoDef("PIC", 0, blob=True)))


def build(path, n=200, first=0):
    rows = [{"DAT:LSE_ID": first + i, "DAT:PROD1": [float(i * k) for k in range(12)]} for i in range(n)]
    noted = [{"N:ID": 1, "N:NAME": "Имя", "TEXT": "заметка", "PIC": b"\x01" * 150}, {"N:ID": 2, "N:NAME": "bare"}]
    path.write_bytes(files.encode_file([(MONHIST, rows), (NOTED, noted)], page_bytes=600))
    return str(path)


def test_query_of_arrays(spark, tmp_path):
    path = build(tmp_path / "a.phd")
    read.register(spark)
    df = spark.read.format("tps").option("table", "monhist").option("pagesPerPartition", "3").load(path)
    assert dict(df.dtypes) == {"LSE_ID": "int", "PROD1": "array<double>"} and df.count() == 200
    df.createOrReplaceTempView("MONHIST")
    got = spark.sql("SELECT LSE_ID, PROD1[1] AS p FROM MONHIST WHERE PROD1[1] > 100.0").collect()
    assert len(got) == 99 and all(r.p == r.LSE_ID for r in got)
    one = spark.read.format("tps").option("table", "MONHIST").option("columns", "LSE_ID").option("recNo", "true").load(path)
    assert one.columns == ["_rec_no", "LSE_ID"] and one.where("_rec_no = 5").first().LSE_ID == 4
    assert spark.read.format("tps").load(path).where("kind = 'DATA'").count() == 202


def test_memos_and_catalog(spark, tmp_path):
    path = build(tmp_path / "a.phd")
    rows = {r.ID: r for r in read.read_table(spark, path, "NOTED").collect()}
    assert rows[1].TEXT == "заметка" and bytes(rows[1].PIC) == b"\x01" * 150 and rows[1].NAME == "Имя" and rows[2].TEXT is None
    assert {(r.table_name, r.stated_rows) for r in read.catalog(spark, path).collect()} == {("MONHIST", 200), ("NOTED", 2)}
    assert read.page_warnings(spark, path).count() == 0 and read.fields(spark, path).count() == 4
    with pytest.raises(Exception, match="no table"):
        read.read_table(spark, path, "NOPE").collect()


def test_landing_many_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    build(tmp_path / "in/a.phd")
    build(tmp_path / "in/b.phd", 50, 1000)
    build(tmp_path / "in/c.mod", 10)
    done = landing.land(spark, str(tmp_path / "in"), str(tmp_path / "out"), "extension")
    assert done.success and done.tables == {"phd_MONHIST": 250, "phd_NOTED": 4, "mod_MONHIST": 10, "mod_NOTED": 2}
    again = landing.land(spark, str(tmp_path / "in"), str(tmp_path / "out"), "extension", resume=True)
    assert sorted(again.skipped) == sorted(done.tables)
    source = read.read_table(spark, str(tmp_path / "in/c.mod"), "MONHIST")
    found = quality.validate({"m": source}, {"m": spark.read.parquet(str(tmp_path / "out/mod_MONHIST"))}, keys={"m": ["LSE_ID"]})
    assert found["counts"].first().status == "equal" and found["diff:m"].count() == 0


def test_archive(spark, tmp_path):
    build(tmp_path / "x.PHD", 5)
    with zipfile.ZipFile(tmp_path / "z.phz", "w") as z:
        z.write(tmp_path / "x.PHD", "sub/x.PHD")
        z.writestr("readme.txt", "hi")
    assert {(r.member, r.category) for r in read.archive(spark, str(tmp_path / "z.phz")).collect()} == {("sub/x.PHD", "phd"), ("readme.txt", "other")}
    assert read.read_table(spark, str(tmp_path / "z.phz"), "MONHIST").count() == 5
    (tmp_path / "bad.phz").write_bytes(b"no zip")
    with pytest.raises(zipfile.BadZipFile):
        files.archive_members(str(tmp_path / "bad.phz"))


def test_reverse(spark, tmp_path):
    with sqlite3.connect(tmp_path / "s.sqlite") as con:
        con.execute("CREATE TABLE phd_T1 (id INTEGER PRIMARY KEY, name TEXT, value REAL)")
        con.executemany("INSERT INTO phd_T1 VALUES (?, ?, ?)", [(1, "test1", 1.5), (2, None, 2.5)])
        con.execute("CREATE TABLE mod_M (id INTEGER, data BLOB)")
        con.execute("INSERT INTO mod_M VALUES (1, ?)", (b"blob data",))
    assert landing.reverse(spark, str(tmp_path / "s.sqlite"), str(tmp_path / "o")) == {"s.phd": 2, "s.mod": 1}
    rows = read.read_table(spark, str(tmp_path / "o/s.phd"), "T1").orderBy("id").collect()
    assert [(int(r.id), r.name, r.value) for r in rows] == [(1, "test1", 1.5), (2, "", 2.5)]
    assert bytes(read.read_table(spark, str(tmp_path / "o/s.mod"), "M").first().data) == b"blob data"


def test_sqlite_partitions(spark, tmp_path):
    path = str(tmp_path / "p.sqlite")
    with sqlite3.connect(path) as con:
        con.execute("CREATE TABLE a (k INTEGER, v TEXT)")
        con.executemany("INSERT INTO a VALUES (?, ?)", [(i, str(i)) for i in range(250)])
        con.execute("CREATE TABLE b (k INTEGER PRIMARY KEY, v REAL) WITHOUT ROWID")
        con.executemany("INSERT INTO b VALUES (?, ?)", [(i, i / 2) for i in range(5)])
        con.execute("CREATE TABLE c (k INTEGER)")
    read.register(spark)
    load = lambda t, **o: spark.read.format("sqlite_file").options(table=t, **o).load(path)
    assert load("a", numPartitions="3").rdd.getNumPartitions() == 3 and load("a", numPartitions="3").count() == load("a").count() == 250
    assert sorted(map(tuple, load("b").collect())) == [(i, i / 2) for i in range(5)] and load("c").count() == 0


def test_reverse_keeps_long_values(spark, tmp_path):
    long = "é long text " * 100 + "end"
    with sqlite3.connect(tmp_path / "l.sqlite") as con:
        con.execute("CREATE TABLE phd_T (id INTEGER, name TEXT, more TEXT)")
        con.executemany("INSERT INTO phd_T VALUES (?, ?, ?)", [(1, "a" * 256, "x"), (2, None, "y"), (3, long.replace("é", "e"), "z" * 255), (4, "short", None)])
    landing.reverse(spark, str(tmp_path / "l.sqlite"), str(tmp_path / "o"))
    rows = read.read_table(spark, str(tmp_path / "o/l.phd"), "T").orderBy("id").collect()
    assert [(r.name or "", r.more) for r in rows] == [("a" * 256, "x"), ("", "y"), (long.replace("é", "e"), "z" * 255), ("short", "")]
    df = spark.createDataFrame([(1, [float(i) for i in range(20)], ["t" * 300, "u"]), (2, None, None)], "id int, v array<double>, t array<string>")
    landing.write_database({"A": df}, str(tmp_path / "a.tps"))
    row = read.read_table(spark, str(tmp_path / "a.tps"), "A").orderBy("id").first()
    assert list(row.v) == [float(i) for i in range(20)] and list(row.t) == ["t" * 300, "u"]
    fixed = spark.createDataFrame([("abcdef",)], "s string").withMetadata("s", {"size": 3})
    with pytest.raises(ValueError, match="does not fit"):
        landing.write_database({"B": fixed}, str(tmp_path / "b.tps"))
    few = spark.createDataFrame([([1, 2, 3],)], "v array<int>").withMetadata("v", {"elements": 2})
    with pytest.raises(ValueError, match="do not fit"):
        landing.write_database({"C": few}, str(tmp_path / "c.tps"))


def test_quality_frames(spark):
    a = spark.createDataFrame([(1, "test1", [1.0]), (2, "test2", None)], "id int, name string, v array<double>")
    b = spark.createDataFrame([(1, "test1", [1.0]), (2, "different", None)], "id int, name string, v array<double>")
    assert [tuple(r) for r in quality.cell_diff(a, b, ["id"]).collect()] == [(2, "name", "test2", "different")]
    assert quality.schema_diff(a, b.drop("v")) == [("v", "array<double>", None)]
    spans = spark.createDataFrame([(1, 0, 100), (2, 10, 20), (3, 30, 40), (4, 100, 110)], "k int, a int, b int")
    assert {tuple(r) for r in quality.overlap_pairs(spans, "k", "a", "b", 7).collect()} == {(1, 2), (1, 3)}
    assert {tuple(r) for r in quality.overlaps(spans, "k", "a", "b").collect()} == {(2, 1), (3, 1)}
    assert quality.full_diff(a.drop("v"), a.drop("v")).count() == 0


def test_policy():
    assert sizing.policy("large").batch_size == 50 and sizing.Policy.from_dict(sizing.policy("enterprise").to_dict()) == sizing.policy("enterprise")
    with pytest.raises(ValueError):
        sizing.policy("huge")


def test_pickup_of_new_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    build(tmp_path / "in/a.phd", 5)
    run = lambda: pickup.follow(spark, str(tmp_path / "in"), "MONHIST", str(tmp_path / "out"), str(tmp_path / "state"))
    run()
    build(tmp_path / "in/b.phd", 7)
    run()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 12


def test_cli(spark, tmp_path, capsys):
    path = build(tmp_path / "a.phd", 3)
    assert cli.main(["convert", path, str(tmp_path / "out")]) == 0
    assert cli.main(["convert", str(tmp_path / "none.phd"), str(tmp_path / "out")]) == 1
    assert spark.read.parquet(str(tmp_path / "out/MONHIST")).where(F.col("LSE_ID") == 2).count() == 1
    assert "MONHIST" in capsys.readouterr().out
