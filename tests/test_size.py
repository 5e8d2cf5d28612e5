"""What may not grow with the number of files or pages faster than the input does."""

import datetime as dt

import pyarrow as pa
import pytest
from pyspark.sql.pandas.types import to_arrow_type

from pagemill.codec import crypt, files, types
from pagemill.codec.types import FieldDef, TableDef
from pagemill.operators.profile import profile
from pagemill.sinks import landing
from pagemill.sources import read, tps

A = TableDef(1, "AAA", 14, (FieldDef("A:ID", "LONG", 0, 4), FieldDef("A:NAME", "STRING", 4, 10)))
OTHER = TableDef(3, "AAA", 12, (FieldDef("A:ID", "LONG", 0, 4), FieldDef("A:V", "DOUBLE", 4, 8)))


def build(folder, n_files, n=50, password=None):
    folder.mkdir(exist_ok=True)
    for k in range(n_files):
        rows = [{"A:ID": k * 1000 + i, "A:NAME": f"n{i}"} for i in range(n)]
        (folder / f"f{k:02d}.tps").write_bytes(files.encode_file([(A, rows)], page_bytes=300, password=password))
    return str(folder)


def test_like_files_land_as_one_scan(spark, tmp_path):
    path = build(tmp_path / "in", 12)
    (tmp_path / "in/g.tps").write_bytes(files.encode_file([(OTHER, [{"A:ID": -1, "A:V": 0.5}])]))
    frames = []
    landing.land(spark, path, str(tmp_path / "none"), write=lambda df, target: frames.append(df))
    assert frames[0]._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 2
    done = landing.land(spark, path, str(tmp_path / "out"), mode="PERMISSIVE")
    got = spark.read.parquet(str(tmp_path / "out/AAA"))
    assert done.tables == {"AAA": 601} and got.columns == ["_source_file", "ID", "NAME", "V"]
    assert {(r.ID, r.NAME, r.V) for r in got.collect()} == {(k * 1000 + i, f"n{i}", None) for k in range(12) for i in range(50)} | {(-1, None, 0.5)}
    assert got.where("_source_file LIKE '%f03.tps'").selectExpr("min(ID)", "count(*)").first() == (3000, 50)


def test_tasks_of_a_scan_are_bounded(tmp_path, monkeypatch):
    known = tps.catalogs_text(read.catalogs(build(tmp_path / "in", 6)))
    leaves = sum(len(c.leaves) for c in tps.catalogs_from(known).values())
    monkeypatch.setattr(tps, "MOST_TASKS", 4)
    source = tps.TpsDataSource({"path": "-", "table": "AAA", "catalogs": known, "pagesPerPartition": "1"})
    reader = source.reader(source.schema())
    parts = reader.partitions()
    assert leaves > 12 and len(parts) <= 4
    assert sorted(x for p in parts for b in reader.read(p) for x in b.column("ID").to_pylist()) == [k * 1000 + i for k in range(6) for i in range(50)]


def test_distinct_counts_multiply_no_rows(spark):
    df = spark.createDataFrame([(1, 0.0, "a", None), (2, -0.0, None, None), (None, float("nan"), "b", None), (2, float("nan"), "a", None)], "k int, v double, s string, `odd.name` int")
    found = profile(df)
    assert "Expand" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.column_name, r.total_count, r.null_count, r.distinct_count) for r in found.orderBy("column_name").collect()] == [("k", 4, 1, 2), ("odd.name", 4, 4, 0), ("s", 4, 1, 2), ("v", 4, 0, 2)]
    assert {r.column_name: r.distinct_count for r in profile(df.limit(0)).collect()} == dict.fromkeys(df.columns, 0) and profile(df, approximate=True).columns == found.columns


def test_a_scan_decrypts_windows_not_pages(tmp_path, monkeypatch):
    path = build(tmp_path / "in", 1, 2000, "pass word") + "/f00.tps"
    spans = []
    inner = crypt.decrypt
    monkeypatch.setattr(crypt, "decrypt", lambda data, key: (spans.append(len(data)), inner(data, key))[1])
    source = tps.TpsDataSource({"path": path, "table": "AAA", "password": "pass word"})
    reader = source.reader(source.schema())
    batches = [b for p in reader.partitions() for b in reader.read(p)]
    assert [x for b in batches for x in b.column("ID").to_pylist()] == list(range(2000)) and len(batches) == 1
    with files.Database(path, "pass word") as db:
        assert len(db.leaves) > 100 > 4 * len(spans)
        whole = db.read(0, 10**6)
        monkeypatch.setattr(files, "WINDOW", 256)
        db.windows.clear()
        assert db.read(0, 10**6) == whole and db.read(250, 600) == whole[250:850] and db.read(len(whole), 5) == b"" and len(db.windows) <= files.WINDOWS


def test_columns_are_encoded_and_decoded_like_rows():
    days = [dt.date(1, 1, 1), dt.date(9999, 12, 31), dt.date(2024, 2, 29), None, dt.date(1969, 12, 31)]
    columns = {
        "I": pa.array([1, -1, None, 2**31 - 1, -(2**31)], pa.int32()), "S": pa.array([1, None, -5, 32767, -32768], pa.int16()), "D": pa.array([0.5, None, float("inf"), -0.0, 1e300]),
        "F": pa.array([0.5, None, 2.0, -0.0, 1.0], pa.float32()), "T": pa.array(["", None, " жук\t", "漢 x", "ab"]), "W": pa.array(days, pa.date32()),
    }
    kinds = {"I": ("LONG", 4), "S": ("SHORT", 2), "D": ("DOUBLE", 8), "F": ("FLOAT", 4), "T": ("STRING", 6), "W": ("DATE", 4)}
    fields, at = [], 0
    for name, (kind, size) in kinds.items():
        fields.append(FieldDef(name, kind, at, size))
        at += size
    table = TableDef(1, "T", at, tuple(fields))
    rows = [dict(zip(columns, row, strict=True)) for row in zip(*(c.to_pylist() for c in columns.values()), strict=True)]
    raws = types.encode_columns(columns, table)
    assert raws == [types.encode_record(r, table) for r in rows]
    odd = [bytes((d, m)) + y.to_bytes(2, "little") for d, m, y in ((0, 1, 2000), (31, 4, 2000), (29, 2, 1900), (1, 13, 2000), (1, 0, 2000), (1, 1, 0), (1, 1, 10000), (255, 255, 65535))]
    raws += [raws[0][:-4] + x for x in odd] + [raws[0]]
    for f in fields:
        kind = to_arrow_type(types.spark_type(f))
        assert types.arrow_column(raws, (f,), kind).to_pylist() == [types.decode_field(r, f) for r in raws]
    assert types.encode_columns({"T": pa.array([1.5])}, TableDef(1, "T", 6, (FieldDef("T", "STRING", 0, 6),))) is None


def test_catalogs_of_many_files_are_decoded_by_tasks(spark, tmp_path, monkeypatch):
    path = build(tmp_path / "in", 5)
    opened = []
    inner = files.Database.__init__
    monkeypatch.setattr(files.Database, "__init__", lambda self, *a, **o: (opened.append(a[0]), inner(self, *a, **o))[1])
    assert read.read_table(spark, path, "AAA").count() == 250 and read.page_warnings(spark, path).count() == 0 and opened == []
    (tmp_path / "in/z.tps").write_bytes(b"no database" * 100)
    with pytest.raises(files.NotADatabase):
        read.read_table(spark, path, "AAA")


def test_an_input_of_one_part_is_written_by_several_tasks(spark, tmp_path):
    made = landing.write_parts(spark.range(2000).selectExpr("CAST(id AS int) AS k", "date_add(DATE'2020-01-01', CAST(id AS int)) AS d").coalesce(1), str(tmp_path / "p"), "T", rows_per_file=100)
    assert len({r.file.split("-")[1] for r in made.collect()}) > 1
    got = read.read_table(spark, str(tmp_path / "p"), "T")
    assert got.selectExpr("count(*)", "count(DISTINCT k)", "max(d)").first() == (2000, 2000, dt.date(2025, 6, 22))
