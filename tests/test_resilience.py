import datetime as dt
import threading

import pytest

from pagemill import cli
from pagemill.codec import definitions, files
from pagemill.codec.types import FieldDef, IndexDef, MemoDef, TableDef
from pagemill.operators import ddl, errors, monitor, quality, sizing
from pagemill.sinks import landing, store
from pagemill.sources import read, tps

A = TableDef(1, "AAA", 12, (FieldDef("A:ID", "LONG", 0, 4), FieldDef("A:V", "DOUBLE", 4, 8)), (), (IndexDef("BY-ID", ((0, True),), unique=True),))
B = TableDef(2, "BBB", 14, (FieldDef("B:ID", "LONG", 0, 4), FieldDef("B:NAME", "STRING", 4, 10)), (MemoDef("NOTE", 0),))


def build(path, n=300):
    rows = [{"A:ID": i, "A:V": i / 2} for i in range(n)]
    path.write_bytes(files.encode_file([(A, rows), (B, [{"B:ID": i, "B:NAME": f"n{i}", "NOTE": b"x"} for i in range(20)])], page_bytes=600))
    return str(path)


def damaged(path):
    """The file with one of its leaves overwritten in the middle."""
    with files.Database(path) as db:
        rows = [p for p in db.leaves if any(r.kind == "DATA" for r in db.records(p))]
        p = rows[3]
        at = p.ref * files.UNIT + db.header_size + 13
    raw = bytearray(open(path, "rb").read())
    raw[at + 5 : at + p.size - 13] = b"\x00" * (p.size - 18)
    open(path, "wb").write(bytes(raw))


def test_a_scan_decodes_a_catalog_once(tmp_path, monkeypatch):
    path = build(tmp_path / "a.tps")
    decodes = []
    inner = files.Database.tables.func
    monkeypatch.setattr(files.Database, "tables", property(lambda self: (decodes.append(self.path), inner(self))[1]))
    source = tps.TpsDataSource({"path": path, "table": "aaa", "pagesPerPartition": "3"})
    schema = source.schema()
    reader = source.reader(schema)
    parts = reader.partitions()
    n = sum(batch.num_rows for p in parts for batch in reader.read(p))
    assert n == 300 and len(parts) > 3 and decodes == [path]
    brought = tps.catalogs_text(read.catalogs(path))
    decodes.clear()
    again = tps.TpsDataSource({"path": path, "table": "BBB", "catalogs": brought})
    reader = again.reader(again.schema())
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 20 and decodes == []


def test_catalogs_as_text(tmp_path):
    with files.Database(build(tmp_path / "a.tps")) as db:
        made = files.Catalog.from_text(db.catalog.to_text())
        assert made == db.catalog and made.table("aaa").statistics == db.catalog.table("AAA").statistics


def test_landing_in_parallel(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        build(tmp_path / f"in/f{k}.tps", 50 + k)
    seen = []
    done = landing.land(spark, str(tmp_path / "in"), str(tmp_path / "out"), "prefix", threads=4, progress=lambda i, n, name: seen.append((i, n, threading.get_ident())))
    assert done.success and done.totals["files"] == 3 and done.totals["records"] == 153 + 60 and len(done.tables) == 6
    assert sorted(i for i, _, _ in seen) == [1, 2, 3, 4, 5, 6] and len({t for *_, t in seen}) > 1
    again = landing.land(spark, str(tmp_path / "in"), str(tmp_path / "out"), "prefix", policy=sizing.policy("enterprise"))
    assert sorted(again.skipped) == sorted(done.tables) and again.tables == done.tables
    assert "file_1_AAA" in landing.landing_report(spark, done)


def test_damage_is_counted(spark, tmp_path):
    path = build(tmp_path / "a.tps")
    damaged(path)
    strict = landing.land(spark, path, str(tmp_path / "strict"), recover="true", mode="PERMISSIVE")
    assert strict.success and strict.damaged == {"AAA": 1, "BBB": 1} and 0 < strict.tables["AAA"] < 300
    found = read.damage(spark, path, "AAA", recover="true").collect()
    assert len(found) == 1 and found[0].record_number is None and found[0].page > 0
    # without the option the strategy for damaged data turns it on, once
    helped = landing.land(spark, path, str(tmp_path / "helped"), recover="true")
    assert helped.success and helped.tables == strict.tables and helped.log.attempts["skip_corrupt_record"] == 2
    assert {e.severity for e in helped.log.entries} == {"warning"}


def test_errors_stop_a_landing(spark, tmp_path):
    path = build(tmp_path / "a.tps")

    def broken(df, target):
        raise ValueError("no room")

    done = landing.land(spark, path, str(tmp_path / "out"), write=broken, max_errors=1)
    assert not done.success and not done.partial and len(done.errors) == 1
    assert done.log.report(spark)["errors_by_category"] == {"conversion": 1} and done.errors_frame(spark).count() == 1


def test_error_log(spark):
    waits = []
    log = errors.ErrorLog(max_errors=3, sleep=waits.append)
    calls = []

    def flaky(options):
        calls.append(options)
        if len(calls) < 3:
            raise FileNotFoundError("x")
        return "done"

    assert log.run(flaky, {"a": 1}, table="T") == "done" and waits == [1.0, 2.0] and log.attempts["retry_file_access"] == 2
    with pytest.raises(MemoryError):
        log.run(lambda o: (_ for _ in ()).throw(MemoryError(str(o["pagesPerPartition"]))), {"pagesPerPartition": 8})
    assert [e.message for e in log.entries if e.category == "memory_limit"] == ["MemoryError: 8", "MemoryError: 2"]
    log.add_strategy(errors.Strategy("give_up", ("system",), lambda o: None))
    log.add("odd", severity="info")
    log.add(RuntimeError("a"))
    with pytest.raises(ValueError):
        log.add("x", category="nonsense")
    log.add("b", "validation", "critical", details={"at": dt.date(2020, 1, 1)})
    with pytest.raises(errors.TooManyErrors):
        log.add("c", "validation")
    with pytest.raises(ZeroDivisionError), errors.ErrorLog() as other:
        1 / 0  # noqa: B018
    assert other.entries[0].severity == "critical" and "ZeroDivisionError" in other.entries[0].stack_trace
    report = log.report(spark, 2)
    assert report["total_errors"] == 8 and report["errors_by_severity"] == {"warning": 4, "info": 1, "error": 2, "critical": 1} and len(report["recent_errors"]) == 2


def test_store(spark, tmp_path):
    root = str(tmp_path / "s")
    store.write_checkpoint(spark, f"{root}/c.json", {"rows": 5})
    assert store.read_checkpoint(spark, f"{root}/c.json") == {"rows": 5} and store.read_checkpoint(spark, f"{root}/none") is None
    with pytest.raises(FileNotFoundError):
        store.restore(spark, root)
    store.backup(spark, root)
    store.write_text(spark, f"{root}/c.json", "{}")
    store.restore(spark, root)
    assert store.read_checkpoint(spark, f"{root}/c.json") == {"rows": 5}
    store.remove(spark, root)
    assert not store.exists(spark, root)


def test_statements():
    lines = ddl.script([A, B]).splitlines()
    assert lines == ["CREATE TABLE AAA (ID INTEGER, V REAL);", "CREATE INDEX AAA_BY_ID ON AAA (ID);", "CREATE TABLE BBB (ID INTEGER, NAME TEXT, NOTE BLOB);"]
    assert ddl.sql_type("GROUP") == ddl.sql_type("ODD") == "BLOB" and ddl.sql_type("DOUBLE", array=True) == "TEXT"
    assert ddl.create_index(IndexDef("X", ((9, False),)), A) == ""


def test_schema_only_and_estimate(spark, tmp_path):
    path = build(tmp_path / "a.tps", 5000)
    done = landing.land(spark, path, str(tmp_path / "out"), schema_only=True)
    assert done.tables == {"AAA": 0, "BBB": 0} and spark.read.parquet(str(tmp_path / "out/AAA")).columns == ["ID", "V"]
    assert "CREATE TABLE BBB" in (tmp_path / "out/_schema.sql").read_text()
    found = read.estimate(path, "AAA")
    assert abs(found["estimated_records"] - 5000) < 1000 and found["sample_pages"] == 20 < found["total_pages"] and found["recommendation"] == "small"
    assert read.estimate(path, "NONE")["recommendation"] == "skip"
    assert cli.main(["convert", path, str(tmp_path / "cli"), "--threads", "2", "--permissive"]) == 0


def test_policy_and_strategies():
    made = sizing.policy("enterprise")
    assert sizing.Policy.from_dict(made.to_dict()) == made and len(made.to_dict()) == 28 and made.threads == 4 and sizing.DEFAULT.threads == 1
    with pytest.raises(ValueError):
        sizing.Policy.from_dict({"max_memory": 5})
    assert made.pages_per_partition(10, 3, 501) < made.pages_per_partition(10, 3, 499) and made.is_large(100_001, 0) and not made.is_large(5, 5)
    assert sizing.strategy("memory")["batch_size"] == 500 and sizing.strategy_conf(sizing.strategy("memory"))["spark.sql.parquet.compression.codec"] == "zstd"
    with pytest.raises(ValueError):
        sizing.strategy("fast")
    assert sizing.advice(60_000, 10) == {"recommendation": "large", "optimal_batch_size": 25}


def test_monitor(spark):
    with monitor.Monitor(spark, limit_mb=1.0, every=0.05) as m:
        spark.range(1000).count()
    assert m.check() is False and m.clean_ups >= 1 and m.frame().count() >= 2
    assert m.metrics(rows=100, size_mb=2.0)["kb_per_record"] == 20.48
    assert monitor.executors(spark).count() >= 1


def test_value_checks(spark):
    df = spark.createDataFrame([(1, 1.0, "a"), (1, 2.0, None), (2, 500.0, "c")], "id int, v double, s string")
    checks = quality.check_values(df, ["id"], ["s"], {"small": "v < 100"})
    assert {r.rule: r.n for r in checks["constraint_violations"].collect()} == {"unique id": 1, "required s": 1, "small": 1}
    assert checks["data_checksums"].first().checksum == quality.checksums({"t": df.repartition(3)}).first().checksum
    assert quality.violations(df).count() == 0 and quality.anomalies(df.limit(0), ["v"]).first().n == 0
    assert {"anomaly_detection", "data_distribution", "null_value_analysis"} < set(checks)


def test_relations(spark, tmp_path):
    for k in range(2):
        build(tmp_path / f"f{k}.tps", 5)
    found = quality.relations(read.catalog(spark, str(tmp_path)), read.fields(spark, str(tmp_path)))
    assert found["table_overlaps"].count() == 2 and found["schema_similarities"].first().similarity == 1.0 and found["data_relationships"].count() == 0


NAMES = ["CUS:ID", "CUS:NAME", "CUS:CITY", "CUS:ZIP"]


@pytest.mark.parametrize(
    ("data", "method"),
    [
        (b"\x01" * 10 + b"".join(n.encode() + b"\0\x07\x08" for n in NAMES), "printable"),
        (b"\0".join(n.encode() for n in NAMES), "encoding"),
        ("\0".join(NAMES).encode("utf-16-le"), "encoding"),
        (b"\x09".join(n.encode() for n in NAMES), "terminator"),
        (b"\x01" * 10 + b"".join(bytes((len(n),)) + n.encode() for n in NAMES), "length_prefix"),
        (b"\x01" * 10 + b"".join(len(n).to_bytes(2, "little") + n.encode() for n in NAMES), "length_prefix"),
        (b"".join(n.encode().ljust(12, b"\0") for n in NAMES), "length"),
        (b"".join(b"\xfe\xfd" * 2 + n.encode() + b"\0" + bytes(-(len(n) + 5) % 4) for n in NAMES), "alignment"),
        (b"".join(b"\0\x01" + n.encode().ljust(14, b"\0") for n in NAMES), "rows_of_16"),
    ],
)
def test_names_are_found(data, method):
    assert definitions.METHODS[method](data, 4) == NAMES
    assert definitions.vote(data, 4) == NAMES


def test_candidates_and_recovery():
    assert definitions.by_start(b"\xff" * 30 + b"\0".join(n.encode() for n in NAMES), 4) == NAMES
    raw = definitions.build(B)
    ranked = definitions.candidates(raw[10:], 2)
    assert [s for s, *_ in ranked] == sorted((s for s, *_ in ranked), reverse=True) and ranked[0][2][:2] == ["B:ID", "B:NAME"]
    assert definitions.by_known(b"xxCITYxxNAMExx", ["NAME", "CITY", "NONE"]) == ["CITY", "NAME"]
    assert definitions.by_reversal(b"\0DI:B\0" + b"EMAN:B\0", 2) == ["B:NAME", "B:ID"]
    assert set(definitions.comprehensive(raw[10:], 2)) >= {"B:ID", "B:NAME"}
    # a byte of rubbish before the fields: they are found further on
    shifted = raw[:10] + b"\xee" + raw[10:]
    assert [(f.name, f.type, f.offset) for f in definitions.parse(shifted, 2, "BBB", recover=True).fields] == [("B:ID", "LONG", 0), ("B:NAME", "STRING", 4)]
    with pytest.raises(definitions.BadDefinition):
        definitions.parse(shifted, 2, "BBB")
    assert definitions.parse_portions({1: raw[20:], 0: raw[:20]}, 2, "BBB") == definitions.parse(raw, 2, "BBB")
    lost = definitions.parse_portions({0: raw[:14], 2: b"\xee\0B:NAME\0"}, 2, "BBB", recover=True)
    assert lost.recovered and "B:NAME" in [f.name for f in lost.fields]
    assert definitions.vote(b"", 3) == [] and definitions.scanned_fields(b"", 0) == []


def test_raw_values():
    import struct

    from pagemill.codec.types import raw_value

    one = lambda kind, raw: raw_value(raw, FieldDef("F", kind, 0, len(raw)))
    assert one("DOUBLE", struct.pack("<d", 1.5)) == 1.5 and one("LONG", struct.pack("<i", -5)) == -5 and one("BYTE", b"\x02") is True
    assert one("STRING", b"ab  ") == "ab" and one("LONG", b"\x01\x02") == "0102" and one("DECIMAL", b"\x12\x34") == "1234" and one("LONG", b"") is None


def test_positions_of_whole_tables(spark):
    a = spark.createDataFrame([(i, f"v{i}") for i in range(500)], "k int, v string").repartition(7)
    b = spark.createDataFrame([(i + 1000, f"v{i}" if i != 77 else "odd") for i in range(500)], "k int, v string").repartition(3)
    found = quality.positional_diff(a, b.selectExpr("k - 1000 AS k", "v"), ["k"], limit=None).collect()
    assert [tuple(r) for r in found] == [(78, "v", "v77", "odd")]


def test_parts_written_by_tasks(spark, tmp_path):
    df = spark.range(1000).selectExpr("CAST(id AS int) AS k", "repeat('x', 300) AS long_text", "array(1.5, 2.5) AS v").repartition(3)
    made = landing.write_parts(df, str(tmp_path / "parts"), "T", rows_per_file=200)
    assert made.count() >= 5 and max(r.n_rows for r in made.collect()) == 200 and not list((tmp_path / "parts").glob("_*"))
    back = read.read_table(spark, str(tmp_path / "parts"), "T")
    assert back.count() == 1000 and back.select("k").distinct().count() == 1000 and back.first().v == [1.5, 2.5] and len(back.first().long_text) == 300
