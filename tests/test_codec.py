import datetime as dt
import struct
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagemill.codec import arrays, crypt, definitions, files, pages, types
from pagemill.codec.types import FieldDef, IndexDef, MemoDef, TableDef

ALL = TableDef(
    1, "EVERYTHING", 67,
    (
        FieldDef("A:B", "BYTE", 0, 1), FieldDef("A:S", "SHORT", 1, 2), FieldDef("A:U", "USHORT", 3, 2), FieldDef("A:D", "DATE", 5, 4), FieldDef("A:T", "TIME", 9, 4), FieldDef("A:L", "LONG", 13, 4),
        FieldDef("A:UL", "ULONG", 17, 4), FieldDef("A:F", "FLOAT", 21, 4), FieldDef("A:DB", "DOUBLE", 25, 8), FieldDef("A:DEC", "DECIMAL", 33, 5, decimals=2), FieldDef("A:ST", "STRING", 38, 10),
        FieldDef("A:CS", "CSTRING", 48, 8), FieldDef("A:PS", "PSTRING", 56, 6), FieldDef("A:FL", "BYTE", 62, 3, 3), FieldDef("A:G", "GROUP", 65, 2),
    ),
    (MemoDef("NOTES", 100), MemoDef("PIC", 0, blob=True)),
    (IndexDef("BY_L", ((5, False), (1, True)), unique=True, nocase=True),),
)
ROW = {
    "A:B": 7, "A:S": -5, "A:U": 65520, "A:D": dt.date(2023, 12, 26), "A:T": "20:30:45.05", "A:L": 81447, "A:UL": 4_000_000_000, "A:F": 1.5, "A:DB": -2.25, "A:DEC": Decimal("-123.45"),
    "A:ST": "Привет", "A:CS": "cut", "A:PS": "pas", "A:FL": [True, False, True], "A:G": b"\x01\xff",
}


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.binary(max_size=400), st.lists(st.tuples(st.integers(0, 3), st.integers(1, 300)), max_size=8).map(lambda runs: b"".join(bytes((v,)) * n for v, n in runs))))
def test_rle_round_trip(data):
    assert pages.rle_decompress(pages.rle_compress(data)) == data


def test_rle_by_hand():
    assert pages.rle_decompress(bytes((3, 65, 66, 67, 4))) == b"ABCCCCC"
    assert pages.rle_decompress(bytes((1, 65, 0x80 | 44, 2))) == b"A" * 301  # (2 << 7) | 44 repeats
    for bad in (b"\x05ab", b"\x00\x00", b"\x81"):
        with pytest.raises(pages.CorruptPage):
            pages.rle_decompress(bad)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.binary(min_size=1, max_size=100), st.integers(0, 20)), max_size=12))
def test_delta_round_trip(records):
    assert list(pages.split_records(pages.join_records(records), len(records))) == records


def test_delta_by_hand():
    data = bytes((0xC0, 3, 0, 1, 0)) + b"abc" + bytes((2,)) + b"d"
    assert list(pages.split_records(data, 2)) == [(b"abc", 1), (b"abd", 1)]
    with pytest.raises(pages.CorruptPage):
        list(pages.split_records(data, 3))
    same = b"x" * 80
    assert pages.join_records([(same, 1), (same, 1)])[-18] == 63


@given(st.binary(min_size=64, max_size=64 * 4).map(lambda b: b[: len(b) // 64 * 64]), st.text(st.characters(codec="cp1251", exclude_characters="\0"), min_size=1, max_size=12))
def test_crypt_round_trip(data, password):
    key = crypt.key_words(password)
    assert crypt.decrypt(crypt.encrypt(data, key), key) == data


def test_every_type_round_trip():
    raw = types.encode_record(ROW, ALL)
    assert {f.name: types.decode_field(raw, f) for f in ALL.fields} == ROW
    blank = types.encode_record({}, ALL)
    got = {f.name: types.decode_field(blank, f) for f in ALL.fields}
    assert got["A:D"] is None and got["A:ST"] == "" and got["A:FL"] == [False] * 3
    assert [types.decode_column([raw, blank], f) for f in ALL.fields] == [[types.decode_field(r, f) for r in (raw, blank)] for f in ALL.fields]


def test_known_values():
    f = lambda kind, size, n=1, **k: FieldDef("x", kind, 0, size, n, **k)
    assert types.day_count(81447) == dt.date(2023, 12, 26) and types.day_count(0) is None and types.day_count(10**9) is None
    assert types.centiseconds(7384505) == "20:30:45.05"
    assert types.decode_element(b"\x01\x00", f("SHORT", 2)) == 1 and types.decode_element(b"\x01", f("SHORT", 2)) is None
    assert types.decode_field(b"\x01\x00", f("BYTE", 3, 3)) == [True, False, None]
    assert types.decode_field(b"Hello     World     ", f("STRING", 20, 2, element_size=10)) == ["Hello", "World"]
    assert types.decode_date(bytes((31, 2, 0xE7, 7))) is None
    assert types.decode_decimal(bytes.fromhex("f12345"), 2) == Decimal("-123.45") and types.decode_decimal(b"\x0a\xbb", 0) is None
    assert types.decode_element(struct.pack("<i", 81447), f("LONG", 4), date_field=True) == dt.date(2023, 12, 26)


def test_definitions():
    raw = definitions.build(ALL)
    got = definitions.parse(raw, 1, "EVERYTHING")
    assert [(f.name, f.type, f.offset, f.size, f.elements, f.decimals) for f in got.fields] == [(f.name, f.type, f.offset, f.size, f.elements, f.decimals) for f in ALL.fields]
    assert [(m.name, m.blob) for m in got.memos] == [("NOTES", False), ("PIC", True)] and got.indexes == ALL.indexes
    assert definitions.parse_header(bytes.fromhex("01000010290000000000")) == (4096, 41, 0, 0)
    with pytest.raises(definitions.BadDefinition):
        definitions.parse(raw[:40], 1, "X")
    saved = definitions.parse(raw[:40], 1, "X", recover=True)
    assert saved.recovered and saved.fields[0].name == "A:B" and saved.fields[-1].type == "DOUBLE"


def test_arrays():
    double = lambda name, at: FieldDef(name, "DOUBLE", at, 8)
    even = TableDef(1, "T", 44, (FieldDef("TEST:ID", "SHORT", 0, 2), *[double(f"TEST:PROD{i}", 2 + 8 * (i - 1)) for i in range(1, 6)], FieldDef("TEST:STATUS", "SHORT", 42, 2)))
    plain, found = arrays.analyse(even)
    assert [f.name for f in plain] == ["TEST:ID", "TEST:STATUS"] and [(a.base, len(a.members)) for a in found] == [("TEST:PROD", 5)]
    gaps = TableDef(1, "T", 200, tuple(double(f"X{i}", at) for i, at in enumerate((100, 125, 150, 180))))
    assert arrays.analyse(gaps)[1] == []
    mixed = TableDef(1, "T", 200, (double("Y1", 0), FieldDef("Y2", "LONG", 8, 4)))
    assert arrays.analyse(mixed)[1] == []
    assert arrays.base_name("TEST:PROD1", 8) == "TEST:PROD" and arrays.base_name("TEST:NAME", 20) == "TEST:NAME" and arrays.base_name("P$12", 8) == "P"


@pytest.mark.parametrize("options", [{}, {"password": "пароль"}, {"compress": False}, {"page_bytes": 300, "portion_bytes": 30, "shuffle_portions": True}])
def test_files(tmp_path, options):
    path = tmp_path / "a.tps"
    other = TableDef(2, "MONHIST", 100, (FieldDef("LSE_ID", "LONG", 0, 4), FieldDef("PROD1", "DOUBLE", 4, 96, 12, element_size=8)))
    rows = [{"LSE_ID": i, "PROD1": [float(i + k) for k in range(12)]} for i in range(500)]
    path.write_bytes(files.encode_file([(ALL, [{**ROW, "NOTES": "a note", "PIC": b"\0" * 200}] * 3), (other, rows)], **options))
    with files.Database(str(path), options.get("password")) as db:
        assert {t.name: len(t.fields) for t in db.tables.values()} == {"EVERYTHING": 15, "MONHIST": 2}
        assert next(iter(db.tables[2].statistics.values()))[0] == 500 and db.check() == []
        records = [r for p in db.leaves for r in db.records(p)]
        assert [types.decode_field(r.body, other.fields[0]) for r in records if r.kind == pages.DATA and r.table == 2] == list(range(500))
        assert sum(r.kind == pages.MEMO for r in records) == 6
    if "password" in options:
        for wrong in ("nope", None):
            with pytest.raises(files.NotADatabase):
                files.Database(str(path), wrong)


def test_corrupt(tmp_path):
    good = files.encode_file([(ALL, [ROW] * 50)])
    (tmp_path / "b.tps").write_bytes(b"\0" * 1024)
    with pytest.raises(files.NotADatabase):
        files.Database(str(tmp_path / "b.tps"))
    (tmp_path / "c.tps").write_bytes(good[:700])
    with pytest.raises((pages.CorruptPage, struct.error)), files.Database(str(tmp_path / "c.tps")) as db:
        list(db.tables)
