import hashlib
from pathlib import Path

import pytest

from pagemill.llm import queries, warc

ROWS = [(i, f"http://x/é {i}", f"<p>{i % 7}</p>" if i < 40 else f"body {i} " * 50, "k") for i in range(120)]
ROWS += [(200, None, None, None), (201, "u", "", None), (202, "v", "big " * 100000, None), (202, "v", "big " * 100000, None), (202, "v", "other", None)]


def archive(spark, rows, path, **kw):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, record_type string").repartition(3)
    manifest = warc.write(pages, str(path), **kw)
    return manifest, [r for r in warc.read(spark, str(path)).collect()]


def test_round_trip(spark, tmp_path):
    manifest, got = archive(spark, ROWS, tmp_path / "a", file_bytes=4000, shard_bytes=9000)
    want = sorted((i, len((h or "").encode()), warc.base32_sha1((h or "").encode())) for i, _, h, _ in ROWS)
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest) for r in got) == want
    first = {}
    for i, _, h, _ in sorted(ROWS, key=lambda r: r[0]):
        first.setdefault(h or "", i)
    for r in got:
        if r.record_type == "response":
            assert first[bytes(r.payload).decode()] == r.page_id and r.refers_to is None
        else:
            assert r.refers_to in first.values() and r.refers_to <= r.page_id
    assert sum(r.record_type == "response" for r in got) == len(first)
    assert manifest.count() > 3 and not list(Path(tmp_path / "a").rglob("_temporary*"))


def test_same_bytes_every_time(spark, tmp_path):
    sums = []
    for name in "ab":
        archive(spark, ROWS, tmp_path / name, file_bytes=4000, shard_bytes=9000)
        sums.append({p.name: hashlib.sha256(p.read_bytes()).hexdigest() for p in Path(tmp_path / name).rglob("*.warc.gz")})
    assert sums[0] == sums[1] and len(sums[0]) > 3


def test_shards_do_not_depend_on_the_dealing(spark, tmp_path):
    pages = spark.createDataFrame([(i * i * 10**6 - 2**62, "u", f"{i} " * 90) for i in range(300)], "page_id long, url string, html string")
    found = []
    for k, rows in enumerate((pages.repartition(1), pages.repartition(7))):
        m = warc.write(rows, str(tmp_path / str(k)), shard_bytes=9000)
        found.append(sorted((r.file, r.n_records, r.sha256) for r in m.collect()))
        tasks = [r.temporary.split(".")[1] for r in m.collect()]
        assert len(set(tasks)) == len(tasks)  # a task a shard
    assert found[0] == found[1] and 15 < len(found[0]) < 40
    assert max(n for _, n, _ in found[0]) * 860 < 2 * 9000


def test_written_again(spark, tmp_path, monkeypatch):
    """A reader of the archive before keeps reading it; files of failed attempts go, and so do generations before that."""
    commit = warc._commit

    def with_orphan(spark_, path, folder, manifest):
        Path(path, folder, "_temporary.9-9-9.0.0.warc.gz").write_bytes(b"half")
        commit(spark_, path, folder, manifest)

    monkeypatch.setattr(warc, "_commit", with_orphan)
    for k in range(3):
        before = warc.read(spark, str(tmp_path / "a")) if k else None
        archive(spark, [(i, "u", f"{k} {i}", "k") for i in range(5)], tmp_path / "a")
        if before is not None:
            assert sorted(bytes(r.payload).decode() for r in before.collect()) == [f"{k - 1} {i}" for i in range(5)]
    assert len(list(Path(tmp_path / "a").glob("generation-*"))) == 2 and not list(Path(tmp_path / "a").rglob("_temporary*"))


def test_null_page_ids(spark, tmp_path):
    rows = [(None, "u", "h", "k"), (None, "u", "h", "k"), (None, None, None, "k"), (3, "u", "h", "k"), (5, "v", "h", "k")]
    _, got = archive(spark, rows, tmp_path / "a", shard_bytes=600)
    assert sorted((str(r.page_id), r.record_type, str(r.refers_to)) for r in got) == [("3", "response", "None"), ("5", "revisit", "3"), *[("None", "response", "None")] * 3]


def test_query_equals_brute_force(spark):
    d = "/root/testdata/sf0.01"
    first, want = {}, []
    for r in sorted(queries.table(spark, d, "pages").collect(), key=lambda r: r.page_id):
        data = (r.html or "").encode()
        revisits = data in first
        want.append((r.page_id, len(data), warc.base32_sha1(data), "revisit" if revisits else "response", first[data] if revisits else None))
        first.setdefault(data, r.page_id)
    assert sorted(map(tuple, queries.op8_warc(spark, d).collect())) == want


def test_small_payloads_stay_responses(spark, tmp_path):
    _, got = archive(spark, ROWS, tmp_path / "a", min_revisit_bytes=100)
    assert {r.record_type for r in got if r.payload_bytes < 100} == {"response"}
    assert sum(r.record_type == "revisit" for r in got) == 1


def test_empty_null_and_uncommitted(spark, tmp_path):
    _, got = archive(spark, [], tmp_path / "a")
    assert got == []
    with pytest.raises(FileNotFoundError):
        warc.read(spark, str(tmp_path / "b"))
