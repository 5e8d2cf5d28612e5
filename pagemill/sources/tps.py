"""A Spark data source for the binary format: ``spark.read.format("tps").option("table", name).load(path)``.

A file's catalog (page tree and table definitions) is decoded once a scan: by the
driver up to the first file that has the table and for files over ``SMALL`` bytes, by
the task that reads it for other files, and by neither where the option ``catalogs``
brings it (see ``catalogs_of``, which decodes on the executors). Tasks get the
definitions with their leaf pages, of one file or of several small ones, and give Arrow
batches of some thousand rows, so a page's rows are decoded once a scan. Equality and IN
filters on ``_source_file`` and range filters on ``_rec_no`` are taken over where Spark
pushes them.

Options: ``table`` (all tables' raw records if not given), ``password``,
``encoding`` (cp1251), ``columns`` (comma-separated; only these are decoded, as
Spark does not prune columns of Python sources), ``dateFields``, ``timeFields``
(LONG fields that hold day counts or times), ``arrays`` (``native`` or ``off``),
``mode`` (``FAILFAST`` or ``PERMISSIVE``: damaged pages are skipped and short
records get nulls), ``recover`` (use damaged definitions), ``pagesPerPartition``,
(leaf pages of a task, more of them where a scan would have over ``MOST_TASKS`` tasks),
``recNo``, ``sourceFile`` (add ``_rec_no``, ``_source_file``), ``raw``, ``damage``
(what cannot be read of a table: damaged pages, and records of another size than
the definition says).

Files are found by the driver: paths in a folder that driver and executors both
mount, or in a store that Arrow knows.

Memos are joined by the (table, record) key: see :func:`pagemill.sources.read.read_table`.
"""

from __future__ import annotations

import base64
import glob
import json
import os
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from itertools import islice
from pathlib import PurePath

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThanOrEqual, In, InputPartition, LessThanOrEqual

from pagemill.codec import arrays, files, pages
from pagemill.codec.types import DEFAULT_ENCODING, FieldDef, TableDef, arrow_column, spark_type
from pagemill.operators import naming

RAW_SCHEMA = "_source_file string, page int, kind string, table_number int, record_number long, body binary"
DAMAGE_SCHEMA = "_source_file string, page int, record_number long, what string"
MEMO_SCHEMA = "_source_file string, table_number int, record_number long, place int, body binary"
#: Bytes of a file whose catalog is left to the task that reads it.
SMALL = 8 * 2**20
#: Each task of a scan costs the driver time, and some KB of metrics, whatever it reads.
MOST_TASKS = 2048
#: Rows and bytes of records after which a batch is given.
BATCH_ROWS, BATCH_BYTES = 8192, 8 * 2**20


def expand(path: str) -> list[tuple[str, str | None]]:
    """(path, archive member) of the databases at a path: a file, a folder, a pattern, or an archive."""
    out: list[tuple[str, str | None]] = []
    for one in path.split(","):
        local = one.removeprefix("file://").removeprefix("file:")
        if "://" in local:
            found = listed(one)
        elif os.path.isdir(local):
            found = sorted(os.path.join(d, n) for d, _, names in os.walk(local) for n in names if PurePath(n).suffix.lower() in (*files.SUFFIXES, files.ARCHIVE))
        else:
            found = sorted(glob.glob(local)) if glob.has_magic(local) else [local]
        for name in found:
            if PurePath(name).suffix.lower() == files.ARCHIVE:
                out += [(name, m) for m, category, _ in files.archive_members(name) if category != "other"]
            else:
                out.append((name, None))
    return out


def listed(path: str) -> list[str]:
    """The databases in a folder of another store, or the path itself if it is a file."""
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    if store.get_file_info(inner).type != fs.FileType.Directory:
        return [path]
    scheme = path[: len(path.rstrip("/")) - len(inner.rstrip("/"))] if path.rstrip("/").endswith(inner.rstrip("/")) else path.split("://")[0] + "://"
    return sorted(scheme + f.path for f in store.get_file_info(fs.FileSelector(inner, recursive=True)) if PurePath(f.path).suffix.lower() in (*files.SUFFIXES, files.ARCHIVE))


def source_name(path: str, member: str | None) -> str:
    return f"{path}!{member}" if member else path


@dataclass(frozen=True)
class ColumnPlan:
    """A column of the result and the fields that it comes from."""

    name: str
    fields: tuple[FieldDef, ...]
    type: T.DataType
    date: bool = False
    time: bool = False


def plan_columns(table: TableDef, options: dict) -> list[ColumnPlan]:
    dates = {x.strip().lower() for x in options.get("datefields", "").split(",") if x.strip()}
    times = {x.strip().lower() for x in options.get("timefields", "").split(",") if x.strip()}
    plain, found = (list(table.fields), []) if options.get("arrays", "native") == "off" else arrays.analyse(table)
    out = []
    for f in plain:
        short = naming.sanitize_field(f.name).lower()
        date, time = bool({short, f.name.lower()} & dates), bool({short, f.name.lower()} & times)
        kind = spark_type(f, date, time)
        out.append((f.name, ColumnPlan("", (f,), T.ArrayType(kind) if f.elements > 1 else kind, date, time)))
    for a in found:
        member = a.members[0]
        if a.single:
            kind = spark_type(member)
        else:
            kind = T.BooleanType() if member.type == "BYTE" else spark_type(member)
        out.append((a.base, ColumnPlan("", a.members, T.ArrayType(kind))))
    names = naming.unique([naming.sanitize_field(n) for n, _ in out])
    plans = [ColumnPlan(n, p.fields, p.type, p.date, p.time) for n, (_, p) in zip(names, out, strict=True)]
    if wanted := options.get("columns"):
        chosen = [c.strip() for c in wanted.split(",") if c.strip()]
        by_name = {p.name.lower(): p for p in plans}
        if missing := [c for c in chosen if c.lower() not in by_name]:
            raise ValueError(f"table {table.name} has no columns {', '.join(missing)}")
        plans = [by_name[c.lower()] for c in chosen]
    return plans


def schema_of(plans: list[ColumnPlan], options: dict) -> T.StructType:
    out = T.StructType()
    if options.get("recno", "false").lower() == "true":
        out.add("_rec_no", T.LongType())
    if options.get("sourcefile", "false").lower() == "true":
        out.add("_source_file", T.StringType())
    for p in plans:
        out.add(p.name, p.type)
    return out


def flag(options: dict, name: str) -> bool:
    return options.get(name.lower(), "false").lower() == "true"


def opened(path: str, member: str | None, options: dict) -> files.Database:
    return files.Database(path, options.get("password"), options.get("encoding", DEFAULT_ENCODING), member, flag(options, "recover"))


def catalog_of(one: tuple[str, str | None], options: dict) -> files.Catalog:
    with opened(*one, options) as db:
        return db.catalog


def over_files(spark: SparkSession, work, found: list[tuple[str, str | None]]) -> list:
    """What a function gives for each of many files, in their order, worked out on the executors. What it raises is raised here as it is."""

    def tried(one):
        try:
            return work(one), None
        except Exception as e:
            return None, e

    sc = spark.sparkContext
    done = sc.parallelize(found, min(len(found), 4 * sc.defaultParallelism)).map(tried).collect()
    if bad := next((e for _, e in done if e is not None), None):
        raise bad
    return [x for x, _ in done]


def catalogs_of(path: str, options: dict, spark: SparkSession | None = None) -> dict[tuple[str, str | None], files.Catalog]:
    """The catalog of every database at a path; each file is decoded once for it, on the executors if there are several and a session is given."""
    found = expand(path)
    if spark is None or len(found) < 2:
        return {one: catalog_of(one, options) for one in found}
    return dict(zip(found, over_files(spark, lambda one: catalog_of(one, options), found), strict=True))


def catalogs_text(catalogs: dict[tuple[str, str | None], files.Catalog]) -> str:
    """Catalogs as a value of the option ``catalogs``."""
    text = json.dumps([list(catalogs), files.catalogs_text(catalogs.values())])
    return base64.b64encode(zlib.compress(text.encode())).decode()


def catalogs_from(text: str) -> dict[tuple[str, str | None], files.Catalog]:
    keys, made = json.loads(zlib.decompress(base64.b64decode(text)))
    return dict(zip(((p, m) for p, m in keys), files.catalogs_from(made), strict=True))


def size_of(path: str) -> int:
    with files.open_bytes(path) as f:
        return f.seek(0, 2)


def kind_of(options: dict) -> str:
    if "table" not in options or flag(options, "raw"):
        return "raw"
    return "memos" if flag(options, "memos") else "damage" if flag(options, "damage") else "rows"


@dataclass
class Piece:
    """Some leaves of a file, from one place to another in the order of the tree; without leaves, all of a file whose catalog the task decodes."""

    path: str
    member: str | None
    leaves: files.Leaves | None
    start: int
    stop: int
    table: TableDef | None

    def refs(self) -> list[int]:
        return list(islice(self.leaves, self.start, self.stop))


@dataclass
class Chunk(InputPartition):
    pieces: list[Piece]


class TpsReader(DataSourceReader):
    def __init__(self, source: TpsDataSource, schema: T.StructType):
        self.options = {k.lower(): v for k, v in source.options.items() if k.lower() != "catalogs"}
        self.catalogs = source.catalogs()
        self.schema = schema
        self.sources: set[str] | None = None
        self.least: int | None = None
        self.most: int | None = None

    def __getstate__(self):
        return {**self.__dict__, "catalogs": {}}  # tasks need no more than their chunk

    def partitions(self):
        kind = kind_of(self.options)
        same: dict[TableDef, TableDef] = {}
        wanted = []
        for (path, member), catalog in self.catalogs.items():
            if self.sources is not None and source_name(path, member) not in self.sources:
                continue
            if isinstance(catalog, int):  # a small file's bytes; its pages take some units each
                wanted.append((max(1, catalog // (4 * files.UNIT)), Piece(path, member, None, 0, 0, None)))
                continue
            table = catalog.table(self.options["table"]) if kind != "raw" else None
            if kind == "raw" or table is not None:
                wanted.append((len(catalog.leaves), Piece(path, member, catalog.leaves, 0, len(catalog.leaves), table and same.setdefault(table, table))))
        per = max(int(self.options.get("pagesperpartition", "256")), -(-sum(n for n, _ in wanted) // MOST_TASKS))
        out, room = [], 0
        for n, piece in wanted:
            start = 0
            while start < n:
                if not room:
                    out.append(Chunk([]))
                    room = per
                size = min(room, n - start)
                out[-1].pieces.append(piece if piece.leaves is None else replace(piece, start=start, stop=start + size))
                room -= size
                start = start + size if piece.leaves is not None else n
        return out or [Chunk([])]

    def _pages(self, db: files.Database, refs: list[int]) -> Iterator[tuple[int, list[bytes]]]:
        permissive = self.options.get("mode", "FAILFAST").upper() != "FAILFAST"
        for ref in refs:
            try:
                yield ref, db.raw_records(db.page(ref))
            except pages.CorruptPage:
                if not permissive:
                    raise

    def read(self, chunk: Chunk):
        kind = kind_of(self.options)
        for piece in chunk.pieces:
            name = source_name(piece.path, piece.member)
            with opened(piece.path, piece.member, self.options) as db:
                if piece.leaves is not None:
                    table, refs = piece.table, piece.refs()
                else:
                    table = db.catalog.table(self.options["table"]) if kind != "raw" else None
                    if kind != "raw" and table is None:
                        continue
                    refs = [p.ref for p in db.leaves]
                if kind == "rows":
                    yield from self._scan(db, refs, table, name)
                else:
                    yield from self._batches({"damage": self._damage, "raw": self._raw, "memos": self._memos}[kind](db, refs, table, name))

    def _scan(self, db: files.Database, refs: list[int], table: TableDef, name: str) -> Iterator[pa.RecordBatch]:
        plans = plan_columns(table, self.options)
        held: list[bytes] = []
        size = 0
        for _, raws in self._pages(db, refs):
            held += (mine := pages.raws_of(raws, table.number))
            size += sum(map(len, mine))
            if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
                yield from self._picked(held, plans, name)
                held, size = [], 0
        yield from self._picked(held, plans, name)

    def _picked(self, raws: list[bytes], plans: list[ColumnPlan], name: str) -> Iterator[pa.RecordBatch]:
        numbers, bodies = pages.numbered(raws)
        if self.least is not None or self.most is not None:
            kept = [k for k, n in enumerate(numbers) if (self.least is None or n >= self.least) and (self.most is None or n <= self.most)]
            numbers, bodies = numbers[kept], [bodies[k] for k in kept]
        if bodies:
            yield self._rows(numbers, bodies, plans, name)

    def _raw(self, db: files.Database, refs: list[int], table: TableDef | None, name: str) -> Iterator[tuple]:
        for ref, raws in self._pages(db, refs):
            yield from ((name, ref, r.kind, r.table, r.number, r.body) for r in map(pages.parse_record, raws))

    def _memos(self, db: files.Database, refs: list[int], table: TableDef, name: str) -> Iterator[tuple]:
        for ref, raws in self._pages(db, refs):
            yield from ((name, r.table, r.number, ref * 65536 + i, r.body) for i, r in enumerate(map(pages.parse_record, raws)) if r.kind == pages.MEMO and r.table == table.number)

    def _damage(self, db: files.Database, refs: list[int], table: TableDef, name: str) -> Iterator[tuple]:
        for ref in refs:
            try:
                raws = pages.raws_of(db.raw_records(db.page(ref)), table.number)
            except pages.CorruptPage as e:
                yield name, ref, None, str(e)
                continue
            if any(len(r) != table.record_size + 9 for r in raws):
                for number, body in zip(*pages.numbered(raws), strict=True):
                    if len(body) != table.record_size:
                        yield name, ref, int(number), f"a record of {len(body)} bytes, not {table.record_size}"

    def _batches(self, rows: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for row in rows:
            held.append(row)
            size += len(row[-1])
            if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
                yield self._batch(held)
                held, size = [], 0
        if held:
            yield self._batch(held)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
        columns = list(zip(*rows, strict=True)) or [()] * len(self.schema)
        return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[f.dataType.simpleString()]) for c, f in zip(columns, self.schema, strict=True)], self.schema.names)

    def _rows(self, numbers: np.ndarray, bodies: list[bytes], plans: list[ColumnPlan], source: str) -> pa.RecordBatch:
        from pyspark.sql.pandas.types import to_arrow_type

        encoding = self.options.get("encoding", DEFAULT_ENCODING)
        by_name = {p.name: p for p in plans}
        out = []
        for f in self.schema.fields:
            kind = to_arrow_type(f.dataType)
            if f.name in by_name:
                p = by_name[f.name]
                out.append(arrow_column(bodies, p.fields, kind, encoding, p.date, p.time))
            elif f.name == "_rec_no":
                out.append(pa.array(numbers, kind))
            else:
                out.append(pa.array([source if f.name == "_source_file" else None] * len(bodies), kind))
        return pa.RecordBatch.from_arrays(out, self.schema.names)


class PushingReader(TpsReader):
    """Takes filters over; Spark refuses a reader that does unless spark.sql.python.filterPushdown.enabled is true."""

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if len(f.attribute) == 1 else None
            if name == "_source_file" and isinstance(f, (EqualTo, In)):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.sources = wanted if self.sources is None else self.sources & wanted
            elif name == "_rec_no" and isinstance(f, (EqualTo, GreaterThanOrEqual)):
                self.least = f.value if self.least is None else max(self.least, f.value)
            if name == "_rec_no" and isinstance(f, (EqualTo, LessThanOrEqual)):
                self.most = f.value if self.most is None else min(self.most, f.value)
            yield f  # Spark applies every filter again


class TpsDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tps"

    def _lowered(self) -> dict:
        return {k.lower(): v for k, v in self.options.items()}

    def catalogs(self) -> dict[tuple[str, str | None], files.Catalog | int]:
        """The catalogs of the path, or those that were brought along, which name the files then; of a small file whose catalog nothing here needs, its bytes. They are kept here, and Spark hands this object from schema() on to the reader, so each file is decoded once a scan."""
        if not hasattr(self, "_catalogs"):
            o = self._lowered()
            if "path" not in o:
                raise ValueError("load() needs a path")
            brought = o.get("catalogs")
            self._catalogs = catalogs_from(brought) if brought else self._needed(o)
        return self._catalogs

    def _needed(self, o: dict) -> dict[tuple[str, str | None], files.Catalog | int]:
        out, met = {}, kind_of(o) != "rows"
        for one in expand(o["path"]):
            size = size_of(one[0]) if met and one[1] is None else SMALL + 1
            out[one] = size if size <= SMALL else catalog_of(one, o)
            met = met or out[one].table(o["table"]) is not None
        return out

    def schema(self):
        o = self._lowered()
        found = self.catalogs()
        kind = kind_of(o)
        if kind != "rows":
            return {"raw": RAW_SCHEMA, "memos": MEMO_SCHEMA, "damage": DAMAGE_SCHEMA}[kind]
        for catalog in found.values():
            if not isinstance(catalog, int) and (table := catalog.table(o["table"])):
                return schema_of(plan_columns(table, o), o)
        raise ValueError(f"{o['path']} has no table {o['table']!r}")

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return (PushingReader if flag(self._lowered(), "pushdown") else TpsReader)(self, schema)
