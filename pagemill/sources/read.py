"""Reading databases as DataFrames: catalogs, tables with their memos, archives, and SQLite files."""

from __future__ import annotations

import logging
import sqlite3
from collections.abc import Iterator
from pathlib import PurePath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from pagemill.codec import files, pages
from pagemill.codec.types import DEFAULT_ENCODING, TableDef
from pagemill.operators import naming, sizing
from pagemill.sources.tps import TpsDataSource, catalogs_of, catalogs_text, expand, opened, over_files, source_name

log = logging.getLogger(__name__)
Catalogs = dict[tuple[str, "str | None"], files.Catalog]

#: Row ids of a SQLite table in a task, unless the option numPartitions says otherwise.
ROWS_PER_PART = 100_000
CATALOG = "source_file string, table_number int, table_name string, record_size int, n_fields int, n_memos int, n_indexes int, stated_rows long, recovered boolean"
FIELDS = "source_file string, table_name string, place int, field_name string, type string, offset int, size int, elements int, decimals int"


def register(spark: SparkSession) -> None:
    """Make the formats ``tps`` and ``sqlite_file`` known to a session."""
    spark.dataSource.register(TpsDataSource)
    spark.dataSource.register(SqliteSource)


def databases(path: str, password: str | None = None, encoding: str = DEFAULT_ENCODING, recover: bool = False) -> Iterator[tuple[str, files.Database]]:
    for one, member in expand(path):
        with files.Database(one, password, encoding, member, recover) as db:
            yield source_name(one, member), db


def catalogs(path: str, spark: SparkSession | None = None, **options) -> Catalogs:
    """The catalog of every database at a path, worked out on the executors of a session if one is given. Readers that are given it decode none again."""
    return catalogs_of(path, {k.lower(): str(v) for k, v in options.items() if v is not None}, spark)


def definitions(path: str, known: Catalogs | None = None, spark: SparkSession | None = None, **options) -> dict[tuple[str, str], TableDef]:
    """The table definitions by (source file, table name)."""
    return {(source_name(*key), t.name): t for key, c in (catalogs(path, spark, **options) if known is None else known).items() for t in c.tables if t.name}


def catalog(spark: SparkSession, path: str, **options) -> DataFrame:
    """A row per table of every database at a path."""
    rows = [
        (s, t.number, t.name, t.record_size, len(t.fields), len(t.memos), len(t.indexes), next((n for n, _ in t.statistics.values()), None), t.recovered)
        for (s, _), t in definitions(path, spark=spark, **options).items()
    ]
    return spark.createDataFrame(rows, CATALOG)


def catalog_totals(tables: DataFrame) -> DataFrame:
    """Tables, fields, indexes and stated rows of each file and table, of each file, and of all, in one pass: what is null is summed over."""
    return tables.rollup("source_file", "table_name").agg(F.count(F.lit(1)).alias("n_tables"), F.sum("n_fields").alias("n_fields"), F.sum("n_indexes").alias("n_indexes"), F.sum("stated_rows").alias("n_rows"))


def fields(spark: SparkSession, path: str, **options) -> DataFrame:
    """A row per field of every table at a path."""
    rows = [(s, n, i, f.name, f.type, f.offset, f.size, f.elements, f.decimals) for (s, n), t in definitions(path, spark=spark, **options).items() for i, f in enumerate(t.fields)]
    return spark.createDataFrame(rows, FIELDS)


def page_warnings(spark: SparkSession, path: str, **options) -> DataFrame:
    """What the integrity checks find."""

    def work(one: tuple[str, str | None]) -> list[tuple[str, int, str]]:
        with files.Database(one[0], options.get("password"), options.get("encoding", DEFAULT_ENCODING), one[1], options.get("recover", False)) as db:
            return [(source_name(*one), w.page, w.what) for w in db.check()]

    found = expand(path)
    rows = [row for some in (over_files(spark, work, found) if len(found) > 1 else map(work, found)) for row in some]
    return spark.createDataFrame(rows, "source_file string, page int, warning string")


def archive(spark: SparkSession, path: str) -> DataFrame:
    """The members of an archive."""
    return spark.createDataFrame(files.archive_members(path), "member string, category string, size long")


def estimate(path: str, table: str, known: Catalogs | None = None, pages_sampled: int = 20, **options) -> dict:
    """Rows and MB of a table at a path, from its rows on a few leaf pages, with the advice that follows from them.

    As the size of a record is known, MB are rows times it. The pages are spread
    evenly over each file; a file with no more pages than that is counted.
    """
    lowered = {k.lower(): str(v) for k, v in options.items() if v is not None}
    rows = size = 0.0
    n_pages = n_sampled = 0
    for key, c in (catalogs(path, **options) if known is None else known).items():
        definition = c.table(table)
        if definition is None or not c.leaves:
            continue
        step = max(1, len(c.leaves) // pages_sampled)
        some = list(c.leaves)[::step][:pages_sampled] if len(c.leaves) > pages_sampled else list(c.leaves)
        seen = 0
        with opened(*key, lowered) as db:
            for ref in some:
                try:
                    seen += len(pages.rows_of(db.raw_records(db.page(ref)), definition.number)[1])
                except pages.CorruptPage:
                    continue
        found = seen * len(c.leaves) / len(some)
        rows, size = rows + found, size + found * definition.record_size
        n_pages, n_sampled = n_pages + len(c.leaves), n_sampled + len(some)
    rows, mb = round(rows), size / 2**20
    return {"estimated_records": rows, "estimated_size_mb": mb, "sample_pages": n_sampled, "total_pages": n_pages, **sizing.advice(rows, mb)}


def damage(spark: SparkSession, path: str, table: str, known: Catalogs | None = None, **options) -> DataFrame:
    """What cannot be read of a table: a row for each damaged page, and for each record of another size than the definition says."""
    return _reader(spark, table, known, options).option("damage", "true").load(path)


def _reader(spark: SparkSession, table: str, known: Catalogs | None, options: dict):
    register(spark)
    reader = spark.read.format("tps").option("table", table)
    if known is not None:
        reader = reader.option("catalogs", catalogs_text(known))
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader


def read_table(spark: SparkSession, path: str, table: str, memos: bool = True, known: Catalogs | None = None, **options) -> DataFrame:
    """A table of every database at a path, its memos attached by (source file, record number).

    The k-th memo record of a row, in file order, belongs to the table's k-th
    memo; text memos are decoded, blobs stay bytes, external ones are null, with a
    warning in the log. ``known`` are the path's catalogs, if they have been read.
    """
    known = catalogs(path, spark, **options) if known is None else known
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    reader = _reader(spark, table, known, options).option("pushdown", pushdown)
    found = next((t for c in known.values() if (t := c.table(table))), None)
    for memo in found.memos if found else ():
        if memo.external:
            log.warning("table %s: memo %s is in the file %s, which is not read", found.name, memo.name, memo.external)
    if found is None or not found.memos or not memos:
        return reader.load(path)
    rows = reader.option("recNo", "true").option("sourceFile", "true").load(path)
    encoding = options.get("encoding", DEFAULT_ENCODING)

    @F.pandas_udf("string")
    def decode(values):
        return values.map(lambda b: None if b is None else bytes(b).replace(b"\0", b"").decode(encoding, "replace"))

    raw = _reader(spark, table, known, options).option("memos", "true")
    held = raw.load(path).groupBy("_source_file", "record_number").agg(F.array_sort(F.collect_list(F.struct("place", "body"))).alias("__m"))
    joined = rows.join(held, (rows["_rec_no"] == held["record_number"]) & (rows["_source_file"] == held["_source_file"]), "left")
    out = [rows[f"`{c}`"] for c in rows.columns if c not in ("_rec_no", "_source_file") or str(options.get({"_rec_no": "recNo", "_source_file": "sourceFile"}[c], "false")).lower() == "true"]
    names = naming.unique([*[c for c in rows.columns], *[naming.sanitize_field(m.name) for m in found.memos]])[len(rows.columns) :]
    for i, (memo, name) in enumerate(zip(found.memos, names, strict=True)):
        body = F.get(F.col("__m"), F.lit(i))["body"]
        body = F.when(F.length(body) > 0, body)
        out.append((F.lit(None).cast("string") if memo.external else body if memo.blob else decode(body)).alias(name))
    return joined.select(*out)


def topread(spark: SparkSession, path: str, password: str | None = None, table: str = "UNNAMED") -> DataFrame:
    """The rows of a one-table file with short names; strings end at their first zero character."""
    options = {"password": password} if password is not None else {}
    df = read_table(spark, path, table, **options)
    return df.select(*[F.substring_index(F.col(f"`{f.name}`"), "\0", 1).alias(f.name) if f.dataType.simpleString() == "string" else F.col(f"`{f.name}`") for f in df.schema])


def valid_inputs(paths: list[str]) -> tuple[list[str], list[str]]:
    """Paths that can be read as databases or archives, and those that cannot."""
    good, bad = [], []
    for path in paths:
        try:
            suffix = PurePath(path).suffix.lower()
            if suffix not in (*files.SUFFIXES, files.ARCHIVE):
                raise ValueError(path)
            files.open_bytes(path).close()
            good.append(path)
        except (OSError, ValueError):
            bad.append(path)
    return good, bad


class SqlitePart(InputPartition):
    """A range of row ids, or all of a table that has none."""

    def __init__(self, low: int | None, high: int | None):
        super().__init__((low, high))


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.path, self.table, self.schema = options["path"], options["table"], schema
        self.n = int(options["numPartitions"]) if "numPartitions" in options else None

    def partitions(self):
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as con:
            try:
                low, high = con.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
            except sqlite3.OperationalError:  # a table WITHOUT ROWID, or a view
                return [SqlitePart(None, None)]
        if low is None:
            return [SqlitePart(0, -1)]
        step = max(1, -(-(high - low + 1) // self.n)) if self.n else ROWS_PER_PART
        return [SqlitePart(a, min(high, a + step - 1)) for a in range(low, high + 1, step)]

    def read(self, part: SqlitePart):
        low, high = part.value
        names = ", ".join(f'"{f.name}"' for f in self.schema.fields)
        casts = [{"bigint": int, "double": float, "string": str, "binary": bytes}[f.dataType.simpleString()] for f in self.schema.fields]
        some = ("", ()) if low is None else (" WHERE rowid BETWEEN ? AND ? ORDER BY rowid", (low, high))
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as con:
            for row in con.execute(f'SELECT {names} FROM "{self.table}"{some[0]}', some[1]):
                yield tuple(None if x is None else x.encode() if c is bytes and isinstance(x, str) else c(x) for x, c in zip(row, casts, strict=True))


class SqliteSource(DataSource):
    """Tables of a SQLite file, by ranges of row ids: ``format("sqlite_file").option("table", t).load(path)``."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_file"

    def schema(self):
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as con:
            columns = con.execute(f'PRAGMA table_info("{self.options["table"]}")').fetchall()
        if not columns:
            raise ValueError(f"{self.options['path']} has no table {self.options['table']!r}")

        def kind(declared: str) -> str:
            up = declared.upper()
            return "bigint" if "INT" in up else "double" if any(x in up for x in ("REAL", "FLOA", "DOUB", "NUM", "DEC")) else "binary" if "BLOB" in up else "string"

        return ", ".join(f"`{c[1]}` {kind(c[2] or 'TEXT')}" for c in columns)

    def reader(self, schema):
        return SqliteReader(self.options, schema)


def sqlite_tables(path: str) -> list[str]:
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as con:
        return [r[0] for r in con.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name")]
