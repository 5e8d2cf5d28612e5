"""Landing databases as Parquet tables, merging them, and writing tables back to the binary format."""

from __future__ import annotations

import codecs
import threading
import time
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import suppress
from dataclasses import dataclass, field
from functools import reduce
from itertools import count, islice
from pathlib import Path

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.codec import files
from pagemill.codec.types import DEFAULT_ENCODING, ONE_BYTE, FieldDef, MemoDef, TableDef, encode_columns
from pagemill.operators import ddl, naming, sizing
from pagemill.operators.errors import ErrorLog, TooManyErrors, last, summary
from pagemill.sinks import store
from pagemill.sources import read
from pagemill.sources.tps import plan_columns, schema_of, source_name

MANIFEST = "_landed.json"
SCHEMA_SCRIPT = "_schema.sql"
#: Rows that a task of write_parts encodes, if there are tasks enough for every core.
ROWS_PER_TASK = 50_000


@dataclass
class Landed:
    """What a landing did: tables with their rows, rows and pages that could not be read whole, and errors of tables that failed."""

    tables: dict[str, int] = field(default_factory=dict)
    errors: list[tuple[str, str]] = field(default_factory=list)
    skipped: list[str] = field(default_factory=list)
    damaged: dict[str, int] = field(default_factory=dict)
    files: int = 0
    seconds: float = 0.0
    log: ErrorLog = field(default_factory=ErrorLog)

    @property
    def success(self) -> bool:
        return not self.errors

    @property
    def partial(self) -> bool:
        """Whether some tables landed and others did not."""
        return bool(self.errors) and bool(self.tables)

    @property
    def totals(self) -> dict[str, float]:
        rows = sum(n for n in self.tables.values() if n > 0)
        return {"files": self.files, "tables": len(self.tables), "records": rows, "errors": len(self.errors), "damaged": sum(self.damaged.values()), "seconds": self.seconds, "records_per_second": rows / self.seconds if self.seconds else 0.0}

    def errors_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.errors, "table_name string, error string")


def plan_names(found: dict[tuple[str, str], TableDef], strategy: str) -> dict[str, list[tuple[str, str]]]:
    """Target names and the (file, table) that go there. Tables of one target are united."""
    sources = {s: n for n, s in enumerate(dict.fromkeys(s for s, _ in found), 1)}
    out: dict[str, list[tuple[str, str]]] = {}
    for source, table in found:
        n = sources[source]
        prefix = {"plain": "", "extension": naming.file_prefix(source.rpartition("!")[2], n), "prefix": f"file_{n}_", "namespace": f"db_{n}_", "separate": ""}[strategy]
        out.setdefault(prefix + naming.sanitize_table(table), []).append((source, table))
    return out


def _write(df: DataFrame, path: str) -> int:
    """Write a table as Parquet and return its rows, counted as they are written."""
    counted = Observation()
    df.observe(counted, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(path)
    return counted.get["n"]


def land(
    spark: SparkSession,
    path: str,
    out_dir: str,
    strategy: str = "plain",
    resume: bool = False,
    max_errors: int | None = None,
    progress: Callable[[int, int, str], None] | None = None,
    write: Callable[[DataFrame, str], None] | None = None,
    policy: sizing.Policy = sizing.DEFAULT,
    threads: int | None = None,
    schema_only: bool = False,
    **options,
) -> Landed:
    """Write every table of the databases at a path to ``out_dir``/<name> as Parquet.

    Files are decoded for their catalogs once, on the executors. Tables land as concurrent Spark jobs
    on ``threads`` threads (the policy's number, if not given), each in as many tasks
    as it has chunks of pages. A table that fails is tried again as the log's
    strategies say, and does not stop the others, up to ``max_errors``; then what
    has not begun does not begin. A manifest of finished tables lets a later call
    with ``resume`` skip them; it is kept by the output, on any file system. Tables
    of several files with one target name are united by column name, with
    ``_source_file`` telling them apart; those with like columns are one scan, as a union
    has every task know, and report on, all of its branches. With the option mode=PERMISSIVE, what a
    table lost to damage is counted. ``schema_only`` writes empty tables.
    """
    began = time.time()
    known = read.catalogs(path, spark, **options)
    found = read.definitions(path, known=known)
    targets = plan_names(found, strategy)
    done_path = f"{out_dir.rstrip('/')}/{MANIFEST}"
    resume = resume or policy.enable_resume_capability
    finished: dict[str, int] = (store.read_checkpoint(spark, done_path) if resume else None) or {}
    result = Landed(files=len(known), log=ErrorLog(max_errors or policy.max_consecutive_errors))
    by_file = {source_name(*key): (key, c) for key, c in known.items()}
    lock = threading.Lock()
    begun = 0

    def alike(parts: list[tuple[str, str]], now: dict) -> list[list[tuple[str, str]]]:
        """The parts by table and columns, in the order that they are met in."""
        lowered = {k.lower(): str(v) for k, v in now.items() if v is not None}
        groups: dict[tuple, list[tuple[str, str]]] = {}
        columns: dict[TableDef, tuple] = {}
        for source, table in parts:
            t = found[source, table]
            if t not in columns:
                columns[t] = schema_of(plan_columns(t, lowered), lowered).json(), t.memos
            groups.setdefault((table, *columns[t]), []).append((source, table))
        return list(groups.values())

    def frame(parts: list[tuple[str, str]], now: dict) -> DataFrame:
        made = []
        for group in alike(parts, now):
            some = [found[x] for x in group]
            pages = min(policy.pages_per_partition(t.record_size, len(t.fields), next((n for n, _ in t.statistics.values()), None)) for t in some)
            own = {"pagesPerPartition": pages, **now}
            df = read.read_table(spark, path, group[0][1], known=dict(by_file[s] for s, _ in group), **own, sourceFile="true")
            made.append(df if len(parts) > 1 else df.drop("_source_file"))
        df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), made)
        return df.limit(0) if schema_only else df

    def one(name: str, parts: list[tuple[str, str]]) -> None:
        nonlocal begun
        target = f"{out_dir.rstrip('/')}/{name}"
        with lock:
            if len(result.errors) >= result.log.max_errors:
                return
            begun += 1
            if progress:
                progress(begun, len(targets), name)
            if name in finished:
                result.skipped.append(name)
                result.tables[name] = finished[name]
                return
        try:

            def work(now: dict) -> int:
                df = frame(parts, now)
                if write is not None:
                    write(df, target)
                    return -1
                return _write(df, target)

            n = result.log.run(work, dict(options), table=name)
            lost = 0
            if str(options.get("mode", "")).upper() == "PERMISSIVE" or any(e.recovery_action == "skip_corrupt_record" and e.context.get("table") == name for e in result.log.entries):
                by_table: dict[str, dict] = {}
                for source, table in parts:
                    by_table.setdefault(table, {}).update([by_file[source]])
                lost = sum(read.damage(spark, path, table, known=some, **options).count() for table, some in by_table.items())
            with lock:
                result.tables[name] = finished[name] = n
                if lost:
                    result.damaged[name] = lost
                    result.log.add(f"{lost} damaged pages and records", "data_parsing", "warning", "skip_corrupt_record", table=name)
                store.write_checkpoint(spark, done_path, finished)
        except Exception as e:  # one table's failure is reported, not fatal
            with lock:
                result.errors.append((name, f"{type(e).__name__}: {str(e)[:500]}"))
            with suppress(TooManyErrors):
                result.log.add(e, table=name)

    if schema_only:
        store.write_text(spark, f"{out_dir.rstrip('/')}/{SCHEMA_SCRIPT}", ddl.script(list(found.values())))
    with ThreadPoolExecutor(max(1, threads or policy.threads)) as pool:
        list(pool.map(lambda x: one(*x), targets.items()))
    result.seconds = time.time() - began
    return result


def longest(df: DataFrame, encoding: str) -> dict[str, tuple[int, int]]:
    """Most elements, and most encoded bytes of a text, of every column that has texts or arrays; 0 where there is none. One pass over the data."""
    return _measured(df, encoding, count_rows=False)[1]


def _measured(df: DataFrame, encoding: str, count_rows: bool = True) -> tuple[int, dict[str, tuple[int, int]]]:
    """The number of rows, and what ``longest`` says of them."""
    name = codecs.lookup(encoding).name
    if name.startswith(ONE_BYTE):  # a byte for each character, also for those that have none and become a question mark
        one = F.length
    elif name == "utf-8":
        one = F.octet_length
    else:
        one = None
    if one:
        size = lambda c, many: F.array_max(F.transform(c, one)) if many else one(c)
    else:
        encoded = F.udf(lambda values: max((len(str(v).encode(encoding, "replace")) for v in values or [] if v is not None), default=0), "int")
        size = lambda c, many: encoded(c if many else F.array(c))
    wanted = {}
    for f in df.schema.fields:
        many = isinstance(f.dataType, T.ArrayType)
        if many or isinstance(f.dataType, T.StringType):
            c = F.col(f"`{f.name}`")
            text = isinstance(f.dataType.elementType if many else f.dataType, T.StringType)
            wanted[f.name] = F.max(F.size(c) if many else F.lit(1)), F.max(size(c, many)) if text else F.lit(0)
    if not wanted and not count_rows:
        return 0, {}
    row = df.agg(F.count(F.lit(1)).alias("n"), *[x.alias(f"c{i}_{k}") for i, pair in enumerate(wanted.values()) for k, x in enumerate(pair)]).first()
    return row["n"], {name: (max(row[f"c{i}_0"] or 0, 0), row[f"c{i}_1"] or 0) for i, name in enumerate(wanted)}


def fields_for(schema: T.StructType, text_size: int = 255, most: dict[str, tuple[int, int]] | None = None) -> tuple[tuple[FieldDef, ...], tuple[MemoDef, ...], int]:
    """Binary fields and memos of a Spark schema, and the record size.

    The metadata ``size`` and ``elements`` of a column hold. Without them, ``most``
    (see ``longest``) sets them: arrays have room for the longest, and texts of
    more than ``text_size`` bytes are memos.
    """
    fields, memos, at = [], [], 0
    for f in schema.fields:
        kind, elements = f.dataType, 1
        count, width = (most or {}).get(f.name, (0, 0))
        if isinstance(kind, T.ArrayType):
            # a field of one element would be no array
            kind, elements = kind.elementType, int(f.metadata.get("elements", max(2, count) if count else 12))
            width = max(width, text_size)
        elif width > text_size and "size" not in f.metadata:
            memos.append(MemoDef(f.name, 0))
            continue
        else:
            width = text_size
        if isinstance(kind, (T.BinaryType,)):
            memos.append(MemoDef(f.name, 0, blob=True))
            continue
        name, size, decimals = {
            "boolean": ("BYTE", 1, 0), "tinyint": ("SHORT", 2, 0), "smallint": ("SHORT", 2, 0), "int": ("LONG", 4, 0), "bigint": ("DECIMAL", 10, 0), "float": ("FLOAT", 4, 0),
            "double": ("DOUBLE", 8, 0), "string": ("STRING", int(f.metadata.get("size", width)), 0), "date": ("DATE", 4, 0),
        }.get(kind.simpleString(), ("", 0, 0))
        if isinstance(kind, T.DecimalType):
            name, size, decimals = "DECIMAL", kind.precision // 2 + 1, kind.scale
        if not name:
            raise ValueError(f"column {f.name}: the format has no {kind.simpleString()}")
        fields.append(FieldDef(f.name, name, at, size * elements, elements, len(fields), 0, size if elements > 1 else 0, 0, decimals))
        at += size * elements
    if at > 0xFFFF:
        raise ValueError(f"a record of {at} bytes: the format has at most 65535")
    return tuple(fields), tuple(memos), at


def write_database(tables: dict[str, DataFrame], path: str, **options) -> int:
    """Write tables as one database file and return its rows.

    One file is one stream of pages, so the driver writes it; rows arrive one
    partition at a time, in the order of the DataFrame. Sizes of texts and arrays
    come from the metadata of their columns or else from a pass over the data; a
    value that does not fit raises ValueError. Where several files will do, use
    :func:`write_parts`, which writes on the executors.
    """
    n = 0

    def rows(df: DataFrame):
        nonlocal n
        for r in df.toLocalIterator(prefetchPartitions=True):
            n += 1
            yield r.asDict()

    made = []
    for number, (name, df) in enumerate(tables.items(), 1):
        fields, memos, size = fields_for(df.schema, most=longest(df, options.get("encoding", DEFAULT_ENCODING)))
        made.append((TableDef(number, name, size, fields, memos), rows(df)))
    data = files.encode_file(made, **options)
    Path(path).write_bytes(data)
    return n


def write_parts(df: DataFrame, folder: str, table: str, rows_per_file: int = 50_000, **options) -> DataFrame:
    """Write a table as database files of a bounded number of rows each, on the executors, and return (file, n_rows).

    All files have the same definition, so the folder reads as one table. The
    folder is one that driver and executors share. Files get names of their task's
    attempt first and their own names once they are whole, so a task that is
    repeated replaces what its first attempt left. Rows are dealt out evenly to as
    many tasks as their number calls for, as an input of few parts would keep few
    cores busy.
    """
    n, most = _measured(df, options.get("encoding", DEFAULT_ENCODING))
    fields, memos, size = fields_for(df.schema, most=most)
    tasks = min(-(-n // rows_per_file), max(df.sparkSession.sparkContext.defaultParallelism, -(-n // ROWS_PER_TASK)))
    definition = TableDef(1, table, size, fields, memos)
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, root = (pafs.LocalFileSystem(), folder.removeprefix("file://").removeprefix("file:")) if folder.startswith(("/", "file:")) else pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        encoding = options.get("encoding", DEFAULT_ENCODING)

        def records(b: pa.RecordBatch) -> Iterable[bytes | dict]:
            made = None if memos or "_rec_no" in names or not fields else encode_columns(dict(zip(names, b.columns, strict=True)), definition, encoding)
            return made if made is not None else (dict(zip(names, row, strict=True)) for row in zip(*(c.to_pylist() for c in b.columns), strict=True))

        rows = (row for b in batches for row in records(b))
        for k in count():
            some = list(islice(rows, rows_per_file))
            if not some:
                return
            name = f"part-{task.partitionId():05d}-{k:04d}.tps"
            temporary = f"{root}/_{name}.{task.taskAttemptId()}"
            with fs.open_output_stream(temporary) as f:
                f.write(files.encode_file([(definition, iter(some))], **options))
            fs.move(temporary, f"{root}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(some)], pa.int64())], ["file", "n_rows"])

    done = (df.repartition(tasks) if tasks > 1 else df).mapInArrow(run, "file string, n_rows long").collect()  # a row for each file
    return df.sparkSession.createDataFrame([tuple(r) for r in done], "file string, n_rows long")


def reverse(spark: SparkSession, sqlite_path: str, out_dir: str) -> dict[str, int]:
    """A SQLite file as database files: tables with a phd_, mod_ or tps_ prefix go to a file of that kind, others to a .tps file."""
    read.register(spark)
    by_kind: dict[str, dict[str, DataFrame]] = {}
    for name in read.sqlite_tables(sqlite_path):
        kind, bare = (name[:3], name[4:]) if name[:4] in ("phd_", "mod_", "tps_") else ("tps", name)
        by_kind.setdefault(kind, {})[bare] = spark.read.format("sqlite_file").option("table", name).load(sqlite_path)
    Path(out_dir).mkdir(parents=True, exist_ok=True)
    stem = Path(sqlite_path).stem
    return {f"{stem}.{kind}": write_database(tables, f"{out_dir}/{stem}.{kind}") for kind, tables in by_kind.items()}


def report(title: str, frames: dict[str, DataFrame], most: int = 20) -> str:
    """A text report of result frames, the first rows of each."""
    out = [title, "=" * len(title)]
    for name, df in frames.items():
        rows = df.limit(most).collect()
        out += ["", name, "-" * len(name), " | ".join(df.columns), *[" | ".join(map(str, r)) for r in rows]]
    return "\n".join(out) + "\n"


def landing_report(spark: SparkSession, done: Landed) -> str:
    """A text report of a landing: totals, tables, errors by kind and the last of them."""
    totals = spark.createDataFrame([(k, float(v)) for k, v in done.totals.items()], "what string, value double")
    tables = spark.createDataFrame(sorted(done.tables.items()), "table_name string, rows long")
    errors = done.log.frame(spark)
    return report("Landing", {"totals": totals, "tables": tables, "errors": summary(errors), "last errors": last(errors, "at").select("category", "severity", "message")})
