"""What the operators of this folder share: the shared folder, batches of bounded size, broadcasts of checked size, memory given back, names of columns."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most bytes that an operator broadcasts.
BROADCAST_LIMIT = 256 << 20
#: Most bytes of text in an Arrow batch handed to Python.
BATCH_BYTES = 2 << 20

#: Paths of tables to drop at the end of each open scope, the innermost last.
_scopes: list[list[str]] = []
_roots: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of this machine where that is unset and Spark is local.

    The session's setting is read and never changed.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _roots:
        _roots[app] = tempfile.mkdtemp(prefix="pagemill-")
    return _roots[app]


def _hadoop(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path that nothing has, in a folder of this application that goes when the driver ends."""
    root = f"{shared_dir(spark)}/pagemill-{spark.sparkContext.applicationId}"
    fs, where = _hadoop(spark, root)
    if fs.mkdirs(where):
        fs.deleteOnExit(where)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def drop(spark: SparkSession, path: str) -> None:
    fs, where = _hadoop(spark, path)
    fs.delete(where, True)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are dropped at the end, but for those written with ``lasting``."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            drop(spark, path)


def written(df: DataFrame, name: str, lasting: bool = False) -> DataFrame:
    """The rows, written as a table in the shared folder and read again: lineage ends here and lost executors lose nothing.

    In a scope the table is dropped at its end; with ``lasting`` it belongs to the
    scope around that one, or stays as long as the driver where there is none.
    """
    path = fresh_path(df.sparkSession, name)
    holders = _scopes[:-1] if lasting else _scopes
    if holders:
        holders[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def aside(columns: Iterable[str], made: Iterable[str]) -> dict[str, str]:
    """A name for each input column beside the columns that an operator makes.

    An input column that is called like one of these, in whatever case, keeps its
    values under its name with ``_input`` appended, as often as it takes; others
    keep their names.
    """
    taken = {m.lower() for m in made}
    columns = list(columns)
    taken_or_own = taken | {c.lower() for c in columns}
    out = {}
    for c in columns:
        name = c
        if c.lower() in taken:
            while name.lower() in taken_or_own:
                name += "_input"
            taken_or_own.add(name.lower())
        out[c] = name
    return out


def free(columns: Iterable[str], name: str) -> str:
    """The name, with underscores before it until no column has it."""
    own = {c.lower() for c in columns}
    while name.lower() in own:
        name = f"_{name}"
    return name


def beside(docs: DataFrame, made: Iterable[str]) -> list[Column]:
    """The columns of ``docs`` under the names of :func:`aside`."""
    return [docs[f"`{c}`"].alias(name) for c, name in aside(docs.columns, made).items()]


def restored(df: DataFrame, columns: list[str], made: Iterable[str]) -> DataFrame:
    """The input columns alone, under their own names, from what an operator returned."""
    return df.select(*[F.col(f"`{name}`").alias(c) for c, name in aside(columns, made).items()])


def packed(docs: DataFrame, **more: Column) -> DataFrame:
    """All columns of ``docs`` as the fields of one struct, __row, and more columns beside it, so that no name can clash."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("__row"), *[c.alias(name) for name, c in more.items()])


def unpacked(columns: list[str], made: Iterable[str]) -> list[Column]:
    """The columns of a packed table under the names of :func:`aside`."""
    return [F.col("__row").getField(c).alias(name) for c, name in aside(columns, made).items()]


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes too, unless the session sets its own bound."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(str(spark.conf.get(key, str(2**31 - 1))).rstrip("bB")) >= 2**31 - 1:
        spark.conf.set(key, str(BATCH_BYTES))


def give_back() -> None:
    """Return this process's freed memory to the system, where its C library can."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function of batches after whose task the worker, which Spark keeps for other tasks, holds no memory that is free."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def check_broadcast(size: int) -> None:
    if size > BROADCAST_LIMIT:
        raise ValueError(f"{size} bytes are too many to broadcast; the limit is {BROADCAST_LIMIT}")


def broadcast(spark: SparkSession, value, size: int):
    """Broadcast a value whose size in bytes is known and bounded."""
    check_broadcast(size)
    return spark.sparkContext.broadcast(value)


def read_small_file(path: str, most: int = 64 << 20) -> str:
    """A vocabulary file, read on the driver; executors get it by broadcast."""
    with open(path, encoding="utf-8") as f:
        text = f.read(most + 1)
    if len(text) > most:
        raise ValueError(f"{path} is larger than {most} characters")
    return text


def slices(texts: list[str], most: int, rows: int | None = None) -> Iterator[list[int]]:
    """Runs of indices whose texts have at most about so many characters together, and of so many texts at most."""
    run, size = [], 0
    for i, text in enumerate(texts):
        if run and (size + len(text) > most or len(run) == rows):
            yield run
            run, size = [], 0
        run.append(i)
        size += len(text)
    if run:
        yield run
