"""Statements that create the tables and indexes of a database: for Spark, and for SQL databases."""

from __future__ import annotations

from pyspark.sql import types as T

from pagemill.codec.types import IndexDef, TableDef
from pagemill.operators import naming

# SQL types of the format's types; others are BLOB, and members of arrays TEXT.
SQL_TYPES = {
    "BYTE": "INTEGER",
    "SHORT": "INTEGER",
    "USHORT": "INTEGER",
    "DATE": "TEXT",
    "TIME": "TEXT",
    "LONG": "INTEGER",
    "ULONG": "INTEGER",
    "FLOAT": "REAL",
    "DOUBLE": "REAL",
    "DECIMAL": "REAL",
    "STRING": "TEXT",
    "CSTRING": "TEXT",
    "PSTRING": "TEXT",
    "GROUP": "BLOB",
}


def sql_type(kind: str, array: bool = False) -> str:
    """The SQL type of a field type. Arrays are kept as JSON text."""
    return "TEXT" if array else SQL_TYPES.get(kind, "BLOB")


def create_spark_table(schema: T.StructType, table: str) -> str:
    return f"CREATE TABLE `{table}` ({', '.join(f'`{f.name}` {f.dataType.simpleString().upper()}' for f in schema)})"


def create_table(table: TableDef, name: str | None = None, if_not_exists: bool = False) -> str:
    """CREATE TABLE in SQL: fields in order, then memos as BLOB, under clean and distinct names."""
    names = naming.unique([naming.sanitize_field(x.name) for x in (*table.fields, *table.memos)])
    kinds = [sql_type(f.type, f.elements > 1) for f in table.fields] + ["BLOB"] * len(table.memos)
    columns = ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True))
    return f"CREATE TABLE {'IF NOT EXISTS ' if if_not_exists else ''}{name or naming.sanitize_table(table.name)} ({columns});"


def index_fields(index: IndexDef, table: TableDef) -> list[tuple[str, bool]]:
    """(clean field name, descending) of an index; numbers that no field has are left out."""
    return [(naming.sanitize_field(table.fields[n].name), descending) for n, descending in index.fields if n < len(table.fields)]


def create_index(index: IndexDef, table: TableDef, name: str | None = None, faithful: bool = False) -> str:
    """CREATE INDEX in SQL, or nothing if no field is left. Order and uniqueness are stated only if ``faithful``."""
    found = index_fields(index, table)
    if not found:
        return ""
    own = name or naming.sanitize_table(table.name)
    columns = ", ".join(f"{n} DESC" if faithful and descending else n for n, descending in found)
    return f"CREATE {'UNIQUE ' if faithful and index.unique else ''}INDEX {own}_{naming.sanitize_field(index.name)} ON {own} ({columns});"


def script(tables: list[TableDef], faithful: bool = False) -> str:
    """All statements of a database, a line each."""
    lines = []
    for t in tables:
        lines += [create_table(t), *filter(None, (create_index(i, t, faithful=faithful) for i in t.indexes))]
    return "\n".join(lines) + "\n" if lines else ""
