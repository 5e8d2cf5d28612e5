"""Names of fields, tables and files: Python functions for schemas, column expressions for data."""

from __future__ import annotations

import re
from pathlib import PurePath

from pyspark.sql import Column
from pyspark.sql import functions as F

LONGEST = 64
# Names that a table may not have.
RESERVED = ("ORDER", "GROUP", "SELECT", "FROM", "WHERE", "INSERT", "UPDATE", "DELETE", "CREATE", "DROP", "ALTER", "INDEX", "TABLE")


def sanitize_field(name: str) -> str:
    """Without the prefix before the first colon, separators as underscores, not starting with a digit, at most 64 characters."""
    name = re.sub(r"[-\s./\\]", "_", name.split(":", 1)[-1])
    if not name or not (name[0].isalpha() or name[0] == "_"):
        name = "_" + name
    return name[:LONGEST]


def sanitize_table(name: str) -> str:
    name = re.sub(r"[-\s./\\]", "_", name)
    if not name or not (name[0].isalpha() or name[0] == "_"):
        name = "_" + name
    return f"{name}_TABLE" if name.upper() in RESERVED else name[:LONGEST]


def unique(names: list[str]) -> list[str]:
    """The names, later ones numbered where they repeat, without regard to case."""
    seen: dict[str, int] = {}
    out = []
    for name in names:
        k = seen[name.lower()] = seen.get(name.lower(), 0) + 1
        out.append(name if k == 1 else f"{name}_{k}")
    return out


def field_expr(name: Column) -> Column:
    """:func:`sanitize_field` of a column."""
    bare = F.regexp_replace(F.regexp_replace(name, "^[^:]*:", ""), r"[-\s./\\]", "_")
    return F.left(F.when(bare.rlike(r"^[\p{L}_]"), bare).otherwise(F.concat(F.lit("_"), bare)), F.lit(LONGEST))


def table_expr(name: Column) -> Column:
    """:func:`sanitize_table` of a column."""
    bare = F.regexp_replace(name, r"[-\s./\\]", "_")
    bare = F.when(bare.rlike(r"^[\p{L}_]"), bare).otherwise(F.concat(F.lit("_"), bare))
    return F.when(F.upper(bare).isin(*RESERVED), F.concat(bare, F.lit("_TABLE"))).otherwise(F.left(bare, F.lit(LONGEST)))


def recovered_expr(name: Column) -> Column:
    """A usable name from one found in damaged bytes: element numbers dropped, odd characters as single underscores, at most 50 characters."""
    bare = F.regexp_replace(F.regexp_replace(name, "^[^:]*:", ""), r"_\d+$", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"_\d+$", ""), r"[^A-Za-z0-9_]", "_")
    bare = F.when(bare.rlike("^[0-9]"), F.concat(F.lit("FIELD_"), bare)).otherwise(bare)
    bare = F.regexp_replace(F.regexp_replace(F.left(bare, F.lit(50)), "_+", "_"), "^_|_$", "")
    return F.when(bare == "", F.lit("FIELD_UNKNOWN")).otherwise(bare)


def file_prefix(path: str, number: int) -> str:
    """The prefix of a file's tables: by its suffix, or by its number where the suffix says nothing."""
    suffix = PurePath(path).suffix.lower()
    return f"{suffix[1:]}_" if suffix in (".phd", ".mod", ".tps") else f"file_{number}_"


def prefix_expr(path: Column, number: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"\.([^./\\]*)$", 1))
    return F.when(suffix.isin("phd", "mod", "tps"), F.concat(suffix, F.lit("_"))).otherwise(F.concat(F.lit("file_"), number.cast("string"), F.lit("_")))


def merged_expr(table: Column, number: Column, strategy: str) -> Column:
    """The name of a table in a merge: by file, by database, or its own."""
    if strategy == "separate":
        return table
    prefix = {"prefix": "file_", "namespace": "db_"}[strategy]
    return F.concat(F.lit(prefix), number.cast("string"), F.lit("_"), table)
