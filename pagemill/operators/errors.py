"""The log of what went wrong, what is tried again, and when to stop."""

from __future__ import annotations

import datetime as dt
import json
import threading
import time
import traceback
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Severities, mildest first, and categories.
SEVERITIES = ("info", "warning", "error", "critical")
CATEGORIES = ("file_access", "data_parsing", "database_operation", "memory_limit", "validation", "conversion", "system")

FRAME = "at timestamp, category string, severity string, message string, details string, stack_trace string, recovery_action string, context string"


class LandingError(RuntimeError):
    """A landing that cannot go on."""


class TooManyErrors(LandingError):
    """The bound of errors is reached."""


@dataclass(frozen=True)
class Entry:
    at: dt.datetime
    category: str
    severity: str
    message: str
    details: dict = field(default_factory=dict)
    stack_trace: str | None = None
    recovery_action: str | None = None
    context: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Strategy:
    """How work is tried again after an error of some categories: ``change`` turns its options into those of the next attempt, or None to give up."""

    name: str
    categories: tuple[str, ...]
    change: Callable[[dict[str, Any]], dict[str, Any] | None]
    max_attempts: int = 3
    delay: float = 0.0


def _fewer_pages(options: dict[str, Any]) -> dict[str, Any] | None:
    now = int(options.get("pagesPerPartition", 256))
    return {**options, "pagesPerPartition": max(1, now // 4)} if now > 1 else None


def _permissive(options: dict[str, Any]) -> dict[str, Any] | None:
    return None if str(options.get("mode", "")).upper() == "PERMISSIVE" else {**options, "mode": "PERMISSIVE"}


#: The strategies that a log begins with: wait and try again, read fewer pages at once, skip what is damaged.
STRATEGIES = (
    Strategy("retry_file_access", ("file_access",), dict, 3, 1.0),
    Strategy("retry_database_operation", ("database_operation",), dict, 2, 0.5),
    Strategy("reduce_memory_usage", ("memory_limit",), _fewer_pages, 2, 0.1),
    Strategy("skip_corrupt_record", ("data_parsing",), _permissive, 1, 0.0),
)


def category_of(error: BaseException) -> str:
    """The category of an exception, by its type and, for what comes out of Spark, its text."""
    text = f"{type(error).__name__}: {error}"
    for category, marks in (
        ("memory_limit", ("MemoryError", "OutOfMemory", "Java heap space")),
        ("data_parsing", ("CorruptPage", "BadDefinition", "UnicodeDecodeError", "struct.error")),
        ("file_access", ("FileNotFound", "PermissionError", "NotADatabase", "BadZipFile", "PATH_NOT_FOUND", "No such file")),
        ("database_operation", ("sqlite3.", "OperationalError", "FileAlreadyExists", "ConcurrentModification")),
        ("validation", ("ValidationError", "AssertionError")),
        ("conversion", ("ValueError", "TypeError", "CAST_", "ArrowInvalid", "OverflowError")),
    ):
        if any(m in text for m in marks):
            return category
    return "system"


class ErrorLog:
    """Errors in the order in which they came; raises once there are too many. Safe to share between threads."""

    def __init__(self, max_errors: int = 100, strategies: tuple[Strategy, ...] = STRATEGIES, sleep: Callable[[float], None] = time.sleep):
        self.max_errors, self.sleep = max_errors, sleep
        self.strategies = {s.name: s for s in strategies}
        self.entries: list[Entry] = []
        self.attempts: Counter[str] = Counter()
        self._lock = threading.Lock()

    def __enter__(self) -> ErrorLog:
        return self

    def __exit__(self, kind, error, _) -> bool:
        """An exception that leaves the block is logged as critical, and goes on."""
        if error is not None and not isinstance(error, LandingError):
            self.add(error, severity="critical", strict=False)
        return False

    def add_strategy(self, strategy: Strategy) -> None:
        self.strategies[strategy.name] = strategy

    def add(self, error: BaseException | str, category: str | None = None, severity: str = "error", recovery_action: str | None = None, details: dict | None = None, strict: bool = True, **context) -> Entry:
        """Log an error. Raises TooManyErrors at the bound of errors and critical errors, unless not ``strict``."""
        own = isinstance(error, BaseException)
        category = category or (category_of(error) if own else "system")
        if category not in CATEGORIES or severity not in SEVERITIES:
            raise ValueError(f"no such category or severity: {category}, {severity}")
        trace = "".join(traceback.format_exception(error)) if own else None
        entry = Entry(dt.datetime.now(dt.UTC), category, severity, f"{type(error).__name__}: {error}"[:2000] if own else str(error), details or {}, trace, recovery_action, context)
        with self._lock:
            self.entries.append(entry)
            grave = sum(SEVERITIES.index(e.severity) >= 2 for e in self.entries)
        if strict and grave >= self.max_errors:
            raise TooManyErrors(f"{grave} errors")
        return entry

    def run(self, work: Callable[[dict[str, Any]], Any], options: dict[str, Any], **context) -> Any:
        """The result of ``work(options)``; after an error it is tried again as the strategies of its category say. What helps in the end is logged as a warning, what does not is raised."""
        tried: Counter[str] = Counter()
        while True:
            try:
                return work(options)
            except LandingError:
                raise
            except Exception as error:
                category = category_of(error)
                for s in self.strategies.values():
                    if category in s.categories and tried[s.name] < s.max_attempts and (changed := s.change(options)) is not None:
                        break
                else:
                    raise
                tried[s.name] += 1
                with self._lock:
                    self.attempts[s.name] += 1
                self.add(error, category, "warning", s.name, **context)
                self.sleep(s.delay * 2 ** (tried[s.name] - 1))
                options = changed

    def frame(self, spark: SparkSession) -> DataFrame:
        """A row for each entry."""
        rows = [(e.at, e.category, e.severity, e.message, json.dumps(e.details, default=str), e.stack_trace, e.recovery_action, json.dumps(e.context, default=str)) for e in self.entries]
        return spark.createDataFrame(rows, FRAME)

    def report(self, spark: SparkSession, most: int = 10) -> dict[str, Any]:
        """Totals, counts by category and by severity, attempts of the strategies, and the last entries."""
        counted = summary(self.frame(spark)).collect()
        return {
            "total_errors": len(self.entries),
            "errors_by_category": {r["category"]: r["n"] for r in counted if r["category"] is not None},
            "errors_by_severity": {r["severity"]: r["n"] for r in counted if r["severity"] is not None},
            "recovery_attempts": dict(self.attempts),
            "recent_errors": [r.asDict() for r in last(self.frame(spark), "at", most).drop("stack_trace").collect()],
        }


def summary(errors: DataFrame, category: str = "category", severity: str = "severity") -> DataFrame:
    """n by category and by severity, in one pass: the other column is null in each."""
    return errors.groupingSets([[category], [severity]], category, severity).agg(F.count(F.lit(1)).alias("n"))


def last(errors: DataFrame, at: str, n: int = 10) -> DataFrame:
    """The n latest rows, newest first; ties in any order."""
    return errors.orderBy(F.desc(at)).limit(n)
