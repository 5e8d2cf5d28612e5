"""Size policy: batch sizes, size categories and presets, for columns and for single values."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass, replace
from typing import Any

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Fixed values: (bound, result), the first bound that is exceeded counts.
BATCH_BY_RECORD = ((10_000, 5), (5_000, 10), (1_000, 25))
BATCH_BY_FIELDS = ((200, 5), (100, 10), (50, 50))
SMALL_RECORD, SMALL_BATCH, USUAL_BATCH = 100, 400, 100
CATEGORIES = (("enterprise", 10_000, 1_000_000), ("large", 1_000, 100_000), ("medium", 100, 10_000))
RECOMMENDATIONS = (("enterprise", 100_000, 1_000, 10), ("large", 50_000, 500, 25), ("medium", 10_000, 100, 50))
STREAM_ROWS, STREAM_RECORD, STREAM_FIELDS = 10_000, 2_000, 100


def _chain(cases: list[tuple[Column, Any]], otherwise: Any) -> Column:
    out: Any = F
    for condition, value in cases:
        out = out.when(condition, F.lit(value) if not isinstance(value, Column) else value)
    return out.otherwise(otherwise)


def batch_size(record_size: Column, n_fields: Column) -> Column:
    """Rows in a batch by the size of a record, then by its number of fields."""
    cases = [(record_size > bound, n) for bound, n in BATCH_BY_RECORD] + [(record_size < SMALL_RECORD, SMALL_BATCH)]
    return _chain(cases + [(n_fields > bound, n) for bound, n in BATCH_BY_FIELDS], F.lit(USUAL_BATCH))


def size_category(megabytes: Column, rows: Column) -> Column:
    return _chain([((megabytes > mb) | (rows > n), name) for name, mb, n in CATEGORIES], F.lit("small"))


def recommendation(rows: Column, megabytes: Column) -> Column:
    return _chain([(rows == 0, "skip")] + [((rows > n) | (megabytes > mb), name) for name, n, mb, _ in RECOMMENDATIONS], F.lit("small"))


def optimal_batch(rows: Column, megabytes: Column) -> Column:
    return _chain([((rows > n) | (megabytes > mb), size) for _, n, mb, size in RECOMMENDATIONS], F.lit(100))


def use_streaming(rows: Column, record_size: Column, n_fields: Column) -> Column:
    return (rows > STREAM_ROWS) | (record_size > STREAM_RECORD) | (n_fields > STREAM_FIELDS)


def _case(cases: list[tuple[bool, Any]], otherwise: Any) -> Any:
    return next((value for condition, value in cases if condition), otherwise)


def advice(rows: int, megabytes: float) -> dict[str, Any]:
    """recommendation() and optimal_batch() of single values."""
    cases = [(rows > n or megabytes > mb, name, size) for name, n, mb, size in RECOMMENDATIONS]
    return {
        "recommendation": "skip" if rows == 0 else _case([(hit, name) for hit, name, _ in cases], "small"),
        "optimal_batch_size": _case([(hit, size) for hit, _, size in cases], 100),
    }


@dataclass(frozen=True)
class Policy:
    """Limits of a landing, and the Spark settings that they stand for.

    The names of the knobs are those that configurations are kept under. Those
    of SQLite are kept too, but nothing here writes SQLite, so they do nothing.
    """

    name: str = "default"
    max_memory_mb: int = 500
    memory_cleanup_interval: int = 1000
    enable_memory_monitoring: bool = True
    default_batch_size: int = 100
    adaptive_batch_sizing: bool = True
    max_batch_size: int = 1000
    min_batch_size: int = 5
    enable_progress_tracking: bool = True
    progress_log_interval: int = 100
    detailed_progress_logging: bool = False
    max_consecutive_errors: int = 100
    enable_partial_conversion: bool = True
    skip_problematic_tables: bool = False
    enable_streaming: bool = True
    streaming_threshold_records: int = 10_000
    enable_parallel_processing: bool = False
    max_worker_threads: int = 4
    sqlite_journal_mode: str = "WAL"
    sqlite_synchronous: str = "NORMAL"
    sqlite_cache_size: int = -2000
    sqlite_temp_store: str = "MEMORY"
    large_table_threshold_records: int = 50_000
    large_table_threshold_mb: float = 500.0
    enable_table_size_estimation: bool = True
    enable_checkpointing: bool = False
    checkpoint_interval: int = 10_000
    enable_resume_capability: bool = False

    @property
    def batch_size(self) -> int:
        return max(self.min_batch_size, min(self.max_batch_size, self.default_batch_size))

    @property
    def threads(self) -> int:
        """Tables that land at once."""
        return self.max_worker_threads if self.enable_parallel_processing else 1

    def to_dict(self) -> dict[str, Any]:
        return asdict(self)

    @classmethod
    def from_dict(cls, values: dict[str, Any]) -> Policy:
        if unknown := set(values) - set(cls.__dataclass_fields__):
            raise ValueError(f"a policy has no {', '.join(sorted(unknown))}")
        return cls(**values)

    def spark_conf(self) -> dict[str, str]:
        """Batches between the JVM and Python, and how much a task reads."""
        return {"spark.sql.execution.arrow.maxRecordsPerBatch": str(self.batch_size * 100), "spark.sql.files.maxPartitionBytes": f"{max(16, self.max_memory_mb // 8)}m"}

    def apply(self, spark: SparkSession) -> None:
        for k, v in self.spark_conf().items():
            spark.conf.set(k, v)

    def pages_per_partition(self, record_size: int, n_fields: int, rows: int | None) -> int:
        """Leaf pages of a task: few where a table is to be streamed in small portions, by its size and width."""
        streams = self.enable_streaming and ((rows or 0) > self.streaming_threshold_records or record_size > STREAM_RECORD or n_fields > STREAM_FIELDS)
        return 64 if streams else 256

    def is_large(self, rows: int, megabytes: float) -> bool:
        return rows > self.large_table_threshold_records or megabytes > self.large_table_threshold_mb


DEFAULT = Policy()
# The presets.
PRESETS = {
    "default": DEFAULT,
    "small": replace(DEFAULT, name="small", max_memory_mb=200, default_batch_size=200, enable_streaming=False),
    "medium": replace(DEFAULT, name="medium", streaming_threshold_records=5_000),
    "large": replace(DEFAULT, name="large", max_memory_mb=1_000, default_batch_size=50, streaming_threshold_records=1_000, enable_parallel_processing=True, max_worker_threads=2, enable_checkpointing=True, checkpoint_interval=5_000, detailed_progress_logging=True),
    "enterprise": replace(
        DEFAULT, name="enterprise", max_memory_mb=2_000, default_batch_size=25, streaming_threshold_records=500, enable_parallel_processing=True, enable_checkpointing=True, checkpoint_interval=1_000,
        enable_resume_capability=True, detailed_progress_logging=True, sqlite_cache_size=-10_000, large_table_threshold_records=100_000, large_table_threshold_mb=1_000.0,
    ),
}


def policy(name: str) -> Policy:
    if name not in PRESETS:
        raise ValueError(f"no preset {name!r}; there are {', '.join(PRESETS)}")
    return PRESETS[name]


# Batch size, buffer in bytes, prefetched records and compression of each strategy.
STRATEGIES = {
    "memory": {"batch_size": 500, "memory_buffer_size": 32 * 1024, "prefetch_size": 50, "compression": True},
    "speed": {"batch_size": 2000, "memory_buffer_size": 128 * 1024, "prefetch_size": 200, "compression": False},
    "balanced": {"batch_size": 1000, "memory_buffer_size": 64 * 1024, "prefetch_size": 100, "compression": False},
}


def strategy(name: str = "balanced", parallel: bool = True, streaming: bool = True, caching: bool = True, cache_ttl: int = 300) -> dict[str, Any]:
    """What a strategy sets."""
    if name not in STRATEGIES:
        raise ValueError(f"no strategy {name!r}; there are {', '.join(STRATEGIES)}")
    return {"parallel_processing": parallel, "streaming": streaming, "caching": caching, "cache_ttl": cache_ttl, **STRATEGIES[name]}


def strategy_conf(settings: dict[str, Any]) -> dict[str, str]:
    """A strategy as Spark settings: rows of an Arrow batch, the writer's buffer, the codec of the files."""
    return {
        "spark.sql.execution.arrow.maxRecordsPerBatch": str(settings["batch_size"] * 10),
        "spark.sql.parquet.compression.codec": "zstd" if settings["compression"] else "snappy",
        "spark.sql.inMemoryColumnarStorage.batchSize": str(settings["prefetch_size"] * 100),
    }


Progress = Callable[[int, int, str], None]
