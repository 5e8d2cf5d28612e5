"""What a run takes: memory and processor time of the driver, and the memory of the executors."""

from __future__ import annotations

import gc
import os
import resource
import threading
import time

from pyspark.sql import DataFrame, SparkSession


def driver_mb() -> float:
    """Resident memory of the driver's Python process."""
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") / 2**20


def executors(spark: SparkSession) -> DataFrame:
    """Storage memory of each executor: at most, and left."""
    status = spark._jsc.sc().getExecutorMemoryStatus()
    rows, each = [], status.iterator()
    while each.hasNext():
        pair = each.next()
        rows.append((pair._1(), pair._2()._1() / 2**20, pair._2()._2() / 2**20))
    return spark.createDataFrame(rows, "executor string, most_mb double, left_mb double")


class Monitor:
    """Samples the driver while a block runs; over its limit it drops cached tables and collects garbage."""

    def __init__(self, spark: SparkSession, limit_mb: float | None = None, every: float = 1.0):
        self.spark, self.limit_mb, self.every = spark, limit_mb, every
        self.samples: list[tuple[float, float, float]] = []
        self.clean_ups = 0
        self._stop = threading.Event()

    def check(self) -> bool:
        """Whether memory is within the limit; cleans up if not."""
        if self.limit_mb is None or driver_mb() <= self.limit_mb:
            return True
        self.clean_ups += 1
        self.spark.catalog.clearCache()
        gc.collect()
        return False

    def _sample(self) -> None:
        used = resource.getrusage(resource.RUSAGE_SELF)
        self.samples.append((time.time(), driver_mb(), used.ru_utime + used.ru_stime))

    def _watch(self) -> None:
        while not self._stop.wait(self.every):
            self._sample()
            self.check()

    def __enter__(self) -> Monitor:
        self._sample()
        self._thread = threading.Thread(target=self._watch, daemon=True)
        self._thread.start()
        return self

    def __exit__(self, *_) -> None:
        self._stop.set()
        self._thread.join()
        self._sample()

    def frame(self) -> DataFrame:
        """A row for each sample."""
        return self.spark.createDataFrame(self.samples, "at double, memory_mb double, cpu_seconds double")

    def metrics(self, rows: int = 0, size_mb: float = 0.0) -> dict[str, float]:
        """Duration, means and rates."""
        seconds = max(1e-9, self.samples[-1][0] - self.samples[0][0])
        return {
            "seconds": seconds,
            "memory_mb": sum(m for _, m, _ in self.samples) / len(self.samples),
            "cpu_percent": 100 * (self.samples[-1][2] - self.samples[0][2]) / seconds,
            "records_per_second": rows / seconds,
            "mb_per_second": size_mb / seconds,
            "kb_per_record": size_mb * 1024 / rows if rows else 0.0,
            "clean_ups": self.clean_ups,
        }
