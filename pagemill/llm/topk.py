"""Exact top-k inner products over vectors ordered by length.

Vectors are turned into integers by the caller, so scores are exact. They are
range-sorted by descending length once, into a table in the shared folder, and
rotated by the eigenvectors of their Gram matrix (the right singular vectors of
the vector table), which packs most of each inner product into the first
components. Queries are taken in blocks of bounded size; for each block

1. the longest vectors are searched first, on the executors, which gives every
   query a first threshold, its k-th best score so far;
2. the other vectors are read in order of descending length as far as any query's
   length times theirs reaches its threshold; the scan's filter ends there, so
   shorter vectors are not even read;
3. within a task vectors come in blocks of about equal length. Partial sums over
   more and more rotated components, each with the Cauchy-Schwarz bound on the
   rest, rule out pairs, queries and vectors; the places of the cuts come from the
   spectrum. Only pairs that are alive after the last cut are scored in integers.
   Thresholds rise as a task proceeds.

Each task gives at most k rows a query; they are written for each block at once,
so the driver holds one block of queries and its thresholds, and nothing grows
there with the number of queries. Spark then keeps the k best.

Defined results: vectors that are null, empty, of a length that no query has, or
that hold a null or non-finite component take no part; queries of each length are
searched among the vectors of that length, however many lengths there are. A
query is never its own candidate: candidates with the query's id are left out, so
rows that repeat an id do not find each other. Rows that repeat a query's id are
one query: its ranking holds the k best of the pairs of all of them. Ties go to the
smaller id. Fewer candidates than k give all of them. An empty table gives no
rows. Scores beyond the range of a long fail.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm import runtime

#: Most bytes of query vectors in a block, vectors in a block of candidates, and vectors of each length that give the first thresholds.
QUERY_BYTES = 16 << 20
BLOCK = 1024
LONGEST = 4096
#: Shares of the spectrum after which the partial sums are cut.
SHARES = (0.5, 0.75, 0.9, 0.97)
#: Numbers of Gram matrices that the driver holds at once.
GRAM_CELLS = 1 << 22
#: Error of the quantile that finds the longest vectors.
FINE = 1e-4
#: Relative error of a partial sum that bounds allow for.
SLACK = 1e-6

FOUND = "query_id long, id long, score long"
COUNTS = ("pairs", "scored by partial sums", "alive after the last cut", "scored in integers")


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))


def quantise(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def _exact(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products of pairs of rows, as exact integers."""
    bound = np.abs(queries).max(initial=0) * np.abs(vectors).max(initial=0) * queries.shape[-1]
    if bound < 2**53:
        return np.einsum("ij,ij->i", queries, vectors).astype(np.int64)
    return np.array([sum(int(a) * int(b) for a, b in zip(q, v, strict=True)) for q, v in zip(queries, vectors, strict=True)], dtype=np.int64)


def cuts_of(spectrum: np.ndarray) -> list[int]:
    """Numbers of components that hold the shares of a descending spectrum, and all of them."""
    total = spectrum.sum()
    held = np.cumsum(spectrum) / total if total > 0 else np.linspace(1 / len(spectrum), 1, len(spectrum))
    return sorted({min(len(spectrum), int(np.searchsorted(held, s)) + 1) for s in SHARES} | {len(spectrum)})


class Searcher:
    """The best k candidates so far for each query of a block."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, rotation: np.ndarray, cuts: list[int], k: int, floor: np.ndarray | None = None):
        self.ids, self.queries, self.k, self.rotation, self.cuts = ids, queries, k, rotation, cuts
        self.rotated = queries @ rotation
        self.length = np.linalg.norm(queries, axis=1)
        self.rest = [np.sqrt((self.rotated[:, c:] ** 2).sum(axis=1)) for c in cuts]
        self.threshold = np.full(len(ids), -np.inf) if floor is None else floor.astype(np.float64)
        # the k best of each query; unused places have no id
        self.best_score = np.full((len(ids), k), np.iinfo(np.int64).min)
        self.best_id = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.used = np.zeros(len(ids), np.int64)
        self.counts = np.zeros(len(COUNTS), np.int64)

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Take candidates; they are sorted by length here and processed in blocks, until no query can gain from shorter ones."""
        length = np.linalg.norm(vectors, axis=1)
        order = np.argsort(-length, kind="stable")
        ids, vectors, length = ids[order], vectors[order], length[order]
        self.counts[0] += len(ids) * len(self.ids)
        for i in range(0, len(ids), BLOCK):
            at = slice(i, i + BLOCK)
            slack = SLACK * (1 + self.length * length[i])
            (live,) = np.nonzero(self.length * length[i] + slack >= self.threshold)
            if not len(live):
                return
            rotated = vectors[at] @ self.rotation
            rest = [np.sqrt((rotated[:, c:] ** 2).sum(axis=1)) for c in self.cuts]
            for j in range(0, len(live), BLOCK):
                some = live[j : j + BLOCK]
                self._block(some, ids[at], vectors[at], rotated, rest, slack[some])

    def _block(self, live: np.ndarray, ids: np.ndarray, vectors: np.ndarray, rotated: np.ndarray, rests: list[np.ndarray], slack: np.ndarray) -> None:
        """One block of candidates for some queries: partial sums and bounds rule out pairs, rows and columns; the pairs that are left are scored in integers."""
        rows, cols, partial, done = np.arange(len(live)), np.arange(len(ids)), 0.0, 0
        self.counts[1] += len(live) * len(ids)
        for cut, own, rest in zip(self.cuts, self.rest, rests, strict=True):
            partial = partial + self.rotated[live[rows], done:cut] @ rotated[cols, done:cut].T
            floor = (self.threshold[live[rows]] - slack[rows])[:, None]
            alive = partial + np.multiply.outer(own[live[rows]], rest[cols]) >= floor
            if cut == self.cuts[-1]:
                break
            keep_r, keep_c = alive.any(axis=1), alive.any(axis=0)
            if not keep_r.any():
                return
            if alive.mean() < 0.02:  # few pairs are left: no box of them is worth a partial sum
                r, c = np.nonzero(alive)
                self._take(live[rows[r]], ids[cols[c]], self.queries[live[rows[r]]], vectors[cols[c]])
                return
            partial, rows, cols, done = partial[np.ix_(keep_r, keep_c)], rows[keep_r], cols[keep_c], cut
        # the last partial sums are the products but for rounding: of more than k only those near the k-th can count
        alive &= self.ids[live[rows]][:, None] != ids[cols][None, :]
        self.counts[2] += np.count_nonzero(alive)
        if len(cols) > self.k:
            near = np.where(alive, partial, -np.inf)
            alive &= partial >= np.partition(near, len(cols) - self.k, axis=1)[:, len(cols) - self.k, None] - 2 * slack[rows][:, None]
        r, c = np.nonzero(alive)
        for i in range(0, len(r), 1 << 16):
            rr, cc = rows[r[i : i + (1 << 16)]], cols[c[i : i + (1 << 16)]]
            self._take(live[rr], ids[cc], self.queries[live[rr]], vectors[cc])

    def _take(self, q: np.ndarray, ids: np.ndarray, queries: np.ndarray, vectors: np.ndarray) -> None:
        """Score pairs and keep the k best of each query."""
        self.counts[3] += len(q)
        score = _exact(queries, vectors)
        on = (score >= self.threshold[q]) & (ids != self.ids[q])
        q, ids, score = q[on], ids[on], score[on]
        if not len(q):
            return
        own = np.unique(q)
        held = np.arange(self.k) < self.used[own][:, None]
        all_q = np.concatenate([np.repeat(own, self.used[own]), q])
        all_id = np.concatenate([self.best_id[own][held], ids])
        all_score = np.concatenate([self.best_score[own][held], score])
        order = np.lexsort((all_id, -all_score, all_q))
        all_q, all_id, all_score = all_q[order], all_id[order], all_score[order]
        rank = np.arange(len(all_q)) - np.searchsorted(all_q, all_q, side="left")
        kept = rank < self.k
        all_q, rank = all_q[kept], rank[kept]
        self.best_id[all_q, rank], self.best_score[all_q, rank] = all_id[kept], all_score[kept]
        self.used[own] = np.bincount(np.searchsorted(own, all_q), minlength=len(own))
        full = own[self.used[own] == self.k]
        self.threshold[full] = np.maximum(self.threshold[full], self.best_score[full, self.k - 1])

    def found(self) -> pa.RecordBatch:
        held = np.arange(self.k) < self.used[:, None]
        columns = [np.repeat(self.ids, self.used), self.best_id[held], self.best_score[held]]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "id", "score"])


def _by_size(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Size, ids and vectors of a batch, a run for each size; sizes are sorted."""
    sizes = batch.column("d").to_numpy()
    ends = [*(np.nonzero(np.diff(sizes))[0] + 1), len(sizes)]
    for start, end in zip([0, *ends], ends, strict=False):
        if end > start:
            part = batch.slice(start, end - start)
            yield int(sizes[start]), part.column("id").to_numpy(), part.column("v").flatten().to_numpy().astype(np.float64).reshape(end - start, -1)


def _rotations(vectors: DataFrame, sizes: list[int]) -> dict[int, tuple[np.ndarray, list[int]]]:
    """For each size the eigenvectors of the Gram matrix, largest first, and the cuts: a partial sum from each task, summed by cell."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, _, x in _by_size(batch):
                total[d] = total.get(d, 0.0) + x.T @ x
        for d, gram in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d * d, d, np.int32)), pa.array(np.arange(d * d, dtype=np.int32)), pa.array(gram.ravel())], ["d", "i", "x"])

    rows = vectors.select("id", "v", "d").mapInArrow(partial, "d int, i int, x double").groupBy("d", "i").agg(F.sum("x").alias("x")).toPandas()
    out = {}
    for d in sizes:
        own = rows[rows["d"] == d]
        gram = np.zeros(d * d)
        gram[own["i"].to_numpy(np.int64)] = own["x"].to_numpy()
        spectrum, axes = np.linalg.eigh(gram.reshape(d, d))
        out[d] = np.ascontiguousarray(axes[:, ::-1]), cuts_of(np.maximum(spectrum[::-1], 0))
    return out


def _groups(counts: dict[int, int]) -> Iterator[list[int]]:
    """Sizes in groups whose Gram matrices have a bounded number of cells."""
    held, cells = [], 0
    for d in sorted(counts):
        if held and cells + d * d > GRAM_CELLS:
            yield held
            held, cells = [], 0
        held.append(d)
        cells += d * d
    if held:
        yield held


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "v", query_bytes: int = QUERY_BYTES, tally: dict[str, int] | None = None) -> DataFrame:
    """query_id, rank, ``id_col`` and score of the k best candidates of each query.

    ``vector_col`` holds arrays of integers (see :func:`quantise`). ``tally`` gets
    the numbers of :data:`COUNTS`; a task that is repeated counts again.
    """
    spark = vectors.sparkSession
    runtime.bound_batches(spark)
    out = runtime.fresh_path(spark, "topk-found")
    counts = spark.sparkContext.accumulator(np.zeros(len(COUNTS), np.int64), _Tally())
    with runtime.scope(spark):
        v = F.col(f"`{vector_col}`")
        rows = vectors.where(F.col(f"`{id_col}`").isNotNull() & v.isNotNull()).select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v"), F.size(v).alias("d"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
        rows = rows.where("d > 0").withColumn("len", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)))
        rows = runtime.written(rows.repartitionByRange("d", F.col("len").desc(), "id").sortWithinPartitions("d", F.col("len").desc(), "id"), "topk-vectors")
        found = rows.groupBy("d").agg(F.count_if("is_query").alias("n"), F.count(F.lit(1)).alias("all")).where("n > 0").collect()
        queries = {r["d"]: r["n"] for r in found}
        for sizes in _groups(queries):
            same = rows.where(F.col("d").isin(sizes))
            _search(same, {r["d"]: r["all"] for r in found if r["d"] in sizes}, -(-8 * sum(d * queries[d] for d in sizes) // query_bytes), k, out, counts)
    if tally is not None:
        tally.update(zip(COUNTS, counts.value.tolist(), strict=True))
    if not queries:
        return spark.createDataFrame([], f"query_id long, rank int, `{id_col}` long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("id"))
    best = spark.read.schema(FOUND).parquet(out).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", F.col("id").alias(id_col), "score")


class _Tally:
    """Adds up numbers of tasks."""

    def zero(self, value: np.ndarray) -> np.ndarray:
        return np.zeros_like(value)

    def addInPlace(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a + b


def _longest(vectors: DataFrame, sizes: dict[int, int]) -> DataFrame:
    """d, len and id of the longest vectors of each size; a quantile first bounds what is sorted."""
    large = {d: n for d, n in sizes.items() if n > 4 * LONGEST}
    if large:
        shares = {d: 1 - max(2 * LONGEST / n, 2 * FINE) for d, n in large.items()}
        quantiles = vectors.agg(*[F.percentile_approx(F.when(F.col("d") == d, F.col("len")), share, int(1 / FINE)).alias(str(d)) for d, share in shares.items()]).first()
        for d in large:
            vectors = vectors.where((F.col("d") != d) | (F.col("len") >= quantiles[str(d)]))
    first = Window.partitionBy("d").orderBy(F.col("len").desc(), "id")
    return vectors.select("d", "len", "id").withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= LONGEST)


def _search(vectors: DataFrame, sizes: dict[int, int], n_blocks: int, k: int, out: str, counts) -> None:
    """Search all queries of some sizes, block by block, and append what is found to a table."""
    axes = _rotations(vectors, list(sizes))
    longest = _longest(vectors, sizes)
    last = {r["d"]: r["last"] for r in longest.groupBy("d").agg(F.min(F.struct("len", (-F.col("id")).alias("id"))).alias("last")).collect()}
    is_long = F.lit(False)
    for d in sizes:
        length, own = last[d]["len"], -last[d]["id"]
        is_long |= (F.col("d") == d) & ((F.col("len") > length) | (F.col("len") == length) & (F.col("id") <= own))
    candidates = vectors.select("id", "v", "d", "len")
    part = F.pmod(F.xxhash64("id"), F.lit(max(1, n_blocks)))
    for block in range(max(1, n_blocks)):
        held = vectors.where(F.col("is_query") & (part == block)).select("id", "v", "d").toPandas()
        if not len(held):
            continue
        queries = {int(d): (x["id"].to_numpy(np.int64), np.array(x["v"].tolist(), dtype=np.float64)) for d, x in held.groupby("d")}
        here = F.col("d").isin(*queries)
        _scanned(candidates.where(here & is_long), queries, axes, None, k, counts).write.mode("append").parquet(f"{out}/part={block}-long")
        seen = vectors.sparkSession.read.schema(FOUND).parquet(f"{out}/part={block}-long")
        nth = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("id"))
        floors = seen.withColumn("nth", F.row_number().over(nth)).where(F.col("nth") == k).select("query_id", "score").toPandas().set_index("query_id")["score"]
        floor = {d: floors.reindex(ids).fillna(-np.inf).to_numpy(np.float64) for d, (ids, _) in queries.items()}
        reach = F.lit(False)
        for d, (_, x) in queries.items():
            length = np.maximum(np.linalg.norm(x, axis=1), 1e-300)
            bound = float(((floor[d] - SLACK * (1 + np.abs(floor[d]))) / length).min())
            reach |= (F.col("d") == d) & (F.col("len") >= bound) if np.isfinite(bound) else F.col("d") == d
        _scanned(candidates.where(here & ~is_long & reach), queries, axes, floor, k, counts).write.mode("append").parquet(f"{out}/part={block}-rest")


def _scanned(candidates: DataFrame, queries: dict, axes: dict, floor: dict | None, k: int, counts) -> DataFrame:
    """The k best of each task for one block of queries."""
    own = {d: axes[d] for d in queries}
    size = sum(q.nbytes + 2 * ids.nbytes + own[d][0].nbytes for d, (ids, q) in queries.items())
    shared = runtime.broadcast(candidates.sparkSession, (queries, own, floor), size)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries_, axes_, floors = shared.value
        searchers: dict[int, Searcher] = {}
        for batch in batches:
            for d, ids, x in _by_size(batch):
                if d not in searchers:
                    searchers[d] = Searcher(*queries_[d], *axes_[d], k, floors and floors[d])
                searchers[d].add(ids, x)
        for searcher in searchers.values():
            counts.add(searcher.counts)
            yield searcher.found()

    return candidates.select("id", "v", "d").mapInArrow(scan, FOUND)
