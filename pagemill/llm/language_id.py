"""Language ID: multinomial naive Bayes over hashed character n-grams.

Training counts the n-grams of a bounded, hash-chosen sample of labelled rows
on the executors and sums them by (language, bucket) before anything reaches
the driver, so that the driver sees at most languages x buckets numbers. The
log-probability matrix, of that same bounded size, is broadcast. Scoring turns
a batch of texts into one long array of bucket numbers (the sparse form of the
batch), gathers their rows of the matrix and sums them by text.

Defined results: null texts, and texts without a letter, give ``und`` with
score 0. Texts of any length are scored whole, in slices. Rows with a null key
are scored like others. Ties go to the language first in alphabetical order.
With no labelled row at all every text is ``und``. All languages have the same
prior. An extra column that is called lang_pred or score becomes lang_pred_input
or score_input; others pass through. Languages are as many as there are: their
counts are summed in groups of bounded size, and the matrix, buckets x languages,
is refused only where it is too large to broadcast.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm import runtime

UNDETERMINED = "und"
#: The columns that predict() makes.
MADE = ("lang_pred", "score")
#: Languages whose counts come to the driver at once.
AT_ONCE = 64
#: Most characters scored at once.
SLICE = 1 << 18
_SPACE = 32


@cache
def _letters() -> np.ndarray:
    """For each code point, whether it is a letter (general category L)."""
    return np.frombuffer(bytes(unicodedata.category(chr(i))[0] == "L" for i in range(0x110000)), dtype=bool)


@dataclass(frozen=True)
class Model:
    """Languages in order, and a float32 matrix of log probabilities, buckets x languages."""

    languages: tuple[str, ...]
    log_prob: np.ndarray
    log_prior: np.ndarray
    orders: tuple[int, ...]


def _buckets(codes: np.ndarray, order: int, n_buckets: int) -> np.ndarray:
    """The bucket of the n-gram that starts at each position but the last ones."""
    h = np.full(len(codes) - order + 1, 0x9E3779B97F4A7C15 * order & (2**64 - 1), dtype=np.uint64)
    for k in range(order):
        h = (h ^ codes[k : len(codes) - order + 1 + k]) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
    return (h & np.uint64(n_buckets - 1)).astype(np.int64)


def _prepare(text: str) -> tuple[np.ndarray, bool]:
    """Lower-cased code points with a space before and after and for every other character; whether any is a letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[codes]
    out = np.full(len(codes) + 2, _SPACE, dtype=np.uint64)
    out[1:-1] = np.where(letter, codes, _SPACE)
    return out, bool(letter.any())


def _parts(codes: np.ndarray, orders: tuple[int, ...]) -> Iterator[tuple[np.ndarray, int]]:
    """Slices of a text, and in how many of the first places of each its n-grams start; the places after overlap the next slice."""
    tail = max(orders) - 1
    step = max(1, SLICE - tail)
    for i in range(0, max(1, len(codes) - tail), step):
        part = codes[i : i + step + tail]
        yield part, len(part) if i + step >= len(codes) - tail else step


def score_texts(texts: list[str | None], model: Model) -> tuple[list[str], np.ndarray]:
    """The language of each text and its posterior probability."""
    n_buckets, n_langs = model.log_prob.shape
    total = np.zeros((len(texts), n_langs))
    known = np.zeros(len(texts), dtype=bool)
    pending: list[tuple[int, np.ndarray, int]] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if pending:
            joined = np.concatenate([c for _, c, _ in pending])
            lengths = np.array([len(c) for _, c, _ in pending])
            bodies = np.array([n for _, _, n in pending])
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            rows = np.array([i for i, _, _ in pending])
            for order in model.orders:
                if len(joined) < order:
                    continue
                gathered = model.log_prob[_buckets(joined, order, n_buckets)]
                # n-grams that run over the end of their slice, or start in the next one, count for nothing
                for k in range(1, max(model.orders)):
                    at = lengths - k
                    over = (starts + at)[(at >= 0) & (at >= np.minimum(bodies, lengths - order + 1))]
                    gathered[over[over < len(gathered)]] = 0
                inside = starts < len(gathered)
                np.add.at(total, rows[inside], np.add.reduceat(gathered, starts[inside], axis=0, dtype=np.float64))
        pending.clear()
        size = 0

    for i, text in enumerate(texts):
        if not text or not n_langs:
            continue
        codes, known[i] = _prepare(text)
        if not known[i]:
            continue
        for part, body in _parts(codes, model.orders):
            if size + len(part) > SLICE:
                flush()
            pending.append((i, part, body))
            size += len(part)
    flush()
    if not n_langs:
        return [UNDETERMINED] * len(texts), np.zeros(len(texts))
    total += model.log_prior
    best = total.argmax(axis=1)
    score = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
    return [model.languages[b] if k else UNDETERMINED for b, k in zip(best, known, strict=True)], np.where(known, score, 0.0)


def fit(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", orders: tuple[int, ...] = (1, 2, 3), bits: int = 16, smoothing: float = 0.1, per_language: int = 3000) -> Model:
    """Fit on about ``per_language`` rows of each language at most, chosen by a hash of their keys.

    That bound is a parameter of the classifier alone; nothing else samples.
    """
    spark = labelled.sparkSession
    runtime.bound_batches(spark)
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l"))
    n_buckets = 1 << bits
    room = runtime.BROADCAST_LIMIT // (4 * n_buckets)
    n_rows = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count(F.lit(1)).alias("n")).limit(room + 1).collect()}
    if len(n_rows) > room:
        raise ValueError(f"a matrix of more than {room} languages is too large to broadcast; use fewer bits")
    languages = tuple(sorted(n_rows))
    if not languages:
        return Model((), np.zeros((n_buckets, 0), np.float32), np.zeros(0), orders)
    share = F.create_map(*[x for name, n in n_rows.items() for x in (F.lit(name), F.lit(min(1.0, per_language / n)))])
    chosen = F.pmod(F.xxhash64(F.col("k").cast("string")), F.lit(1 << 30)) < share[F.col("l")] * (1 << 30)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, value in zip(batch.column("l").to_pylist(), batch.column("t").to_pylist(), strict=True):
                codes, has_letter = _prepare(value)
                if not has_letter:
                    continue
                into = seen.setdefault(name, np.zeros(n_buckets, dtype=np.int64))
                for part, body in _parts(codes, orders):
                    for order in orders:
                        if len(part) >= order:
                            into += np.bincount(_buckets(part[: body + order - 1], order, n_buckets), minlength=n_buckets)
        for name, into in seen.items():
            (at,) = into.nonzero()
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(into[at])], ["l", "bucket", "n"])

    log_prob = np.zeros((n_buckets, len(languages)), dtype=np.float32)
    for i in range(0, len(languages), AT_ONCE):
        some = languages[i : i + AT_ONCE]
        counted = rows.where(chosen & F.col("l").isin(*some)).select("l", "t").mapInArrow(runtime.lean(count), "l string, bucket int, n long").groupBy("l", "bucket").agg(F.sum("n").alias("n")).toPandas()
        counts = np.zeros((n_buckets, len(some)))
        at = {name: k for k, name in enumerate(some)}
        counts[counted["bucket"].to_numpy(np.int64), counted["l"].map(at).to_numpy(np.int64)] = counted["n"].to_numpy(np.float64)
        log_prob[:, i : i + len(some)] = np.log((counts + smoothing) / (counts.sum(axis=0) + smoothing * n_buckets))
    return Model(languages, log_prob, np.full(len(languages), -np.log(len(languages))), orders)


def predict(docs: DataFrame, model: Model, text: str = "text", keep: list[Column | str] | None = None) -> DataFrame:
    """The columns of ``keep`` (all, if not given) with lang_pred and score."""
    spark = docs.sparkSession
    runtime.bound_batches(spark)
    shared = runtime.broadcast(spark, model, model.log_prob.nbytes)
    kept = docs.select(*(keep or runtime.beside(docs, MADE)), docs[f"`{text}`"].alias(runtime.free(docs.columns, "__text")))
    names = kept.columns[:-1]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pred, value = score_texts(batch.column(len(names)).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(pred, pa.string()), pa.array(value)], [*names, *MADE])

    schema = T.StructType(kept.schema.fields[:-1]).add("lang_pred", "string").add("score", "double")
    return kept.mapInArrow(runtime.lean(score), schema)


def held_out(key: str = "doc_id") -> Column:
    """Whether a row is kept from training: crc32 of its key as text, mod 4, is 2. A null key is not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))
