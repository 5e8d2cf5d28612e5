"""Benchmark decontamination by pigeonhole edit matching.

An item of n characters may occur in a document with up to k = floor(n * rate)
edits. Split into k + 1 pieces, at least one piece then occurs unchanged. Pieces
of all items are found in one pass over a text by an Aho-Corasick automaton;
each hit says where in the text its item would lie, and Myers' bit-parallel
algorithm, on Python's unbounded integers, finds the least edit distance of the
item to a stretch of that window. Windows of one item that overlap are verified
as one.

Texts and items are compared lower-cased, with every run of other characters
than letters and digits as one space. The automaton is made from a block of
items of bounded size; if the benchmark is larger, each block takes a pass over
the documents, so what is broadcast never grows with the benchmark or the data.

Items shorter than ``least`` characters after normalising are found without
errors only, and only as whole words: at an end of the text, next to a space, or
next to or at a character of a script that is written without spaces.

Defined results: null texts and texts without a letter or digit match nothing.
Items that are null or empty after normalising are left out. Items of the same
normalised text all match where one does. Texts are searched whole. A row of the
documents gives a row for each item that it holds, with its best distance;
repeated rows give their own. Rows with a null key are reported with it. Items
with a null key count in ``clean``; ``matches`` reports them, with a null key,
if ``unnamed`` is set.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import runtime

RATE = 0.05
LEAST = 40
#: Characters of items in one block.
BLOCK_CHARS = 4 << 20

_OTHER = re.compile(r"[\W_]+")
#: Scripts without spaces between words: Thai to Lao, Myanmar, Khmer, kana, and ideographs.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")


def normalise(text: str | None) -> str:
    return _OTHER.sub(" ", (text or "").lower()).strip()


def whole_words(text: str, start: int, end: int) -> bool:
    """Whether a stretch of a normalised text begins and ends between words."""
    return all(at in (0, len(text)) or " " in text[at - 1 : at + 1] or bool(_UNSPACED.search(text, at - 1, at + 1)) for at in (start, end))


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """The item in errors + 1 pieces of about equal length, with their offsets."""
    n = errors + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


class Pattern:
    """Myers' bit vectors of one item."""

    def __init__(self, item: str):
        self.n = len(item)
        self.all = (1 << self.n) - 1
        self.top = 1 << (self.n - 1)
        self.at: dict[str, int] = {}
        for i, c in enumerate(item):
            self.at[c] = self.at.get(c, 0) | 1 << i

    def distance(self, text: str, most: int) -> tuple[int, int]:
        """The least edit distance of the item to any stretch of the text and the end of the first such stretch; most + 1 if none is that near."""
        pv, mv, score, best, end = self.all, 0, self.n, most + 1, -1
        for j, c in enumerate(text):
            eq = self.at.get(c, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | ~(xh | pv) & self.all
            mh = pv & xh
            if ph & self.top:
                score += 1
            elif mh & self.top:
                score -= 1
            ph = ph << 1 & self.all
            mh = mh << 1 & self.all
            pv = mh | ~(xv | ph) & self.all
            mv = ph & xv
            if score < best:
                best, end = score, j + 1
        return best, end


class Matcher:
    """Finds the items of one block in texts."""

    def __init__(self, items: list[tuple[int | None, str]], rate: float, least: int = LEAST):
        self.items = items
        self.least = least
        self.errors = [int(len(text) * rate) if len(text) >= least else 0 for _, text in items]
        self.patterns: dict[int, Pattern] = {}
        self.automaton = ahocorasick.Automaton()
        where: dict[str, list[tuple[int, int]]] = {}
        for i, (_, text) in enumerate(items):
            for offset, piece in pieces(text, self.errors[i]):
                where.setdefault(piece, []).append((i, offset))
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        if items:
            self.automaton.make_automaton()

    def find(self, text: str) -> dict[int, int]:
        """The best distance of each item (by its number in the block) that the normalised text holds."""
        windows: dict[int, list[tuple[int, int]]] = {}
        if not self.items or not text:
            return {}
        out = {}
        for last, (length, places) in self.automaton.iter(text):
            for i, offset in places:
                start = last + 1 - length - offset
                if len(self.items[i][1]) < self.least:
                    if i not in out and whole_words(text, start, last + 1):
                        out[i] = 0
                    continue
                k = self.errors[i]
                windows.setdefault(i, []).append((max(0, start - k), min(len(text), start + len(self.items[i][1]) + k)))
        for i, found in windows.items():
            item, k = self.items[i][1], self.errors[i]
            best = k + 1
            # the pieces of one occurrence, and of repeats, share windows
            found.sort()
            merged = [list(found[0])]
            for a, b in found[1:]:
                if a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            for a, b in merged:
                if item in text[a:b]:
                    best = 0
                    break
                pattern = self.patterns.get(i) or self.patterns.setdefault(i, Pattern(item))
                best = min(best, pattern.distance(text[a:b], k)[0])
            if best <= k:
                out[i] = best
        return out


def _passes(benchmark: DataFrame, least: int, item_key: str, item_text: str, block_chars: int, unnamed: bool) -> Iterator[list[tuple[int | None, str]]]:
    """The items in blocks: they come one partition at a time, and the driver holds one block."""
    held, size = [], 0
    stated = benchmark.where(F.col(item_text).isNotNull() & (F.lit(unnamed) | F.col(item_key).isNotNull())).select(F.col(item_key).cast("long").alias("i"), F.col(item_text).alias("t"))
    for r in stated.distinct().orderBy("i", "t").toLocalIterator():
        if item := normalise(r["t"]):
            held.append((r["i"], item))
            size += max(len(item), least)
            if size >= block_chars:
                yield held
                held, size = [], 0
    if held:
        yield held


def _shared(spark: SparkSession, block: list[tuple[int, str]]):
    return runtime.broadcast(spark, block, sum(4 * len(t) + 100 for _, t in block))


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, least: int = LEAST, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", block_chars: int = BLOCK_CHARS, unnamed: bool = False) -> DataFrame:
    """``key``, ``item_key`` and distance for every item that a document holds with at most floor(length * rate) edits; short items as whole words without edits."""
    spark = docs.sparkSession
    runtime.bound_batches(spark)
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, `{item_key}` long, distance int"
    rows = docs.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{text}`").alias("__text")).where(F.col("__text").isNotNull())
    out = None
    for block in _passes(benchmark, least, item_key, item_text, block_chars, unnamed):
        shared = _shared(spark, block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, rate, least)
            for batch in batches:
                at, items, distances = [], [], []
                for n, value in enumerate(batch.column(1)):
                    for i, d in sorted(matcher.find(normalise(value.as_py())).items()):
                        at.append(n)
                        items.append(matcher.items[i][0])
                        distances.append(d)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(items, pa.int64()), pa.array(distances, pa.int32())], [key, item_key, "distance"])

        found = rows.mapInArrow(runtime.lean(run), schema)
        out = found if out is None else out.unionAll(found)
    return spark.createDataFrame([], schema) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, least: int = LEAST, text: str = "text", item_key: str = "item_id", item_text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` that hold no item, in place: no row moves. Rows with a null text stay."""
    spark = docs.sparkSession
    runtime.bound_batches(spark)
    at = docs.columns.index(text)
    for block in _passes(benchmark, least, item_key, item_text, block_chars, unnamed=True):
        shared = _shared(spark, block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, rate, least)
            for batch in batches:
                yield batch.filter(pa.array([not matcher.find(normalise(value.as_py())) for value in batch.column(at)], pa.bool_()))

        docs = docs.mapInArrow(runtime.lean(run), docs.schema)
    return docs
