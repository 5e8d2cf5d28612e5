"""Token counts by the whole-token shortcut.

Offline, once per vocabulary, the driver proves which vocabulary strings encode
alone as one token: each string is encoded by the library and kept only if the
result is its own id. Texts are split into pre-tokens; a pre-token that is one
of the proven strings counts 1 with no merging, every other one is merged by
the library's model and remembered in a memo of bounded size.

Defined results: null and empty texts have 0 tokens. Added special tokens
inside texts count 1 each, as is the library's default. Texts are counted
whole, whatever their length. Null keys and extra columns pass through; one that
is called like a result column has _input appended to its name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm import byte_level, runtime

#: The columns that count_tokens() makes.
MADE = ("n_bytes", "n_tokens", "over_limit")

_FAST = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{byte_level.LETTER}]+| ?[{byte_level.NUMBER}]+| ?[^\t\n\r {byte_level.LETTER}{byte_level.NUMBER}]+|[\t\n\r ]+(?![^\t\n\r ])|[\t\n\r ]+"
)


def prove_whole_tokens(tokenizer_json: str) -> list[str]:
    """The vocabulary strings that the library encodes, alone, as the one token they spell."""
    tok = byte_level.tokenizer(tokenizer_json)
    texts, ids = [], []
    for token, i in tok.get_vocab(with_added_tokens=False).items():
        if text := byte_level.from_byte_level(token):
            texts.append(text)
            ids.append(i)
    proven = []
    for text, i, got in zip(texts, ids, tok.encode_batch(texts, add_special_tokens=False), strict=True):
        if got.ids == [i] and len(tok.pre_tokenizer.pre_tokenize_str(text)) == 1:
            proven.append(text)
    return proven


class Counter:
    """Counts the tokens of texts for one byte-level vocabulary with the usual pre-token pattern."""

    def __init__(self, tokenizer_json: str, proven: list[str]):
        self.tok = byte_level.tokenizer(tokenizer_json)
        if self.tok.normalizer is not None:
            raise ValueError("the vocabulary normalises texts; the fast split does not hold for it")
        self.special, _ = byte_level.special_splitter(tokenizer_json)
        model = self.tok.model
        self.by_text = byte_level.Memo(lambda s: len(model.tokenize(byte_level.to_byte_level(s))), known=dict.fromkeys(proven, 1))
        self.by_bytes = byte_level.Memo(lambda s: len(model.tokenize(s)), known={byte_level.to_byte_level(s): 1 for s in proven})

    def plain(self, text: str) -> int:
        """Tokens of a text without added special tokens."""
        if text.isascii() and text.isprintable() or not byte_level.UNUSUAL.search(text):
            return sum(map(self.by_text.__getitem__, _FAST.findall(text)))
        return sum(self.by_bytes[s] for s, _ in self.tok.pre_tokenizer.pre_tokenize_str(text))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is None or not self.special.search(text):
            return self.plain(text)
        parts = self.special.split(text)  # odd ones are the special tokens
        return len(parts) // 2 + sum(self.plain(p) for p in parts[::2] if p)


def count_tokens(docs: DataFrame, tokenizer_json: str, text: str = "text", keep: list[Column | str] | None = None, limit: int = 1024) -> DataFrame:
    """The columns of ``keep`` (all, if not given) with n_bytes, n_tokens and over_limit."""
    spark = docs.sparkSession
    runtime.bound_batches(spark)
    proven = prove_whole_tokens(tokenizer_json)
    shared = runtime.broadcast(spark, (tokenizer_json, proven), len(tokenizer_json) + sum(map(len, proven)))
    content = F.coalesce(docs[f"`{text}`"], F.lit(""))
    kept = docs.select(*(keep or runtime.beside(docs, MADE)), F.octet_length(content).cast("long").alias("n_bytes"), content.alias(runtime.free(docs.columns, "__text")))
    names = kept.columns[:-1]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(*shared.value)
        for batch in batches:
            n = pa.array([counter.count(x) for x in batch.column(len(names)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], n], [*names, "n_tokens"])

    schema = T.StructType(kept.schema.fields[:-1]).add("n_tokens", "long")
    return kept.mapInArrow(count, schema).withColumn("over_limit", F.col("n_tokens") > limit)
