"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole by a template of control strings, encoded once
with offsets, and the spans of its assistant texts are intersected with the
spans of its tokens by binary search: both lists are sorted, so the tokens of a
turn are one run, found by two searches.

Template: each turn is ``### Role:`` and a line break, the escaped text, then
``</turn>`` and a line break. Escaping puts a backslash before each backslash,
``#`` and ``<`` of a role or text. Inside texts no ``#`` or ``<`` is then
without an odd run of backslashes before it, so no text can spell a control
string, and removing each escaping backslash gives the text back.

Rows are sorted by conversation and turn within partitions and streamed: memory
holds one conversation, the unit that is encoded, and never a whole partition.

Defined results: null texts are empty, null roles the empty role. Turns are
taken by turn (nulls first), then role, then text; repeated rows are turns of
their own. Rows with a null conversation id form one conversation. An empty
table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm import byte_level, runtime

OPEN, CLOSE = "### ", "</turn>\n"
LOSS_ROLE = "assistant"
#: Characters encoded at once, unless one conversation has more.
CHUNK = 1 << 17
_ESCAPED = re.compile(r"[\\#<]")
_UNESCAPE = re.compile(r"\\(.)", re.S)
#: A turn in formatted text: in an escaped part, a backslash hides the character after it.
_TURN = re.compile(r"### ((?:[^\\#<:]|\\.)*+):\n((?:[^\\#<]|\\.)*+)</turn>\n", re.S)


def escape(text: str) -> str:
    return _ESCAPED.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def render(turns: Iterable[tuple[str, str]], loss_role: str = LOSS_ROLE) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans of its texts under the loss, in code points."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{escape(role).replace(':', chr(92) + ':')}:\n", escape(text)
        if role == loss_role:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += (head, body, CLOSE)
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation; fails on anything that render() does not make."""
    turns, at = [], 0
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if not found:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(found[1]), unescape(found[2])))
        at = found.end()
    return turns


def token_mask(offsets: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which tokens lie under a span, wholly or in part. Offsets are sorted; spans are sorted and apart."""
    mask = np.zeros(len(offsets), dtype=bool)
    if len(offsets) and spans:
        starts, ends = np.array(spans).T
        first = np.searchsorted(offsets[:, 1], starts, side="right")  # the first that ends after the start
        last = np.searchsorted(offsets[:, 0], ends, side="left")  # the first that starts at or after the end
        for a, b, empty in zip(first, last, starts == ends, strict=True):
            if not empty:
                mask[a:b] = True
    return mask


def masked_pieces(formatted: str, offsets: np.ndarray, mask: np.ndarray, spans: list[tuple[int, int]]) -> list[str]:
    """For each span, the text that its masked tokens cover within it, each character once."""
    out = []
    for start, end in spans:
        if start == end:
            out.append("")
            continue
        a, b = np.searchsorted(offsets[:, 1], start, side="right"), np.searchsorted(offsets[:, 0], end, side="left")
        covered, pieces = start, []
        for lo, hi in offsets[a:b][mask[a:b]]:
            lo, hi = max(int(lo), covered), min(int(hi), end)
            if lo < hi:
                pieces.append(formatted[lo:hi])
                covered = hi
        out.append("".join(pieces))
    return out


SCHEMA = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("formatted", T.StringType()),
        T.StructField("token_ids", T.ArrayType(T.IntegerType())),
        T.StructField("loss_mask", T.ArrayType(T.BooleanType())),
        T.StructField("token_starts", T.ArrayType(T.IntegerType())),
        T.StructField("token_ends", T.ArrayType(T.IntegerType())),
        T.StructField("loss_starts", T.ArrayType(T.IntegerType())),
        T.StructField("loss_ends", T.ArrayType(T.IntegerType())),
    ]
)


def format_chats(turns: DataFrame, tokenizer_json: str, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: the formatted text, its token ids with offsets, the loss mask and the loss spans."""
    spark = turns.sparkSession
    runtime.bound_batches(spark)
    shared = runtime.broadcast(spark, tokenizer_json, len(tokenizer_json))
    rows = turns.select(F.col(key).cast("long").alias("k"), F.col(turn).alias("n"), F.coalesce(role, F.lit("")).alias("r"), F.coalesce(text, F.lit("")).alias("t"))
    rows = rows.repartition("k").sortWithinPartitions("k", "n", "r", "t").select("k", "r", "t")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = byte_level.tokenizer(shared.value)
        held, size = [], 0
        for k, group in groupby(stream(batches), key=lambda x: x[0]):
            formatted, spans = render((r, t) for _, r, t in group)
            held.append((k, formatted, spans))
            size += len(formatted)
            if size >= CHUNK:
                yield _encoded(tok, held)
                held, size = [], 0
        if held:
            yield _encoded(tok, held)

    return rows.mapInArrow(run, SCHEMA)


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """An Arrow array of lists from arrays of numbers, without a Python object for each."""
    ends = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values), kind))


def _encoded(tok, held: list[tuple]) -> pa.RecordBatch:
    ids, masks, offsets = [], [], []
    for _, formatted, spans in held:  # one at a time: the library's result takes far more memory than these arrays
        e = tok.encode(formatted, add_special_tokens=False)
        ids.append(np.array(e.ids, dtype=np.int32))
        offsets.append(np.array(e.offsets, dtype=np.int32).reshape(-1, 2))
        masks.append(token_mask(offsets[-1], spans))
    spans = [np.array(s, dtype=np.int32).reshape(-1, 2) for _, _, s in held]
    ints = pa.int32()
    columns = [pa.array([k for k, *_ in held], pa.int64()), pa.array([f for _, f, _ in held], pa.string()), _lists(ids, ints), _lists(masks, pa.bool_())]
    columns += [_lists([o[:, i] for o in some], ints) for some in (offsets, spans) for i in (0, 1)]
    return pa.RecordBatch.from_arrays(columns, SCHEMA.names)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, n_loss_tokens long"


def read_back(chats: DataFrame) -> DataFrame:
    """Digests of what the formatted conversations hold: turns parsed from the text, loss text from tokens and mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                k, formatted, starts, ends, mask, lo, hi = (batch.column(n)[i] for n in ("conv_id", "formatted", "token_starts", "token_ends", "loss_mask", "loss_starts", "loss_ends"))
                k, formatted = k.as_py(), formatted.as_py()
                offsets = np.stack([starts.values.to_numpy(), ends.values.to_numpy()], axis=1)
                flags = mask.values.to_numpy(zero_copy_only=False)
                pieces = masked_pieces(formatted, offsets, flags, list(zip(lo.as_py(), hi.as_py(), strict=True)))
                loss = "".join(map(unescape, pieces))
                turns = parse(formatted)
                said = "".join(f"{r}\n{t}\n" for r, t in turns)
                out.append((k, len(turns), _sha(said), len(loss), _sha(loss), len(formatted), len(flags), int(flags.sum())))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in DIGESTS.split(", ")])

    return chats.mapInArrow(run, DIGESTS)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
