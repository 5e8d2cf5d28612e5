"""BPE encoding and decoding by tree concatenation.

A long text is halved, wherever the middle falls, until its pieces are short;
the pieces of several texts are encoded on their own, those of a bounded batch at
once: the words that none has met before go to the library in one parallel call,
thousands of them as one text, as a call or a result for each word costs more
than its merges. Then neighbours are joined level by level.
A join re-encodes a window around the cut: its left edge lies before a white
space left of the cut, its right edge before one right of it. The window is
accepted if its first and last tokens are those that the two sides hold there
and what the sides hold between the edges and the cut is what they give alone;
else it grows, up to the ends of both sides. Both edges are places where the vocabulary's encoding starts
anew, so an accepted join equals the encoding of the whole exactly.

One unbroken word may be long too. Its leaves are encoded by the library in
one parallel batch, without the word-end mark except for the last, and joined
in windows of tokens. There the proof is that of BPE itself: a sequence of
tokens is the encoding of a word exactly if each pair of neighbours is the
encoding of the pair's text, so a window that begins and ends with the tokens
that the sides hold at those places can be spliced in.

Decoding maps ids to their vocabulary strings in one pass; with no decoder in
the vocabulary file the strings are joined by spaces, as the library does.

Defined results: null and empty texts have no tokens and decode to the empty
text. Added special tokens inside texts become their ids. Texts are encoded
whole, whatever their length; null keys and extra columns pass through. An extra
column that is called like a result column has _input appended to its name.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator, Sequence
from functools import cached_property
from itertools import chain, islice
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T
from tokenizers import Tokenizer

from pagemill.llm import byte_level, runtime

#: Longest text encoded without halving, and longest word.
LEAF, WORD_LEAF = 4096, 256
#: Characters at first between a cut and an edge of its window.
WINDOW = 32
#: Pieces that are encoded at once, and words that the library gets as one text.
AT_ONCE, TOGETHER = 64, 4096
#: Words whose tokens are remembered.
REMEMBERED = 100_000
#: Characters of texts whose tokens are held at once; a longer text is alone.
RUN = 1 << 18

#: The columns that encode() always makes.
MADE = ("n_tokens", "ids_sha256", "decoded_sha256")

_FAST = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{byte_level.LETTER}]+|[{byte_level.NUMBER}]|[^\t\n\r {byte_level.LETTER}{byte_level.NUMBER}]+")
_SPACES = " \n\t\r"
_SPACE = re.compile(f"[{_SPACES}]")


class Encoder:
    """Encodes texts for a byte-level vocabulary with word-end marks."""

    def __init__(self, tokenizer_json: str, leaf: int = LEAF, word_leaf: int = WORD_LEAF, window: int = WINDOW):
        self.tok = byte_level.tokenizer(tokenizer_json)
        self.special, self.special_ids = byte_level.special_splitter(tokenizer_json)
        self.leaf, self.word_leaf, self.window = leaf, word_leaf, window
        self.json = tokenizer_json
        self.by_text = byte_level.Memo(lambda s: self.word(byte_level.to_byte_level(s)), REMEMBERED)
        self.by_bytes = byte_level.Memo(self.word, REMEMBERED)
        self.strings = {i: t for t, i in self.tok.get_vocab(with_added_tokens=True).items()}
        self.numbers = {i: i for i in self.strings}

    # words; the vocabulary without its text steps is loaded only where a long word needs it

    @cached_property
    def suffix(self) -> str:
        return json.loads(self.json)["model"]["end_of_word_suffix"] or ""

    @cached_property
    def ends(self) -> frozenset[int]:
        """The tokens that end a word, if each word ends in one: the vocabulary has each byte, alone and with the word-end mark. Else none."""
        known = set(self.strings.values())
        if not self.suffix or not all(c in known and c + self.suffix in known for c in byte_level.byte_alphabet()):
            return frozenset()
        return frozenset(i for i, t in self.strings.items() if t.endswith(self.suffix))

    def _bare(self, suffix: str | None) -> Tokenizer:
        spec = json.loads(self.json)
        spec |= {"added_tokens": [], "normalizer": None, "pre_tokenizer": None, "post_processor": None, "model": {**spec["model"], "end_of_word_suffix": suffix}}
        return Tokenizer.from_str(json.dumps(spec))

    @cached_property
    def last(self) -> Tokenizer:
        return self._bare(self.suffix or None)

    @cached_property
    def inner(self) -> Tokenizer:
        return self._bare(None)

    def word(self, word: str) -> tuple[int, ...]:
        """The tokens of one pre-token, in its byte-level form."""
        if len(word) <= self.word_leaf:
            return tuple(t.id for t in self.tok.model.tokenize(word))
        return tuple(self.long_word(word))

    def _piece(self, word: str, start: int, end: int) -> list[int]:
        return (self.last if end == len(word) else self.inner).encode(word[start:end], add_special_tokens=False).ids

    def _width(self, token: int) -> int:
        s = self.strings[token]
        return len(s) - (len(self.suffix) if self.suffix and s.endswith(self.suffix) and len(s) > len(self.suffix) else 0)

    def long_word(self, word: str) -> list[int]:
        cuts = [*range(0, len(word), self.word_leaf), len(word)]
        inner = self.inner.encode_batch([word[a:b] for a, b in zip(cuts[:-2], cuts[1:-1], strict=True)], add_special_tokens=False)
        parts = [(a, b, e.ids) for a, b, e in zip(cuts[:-2], cuts[1:-1], inner, strict=True)]
        parts.append((cuts[-2], cuts[-1], self._piece(word, cuts[-2], cuts[-1])))
        while len(parts) > 1:
            joined = [self._join_word(word, *pair) for pair in zip(parts[::2], parts[1::2], strict=False)]
            parts = joined + parts[len(joined) * 2 :]
        return parts[0][2]

    def _join_word(self, word: str, left: tuple, right: tuple) -> tuple[int, int, list[int]]:
        (start, cut, a), (_, end, b) = left, right
        k = 4
        while True:
            i, j = max(0, len(a) - k), min(len(b), k)
            lo = cut - sum(map(self._width, a[i:]))
            hi = cut + sum(map(self._width, b[:j]))
            window = self._piece(word, lo, hi)
            left_ok = i == 0 or window[0] == a[i]
            right_ok = j == len(b) or window[-1] == b[j - 1]
            if left_ok and right_ok:
                return start, end, [*a[:i], *window, *b[j:]]
            k *= 2

    # texts

    def _usual(self, text: str) -> bool:
        """Whether the fast pattern splits a text as the library does."""
        return text.isascii() and text.isprintable() or not byte_level.UNUSUAL.search(text)

    def flat(self, text: str) -> list[int]:
        """The tokens of a text without added special tokens, word by word."""
        out: list[int] = []
        if self._usual(text):
            for ids in map(self.by_text.__getitem__, _FAST.findall(text.lower())):
                out += ids
        else:
            for s, _ in self.tok.pre_tokenizer.pre_tokenize_str(self.tok.normalizer.normalize_str(text)):
                out += self.by_bytes[s]
        return out

    def _edge(self, text: str, near: int, far: int, last: bool) -> int | None:
        """A place before a white space between two places: the last or the first."""
        if last:
            found = max(text.rfind(c, near, far) for c in _SPACES)
            return None if found < 0 else found
        found = _SPACE.search(text, near, far)
        return found.start() if found else None

    def _join(self, text: str, start: int, cut: int, end: int, a: list[int], b: list[int]) -> list[int]:
        """The tokens of text[start:end] from those of both sides of the cut."""
        width = self.window
        while True:
            lo = self._edge(text, max(start, cut - 2 * width), max(start, cut - width), True)
            hi = self._edge(text, min(end, cut + width), min(end, cut + 2 * width), False)
            lo = start if lo is None and cut - 2 * width <= start else lo
            hi = end if hi is None and cut + 2 * width >= end else hi
            if lo is not None and hi is not None:
                tail, head, whole = self.flat(text[lo:cut]), self.flat(text[cut:hi]), self.flat(text[lo:hi])
                held = a[len(a) - len(tail) :] == tail and b[: len(head)] == head
                left_ok = lo == start or (tail and whole and whole[0] == tail[0])
                right_ok = hi == end or (head and whole and whole[-1] == head[-1])
                if (held and left_ok and right_ok) or (lo == start and hi == end):
                    return [*a[: len(a) - len(tail)], *whole, *b[len(head) :]] if held else whole
            width *= 2

    def _halved(self, text: str) -> list[tuple[int, int]]:
        """The bounds of the pieces of a text, halved until they are short."""
        bounds = [(0, len(text))]
        while bounds[0][1] - bounds[0][0] > self.leaf:
            bounds = [half for a, b in bounds for half in ((a, (a + b) // 2), ((a + b) // 2, b))]
        return bounds

    def _leaves(self, texts: list[str], bounds: list[list[tuple[int, int]]]) -> Iterator[list[int]]:
        """The tokens of the pieces of all texts, one after another."""
        pieces = ((t, a, b) for t, own in zip(texts, bounds, strict=True) for a, b in own)
        while some := [t[a:b] for t, a, b in islice(pieces, AT_ONCE)]:
            words = [_FAST.findall(p.lower()) if self._usual(p) else None for p in some]
            self._learn(words)
            known = self.by_text.__getitem__
            for piece, own in zip(some, words, strict=True):
                yield self.flat(piece) if own is None else [*chain.from_iterable(map(known, own))]

    def _learn(self, words: list[list[str] | None]) -> None:
        """Encode the words of all pieces that are not known yet in one parallel call of the library, as texts of words between spaces. No word of the fast pattern has the word-end mark inside, so the mark tells where a word ends."""
        new = set().union(*filter(None, words)).difference(self.by_text)
        most = min(self.word_leaf // 2, byte_level.LONGEST)  # a usual character has two bytes at most
        new = [w for w in new if len(w) <= most]
        if len(new) < 2 or not self.ends:
            return
        runs = [new[i : i + TOGETHER] for i in range(0, len(new), TOGETHER)]
        space = byte_level.to_byte_level(" ")
        raw = [byte_level.to_byte_level(" ".join(run)).replace(space, " ") for run in runs]
        for run, e in zip(runs, byte_level.between_spaces(self.json).encode_batch_fast(raw, add_special_tokens=False), strict=True):
            ids, ends = picked(self.numbers, e.ids), self.ends  # one object for each id, however many words hold it
            stops = [k for k, i in enumerate(ids, 1) if i in ends]
            self.by_text.learn_all(run, [ids[a:b] for a, b in zip([0, *stops], stops, strict=False)])

    def trees(self, texts: list[str]) -> list[list[int]]:
        """The tokens of texts without added special tokens."""
        bounds = [*map(self._halved, texts)]
        leaves, out = self._leaves(texts, bounds), []
        for text, own in zip(texts, bounds, strict=True):
            parts = [(a, b, next(leaves)) for a, b in own]
            while len(parts) > 1:
                parts = [(a, d, self._join(text, a, b, d, x, y)) for (a, b, x), (_, d, y) in zip(parts[::2], parts[1::2], strict=True)]
            out.append(parts[0][2])
        return out

    def encode_all(self, texts: list[str | None]) -> list[list[int]]:
        """The tokens of some texts, all their pieces in batches."""
        split = [self.special.split(t) if t and self.special else [t or ""] for t in texts]
        trees = iter(self.trees([part for parts in split for part in parts[::2]]))
        out = []
        for parts in split:
            ids = next(trees)
            for special in parts[1::2]:
                ids = [*ids, self.special_ids[special], *next(trees)]
            out.append(ids)
        return out

    def encode(self, text: str | None) -> list[int]:
        return self.encode_all([text])[0]

    def decode(self, ids: list[int]) -> str:
        if self.tok.decoder is not None:
            return self.tok.decode(ids, skip_special_tokens=False)
        return " ".join(picked(self.strings, ids))


def picked(values: dict, ids: list[int]) -> Sequence:
    """The value of each id, in one call."""
    return itemgetter(*ids)(values) if len(ids) > 1 else tuple(values[i] for i in ids)


def encode(docs: DataFrame, tokenizer_json: str, text: str = "text", keep: list[Column | str] | None = None, with_ids: bool = True, with_text: bool = True) -> DataFrame:
    """The columns of ``keep`` (all, if not given) with n_tokens, both digests and, if wanted, token_ids and decoded."""
    spark = docs.sparkSession
    runtime.bound_batches(spark)
    shared = runtime.broadcast(spark, tokenizer_json, len(tokenizer_json))
    made = (*MADE, *["token_ids"] * with_ids, *["decoded"] * with_text)
    kept = docs.select(*(keep or runtime.beside(docs, made)), docs[f"`{text}`"].alias(runtime.free(docs.columns, "__text")))
    names = kept.columns[:-1]
    extra = [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string"), *[("token_ids", T.ArrayType(T.IntegerType()))] * with_ids, *[("decoded", "string")] * with_text]
    schema = T.StructType(kept.schema.fields[:-1])
    for name, kind in extra:
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        digits = {i: str(i) for i in encoder.strings}
        for batch in batches:
            texts = batch.column(len(names)).to_pylist()
            for part in runtime.slices([t or "" for t in texts], RUN):
                n, ids_sha, text_sha, all_ids, all_texts = [], [], [], [], []
                for ids in encoder.encode_all([texts[i] for i in part]):
                    decoded = encoder.decode(ids)
                    n.append(len(ids))
                    ids_sha.append(hashlib.sha256(" ".join(picked(digits, ids)).encode()).hexdigest())
                    text_sha.append(hashlib.sha256(decoded.encode()).hexdigest())
                    if with_ids:
                        all_ids.append(ids)
                    if with_text:
                        all_texts.append(decoded)
                columns = [pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)]
                columns += [pa.array(all_ids, pa.list_(pa.int32()))] * with_ids + [pa.array(all_texts, pa.string())] * with_text
                rest = batch.slice(part[0], len(part)).columns[:-1]
                yield pa.RecordBatch.from_arrays([*rest, *columns], [*names, *[x for x, _ in extra]])

    return kept.mapInArrow(runtime.lean(run), schema)
