"""Pre-tokens of byte-level vocabularies, shared by token counts and BPE encoding."""

from __future__ import annotations

import json
import re
from functools import cache

from tokenizers import Tokenizer

# Characters for which the fast patterns below split texts exactly as the library does: plain ASCII
# text and Latin letters, whose classes are the same in every Unicode version and which NFC leaves alone.
LETTER = "a-zA-ZªµºÀ-ÖØ-öø-ɏ"
NUMBER = "0-9²³¹¼-¾"
UNUSUAL = re.compile("[^\t\n\r\x20-\x7e¡-¬®-ɏ]")

#: Longest string that a memo keeps.
LONGEST = 64


@cache
def byte_alphabet() -> tuple[str, ...]:
    """The printable stand-in of each byte: itself if printable Latin-1, else the next code point from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b if b in plain else spare))
        spare += b not in plain
    return tuple(out)


@cache
def _latin1_map() -> dict[int, str]:
    return dict(enumerate(byte_alphabet()))


@cache
def _byte_of() -> dict[str, int]:
    return {c: b for b, c in enumerate(byte_alphabet())}


def to_byte_level(text: str) -> str:
    return text.encode("utf-8", "surrogatepass").decode("latin-1").translate(_latin1_map())


def from_byte_level(token: str) -> str | None:
    """The text of a token, or None if its bytes are no whole characters."""
    try:
        return bytes(_byte_of()[c] for c in token).decode()
    except (KeyError, UnicodeDecodeError):
        return None


@cache
def special_splitter(tokenizer_json: str) -> tuple[re.Pattern | None, dict[str, int]]:
    """A pattern that finds added tokens in raw text as the library's default does, and their ids.

    Only plain added tokens are understood: others would need the library's
    own search, so they are refused.
    """
    added = json.loads(tokenizer_json)["added_tokens"]
    for t in added:
        if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]:
            raise ValueError(f"added token {t['content']!r} is not a plain string")
    ids = {t["content"]: t["id"] for t in added}
    longest_first = sorted(ids, key=len, reverse=True)
    return (re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if ids else None), ids


class Memo(dict):
    """A memo of a function of short strings that forgets what it learned once it holds ``most`` entries."""

    def __init__(self, function, most: int = 150_000, known: dict | None = None):
        super().__init__(known or {})
        self.function, self.most, self.known = function, most, known or {}

    def __missing__(self, key):
        value = self.function(key)
        self.learn(key, value)
        return value

    def learn(self, key, value) -> None:
        if len(key) <= LONGEST:
            self.learn_all([key], [value])

    def learn_all(self, keys: list[str], values: list) -> None:
        """Learn the values of keys that are not too long."""
        if len(self) + len(keys) > self.most:
            self.clear()
            self.update(self.known)
        self.update(zip(keys, values, strict=True))


@cache
def tokenizer(tokenizer_json: str) -> Tokenizer:
    tok = Tokenizer.from_str(tokenizer_json)
    tok.no_truncation()
    tok.no_padding()
    return tok


@cache
def between_spaces(tokenizer_json: str) -> Tokenizer:
    """The vocabulary for texts of pre-tokens in byte-level form, between spaces."""
    steps = {"added_tokens": [], "normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": None, "truncation": None, "padding": None}
    return Tokenizer.from_str(json.dumps(json.loads(tokenizer_json) | steps))
