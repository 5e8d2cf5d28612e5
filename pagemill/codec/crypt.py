"""The format's encryption: 64-byte blocks of sixteen words under a key of sixteen words, vectorised over blocks."""

from __future__ import annotations

import numpy as np

BLOCK = 64
_U = np.uint32


def key_words(password: str, encoding: str = "cp1251") -> np.ndarray:
    """The sixteen key words of a password: spread over 64 bytes, then mixed in two rounds."""
    text = password.encode(encoding) + b"\0"
    spread = bytearray(BLOCK)
    for i in range(BLOCK):
        spread[(i * 0x11) & 0x3F] = (i + text[(i + 1) % len(text)]) & 0xFF
    words = np.frombuffer(bytes(spread), dtype="<u4").astype(np.uint32)
    for _ in range(2):
        words = _mix(words)
    return words


def _mix(words: np.ndarray) -> np.ndarray:
    """One round: each word is exchanged with the partner that its low bits name, both added and combined."""
    out = [int(w) for w in words]
    for i in range(16):
        j = out[i] & 0x0F
        a, b = out[i], out[j]
        out[j] = (a + (a & b)) & 0xFFFFFFFF
        out[i] = ((a | b) + a) & 0xFFFFFFFF
    return np.array(out, dtype=np.uint32)


def _blocks(data: bytes) -> np.ndarray:
    """A row for each of the sixteen places, a column for each block."""
    if len(data) % BLOCK:
        raise ValueError(f"{len(data)} bytes are no whole blocks of {BLOCK}")
    return np.array(np.frombuffer(data, dtype="<u4").reshape(-1, 16).T, dtype=np.uint32, order="C")


def decrypt(data: bytes, key: np.ndarray) -> bytes:
    """Plain text of whole blocks: places 15 to 0, each with the partner its key word names."""
    words = _blocks(data)
    for i in range(15, -1, -1):
        k, j = key[i], int(key[i]) & 0x0F
        a, b = words[i] - k, words[j] - k
        words[i], words[j] = (a & k) | (b & ~k), (b & k) | (a & ~k)
    return words.T.astype("<u4").tobytes()


def encrypt(data: bytes, key: np.ndarray) -> bytes:
    """The inverse: places 0 to 15, bits swapped under the key, then the key added."""
    words = _blocks(data)
    for i in range(16):
        k, j = key[i], int(key[i]) & 0x0F
        a, b = words[i].copy(), words[j].copy()
        words[i], words[j] = ((a & k) | (b & ~k)) + k, ((b & k) | (a & ~k)) + k
    return words.T.astype("<u4").tobytes()
