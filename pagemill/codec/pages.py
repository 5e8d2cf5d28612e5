"""Pages: run-length coding, prefix-delta coded records, and the records themselves."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

PAGE_HEADER = struct.Struct("<IHHHHB")
#: Most bytes that a record can share with the one before it.
MOST_SHARED = 63

DATA, METADATA, DEFINITION, MEMO, NAME, INDEX = "DATA", "METADATA", "TABLE_DEFINITION", "MEMO", "TABLE_NAME", "INDEX"
# Type bytes of records; every other byte is an index.
RECORD_TYPES = {0xF3: DATA, 0xF6: METADATA, 0xFA: DEFINITION, 0xFC: MEMO, 0xFE: NAME}
TYPE_BYTE = {kind: byte for byte, kind in RECORD_TYPES.items()}


class CorruptPage(ValueError):
    """A page whose bytes do not follow the format."""


@dataclass(frozen=True)
class Page:
    ref: int
    offset: int
    size: int
    uncompressed_size: int
    unabridged_size: int
    record_count: int
    level: int

    @property
    def start(self) -> int:
        return self.offset + PAGE_HEADER.size


def parse_page(ref: int, raw: bytes) -> Page:
    if len(raw) < PAGE_HEADER.size:
        raise CorruptPage(f"page {ref}: its header is cut off")
    return Page(ref, *PAGE_HEADER.unpack_from(raw))


def _count(data: bytes, at: int) -> tuple[int, int]:
    """A run length of one or two bytes and the place after it."""
    first = data[at]
    if first <= 0x7F:
        return first, at + 1
    return (data[at + 1] << 7) | (first & 0x7F), at + 2


def rle_decompress(data: bytes) -> bytes:
    """Undo run-length coding: literal runs, each followed by repeats of its last byte."""
    out, at, end = [], 0, len(data)
    try:
        while at < end:  # the run lengths are read as in _count
            literal = data[at]
            at += 1
            if literal > 0x7F:
                literal = (data[at] << 7) | (literal & 0x7F)
                at += 1
            if not literal:
                raise CorruptPage("a literal run of no bytes")
            start, at = at, at + literal
            if at > end:
                raise CorruptPage("a literal run is cut off")
            out.append(data[start:at])
            if at < end:
                last, repeats = data[at - 1 : at], data[at]
                at += 1
                if repeats > 0x7F:
                    repeats = (data[at] << 7) | (repeats & 0x7F)
                    at += 1
                out.append(last * repeats)
    except IndexError as e:
        raise CorruptPage("a run length is cut off") from e
    return b"".join(out)


def _coded(n: int) -> bytes:
    return bytes((n,)) if n <= 0x7F else bytes(((n & 0x7F) | 0x80, n >> 7))


def rle_compress(data: bytes, shortest: int = 4, longest: int = 0x7FFF) -> bytes:
    """Run-length code: runs of at least so many equal bytes become repeats."""
    out = bytearray()

    def literal(start: int, end: int) -> None:
        while end - start > longest:
            out.extend(_coded(longest) + data[start : start + longest] + _coded(0))
            start += longest
        out.extend(_coded(end - start) + data[start:end])

    values = np.frombuffer(data, dtype=np.uint8)
    starts = np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]]) if len(values) else np.zeros(1, int)
    lengths = starts[1:] - starts[:-1]
    long = np.flatnonzero(lengths >= shortest)
    at = 0
    for start, length in zip(starts[long].tolist(), lengths[long].tolist(), strict=True):
        while length >= shortest:
            n = min(length, longest + 1)
            literal(at, start + 1)
            out += _coded(n - 1)
            at = start = start + n
            length -= n
    if at < len(data):
        literal(at, len(data))
    return bytes(out)


def split_records(data: bytes, count: int) -> Iterator[tuple[bytes, int]]:
    """The records of an uncompressed leaf and their header sizes; each keeps a prefix of the one before."""
    before, size, header, at = b"", 0, 0, 0
    for _ in range(count):
        if at >= len(data):
            raise CorruptPage("fewer records than the page's header counts")
        flags = data[at]
        at += 1
        if flags & 0x80:
            (size,) = struct.unpack_from("<H", data, at)
            at += 2
        if flags & 0x40:
            (header,) = struct.unpack_from("<H", data, at)
            at += 2
        shared = flags & MOST_SHARED
        if shared > size or shared > len(before) or at + size - shared > len(data):
            raise CorruptPage("a record is cut off")
        before = before[:shared] + data[at : at + size - shared]
        at += size - shared
        yield before, header


def join_records(records: list[tuple[bytes, int]]) -> bytes:
    """Prefix-delta code records of (bytes, header size)."""
    out, before, last_size, last_header = bytearray(), b"", None, None
    for record, header in records:
        # the first bit in which the prefixes differ is in the first byte that does
        most = min(MOST_SHARED, len(record), len(before))
        differ = int.from_bytes(record[:most], "big") ^ int.from_bytes(before[:most], "big")
        shared = most - (differ.bit_length() + 7) // 8
        flags = shared | (0x80 if len(record) != last_size else 0) | (0x40 if header != last_header else 0)
        out.append(flags)
        if flags & 0x80:
            out += struct.pack("<H", len(record))
        if flags & 0x40:
            out += struct.pack("<H", header)
        out += record[shared:]
        before, last_size, last_header = record, len(record), header
    return bytes(out)


@dataclass(frozen=True)
class Record:
    """A record: its kind, table, number where it has one, and what follows."""

    kind: str
    table: int
    number: int | None
    body: bytes


def parse_record(raw: bytes) -> Record:
    """Tell a record by its type byte. A short or odd record is an index record with its bytes."""
    if raw[:1] == b"\xfe":  # a table name: the number is in the last bytes
        return Record(NAME, int.from_bytes(raw[-4:], "big") if len(raw) >= 5 else 0, None, raw[1:-4])
    if len(raw) < 5:
        return Record(INDEX, 0, None, raw)
    table, kind = struct.unpack_from(">IB", raw)
    name = RECORD_TYPES.get(kind, INDEX)
    if name in (DATA, MEMO) and len(raw) >= 9:
        return Record(name, table, struct.unpack_from(">I", raw, 5)[0], raw[9:])
    if name == DEFINITION and len(raw) >= 7:
        return Record(name, table, struct.unpack_from("<H", raw, 5)[0], raw[7:])
    if name == METADATA and len(raw) >= 6:
        return Record(name, table, raw[5], raw[6:])
    if name == INDEX and len(raw) >= 9:
        return Record(name, table, struct.unpack_from("<I", raw, len(raw) - 4)[0], raw[4:-4])
    return Record(INDEX, table, None, raw[5:])


def make_record(kind: str, table: int, number: int = 0, body: bytes = b"") -> tuple[bytes, int]:
    """The bytes of a record and its header size."""
    if kind == NAME:
        return b"\xfe" + body + struct.pack(">I", table), 1 + len(body)
    head = struct.pack(">IB", table, TYPE_BYTE[kind])
    if kind in (DATA, MEMO):
        head += struct.pack(">I", number)
    elif kind == DEFINITION:
        head += struct.pack("<H", number)
    else:
        head += bytes((number,))
    return head + body, len(head)


def raw_records(page: Page, body: bytes) -> list[bytes]:
    """The bytes of the records of a leaf page from the bytes after its header."""
    if page.uncompressed_size > page.size:
        body = rle_decompress(body)
    return [raw for raw, _ in split_records(body, page.record_count)]


def leaf_records(page: Page, body: bytes) -> Iterator[Record]:
    """The records of a leaf page from the bytes after its header."""
    return map(parse_record, raw_records(page, body))


#: What starts a record of a table's rows, before the record's number.
DATA_HEAD = struct.Struct(">IB")


def rows_of(raws: list[bytes], table: int) -> tuple[np.ndarray, list[bytes]]:
    """Numbers and bodies of the rows of one table among raw records."""
    return numbered(raws_of(raws, table))


def raws_of(raws: list[bytes], table: int) -> list[bytes]:
    """The rows of one table among raw records, as they are."""
    head = DATA_HEAD.pack(table, TYPE_BYTE[DATA])
    return [r for r in raws if len(r) >= 9 and r.startswith(head)]


def numbered(rows: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    return np.frombuffer(b"".join([r[5:9] for r in rows]), dtype=">u4").astype(np.int64), [r[9:] for r in rows]
