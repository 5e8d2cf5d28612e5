"""Table definitions: parsing, writing, and recovery where the bytes are damaged."""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterable, Iterator
from dataclasses import replace

from pagemill.codec.types import CODE_OF, CODES, TEXT, FieldDef, IndexDef, MemoDef, TableDef


class BadDefinition(ValueError):
    """Definition bytes that do not follow the format."""


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, code: str):
        try:
            value = struct.unpack_from("<" + code, self.data, self.at)
        except struct.error as e:
            raise BadDefinition(f"the definition ends at byte {len(self.data)}") from e
        self.at += struct.calcsize("<" + code)
        return value[0] if len(value) == 1 else value

    def text(self) -> str:
        end = self.data.find(b"\0", self.at)
        if end < 0:
            raise BadDefinition("a name does not end")
        value, self.at = self.data[self.at : end], end + 1
        return value.decode("ascii", "replace")


def parse_header(data: bytes) -> tuple[int, int, int, int]:
    """Record size and numbers of fields, memos and indexes."""
    return _Reader(data).take("HHHHH")[1:]


def _field(r: _Reader) -> FieldDef:
    code = r.take("B")
    if code not in CODES:
        raise BadDefinition(f"no field type has the code {code:#x}")
    kind, offset, name = CODES[code], r.take("H"), r.text()
    elements, size, overlaps, number = r.take("HHHH")
    element_size = template = decimals = 0
    if kind in TEXT:
        element_size, template = r.take("HH")
    elif kind == "DECIMAL":
        decimals, element_size = r.take("BB")
    return FieldDef(name, kind, offset, size, max(1, elements), number, overlaps, element_size, template, decimals)


def _external(r: _Reader) -> str:
    name = r.text()
    if not name and r.take("B") != 1:
        raise BadDefinition("the mark of an internal part is missing")
    return name


def _memo(r: _Reader) -> MemoDef:
    external, name = _external(r), r.text()
    size, flags = r.take("H"), r.take("H")
    return MemoDef(name, size, bool(flags & 0x04), external, flags)


def _index(r: _Reader) -> IndexDef:
    external, name, flags, count = _external(r), r.text(), r.take("B"), r.take("H")
    fields = tuple((n, order != 0) for n, order in (r.take("HH") for _ in range(count)))
    return IndexDef(name, fields, external, (flags >> 5) & 3, bool(flags & 4), bool(flags & 2), not flags & 1)


def parse(data: bytes, number: int, name: str, recover: bool = False) -> TableDef:
    """A definition from its bytes, the portions in order. ``recover`` takes what can be read of damaged ones."""
    r = _Reader(data)
    fields: list[FieldDef] = []
    try:
        _, record_size, n_fields, n_memos, n_indexes = r.take("HHHHH")
        for _ in range(n_fields):
            fields.append(_field(r))
        memos = tuple(_memo(r) for _ in range(n_memos))
        indexes = tuple(_index(r) for _ in range(n_indexes))
        return TableDef(number, name, record_size, tuple(fields), memos, indexes)
    except BadDefinition:
        if not recover:
            raise
        return recovered(data, number, name, fields)


def printable_names(data: bytes) -> list[str]:
    """All strings of printable characters that a zero byte ends, two characters or longer, in order and once."""
    out: dict[str, None] = {}
    for part in data.split(b"\0")[:-1]:
        end = len(part)
        start = end
        while start and 0x20 < part[start - 1] < 0x7F:
            start -= 1
        if end - start >= 2:
            out[part[start:end].decode("ascii")] = None
    return list(out)


# Ways to find field names in bytes that no longer follow the format. Each gives
# names in the order in which it meets them; vote() takes the best.

_NAME = re.compile(r"[A-Za-z][A-Za-z0-9_:$]{1,49}")
ENCODINGS = ("ascii", "latin-1", "cp1252", "utf-8", "utf-16", "utf-16-le", "utf-16-be")
TERMINATORS = (*range(17), 32, 255)
LENGTHS = (8, 10, 12, 16, 20, 24, 32, 40, 48, 64)
ALIGNMENTS = (1, 2, 4, 8, 16, 32)
STARTS = tuple(range(10, 101, 10))


def is_name(text: str) -> bool:
    return _NAME.fullmatch(text) is not None


def _names(parts: Iterable[str]) -> list[str]:
    return list(dict.fromkeys(p for p in parts if is_name(p)))


def score(names: list[str], n_fields: int) -> float:
    """How near a list comes to the stated number of fields: too many names count against it as too few do."""
    return min(len(names), n_fields) / max(len(names), n_fields, 1)


def _best(tries: Iterable[list[str]], n_fields: int) -> list[str]:
    """The list with the best score; of several the one with the longest names, as cut ones are shorter, then the first."""
    return max(tries, key=lambda names: (score(names, n_fields), sum(map(len, names))), default=[])


def by_encoding(data: bytes, n_fields: int) -> list[str]:
    """Strings that end with a zero character, in one encoding after another."""
    return _best((_names(data.decode(e, "replace").split("\0")) for e in ENCODINGS), n_fields)


def by_terminator(data: bytes, n_fields: int) -> list[str]:
    """Strings between each of the bytes that may end one."""
    return _best((_names(p.decode("ascii", "replace") for p in data.split(bytes((t,)))) for t in TERMINATORS), n_fields)


def by_length_prefix(data: bytes, n_fields: int) -> list[str]:
    """Strings after their length, of one byte or two, from the place behind the header."""
    found, at = [], 10
    while at < len(data):
        for width in (1, 2):
            n = int.from_bytes(data[at : at + width], "little")
            text = data[at + width : at + width + n].decode("ascii", "replace")
            if 1 <= n <= 50 and is_name(text):
                found.append(text)
                at += width + n
                break
        else:
            end = data.find(b"\0", at, at + 16)
            at = end + 1 if end >= 0 else at + 16
    return _names(found)


def by_start(data: bytes, n_fields: int) -> list[str]:
    """Strings that end with a zero byte, from different places behind the header."""
    return _best((_names(p.decode("ascii", "replace") for p in data[s:].split(b"\0")) for s in STARTS), n_fields)


def by_length(data: bytes, n_fields: int) -> list[str]:
    """Slots of a fixed length, cut at their first zero byte."""
    return _best((_names(data[i : i + n].split(b"\0", 1)[0].decode("ascii", "replace") for i in range(0, len(data), n)) for n in LENGTHS), n_fields)


def by_alignment(data: bytes, n_fields: int) -> list[str]:
    """Strings that begin at a multiple of some width and end with a zero byte."""

    def aligned(width: int) -> Iterator[str]:
        at = 0
        while at < len(data):
            end = data.find(b"\0", at)
            end = len(data) if end < 0 else end
            if is_name(text := data[at:end].decode("ascii", "replace")):
                yield text
                at = end + 1
            else:
                at += 1
            at = -(-at // width) * width

    return _best((_names(aligned(w)) for w in ALIGNMENTS), n_fields)


def by_reversal(data: bytes, n_fields: int) -> list[str]:
    """Strings of the reversed bytes, spelled as they stand there."""
    return [n for n in printable_names(data[::-1]) if is_name(n)]


def by_known(data: bytes, known: Iterable[str] = ()) -> list[str]:
    """Names that are known beforehand, where they occur, in order of place."""
    at = {name: data.find(name.encode("ascii", "replace")) for name in known}
    return sorted((n for n, i in at.items() if i >= 0), key=at.__getitem__)


def by_rows_of_16(data: bytes, n_fields: int) -> list[str]:
    """Strings that begin in the rows of 16 bytes, one from each at most."""
    found = []
    for i in range(0, len(data), 16):
        text = data[i : i + 64].lstrip(bytes(range(33))).split(b"\0", 1)[0].decode("ascii", "replace")
        if is_name(text):
            found.append(text)
    return _names(found)


def scanned_fields(data: bytes, n_fields: int, least: float = 0.3) -> list[FieldDef]:
    """Fields parsed one after another from whichever place gives the most of them with proper names; none if that is too small a share."""
    best: list[FieldDef] = []
    for start in range(min(len(data), 256)):
        r, found = _Reader(data), []
        r.at = start
        try:
            while len(found) < n_fields:
                f = _field(r)
                if not is_name(f.name):
                    break
                found.append(f)
        except BadDefinition:
            pass
        if len(found) > len(best):
            best = found
    return best if n_fields and len(best) >= least * n_fields else []


METHODS: dict[str, Callable[[bytes, int], list[str]]] = {
    "printable": lambda data, n: [x for x in printable_names(data) if is_name(x)],
    "scan": lambda data, n: [f.name for f in scanned_fields(data, n)],
    "encoding": by_encoding,
    "terminator": by_terminator,
    "length_prefix": by_length_prefix,
    "start": by_start,
    "length": by_length,
    "alignment": by_alignment,
    "rows_of_16": by_rows_of_16,
    "reversal": by_reversal,
}
#: The methods of a vote; names that are spelled backwards do not stand for election.
VOTING = tuple(m for m in METHODS if m != "reversal")
#: Methods that are tried together: the strings' own form, and their places.
ADVANCED, ALTERNATIVE = ("encoding", "terminator", "length_prefix", "start"), ("length", "alignment", "reversal", "printable")


def candidates(data: bytes, n_fields: int, methods: Iterable[str] = tuple(METHODS), known: Iterable[str] = ()) -> list[tuple[float, str, list[str]]]:
    """(score, method, names) of every method, the best first; methods of one score stay in their order."""
    made = [(score(names, n_fields), m, names) for m in methods if (names := METHODS[m](data, n_fields))]
    if found := by_known(data, known):
        made.append((score(found, n_fields), "known", found))
    return sorted(made, key=lambda x: -x[0])


def vote(data: bytes, n_fields: int, methods: Iterable[str] = VOTING, known: Iterable[str] = ()) -> list[str]:
    """The names of the best method."""
    found = candidates(data, n_fields, methods, known)
    return found[0][2] if found else []


def comprehensive(data: bytes, n_fields: int) -> list[str]:
    """The names of all methods but the reversal, best method first, each once."""
    return list(dict.fromkeys(n for _, _, names in candidates(data, n_fields, VOTING) for n in names))


def parse_portions(portions: dict[int, bytes], number: int, name: str, recover: bool = False) -> TableDef:
    """A definition from its portions in order; with ``recover``, a portion that is missing or damaged costs the fields that it held only."""
    whole = b"".join(portions[k] for k in sorted(portions))
    if not recover:
        return parse(whole, number, name)
    try:
        return parse(whole, number, name)
    except BadDefinition:
        made = parse(whole, number, name, recover=True)
        later = [n for k in sorted(portions)[1:] for n in vote(portions[k], len(made.fields)) if n not in {f.name for f in made.fields}]
        named = iter(later)
        fields = tuple(replace(f, name=next(named, f.name)) if f.name.startswith("FIELD_") else f for f in made.fields)
        return replace(made, fields=fields)


def recovered(data: bytes, number: int, name: str, parsed: list[FieldDef]) -> TableDef:
    """A last resort: the fields that could be parsed, there or further on, then eight-byte numbers under the names that the methods find."""
    try:
        record_size, n_fields, _, _ = parse_header(data)
    except BadDefinition:
        record_size, n_fields = 8, 1
    fields = max(parsed, scanned_fields(data, n_fields), key=len)[:]
    seen = [n for n in vote(data[10:], n_fields) or printable_names(data[10:]) if n not in {f.name for f in fields}]
    at = max((f.offset + f.size for f in fields), default=0)
    while len(fields) < n_fields and at + 8 <= record_size:
        k = len(fields)
        fields.append(FieldDef(seen.pop(0) if seen else f"FIELD_{k + 1}", "DOUBLE", at, 8, 1, k))
        at += 8
    return TableDef(number, name, record_size, tuple(fields), recovered=True)


def build(table: TableDef) -> bytes:
    """The bytes of a definition."""
    out = bytearray(struct.pack("<HHHHH", 1, table.record_size, len(table.fields), len(table.memos), len(table.indexes)))
    text = lambda s: s.encode("ascii", "replace") + b"\0"
    for f in table.fields:
        out += struct.pack("<BH", CODE_OF[f.type], f.offset) + text(f.name) + struct.pack("<HHHH", f.elements, f.size, f.overlaps, f.number)
        if f.type in TEXT:
            out += struct.pack("<HH", f.element_size or f.stride, f.template)
        elif f.type == "DECIMAL":
            out += struct.pack("<BB", f.decimals, f.element_size or f.stride)
    for m in table.memos:
        out += text(m.external) + (b"" if m.external else b"\x01") + text(m.name) + struct.pack("<HH", m.size, m.flags | (0x04 if m.blob else 0))
    for i in table.indexes:
        flags = (i.kind & 3) << 5 | i.nocase << 2 | i.optional << 1 | (not i.unique)
        out += text(i.external) + (b"" if i.external else b"\x01") + text(i.name) + struct.pack("<BH", flags, len(i.fields))
        for n, descending in i.fields:
            out += struct.pack("<HH", n, int(descending))
    return bytes(out)
