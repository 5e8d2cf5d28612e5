"""Arrays among fields: one field of several elements, or several fields that are the elements of one array."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pagemill.codec.types import FieldDef, TableDef

#: Fields longer than this are not members of an array by the digits of their name alone.
LONGEST_MEMBER = 8


@dataclass(frozen=True)
class ArrayDef:
    base: str
    members: tuple[FieldDef, ...]

    @property
    def single(self) -> bool:
        return len(self.members) == 1


def base_name(name: str, size: int) -> str:
    """The name without an element number: X$2 is X; short fields lose their last digits."""
    if "$" in name:
        return name.split("$", 1)[0]
    return name if size > LONGEST_MEMBER else re.sub(r"\d+$", "", name) or name


def _element(f: FieldDef) -> int:
    digits = re.search(r"(\d+)$", f.name)
    return int(digits[1]) if digits else -1


def analyse(table: TableDef, same_type: bool = True) -> tuple[list[FieldDef], list[ArrayDef]]:
    """The plain fields in order, and the arrays.

    Several fields are an array if their offsets are evenly spaced and, unless
    ``same_type`` is off, their types and sizes are equal and lie end to end.
    """
    groups: dict[str, list[FieldDef]] = {}
    for f in table.fields:
        if f.elements <= 1:
            groups.setdefault(base_name(f.name, f.size), []).append(f)
    arrays: list[ArrayDef] = [ArrayDef(f.name, (f,)) for f in table.fields if f.elements > 1]
    for base, found in groups.items():
        found = sorted(found, key=lambda f: f.offset)
        if len(found) < 2:
            continue
        steps = {b.offset - a.offset for a, b in zip(found[:-1], found[1:], strict=True)}
        even = len(steps) == 1
        alike = len({(f.type, f.size, f.decimals) for f in found}) == 1 and steps == {found[0].size} and found == sorted(found, key=_element)
        if even and (alike or not same_type):
            arrays.append(ArrayDef(base, tuple(found)))
    used = {f.name for a in arrays for f in a.members}
    order = {f.name: i for i, f in enumerate(table.fields)}
    return [f for f in table.fields if f.name not in used], sorted(arrays, key=lambda a: order[a.members[0].name])
