"""JSON cut down to a budget of bytes, row by row.

Parsing keeps the order of keys, which decides what stays; VARIANT would sort them, so a small
reader works in Arrow batches. Its output is JSON text, which `try_parse_json` turns to VARIANT.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed: levels and items of a level that stay, bytes of a key, bytes of a null.
LEVELS, ITEMS, KEY_BYTES, NULL_BYTES = 4, 20, 512, 4


def letter_bytes(c: str) -> int:
    """Bytes of a character in JSON that is all ASCII."""
    if c in '"\\\b\f\n\r\t':
        return 2
    return 1 if " " <= c <= "~" else 6 if c <= "￿" else 12


def fitted(text: str, most: int) -> tuple[str, int]:
    """The longest beginning whose JSON has at most so many bytes, and its bytes; the empty one has two in any case."""
    if 12 * len(text) + 2 <= most:
        return text, 2 + sum(map(letter_bytes, text))
    keep, size = 0, 2
    for keep_next, total in enumerate(accumulate(map(letter_bytes, text), initial=2)):
        if total > most:
            break
        keep, size = keep_next, total
    return text[:keep], size


class Budget:
    """Bytes that are left; what does not fit uses up the rest."""

    def __init__(self, most: int):
        self.left = most

    def take(self, size: int) -> bool:
        fits = size <= self.left
        self.left = self.left - size if fits else 0
        return fits

    def trim(self, value: object, level: int = 0) -> object:
        """value with texts, lists and objects shortened; nothing is left of what lies too deep or comes too late."""
        if self.left <= 0:
            return None
        if level == LEVELS:
            self.take(NULL_BYTES)
            return None
        if isinstance(value, str):
            text, size = fitted(value, self.left)
            self.take(size)
            return text
        if not isinstance(value, (list, dict)):
            self.take(len(json.dumps(value)))
            return value
        out: list | dict = type(value)()
        if not self.take(2):
            return out
        for nth, part in enumerate(list(value)[:ITEMS]):
            if isinstance(value, dict) and self.left <= 0 or not self.take(min(nth, 1)):
                break
            if isinstance(out, list):
                out.append(self.trim(part, level + 1))
                continue
            key, size = fitted(part, min(self.left, KEY_BYTES))
            if not self.take(size + 1):
                break
            out[key] = self.trim(value[part], level + 1)
        return out


def arranged(value: object, reserved: Sequence, priority: Sequence[str], snippets: Sequence) -> object:
    """An object with reserved and priority keys first; other values stay."""
    if not isinstance(value, dict):
        return value
    own = {key: Budget(most).trim(value[key]) for names, most in reserved for key in [next((n for n in names if n in value), None)] if key is not None}
    out = own | {key: value[key] for key in (*priority, *value) if key in value and key not in own}
    for names, items, field, most in snippets:
        present = [n for n in names if n in out]
        for other in present[1:]:
            del out[other]
        if present and isinstance(out[present[0]], list):
            shorten = lambda e: e | {field: fitted(e[field], most)[0]} if isinstance(e, dict) and isinstance(e.get(field), str) else e  # noqa: B023, E731
            out[present[0]] = [shorten(e) for e in out[present[0]][:items]]
    return out


def bounded_json(text: Column, most: int, reserved: Sequence[tuple[Sequence[str], int]] = (), priority: Sequence[str] = (), snippets: Sequence[tuple[Sequence[str], int, str, int]] = ()) -> Column:
    """JSON text cut down to a budget of bytes: four levels, twenty items a level, keys of 512 bytes at most.

    reserved are (names, bytes): of an object's keys the first present of the names comes first, with
    a budget of its own; priority keys come next. snippets are (names, items, field, bytes): the list
    under the first present name keeps so many items, whose text field is shortened. Text that is
    null or no JSON gives null. Sizes are those of ASCII JSON without spaces; a last number or null
    may stand over the budget by its own bytes.
    """

    @F.arrow_udf("string")
    def cut(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            try:
                value = json.loads(t) if t is not None else None
            except ValueError:
                value, t = None, None
            out.append(None if t is None else json.dumps(Budget(most).trim(arranged(value, reserved, priority, snippets)), separators=(",", ":")))
        return pa.array(out, pa.string())

    return cut(text)
