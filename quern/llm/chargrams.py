"""Character n-gram counts over a fixed alphabet of 48 classes, and counts that tell the letters of a class apart.

The alphabet bounds every table of n-grams: 48^4 (5.3 million) entries at most, whatever the input,
so counts may be collected and models broadcast. Case, digits and marks of a kind are folded in all scripts. The
other classes hold many letters, OTHER all scripts but the Latin one; which one a character is, is counted in two steps,
so every other code point is told: its row of 48 code points after the character before (by that one's
row, or from U+0C00 on by its block of 48 rows), then its place in the row after the place of the character before.
Unassigned and private code points are together one more row, and are told from each other without context. That bounds
the entries by Unicode (15.1): 49 for each of 149,878 characters and one for each other code point, 8.4 million places;
rows are far fewer.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import sliced, texts

SIZE, ORDER = 48, 4
#: The classes after blank (0) and a-z (1-26), in natural order.
GROUPS = ("\n", "0123456789", ".", ",", "!?;:", "'\"-()/", "#*$%&|<>", "@_=+~`^\\{}[]", "ä", "àáâãå", "é", "èêë", "ìíîï", "ö", "òóôõ", "ü", "ùúû", "ñ", "ç")
LATIN, OTHER = 46, 47
#: Code points from here on are of class OTHER; letters from there on have no case.
_TOP, _CASED = 0x3000, 0x20000
#: Code points that a row holds, and how a class and a row make one number.
ROW, _ROWS = 48, 1 << 15


def _class_of(c: str) -> int:
    if c in " \t\x0b\x0c\r":
        return 0
    low = c.lower()[:1]
    if "a" <= low <= "z":
        return ord(low) - 96
    for i, group in enumerate(GROUPS):
        if low in group:
            return 27 + i
    return LATIN if "LATIN" in unicodedata.name(c, "") else OTHER


TABLE = np.full(0x110000, OTHER, np.uint8)
TABLE[:_TOP] = [_class_of(chr(i)) for i in range(_TOP)]
#: Letters in lower case; the classes from TOLD on are of letters or of the rest, whose members are told apart.
FOLD = np.arange(len(TABLE), dtype=np.int32)
FOLD[:_CASED] = [ord(chr(i).lower()[0]) for i in range(_CASED)]
TABLE = TABLE[FOLD]
TOLD = 27 + GROUPS.index("ä")
#: Code points of no character (all of class OTHER): among themselves a class, in OTHER a row.
NONE, _NONE_ROW = SIZE, OTHER * _ROWS + _ROWS - 1
_ASSIGNED = np.zeros(len(TABLE), bool)
for _plane in (0, 1, 2, 3, 14):  # Unicode has characters in no other
    _ASSIGNED[_plane << 16 : (_plane + 1) << 16] = [
        unicodedata.category(chr(i)) not in ("Cn", "Co", "Cs") for i in range(_plane << 16, (_plane + 1) << 16)
    ]
_KEY = np.where(_ASSIGNED, TABLE, NONE).astype(np.int32) * _ROWS + np.arange(len(TABLE), dtype=np.int32) // ROW
#: How many code points of a class a row has, and how many rows a class has.
PLACES = np.bincount(_KEY[np.bincount(FOLD, minlength=len(FOLD)) > 0], minlength=(SIZE + 1) * _ROWS).astype(np.int32)
PLACES[_NONE_ROW] = 1
ROWS = (PLACES.reshape(SIZE + 1, _ROWS) > 0).sum(axis=1)
#: Counts of rows and places are told from those of n-grams by these bits.
ROW_BIT, PLACE_BIT = 1 << 40, 1 << 41
#: Where the context begins in a row code (context, class, row) and a place code (context, class, row, place).
CONTEXT_OF_ROW, CONTEXT_OF_PLACE = 21, 27


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def classes(text: str) -> np.ndarray:
    return TABLE[points(text)]


def told(text: str, start: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
    """Where in text[start:stop] characters must be told from others of their class, and their pairs with the one before (a
    blank before the first of the text), as numbers of two folded code points."""
    p = FOLD[points(text[start - 1 : stop] if start else " " + text[:stop])]
    at = np.flatnonzero(TABLE[p[1:]] >= TOLD)
    return at, (p[at].astype(np.int64) << 21) | p[at + 1]


def members(pair: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """What tells the second code point of each pair from the others of its class: the bit of a kind of counts, where such a
    step is needed, its codes there, and how many choices it has. A class of one row or a row of one place needs none."""
    before, point = pair >> 21, pair & 0x1FFFFF
    key, real = _KEY[point].astype(np.int64), _ASSIGNED[point]
    near = before // ROW
    context = np.where(_ASSIGNED[before], 1 + np.where(near < 64, near, 64 + near // ROW), 0)
    choices = ROWS[TABLE[point]]
    at = np.flatnonzero(choices > 1)
    yield ROW_BIT, at, ((context << CONTEXT_OF_ROW) | np.where(real, key, _NONE_ROW))[at], choices[at]
    at = np.flatnonzero(~real)
    yield ROW_BIT, at, key[at], np.full(len(at), ROWS[NONE])
    context = np.where(_ASSIGNED[before] & real, 1 + before % ROW, 0)
    choices = PLACES[key]
    at = np.flatnonzero(choices > 1)
    yield PLACE_BIT, at, ((context << CONTEXT_OF_PLACE) | (key << 6) | (point % ROW))[at], choices[at]


def codes(text: str, chars: int = 1 << 20) -> Iterator[np.ndarray]:
    """The 4-gram code of each character of the text, after three blanks, in arrays of ``chars`` at most."""
    before = np.zeros(ORDER - 1, np.int32)
    for i in range(0, len(text), chars):
        p = np.concatenate((before, classes(text[i : i + chars]).astype(np.int32)))
        yield ((p[:-3] * SIZE + p[1:-2]) * SIZE + p[2:-1]) * SIZE + p[3:]
        before = p[1 - ORDER :]


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    code, where = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    return code, np.bincount(where, weights=np.concatenate([n for _, n in parts]), minlength=len(code)).astype(np.int64)


def count_characters(rows: DataFrame, column: str = "text") -> DataFrame:
    """(code, n) over all rows: 4-grams of classes, rows and places; each task sends a row for each distinct code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE**ORDER, np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        held: list[np.ndarray] = []
        pairs: list[np.ndarray] = []
        room = 1 << 18

        def settle():
            nonlocal held, pairs, parts, room
            if held:
                code, n = np.unique(np.concatenate(held), return_counts=True)
                total[code] += n
            if pairs:
                pair, n = np.unique(np.concatenate(pairs), return_counts=True)
                parts += [(code | bit, n[at]) for bit, at, code, _ in members(pair)]
            if len(parts) >= 64:
                parts = [_added(parts)]
            held, pairs, room = [], [], 1 << 18

        for b in sliced(batches):
            for text in texts(b):
                plain, start = text.isascii(), 0
                for code in codes(text):
                    held.append(code)
                    if not plain:
                        pairs.append(told(text, start, start + len(code))[1])
                    start += len(code)
                    room -= len(code)
                    if room <= 0:
                        settle()
        settle()
        code = np.flatnonzero(total)
        for own, n in [(code, total[code])] + ([_added(parts)] if parts else []):
            for i in range(0, len(own), 1 << 20):
                yield pa.RecordBatch.from_arrays([pa.array(own[i : i + (1 << 20)]), pa.array(n[i : i + (1 << 20)])], names=["code", "n"])

    return (
        rows
        .select(F.coalesce(F.col(column), F.lit("")).alias("text"))
        .mapInArrow(run, "code long, n long")
        .groupBy("code")
        .agg(F.sum("n").alias("n"))
    )


def collected(counts: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sorted codes and counts of 4-grams, rows and places; as many as the bounds above allow at most."""
    got = counts.toPandas().sort_values("code")
    code, n = got["code"].to_numpy(np.int64), got["n"].to_numpy(np.int64)
    a, b = np.searchsorted(code, (ROW_BIT, PLACE_BIT))
    return [(code[:a], n[:a]), (code[a:b] - ROW_BIT, n[a:b]), (code[b:] - PLACE_BIT, n[b:])]
