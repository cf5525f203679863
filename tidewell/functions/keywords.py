"""Tables of keywords as one dictionary: a text is searched once, and a bit for each table tells whether it holds one of its words."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once a row: a lambda's variable is computed once, a captured expression for each use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def longest_at_each_place(words: Sequence[str]) -> str:
    """A pattern without width whose group is, at each place of a text, the longest of words that begins there.

    Words that begin alike share their beginning, so a place is tried by its first character, not word by word.
    """

    def part(rest: list[str]) -> str:
        by: dict[str, list[str]] = {}
        for w in rest:
            if w:
                by.setdefault(w[0], []).append(w[1:])
        if not by:
            return ""
        inner = "|".join(re.escape(first) + part(more) for first, more in by.items())
        return f"(?:{inner})" + ("?" if "" in rest else "")

    return f"(?=({part(sorted(set(words)))}))"


class Dictionary:
    """tables: name -> keywords, told by the bits 0, 1, ... of a long (63 tables at most)."""

    def __init__(self, tables: Mapping[str, Sequence[str]]):
        if len(tables) > 63 or any(not w for words in tables.values() for w in words):
            raise ValueError("63 tables at most, of words that aren't empty")
        self.bit = {name: 1 << i for i, name in enumerate(tables)}
        every = sorted({w for words in tables.values() for w in words})
        self.pattern = longest_at_each_place(every)
        # a word is found where it begins, or in a longer one that begins with it at the same place
        self.telling = {name: [w for w in every if any(w.startswith(x) for x in words)] for name, words in tables.items()}

    def mask(self, text: Column) -> Column:
        """Bits of the tables of which text holds a word; 0 for null."""
        found = F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(self.pattern), F.lit(1)))

        def bits(held: Column) -> Column:
            out = F.lit(0).cast("long")
            for name, words in self.telling.items():
                told = F.arrays_overlap(held, F.array(*[F.lit(w) for w in words]))
                out = out.bitwiseOR(F.when(told, F.lit(self.bit[name]).cast("long")).otherwise(F.lit(0).cast("long")))
            return out

        return let(found, lambda held: F.when(F.size(held) == 0, F.lit(0).cast("long")).otherwise(bits(held)))

    def has(self, mask: Column, *tables: str) -> Column:
        """Whether mask has a bit of one of the tables."""
        return mask.bitwiseAND(F.lit(sum(self.bit[t] for t in tables)).cast("long")) != 0

    def first(self, mask: Column, tables: Sequence[str]) -> Column:
        """The first of the tables whose bit mask has, or null."""
        return F.coalesce(*[F.when(self.has(mask, t), F.lit(t)) for t in tables])
