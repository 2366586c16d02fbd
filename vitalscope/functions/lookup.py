"""Dictionary lookups that stay inside the scan stage."""

from __future__ import annotations

import json
import zlib

from pyspark.sql import Column, functions as F

# Spark compares map keys one by one, so entries are split over this many maps.
SLOTS = 512


class WordMap:
    """A small word-to-word table as a folded literal.

    The slot of a word is its CRC-32, which Spark and the builder compute
    alike, so a lookup inspects one or two entries however many there are.
    """

    def __init__(self, mapping: dict[str, str]):
        self.mapping = dict(mapping)
        slots: list[dict[str, str]] = [{} for _ in range(SLOTS)]
        for word, target in self.mapping.items():
            slots[zlib.crc32(word.encode("utf-8")) % SLOTS][word] = target
        self._literal = json.dumps(slots, ensure_ascii=False)

    def get(self, word: Column) -> Column:
        """The mapped word, or null."""
        slots = F.from_json(F.lit(self._literal), "array<map<string,string>>")
        slot = (F.crc32(word.cast("binary")) % F.lit(SLOTS)).cast("int")
        return F.element_at(F.get(slots, slot), word)

    def get_or_same(self, word: Column) -> Column:
        return F.coalesce(self.get(word), word) if self.mapping else word


def in_words(word: Column, words) -> Column:
    """Membership in a small word list; Spark turns the list into a hash set."""
    values = sorted(words)
    return word.isin(values) if values else F.lit(False)
