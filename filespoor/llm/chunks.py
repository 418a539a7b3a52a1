"""Cuts texts into chunks that a tokenizer encodes on its own, and remembers what it got for them.

The tokenizers' patterns let a word take the one space before it, so a text can be cut before every single space that
stands between other characters. Words repeat, so most chunks are found in a dictionary; only new ones are encoded, many
at a time. The dictionary is emptied when it is full, so a task's memory is bounded whatever it reads.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc

BATCH_CHARS = 1_000_000
CACHE_SIZE = 800_000  # more than the different words of a usual task; about 170 MB

# white space other than the space and line feed, also what only Python takes for white space
_OTHER_SPACE = re.compile("[\t\x0b-\r\x1c-\x1f\x85\xa0  -     　]")
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")


def split(text: str) -> list[str]:
    """Chunks without the space before them; the first one has none."""
    if "  " in text or "\n " in text or " \n" in text or _OTHER_SPACE.search(text):
        return _BETWEEN.split(text)
    return text.split(" ")


class Cache:
    """Values of chunks; ``encode`` gets lists of new chunks."""

    def __init__(self, encode: Callable[[list[str]], list], size: int = CACHE_SIZE):
        self.encode, self.size = encode, size
        self.first: dict[str, object] = {}
        self.later: dict[str, object] = {}

    def of(self, texts: list[str]) -> list[list]:
        """For each text the values of its chunks, in order."""
        if len(self.first) + len(self.later) > self.size:
            self.first.clear()
            self.later.clear()
        cut = [split(x) for x in texts]
        heads = {x[0] for x in cut}.difference(self.first)
        words = set().union(*(x[1:] for x in cut)).difference(self.later)
        heads, words = list(heads), list(words)
        values = self.encode(heads + [" " + x for x in words])
        self.first.update(zip(heads, values))
        self.later.update(zip(words, values[len(heads):]))
        find = self.later.__getitem__
        return [[self.first[x[0]], *map(find, x[1:])] for x in cut]


def parts(batch: pa.RecordBatch, column: str = "text", most: int = BATCH_CHARS) -> Iterator[tuple[int, list[str]]]:
    """The texts of a batch in runs of about ``most`` bytes, each with its first row; null is empty."""
    texts, sizes = batch.column(column), pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
    start = total = 0
    for i, size in enumerate(sizes):
        total += size
        if total >= most or i + 1 == len(sizes):
            yield start, [x or "" for x in texts.slice(start, i + 1 - start).to_pylist()]
            start, total = i + 1, 0
