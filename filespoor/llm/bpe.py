"""Byte-pair encoding in batched numpy merge rounds.

The symbols of many words stand in one flat array. Each round finds, for every word at once, its lowest-rank pair and
merges all its places; ranks come from a binary search over sorted pair keys and are looked up anew only beside merged
places. Words without a known pair leave the array. Decoding joins the bytes of the ids.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from filespoor.llm import chunks
from filespoor.llm.common import table
from filespoor.llm.registry import query

VOCABULARY = "byte_bpe_50k.json"
NO_RANK = np.int32(2**31 - 1)


def _byte_names() -> dict[str, int]:
    """Vocabularies write each byte as a printable character: itself, or one of those from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


_SPACE, _LETTER, _DIGIT, _SIGN, _LINE, _HARD = range(6)


def _kinds() -> np.ndarray:
    """Classes of bytes: the pattern's words are stretches of one class, and take one space before them."""
    kinds = np.full(256, _HARD, np.uint8)
    for byte in range(33, 127):
        kinds[byte] = _LETTER if chr(byte).isalpha() else _DIGIT if chr(byte).isdigit() else _SIGN
    # apostrophes may begin an ending such as 's, "<" a special token
    kinds[[ord("'"), ord("<")]] = _HARD
    kinds[ord("\n")] = _LINE  # alone between other characters it is a word of its own
    return kinds


def _cut(symbol: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """Consecutive ids as bytes, ``counts`` of them each."""
    flat = symbol.astype("<u4").tobytes()
    ends = (np.cumsum(counts) * 4).tolist()
    return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends)]


class Bpe:
    """A vocabulary with its merges, read from a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        vocab, names = data["model"]["vocab"], _byte_names()
        merges = [m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.tokens = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in vocab.items():
            self.tokens[i] = bytes(names[c] for c in token)
        for token, i in self.special.items():
            self.tokens[i] = token.encode()
        self.start = np.zeros(256, np.int32)
        for char, byte in names.items():
            self.start[byte] = vocab[char]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int32)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.kinds = _kinds()
        if any(token[:1] != "<" for token in self.special):
            self.kinds[:] = _HARD
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], NO_RANK)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as little-endian unsigned 32-bit integers. Words aren't empty."""
        if not words:
            return []
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        word, symbol = self._merged(np.frombuffer(b"".join(words), np.uint8), np.repeat(np.arange(len(words), dtype=np.int32), lengths))
        return _cut(symbol, np.bincount(word, minlength=len(words)))

    def _merged(self, data: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words' numbers and ids, in order, of bytes that belong to the words ``word`` (not falling)."""
        symbol = self.start[data]
        rank = np.full(len(symbol), NO_RANK, np.int32)  # of the pair that starts here
        inside = np.flatnonzero(word[:-1] == word[1:])
        rank[inside] = self._rank(symbol[inside], symbol[inside + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbol):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lowest = np.minimum.reduceat(rank, first)
            size = np.diff(np.r_[first, len(symbol)])
            ended = lowest == NO_RANK
            if ended.any():
                out = np.repeat(ended, size)
                done.append((word[out], symbol[out]))
                symbol, word, rank = symbol[~out], word[~out], rank[~out]
                lowest, size = lowest[~ended], size[~ended]
                if not len(symbol):
                    break
            at = np.flatnonzero(rank == np.repeat(lowest, size))
            # places of one pair that overlap: every second one of a run, from the left
            if len(at) > 1 and (at[1:] == at[:-1] + 1).any():
                opens = np.r_[True, at[1:] != at[:-1] + 1]
                run = np.maximum.accumulate(np.where(opens, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - run) % 2 == 0]
            symbol[at] = self.made[rank[at]]
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            at -= np.arange(len(at))  # places after the right halves are gone
            symbol, word, rank = symbol[keep], word[keep], rank[keep]
            near = np.r_[at, at[at > 0] - 1]
            rank[near] = NO_RANK
            near = near[near + 1 < len(word)]
            near = near[word[near] == word[near + 1]]
            rank[near] = self._rank(symbol[near], symbol[near + 1])
        word, symbol = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(word, kind="stable")
        return word[order], symbol[order]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; the strings of special tokens give their ids.

        Texts whose words follow from classes of bytes are cut as one array; others by the pattern.
        """
        if not texts:
            return []
        encoded = [x.encode() for x in texts]
        lengths = np.fromiter(map(len, encoded), np.int64, len(encoded))
        data = np.frombuffer(b"".join(encoded), np.uint8)
        text = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
        first = np.zeros(len(data), bool)
        first[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
        kind = self.kinds[data]
        # two-byte letters: the second byte is one of them behind 0xC3 only, and but for the signs of multiplication and division
        high = np.flatnonzero(data >= 128)
        letter = data[high] == 0xC3
        after = ~first[high] & (data[high - 1] == 0xC3) & (data[high] < 0xC0) & (data[high] != 0x97) & (data[high] != 0xB7)
        kind[high] = np.where(letter | after, _LETTER, _HARD)
        kind[(data == 32) & first] = _SPACE
        lines = np.flatnonzero((kind == _LINE) & ~first)
        kind[lines[np.isin(kind[lines - 1], (_LINE, _SPACE))]] = _HARD
        hard = np.bincount(text[kind == _HARD], minlength=len(texts)) > 0
        hard |= (lengths > 0) & (np.bincount(text[kind != _SPACE], minlength=len(texts)) == 0)
        opens = first.copy()
        opens[1:] |= (kind[1:] != kind[:-1]) & (kind[:-1] != _SPACE)
        plain = ~hard[text]
        word = np.cumsum(opens[plain], dtype=np.int32) - 1
        out: list[bytes] = [b""] * len(texts)
        if len(word):
            text_of = text[plain][opens[plain]]  # of each word
            merged, symbol = self._merged(data[plain], word)
            out = _cut(symbol, np.bincount(text_of[merged], minlength=len(texts)))
        rest = np.flatnonzero(hard).tolist()
        for i, ids in zip(rest, self._by_pattern([texts[i] for i in rest])):
            out[i] = ids
        return out

    def _by_pattern(self, texts: list[str]) -> list[bytes]:
        words = [[x] if x.isalpha() or x[:1] == " " and x[1:].isalpha() else self._words(x) for x in texts]
        fresh = list(set().union(*words).difference(self.special))
        ids = dict(zip(fresh, self.merge([w.encode() for w in fresh])))
        ids |= {token: np.array([i], "<u4").tobytes() for token, i in self.special.items()}
        return [ids[x[0]] if len(x) == 1 else b"".join([ids[w] for w in x]) for x in words]

    def _words(self, text: str) -> list[str]:
        parts = self.cut.split(text) if self.cut else [text]
        return [w for p in parts for w in ([p] if p in self.special else self.pattern.findall(p))]

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(2)
def vocabulary(path: str) -> Bpe:
    return Bpe(path)


def encode(docs: DataFrame, path: str | None = None, with_ids: bool = True) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_tokens, ids_sha256, decoded_sha256 and with_ids the ids.

    Null is an empty text without ids. Ids are little-endian unsigned 32-bit integers in one binary value. Rows may
    repeat, doc_id may be null; other columns are ignored. ``path`` is a tokenizer file with byte-level merges.
    """
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        cache = chunks.Cache(bpe.encode)
        for batch in batches:
            for start, texts in chunks.parts(batch):
                ids = [b"".join(x) for x in cache.of(texts)]
                columns = {
                    "doc_id": batch.column("doc_id").slice(start, len(texts)),
                    "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    "decoded_sha256": pa.array(
                        [hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in ids], pa.string()
                    ),
                }
                if with_ids:
                    columns["ids"] = pa.array(ids, pa.binary())
                yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, schema)


@query("op7_bpe")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return encode(table(spark, folder, "documents"), with_ids=False)
