"""Toxicity of texts restored by a noisy-channel decoder.

A writer's word reaches us through a channel that puts digits and signs for letters, spaces letters out and repeats them.
Each suspect stretch is a lattice of what its characters may stand for; Viterbi decoding finds the likeliest reading under
a character trigram model of all documents and fixed channel costs. Characters without a second reading make a lattice of
one path, so only words with signs, runs of three equal letters or spaced letters are decoded. The restored words, and
their beginnings, are scored with what labelled rows say about them.

Scored as they stand are letters spaced by more than one space or other white space, fewer than four spaced or dotted
letters, letters that are only doubled, and words of digits or signs without a letter.

The trigram counts are summed per task, then by group; what reaches the driver is bounded by the alphabet. The labelled
sample is bounded, and so are the words that its counts single out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filespoor.llm import chunks
from filespoor.llm.common import table, text_of
from filespoor.llm.registry import query
from filespoor.session import Workspace

ALPHABET = " abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿœ"
OTHER = len(ALPHABET)  # all that is no letter
SIZE = OTHER + 1

# what a sign may stand for
LEET = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s",
    "!": "i", "|": "il", "+": "t", "€": "e", "*": "aeiou", "#": "aeiou",
}
# log probabilities of the channel
AS_IS, SIGN, JOINED, APART, ONCE, TWICE, RUN = -1.0, -2.0, -1.0, -2.0, -0.7, -0.9, -4.0

TOXIC_ROWS, CLEAN_ROWS = 6000, 12000  # labelled rows that are read at most
MIN_DOCS = 7  # toxic rows of the sample that have a telling word
MIN_CONTEXTS = 0.5  # different neighbours of a telling word, as a share of its toxic rows
MIN_PRECISION, Z = 0.5, 2.6  # lower bound of its precision, at so many standard deviations
PREFIXES = (4, 5, 6, 7, 8)
MOSTLY = 0.8
LONG = 200  # stretches up to so many characters are kept in the dictionary
BASE = 0.01  # score of a text without a telling word
THRESHOLD = 0.3

_SPACED_HINT = re.compile(r" \S \S \S(?!\S)")
_SPACED = re.compile(r"(?<!\S)\S(?: \S){3,}(?!\S)")
_SUSPECT = re.compile(r"[^\W\d_][0-9@$|+€*#]|[0-9@$|+€*#][^\W\d_]|[^\W_]![^\W_]|^![^\W_]|([^\W\d_])\1\1|(?:[^\W_][._\-*~]){3,}[^\W_]")
_WORD = re.compile(r"[^\W\d_]+")


def _symbols() -> np.ndarray:
    codes = np.full(0x250, OTHER, np.uint8)
    for i, char in enumerate(ALPHABET):
        codes[ord(char)] = i
    codes[[ord(c) for c in "\t\n\x0b\f\r"]] = 0
    return codes


SYMBOL = _symbols()


def symbols(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return SYMBOL[np.minimum(codes, len(SYMBOL) - 1)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SIZE**3, np.int64)
    for batch in batches:
        for _, texts in chunks.parts(batch):
            s = symbols(" " + "  ".join(texts).lower() + " ").astype(np.int32)
            total += np.bincount((s[:-2] * SIZE + s[1:-1]) * SIZE + s[2:], minlength=SIZE**3)
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"gram": pa.array(seen, pa.int64()), "n": pa.array(total[seen], pa.int64())})


def trigrams(docs: DataFrame) -> DataFrame:
    """gram, n over all texts: counts of symbol triples."""
    return docs.select(text_of().alias("text")).mapInArrow(_count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def model(counts: list[tuple[int, int]]) -> np.ndarray:
    """log P(third | first two), smoothed towards shorter contexts."""
    three = np.zeros(SIZE**3)
    for gram, n in counts:
        three[gram] = n
    three = three.reshape(SIZE, SIZE, SIZE)
    two, one = three.sum(axis=0), three.sum(axis=(0, 1))
    p1 = (one + 1) / (one.sum() + SIZE)
    p2 = (two + 20 * p1) / (two.sum(axis=1, keepdims=True) + 20)
    return np.log((three + 20 * p2) / (three.sum(axis=2, keepdims=True) + 20)).astype(np.float32)


Path = tuple | None


def spell(path: Path) -> str:
    """The readings of a chain of (path before, reading), first to last."""
    out = []
    while path:
        path, reading = path
        out.append(reading)
    return "".join(reversed(out))


class Decoder:
    """Reads stretches through the channel under a trigram model."""

    def __init__(self, logs: np.ndarray):
        self.logs = logs.tolist()
        self.known: dict[str, str] = {}

    @staticmethod
    def lattice(stretch: str) -> list[list[tuple[str, float]]]:
        """For each place its readings with their costs. Separators count only between single characters."""
        out: list[list[tuple[str, float]]] = []
        spaced = bool(re.search(r"(?:[^\W_][ ._\-*~]){3,}[^\W_]|\S \S \S \S", stretch))
        for m in re.finditer(r"([^\W\d_])\1\1+|.", stretch, re.S):
            c = m[0]
            if len(c) > 1:
                out.append([(c[0], ONCE), (c[:2], TWICE), (c, RUN)])
            elif spaced and c in " ._-~":
                out.append([("", JOINED), (c, APART)])
            elif c in LEET:
                out.append([(c, AS_IS), *((x, SIGN) for x in LEET[c]), *([("", JOINED)] if spaced and c == "*" else [])])
            else:
                out.append([(c, 0.0)])
        return out

    def read(self, stretch: str) -> str:
        if (found := self.known.get(stretch)) is not None:
            return found
        # a state's path is a chain of (path before, reading), so a step costs the same at any place
        states: dict[tuple[int, int], tuple[float, Path]] = {(0, 0): (0.0, None)}
        done: list[str] = []
        for place in [*self.lattice(stretch), [(" ", 0.0)]]:
            if len(states) == 1:  # what lies before a single state is certain
                state, (score, path) = states.popitem()
                done.append(spell(path))
                states = {state: (score, None)}
            after: dict[tuple[int, int], tuple[float, Path]] = {}
            for (a, b), (score, path) in states.items():
                for reading, cost in place:
                    x, y, total = a, b, score + cost
                    for c in reading:
                        z = int(SYMBOL[min(ord(c), len(SYMBOL) - 1)])
                        total += self.logs[x][y][z]
                        x, y = y, z
                    if (x, y) not in after or total > after[x, y][0]:
                        after[x, y] = (total, (path, reading))
            states = after
        done.append(spell(max(states.values(), key=lambda s: s[0])[1]))
        best = "".join(done)[:-1]
        if len(stretch) <= LONG:
            if len(self.known) > chunks.CACHE_SIZE:
                self.known.clear()
            self.known[stretch] = best
        return best

    def restore(self, text: str) -> str:
        """The lower-case text with all suspect stretches read."""
        text = text.lower()
        if _SPACED_HINT.search(" " + text):
            text = _SPACED.sub(lambda m: self.read(m[0]), text)
        return " ".join([self.read(x) if _SUSPECT.search(x) else x for x in text.split()])

    def words(self, chunk: str) -> list[str]:
        """The words of a stretch without white space."""
        return _WORD.findall(self.read(chunk) if _SUSPECT.search(chunk) else chunk)

    def split(self, text: str) -> list[str]:
        """Stretches without white space, in lower case; spaced letters are read."""
        text = text.lower()
        if _SPACED_HINT.search(" " + text):
            text = _SPACED.sub(lambda m: self.read(m[0]), text)
        return text.split()


def features(word: str) -> list[str]:
    return [word, *(f"{word[:n]}-" for n in PREFIXES if len(word) > n)]


def _learn(logs: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder, counts = Decoder(logs), (Counter(), Counter())
        for batch in batches:
            marks = batch.column("toxic").to_pylist()
            for start, texts in chunks.parts(batch):
                for toxic, text in zip(marks[start:], texts):
                    words = {w for chunk in set(decoder.split(text)) for w in decoder.words(chunk)}
                    counts[toxic].update({f for w in words for f in features(w)})
        names = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_pydict({
            "feature": pa.array(names, pa.string()), "clean": pa.array([counts[0][x] for x in names], pa.int64()),
            "toxic": pa.array([counts[1][x] for x in names], pa.int64()),
        })

    return run


def learn(docs: DataFrame, labels: DataFrame, logs: np.ndarray, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS) -> dict[str, float]:
    """P(toxic | feature) of the telling features, from at most so many rows of ``labels`` (doc_id, toxic)."""
    known = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    totals = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = totals.get(1, 0) / max(1, totals.get(0, 0) + totals.get(1, 0))
    order = F.xxhash64("doc_id")
    sample = known.filter("toxic = 1").orderBy(order, "doc_id").limit(toxic_rows).unionByName(
        known.filter("toxic = 0").orderBy(order, "doc_id").limit(clean_rows)
    )
    used = Counter({1: min(toxic_rows, totals.get(1, 0)), 0: min(clean_rows, totals.get(0, 0))})
    # at most toxic_rows + clean_rows rows of two numbers; copies of a text count once
    rows = docs.join(F.broadcast(sample), "doc_id").select("toxic", text_of().alias("text"))
    rows = rows.withColumn("copy", F.xxhash64("text")).dropDuplicates(["toxic", "copy"]).select("toxic", "text")
    counted = rows.mapInArrow(_learn(logs), "feature string, clean long, toxic long").groupBy("feature").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")
    ).filter((F.col("toxic") >= MIN_DOCS) & (F.col("toxic") > F.col("clean")))
    likely: dict[str, float] = {}
    often: dict[str, int] = {}
    for feature, clean, toxic in counted.collect():
        n, p = clean + toxic, toxic / (clean + toxic)
        wide = Z * ((p * (1 - p) + Z * Z / 4 / n) / n) ** 0.5
        if (p + Z * Z / 2 / n - wide) / (1 + Z * Z / n) >= MIN_PRECISION:
            t, c = toxic / max(1, used[1]) * share, (clean + 0.5) / max(1, used[0]) * (1 - share)
            likely[feature] = t / (t + c)
            often[feature] = toxic
    likely = _longest(likely, often)
    # other words of a text that many rows repeat stand between the same neighbours; at most ``likely`` rows
    contexts = rows.filter("toxic = 1").mapInArrow(_contexts(logs, set(likely)), "feature string, context long")
    varied = contexts.groupBy("feature").agg(F.countDistinct("context").alias("n")).collect()
    return {f: likely[f] for f, n in varied if n >= MIN_CONTEXTS * often[f]}


def _longest(likely: dict[str, float], often: dict[str, int]) -> dict[str, float]:
    """Without beginnings that say less than a longer feature which makes up nearly all of their toxic rows."""
    weaker = set()
    for feature, p in likely.items():
        stem = feature.removesuffix("-")
        for n in PREFIXES:
            short = f"{stem[:n]}-"
            if n < len(stem) and likely.get(short, p) < p and often[feature] >= MOSTLY * often[short]:
                weaker.add(short)
    return {f: p for f, p in likely.items() if f not in weaker}


def _contexts(logs: np.ndarray, likely: set[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder, known = Decoder(logs), {}
        for batch in batches:
            for _, texts in chunks.parts(batch):
                found = set()
                for text in texts:
                    parts = ["", *decoder.split(text), ""]
                    for before, part, after in zip(parts, parts[1:], parts[2:]):
                        if part not in known:
                            known[part] = [f for w in decoder.words(part) for f in features(w) if f in likely]
                        found.update((f, xxhash.xxh64_intdigest(f"{before} {after}") - 2**63) for f in known[part])
                names, numbers = zip(*found) if found else ((), ())
                yield pa.RecordBatch.from_pydict({"feature": pa.array(names, pa.string()), "context": pa.array(numbers, pa.int64())})

    return run


def score(docs: DataFrame, logs: np.ndarray, telling: dict[str, float]) -> DataFrame:
    """doc_id and score of each row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder, known = Decoder(logs), {}

        def weigh(chunk: str) -> tuple[tuple[str, float], ...]:
            found = []
            for word in decoder.words(chunk):
                best = max(((telling[f], f) for f in features(word) if f in telling), default=None)
                if best:
                    found.append((word, log(1 - min(best[0], 0.999))))
            return tuple(found)

        for batch in batches:
            for start, texts in chunks.parts(batch):
                if len(known) > chunks.CACHE_SIZE:
                    known.clear()
                scores = []
                for text in texts:
                    parts = set(decoder.split(text))
                    for x in parts.difference(known):
                        known[x] = weigh(x)
                    hits = dict(hit for x in parts for hit in known[x])
                    scores.append(1 - (1 - BASE) * float(np.exp(sum(hits.values()))))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id").slice(start, len(texts)), "score": pa.array(scores, pa.float64())
                })

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")


def language_model(docs: DataFrame, space: Workspace) -> np.ndarray:
    """The character model of all texts; its counts have at most SIZE ** 3 rows."""
    return model([tuple(r) for r in space.save(trigrams(docs), "trigrams").collect()])


def toxicity(docs: DataFrame, labels: DataFrame, space: Workspace) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, score, predicted.

    ``labels`` (doc_id, toxic) are the rows to learn from; ids with several labels are toxic if one says so. Null and
    empty texts get the base score, and so do all texts without a usable label. Rows may repeat, doc_id may be null, an
    empty table gives no rows; other columns are ignored.
    """
    logs = language_model(docs, space)
    telling = learn(docs, labels, logs)
    return score(docs, logs, telling).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def restore(docs: DataFrame, space: Workspace) -> DataFrame:
    """doc_id and restored text (lower case, single spaces) of each row of ``docs``; null gives an empty text."""
    logs = language_model(docs, space)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(logs)
        for batch in batches:
            for start, texts in chunks.parts(batch):
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id").slice(start, len(texts)), "restored": pa.array(map(decoder.restore, texts), pa.string())
                })

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, "doc_id long, restored string")


HELD_OUT = "crc32(cast(doc_id as string)) % 4 = 2"


@query("op3_toxicity")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "labels").filter(f"not ({HELD_OUT})")
    found = toxicity(table(spark, folder, "documents"), labels, Workspace(spark, "toxicity"))
    return found.select("doc_id", F.expr(f"coalesce({HELD_OUT}, false)").alias("held_out"), "score", "predicted")
