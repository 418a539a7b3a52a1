"""Periodic runs against brute force."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest

from filespoor.llm import runs
from filespoor.llm.registry import QUERIES


def brute(words):
    """All maximal stretches of each period, least periods first."""
    n, seen, out = len(words), set(), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(12, 2 * q) and (i, length) not in seen:
                seen.add((i, length))
                out.append((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def samples():
    pick = random.Random(5)
    out = [[], ["a"], ["a"] * 11, ["a"] * 12, ["a"] * 1000, list("ab") * 40, list("aab") * 30 + ["x"] + list("aab") * 9]
    out += [list("aaaaab" * 30), list("ababa" * 9), (list("abc") * 5 + ["z"]) * 7, ["w%d" % i for i in range(300)] * 3]
    morse = ["a"]
    for _ in range(9):
        morse += ["b" if x == "a" else "a" for x in morse]
    word, last = ["a"], ["a", "b"]
    for _ in range(11):
        word, last = last, last + word
    out += [morse, last]
    for letters in (1, 2, 3, 5):
        for _ in range(25):
            text = [pick.choice("abcde"[:letters]) for _ in range(pick.randrange(260))]
            for _ in range(pick.randrange(3)):
                at, size = pick.randrange(len(text) + 1), pick.randrange(1, 60)
                text[at:at] = (text[at:at + size] or ["a"]) * pick.randrange(1, 6)
            out.append(text)
    return [[w.encode() for w in text] for text in out]


def test_runs_equal_brute_force():
    texts = samples()
    assert runs.runs_of(texts) == [brute(x) for x in texts]
    assert runs.runs_of([]) == []


@pytest.mark.parametrize("step", [1, 2, 7, 100])
def test_words_may_come_in_any_pieces(step):
    for text in samples()[::9]:
        catchers = runs.Catchers(len(text))
        numbers = np.array([hash(w) for w in text], np.int64).view(np.uint64)
        for at in range(0, len(numbers), step):
            catchers.append(numbers[at:at + step])
            if at % 35 == 0:  # runs so far, at any time
                assert catchers.runs().tolist() == [list(r) for r in brute(text[:at + step])]
        assert catchers.runs().tolist() == [list(r) for r in brute(text)]


def test_words_that_meet_in_a_hash_are_told_apart(monkeypatch):
    texts = [[b"%d" % (i % 7) for i in range(60)] + [b"x%d" % i for i in range(40)]]
    monkeypatch.setattr(runs, "hash", lambda word: len(word), raising=False)
    assert runs.runs_of(texts) == [brute(texts[0])]


def test_long_texts_take_time_in_proportion():
    began = time.perf_counter()
    assert runs.runs_of([[b"a"] * 300_000]) == [[(0, 300_000, 1)]]
    half = [b"%d" % i for i in range(150_000)]
    assert runs.runs_of([half * 2]) == [[(0, 300_000, 150_000)]]
    runs.runs_of([[b"a", b"a", b"a", b"a", b"b"] * 60_000])
    assert time.perf_counter() - began < 60


def test_rows(frame):
    rows = [
        (1, "a b c a b c\ta b c a b\x0bc x", "en", "s"), (2, None, "en", "s"), (3, "", None, None), (None, "x " * 20, None, None),
        (4, "\x85 \xa0 " + "é " * 13 + "y", "en", "s"), (1, "a b c a b c\ta b c a b\x0bc x", "en", "s"), (5, " \n ", "en", "s"),
    ]
    found = {(r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in runs.periodic_runs(frame(rows)).collect()}
    assert found == {
        (1, 13, ((0, 12, 3),), "a b c x"), (2, 0, (), ""), (3, 0, (), ""), (None, 20, ((0, 20, 1),), "x"),
        (4, 16, ((2, 13, 1),), "\x85 \xa0 é y"), (5, 0, (), ""),
    }
    assert runs.periodic_runs(frame(rows)).count() == 7
    assert runs.periodic_runs(frame(rows).limit(0)).count() == 0


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    texts = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op12_periodic_runs"](spark, folder).collect()}
    assert len(got) == len(texts)
    for doc_id, text in texts:
        words = re.findall("[^\x20\x09-\x0d]+", text or "")
        n = len(words)
        if n > 3000:  # brute force is quadratic
            continue
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        found = brute(words)
        lost = {i for s, length, q in found for i in range(s + q, s + length)}
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
        digest = [
            hashlib.sha256(x.encode()).hexdigest()
            for x in ("".join(f"{a},{b},{c}\n" for a, b, c in found), " ".join(w for i, w in enumerate(words) if i not in lost))
        ]
        want = (len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, *digest)
        assert got[doc_id] == want
