"""The trie of conversations against brute force."""

import hashlib
import math
import re
import zlib
from collections import defaultdict

import pytest

from filespoor.llm import prefix_trie
from filespoor.llm.registry import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows, every=20, kinds=4):
    own = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            own[conv_id].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(turns)] for c, turns in own.items()}
    full = {}
    for c, turns in own.items():
        if every:
            h = zlib.crc32(str(c).encode()) % kinds
            turns = own.get(c - int(math.fmod(c, every)), [])[:h] + turns[h:]  # towards zero, as in SQL
        full[c] = turns
    members = defaultdict(list)
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(int)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, convs in members.items():
        words = len(re.findall("[^\x20\x09-\x0d]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += children[node] == 0
            saved[node[:d]] += (len(convs) - 1) * words
    out = []
    for node, convs in members.items():
        ends = ",".join(map(str, sorted(c for c in convs if len(full[c]) == len(node))))
        out.append((
            min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), children[node], leaves[node],
            saved[node], hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


ROWS = (
    [(c, t, "user" if t % 2 else "bot", f"hi {t % 3} \x85x") for c in range(45) for t in range(c % 6)]
    + [(7, t, "user", f"w{t // 2} w w") for t in range(150)]  # longer than a band
    + [(27, t, "user", f"w{t // 2} w w") for t in range(140)] + [(200 + c, 1, None, None) for c in range(30)]
    + [(None, 1, "user", "lost"), (50, None, "user", "first"), (50, None, "a", "second"), (50, 0, "user", ""), (50, 0, "user", "")]
    + [(-25, 1, "user", "below zero"), (-20, 1, "user", "base"), (-20, 2, "user", "base two"), (61, 3, "user", "no base " * 500)]
)


@pytest.fixture
def frames(spark):
    def make(rows):
        df = spark.createDataFrame(rows, SCHEMA)
        for name in ("depth", "k1", "part", "words", "h", "n_turns", "own"):
            df = df.selectExpr("*", f"'extra' {name}")
        return df

    return make


@pytest.mark.parametrize("every,band", [(20, 64), (20, 3), (0, 4)])
def test_equals_brute_force(frames, space, every, band, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 7)  # nodes whose ends come in several pieces
    found = prefix_trie.conversation_trie(frames(ROWS).repartition(5), space, every, 4, band, hot_rows=10)
    assert rows_of(found) == brute(ROWS, every)


def test_few_and_no_conversations(frames, space):
    assert rows_of(prefix_trie.conversation_trie(frames(ROWS[:0]), space, 20, 4)) == []
    rows = [(3, 1, "user", "a"), (3, 1, "user", "a")]
    assert rows_of(prefix_trie.conversation_trie(frames(rows), space, 20, 4)) == brute(rows)
    rows = [(None, 1, "user", "a")]
    assert rows_of(prefix_trie.conversation_trie(frames(rows), space, 20, 4)) == []


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert rows_of(QUERIES["op13_prefix_trie"](spark, folder)) == brute([tuple(r) for r in rows])
