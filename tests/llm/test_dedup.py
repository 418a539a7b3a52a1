"""Exact, line and near duplicates against brute force, with nulls, ties, repeated rows and empty tables."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from filespoor.llm import exact_dedup, line_dedup, simhash

SPACE = re.compile(r"[\x20\x09-\x0D]+")
TEXTS = [
    None, "", " \n", "a b", "ab", " a\tb\n", "É a", "é a", "x" * 300 + "1", "x" * 300 + "2", "x" * 150 + " " + "x" * 150 + "2",
    "\xa0a b", "long " * 30000, "long" * 30000,
]


def docs_of(texts):
    return [(i, t, "en", "s") for i, t in enumerate(texts)]


@pytest.mark.parametrize("digest", [True, False])
def test_exact_dedup(frame, space, digest):
    rows = docs_of(TEXTS) + [(3, "a b", "en", "s"), (None, "ab", "en", "s"), (None, "only", None, None)]
    found = exact_dedup.exact_dedup(frame(rows), space, digest_all=digest).collect()
    assert len(found) == len(rows)
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(SPACE.sub("", t or ""), []).append((-len(t or ""), i if i is not None else 2**63, i))
    want = sorted(
        (str(i), str(min(g)[2]), len(g), min(g)[2] == i, hashlib.sha256(key.encode()).hexdigest())
        for key, g in groups.items() for _, _, i in g
    )
    got = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in found)
    assert [x[:4] for x in got] == [x[:4] for x in want]
    assert all(a[4] == b[4] or (not digest and a[4] is None and a[2] == 1) for a, b in zip(got, want))


def test_exact_dedup_empty(frame, space):
    assert exact_dedup.exact_dedup(frame([]), space, digest_all=True).count() == 0


def brute_lines(rows):
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\f\r"))

    where = {}
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                where.setdefault(key(line), set()).add(2**63 if i is None else i)
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        i_ = 2**63 if i is None else i
        kept = [x for x in lines if len(where.get(key(x), ())) < 2 or min(where[key(x)]) == i_]
        out.append((str(i), len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def test_line_dedup(frame, space):
    shared = "This is a Shared line"
    rows = docs_of([
        None, "", "\n\n", shared, f"{shared}\nown line of two\n\t{shared.upper()} \x0b\n", f"top\n{shared}", "short\nshort",
        "short", "Äpfel und Birnen", "äpfel und birnen", "ÄPFEL und Birnen\n" * 2000, f"{shared}\n{shared}",
    ]) + [(4, f"{shared}\nother text of four", "en", "s"), (None, shared, "en", "s"), (None, shared, "en", "s")]
    found = line_dedup.line_dedup(frame(rows), space).collect()
    assert sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept_text) for r in found) == brute_lines(rows)
    assert line_dedup.line_dedup(frame([]), space).count() == 0


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, most=4):
    """Label of each fingerprint: the smallest (signed) that is reachable."""
    nodes = sorted(set(prints))
    bits = np.array(nodes, np.int64).view(np.uint64)
    root = list(range(len(nodes)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(nodes)):
        for j in np.flatnonzero(np.bitwise_count(bits[i + 1:] ^ bits[i]) <= most) + i + 1:
            a, b = top(i), top(int(j))
            root[max(a, b)] = min(a, b)
    return {f: nodes[top(i)] for i, f in enumerate(nodes)}


def chains(seed, groups=12, size=25):
    rnd, out = random.Random(seed), set()
    for _ in range(groups):
        x = rnd.getrandbits(64)
        for _ in range(rnd.randint(1, size)):
            out.add(x)
            for b in rnd.sample(range(64), rnd.randint(1, 5)):
                x ^= 1 << b
    dense = rnd.getrandbits(64)
    out.update(dense ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 3))) for _ in range(150))
    return [simhash._signed(x) for x in out | {0, 1, 2**63}]


@pytest.mark.parametrize("seed, block", [(1, 2048), (2, 40)])
def test_simhash_links_join_what_brute_force_joins(spark, space, seed, block):
    prints = chains(seed)
    df = spark.createDataFrame([(x,) for x in prints], "fp long")
    edges = space.save(simhash.links(df, space, block=block), "links")
    assert all(bin((r.a ^ r.b) & (2**64 - 1)).count("1") <= 4 for r in edges.collect())
    labels = {r.node: r.label for r in simhash.components(edges, space).collect()}
    assert {x: labels.get(x, x) for x in prints} == brute_components(prints)


def test_near_duplicates(frame, space):
    rnd = random.Random(5)
    words = [rnd.choice(["Alpha", "beta", "Gamma,", "élan", "ÉLAN", "7"]) + str(rnd.randint(0, 400)) for _ in range(400)]
    near = words[:200] + ["changed"] + words[201:]
    texts = [None, "", " \t\n", "one", "ONE", "one two three", "a b c d", " ".join(words), " ".join(near), "\n".join(words), "w " * 40000]
    rows = docs_of(texts) + [(7, "one", "en", "s"), (None, "one", "en", "s")]
    found = simhash.near_duplicates(frame(rows), space).collect()
    assert len(found) == len(rows)
    prints = [simhash._signed(fingerprint(t)) for _, t, *_ in rows]
    label = brute_components(prints)
    least = {}
    for (i, *_), fp in zip(rows, prints):
        if i is not None:
            least[label[fp]] = min(i, least.get(label[fp], i))
    assert sorted((str(r.doc_id), r.fp, r.component_id) for r in found) == sorted(
        (str(i), fp, least[label[fp]]) for (i, *_), fp in zip(rows, prints)
    )
    assert simhash.near_duplicates(frame([]), space).count() == 0


def test_runs_must_exceed_bits(spark, space):
    with pytest.raises(ValueError):
        simhash.links(spark.range(1).toDF("fp"), space, most=7)
