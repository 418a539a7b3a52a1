import itertools
import time

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from filespoor.llm import simhash, toxicity, url_filter


def decoder():
    rng = np.random.default_rng(3)
    text = " the stupid cat is at the hall and the idiot is still here " * 3
    s = toxicity.symbols(text).astype(int)
    grams = (s[:-2] * toxicity.SIZE + s[1:-1]) * toxicity.SIZE + s[2:]
    counts = [(int(g), int(n)) for g, n in zip(*np.unique(grams, return_counts=True))]
    counts += [(int(g), 1) for g in rng.integers(0, toxicity.SIZE**3, 200)]
    return toxicity.Decoder(toxicity.model(counts))


def cost(model, readings):
    x = y = 0
    total = 0.0
    for reading, price in [*readings, (" ", 0.0)]:
        total += price
        for c in reading:
            z = int(toxicity.SYMBOL[min(ord(c), len(toxicity.SYMBOL) - 1)])
            total += model.logs[x][y][z]
            x, y = y, z
    return total


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from("st1upd4 0@*.aaa"), min_size=1, max_size=9))
def test_decoder_equals_enumeration(stretch):
    model = test_decoder_equals_enumeration.model
    ways = list(itertools.product(*model.lattice(stretch)))
    best = max(cost(model, way) for way in ways)
    spelt = "".join(r for r, _ in max(ways, key=lambda way: cost(model, way)))
    found = model.read(stretch)
    of_found = max(cost(model, way) for way in ways if "".join(r for r, _ in way) == found)
    assert of_found == pytest.approx(best) and (found == spelt or of_found == pytest.approx(best))


test_decoder_equals_enumeration.model = decoder()


def test_decoder_is_linear_in_long_stretches():
    model = decoder()
    seconds = []
    for n in (50_000, 200_000):
        start = time.process_time()
        read = model.read("s t 1 " * (n // 6))
        seconds.append(time.process_time() - start)
        assert 0 < len(read) <= n
    assert seconds[1] < 12 * seconds[0]
    assert not any(len(x) > toxicity.LONG for x in model.known)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=2, max_size=20), st.lists(st.integers(0, 63), max_size=6))
def test_manhattan_distance_is_a_lower_bound(numbers, flips):
    numbers.append(numbers[0])
    for bit in set(flips):
        numbers[-1] ^= 1 << bit
    fp = np.array(numbers, np.uint64)
    counts = simhash.popcounts(fp)
    for a, b in itertools.combinations(range(len(fp)), 2):
        segments = [[(int(fp[i]) >> s & 3).bit_count() for s in range(0, 64, 2)] for i in (a, b)]
        want = sum(abs(x - y) for x, y in zip(*segments))
        got = int(simhash.manhattan(counts[a:a + 1], counts[b:b + 1])[0])
        assert got == want <= (int(fp[a]) ^ int(fp[b])).bit_count()


def test_filter_follows_its_list(spark):
    assert [url_filter.blocks_for(n) for n in (0, 4096, 4097, 2**22, 2**22 + 1)] == [1024, 1024, 2048, 2**20, 2**21]
    pages = spark.range(20000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://a.example.org/p"), "id").alias("url"))
    pages = pages.unionByName(spark.createDataFrame([(-1, "http://x.org/" + "p" * 300_000), (-2, None)], "page_id long, url string"))
    listed = pages.filter("page_id % 3 = 0").select(F.concat(F.lit("a.example.org/p"), "page_id").alias("canon"))
    want = {r.page_id for r in pages.filter("page_id % 3 = 0").collect()}
    for most in (2**20, 1):
        found = url_filter.url_filter(pages, listed, most_broadcast=most)
        assert found.count() == 20002
        assert {r.page_id for r in found.filter("verdict = 'block'").collect()} == want
    # few pages that are not listed pass a filter of this size
    rows = url_filter._marks(pages.select(F.concat(F.lit("a.example.org/p"), "page_id").alias("canon"), "page_id"), 2048)
    passed = rows.join(url_filter.bloom(listed, 2048), "block").filter("(bits & mask) = mask and page_id % 3 <> 0")
    assert passed.count() < 700


def test_list_is_made_by_label(spark):
    urls = ["http://ads-track.a.org/x", "http://www.free-bets.co.uk/y/", "http://ads-tracker.org/x", "http://org/ads-track.com", None]
    found = url_filter.listed_of(spark.createDataFrame([(u,) for u in urls], "url string"))
    assert {r.canon for r in found.collect()} == {"ads-track.a.org/x", "free-bets.co.uk/y"}
