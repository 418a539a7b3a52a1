"""Encoding, counting and packing against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer
from tokenizers.models import Unigram
from tokenizers.pre_tokenizers import Metaspace

from filespoor.llm import bpe, chunks, packing, token_count

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", " ", "  a", "a  b", "a   b", "x <|endoftext|> y", "<|endoftext|><|endoftext|>z", "it's we'll  'S", "a\n b \n\n c\t\td",
    "aaaaaaa aaaa", "é　ß\xa0x   ", "1234567 ½ Ⅷ ٣", "\x1c x\x1d", "▁a ▁", "😀😀 x", "a\r\n b", "<s> </s> <0x0A> <unk>",
    "ẽ a", "x" * 20000, "ab " * 20000,
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(data):
    return np.frombuffer(data, "<u4").tolist()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab \n\t'sé×Ãÿ😀1.<|Tı\xa0 "), max_size=40), min_size=1, max_size=5))
def test_random_merges_equal_library(texts):
    model, tokenizer = bpe.vocabulary(PATH), Tokenizer.from_file(PATH)
    got = [b"".join(x) for x in chunks.Cache(model.encode).of(texts)]
    for text, data in zip(texts, got):
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert ids_of(data) == want
        assert model.decode(data) == tokenizer.decode(want, skip_special_tokens=False)


def test_encode_rows(frame, library):
    rows = [(i, t, "en", "s") for i, t in enumerate([None, *ODD])] + [(1, "again", "en", "s"), (None, "x", None, None)]
    found = bpe.encode(frame(rows)).collect()
    want = []
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        data = np.array(ids, "<u4").tobytes()
        want.append((str(i), len(ids), hashlib.sha256(data).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), data))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256, bytes(r.ids)) for r in found) == sorted(want)
    assert bpe.encode(frame([])).count() == 0


def test_cache_is_emptied_when_full():
    cache = chunks.Cache(lambda texts: [x.upper() for x in texts], size=3)
    assert ["".join(x) for x in cache.of(["a b c d"])] == ["A B C D"]
    assert ["".join(x) for x in cache.of(["e f"])] == ["E F"]
    assert len(cache.later) == 1


@pytest.mark.parametrize("vocab", ["file", "small", "no bytes"])
def test_counts_equal_library(frame, vocab):
    if vocab == "file":
        pieces, fallback = token_count.pieces(public_tokenizers.path("piece_bpe_32k.model")), True
    else:  # equal sums of scores: ties
        pieces, fallback = [("<unk>", 0.0), ("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁a", -2.0), ("ba", -2.0), ("aab", -2.5)], False
        if vocab == "small":
            pieces, fallback = pieces + [(f"<0x{b:02X}>", -9.0) for b in range(256)], True
    tokenizer = Tokenizer(Unigram(pieces, 0, byte_fallback=fallback))
    tokenizer.pre_tokenizer = Metaspace("▁", "always", True)
    rnd = random.Random(2)
    texts = [x for x in ODD if vocab == "file" or len(x) < 100]
    texts += ["".join(rnd.choice("aab é\n") for _ in range(rnd.randint(1, 30))) for _ in range(300)]
    counter = token_count.Counter(pieces)
    got = [sum(counter.word(w)[0] for w in token_count.marked(x)) for x in texts]
    assert got == [len(tokenizer.encode(x, add_special_tokens=False).ids) for x in texts]


def test_count_rows(frame):
    rows = [(1, None, "en", "s"), (1, "", "en", "s"), (None, "a b", None, None), (2, "ab " * 30000, "en", "s")]
    found = sorted((str(r.doc_id), r.n_words) for r in token_count.count_tokens(frame(rows)).collect())
    assert found == [("1", 0), ("1", 0), ("2", 30001), ("None", 2)]
    assert token_count.count_tokens(frame([])).count() == 0


def best_fit(counts, size):
    bins = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fit = [i for i, room in enumerate(bins) if room >= length]
            if fit:
                bins[min(fit, key=lambda i: bins[i])] -= length
            else:
                bins.append(size - length)
    return len(bins)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 25), max_size=10))
def test_plan_is_best_fit_decreasing(counts):
    steps, filled = packing.plan(counts, 32), {}
    for length, n in counts.items():
        own = [s for s in steps if s[0] == length]
        for rank in range(n):
            _, low, first, each, at = [s for s in own if s[1] <= rank][-1]
            filled.setdefault(first + (rank - low) // each, []).append((at + (rank - low) % each * length, length))
    for places in filled.values():
        end = 0
        for at, length in sorted(places):
            assert at == end
            end += length
        assert end <= 32
    assert len(filled) == best_fit(counts, 32)


def test_pack_rows(frame, space, library):
    rnd = random.Random(4)
    texts = [None, "", "one", "one", " ".join(rnd.choice(["alpha", "be", "gamma!"]) for _ in range(900)), "x y " * 4000]
    texts += [" ".join(["word"] * rnd.randint(1, 200)) for _ in range(60)]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)] + [(2, "one", "en", "s"), (None, "two words", "en", "s")]
    found = packing.pack(frame(rows), space).collect()
    whole = sorted(library.encode(t or "", add_special_tokens=False).ids + [2] for _, t, *_ in rows)
    docs = {}
    for r in found:
        ids = ids_of(r.ids)
        assert r.length == len(ids) <= 1024 and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        docs.setdefault((r.doc_id, r.piece), []).append((r.start, ids))
    pieces = {}
    for (doc, piece), parts in docs.items():
        pieces.setdefault(doc, []).append((piece, parts))
    joined = []
    for parts in pieces.values():
        parts.sort()
        copies = len(parts[0][1])
        for k in range(copies):
            ids = []
            for _, same in parts:
                assert same[k][0] == len(ids)
                ids += same[k][1]
            joined.append(ids)
    assert sorted(joined) == whole
    filled = {}
    for r in found:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in filled.values():
        assert [a for a, _ in sorted(places)] == [sum(n for _, n in sorted(places)[:i]) for i in range(len(places))]
        assert sum(n for _, n in places) <= 1024
    assert len(filled) <= sum(map(len, whole)) / 1024 + 2
    assert packing.pack(frame([]), space).count() == 0
