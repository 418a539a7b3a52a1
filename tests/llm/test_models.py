"""Quality rules, language and toxicity: brute force, held-out accuracy and odd input."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from filespoor.llm import language, quality, toxicity

FOLDER = "/root/testdata/sf0.01"


def test_repeated_words():
    rnd = random.Random(1)
    for _ in range(300):
        words = [rnd.choice([b"a", b"b", b"c"]) for _ in range(rnd.randint(0, 25))]
        often = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
        inside = {i + d for i in range(len(words) - 2) if often[tuple(words[i:i + 3])] > 1 for d in range(3)}
        assert quality.repeated(words) == len(inside)


def test_quality_rules(frame, space):
    own = [" ".join(f"word{i}x{j}" for j in range(60)) for i in range(40)]
    menu = "Home  About\tContact"
    rows = [(i, f"{t}\n{menu}", "en", "h1") for i, t in enumerate(own[:30])]
    thin = "\n".join([menu.upper()] * 30 + ["own word here"])
    rows += [(50, thin, "en", "h1"), (51, f"{own[35]}\n{menu}", "en", "h2"), (52, None, "en", "h1"), (53, "", None, None), (54, own[36], None, None)]
    rows += [(100 + i, own[39], "en", "h3") for i in range(60)] + [(None, own[38], "en", "h1"), (54, own[36], None, None)]
    rows += [(200, "long " * 50000, "en", "h3"), (201, "a b c " * 20, "en", "h3")]
    judged = quality.judge(frame(rows), space, max_repeat=100)
    found = {r.doc_id: r for r in judged.collect()}
    assert judged.count() == len(rows)
    assert found[0].cut_words == 0 and found[0].kept  # the first document keeps the line
    assert found[1].cut_words == 3 and found[1].kept
    assert found[50].cut_words == 90 and not found[50].kept and not found[50].base_failed
    assert found[51].cut_words == 0 and found[51].kept  # another host
    assert found[52].n_words == 0 and found[52].base_failed and found[53].base_failed
    assert found[54].kept and found[None].kept
    assert all(found[100 + i].kept and found[100 + i].cut_words == 0 for i in range(60))  # copies are one document
    assert found[200].n_words == 50000 and found[200].n_repeat_words == 50000
    strict = {r.doc_id: r for r in quality.judge(frame(rows), space).collect()}
    assert strict[200].base_failed and strict[201].base_failed
    docs = frame(rows)
    cleaned = quality.clean(docs, judged)
    assert cleaned.columns == docs.columns
    texts = {r.doc_id: r.text for r in cleaned.collect()}
    assert texts[0].endswith(menu) and texts[1] == own[1] and 50 not in texts and 52 not in texts
    assert quality.judge(frame([]), space).count() == 0


def test_lines_of_a_large_host(spark, frame, space, monkeypatch):
    own = [" ".join(f"word{i}x{j}" for j in range(60)) for i in range(1600)]
    shared = "an offer that thirty texts of the host share"
    # 30 of 1,600 documents are under 2 %
    docs = frame([(i, f"{t}\n{shared}" if i < 30 else t, "en", "hot") for i, t in enumerate(own)])
    assert quality.judge(docs, space).filter("cut_words > 0").count() == 0
    assert quality.judge(docs, space, line_most=30).filter("cut_words > 0").count() == 0
    assert {r.doc_id for r in quality.judge(docs, space, line_most=29).filter("cut_words = 9").collect()} == set(range(1, 30))
    monkeypatch.setattr(quality, "LINE_MOST", 29)
    kept = {r.doc_id: r.text for r in dict(corpus_pipeline.STAGES)["quality_rules"](spark, docs, FOLDER).collect()}
    assert len(kept) == len(own) and [i for i, t in kept.items() if shared in t] == [0]


def test_language_accuracy(spark, space):
    docs, pages = (spark.read.parquet(f"{FOLDER}/{n}.parquet") for n in ("documents", "pages"))
    # the labels of half of the rows are hidden from the model
    hidden = docs.selectExpr("doc_id", "text", "source", "if(doc_id % 2 = 0, lang, null) lang", "lang truth")
    found = language.identify(hidden, pages, space).join(docs.selectExpr("doc_id", "lang truth"), "doc_id").filter("doc_id % 2 = 1")
    right, kept, n = found.selectExpr("avg(int(language = truth))", "avg(int(kept))", "count(*)").first()
    assert n > 400 and right > 0.97 and kept > 0.98


def test_language_odd_input(spark, frame, space):
    pages = spark.createDataFrame(
        [("http://x.example.com/fr/7", '<html lang="FR-fr">'), (None, None), ("nothing", ""), ("http://x.example.com/fr/7", "<p>")], "url string, html string"
    )
    rows = [(i, "the house and the garden are with the people of this town", "en", "h") for i in range(20)]
    rows += [(40 + i, "la maison et les jardins sont avec les gens de cette ville", "fr", None) for i in range(20)]
    rows += [(7, None, None, None), (8, "", "en", "h"), (9, "123 !!", "en", "h"), (None, "the people of the town", None, "h"), (99, "the town " * 40000, None, "h")]
    found = language.identify(frame(rows), pages, space).collect()
    assert len(found) == len(rows)
    by = {(r.doc_id, r.language) for r in found if r.kept}
    assert (99, "en") in by and (None, "en") in by and (45, "fr") in by
    assert all(not r.kept and r.language is None for r in found if r.doc_id in (8, 9) and r.n_letters == 0)
    assert language.identify(frame([]), pages, space).count() == 0
    assert language.identify(frame([(1, "text", None, None)]), pages.limit(0), space).first().kept is False


def test_language_many(spark, frame, space):
    rnd = random.Random(3)
    names = [f"l{i:02}" for i in range(24)]
    words = {x: ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(30)] for x in names}
    # 20 languages are rare and stand with one another on hosts, four have nearly all rows
    langs = [x for i, x in enumerate(names) for _ in range(300 if i < 4 else 6)]
    rows = [(i, " ".join(rnd.choices(words[x], k=40)), x, f"h{i % 5}") for i, x in enumerate(langs)]
    pages = spark.createDataFrame([], "url string, html string")
    found = language.identify(frame(rows), pages, space, rows=48).collect()
    assert len(found) == len(rows)
    assert all(r.kept and r.language == r.text_language == langs[r.doc_id] for r in found)


def test_language_sample(spark):
    known = spark.createDataFrame([(i, "en") for i in range(3000)] * 2 + [(i, "fr") for i in range(7)], "doc_id long, lang string")
    sizes = Counter(r.lang for r in language.choose(known, 1000).collect())
    assert sizes == {"en": 500, "fr": 7}
    assert language.choose(known.limit(0)).count() == 0


@pytest.fixture(scope="module")
def decoder(spark):
    from filespoor.session import Workspace

    words = "you are such an idiot and a moron stupid loser scum trash clown pathetic house garden people town worthless disgusting"
    docs = spark.createDataFrame([(1, " ".join([words] * 20)), (2, None)], "doc_id long, text string")
    return toxicity.Decoder(toxicity.language_model(docs, Workspace(spark, "llm-test")))


@pytest.mark.parametrize("written, meant", [
    ("1d10t", "idiot"), ("m0r0n", "moron"), ("$tup1d", "stupid"), ("s t u p i d", "stupid"), ("l.o.s.e.r", "loser"), ("stuuuupid", "stupid"),
    ("tr@sh", "trash"), ("p4thetic", "pathetic"), ("i d 1 0 t", "idiot"), ("Cl0wwwn", "clown"), ("house", "house"), ("a b", "a b"), ("1234", "1234"),
])
def test_decoder(decoder, written, meant):
    assert decoder.restore(f"the {written} people") == f"the {meant} people"


def test_beginnings_give_way_to_longer_features():
    likely = {"lose-": 0.87, "loser": 0.99, "stem-": 0.97, "stemma": 0.98, "stemmb": 0.98, "kin-": 0.9}
    often = {"lose-": 50, "loser": 48, "stem-": 40, "stemma": 10, "stemmb": 9, "kin-": 9}
    assert set(toxicity._longest(likely, often)) == set(likely) - {"lose-"}


def test_toxicity_held_out(spark, space):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    found = toxicity.toxicity(docs, labels.filter(f"not ({toxicity.HELD_OUT})"), space).join(labels, "doc_id").filter(toxicity.HELD_OUT)
    hit, false, missed = found.selectExpr(
        "sum(int(predicted = 1 and toxic = 1))", "sum(int(predicted = 1 and toxic = 0))", "sum(int(predicted = 0 and toxic = 1))"
    ).first()
    assert hit / (hit + missed) > 0.8 and hit / (hit + false) > 0.8


def test_toxicity_odd_input(spark, frame, space):
    rows = [(i, f"text {'abcdefghij'[i]} stupid {'abcdefghij'[i]} number", "en", "s") for i in range(10)] + [(20 + i, f"kind text number {'abcdefghij'[i]}", "en", "s") for i in range(10)]
    rows += [(90, None, None, None), (91, "", None, None), (92, "word " * 50000 + "$tup1d", None, None), (None, "s t u p i d", None, None), (90, "kind", None, None)]
    labels = spark.createDataFrame([(i, 1) for i in range(10)] + [(20 + i, 0) for i in range(10)] + [(0, 0), (None, 1), (21, None)], "doc_id long, toxic int")
    found = toxicity.toxicity(frame(rows), labels, space).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    marks = {(r.doc_id, r.predicted) for r in found}
    assert {(92, 1), (None, 1), (3, 1), (91, 0), (90, 0), (25, 0)} <= marks and (90, 1) not in marks
    assert toxicity.toxicity(frame([]), labels, space).count() == 0
    assert {r.predicted for r in toxicity.toxicity(frame(rows), labels.limit(0), space).collect()} == {0}
    restored = {r.doc_id: r.restored for r in toxicity.restore(frame(rows), space).collect()}
    assert restored[91] == ""


def test_pipeline(spark):
    steps = corpus_pipeline.STAGES
    assert [name for name, _ in steps] == ["language", "quality_rules", "exact_dedup", "simhash", "packing"]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert rows.count() > 0
    assert rows.join(docs, "doc_id", "left_anti").count() == 0


def test_pipeline_stages(spark, frame):
    text = " ".join(f"word{j} of{j} the house" for j in range(60))
    other = " ".join(f"thing{j} in{j} the garden" for j in range(60))
    rows = [(1, text, "en", "h"), (2, text + "  ", "en", "h"), (2, text + "  ", "en", "h"), (3, other, "en", "h"), (4, other + " end", "en", "h"), (5, None, None, None), (None, other[5:2000], "en", None)]
    docs, folder = frame(rows), "/root/testdata/sf0.001"
    kept = dict((name, stage(spark, docs, folder)) for name, stage in corpus_pipeline.STAGES)
    assert all(kept[name].columns == docs.columns for name in ("language", "quality_rules", "exact_dedup", "simhash"))
    assert sorted(str(r.doc_id) for r in kept["language"].collect()) == ["1", "2", "2", "3", "4", "None"]
    assert sorted(str(r.doc_id) for r in kept["quality_rules"].collect()) == ["1", "2", "2", "3", "4", "None"]
    assert sorted(str(r.doc_id) for r in kept["exact_dedup"].collect()) == ["2", "3", "4", "5", "None"]
    assert "1" in {str(r.doc_id) for r in kept["simhash"].collect()}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0


def test_pipeline_keeps_one_row_of_each_text_whatever_the_ids(spark, frame):
    """Ids that stand on several texts, repeated rows and rows alike but for their source."""
    words = [" ".join(f"{kind}{i}x{i * i % 7} the" for i in range(80)) for kind in ("alpha", "beta", "gamma", "delta")]
    near = words[0] + " end"
    rows = [
        (1, words[0], "en", "h"), (2, words[0], "en", "h"), (2, words[1], "en", "h"), (2, words[1], "en", "h"),
        (2, words[1], "en", "g"), (2, words[1].replace(" ", "  "), "en", "h"), (3, words[2], None, None), (None, words[3], "en", "h"),
        (None, words[3], "en", "h"), (1, near, "en", "h"), (4, None, "en", "h"), (4, "", "en", "h"), (5, None, None, None),
    ]
    stages, folder = dict(corpus_pipeline.STAGES), "/root/testdata/sf0.001"

    def bare(text):
        return "".join((text or "").split())

    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(bare(t), []).append((-len(t or ""), i is None, i or 0))
    want = sorted((str(None if min(g)[1] else min(g)[2]), key) for key, g in groups.items())
    unique = stages["exact_dedup"](spark, frame(rows), folder)
    assert sorted((str(r.doc_id), bare(r.text)) for r in unique.collect()) == want
    # near copies: fingerprints of one component, brute force over all pairs
    from test_dedup import brute_components, fingerprint
    from filespoor.llm import simhash

    prints = [simhash._signed(fingerprint(t)) for _, t, *_ in rows]
    label = brute_components(prints)
    assert label[prints[0]] == label[prints[9]]
    least = {}
    for (i, *_), fp in zip(rows, prints):
        least[label[fp]] = min(least.get(label[fp], (True, 0)), (i is None, i or 0))
    near_unique = stages["simhash"](spark, frame(rows), folder).collect()
    got = sorted((label[simhash._signed(fingerprint(r.text))], r.doc_id is None, r.doc_id or 0) for r in near_unique)
    assert got == sorted((k, *v) for k, v in least.items())
    # a rejected text of an id goes, its other text stays
    mixed = [(7, "123 456", "en", "h"), (7, "the house and the garden are with the people of this town", "en", "h")]
    mixed += [(10 + i, "the garden and the house of the people", "en", "h") for i in range(25)]
    left = stages["language"](spark, frame(mixed), folder).collect()
    assert [r.text for r in left if r.doc_id == 7] == [mixed[1][1]]
