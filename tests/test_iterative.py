"""The registered iterative queries against the brute-force model, site by site."""

from filespoor.world import site_queries
from filespoor.world.registry import QUERIES
from filespoor.world.views import World
from model import Model

FOLDER = "/root/testdata/sf0.001"


def test_inference_queries_equal_brute_force(spark):
    world = World(spark, FOLDER)
    sites, included, estimates, crawl = site_queries.content_sites(world)
    uses = [(r.version_id, r.webroot_path, r.checksum) for r in world.doc_files.collect()]
    responses = {r.url: (r.status, r.checksum) for r in crawl.collect()}
    model = Model(uses, world.doc_versions.count(), responses)
    refs, first = {}, {}
    for r in included.collect():
        refs.setdefault(r.site_id, []).append(r.url)
    for r in estimates.distinct().collect():
        first.setdefault(r.site_id, []).append(r.version_id)
    want = {r.site_id: model.infer(r.base_url, refs.get(r.site_id, []), first.get(r.site_id, [])) for r in sites.collect()}
    got = {}
    for r in QUERIES["infer_sites"](spark, FOLDER).collect():
        rounds, versions = got.setdefault(r.site_id, (r.rounds, []))
        if r.version_id is not None:
            versions.append(r.version_id)
    assert {s: (n, sorted(v)) for s, (n, v) in got.items()} == {s: (n, sorted(a or [])) for s, (a, n) in want.items()}
    rounds = {s: n for s, (_, n) in want.items() if n}
    trace = QUERIES["iteration_trace"](spark, FOLDER).collect()
    assert {(r.site_id, r.round) for r in trace} == {(s, i + 1) for s, n in rounds.items() for i in range(n)}
    streaks = {r.site_id: r for r in QUERIES["useless_streak"](spark, FOLDER).collect()}
    assert {s: r.rounds for s, r in streaks.items()} == rounds
    for r in trace:
        assert streaks[r.site_id].longest >= r.streak and (r.streak == 0) == (r.useless_reason is None)
