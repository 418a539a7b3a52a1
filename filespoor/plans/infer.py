"""Iterative inference of software versions, for all sites at once.

State lives in written tables, one folder per round. Sums by set of versions add up over assets, so
each round matches only the assets it requested. Only the number of undecided sites reaches
the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from filespoor.functions import urls
from filespoor.operators import entropy, matching, scoring, version_sets
from filespoor.operators.skew import expanding_join, salted_join
from filespoor.params import InferenceParams
from filespoor.session import Workspace
from filespoor.sources.crawl import with_success
from filespoor.sources.index_store import MatchTables

GUESS_COLUMNS = ["site_id", "version_id", "rank", *scoring.SCORE_COLUMNS, "strength_nano"]


@dataclass(frozen=True)
class Inference:
    """What is known of every site, and the record of how it came about.

    ``sites``: outcome per site with its finish reason. ``guesses``: answer. ``trace``: one
    row per round and site. ``probes``: one row per requested path of a round. ``listed``:
    the guesses after each round, round 0 being the first ones.
    """

    sites: DataFrame
    guesses: DataFrame
    assets: DataFrame
    trace: DataFrame
    probes: DataFrame
    listed: DataFrame


ASSET_COLUMNS = ["site_id", "url", "webroot_path", "success", "checksum", "found", "weight_micro"]


def known_responses(crawl: DataFrame, idf: DataFrame) -> DataFrame:
    """Successful responses ``(url, checksum, found, weight_micro)``, matched once per crawl."""
    served = with_success(crawl).filter("success").select("url", "success", "checksum")
    return matching.weigh_assets(served, idf)


def request(
    wanted: DataFrame, responses: DataFrame, params: InferenceParams, strict_paths: bool = False
) -> DataFrame:
    """Look up ``wanted(site_id, url, ...)`` in ``known_responses``."""
    # many sites may refer to one URL of a shared host
    answers = salted_join(wanted, responses, ["url"], "left")
    return answers.select(
        *wanted.columns,
        urls.webroot_path(F.col("url"), strict_paths).alias("webroot_path"),
        F.coalesce("success", F.lit(False)).alias("success"),
        "checksum",
        F.coalesce("found", F.lit(False)).alias("found"),
        F.coalesce("weight_micro", F.lit(params.failed_micro)).alias("weight_micro"),
    )


# addresses of one round that are sent to all tasks, as 64-bit hashes
ASKED = 8_000_000


def asked_responses(wanted: DataFrame, served: DataFrame, idf: DataFrame, asked: int = ASKED) -> DataFrame:
    """``known_responses`` of the URLs of ``wanted`` only: the responses of a crawl are read, but only those asked for are moved."""
    hashed = wanted.select(F.xxhash64("url").alias("_asked")).distinct()
    if wanted.count() <= asked:
        hashed = F.broadcast(hashed)
    few = served.join(hashed, F.xxhash64(served["url"]) == F.col("_asked"), "left_semi")
    return matching.weigh_assets(few, idf)


def relocate(sites: DataFrame, votes: DataFrame) -> DataFrame:
    """Move the base URL of sites whose assets sit in another folder than expected."""
    base_path = F.col("base_path")
    host = F.concat(urls.scheme(F.col("base_url")), F.lit("://"), urls.authority(F.col("base_url")), F.lit("/"))
    start = F.when(F.startswith(base_path, F.lit("/")), host).otherwise(F.col("base_url"))
    moved = F.when(base_path.isNull(), F.col("base_url")).otherwise(urls.join_url(start, base_path))
    return (
        sites.join(matching.updated_base_path(votes), "site_id", "left")
        .withColumn("base_url", moved)
        .drop("base_path")
    )


def _version_lists(guesses: DataFrame) -> DataFrame:
    """``(site_id, versions, set_id)``: the guessed versions of each site, and what names the list."""
    return guesses.groupBy("site_id").agg(F.sort_array(F.collect_set("version_id")).alias("versions")).withColumn(
        "set_id", F.sha1(F.to_json("versions"))
    )


def candidate_paths(
    guesses: DataFrame, assets: DataFrame, tables: MatchTables, limit: int | None, files: DataFrame | None = None
) -> DataFrame:
    """``(site_id, webroot_path, version_count, checksum_count, rank)``, at most ``limit`` per site.

    Sites with the same set of guessed versions share one ranking of paths. A site has
    excluded at most as many paths as it has assets, so the first ``limit`` + assets
    ranks of its set hold its first ``limit`` paths. ``files`` are the ``version_paths`` of the tables.
    """
    if not limit:
        return all_candidate_paths(guesses.select("site_id").distinct(), guesses, assets, tables)
    if files is None:
        files = entropy.version_paths(tables.path_checksums)
    seen = assets.select("site_id", "webroot_path").distinct()
    depth = seen.groupBy("site_id").agg(F.count(F.lit(1)).alias("_seen"))
    deepest = _version_lists(guesses).join(depth, "site_id", "left").withColumn("depth", F.coalesce("_seen", F.lit(0)) + limit)
    sets = deepest.groupBy("set_id").agg(F.first("versions").alias("versions"), F.max("depth").alias("depth"))
    ranked = entropy.rank_paths(entropy.strongest_paths(sets, files))
    options = deepest.select("site_id", "set_id", "depth").join(ranked, "set_id").filter(F.col("rank") <= F.col("depth"))
    unseen = options.drop("rank", "depth").join(seen, ["site_id", "webroot_path"], "left_anti")
    return entropy.top_paths(unseen.drop("set_id").withColumnRenamed("site_id", "set_id"), limit).withColumnRenamed(
        "set_id", "site_id"
    )


def all_candidate_paths(
    sites: DataFrame,
    guesses: DataFrame,
    assets: DataFrame,
    tables: MatchTables,
    save: Callable[[DataFrame, str], DataFrame] = lambda df, name: df,
    listed: int = entropy.LISTED,
) -> DataFrame:
    """``sites(site_id, ...)`` with ``webroot_path, version_count, checksum_count, rank``: all telling paths that a site has not seen.

    Sites with the same versions share one ranking. A site's own rank of a path is that less the ranks before it that it has seen, so
    the very many rows are made where they are given out; only sites that have seen more than ``listed`` paths are ranked by themselves.
    """
    sets = save(_version_lists(guesses), "version-lists")
    members = sets.select("set_id", F.explode("versions").alias("version_id")).distinct()
    ranked = save(entropy.rank_paths(entropy.path_entropy(members, tables.path_checksums)), "ranked")
    of_set = sets.select("site_id", "set_id")
    seen = assets.select("site_id", "webroot_path").distinct()
    known = save(seen.join(of_set, "site_id").join(ranked.select("set_id", "webroot_path", "rank"), ["set_id", "webroot_path"])
                 .groupBy("site_id").agg(F.count(F.lit(1)).alias("_n"), F.collect_list("rank").alias("_ranks")), "seen-ranks")
    short = known.select("site_id", (F.col("_n") > listed).alias("_many"), F.when(F.col("_n") <= listed, F.col("_ranks")).alias("_ranks"))
    wanted = sites.join(of_set, "site_id").join(short, "site_id", "left")
    options = expanding_join(wanted, ranked, ["set_id"])
    columns = [*sites.columns, "webroot_path", "version_count", "checksum_count", "rank"]
    none = F.array().cast("array<int>")
    ranks = F.coalesce("_ranks", none)
    few = options.filter(~F.coalesce("_many", F.lit(False)) & ~F.array_contains(ranks, F.col("rank"))).withColumn(
        "rank", F.col("rank") - F.size(F.filter(ranks, lambda r: r < F.col("rank")))
    )
    many = known.filter(F.col("_n") > listed).select("site_id")
    own = of_set.join(many, "site_id", "left_semi").join(ranked.drop("rank"), "set_id").drop("set_id")
    left = own.join(seen.join(many, "site_id", "left_semi"), ["site_id", "webroot_path"], "left_anti")
    alone = entropy.rank_paths(left.withColumnRenamed("site_id", "set_id")).withColumnRenamed("set_id", "site_id")
    return few.select(*columns).unionByName(sites.join(alone, "site_id").select(*columns))


def infer_sites(
    sites: DataFrame,
    included: DataFrame,
    estimates: DataFrame,
    crawl: DataFrame,
    tables: MatchTables,
    files: DataFrame,
    workspace: Workspace,
    params: InferenceParams = InferenceParams(),
    strict_paths: bool = False,
) -> Inference:
    """Infer the versions that sites run.

    ``sites(site_id, base_url)`` have a fetched main page. ``included(site_id, url)`` are
    the files their pages refer to, ``estimates(site_id, version_id)`` first estimates.
    """
    save = workspace.save
    served = with_success(crawl).filter("success").select("url", "success", "checksum")

    def answers(wanted: DataFrame) -> DataFrame:
        return request(wanted, asked_responses(wanted, served, tables.idf), params, strict_paths)

    wanted = save(included.select("site_id", "url").distinct(), "included")
    main_assets = save(answers(wanted).select(*ASSET_COLUMNS), "main-assets")
    located = save(relocate(sites.select("site_id", "base_url"), matching.base_path_votes(main_assets, files)), "sites")
    favicon = located.select("site_id", urls.join_url(F.col("base_url"), F.lit("favicon.ico")).alias("url"))
    icons = save(matching.new_assets(favicon, main_assets), "favicons")
    assets = save(main_assets.unionByName(answers(icons).select(*ASSET_COLUMNS)), "assets-0")

    def rank(sums: DataFrame, others: DataFrame) -> DataFrame:
        strongest = scoring.strongest(sums, tables.packed, others, params)
        return scoring.best_guesses(strongest, params).select(*GUESS_COLUMNS)

    # what a site has matched is kept as sums by set of versions
    sums, others = version_sets.set_sums(assets, tables.packed, save=save)
    sums, others = save(sums, "sums-0"), save(others, "others-0")
    zero = [F.lit(0).cast("bigint").alias(c) for c in (*scoring.SCORE_COLUMNS, "strength_nano")]
    # first estimates come first in the list, without strength; the order among them is open
    first = estimates.distinct().select("site_id", "version_id", F.lit(0).alias("rank"), *zero)
    guesses = save(first.unionByName(rank(sums, others)), "guesses-0")
    state = save(
        located.join(scoring.decisiveness(guesses), "site_id", "left")
        .join(assets.groupBy("site_id").agg(F.count(F.lit(1)).alias("assets_so_far")), "site_id", "left").select(
            "site_id",
            "base_url",
            F.coalesce("assets_so_far", F.lit(0)).alias("assets_so_far"),
            F.lit(0).alias("streak"),
            F.coalesce("decisiveness", F.lit(0.0)).alias("decisiveness"),
        ),
        "state-0",
    )
    # a site without any guess has no result
    active = state.join(guesses.select("site_id").distinct(), "site_id", "left_semi")
    done_guesses: list[DataFrame] = []
    done_states: list[DataFrame] = [
        _outcome(state.join(guesses.select("site_id").distinct(), "site_id", "left_anti"), 0)
    ]
    traces: list[DataFrame] = []
    rounds: list[DataFrame] = []
    listed: list[DataFrame] = [guesses.select(*GUESS_COLUMNS).withColumn("round", F.lit(0))]
    all_assets: list[DataFrame] = [assets]

    files_of = entropy.version_paths(tables.path_checksums, save)
    for number in range(1, params.max_iterations + 1):
        paths = candidate_paths(guesses, assets, tables, params.max_assets_per_iteration, files_of)
        wanted = active.select("site_id", "base_url").join(paths, "site_id").withColumn(
            "url", urls.join_url(F.col("base_url"), F.col("webroot_path"))
        ).drop("base_url", "webroot_path")
        fresh = save(
            matching.new_assets(wanted, assets).groupBy("site_id", "url").agg(F.min("rank").alias("rank")),
            f"wanted-{number}",
        )
        probes = save(
            scoring.probe_prefix(answers(fresh), params.min_assets_per_iteration),
            f"probes-{number}",
        )
        rounds.append(probes.select(*ASSET_COLUMNS, "rank").withColumn("round", F.lit(number)))
        requested = probes.select(*ASSET_COLUMNS)
        all_assets.append(requested)
        new_sums, new_others = version_sets.set_sums(requested, tables.packed, save=save)
        sums = save(version_sets.add_sums(sums, new_sums), f"sums-{number}")
        others = save(version_sets.add_sets(others, new_others), f"others-{number}")
        new_guesses = save(rank(sums, others), f"guesses-{number}")
        listed.append(new_guesses.withColumn("round", F.lit(number)))
        probed = probes.groupBy("site_id").agg(
            F.bool_or("success").alias("served"), F.count(F.lit(1)).alias("probed")
        )
        so_far = F.col("assets_so_far") + F.coalesce("probed", F.lit(0))
        counts = active.join(probed, "site_id", "left").select("site_id", so_far.alias("n_assets")).filter("n_assets > 0")
        rated = scoring.support(new_guesses, counts, params)
        gain = F.col("new_decisiveness") - F.col("decisiveness")
        no_asset = ~F.coalesce("served", F.lit(False))
        small_gain = gain < params.iteration_min_improvement
        state = save(
            active.join(probed, "site_id", "left")
            .withColumn("assets_so_far", so_far)
            .join(scoring.decisiveness(new_guesses).withColumnRenamed("decisiveness", "new_decisiveness"), "site_id", "left")
            .join(rated, "site_id", "left")
            .withColumn("new_decisiveness", F.coalesce("new_decisiveness", F.lit(0.0)))
            .withColumn("gain", gain)
            .withColumn(
                "useless_reason",
                F.when(small_gain, "gain too small").when(no_asset, "no asset retrieved"),
            )
            .withColumn("streak", F.when(F.col("useless_reason").isNull(), 0).otherwise(F.col("streak") + 1))
            .withColumn("n_guesses", F.coalesce("n_guesses", F.lit(0)))
            .withColumn("enough", F.coalesce("enough", F.lit(False)))
            .withColumn(
                "stopped",
                (F.col("n_guesses") == 0)
                | (F.col("streak") >= params.max_iterations_without_improvement)
                | ((F.col("n_guesses") == 1) & F.col("enough"))
                | F.lit(number == params.max_iterations),
            )
            .withColumn(
                "finish_reason",
                F.when(F.col("n_guesses") == 0, "no guess left")
                .when(F.col("streak") >= params.max_iterations_without_improvement, "no improvement")
                .when((F.col("n_guesses") == 1) & F.col("enough"), "decided")
                .when(F.lit(number == params.max_iterations), "iteration limit"),
            )
            .withColumn("decisiveness", F.col("new_decisiveness"))
            .drop("new_decisiveness"),
            f"state-{number}",
        )
        traces.append(state.withColumn("round", F.lit(number)))
        stopped = state.filter("stopped")
        done_states.append(_outcome(stopped, number))
        done_guesses.append(new_guesses.join(stopped.filter("enough").select("site_id"), "site_id", "left_semi"))
        active = state.filter(~F.col("stopped")).select("site_id", "base_url", "assets_so_far", "streak", "decisiveness")
        if active.isEmpty():
            break
        going = active.select("site_id")
        guesses = new_guesses.join(going, "site_id", "left_semi")
        sums = sums.join(going, "site_id", "left_semi")
        assets = reduce(DataFrame.unionByName, all_assets).join(going, "site_id", "left_semi")

    answers = reduce(DataFrame.unionByName, done_guesses)
    return Inference(
        sites=reduce(DataFrame.unionByName, done_states),
        guesses=scoring.best_tie_group(answers),
        assets=reduce(DataFrame.unionByName, all_assets),
        trace=reduce(DataFrame.unionByName, traces),
        probes=reduce(DataFrame.unionByName, rounds),
        listed=reduce(DataFrame.unionByName, listed),
    )


def _outcome(state: DataFrame, number: int) -> DataFrame:
    """Final row of sites: whether there is an answer, after how many rounds."""

    def column(name: str, kind: str) -> Column:
        value = F.col(name) if name in state.columns else F.lit(None)
        return value.cast(kind).alias(name)

    return state.select(
        "site_id",
        "base_url",
        F.lit(number).alias("rounds"),
        column("best_nano", "bigint"),
        column("n_guesses", "bigint"),
        column("n_assets", "bigint"),
        column("support", "double"),
        F.coalesce(column("finish_reason", "string"), F.lit("no guess")).alias("finish_reason"),
        F.coalesce(column("enough", "boolean"), F.lit(False)).alias("has_result"),
    )


def complete_retrieval_plan(
    packages: DataFrame, versions: DataFrame, tables: MatchTables, save: Callable[[DataFrame, str], DataFrame]
) -> DataFrame:
    """``(webroot_path, rank)``: all telling paths of the indexed versions of the chosen packages, best first."""
    chosen = versions.filter(F.col("indexed").isNotNull()).join(
        packages.select("package_id").distinct(), "package_id", "left_semi"
    )
    return entropy.rank_long(
        entropy.path_entropy(chosen.select(F.lit(0).alias("set_id"), "version_id"), tables.path_checksums), save
    ).drop("set_id")


def complete_retrieval(
    sites: DataFrame,
    guesses: DataFrame,
    assets: DataFrame,
    responses: DataFrame,
    tables: MatchTables,
    params: InferenceParams = InferenceParams(),
    strict_paths: bool = False,
    save: Callable[[DataFrame, str], DataFrame] = lambda df, name: df,
) -> DataFrame:
    """Every telling path of every site, looked up without an early stop.

    ``sites(site_id, base_url)``, ``guesses(site_id, version_id)``; paths of ``assets`` are left out, ``responses`` come from
    ``known_responses``. Returns ``(site_id, rank, webroot_path, url, success, found)`` in the order of requests of a site; ``found``
    says that the content is in the index. Sites with the same versions share one ranking.
    """
    paths = all_candidate_paths(sites.select("site_id", "base_url"), guesses, assets, tables, save)
    wanted = paths.select(
        "site_id", "rank", F.col("webroot_path").alias("path"), urls.join_url(F.col("base_url"), F.col("webroot_path")).alias("url")
    )
    # a row meets one response at most: counting URLs would make all rows once more, and the adaptive join spreads those of many
    answers = wanted.join(responses.select("url", "success", "found"), "url", "left")
    return answers.select(
        "site_id", "rank", F.col("path").alias("webroot_path"), "url", F.coalesce("success", F.lit(False)).alias("success"),
        F.coalesce("found", F.lit(False)).alias("found"),
    )
