"""First estimates from page signals: referenced files, rules, generator tags."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from filespoor import fixed_values as fv
from filespoor.functions import urls
from filespoor.functions.text import basename, clean_rule_pattern, file_type, glob_regex
from filespoor.operators import skew
from filespoor.operators.skew import dealt_by

GRAM = 4  # characters of a rule's text that have to be in a page before the rule is tried
STRETCH = 1 << 16  # characters of a page that are cut into such pieces at a time
GROUP_DEPTH = 4
# rules that are sent to all tasks; with more of them the pieces of the pages are shuffled
BROADCAST_RULES = 100_000


def keep_scheme(url: Column) -> Column:
    """URLs that can be parsed and have a supported scheme or none."""
    scheme = urls.scheme(url)
    return urls.is_parsable(url) & ((scheme == "") | scheme.isin(*fv.SUPPORTED_SCHEMES))


def included_assets(signals: DataFrame, page_url: Column, analysis_only: bool = True) -> DataFrame:
    """``(site_id, url)`` of the static files a page refers to.

    ``signals`` has ``site_id`` and ``refs``; relative references are placed below the
    page URL.
    """
    refs = signals.select("site_id", page_url.alias("_page"), F.explode(F.array_distinct("refs")).alias("ref"))
    ref = F.col("ref")
    absolute = F.when(urls.scheme(ref) == "", urls.join_url(F.col("_page"), ref)).otherwise(ref)
    return (
        refs.filter(keep_scheme(ref))
        .filter(file_type(basename(ref), analysis_only).isNotNull())
        .select("site_id", absolute.alias("url"))
        .distinct()
    )


def packages_by_name(patterns: DataFrame, packages: DataFrame) -> DataFrame:
    """Packages whose name is LIKE a ``pattern``, ignoring case.

    ``%`` and ``_`` in the pattern are wildcards; alternative names are not searched.
    The text before the first wildcard is a join key: names are matched on each of their
    prefixes, so only names that can match are compared.
    """
    lower = F.lower("pattern")
    wanted = patterns.select("pattern").distinct().withColumn(
        "_prefix", F.regexp_extract(lower, r"^([^%_]*)", 1)
    )
    exact = wanted.filter(F.col("_prefix") == lower)
    wild = wanted.filter(F.col("_prefix") != lower)
    by_name = exact.join(packages.withColumn("_prefix", F.lower("name")), "_prefix")
    prefixes = packages.withColumn(
        "_prefix",
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.length("name")),
                lambda n: F.substr(F.lower("name"), F.lit(1), n),
            )
        ),
    )
    # no character escapes a wildcard
    by_prefix = wild.join(prefixes, "_prefix").filter(F.like(F.lower("name"), lower, F.lit("\0")))
    return by_name.unionByName(by_prefix).drop("_prefix")


def name_keys(packages: DataFrame) -> DataFrame:
    """``(package_id, name_key)``: lower-case name and alternative names."""
    names = F.concat(F.array("name"), F.coalesce("alternative_names", F.array().cast("array<string>")))
    return packages.select("package_id", F.explode(names).alias("_name")).select(
        "package_id", F.lower("_name").alias("name_key")
    ).distinct()


def packages_by_any_name(rows: DataFrame, column: str, packages: DataFrame) -> DataFrame:
    """Add the ``package_id`` of packages that have the name in ``column``."""
    return rows.withColumn("name_key", F.lower(column)).join(name_keys(packages), "name_key").drop("name_key")


def packages_by_glob(packages: DataFrame, glob: str, any_name: bool = False) -> DataFrame:
    """Packages whose name (or any name) fits a shell glob, ignoring case."""
    regex = F.lit(glob_regex(glob))
    hit = F.rlike(F.lower("name"), regex)
    if any_name:
        hit = hit | F.coalesce(
            F.exists("alternative_names", lambda n: F.rlike(F.lower(n), regex)), F.lit(False)
        )
    return packages.filter(hit)


def _field_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Header and meta rules: equal names first, then the pattern from the start. One pass over the pages."""

    def pairs(kind: str, column: str, value: str) -> Column:
        made = F.transform(
            column, lambda x: F.struct(F.lit(kind).alias("kind"), F.lower(x["name"]).alias("field"), x[value].alias("value"))
        )
        return F.coalesce(made, F.array().cast("array<struct<kind:string,field:string,value:string>>"))

    fields = pages.select(
        "site_id", F.inline(F.concat(pairs("headers", "headers", "value"), pairs("meta", "metas", "content")))
    )
    wanted = rules.filter(F.col("kind").isin("headers", "meta")).select(
        "app", "kind", F.lower("field").alias("field"), F.concat(F.lit("(?i)^(?:"), "pattern", F.lit(")")).alias("_regex")
    )
    return fields.join(wanted, ["kind", "field"]).filter(F.rlike("value", F.col("_regex"))).select("site_id", "app")


def required_literal(pattern: Column) -> Column:
    """The longest plain text that each match of ``pattern`` has, in lower case; empty where none is sure.

    Classes, groups, escapes and optional characters end a piece of plain text. Patterns with flags, alternatives outside of
    groups, deeply nested groups or rare escapes count as having none.
    """
    gap = "\x00"
    text = F.regexp_replace(pattern, r"\\([dDwWsSbBnrt]|[^A-Za-z0-9])", gap)
    text = F.regexp_replace(text, r"\[\^?\]?[^\[\]]*\]", gap)
    for _ in range(GROUP_DEPTH):
        text = F.regexp_replace(text, r"\((?!\?[^:=!<])[^()]*\)", gap)
    unsure = F.rlike(text, F.lit(r"[()\[\]|\\]"))
    text = F.regexp_replace(text, r"([*+?}])[?+]", "$1")
    text = F.regexp_replace(text, r"(?s).(?:[*?]|\{[^}]*\})", gap)
    pieces = F.split(text, r"[^\x20-\x7e]|[+^$.{}*?]")
    longest = F.array_max(F.transform(pieces, lambda x: F.struct(F.length(x).alias("size"), x.alias("piece"))))["piece"]
    return F.when(unsure, F.lit("")).otherwise(F.lower(longest))


def _grams(texts: DataFrame) -> DataFrame:
    """``(site_id, kind, gram)`` of ``texts(site_id, kind, text)``, taken in stretches; each text also has the empty one."""
    start = F.explode(F.sequence(F.lit(0), F.floor(F.length("text") / STRETCH))).alias("_stretch")
    part = F.lower(F.substr("text", F.col("_stretch") * STRETCH + 1, F.lit(STRETCH + GRAM - 1)))
    found = F.regexp_extract_all(part, F.lit(f"(?=([\\x20-\\x7e]{{{GRAM}}}))"), F.lit(1))
    return texts.select("site_id", "kind", "text", start).select(
        "site_id", "kind", F.explode(F.concat(F.array(F.lit("")), F.array_distinct(found))).alias("gram")
    )


def _text_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules on the page and its script sources, found by a piece of text that each of their matches has.

    The pieces of the pages meet those of the rules in a join; only pages that have the piece of a rule are tried with its
    pattern. A rule without such a text is tried on all pages.
    """
    wanted = rules.filter(F.col("kind").isin("html", "script")).select("app", "kind", "pattern").distinct().withColumn(
        "_literal", required_literal(F.col("pattern"))
    )
    keyed = wanted.withColumn("gram", F.when(F.length("_literal") < GRAM, "").otherwise(F.right("_literal", F.lit(GRAM))))
    html = F.array(F.struct(F.lit("html").alias("kind"), F.col("html").alias("text")))
    scripts = F.transform("script_srcs", lambda x: F.struct(F.lit("script").alias("kind"), x.alias("text")))
    texts = pages.select("site_id", F.inline(F.concat(html, F.coalesce(scripts, F.array().cast("array<struct<kind:string,text:string>>")))))
    texts = texts.filter(F.col("text").isNotNull())
    # most pieces of the pages are in no rule, so few rows are left where the rules come to the pages
    rules_near = F.broadcast(keyed) if keyed.count() <= BROADCAST_RULES else keyed
    tried = _grams(texts).join(rules_near, ["kind", "gram"]).select("site_id", "kind", "app", "pattern", "_literal").distinct()
    fits = F.contains(F.lower("text"), F.col("_literal")) & F.rlike("text", F.concat(F.lit("(?i)"), "pattern"))
    return texts.join(tried, ["site_id", "kind"]).filter(fits).select("site_id", "app")


def compiles(pattern: Column) -> Column:
    """Whether a pattern can be compiled."""
    return F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), pattern).isNotNull()


def invalid_patterns(spark: SparkSession, patterns: Iterable[str]) -> list[str]:
    """Patterns of a list that cannot be compiled; rules with them match nothing."""
    listed = spark.createDataFrame([(p,) for p in set(patterns)], "pattern STRING")
    return [row.pattern for row in listed.filter(~compiles(F.col("pattern"))).collect()]


def tech_rule_match(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """``(site_id, app)`` where any header, meta, html or script rule of the app fits.

    ``pages(site_id, html, headers, metas, script_srcs)``. Patterns ignore case; header
    and meta patterns are anchored at the start, the others are searched. Rules are a table of any size; those whose pattern cannot
    be compiled match nothing.
    """
    cleaned = rules.filter(F.col("pattern").isNotNull()).withColumn("pattern", clean_rule_pattern(F.col("pattern")))
    usable = cleaned.filter(compiles(F.col("pattern")))
    return _field_rules(pages, usable).unionByName(_text_rules(pages, usable)).distinct()


def rule_versions(matches: DataFrame, packages: DataFrame, versions: DataFrame) -> DataFrame:
    """``(site_id, version_id)``: all indexed versions of the packages of matched apps; few versions are given out where their sites are."""
    found = dealt_by(packages_by_any_name(matches, "app", packages).select("site_id", "package_id"), "site_id").distinct()
    indexed = versions.filter(F.col("indexed").isNotNull()).select("package_id", "version_id").distinct()
    # a version of one package comes once for a site; the rows of others only have to be made distinct
    packages_of = indexed.groupBy("version_id").agg(F.collect_list("package_id").alias("_packages"))
    own = packages_of.filter(F.size("_packages") == 1).select(F.col("_packages")[0].alias("package_id"), "version_id")
    shared = packages_of.filter(F.size("_packages") > 1).select(F.explode("_packages").alias("package_id"), "version_id")
    join = skew.near(indexed, skew.NEAR_PAIRS)
    once = join(found, own, ["package_id"]).select("site_id", "version_id")
    return once.unionByName(join(found, shared, ["package_id"]).select("site_id", "version_id").distinct())


def generator_texts(signals: DataFrame) -> DataFrame:
    """``(site_id, generator)`` of pages with exactly one non-empty generator tag."""
    tags = F.filter("metas", lambda m: m["name"] == "generator")
    return (
        signals.select("site_id", tags.alias("_tags"))
        .filter(F.size("_tags") == 1)
        .select("site_id", F.col("_tags")[0]["content"].alias("generator"))
        .filter(F.trim(F.regexp_replace("generator", r"\s+", " ")) != "")
    )


def generator_versions(texts: DataFrame, packages: DataFrame, versions: DataFrame) -> DataFrame:
    """``(site_id, version_id)`` suggested by generator texts.

    The first word names the package, else the full text does. If the second word occurs
    in the name of some of its indexed versions these are taken, else all of them. Equal
    texts are resolved once.
    """
    distinct = texts.select("generator").distinct()
    words = F.split(F.trim(F.regexp_replace("generator", r"\s+", " ")), " ")
    tokens = distinct.select(
        "generator", words[0].alias("first"), F.lower(F.try_element_at(words, F.lit(2))).alias("hint")
    )
    by_first = tokens.join(
        packages_by_name(tokens.select(F.col("first").alias("pattern")), packages).select(
            F.col("pattern").alias("first"), "package_id"
        ),
        "first",
    )
    unresolved = tokens.join(by_first.select("generator").distinct(), "generator", "left_anti")
    by_text = unresolved.join(
        packages_by_name(unresolved.select(F.col("generator").alias("pattern")), packages).select(
            F.col("pattern").alias("generator"), "package_id"
        ),
        "generator",
    )
    named = by_first.unionByName(by_text).select("generator", "hint", "package_id").distinct()
    indexed = versions.filter(F.col("indexed").isNotNull()).select(
        "package_id", "version_id", F.lower(F.trim("name")).alias("_name")
    )
    options = named.join(indexed, "package_id").withColumn(
        "_hit", F.coalesce(F.contains(F.col("_name"), F.col("hint")), F.lit(False))
    )
    any_hit = options.groupBy("generator", "package_id").agg(F.max("_hit").alias("_any"))
    chosen = (
        options.join(any_hit, ["generator", "package_id"])
        .filter(F.col("_hit") | ~F.col("_any"))
        .select("generator", "version_id")
        .distinct()
    )
    # a site with one text has each version once; the rows of others only have to be made distinct
    texts_of = dealt_by(texts, "site_id").groupBy("site_id").agg(F.collect_set("generator").alias("_texts"))
    own = texts_of.filter(F.size("_texts") == 1).select("site_id", F.col("_texts")[0].alias("generator"))
    several = texts_of.filter(F.size("_texts") > 1).select("site_id", F.explode("_texts").alias("generator"))
    join = skew.near(chosen, skew.NEAR_PAIRS)
    once = join(own, chosen, ["generator"]).select("site_id", "version_id")
    return once.unionByName(join(several, chosen, ["generator"]).select("site_id", "version_id").distinct())


def candidate_versions(*estimates: DataFrame) -> DataFrame:
    """Set union of the estimates. Those dealt by site (``dealt_by``) are made distinct where they are."""
    union = estimates[0]
    for other in estimates[1:]:
        union = union.unionByName(other)
    return union.distinct()
