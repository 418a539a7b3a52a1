"""Column expressions on names, paths and patterns (all JVM side)."""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import Column, functions as F

from filespoor import fixed_values as fv


def basename(url: Column) -> Column:
    """Last segment of the whole URL, cut at its first question mark."""
    return F.substring_index(F.substring_index(url, "/", -1), "?", 1)


def file_type(name: Column, analysis_only: bool = False, types: tuple = fv.FILE_TYPES) -> Column:
    """Type of a file by its name, NULL for none. ``types`` are rows like those of ``FILE_TYPES``.

    A known extension wins over the leading dot of a dotfile.
    """
    lower = F.lower(name)
    extension = F.when(F.contains(lower, F.lit(".")), F.substring_index(lower, ".", -1))
    kinds = F.when(F.lit(False), F.lit(None).cast("string"))
    for kind, extensions, for_analysis, for_index, _ in types:
        if for_analysis if analysis_only else for_index:
            kinds = kinds.when(extension.isin(*extensions), F.lit(kind))
    kinds = kinds.when(F.startswith(name, F.lit(".")), F.lit("dotfile"))
    if not analysis_only:
        kinds = kinds.when(~F.contains(name, F.lit(".")), F.lit("extensionless"))
    return kinds


def clean_path_name(name: Column) -> Column:
    return F.regexp_replace(F.replace(name, F.lit("/"), F.lit("_")), fv.NOT_IN_PATH_NAMES, "")


def default_scheme(url: Column) -> Column:
    has_scheme = F.startswith(url, F.lit("http://")) | F.startswith(url, F.lit("https://"))
    return F.when(has_scheme, url).otherwise(F.concat(F.lit("http://"), url))


def natural_key(name: Column) -> Column:
    """Sort key in natural order: texts compared as text, digit runs as numbers.

    Numbers of any length are compared by their number of digits, then by the digits.
    """
    texts = F.split(name, r"\d+", -1)
    numbers = F.transform(
        F.regexp_extract_all(name, F.lit(r"(\d+)"), F.lit(1)), lambda digits: F.ltrim(digits, F.lit("0"))
    )
    return F.transform(
        texts,
        lambda text, i: F.struct(
            text.alias("text"),
            F.coalesce(F.length(F.try_element_at(numbers, i + 1)), F.lit(-1)).alias("size"),
            F.try_element_at(numbers, i + 1).alias("digits"),
        ),
    )


def dashed_tag_name(tag: Column) -> Column:
    """``X_6-2-1rc`` -> ``x_6.2.1-rc``: dots between the first three numbers, lower case."""
    dotted = F.lower(F.regexp_replace(tag, fv.DASHED_TAG, fv.DOTTED_TAG))
    return F.regexp_replace(dotted, "-$", "")


def clean_rule_pattern(pattern: Column) -> Column:
    """Cut the version extraction part of a technology rule."""
    return F.regexp_replace(pattern, fv.RULE_VERSION, "")


def glob_regex(glob: str) -> str:
    """A shell glob as a Java regular expression over lower-case text."""
    return "^" + re.sub(r"\\[Zz]$", r"\\z", fnmatch.translate(glob.lower()))


def java_regex(pattern: str | None) -> tuple[str | None, int]:
    """A Python pattern without named groups, and the number of its ``version_name`` group."""
    if pattern is None:
        return None, 0
    group = re.compile(pattern).groupindex.get(fv.VERSION_GROUP, 0)
    return re.sub(r"\(\?P<\w+>", "(", pattern), group


def matches_at_start(text: Column, pattern: Column) -> Column:
    return F.rlike(text, F.concat(F.lit("^(?:"), pattern, F.lit(")")))
