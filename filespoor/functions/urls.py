"""URL and path expressions, by the generic URI grammar and without Python calls."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

_URI = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _URI, 1))


def authority(url: Column) -> Column:
    return F.regexp_extract(url, _URI, 2)


def path(url: Column) -> Column:
    """Path component; parameters of the last segment do not belong to it."""
    return F.regexp_replace(F.regexp_extract(url, _URI, 3), r";[^/]*$", "")


def is_parsable(url: Column) -> Column:
    """Square brackets in the host must be paired."""
    host = authority(url)
    return F.contains(host, F.lit("[")) == F.contains(host, F.lit("]"))


def webroot_path(url: Column, strict: bool = False) -> Column:
    """Path on the server; without its leading slash unless ``strict``."""
    full = path(url)
    return full if strict else strip_slash(full)


def strip_slash(text: Column) -> Column:
    return F.regexp_replace(text, "^/", "")


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _append(base: Column, part: Column) -> Column:
    """Append one path part; a part that is still absolute replaces the base."""
    return (
        F.when(F.startswith(part, F.lit("/")), part)
        .when((base == "") | F.endswith(base, F.lit("/")), F.concat(base, part))
        .otherwise(F.concat(base, F.lit("/"), part))
    )


def join_paths(first: Column, *parts: Column) -> Column:
    """Join path parts; one leading slash of every later part is ignored."""
    joined = first
    for part in parts:
        pair = F.struct(joined.alias("base"), strip_slash(part).alias("part"))
        joined = _once(pair, lambda p: _append(p["base"], p["part"]))
    return joined


def remove_dot_segments(text: Column) -> Column:
    """Resolve ``.`` and ``..`` of an absolute path."""

    def push(done: Column, segment: Column) -> Column:
        size = F.size(done)
        popped = F.when(size > 1, F.slice(done, F.lit(1), size - 1)).otherwise(done)
        return (
            F.when(segment == "..", popped)
            .when(segment == ".", done)
            .otherwise(F.concat(done, F.array(segment)))
        )

    def resolve(path: Column) -> Column:
        kept = F.aggregate(F.split(path, "/", -1), F.array().cast("array<string>"), push)
        # a path that ends in a dot segment names a folder
        folder = F.when(F.rlike(path, F.lit(r"(^|/)\.\.?$")), F.lit("/")).otherwise(F.lit(""))
        resolved = F.concat(F.array_join(kept, "/"), folder)
        return F.when(F.rlike(path, F.lit(r"(^|/)\.\.?(/|$)")), resolved).otherwise(path)

    return _once(text, resolve)


def normalize(url: Column) -> Column:
    """Lower-case scheme and host, no default port, resolved path of at least ``/``."""

    def split(text: Column) -> Column:
        parts = {"scheme": scheme(text), "host": F.lower(authority(text))}
        for name, group in (("path", 3), ("query", 4), ("fragment", 5)):
            parts[name] = F.regexp_extract(text, _URI, group)
        return F.struct(*[part.alias(name) for name, part in parts.items()])

    def build(parts: Column) -> Column:
        port = F.when(parts["scheme"] == "https", F.lit(":443$")).otherwise(F.lit(":80$"))
        host = F.regexp_replace(parts["host"], port, F.lit(""))
        full = F.when(parts["path"] == "", F.lit("/")).otherwise(remove_dot_segments(parts["path"]))
        return F.concat(parts["scheme"], F.lit("://"), host, full, parts["query"], parts["fragment"])

    return _once(_once(url, split), build)


def join_url(base: Column, *parts: Column) -> Column:
    """Put path parts below the path of ``base`` and normalise the result.

    The path of ``base`` is kept as a folder. A part that is a full URL of its own, or
    names another host, is not put below it.
    """

    def site(text: Column) -> Column:
        root = F.concat(scheme(text), F.lit("://"), authority(text))
        return F.struct(scheme(text).alias("scheme"), root.alias("root"), strip_slash(path(text)).alias("folder"))

    def below(place: Column) -> Column:
        # one leading slash is dropped below a folder only
        folder = place["site"]["folder"]
        return F.when(folder == "", place["relative"]).otherwise(join_paths(folder, place["relative"]))

    def absolute(place: Column) -> Column:
        where, full = place["site"], place["full"]
        own_url = F.rlike(place["relative"], F.lit(r"^[A-Za-z][A-Za-z0-9+.\-]*://"))
        return (
            F.when(own_url, place["relative"])
            .when(F.startswith(full, F.lit("//")), F.concat(where["scheme"], F.lit(":"), full))
            .otherwise(F.concat(where["root"], F.lit("/"), strip_slash(full)))
        )

    relative = join_paths(*parts) if parts else F.lit("")
    place = F.struct(_once(base, site).alias("site"), relative.alias("relative"))
    if not parts:
        return normalize(_once(place, lambda p: F.concat(p["site"]["root"], F.lit("/"))))
    placed = _once(
        place, lambda p: F.struct(p["site"].alias("site"), p["relative"].alias("relative"), below(p).alias("full"))
    )
    return normalize(_once(placed, absolute))
