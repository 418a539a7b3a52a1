"""URL rules and a list of URLs behind a blocked Bloom filter.

Listed canonical URLs are folded into a filter of 64-bit blocks: a hash picks the block, further bits of it set a few bits
there. The filter is a table (block, bits) whose number of blocks follows the counted length of the list, so that few
URLs pass by chance. Up to MAX_BLOCKS rows it is broadcast, beyond that joined by the block like any table. URLs that
pass it, true hits and a few false ones, are joined with the list itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filespoor.llm.common import lower_ascii, table
from filespoor.llm.registry import query
from filespoor.session import Workspace

# (verdict, host, path): a rule fits its host and all subdomains and paths that start with its path
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
# a host with one of these labels, under any suffix and with any subdomain, has its pages on the list of the query
LISTED_NAMES = ("ads-track", "casino-win", "spam-farm", "adult-x", "cheap-pills", "free-bets")
MIN_BLOCKS, MAX_BLOCKS = 2**10, 2**20  # 16 bytes each: up to 16 MB of rows are broadcast
PER_BLOCK, BITS = 4, 6  # URLs per block at most, on average; set bits per URL


def with_parts(pages: DataFrame) -> DataFrame:
    """Adds host and path. Null or no ``://``: both are empty."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(F.expr("substring(u, instr(u, '://') + 3)"), "#", 1)).otherwise("")
    rest = F.substring_index(rest, "?", 1)
    parts = pages.withColumn("u", url).withColumn("rest", rest)
    host = F.substring_index("rest", "/", 1)
    return (
        parts.withColumn("host", lower_ascii(host))
        .withColumn("path", F.expr("substring(rest, length(substring_index(rest, '/', 1)) + 1)")).drop("u", "rest")
    )


def canonical(host: Column, path: Column) -> Column:
    """Host without ``www.`` or ``m.`` and path without ``.html`` and a slash at the end."""
    return F.concat(F.regexp_replace(host, r"^(www|m)\.", ""), F.regexp_replace(path, r"(\.html|/)$", ""))


def _hits(host: Column, domain: str) -> Column:
    return (host == domain) | F.endswith(host, F.lit("." + domain))


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """The longest fitting rule as struct(rule, verdict); null if none fits. Of rules of one length the first wins."""
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, domain, start in reversed(sorted(rules, key=lambda r: -len(r[1] + r[2]))):
        fits = _hits(host, domain) & F.startswith(path, F.lit(start))
        chosen = F.when(fits, F.struct(F.lit(domain + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def _marks(df: DataFrame, blocks: int) -> DataFrame:
    """Adds the block of ``canon`` and its bits there."""
    mask = " | ".join(f"shiftleft(1L, cast((h2 >> {6 * i}) & 63 as int))" for i in range(BITS))
    return (
        df.withColumns({"h1": F.xxhash64("canon"), "h2": F.xxhash64(F.lit(1), "canon")})
        .withColumn("block", F.pmod("h1", F.lit(blocks))).withColumn("mask", F.expr(mask)).drop("h1", "h2")
    )


def blocks_for(urls: int) -> int:
    """A power of two of blocks with at most PER_BLOCK of ``urls`` each, on average."""
    return max(MIN_BLOCKS, 1 << (-(-urls // PER_BLOCK) - 1).bit_length())


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """The filter of ``listed`` (canon): block, bits. At most ``blocks`` rows."""
    return _marks(listed, blocks).groupBy("block").agg(F.bit_or("mask").alias("bits"))


def url_filter(
    pages: DataFrame, listed: DataFrame, rules: tuple = RULES, blocks: int | None = None, most_broadcast: int = MAX_BLOCKS
) -> DataFrame:
    """One row per row of ``pages`` (page_id, url): page_id, host, path, rule, verdict.

    The rule's verdict, else block if the canonical URL is in ``listed`` (canon), else allow. URLs without host or path
    are not in any list and allowed. Repeated rows and nulls in page_id are kept; a list may repeat its URLs or be empty.
    Without ``blocks`` the list is counted, so a list that is costly to make should be written before. A filter of more
    than ``most_broadcast`` blocks is not broadcast.
    """
    blocks = blocks or blocks_for(listed.count())
    marks = bloom(listed, blocks)
    if blocks <= most_broadcast:
        marks = F.broadcast(marks)
    rows = with_parts(pages.select("page_id", "url")).select("page_id", "host", "path")
    rows = rows.withColumns({"chosen": rule_of(F.col("host"), F.col("path")), "canon": canonical(F.col("host"), F.col("path"))})
    marked = _marks(rows, blocks).join(marks, "block", "left")
    passed = F.expr("chosen is null and coalesce((bits & mask) = mask, false) and canon <> ''")
    sure = marked.filter(~passed).withColumn("verdict", F.coalesce("chosen.verdict", F.lit("allow")))
    exact = listed.select("canon").distinct().withColumn("hit", F.lit(True))
    tested = marked.filter(passed).join(exact, "canon", "left").withColumn("verdict", F.expr("if(hit, 'block', 'allow')"))
    out = ("page_id", "host", "path", F.col("chosen.rule").alias("rule"), "verdict")
    return sure.select(*out).unionByName(tested.select(*out))


def listed_of(pages: DataFrame, names: tuple = LISTED_NAMES) -> DataFrame:
    """Canonical URLs of all pages whose host has one of ``names`` as a label."""
    rows = with_parts(pages.select("url"))
    on_list = F.arrays_overlap(F.split("host", r"\."), F.array(*map(F.lit, names)))
    return rows.filter(on_list).select(canonical(F.col("host"), F.col("path")).alias("canon")).distinct()


def _sql_hits(domain: str) -> str:
    return f"(host = '{domain}' OR ends_with(host, '.{domain}'))"


_CASES = " ".join(
    f"WHEN {_sql_hits(host)} AND starts_with(path, '{path}') THEN {{0}}'{host + path}'{{1}}'{verdict}'{{2}}"
    for verdict, host, path in sorted(RULES, key=lambda r: -len(r[1] + r[2]))
)
_CASES = _CASES.replace("{0}", "{'rule': ").replace("{1}", ", 'verdict': ").replace("{2}", "}")

SQL = rf"""
WITH parts AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest
  FROM pages
), split AS (
  SELECT page_id, regexp_extract(rest, '^[^/]*') AS raw, substr(rest, length(regexp_extract(rest, '^[^/]*')) + 1) AS path FROM parts
), named AS (
  SELECT page_id, path, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM split
), canon AS (
  SELECT *, regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '(\.html|/)$', '') AS canon FROM named
), listed AS (
  SELECT DISTINCT canon FROM canon WHERE list_has_any(string_split(host, '.'), {list(LISTED_NAMES)})
), ruled AS (
  SELECT *, CASE {_CASES} END AS chosen, canon IN (SELECT canon FROM listed) AS hit FROM canon
)
SELECT page_id, host, path, chosen.rule AS rule, coalesce(chosen.verdict, CASE WHEN hit THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled
"""


@query("op10_url_filter", SQL)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return url_filter(pages, Workspace(spark, "urls").save(listed_of(pages), "listed"))
