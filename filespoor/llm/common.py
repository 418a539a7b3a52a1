"""What the operators of this folder share: tables, words and rows' keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# white space between words: the characters 0x20 and 0x09 to 0x0D
SPACE = " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# a null doc_id counts as one document behind all others
LAST_ID = 2**63 - 1


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def without_space(text: Column) -> Column:
    for char in SPACE:
        text = F.replace(text, F.lit(char), F.lit(""))
    return text


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, other letters as they are. Plain ASCII takes the fast function."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def join_same(left: DataFrame, right: DataFrame, names: tuple[str, ...], how: str = "inner") -> DataFrame:
    """Joins on the named columns, in which nulls are equal. Other columns of ``right`` have names of their own."""
    other = right.withColumnsRenamed({n: f"_right_{n}" for n in names})
    condition = F.lit(True)
    for n in names:
        condition = condition & F.col(n).eqNullSafe(F.col(f"_right_{n}"))
    return left.join(other, condition, how).drop(*(f"_right_{n}" for n in names))


def row_keys(docs: DataFrame, names: tuple[str, ...] = ("_k1", "_k2")) -> DataFrame:
    """``docs`` with a 128-bit key of each row's id, language, source and text; only rows alike in all of them share one."""
    own = [F.col(c).cast("string") for c in ("doc_id", "lang", "source", "text") if c in docs.columns]
    empty = [c.isNull() for c in own]
    return docs.withColumns({n: F.xxhash64(F.lit(i), *empty, *own) for i, n in enumerate(names)})
