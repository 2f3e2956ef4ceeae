"""What the training-data operators share: small Column helpers, fixed values and table reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lucerna.functions.shared import settle  # noqa: F401  shared by the operators here

#: The white space of every contract: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
#: Stands for a null doc_id where documents are ordered: after all others.
LAST_ID = 9223372036854775807


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row.

    A plain column reference would be inlined into a lambda and computed again for each element."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; none for null."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[ \\t-\\r]+"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
