"""A corpus pipeline over ``documents``: quality rules, line dedup, near-dedup, mixing, packing.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns the documents
that it kept, with the columns of ``documents``. The last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lucerna.llm.common import SPACES, settle, table
from lucerna.llm.line_dedup import line_dedup
from lucerna.llm.mixing import mixing
from lucerna.llm.near_dedup import keep_one
from lucerna.llm.packing import best_fit_packing
from lucerna.llm.quality_rules import kept_rows
from lucerna.llm.queries import vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose host does."""
    return kept_rows(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document without the lines that an earlier one holds; its n_chars follows. A document that
    loses its lines and has no word left goes: earlier documents hold all that it had."""
    out = line_dedup(docs)
    out = out.where(~((F.col("n_dropped") > 0) & (F.btrim(F.col("kept"), F.lit(SPACES)) == "")))
    text = F.when(F.col("n_dropped") == 0, F.col("row.text")).otherwise(F.col("kept"))
    n_chars = F.when(F.col("n_dropped") == 0, F.col("row.n_chars")).otherwise(F.length("kept").cast("long"))
    return out.select(*[{"text": text, "n_chars": n_chars}.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mixture."""
    mixed = mixing(docs).select("row.*", "position")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return mixed.repartitionByRange(parts, "position").sortWithinPartitions("position").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences, in the order of the mixture."""
    return best_fit_packing(docs, vocabulary(), ordered=True)


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("near_dedup", near_duplicates), ("mixing", mixture), ("packing", packing)]

#: Weighted sampling, scheduling and tokenization aren't expressible in SQL; the tests hold ``run``
#: against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
