"""From raw documents to a mixed training corpus: quality, near-duplicates, decontamination, pseudonyms, mixing.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, in the columns of `documents`; the last adds
what the mix takes of each. A stage's result is written to the shared folder and read again by the next one.

Defined results: rows are known by id and a hash of their text, never by id alone. A null text is an empty one and fails
the quality rules; rows with a null id are judged by their text like others and always pass the near-duplicate stage; rows
that share an id and differ in text are documents of their own; of equal rows one passes the near-duplicate stage. An empty table gives an
empty result. Columns beyond those of `documents` are passed on; the last stage's four columns replace columns of their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlab.llm import block_mixing, golay_simhash, host_rules, pseudonyms, template_match
from sessionlab.llm.common import table
from sessionlab.llm.queries import PSEUDONYM_KEY
from sessionlab.staging import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return host_rules.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return golay_simhash.one_of_similar(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return template_match.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own = {c: f"{c}_of_docs" for c in ("_found", "_fresh", "_replaced") if c in docs.columns}
    fresh = pseudonyms.with_pseudonyms(docs.withColumnsRenamed(own), PSEUDONYM_KEY)
    chars = F.when(F.col("_replaced") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return fresh.withColumn("n_chars", chars).drop("_replaced").withColumnsRenamed({v: k for k, v in own.items()}).select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which the mix takes words, with size, source_size, target and taken."""
    return block_mixing.mixed_documents(docs)


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("private_data", private_data), ("mixing", mixing)]

# Fingerprints by XXH64, templates and keyed permutations have no SQL form; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
