"""Labelled cases of a measuring suite and the corpus they are about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Fields of all tasks; a case has those of its own task, the others are null.
CASE = (
    "id string, task string, input string, relevantDocuments array<string>, negativeDocuments array<string>, document string, requiredFacts array<string>, requireSources boolean, "
    "expectedOperation string, expectedTarget string, expectedBefore string, expectedAfter string, reviewCandidates array<string>, unrelatedSameDate array<string>, unchangedRelatedFiles boolean"
)


def read_cases(spark: SparkSession, path: str, task: str | None = None) -> DataFrame:
    """The cases of one JSON array, or of one task; a case without id or task is left out."""
    cases = spark.read.schema(CASE).option("multiLine", "true").json(path).filter("id IS NOT NULL AND task IS NOT NULL")
    return cases if task is None else cases.filter(F.col("task") == task)


def corpus_hash(text: Column) -> Column:
    """The hash of a corpus text, which does not depend on how its lines end."""
    return F.concat(F.lit("sha256:"), F.sha2(F.regexp_replace(text, "\r\n?", "\n"), 256))


def read_corpus(spark: SparkSession, root: str) -> DataFrame:
    """(relative_path, name, content, corpus_hash) of the texts below a folder."""
    from .folder import read_documents

    read = read_documents(spark, root, None).filter("content IS NOT NULL")
    return read.select("relative_path", "name", "content", corpus_hash(F.col("content")).alias("corpus_hash"))


def labelled(cases: DataFrame, column: str) -> DataFrame:
    """(id, document): one row for each document that a case names in `column`."""
    return cases.select("id", F.explode(column).alias("document")).distinct()
