"""The queries of the training-data problems over the tables of a folder, with production parameters and whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.tables import table
from . import clusters, language, mixing, neardup, neighbors, packing, shared_spans, splitting, textform, tokens

#: Cosine from which a neighbour counts for p1_found; beam of the full neighbour lists.
P1_COSINE, P1_WIDE = 0.85, 160


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    near = neighbors.nearest(table(spark, d, "chunk_vectors"), table(spark, d, "embedding_spaces"), least=P1_COSINE)
    return near.select(F.col("space").alias("space_id"), F.least("id", "neighbor").alias("chunk_id_a"), F.greatest("id", "neighbor").alias("chunk_id_b")).distinct()


def p1_neighbors(spark: SparkSession, d: str) -> DataFrame:
    """The ten most similar chunks of every chunk whose id is divisible by 20, against all chunks and all shards."""
    near = neighbors.nearest(table(spark, d, "chunk_vectors"), table(spark, d, "embedding_spaces"), ef=P1_WIDE, ef_build=48, margin=2.0, dense=True, asking=F.col("chunk_id") % 20 == 0)
    return near.select(F.col("space").alias("space_id"), F.col("id").alias("chunk_id"), "rank", F.col("neighbor").alias("neighbor_chunk_id"), F.round("cosine", 6).alias("cosine"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    paths = textform.look_alike_pairs(table(spark, d, "indexed_documents"), "file_id", "relative_path", "workspace_id").withColumn("field", F.lit("relative_path"))
    contents = textform.look_alike_pairs(table(spark, d, "document_texts"), "file_id", "content").withColumn("field", F.lit("content"))
    return paths.unionByName(contents).select("field", F.col("id_a").alias("file_id_a"), F.col("id_b").alias("file_id_b"))


def p2_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every file's path in the consistent form, and a hash of its content in that form."""
    paths = table(spark, d, "indexed_documents").select("file_id", "relative_path").distinct()
    texts = table(spark, d, "document_texts").select("file_id", "content")
    form = textform.canonical_form(F.col("content"))
    told = texts.select("file_id", F.sha2(form, 256).alias("form_hash"), (form != F.col("content")).alias("content_changed")).distinct()
    path = textform.canonical_form(F.col("relative_path"))
    return paths.select("file_id", path.alias("path_form"), (path != F.col("relative_path")).alias("path_changed")).join(told, "file_id", "left")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = neardup.near_duplicate_pairs(table(spark, d, "document_texts"), "file_id", "content")
    return pairs.select(F.col("id_a").alias("file_id_a"), F.col("id_b").alias("file_id_b"))


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_duplicate_groups(table(spark, d, "document_texts"), "file_id", "content").withColumnRenamed("id", "file_id")


def _passages(spark: SparkSession, d: str, oversized: bool = False) -> DataFrame:
    return splitting.split_passages(table(spark, d, "document_texts"), table(spark, d, "indexed_documents"), table(spark, d, "split_limits"), oversized=oversized)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Items that had to be cut: those with a second passage."""
    return _passages(spark, d, oversized=True).filter("passage_no = 1").select("file_id", "page")


def p4_passages(spark: SparkSession, d: str) -> DataFrame:
    return _passages(spark, d)


def p5_labels(spark: SparkSession, d: str) -> DataFrame:
    return language.detect_languages(table(spark, d, "document_texts"), table(spark, d, "language_samples"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    stored = table(spark, d, "indexed_documents").filter("file_id IS NOT NULL").groupBy("file_id").agg(F.max("language").alias("stored"))
    labels = p5_labels(spark, d).join(stored, "file_id", "left")
    wrong = (F.col("seg_no") == 0) & ~F.col("language").eqNullSafe(F.col("stored"))
    part = (F.col("seg_no") > 0) & (F.col("n_words") >= language.PARAGRAPH_WORDS)
    return labels.filter(wrong | part).select("file_id", "seg_no", "language")


def _groups(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return clusters.similarity_groups(table(spark, d, "suggested_members"), "file_id", "vector", "workspace_id", "space_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _groups(spark, d)[0].select("cluster_key", F.col("id").alias("file_id"))


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    return _groups(spark, d)[1].withColumnsRenamed({"scope": "workspace_id", "space": "space_id"})


def p7_packs(spark: SparkSession, d: str) -> DataFrame:
    sizes = tokens.token_counts(table(spark, d, "documents"), "doc_id", "text")
    return packing.pack(sizes, table(spark, d, "pack_sizes"), "id").withColumnRenamed("id", "doc_id")


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(p7_packs(spark, d), table(spark, d, "pack_sizes"))


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sized = tokens.token_counts(table(spark, d, "documents"), "doc_id", "text", "source")
    return mixing.mix(sized, table(spark, d, "mix_targets"))


def p8_mixes(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[0].withColumnRenamed("id", "doc_id")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1]


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = shared_spans.shared_pairs(table(spark, d, "documents"), "doc_id", "text")
    return pairs.select(F.col("id_a").alias("doc_id_a"), F.col("id_b").alias("doc_id_b"))


def p9_parts(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans.shared_parts(table(spark, d, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def p9_spans(spark: SparkSession, d: str) -> DataFrame:
    spans = shared_spans.shared_stretches(table(spark, d, "documents"), "doc_id", "text")
    return spans.withColumnsRenamed({"id_a": "doc_id_a", "id_b": "doc_id_b"})


def p9_members(spark: SparkSession, d: str) -> DataFrame:
    """The document that stands for each document where a text is named once: the smallest id with the same text."""
    members = shared_spans.copies_of(table(spark, d, "documents"), "doc_id", "text")
    return members.withColumnsRenamed({"id": "doc_id", "rep": "rep_doc_id"})


QUERIES = {f.__name__: f for f in (p1_found, p1_neighbors, p2_found, p2_forms, p3_found, p3_groups, p4_found, p4_passages, p5_found, p5_labels, p6_found, p6_groups, p7_packs, p7_fill, p8_mixes, p8_shares, p9_found, p9_parts, p9_spans, p9_members)}

#: Where SQL can state the result over whole tables: every oversized item, from the page ranges alone.
ORACLES = {
    "p4_found": """
WITH t AS (SELECT DISTINCT file_id, content, pages FROM document_texts WHERE file_id IS NOT NULL AND content IS NOT NULL),
m AS (SELECT file_id, min(media_type) AS media_type FROM indexed_documents GROUP BY file_id),
i AS (
  SELECT file_id, 0 AS page, CAST(strlen(content) AS BIGINT) AS n FROM t WHERE pages IS NULL
  UNION ALL
  SELECT file_id, p.page AS page, p.end_offset - p.start_offset AS n FROM (SELECT file_id, unnest(pages) AS p FROM t WHERE pages IS NOT NULL)
)
SELECT i.file_id, CAST(i.page AS INTEGER) AS page FROM i JOIN m USING (file_id) JOIN split_limits l USING (media_type) WHERE i.n > l.max_bytes
""",
}
