"""The library as an object: the commands of a document workspace over a folder of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions import vectors as V
from .operators import embedding, history, organize, relations, ripple, scan, search
from .sources import folder
from .sources.tables import table


class Library:
    """Reads the tables of a folder; every method returns a DataFrame and runs nothing by itself, unless it says so."""

    def __init__(self, spark: SparkSession, tables: str, workspace: str | None = None):
        self.spark, self.tables, self.workspace = spark, tables, workspace

    def _files(self) -> DataFrame:
        files = table(self.spark, self.tables, "indexed_documents").distinct()
        return files.filter(F.col("workspace_id") == self.workspace) if self.workspace else files

    def _chunks(self) -> DataFrame:
        chunks = table(self.spark, self.tables, "chunks").distinct()
        return chunks.filter(F.col("workspace_id") == self.workspace) if self.workspace else chunks

    def _texts(self) -> DataFrame:
        return table(self.spark, self.tables, "document_texts").dropDuplicates(["file_id"]).join(self._files().select("file_id"), "file_id", "left_semi")

    def list_indexed_documents(self) -> DataFrame:
        return self._files().orderBy("relative_path")

    def get_document(self, document_id: str) -> DataFrame:
        """The document with that id, or nothing."""
        return self._files().filter(F.col("document_id") == document_id)

    def document_chunks(self, document_id: str, leading: int | None = None) -> DataFrame:
        """The passages of an indexed document in reading order, or the first of them."""
        indexed = self._files().filter((F.col("status") == "indexed") & (F.col("document_id") == document_id)).select("document_id")
        rows = self._chunks().join(indexed, "document_id", "left_semi").orderBy("ordinal")
        return rows if leading is None else rows.limit(max(1, min(leading, 100)))

    def stored_chunks(self, ids: list[int]) -> DataFrame:
        """Passages of indexed documents by a list of ids."""
        indexed = self._files().filter("status = 'indexed'").select("document_id").distinct()
        return self._chunks().filter(F.col("chunk_id").isin(ids)).join(indexed, "document_id", "left_semi")

    def recheck(self, root: str, document_ids: list[str]) -> DataFrame:
        """Outcomes of reading some documents again, whatever they wait for; of documents of this library only."""
        asked = self._files().filter(F.col("document_id").isin(document_ids)).select("relative_path")
        return self.scan_workspace(root).join(asked, "relative_path", "left_semi")

    def scan_workspace(self, root: str) -> DataFrame:
        """Outcomes of a scan of a folder of files against the index, by path."""
        now = folder.read_documents(self.spark, root).select("relative_path", "size_bytes", "modified_at", F.when(F.col("content").isNotNull(), F.col("content_hash")).alias("content_hash"))
        return scan.scan_outcomes(self._files().select("relative_path", "size_bytes", "modified_at", "content_hash", "status"), now, "relative_path")

    def search_index(self, query: str, limit: int = 20) -> DataFrame:
        """Boolean search if the query uses an operator, else keyword search grouped to documents."""
        limit = max(1, min(limit, 100))
        parsed = search.parse(query)
        if parsed is None:
            scored = search.bm25(self._chunks(), ["chunk_id", "document_id"], "chunk_text", query, normalised=False)
            return search.capped_then_grouped(scored, "document_id", "chunk_id", limit)
        files = self._files().join(self._texts().select("file_id", "content"), "file_id", "left")
        return search.operator_search(files, parsed, F.col("name"), F.col("title"), F.col("relative_path"), F.col("content")).drop("content").orderBy(F.desc("score"), "relative_path").limit(limit)

    def vector_candidates(self, query: list[float], space: str, k: int = 20) -> DataFrame:
        """The k chunks of a space nearest to a vector; ties go to the smaller chunk."""
        q = F.array(*map(F.lit, query))
        v = table(self.spark, self.tables, "chunk_vectors").filter(F.col("space_id") == space).select("chunk_id", "vector").filter(V.usable(F.col("vector"), F.lit(len(query)))).distinct()
        return v.select("chunk_id", F.round(V.cosine(F.col("vector"), q), 6).alias("cosine")).orderBy(F.desc("cosine"), "chunk_id").limit(max(1, min(k, 100)))

    def semantic_search(self, query: str, vector: list[float], space: str, limit: int = 10) -> DataFrame:
        """Hybrid ranking: every passage with a cosine or a keyword score; the gate looks at all cosines of the scope."""
        keyword = search.bm25(self._chunks(), ["chunk_id", "document_id"], "chunk_text", query).withColumnRenamed("score", "keyword")
        v = table(self.spark, self.tables, "chunk_vectors").filter(F.col("space_id") == space).filter(V.usable(F.col("vector"), F.lit(len(vector)))).select("chunk_id", V.cosine(F.col("vector"), F.array(*map(F.lit, vector))).alias("cosine")).distinct()
        both = keyword.join(v.distinct(), "chunk_id", "left")
        gate = search.scope_gate(both, "cosine").select("passed")
        met = both.join(F.broadcast(gate), how="left").filter((F.coalesce("passed", F.lit(False)) & (F.col("cosine") >= 0.35)) | (F.col("keyword") >= 0.5))
        scored = met.withColumn("score", V.fused(F.coalesce("cosine", F.lit(0.0)), F.col("keyword")))
        return search.group_passages(scored.drop("passed"), "document_id", "chunk_id", 3, limit)

    def list_duplicates(self) -> DataFrame:
        return organize.duplicate_groups(self._files().filter("status IN ('indexed', 'unsupported')"), "workspace_id", "file_id", "content_hash")

    def list_relationships(self) -> DataFrame:
        return relations.explicit_links(self._texts(), self._files(), "file_id", "workspace_id", "relative_path", "content")

    def organization_suggestions(self) -> DataFrame:
        editable = F.expr("status = 'indexed' AND media_type <> 'application/pdf'")
        return organize.filename_suggestions(self._files().withColumn("editable", editable), "file_id", "workspace_id", "relative_path", "name", "title")

    def ripple_impacts(self, before: str, after: str) -> DataFrame:
        """Lines elsewhere that mention what an edit replaces; empty for a mere insertion."""
        phrase = ripple.replaced_phrase(before, after)
        if phrase is None:
            return self._texts().select("file_id", F.lit(0).alias("line_no"), F.lit("").alias("line")).limit(0)
        return ripple.line_mentions(self._texts(), "file_id", "content", phrase)

    def pending_embedding_chunks(self, space: str) -> DataFrame:
        return embedding.pending(self._chunks(), table(self.spark, self.tables, "chunk_vectors"), space)

    def list_activity(self, after: tuple | None = None, size: int = history.PAGE) -> DataFrame:
        rows = table(self.spark, self.tables, "history").distinct().filter("applied_at IS NOT NULL")
        rows = rows.filter(F.col("workspace_id") == self.workspace) if self.workspace else rows
        return history.keyset_page(rows, ["applied_at", "history_id"], after, size)

    def preview_undo(self, plan: str) -> DataFrame:
        entries = table(self.spark, self.tables, "history").distinct().filter((F.col("plan_id") == plan) & F.col("undone_at").isNull())
        seen = self._files().select("workspace_id", F.col("relative_path").alias("path"), "content_hash")
        return history.undo_conflicts(entries, seen, "workspace_id", "path", "content_hash")
