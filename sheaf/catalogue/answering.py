"""Targets, edits, verbatim passages and relation lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import answers, embedding, relations, ripple
from ..sources.tables import table
from . import query
from .relating import _RELATIONS, _files, _pairs, _relations


def _collapsed(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[ \\t\\n\\r\\f]+', ' ', 'g'))"


@query(f"""
WITH c AS (SELECT DISTINCT chunk_id, document_id, {_collapsed('chunk_text')} AS q FROM chunks), f AS (SELECT DISTINCT document_id, file_id FROM indexed_documents), t AS (SELECT DISTINCT file_id, {_collapsed('content')} AS body FROM document_texts)
SELECT chunk_id, file_id FROM c JOIN f USING (document_id) JOIN t USING (file_id) WHERE strlen(q) >= 12 AND contains(body, q)
""")
def verbatim_passages(spark, d):
    """Passages of the older cutting that still stand word for word in their file."""
    files = table(spark, d, "indexed_documents").select("document_id", "file_id").distinct()
    quotes = table(spark, d, "chunks").select("chunk_id", "document_id", "chunk_text").join(files, "document_id").drop("document_id")
    texts = table(spark, d, "document_texts").select("file_id", "content")
    return answers.verbatim_sources(quotes, texts, "chunk_text", "content", ["file_id"]).select("chunk_id", "file_id").distinct()


@query("""
WITH s AS (SELECT query_chunk_id, document_id, max(round(cosine::DOUBLE, 6)) AS score FROM chunk_scores WHERE cosine IS NOT NULL AND NOT isnan(cosine) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER w AS rank, lead(score) OVER w AS nxt FROM s WINDOW w AS (PARTITION BY query_chunk_id ORDER BY score DESC, document_id))
SELECT query_chunk_id, document_id, score, rank, rank = 1 AND score >= 0.25 AND score - coalesce(nxt, 0) > 0.15 AS bound FROM r WHERE rank <= 5
""")
def resolved_targets(spark, d):
    s = table(spark, d, "chunk_scores").filter("cosine IS NOT NULL AND NOT isnan(cosine)").groupBy("query_chunk_id", "document_id").agg(F.max(F.round(F.col("cosine").cast("double"), 6)).alias("score"))
    return answers.resolved_target(s, "query_chunk_id", "document_id", "score").withColumn("rank", F.col("rank").cast("bigint"))


@query("""
WITH t AS (SELECT DISTINCT file_id, content FROM document_texts), h AS (SELECT file_id, ((length(content) - length(replace(content, 'budget', ''))) // 6)::INTEGER AS hits FROM t)
SELECT file_id, hits, hits = 1 AS applicable FROM h
""")
def resolved_edits(spark, d):
    texts = table(spark, d, "document_texts").select("file_id", "content")
    return answers.resolved_edit(texts, "file_id", "content", "budget", "plan").drop("edited").distinct()


@query("""
WITH f AS (SELECT DISTINCT file_id, name, list_filter(string_split_regex(trim(strip_accents(lower(regexp_replace(name, '[.][^.]*$', '')))), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS said FROM indexed_documents WHERE contains(name, '.')),
q AS (SELECT ['open', 'the', 'lecture', 'and', 'calendar', 'deadline', 'final', 'for', 'me'] AS asked),
m AS (SELECT file_id, name, contains('open the lecture and calendar deadline final for me', lower(name)) AS exact, len(list_filter(list_distinct(said), lambda w: NOT list_contains(asked, w))) AS extra,
  len(list_filter(said, lambda w: length(w) > 2 AND NOT regexp_full_match(w, '[0-9]+'))) > 0 AND len(list_filter(said, lambda w: length(w) > 2 AND NOT regexp_full_match(w, '[0-9]+') AND NOT list_contains(asked, w))) = 0 AS part FROM f, q)
SELECT file_id, name, exact, extra::INTEGER AS extra FROM m WHERE exact OR (part AND NOT (SELECT bool_or(exact) FROM m))
""")
def named_files(spark, d):
    """Files that a request names."""
    files = table(spark, d, "indexed_documents").filter("contains(name, '.')")
    return answers.named_files(files, "Open the lecture and calendar deadline final for me", "file_id", "name")


@query(f"""
WITH {_RELATIONS}, di AS (SELECT target AS t, source AS o, min(CASE WHEN kind = 'link' THEN 0 ELSE 2 END) AS rank, min(relative_path) AS path FROM rel JOIN f ON f.file_id = rel.source WHERE source <> target GROUP BY 1, 2),
dn AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY rank, path, o) AS k FROM di)
SELECT t AS file_id, o AS touched, CASE rank WHEN 0 THEN 'evidence' ELSE 'similarity' END AS strength FROM dn WHERE k <= 25
""")
def deletion_impacts(spark, d):
    """Whom the deletion of each file would touch."""
    paths = _files(spark, d).select(F.col("file_id").alias("touched"), "relative_path")
    edges = _relations(spark, d).select(F.col("target").alias("file_id"), F.col("source").alias("touched"), "kind").join(paths, "touched")
    return ripple.deletion_impacts(edges, "file_id", "touched", "kind", "relative_path")


@query("""
WITH e AS (SELECT DISTINCT workspace_id, document_id, content_hash FROM indexed_documents WHERE status = 'indexed' AND content_hash IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY workspace_id ORDER BY document_id) AS seq FROM (SELECT DISTINCT workspace_id, document_id, content_hash FROM indexed_documents WHERE content_hash IS NOT NULL AND media_type = 'text/plain')),
h AS (SELECT k.* FROM k SEMI JOIN e USING (workspace_id, document_id, content_hash)), l AS (SELECT workspace_id, max(seq) AS m FROM k GROUP BY 1),
n AS (SELECT e.*, coalesce(m, 0) + row_number() OVER (PARTITION BY workspace_id ORDER BY document_id) AS seq FROM (SELECT * FROM e ANTI JOIN h USING (workspace_id, document_id, content_hash)) e LEFT JOIN l USING (workspace_id))
SELECT workspace_id, document_id, content_hash, seq FROM h UNION ALL SELECT workspace_id, document_id, content_hash, seq FROM n
""")
def admitted_revisions(spark, d):
    """Numbers of revisions: the plain texts are known, the other indexed files are numbered on."""
    files = table(spark, d, "indexed_documents").filter("content_hash IS NOT NULL").select("workspace_id", "document_id", "content_hash", "status", "media_type").distinct()
    known = files.filter("media_type = 'text/plain'").withColumn("seq", F.expr("row_number() OVER (PARTITION BY workspace_id ORDER BY document_id)").cast("bigint"))
    return embedding.admitted(files.filter("status = 'indexed'"), known, "workspace_id", "document_id", "content_hash")


@query()
def graph_map(spark, d):
    """What a map around the best connected file shows (no SQL: the depth depends on what is found)."""
    return relations.map_subset(_pairs(spark, d), _files(spark, d), "file_id", "relative_path")


@query("""
SELECT chunk_id FROM (SELECT DISTINCT chunk_id, chunk_text FROM chunks) WHERE regexp_matches(' ' || trim(strip_accents(lower(chunk_text))) || ' ', '[^\\p{L}\\p{N}_](resibo|receipt)[^\\p{L}\\p{N}_]')
""")
def mentioning_passages(spark, d):
    chunks = table(spark, d, "chunks").select("chunk_id", "chunk_text")
    return answers.mentioning(chunks, "chunk_text", ["resibo", "receipt"]).select("chunk_id").distinct()
