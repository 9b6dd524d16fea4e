"""Files, texts and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import table
from . import query

FOLDED = "trim(regexp_replace(regexp_replace(strip_accents(lower({x})), '\\p{{M}}+', '', 'g'), '[ \\t\\n\\r\\f]+', ' ', 'g'))"
TOKENS = "list_filter(string_split_regex(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"
FILES = "(SELECT DISTINCT * FROM indexed_documents)"


@query("""
SELECT file_id, workspace_id || ':' || relative_path AS made_id, document_id = workspace_id || ':' || relative_path AS same_id, list_extract(string_split(relative_path, '/'), -1) AS file_name,
  CASE WHEN contains(relative_path, '/') THEN regexp_replace(relative_path, '/[^/]*$', '') ELSE '' END AS folder,
  CASE WHEN contains(name, '.') THEN lower(list_extract(string_split(name, '.'), -1)) ELSE '' END AS extension
FROM (SELECT DISTINCT file_id, document_id, workspace_id, relative_path, name FROM indexed_documents)
""")
def document_identity(spark, d):
    files = table(spark, d, "indexed_documents").select("file_id", "document_id", "workspace_id", "relative_path", "name").distinct()
    made = F.concat("workspace_id", F.lit(":"), "relative_path")
    return files.select("file_id", made.alias("made_id"), (F.col("document_id") == made).alias("same_id"), T.name_of(F.col("relative_path")).alias("file_name"), T.folder_of(F.col("relative_path")).alias("folder"), T.extension_of(F.col("name")).alias("extension"))


@query("""
SELECT workspace_id, status, count(*) AS files, sum(size_bytes) AS size_bytes, count(*) FILTER (WHERE title IS NULL) AS untitled, max(indexed_at) AS last_indexed
FROM (SELECT DISTINCT * FROM indexed_documents) GROUP BY workspace_id, status
""")
def index_status(spark, d):
    files = table(spark, d, "indexed_documents").select("file_id", "workspace_id", "status", "size_bytes", "title", "indexed_at").distinct()
    return files.groupBy("workspace_id", "status").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("size_bytes"), F.count_if(F.col("title").isNull()).alias("untitled"), F.max("indexed_at").alias("last_indexed"))


@query(f"""
SELECT workspace_id, relative_path, coalesce(title, name) AS shown, status FROM {FILES} WHERE status IN ('indexed', 'stale')
""")
def listed_documents(spark, d):
    files = table(spark, d, "indexed_documents").filter(F.col("status").isin("indexed", "stale")).select("file_id", "workspace_id", "relative_path", "title", "name", "status").distinct()
    return files.select("workspace_id", "relative_path", F.coalesce("title", "name").alias("shown"), "status")


@query(f"SELECT DISTINCT file_id, {FOLDED.format(x='name')} AS folded_name FROM indexed_documents")
def folded_names(spark, d):
    return table(spark, d, "indexed_documents").select("file_id", T.fold(F.col("name")).alias("folded_name")).distinct()


@query("""
SELECT DISTINCT file_id, regexp_replace(regexp_replace(lower(title), '[^\\p{L}\\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM indexed_documents WHERE title IS NOT NULL
""")
def title_slugs(spark, d):
    return table(spark, d, "indexed_documents").filter("title IS NOT NULL").select("file_id", T.slug_of(F.col("title")).alias("slug")).distinct()


@query(f"""
SELECT DISTINCT file_id, len(list_filter({TOKENS.format(x="regexp_replace(name, '[.][^.]*$', '')")}, lambda w: NOT (list_contains([{", ".join(f"'{w}'" for w in T.GENERIC_WORDS)}], w) OR regexp_full_match(w, '[0-9]+') OR regexp_full_match(w, '[^0-9]{{1,4}}[0-9]+')))) = 0 AS is_generic
FROM indexed_documents
""")
def generic_names(spark, d):
    return table(spark, d, "indexed_documents").select("file_id", T.is_generic_stem(T.stem_of(F.col("name"))).alias("is_generic")).distinct()


@query("""
WITH f AS (SELECT DISTINCT workspace_id, file_id, string_split(relative_path, '/') AS parts FROM indexed_documents),
x AS (SELECT workspace_id, file_id, array_to_string(parts[1:i], '/') AS folder FROM (SELECT *, unnest(range(1, len(parts))) AS i FROM f))
SELECT workspace_id, folder, count(*) AS files FROM x GROUP BY ALL
""")
def folder_ancestors(spark, d):
    files = table(spark, d, "indexed_documents").select("workspace_id", "file_id", "relative_path").distinct()
    return files.select("workspace_id", F.explode(T.folders_of(F.col("relative_path"))).alias("folder")).groupBy("workspace_id", "folder").agg(F.count("*").alias("files"))


@query("""
SELECT file_id, relative_path FROM (SELECT DISTINCT file_id, relative_path, media_type, modified_at FROM indexed_documents)
WHERE media_type = 'text/markdown' AND modified_at >= TIMESTAMPTZ '2025-06-01 00:00:00+00' AND (relative_path LIKE 'notes/%' OR NOT contains(relative_path, '/'))
""")
def home_filters(spark, d):
    files = table(spark, d, "indexed_documents").select("file_id", "relative_path", "media_type", "modified_at").distinct()
    inside = F.col("relative_path").startswith("notes/") | ~F.col("relative_path").contains("/")
    return files.filter((F.col("media_type") == "text/markdown") & (F.col("modified_at") >= F.lit("2025-06-01T00:00:00Z").cast("timestamp")) & inside).select("file_id", "relative_path")


@query("""
WITH l AS (SELECT DISTINCT file_id, list_transform(string_split(content, chr(10)), lambda x: regexp_replace(x, '\\r$', '')) AS lines FROM document_texts),
h AS (SELECT file_id, list_filter(lines, lambda x: starts_with(x, '# ')) AS heads, list_filter(list_transform(lines, lambda x: trim(x)), lambda x: x <> '' AND length(x) <= 120) AS short FROM l)
SELECT file_id, nullif(CASE WHEN len(heads) > 0 THEN trim(substr(heads[1], 3)) ELSE short[1] END, '') AS title FROM h
""")
def titles(spark, d):
    return table(spark, d, "document_texts").select("file_id", T.title_of(F.col("content")).alias("title")).distinct()


@query(f"""
WITH t AS (SELECT DISTINCT file_id, {TOKENS.format(x='content')} AS w FROM document_texts),
f AS (SELECT file_id, list_has_any(w, [{", ".join(f"'{w}'" for w in T.ENGLISH_HINTS)}]) AS en, list_has_any(w, [{", ".join(f"'{w}'" for w in T.FILIPINO_HINTS)}]) AS fil FROM t)
SELECT CASE WHEN en AND fil THEN 'mixed' WHEN en THEN 'en' WHEN fil THEN 'fil' ELSE 'unknown' END AS hint, count(*) AS files FROM f GROUP BY 1
""")
def hinted_languages(spark, d):
    texts = table(spark, d, "document_texts").select("file_id", T.hinted_language(F.col("content")).alias("hint")).distinct()
    return texts.groupBy("hint").agg(F.count("*").alias("files"))


@query("""
WITH c AS (SELECT DISTINCT chunk_id, chunk_text FROM chunks)
SELECT count(*) AS chunks, sum(length(chunk_text)) AS chars, sum(strlen(chunk_text)) AS bytes, round(avg(length(chunk_text)), 6) AS avg_chars, max(length(chunk_text)) AS longest FROM c
""")
def corpus_stats(spark, d):
    chunks = table(spark, d, "chunks").select("chunk_id", F.char_length("chunk_text").alias("n"), F.octet_length("chunk_text").alias("b")).distinct()
    return chunks.agg(F.count("*").alias("chunks"), F.sum("n").alias("chars"), F.sum("b").alias("bytes"), F.round(F.avg("n"), 6).alias("avg_chars"), F.max("n").cast("bigint").alias("longest"))


@query(f"""
WITH c AS (SELECT DISTINCT chunk_id, chunk_text FROM chunks)
SELECT term, count(*) AS chunks FROM (SELECT unnest(list_distinct({TOKENS.format(x='chunk_text')})) AS term FROM c) GROUP BY term
""")
def token_document_frequency(spark, d):
    terms = table(spark, d, "chunks").select("chunk_id", F.explode(F.array_distinct(T.tokens(F.col("chunk_text")))).alias("term"))
    return terms.groupBy("term").agg(F.count_distinct("chunk_id").alias("chunks"))


@query("""
WITH c AS (SELECT DISTINCT chunk_id, document_id, chunk_text, start_offset, end_offset, content_hash FROM chunks),
f AS (SELECT DISTINCT document_id, file_id FROM indexed_documents),
t AS (SELECT DISTINCT file_id, content, content_hash AS now_hash FROM document_texts)
SELECT CASE WHEN content IS NULL THEN 'unread' WHEN c.content_hash IS DISTINCT FROM now_hash THEN 'changed' WHEN encode(content)[start_offset + 1 : end_offset] = encode(chunk_text) THEN 'current' ELSE 'displaced' END AS state, count(*) AS passages
FROM c LEFT JOIN f USING (document_id) LEFT JOIN t USING (file_id) GROUP BY 1
""")
def passage_states(spark, d):
    """Passages and texts meet once, as they lie; what repeated rows say is made distinct afterwards."""
    chunks = table(spark, d, "chunks").select("chunk_id", "document_id", "chunk_text", "start_offset", "end_offset", "content_hash")
    files = table(spark, d, "indexed_documents").select("document_id", "file_id").distinct()
    texts = table(spark, d, "document_texts").select("file_id", "content", F.col("content_hash").alias("now_hash"))
    same = T.byte_slice(F.col("content"), F.col("start_offset"), F.col("end_offset")) == F.encode("chunk_text", "UTF-8")
    state = F.when(F.col("content").isNull(), "unread").when(~F.col("content_hash").eqNullSafe(F.col("now_hash")), "changed").when(same, "current").otherwise("displaced")
    told = chunks.join(files, "document_id", "left").join(texts, "file_id", "left").select("chunk_id", "document_id", "start_offset", "end_offset", state.alias("state")).distinct()
    return told.groupBy("state").agg(F.count("*").alias("passages"))


@query("""
WITH t AS (SELECT DISTINCT file_id, pages FROM document_texts WHERE pages IS NOT NULL),
p AS (SELECT file_id, unnest(pages) AS p FROM t)
SELECT file_id, count(*) AS pages, sum(p.end_offset - p.start_offset)::BIGINT AS page_bytes, count(*) FILTER (WHERE p.end_offset = p.start_offset) AS empty_pages FROM p GROUP BY file_id
""")
def page_ranges(spark, d):
    pages = table(spark, d, "document_texts").filter("pages IS NOT NULL").select("file_id", "pages").distinct().select("file_id", F.explode("pages").alias("p"))
    return pages.groupBy("file_id").agg(F.count("*").alias("pages"), F.sum(F.col("p.end_offset") - F.col("p.start_offset")).alias("page_bytes"), F.count_if(F.col("p.end_offset") == F.col("p.start_offset")).alias("empty_pages"))


@query("""
WITH c AS (SELECT DISTINCT chunk_id, document_id, start_offset, end_offset, page FROM chunks WHERE page IS NOT NULL),
f AS (SELECT DISTINCT document_id, file_id FROM indexed_documents),
p AS (SELECT file_id, p.page AS page_no, p.start_offset AS s, p.end_offset AS e FROM (SELECT file_id, unnest(pages) AS p FROM (SELECT DISTINCT file_id, pages FROM document_texts WHERE pages IS NOT NULL)))
SELECT chunk_id, page, min(page_no) AS page_found FROM c JOIN f USING (document_id) JOIN p USING (file_id) WHERE s <= start_offset AND e >= end_offset GROUP BY chunk_id, page
""")
def chunks_in_pages(spark, d):
    """Interval containment: the page whose byte range holds a chunk."""
    chunks = table(spark, d, "chunks").filter("page IS NOT NULL").select("chunk_id", "document_id", "start_offset", "end_offset", "page").distinct()
    files = table(spark, d, "indexed_documents").select("document_id", "file_id").distinct()
    pages = table(spark, d, "document_texts").filter("pages IS NOT NULL").select("file_id", "pages").distinct().select("file_id", F.explode("pages").alias("p"))
    met = chunks.join(files, "document_id").join(pages, "file_id").filter("p.start_offset <= start_offset AND p.end_offset >= end_offset")
    return met.groupBy("chunk_id", "page").agg(F.min("p.page").alias("page_found"))


@query("""
SELECT DISTINCT chunk_id, CASE WHEN regexp_matches(chunk_text, '[^\\x00-\\x7F]') THEN 'other' ELSE 'ascii' END AS kind, length(chunk_text) AS chars, strlen(chunk_text) AS bytes FROM chunks
""")
def byte_and_char_lengths(spark, d):
    kind = F.when(F.col("chunk_text").rlike(r"[^\x00-\x7F]"), "other").otherwise("ascii")
    return table(spark, d, "chunks").select("chunk_id", kind.alias("kind"), F.char_length("chunk_text").cast("bigint").alias("chars"), F.octet_length("chunk_text").cast("bigint").alias("bytes")).distinct()


@query("SELECT event_id, event_type, json_extract_string(props, '$.k') AS k, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k_number FROM events")
def props_json_fields(spark, d):
    k = F.get_json_object("props", "$.k")
    return table(spark, d, "events").select("event_id", "event_type", k.alias("k"), k.try_cast("bigint").alias("k_number"))


@query()
def index_chunks(spark, d):
    """Every text cut anew into passages of at most 1200 characters (a generator: no SQL)."""
    from ..operators.chunking import chunk

    return chunk(table(spark, d, "document_texts"), "file_id", "content", "pages", with_text=False)


@query()
def summary_passages(spark, d):
    from ..operators.chunking import SUMMARY_BYTES, chunk

    return chunk(table(spark, d, "document_texts"), "file_id", "content", None, SUMMARY_BYTES, "bytes", False).drop("page")


@query()
def clause_facts(spark, d):
    from ..operators.facts import clause_facts as facts

    return facts(table(spark, d, "document_texts"), "file_id", "content")


@query()
def shared_facts(spark, d):
    from ..operators import facts

    """Texts that state the same fact, by class."""
    return facts.shared_facts(facts.clause_facts(table(spark, d, "document_texts"), "file_id", "content"), "file_id")


@query()
def revision_diffs(spark, d):
    """Line differences between each passage of the older cutting and what stands at its place now."""
    from ..operators.diffs import diff_lines

    chunks = table(spark, d, "chunks").select("chunk_id", "document_id", "chunk_text", "start_offset", "end_offset")
    files = table(spark, d, "indexed_documents").select("document_id", "file_id").distinct()
    texts = table(spark, d, "document_texts").select("file_id", "content")
    now = F.try_validate_utf8(T.byte_slice(F.col("content"), F.col("start_offset"), F.col("end_offset")).cast("string"))
    return diff_lines(chunks.join(files, "document_id").join(texts, "file_id").select("chunk_id", "chunk_text", now.alias("now")), "chunk_id", "chunk_text", "now").distinct()


@query("""
WITH t AS (SELECT DISTINCT file_id, content FROM document_texts), l AS (SELECT file_id, unnest(string_split(content, chr(10))) AS line FROM t),
w AS (SELECT file_id, line, regexp_replace(line, '\\s+', '', 'g') AS v, list_filter(string_split_regex(line, '[^\\p{L}\\p{N}]+'), lambda w: length(regexp_replace(w, '[^A-Za-z]', '', 'g')) >= 2) AS ws FROM l),
o AS (SELECT file_id, length(v) AS n, length(regexp_replace(v, '[\\p{L}\\p{N}.,;:!?''"()\\[\\]{}\\-–—/\\\\&%@#*+=<>|~^$€£¥₱°•·…‘’“”«»_]', '', 'g')) AS odd, len(ws) AS k, len(list_filter(ws, lambda w: regexp_matches(w, '[aeiouyAEIOUY]'))) AS voiced, len(list_filter(ws, lambda w: regexp_matches(w, '[0-9]'))) AS mixed FROM w)
SELECT file_id, count(*) AS lines, count(*) FILTER (WHERE n = 0 OR (odd <= n * CASE WHEN n < 4 THEN 0.5 ELSE 0.25 END AND NOT (k >= 4 AND (voiced < k * 0.4 OR mixed * 2 > k)))) AS readable FROM o GROUP BY 1
""")
def readable_lines(spark, d):
    from ..sources.folder import is_readable

    lines = F.split("content", "\n")
    return table(spark, d, "document_texts").filter("content IS NOT NULL").select("file_id", F.size(lines).cast("bigint").alias("lines"), F.size(F.filter(lines, is_readable)).cast("bigint").alias("readable")).distinct()
