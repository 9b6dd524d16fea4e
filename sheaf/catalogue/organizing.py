"""Duplicates, names, destinations, groups and collections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T, vectors as V
from ..operators import organize
from ..sources.tables import table
from . import query
from .library import FILES


@query(f"SELECT media_type, content_hash, count(*) AS n_files, min(file_id) AS first_id FROM {FILES} WHERE status IN ('indexed', 'unsupported') AND content_hash <> '' GROUP BY 1, 2 HAVING count(*) > 1")
def exact_duplicate_groups(spark, d):
    files = table(spark, d, "indexed_documents").filter("status IN ('indexed', 'unsupported')")
    return organize.duplicate_groups(files, "media_type", "file_id", "content_hash")


@query("""
WITH t AS (SELECT DISTINCT file_id, sha256(content) AS h FROM document_texts WHERE content <> ''), c AS (SELECT h, min(file_id) AS class_id, count(*) AS copies FROM t GROUP BY 1 HAVING count(*) > 1)
SELECT file_id, class_id, copies FROM t JOIN c USING (h)
""")
def duplicate_pairs(spark, d):
    """Files with the same text as another, by the hash of what is stored now (kept hashes may be of older revisions): one row
    per file with its class - the smallest id - and the number of copies, not one per pair."""
    t = table(spark, d, "document_texts").filter("content <> ''").select("file_id", F.unhex(F.sha2("content", 256)).alias("h")).distinct()
    c = t.groupBy("h").agg(F.min("file_id").alias("class_id"), F.count("*").alias("copies")).filter("copies > 1")
    return t.join(c, "h").select("file_id", "class_id", "copies")


@query("""
WITH f AS (SELECT DISTINCT file_id, workspace_id, relative_path, name, title, status = 'indexed' AND media_type <> 'application/pdf' AS editable FROM indexed_documents),
s AS (SELECT *, regexp_replace(regexp_replace(lower(coalesce(title, '')), '[^\\p{L}\\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, CASE WHEN contains(relative_path, '/') THEN regexp_replace(relative_path, '/[^/]*$', '/') ELSE '' END AS folder FROM f WHERE editable AND contains(name, '.')),
w AS (SELECT *, folder || slug || '.' || list_extract(string_split(name, '.'), -1) AS suggested FROM s WHERE slug <> '' AND length(slug) <= 60 AND slug <> lower(regexp_replace(name, '[.][^.]*$', ''))),
r AS (SELECT *, row_number() OVER (PARTITION BY workspace_id, lower(suggested) ORDER BY relative_path, file_id) AS k FROM w WHERE (workspace_id, lower(suggested)) NOT IN (SELECT (workspace_id, lower(relative_path)) FROM f))
SELECT file_id, workspace_id, relative_path, suggested FROM r WHERE k = 1
""")
def filename_suggestions(spark, d):
    files = table(spark, d, "indexed_documents").select("file_id", "workspace_id", "relative_path", "name", "title", F.expr("status = 'indexed' AND media_type <> 'application/pdf'").alias("editable")).distinct()
    return organize.filename_suggestions(files, "file_id", "workspace_id", "relative_path", "name", "title")


@query("""
WITH m AS (SELECT DISTINCT file_id, collection_id, vector::DOUBLE[] AS v FROM suggested_members WHERE vector IS NOT NULL AND collection_id IS NOT NULL),
u AS (SELECT file_id, collection_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM m WHERE list_dot_product(v, v) > 0),
p AS (SELECT collection_id, i, sum(v[i]) AS s FROM (SELECT collection_id, v, unnest(range(1, len(v) + 1)) AS i FROM u) GROUP BY 1, 2),
q AS (SELECT collection_id, sum(s * s) AS ss FROM p GROUP BY 1), n AS (SELECT collection_id, count(*) AS n FROM u GROUP BY 1)
SELECT collection_id, n, round(CASE WHEN n > 1 THEN (ss - n) / (n * (n - 1)) ELSE 1 END, 5) AS cohesion FROM q JOIN n USING (collection_id)
""")
def collection_cohesion(spark, d):
    """Recomputed mean pairwise cosine of every suggested collection."""
    m = table(spark, d, "suggested_members").filter("vector IS NOT NULL AND collection_id IS NOT NULL").select("file_id", "collection_id", "vector").distinct()
    u = m.select("collection_id", V.unit(F.col("vector")).alias("u")).filter("u IS NOT NULL")
    return organize.cohesion(u, "collection_id", "u").select("collection_id", "n", F.round("cohesion", 5).alias("cohesion"))


# for every file and folder of its scope, the sum over the folder's files of another content
_AFFINITY = """
m AS (SELECT s.file_id, min(s.workspace_id) AS workspace_id, min(s.space_id) AS space_id, min(s.vector::DOUBLE[]) AS v, min(d.relative_path) AS path, min(d.content_hash) AS hash FROM suggested_members s JOIN indexed_documents d USING (file_id) WHERE vector IS NOT NULL AND d.content_hash IS NOT NULL GROUP BY 1),
u AS (SELECT file_id, workspace_id, space_id, path, hash, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS home, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM m WHERE list_dot_product(v, v) > 0),
w AS (SELECT a.file_id, b.home AS candidate, i, sum(b.v[i]) AS s, count(*) AS others FROM u a JOIN u b ON a.workspace_id = b.workspace_id AND a.space_id = b.space_id AND a.hash <> b.hash, unnest(range(1, 65)) AS t(i) GROUP BY 1, 2, 3),
x AS (SELECT file_id, candidate, list(s ORDER BY i) AS rest, max(others) AS others FROM w GROUP BY 1, 2),
y AS (SELECT u.*, candidate, others, list_dot_product(rest, v) / sqrt(list_dot_product(rest, rest)) AS sim FROM x JOIN u USING (file_id) WHERE list_dot_product(rest, rest) > 1e-18),
c AS (SELECT file_id, sim FROM y WHERE candidate = home),
b AS (SELECT y.*, row_number() OVER (PARTITION BY file_id ORDER BY round(sim, 9) DESC, candidate) AS k FROM y WHERE candidate <> home AND others >= 2),
l AS (SELECT b.file_id, b.workspace_id, b.space_id, b.path, b.home, b.candidate, b.sim, round(b.sim - coalesce(c.sim, 0), 6) AS margin FROM b LEFT JOIN c USING (file_id) WHERE k = 1),
z AS (SELECT *, row_number() OVER (PARTITION BY workspace_id, space_id ORDER BY margin DESC, path, file_id) AS turn FROM l WHERE round(sim, 6) >= 0.86 AND margin >= 0.03),
affinity AS (SELECT file_id, workspace_id, space_id, path AS relative_path, home AS own_folder, candidate AS folder, round(sim, 6) AS similarity, margin FROM z WHERE turn <= 10)"""


def _affinity(spark, d):
    m = table(spark, d, "suggested_members").filter("vector IS NOT NULL").select("file_id", "workspace_id", "space_id", "vector").dropDuplicates(["file_id"])
    files = table(spark, d, "indexed_documents").groupBy("file_id").agg(F.min("relative_path").alias("relative_path"), F.min("content_hash").alias("content_hash"))
    u = m.join(files, "file_id").select("file_id", "workspace_id", "space_id", "relative_path", "content_hash", T.folder_of(F.col("relative_path")).alias("home"), V.unit(F.col("vector")).alias("u"))
    return organize.folder_affinity(u, "file_id", ["workspace_id", "space_id"], "home", "relative_path", "content_hash", "u")


@query(f"WITH {_AFFINITY} SELECT * FROM affinity")
def folder_affinity(spark, d):
    """Files that are clearly nearer to another folder than to their own; copies are no reason to move."""
    return _affinity(spark, d)


_EDITABLE = "status = 'indexed' AND media_type <> 'application/pdf'"
_HELD = f"fs AS (SELECT DISTINCT file_id, workspace_id, relative_path, content_hash, {_EDITABLE} AS editable FROM indexed_documents)"


def _held(spark, d):
    return table(spark, d, "indexed_documents").select("file_id", "workspace_id", "relative_path", "content_hash", F.expr(_EDITABLE).alias("editable")).distinct()


def _free_sql(wanted: str) -> str:
    """Wishes (file_id, workspace_id, relative_path, destination) that are portable and free."""
    return f"""
g AS (SELECT * FROM {wanted} WHERE lower(destination) <> lower(relative_path) AND (workspace_id, lower(destination)) NOT IN (SELECT (workspace_id, lower(relative_path)) FROM fs)
  AND len(list_filter(string_split(destination, '/'), lambda p: p IN ('', '.', '..') OR regexp_matches(p, '[\x00-\x1f<>:"|?*\\\\]') OR regexp_matches(p, '[. ]$') OR regexp_matches(lower(p), '^(con|prn|aux|nul|com[1-9]|lpt[1-9])([.].*)?$'))) = 0),
o AS (SELECT *, row_number() OVER (PARTITION BY workspace_id, lower(destination) ORDER BY relative_path, file_id) AS k FROM g)
SELECT file_id, workspace_id, relative_path, destination FROM o WHERE k = 1"""


@query(f"""
WITH {_AFFINITY}, {_HELD},
want AS (SELECT fs.file_id, fs.workspace_id, fs.relative_path, CASE WHEN folder <> '' THEN folder || '/' ELSE '' END || list_extract(string_split(fs.relative_path, '/'), -1) AS destination FROM affinity JOIN fs USING (file_id) WHERE editable AND content_hash IS NOT NULL),
{_free_sql("want")}
""")
def destination_moves(spark, d):
    """Moves to the nearer folder under the file's own name, where that is free."""
    return organize.destinations(_affinity(spark, d), _held(spark, d), "file_id", "workspace_id", "relative_path", "content_hash", "editable")


@query(f"""
WITH {_HELD}, nm AS (SELECT DISTINCT file_id, regexp_replace(regexp_replace(lower(name), '[^\\p{{L}}\\p{{N}}]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM (SELECT name, unnest(members) AS file_id FROM suggested_collections WHERE name IS NOT NULL)),
want AS (SELECT fs.file_id, workspace_id, relative_path, CASE WHEN contains(relative_path, '/') THEN regexp_replace(relative_path, '/[^/]*$', '/') ELSE '' END || slug || '.' || list_extract(string_split(list_extract(string_split(relative_path, '/'), -1), '.'), -1) AS destination
  FROM nm JOIN fs USING (file_id) WHERE editable AND content_hash IS NOT NULL AND slug <> '' AND length(slug) <= 60 AND contains(list_extract(string_split(relative_path, '/'), -1), '.')),
{_free_sql("want")}
""")
def model_filenames(spark, d):
    """Renames to written names; the names of suggested collections stand for names that a model wrote for their members."""
    names = table(spark, d, "suggested_collections").filter("name IS NOT NULL").select(F.explode("members").alias("file_id"), "name").distinct()
    return organize.generated_names(names, _held(spark, d), "file_id", "workspace_id", "relative_path", "content_hash", "editable", "name")


@query(f"""
WITH f AS (SELECT DISTINCT file_id, name, title, {_EDITABLE} AS editable FROM indexed_documents),
w AS (SELECT *, list_filter(string_split_regex(lower(regexp_replace(name, '[.][^.]*$', '')), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '') AS ws FROM f)
SELECT file_id FROM w WHERE editable AND title IS NULL AND len(list_filter(ws, lambda w: NOT (list_contains([{", ".join(f"'{w}'" for w in T.GENERIC_WORDS)}], w) OR regexp_full_match(w, '[0-9]+') OR regexp_full_match(w, '[^0-9]{{1,4}}[0-9]+')))) = 0
""")
def needs_a_name(spark, d):
    """Editable files that no title names and whose name says nothing."""
    files = table(spark, d, "indexed_documents").select("file_id", "name", "title", F.expr(_EDITABLE).alias("editable")).distinct()
    return files.filter(F.col("editable") & F.col("title").isNull() & T.is_generic_stem(T.stem_of(F.col("name")))).select("file_id")


@query("""
WITH c AS (SELECT DISTINCT collection_id, members FROM suggested_collections), x AS (SELECT collection_id, unnest(members) AS file_id FROM c), f AS (SELECT DISTINCT file_id FROM indexed_documents),
k AS (SELECT collection_id, count(DISTINCT f.file_id) AS kept, count(x.file_id) - count(DISTINCT f.file_id) AS dropped FROM x LEFT JOIN f USING (file_id) GROUP BY 1)
SELECT collection_id, coalesce(kept, 0) AS kept, coalesce(dropped, 0) AS dropped FROM c LEFT JOIN k USING (collection_id)
""")
def collection_members(spark, d):
    c = table(spark, d, "suggested_collections").select("collection_id", "members").distinct()
    return organize.follow_members(c, "members", table(spark, d, "indexed_documents"), "file_id", "collection_id")


@query("""
WITH c AS (SELECT DISTINCT collection_id, regexp_replace(regexp_replace(trim(regexp_replace(name, '[ \\t\\n\\r\\f]+', ' ', 'g')), '^["''.,;:!? ]+', ''), '["''.,;:!? ]+$', '') AS n FROM suggested_collections)
SELECT collection_id, CASE WHEN n <> '' AND length(n) <= 60 THEN n END AS clean FROM c
""")
def clean_collection_names(spark, d):
    return table(spark, d, "suggested_collections").select("collection_id", T.clean_name(F.col("name")).alias("clean")).distinct()


@query()
def linkage_clusters(spark, d):
    """Average linkage of the vectors of each label (no SQL: the merges depend on one another)."""
    v = table(spark, d, "embeddings").select("label", "vec_id", "embedding")
    return organize.linkage_groups(v, "label", "vec_id", "embedding", 0.3)


@query("""
WITH s AS (SELECT DISTINCT space_id, model_id, revision, quantization, dimensions FROM embedding_spaces), v AS (SELECT space_id, count(DISTINCT chunk_id) AS chunks, max(embedded_at) AS last_at FROM chunk_vectors WHERE vector IS NOT NULL GROUP BY 1)
SELECT s.*, coalesce(chunks, 0) AS chunks, last_at, row_number() OVER (PARTITION BY model_id ORDER BY revision DESC) = 1 AS active FROM s LEFT JOIN v USING (space_id)
""")
def space_registry(spark, d):
    s = table(spark, d, "embedding_spaces").distinct()
    v = table(spark, d, "chunk_vectors").filter("vector IS NOT NULL").groupBy("space_id").agg(F.count_distinct("chunk_id").alias("chunks"), F.max("embedded_at").alias("last_at"))
    return s.join(v, "space_id", "left").fillna(0, ["chunks"]).withColumn("active", F.expr("row_number() OVER (PARTITION BY model_id ORDER BY revision DESC) = 1"))
