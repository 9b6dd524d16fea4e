"""Links, edges, the graph over them, and what an edit touches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import relations, ripple, similar
from ..operators.components import connected_components
from ..sources.tables import table
from . import query


def _files(spark, d):
    return table(spark, d, "indexed_documents").select("file_id", "workspace_id", "relative_path").distinct()


def _links(spark, d):
    return relations.explicit_links(table(spark, d, "document_texts"), table(spark, d, "indexed_documents"), "file_id", "workspace_id", "relative_path", "content")


# A link of the test texts is "../folder/name" or "name": the oracle resolves exactly these two shapes and "./".
_LINKS = r"""
f AS (SELECT DISTINCT file_id, workspace_id, relative_path FROM indexed_documents),
t AS (SELECT DISTINCT file_id, content FROM document_texts WHERE contains(content, '](')),
x AS (SELECT file_id, unnest(regexp_extract_all(content, '\[[^\]]+\]\(([^)]+)\)', 1)) AS raw_target FROM t),
n AS (SELECT file_id AS source, raw_target, count(*) AS n FROM x GROUP BY 1, 2),
p AS (SELECT n.*, workspace_id, string_split(relative_path, '/')[1 : -2] AS home, list_filter(string_split(url_decode(replace(regexp_extract(raw_target, '^([^?#]*)', 1), '+', '%2B')), '/'), lambda s: s <> '' AND s <> '.') AS steps,
  regexp_matches(raw_target, '^([/\\]|[A-Za-z]+:)') AS outside FROM n JOIN f ON f.file_id = n.source),
u AS (SELECT *, len(list_filter(steps, lambda s: s = '..')) AS ups FROM p),
r AS (SELECT *, CASE WHEN outside OR ups > len(home) THEN NULL ELSE nullif(array_to_string(list_concat(home[1 : len(home) - ups], list_filter(steps, lambda s: s <> '..')), '/'), '') END AS target_path FROM u),
g AS (SELECT workspace_id, relative_path AS target_path, min(file_id) AS target FROM f GROUP BY 1, 2),
links AS (SELECT r.workspace_id, source, target, raw_target, n FROM r LEFT JOIN g USING (workspace_id, target_path) WHERE target IS NULL OR target <> source)"""


@query(f"WITH {_LINKS} SELECT workspace_id, source, target, raw_target, n FROM links")
def document_links(spark, d):
    return _links(spark, d).withColumnRenamed("scope", "workspace_id")


@query(f"WITH {_LINKS} SELECT workspace_id, count(*) AS links, count(target) AS resolved, count(*) - count(target) AS unresolved FROM links GROUP BY 1")
def link_resolution(spark, d):
    return _links(spark, d).groupBy(F.col("scope").alias("workspace_id")).agg(F.count("*").alias("links"), F.count("target").alias("resolved"), (F.count("*") - F.count("target")).alias("unresolved"))


_E = "e AS (SELECT query_chunk_id AS a, regexp_extract(document_id, '^([^:]*):', 1) AS ws, document_id, max(round(cosine::DOUBLE, 6)) AS score FROM chunk_scores WHERE cosine IS NOT NULL AND NOT isnan(cosine) GROUP BY ALL), x AS (SELECT a::VARCHAR AS a, document_id AS b, max(score) AS score FROM e GROUP BY 1, 2)"


def _edges(spark, d):
    s = table(spark, d, "chunk_scores").filter("cosine IS NOT NULL AND NOT isnan(cosine)")
    return s.groupBy(F.col("query_chunk_id").cast("string").alias("a"), F.col("document_id").alias("b")).agg(F.max(F.round(F.col("cosine").cast("double"), 6)).alias("score"))


_RANKS = "r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS ra, row_number() OVER (PARTITION BY b ORDER BY score DESC, a) AS rb FROM x)"


@query(f"WITH {_E}, {_RANKS} SELECT a, b, score FROM r WHERE ra <= 8 OR rb <= 8")
def displayed_edges(spark, d):
    """Scored candidates among the eight best of either end."""
    return relations.ranked_at_either_end(_edges(spark, d), "a", "b", "score")


@query(f"WITH {_E}, {_RANKS} SELECT a, b, score FROM r WHERE ra <= 3 AND rb <= 3")
def capped_candidates(spark, d):
    """Scored candidates among the three best of both ends (a small cap, so that it binds on the test tables)."""
    return relations.capped_at_both_ends(_edges(spark, d), "a", "b", "score", 3)


# scored candidates become edges between the files of both passages from this cosine on
_EDGE_COSINE = 0.5


def _similar(spark, d):
    s = table(spark, d, "chunk_scores").filter("cosine IS NOT NULL AND NOT isnan(cosine)").filter(F.round(F.col("cosine").cast("double"), 6) >= _EDGE_COSINE).select("query_chunk_id", "document_id").distinct()
    files = table(spark, d, "indexed_documents").select("document_id", "file_id").distinct()
    chunks = table(spark, d, "chunks").select(F.col("chunk_id").alias("query_chunk_id"), F.col("document_id").alias("from_document")).distinct()
    met = s.join(chunks, "query_chunk_id").join(files.select(F.col("document_id").alias("from_document"), F.col("file_id").alias("source")), "from_document").join(files.select("document_id", F.col("file_id").alias("target")), "document_id")
    return met.filter("source <> target").groupBy("source", "target").agg(F.count("*").alias("n"))


def _relations(spark, d):
    """Resolved links and scored similarities, one row per kind, source and target."""
    links = _links(spark, d).filter("target IS NOT NULL").groupBy("source", "target").agg(F.sum("n").alias("n"))
    return links.withColumn("kind", F.lit("link")).unionByName(_similar(spark, d).withColumn("kind", F.lit("similarity")))


_RELATIONS = f"""{_LINKS},
sim AS (SELECT a.file_id AS source, b.file_id AS target, count(*) AS n FROM (SELECT DISTINCT query_chunk_id, document_id FROM chunk_scores WHERE cosine IS NOT NULL AND NOT isnan(cosine) AND round(cosine::DOUBLE, 6) >= 0.5) s JOIN (SELECT DISTINCT chunk_id, document_id AS from_document FROM chunks) c ON c.chunk_id = s.query_chunk_id
  JOIN (SELECT DISTINCT document_id, file_id FROM indexed_documents) a ON a.document_id = c.from_document JOIN (SELECT DISTINCT document_id, file_id FROM indexed_documents) b ON b.document_id = s.document_id WHERE a.file_id <> b.file_id GROUP BY 1, 2),
rel AS (SELECT source, target, sum(n)::BIGINT AS n, 'link' AS kind FROM links WHERE target IS NOT NULL GROUP BY 1, 2 UNION ALL SELECT source, target, n, 'similarity' FROM sim)"""
_PAIRS = f"{_RELATIONS}, pairs AS (SELECT least(source, target) AS a, greatest(source, target) AS b, count(*) AS n, count(DISTINCT source < target) > 1 AS mutual FROM rel GROUP BY 1, 2)"


def _pairs(spark, d):
    return relations.graph_pairs(_relations(spark, d), "source", "target")


@query(f"WITH {_PAIRS} SELECT a, b, n, mutual FROM pairs")
def graph_edges(spark, d):
    return _pairs(spark, d)


@query(f"WITH {_PAIRS}, e AS (SELECT a AS node FROM pairs UNION ALL SELECT b FROM pairs), c AS (SELECT node, count(*) AS n FROM e GROUP BY 1) SELECT file_id AS node, coalesce(n, 0) AS degree FROM (SELECT DISTINCT file_id FROM indexed_documents) LEFT JOIN c ON node = file_id")
def link_degree(spark, d):
    return relations.degrees(_pairs(spark, d), _files(spark, d).select(F.col("file_id").alias("node")))


@query(f"""
WITH RECURSIVE {_PAIRS}, both_ways AS (SELECT a AS u, b AS v FROM pairs UNION ALL SELECT b, a FROM pairs),
s AS (SELECT DISTINCT file_id AS node FROM indexed_documents WHERE workspace_id = 'ws-000007'),
w AS (SELECT node, 0 AS hops FROM s UNION SELECT v, hops + 1 FROM w JOIN both_ways ON u = node WHERE hops < 2)
SELECT node, min(hops)::INTEGER AS hops FROM w GROUP BY node
""")
def reachable_two_hops(spark, d):
    seeds = _files(spark, d).filter("workspace_id = 'ws-000007'").select(F.col("file_id").alias("node"))
    return relations.neighbourhood(_pairs(spark, d), seeds, 2)


@query(f"""
WITH {_PAIRS}, e AS (SELECT a AS file_id FROM pairs UNION SELECT b FROM pairs)
SELECT CASE WHEN contains(relative_path, '/') THEN regexp_replace(relative_path, '/[^/]*$', '') ELSE '' END AS folder, count(DISTINCT file_id) AS files FROM e JOIN f USING (file_id) GROUP BY 1
""")
def folder_spread(spark, d):
    return relations.folder_spread(_pairs(spark, d), _files(spark, d), "file_id", "relative_path")


@query(f"""
WITH RECURSIVE {_PAIRS}, both_ways AS (SELECT a AS u, b AS v FROM pairs UNION ALL SELECT b, a FROM pairs),
w AS (SELECT DISTINCT u AS node, u AS root FROM both_ways UNION SELECT v, root FROM w JOIN both_ways ON u = node)
SELECT node, min(root) AS component FROM w GROUP BY node
""")
def link_components(spark, d):
    """Files connected by links, by alternating large-star and small-star."""
    return connected_components(_pairs(spark, d), "a", "b")


@query("""
WITH f AS (SELECT workspace_id, row_number() OVER (PARTITION BY workspace_id ORDER BY file_id) AS seq, ordinal_no FROM (SELECT workspace_id, file_id, count(*) AS ordinal_no FROM (SELECT DISTINCT d.workspace_id, d.file_id, c.chunk_id FROM indexed_documents d LEFT JOIN chunks c USING (document_id)) GROUP BY 1, 2)),
c AS (SELECT workspace_id, seq, least(ordinal_no, seq - 1) AS cur FROM f),
t AS (SELECT workspace_id, count(*) AS documents, sum(cur)::BIGINT AS compared FROM c GROUP BY 1)
SELECT workspace_id, documents, documents * (documents - 1) // 2 AS pairs, compared, documents * (documents - 1) // 2 - compared AS remaining, CASE WHEN documents * (documents - 1) // 2 = compared THEN 'complete' ELSE 'partial' END AS state FROM t
""")
def pair_coverage(spark, d):
    """Progress of pairwise discovery; the number of a document's chunks stands for its cursor."""
    chunks = table(spark, d, "chunks").select("document_id", "chunk_id").distinct()
    files = table(spark, d, "indexed_documents").select("workspace_id", "file_id", "document_id").distinct().join(chunks, "document_id", "left").groupBy("workspace_id", "file_id").agg(F.greatest(F.count("chunk_id"), F.lit(1)).alias("cursor"))
    admitted = files.withColumn("seq", F.expr("row_number() OVER (PARTITION BY workspace_id ORDER BY file_id)").cast("bigint"))
    return relations.pair_coverage(admitted, ["workspace_id"], "seq", "cursor")


@query("""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings)
SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.e, b.e), 5) AS score FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.4
""")
def similarity_edges(spark, d):
    """Pairs of vectors of one label with cosine of at least 0.4; the synthetic embeddings stand for files, their labels for workspaces."""
    met = similar.similar_pairs(table(spark, d, "embeddings"), "label", "vec_id", "embedding", 0.4)
    return met.select("a", "b", F.round("cosine", 5).alias("score"))


@query("""
WITH c AS (SELECT DISTINCT chunk_id, workspace_id, document_id, ordinal FROM chunks), w AS (SELECT DISTINCT chunk_id, vector FROM chunk_vectors WHERE space_id = 'space-main' AND vector IS NOT NULL AND len(vector) = 64),
v AS (SELECT c.*, vector::DOUBLE[] AS e FROM w JOIN c USING (chunk_id) WHERE len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND list_dot_product(vector::DOUBLE[], vector::DOUBLE[]) > 0),
p AS (SELECT a.document_id AS l, b.document_id AS r, a.ordinal AS lo, b.ordinal AS ro, list_cosine_similarity(a.e, b.e) AS cos FROM v a JOIN v b ON a.workspace_id = b.workspace_id AND a.document_id < b.document_id WHERE list_cosine_similarity(a.e, b.e) >= 0.8),
g AS (SELECT l AS a, r AS b, lo AS at_a, ro AS at_b, max(round(cos, 6)) AS c FROM p GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY c DESC, at_a, at_b) AS n FROM g)
SELECT a, b, round(max(c), 5) AS best, (max(at_a) FILTER (WHERE n = 1))::INTEGER AS at_a, (max(at_b) FILTER (WHERE n = 1))::INTEGER AS at_b, (count(*) FILTER (WHERE n <= 6))::INTEGER AS n FROM k GROUP BY a, b
""")
def similarity_relation(spark, d):
    """Documents of a workspace that are similar by their passages: the best pair of passages and how many speak for it, over all vectors."""
    chunks = table(spark, d, "chunks").select("chunk_id", "workspace_id", "document_id", "ordinal").distinct()
    v = table(spark, d, "chunk_vectors").filter("space_id = 'space-main'").select("chunk_id", "vector").filter(V.usable(F.col("vector"), F.lit(64))).join(chunks.select("chunk_id", "workspace_id"), "chunk_id")
    met = similar.similar_pairs(v, "workspace_id", "chunk_id", "vector", 0.8)
    about = lambda x, at, doc: chunks.select(F.col("chunk_id").alias(x), F.col("document_id").alias(doc), F.col("ordinal").alias(at))
    pairs = met.join(about("a", "lo", "l"), "a").join(about("b", "ro", "r"), "b").select("l", "r", "lo", "ro", F.round("cosine", 6).alias("cosine"))
    told = relations.pair_evidence(pairs, "l", "r", "lo", "ro", "cosine", 0.0)
    return told.select("a", "b", F.round("best", 5).alias("best"), "at_a", "at_b", "n")


@query(f"""
WITH {_RELATIONS}, o AS (SELECT source AS document, target AS other, kind, 'out' AS way, n FROM rel UNION ALL SELECT target, source, kind, 'in', n FROM rel)
SELECT document, other, kind, CASE WHEN count(DISTINCT way) > 1 THEN 'mutual' ELSE min(way) END AS direction, max(n)::BIGINT AS score, count(*) AS n FROM o GROUP BY 1, 2, 3
""")
def connections(spark, d):
    return relations.connections(_relations(spark, d), "source", "target", "kind", "n")


_LINES = r"""
WITH t AS (SELECT DISTINCT file_id, content FROM document_texts),
s AS (SELECT file_id, string_split(content, chr(10)) AS ls FROM t),
l AS (SELECT file_id, unnest(range(0, len(ls))) AS line_no, unnest(ls) AS line FROM s),
m AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY line_no) AS k FROM l WHERE regexp_matches(' ' || lower(line) || ' ', '[^\p{L}\p{N}]budget for the[^\p{L}\p{N}]'))
"""


@query(_LINES + r"SELECT file_id, line_no::INTEGER AS line_no, trim(regexp_replace(line, '\r$', '')) AS line FROM m WHERE k <= 5")
def line_mentions(spark, d):
    return ripple.line_mentions(table(spark, d, "document_texts").select("file_id", "content"), "file_id", "content", "budget for the")


@query(f"""
WITH {_RELATIONS}, im AS (SELECT DISTINCT file_id FROM document_texts WHERE regexp_matches(' ' || lower(content) || ' ', '[^\\p{{L}}\\p{{N}}]budget for the[^\\p{{L}}\\p{{N}}]')),
ip AS (SELECT DISTINCT file_id, workspace_id, relative_path, content_hash FROM indexed_documents),
ii AS (SELECT target AS t, source AS o, 'in' AS k FROM rel WHERE kind = 'link' UNION ALL SELECT source, target, 'out' FROM rel WHERE kind = 'link' UNION ALL SELECT source, target, 'similar' FROM rel WHERE kind = 'similarity' UNION ALL SELECT target, source, 'similar' FROM rel WHERE kind = 'similarity'),
near AS (SELECT t, o, bool_or(k = 'in') AS comes, bool_or(k = 'out') AS goes FROM ii WHERE t <> o AND o IN (SELECT file_id FROM im) GROUP BY 1, 2),
ic AS (SELECT a.file_id AS t, b.file_id AS o FROM ip a JOIN ip b ON a.workspace_id = b.workspace_id AND a.content_hash = b.content_hash AND a.content_hash <> '' AND a.file_id <> b.file_id),
iu AS (SELECT t, o, CASE WHEN comes OR goes THEN 'evidence' ELSE 'similarityOnly' END AS strength, CASE WHEN comes AND goes THEN 'links both ways' WHEN comes THEN 'links to the target' WHEN goes THEN 'is linked from the target' ELSE 'is similar' END AS reason FROM near
  UNION ALL SELECT t, o, 'similarityOnly', 'is a copy' FROM ic WHERE (t, o) NOT IN (SELECT (t, o) FROM near)),
ir AS (SELECT iu.*, row_number() OVER (PARTITION BY t ORDER BY CASE WHEN strength = 'evidence' THEN 0 ELSE 1 END, relative_path, o) AS k FROM iu JOIN ip ON ip.file_id = iu.o)
SELECT t AS target_id, o AS other_id, strength, reason FROM ir WHERE k <= 25
""")
def impact_candidates(spark, d):
    """For every document: the linked and similar ones that mention the phrase, and its identical copies."""
    told = ripple.line_mentions(table(spark, d, "document_texts"), "file_id", "content", "budget for the").select(F.col("file_id").alias("other_id"))
    files = table(spark, d, "indexed_documents").select(F.col("file_id").alias("other_id"), "workspace_id", "relative_path", "content_hash")
    edges = _similar(spark, d).select(F.col("source").alias("a"), F.col("target").alias("b"), F.lit("similarity").alias("kind"))
    return ripple.impacts(_links(spark, d).filter("target IS NOT NULL"), edges, told, files, "target_id", "other_id", "relative_path", "content_hash", "workspace_id")
