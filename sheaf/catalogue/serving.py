"""What a search page, a map, a scan and a review are served with."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import answers, history, lab, organize, relations, scan, search
from ..sources.tables import table
from . import query
from .changes import _H, _history
from .library import FOLDED, TOKENS
from .relating import _RELATIONS, _files, _pairs, _relations, _PAIRS
from .retrieval import _C, WORDS, _bm25_sql

_TERMS = search.terms_of(WORDS)
_INDEXED = "ix AS (SELECT DISTINCT document_id FROM indexed_documents WHERE status = 'indexed')"


def _indexed(spark, d):
    return table(spark, d, "indexed_documents").filter("status = 'indexed'").select("document_id").distinct()


@query(f"""
WITH c AS (SELECT DISTINCT chunk_id, document_id, ordinal FROM chunks), {_INDEXED}, r AS (SELECT c.*, row_number() OVER (PARTITION BY document_id ORDER BY ordinal, chunk_id) AS place FROM c JOIN ix USING (document_id))
SELECT document_id, chunk_id, ordinal, place FROM r WHERE place <= 8
""")
def leading_chunks(spark, d):
    """The opening passages of every indexed document in reading order."""
    c = table(spark, d, "chunks").select("chunk_id", "document_id", "ordinal").distinct().join(_indexed(spark, d), "document_id", "left_semi")
    placed = c.withColumn("place", F.expr("row_number() OVER (PARTITION BY document_id ORDER BY ordinal, chunk_id)").cast("bigint"))
    return placed.filter("place <= 8").select("document_id", "chunk_id", "ordinal", "place")


@query(f"""
WITH c AS (SELECT DISTINCT chunk_id, document_id, ordinal, page, start_offset, end_offset FROM chunks), {_INDEXED}
SELECT c.* FROM c WHERE document_id IN (SELECT document_id FROM ix) AND chunk_id IN (SELECT query_chunk_id FROM chunk_scores)
""")
def stored_chunks(spark, d):
    """Passages by a list of ids: those that earlier searches asked for."""
    c = table(spark, d, "chunks").select("chunk_id", "document_id", "ordinal", "page", "start_offset", "end_offset").distinct()
    ids = table(spark, d, "chunk_scores").select(F.col("query_chunk_id").alias("chunk_id")).distinct()
    return c.join(ids, "chunk_id", "left_semi").join(_indexed(spark, d), "document_id", "left_semi").select("chunk_id", "document_id", "ordinal", "page", "start_offset", "end_offset")


@query(f"""
WITH c AS (SELECT DISTINCT chunk_id, document_id, ordinal FROM chunks), {_INDEXED}, v AS (SELECT DISTINCT chunk_id, space_id, len(vector) AS n FROM chunk_vectors WHERE vector IS NOT NULL)
SELECT chunk_id, document_id, ordinal, space_id, n::INTEGER AS numbers, n = dimensions AS sound FROM c JOIN v USING (chunk_id) JOIN embedding_spaces USING (space_id) WHERE document_id IN (SELECT document_id FROM ix)
""")
def embedded_chunks(spark, d):
    """Passages of indexed documents with their vectors' lengths: one of the wrong length is an error to its reader."""
    c = table(spark, d, "chunks").select("chunk_id", "document_id", "ordinal").distinct().join(_indexed(spark, d), "document_id", "left_semi")
    v = table(spark, d, "chunk_vectors").filter("vector IS NOT NULL").select("chunk_id", "space_id", F.size("vector").alias("numbers")).distinct()
    s = table(spark, d, "embedding_spaces").select("space_id", "dimensions")
    return c.join(v, "chunk_id").join(s, "space_id").select("chunk_id", "document_id", "ordinal", "space_id", "numbers", (F.col("numbers") == F.col("dimensions")).alias("sound"))


@query("""
WITH a AS (SELECT space_id, row_number() OVER (PARTITION BY model_id ORDER BY revision DESC) = 1 AS active FROM (SELECT DISTINCT space_id, model_id, revision FROM embedding_spaces)), v AS (SELECT DISTINCT chunk_id, space_id FROM chunk_vectors)
SELECT space_id, count(*) AS purged FROM v WHERE space_id NOT IN (SELECT space_id FROM a WHERE active) GROUP BY 1
""")
def purged_spaces(spark, d):
    """Vectors that go when only the active space of each model is kept."""
    s = table(spark, d, "embedding_spaces").select("space_id", "model_id", "revision").distinct()
    active = s.withColumn("n", F.expr("row_number() OVER (PARTITION BY model_id ORDER BY revision DESC)")).filter("n = 1").select("space_id")
    v = table(spark, d, "chunk_vectors").select("chunk_id", "space_id").distinct()
    return v.join(active, "space_id", "left_anti").groupBy("space_id").agg(F.count("*").alias("purged"))


@query(f"""
WITH {_RELATIONS}, dc AS (SELECT file_id, min(file_id) OVER (PARTITION BY content_hash) AS class_id FROM (SELECT DISTINCT file_id, content_hash FROM indexed_documents WHERE content_hash <> '')),
ek AS (SELECT source, target, kind FROM rel UNION ALL SELECT class_id, file_id, 'copy' FROM dc WHERE file_id <> class_id)
SELECT kind, CASE kind WHEN 'link' THEN 'document link' WHEN 'copy' THEN 'same bytes' ELSE 'embedding' END AS origin, kind <> 'similarity' AS confirmed, count(*) AS edges FROM ek GROUP BY 1
""")
def edge_origins(spark, d):
    """Relations by where they come from: links and copies are confirmed, similarities are to be checked."""
    files = table(spark, d, "indexed_documents").filter("content_hash <> ''").select("file_id", "content_hash").distinct()
    first = files.groupBy("content_hash").agg(F.min("file_id").alias("source"))
    copies = files.join(first, "content_hash").filter("file_id <> source").select("source", F.col("file_id").alias("target"), F.lit("copy").alias("kind"))
    edges = _relations(spark, d).select("source", "target", "kind").unionByName(copies)
    origin, confirmed = relations.edge_origin(F.col("kind"))
    return edges.groupBy("kind", origin.alias("origin"), confirmed.alias("confirmed")).agg(F.count("*").alias("edges"))


_NAME_HIT = f"list_has_any({TOKENS.format(x='name')}, [{', '.join(repr(t) for t in _TERMS)}])"


@query(f"""
WITH {_bm25_sql(False)}, di AS (SELECT DISTINCT document_id, name, relative_path FROM indexed_documents),
th AS (SELECT document_id, row_number() OVER (ORDER BY max(round(score, 9)) DESC, document_id) AS place FROM b JOIN c USING (chunk_id) WHERE score > 0 GROUP BY 1 ORDER BY max(round(score, 9)) DESC, document_id LIMIT 20),
nh AS (SELECT document_id, row_number() OVER (ORDER BY relative_path, document_id) AS place FROM di WHERE {_NAME_HIT} ORDER BY relative_path, document_id LIMIT 20)
SELECT document_id, 'text' AS list, place FROM th WHERE document_id IN (SELECT document_id FROM di) UNION ALL SELECT document_id, 'name', place FROM nh WHERE document_id NOT IN (SELECT document_id FROM th)
""")
def merged_results(spark, d):
    """The twenty best documents by their text, then the first twenty by their name that are not among them."""
    files = table(spark, d, "indexed_documents").select("document_id", "name", "relative_path").distinct()
    scored = search.bm25(table(spark, d, "chunks"), ["chunk_id", "document_id"], "chunk_text", WORDS, normalised=False).filter("score > 0")
    text = scored.groupBy("document_id").agg(F.max(F.round("score", 9)).alias("s")).orderBy(F.desc("s"), "document_id").limit(20).withColumn("place", F.expr("row_number() OVER (ORDER BY s DESC, document_id)").cast("bigint"))
    named = files.filter(F.arrays_overlap(T.tokens(F.col("name")), T.array_of(_TERMS))).orderBy("relative_path", "document_id").limit(20).withColumn("place", F.expr("row_number() OVER (ORDER BY relative_path, document_id)").cast("bigint"))
    return search.merged_results(text, named, files, "document_id", "place")


@query("""
WITH s AS (SELECT query_chunk_id, document_id AS r, ordinal AS ro, cosine::DOUBLE AS cos FROM chunk_scores WHERE cosine IS NOT NULL AND NOT isnan(cosine)),
c AS (SELECT DISTINCT chunk_id, document_id AS l, ordinal AS lo FROM chunks),
p AS (SELECT least(l, r) AS a, greatest(l, r) AS b, CASE WHEN l > r THEN ro ELSE lo END AS at_a, CASE WHEN l > r THEN lo ELSE ro END AS at_b, max(cos) AS c FROM s JOIN c ON chunk_id = query_chunk_id WHERE l <> r GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY c DESC, at_a, at_b) AS n FROM p)
SELECT a, b, round(max(c), 6) AS best, (max(at_a) FILTER (WHERE n = 1))::INTEGER AS at_a, (max(at_b) FILTER (WHERE n = 1))::INTEGER AS at_b, (count(*) FILTER (WHERE c >= 0.8 AND n <= 6))::INTEGER AS n, coalesce(string_agg(at_a || '-' || at_b, ' ' ORDER BY n) FILTER (WHERE c >= 0.8 AND n <= 6), '') AS evidence FROM k GROUP BY a, b
""")
def pair_evidence(spark, d):
    """The best passages of every two documents that kept searches have brought together, and what speaks for their similarity."""
    s = table(spark, d, "chunk_scores").select("query_chunk_id", F.col("document_id").alias("r"), F.col("ordinal").alias("ro"), "cosine")
    c = table(spark, d, "chunks").select(F.col("chunk_id").alias("query_chunk_id"), F.col("document_id").alias("l"), F.col("ordinal").alias("lo")).distinct()
    told = relations.pair_evidence(s.join(c, "query_chunk_id"), "l", "r", "lo", "ro", "cosine")
    shown = F.array_join(F.transform("evidence", lambda e: F.concat_ws("-", e["at_a"], e["at_b"])), " ")
    return told.select("a", "b", F.round("best", 6).alias("best"), "at_a", "at_b", "n", shown.alias("evidence"))


@query("""
WITH f AS (SELECT DISTINCT document_id, file_id FROM indexed_documents), t AS (SELECT DISTINCT file_id, strlen(content) AS total FROM document_texts WHERE content <> ''),
c AS (SELECT DISTINCT file_id, start_offset AS s, end_offset AS e FROM chunks JOIN f USING (document_id)),
r AS (SELECT *, max(e) OVER (PARTITION BY file_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM c),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM r),
m AS (SELECT file_id, sum(n) AS covered FROM (SELECT file_id, island, max(e) - min(s) AS n FROM i GROUP BY 1, 2) GROUP BY 1)
SELECT file_id, coalesce(covered, 0)::BIGINT AS covered, total, round(least(100.0, 100.0 * coalesce(covered, 0) / total), 4) AS percent FROM t LEFT JOIN m USING (file_id)
""")
def coverage_percent(spark, d):
    """How much of each text the passages of the older cutting cover."""
    files = table(spark, d, "indexed_documents").select("document_id", "file_id").distinct()
    texts = table(spark, d, "document_texts").filter("content <> ''").select("file_id", F.octet_length("content").cast("bigint").alias("total")).distinct()
    c = table(spark, d, "chunks").select("document_id", F.col("start_offset").alias("s"), F.col("end_offset").alias("e")).join(files, "document_id").select("file_id", "s", "e").distinct()
    m = search.merged_intervals(c, ["file_id"], "s", "e").groupBy("file_id").agg(F.sum(F.col("e") - F.col("s")).alias("covered"))
    got = F.coalesce("covered", F.lit(0))
    return texts.join(m, "file_id", "left").select("file_id", got.alias("covered"), "total", F.round(F.least(F.lit(100.0), got * 100.0 / F.col("total")), 4).alias("percent"))


@query("""
WITH s AS (SELECT workspace_id, document_id, row_number() OVER (PARTITION BY workspace_id ORDER BY document_id) AS seq FROM (SELECT DISTINCT workspace_id, document_id FROM indexed_documents WHERE content_hash IS NOT NULL)),
w AS (SELECT DISTINCT document_id FROM chunks WHERE chunk_id NOT IN (SELECT chunk_id FROM chunk_vectors WHERE space_id = 'space-main' AND vector IS NOT NULL)),
q AS (SELECT s.workspace_id, seq, seq < count(*) OVER (PARTITION BY s.workspace_id) // 2 AS wrapped, document_id FROM s), p AS (SELECT * FROM q WHERE document_id IN (SELECT document_id FROM w)),
r AS (SELECT *, row_number() OVER (PARTITION BY workspace_id ORDER BY wrapped, seq) AS k FROM p)
SELECT workspace_id, seq FROM r WHERE k = 1
""")
def next_jobs(spark, d):
    """The next document of each workspace that wants vectors, round-robin from a pointer; the middle of the numbers stands for the pointer."""
    docs = table(spark, d, "indexed_documents").filter("content_hash IS NOT NULL").select("workspace_id", "document_id").distinct()
    numbered = docs.withColumn("seq", F.expr("row_number() OVER (PARTITION BY workspace_id ORDER BY document_id)").cast("bigint"))
    v = table(spark, d, "chunk_vectors").filter("space_id = 'space-main' AND vector IS NOT NULL").select("chunk_id")
    wanting = table(spark, d, "chunks").select("chunk_id", "document_id").join(v, "chunk_id", "left_anti").select("document_id").distinct()
    pointers = docs.groupBy("workspace_id").agg(F.floor(F.count("*") / 2).alias("pointer"))
    return relations.next_job(numbered.join(wanting, "document_id", "left_semi"), "workspace_id", "seq", pointers, "pointer")


_STRONG = f"{_PAIRS}, sp AS (SELECT least(source, target) AS a, greatest(source, target) AS b, max(CASE WHEN kind = 'link' THEN 1000 ELSE least(n, 999) END)::DOUBLE AS strength FROM rel GROUP BY 1, 2)"


def _strong(spark, d):
    """Pairs with a strength: a link is stronger than any number of similar passages."""
    strength = F.when(F.col("kind") == "link", F.lit(1000)).otherwise(F.least(F.col("n"), F.lit(999)))
    return _relations(spark, d).groupBy(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(F.max(strength).cast("double").alias("strength"))


_SCOPE = f"""{_STRONG}, fx AS (SELECT 3 AS focus),
ka AS (SELECT a, b, row_number() OVER (ORDER BY strength DESC, a, b) AS n, 1 AS part FROM sp, fx WHERE a = focus OR b = focus UNION ALL SELECT a, b, row_number() OVER (ORDER BY strength DESC, a, b), 2 FROM sp),
ends AS (SELECT 0 AS part, 0 AS n, 0 AS o, focus AS document FROM fx WHERE EXISTS (SELECT 1 FROM sp WHERE a = focus OR b = focus) UNION ALL SELECT part, n, 0, a FROM ka UNION ALL SELECT part, n, 1, b FROM ka),
fst AS (SELECT document, min((part, n, o)) AS x FROM ends GROUP BY 1 ORDER BY x LIMIT 50), scp AS (SELECT document, row_number() OVER (ORDER BY x) AS place FROM fst)"""


@query(f"WITH {_SCOPE} SELECT document::BIGINT AS document, place FROM scp")
def summary_scope(spark, d):
    """The fifty files a summary of relations around file 3 looks at, in the order in which they come up."""
    return relations.summary_scope(_strong(spark, d), 3).withColumn("place", F.col("place").cast("bigint"))


@query(f"""
WITH {_SCOPE}, rs AS (SELECT source, target, kind, n, ['f' || source, 'f' || target] AS ps FROM rel WHERE source IN (SELECT document FROM scp) AND target IN (SELECT document FROM scp)),
pl AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN source = 3 OR target = 3 THEN 0 ELSE 1 END, CASE kind WHEN 'link' THEN 0 ELSE 2 END, CASE kind WHEN 'link' THEN 0 ELSE n END DESC, source, target) AS place FROM rs),
ea AS (SELECT place, unnest(range(0, len(ps))) AS i, unnest(ps) AS p FROM pl), fp AS (SELECT p, min((place, i)) AS x FROM ea GROUP BY 1), hd AS (SELECT p, x, row_number() OVER (ORDER BY x) AS turn FROM fp),
tk AS (SELECT x[1] AS place, count(*)::INTEGER AS taken FROM hd WHERE turn <= 8 GROUP BY 1)
SELECT source, target, kind, place, taken FROM pl JOIN tk USING (place)
""")
def summary_selection(spark, d):
    """The relations whose passages such a summary reads, eight passages in all; the ends of a relation stand for its passages."""
    p = lambda c: F.struct(F.concat(F.lit("f"), F.col(c).cast("string")).alias("document"), F.lit(0).alias("start"), F.lit(0).alias("end"))
    rows = _relations(spark, d).select("source", "target", "kind", F.col("n").alias("score"), F.array(p("source"), p("target")).alias("passages"))
    told = relations.summary_selection(rows, relations.summary_scope(_strong(spark, d), 3), 3)
    return told.select("source", "target", "kind", F.col("place").cast("bigint").alias("place"), F.size("passages").alias("taken"))


@query(f"""
WITH {_H}, p AS (SELECT history_id, workspace_id, applied_at FROM h WHERE applied_at IS NOT NULL AND (applied_at, history_id) < (TIMESTAMPTZ '2024-06-01 00:00:00+00', 0) ORDER BY applied_at DESC, history_id DESC LIMIT 101),
r AS (SELECT *, row_number() OVER (ORDER BY applied_at DESC, history_id DESC) AS k, count(*) OVER () > 100 AS has_more FROM p)
SELECT history_id, workspace_id, applied_at, has_more FROM r WHERE k <= 100
""")
def activity_page_more(spark, d):
    """The same page with the word whether another follows."""
    import datetime

    at = (datetime.datetime(2024, 6, 1, tzinfo=datetime.timezone.utc), 0)
    return history.page_with_more(_history(spark, d, "workspace_id", "applied_at").filter("applied_at IS NOT NULL"), ["applied_at", "history_id"], at).select("history_id", "workspace_id", "applied_at", "has_more")


@query(f"""
WITH {_H}, l AS (SELECT workspace_id, file_id, max(applied_at) AS last_at FROM h WHERE file_id IS NOT NULL AND applied_at IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY workspace_id ORDER BY last_at DESC, file_id) AS place FROM l)
SELECT workspace_id, file_id, last_at, place FROM r WHERE place <= 8
""")
def recent_files(spark, d):
    """The eight files of each workspace that were worked on last."""
    return history.recent(_history(spark, d, "workspace_id", "file_id", "applied_at"), "workspace_id", "file_id", "applied_at").withColumn("place", F.col("place").cast("bigint"))


@query(f"""
WITH t AS (SELECT DISTINCT file_id, {TOKENS.format(x="coalesce(title, name)")} AS w FROM indexed_documents)
SELECT file_id, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i)[1:32], ' ') AS terms FROM t
""")
def title_terms(spark, d):
    """What the full-text index is asked for when a title is searched: its words in order, each once, 32 at most."""
    return table(spark, d, "indexed_documents").select("file_id", F.array_join(T.terms_in_order(F.coalesce("title", "name")), " ").alias("terms")).distinct()


@query(f"""
WITH {_C}, t AS (SELECT chunk_id, list_filter(string_split_regex({FOLDED.format(x='chunk_text')}, '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS ws FROM c)
SELECT chunk_id, len(list_filter(ws, lambda w: {' OR '.join(f"starts_with(w, '{t}')" for t in _TERMS)}))::INTEGER AS hits FROM t
""")
def highlight_hits(spark, d):
    """How many words of each passage are marked for a query: those that begin with one of its terms."""
    marked = T.highlighted(F.col("chunk_text"), _TERMS)
    return table(spark, d, "chunks").select("chunk_id", F.size(F.filter(marked, lambda x: x["hit"])).alias("hits")).distinct()


@query("""
WITH t AS (SELECT DISTINCT file_id, content, strpos(content, '](') AS pos FROM document_texts WHERE contains(content, ']('))
SELECT file_id, pos::INTEGER AS pos, trim(regexp_replace(string_split(content, chr(10))[length(substr(content, 1, pos - 1)) - length(replace(substr(content, 1, pos - 1), chr(10), '')) + 1], '[ \\t\\r]+$', '')) AS line FROM t
""")
def link_lines(spark, d):
    """The line in which a text's first link stands."""
    at = F.locate("](", "content")
    return table(spark, d, "document_texts").filter("contains(content, '](')").select("file_id", at.alias("pos"), T.line_at(F.col("content"), at).alias("line")).distinct()


@query(f"""
WITH fl AS (SELECT DISTINCT file_id, document_id, relative_path FROM indexed_documents), {_C}, tp AS (SELECT DISTINCT file_id FROM c JOIN fl USING (document_id) WHERE list_contains({TOKENS.format(x='chunk_text')}, 'budget'))
SELECT 'folder' AS start, file_id FROM fl WHERE starts_with(relative_path, 'notes/') UNION ALL SELECT 'topic', file_id FROM tp UNION ALL SELECT 'file', file_id FROM (SELECT DISTINCT file_id FROM fl) WHERE file_id = 3
""")
def starting_files(spark, d):
    """Where a map starts from a folder, from a topic and from a file."""
    files = table(spark, d, "indexed_documents").select("file_id", "document_id", "relative_path").distinct()
    hits = table(spark, d, "chunks").filter(F.array_contains(T.tokens(F.col("chunk_text")), "budget")).select("document_id").distinct().join(files, "document_id").select("file_id")
    ids = _files(spark, d).select("file_id", "relative_path")
    parts = [("folder", relations.starting_files(ids, "file_id", "relative_path", "folder", "notes")), ("topic", relations.starting_files(ids, "file_id", "relative_path", "topic", hits=hits)), ("file", relations.starting_files(ids, "file_id", "relative_path", "file", "3"))]
    whole = [p.select(F.lit(name).alias("start"), "file_id") for name, p in parts]
    return whole[0].unionByName(whole[1]).unionByName(whole[2])


@query(f"""
WITH {_PAIRS}, st AS (SELECT DISTINCT file_id FROM indexed_documents WHERE starts_with(relative_path, 'notes/'))
SELECT a, b, n, mutual FROM pairs WHERE a IN (SELECT file_id FROM st) OR b IN (SELECT file_id FROM st)
""")
def folder_map(spark, d):
    """The connections that touch a folder."""
    ids = _files(spark, d).select("file_id", "relative_path")
    return relations.touching(_pairs(spark, d), relations.starting_files(ids, "file_id", "relative_path", "folder", "notes"), "file_id")


@query(f"""
WITH {_H}, o AS (SELECT workspace_id, lower(relative_path) AS low, max(content_hash) AS hash FROM indexed_documents WHERE relative_path IS NOT NULL GROUP BY 1, 2),
j AS (SELECT h.history_id, operation_kind AS k, lower(before_path) AS bp, before_hash AS bh, lower(after_path) AS ap, a.low IS NOT NULL AS there, a.hash AS now_hash, b.low IS NOT NULL AS taken FROM h LEFT JOIN o a ON a.workspace_id = h.workspace_id AND a.low = lower(h.before_path) LEFT JOIN o b ON b.workspace_id = h.workspace_id AND b.low = lower(h.after_path))
SELECT history_id, CASE WHEN k <> 'create' AND bp IS NOT NULL AND NOT there THEN 'targetMissing' WHEN k <> 'create' AND bp IS NOT NULL AND bh IS NOT NULL AND bh IS DISTINCT FROM now_hash THEN 'targetChanged' WHEN k IN ('create', 'rename', 'move') AND taken AND bp IS DISTINCT FROM ap THEN 'destinationExists' ELSE 'none' END AS fault FROM j
""")
def preflight_states(spark, d):
    """What the present files would say to every kept operation if it were to be done now."""
    seen = table(spark, d, "indexed_documents").select("workspace_id", "relative_path", "content_hash")
    h = _history(spark, d, "workspace_id", "operation_kind", "before_path", "before_hash", "after_path")
    return history.state_faults(h, seen, "workspace_id", "relative_path", "content_hash").select("history_id", F.coalesce("fault", F.lit("none")).alias("fault"))


@query(f"WITH {_H} SELECT plan_id, operation_kind, count(*) AS operations, count(DISTINCT file_id) AS files FROM h GROUP BY 1, 2")
def plan_review(spark, d):
    return history.plan_review(_history(spark, d, "plan_id", "operation_kind", "file_id"), "plan_id", "operation_kind", "file_id")


@query(f"""
WITH c AS (SELECT DISTINCT chunk_id, document_id, ordinal FROM chunks), {_INDEXED}, n AS (SELECT document_id, count(*) AS passages FROM c WHERE document_id IN (SELECT document_id FROM ix) GROUP BY 1)
SELECT document_id, passages, least(passages, 32) AS covered, least((passages + 3) // 4, 8)::BIGINT AS stages, passages > 32 AS partial FROM n
""")
def summary_stages(spark, d):
    """How many groups of passages a summary of each document reads, and whether it is a partial one."""
    c = table(spark, d, "chunks").select("chunk_id", "document_id", "ordinal").distinct().join(_indexed(spark, d), "document_id", "left_semi")
    told = answers.summary_groups(c, "document_id", "ordinal, chunk_id").groupBy("document_id").agg(F.count("*").alias("passages"), F.count_if("covered").alias("covered"), F.count_distinct(F.when(F.col("covered"), F.col("stage"))).alias("stages"))
    return told.withColumn("partial", F.col("covered") < F.col("passages"))


@query("""
WITH o AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN '```json' || chr(10) || props || chr(10) || '```' WHEN 2 THEN '  ' || props || chr(10) ELSE 'Sure! ' || props END AS said FROM events),
j AS (SELECT event_id, CASE WHEN starts_with(trim(said, ' ' || chr(10)), '```json') THEN trim(substr(trim(said, ' ' || chr(10)), 8, length(trim(said, ' ' || chr(10))) - 10), ' ' || chr(10)) ELSE trim(said, ' ' || chr(10)) END AS body FROM o)
SELECT event_id, CASE WHEN json_valid(body) THEN json_extract_string(body, '$.k') END AS k, json_valid(body) AS valid FROM j
""")
def model_outputs(spark, d):
    """Fields of what models said: plain JSON, JSON in a fence, JSON with white space, and talk, which is not valid; made of event properties."""
    props, odd = F.col("props"), F.col("event_id") % 4
    said = F.when(odd == 0, props).when(odd == 1, F.concat(F.lit("```json\n"), props, F.lit("\n```"))).when(odd == 2, F.concat(F.lit("  "), props, F.lit("\n"))).otherwise(F.concat(F.lit("Sure! "), props))
    body = T.model_json(said)
    return table(spark, d, "events").select("event_id", F.get_json_object(body, "$.k").alias("k"), body.isNotNull().alias("valid"))


# the tables hold no failures of earlier scans: these are made of the ids
_BEFORE = "SELECT DISTINCT file_id, size_bytes, modified_at, content_hash, status, (file_id % 6)::INTEGER AS failures, 1000000 - (file_id % 40) * 60000 AS failed_ms FROM indexed_documents"
_NOW = "SELECT DISTINCT t.file_id, t.size_bytes, t.modified_at, t.content_hash, media_type <> 'application/pdf' OR len(coalesce(unreadable_pages, [])) = 0 AS supported FROM document_texts t JOIN (SELECT file_id, min(media_type) AS media_type FROM indexed_documents GROUP BY 1) m USING (file_id)"
_SCAN = f"""
be AS ({_BEFORE}), nw AS ({_NOW}),
sc AS (SELECT coalesce(be.file_id, nw.file_id) AS file_id, be.status, failures, failed_ms, supported, nw.size_bytes IS NOT DISTINCT FROM be.size_bytes AND nw.modified_at IS NOT DISTINCT FROM be.modified_at AS same,
  CASE WHEN nw.file_id IS NULL THEN 'removed' WHEN be.file_id IS NULL THEN CASE WHEN nw.content_hash IS NULL THEN 'failed' ELSE 'added' END WHEN nw.content_hash IS NULL THEN CASE WHEN status IN ('indexed', 'stale') THEN 'stale' ELSE 'failed' END
  WHEN nw.size_bytes IS NOT DISTINCT FROM be.size_bytes AND nw.modified_at IS NOT DISTINCT FROM be.modified_at AND status = 'indexed' THEN 'unchanged' WHEN nw.content_hash = be.content_hash AND status <> 'failed' THEN 'metadata' ELSE 'updated' END AS outcome FROM be FULL JOIN nw ON be.file_id = nw.file_id),
wt AS (SELECT *, CASE WHEN failures <= 2 THEN 0 ELSE least(600000 * (1::BIGINT << least(failures - 3, 16)::INT), 21600000) END AS wait FROM sc),
so AS (SELECT file_id, CASE WHEN outcome = 'removed' THEN 'removed' WHEN status IN ('stale', 'failed') AND same AND 1000000 - failed_ms < wait AND file_id % 20 <> 0 THEN CASE status WHEN 'stale' THEN 'deferredStale' ELSE 'deferredFailed' END WHEN outcome <> 'unchanged' AND NOT supported THEN 'unsupported' ELSE outcome END AS outcome FROM wt)"""


def _scanned(spark, d):
    before = table(spark, d, "indexed_documents").select("file_id", "size_bytes", "modified_at", "content_hash", "status", (F.col("file_id") % 6).cast("int").alias("failures"), (F.lit(1_000_000) - (F.col("file_id") % 40) * 60_000).alias("failed_ms")).distinct()
    kinds = table(spark, d, "indexed_documents").groupBy("file_id").agg(F.min("media_type").alias("media_type"))
    supported = (F.col("media_type") != "application/pdf") | (F.size(F.coalesce("unreadable_pages", F.array().cast("array<int>"))) == 0)
    now = table(spark, d, "document_texts").select("file_id", "size_bytes", "modified_at", "content_hash", "unreadable_pages").join(kinds, "file_id").select("file_id", "size_bytes", "modified_at", "content_hash", supported.alias("supported")).distinct()
    asked = before.filter(F.col("file_id") % 20 == 0).select("file_id")
    return scan.retry_outcomes(before, now, "file_id", F.lit(1_000_000), F.col("supported"), asked)


@query(f"WITH {_SCAN} SELECT file_id, outcome FROM so")
def scan_with_retries(spark, d):
    """Outcomes of a scan that does not read again what has failed lately, unless asked to (ids divisible by 20); the tables
    hold no failures of earlier scans, so these are made of the ids, and a PDF with unreadable pages stands for an unsupported file."""
    return _scanned(spark, d)


@query(f"""
WITH {_SCAN}, ct AS (SELECT count(*) FILTER (WHERE outcome = 'added') AS added, count(*) FILTER (WHERE outcome IN ('updated', 'metadata')) AS updated, count(*) FILTER (WHERE outcome = 'removed') AS removed, count(*) FILTER (WHERE outcome = 'unchanged') AS unchanged, count(*) FILTER (WHERE outcome = 'unsupported') AS unsupported,
  count(*) FILTER (WHERE outcome IN ('failed', 'deferredFailed')) AS failed, count(*) FILTER (WHERE outcome IN ('stale', 'deferredStale')) AS stale, count(*) FILTER (WHERE outcome LIKE 'deferred%') AS deferred, count(*) FILTER (WHERE outcome = 'deferredFailed') AS df FROM so)
SELECT added, updated, removed, unchanged, unsupported, failed, stale, deferred, added + updated + removed + unsupported + failed - df > 0 AS relink FROM ct
""")
def scan_counters(spark, d):
    return scan.scan_counters(_scanned(spark, d))


@query("""
WITH f AS (SELECT DISTINCT file_id, status, modified_at, failures, CASE WHEN file_id % 3 = 0 THEN 'other' ELSE 'sig' END AS was FROM (SELECT file_id, status, modified_at, (file_id % 6)::INTEGER AS failures FROM indexed_documents) WHERE file_id NOT IN (SELECT file_id FROM document_texts)),
n AS (SELECT *, CASE WHEN status IN ('stale', 'failed') AND was = 'sig' THEN failures + 1 ELSE 1 END AS now FROM f)
SELECT DISTINCT file_id, CASE WHEN status IN ('indexed', 'stale') THEN 'stale' ELSE 'failed' END AS status, now::INTEGER AS failures, CASE WHEN now > 2 THEN 1000000 + least(600000 * (1::BIGINT << least(now - 3, 16)::INT), 21600000) END::BIGINT AS retry_after_ms FROM n
""")
def recorded_failures(spark, d):
    """What is written down about the files without a text; earlier failures and signatures are made of the ids."""
    files = table(spark, d, "indexed_documents").select("file_id", "status").distinct()
    lost = files.join(table(spark, d, "document_texts").select("file_id"), "file_id", "left_anti")
    before = lost.select("file_id", "status", (F.col("file_id") % 6).cast("int").alias("failures"), F.when(F.col("file_id") % 3 == 0, "other").otherwise("sig").alias("signature"))
    return scan.recorded_failures(lost.select("file_id", F.lit("sig").alias("signature")), before, "file_id", "signature", F.lit(1_000_000)).withColumn("retry_after_ms", F.col("retry_after_ms").cast("bigint"))


@query(f"""
WITH {_PAIRS}, gn AS (SELECT DISTINCT file_id, document_id FROM indexed_documents WHERE status = 'failed'), c AS (SELECT DISTINCT chunk_id, document_id FROM chunks), k AS (SELECT * FROM c WHERE document_id NOT IN (SELECT document_id FROM gn))
SELECT 'chunks' AS kind, count(*) AS kept FROM k UNION ALL SELECT 'vectors', count(*) FROM (SELECT DISTINCT chunk_id, space_id FROM chunk_vectors) WHERE chunk_id IN (SELECT chunk_id FROM k) UNION ALL SELECT 'relations', count(*) FROM rel WHERE source NOT IN (SELECT file_id FROM gn) AND target NOT IN (SELECT file_id FROM gn)
""")
def cleared_derived(spark, d):
    """What is left of derived rows when those of failed files are cleared: passages, with them their vectors, and relations at either end."""
    gone = table(spark, d, "indexed_documents").filter("status = 'failed'").select("file_id", "document_id").distinct()
    chunks = scan.without_derived(table(spark, d, "chunks").select("chunk_id", "document_id").distinct(), gone, "document_id")
    vectors = table(spark, d, "chunk_vectors").select("chunk_id", "space_id").distinct().join(chunks, "chunk_id", "left_semi")
    edges = scan.without_derived(_relations(spark, d), gone, "source", "target", name="file_id")
    rows = [df.agg(F.count("*").alias("kept")).select(F.lit(kind).alias("kind"), "kept") for kind, df in (("chunks", chunks), ("vectors", vectors), ("relations", edges))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(f"WITH {_H} SELECT operation_kind AS model, CASE WHEN undone_at IS NOT NULL THEN 'undone' ELSE 'kept' END AS outcome, count(*) AS n FROM h GROUP BY 1, 2")
def outcome_counts(spark, d):
    """Outcomes per model; kinds of operation stand for models, of which the tables have no runs."""
    h = _history(spark, d, "operation_kind", "undone_at").select(F.col("operation_kind").alias("model"), F.when(F.col("undone_at").isNotNull(), "undone").otherwise("kept").alias("outcome"))
    return lab.outcome_counts(h, "model", "outcome")


@query(r"""
WITH t AS (SELECT DISTINCT file_id, content FROM document_texts WHERE contains(content, '](')),
m AS (SELECT file_id, regexp_extract_all(content, '\[([^\]]+)\]\(([^)]+)\)', 0) AS ms, regexp_extract_all(content, '\[([^\]]+)\]\(([^)]+)\)', 1) AS ls, regexp_extract_all(content, '\[([^\]]+)\]\(([^)]+)\)', 2) AS ts, string_split_regex(content, '\[[^\]]+\]\([^)]+\)') AS ps FROM t),
e AS (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM m)
SELECT file_id, i::INTEGER AS n, ls[i] AS label, ts[i] AS target, (list_sum(list_transform(ps[1:i], lambda x: strlen(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: strlen(x))), 0))::BIGINT AS start_byte, (list_sum(list_transform(ps[1:i], lambda x: strlen(x))) + list_sum(list_transform(ms[1:i], lambda x: strlen(x))))::BIGINT AS end_byte FROM e
""")
def link_ranges(spark, d):
    """Every link with its label and the bytes it stands at."""
    texts = table(spark, d, "document_texts").filter("contains(content, '](')").select("file_id", F.posexplode(T.link_ranges(F.col("content"))).alias("n", "x"))
    return texts.select("file_id", (F.col("n") + 1).alias("n"), "x.label", "x.target", F.col("x.start").alias("start_byte"), F.col("x.end").alias("end_byte")).distinct()
