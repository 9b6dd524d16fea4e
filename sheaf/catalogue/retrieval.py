"""Keyword, boolean, vector and hybrid search, and its measurement."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T, vectors as V
from ..operators import lab, search
from ..sources.tables import table
from . import query
from .library import FOLDED, TOKENS

WORDS = "budget report ng barangay"
_TERMS = search.terms_of(WORDS)
_C = "c AS (SELECT DISTINCT chunk_id, document_id, ordinal, chunk_text FROM chunks)"


def _chunks(spark, d):
    return table(spark, d, "chunks").select("chunk_id", "document_id", "ordinal", "chunk_text").distinct()


def _bm25_sql(normalised: bool) -> str:
    """The ranking as SQL: tokens, document frequencies, weights, scores."""
    values = ", ".join(f"('{t}', {'TRUE' if t in T.STOP_WORDS else 'FALSE'})" for t in _TERMS)
    weight = "CASE WHEN q.stop OR df >= greatest(n * 0.9, 2) THEN 0 ELSE ln(1 + (n - df + 0.5) / (df + 0.5)) END" if normalised else "greatest(1e-6, ln((n - df + 0.5) / (df + 0.5)))"
    score = "CASE WHEN (SELECT sum(w) FROM wt) > 0 THEN least(1, s / (SELECT sum(w) FROM wt)) ELSE 0 END" if normalised else "s"
    return f"""
{_C}, t AS (SELECT *, {TOKENS.format(x='chunk_text')} AS toks FROM c),
q AS (SELECT * FROM (VALUES {values}) v(term, stop)),
st AS (SELECT count(*) AS n, greatest(avg(len(toks)), 1) AS al FROM t),
df AS (SELECT q.term, q.stop, count(*) FILTER (WHERE list_contains(toks, q.term)) AS df FROM t CROSS JOIN q GROUP BY ALL),
wt AS (SELECT q.term, {weight} AS w FROM df q CROSS JOIN st),
tf AS (SELECT t.chunk_id, len(toks) AS dl, term, w, len(list_filter(toks, lambda x: x = term)) AS tf FROM t CROSS JOIN wt),
r AS (SELECT chunk_id, sum(CASE WHEN tf > 0 THEN w * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / al)) ELSE 0 END) AS s FROM tf CROSS JOIN st GROUP BY chunk_id),
b AS (SELECT chunk_id, {score} AS score FROM r)"""


@query(f"WITH {_bm25_sql(True)} SELECT chunk_id, round(score, 6) AS score FROM b WHERE score > 0")
def bm25_normalised(spark, d):
    return search.bm25(table(spark, d, "chunks"), ["chunk_id"], "chunk_text", WORDS).filter("score > 0").select("chunk_id", F.round("score", 6).alias("score"))


@query(f"WITH {_bm25_sql(False)} SELECT chunk_id, round(score, 6) AS score FROM b WHERE score > 0")
def fts_rank(spark, d):
    return search.bm25(table(spark, d, "chunks"), ["chunk_id"], "chunk_text", WORDS, normalised=False).filter("score > 0").select("chunk_id", F.round("score", 6).alias("score"))


@query(f"WITH {_C} SELECT term, chunk_id, count(*)::INTEGER AS tf, n::INTEGER AS length FROM (SELECT chunk_id, len({TOKENS.format(x='chunk_text')}) AS n, unnest({TOKENS.format(x='chunk_text')}) AS term FROM c) GROUP BY term, chunk_id, n")
def postings(spark, d):
    """The inverted index: what a written index would hold."""
    return search.postings(table(spark, d, "chunks").select("chunk_id", "chunk_text").dropDuplicates(["chunk_id"]), "chunk_id", "chunk_text")


@query(f"WITH {_bm25_sql(False)} SELECT chunk_id, round(score, 6) AS score FROM b WHERE score > 0")
def postings_rank(spark, d):
    """The full-text rank read from an inverted index that is written first, divided by term."""
    import uuid

    from ..plans.staging import shared_dir

    place = f"{shared_dir(spark)}/sheaf-postings-{uuid.uuid4().hex}"
    chunks = table(spark, d, "chunks").select("chunk_id", "chunk_text").dropDuplicates(["chunk_id"])
    part = F.pmod(F.xxhash64("term"), F.lit(64))
    search.postings(chunks, "chunk_id", "chunk_text").withColumn("part", part).write.partitionBy("part").parquet(f"{place}/terms")
    search.lengths_of(chunks, "chunk_id", "chunk_text").write.parquet(f"{place}/lengths")
    parts = [r[0] for r in spark.createDataFrame([(t,) for t in _TERMS], "term string").select(part).distinct().collect()]
    index = spark.read.parquet(f"{place}/terms").filter(F.col("part").isin(parts))
    found = search.ranked_postings(index, spark.read.parquet(f"{place}/lengths"), "chunk_id", WORDS)
    return found.filter("score > 0").select("chunk_id", F.round("score", 6).alias("score"))


@query(f"""
WITH {_C}, t AS (SELECT *, {TOKENS.format(x='chunk_text')} AS toks FROM c), h AS (SELECT * FROM t WHERE list_has_any(toks, [{", ".join(f"'{t}'" for t in _TERMS)}]))
SELECT round((SELECT avg(length(chunk_text)) FROM c), 6) AS average_chars, sum(len(toks))::BIGINT AS tokens, sum(length(chunk_text))::BIGINT AS chars, round((SELECT avg(length(chunk_text)) FROM c) * sum(len(toks)) / sum(length(chunk_text)), 6) AS average_length FROM h
""")
def estimated_length(spark, d):
    told = search.estimated_length(table(spark, d, "chunks"), ["chunk_id"], "chunk_text", WORDS)
    return told.select(F.round("average_chars", 6).alias("average_chars"), "tokens", "chars", F.round("average_length", 6).alias("average_length"))


@query(f"""
WITH {_bm25_sql(False)},
s AS (SELECT b.chunk_id, document_id, round(score, 9) AS score FROM b JOIN c USING (chunk_id) WHERE score > 0 ORDER BY round(score, 9) DESC, chunk_id LIMIT 160),
g AS (SELECT document_id, max(score) AS doc_score FROM s GROUP BY 1 ORDER BY doc_score DESC, document_id LIMIT 20),
k AS (SELECT document_id, doc_score, row_number() OVER (ORDER BY doc_score DESC, document_id) AS doc_rank FROM g),
p AS (SELECT s.*, doc_rank, row_number() OVER (PARTITION BY s.document_id ORDER BY score DESC, chunk_id) AS passage_rank FROM s JOIN k USING (document_id))
SELECT document_id, chunk_id, doc_rank, passage_rank, round(score, 6) AS score FROM p WHERE passage_rank <= 3
""")
def keyword_search(spark, d):
    """The flagship: the passages best by full-text rank, capped, grouped to the twenty best documents with at most three
    passages each."""
    scored = search.bm25(table(spark, d, "chunks"), ["chunk_id", "document_id"], "chunk_text", WORDS, normalised=False).withColumn("score", F.round("score", 9))
    found = search.capped_then_grouped(scored, "document_id", "chunk_id", 20)
    return found.select("document_id", "chunk_id", F.col("doc_rank").cast("bigint").alias("doc_rank"), F.col("passage_rank").cast("bigint").alias("passage_rank"), F.round("score", 6).alias("score"))


@query(f"""
WITH {_bm25_sql(False)},
h AS (SELECT DISTINCT document_id, content_hash FROM indexed_documents WHERE content_hash IS NOT NULL),
g AS (SELECT document_id, max(round(score, 9)) AS doc_score FROM b JOIN c USING (chunk_id) WHERE score > 0 GROUP BY 1),
k AS (SELECT document_id, content_hash, doc_score, row_number() OVER (ORDER BY doc_score DESC, document_id) AS rank FROM g JOIN h USING (document_id)),
f AS (SELECT content_hash, row_number() OVER (ORDER BY min(rank)) AS place FROM k GROUP BY 1 ORDER BY min(rank) LIMIT 10)
SELECT document_id, content_hash, place, round(doc_score, 6) AS doc_score FROM k JOIN f USING (content_hash)
""")
def distinct_content_limit(spark, d):
    """Documents of the first ten different contents; copies ride along.  Only those ten are put in order."""
    scored = search.bm25(table(spark, d, "chunks"), ["chunk_id", "document_id"], "chunk_text", WORDS, normalised=False).filter("score > 0").groupBy("document_id").agg(F.max(F.round("score", 9)).alias("score"))
    hashes = table(spark, d, "indexed_documents").filter("content_hash IS NOT NULL").select("document_id", "content_hash").distinct()
    ranked = scored.join(hashes, "document_id")
    first = search.first_contents(ranked, "content_hash", "document_id", 10)
    return ranked.join(F.broadcast(first), "content_hash").select("document_id", "content_hash", F.col("place").cast("bigint").alias("place"), F.round("score", 6).alias("doc_score"))


@query(f"""
WITH {_C} SELECT chunk_id, round(len(list_intersect(list_distinct({TOKENS.format(x='chunk_text')}), [{", ".join(f"'{t}'" for t in _TERMS)}])) / {len(_TERMS)}.0, 6) AS overlap FROM c
""")
def term_overlap_search(spark, d):
    return table(spark, d, "chunks").select("chunk_id", F.round(search.term_overlap(F.col("chunk_text"), WORDS), 6).alias("overlap")).distinct()


def _count_sql(column: str, term: str) -> str:
    """Whole-token occurrences: the number of cuts at the term, with its neighbours looked at."""
    return f"len(list_filter(range(1, length({column}) + 1), lambda i: substr({column}, i, {len(term)}) = '{term}' AND NOT regexp_matches(substr(' ' || {column}, i, 1), '[\\p{{L}}\\p{{N}}_]') AND NOT regexp_matches(substr({column} || ' ', i + {len(term)}, 1), '[\\p{{L}}\\p{{N}}_]')))"


def _operator_sql(text: str) -> str:
    q = search.parse(text)
    keep, score = ["TRUE"], ["0.0"]
    if q.filetypes:
        keep.append(f"CASE WHEN contains(name, '.') THEN lower(list_extract(string_split(name, '.'), -1)) ELSE '' END IN ({', '.join(repr(x) for x in q.filetypes)})")
    if q.folders:
        at = FOLDED.format(x="CASE WHEN contains(relative_path, '/') THEN regexp_replace(relative_path, '/[^/]*$', '') ELSE '' END")
        keep.append("(" + " OR ".join(f"contains('/' || {at} || '/', '/{x}/')" for x in q.folders) + ")")
    cols, n = [], 0

    def count(column, term):
        nonlocal n
        n += 1
        cols.append(f"CASE WHEN contains({column}, '{term}') THEN {_count_sql(column, term)} ELSE 0 END AS n{n}")
        return f"n{n}"

    for term in q.in_title:
        a = count("tt", term)
        keep.append(f"{a} > 0")
        score.append(f"5.0 + {a}")
    for clause in q.clauses:
        met = []
        for term in clause:
            a, b = count("tt", term), count("body", term)
            met.append(f"{a} + {b} > 0")
            score.append(f"3.0 * least({a}, 1) + least({b}, 20)")
        keep.append("(" + " OR ".join(met) + ")")
    for term in q.excluded:
        a, b = count("tt", term), count("body", term)
        keep.append(f"{a} + {b} = 0")
    label = FOLDED.format(x="name || ' ' || coalesce(title, name)")
    return f"""
WITH f AS (SELECT DISTINCT file_id, name, title, relative_path FROM indexed_documents WHERE status = 'indexed'),
t AS (SELECT DISTINCT file_id, content FROM document_texts),
x AS (SELECT f.*, {label} AS lab, {FOLDED.format(x="coalesce(content, '')")} AS body FROM f LEFT JOIN t USING (file_id)),
y AS (SELECT *, lab || ' ' || replace(lab, '_', ' ') AS tt FROM x),
z AS (SELECT *, {', '.join(cols) if cols else '0 AS n0'} FROM y)
SELECT file_id, round({' + '.join(score)}, 6) AS score FROM z WHERE {' AND '.join(keep)}"""


def _operator(spark, d, text: str):
    files = table(spark, d, "indexed_documents").filter("status = 'indexed'").select("file_id", "name", "title", "relative_path").distinct()
    texts = table(spark, d, "document_texts").select("file_id", "content")
    found = search.operator_search(files.join(texts, "file_id", "left"), search.parse(text), F.col("name"), F.col("title"), F.col("relative_path"), F.col("content"))
    # texts delivered twice give equal rows: the narrow result is made distinct, not the texts
    return found.select("file_id", F.round("score", 6).alias("score")).distinct()


def _register(name: str, text: str) -> None:
    def run(spark, d):
        return _operator(spark, d, text)
    run.__name__ = name
    query(_operator_sql(text))(run)


_register("operator_and", '"budget" fence')
_register("operator_or_not", "permit OR kontrata AND receipt -luggage")
_register("operator_phrase", '"the budget for the" -bago')
_register("operator_intitle", "intitle:checklist")
_register("operator_filetype_folder", "filetype:md in:notes reviewers OR pulong")


@query("""
WITH s AS (SELECT DISTINCT * FROM chunk_scores WHERE cosine IS NOT NULL AND NOT isnan(cosine)),
g AS (SELECT query_chunk_id, count(*) AS n, max(cosine)::DOUBLE AS top, median(cosine::DOUBLE) AS med FROM s GROUP BY 1)
SELECT query_chunk_id, n, round(top, 5) AS top, round(med, 5) AS median, top >= 0.813 AND (n < 5 OR top - med >= 0.031) AS passed FROM g
""")
def evidence_gate(spark, d):
    scores = table(spark, d, "chunk_scores").distinct().withColumn("cosine", F.col("cosine").cast("double"))
    return search.evidence_gate(scores, "query_chunk_id", "cosine").select("query_chunk_id", "n", F.round("top", 5).alias("top"), F.round("median", 5).alias("median"), "passed")


@query("""
WITH s AS (SELECT DISTINCT query_chunk_id, document_id, ordinal, cosine::DOUBLE AS cosine, CASE WHEN keyword IS NULL OR isnan(keyword) THEN 0 ELSE keyword::DOUBLE END AS keyword FROM chunk_scores WHERE cosine IS NOT NULL AND NOT isnan(cosine)),
g AS (SELECT query_chunk_id, max(cosine) >= 0.813 AND (count(*) < 5 OR max(cosine) - median(cosine) >= 0.031) AS passed FROM s GROUP BY 1),
a AS (SELECT s.*, cosine + 0.01 * keyword AS fused FROM s JOIN g USING (query_chunk_id) WHERE (passed AND cosine >= 0.35) OR keyword >= 0.5),
b AS (SELECT query_chunk_id, document_id, max(round(fused, 6)) AS doc_score, count(*) AS passages FROM a GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_chunk_id ORDER BY doc_score DESC, document_id) AS rank FROM b)
SELECT query_chunk_id, document_id, doc_score, passages, rank FROM r WHERE rank <= 10
""")
def hybrid_top(spark, d):
    """Cosine with the keyword tie-break over admitted passages, the ten best documents of each query.

    A passage is admitted by its cosine only if the query passes the evidence gate, or by its keyword score.
    """
    s = table(spark, d, "chunk_scores").select("query_chunk_id", "document_id", "ordinal", F.col("cosine").cast("double").alias("cosine"), F.nanvl(F.coalesce("keyword", F.lit(0.0)).cast("double"), F.lit(0.0)).alias("keyword")).filter("cosine IS NOT NULL AND NOT isnan(cosine)").distinct()
    gate = search.evidence_gate(s, "query_chunk_id", "cosine").select("query_chunk_id", "passed")
    a = s.join(gate, "query_chunk_id").filter("(passed AND cosine >= 0.35) OR keyword >= 0.5").withColumn("fused", F.round(V.fused(F.col("cosine"), F.col("keyword")), 6))
    b = a.groupBy("query_chunk_id", "document_id").agg(F.max("fused").alias("doc_score"), F.count("*").alias("passages"))
    r = b.withColumn("rank", F.expr("row_number() OVER (PARTITION BY query_chunk_id ORDER BY doc_score DESC, document_id)").cast("bigint"))
    return r.filter("rank <= 10").select("query_chunk_id", "document_id", "doc_score", "passages", "rank")


@query("""
WITH c AS (SELECT DISTINCT cosine::DOUBLE AS c, query_chunk_id, document_id, ordinal FROM chunk_scores WHERE cosine IS NOT NULL AND NOT isnan(cosine))
SELECT count(*) AS n, round(max(c), 5) AS top, round(median(c), 5) AS median, max(c) >= 0.813 AND (count(*) < 5 OR max(c) - median(c) >= 0.031) AS passed FROM c
""")
def scope_gate(spark, d):
    """The gate over all kept cosines as if of one search: the median by counting, not by sorting."""
    s = table(spark, d, "chunk_scores").select("query_chunk_id", "document_id", "ordinal", "cosine").distinct()
    return search.scope_gate(s, "cosine").select("n", F.round("top", 5).alias("top"), F.round("median", 5).alias("median"), "passed")


@query("""
WITH v AS (SELECT DISTINCT chunk_id, vector FROM chunk_vectors WHERE space_id = 'space-main' AND vector IS NOT NULL AND len(vector) = 64),
u AS (SELECT chunk_id, vector::DOUBLE[] AS v FROM v WHERE len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND list_dot_product(vector::DOUBLE[], vector::DOUBLE[]) > 0),
q AS (SELECT v AS qv, chunk_id AS qid FROM u ORDER BY chunk_id LIMIT 1)
SELECT chunk_id, round(list_cosine_similarity(v, qv), 5) AS cosine FROM u, q WHERE chunk_id <> qid ORDER BY round(list_cosine_similarity(v, qv), 9) DESC, chunk_id LIMIT 25
""")
def vector_top(spark, d):
    """The 25 chunks most similar to one query vector: a scan, a top-k and a broadcast of one row.

    A report on a single vector, that of the smallest chunk_id of space-main, and not a search for many queries:
    p1_neighbors answers for every chunk_id divisible by 20 of all spaces, by graph.
    """
    v = table(spark, d, "chunk_vectors").filter("space_id = 'space-main'").select("chunk_id", "vector").filter(V.usable(F.col("vector"), F.lit(64)))
    q = v.orderBy("chunk_id").limit(1).select(F.col("vector").alias("qv"), F.col("chunk_id").alias("qid"))
    # repeated rows give equal numbers: these are made distinct, not the vectors
    near = v.join(F.broadcast(q), F.col("chunk_id") != F.col("qid")).select("chunk_id", F.round(V.cosine(F.col("vector"), F.col("qv")), 9).alias("c")).distinct()
    return near.orderBy(F.desc("c"), "chunk_id").limit(25).select("chunk_id", F.round("c", 5).alias("cosine"))


@query("""
WITH v AS (SELECT DISTINCT chunk_id, space_id, vector FROM chunk_vectors)
SELECT space_id, CASE WHEN vector IS NULL THEN 'missing' WHEN len(vector) <> dimensions THEN 'cut off' WHEN len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) > 0 THEN 'not finite' WHEN list_dot_product(vector::DOUBLE[], vector::DOUBLE[]) = 0 THEN 'zero' ELSE 'usable' END AS state, count(*) AS vectors
FROM v JOIN embedding_spaces USING (space_id) GROUP BY 1, 2
""")
def vector_states(spark, d):
    v = table(spark, d, "chunk_vectors").select("chunk_id", "space_id", "vector")
    s = table(spark, d, "embedding_spaces").select("space_id", "dimensions")
    odd = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    state = F.when(F.col("vector").isNull(), "missing").when(F.size("vector") != F.col("dimensions"), "cut off").when(odd, "not finite").when(V.norm(F.col("vector")) == 0, "zero").otherwise("usable")
    return v.join(s, "space_id").select("space_id", "chunk_id", state.alias("state")).distinct().groupBy("space_id", "state").agg(F.count("*").alias("vectors"))


@query(f"""
WITH {_C}, v AS (SELECT DISTINCT chunk_id FROM chunk_vectors WHERE space_id = 'space-main' AND vector IS NOT NULL), f AS (SELECT DISTINCT document_id FROM indexed_documents WHERE status IN ('indexed', 'stale'))
SELECT chunk_id, document_id, ordinal FROM c WHERE document_id IN (SELECT document_id FROM f) AND chunk_id NOT IN (SELECT chunk_id FROM v)
""")
def pending_embeddings(spark, d):
    v = table(spark, d, "chunk_vectors").filter("space_id = 'space-main' AND vector IS NOT NULL").select("chunk_id")
    f = table(spark, d, "indexed_documents").filter("status IN ('indexed', 'stale')").select("document_id")
    return _chunks(spark, d).join(f, "document_id", "left_semi").join(v, "chunk_id", "left_anti").select("chunk_id", "document_id", "ordinal")


@query("""
WITH c AS (SELECT DISTINCT chunk_id, workspace_id FROM chunks), v AS (SELECT DISTINCT chunk_id FROM chunk_vectors WHERE space_id = 'space-main' AND vector IS NOT NULL)
SELECT workspace_id, count(*) AS chunks, count(v.chunk_id) AS embedded, CASE WHEN count(*) = count(v.chunk_id) THEN 'hybrid' ELSE 'keyword' END AS method FROM c LEFT JOIN v USING (chunk_id) GROUP BY 1
""")
def embedding_coverage(spark, d):
    c = table(spark, d, "chunks").select("chunk_id", "workspace_id").distinct()
    v = table(spark, d, "chunk_vectors").filter("space_id = 'space-main' AND vector IS NOT NULL").select("chunk_id", F.lit(1).alias("has")).distinct()
    told = c.join(v, "chunk_id", "left").groupBy("workspace_id").agg(F.count("*").alias("chunks"), F.count("has").alias("embedded"))
    return told.withColumn("method", F.when(F.col("chunks") == F.col("embedded"), "hybrid").otherwise("keyword"))


@query("""
WITH c AS (SELECT DISTINCT chunk_id, document_id FROM chunks), v AS (SELECT DISTINCT chunk_id FROM chunk_vectors WHERE space_id = 'space-main' AND vector IS NOT NULL)
SELECT document_id, count(*) AS chunks FROM c LEFT JOIN v USING (chunk_id) GROUP BY 1 HAVING bool_and(v.chunk_id IS NOT NULL)
""")
def eligible_documents(spark, d):
    """Relational division: documents every chunk of which has a vector."""
    c = table(spark, d, "chunks").select("chunk_id", "document_id").distinct()
    v = table(spark, d, "chunk_vectors").filter("space_id = 'space-main' AND vector IS NOT NULL").select("chunk_id", F.lit(True).alias("has")).distinct()
    return c.join(v, "chunk_id", "left").groupBy("document_id").agg(F.count("*").alias("chunks"), F.bool_and(F.coalesce("has", F.lit(False))).alias("all")).filter("all").select("document_id", "chunks")


@query("""
WITH s AS (SELECT DISTINCT query_chunk_id, document_id, ordinal, cosine, fused FROM chunk_scores),
h AS (SELECT document_id, min(content_hash) AS hash FROM indexed_documents GROUP BY 1),
w AS (SELECT query_chunk_id, document_id, max(fused::DOUBLE) AS f, max(cosine::DOUBLE) FILTER (WHERE NOT isnan(cosine)) AS c FROM s WHERE fused IS NOT NULL AND NOT isnan(fused) GROUP BY 1, 2),
r AS (SELECT w.*, coalesce('h' || hash, 'd' || w.document_id) AS content, row_number() OVER (PARTITION BY query_chunk_id ORDER BY f DESC, w.document_id) AS rank FROM w LEFT JOIN h ON h.document_id = w.document_id),
d AS (SELECT query_chunk_id, content, row_number() OVER (PARTITION BY query_chunk_id ORDER BY min(rank)) AS place FROM r GROUP BY 1, 2),
t AS (SELECT r.*, place <= 5 AS top FROM r JOIN d USING (query_chunk_id, content))
SELECT query_chunk_id, count(*) FILTER (WHERE c >= 0.6) AS relevant, count(*) FILTER (WHERE c >= 0.6 AND top) AS found, round(count(*) FILTER (WHERE c >= 0.6 AND top) / count(*) FILTER (WHERE c >= 0.6), 6) AS recall,
  count(*) FILTER (WHERE c >= 0.6 AND top) = count(*) FILTER (WHERE c >= 0.6) AS all_found, CASE WHEN count(*) FILTER (WHERE c < 0.3) > 0 THEN count(*) FILTER (WHERE c < 0.3 AND top) = 0 END AS no_negative
FROM t GROUP BY 1 HAVING count(*) FILTER (WHERE c >= 0.6) > 0
""")
def recall_at_five(spark, d):
    """Retrieval checks of kept score lists: documents from cosine 0.6 on stand for relevant ones, those under 0.3 for negatives."""
    s = table(spark, d, "chunk_scores").distinct().filter("fused IS NOT NULL AND NOT isnan(fused)")
    sound = F.when(~F.isnan("cosine"), F.col("cosine").cast("double"))
    w = s.groupBy("query_chunk_id", "document_id").agg(F.max(F.col("fused").cast("double")).alias("f"), F.max(sound).alias("c"))
    hashes = table(spark, d, "indexed_documents").groupBy("document_id").agg(F.min("content_hash").alias("hash"))
    r = w.join(hashes, "document_id", "left").withColumn("rank", F.expr("row_number() OVER (PARTITION BY query_chunk_id ORDER BY f DESC, document_id)"))
    told = lab.retrieval_checks(r, w.filter("c >= 0.6"), w.filter("c < 0.3"), "query_chunk_id", "document_id", "rank", "hash")
    return told.select("query_chunk_id", "relevant", "found", F.round("recall", 6).alias("recall"), "all_found", "no_negative")


@query("""
WITH c AS (SELECT DISTINCT chunk_id, document_id, ordinal, end_offset - start_offset AS n FROM chunks),
r AS (SELECT *, row_number() OVER w AS k, sum(n) OVER (w ROWS UNBOUNDED PRECEDING) AS total FROM c WINDOW w AS (PARTITION BY document_id ORDER BY ordinal)),
o AS (SELECT *, max(CASE WHEN k > 1 AND (k > 8 OR total > 6400) THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY ordinal ROWS UNBOUNDED PRECEDING) AS over FROM r)
SELECT document_id, count(*) AS held, sum(n)::BIGINT AS bytes FROM o WHERE over = 0 GROUP BY 1
""")
def evidence_budget(spark, d):
    c = table(spark, d, "chunks").select("chunk_id", "document_id", "ordinal", (F.col("end_offset") - F.col("start_offset")).alias("n")).distinct()
    return search.budgeted_prefix(c, "document_id", "ordinal", "n").groupBy("document_id").agg(F.count("*").alias("held"), F.sum("n").alias("bytes"))


@query("""
WITH c AS (SELECT DISTINCT document_id, start_offset AS s, end_offset AS e FROM chunks),
r AS (SELECT *, max(e) OVER (PARTITION BY document_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM c),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM r),
m AS (SELECT document_id, island, min(s) AS s, max(e) AS e FROM i GROUP BY 1, 2)
SELECT document_id, count(*) AS intervals, sum(e - s)::BIGINT AS covered FROM m GROUP BY 1
""")
def interval_coverage(spark, d):
    c = table(spark, d, "chunks").select("document_id", F.col("start_offset").alias("s"), F.col("end_offset").alias("e")).distinct()
    return search.merged_intervals(c, ["document_id"], "s", "e").groupBy("document_id").agg(F.count("*").alias("intervals"), F.sum(F.col("e") - F.col("s")).alias("covered"))


@query("""
WITH t AS (SELECT DISTINCT file_id, content, content_hash FROM document_texts), f AS (SELECT DISTINCT file_id, content_hash AS known, status, language FROM indexed_documents),
k AS (SELECT file_id, CASE WHEN status = 'failed' THEN NULL ELSE t.content_hash = known END AS same, CASE WHEN content = '' THEN NULL ELSE language IS NOT NULL END AS labelled FROM f LEFT JOIN t USING (file_id))
SELECT CASE WHEN same = FALSE OR labelled = FALSE THEN 'failed' WHEN same IS NOT NULL OR labelled IS NOT NULL THEN 'passed' ELSE 'unknown' END AS verdict, count(*) AS files FROM k GROUP BY 1
""")
def tri_state_checks(spark, d):
    t = table(spark, d, "document_texts").select("file_id", "content", "content_hash").distinct()
    f = table(spark, d, "indexed_documents").select("file_id", F.col("content_hash").alias("known"), "status", "language").distinct()
    same = F.when(F.col("status") != "failed", F.col("content_hash") == F.col("known"))
    labelled = F.when(F.coalesce(F.col("content") != "", F.lit(True)), F.col("language").isNotNull())
    return f.join(t, "file_id", "left").groupBy(lab.tri_state([same, labelled]).alias("verdict")).agg(F.count("*").alias("files"))
