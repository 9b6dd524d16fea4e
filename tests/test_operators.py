"""Operators on small frames: semantics, nulls, ties, repeats, empty input."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheaf.functions import text as T, vectors as V
from sheaf.operators import chunking, diffs, facts, history, lab, organize, relations, ripple, scan, search
from sheaf.operators.components import connected_components


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column).first()[0]


@pytest.mark.parametrize("title, slug", [("Ulat ng Pulong!", "ulat-ng-pulong"), ("  --Niño 2 ", "niño-2"), ("", ""), ("***", "")])
def test_slug(spark, title, slug):
    assert one(spark, T.slug_of(F.col("x")), x=title) == slug


@pytest.mark.parametrize("text, title", [("a\n# Head \nb", "Head"), ("\n\n first \n", "first"), ("", None), ("x" * 121 + "\nshort", "short"), ("# \nnext", None)])
def test_title(spark, text, title):
    assert one(spark, T.title_of(F.col("x")), x=text) == title


@pytest.mark.parametrize("text, term, n", [("aa aa aa", "aa aa", 2), ("a_b a", "a", 1), ("budget-budget", "budget", 2), ("c++ c", "c++", 1), ("", "x", 0)])
def test_occurrences(spark, text, term, n):
    assert one(spark, T.occurrences(F.col("x"), term), x=text) == n


@pytest.mark.parametrize("source, link, to", [
    ("a/b/c.md", "../d.md", "a/d.md"), ("a/b/c.md", "./e%20f.md#x", "a/b/e f.md"), ("c.md", "../d.md", None), ("a/c.md", "http://x/y", None), ("a/c.md", "/root.md", None),
    ("a/c.md", "d+e.md", "a/d+e.md"), ("a/c.md", "#top", None), ("a/c.md", "%zz.md", None), ("a/b/c.md", "../../d.md?q", "d.md"),
])
def test_linked_path(spark, source, link, to):
    assert one(spark, T.linked_path(F.col("s"), F.col("l")), s=source, l=link) == to


def test_fold_and_generic(spark):
    assert one(spark, T.fold(F.col("x")), x="  Niño\t CAFÉ ñ ") == "nino cafe n"
    assert one(spark, T.is_generic_stem(F.col("x")), x="Final_draft-2 img0042") is True
    assert one(spark, T.is_generic_stem(F.col("x")), x="budget draft") is False
    assert T.date_variants("October 20") == ["october 20", "oct 20", "oktubre 20"] and T.date_variants("may 20") == ["may 20"]


def test_parse():
    assert search.parse("plain words") is None and search.parse("") is None
    q = search.parse('a OR "b c" -d intitle:E filetype:.md in:/notes/ AND f -intitle:g')
    assert (q.clauses, q.excluded, q.in_title, q.filetypes, q.folders) == ([["a", "b c"], ["f"]], ["d", "g"], ["e"], ["md"], ["notes"])
    assert search.parse("OR x").clauses == [["x"]] and search.parse('"  "').clauses == [] and search.parse("- a") is None


def test_operator_search(spark):
    files = spark.createDataFrame([("budget.md", None, "notes/budget.md", "the budget"), ("x_plan.txt", "Plan", "x_plan.txt", None), (None, None, None, "budget")], "name string, title string, path string, text string")
    find = lambda q: got(search.operator_search(files, search.parse(q), F.col("name"), F.col("title"), F.col("path"), F.col("text")).select("path", "score"))
    assert find("intitle:budget") == [("notes/budget.md", 9.0)]
    assert find("in:notes budget") == [("notes/budget.md", 4.0)]
    assert find('"plan" filetype:txt') == [("x_plan.txt", 3.0)]
    assert find("-budget") == [("x_plan.txt", 0.0)]


def test_bm25_edges(spark):
    empty = spark.createDataFrame([], "id int, t string")
    assert search.bm25(empty, ["id"], "t", "budget").collect() == []
    rows = spark.createDataFrame([(1, "budget budget"), (2, None), (3, "plan"), (4, "the plan"), (5, "x")], "id int, t string")
    scores = {r.id: r.score for r in search.bm25(rows, ["id"], "t", "the budget").collect()}
    assert scores[1] > 0 and scores[2] == scores[3] == scores[4] == 0
    assert {r.score for r in search.bm25(rows, ["id"], "t", " ?! ").collect()} == {0.0}


def test_gate(spark):
    s = spark.createDataFrame([(1, c) for c in (0.9, 0.5, 0.5, 0.5, 0.5)] + [(2, 0.82), (3, None), (3, float("nan")), (4, 0.9), (4, 0.89), (4, 0.89), (4, 0.89), (4, 0.89)], "q int, c double")
    assert {r.q: r.passed for r in search.evidence_gate(s, "q", "c").collect()} == {1: True, 2: True, 4: False}


def test_limit_distinct_contents(spark):
    r = spark.createDataFrame([("a", 1), ("a", 3), ("b", 2), ("c", 4)], "h string, r int")
    assert got(search.limit_distinct_contents(r, "h", "r", 2)) == [("a", 1), ("a", 3), ("b", 2)]


def test_budget_and_intervals(spark):
    p = spark.createDataFrame([(1, i, n) for i, n in enumerate([9000, 10, 10])] + [(2, i, 3000) for i in range(4)], "g int, o int, n int")
    assert got(search.budgeted_prefix(p, "g", "o", "n")) == [(1, 0, 9000), (2, 0, 3000), (2, 1, 3000)]
    s = spark.createDataFrame([(1, 0, 5), (1, 5, 8), (1, 2, 3), (1, 10, 12)], "g int, s int, e int")
    assert sorted((r.s, r.e, r.n) for r in search.merged_intervals(s, ["g"], "s", "e").collect()) == [(0, 8, 3), (10, 12, 1)]


def test_edges(spark):
    e = spark.createDataFrame([("a", f"x{i:02}", 1 - i / 100) for i in range(12)] + [("b", "x11", 0.1)], "a string, b string, s double")
    assert relations.ranked_at_either_end(e, "a", "b", "s", 8).count() == 13
    assert relations.capped_at_both_ends(e, "a", "b", "s", 8).count() == 9
    pairs = relations.graph_pairs(spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 3), (None, 1)], "u int, v int"), "u", "v")
    assert got(pairs) == [(1, 2, 2, True), (2, 3, 1, False)]
    assert got(relations.neighbourhood(pairs, spark.createDataFrame([(1,)], "node int"), 2)) == [(1, 0), (2, 1), (3, 2)]
    assert got(relations.degrees(pairs, spark.createDataFrame([(1,), (2,), (9,)], "node int"))) == [(1, 1), (2, 2), (9, 0)]


def test_pair_coverage(spark):
    seqs = [1, 2, 4, 7]
    cursors = [0, 1, 2, 1]
    df = spark.createDataFrame(list(zip(["w"] * 4, seqs, cursors)), "w string, seq int, cur int")
    r = relations.pair_coverage(df, ["w"], "seq", "cur").first()
    want = sum(1 for s, c in zip(seqs, cursors) for p in seqs if p < s and p <= c)
    assert (r.documents, r.pairs, r.compared, r.state) == (4, 6, want, "partial")


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = np.random.default_rng(seed)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(5, None)]
    root = {n: n for e in edges if e[1] is not None for n in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if b is not None:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    df = spark.createDataFrame(edges, "u long, v long")
    assert got(connected_components(df, "u", "v")) == sorted(((n, find(n)) for n in root), key=repr)
    assert connected_components(df.limit(0), "u", "v").collect() == []


def test_names_and_groups(spark):
    f = spark.createDataFrame([(1, "w", "a.md", "a.md", "New Name", True), (2, "w", "b.md", "b.md", "new name", True), (3, "w", "c.md", "c.md", "D", True), (4, "w", "d.md", "d.md", None, True), (5, "w", "e", "e", "F", True), (6, "w", "g.md", "g.md", "!", True)], "id int, ws string, path string, name string, title string, editable boolean")
    assert got(organize.filename_suggestions(f, "id", "ws", "path", "name", "title")) == [(1, "w", "a.md", "new-name.md")]
    h = spark.createDataFrame([("w", 1, "h"), ("w", 1, "h"), ("w", 2, "h"), ("w", 3, ""), ("w", 4, ""), ("w", 5, None)], "w string, id int, h string")
    assert got(organize.duplicate_groups(h, "w", "id", "h")) == [("w", "h", 2, 1)]


def _linkage_of_all_pairs(vectors, least):
    """Average linkage as it is defined: the best of all pairs of clusters, each time anew."""
    sim = vectors @ vectors.T
    held = {i: [i] for i in range(len(vectors))}
    while len(held) > 1:
        value, a, b = min((-round(sim[np.ix_(held[a], held[b])].mean(), 9), a, b) for a in held for b in held if a < b)
        if -value < least:
            break
        held[a] += held.pop(b)
    return [next(k for k, v in held.items() if i in v) for i in range(len(vectors))]


def test_linkage_of_large_groups(spark):
    rng = np.random.default_rng(5)
    for n, copies in ((40, 1), (24, 3)):
        v = np.repeat(rng.normal(size=(n // copies, 4)), copies, axis=0)
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        assert organize.average_linkage(v, 0.5).tolist() == _linkage_of_all_pairs(v, 0.5)
    v = np.repeat(np.eye(3), 300, axis=0)
    rows = spark.createDataFrame([("big", i, x.tolist()) for i, x in enumerate(v)] + [("small", 1000, [1.0, 0.0, 0.0])], "g string, id long, v array<double>")
    assert set(got(organize.linkage_groups(rows, "g", "id", "v"))) == {("big", i, i // 300 * 300) for i in range(900)} | {("small", 1000, 1000)}


def test_linkage_and_cohesion(spark):
    v = np.array([[1, 0], [0.99, 0.1], [0, 1.0]])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    assert organize.average_linkage(v).tolist() == [0, 0, 2]
    rows = spark.createDataFrame([("g", i, [float(x) for x in r]) for i, r in enumerate(v)] + [("h", 9, [1.0, 0.0])], "g string, id long, v array<double>")
    assert got(organize.linkage_groups(rows, "g", "id", "v")) == [("g", 0, 0), ("g", 1, 0), ("g", 2, 2), ("h", 9, 9)]
    mean = np.mean([v[i] @ v[j] for i, j in ((0, 1), (0, 2), (1, 2))])
    assert {r.g: round(r.cohesion, 9) for r in organize.cohesion(rows, "g", "v").collect()} == {"g": round(mean, 9), "h": 1.0}


def test_vectors(spark):
    r = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0]), ([1.0, float("nan")], [1.0, 1.0])], "a array<float>, b array<float>")
    assert [x[0] for x in r.select(V.cosine(F.col("a"), F.col("b"))).collect()][0] == 0.0
    assert [tuple(x) for x in r.select(V.usable(F.col("a"), F.lit(2)), V.usable(F.col("b"), F.lit(2))).collect()] == [(True, False), (False, True)]


def test_history(spark):
    ops = spark.createDataFrame([("p", i, i == 2, False) for i in range(4)] + [("q", i, False, i == 1) for i in range(3)] + [("r", 0, False, True), ("r", 1, True, False)], "p string, i int, f boolean, c boolean")
    told = history.settled(ops, "p", "i", F.col("f"), F.col("c"))
    assert [r.outcome for r in told.orderBy("p", "i").collect()] == ["succeeded", "succeeded", "failed", "notStarted", "succeeded", "succeeded", "cancelled", "succeeded", "cancelled"]
    page = history.keyset_page(ops.select("p", "i"), ["p", "i"], ("q", 1), 3)
    assert [tuple(r) for r in page.collect()] == [("q", 0), ("p", 3), ("p", 2)]
    assert {r.p: r.recoverable for r in history.prune_flags(ops.withColumn("s", F.lit(1)), "s", "p", "i", 2).collect()} == {"p": True, "q": True, "r": False}


def test_undo(spark):
    e = spark.createDataFrame([(1, "edit", "a", "a", "h1", 1), (2, "edit", "b", "b", "h2", 1), (3, "move", "c", "d", None, 1), (4, "delete", "a", None, None, 1), (5, "edit", "a", "a", "h1", None), (6, "edit", "z", "z", "h", 1)], "id int, operation_kind string, before_path string, after_path string, after_hash string, recoverable int").withColumn("w", F.lit("w"))
    o = spark.createDataFrame([("w", "a", "h1"), ("w", "b", "other"), ("w", "c", "x"), ("w", "d", "y")], "w string, p string, h string")
    assert {r.id: r.conflict for r in history.undo_conflicts(e, o, "w", "p", "h").collect()} == {1: None, 2: "externallyModified", 3: "destinationOccupied", 4: "destinationOccupied", 5: "notRecoverable", 6: "missing"}


def test_scan(spark):
    waits = [r[0] for r in spark.range(1, 12).select(scan.retry_wait(F.col("id"))).collect()]
    assert waits == [0, 0, 600000, 1200000, 2400000, 4800000, 9600000, 19200000, 21600000, 21600000, 21600000]
    b = spark.createDataFrame([(1, 5, 1, "a", "indexed"), (2, 5, 1, "a", "indexed"), (3, 5, 1, "a", "failed"), (4, 5, 1, "a", "indexed"), (5, 5, 1, "a", "indexed"), (6, 5, 1, None, "failed")], "id int, size_bytes int, modified_at int, content_hash string, status string")
    n = spark.createDataFrame([(1, 5, 1, "a"), (2, 5, 2, "a"), (3, 5, 2, "a"), (4, 5, 1, None), (6, 5, 1, None), (7, 1, 1, "z"), (8, 1, 1, None)], "id int, size_bytes int, modified_at int, content_hash string")
    assert got(scan.scan_outcomes(b, n, "id")) == [(1, "unchanged"), (2, "metadata"), (3, "updated"), (4, "stale"), (5, "removed"), (6, "failed"), (7, "added"), (8, "failed")]
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 2, "c"), (2, None, "d")], "k int, at int, v string")
    assert got(scan.latest(rows, ["k"], "at", ["v"])) == [(1, 2, "c"), (2, None, "d")]


def test_ripple(spark):
    t = spark.createDataFrame([(1, "x\nDue October 20.\r\non Oktubre 20\nOctober 2026"), (2, "may 20 estudyante\nMay 20 na"), (3, None)], "id int, t string")
    assert got(ripple.line_mentions(t, "id", "t", "October 20")) == [(1, 1, "Due October 20."), (1, 2, "on Oktubre 20")]
    assert got(ripple.line_mentions(t, "id", "t", "May 20")) == [(2, 1, "May 20 na")]


@pytest.mark.parametrize("block, dim", [(8192, 6), (40, 6), (25, 3)])
def test_similar_pairs(spark, monkeypatch, block, dim):
    """Every pair of a scope from the cosine on, however blocks are cut, with copies, dirt and widths that do not meet."""
    from sheaf.operators import similar

    monkeypatch.setattr(similar, "BLOCK_ROWS", block)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, dim))
    v = [centres[i % 12] + rng.normal(size=dim) * 0.3 for i in range(300)] + [centres[0]] * 60
    rows = [(i, "s" if i % 3 else "t", [float(x) for x in w]) for i, w in enumerate(v)]
    dirt = [(900, "s", None), (901, "s", [0.0] * dim), (902, "s", [float("nan")] * dim), (903, None, rows[0][2]), (None, "s", rows[0][2]), (904, "s", [1.0]), (905, "s", [2.0]), rows[1], (906, "s", [])]
    df = spark.createDataFrame(rows + dirt, "k long, w string, v array<double>").withColumn("block", F.lit("x"))
    u = np.array(v) / np.linalg.norm(v, axis=1, keepdims=True)
    cos = u @ u.T
    want = {(rows[i][1], i, j) for i in range(360) for j in range(i + 1, 360) if rows[i][1] == rows[j][1] and cos[i, j] >= 0.9} | {("s", 904, 905)}
    assert {tuple(r)[:3] for r in similar.similar_pairs(df, "w", "k", "v", 0.9).collect()} == want
    assert similar.similar_pairs(df.limit(0), "w", "k", "v", 0.9).collect() == []


def test_running_sums(spark, monkeypatch):
    """Divisions of the numbers change nothing."""
    rows = spark.createDataFrame([("w", i, (i * 7) % 40 + 1) for i in range(1, 60)] + [("v", 1, 1)], "s string, q long, c long")
    whole = got(relations.pair_coverage(rows, ["s"], "q", "c"))
    monkeypatch.setattr(relations, "DIVISION", 7)
    assert got(relations.pair_coverage(rows, ["s"], "q", "c")) == whole


def test_pair_evidence(spark):
    rows = [("a", "b", 1, 5, 0.9), ("b", "a", 5, 1, 0.95), ("a", "b", 2, 4, 0.95), ("a", "b", 1, 6, 0.95), ("a", "b", 9, 9, 0.5), ("a", "a", 1, 2, 0.99), ("c", "b", 3, 1, 0.2), ("c", "d", 1, 1, None), ("c", "d", 1, 1, float("nan"))]
    told = relations.pair_evidence(spark.createDataFrame(rows, "l string, r string, lo int, ro int, c double"), "l", "r", "lo", "ro", "c").collect()
    assert sorted((r.a, r.b, r.best, r.at_a, r.at_b, [tuple(e) for e in r.evidence]) for r in told) == [("a", "b", 0.95, 1, 5, [(1, 5), (1, 6), (2, 4)]), ("b", "c", 0.2, 1, 3, [])]


def test_summary_scope_and_selection(spark):
    pairs = spark.createDataFrame([(1, 2, 0.5), (2, 3, 0.9), (3, 4, 0.7), (5, 6, 0.9)], "a int, b int, strength double")
    order = lambda df: [r.document for r in df.orderBy("place").collect()]
    assert order(relations.summary_scope(pairs, 4)) == [4, 3, 2, 5, 6, 1]
    assert order(relations.summary_scope(pairs, 4, most=3)) == [4, 3, 2]
    assert order(relations.summary_scope(pairs)) == [2, 3, 5, 6, 4, 1] and order(relations.summary_scope(pairs, 77)) == [2, 3, 5, 6, 4, 1]
    p = lambda *d: [(x, 0, 9) for x in d]
    rows = [(1, 2, "similarity", 0.9, p("x", "y")), (3, 4, "link", None, p("z")), (4, 2, "similarity", 0.1, p("y", "w")), (2, 3, "link", None, p()), (5, 9, "link", None, p("q"))]
    df = spark.createDataFrame(rows, "source int, target int, kind string, score double, passages array<struct<document:string,start:int,end:int>>")
    scope = relations.summary_scope(pairs, 4)
    told = {(r.source, r.target): [x.document for x in r.passages] for r in relations.summary_selection(df, scope, 4, most=3).collect()}
    assert told == {(3, 4): ["z"], (4, 2): ["y", "w"]}


def test_highlight_and_lines(spark):
    shown = lambda t, terms, **o: [(x.text, x.hit) for x in one(spark, T.highlighted(F.col("t"), terms, **o), t=t)]
    assert shown("Plans: planning, explanation, PLÁN", ["plan"]) == [("Plans", True), (": ", False), ("planning", True), (", explanation, ", False), ("PLÁN", True)]
    assert shown("El Niño", ["nino"]) == [("El ", False), ("Niño", True)] and shown("Nin\u0303o", ["nino"]) == [("Nin\u0303o", True)]
    assert shown("1_b 1_bc 1 b", ["1_b"], whole=True) == [("1_b", True), (" 1_bc 1 b", False)]
    assert shown("a+b (x)", ["a+b"], whole=True)[0] == ("a+b", True) and shown("", ["a"]) == [] and shown("abc", []) == [("abc", False)]
    assert one(spark, T.line_at(F.col("t"), F.lit(6)), t="ab\n cd x \r\ne") == "cd x" and one(spark, T.line_at(F.col("t"), F.lit(1)), t="ab") == "ab"
    assert one(spark, T.model_json(F.col("t")), t="```json\n{\"a\": 1}\n```") == '{"a": 1}' and one(spark, T.model_json(F.col("t")), t="Sure! {}") is None
    assert one(spark, F.array_join(T.terms_in_order(F.col("t")), " "), t="b a B c a") == "b a c"
    assert search.terms_in_order("b a B?c") == ["b", "a", "c"] and search.match_expression(["a", "b c", ""]) == '"a"' and search.match_expression([]) is None


def test_link_ranges_and_offsets(spark):
    t = "[é](a.md)ñ [b c](d(e) x[]() [f](g)"
    found = one(spark, T.link_ranges(F.col("t")), t=t)
    assert [(x.label, x.target, t.encode()[x.start : x.end].decode()) for x in found] == [("é", "a.md", "[é](a.md)"), ("b c", "d(e", "[b c](d(e)"), ("f", "g", "[f](g)")]
    assert one(spark, T.link_ranges(F.col("t")), t="none") == [] and one(spark, T.link_ranges(F.col("t")), t="") == []
    s = "aé🏽z"  # 1, 2, 4 and 1 bytes; 1, 1, 2 and 1 units
    back = [one(spark, T.utf8_offset(F.col("t"), F.lit(n)), t=s) for n in range(-1, 7)]
    assert back == [None, 0, 1, 3, None, 7, 8, None]
    assert [one(spark, T.utf16_offset(F.col("t"), F.lit(b)), t=s) for b in (0, 1, 3, 7, 8)] == [0, 1, 2, 4, 5]


def test_diff_hunks(spark):
    a = "\n".join(f"l{i}" for i in range(20))
    b = a.replace("l3\n", "x\ny\n").replace("l17", "z")
    df = spark.createDataFrame([(1, a, b), (2, a, a), (3, None, "n"), (4, None, None)], "k int, a string, b string")
    found = sorted(tuple(r) for r in diffs.diff_hunks(df, "k", "a", "b", 1).collect())
    assert found == [(1, 0, 3, 3, 3, 4, [" l2", "-l3", "+x", "+y", " l4"]), (1, 1, 17, 3, 18, 3, [" l16", "-l17", "+z", " l18"]), (3, 0, 1, 0, 1, 1, ["+n"])]


def test_scan_with_retries(spark):
    before = spark.createDataFrame([(1, 5, 1, "h", "failed", 3, 0), (2, 5, 1, "h", "stale", 3, 0), (3, 5, 1, "h", "failed", 3, 0), (4, 5, 1, "h", "failed", 2, 0), (5, 5, 1, "h", "indexed", 0, 0), (6, 5, 1, "h", "indexed", 0, 0)], "k int, size_bytes int, modified_at int, content_hash string, status string, failures int, failed_ms long")
    now = spark.createDataFrame([(1, 5, 1, None, True), (2, 5, 1, None, True), (3, 6, 1, None, True), (4, 5, 1, None, True), (5, 5, 1, "h", False), (7, 1, 1, "x", False)], "k int, size_bytes int, modified_at int, content_hash string, ok boolean")
    run = lambda asked=None: dict(got(scan.retry_outcomes(before, now, "k", F.lit(1000), F.col("ok"), asked)))
    assert run() == {1: "deferredFailed", 2: "deferredStale", 3: "failed", 4: "failed", 5: "unchanged", 6: "removed", 7: "unsupported"}
    assert run(spark.createDataFrame([(1,)], "k int"))[1] == "failed"
    told = scan.scan_counters(scan.retry_outcomes(before, now, "k", F.lit(1000), F.col("ok"))).first().asDict()
    assert told == {"added": 0, "updated": 0, "removed": 1, "unchanged": 1, "unsupported": 1, "failed": 3, "stale": 1, "deferred": 2, "relink": True}
    only = spark.createDataFrame([(1, "deferredFailed"), (2, "unchanged")], "k int, outcome string")
    assert scan.scan_counters(only).first().relink is False


def test_summaries(spark):
    from sheaf.operators import answers

    rows = spark.createDataFrame([("d", i, f"t{i}") for i in range(40)] + [("e", 0, "")], "d string, n int, t string")
    told = {r.d: r for r in answers.summarised(rows, "d", "n", "t", lambda texts: " ".join(texts) or None, lambda notes: "|".join(notes)).collect()}
    assert told["d"].notes == 8 and told["d"].covered == 32 and told["d"].partial and told["d"].summary.startswith("t0 t1 t2 t3|t4")
    assert told["e"].summary is None and not told["e"].partial


def test_folder_affinity(spark):
    """Copies are no reason to move, a missing home counts as 0, of equal folders the smaller is taken, ten per scope."""
    a, b = [1.0, 0.0], [0.0, 1.0]
    rows = [
        (1, "w", "x/1", "x", "h1", a), (2, "w", "a/2", "a", "h2", a), (3, "w", "a/3", "a", "h3", a), (4, "w", "b/4", "b", "h4", a), (5, "w", "b/5", "b", "h5", a),
        (6, "w", "x/6", "x", "h6", b), (7, "w", "y/7", "y", "h7", b), (8, "w", "c/8", "c", "h7", b), (9, "w", "c/9", "c", "h7", b), (10, "w", "c/10", "c", None, b), (11, "w", "z/11", "z", "h11", None),
    ]
    df = spark.createDataFrame(rows, "k int, w string, p string, f string, h string, v array<double>")
    told = {r.k: (r.folder, r.similarity, r.margin) for r in organize.folder_affinity(df, "k", ["w"], "f", "p", "h", "v").collect()}
    # 1 is as near to a as to b and its home holds only the opposite; 6 is near to c; 7 has only copies in c, 2 to 5 lie well
    assert told == {1: ("a", 1.0, 1.0), 6: ("c", 1.0, 1.0)}
    many = spark.createDataFrame([(i, "w", f"x{i}/{i}", f"x{i}", f"h{i}", a) for i in range(30)] + [(100 + i, "w", f"d/{i}", "d", f"g{i}", a) for i in range(3)], "k int, w string, p string, f string, h string, v array<double>")
    assert organize.folder_affinity(many, "k", ["w"], "f", "p", "h", "v").count() == 10
    assert organize.folder_affinity(df.limit(0), "k", ["w"], "f", "p", "h", "v").collect() == []


def test_free_paths(spark):
    files = spark.createDataFrame([(1, "w", "n/a.md", "h", True), (2, "w", "n/b.md", "h", True), (3, "w", "N/C.md", "h", True), (4, "w", "n/d", "h", True), (5, "w", "n/e.md", None, True), (6, "w", "n/f.pdf", "h", False), (7, "w", "g.md", "h", True)], "k int, w string, p string, h string, e boolean")
    names = spark.createDataFrame([(1, "New Plan"), (2, "new plan!"), (3, "A"), (4, "x"), (5, "x"), (6, "x"), (7, "con"), (7, None), (1, "?")], "k int, name string")
    assert got(organize.generated_names(names, files, "k", "w", "p", "h", "e", "name")) == [(1, "w", "n/a.md", "n/new-plan.md")]
    moves = spark.createDataFrame([(1, ""), (2, "n"), (7, "n"), (3, "q")], "k int, folder string")
    assert got(organize.destinations(moves, files, "k", "w", "p", "h", "e")) == [(1, "w", "n/a.md", "a.md"), (3, "w", "N/C.md", "q/C.md"), (7, "w", "g.md", "n/g.md")]
    taken = spark.createDataFrame([("w", "A.MD")], "w string, p string")
    wish = spark.createDataFrame([(1, "w", "n/a.md", "a.md")], "k int, w string, p string, destination string")
    assert organize.free_paths(wish, files, "w", "p", "k", taken).collect() == []


def test_impacts(spark):
    """A link either way is evidence, an identical copy only similar; what does not mention the phrase is left out, but for copies."""
    files = spark.createDataFrame([(1, "w", "t.md", "h"), (2, "w", "out.md", "a"), (3, "w", "in.md", "b"), (4, "w", "copy.md", "h"), (5, "v", "far.md", "h"), (6, "w", "fact.md", "c"), (7, "w", "sim.md", "d"), (8, "w", "mute.md", "e"), (9, "w", "z.md", "h")], "o int, w string, p string, c string")
    links = spark.createDataFrame([(1, 2), (3, 1), (8, 1), (1, 9)], "source int, target int")
    edges = spark.createDataFrame([(6, 1, "shared-fact"), (1, 7, "similarity"), (3, 1, "similarity")], "a int, b int, kind string")
    told = spark.createDataFrame([(i,) for i in (2, 3, 6, 7, 9)], "o int")
    found = [tuple(r)[1:] for r in ripple.impacts(links, edges, told, files, "t", "o", "p", "c", "w").filter("t = 1").collect()]
    assert sorted(found) == [
        (2, "evidence", "is linked from the target"), (3, "evidence", "links to the target"), (4, "similarityOnly", "is a copy"),
        (6, "evidence", "may state the same fact"), (7, "similarityOnly", "is similar"), (9, "evidence", "is linked from the target"),
    ]
    two = ripple.impacts(links, edges, told, files, "t", "o", "p", "c", "w", most=5).filter("t = 1").collect()
    assert sorted(r.o for r in two) == [2, 3, 4, 6, 9]
    assert ripple.impacts(links.limit(0), edges.limit(0), told.limit(0), files.limit(0), "t", "o", "p", "c", "w").collect() == []


def test_impacts_of_many_copies(spark):
    """A content that all files have gives as many rows per file as are kept, and no more."""
    files = spark.range(400).select(F.col("id").alias("o"), F.lit("w").alias("w"), F.format_string("%05d", "id").alias("p"), F.lit("h").alias("c"))
    none = spark.createDataFrame([], "source long, target long")
    found = ripple.impacts(none, spark.createDataFrame([], "a long, b long, kind string"), spark.createDataFrame([], "o long"), files, "t", "o", "p", "c", "w", most=3)
    assert found.count() == 1200 and sorted(r.o for r in found.filter("t = 1").collect()) == [0, 2, 3]


def test_scope_gate(spark):
    """The same verdict as by sorting, for even and odd numbers, ties and nothing."""
    import statistics

    rng = __import__("random").Random(4)
    for values in ([0.9], [0.9, 0.1], [rng.uniform(-1, 1) for _ in range(501)] + [0.95], [0.5] * 100 + [0.82, 0.83], [1.0, -1.0, 1.0, -1.0]):
        df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "c double")
        r = search.scope_gate(df, "c").first()
        assert (r.n, r.top) == (len(values), max(values)) and abs(r.median - statistics.median(values)) < 1e-12
        assert r.passed == search.evidence_gate(df.withColumn("q", F.lit(1)), "q", "c").first().passed
    assert search.scope_gate(spark.createDataFrame([], "c double"), "c").collect() == []


def test_no_text_is_shuffled(spark, tmp_path):
    """Ranking moves numbers: the passages' text is above no exchange."""
    spark.createDataFrame([(1, 2, "a budget"), (1, 2, "a budget"), (2, 2, None)], "c long, d long, t string").write.parquet(str(tmp_path / "c"))
    plan = search.bm25(spark.read.parquet(str(tmp_path / "c")), ["c", "d"], "t", "budget", False)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert exchanges and not any(" t#" in line for line in exchanges)


def test_lab_records(spark):
    runs = spark.createDataFrame([("r1", "qa", "m", "valid", "running", 1, "h1"), ("r2", "qa", "m", "failed", "done", 2, "h2"), ("r3", "sum", "n", "valid", "running", 9, None)], "id string, task string, model string, outcome string, state string, at int, out string")
    assert got(lab.outcome_counts(runs, "model", "outcome")) == [("m", "failed", 1), ("m", "valid", 1), ("n", "valid", 1)]
    assert [r.id for r in lab.listed_runs(runs, "at", "id").collect()] == ["r3", "r2", "r1"]
    assert [r.id for r in lab.listed_runs(runs, "at", "id", task="qa", outcome="valid").collect()] == ["r1"]
    assert got(lab.interrupted(runs, "state", "at", F.lit(5)).select("id", "state")) == [("r1", "interrupted"), ("r2", "done"), ("r3", "running")]
    reviews = spark.createDataFrame([("r1", "h1", 5, "ok"), ("r1", "h1", 3, "bad"), ("r1", "hx", 4, "other"), ("r2", "h2", 7, "ok")], "id string, out string, at int, note string")
    told = {r.id: [x.note for x in r.reviews or []] for r in lab.reviewed(runs, reviews, "id", "out", "at").collect()}
    assert told == {"r1": ["bad", "ok"], "r2": ["ok"], "r3": []}
    assert got(lab.latest_reviews(reviews, "out", "at", "note").select("out", "note")) == [("h1", "ok"), ("h2", "ok"), ("hx", "other")]


def test_lab(spark):
    # query 1: b is a copy of a and takes no place, so that g is the fifth content; h is the sixth
    r = spark.createDataFrame([(1, d, n, h) for n, (d, h) in enumerate([("a", "x"), ("b", "x"), ("c", "y"), ("e", None), ("f", None), ("g", "w"), ("h", "v")])] + [(2, "c", 1, "y")], "q int, d string, r int, h string")
    rel = spark.createDataFrame([(1, "a"), (1, "b"), (1, "g"), (1, "h"), (2, "z"), (3, "a")], "q int, d string")
    neg = spark.createDataFrame([(1, "h"), (2, "c")], "q int, d string")
    assert got(lab.retrieval_checks(r, rel, neg, "q", "d", "r", "h")) == [(1, 4, 3, 0.75, False, True), (2, 1, 0, 0.0, False, False), (3, 1, 0, 0.0, False, None)]
    s = spark.createDataFrame([(True, None), (False, True), (None, None)], "a boolean, b boolean").select(lab.tri_state([F.col("a"), F.col("b")]))
    assert [x[0] for x in s.collect()] == ["passed", "failed", "unknown"]
    assert one(spark, lab.fact_present(F.col("t"), F.col("f")), t="on 20 Oct 2026", f="October 20, 2026") is True
    assert one(spark, lab.fact_present(F.col("t"), F.col("f")), t="Final Report", f="final report") is True


def test_record_faults(spark):
    ok = ("retrieval", "valid", True, "firstRequestAfterServerRestart", 0, False, True, 5, 5, 8, 8, "s", [("s",)], [(1, None)])
    bad = ("summary", "timeout", True, "later", 3, False, True, 5, 6, 8, 9, "s", [("t",)], [(None, None)])
    df = spark.createDataFrame([ok, bad], "task string, outcome_kind string, cold boolean, request_position string, requests_since_start int, retry_needed boolean, correctness boolean, model_disk_bytes int, model_file_bytes int, context_tokens int, n_ctx int, output_sha256 string, reviews array<struct<output_sha256:string>>, memory array<struct<peak_bytes:int,unavailable_reason:string>>")
    a, b = [r.faults for r in lab.record_faults(df).collect()]
    assert a == [] and b == ["diskBytes", "contextTokens", "cold", "coldStart", "retryNeeded", "failedCorrectness", "summaryCorrectness", "memory", "review"]


def test_facts(spark):
    a = "# Plan\nThe Green Valley meeting is on October 20. Not all agree. Submission moved to May 3."
    b = "Ang pulong ng Green Valley ay sa Okt 20, pero huwag."
    c = "Green Valley session: Oktubre 20 2026\nBinilang ng Green Valley ang 15 students."
    assert [f[:6] for f in facts.text_facts(a)] == [("date", "event", "green valley", False, 10, 20)]
    assert facts.text_facts(b) == []
    df = spark.createDataFrame([(1, a), (2, b), (3, c), (4, None), (3, c)], "id long, t string")
    told = facts.clause_facts(df, "id", "t")
    # the year of 3 makes one class with 1, which names none
    assert got(facts.shared_facts(told, "id")) == [(1, 1, "date", "event", "green valley", 10, 20, -1, 2), (3, 1, "date", "event", "green valley", 10, 20, -1, 2)]
    near = spark.createDataFrame([(1, 3, 0.9), (1, 2, 0.95), (2, 3, 0.1)], "a long, b long, cosine double")
    assert got(facts.fact_links(told, near, "id")) == [(1, 3, "date", "event", "green valley")]
    assert facts.fact_links(told, near.withColumn("cosine", F.lit(0.5)), "id").collect() == []


@pytest.mark.parametrize("text, want", [
    ("The Green Valley submission is on Sept 5.", [("date", "deadline", "green valley", 9, 5)]),
    ("Green Valley meeting, Octubre 20.", []),  # the comma parts anchor and role
    ("Ang huling araw ng Green Valley ay Octubre 20.", [("date", "deadline", "green valley", 10, 20)]),
    ("Ang huling ulat ng Green Valley ay Octubre 20.", []),
    ("'Di tuloy ang pulong ng Green Valley sa Oktubre 20.", []),
    ("The Green Valley meeting is on Oct 20 2026.", [("date", "event", "green valley", 10, 20)]),
    ("The Green Valley meeting is on May 3.", [("date", "event", "green valley", 5, 3)]),
    ("may 3 estudyante sa Green Valley meeting.", [("quantity", "person", "green valley", None, None)]),
    ("On page 20 students of Green Valley.", []),
    ("The Green Valley meeting and the submission are on Oct 20.", []),
])
def test_facts_of_a_clause(text, want):
    assert [(f[0], f[1], f[2], f[4], f[5]) for f in facts.text_facts(text)] == want


def test_fact_classes(spark):
    """Two years are two classes, a text without a year is in both; headings alone are no match; many texts make no pairs."""
    one = "The Green Valley meeting is on October 20{}."
    rows = [(1, one.format("")), (2, one.format(" 2026")), (3, one.format(" 2027")), (4, "# Red Hill Trail\nThe meeting is on May 3."), (5, "# Red Hill Trail\nThe meeting is on May 3.")]
    told = facts.clause_facts(spark.createDataFrame(rows, "id long, t string"), "id", "t")
    assert {(r.id, r.class_id, r.n_texts) for r in facts.shared_facts(told, "id").collect()} == {(1, 1, 2), (2, 1, 2), (3, 1, 2)}
    many = spark.range(3000).select("id", F.lit(one.format("")).alias("t"))
    assert facts.shared_facts(facts.clause_facts(many, "id", "t"), "id").count() == 3000


@pytest.mark.parametrize("unit, limit", [("chars", 60), ("bytes", 40)])
def test_chunks(spark, unit, limit):
    text = "# Ñame\n\nshort one\r\n\r\n" + "word " * 40 + "[label here](some/very/long/target path.md) " + "é" * 90 + "\n\n \n\nend"
    df = spark.createDataFrame([(1, text, None), (2, None, None), (3, "", None), (4, "page one\n\npage two", [(1, 0, 8), (2, 10, 18), (3, 18, 18)])], "id long, t string, p array<struct<page:int,start_offset:bigint,end_offset:bigint>>")
    rows = chunking.chunk(df, "id", "t", "p", limit, unit).collect()
    data = text.encode()
    for r in rows:
        if r.id == 1:
            assert data[r.start_offset : r.end_offset].decode() == r.chunk_text == r.chunk_text.strip()
            assert (len(r.chunk_text) if unit == "chars" else r.end_offset - r.start_offset) <= limit
    joined = "".join("".join(r.chunk_text.split()) for r in sorted((r for r in rows if r.id == 1), key=lambda r: r.ordinal))
    assert joined == "".join(text.split())
    assert [(r.page, r.chunk_text) for r in sorted(rows, key=lambda r: r.ordinal) if r.id == 4] == [(1, "page one"), (2, "page two")]
    if unit == "chars":
        assert any("[label here](some/very/long/target path.md)" in r.chunk_text for r in rows)


def test_diffs(spark):
    assert diffs.changed_region("abcXdef", "abcYYdef") == (3, 4, 5) and diffs.changed_region("aa", "aaa") == (2, 2, 3)
    df = spark.createDataFrame([(1, "a\nb", "a\nc\nd"), (2, None, ""), (3, "x", None)], "id int, a string, b string")
    assert [r[:4] for r in got(diffs.diff_lines(df, "id", "a", "b"))] == [(1, "changed", 1, 2), (2, "same", 0, 0), (3, "changed", 1, 0)]
