"""The folder source, the sinks and the streams."""

import datetime
import os

from pyspark.sql import functions as F

from sheaf.plans.staging import shared_dir, stage
from sheaf.sources import folder
from sheaf.streaming import ingest


def test_folder(spark, tmp_path):
    root = tmp_path / "lib"
    for name, data in {"a.md": b"# Head\ntext", "sub dir/b+c.txt": b"plain", "x.bin": b"?", ".hidden.md": b"no", "node_modules/m.md": b"no", ".git/c.md": b"no", "bad.txt": b"\xff\xfe", "empty.txt": b"", "p.pdf": b"%PDF"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    got = {r.relative_path: (r.media_type, r.content, r.title) for r in folder.read_documents(spark, str(root)).collect()}
    assert got == {"a.md": ("text/markdown", "# Head\ntext", "Head"), "sub dir/b+c.txt": ("text/plain", "plain", "b+c.txt"), "bad.txt": ("text/plain", None, "bad.txt"), "p.pdf": ("application/pdf", None, "p.pdf")} | {"sub dir/b+c.txt": ("text/plain", "plain", "plain")}
    try:
        folder.read_documents(spark, str(root), 2)
        raise AssertionError("too many files were read")
    except ValueError:
        pass


def test_readable(spark):
    lines = spark.createDataFrame([("An ordinary line, with words.",), ("˛˛T˛m)7",), ("SN BSCS",), ("",), ("WBT XKZ QRT 7Wk BDF",)], "x string")
    assert [r[0] for r in lines.select(folder.is_readable(F.col("x"))).collect()] == [True, False, True, True, False]


def test_upsert_and_stream(spark, tmp_path):
    at = lambda d: datetime.datetime(2025, 1, d)
    table, landing = str(tmp_path / "table"), str(tmp_path / "landing")
    rows = spark.createDataFrame([(1, "a", at(1)), (1, "b", at(2)), (2, "c", at(1))], "id int, v string, at timestamp")
    folder.upsert(table, rows, ["id"], "at")
    rows.filter("v = 'a'").withColumn("v", F.lit("late")).unionByName(spark.createDataFrame([(3, "new", at(3))], rows.schema)).write.parquet(landing)
    for _ in range(2):
        ingest.ingest(ingest.watch(spark, landing, "id int, v string, at timestamp"), table, str(tmp_path / f"cp{_}"), ["id"], "at").awaitTermination()
    assert sorted((r.id, r.v) for r in folder.read_table(spark, table).collect()) == [(1, "b"), (2, "c"), (3, "new")]


def test_retry_stream(spark, tmp_path):
    rows = [("p", "s", False, 1), ("p", "s", False, 2), ("p", "s", False, 3), ("q", "s", False, 1), ("q", "s", True, 2), ("r", "s", False, 1), ("r", "t", False, 2)]
    spark.createDataFrame(rows, "path string, signature string, ok boolean, at_ms long").write.parquet(str(tmp_path / "in"))
    stream = ingest.watch(spark, str(tmp_path / "in"), "path string, signature string, ok boolean, at_ms long")
    q = ingest.retry_state(stream).writeStream.outputMode("update").format("memory").queryName("retries").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.sql("select * from retries").collect())) == [("p", 3, 600003), ("q", 0, None), ("r", 1, 2)]


def test_export_and_stage(spark, tmp_path):
    df = spark.createDataFrame([(1, "ñ")], "a int, b string")
    folder.export_json(df, str(tmp_path / "out"))
    assert os.listdir(tmp_path / "out") and spark.read.json(str(tmp_path / "out")).count() == 1
    assert stage(df).schema == df.schema and shared_dir(spark) == shared_dir(spark)


def test_upsert_states(spark, tmp_path):
    """Only touched divisions are written, a reader keeps its state, and a second writer of one version fails."""
    at = datetime.datetime(2025, 1, 1)
    table = str(tmp_path / "t")
    make = lambda rows: spark.createDataFrame(rows, "id int, v string, at timestamp")
    folder.upsert(table, make([(i, "a", at) for i in range(200)]), ["id"], "at", parts=8)
    first = folder._manifest(spark, table)
    reader = folder.read_table(spark, table)
    folder.upsert(table, make([(7, "b", at + datetime.timedelta(1)), (7, "old", None), (9, "old", None)]), ["id"], "at")
    second = folder._manifest(spark, table)
    assert sum(first["parts"][p] != second["parts"][p] for p in first["parts"]) <= 2 and second["version"] == 2
    assert {r.v for r in reader.collect()} == {"a"}
    assert sorted({(r.id, r.v) for r in folder.read_table(spark, table).collect() if r.id in (7, 9)}) == [(7, "b"), (9, "a")]
    folder.upsert(table, make([]), ["id"], "at")
    assert folder._manifest(spark, table)["version"] == 2 and folder.read_table(spark, table).count() == 200
    os.makedirs(f"{table}/_states", exist_ok=True)
    open(f"{table}/_states/x.tmp", "w").close()
    assert folder._manifest(spark, table)["version"] == 2


def _pdf(pages, encrypt=False):
    """A PDF with a compressed content stream per page."""
    import zlib

    kids = " ".join(f"{3 + 2 * n} 0 R" for n in range(len(pages)))
    out = [b"%PDF-1.4\n", b"1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n", f"2 0 obj\n<< /Type /Pages /Kids [{kids}] /Count {len(pages)} >>\nendobj\n".encode()]
    for n, content in enumerate(pages):
        data = zlib.compress(content)
        out.append(f"{3 + 2 * n} 0 obj\n<< /Type /Page /Parent 2 0 R /Contents {4 + 2 * n} 0 R >>\nendobj\n{4 + 2 * n} 0 obj\n<< /Length {len(data)} /Filter /FlateDecode >>\nstream\n".encode() + data + b"\nendstream\nendobj\n")
    return b"".join(out) + (b"trailer << /Encrypt 9 0 R >>" if encrypt else b"trailer << /Root 1 0 R >>") + b"\n%%EOF"


def test_pdf(spark, tmp_path):
    pages = [rb"BT /F1 12 Tf 10 700 Td (First \(page\)) Tj 0 -14 Td [(se) -20 (cond) -300 (line)] TJ ET", b"", rb"BT (\251ni\361o) ' <48692E> Tj ET", b"BT (\x01\x02\x03\x04\x05\x06) Tj ET"]
    root = tmp_path / "lib"
    root.mkdir()
    for name, data in {"a.pdf": _pdf(pages), "locked.pdf": _pdf(pages, True), "bad.pdf": b"%PDF-1.4 nothing", "t.txt": b"plain"}.items():
        (root / name).write_bytes(data)
    got = {r.relative_path: r for r in folder.read_documents(spark, str(root)).collect()}
    a = got["a.pdf"]
    assert a.content == "First (page)\nsecond line\n\n©niñoHi." and a.unreadable_pages == [2, 4] and a.title == "First (page)"
    assert [(p.page, a.content.encode()[p.start_offset : p.end_offset].decode()) for p in a.pages] == [(1, "First (page)\nsecond line"), (3, "©niñoHi.")]
    assert got["locked.pdf"].content is None and got["bad.pdf"].content is None and got["t.txt"].content == "plain" and got["t.txt"].pages is None


def test_staged_tables_are_removed(spark):
    from sheaf.operators.components import connected_components
    from sheaf.plans import staging

    place = staging.own_dir(spark).removeprefix("file:")
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a int, b int")
    before = set(os.listdir(place)) if os.path.isdir(place) else set()
    assert {r.component for r in connected_components(edges, "a", "b").collect()} == {0}
    assert len(set(os.listdir(place)) - before) == 1


def test_suite(spark, tmp_path):
    import json

    from sheaf.sources import suite

    cases = [{"id": "r1", "task": "retrieval", "input": "q", "relevantDocuments": ["a.md", "b.md", "a.md"]}, {"id": "e1", "task": "edit", "input": "x", "expectedTarget": "a.md", "unchangedRelatedFiles": True}, {"task": "edit"}]
    (tmp_path / "cases.json").write_text(json.dumps(cases))
    assert sorted(r.id for r in suite.read_cases(spark, str(tmp_path / "cases.json")).collect()) == ["e1", "r1"]
    only = suite.read_cases(spark, str(tmp_path / "cases.json"), "retrieval")
    assert sorted(map(tuple, suite.labelled(only, "relevantDocuments").collect())) == [("r1", "a.md"), ("r1", "b.md")]
    root = tmp_path / "corpus"
    root.mkdir()
    (root / "a.md").write_bytes(b"x\r\ny\rz")
    (root / "b.md").write_bytes(b"x\ny\nz")
    assert len({r.corpus_hash for r in suite.read_corpus(spark, str(root)).collect()}) == 1
