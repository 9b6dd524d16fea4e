"""A folder of documents as a table, and the sinks of the library."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.text import extension_of, name_of, title_of
from ..operators.scan import latest
from ..plans.staging import stage

# What is read, as what, and up to which size in bytes.
MEDIA_TYPES = {"md": "text/markdown", "markdown": "text/markdown", "txt": "text/plain", "pdf": "application/pdf"}
MOST_TEXT, MOST_PDF, MOST_FILES = 2 * 1024 * 1024, 20 * 1024 * 1024, 5000
#: Divisions of a table that upsert keeps.
PARTS = 32
# Fixed value: punctuation that ordinary text uses.
COMMON_PUNCTUATION = ".,;:!?'\"()[]{}-–—/\\&%@#*+=<>|~^$€£¥₱°•·…‘’“”«»_"


def _found(spark: SparkSession, root: str) -> DataFrame:
    """The documents below a folder as rows of one scan; what is not selected of it is not read."""
    base = root.rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.try_url_decode(F.replace(F.substring_index("path", base, -1), F.lit("+"), F.lit("%2B")))
    rows = files.select(path.alias("relative_path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"), F.col("content").alias("bytes"))
    rows = rows.filter(~F.col("relative_path").rlike(r"(^|/)(\.|node_modules/)"))
    kinds = F.create_map(*(F.lit(x) for kv in MEDIA_TYPES.items() for x in kv))
    name = name_of(F.col("relative_path"))
    return rows.withColumn("name", name).withColumn("media_type", F.try_element_at(kinds, extension_of(name))).filter("media_type IS NOT NULL")


def list_documents(spark: SparkSession, root: str) -> DataFrame:
    """(relative_path, size_bytes, modified_at, name, media_type) of the documents below a folder, contents unread.

    Hidden files, files in hidden folders and in node_modules, and other kinds of file are left out; so are files of no
    bytes, which Spark's file scan does not list.
    """
    return _found(spark, root).drop("bytes")


def read_documents(spark: SparkSession, root: str, most_files: int | None = MOST_FILES) -> DataFrame:
    """list_documents with content_hash, content, pages, unreadable_pages and title: content is null where a file is not
    UTF-8 text, is too large, or is a PDF of which no page gives text.

    Pages are byte ranges of content, for PDFs only (see pdf).  More than `most_files` documents are refused before
    anything is read; None lifts the bound.
    """
    from .pdf import with_pages

    listed = list_documents(spark, root)
    if most_files is not None and listed.limit(most_files + 1).count() > most_files:
        raise ValueError(f"more than {most_files} documents")
    pdf = F.col("media_type") == "application/pdf"
    plain = ~pdf & (F.col("size_bytes") <= MOST_TEXT) & F.is_valid_utf8("bytes")
    read = with_pages(_found(spark, root).withColumn("__pdf", F.when(pdf & (F.col("size_bytes") <= MOST_PDF), F.col("bytes"))), "__pdf", "__read")
    text = F.when(plain, F.decode("bytes", "UTF-8")).otherwise(F.col("__read.content"))
    told = read.select(*listed.columns, F.concat(F.lit("sha256:"), F.sha2("bytes", 256)).alias("content_hash"), text.alias("content"), F.col("__read.pages").alias("pages"), F.col("__read.unreadable_pages").alias("unreadable_pages"))
    return told.withColumn("title", F.coalesce(title_of(F.col("content")), F.col("name")))


def is_readable(line: Column) -> Column:
    """Whether a line reads as language rather than as codes of a font without a character map."""
    visible = F.regexp_replace(line, r"\s+", "")
    plain = "".join("\\" + c for c in COMMON_PUNCTUATION if c not in "–—€£¥₱°•·…‘’“”«»_") + "–—€£¥₱°•·…‘’“”«»_"
    odd = F.length(F.regexp_replace(visible, rf"[\p{{L}}\p{{N}}{plain}]", ""))
    n = F.length(visible)
    words = F.filter(F.split(line, r"[^\p{L}\p{N}]+"), lambda w: F.length(F.regexp_replace(w, "[^A-Za-z]", "")) >= 2)
    voiced, mixed = F.size(F.filter(words, lambda w: w.rlike("[aeiouyAEIOUY]"))), F.size(F.filter(words, lambda w: w.rlike("[0-9]")))
    coded = (F.size(words) >= 4) & ((voiced < F.size(words) * 0.4) | (mixed * 2 > F.size(words)))
    return (n == 0) | ((odd <= n * F.when(n < 4, 0.5).otherwise(0.25)) & ~coded)


def readable_lines(text: Column) -> Column:
    return F.array_join(F.filter(F.split(text, "\n"), is_readable), "\n")


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path


def _manifest(spark: SparkSession, table_path: str) -> dict | None:
    """The newest state of a table: its version, schema and where each part lies; None if there is none yet."""
    fs, path = _file_system(spark, table_path)
    folder = path(f"{table_path}/_states")
    if not fs.exists(folder):
        return None
    versions = [int(f.getPath().getName()[:-5]) for f in fs.listStatus(folder) if f.getPath().getName().endswith(".json")]
    if not versions:
        return None
    stream = fs.open(path(f"{table_path}/_states/{max(versions)}.json"))
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def read_table(spark: SparkSession, table_path: str) -> DataFrame:
    """A table that upsert keeps, in its newest state."""
    state = _manifest(spark, table_path)
    if state is None:
        raise FileNotFoundError(table_path)
    schema = T.StructType.fromJson(state["schema"])
    places = [f"{table_path}/{p}" for p in state["parts"].values()]
    return spark.read.schema(schema).parquet(*places) if places else spark.createDataFrame([], schema)


def upsert(table_path: str, changes: DataFrame, keys: list[str], at: str, parts: int = PARTS) -> None:
    """Merge rows into a table: per key the row written last stays.

    The table lies in `parts` divisions by a hash of the key.  Only divisions that the changes touch are written anew, beside
    the old ones; then a file that names all divisions of the new state appears by one rename.  A reader sees the old
    state or the new one, a crash leaves the old one, and a batch merged again changes nothing.  Divisions of states
    before the last are deleted.  One writer at a time: a second one with the same version fails.
    """
    spark = changes.sparkSession
    state = _manifest(spark, table_path)
    parts = state["divisions"] if state else parts
    part = F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")
    fresh = stage(latest(changes, keys, at).withColumn("__part", part), "changes")
    touched = [r[0] for r in fresh.select("__part").distinct().collect()]  # at most `parts` numbers
    if not touched:
        return
    known = state["parts"] if state else {}
    old = [f"{table_path}/{known[str(p)]}" for p in touched if str(p) in known]
    rows = fresh
    if old:
        before = spark.read.schema(T.StructType.fromJson(state["schema"])).parquet(*old)
        rows = latest(before.withColumn("__part", part).unionByName(fresh, allowMissingColumns=True), keys, at)
    version = (state["version"] if state else 0) + 1
    place = f"data/{version}-{uuid.uuid4().hex}"
    rows.repartition("__part").write.partitionBy("__part").parquet(f"{table_path}/{place}")
    schema = T.StructType([f for f in rows.schema.fields if f.name != "__part"])
    now = {"version": version, "divisions": parts, "schema": json.loads(schema.json()), "parts": known | {str(p): f"{place}/__part={p}" for p in touched}}
    fs, path = _file_system(spark, table_path)
    draft, final = path(f"{table_path}/_states/.{version}-{uuid.uuid4().hex}"), path(f"{table_path}/_states/{version}.json")
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps(now).encode()))
    out.close()
    if fs.exists(final) or not fs.rename(draft, final):
        raise RuntimeError(f"{table_path}: another writer has made version {version}")
    if state:
        stale = {p for p in _before_last(spark, table_path, version) if p not in state["parts"].values() and p not in now["parts"].values()}
        for p in stale:
            fs.delete(path(f"{table_path}/{p}"), True)


def _before_last(spark: SparkSession, table_path: str, version: int) -> list[str]:
    """The parts of the state two versions back, whose file is deleted."""
    fs, path = _file_system(spark, table_path)
    at = path(f"{table_path}/_states/{version - 2}.json")
    if not fs.exists(at):
        return []
    stream = fs.open(at)
    try:
        parts = list(json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["parts"].values())
    finally:
        stream.close()
    fs.delete(at, False)
    return parts


def export_json(records: DataFrame, path: str) -> None:
    """A whole-table JSON export, one record a line."""
    records.write.mode("overwrite").json(path)
