"""Relationships between documents: explicit links, ranked and capped edges, coverage, and the graph over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import folder_of, linked_path, markdown_links

DISPLAYED, STORED = 8, 32
#: Numbers of documents that a running sum takes at once.
DIVISION = 65_536


def explicit_links(texts: DataFrame, files: DataFrame, key: str, scope: str, path: str, text: str) -> DataFrame:
    """(scope, source, target, raw_target, n): links of each document to another one of its scope; self-links are dropped.

    `files` has key, scope and path.  A link that leads nowhere has a null target.  Null texts have no links.
    """
    known = files.select(F.col(key).alias("source"), F.col(scope).alias("scope"), F.col(path).alias("path")).filter("source IS NOT NULL AND scope IS NOT NULL AND path IS NOT NULL").distinct()
    # the cheap test keeps most texts out of the pattern and out of the join
    raw = texts.filter(F.col(text).contains("](")).select(F.col(key).alias("source"), F.col(text).alias("text")).distinct().select("source", F.explode(markdown_links(F.col("text"))).alias("raw_target"))
    counted = raw.groupBy("source", "raw_target").agg(F.count("*").alias("n"))
    led = counted.join(known, "source").withColumn("to", linked_path(F.col("path"), F.col("raw_target")))
    target = known.groupBy("scope", F.col("path").alias("to")).agg(F.min("source").alias("target"))
    return led.join(target, ["scope", "to"], "left").filter("target IS NULL OR target <> source").select("scope", "source", "target", "raw_target", "n")


def ranked_at_either_end(edges: DataFrame, left: str, right: str, score: str, most: int = DISPLAYED, kind: str | None = None) -> DataFrame:
    """Edges among the `most` best of at least one of their ends (per kind): best score first, then the smaller other end."""
    both = _ends(edges, left, right, score, kind)
    kept = both.filter(F.col("__rank") <= most).select(left, right, *([kind] if kind else [])).distinct()
    return edges.join(kept, [left, right, *([kind] if kind else [])], "left_semi")


def capped_at_both_ends(edges: DataFrame, left: str, right: str, score: str, most: int = STORED, kind: str | None = None) -> DataFrame:
    """Edges among the `most` best of both their ends: the batch form of evicting the weakest from a full end."""
    keys = [left, right, *([kind] if kind else [])]
    both = _ends(edges, left, right, score, kind).groupBy(*keys).agg(F.max("__rank").alias("__worst")).filter(F.col("__worst") <= most)
    return edges.join(both.select(*keys), keys, "left_semi")


def _ends(edges: DataFrame, left: str, right: str, score: str, kind: str | None) -> DataFrame:
    keep = [left, right, score, *([kind] if kind else [])]
    ends = edges.select(*keep, F.explode(F.array(F.struct(F.col(left).alias("at"), F.col(right).alias("other")), F.struct(F.col(right).alias("at"), F.col(left).alias("other")))).alias("e"))
    by = f"{kind + ', ' if kind else ''}e.at"
    return ends.withColumn("__rank", F.expr(f"row_number() OVER (PARTITION BY {by} ORDER BY {score} DESC, e.other)"))


def graph_pairs(links: DataFrame, left: str, right: str) -> DataFrame:
    """(a, b, n, mutual): every unordered pair once."""
    low, high = F.least(left, right), F.greatest(left, right)
    return links.filter(f"{left} IS NOT NULL AND {right} IS NOT NULL AND {left} <> {right}").groupBy(low.alias("a"), high.alias("b")).agg(F.count("*").alias("n"), (F.count_distinct(F.col(left) < F.col(right)) > 1).alias("mutual"))


def degrees(pairs: DataFrame, nodes: DataFrame | None = None, node: str = "node") -> DataFrame:
    """(node, degree) over pairs (a, b); with `nodes`, isolated ones have 0."""
    counted = pairs.select(F.explode(F.array("a", "b")).alias(node)).groupBy(node).agg(F.count("*").alias("degree"))
    return counted if nodes is None else nodes.select(node).distinct().join(counted, node, "left").fillna(0, ["degree"])


def neighbourhood(pairs: DataFrame, seeds: DataFrame, depth: int, node: str = "node") -> DataFrame:
    """(node, hops): what at most `depth` undirected hops reach from the seeds, with the least number of hops."""
    both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(pairs.select(F.col("b").alias("u"), F.col("a").alias("v")))
    reached = seeds.select(node).distinct().withColumn("hops", F.lit(0))
    for hop in range(1, depth + 1):
        edge = reached.filter(F.col("hops") == hop - 1).join(both, F.col(node) == F.col("u")).select(F.col("v").alias(node), F.lit(hop).alias("hops"))
        reached = reached.unionByName(edge).groupBy(node).agg(F.min("hops").alias("hops"))
    return reached


def folder_spread(pairs: DataFrame, files: DataFrame, key: str, path: str) -> DataFrame:
    """(folder, files): how many distinct linked files lie in each folder."""
    linked = pairs.select(F.explode(F.array("a", "b")).alias(key)).distinct()
    return files.select(key, path).distinct().join(linked, key, "left_semi").groupBy(folder_of(F.col(path)).alias("folder")).agg(F.count_distinct(key).alias("files"))


def pair_coverage(admitted: DataFrame, scope: list[str], seq: str, cursor: str) -> DataFrame:
    """Per scope: documents, pairs admitted, pairs compared, pairs remaining and the state.

    Each document's cursor is the last partner it was compared with; a document owes the partners before it in seq.
    Pairs are counted by one running sum over documents and cursors in order, never by joining them.
    """
    marks = admitted.select(*scope, F.col(seq).alias("at"), F.lit(0).alias("is_cursor")).unionByName(admitted.select(*scope, F.least(F.col(cursor), F.col(seq) - 1).alias("at"), F.lit(1).alias("is_cursor")))
    keys = ", ".join(scope)
    # a running sum in two steps: over divisions of the numbers, and inside each of them, so that a scope is no one task
    part = marks.withColumn("__part", F.floor(F.col("at") / DIVISION))
    whole = part.groupBy(*scope, "__part").agg(F.sum(1 - F.col("is_cursor")).alias("__m"))
    ahead = whole.withColumn("__ahead", F.expr(f"coalesce(sum(__m) OVER (PARTITION BY {keys} ORDER BY __part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)")).drop("__m")
    inside = part.withColumn("__before", F.expr(f"sum(1 - is_cursor) OVER (PARTITION BY {keys}, __part ORDER BY at, is_cursor ROWS UNBOUNDED PRECEDING)"))
    counted = inside.join(ahead, [*scope, "__part"]).withColumn("before", F.col("__before") + F.col("__ahead"))
    told = counted.groupBy(*scope).agg(F.sum(1 - F.col("is_cursor")).alias("documents"), F.sum(F.when(F.col("is_cursor") == 1, F.col("before")).otherwise(0)).alias("compared"))
    pairs = (F.col("documents") * (F.col("documents") - 1) / 2).cast("bigint")
    return told.select(*scope, "documents", pairs.alias("pairs"), "compared", (pairs - F.col("compared")).alias("remaining"), F.when(pairs == F.col("compared"), "complete").otherwise("partial").alias("state"))


def connections(edges: DataFrame, left: str, right: str, kind: str, score: str) -> DataFrame:
    """(document, other, kind, direction, score, n): what each document is connected with, one row per kind and partner."""
    out = edges.select(F.col(left).alias("document"), F.col(right).alias("other"), F.col(kind).alias("kind"), F.col(score).alias("score"), F.lit("out").alias("way"))
    back = edges.select(F.col(right).alias("document"), F.col(left).alias("other"), F.col(kind).alias("kind"), F.col(score).alias("score"), F.lit("in").alias("way"))
    told = out.unionByName(back).filter("document <> other").groupBy("document", "other", "kind").agg(F.count_distinct("way").alias("ways"), F.min("way").alias("way"), F.max("score").alias("score"), F.count("*").alias("n"))
    return told.select("document", "other", "kind", F.when(F.col("ways") > 1, "mutual").otherwise(F.col("way")).alias("direction"), "score", "n")


def invalid_relations(edges: DataFrame, left: str, right: str, score: str, evidence: str) -> DataFrame:
    """`edges` with fault: selfRelation, badScore or missingEvidence, null if sound.

    A sound edge has two different ends, a null or finite score of 0 to 1, and in `evidence` (array of struct with
    document and content_hash) passages of both ends, each end of one revision.
    """
    of = lambda end: F.filter(evidence, lambda p: p["document"] == F.col(end))
    one = lambda end: (F.size(of(end)) > 0) & (F.size(F.array_distinct(F.transform(of(end), lambda p: p["content_hash"]))) == 1)
    s = F.col(score)
    fault = F.when(F.col(left) == F.col(right), "selfRelation").when(s.isNotNull() & (F.isnan(s) | (s < 0) | (s > 1)), "badScore").when(~F.coalesce(one(left) & one(right), F.lit(False)), "missingEvidence")
    return edges.withColumn("fault", fault)


def merged_relations(sources: list[DataFrame], keys: list[str]) -> DataFrame:
    """The union of several lists; of equal relations the one of the first list stays."""
    whole = None
    for n, df in enumerate(sources):
        part = df.withColumn("__list", F.lit(n))
        whole = part if whole is None else whole.unionByName(part, allowMissingColumns=True)
    return whole.withColumn("__turn", F.expr(f"row_number() OVER (PARTITION BY {', '.join(keys)} ORDER BY __list)")).filter("__turn = 1").drop("__turn", "__list")


def map_subset(pairs: DataFrame, files: DataFrame, key: str, path: str, centre: int | str | None = None, most: int = 400) -> DataFrame:
    """(key, hops): what a map shows - the neighbourhood of the centre (by default the file of the highest degree, first
    path) at depth 2, at depth 1 if that is too much, cut by path if that is still too much."""
    if centre is None:
        best = degrees(pairs, node=key).join(files.select(key, path).distinct(), key).orderBy(F.desc("degree"), path).first()
        if best is None:
            return files.select(key, F.lit(0).alias("hops")).limit(0)
        centre = best[key]
    kind = dict(files.dtypes)[key]
    seeds = files.sparkSession.createDataFrame([(centre,)], f"{key} {kind}")
    for depth in (2, 1):
        got = neighbourhood(pairs, seeds, depth, key)
        if got.limit(most + 1).count() <= most:
            return got
    return got.join(files.select(key, path).distinct(), key).orderBy("hops", path).limit(most).select(key, "hops")


def first_findings(duplicates: DataFrame, links: DataFrame, most: int = 3) -> DataFrame:
    """(kind, a, b, cross_folder): duplicates first, then links between folders, then others; each unordered pair once.

    Both inputs have a, b, folder_a and folder_b.
    """
    both = duplicates.withColumn("kind", F.lit(0)).unionByName(links.withColumn("kind", F.lit(1)))
    pairs = both.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("kind").alias("kind"), F.bool_or(F.col("folder_a") != F.col("folder_b")).alias("cross_folder"))
    return pairs.orderBy("kind", F.desc("cross_folder"), "a", "b").limit(most).select(F.when(F.col("kind") == 0, "duplicate").otherwise("link").alias("kind"), "a", "b", "cross_folder")


def pair_evidence(scores: DataFrame, left: str, right: str, left_at: str, right_at: str, cosine: str, least: float = 0.80, most: int = 6) -> DataFrame:
    """(a, b, best, at_a, at_b, n, evidence): per two documents (a < b) the best pair of passages and up to `most` of
    those from cosine `least` on, best first; ties go to the smaller place in a, then in b.

    `scores` are pairs of passages that a search has found, so nothing is joined: one aggregation over a few numbers.
    """
    swap = F.col(left) > F.col(right)
    turned = scores.filter(F.col(cosine).isNotNull() & ~F.isnan(cosine) & (F.col(left) != F.col(right))).select(
        F.least(left, right).alias("a"), F.greatest(left, right).alias("b"), F.col(cosine).cast("double").alias("c"),
        F.when(swap, F.col(right_at)).otherwise(F.col(left_at)).alias("at_a"), F.when(swap, F.col(left_at)).otherwise(F.col(right_at)).alias("at_b"),
    ).groupBy("a", "b", "at_a", "at_b").agg(F.max("c").alias("c"))
    ranked = turned.withColumn("__n", F.expr("row_number() OVER (PARTITION BY a, b ORDER BY c DESC, at_a, at_b)")).filter(F.col("__n") <= most)
    sound = F.when(F.col("c") >= least, F.struct("__n", "at_a", "at_b"))
    told = ranked.groupBy("a", "b").agg(F.min_by(F.struct("c", "at_a", "at_b"), "__n").alias("x"), F.array_sort(F.collect_list(sound)).alias("e"))
    return told.select("a", "b", F.col("x.c").alias("best"), F.col("x.at_a").alias("at_a"), F.col("x.at_b").alias("at_b"), F.size("e").alias("n"), F.transform("e", lambda y: F.struct(y["at_a"].alias("at_a"), y["at_b"].alias("at_b"))).alias("evidence"))


def edge_origin(kind: Column) -> tuple[Column, Column]:
    """(origin, confirmed) of a relation by its kind: what is read from the files themselves is confirmed, all else is to be checked."""
    origin = F.when(kind == "link", "document link").when(kind == "copy", "same bytes").when(kind == "model", "model").otherwise("embedding")
    return origin, kind.isin("link", "copy")


def starting_files(files: DataFrame, key: str, path: str, kind: str, value: str | None = None, hits: DataFrame | None = None) -> DataFrame:
    """(key) of the files a map starts from: all, one file, the files below a folder ('' for all), or the hits of a topic."""
    ids = files.select(key, path).distinct()
    if kind == "file":
        ids = ids.filter(F.col(key).cast("string") == str(value))
    elif kind == "folder":
        ids = ids.filter(F.col(path).startswith(f"{value}/")) if value else ids
    elif kind == "topic":
        ids = ids.join(hits.select(key).distinct(), key, "left_semi") if hits is not None else ids.limit(0)
    elif kind != "all":
        raise ValueError(kind)
    return ids.select(key)


def touching(pairs: DataFrame, start: DataFrame, key: str) -> DataFrame:
    """The pairs (a, b) of which at least one end is in `start`."""
    s = start.select(F.col(key).alias("__s")).distinct()
    a, b = pairs.join(s, F.col("a") == F.col("__s"), "left_semi"), pairs.join(s, F.col("b") == F.col("__s"), "left_semi")
    return a.unionByName(b).distinct()


def summary_scope(pairs: DataFrame, focus: int | str | None = None, most: int = 50) -> DataFrame:
    """(document, place): the documents a summary of relations looks at - the focus, the ends of its strongest pairs, the
    ends of the strongest pairs of all - in the order in which they come up.

    `pairs` has a, b and strength; equal strengths go by a, then b.  Only the first pairs can matter: of each list as many
    as documents are wanted are put in order, by a top-k.
    """
    spark = pairs.sparkSession
    order = [F.desc("strength"), F.asc("a"), F.asc("b")]
    kind = dict(pairs.dtypes)["a"]
    empty = pairs.select("a", "b", "strength").limit(0)
    near = pairs.filter((F.col("a") == F.lit(focus)) | (F.col("b") == F.lit(focus))).select("a", "b", "strength").orderBy(*order).limit(most) if focus is not None else empty
    top = pairs.select("a", "b", "strength").orderBy(*order).limit(most)
    both = near.withColumn("part", F.lit(1)).unionByName(top.withColumn("part", F.lit(2)))
    placed = both.withColumn("n", F.expr("row_number() OVER (PARTITION BY part ORDER BY strength DESC, a, b)"))
    ends = placed.select("part", "n", F.posexplode(F.array("a", "b")).alias("end", "document"))
    if focus is not None:
        own = pairs.filter((F.col("a") == F.lit(focus)) | (F.col("b") == F.lit(focus))).limit(1)
        ends = own.select(F.lit(0).alias("part"), F.lit(0).alias("n"), F.lit(0).alias("end"), F.lit(focus).cast(kind).alias("document")).unionByName(ends)
    first = ends.groupBy("document").agg(F.min(F.struct("part", "n", "end")).alias("x")).orderBy("x").limit(most)
    return first.select("document", F.expr("row_number() OVER (ORDER BY x)").alias("place"))


def summary_selection(relations_: DataFrame, scope: DataFrame, focus: int | str | None = None, most: int = 8) -> DataFrame:
    """(source, target, kind, score, place, passages): the relations inside a scope whose passages a summary reads.

    `relations_` has source, target, kind (link, shared-fact, similarity), score and passages (array of struct document,
    start, end).  Relations of the focus first, then by kind, the higher score, source and target; passages are taken in
    that order, each once, until `most` are held; relations that add none to them are left out.
    """
    inside = scope.select("document")
    met = relations_.join(inside.withColumnRenamed("document", "source"), "source", "left_semi").join(inside.withColumnRenamed("document", "target"), "target", "left_semi").filter(F.size("passages") > 0)
    far = F.lit(1) if focus is None else F.when((F.col("source") == F.lit(focus)) | (F.col("target") == F.lit(focus)), 0).otherwise(1)
    rank = F.when(F.col("kind") == "link", 0).when(F.col("kind") == "shared-fact", 1).otherwise(2)
    ranked = met.withColumns({"__far": far, "__rank": rank, "__score": F.when(F.col("kind") == "link", F.lit(0.0)).otherwise(F.coalesce(F.col("score").cast("double"), F.lit(0.0)))})
    # a scope has a bounded number of documents, so its relations are few and may be put in one order
    placed = ranked.withColumn("place", F.expr("row_number() OVER (ORDER BY __far, __rank, __score DESC, source, target)"))
    each = placed.select("place", F.posexplode("passages").alias("n", "p"))
    first = each.groupBy("p").agg(F.min(F.struct("place", "n")).alias("x"))
    held = first.select("p", F.col("x.place").alias("place"), F.expr("row_number() OVER (ORDER BY x)").alias("turn")).filter(F.col("turn") <= most)
    kept = held.groupBy("place").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "p"))), lambda y: y["p"]).alias("taken"))
    return placed.join(kept, "place").select("source", "target", "kind", "score", "place", F.col("taken").alias("passages"))


def next_job(pending: DataFrame, scope: str, seq: str, pointers: DataFrame, pointer: str) -> DataFrame:
    """(scope, seq) of the next piece of work of each scope: the first at or after its pointer, else the first of all."""
    at = pending.join(pointers.select(scope, pointer), scope, "left")
    best = at.groupBy(scope).agg(F.min(F.struct((F.col(seq) < F.coalesce(pointer, F.lit(0))).alias("wrapped"), F.col(seq).alias("s"))).alias("x"))
    return best.select(scope, F.col("x.s").alias(seq))
