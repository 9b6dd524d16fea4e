"""Problem 9: long stretches that stand verbatim in more than one document.

Content-defined chunking with a gear rolling hash: a position's hash depends on the last `GEAR` characters only, and
a position is a cut where its hash is the least of some `WINDOW` consecutive ones (cut points are therefore at most
WINDOW apart and do not depend on what stands further away).  At each cut begins a variable chunk that ends at the
first cut at least `STEP` characters on; chunks begin at every cut and so overlap.  Any stretch of
GEAR - 1 + 2 * WINDOW + STEP <= `length` characters that two texts share holds a whole chunk that both have, wherever
the stretch stands, so no stretch of that length is missed.  Chunks are at least GEAR + STEP characters long, which
keeps shorter standing phrases apart.

Equal digests are followed by an exact comparison of the characters around the chunk, as far as a stretch of
`length` can reach.  Digests of more than `HOT` chunks, and those of repeated characters, are not compared pair by pair:
each text gets a key of 128 bits for every window of `length` characters that holds such a chunk, and only equal windows
meet.  Parts come from counts per window, and pairs of documents are enumerated only where they are what is asked for,
once per set of documents that have a window in common, or of places where they have it.

Digests that hold a noticeable share of all chunks are found on a sample of the documents (at most `SHARES` digests,
whatever the size of the input); their rows are known to be shared and take no part in the grouping by digest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..operators.search import merged_intervals
from ..plans.staging import stage

GEAR, WINDOW = 16, 60
HOT = 64
#: One document in SAMPLE is looked at for frequent digests: those with SEEN chunks and 1 / SHARES of all in the sample.
SAMPLE, SEEN, SHARES = 64, 16, 10_000
#: Parts that the rows of a frequent digest are dealt to.
SALTS = 256
BATCH_CHARS = 300_000
_PAD_A, _PAD_B = "\U0010fffe", "\U0010ffff"
_BASE = np.uint64(0xD1342543DE82EF95)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _inverse(x: int) -> int:
    return pow(x, -1, 1 << 64)


def _gear(codes: np.ndarray) -> np.ndarray:
    """64 pseudo-random bits of each character."""
    x = (codes.astype(np.uint64) + np.uint64(1)) * _MIX
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or next(iter(_powers)) < n:
        _powers.clear()
        size = max(n, BATCH_CHARS * 2)
        one = np.ones(size, np.uint64)
        for base in ((up := one.copy()), (down := one.copy())):
            base[1:] = _BASE if base is up else np.uint64(_inverse(int(_BASE)))
        _powers[size] = (np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64))
    return next(iter(_powers.values()))


def chunks(texts: list[str], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, start, last start, size, digest) of every chunk of the texts, positions in characters of each text.

    A run of overlapping chunks with one digest (repeated characters) is one row, from its first start to its last.
    """
    step = length - GEAR + 1 - 2 * WINDOW - 1
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    starts = ends - sizes
    none = np.empty(0, np.int64)
    if len(codes) < GEAR + WINDOW:
        return none, none, none, none, none
    wide = _gear(codes)
    h = (wide >> np.uint64(32)).astype(np.uint32)
    for k in (1, 2, 4, 8):
        h[k:] = h[k:] + (h[:-k] << np.uint32(2 * k))
    least = (h.astype(np.uint64) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
    for k in (1, 2, 4, 8, 16):
        least = np.minimum(least[:-k], least[k:])
    least = np.minimum(least[: len(h) - WINDOW + 1], least[WINDOW - 32 : WINDOW - 32 + len(h) - WINDOW + 1])
    owner = np.repeat(np.arange(len(texts)), sizes)
    at = np.arange(len(least))
    own = owner[: len(least)]
    valid = (at >= starts[own] + GEAR - 1) & (at + WINDOW <= ends[own])
    cut = (least[valid] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    if not len(cut):
        return none, none, none, none, none
    cut = cut[np.concatenate(([True], cut[1:] != cut[:-1]))]
    to = np.searchsorted(cut, cut + step)
    inside = to < len(cut)
    cut_from, cut_to = cut[inside], cut[to[inside]]
    doc = owner[cut_from]
    same = doc == owner[cut_to]
    doc, a, b = doc[same], cut_from[same] - (GEAR - 1), cut_to[same] + 1
    up, down = _power(len(codes) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(wide * up[: len(wide)], dtype=np.uint64)))
    digest = (sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64) * _MIX
    digest = (digest ^ (digest >> np.uint64(31))) * _MIX
    digest ^= digest >> np.uint64(29)
    again = np.zeros(len(a) + 1, bool)
    again[1:-1] = (digest[1:] == digest[:-1]) & (doc[1:] == doc[:-1]) & (a[1:] < b[:-1])
    first, last = ~again[:-1], ~again[1:]
    at = a - starts[doc]
    return doc[first], at[first], at[last], (b - a)[first], digest[first].view(np.int64)


_FOUND = "doc bigint, start int, last int, size int, digest bigint"


def _chunked(length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def emit(ids: list, texts: list):
            doc, start, last, size, digest = chunks(texts, length)
            return pd.DataFrame({"doc": np.asarray(ids, np.int64)[doc] if len(ids) else doc, "start": start.astype(np.int32), "last": last.astype(np.int32), "size": size.astype(np.int32), "digest": digest})

        for pdf in batches:
            ids, texts, held = [], [], 0
            for i, t in zip(pdf["doc"], pdf["text"]):
                ids.append(i)
                texts.append(t)
                held += len(t)
                if held >= BATCH_CHARS:
                    yield emit(ids, texts)
                    ids, texts, held = [], [], 0
            if ids:
                yield emit(ids, texts)
    return run


_CUT = "digest bigint, doc bigint, start int, before string, chunk string, after string, key_a bigint, key_b bigint, step int, times int"


def window_keys(text: str, chunks_: list[tuple[int, int, int]], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, keys, keys) of the windows of `length` characters of the text that hold one of the chunks (first start, last start, size)."""
    n = len(text) - length + 1
    edge = np.zeros(max(n, 0) + 1, np.int64)
    for first, last, size in chunks_:
        a, b = max(0, first + size - length), min(last, n - 1)
        if a <= b:
            edge[a] += 1
            edge[b + 1] -= 1
    at = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    up, down = _power(len(codes) + 1)
    keys = []
    for turn in (np.uint32(0), np.uint32(0x40000000)):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_gear(codes ^ turn) * up[: len(codes)], dtype=np.uint64)))
        k = (sums[at + length] - sums[at]) * down[at] * _MIX
        keys.append((k ^ (k >> np.uint64(31))).view(np.int64))
    return at, keys[0], keys[1]


def _places(at: np.ndarray, one: np.ndarray, two: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(first start, keys, keys, step, times): equal windows of a text that overlap by half or more, at equal steps, as one row."""
    order = np.lexsort((at, two, one))
    at, one, two = at[order], one[order], two[order]
    gap = np.zeros(len(at) + 1, np.int64)  # from the window before, 0 where a row must begin
    if len(at):
        near = at[1:] - at[:-1]
        gap[1:-1] = np.where((one[1:] == one[:-1]) & (two[1:] == two[:-1]) & (near <= length // 2), near, 0)
    before = np.concatenate(([0], gap[:-1]))
    first = np.flatnonzero(((gap == 0) | ((before > 0) & (gap != before)))[:-1])
    times = np.diff(np.append(first, len(at)))
    return at[first], one[first], two[first], np.where(times > 1, gap[first + 1], 1), times


def _windows(length: int):
    """Of each candidate chunk its characters and as many before and after it as a stretch can need; of the hot ones
    of a text the keys of the windows that hold them."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out, held = [], [(np.empty(0, np.int64),) * 6]
            for doc, text, found in zip(pdf["doc"], pdf["text"], pdf["found"]):
                hot = []
                for x in found:
                    s, e = x["start"], x["start"] + x["size"]
                    if x["hot"]:
                        hot.append((s, x["last"], x["size"]))
                    else:
                        need = max(0, length - x["size"])
                        out.append((x["digest"], doc, s, text[max(0, s - need) : s], text[s:e], text[e : e + need]))
                if hot:
                    at, one, two, step, times = _places(*window_keys(text, hot, length), length)
                    held.append((np.full(len(at), doc), at, one, two, step, times))
            yield pd.DataFrame(out, columns=["digest", "doc", "start", "before", "chunk", "after"]).assign(key_a=None, key_b=None, step=None, times=None)
            doc, at, one, two, step, times = (np.concatenate(c) for c in zip(*held))
            for k in range(0, len(doc), 200_000):
                part = slice(k, k + 200_000)
                yield pd.DataFrame({"digest": None, "doc": doc[part], "start": at[part].astype(np.int32), "before": None, "chunk": None, "after": None, "key_a": one[part], "key_b": two[part], "step": step[part].astype(np.int32), "times": times[part].astype(np.int32)})
    return run


def _matched(before: pd.Series, pad: str, width: int, reverse: bool) -> np.ndarray:
    whole = "".join((s[::-1] if reverse else s).ljust(width, pad) for s in before)
    return np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(before), width)


def _common(a: pd.Series, b: pd.Series, width: int, reverse: bool) -> np.ndarray:
    """How many characters the two sides share from the chunk outward."""
    if not width:
        return np.zeros(len(a), np.int64)
    same = _matched(a, _PAD_A, width, reverse) == _matched(b, _PAD_B, width, reverse)
    return np.where(same.all(axis=1), width, same.argmin(axis=1))


def _compared(length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf[pdf["chunk_a"] == pdf["chunk_b"]]
            width = max(0, length - GEAR)
            left = _common(pdf["before_a"], pdf["before_b"], width, True)
            right = _common(pdf["after_a"], pdf["after_b"], width, False)
            size = left + pdf["chunk_a"].str.len().to_numpy(np.int64) + right
            ok = size >= length
            yield pd.DataFrame({"doc_a": pdf["doc_a"][ok], "doc_b": pdf["doc_b"][ok], "start_a": (pdf["start_a"] - left)[ok], "start_b": (pdf["start_b"] - left)[ok], "size": size[ok]})
    return run


def _rows(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(key).cast("bigint").alias("doc"), F.col(text).alias("text")).filter("doc IS NOT NULL AND text IS NOT NULL")


def copies_of(df: DataFrame, key: str, text: str) -> DataFrame:
    """(id, rep, n_chars) of every row with id and text: rep is the smallest id with the same text, as in shared_spans."""
    named = _rows(df, key, text).select("doc", F.unhex(F.md5("text")).alias("hash"), F.length("text").alias("n_chars"))
    first = named.groupBy("hash").agg(F.min("doc").alias("rep"))
    return named.join(first, "hash").select(F.col("doc").alias("id"), "rep", "n_chars").distinct()


def _frequent(rows: DataFrame, length: int) -> DataFrame:
    """(digest): at most SHARES digests that a sample shows in several texts and in a noticeable share of all chunks."""
    seen = rows.filter(F.pmod(F.xxhash64("doc"), F.lit(SAMPLE)) == 0).mapInPandas(_chunked(length), _FOUND)
    counted = stage(seen.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc").alias("low"), F.max("doc").alias("high")), "seen")
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    return counted.join(F.broadcast(total)).filter((F.col("low") < F.col("high")) & (F.col("n") >= SEEN) & (F.col("n") * SHARES >= F.col("total"))).select("digest")


def _candidates(df: DataFrame, key: str, text: str, length: int) -> tuple[DataFrame, DataFrame]:
    """(members, windows): who has which text, and the surroundings of every chunk that stands in several different texts."""
    if length < GEAR + 2 * WINDOW + 8:
        raise ValueError(f"length must be at least {GEAR + 2 * WINDOW + 8}")
    rows = _rows(df, key, text)
    members = stage(copies_of(df, key, text), "members")
    copies = members.filter("id <> rep").select(F.col("id").alias("doc"))
    long_ = rows.filter(F.length("text") >= length)
    found = long_.mapInPandas(_chunked(length), _FOUND)
    marked = found.join(F.broadcast(_frequent(long_, length).withColumn("frequent", F.lit(True))), "digest", "left")
    over = lambda x, by: F.expr(f"{x} OVER (PARTITION BY {by})")
    # rows of a frequent digest are known to be shared: they are dealt out and not looked at together
    dealt = f"digest, CASE WHEN frequent THEN pmod(xxhash64(doc), {SALTS}) END"
    met = marked.withColumns({"low": over("min(doc)", dealt), "high": over("max(doc)", dealt)}).filter("frequent OR low < high").select("doc", "start", "last", "size", "digest", F.coalesce("frequent", F.lit(False)).alias("often"))
    # copies are put aside only now, where few narrow rows are left; what they alone shared goes with them
    apart = stage(met.join(copies, "doc", "left_anti"), "apart")
    again = apart.filter("NOT often").withColumns({"low": over("min(doc)", "digest"), "high": over("max(doc)", "digest"), "n": over("count(*)", "digest"), "runs": over("max(last - start)", "digest")}).filter("low < high")
    hot = apart.filter("often").select("doc", "digest", "start", "last", "size", F.lit(True).alias("hot"))
    # a chunk inside a run may be the only one that two stretches have in common: all windows over the run are met
    candidates = again.select("doc", "digest", "start", "last", "size", ((F.col("n") > HOT) | (F.col("runs") > 0)).alias("hot")).unionByName(hot)
    by_doc = candidates.groupBy("doc").agg(F.collect_set(F.struct("digest", "start", "last", "size", "hot")).alias("found"))
    return members, stage(long_.join(by_doc, "doc").mapInPandas(_windows(length), _CUT), "windows")


_STRETCH = "doc_a bigint, doc_b bigint, start_a int, start_b int, size int"


def _pairwise(windows: DataFrame, length: int) -> DataFrame:
    """The stretches around chunks of at most HOT texts, text by text."""
    plain = windows.filter("key_a IS NULL").drop("key_a", "key_b", "step", "times").distinct()
    side = lambda x: plain.select("digest", *(F.col(c).alias(f"{c}_{x}") for c in ("doc", "start", "before", "chunk", "after")))
    return side("a").join(side("b"), "digest").filter("doc_a < doc_b").drop("digest").mapInPandas(_compared(length), _STRETCH)


_KEYS = ["key_a", "key_b"]


def _shared_windows(windows: DataFrame) -> DataFrame:
    """The places (start, step, times) of the windows around hot chunks that several texts have, with the first of each; counted before they are met, so no pair is formed."""
    keyed = windows.filter("key_a IS NOT NULL").select(*_KEYS, "doc", "start", "step", "times")
    held = keyed.groupBy(*_KEYS).agg(F.min(F.struct("doc", "start")).alias("first"), F.max("doc").alias("high")).filter("first.doc < high")
    return keyed.join(held.select(*_KEYS, "first"), _KEYS)


def _laid(places: DataFrame, length: int, pairs: str) -> DataFrame:
    """(doc_a, doc_b, shift, s, e): pieces of the stretches that two texts of `pairs` have in common, from the places of equal windows.

    Windows that follow one another in the same places of the same texts are met once.  Where both texts repeat the
    window, each way to lay them over one another is a row.
    """
    met = stage(places.distinct(), "met")
    at = ["doc", F.col("start") - F.col("first.start"), "step", "times"]
    sets = met.groupBy(*_KEYS, "first").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*at)).alias("mark"), F.bit_xor(F.xxhash64(*at, F.lit(1))).alias("mark_b"))
    kind = "first.doc, n, mark, mark_b"
    numbered = sets.withColumn("island", F.expr(f"first.start - row_number() OVER (PARTITION BY {kind} ORDER BY first.start)"))
    one = numbered.groupBy("first.doc", "n", "mark", "mark_b", "island").agg(F.min_by(F.struct(*_KEYS), "first.start").alias("k"), F.count("*").alias("more"))
    kept = stage(met.join(one.select("k.key_a", "k.key_b", "more"), _KEYS).select(*_KEYS, F.col("first.doc").alias("low"), (F.col("more") - 1 + length).cast("int").alias("size"), "doc", "start", "step", "times"), "kept")
    side = lambda x: kept.select(*_KEYS, "low", "size", *(F.col(c).alias(f"{c}_{x}") for c in ("doc", "start", "step", "times")))
    both = side("a").join(side("b").drop("low", "size"), _KEYS).filter(pairs)
    uneven = "step_a <> step_b AND times_a > 1 AND times_b > 1"  # then the places of the one are laid on those of the other singly
    each = both.withColumn("i", F.explode(F.expr(f"CASE WHEN {uneven} THEN sequence(0, times_a - 1) ELSE array(0) END")))
    laid = each.select("doc_a", "doc_b", F.expr("start_a + i * step_a AS at_a"), "start_b", "size", "times_b", F.expr(f"CASE WHEN {uneven} THEN 1 ELSE times_a END AS times_a"), F.expr("CASE WHEN times_b > 1 THEN step_b ELSE step_a END AS step"))
    moved = laid.withColumn("by", F.explode(F.expr("sequence(1 - times_b, times_a - 1)")))
    return moved.selectExpr("doc_a", "doc_b", "at_a - start_b + by * step AS shift", "at_a + greatest(0, by) * step AS s", "at_a + least(times_a, times_b + by) * step - step + size AS e")


def _hot_pairs(windows: DataFrame) -> DataFrame:
    """(doc_a, doc_b) that have a window around a hot chunk in common: windows of the same set of texts are met once."""
    keyed = stage(windows.filter("key_a IS NOT NULL").select(*_KEYS, "doc").distinct(), "keyed")
    sets = keyed.groupBy(*_KEYS).agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("doc")).alias("mark"), F.min("doc").alias("low"), F.max("doc").alias("high")).filter("n > 1")
    one = sets.groupBy("n", "mark", "low", "high").agg(F.min(F.struct(*_KEYS)).alias("k")).select("k.key_a", "k.key_b")
    kept = stage(keyed.join(one, _KEYS, "left_semi"), "kept")
    return kept.withColumnRenamed("doc", "doc_a").join(kept.withColumnRenamed("doc", "doc_b"), _KEYS).filter("doc_a < doc_b").select("doc_a", "doc_b")


def shared_pairs(df: DataFrame, key: str, text: str, length: int = 180) -> DataFrame:
    """Every pair (id_a < id_b) of rows whose texts share a stretch of at least `length` characters, copies included.

    Ids must be bigint.  Null ids and texts take no part, repeated rows count once, other columns are ignored, empty
    input gives empty results.  The narrow (digest, id, position) table is the only thing shuffled for all texts; a
    text is shuffled only to cut out the surroundings of its candidate chunks.
    """
    members, windows = _candidates(df, key, text, length)
    links = _pairwise(windows, length).select("doc_a", "doc_b").unionByName(_hot_pairs(windows)).distinct()
    a = members.select(F.col("rep").alias("doc_a"), F.col("id").alias("x"))
    b = members.select(F.col("rep").alias("doc_b"), F.col("id").alias("y"))
    across = links.join(a, "doc_a").join(b, "doc_b").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    long_ = members.filter(F.col("n_chars") >= length)
    several = long_.groupBy("rep").agg(F.count("*").alias("n")).filter("n > 1").select("rep")
    own = long_.join(several, "rep", "left_semi").select("rep", "id")
    within = own.withColumnRenamed("id", "id_a").join(own.withColumnRenamed("id", "id_b"), "rep").filter("id_a < id_b").select("id_a", "id_b")
    return across.unionByName(within)


def shared_parts(df: DataFrame, key: str, text: str, length: int = 180) -> DataFrame:
    """Per row with id and text: (id, n_chars, shared_chars, shared_part, n_stretches): how much of it stands elsewhere.

    A text with an equal copy of at least `length` characters is shared as a whole; parts that overlap or touch are
    one stretch; an empty text has part 0.  No pairs are formed where more than HOT texts share a chunk.
    """
    members, windows = _candidates(df, key, text, length)
    ends = lambda x: F.struct(F.col(f"doc_{x}").alias("rep"), F.col(f"start_{x}").alias("s"), (F.col(f"start_{x}") + F.col("size")).alias("e"))
    plain = _pairwise(windows, length).select(F.explode(F.array(ends("a"), ends("b"))).alias("x")).select("x.*")
    hot = _shared_windows(windows).select(F.col("doc").alias("rep"), F.col("start").alias("s"), (F.col("start") + (F.col("times") - 1) * F.col("step") + length).alias("e"))
    spans = plain.unionByName(hot).distinct()
    copied = members.filter(F.col("n_chars") >= length).groupBy("rep").agg(F.count("*").alias("n"), F.max("n_chars").alias("e")).filter("n > 1").select("rep", F.lit(0).alias("s"), "e")
    spans = stage(spans.unionByName(copied), "spans")
    opened = spans.withColumn("reach", F.expr("max(e) OVER (PARTITION BY rep ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"))
    numbered = opened.withColumn("island", F.expr("sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY rep ORDER BY s, e ROWS UNBOUNDED PRECEDING)"))
    merged = numbered.groupBy("rep", "island").agg((F.max("e") - F.min("s")).alias("n")).groupBy("rep").agg(F.sum("n").alias("shared_chars"), F.count("*").alias("n_stretches"))
    out = members.join(merged, "rep", "left").select("id", F.col("n_chars").cast("bigint"), F.coalesce("shared_chars", F.lit(0)).cast("bigint").alias("shared_chars"), F.coalesce("n_stretches", F.lit(0)).cast("bigint").alias("n_stretches"))
    return out.withColumn("shared_part", F.when(F.col("n_chars") > 0, F.col("shared_chars") / F.col("n_chars")).otherwise(0.0))


def _spans(windows: DataFrame, length: int, pairs: str) -> DataFrame:
    """(doc_a, doc_b, shift, s, e, n) of different texts; `pairs` says which are met around hot chunks."""
    plain = _pairwise(windows, length).select("doc_a", "doc_b", (F.col("start_a") - F.col("start_b")).alias("shift"), F.col("start_a").alias("s"), (F.col("start_a") + F.col("size")).alias("e"))
    return merged_intervals(plain.unionByName(_laid(_shared_windows(windows), length, pairs)).distinct(), ["doc_a", "doc_b", "shift"], "s", "e")


def shared_spans(df: DataFrame, key: str, text: str, length: int = 180) -> DataFrame:
    """(id_a, id_b, start_a, start_b, size): the common stretches in short form, in characters, joined where windows of one
    alignment overlap; one row per pair of different texts (their smallest ids) and alignment.  What more than HOT texts
    have is tied to every place in the smallest id that has it, so that the places of two others follow from two rows;
    shared_stretches has a row for each.  copies_of has the other ids of each text."""
    whole = _spans(_candidates(df, key, text, length)[1], length, "doc_a < doc_b AND doc_a = low")
    return whole.select(F.col("doc_a").alias("id_a"), F.col("doc_b").alias("id_b"), F.col("s").alias("start_a"), (F.col("s") - F.col("shift")).alias("start_b"), (F.col("e") - F.col("s")).alias("size"))


def _repeated(length: int):
    """The places of the windows that a text has more than once; keys are those of the one text."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for doc, text in zip(pdf["doc"], pdf["text"]):
                at, one, two, step, times = _places(*window_keys(text, [(0, len(text), 0)], length), length)
                begins = np.flatnonzero(np.concatenate(([True], (one[1:] != one[:-1]) | (two[1:] != two[:-1]))))
                n = np.diff(np.append(begins, len(at)))
                first, several = np.repeat(at[begins], n), np.repeat((n > 1) | (times[begins] > 1), n)
                own = np.array([doc], np.int64).view(np.uint64) * _MIX
                yield pd.DataFrame({"key_a": one ^ own.view(np.int64), "key_b": two, "doc": doc, "start": at, "step": step, "times": times, "first": first})[several]
    return run


def _repeats(texts: DataFrame, length: int) -> DataFrame:
    """(doc, s, later, size) of the stretches that a text has in common with itself."""
    places = texts.mapInPandas(_repeated(length), "key_a bigint, key_b bigint, doc bigint, start int, step int, times int, first int").withColumn("first", F.struct("doc", F.col("first").alias("start")))
    pieces = _laid(places, length, "doc_a = doc_b AND start_a <= start_b").filter("shift < 0").select(F.col("doc_a").alias("doc"), "shift", "s", "e").distinct()
    return merged_intervals(pieces, ["doc", "shift"], "s", "e").selectExpr("doc", "s", "s - shift AS later", "e - s AS size")


def shared_stretches(df: DataFrame, key: str, text: str, length: int = 180) -> DataFrame:
    """(id_a, id_b, start_a, start_b, size): every common stretch of at least `length` characters of every pair
    (id_a < id_b) of rows, copies included; one row per pair and alignment, none of which can be longer at either end.

    Inputs are as in shared_pairs, and the pairs are the same.
    """
    members, windows = _candidates(df, key, text, length)
    spans = _spans(windows, length, "doc_a < doc_b")
    a = members.select(F.col("rep").alias("doc_a"), F.col("id").alias("x"))
    b = members.select(F.col("rep").alias("doc_b"), F.col("id").alias("y"))
    turned = lambda of_a, of_b: F.when(F.col("x") < F.col("y"), of_a).otherwise(of_b)
    at_a, at_b = F.col("s").cast("int"), (F.col("s") - F.col("shift")).cast("int")
    across = spans.join(a, "doc_a").join(b, "doc_b").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), turned(at_a, at_b).alias("start_a"), turned(at_b, at_a).alias("start_b"), (F.col("e") - F.col("s")).cast("int").alias("size"))
    long_ = members.filter(F.col("n_chars") >= length)
    several = stage(long_.groupBy("rep").agg(F.count("*").alias("n"), F.first("n_chars").alias("size")).filter("n > 1"), "several")
    own = long_.join(several.select("rep"), "rep", "left_semi").select("rep", "id")
    within = own.withColumnRenamed("id", "id_a").join(own.withColumnRenamed("id", "id_b"), "rep").filter("id_a < id_b")
    again = _repeats(_rows(df, key, text).join(several.select(F.col("rep").alias("doc")), "doc", "left_semi"), length)
    both = again.selectExpr("doc AS rep", "explode(array(struct(s AS start_a, later AS start_b), struct(later AS start_a, s AS start_b))) AS at", "size").select("rep", "at.*", "size")
    places = both.unionByName(several.select("rep", F.lit(0).alias("start_a"), F.lit(0).alias("start_b"), "size"))
    copied = within.join(places, "rep").select("id_a", "id_b", F.col("start_a").cast("int"), F.col("start_b").cast("int"), F.col("size").cast("int"))
    return across.unionByName(copied)
