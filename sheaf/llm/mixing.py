"""Problem 8: mixing sources to target shares of tokens, by entropy balancing.

For each mix the total is the largest at which every source that has tokens at all can reach its share within its
repeats.  The rates r of a source's documents are those nearest to equal rates, in relative entropy and bounded by
max_repeats, that give the source its tokens: r = min(max_repeats, exp(l * x)) with x a document's tokens over the
source's mean.  A source that binds the total has every rate at max_repeats, in closed form.  The l of all others are
found together by Newton's method on the convex dual, held inside brackets: each iteration is one distributed
aggregation over the table of (source, size, number of documents) at the Newton point and at PROBES points that cut
the bracket, and only PROBES + 1 pairs of numbers per target come to the driver.  Rates become copies: the whole part, and one more for the documents with the largest (fraction minus
a hashed uniform number), as many as stay within the source's tokens (the cut is found by a histogram); a last document of the
nearest size fills what is missing.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from ..plans.staging import stage

ITERATIONS, TOLERANCE, PROBES = 12, 1e-9, 15
#: A tilt at which every document has the most repeats, and the least and largest tilt that is looked for.
ALL, BOUND = 1e12, 1e6
BUCKETS = 4096


def _sized_targets(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per target with what its source has: tokens, docs, and the tokens it shall give."""
    own = sized.filter("n_tokens > 0 AND source IS NOT NULL").groupBy("source").agg(F.sum("n_tokens").alias("available"), F.count("*").alias("docs"))
    told = targets.filter("mix_id IS NOT NULL AND source IS NOT NULL AND target_share > 0 AND max_repeats > 0").groupBy("mix_id", "source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    met = told.join(own, "source", "left").fillna(0, ["available", "docs"])
    reach = F.when(F.col("available") > 0, F.col("available") * F.col("max_repeats") / F.col("target_share"))
    total = met.groupBy("mix_id").agg(F.min(reach).alias("total"))
    return met.join(total, "mix_id").withColumn("wanted", F.when(F.col("available") > 0, F.col("target_share") * F.col("total")).otherwise(0.0))


def _points(low: float, high: float) -> list[float]:
    """Points that cut a bracket: even in value once it is narrow, even in order of magnitude about 0 before."""
    if high - low <= 4:
        return [low + (high - low) * (n + 1) / (PROBES + 1) for n in range(PROBES)]
    a, b = math.asinh(low), math.asinh(high)
    return [math.sinh(a + (b - a) * (n + 1) / (PROBES + 1)) for n in range(PROBES)]


def tilts(groups: DataFrame, targets: list) -> dict[tuple[str, str], float]:
    """The dual variable of each target; `groups` has source, n_tokens and docs, `targets` rows of _sized_targets.
    Raises ArithmeticError if a target is not met within ITERATIONS."""
    open_ = {(t["mix_id"], t["source"]): t for t in targets if t["available"] > 0}
    done = {k: ALL for k, t in open_.items() if t["wanted"] >= t["available"] * t["max_repeats"] * (1 - 1e-12)}
    at = {k: 0.0 for k in open_}
    bounds = {k: (-BOUND, BOUND) for k in open_}
    spark = groups.sparkSession
    for _ in range(ITERATIONS):
        rest = [k for k in open_ if k not in done]
        if not rest:
            return done
        asked = [(*k, n, float(l), float(open_[k]["max_repeats"]), open_[k]["available"] / open_[k]["docs"]) for k in rest for n, l in enumerate([at[k], *_points(*bounds[k])])]
        now = spark.createDataFrame(asked, "mix_id string, source string, n int, l double, most double, mean double")
        x = F.col("n_tokens") / F.col("mean")
        y = F.greatest(F.least(F.col("l") * x, F.lit(700.0)), F.lit(-700.0))
        r = F.least(F.col("most"), F.exp(y))
        bend = F.when(F.exp(y) < F.col("most"), r * x * F.col("n_tokens")).otherwise(0.0)
        sums = groups.join(F.broadcast(now), "source").groupBy("mix_id", "source", "n", "l").agg(F.sum(r * F.col("n_tokens") * F.col("docs")).alias("tokens"), F.sum(bend * F.col("docs")).alias("slope"))
        best: dict[tuple[str, str], tuple[float, float, float]] = {}
        for row in sums.collect():
            k = (row["mix_id"], row["source"])
            off = row["tokens"] - open_[k]["wanted"]
            low, high = bounds[k]
            bounds[k] = (low, min(high, row["l"])) if off > 0 else (max(low, row["l"]), high)
            if k not in best or abs(off) < abs(best[k][0]):
                best[k] = (off, row["l"], row["slope"])
        for k, (off, l, slope) in best.items():
            low, high = bounds[k]
            if abs(off) <= TOLERANCE * open_[k]["wanted"] or high - low <= 1e-13 * max(1.0, abs(l)):
                done[k] = l
                continue
            step = l - off / slope if slope > 0 else math.inf
            at[k] = step if low < step < high else (low + high) / 2
    if len(done) < len(open_):
        raise ArithmeticError(f"no rates found within {ITERATIONS} iterations for {sorted(set(open_) - set(done))}")
    return done


def mix(sized: DataFrame, targets: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(copies, shares).  copies: mix_id, key, source, n_tokens, copies (1 to max_repeats).  shares: per target the share
    wanted, the tokens available and given, documents used, and the share really reached.

    `sized` has key, source and n_tokens; documents without tokens, key or source are in no mix.  `targets` (mix_id,
    source, target_share, max_repeats) is a table of a few rows by design: one row per target comes to the driver.
    Targets with a null or non-positive share or repeats are left out of the mix; a source without documents gives 0
    tokens and is reported; the others keep their shares relative to one another.  Repeated keys count once.
    """
    docs = stage(sized.select(F.col(key).alias("id"), "source", "n_tokens").filter("id IS NOT NULL AND source IS NOT NULL AND n_tokens > 0").dropDuplicates(["id"]), "docs")
    wanted = _sized_targets(docs, targets).collect()
    groups = stage(docs.groupBy("source", "n_tokens").agg(F.count("*").alias("docs")), "sizes")
    found = tilts(groups, wanted)
    spark = docs.sparkSession
    plan = spark.createDataFrame(
        [(t["mix_id"], t["source"], float(found.get((t["mix_id"], t["source"]), 0.0)), int(t["max_repeats"]), float(t["available"] / t["docs"]) if t["docs"] else 1.0, float(t["wanted"]), float(t["target_share"]), int(t["available"])) for t in wanted],
        "mix_id string, source string, l double, most int, mean double, wanted double, target_share double, available bigint",
    )
    rated = docs.join(F.broadcast(plan), "source")
    rate = F.least(F.col("most").cast("double"), F.exp(F.least(F.col("l") * F.col("n_tokens") / F.col("mean"), F.lit(700.0))))
    chance = F.pmod(F.xxhash64("mix_id", "id"), F.lit(1 << 30)) / float(1 << 30)
    rated = rated.withColumn("rate", rate).withColumn("base", F.floor(F.col("rate") + 1e-9).cast("int")).withColumn("rank", F.when(F.col("base") < F.col("most"), F.col("rate") - F.col("base") - chance))
    rated = rated.withColumn("bucket", F.floor((1 - F.col("rank")) / 2 * BUCKETS).cast("int"))
    sums = rated.groupBy("mix_id", "source", "bucket").agg(F.sum("n_tokens").alias("tokens"), F.sum(F.col("base") * F.col("n_tokens")).alias("base_tokens"), F.max("wanted").alias("wanted"))
    ordered = sums.withColumn("before", F.expr("coalesce(sum(CASE WHEN bucket IS NULL THEN 0 ELSE tokens END) OVER (PARTITION BY mix_id, source ORDER BY bucket NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"))
    ordered = ordered.withColumn("missing", F.expr("wanted - sum(base_tokens) OVER (PARTITION BY mix_id, source)"))
    # the bucket in which the missing tokens are reached; at most one row per target
    edge = ordered.filter("bucket IS NOT NULL AND before < missing AND before + tokens >= missing").select("mix_id", "source", F.col("bucket").alias("edge"), (F.col("missing") - F.col("before")).alias("short"))
    last = ordered.groupBy("mix_id", "source").agg(F.max("missing").alias("missing"))
    marked = rated.join(F.broadcast(last), ["mix_id", "source"]).join(F.broadcast(edge), ["mix_id", "source"], "left")
    inside = marked.filter("bucket = edge").withColumn("run", F.expr("sum(n_tokens) OVER (PARTITION BY mix_id, source ORDER BY rank DESC, id)"))
    picked = inside.withColumn("more", (F.col("run") <= F.col("short")).cast("int"))
    clear = marked.filter("bucket IS NULL OR edge IS NULL OR bucket <> edge").withColumn("more", F.expr("CASE WHEN bucket IS NULL OR missing <= 0 THEN 0 WHEN edge IS NULL OR bucket < edge THEN 1 ELSE 0 END"))
    columns = ["mix_id", "id", "source", "n_tokens", (F.col("base") + F.col("more")).alias("copies"), ((F.col("base") + F.col("more")) < F.col("most")).alias("free"), "wanted"]
    dealt = stage(clear.select(*columns).unionByName(picked.select(*columns)), "dealt")
    # what is still missing is less than one document; the free document of the nearest size fills it, if it helps
    left = dealt.groupBy("mix_id", "source").agg((F.max("wanted") - F.sum(F.col("copies") * F.col("n_tokens"))).alias("left")).filter("left > 0")
    off = F.abs(F.col("n_tokens") - F.col("left"))
    best = dealt.filter("free").join(F.broadcast(left), ["mix_id", "source"]).filter(off < F.col("left")).groupBy("mix_id", "source").agg(F.min(F.struct(off.alias("off"), "id")).alias("b"))
    best = best.select("mix_id", "source", F.col("b.id").alias("filler"))
    filled = dealt.join(F.broadcast(best), ["mix_id", "source"], "left").withColumn("copies", F.col("copies") + F.expr("CASE WHEN filler = id THEN 1 ELSE 0 END"))
    copies = stage(filled.filter("copies > 0").select("mix_id", "id", "source", "n_tokens", "copies"), "copies")
    given = copies.groupBy("mix_id", "source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens"), F.count("*").alias("docs_used"), F.max("copies").alias("most_copies"))
    totals = given.groupBy("mix_id").agg(F.sum("tokens").alias("all_tokens"))
    shares = plan.join(given, ["mix_id", "source"], "left").join(totals, "mix_id", "left").select(
        "mix_id", "source", "target_share", F.col("most").alias("max_repeats"), F.col("available").alias("available_tokens"), F.coalesce("tokens", F.lit(0)).cast("bigint").alias("tokens"),
        F.coalesce("docs_used", F.lit(0)).cast("bigint").alias("docs_used"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)).alias("share"),
    )
    return copies.withColumnRenamed("id", key), shares
