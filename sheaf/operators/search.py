"""Search over passages: keyword ranking, the boolean search language, evidence gate, fusion and grouping."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import STOP_WORDS, array_of, extension_of, fold, folder_of, occurrences, tokens

K1, B = 1.2, 0.75
GATE_TOP, GATE_MARGIN, GATE_LEAST = 0.813, 0.031, 5
MOST_TERMS = 32
FIELDS = ("intitle", "filetype", "ext", "in", "folder")


def terms_of(query: str) -> list[str]:
    """Distinct terms of a query, sorted."""
    word, found = "", set()
    for c in query.lower() + " ":
        if c.isalnum():
            word += c
        elif word:
            found.add(word)
            word = ""
    return sorted(found)


def _is(word: str):
    return lambda t: t == word


def terms_in_order(query: str) -> list[str]:
    """Distinct terms of a query in the order in which they first stand, MOST_TERMS at most: what the full-text index is asked for."""
    word, found = "", []
    for c in query + " ":
        if c.isalnum():
            word += c
        elif word:
            found.append(word.lower())
            word = ""
    return list(dict.fromkeys(found))[:MOST_TERMS]


def match_expression(terms: list[str]) -> str | None:
    """The terms quoted and joined by OR, those that are not plain words left out; None if none is left."""
    kept = [f'"{t}"' for t in terms if t and t.isalnum()]
    return " OR ".join(kept) or None


def term_counts(passages: DataFrame, keys: list[str], text: str, terms: list[str]) -> DataFrame:
    """(*keys, length, tf): tokens of each passage and how often it has each term.  A null text counts as empty.

    This is what ranking needs of a text: everything after it - dropping repeated rows, statistics, scores - moves a
    few numbers per passage, never the text.
    """
    held = passages.select(*keys, tokens(F.coalesce(text, F.lit(""))).alias("__t"))
    tf = F.array(*(F.size(F.filter("__t", _is(w))) for w in terms)) if terms else F.array().cast("array<int>")
    return held.select(*keys, F.size("__t").alias("length"), tf.alias("tf")).distinct()


def postings(passages: DataFrame, key: str, text: str) -> DataFrame:
    """(term, key, tf, length): the inverted index of the passages, one row per term and passage; a null text has none.

    To be written partitioned or bucketed by term, so that a query reads the terms it names: see ranked_postings.
    """
    held = passages.select(key, tokens(F.coalesce(text, F.lit(""))).alias("__t")).select(key, F.size("__t").cast("int").alias("length"), F.explode("__t").alias("term"))
    return held.groupBy("term", key).agg(F.count("*").cast("int").alias("tf"), F.max("length").alias("length"))


def lengths_of(passages: DataFrame, key: str, text: str) -> DataFrame:
    """(n, avg_len): the row of statistics that goes with postings."""
    sized = passages.select(key, F.size(tokens(F.coalesce(text, F.lit("")))).alias("length")).distinct()
    return sized.agg(F.count("*").alias("n"), F.avg("length").alias("avg_len"))


def ranked_postings(index: DataFrame, statistics: DataFrame, key: str, query: str) -> DataFrame:
    """(key, score): the full-text rank from postings and their statistics; only the query's terms are read."""
    found = index.filter(F.col("term").isin(terms_of(query)))
    frequency = found.groupBy("term").agg(F.count("*").alias("df"))
    met = found.join(F.broadcast(frequency), "term").join(F.broadcast(statistics))  # as many rows as the query has terms, and one
    weight = F.greatest(F.lit(1e-6), F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    part = weight * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.greatest(F.col("avg_len"), F.lit(1.0))))
    return met.groupBy(key).agg(F.sum(part).alias("score"))


def bm25(passages: DataFrame, keys: list[str], text: str, query: str, normalised: bool = True) -> DataFrame:
    """(*keys, score): BM25 of the query's terms for each passage, 0 where none is met; a repeated passage counts once.

    Normalised: stop words and terms in at least 90 % of the passages weigh nothing, and scores are divided by the
    sum of weights and capped at 1.  Otherwise the full-text rank: weights of at least 1e-6, no division.  A text is
    tokenised once, where it is read; statistics are one row, which is broadcast, gathered from the same narrow table.
    """
    terms = terms_of(query)
    counts = term_counts(passages, keys, text, terms)
    if not terms:
        return counts.select(*keys, F.lit(0.0).alias("score"))
    stats = counts.agg(F.count("*").alias("__n"), F.avg("length").alias("__avg_len"), *(F.count_if(F.col("tf")[i] > 0).alias(f"__df_{i}") for i in range(len(terms))))
    joined = counts.join(F.broadcast(stats))
    length = K1 * (1 - B + B * F.col("length") / F.greatest(F.col("__avg_len"), F.lit(1.0)))
    total, most = F.lit(0.0), F.lit(0.0)
    for i, w in enumerate(terms):
        df, tf = F.coalesce(F.col(f"__df_{i}"), F.lit(0)), F.col("tf")[i]
        if normalised:
            weight = F.lit(0.0) if w in STOP_WORDS else F.when(df >= F.greatest(F.col("__n") * 0.9, F.lit(2.0)), 0.0).otherwise(F.log(1 + (F.col("__n") - df + 0.5) / (df + 0.5)))
        else:
            weight = F.greatest(F.lit(1e-6), F.log((F.col("__n") - df + 0.5) / (df + 0.5)))
        most = most + weight
        total = total + F.when(tf > 0, weight * tf * (K1 + 1) / (tf + length)).otherwise(0.0)
    score = F.when(most > 0, F.least(F.lit(1.0), total / most)).otherwise(0.0) if normalised else total
    return joined.select(*keys, score.alias("score"))


def estimated_length(passages: DataFrame, keys: list[str], text: str, query: str) -> DataFrame:
    """(average_chars, tokens, chars, average_length): the average number of tokens, estimated as the average number of
    characters times the tokens per character of the passages that hold a term of the query; 0 where none does."""
    held = passages.select(*keys, F.char_length(F.coalesce(text, F.lit(""))).alias("chars"), F.size(tokens(F.coalesce(text, F.lit("")))).alias("tokens"), F.arrays_overlap(tokens(F.coalesce(text, F.lit(""))), array_of(terms_of(query))).alias("hit")).distinct()
    told = held.agg(F.avg("chars").alias("average_chars"), F.coalesce(F.sum(F.when(F.col("hit"), F.col("tokens"))), F.lit(0)).alias("tokens"), F.coalesce(F.sum(F.when(F.col("hit"), F.col("chars"))), F.lit(0)).alias("chars"))
    return told.withColumn("average_length", F.coalesce(F.when(F.col("chars") > 0, F.col("average_chars") * F.col("tokens") / F.col("chars")), F.lit(0.0)))


def term_overlap(text: Column, query: str) -> Column:
    """Share of the query's terms that stand in the text as tokens; 1 for a query without terms."""
    terms = terms_of(query)
    return F.size(F.array_intersect(tokens(F.coalesce(text, F.lit(""))), array_of(terms))) / F.lit(len(terms)) if terms else F.lit(1.0)


def group_passages(scored: DataFrame, document: str, passage: str, per_document: int = 3, limit: int | None = None) -> DataFrame:
    """At most `per_document` passages of each document, best first (ties: smaller passage id); documents by best score, then id.

    Adds doc_score, doc_rank and passage_rank.  With a limit the documents are chosen before their passages are ranked.
    """
    best = scored.groupBy(document).agg(F.max("score").alias("doc_score"))
    if limit is not None:
        best = best.orderBy(F.desc("doc_score"), document).limit(limit)
    best = best.withColumn("doc_rank", F.expr(f"row_number() OVER (ORDER BY doc_score DESC, {document})")) if limit is not None else best
    ranked = scored.join(best, document).withColumn("passage_rank", F.expr(f"row_number() OVER (PARTITION BY {document} ORDER BY score DESC, {passage})"))
    return ranked.filter(F.col("passage_rank") <= per_document)


def limit_distinct_contents(ranked: DataFrame, content: str, rank: str, limit: int) -> DataFrame:
    """Rows whose content is among the first `limit` distinct ones by rank: identical copies ride along for free."""
    first = ranked.groupBy(content).agg(F.min(rank).alias("__first")).orderBy("__first").limit(limit)
    return ranked.join(first, content, "left_semi")


def capped_then_grouped(scored: DataFrame, document: str, passage: str, limit: int, per_document: int = 3) -> DataFrame:
    """Keyword search as served: the best min(8 * limit, 400) passages first, then at most `limit` documents of them."""
    top = scored.filter("score > 0").orderBy(F.desc("score"), passage).limit(min(8 * limit, 400))
    return group_passages(top, document, passage, per_document, limit)


def first_contents(scored: DataFrame, content: str, document: str, limit: int) -> DataFrame:
    """(content, best, first_document, place): the `limit` contents whose best document (ties: the smaller id) comes first.

    One aggregation per content and a top-k; no order over all documents is made.
    """
    best = scored.groupBy(content).agg(F.min(F.struct((-F.col("score")).alias("s"), F.col(document).alias("d"))).alias("b"))
    top = best.select(content, (-F.col("b.s")).alias("best"), F.col("b.d").alias("first_document")).orderBy(F.desc("best"), "first_document").limit(limit)
    return top.withColumn("place", F.expr("row_number() OVER (ORDER BY best DESC, first_document)"))


def merged_results(index_hits: DataFrame, name_hits: DataFrame, documents: DataFrame, document: str, order: str) -> DataFrame:
    """(document, list, place): hits in the text first, then hits in names that are not among them; each document once,
    only documents that are still there, each list in its own `order`."""
    both = index_hits.select(document, F.lit("text").alias("list"), F.lit(0).alias("__l"), F.col(order).alias("place")).unionByName(name_hits.select(document, F.lit("name").alias("list"), F.lit(1).alias("__l"), F.col(order).alias("place")))
    first = both.groupBy(document).agg(F.min(F.struct("__l", "place", "list")).alias("x"))
    return first.join(documents.select(document).distinct(), document, "left_semi").select(document, "x.list", "x.place")


def evidence_gate(scores: DataFrame, query: str, cosine: str) -> DataFrame:
    """Per query: n, top, median, margin and whether there is evidence at all; null and NaN cosines do not count."""
    sound = scores.filter(F.col(cosine).isNotNull() & ~F.isnan(cosine))
    told = sound.groupBy(query).agg(F.count("*").alias("n"), F.max(cosine).cast("double").alias("top"), F.median(cosine).alias("median"))
    return _gated(told)


def scope_gate(scores: DataFrame, cosine: str, bins: int = 4096) -> DataFrame:
    """The same for all scores of one scope as one row, with no sort of them: the middle is found by counting.

    A first pass counts the cosines in `bins` equal parts of -1 to 1; a second one takes the few values of the parts in
    which the middle ones lie, unless those are more than a task should hold, and is exact.
    """
    sound = scores.filter(F.col(cosine).isNotNull() & ~F.isnan(cosine)).select(F.col(cosine).cast("double").alias("c"))
    part = F.least(F.greatest(F.floor((F.col("c") + 1) / 2 * bins), F.lit(0)), F.lit(bins - 1))
    counted = sound.groupBy(part.alias("part")).agg(F.count("*").alias("m"))
    run = counted.withColumns({"before": F.expr("coalesce(sum(m) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"), "n": F.expr("sum(m) OVER ()")})  # at most `bins` rows
    low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    edges = run.filter(((F.col("before") <= low) & (low < F.col("before") + F.col("m"))) | ((F.col("before") <= high) & (high < F.col("before") + F.col("m")))).select("part", "before", "n")
    inside = sound.withColumn("part", part).join(F.broadcast(edges), "part").groupBy("part", "before", "n", "c").agg(F.count("*").alias("k"))
    placed = inside.withColumn("at", F.expr("before + sum(k) OVER (PARTITION BY part ORDER BY c) - k"))
    covers = lambda x: (F.col("at") <= x) & (x < F.col("at") + F.col("k"))
    middle = placed.agg(F.max("n").alias("n"), F.max(F.when(covers(low), F.col("c"))).alias("a"), F.max(F.when(covers(high), F.col("c"))).alias("b"))
    return _gated(middle.join(sound.agg(F.max("c").alias("top"))).filter("n IS NOT NULL").select("n", "top", ((F.col("a") + F.col("b")) / 2).alias("median")))


def _gated(told: DataFrame) -> DataFrame:
    margin = F.col("top") - F.col("median")
    return told.withColumn("margin", margin).withColumn("passed", (F.col("top") >= GATE_TOP) & ((F.col("n") < GATE_LEAST) | (margin >= GATE_MARGIN)))


@dataclass
class SearchQuery:
    """A parsed search: every clause needs one of its terms; folded values throughout."""

    clauses: list[list[str]] = field(default_factory=list)
    excluded: list[str] = field(default_factory=list)
    in_title: list[str] = field(default_factory=list)
    filetypes: list[str] = field(default_factory=list)
    folders: list[str] = field(default_factory=list)

    @property
    def terms(self) -> list[str]:
        return [t for c in self.clauses for t in c] + self.in_title


def _plain(value: str) -> str:
    import unicodedata

    bare = "".join(c for c in unicodedata.normalize("NFD", value) if not unicodedata.combining(c))
    return " ".join(bare.lower().split())


def _lex(query: str):
    """(negated, field, value, quoted) of each word of a query."""
    at, n = 0, len(query)
    while at < n:
        if query[at].isspace():
            at += 1
            continue
        negated = query[at] == "-"
        at += negated
        word, quoted, name = "", False, None
        while at < n and not query[at].isspace():
            if query[at] == '"':
                end = query.find('"', at + 1)
                end = n if end < 0 else end
                word, quoted, at = word + query[at + 1 : end], True, min(n, end + 1)
                break
            word += query[at]
            at += 1
            if name is None and word.endswith(":") and word[:-1].lower() in FIELDS:
                name, word = word[:-1].lower(), ""
        if word or quoted or name or not negated:
            yield negated, name, word, quoted


def parse(query: str) -> SearchQuery | None:
    """The query of the search language, or None if it uses no operator and is plain words.

    Words, "phrases", -not, OR (joins with the clause before), AND (ignored), intitle:, filetype: or ext:, in: or
    folder:.  A negated field is an exclusion of its value.  At most MOST_TERMS terms count.
    """
    found = list(_lex(query))
    if not any(neg or name or quoted or word in ("OR", "AND") for neg, name, word, quoted in found):
        return None
    got, join, count = SearchQuery(), False, 0
    for negated, name, word, quoted in found:
        if not (quoted or negated or name) and word in ("OR", "AND"):
            join = bool(got.clauses) if word == "OR" else join
            continue
        value = _plain(word)
        if not value or count == MOST_TERMS:
            continue
        count += 1
        if negated:
            got.excluded.append(value)
        elif name == "intitle":
            got.in_title.append(value)
        elif name in ("filetype", "ext"):
            got.filetypes.append(value.lstrip("."))
        elif name in ("in", "folder"):
            got.folders.append(value.strip("/").replace("\\", "/"))
        elif join:
            got.clauses[-1].append(value)
        else:
            got.clauses.append([value])
        join = False
    return got


def operator_search(files: DataFrame, query: SearchQuery, name: str, title: str, path: str, text: str) -> DataFrame:
    """The files that match, with column score.  Null texts and titles count as empty; a null name or path matches nothing by name.

    The query is compiled to one filter and one arithmetic expression over folded columns.
    """
    label = fold(F.concat_ws(" ", F.coalesce(name, F.lit("")), F.coalesce(title, name, F.lit(""))))
    folded = files.withColumns({"__title": F.concat_ws(" ", label, F.replace(label, F.lit("_"), F.lit(" "))), "__body": fold(F.coalesce(text, F.lit("")))})
    keep, score = F.lit(True), F.lit(0.0)
    if query.filetypes:
        keep &= extension_of(F.coalesce(name, F.lit(""))).isin(query.filetypes)
    if query.folders:
        at = F.concat(F.lit("/"), fold(folder_of(F.coalesce(path, F.lit("")))), F.lit("/"))
        inside = F.lit(False)
        for wanted in query.folders:
            inside |= at.contains(f"/{wanted}/")
        keep &= inside
    for term in query.in_title:
        n = occurrences(F.col("__title"), term)
        keep &= n > 0
        score += 5.0 + n
    for clause in query.clauses:
        met = F.lit(False)
        for term in clause:
            n, m = occurrences(F.col("__title"), term), occurrences(F.col("__body"), term)
            met |= n + m > 0
            score += 3.0 * F.least(n, F.lit(1)) + F.least(m, F.lit(20))
        keep &= met
    for term in query.excluded:
        keep &= occurrences(F.col("__title"), term) + occurrences(F.col("__body"), term) == 0
    return folded.filter(keep).withColumn("score", score).select(*files.columns, "score")


def budgeted_prefix(passages: DataFrame, group: str, order: str, size: str, most: int = 8, budget: int = 6400) -> DataFrame:
    """Per group the leading passages while fewer than `most` are held and their sizes stay within the budget; the first always."""
    run = passages.withColumn("__n", F.expr(f"row_number() OVER (PARTITION BY {group} ORDER BY {order})")).withColumn("__sum", F.expr(f"sum({size}) OVER (PARTITION BY {group} ORDER BY {order} ROWS UNBOUNDED PRECEDING)"))
    over = run.withColumn("__over", F.expr(f"max(CASE WHEN __n > 1 AND (__n > {most} OR __sum > {budget}) THEN 1 ELSE 0 END) OVER (PARTITION BY {group} ORDER BY {order} ROWS UNBOUNDED PRECEDING)"))
    return over.filter("__over = 0").select(*passages.columns)


def merged_intervals(spans: DataFrame, group: list[str], start: str, end: str) -> DataFrame:
    """Overlapping and touching intervals of each group as one: (*group, start, end, n)."""
    keys = ", ".join(group)
    seen = spans.withColumn("__reach", F.expr(f"max({end}) OVER (PARTITION BY {keys} ORDER BY {start}, {end} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"))
    numbered = seen.withColumn("__island", F.expr(f"sum(CASE WHEN __reach IS NULL OR {start} > __reach THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY {start}, {end} ROWS UNBOUNDED PRECEDING)"))
    return numbered.groupBy(*group, "__island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("__island")
