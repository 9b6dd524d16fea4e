"""Putting a library in order: duplicates, file names, destinations, groups and collections."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import folder_of, slug_of, stem_of

MOST_SLUG = 60
DESTINATION_SIMILARITY, DESTINATION_MARGIN, FOLDER_FILES = 0.86, 0.03, 2
MOST_DESTINATIONS, SALT_FILES = 10, 20_000
LINKAGE_SIMILARITY = 0.86
# Names that a file system keeps for devices.
DEVICES = r"(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])(\..*)?$"


def duplicate_groups(files: DataFrame, scope: str, key: str, content_hash: str) -> DataFrame:
    """(scope, content_hash, n_files, first_id): contents that more than one file of a scope has; null and empty hashes are none."""
    sound = files.filter(F.col(content_hash).isNotNull() & (F.col(content_hash) != "")).select(scope, key, content_hash).distinct()
    return sound.groupBy(scope, content_hash).agg(F.count("*").alias("n_files"), F.min(key).alias("first_id")).filter("n_files > 1")


def filename_suggestions(files: DataFrame, key: str, scope: str, path: str, name: str, title: str) -> DataFrame:
    """(key, scope, path, suggested): a file named after its title, where the name is free and no earlier path claims it.

    Editable files only are to be passed as candidates by column `editable`; names are compared without case.
    """
    dot = F.col(name).contains(".")
    slug = slug_of(F.coalesce(F.col(title), F.lit("")))
    folder = F.when(folder_of(F.col(path)) != "", F.concat(folder_of(F.col(path)), F.lit("/"))).otherwise("")
    wanted = files.filter("editable").filter(dot).select(F.col(key), F.col(scope), F.col(path), slug.alias("slug"), F.lower(stem_of(F.col(name))).alias("stem"), F.concat(folder, slug, F.lit("."), F.element_at(F.split(name, r"\."), -1)).alias("suggested"))
    wanted = wanted.filter((F.col("slug") != "") & (F.length("slug") <= MOST_SLUG) & (F.col("slug") != F.col("stem")))
    taken = files.select(F.col(scope), F.lower(path).alias("low")).distinct()
    free = wanted.withColumn("low", F.lower("suggested")).join(taken, [scope, "low"], "left_anti")
    first = free.withColumn("turn", F.expr(f"row_number() OVER (PARTITION BY {scope}, low ORDER BY {path}, {key})")).filter("turn = 1")
    return first.select(key, scope, path, "suggested")


def vector_sums(df: DataFrame, by: list[str], vector: str) -> DataFrame:
    """(*by, n, total): number and sum of the vectors of each group, for vectors of any length; other lengths than the group's first are left out.

    Partial sums are made where the rows are, so that a group sends one row per partition.
    """
    kinds = dict(df.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in by) + ", n bigint, total array<double>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list] = {}
        for pdf in batches:
            vectors = pdf["total"].to_numpy(object)
            for key, at in pdf.groupby(by, dropna=False).indices.items():
                key = key if isinstance(key, tuple) else (key,)
                width = len(held[key][1]) if key in held else len(vectors[at[0]])
                fits = np.array([i for i in at if len(vectors[i]) == width], int)
                if len(fits):
                    part = np.stack(vectors[fits]).sum(axis=0, dtype=np.float64)
                    n = int(pdf["n"].to_numpy()[fits].sum())
                    held[key] = [held[key][0] + n, held[key][1] + part] if key in held else [n, part]
        yield pd.DataFrame([(*k, n, v) for k, (n, v) in held.items()], columns=[*by, "n", "total"])

    rows = df.filter(F.col(vector).isNotNull()).select(*by, F.lit(1).cast("bigint").alias("n"), F.col(vector).cast("array<double>").alias("total"))
    return rows.mapInPandas(run, schema).repartition(*by).mapInPandas(run, schema)


def folder_affinity(files: DataFrame, key: str, scope: list[str], folder: str, path: str, content: str, vector: str, most: int = MOST_DESTINATIONS) -> DataFrame:
    """(key, *scope, path, own_folder, folder, similarity, margin): the folder whose other files a file is clearly nearest to.

    `vector` holds unit vectors.  A folder is the direction of the sum of its files, without the file itself and its
    identical copies; it needs FOLDER_FILES others.  The best folder (ties: the smaller) must reach
    DESTINATION_SIMILARITY and lead the own folder - 0 if that has no others - by DESTINATION_MARGIN.  The `most` of each scope with the
    largest lead, then by path.  Files without a content, a vector or a folder take no part.

    Sums are made per folder, and per folder and content where a content has copies; the files of a scope meet the sums
    of its folders as matrices, SALT_FILES files at a time, so that neither a scope nor a folder is one task.
    """
    names = [key, *scope, folder, path, content, vector]
    rows = files.filter(" AND ".join(f"{c} IS NOT NULL" for c in names)).select(*names)
    by_folder = vector_sums(rows, [*scope, folder], vector).withColumn(content, F.lit(None).cast("string"))
    several = rows.groupBy(*scope, content).agg(F.count("*").alias("__n")).filter("__n > 1").drop("__n")
    by_content = vector_sums(rows.join(several, [*scope, content], "left_semi"), [*scope, folder, content], vector)
    counted = rows.groupBy(*scope).agg(F.ceil(F.count("*") / SALT_FILES).cast("int").alias("__salts"))
    salted = rows.join(counted, scope).withColumn("__salt", F.pmod(F.xxhash64(key), F.col("__salts")).cast("int")).drop("__salts")
    sums = by_folder.unionByName(by_content).join(counted, scope).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.col("__salts") - 1))).drop("__salts")
    kinds = dict(rows.dtypes)
    schema = f"{key} {kinds[key]}, " + ", ".join(f"{c} {kinds[c]}" for c in scope) + f", {path} string, own_folder string, folder string, similarity double, margin double"

    def run(own: pd.DataFrame, sums: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(columns=[key, *scope, path, "own_folder", "folder", "similarity", "margin"], dtype=object)
        if not len(own) or not len(sums):
            return out
        width = len(own[vector].iloc[0])
        own = own[[len(v) == width for v in own[vector]]]
        whole, part = sums[sums[content].isna() & [len(t) == width for t in sums["total"]]].sort_values(folder), sums[sums[content].notna()]
        if not len(own) or not len(whole):
            return out
        at = {f: j for j, f in enumerate(whole[folder])}
        u, s, n = np.stack(own[vector].to_numpy(object)).astype(np.float64), np.stack(whole["total"].to_numpy(object)), whole["n"].to_numpy(np.int64)
        copies: dict[str, list] = {}
        for f, c, m, t in zip(part[folder], part[content], part["n"], part["total"]):
            copies.setdefault(c, []).append((at[f], m, t))
        # what a file leaves out of a folder: its copies there, or itself
        i, j, less, count = [], [], [], []
        for k, (f, c) in enumerate(zip(own[folder], own[content])):
            for where, m, t in copies.get(c) or [(at[f], 1, u[k])]:
                i.append(k)
                j.append(where)
                less.append(t)
                count.append(m)
        i, j = np.array(i), np.array(j)
        others = np.broadcast_to(n, (len(u), len(n))).copy()
        others[i, j] -= np.array(count, np.int64)
        dot, size = u @ s.T, np.broadcast_to(np.linalg.norm(s, axis=1), (len(u), len(n))).copy()
        rest = s[j] - np.stack(less)
        dot[i, j], size[i, j] = np.einsum("ij,ij->i", rest, u[i]), np.linalg.norm(rest, axis=1)
        cos = np.where((others > 0) & (size > 1e-9), dot / np.maximum(size, 1e-300), np.nan)
        home = np.array([at[f] for f in own[folder]])
        line = np.arange(len(u))
        current = np.nan_to_num(cos[line, home], nan=0.0)
        able = np.where((others >= FOLDER_FILES) & ~np.isnan(cos), np.round(cos, 9), -np.inf)
        able[line, home] = -np.inf
        best = able.argmax(axis=1)  # folders are in order, so that the first of equals is the smallest
        top = able[line, best]
        lead = np.round(top - current, 6)
        keep = (np.round(top, 6) >= DESTINATION_SIMILARITY) & (lead >= DESTINATION_MARGIN)
        got = own[[key, *scope, path]].copy()
        got["own_folder"], got["folder"], got["similarity"], got["margin"] = own[folder].to_numpy(object), whole[folder].to_numpy(object)[best], np.round(top, 6), lead
        got = got[keep]
        return got if len(got) else out

    found = salted.groupBy(*scope, "__salt").cogroup(sums.groupBy(*scope, "__salt")).applyInPandas(run, schema)
    turned = found.withColumn("__turn", F.expr(f"row_number() OVER (PARTITION BY {', '.join(scope)} ORDER BY margin DESC, {path}, {key})"))
    return turned.filter(F.col("__turn") <= most).drop("__turn")


def destinations(suggested: DataFrame, files: DataFrame, key: str, scope: str, path: str, content: str, editable: str) -> DataFrame:
    """(key, scope, path, destination): moves into the suggested folder, for editable files with a content, where the new
    path is free and no earlier suggestion (by path) takes it; paths are compared without case."""
    name = F.element_at(F.split(path, "/"), -1)
    able = files.filter(F.col(editable) & F.col(content).isNotNull()).select(key, scope, path).distinct()
    wanted = suggested.select(key, "folder").join(able, key).withColumn("destination", F.when(F.col("folder") != "", F.concat("folder", F.lit("/"), name)).otherwise(name))
    return free_paths(wanted, files, scope, path, key)


def generated_names(names: DataFrame, files: DataFrame, key: str, scope: str, path: str, content: str, editable: str, name: str) -> DataFrame:
    """(key, scope, path, destination): renames to names that a model wrote, made slugs, in the file's folder and with its
    extension; names without a slug or with one that is too long, and files without an extension or a content, give none."""
    able = files.filter(F.col(editable) & F.col(content).isNotNull()).select(key, scope, path).distinct()
    file = F.element_at(F.split(path, "/"), -1)
    home = F.when(folder_of(F.col(path)) != "", F.concat(folder_of(F.col(path)), F.lit("/"))).otherwise("")
    slugged = names.select(key, slug_of(F.col(name)).alias("__slug")).filter((F.col("__slug") != "") & (F.char_length("__slug") <= MOST_SLUG))
    wanted = slugged.join(able.filter(file.contains(".")), key).withColumn("destination", F.concat(home, "__slug", F.lit("."), F.element_at(F.split(file, r"\."), -1)))
    return free_paths(wanted, files, scope, path, key)


def free_paths(wanted: DataFrame, files: DataFrame, scope: str, path: str, key: str, taken: DataFrame | None = None) -> DataFrame:
    """(key, scope, path, destination): wishes whose destination is portable, is not the file's own path, and that no
    file - nor `taken` (scope, path), what other suggestions want - has, without case; of equal wishes the first by path."""
    held = files.select(F.col(scope), F.lower(path).alias("__low"))
    if taken is not None:
        held = held.unionByName(taken.select(F.col(scope), F.lower(path).alias("__low")))
    low = wanted.filter(portable(F.col("destination"))).withColumn("__low", F.lower("destination")).filter(F.col("__low") != F.lower(path))
    free = low.join(held.distinct(), [scope, "__low"], "left_anti")
    first = free.groupBy(scope, "__low").agg(F.min(F.struct(path, key, "destination")).alias("__x"))
    return first.select(f"__x.{key}", scope, f"__x.{path}", "__x.destination")


def portable(path: Column) -> Column:
    """Whether every part of a relative path can stand on all file systems: not empty, . or .., no control or reserved
    character, no dot or space at its end, no device name."""
    part = lambda p: (p != "") & (p != ".") & (p != "..") & ~p.rlike(r'[\x00-\x1f<>:"|?*\\]') & ~p.rlike(r"[. ]$") & ~p.rlike(DEVICES)
    return F.forall(F.split(path, "/"), part)


def cohesion(members: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, n, cohesion): mean cosine of all pairs of unit vectors; 1 for a single member.

    The squared length of the sum of unit vectors is n plus twice the sum of pair cosines, so no pairs are formed.
    """
    sums = vector_sums(members, [group], vector)
    squared = F.aggregate("total", F.lit(0.0), lambda s, v: s + v * v)
    return sums.select(group, "n", F.when(F.col("n") > 1, (squared - F.col("n")) / (F.col("n") * (F.col("n") - 1))).otherwise(1.0).alias("cohesion"))


def average_linkage(vectors: np.ndarray, least: float = LINKAGE_SIMILARITY) -> np.ndarray:
    """Cluster number per row: the most similar two clusters merge while their mean cosine is at least `least`; ties go to the lowest rows."""
    n = len(vectors)
    label = np.arange(n)
    size = np.ones(n)
    sim = vectors @ vectors.T
    np.fill_diagonal(sim, -np.inf)
    # the best partner of each row, so that a merge looks through the rows it touches only
    best = np.argmax(np.round(sim, 9), axis=1) if n else label
    most = np.round(sim[label, best], 9)
    while n > 1:
        at = int(np.argmax(most))
        a, b = sorted((at, int(best[at])))
        if not sim[a, b] >= least:
            break
        both = (size[a] * sim[a] + size[b] * sim[b]) / (size[a] + size[b])
        sim[a], sim[:, a] = both, both
        sim[a, a] = -np.inf
        sim[b], sim[:, b] = -np.inf, -np.inf
        size[a] += size[b]
        label[label == b] = a
        now = np.round(sim[:, a], 9)
        nearer = (now > most) | ((now == most) & (a < best))
        best[nearer], most[nearer] = a, now[nearer]
        for i in {a, b, *np.flatnonzero(((best == a) | (best == b)) & ~nearer).tolist()}:
            row = np.round(sim[i], 9)
            best[i] = int(np.argmax(row))
            most[i] = row[best[i]]
    return label


def linkage_groups(rows: DataFrame, by: str, key: str, vector: str, least: float = LINKAGE_SIMILARITY) -> DataFrame:
    """(by, key, cluster): average linkage inside each group, cluster being its smallest key.

    A group is worked on in one task, with 8 bytes for each pair of its rows.
    """
    schema = f"{by} {dict(rows.dtypes)[by]}, {key} {dict(rows.dtypes)[key]}, cluster {dict(rows.dtypes)[key]}"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        v = np.array([np.asarray(x, np.float64) for x in pdf[vector]])
        v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
        label = average_linkage(v, least)
        return pd.DataFrame({by: pdf[by], key: pdf[key], "cluster": pdf[key].to_numpy()[label]})

    return rows.select(by, key, vector).groupBy(by).applyInPandas(run, schema)


def follow_members(collections: DataFrame, members: str, files: DataFrame, key: str, collection: str) -> DataFrame:
    """(collection, kept, dropped): members that are still files, each once, and how many entries are gone."""
    listed = collections.select(collection, F.explode_outer(members).alias(key))
    known = files.select(key).distinct().withColumn("__there", F.lit(True))
    met = listed.join(known, key, "left")
    return met.groupBy(collection).agg(F.count_distinct(F.when(F.col("__there"), F.col(key))).alias("kept"), (F.count(key) - F.count_distinct(F.when(F.col("__there"), F.col(key)))).alias("dropped"))


def changed_members(members: DataFrame, collection: str, key: str, removed: DataFrame | None = None, added: DataFrame | None = None, renamed: DataFrame | None = None) -> DataFrame:
    """(collection, key) after removals, additions and moves (`renamed` has key and new_key); a member counts once."""
    now = members.select(collection, key)
    if renamed is not None:
        now = now.join(renamed.select(key, "new_key"), key, "left").select(collection, F.coalesce("new_key", key).alias(key))
    if removed is not None:
        now = now.join(removed.select(collection, key), [collection, key], "left_anti")
    if added is not None:
        now = now.unionByName(added.select(collection, key))
    return now.distinct()
