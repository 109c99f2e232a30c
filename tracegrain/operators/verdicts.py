"""From candidates to a verdict: greedy removal of what others explain, aliases, exclusions, merged and regrouped tables."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pair_overlap(items: DataFrame, group: str, key: list[str], item: str) -> DataFrame:
    """``group``, a and b (structs of ``key``), overlap: how many items two candidates of a group share; a before b."""
    rows = items.select(group, F.struct(*key).alias("k"), item).distinct()
    left, right = rows.withColumnRenamed("k", "a"), rows.withColumnRenamed("k", "b")
    return left.join(right, [group, item]).where("a < b").groupBy(group, "a", "b").agg(F.count("*").alias("overlap"))


def greedy_kept(candidates: list[tuple], overlap: dict, strings: bool) -> list[tuple]:
    """Keys that two passes leave of (key, matched, total).

    The first takes the candidate with the most matches and drops those that it explains: 85 % of theirs in common, and by a
    factor of 1.3 fewer in common than it has. The second starts from the fewest matches; for strings it drops
    what has 1.3 times the head's total, for arrays what has less. Ties go by key. For arrays both
    comparisons of the first pass and the 85 % are strict.
    """
    share = lambda a, b: overlap.get((min(a, b), max(a, b)), 0)
    left = sorted(candidates, key=lambda c: (-c[1], c[0]))
    kept = []
    while left:
        head, *rest = left
        kept.append(head)
        left = []
        for c in rest:
            both = share(head[0], c[0])
            sim = both / c[1] if c[1] else 0.0
            gone = (sim >= 0.85 and both * 1.3 <= head[1]) if strings else (sim > 0.85 and both * 1.3 < head[1])
            if not gone:
                left.append(c)
    left, kept = sorted(kept, key=lambda c: (c[1], c[0])), []
    while left:
        head, *rest = left
        kept.append(head)
        left = []
        for c in rest:
            low = min(c[1], head[1])
            sim = share(head[0], c[0]) / low if low else 0.0
            ratio = c[2] / head[2] if head[2] else float("inf")
            gone = (sim >= 0.85 and ratio >= 1.3) if strings else (sim > 0.85 and ratio < 1.3)
            if not gone:
                left.append(c)
    return [c[0] for c in kept]


def greedy_dedup(candidates: DataFrame, items: DataFrame, item: str, strings: bool) -> DataFrame:
    """bin_file, pj, dyn, ver of the candidates that survive.

    ``candidates`` (bin_file, pj, dyn, ver, matched_count, total_count) are few for each binary: a rule let them pass. Their
    overlaps are counted by a join on the items they matched; only the order-dependent passes run in Python.
    """
    keys = ["pj", "dyn", "ver"]
    few = candidates.select("bin_file", *keys, "matched_count", "total_count")
    shared = pair_overlap(items.join(few.select("bin_file", *keys), ["bin_file", *keys], "left_semi"), "bin_file", keys, item)
    lists = few.groupBy("bin_file").agg(F.collect_list(F.struct(F.struct(*keys).alias("k"), "matched_count", "total_count")).alias("c"))
    pairs = shared.groupBy("bin_file").agg(F.collect_list(F.struct("a", "b", "overlap")).alias("o"))
    rows = lists.join(pairs, "bin_file", "left")

    def passes(batches):
        for pdf in batches:
            out = []
            for name, c, o in zip(pdf["bin_file"], pdf["c"], pdf["o"]):
                key = lambda k: (k["pj"], k["dyn"], k["ver"])
                overlap = {(key(x["a"]), key(x["b"])): x["overlap"] for x in (o if o is not None else [])}
                out += [(name, *k) for k in greedy_kept([(key(x["k"]), x["matched_count"], x["total_count"]) for x in c], overlap, strings)]
            yield pd.DataFrame(out, columns=["bin_file", *keys])

    return rows.mapInPandas(passes, "bin_file string, pj string, dyn string, ver string")


def folded_aliases(found: DataFrame, alias: DataFrame) -> DataFrame:
    """found with name: the alias of (pj, dyn) if it has one; else that of (pj, ''), where '' excludes the row and none
    leaves pj."""
    own = alias.where("dyn <> ''").select("pj", "dyn", F.col("alias_pj").alias("own"))
    every = alias.where("dyn = ''").select("pj", F.col("alias_pj").alias("general"))
    rows = found.join(own, ["pj", "dyn"], "left").join(every, "pj", "left")
    has_own = F.coalesce(F.col("own") != "", F.lit(False))
    rows = rows.where(has_own | F.coalesce(F.col("general") != "", F.lit(True)))
    return rows.withColumn("name", F.when(has_own, F.col("own")).otherwise(F.coalesce("general", "pj"))).drop("own", "general")


def without_invalid(found: DataFrame, invalid: DataFrame, family: str) -> DataFrame:
    """found without what ``invalid`` lists by project or component, for the family or for all ('')."""
    bad = invalid.where(F.col("family").isin(family, ""))
    return found.join(bad.where("dyn = ''").select("pj").distinct(), "pj", "left_anti").join(bad.where("dyn <> ''").select("pj", "dyn").distinct(), ["pj", "dyn"], "left_anti")


def verdict(found: DataFrame, alias: DataFrame) -> DataFrame:
    """bin_file, name: the projects reused."""
    return folded_aliases(found, alias).select("bin_file", "name").distinct()


def merged_tables(tables: list[DataFrame], keys: list[str], sums: list[str], lists: list[str]) -> DataFrame:
    """Score tables as one: numbers add, list items are marked by their table's number."""

    def marked(column: str, i: int) -> Column:
        return F.transform(column, lambda x: F.concat(F.lit(f"{i}:"), x.cast("string"))).alias(column)

    parts = [t.select(*keys, *sums, *(marked(c, i) for c in lists)) for i, t in enumerate(tables, 1)]
    every = reduce(DataFrame.unionByName, parts)
    return every.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in sums), *(F.array_sort(F.flatten(F.collect_list(c))).alias(c) for c in lists))


def regrouped(matched: DataFrame) -> DataFrame:
    """lib, dyn, feature, bin_files: in which binaries a family of a component matched."""
    return matched.where("matched").groupBy("lib", "dyn", "feature").agg(F.array_sort(F.collect_set("bin_file")).alias("bin_files"))


def reused(matched: DataFrame) -> DataFrame:
    """lib, reused: whether any pair of it matched."""
    return matched.groupBy("lib").agg(F.bool_or("matched").alias("reused"))


def first_of_equal_sets(rows: DataFrame, key: str, members: str) -> DataFrame:
    """One row for each set of members, the first by ``key``; empty sets go."""
    same: Column = F.array_sort(F.array_distinct(members))
    return rows.where(F.size(members) > 0).groupBy(same.alias("_set")).agg(F.min_by(F.struct(*rows.columns), key).alias("r")).select("r.*")
