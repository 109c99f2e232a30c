"""Matching by exported symbols and by function names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexical as L


def match_exports(source: DataFrame, binary: DataFrame) -> DataFrame:
    """lib, bin_file, similarity, score, matched for each pair with a common name.

    Distinct names are shared; the sizes are of the lists as they are. Small libraries need more of a binary's names.
    """
    ns = source.groupBy("lib").agg(F.count("*").alias("ns"))
    nb = binary.groupBy("bin_file").agg(F.count("*").alias("nb"))
    shared = source.select("lib", "name").distinct().join(binary.select("bin_file", "name").distinct(), "name").groupBy("lib", "bin_file").agg(F.count("*").alias("score"))
    rows = shared.join(ns, "lib").join(nb, "bin_file").withColumn("similarity", F.col("score") / F.col("ns"))
    both = F.col("score") / F.col("nb") + F.col("similarity")
    rule = ((F.col("ns") > 5) & (F.col("similarity") >= 0.8)) | (F.col("score") > 20) | ((F.col("ns") > 10) & (both >= 1.2)) | (both >= 1.5)
    return rows.select("lib", "bin_file", "similarity", "score", rule.alias("matched"))


def _named(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(key, L.last_segment(F.col("name")).alias("name")).distinct()


def match_function_names(source: DataFrame, binary: DataFrame, source_exports: DataFrame | None = None) -> DataFrame:
    """lib, bin_file, similarity, score, matched: last segments of names, or signatures if a binary has any.

    Only binaries of more than ten exports; a share of 80 % or less of their distinct names is reported as nothing. With
    ``source_exports``, only for pairs whose exports did not match and whose library has at most five of them.
    """
    sizes = binary.groupBy("bin_file").agg(F.count("*").alias("exports"), F.bool_or(F.col("name").contains("(") & F.col("name").contains(")")).alias("signed"))
    src, named = _named(source, "lib"), _named(binary, "bin_file").join(sizes.where("exports > 10"), "bin_file")
    total = named.groupBy("bin_file").agg(F.count("*").alias("names"))
    before = F.substring_index("name", "(", 1)
    plain = src.select("lib", before.alias("key")).distinct().join(named.where("not signed").select("bin_file", before.alias("key")).distinct(), "key").select("lib", "bin_file", "key")
    found = plain.union(match_signatures(src, named.where("signed").select("bin_file", "name")).select("lib", "bin_file", F.col("name").alias("key")))
    rows = found.groupBy("lib", "bin_file").agg(F.count("*").alias("n")).join(total, "bin_file")
    hit = F.col("n") / F.col("names") > 0.8
    out = rows.select("lib", "bin_file", F.when(hit, F.col("n") / F.col("names")).otherwise(0.0).alias("similarity"), F.when(hit, F.col("n")).otherwise(0).alias("score"), hit.alias("matched"))
    if source_exports is None:
        return out
    few = source_exports.groupBy("lib").agg(F.count("*").alias("ns")).where("ns > 5").select("lib")
    done = match_exports(source_exports, binary).where("matched").select("lib", "bin_file")
    return out.join(few, "lib", "left_anti").join(done, ["lib", "bin_file"], "left_anti")


def match_signatures(source: DataFrame, binary: DataFrame) -> DataFrame:
    """lib, bin_file, name, parameters: names with an overload whose normalised parameter lists are equal."""
    name = L.name_before_parameters(F.col("name"))
    s = source.select("lib", name.alias("key"), L.source_parameters(F.col("name")).alias("parameters")).distinct()
    b = binary.select("bin_file", name.alias("key"), L.binary_parameters(F.col("name")).alias("parameters")).distinct()
    both = s.join(b, ["key", "parameters"])
    return both.groupBy("lib", "bin_file", F.col("key").alias("name")).agg(F.max(F.array_join("parameters", ",")).alias("parameters"))
