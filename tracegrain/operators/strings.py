"""Matching by strings: pairwise against each component, and through an inverted index with IDF scores."""

from __future__ import annotations

import pickle
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexical as L
from ..staging import staged


def binary_side(strings: DataFrame) -> DataFrame:
    """bin_file, value: without mangled names and ordinary words; as often as they occur."""
    return strings.where(~L.is_mangled(F.col("value")) & ~L.is_ordinary_word(F.col("value")))


def source_side(strings: DataFrame, seq: str | None = None) -> DataFrame:
    """pj, dyn, value, score: literals without quotes and ordinary words, once each; the last score wins by ``seq``."""
    score = F.col("score") if "score" in strings.columns else F.lit(1.0)
    rows = strings.select("pj", "dyn", L.unquoted(F.col("value")).alias("value"), score.alias("score"), (F.col(seq) if seq else F.lit(0)).alias("seq"))
    return rows.where(~L.is_ordinary_word(F.col("value"))).groupBy("pj", "dyn", "value").agg(F.max_by("score", F.struct("seq", "score")).alias("score"))


def match_pairwise(source: DataFrame, binary: DataFrame, use_score: bool = True) -> DataFrame:
    """pj, dyn, bin_file, percent, weights, weight_percent, matched; a row for each pair with a common string.

    Binary occurrences count each, so a percentage can exceed one. They are summed by string before the join, and
    string weights are computed once for each component's string. Totals of zero give null percentages.
    """
    lib = source_side(source)
    share = 1 / F.col("score") if use_score else F.lit(1.0)
    lib = lib.select("pj", "dyn", "value", share.alias("share"), (L.line_weight(F.col("value"), F.col("pj")) * share).alias("weight"))
    totals = lib.groupBy("pj", "dyn").agg(F.sum("share").alias("all_share"), F.sum("weight").alias("all_weight"))
    counted = binary_side(binary).groupBy("bin_file", "value").agg(F.count("*").alias("n"))
    found = lib.join(counted, "value").groupBy("pj", "dyn", "bin_file").agg(F.sum(F.col("n") * F.col("share")).alias("count"), F.sum(F.col("n") * F.col("weight")).alias("weights"))
    out = found.join(totals, ["pj", "dyn"])
    percent, weight_percent = F.try_divide("count", "all_share"), F.try_divide("weights", "all_weight")
    out = out.select("pj", "dyn", "bin_file", percent.alias("percent"), "weights", weight_percent.alias("weight_percent"))
    return out.withColumn("matched", (F.col("percent") > 0.5) | ((F.col("weights") > 100) & (F.col("weight_percent") > 0.1)))


#: Items of arrays that are packed together, about; cells of a table of arrays by binaries that are counted together.
ITEMS, CELLS = 1 << 21, 1 << 20


def _packed_arrays(batches):
    """_chunk, _no, value for each distinct item of about ITEMS, and one row with the arrays in these numbers: each item once."""
    chunk = TaskContext.get().partitionId() << 32
    schema = pa.schema([("_chunk", pa.int64()), ("_no", pa.int32()), ("value", pa.string()), ("_arrays", pa.binary())])

    def pack(batch):
        n = pa.compute.list_value_length(batch.column("arr")).to_numpy(zero_copy_only=False)
        coded = batch.column("arr").flatten().dictionary_encode()
        values = coded.dictionary.cast(pa.string())
        row, no = np.repeat(np.arange(len(n)), n), pa.compute.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        pairs = np.unique((row * (len(values) + 1) + no)[no >= 0])
        keys = list(zip(batch.column("pj").to_pylist(), batch.column("dyn").to_pylist()))
        number = {k: i for i, k in enumerate(dict.fromkeys(keys))}
        arrays = (list(number), np.array([number[k] for k in keys], np.int32), n.astype(np.int32), (pairs // (len(values) + 1)).astype(np.int32), (pairs % (len(values) + 1)).astype(np.int32))
        yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([-1], pa.int32()), pa.nulls(1, pa.string()), pa.array([zlib.compress(pickle.dumps(arrays), 1)], pa.binary())], schema=schema)
        if len(values):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), chunk)), pa.array(np.arange(len(values), dtype=np.int32)), values, pa.nulls(len(values), pa.binary())], schema=schema)

    held, items = [], 0
    for batch in batches:
        held.append(batch)
        items += len(batch.column("arr").flatten())
        if items >= ITEMS:
            yield from pack(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
            held, items, chunk = [], 0, chunk + 1
    if items:
        yield from pack(pa.Table.from_batches(held).combine_chunks().to_batches()[0])


def _count_arrays(arrays: pa.Table, found: pa.Table) -> pa.Table:
    """pj, dyn, _bin, hit_arrays, matched_strings, hit_chars of packed arrays, from the binaries that hold their items."""
    names = ["pj", "dyn", "_bin", "hit_arrays", "matched_strings", "hit_chars"]
    schema = pa.schema([(c, pa.string() if i < 2 else pa.int64()) for i, c in enumerate(names)])
    if not found.num_rows or not arrays.num_rows:
        return schema.empty_table()
    keys, group, n, row, no = pickle.loads(zlib.decompress(arrays["_arrays"][0].as_py()))
    places = found["_no"].to_numpy().astype(np.int64)
    held = np.frombuffer(b"".join(b for c in found["_bins"].chunks for b in c.to_pylist()), ">u4")
    many = np.zeros(max(int(no.max(initial=0)), int(places.max())) + 1, np.int64)
    size, start = many.copy(), many.copy()
    each = pa.compute.binary_length(found["_bins"]).to_numpy().astype(np.int64) // 4
    many[places], start[places], size[places] = each, np.cumsum(each) - each, found["_size"].to_numpy()
    files, bins = np.unique(held, return_inverse=True)
    width = len(files)
    sums = np.zeros((3, len(keys) * width), np.int64)
    low = 0
    before = np.concatenate([[0], np.cumsum(many[no])])
    first = np.searchsorted(row, np.arange(len(n) + 1))  # where each array's items begin
    while low < len(n):
        # so many arrays that neither their table nor the places in it grow beyond CELLS, one at least
        high = min(low + max(1, CELLS // width), max(low + 1, int(np.searchsorted(before[first], before[first[low]] + CELLS, "right")) - 1), len(n))
        a, b = first[low], first[high]
        times = many[no[a:b]]
        at = np.repeat(start[no[a:b]] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        of, to = np.repeat(row[a:b], times).astype(np.int64), bins[at]
        hits = np.bincount((of - low) * width + to, minlength=(high - low) * width).reshape(high - low, width)
        r, c = np.nonzero(hits / n[low:high, None] >= 0.8)
        cell = group[of].astype(np.int64) * width + to
        sums[0] += np.bincount(group[low + r].astype(np.int64) * width + c, minlength=sums.shape[1])
        sums[1] += np.bincount(cell, minlength=sums.shape[1])
        sums[2] += np.bincount(cell, weights=np.repeat(size[no[a:b]], times), minlength=sums.shape[1]).astype(np.int64)
        low = high
    hit = np.flatnonzero(sums[1])
    own = [keys[k // width] for k in hit]
    return pa.Table.from_arrays([pa.array([k[0] for k in own], pa.string()), pa.array([k[1] for k in own], pa.string()), pa.array(files[hit % width].astype(np.int64)), *(pa.array(x[hit]) for x in sums)], schema=schema)


def match_string_arrays(arrays: DataFrame, strings: DataFrame) -> DataFrame:
    """pj, dyn, bin_file, array_percent, string_percent, char_percent, matched_strings, matched.

    ``arrays``: id, pj, dyn, arr; those of fewer than three items do not count. An array matches if a binary holds 80 % of
    its items. Arrays are packed where they are read, and each distinct item of a pack meets the strings once, by an
    equi-join; numbers of the binaries that hold it go back to its pack, where arrays are counted. Arrays without
    any keep their place in the totals.
    """
    long = arrays.where(F.size("arr") >= 3).select("pj", "dyn", F.transform("arr", L.unquoted).alias("arr")).where("pj IS NOT NULL AND dyn IS NOT NULL")
    chars = F.aggregate("arr", F.lit(0), lambda a, x: a + F.length(x))
    totals = long.groupBy("pj", "dyn").agg(F.count("*").alias("arrays"), F.sum(F.size("arr")).alias("items"), F.sum(chars).alias("chars"))
    packed = staged(long.mapInArrow(_packed_arrays, "_chunk long, _no int, value string, _arrays binary"), "arrays")
    names = staged(strings.select("bin_file").distinct().coalesce(1).withColumn("_bin", F.monotonically_increasing_id()), "binaries")  # from 0 on
    held = strings.select("bin_file", "value").distinct().join(names, "bin_file").groupBy("value").agg(F.unhex(F.array_join(F.transform(F.collect_list("_bin"), lambda k: F.lpad(F.hex(k), 8, "0")), "")).alias("_bins"))
    found = packed.where("_no >= 0").select("_chunk", "_no", "value").join(held, "value").select(F.col("_chunk").alias("_of"), "_no", F.length("value").alias("_size"), "_bins")
    each = packed.where("_no < 0").select("_chunk", "_arrays").groupBy("_chunk").cogroup(found.groupBy("_of"))
    counted = each.applyInArrow(_count_arrays, "pj string, dyn string, _bin long, hit_arrays long, matched_strings long, hit_chars long")
    found = counted.groupBy("pj", "dyn", "_bin").agg(*(F.sum(c).alias(c) for c in ("hit_arrays", "matched_strings", "hit_chars"))).join(names, "_bin")
    out = found.join(totals, ["pj", "dyn"]).select(
        "pj", "dyn", "bin_file", (F.col("hit_arrays") / F.col("arrays")).alias("array_percent"), (F.col("matched_strings") / F.col("items")).alias("string_percent"),
        F.try_divide("hit_chars", "chars").alias("char_percent"), "matched_strings",
    )
    return out.withColumn("matched", (F.col("array_percent") >= 0.5) | (F.greatest("string_percent", "char_percent") >= 0.6))


def version_counts(projects: DataFrame) -> DataFrame:
    """pj, ver_cnt"""
    return projects.select("pj", "ver").distinct().groupBy("pj").agg(F.count("*").alias("ver_cnt"))


def with_scores(postings: DataFrame, projects: DataFrame, key: str, weight) -> DataFrame:
    """Distinct postings (``key``, pj, dyn, ver) with pj_score and ver_score: weight times log10 of how rare the key is
    among projects, and among the project's versions. Keys of projects without versions go.

    Versions are gathered by key and component, projects are counted by key and joined back, so that a key of every project
    is many rows.
    """
    counts = version_counts(projects)
    total = counts.agg(F.count("*").alias("projects"))  # one row
    rows = postings.select(key, "pj", "dyn", "ver").groupBy(key, "pj", "dyn").agg(F.collect_set("ver").alias("vers"))
    rel = rows.select(key, "pj").distinct().groupBy(key).agg(F.count("*").alias("rel_projs"))
    rows = rows.join(rel, key).withColumn("weight", weight(F.col(key)))
    rows = rows.join(counts, "pj").join(F.broadcast(total))
    scored = rows.select(
        key, "pj", "dyn", "weight", L.idf_score(F.col("weight"), F.col("projects"), F.col("rel_projs")).alias("pj_score"),
        L.idf_score(F.col("weight"), F.col("ver_cnt"), F.size("vers")).alias("ver_score"), F.explode("vers").alias("ver"),
    )
    return scored.select(key, "pj", "dyn", "ver", "weight", "pj_score", "ver_score")


def string_index(source: DataFrame, projects: DataFrame, full_token_factor: bool = False) -> DataFrame:
    """value, pj, dyn, ver, weight, pj_score, ver_score"""
    return with_scores(source, projects, "value", lambda v: L.string_weight(v, full_token_factor))


def score_totals(index: DataFrame) -> DataFrame:
    """pj, dyn, ver, total_pj_score, total_ver_score, total_count"""
    return index.groupBy("pj", "dyn", "ver").agg(F.sum("pj_score").alias("total_pj_score"), F.sum("ver_score").alias("total_ver_score"), F.count("*").alias("total_count"))


def probe(index: DataFrame, binary: DataFrame) -> DataFrame:
    """bin_file, value and the index's columns for each distinct string of each binary, of 1 to 65535 characters."""
    asked = binary.select("bin_file", "value").where(F.length("value").between(1, 65535)).distinct()
    return asked.join(index, "value")


def score_tables(hits: DataFrame) -> DataFrame:
    """bin_file, pj, dyn, ver, pj_score, ver_score, matched_count"""
    return hits.groupBy("bin_file", "pj", "dyn", "ver").agg(F.sum("pj_score").alias("pj_score"), F.sum("ver_score").alias("ver_score"), F.count("*").alias("matched_count"))


def string_candidates(scores: DataFrame, totals: DataFrame) -> DataFrame:
    """Score tables that pass the string rule, with count_sim and score_sim. Without a total, or with a total of zero,
    there is no candidate."""
    rows = scores.join(totals, ["pj", "dyn", "ver"]).where("total_pj_score != 0")
    rows = rows.withColumns({"count_sim": F.col("matched_count") / F.col("total_count"), "score_sim": F.col("pj_score") / F.col("total_pj_score")})
    c, s, n = F.col("count_sim"), F.col("score_sim"), F.col("total_count")
    return rows.where((n > 20) & ((c >= 0.5) | (s >= 0.5) | ((c >= 0.3) & (s >= 0.3)) | ((n > 500) & (c + s >= 0.5))))
