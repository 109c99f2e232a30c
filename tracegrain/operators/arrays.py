"""Matching number arrays in the bytes of binaries: needles, their subsumption, containment, index scores."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import encoding as E
from ..functions import lexical as L
from ..functions import places
from ..staging import staged
from .strings import score_totals, with_scores

#: Bytes of a haystack's block, without the overlap; lengths by which needles are looked up, and needles up to which the sieve
#: grows, both at most.
BLOCK, LEVELS, SENT = 1 << 15, 48, 4_000_000


def distinct_arrays(arrays: DataFrame, key: str, seq: str) -> DataFrame:
    """``key``, arr, element_type, score, count: searchable arrays once each; the first by ``seq`` gives type and score."""
    first = F.min_by(F.struct("element_type", "score"), seq)
    rows = arrays.where(E.is_searchable(F.col("arr"))).groupBy(key, "arr").agg(first.alias("first"), F.count("*").alias("count"))
    return rows.select(key, "arr", "first.element_type", "first.score", "count")


def needle_table(distinct: DataFrame, key: str, wide: bool = False) -> DataFrame:
    """``key``, arr, count, score, needle: one width for a known type, else all that hold the largest number."""
    known = E.type_width(F.col("element_type"), wide)
    widths = F.when(known.isNotNull(), F.array(known)).otherwise(E.widths(F.col("arr"), False))
    rows = distinct.withColumn("width", F.explode(widths))
    return rows.select(key, "arr", "count", "score", E.needle(F.col("arr"), F.col("width")).alias("needle"))


def blocks(haystacks: DataFrame, keys: list[str], data: Column, longest: int) -> DataFrame:
    """``keys``, _block, _part: each haystack's bytes in overlapping parts, so that a needle of ``longest`` bytes at most stands
    whole in the part where it begins."""
    rows = haystacks.select(*keys, data.alias("_all"))
    starts = F.sequence(F.lit(0), F.greatest(F.length("_all") - 1, F.lit(0)), F.lit(BLOCK))
    cut = F.transform(starts, lambda at: F.struct(at.alias("at"), F.substring("_all", at + 1, F.lit(BLOCK + longest - 1)).alias("part")))
    return rows.select(*keys, F.explode(cut).alias("_cut")).select(*keys, F.col("_cut.at").alias("_block"), F.col("_cut.part").alias("_part"))


def _levels(sizes: list[int]) -> list[int]:
    """The needles' own lengths, or LEVELS of them spread evenly, the least among them."""
    if len(sizes) <= LEVELS:
        return sizes
    return sorted({sizes[i * len(sizes) // LEVELS] for i in range(LEVELS)})


def contained(needles: DataFrame, haystacks: DataFrame, keys: list[str], byte_aligned: bool, same: tuple[str, ...] = (), carry: tuple[str, ...] = (), longer: bool = False) -> DataFrame:
    """(``same``, ``keys``, needle, ``carry``) where ``needle`` stands in ``hex``, the haystack of ``keys``; ``carry`` are further
    columns of the needles. ``longer`` leaves out the needle that is the whole haystack.

    Haystacks are cut into overlapping blocks. A needle is looked up by its whole length (or the longest of the LEVELS that
    it has): a block is read once, and what stands at a place goes on if the sieve, a bit map of the needles' hashes, lets it
    pass. These bytes meet the needles by an equi-join, so the sieve decides nothing. The driver holds the sieve only, and no
    haystack, and no list of places or needles, is ever one row. ``byte_aligned`` counts even places only: both
    sides are then compared as bytes, else as digits.
    """
    raw = (lambda c: F.unhex(c)) if byte_aligned else (lambda c: F.encode(c, "US-ASCII"))
    size = F.length("_bytes")
    salt = F.xxhash64(*same) if same else F.lit(0).cast("long")
    asked = needles.select(*same, "needle", *carry).distinct().withColumn("_bytes", raw(F.col("needle"))).where(size > 0)
    asked = staged(asked, "needles")
    rows = asked.groupBy(size.alias("size")).agg(F.count("*").alias("n")).collect()
    sizes = sorted(r.size for r in rows)
    if not sizes:
        return haystacks.where(F.lit(False)).select(*same, *keys).join(needles.select(*same, "needle", *carry).where(F.lit(False)), list(same))
    levels = _levels(sizes)
    longest = [max(s for s in sizes if s < high) for high in [*levels[1:], sizes[-1] + 1]]
    bits = max(16, (64 * min(sum(r.n for r in rows), SENT)).bit_length())
    sent = _sieve(asked.select("_bytes", salt.alias("_salt")), levels, bits)
    parts = blocks(haystacks.withColumns({"_salt": salt, "_size": F.length(raw(F.col("hex")))}), [*same, *keys, "_salt", "_size"], raw(F.col("hex")), sizes[-1])
    kept = [*same, *keys]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in parts.select(*kept).schema]
    found = parts.drop("_block").mapInArrow(scan(kept, levels, longest, bits, sent, BLOCK, longer), ", ".join([*fields, "_seed binary", "_rest binary"]))
    level = F.coalesce(*(F.when(size >= n, F.lit(n)) for n in reversed(levels)))
    asked = asked.withColumn("_seed", F.substring("_bytes", F.lit(1), level))
    found = found.repartition(*same, "_seed").distinct().join(asked, [*same, "_seed"])
    found = found.where(F.substring(F.coalesce("_rest", "_seed"), F.lit(1), size) == F.col("_bytes")).select(*kept, "needle", *carry)
    return found if levels == longest else found.distinct()


def _sieve(rows: DataFrame, levels: list[int], bits: int):
    """The bit map of the needles (_bytes, _salt), for all tasks."""

    def build(batches):
        table = None
        for batch in batches:
            table = places.Sieve(bits, levels) if table is None else table
            table.add(batch.column("_bytes"), batch.column("_salt"))
        if table is not None:
            yield pa.RecordBatch.from_arrays([pa.array([table.packed()], pa.binary())], ["sieve"])

    whole = places.Sieve(bits, levels)
    for row in rows.coalesce(8).mapInArrow(build, "sieve binary").toLocalIterator():
        whole.merge(row.sieve)
    return rows.sparkSession.sparkContext.broadcast(whole.packed())


def scan(kept: list[str], levels: list[int], longest: list[int], bits: int, sent, block: int, longer: bool):
    """What of blocks (``kept``, _salt, _size, _part) passes the sieve: ``kept``, _seed (as long as a level) and, where
    needles are longer, _rest; once for each block."""

    def run(batches):
        sieve = places.Sieve(bits, levels, sent.value)
        for batch in batches:
            for at, rows in places.chunks(batch.column("_part")):
                some = batch.slice(at, rows)
                origin, seeds, rests = sieve.search(some.column("_part"), some.column("_salt"), some.column("_size"), longest, block, longer)
                if not len(origin):
                    continue
                out = [some.column(k).take(pa.array(origin)) for k in kept]
                yield pa.RecordBatch.from_arrays([*out, pa.array(seeds, pa.binary()), pa.array(rests, pa.binary())], [*kept, "_seed", "_rest"])

    return run


def without_subsumed(needles: DataFrame, key: str) -> DataFrame:
    """Needles that no strictly longer needle of the same ``key`` contains."""
    every = needles.select(key, "needle").distinct()
    gone = contained(every, every.select(key, F.col("needle").alias("hex")), [], False, (key,), longer=True).select(key, "needle").distinct()
    return needles.join(gone, [key, "needle"], "left_anti")


def match_arrays(needles: DataFrame, binaries: DataFrame, key: str, byte_aligned: bool = False, use_score: bool = True) -> DataFrame:
    """``key``, bin_file, success, total, similarity, matched, matched_simple.

    An array counts once if any of its needles stands in the binary's hex text, at any nibble unless ``byte_aligned``. The
    rule needs half of a large total, or 70 % of a smaller one; ``matched_simple`` is half alone.
    """
    score = L.occurrence_score(F.col("count"), F.size("arr"), F.col("score"), use_score)
    arrays = needles.groupBy(key, "arr").agg(F.collect_set("needle").alias("needles"), F.collect_set(score).alias("scores"))
    points = F.aggregate("scores", F.lit(0.0) if use_score else F.lit(0).cast("long"), lambda a, x: a + x)
    arrays = arrays.select(key, "needles", F.when(F.size("scores") > 0, points).alias("points"))
    arrays = staged(arrays.withColumn("_id", F.monotonically_increasing_id()), "arrays")
    totals = arrays.groupBy(key).agg(F.sum("points").alias("total"))
    asked = arrays.select("_id", F.explode("needles").alias("needle"))
    hits = contained(asked, binaries.select("bin_file", "hex"), ["bin_file"], byte_aligned, carry=("_id",)).select("_id", "bin_file")
    found = hits.repartition("_id").distinct().join(arrays.select("_id", key, "points"), "_id").groupBy(key, "bin_file").agg(F.sum("points").alias("success"))
    rows = found.join(totals, key).withColumn("similarity", F.try_divide("success", "total"))
    rule = ((F.col("total") >= 50) & (F.col("similarity") >= 0.5)) | ((F.col("total") > 5) & (F.col("total") < 50) & (F.col("similarity") >= 0.7))
    return rows.select(key, "bin_file", "success", "total", "similarity", rule.alias("matched"), (F.col("similarity") >= 0.5).alias("matched_simple"))


def array_index(arrays: DataFrame, projects: DataFrame) -> DataFrame:
    """arr, pj, dyn, ver, weight, pj_score, ver_score, trie_no; the weight is the natural logarithm of the length."""
    once = lambda rows: rows.groupBy("arr", "pj", "dyn", "ver").agg(F.max("entropy").alias("entropy"))
    trimmed = staged(once(once(arrays).withColumn("arr", E.without_outer_zeros(F.col("arr")))), "postings")
    few = trimmed.groupBy("arr").agg(F.count_distinct("pj").alias("projects"), F.max("entropy").alias("entropy"))
    taken = few.where(E.is_admitted(F.col("arr"), F.col("entropy"), F.col("projects"))).select("arr")
    rows = with_scores(trimmed.join(taken, "arr", "left_semi"), projects, "arr", lambda a: F.log(F.size(a)))
    return rows.withColumn("trie_no", E.trie_number(F.col("arr")))


def array_totals(index: DataFrame) -> DataFrame:
    lengths = index.groupBy("pj", "dyn", "ver").agg(F.sum(F.size("arr")).alias("total_len"))
    return score_totals(index).join(lengths, ["pj", "dyn", "ver"])


def search_index(index: DataFrame, segments: DataFrame) -> DataFrame:
    """bin_file, seg, arr: arrays of the index whose bytes, in any width, stand in a segment's (byte aligned)."""
    arrays = index.select("arr").distinct()
    needles = arrays.select("arr", F.explode(E.needles(F.col("arr"))).alias("needle"))
    found = contained(needles, segments.select("bin_file", "seg", "hex"), ["bin_file", "seg"], True, carry=("arr",))
    return found.select("bin_file", "seg", "arr").repartition("arr").distinct()


def array_scores(hits: DataFrame, index: DataFrame) -> DataFrame:
    """bin_file, pj, dyn, ver, pj_score, ver_score, matched_count, matched_len; once for each segment an array is in."""
    rows = hits.join(index, "arr")
    return rows.groupBy("bin_file", "pj", "dyn", "ver").agg(F.sum("pj_score").alias("pj_score"), F.sum("ver_score").alias("ver_score"), F.count("*").alias("matched_count"), F.sum(F.size("arr")).alias("matched_len"))


def array_candidates(scores: DataFrame, totals: DataFrame) -> DataFrame:
    """Score tables that pass the array rule. Without a total there is no candidate."""
    rows = scores.join(totals, ["pj", "dyn", "ver"]).where("total_pj_score != 0")
    rows = rows.withColumns({"count_sim": F.col("matched_count") / F.col("total_count"), "len_sim": F.col("matched_len") / F.col("total_len"), "score_sim": F.col("pj_score") / F.col("total_pj_score")})
    c, n, s, own = F.col("count_sim"), F.col("len_sim"), F.col("score_sim"), F.col("pj_score")
    enough = ((F.col("total_count") > 5) | (F.col("total_len") > 50) | (F.col("total_pj_score") > 50)) & (own > 15)
    alike = (c >= 0.7) | ((c >= 0.5) & (n > 0.7)) | ((c >= 0.5) & (s >= 0.7)) | ((c >= 0.5) & (n > 0.5) & (s >= 0.5)) | (n + s >= 1.5) | ((own > 50) & (c >= 0.5))
    return rows.where(enough & alike)


def passed_by(postings: DataFrame, least: int = 4, longest: int = 50) -> DataFrame:
    """arr, pj, dyn, ver of the stored arrays that stand, contiguously, in a stored array of at most ``longest`` numbers;
    longer ones pass by themselves only. All slices are looked up by an equi-join, none longer than the longest stored."""
    stored = postings.select("arr").distinct()
    n = F.size("arr")
    starts = F.sequence(F.lit(1), F.greatest(n - least + 1, F.lit(1)))
    slices = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(least), F.greatest(n - i + 1, F.lit(least))), lambda k: F.slice(F.col("arr"), i, k))))
    inner = stored.where((n <= longest) & (n >= least)).select(F.explode(F.array_distinct(slices)).alias("arr")).where(F.size("arr") >= least)
    seen = inner.unionByName(stored.where(n > longest)).distinct()
    return postings.join(seen, "arr", "left_semi").distinct()
