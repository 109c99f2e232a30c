"""Mixing sources to target weights by Pfair scheduling.

Weights are whole numbers of slots in a period of SLOTS, or of two for each source if these are more. Block j of a source of weight w is released at
floor(j / w) and due at ceil((j + 1) / w); in each slot the released block with the earliest deadline goes, so that
after t slots every source has had more than w * t - 1 and less than w * t + 1 blocks. A period's weights add up to its
length, so the schedule starts afresh with each period: one period is computed, and a document's slot follows from
its rank in its source. No document is dropped; a source that has run out leaves its slots to the others.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged

#: Slots of a period, and slots for each source at least.
SLOTS, EACH = 1000, 2
#: What ``mixed`` adds.
COLUMNS = ("_source", "_block", "_slot", "_place")
#: Documents of a block, and documents that one ranking task gets on average.
BLOCK, RANKED = 8, 20_000


def slots_for(sources: int) -> int:
    return max(SLOTS, EACH * sources)


def whole_weights(target: dict[str, float], slots: int | None = None) -> dict[str, int]:
    """Slots of each source by largest remainders, one at least; targets are not negative. ``slots``: of a period."""
    if not target:
        return {}
    slots = slots or slots_for(len(target))
    total = sum(map(Fraction, target.values()))
    share = {s: Fraction(w) / total * slots if total else Fraction(slots, len(target)) for s, w in target.items()}
    out = {s: max(1, int(x)) for s, x in share.items()}
    spare = slots - sum(out.values())
    for s in sorted(target, key=lambda s: (int(share[s]) - share[s], s))[: max(0, spare)]:
        out[s] += 1
    # the sources that were raised to one slot have it from those that are furthest above their shares
    above = [(share[s] - n, -n, s) for s, n in out.items() if n > 1] if spare < 0 else []
    heapq.heapify(above)
    for _ in range(-spare):
        _, _, s = heapq.heappop(above)
        out[s] -= 1
        if out[s] > 1:
            heapq.heappush(above, (share[s] - out[s], -out[s], s))
    return out


def period(weights: dict[str, int]) -> list[str]:
    """The source of each slot of a period: earliest deadline first among the released blocks.

    Ties: by the PD rules, a block whose window overlaps the next one's goes first, then the heavier source, then the name.
    """
    slots = sum(weights.values())
    waiting = [(0, s, 0) for s in weights]  # release, source, block
    ready: list[tuple] = []
    out = []
    for t in range(slots):
        while waiting and waiting[0][0] <= t:
            _, s, j = heapq.heappop(waiting)
            w = weights[s]
            heapq.heappush(ready, (-(-(j + 1) * slots // w), 0 if (j + 1) * slots % w else 1, -w, s, j))
        *_, s, j = heapq.heappop(ready)  # the weights add up to the slots, so one is always released
        out.append(s)
        if j + 1 < weights[s]:
            heapq.heappush(waiting, ((j + 1) * slots // weights[s], s, j + 1))
    return out


def source_sizes(docs: DataFrame, source_col: str = "source") -> dict[str, int]:
    """Documents by source. The driver gets one row for each source: as many as the mixture has targets."""
    name = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    return {r.s: r["count"] for r in docs.groupBy(name.alias("s")).count().collect()}


def tempered(sizes: dict[str, int], power: float = 0.5) -> dict[str, float]:
    """Targets in proportion to a power of the sizes: under 1, small sources gain."""
    return {s: n**power for s, n in sizes.items()}


def mixed(docs: DataFrame, target: dict[str, float] | None = None, block: int = BLOCK, source_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with _source, _block (number in its source), _slot, and _place: its place in the mixture is by (_slot, _place).

    Within its source a document's rank follows the MD5 of its id as text (none: of the empty text; ties: id, then a hash of the text
    where there is one). A null source is a source of its own, named ''. Columns of ``docs`` with one of the four names are
    replaced. Sources without a target get the smallest target given. Ranking is by ranges of the MD5 in a source, so that a
    large one is many groups.
    """
    sizes = source_sizes(docs, source_col)
    weights = tempered(sizes) if target is None else {s: target.get(s, min(target.values(), default=1.0)) for s in sizes}
    slots = period(whole_weights(weights))  # a row for each slot; Spark broadcasts them if they are few
    spark = docs.sparkSession
    seen: dict[str, int] = {}
    table = [(s, seen.setdefault(s, 0), t, seen.__setitem__(s, seen[s] + 1))[:3] for t, s in enumerate(slots)]
    pattern = spark.createDataFrame(table or [("", 0, 0)], "_source string, _index long, _at long")
    per = spark.createDataFrame([(s, n) for s, n in seen.items()] or [("", 1)], "_source string, _per long")
    ranges = max(128, -(-sum(sizes.values()) // RANKED))
    code = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    bucket = F.shiftright(F.conv(F.substring(code, 1, 8), 16, 10).cast("long") * ranges, 32)
    name = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    last = F.col("text").cast("string") if "text" in docs.columns else F.lit("")
    # the document itself travels as one column, so that its columns cannot clash with these
    rows = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("_row"), name.alias("_source"), bucket.alias("_bucket"), code.alias("_code"), F.col(id_col).alias("_id"), F.xxhash64(last).alias("_last"))
    # the ranges' sizes, and how many rows of the source stand before each: sources x ranges small rows
    counts = staged(docs.select(name.alias("_source"), bucket.alias("_bucket")).groupBy("_source", "_bucket").agg(F.count("*").alias("_n")), "ranges")
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy("_source").orderBy("_bucket")) - F.col("_n")).drop("_n")
    within = F.row_number().over(Window.partitionBy("_source", "_bucket").orderBy("_code", "_id", "_last")) - 1
    ranked = rows.withColumn("_within", within).join(before, ["_source", "_bucket"]).withColumn("_rank", F.col("_before") + F.col("_within"))
    ranked = ranked.withColumn("_block", F.floor(F.col("_rank") / block)).join(per, "_source")
    ranked = ranked.withColumn("_index", F.col("_block") % F.col("_per")).join(pattern, ["_source", "_index"])
    slot = F.floor(F.col("_block") / F.col("_per")) * len(slots) + F.col("_at")
    kept = [F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c not in COLUMNS]
    return ranked.select(*kept, "_source", "_block", slot.alias("_slot"), (F.col("_rank") % block).cast("int").alias("_place"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, block, slot, place of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    out = mixed(docs)
    return out.select("doc_id", "source", F.col("_block").alias("block"), F.col("_slot").alias("slot"), F.col("_place").alias("place"))
