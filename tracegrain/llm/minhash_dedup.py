"""Near-duplicate documents by MinHash bands, with odd sketches between the bands and the exact check.

Documents with equal shingle sets are one class, and only the class's smallest id goes on. MinHash samples are
banded for candidates and folded into a parity bitmap (an odd sketch), whose XOR population count estimates high
similarities closely; pairs far below the threshold by it are dropped, all others are decided on full sets. In large
buckets the parity bitmaps of whole sets, which bound the difference from below, come in between.

No bucket's pairs are all tried: in each bucket every member is tried with one centre, drawn anew for each bucket.
Components of the links found contract the buckets; what is left, members of one bucket in different components,
is compared completely, in blocks, so that no link between components is lost.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, byte_texts, map_texts, mix, staged, texts
from .components import connected

#: 36 bands of 5: a pair of similarity 0.8 is missed with probability 6e-7.
BANDS, ROWS = 36, 5
#: Bits of an odd sketch, and the estimate below which a pair is dropped: six deviations under 0.8.
BITS, LEAST_ESTIMATE = 512, 0.5
#: Buckets up to this size are compared by a join, larger ones in blocks of the second size.
SMALL, BLOCK = 16, 2048

_K = BANDS * ROWS
_STATE = np.random.RandomState(20240607)
_XOR = _STATE.randint(0, 1 << 32, _K, dtype=np.int64).astype(np.uint32)[:, None]
_ODD = (_STATE.randint(0, 1 << 32, _K, dtype=np.int64).astype(np.uint32) | np.uint32(1))[:, None]
_SEED = _STATE.randint(0, 1 << 63, max(_K, 64), dtype=np.int64).astype(np.uint64)


def shingles(text: bytes, width: int, memo: Memo) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``width`` words; fewer words make one shingle, none make none."""
    found = text.lower().split()
    n = len(found)
    if not n:
        return np.empty(0, np.uint64)
    words = np.fromiter(map(memo.__getitem__, found), np.uint64, n)
    width_ = min(width, n)
    code = words[: n - width_ + 1].copy()
    for k in range(1, width_):
        code = mix(code + np.uint64(k)) + words[k : n - width_ + 1 + k]
    return np.unique(mix(code + np.uint64(width_)))


def word_memo() -> Memo:
    return Memo(xxhash.xxh3_64_intdigest, 200_000)


def samples(found: np.ndarray) -> np.ndarray:
    """The least of each of K orders; 32 bits of the hashes are multiplied four times as fast as 64."""
    high = (found >> np.uint64(32)).astype(np.uint32)
    out = np.full(_K, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(high), 1024):
        np.minimum(out, ((high[None, at : at + 1024] ^ _XOR) * _ODD).min(1), out=out)
    return out.astype(np.uint64)


def signature(found: np.ndarray) -> tuple[list[int], list[int]]:
    """Band keys and the odd sketch, as signed 64-bit integers."""
    low = mix(samples(found))
    bands = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        bands = mix(bands + low[k::ROWS])
    odd = np.bincount((mix(low ^ _SEED[:_K]) >> np.uint64(64 - int(math.log2(BITS)))).astype(np.int64), minlength=BITS) & 1
    return bands.view(np.int64).tolist(), np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def parity_bits(n: int) -> int:
    """Bits of a set's parity bitmap: the power of two from four for each element on, 512 at least."""
    return max(512, 1 << (4 * n - 1).bit_length())


def parity_bitmap(found: np.ndarray) -> bytes:
    """The odd sketch of the whole set. Its XOR with another's has at most as many bits as elements differ, so it
    proves dissimilarity; bitmaps of different sizes compare after the larger is folded in two."""
    bits = parity_bits(len(found))
    odd = np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _folded(bitmaps: np.ndarray) -> np.ndarray:
    half = bitmaps.shape[1] // 2
    return bitmaps[:, :half] ^ bitmaps[:, half:]


def signatures(rows: DataFrame, width: int) -> DataFrame:
    def kernel(batch, memo):
        out: dict = {"n": [], "sig": [], "bands": [], "sketch": [], "parity": []}
        for text in byte_texts(batch):
            found = shingles(text, width, memo)
            out["n"].append(len(found))
            out["parity"].append(parity_bitmap(found))
            out["sig"].append(xxhash.xxh3_128_digest(found.tobytes()))
            bands, sketch = signature(found) if len(found) else ([], [])
            out["bands"].append(bands)
            out["sketch"].append(sketch)
        return {"doc_id": batch.column("doc_id")} | out

    return map_texts(rows, kernel, "doc_id long, n long, sig binary, bands array<long>, sketch array<long>, parity binary", word_memo)


def most_bits(least: float = LEAST_ESTIMATE) -> int:
    """The population count of the XOR of two sketches at an estimated similarity of ``least``."""
    return int(BITS / 2 * (1 - math.exp(-4 * _K * (1 - least) / BITS)))


def likely(percent: int) -> Column:
    """Whether columns an, bn (set sizes) and sa, sb (sketches) leave room for the threshold."""
    apart = sum((F.bit_count(F.col("sa")[i].bitwiseXOR(F.col("sb")[i])) for i in range(BITS // 64)), F.lit(0))
    return (100 * F.least("an", "bn") >= percent * F.greatest("an", "bn")) & (apart <= most_bits())


def verified(pairs: DataFrame, rows: DataFrame, width: int, percent: int) -> DataFrame:
    """Of ``pairs`` (a, b) those whose full shingle sets have 100 * intersection >= percent * union."""
    left, right = (rows.select(F.col("doc_id").alias(x), F.col("text").alias(f"{x}_text")) for x in "ab")

    def kernel(batch, memo):
        sets: dict[int, np.ndarray] = {}
        columns = [(batch.column(x).to_pylist(), byte_texts(batch, f"{x}_text")) for x in "ab"]
        out: dict = {"a": [], "b": []}
        for a, ta, b, tb in zip(*columns[0], *columns[1]):
            for k, t in ((a, ta), (b, tb)):
                if k not in sets:
                    if len(sets) > 2000:
                        sets.clear()
                    sets[k] = shingles(t, width, memo)
            if a in sets and b in sets:
                x, y = sets[a], sets[b]
            else:
                x, y = shingles(ta, width, memo), shingles(tb, width, memo)
            both = len(np.intersect1d(x, y, assume_unique=True))
            if both and 100 * both >= percent * (len(x) + len(y) - both):
                out["a"].append(a)
                out["b"].append(b)
        return out

    joined = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "a_text", "b_text")
    return map_texts(joined, kernel, "a long, b long", word_memo)


def _with_sketches(pairs: DataFrame, kept: DataFrame) -> DataFrame:
    a = kept.select(F.col("doc_id").alias("a"), F.col("n").alias("an"), F.col("sketch").alias("sa"))
    b = kept.select(F.col("doc_id").alias("b"), F.col("n").alias("bn"), F.col("sketch").alias("sb"))
    return pairs.join(a, "a").join(b, "b")


def _block_pairs(percent: int):
    """Candidate pairs between the queries and the targets of one block; ids only where components differ.

    A pair that the samples leave likely has to pass its sets' parity bitmaps too: of sets with m and n elements, at most
    (m + n) * (100 - percent) / (100 + percent) elements differ in a link.
    """
    bits = most_bits()
    share = (100 - percent) / (100 + percent)

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        q, t = pdf[pdf["query"]], pdf[~pdf["query"]]
        out = []
        if len(q) and len(t):
            ids, comps, sizes = t["rep"].to_numpy(), t["comp"].to_numpy(), t["n"].to_numpy()
            sketch = np.array(t["sketch"].tolist(), np.int64).view(np.uint64)
            parity, widths = t["parity"].to_numpy(), np.array([parity_bits(int(n)) for n in sizes])
            levels = {}
            for width in np.unique(widths):
                at = np.flatnonzero(widths == width)
                levels[int(width)] = (at, np.frombuffer(b"".join(parity[at]), np.uint64).reshape(len(at), -1))
            for rep, comp, n, own, bitmap in zip(q["rep"], q["comp"], q["n"], q["sketch"], q["parity"]):
                apart = np.bitwise_count(sketch ^ np.array(own, np.int64).view(np.uint64)).sum(1)
                likely_ = (comps != comp) & (apart <= bits) & (100 * np.minimum(sizes, n) >= percent * np.maximum(sizes, n))
                if not likely_.any():
                    continue
                mine = np.frombuffer(bitmap, np.uint64)[None, :]
                for width, (at, maps) in levels.items():
                    hit = np.flatnonzero(likely_[at])
                    if len(hit):
                        left, right = maps[hit], mine
                        while left.shape[1] > right.shape[1]:
                            left = _folded(left)
                        while right.shape[1] > left.shape[1]:
                            right = _folded(right)
                        hit = at[hit[np.bitwise_count(left ^ right).sum(1) <= (sizes[at[hit]] + n) * share + 1e-9]]
                        out += [(min(rep, x), max(rep, x)) for x in ids[hit]]
        return pd.DataFrame(sorted(set(out)), columns=["a", "b"], dtype="int64")

    return compare


def _left_over(members: DataFrame, comps: DataFrame, kept: DataFrame, tried: DataFrame, percent: int) -> DataFrame:
    """All likely pairs of one bucket that are in different components, but for those tried already."""
    on = comps.select(F.col("id").alias("rep"), "component")
    labelled = members.join(on, "rep", "left").select("key", "rep", "size", F.coalesce("component", "rep").alias("comp"))
    labelled = staged(labelled, "labelled")
    several = labelled.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    open_ = staged(labelled.join(staged(several, "several"), "key"), "open")
    small = open_.where(F.col("size") <= SMALL)
    a, b = small.select("key", F.col("rep").alias("a"), F.col("comp").alias("ac")), small.select("key", F.col("rep").alias("b"), F.col("comp").alias("bc"))
    near = a.join(b, "key").where("ac != bc and a < b").select("a", "b").distinct()
    near = _with_sketches(near, kept).where(likely(percent)).select("a", "b")
    large = open_.where(F.col("size") > SMALL)
    if not large.isEmpty():
        by = large.groupBy("key", "comp").agg(F.count("*").alias("c"))
        main = staged(by.groupBy("key").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.sum("c").alias("all"), F.max("c").alias("most")), "mains")
        rows = large.join(main, "key").join(kept.select(F.col("doc_id").alias("rep"), "n", "sketch", "parity"), "rep")
        blocks = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
        tb, qb = blocks(F.col("all")), F.greatest(F.lit(1), blocks(F.col("all") - F.col("most")))
        part = lambda n, seed: F.pmod(F.xxhash64("rep", F.lit(seed)), n).cast("int")
        targets = rows.withColumn("t", part(tb, 1)).withColumn("q", F.explode(F.sequence(F.lit(0), qb - 1))).withColumn("query", F.lit(False))
        queries = rows.where("comp != main").withColumn("q", part(qb, 2)).withColumn("t", F.explode(F.sequence(F.lit(0), tb - 1))).withColumn("query", F.lit(True))
        both = targets.select("key", "t", "q", "query", "rep", "comp", "n", "sketch", "parity").unionByName(queries.select("key", "t", "q", "query", "rep", "comp", "n", "sketch", "parity"))
        near = near.union(both.groupBy("key", "t", "q").applyInPandas(_block_pairs(percent), "a long, b long"))
    return near.distinct().join(tried, ["a", "b"], "left_anti")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links), kept (doc_id = component_id).

    A link is 100 * intersection >= percent * union of the sets of distinct ``width``-word shingles. Null and empty
    texts have no shingles and link with nothing; rows without an id are kept and link with nothing (null
    component). A row that is repeated gives repeated results.
    """
    rows = texts(docs, id_col, text_col)
    sigs = staged(signatures(rows, width), "signatures")
    classes = staged(sigs.where("n > 0 and doc_id is not null").groupBy("sig").agg(F.min("doc_id").alias("rep")), "classes")
    kept = sigs.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").select("doc_id", "n", "sketch", "parity", "bands")
    kept = staged(kept.dropDuplicates(["doc_id"]), "kept")
    keyed = kept.select(F.col("doc_id").alias("rep"), F.explode("bands").alias("key"))
    buckets = keyed.groupBy("key").agg(F.count("*").alias("size"), F.min(F.struct(F.xxhash64("key", "rep"), "rep")).alias("least")).where("size > 1")
    buckets = staged(buckets.select("key", "size", F.col("least.rep").alias("centre")), "buckets")
    members = staged(keyed.join(buckets, "key"), "members")
    tried = members.where("rep != centre").select(F.least("rep", "centre").alias("a"), F.greatest("rep", "centre").alias("b")).distinct()
    tried = staged(tried, "tried")
    plain = rows.where("doc_id is not null")
    links = staged(verified(_with_sketches(tried, kept).where(likely(percent)), plain, width, percent), "links")
    comps = connected(links)
    more = staged(_left_over(members, comps, kept, tried, percent), "left-over")
    if not more.isEmpty():
        found = staged(verified(more, plain, width, percent), "links")
        if not found.isEmpty():
            comps = connected(links.union(found))
    own = sigs.select("doc_id", "n", F.when(F.col("n") > 0, F.col("sig")).alias("sig"))
    out = own.join(classes, "sig", "left").join(comps.select(F.col("id").alias("rep"), "component"), "rep", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=2)
