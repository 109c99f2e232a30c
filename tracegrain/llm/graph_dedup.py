"""Near-duplicate vectors by robust-pruned flat graphs over overlapping cluster shards.

1. Equal vectors of a label are one class, which has their number; only classes go on.
2. The classes of a label are one cell, and cells of more than LIMIT are split, level by level, around centroids fitted on
   a bounded sample of each. A class goes to its nearest cell, and to the second where a link could cross over; so shards
   overlap. Cells whose vectors no centroid tells apart stay whole. Every class is dealt, in tasks of bounded size.
3. In a shard, each block of classes gets a graph: candidates are pruned robustly (a neighbour goes if a closer one
   leads to it), and the adjacency lists of both directions are united. Queries walk greedily from the block's medoid,
   then expand their range: every neighbour of a vector in range is looked at until none is new. Links are decided by
   the cosine in double precision. A pair that shares several shards is counted in the first of them only.

The candidates of a block come from one product of its vectors, so work grows with rows times LIMIT, whatever the table's
size. ``audit`` measures recall against all pairs of a stated query set.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, staged, unstaged
from .components import connected

#: Classes of a shard that are aimed at, and from which a cell is split; classes and queries of one task at most.
SHARD, LIMIT, BLOCK, QUERIES = 400, 1500, 1500, 1500
#: Centroids of a cell, and classes they are fitted on, at most; classes that one task deals; shares of a cell that a
#: part of it must stay under to be split again.
CENTROIDS, SAMPLE, DEALT, SHRINK = 256, 8192, 20_000, 0.8
#: Out-degree, width of the walk, and how much closer a neighbour must be to prune another.
DEGREE, BEAM, ALPHA = 24, 32, 1.2


def _units(batch, made) -> dict:
    """Vectors scaled to length one in double precision, and their digests; null where a vector cannot link."""
    column, n = batch.column("v"), batch.num_rows
    sizes = np.asarray(pc.fill_null(pc.list_value_length(column), 0), np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    begin = (np.cumsum(sizes) - sizes)[sizes > 0]
    fine = np.zeros(n, bool)
    if len(begin):
        with np.errstate(all="ignore"):
            top = np.maximum.reduceat(np.abs(flat), begin)
            scaled = flat / np.repeat(top, sizes[sizes > 0])  # so that squares neither vanish nor overflow
            norm = np.sqrt(np.add.reduceat(scaled * scaled, begin))
            flat = scaled / np.repeat(norm, sizes[sizes > 0])
        fine[sizes > 0] = np.logical_and.reduceat(np.isfinite(flat), begin) & (top > 0) & np.isfinite(top)
    fine &= np.asarray(pc.and_(pc.is_valid(batch.column("vec_id")), pc.is_valid(batch.column("label"))))
    ends = np.cumsum(sizes)
    rows = [flat[e - k : e] if ok else None for e, k, ok in zip(ends, sizes, fine)]
    return {"vec_id": batch.column("vec_id"), "label": batch.column("label"), "v": pa.array(rows, pa.list_(pa.float64())), "key": [None if r is None else xxhash.xxh3_128_digest(r.tobytes()) for r in rows]}


def unit_rows(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, v, key) of all rows; v and key are null in rows that cannot link."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    return map_texts(rows, _units, "vec_id long, label string, v array<double>, key binary")


def fitted(data: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """``k`` centroids of unit rows by a few rounds of k-means on the sphere, from rows spread over the sample."""
    mid = data[np.linspace(0, len(data) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = (data @ mid.T).argmax(1)
        sums = np.zeros_like(mid)
        np.add.at(sums, near, data)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        mid = np.where(length > 1e-12, sums / np.maximum(length, 1e-12), mid)
    return mid


def _fit_cell(pdf: pd.DataFrame) -> pd.DataFrame:
    some = pdf.sort_values(["code", "cls"]).head(SAMPLE)
    data = np.stack(some["v"].to_numpy())
    k = min(CENTROIDS, -(-int(pdf["n"].iloc[0]) // SHARD), len(data))
    return pd.DataFrame({"cell": [pdf["cell"].iloc[0]], "n": [pdf["n"].iloc[0]], "k": [k], "mids": [fitted(data, k).tobytes()]})


_CELLS = "cls long, weight long, v array<double>, cell string, whole long"


def _deal(least: float):
    """Each class to the nearest centroid's cell, and to the second's if a partner's nearest could be that."""
    reach = 2 * np.arccos(min(1.0, least))

    def deal(pdf: pd.DataFrame, mids: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame({c: [] for c in ("cls", "weight", "v", "cell", "whole")})
        row = mids.iloc[0]
        data = np.stack(pdf["v"].to_numpy())
        angle = np.arccos(np.clip(data @ np.frombuffer(row["mids"]).reshape(int(row["k"]), -1).T, -1.0, 1.0))
        order = np.argsort(angle, axis=1, kind="stable")[:, :2]
        near = np.take_along_axis(angle, order, 1)
        out = []
        for rank in range(order.shape[1]):
            here = np.flatnonzero(near[:, rank] - near[:, 0] <= reach)
            part = pdf.iloc[here][["cls", "weight", "v"]].copy()
            part["cell"] = [f"{c}/{row['cell']}" for c in order[here, rank]]
            out.append(part)
        found = pd.concat(out, ignore_index=True)
        found["whole"] = int(row["n"])
        return found

    return deal


def shards(classes: DataFrame, least: float) -> DataFrame:
    """(cls, weight, v, cell) of ``classes`` (cls, label, weight, v): each in one cell or several. A cell's name is the path
    of centroids, then the dimension and the label."""
    first = F.concat(F.lit(":"), F.size("v").cast("string"), F.lit(":"), "label")
    cells = classes.select("cls", "weight", "v", first.alias("cell"), F.lit((1 << 62)).alias("whole"))
    level = 0
    while True:
        sizes = staged(cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("whole").alias("of")), "cells")
        big = sizes.where((F.col("n") > LIMIT) & (F.col("n") <= SHRINK * F.col("of"))).select("cell", "n")
        if big.isEmpty():
            return cells.select("cls", "weight", "v", "cell")
        code = F.shiftright(F.xxhash64("cls", F.lit(level)), 4)
        inside = cells.join(big, "cell").withColumn("code", F.pmod(code, F.lit(1 << 40)))
        some = inside.where(F.col("code") * F.col("n") < F.lit(float(SAMPLE) * (1 << 40)))  # SAMPLE of each cell, in expectation
        mids = staged(some.select("cell", "n", "cls", "v", "code").groupBy("cell").applyInPandas(_fit_cell, "cell string, n long, k int, mids binary"), "mids")
        salts = F.ceil(F.col("n") / DEALT).cast("int")
        left = inside.withColumn("salt", F.pmod("code", salts).cast("int")).groupBy("cell", "salt")
        right = mids.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).groupBy("cell", "salt")
        dealt = left.cogroup(right).applyInPandas(_deal(least), _CELLS)
        cells = staged(cells.join(big, "cell", "left_anti").select("cls", "weight", "v", "cell", "whole").unionByName(dealt), "dealt")
        unstaged(mids)
        level += 1


def robust_prune(data: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA, pool: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Adjacency (rows x degree, padded by the row itself) of robustly pruned nearest candidates, for all rows at once;
    and the candidates, nearest first."""
    n = len(data)
    if n == 1:
        return np.zeros((1, 1), np.int64), np.zeros((1, 1), np.int64)
    pool = min(pool, n - 1)
    like = data @ data.T
    np.fill_diagonal(like, -2.0)
    near = np.argpartition(-like, pool - 1, axis=1)[:, :pool]
    # every row also has candidates far away, so that the graph is navigable
    far = (np.arange(n)[:, None] + np.array([1 + (n - 1) * k // 8 for k in range(8)])[None, :]) % n
    far[far == np.arange(n)[:, None]] = (far[far == np.arange(n)[:, None]] + 1) % n
    near = np.concatenate([near, far], axis=1)
    own = np.take_along_axis(like, near, 1)
    order = np.argsort(-own, axis=1, kind="stable")
    near, own = np.take_along_axis(near, order, 1), np.take_along_axis(own, order, 1)
    reach = np.sqrt(np.maximum(0.0, 2 - 2 * own))
    out = np.repeat(np.arange(n)[:, None], degree, axis=1)
    alive, filled = own > -2.0, np.zeros(n, np.int64)
    rows = np.arange(n)
    for _ in range(min(degree, near.shape[1])):
        first = alive.argmax(1)
        has = alive[rows, first]
        if not has.any():
            break
        chosen = near[rows, first]
        out[rows[has], filled[has]] = chosen[has]
        filled += has
        between = np.sqrt(np.maximum(0.0, 2 - 2 * like[chosen[:, None], near]))
        alive &= ~((alpha * between <= reach) | (near == chosen[:, None])) | ~has[:, None]
        alive[rows[has], first[has]] = False
    return out, near


def united(lists: np.ndarray, degree: int) -> np.ndarray:
    """Both directions of the lists: up to ``degree`` of those that point at a row join its own."""
    n = len(lists)
    source, target = np.repeat(np.arange(n), lists.shape[1]), lists.ravel()
    keep = source != target
    order = np.argsort(target[keep], kind="stable")
    target, source = target[keep][order], source[keep][order]
    rank = np.arange(len(target)) - np.searchsorted(target, target)
    fits = rank < degree
    back = np.repeat(np.arange(n)[:, None], degree, axis=1)
    back[target[fits], rank[fits]] = source[fits]
    return np.concatenate([lists, back], axis=1)


def reinforced(graph: np.ndarray, near: np.ndarray, least: int = 6, slots: int = 16) -> np.ndarray:
    """Rows that fewer than ``least`` others point at get more: their nearest candidates with free slots point at them.
    In a dense cluster some rows would else be nobody's neighbour."""
    n = len(graph)
    own = np.arange(n)[:, None]
    pointed = np.bincount(graph[graph != own], minlength=n)
    extra, used = np.repeat(own, slots, axis=1), np.zeros(n, np.int64)
    low = np.flatnonzero(pointed < least)
    for k in range(near.shape[1]):
        if not len(low):
            break
        order = np.argsort(near[low, k], kind="stable")
        source, target = near[low, k][order], low[order]
        place = used[source] + np.arange(len(source)) - np.searchsorted(source, source)
        fits = (place < slots) & (source != target)
        extra[source[fits], place[fits]] = target[fits]
        np.maximum.at(used, source[fits], place[fits] + 1)
        pointed[target[fits]] += 1
        low = low[pointed[low] < least]
    return np.concatenate([graph, extra], axis=1)


def range_search(data: np.ndarray, graph: np.ndarray, queries: np.ndarray, least: float, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) pairs of cosine >= least: greedy walks from the medoid, then expansion within the range."""
    n, m = len(data), len(queries)
    beam = min(beam, n)
    medoid = int((data @ data.mean(0)).argmax())
    seen = np.zeros((m, n), bool)
    like = np.full((m, n), -2.0)
    every = np.arange(m)
    seen[:, medoid] = True
    like[:, medoid] = queries @ data[medoid]
    best, done = np.full((m, beam), medoid), np.zeros((m, n), bool)
    walking = every
    for _ in range(4 * beam):
        score = np.where(done[walking[:, None], best[walking]], -3.0, like[walking[:, None], best[walking]])
        step = best[walking, score.argmax(1)]
        open_ = score.max(1) > -3.0
        walking, step = walking[open_], step[open_]
        if not len(walking):
            break
        done[walking, step] = True
        near = graph[step]
        new = ~seen[walking[:, None], near]
        q, r = walking[np.nonzero(new)[0]], near[new]
        seen[q, r] = True
        like[q, r] = np.einsum("ij,ij->i", queries[q], data[r])
        pool = np.concatenate([best[walking], near], axis=1)
        score = like[walking[:, None], pool]
        score[:, beam:][~new] = -4.0
        top = np.argpartition(-score, beam - 1, axis=1)[:, :beam]
        best[walking] = np.take_along_axis(pool, top, 1)
    q, r = np.nonzero(like >= least - 1e-3)
    while len(q):  # neighbours of what is in range, until none is new
        near = graph[r]
        q = np.repeat(q, near.shape[1])
        code = np.unique(q * n + near.ravel())
        q, r = code // n, code % n
        new = ~seen[q, r]
        q, r = q[new], r[new]
        seen[q, r] = True
        own = np.concatenate([np.einsum("ij,ij->i", queries[q[a : a + 50_000]], data[r[a : a + 50_000]]) for a in range(0, len(q), 50_000)]) if len(q) else np.empty(0)
        like[q, r] = own
        inside = own >= least - 1e-3
        q, r = q[inside], r[inside]
    return np.nonzero(like >= least)


def _search(least: float):
    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        index, ask = pdf[pdf["role"] == 0], pdf[pdf["role"] == 1]
        if not len(index) or not len(ask):
            return pd.DataFrame({"cls": [], "links": [], "other": []}).astype("int64")
        data = np.stack(index["v"].to_numpy())
        lists, near = robust_prune(data)
        graph = reinforced(united(lists, DEGREE), near)
        q, r = range_search(data, graph, np.stack(ask["v"].to_numpy()), least)
        ids, asked, weight = index["cls"].to_numpy(), ask["cls"].to_numpy(), index["weight"].to_numpy()
        # a pair that shares several shards counts in the first of them
        names = {x: i for i, x in enumerate(sorted({x for s in pdf["cells"] for x in s}))}
        width = max(map(len, pdf["cells"]))
        pad = lambda s, fill: np.array([[names[c] for c in x] + [fill] * (width - len(x)) for x in s], np.int64)
        si, sq, own = pad(index["cells"], -1), pad(ask["cells"], -2), names[pdf["cell"].iloc[0]]
        keep = np.zeros(len(q), bool)
        for at in range(0, len(q), 200_000):
            a, b = sq[q[at : at + 200_000]], si[r[at : at + 200_000]]
            shared = np.where((a[:, :, None] == b[:, None, :]).any(2), a, np.iinfo(np.int64).max).min(1)
            keep[at : at + 200_000] = shared == own
        keep &= asked[q] != ids[r]
        q, r = q[keep], r[keep]
        links = np.bincount(q, weight[r], minlength=len(asked)).astype(np.int64)
        # of the links a forest is enough
        forest = _forest(q, r, asked, ids)
        out = pd.DataFrame({"cls": asked, "links": links, "other": asked})
        more = pd.DataFrame({"cls": [a for a, _ in forest], "links": 0, "other": [b for _, b in forest]})
        return pd.concat([out, more], ignore_index=True).astype("int64")

    return search


def _forest(q: np.ndarray, r: np.ndarray, asked: np.ndarray, ids: np.ndarray) -> list[tuple[int, int]]:
    """(id, smallest id) of the components of the links of one task."""
    nodes, back = np.unique(np.concatenate([asked[q], ids[r]]), return_inverse=True)
    if not len(nodes):
        return []
    a, b = back[: len(q)], back[len(q) :]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            break
        label = new
    return [(int(nodes[i]), int(nodes[x])) for i, x in enumerate(label) if x != i]


def near_duplicate_vectors(vectors: DataFrame, least: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links (other rows linked directly), component_id (smallest id reachable), kept (vec_id = component_id).

    Only rows of equal, not null labels and equal dimension are compared. Vectors that are null, zero, or hold null or
    non-finite components, and rows without an id, link with nothing; a row without an id has a null component and
    is kept. Rows that repeat an id are rows of their own: they link with each other, and each has its own vector's links.
    """
    rows = staged(unit_rows(vectors, id_col, vector_col, label_col), "unit")
    classes = rows.where("key IS NOT NULL").groupBy("label", "key").agg(F.count("*").alias("weight"), F.min("vec_id").alias("rep"), F.first("v").alias("v"))
    classes = staged(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    flat = shards(classes.select("cls", "label", "weight", "v"), least)
    flat = staged(flat.groupBy("cls").agg(F.first("weight").alias("weight"), F.first("v").alias("v"), F.array_sort(F.collect_set("cell")).alias("cells")), "shards").withColumn("cell", F.explode("cells"))
    flat = flat.join(flat.groupBy("cell").agg(F.count("*").alias("n")), "cell")
    nb, nq = F.ceil(F.col("n") / BLOCK).cast("int"), F.ceil(F.col("n") / QUERIES).cast("int")
    part = lambda n, seed: F.pmod(F.xxhash64("cls", F.lit(seed)), n).cast("int")
    index = flat.withColumn("block", part(nb, 1)).withColumn("ask", F.explode(F.sequence(F.lit(0), nq - 1))).withColumn("role", F.lit(0))
    asks = flat.withColumn("ask", part(nq, 2)).withColumn("block", F.explode(F.sequence(F.lit(0), nb - 1))).withColumn("role", F.lit(1))
    columns = ["cell", "block", "ask", "role", "cls", "weight", "v", "cells"]
    found = index.select(columns).unionByName(asks.select(columns)).groupBy("cell", "block", "ask").applyInPandas(_search(least), "cls long, links long, other long")
    found = staged(found, "vector-links")
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    comps = connected(found.where("cls != other").select(F.col("cls").alias("a"), F.col("other").alias("b")), "vectors")
    known = classes.select("label", "key", "cls", "weight", "rep").join(links, "cls", "left").join(comps.withColumnRenamed("id", "cls"), "cls", "left")
    known = staged(known.withColumn("component", F.coalesce("component", "cls")), "known")
    least_of = known.groupBy("component").agg(F.min("rep").alias("component_id"))
    n_links = F.coalesce("links", F.lit(0)) + F.col("weight") - 1
    known = known.join(least_of, "component").select("label", "key", n_links.alias("n_links"), "component_id")
    out = rows.select("vec_id", "label", "key").join(known, ["label", "key"], "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def audit(vectors: DataFrame, result: DataFrame, least: float = 0.98, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[int, int]:
    """(links found, links there are) of the vectors whose id is divisible by ``every``, by all their pairs, in blocks."""
    rows = unit_rows(vectors, id_col, vector_col, label_col).where("key IS NOT NULL").select("vec_id", "label", "v")
    n = max(1, -(-rows.count() // 5000))
    ask = rows.where(F.col("vec_id") % every == 0).withColumn("role", F.lit(1)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    there = rows.withColumn("role", F.lit(0)).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int"))

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        q, t = pdf[pdf["role"] == 1], pdf[pdf["role"] == 0]
        total = 0
        if len(q) and len(t) and len(set(map(len, pdf["v"]))) == 1:
            like = np.stack(q["v"].to_numpy()) @ np.stack(t["v"].to_numpy()).T
            total = int(((like >= least) & (q["vec_id"].to_numpy()[:, None] != t["vec_id"].to_numpy()[None, :])).sum())
        return pd.DataFrame({"n": [total]})

    want = ask.unionByName(there).groupBy("label", "block", F.size("v")).applyInPandas(count, "n long").agg(F.sum("n")).first()[0] or 0
    got = result.where(F.col("vec_id") % every == 0).agg(F.sum("n_links")).first()[0] or 0
    return int(got), int(want)


def op5_vector_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
