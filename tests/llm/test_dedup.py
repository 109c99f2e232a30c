"""MinHash, suffix and vector deduplication against brute force, and their edge cases."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracegrain.llm import components, graph_dedup, minhash_dedup, suffix_dedup


class Union:
    def __init__(self, ids):
        self.up = {i: i for i in ids}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


def near_texts(seed=4, groups=6, size=30):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(groups):
        base = [rng.choice(words) for _ in range(rng.randrange(5, 120))]
        for _ in range(size):
            t = list(base)
            for _ in range(rng.randrange(0, max(1, len(t) // 12))):
                t[rng.randrange(len(t))] = rng.choice(words)
            out.append(" ".join(t))
    return out


EDGES = [None, "", "   ", "one", "ONE", "one", "two words", "Two\x0bWORDS", "É é", "x " * 5000]


def word_set(text, width):
    found = (text or "").encode().lower().split()
    if len(found) < width:
        return {tuple(found)} if found else set()
    return {tuple(found[i : i + width]) for i in range(len(found) - width + 1)}


@pytest.mark.parametrize("width", [2, 5])
def test_minhash_equals_all_pairs(spark, width):
    rows = list(enumerate(near_texts() + EDGES))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"sig": F.lit(1), "n": F.lit("clash"), "rep": F.lit(0)}).repartition(4)
    sets = {i: word_set(t, width) for i, t in rows}
    union = Union(sets)
    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and a and b and 100 * len(a & b) >= 80 * len(a | b):
                union.join(i, j)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(df, width).collect()}
    assert got == {i: (len(s), union.find(i), union.find(i) == i) for i, s in sets.items()}


def test_minhash_in_blocks_loses_no_link(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "SMALL", 3)
    monkeypatch.setattr(minhash_dedup, "BLOCK", 8)
    rows = list(enumerate(near_texts(9, 2, 80)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: word_set(t, 2) for i, t in rows}
    union = Union(sets)
    for i in sets:
        for j in sets:
            if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                union.join(i, j)
    assert {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(df, 2).collect()} == {i: union.find(i) for i in sets}


def test_minhash_nulls_repeats_and_nothing(spark):
    df = spark.createDataFrame([(None, "a b c"), (7, "a b c"), (7, "a b c"), (3, "a b c"), (None, None)], "doc_id long, text string")
    got = sorted(minhash_dedup.near_duplicates(df, 2).collect(), key=str)
    assert [(r.doc_id, r.component_id, r.kept) for r in got if r.doc_id] == [(3, 3, True), (7, 3, False), (7, 3, False)]
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)] * 2
    assert minhash_dedup.near_duplicates(df.limit(0), 2).count() == 0


def test_odd_sketches_estimate_similarity():
    rng = np.random.RandomState(1)
    for share in (0.95, 0.8, 0.3):
        both = rng.randint(0, 1 << 62, 2000).astype(np.uint64)
        n = int(2000 * (1 - share) / (1 + share)) if share < 1 else 0
        own = [np.unique(np.concatenate([both[n:], rng.randint(0, 1 << 62, n).astype(np.uint64)])) for _ in range(2)]
        a, b = (np.array(minhash_dedup.signature(x)[1], np.int64).view(np.uint64) for x in own)
        assert (np.bitwise_count(a ^ b).sum() <= minhash_dedup.most_bits()) == (share >= 0.8)
        maps = [np.frombuffer(minhash_dedup.parity_bitmap(x), np.uint64) for x in own]
        assert np.bitwise_count(maps[0] ^ maps[1]).sum() <= len(np.setxor1d(*own))


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (5, 5)], "a long, b long")
    assert {r.id: r.component for r in components.connected(links).collect()} == {i: 0 for i in range(51)} | {100: 100, 101: 100}


def covered(texts, length):
    """For each text whether each byte is in a string of ``length`` that also starts anywhere else."""
    counts, hashes = Counter(), []
    for t in texts:
        h = [t[i : i + length] for i in range(len(t) - length + 1)]
        hashes.append(h)
        counts.update(h)
    out = []
    for t, h in zip(texts, hashes):
        cover = [False] * len(t)
        for k, x in enumerate(h):
            if counts[x] > 1:
                cover[k : k + length] = [True] * length
        out.append(cover)
    return out


def runs_of(cover):
    edges = [0, *(k for k in range(1, len(cover)) if cover[k] != cover[k - 1]), len(cover)]
    return [(lo, hi) for lo, hi in zip(edges, edges[1:]) if hi > lo and cover[lo]]


def removed_by_brute_force(rows, length, passage=suffix_dedup.PASSAGE, words=suffix_dedup.WORDS):
    out = []
    for (i, t), cover, short in zip(rows, covered([t for _, t in rows], length), covered([t for _, t in rows], passage)):
        rest = bytes(b for b, c in zip(t, cover) if not c)
        shared = sum(hi - lo for lo, hi in runs_of(short) if hi - lo >= 400 or len(t[lo:hi].split()) >= words)
        out.append((i, len(t), len(t) - len(rest), len(runs_of(cover)), hashlib.sha256(rest).hexdigest(), shared))
    return sorted(out, key=str)


def passage_rows(seed=5):
    rng = random.Random(seed)
    base = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    rows = []
    for i in range(60):
        t = list(base)
        for _ in range(rng.randrange(7)):
            t[rng.randrange(3000)] = "Z"
        a = rng.randrange(1500)
        rows.append((i, "".join(t[a : a + rng.randrange(300, 1400)])))
    extra = [(1000, "ab" * 600), (1001, "a" * 900), (1002, None), (1003, ""), (None, "x" * 401), (1004, "é" * 300), (1004, "é" * 300), (1005, base[:399]), (1006, base[:400]), (1007, base[:400] + "q")]
    return rows + extra


@pytest.mark.parametrize("hot,hotter", [(10_000, 1_000_000), (5, 1_000_000), (2, 5)])
def test_suffixes_equal_brute_force(spark, monkeypatch, hot, hotter):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "HOTTER", hotter)
    rows = passage_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"uid": F.lit(3), "spans": F.lit("x")}).repartition(5)
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.n_passage) for r in suffix_dedup.removed(df).collect()), key=str)
    assert got == removed_by_brute_force([(i, (t or "").encode()) for i, t in rows], 400)


def test_suffixes_of_the_test_tables(spark):
    """All texts of the smallest table, among them the passages that its documents share."""
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in suffix_dedup.op10_suffix_dedup(spark, "/root/testdata/sf0.001").collect()), key=str)
    assert got == removed_by_brute_force([(i, (t or "").encode()) for i, t in rows], 400)
    assert any(r[2] for r in got) and any(r[5] for r in got)


def test_passages_of_over_fifty_words_go_although_shorter_than_400_bytes(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8)))
    passage = " ".join(word() for _ in range(55))
    line = " ".join(word() for _ in range(42)) + " " + "x" * 60
    assert suffix_dedup.PASSAGE < len(passage) < 400 and suffix_dedup.PASSAGE < len(line) < 400
    rows = [(i, " ".join(word() for _ in range(40)) + f" {passage if i < 20 else line} " + " ".join(word() for _ in range(40))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"__id": F.lit(7), "__uid": F.lit("u"), "__rest": F.lit("r"), "row": F.lit("w"), "rest": F.lit("s")})
    out = {r.doc_id: r for r in suffix_dedup.without_repeats(df, suffix_dedup.PASSAGE, suffix_dedup.WORDS).collect()}
    assert all(passage not in out[i].text and len(out[i].text) >= len(rows[i][1]) - len(passage) - 40 for i in range(20))
    assert all(out[i].text == rows[i][1] for i in range(20, 40))  # repeated, but no passage
    assert {(r["__id"], r["__uid"], r["__rest"], r["row"], r["rest"]) for r in out.values()} == {(7, "u", "r", "w", "s")}
    got = {r.doc_id: (r.n_removed, r.n_passage > 0) for r in suffix_dedup.removed(df).collect()}
    assert got == {i: (0, i < 20) for i in range(40)}


def test_suffix_texts_and_columns(spark):
    rows = [(i, (t or "") or None, "s") for i, t in passage_rows()]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = suffix_dedup.without_repeats(df)
    assert out.columns == df.columns and out.count() == df.count()
    sizes = {r.doc_id: r.n_bytes - r.n_removed for r in suffix_dedup.removed(df).collect() if r.doc_id is not None and r.doc_id < 1000}
    assert {r.doc_id: len(r.text.encode()) for r in out.collect() if r.doc_id is not None and r.doc_id < 1000} == sizes
    assert suffix_dedup.removed(df.limit(0)).count() == 0 and suffix_dedup.without_repeats(df.limit(0)).count() == 0


def test_loser_tree_merges_and_knows_common_prefixes():
    rng = random.Random(2)
    for n in (1, 2, 3, 7):
        runs = [sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(1, 9))).encode() for _ in range(30)}) for _ in range(n)]
        coded = [suffix_dedup.decode_run(*suffix_dedup.encode_run(r)) for r in runs]
        merged = list(suffix_dedup.merge_runs(coded))
        assert [k for _, k, _ in merged] == sorted(k for r in runs for k in r)
        assert [s for s, _, _ in merged] == [0, *(suffix_dedup.common(a[1], b[1], 0) for a, b in zip(merged, merged[1:]))]


def vectors(seed=1, n=300):
    rng = np.random.RandomState(seed)
    rows = []
    for c in range(10):
        base = rng.randn(16)
        rows += [(base + rng.randn(16) * rng.choice([0.02, 0.1, 0.5])).tolist() for _ in range(n // 10)]
    return [(i, [float(np.float32(x)) for x in v], i % 3 if i % 17 else None) for i, v in enumerate(rows)]


def test_vectors_equal_all_pairs(spark):
    bad = [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] + [1.0] * 15, 0), (903, [float("inf")] * 16, 0), (904, [None] + [1.0] * 15, 0), (905, [1e-30] * 16, 1), (906, [1e30] * 16, 1), (907, [1.0] * 4, 1)]
    rows = vectors() + bad
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"row": F.lit(1), "v": F.lit("clash"), "links": F.lit(0)})
    units = {i: np.array(v, float) / np.linalg.norm(v) for i, v, _ in vectors()}
    labels = {i: x for i, _, x in rows}
    union, count = Union(labels), Counter()
    for i in units:
        for j in units:
            if i < j and labels[i] is not None and labels[i] == labels[j] and units[i] @ units[j] >= 0.98:
                union.join(i, j)
                count.update((i, j))
    union.join(905, 906)
    count.update((905, 906))
    out = graph_dedup.near_duplicate_vectors(df)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in out.collect()}
    assert got == {i: (count[i], union.find(i), union.find(i) == i) for i in labels}
    found, there = graph_dedup.audit(df, out, every=3)
    assert there and found >= 0.9 * there
    assert graph_dedup.near_duplicate_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("sizes", [{"SHARD": 20, "LIMIT": 30, "BLOCK": 15, "QUERIES": 15}, {"SHARD": 10, "LIMIT": 15, "CENTROIDS": 3, "DEALT": 20, "SAMPLE": 40}])
def test_vectors_in_shards_and_blocks(spark, monkeypatch, sizes):
    """Cells split over one level or several, dealt in several tasks, searched in several blocks."""
    for name, value in sizes.items():
        monkeypatch.setattr(graph_dedup, name, value)
    df = spark.createDataFrame(vectors(2), "vec_id long, embedding array<float>, label int")
    found, there = graph_dedup.audit(df, graph_dedup.near_duplicate_vectors(df), every=1)
    assert found <= there and found >= 0.9 * there


def test_vectors_that_no_centroid_tells_apart(spark, monkeypatch):
    """A hot vector in many copies is one class; a dense group of different ones stays whole and is searched in blocks."""
    for name, value in {"SHARD": 20, "LIMIT": 30, "BLOCK": 25, "QUERIES": 25}.items():
        monkeypatch.setattr(graph_dedup, name, value)
    rng = np.random.RandomState(4)
    base = rng.randn(8)
    rows = [(i, base.tolist(), 1) for i in range(500)] + [(1000 + i, (base + 1e-3 * rng.randn(8)).tolist(), 1) for i in range(120)] + [(5000 + i, rng.randn(8).tolist(), 2) for i in range(5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in graph_dedup.near_duplicate_vectors(df).collect()}
    assert all(got[i][0] == 619 and got[i][1] == 0 for i in range(500))
    assert sum(got[1000 + i][0] for i in range(120)) >= 0.9 * 120 * 619 and all(got[1000 + i][1] == 0 for i in range(120))
    assert all(got[5000 + i][0] <= 4 for i in range(5))


def test_repeated_vector_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1), (None, [1.0, 0.0], 1)], "vec_id long, embedding array<float>, label int")
    got = sorted(((r.vec_id, r.component_id, r.kept) for r in graph_dedup.near_duplicate_vectors(df).collect()), key=str)
    assert got == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (None, None, True)], key=str)
