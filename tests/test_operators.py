"""Operators against small models of them."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tracegrain.operators import arrays as A
from tracegrain.operators import graphs as G
from tracegrain.operators import strings as S
from tracegrain.operators import switches as W
from tracegrain.operators import symbols as Y
from tracegrain.operators import verdicts as V
from tracegrain.staging import staged


def exports(spark, src, binary):
    s = spark.createDataFrame([("l", n) for n in src], "lib string, name string")
    b = spark.createDataFrame([("b", n) for n in binary], "bin_file string, name string")
    found = Y.match_exports(s, b).collect()
    return found[0].matched if found else None


def names(n, start=0):
    return [f"n{i}" for i in range(start, start + n)]


@pytest.mark.parametrize(
    ("src", "binary", "want"),
    [
        (names(6), names(5) + names(40, 100), True),  # more than five, 5/6 shared
        (names(5), names(4) + names(40, 100), False),  # five only
        (names(100), names(21) + names(80, 500), True),  # over twenty shared
        (names(11), names(8), True),  # 8/8 + 8/11
        (names(10), names(5) + names(3, 50), False),  # 5/8 + 5/10
        (names(2), names(1), True),  # 1 + 1/2
        (names(3), names(3, 9), None),  # nothing shared, no row
    ],
)
def test_export_rule(spark, src, binary, want):
    assert exports(spark, src, binary) is want


def test_pairwise_counts_binary_occurrences(spark):
    s = spark.createDataFrame([("p", "d", '"two words"'), ("p", "d", "x_1"), ("p", "d", "word")], "pj string, dyn string, value string")
    b = spark.createDataFrame([("b", "two words"), ("b", "two words"), ("b", "?x_1"), ("b", "word")], "bin_file string, value string")
    (row,) = S.match_pairwise(s, b).collect()
    assert row.percent == pytest.approx(2 / 2)  # twice one of two strings
    assert row.matched


@pytest.mark.parametrize("block,sent", [(1 << 15, 1_000_000), (7, 1)])
def test_contained_equals_brute_force(spark, monkeypatch, block, sent):
    monkeypatch.setattr(A, "BLOCK", block)
    monkeypatch.setattr(A, "SENT", sent)
    rng = random.Random(3)
    hay = [("".join(rng.choice("01ab") for _ in range(rng.randrange(0, 200))),) for _ in range(20)]
    needles = list({h[0][i : i + rng.randrange(6, 40)] for h in hay for i in rng.sample(range(180), 6)} | {"0" * 9, "abab01", "1111110"})
    needles = [n for n in needles if len(n) >= 6]
    h = spark.createDataFrame([(i, x[0]) for i, x in enumerate(hay)], "id int, hex string")
    n = spark.createDataFrame([(x,) for x in needles], "needle string")
    got = {(r.id, r.needle) for r in A.contained(n, h, ["id"], False).collect()}
    assert got == {(i, x) for i, (t,) in enumerate(hay) for x in needles if x in t}
    even = [x for x in needles if len(x) % 2 == 0]
    h2 = h.where(F.length("hex") % 2 == 0)
    got = {(r.id, r.needle) for r in A.contained(n.where(F.length("needle") % 2 == 0), h2, ["id"], True).collect()}
    want = {(i, x) for i, (t,) in enumerate(hay) if len(t) % 2 == 0 for x in even if any(t[k : k + len(x)] == x for k in range(0, len(t), 2))}
    assert got == want


def test_needles_of_any_length_and_many_lengths(spark, monkeypatch):
    """Two digits and more, by two levels for eleven lengths; copies of a haystack keep their keys."""
    monkeypatch.setattr(A, "LEVELS", 2)
    rng = random.Random(5)
    hay = ["".join(rng.choice("01f") for _ in range(150)) for _ in range(6)]
    needles = sorted({h[i : i + k] for h in hay[:3] for i in (0, 40, 150 - 22) for k in range(2, 24, 2)} | {"ff0011ffee"})
    h = spark.createDataFrame([(i, x) for i, x in enumerate(hay + hay[:2])], "id int, hex string")
    got = [(r.id, r.needle, r.tag) for r in A.contained(spark.createDataFrame([(n, "t" + n) for n in needles], "needle string, tag string"), h, ["id"], False, carry=("tag",)).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(i, n, "t" + n) for i, t in enumerate(hay + hay[:2]) for n in needles if n in t}


def test_needles_are_never_sent_whole(spark):
    """The driver holds the sieve alone, however many needles there are (array_candidates)."""
    index = spark.createDataFrame([([1, 2, 3, i], "p", "d", "1") for i in range(50)], "arr array<bigint>, pj string, dyn string, ver string")
    segments = spark.createDataFrame([("f", ".data", "01020307")], "bin_file string, seg string, hex string")
    found = A.search_index(index, segments)
    assert "strategy=broadcast" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.bin_file, r.seg, r.arr) for r in found.collect()] == [("f", ".data", [1, 2, 3, 7])]


def test_long_haystacks_are_read_in_blocks(spark):
    """Half a megabyte in one file: needles across the edges of blocks, of all seed lengths, are found, and others are not."""
    rng = random.Random(6)
    hay = "".join(rng.choices("0123456789abcdef", k=1_000_000))
    needles = [hay[k * A.BLOCK - n // 2 : k * A.BLOCK + n // 2] for k, n in enumerate((8, 12, 20, 40, 100, 5000), 1)]
    needles += [n[:-1] + ("0" if n[-1] != "0" else "1") for n in needles[2:]]
    rows = spark.createDataFrame([("f", hay)], "id string, hex string")
    got = {r.needle for r in A.contained(spark.createDataFrame([(n,) for n in needles], "needle string"), rows, ["id"], False).collect()}
    assert got == {n for n in needles if n in hay} and len(got) >= 6
    assert A.blocks(rows, ["id"], F.encode("hex", "US-ASCII"), 5000).agg(F.max(F.length("_part"))).first()[0] == A.BLOCK + 4999


def test_subsumed_needles_go(spark):
    rows = spark.createDataFrame([("l", "aabbccdd"), ("l", "bbccdd"), ("l", "ddccbb"), ("m", "bbccdd")], "lib string, needle string")
    assert {(r.lib, r.needle) for r in A.without_subsumed(rows, "lib").collect()} == {("l", "aabbccdd"), ("l", "ddccbb"), ("m", "bbccdd")}


def test_delete_one(spark):
    s = spark.createDataFrame([("s1", [[1], [5, 6]]), ("s2", [[3], [7]])], "id string, case_value array<array<bigint>>")
    b = spark.createDataFrame([("b1", [[0], [1], [5, 6]]), ("b2", [[0], [4], [9]]), ("b3", [[1], [5, 6]])], "id string, case_value array<array<bigint>>")
    got = {(r.id, r.b_id, r.rebased) for r in W.delete_one_pairs(s, b).collect()}
    assert got == {("s1", "b1", False), ("s2", "b2", True)}


@pytest.mark.parametrize(("targets", "ncases", "last", "want"), [(4, 5, 20, True), (3, 9, 90, False), (4, 6, 4, True), (4, 5, 8, False), (4, 5, 9, True)])
def test_special_switch_boundaries(spark, targets, ncases, last, want):
    df = spark.createDataFrame([(targets, ncases, [[1], [2], [3], [last]])], "t int, n int, c array<array<bigint>>")
    assert df.select(W.is_special(F.col("t"), F.col("n"), F.col("c"), True)).first()[0] is want


def test_greedy_assignment_uses_binaries_up():
    a, b = ("1", "2", "3"), ("4", "5", "6")
    assert W.greedy_assignment([a, a, b], [a, b]) == (2, 2)
    assert W.greedy_assignment([("1", "2", "3", "9")], [("1", "2", "3", "4")]) == (1, 0)
    assert W.greedy_assignment([("1", "2", "8", "9", "7")], [("1", "2", "3", "4", "5")]) == (0, 0)


def one_by_one(sources, binaries):
    left, matches, full = list(binaries), 0, 0
    for s in sources:
        best, most = None, 0
        for i, b in enumerate(left):
            if s == b:
                best, most = i, len(s)
                full += 1
                break
            n = len(set(s) & set(b))
            if n > most and n / max(len(s), len(b)) * 100 > 40:
                best, most = i, n
        if most >= 3:
            matches += 1
            del left[best]
    return matches, full


@pytest.mark.parametrize(("steps", "longest"), [(4, 5), (9, 8), (30, 14), (12, 25)])
def test_greedy_assignment_equals_one_by_one(steps, longest):
    rng = random.Random(steps)
    some = lambda n: [tuple(str(rng.randrange(steps)) for _ in range(rng.randrange(1, longest))) for _ in range(n)]
    for _ in range(40):
        s, b = some(60), some(50)
        s, b = s + rng.choices(b, k=10) + s[:20], b + b[:10]
        rng.shuffle(s)
        assert W.greedy_assignment(s, b) == one_by_one(s, b)


def test_many_copies_of_chains_are_assigned_quickly():
    """What no binary chain is left for is not looked for again: 40,000 against 20,000 were 800 million comparisons (nested_if_match)."""
    rng = random.Random(8)
    kinds = [tuple(str(rng.randrange(30)) for _ in range(rng.randrange(3, 7))) for _ in range(800)]
    s, b = rng.choices(kinds, k=40_000), rng.choices(kinds[:400], k=20_000)
    began = time.process_time()
    matches, full = W.greedy_assignment(s, b)
    assert time.process_time() - began < 20 and full <= matches <= 20_000


def test_greedy_passes_differ_in_direction():
    one, two = (("a", "d", "1"), 100, 100), (("b", "d", "1"), 60, 60)
    assert V.greedy_kept([one, two], {(one[0], two[0]): 60}, True) == [one[0]]
    assert V.greedy_kept([one, two], {(one[0], two[0]): 30}, True) == [two[0], one[0]]
    near, big = (("a", "d", "1"), 100, 100), (("b", "d", "1"), 99, 200)
    assert V.greedy_kept([near, big], {(near[0], big[0]): 99}, True) == [big[0], near[0]]
    assert V.greedy_kept([near, big], {(near[0], big[0]): 99}, False) == [big[0]]


def test_greedy_ties_go_by_key():
    c = [((k, "d", "1"), 10, 10) for k in "cab"]
    assert V.greedy_kept(c, {}, True) == [("a", "d", "1"), ("b", "d", "1"), ("c", "d", "1")]


def test_merge_is_the_same_in_any_order(spark):
    rows = [[("a", 1.0, [1, 2])], [("a", 2.0, [3]), ("b", 5.0, [4])], []]
    tables = [spark.createDataFrame(r, "k string, s double, l array<int>") for r in rows]
    got = {(r.k, r.s, tuple(r.l)) for r in V.merged_tables(tables, ["k"], ["s"], ["l"]).collect()}
    assert got == {("a", 3.0, ("1:1", "1:2", "2:3")), ("b", 5.0, ("2:4",))}


def test_aliases(spark):
    found = spark.createDataFrame([("b", p, d) for p, d in [("p", "x"), ("p", "y"), ("q", "x"), ("r", "x"), ("s", "x")]], "bin_file string, pj string, dyn string")
    alias = spark.createDataFrame([("p", "x", "P"), ("q", "", ""), ("r", "", "R"), ("s", "x", None)], "pj string, dyn string, alias_pj string")
    assert {r.name for r in V.verdict(found, alias).collect()} == {"P", "p", "R", "s"}


def test_missing_totals_give_no_candidate(spark):
    scores = spark.createDataFrame([("b", "p", "d", "1", 30.0, 0.0, 30)], "bin_file string, pj string, dyn string, ver string, pj_score double, ver_score double, matched_count long")
    totals = spark.createDataFrame([("q", "d", "1", 30.0, 0.0, 30)], "pj string, dyn string, ver string, total_pj_score double, total_ver_score double, total_count long")
    assert S.string_candidates(scores, totals).count() == 0


def test_passby_names_the_contained_array(spark):
    rows = spark.createDataFrame([([1, 2, 3, 4, 9], "p", "d", "1"), ([2, 3, 4, 9], "q", "d", "1"), ([5, 6, 7], "r", "d", "1"), (list(range(60)), "s", "d", "1")], "arr array<bigint>, pj string, dyn string, ver string")
    assert {r.pj for r in A.passed_by(rows).collect()} == {"p", "q", "s"}


def test_closure_with_a_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "x")], "output string, dependency string")
    assert {(r.output, r.dependency) for r in G.closure(edges).collect()} == {(i, j) for i in "abc" for j in "abc" if i != j}


def test_chains_of_a_graph():
    found = W.chains_of_function([(1, 2), (2, 3), (1, 3), (3, 4)], {1: (5, 0), 2: (6, 1), 3: (7, 2), 4: (0, 0)})
    assert found == [((5, 0), (6, 1), (7, 2))]


def test_chains_of_deep_and_branching_graphs():
    deep = W.chains_of_function([(i, i + 1) for i in range(1500)], {i: (i, 1) for i in range(1500)})
    assert deep == [tuple((i, 1) for i in range(1500))]
    edges, conditions = [], {}
    for i in range(0, 33, 3):
        edges += [(i, i + 1), (i, i + 2), (i + 1, i + 3), (i + 2, i + 3)]
        conditions |= {i + 1: (i, 1), i + 2: (i, 2)}
    assert len(set(W.chains_of_function(edges, conditions))) == 2**11
    assert W.chains_of_function([(1, 2), (2, 3), (3, 1), (3, 4)], {1: (1, 1), 2: (2, 1), 3: (3, 1)}) == [((1, 1), (2, 1), (3, 1))]


def test_random_chains_are_maximal():
    rng = random.Random(1)
    for _ in range(30):
        chains = [tuple(rng.sample(range(8), rng.randrange(1, 5))) for _ in range(10)]
        kept = W.maximal_chains(chains)
        assert all(any(set(c) <= set(k) for k in kept) for c in chains)
        assert not any(a != b and set(a) <= set(b) for a in kept for b in kept)


def test_overlaps_of_short_and_long_chains(spark):
    rng = random.Random(6)
    chains = [[str(rng.randrange(25)) for _ in range(rng.choice([3, 5, 9, 14, 20]))] for _ in range(40)]
    df = spark.createDataFrame([(str(i), c) for i, c in enumerate(chains)], "id string, chain array<string>")
    for least in (1, 3, 4):
        got = {(r.s_id, r.b_id): r.overlap for r in W.chain_overlaps(df, df, least).collect()}
        want = {(str(i), str(j)): n for i, a in enumerate(chains) for j, b in enumerate(chains) if (n := len(set(a) & set(b))) >= least}
        assert got == want


def test_every_function_has_its_chains(spark):
    from tracegrain.plans.switches import cfg_chains

    assert {r.function % 10 for r in cfg_chains(spark, "/root/testdata/sf0.001").select("function").distinct().collect()} == set(range(10))


def test_copies_of_chains_meet_as_classes(spark, monkeypatch):
    """300 copies on either side are one pair of classes until rows are written (nested_if_overlap)."""
    monkeypatch.setattr(W, "MEMBERS", 7)
    kept = []
    monkeypatch.setattr(W, "staged", lambda df, name: kept.append((name, df.count())) or staged(df, name))
    rows = spark.createDataFrame([(f"{k}@{i}", c) for i in range(300) for k, c in (("a", ["1", "2", "3"]), ("z", ["7", "8", "9"]))], "id string, chain array<string>")
    more = spark.createDataFrame([(f"b@{i}", ["3", "2", "1", "1"]) for i in range(300)], "id string, chain array<string>")
    got = W.chain_overlaps(rows, more, over=40, digits=6).collect()
    assert sorted((r.s_id, r.b_id, r.overlap, r.percent) for r in got) == sorted((f"a@{i}", f"b@{j}", 3, 75.0) for i in range(300) for j in range(300))
    assert dict(kept)["classes"] == 1
    assert not W.chain_overlaps(rows, more, over=75).collect()


def test_string_arrays_in_many_packs(spark, monkeypatch):
    """Arrays with repeated, missing and unknown items, in packs of any size, equal a plain count (string_array_match); items are
    not joined one by one."""
    monkeypatch.setattr(S, "ITEMS", 7)
    monkeypatch.setattr(S, "CELLS", 5)
    rng = random.Random(4)
    word = lambda: rng.choice(["", None, "x y", *"abcdefghij"])
    rows = [(i, rng.choice("pq"), rng.choice(["d", None]), [word() for _ in range(rng.randrange(0, 9))]) for i in range(120)]
    held = {(f"b{rng.randrange(4)}", rng.choice(["x y", *"abcdefgh"])) for _ in range(24)}
    arrays = spark.createDataFrame(rows, "id int, pj string, dyn string, arr array<string>")
    strings = spark.createDataFrame(sorted(held) * 2, "bin_file string, value string")
    made = []
    monkeypatch.setattr(S, "staged", lambda df, name: made.append(name) or staged(df, name))
    got = {(r.pj, r.dyn, r.bin_file): (r.array_percent, r.string_percent, r.matched_strings) for r in S.match_string_arrays(arrays, strings).collect()}
    want = {}
    for pj in "pq":
        mine = [a for _, p, d, a in rows if p == pj and d == "d" and len(a) >= 3]
        for b in sorted({b for b, _ in held}):
            hits = [len({x for x in a if (b, x) in held}) for a in mine]
            if sum(hits):
                want[pj, "d", b] = (sum(h / len(a) >= 0.8 for h, a in zip(hits, mine)) / len(mine), sum(hits) / sum(map(len, mine)), sum(hits))
    assert got == want and "arrays" in made


def test_scores_of_the_index_send_nothing_whole(spark):
    """Hits meet the index, and needles the segments, without a broadcast of either (array_match_index)."""
    rows = spark.createDataFrame([([0, 7, 9, 2, i, 0], p, "d", v, 12) for i in range(20) for p, v in (("p", "1"), ("q", "2"))], "arr array<bigint>, pj string, dyn string, ver string, entropy int")
    index = A.array_index(rows, rows.select("pj", "ver"))
    segments = spark.createDataFrame([("f", ".data", "0709020e"), ("f", ".rdata", "ff0709020e"), ("g", ".data", "070902")], "bin_file string, seg string, hex string")
    scores = A.array_scores(A.search_index(index, segments), index.select("arr", "pj", "dyn", "ver", "pj_score", "ver_score"))
    hits = A.search_index(index, segments)
    assert "strategy=broadcast" not in hits._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.bin_file, r.pj, r.matched_count, r.matched_len) for r in scores.collect()} == {("f", "p", 2, 8), ("f", "q", 2, 8)}


def test_greedy_arrays_read_the_orders_once(spark, monkeypatch):
    """Postings, projects and segments come from one staged table of arrays (greedy_dedup_array)."""
    from tracegrain.plans import arrays as plan
    from tracegrain.plans import load, registry

    made = []
    load()
    monkeypatch.setattr(plan.B, "order_arrays", lambda *a, f=plan.B.order_arrays: made.append(1) or f(*a))
    registry.QUERIES["greedy_dedup_array"](spark, "/root/testdata/sf0.001")
    assert len(made) == 1


def test_short_needles_are_subsumed_too(spark):
    """Needles under six digits, and equal ones of other keys, are looked up like all others (needle_subsumption)."""
    rows = spark.createDataFrame([("l", "aabb"), ("l", "aabbcc"), ("m", "aabb"), ("m", "bbaa"), ("m", "0bbaa0")], "lib string, needle string")
    assert {(r.lib, r.needle) for r in A.without_subsumed(rows, "lib").collect()} == {("l", "aabbcc"), ("m", "aabb"), ("m", "0bbaa0")}


def test_arrays_count_once_and_needles_are_not_sent(spark):
    """Two widths of an array in one binary are one success; no needle is broadcast (num_match)."""
    rows = [("l", [1, 2, 3], 2, 1.0, n) for n in ("010203", "010002000300")] + [("l", [4, 5, 6], 1, 1.0, "040506")]
    needles = spark.createDataFrame(rows, "lib string, arr array<bigint>, count bigint, score double, needle string")
    found = A.match_arrays(needles, spark.createDataFrame([("b", "010203aa010002000300"), ("c", "00405060")], "bin_file string, hex string"), "lib")
    assert "strategy=broadcast" not in found._jdf.queryExecution().optimizedPlan().toString()
    point = pytest.approx(2.584962500721156)
    assert sorted((r.bin_file, r.success / r.total * 3) for r in found.collect()) == [("b", pytest.approx(2)), ("c", pytest.approx(1))]
    assert found.where("bin_file = 'c'").first().success == point


def test_short_enums_are_found(spark):
    """Two values of a byte are four digits, which were too few to be looked up (enum_match)."""
    needles = spark.createDataFrame([("l", [1, 2], 1, 1.0, "0102")], "lib string, arr array<bigint>, count bigint, score double, needle string")
    (row,) = A.match_arrays(needles, spark.createDataFrame([("b", "ff0102"), ("c", "ff0201")], "bin_file string, hex string"), "lib").collect()
    assert (row.bin_file, row.success, row.matched_simple) == ("b", 2.0, True)
