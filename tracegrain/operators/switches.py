"""Matching switch structures and chains of nested conditions."""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Callable
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import staged


def normalized_cases(cases: Column) -> Column:
    """Labels sorted in each branch, branches sorted."""
    return F.array_sort(F.transform(cases, lambda b: F.array_sort(b)))


def case_pool(case_value: Column) -> Column:
    return F.transform(case_value, lambda b: F.size(b))


def merged_switches(switches: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """One row for equal case values of a key: sizes of the first by ``seq``, all functions in that order."""
    rows = switches.groupBy(*keys, "case_value").agg(F.min_by(F.struct("ncases", "targets"), seq).alias("first"), F.sort_array(F.collect_list(F.struct(seq, "function"))).alias("all"))
    return rows.select(*keys, "case_value", case_pool(F.col("case_value")).alias("case_pool"), "first.ncases", "first.targets", F.transform("all", lambda x: x["function"]).alias("functions"))


def is_special(targets: Column, ncases: Column, case_value: Column, is_source: bool) -> Column:
    """Whether a switch says enough: branches, and several labels on one or labels far apart."""
    spread = F.element_at(F.element_at(case_value, -1), 1) - F.element_at(F.element_at(case_value, 1), 1)
    return (targets >= (4 if is_source else 3)) & ((ncases - targets > 1) | (spread > F.size(case_value) + 3))


def without_one(arr: Column) -> Column:
    """All arrays that lack one element of ``arr``, distinct."""
    n = F.size(arr)
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.slice(arr, F.lit(1), i - 1), F.slice(arr, i + 1, F.greatest(n - i, F.lit(0)))))))


def has_zero(case_value: Column) -> Column:
    return F.exists(case_value, lambda b: F.array_contains(b, F.lit(0).cast("long")))


def rebased(case_value: Column) -> Column:
    """Labels less the smallest."""
    low = F.array_min(F.flatten(case_value))
    return F.transform(case_value, lambda b: F.transform(b, lambda v: v - low))


def delete_one_pairs(source: DataFrame, binary: DataFrame, with_rebase: bool = True) -> DataFrame:
    """Pairs of rows of which the binary's switch has one branch more, source columns as they are, binary ones with b_.

    The variants of each binary switch without one branch meet the sources' case values by an equi-join; if the binary
    has a zero label and the source has none, the source's labels less their smallest do too.
    """
    variants = binary.select(*(F.col(c).alias(f"b_{c}") for c in binary.columns), F.explode(without_one(F.col("case_value"))).alias("_key"))
    pairs = source.withColumn("_key", F.col("case_value")).join(variants, "_key").withColumn("rebased", F.lit(False))
    if with_rebase:
        moved = source.where(~has_zero(F.col("case_value"))).withColumn("_key", rebased(F.col("case_value")))
        zero = variants.where(has_zero(F.col("b_case_value")))
        pairs = pairs.unionByName(moved.join(zero, "_key").withColumn("rebased", F.lit(True)))
    return pairs.drop("_key")


def match_switches(source: DataFrame, binary: DataFrame, library: str = "lib") -> DataFrame:
    """``library``, bin_file, special, count, matched. A special source switch counts once if any of the binary's has just
    one branch more; the binary's own are not filtered. The pool of branch sizes follows from the case values."""
    special = source.where(is_special(F.col("targets"), F.col("ncases"), F.col("case_value"), True))
    sizes = special.groupBy(library).agg(F.count("*").alias("special"))
    pools = F.exists(without_one(F.col("b_case_pool")), lambda p: p == F.col("case_pool"))
    found = delete_one_pairs(special.withColumn("_row", F.xxhash64(library, "case_value")), binary).where(pools)
    counted = found.select(library, F.col("b_bin_file").alias("bin_file"), "case_value").distinct().groupBy(library, "bin_file").agg(F.count("*").alias("count"))
    rows = counted.join(sizes, library)
    percent = F.col("count") / F.col("special") * 100
    rule = (F.col("special") >= 5) & (((F.col("count") > 2) & (percent >= 50)) | ((F.col("count") > 5) & (percent >= 20)))
    return rows.select(library, "bin_file", "special", "count", rule.alias("matched"))


def parsed_chain(values: Column) -> Column:
    """`num, mark` texts as structs."""
    return F.transform(values, lambda t: F.struct(F.trim(F.split_part(t, F.lit(","), F.lit(1))).cast("long").alias("num"), F.trim(F.split_part(t, F.lit(","), F.lit(2))).cast("int").alias("mark")))


def long_chains(chains: DataFrame, chain: str = "chain") -> DataFrame:
    return chains.where(F.size(chain) >= 3)


#: Chains up to this many distinct steps meet by combinations of three of them.
SHORT = 12


def _triples(steps: Column) -> Column:
    """All combinations of three of a sorted array."""
    n = F.size(steps)
    at = lambda low, high: F.when(low <= high, F.sequence(low, F.greatest(low, high))).otherwise(F.array().cast("array<int>"))
    one = F.lit(1)
    return F.flatten(F.transform(at(one, n - 2), lambda i: F.flatten(F.transform(at(i + 1, n - 1), lambda j: F.transform(at(j + 1, n), lambda k: F.array(steps[i - 1], steps[j - 1], steps[k - 1]))))))


#: Chains of a class that travel as one row, about.
MEMBERS = 1000


def _classes(rows: DataFrame, x: str) -> tuple[DataFrame, DataFrame]:
    """Classes of chains with the same distinct steps and length (``x``_c, _n, _steps), and their members (``x``_c, _ids) in lists
    of about MEMBERS."""
    each = rows.select("id", F.size("chain").alias("n"), F.array_sort(F.array_distinct("chain")).alias("steps"))
    kinds = each.groupBy("n", "steps").agg(F.count("*").alias("many")).withColumn("c", F.monotonically_increasing_id())
    kinds = staged(kinds, "chains")
    parts = F.pmod(F.xxhash64("id"), F.ceil(F.col("many") / MEMBERS))
    members = each.join(kinds, ["n", "steps"]).groupBy("c", parts.alias("part")).agg(F.collect_list("id").alias("ids"))
    return kinds.select(F.col("c").alias(f"{x}_c"), F.col("n").alias(f"{x}_n"), F.col("steps").alias(f"{x}_steps")), members.select(F.col("c").alias(f"{x}_c"), F.col("ids").alias(f"{x}_ids"))


def chain_overlaps(source: DataFrame, binary: DataFrame, least: int = 3, over: float = 0, digits: int | None = None) -> DataFrame:
    """s_id, b_id, overlap, percent of the longer, for chains with ``least`` steps in common, where that is over ``over`` percent;
    rounded to ``digits`` last.

    Chains of the same distinct steps and length are one class: classes are compared, and only what holds is written out for
    their members, where it is made. With three and more, short chains meet by combinations of three of their distinct
    steps, which few pairs share by chance; a pair with a long chain, or any pair with ``least`` under three, meets by
    single steps. No pair is lost.
    """
    (s, s_members), (b, b_members) = _classes(source, "s"), _classes(binary, "b")
    single = lambda rows, x: rows.select(f"{x}_c", f"{x}_n", F.explode(f"{x}_steps").alias("key"))

    def counted(left: DataFrame, right: DataFrame) -> DataFrame:
        return single(left, "s").join(single(right, "b"), "key").groupBy("s_c", "b_c", "s_n", "b_n").agg(F.count("*").alias("overlap"))

    if least < 3:
        both = counted(s, b).where(F.col("overlap") >= least)
    else:
        is_short = lambda x: F.size(f"{x}_steps") <= SHORT
        keyed = [rows.where(is_short(x)).select(f"{x}_c", F.explode(_triples(F.col(f"{x}_steps"))).alias("key")) for rows, x in ((s, "s"), (b, "b"))]
        pairs = keyed[0].join(keyed[1], "key").select("s_c", "b_c").distinct()
        short = pairs.join(s, "s_c").join(b, "b_c").select("s_c", "b_c", "s_n", "b_n", F.size(F.array_intersect("s_steps", "b_steps")).cast("long").alias("overlap"))
        long = counted(s.where(~is_short("s")), b).unionByName(counted(s.where(is_short("s")), b.where(~is_short("b"))))
        both = short.unionByName(long).where(F.col("overlap") >= least)
    both = both.select("s_c", "b_c", "overlap", (F.col("overlap") / F.greatest("s_n", "b_n") * 100).alias("percent")).where(F.col("percent") > over)
    if digits is not None:
        both = both.withColumn("percent", F.round("percent", digits))
    both = staged(both, "classes").join(s_members, "s_c").join(b_members, "b_c")
    return both.select(F.explode("s_ids").alias("s_id"), "b_ids", "overlap", "percent").select("s_id", F.explode("b_ids").alias("b_id"), "overlap", "percent")


#: Chains up to this many distinct steps are looked up by their subsets; longer ones are compared one by one.
FEW = 8


class Binaries:
    """Chains of one binary, by equality and by subsets of their steps, for greedy assignments that use them up."""

    def __init__(self, chains: list[tuple]):
        self.chains = chains
        self.number: dict = {}
        self.equal: dict[tuple, list[int]] = {}
        self.subsets: dict[tuple, list[int]] = {}
        self.long: list[int] = []
        self.sets = [frozenset(self.number.setdefault(x, len(self.number)) for x in c) for c in chains]
        of: dict[tuple, list] = {}
        for j, c in enumerate(chains):
            self.equal.setdefault(c, []).append(j)
            if len(self.sets[j]) > FEW:
                self.long.append(j)
                continue
            key = (self.sets[j], len(c))
            if key not in of:
                of[key] = [self.subsets.setdefault(x, []) for n in range(3, len(key[0]) + 1) if n / len(c) * 100 > 40 for x in combinations(sorted(key[0]), n)]
            for posting in of[key]:
                posting.append(j)
        self.ranked: dict[tuple, tuple] = {}

    def ranks(self, chain: tuple) -> tuple:
        """(places of equal chains, postings by falling overlap) of a source chain; overlaps of three at least, over 40 % of
        the longer chain."""
        if chain not in self.ranked:
            own = sorted({self.number[x] for x in chain if x in self.number})
            tiers: dict[int, list] = {}
            one_by_one = self.long
            if len(own) > FEW:
                one_by_one = range(len(self.chains))
            else:
                for n in range(3, len(own) + 1):
                    if n / len(chain) * 100 > 40:
                        tiers[n] = [self.subsets[x] for x in combinations(own, n) if x in self.subsets]
            single: dict[int, list[int]] = {}
            mine = frozenset(own)
            for j in one_by_one:
                n = len(mine & self.sets[j])
                if n >= 3 and n / max(len(chain), len(self.chains[j])) * 100 > 40:
                    single.setdefault(n, []).append(j)
            for n, places in single.items():
                tiers.setdefault(n, []).append(places)
            self.ranked[chain] = (self.equal.get(chain), [tiers[n] for n in sorted(tiers, reverse=True) if tiers[n]])
        return self.ranked[chain]

    def assign(self, chains: list[tuple], order) -> tuple[int, int]:
        """(matches, full matches) of sources, ``chains`` in ``order``. A chain that finds nothing finds nothing later."""
        used, at, left = bytearray(len(self.chains)), {}, len(self.chains)
        ranks = [self.ranks(c) for c in chains]
        done = bytearray(len(chains))
        matches = full = 0

        def first(posting):
            k = id(posting)
            i, n = at.get(k, 0), len(posting)
            while i < n and used[posting[i]]:
                i += 1
            at[k] = i
            return posting[i] if i < n else -1

        for c in order:
            if done[c]:
                continue
            if not left:
                break
            equal, tiers = ranks[c]
            best = first(equal) if equal else -1
            if best >= 0:
                full += 1
                if len(chains[c]) < 3:
                    continue
            else:
                for postings in tiers:
                    heads = [j for j in map(first, postings) if j >= 0]
                    if heads:
                        best = min(heads)
                        break
            if best < 0:
                done[c] = 1
                continue
            matches += 1
            used[best] = 1
            left -= 1
        return matches, full


def greedy_assignment(sources: list[tuple], binaries: list[tuple]) -> tuple[int, int]:
    """(matches, full matches): each source takes an equal binary chain, else the one with the largest overlap over 40 % of
    the longer; with three steps or more in common it counts, and the binary chain is used up. First come, first served."""
    return Binaries(binaries).assign(sources, range(len(sources)))


def _packed(rows: DataFrame, key: str, chains: str) -> DataFrame:
    """``key``, n, ``chains``: a list of chains as its distinct ones and their order, compressed."""

    def pack(batches):
        for pdf in batches:
            out = []
            for x in pdf[chains]:
                number: dict[tuple, int] = {}
                order = np.array([number.setdefault(tuple(c), len(number)) for c in x], np.uint32)
                out.append(zlib.compress(pickle.dumps((list(number), order)), 1))
            yield pd.DataFrame({key: pdf[key], "n": [len(x) for x in pdf[chains]], chains: out})

    return rows.mapInPandas(pack, f"{key} string, n long, {chains} binary")


def match_chains(source: DataFrame, binary: DataFrame) -> DataFrame:
    """lib, bin_file, count, full, similarity, matched for every pair with a step in common.

    Order decides, so a pair of a library and a binary is one group; both sides are single files' chains. Pairs without
    a common step never meet. What a source chain would take is looked up by subsets of its steps, in an index of the
    binary's chains. Columns: lib or bin_file, seq (the order), chain (an array of texts).
    """
    libs = source.select("lib", F.explode("chain").alias("step")).distinct()
    bins = binary.select("bin_file", F.explode("chain").alias("step")).distinct()
    pairs = libs.join(bins, "step").select("lib", "bin_file").distinct()
    chains = F.transform(F.sort_array(F.collect_list(F.struct("seq", "chain"))), lambda x: x["chain"])
    s = _packed(source.groupBy("lib").agg(chains.alias("s")).where(F.size("s") >= 3), "lib", "s")
    b = _packed(binary.groupBy("bin_file").agg(chains.alias("b")), "bin_file", "b").drop("n")
    parts = int(source.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = pairs.join(s, "lib").join(b, "bin_file").repartition(parts, "bin_file", F.pmod(F.xxhash64("lib"), F.lit(4))).sortWithinPartitions("bin_file")

    def assign(batches):
        name = index = None
        for pdf in batches:
            got = []
            for lib, bin_file, x, y in zip(pdf["lib"], pdf["bin_file"], pdf["s"], pdf["b"]):
                if index is None or bin_file != name:
                    kinds, order = pickle.loads(zlib.decompress(y))
                    name, index = bin_file, Binaries([kinds[i] for i in order.tolist()])
                kinds, order = pickle.loads(zlib.decompress(x))
                got.append(index.assign(kinds, order.tolist()))
            count = pd.Series([g[0] for g in got], index=pdf.index, dtype="int64")
            share = count / pdf["n"] * 100
            yield pd.DataFrame({"lib": pdf["lib"], "bin_file": pdf["bin_file"], "count": count, "full": [g[1] for g in got], "similarity": share, "matched": (count > 5) & (share > 75)})

    return rows.mapInPandas(assign, "lib string, bin_file string, count long, full long, similarity double, matched boolean")


def switch_report(lines: DataFrame) -> DataFrame:
    """file, function_name, targets, ncases, case_value, case_pool of a report's lines (file, line_no, line).

    `Function:` opens a record, `ncases:` gives the number of targets, `Cur_Case: ... Target:` a branch's labels; a default
    branch counts among the labels but gives no branch. One pass over each file in line order.
    """
    rows = _with_record(lines)
    labels = F.filter(F.split(F.regexp_extract("line", r"^Cur_Case:(.*?)Target:", 1), r"\s+", -1), lambda t: t != "")
    rows = rows.withColumn("labels", F.when(F.col("line").startswith("Cur_Case:"), labels))
    per = rows.where("record > 0").groupBy("file", "record").agg(
        F.max(F.when(F.col("line").startswith("Function:"), F.expr("substring(line, 11)"))).alias("function_name"),
        F.max_by(F.when(F.col("line").startswith("ncases:"), F.expr("substring(line, 9)").cast("int")), F.when(F.col("line").startswith("ncases:"), F.col("line_no"))).alias("targets"),
        F.coalesce(F.sum(F.size("labels")).cast("long"), F.lit(0).cast("long")).alias("ncases"), F.collect_list("labels").alias("all"),
    )
    branches = F.transform(F.filter("all", lambda b: b != F.array(F.lit("default"))), lambda b: F.transform(b, lambda x: x.cast("long")))
    value = normalized_cases(branches)
    return per.select("file", "function_name", "targets", "ncases", value.alias("case_value"), case_pool(value).alias("case_pool"))


def _with_record(lines: DataFrame) -> DataFrame:
    w = Window.partitionBy("file").orderBy("line_no")
    return lines.withColumn("record", F.sum(F.col("line").startswith("Function:").cast("int")).over(w))


def condition_report(lines: DataFrame, mirror: bool = False) -> DataFrame:
    """file, function_name, chain (`num, mark` texts): conditions of each function in order, once each, without `0, 0`, empty
    and -1; of three at least.

    ``mirror`` names each chain after the next function and leaves the last out, as older tools did.
    """
    rows = _with_record(lines).where("record > 0")
    names = rows.groupBy("file", "record").agg(F.max(F.when(F.col("line").startswith("Function:"), F.expr("substring(line, 11)"))).alias("function_name"))
    info = F.expr("substring(line, 12)")
    number = F.split_part(info, F.lit(","), F.lit(1))
    steps = rows.where(F.col("line").startswith("CMP_INFOS:")).select("file", "record", "line_no", info.alias("step")).where((info != "0, 0") & ~number.isin("", "-1"))
    first = steps.groupBy("file", "record", "step").agg(F.min("line_no").alias("line_no"))
    chains = first.groupBy("file", "record").agg(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "step"))), lambda x: x["step"]).alias("chain"))
    if mirror:
        w = Window.partitionBy("file").orderBy("record")
        seen = rows.where(F.col("line").startswith("CMP_INFOS:")).select("file", "record").distinct()
        follow = seen.join(names, ["file", "record"]).select("file", "record", F.lead("function_name").over(w).alias("function_name")).where("function_name IS NOT NULL")
        names = follow
    return chains.where(F.size("chain") > 2).join(names, ["file", "record"]).select("file", "function_name", "chain")


def compare_operand(instruction: Column) -> Column:
    """The number of a `cmp` with an immediate: `...h` is hex, else decimal, else hex; null without one."""
    text = F.trim(F.regexp_extract(instruction, r"^\s*cmp\s+.*,\s*([^,]+)$", 1))
    hexed = F.regexp_extract(text, r"^0*([0-9A-Fa-f]+)[hH]$", 1)
    return (
        F.when(hexed != "", F.conv(hexed, 16, 10).try_cast("long"))
        .when(text.rlike(r"^-?[0-9]+$"), text.try_cast("long"))
        .when(text.rlike(r"^[0-9A-Fa-f]+$"), F.conv(text, 16, 10).try_cast("long"))
    )


#: Conditional jumps by class: 2 on at most or above, 1 on below or at least, 0 on equal or not.
JUMPS = {2: ("jbe", "jna", "jle", "jng", "ja", "jnbe", "jg", "jnle"), 1: ("jae", "jnb", "jge", "jnl", "jb", "jnae", "jl", "jnge"), 0: ("jz", "je", "jnz", "jne")}


def jump_class(jump: Column) -> Column:
    """The class of a conditional jump; null for other instructions."""
    return F.coalesce(*(F.when(jump.isin(*names), k) for k, names in JUMPS.items()))


def maximal_chains(chains: list[tuple]) -> list[tuple]:
    """Chains whose element sets are in no other's; of equal sets the first stays."""
    number: dict = {}
    first: dict[int, int] = {}
    for i, c in enumerate(chains):
        mask = 0
        for x in c:
            mask |= 1 << number.setdefault(x, len(number))
        first.setdefault(mask, i)
    kept: list[tuple[int, int]] = []
    larger = 0  # of ``kept``, those with more elements than the set at hand
    size = None
    for mask in sorted(first, key=int.bit_count, reverse=True):
        if mask.bit_count() != size:
            size, larger = mask.bit_count(), len(kept)
        if not any(mask & m == mask for m, _ in kept[:larger]):
            kept.append((mask, first[mask]))
    return [chains[i] for i in sorted(i for _, i in kept)]


def _ancestors(before: dict, blocks: set) -> dict:
    """The blocks that lead to each block; a block on a cycle is its own ancestor."""
    out = {}
    for block in blocks:
        found, open_ = set(), list(before.get(block, ()))
        while open_:
            p = open_.pop()
            if p not in found:
                found.add(p)
                open_ += before.get(p, ())
        out[block] = found
    return out


def chains_of_function(edges: list[tuple], conditions: dict) -> list[tuple]:
    """Maximal chains of conditions on the paths into a function's last blocks, backwards, each block once a path.

    A block's chains are found once, but for paths that a cycle cuts short. There can be as many chains as paths: two to the
    power of the diamonds in a row, which is the size of the result, not of the search. Any depth of blocks is walked.
    """
    before: dict = {}
    blocks, out_of = set(), set()
    for a, b in edges:
        before.setdefault(b, []).append(a)
        blocks |= {a, b}
        out_of.add(a)
    above, done = _ancestors(before, blocks), {}

    def walk(block, seen: frozenset):
        """Gives (block, seen) of what it needs first, and returns the chains that end in ``block``."""
        free = not (seen & above[block] or block in above[block])
        if free and block in done:
            return done[block]
        own = (conditions[block],) if conditions.get(block) and conditions[block] != (0, 0) else ()
        paths = {own}
        on = frozenset() if free else seen | {block}  # what cannot be met again need not be remembered
        for p in sorted(set(before.get(block, ()))):
            if p not in seen and p != block:
                paths.update(path + own for path in (yield p, on))
        found = maximal_chains(sorted(paths, key=lambda c: (-len(c), c)))
        if free:
            done[block] = found
        return found

    def result(block) -> list[tuple]:
        waiting, value = [walk(block, frozenset())], None
        while waiting:
            try:
                waiting.append(walk(*waiting[-1].send(value)))
                value = None
            except StopIteration as end:
                waiting.pop()
                value = end.value
        return value

    found = {c for block in sorted(blocks - out_of) for c in result(block)}
    return [c for c in maximal_chains(sorted(found, key=lambda c: (-len(c), c))) if len(c) > 2]


def function_chains(edges: DataFrame, make: Callable = chains_of_function) -> DataFrame:
    """function, chain from (function, block, succ, num, mark): the graph of one function is one row, many functions a batch."""
    graphs = edges.groupBy("function").agg(F.collect_list(F.struct("block", "succ", "num", "mark")).alias("edges"))

    def each(batches):
        for pdf in batches:
            out = []
            for function, rows in zip(pdf["function"], pdf["edges"]):
                conditions = {r["block"]: (r["num"], r["mark"]) for r in rows if r["num"] is not None}
                links = [(r["block"], r["succ"]) for r in rows if r["succ"] is not None]
                out += [(function, [f"{n}, {m}" for n, m in c]) for c in make(links, conditions)]
            yield pd.DataFrame(out, columns=["function", "chain"])

    return graphs.mapInPandas(each, "function long, chain array<string>")
