"""Repeated passages by a sparse suffix array over all documents, built by a distributed merge sort.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else. Each such string holds an
anchor: the place of the smallest hash among its GRAM-byte strings, so equal strings have it at the same place,
and it is enough to sort the suffixes that start at anchors, with the bytes to their left as what follows. Several
lengths share the anchors of the shortest, which every longer string begins with.

1. Anchors of every text, by rolling hashes and sliding minima; those whose hash occurs once are done.
2. The suffixes of the others are sorted in each task and exchanged as front-coded runs: every key is the length it
   shares with the one before, and the rest. Equal keys of a run are one, so copies cost one key a run.
3. A loser tree merges the runs. Its matches compare lengths of common prefixes first and bytes only beyond the
   prefix that is known, so no known prefix is compared again. It gives each key the length it shares with its
   neighbours, which bounds the strings around its anchor that can occur twice; these are looked up by hash.

Anchor hashes of more than HOT places are dealt out further, by the bytes that a span of offsets has in common; those of
more than HOTTER by each whole string around them, so that what meets is equal, and one key a run.
Strings are told apart by sums of 64 random bits for each place and byte.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, byte_texts, map_texts, mix, release, small_batches, staged, trim, unstaged

#: Bytes of a string that counts as repeated, and bytes that an anchor's hash is of.
LENGTH, GRAM = 400, 64
#: Bytes of the strings that make up passages, and the words from which a run of them is a passage, whatever its bytes.
PASSAGE, WORDS = 256, 50
#: Anchor hashes at more places than this are dealt out in so many spans of offsets; beyond the third, by whole strings.
HOT, SPANS, HOTTER = 10_000, 8, 1_000_000
#: Suffixes that a merge task gets, on average.
SUFFIXES = 20_000
#: Ends the bytes to the right in a key. UTF-8 never holds it.
_END = b"\xff"


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the ``gram`` bytes at each place, by doubling."""
    part = mix(data.astype(np.uint64) + np.uint64(1))
    out, done, size, base = None, 0, 1, 0x9E3779B97F4A7C15
    while True:
        if gram & size:
            if out is None:
                out, done = part, size
            else:
                n = len(out) - size
                shifted = part[done : done + n]
                out = out[: len(shifted)] * np.uint64(base) + shifted
                done += size
        size *= 2
        if size > gram:
            return mix(out)
        n = len(part) - size // 2
        part = part[:n] * np.uint64(base) + part[size // 2 : size // 2 + n]
        base = (base * base + 2) % (1 << 64)


def _least_places(keys: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` keys the place of its smallest, the first of equals."""
    n = len(keys)
    bits = max(28, int(n).bit_length())  # the same for all chunks, so that equal windows choose alike
    coded = (keys >> np.uint64(bits) << np.uint64(bits)) | np.arange(n, dtype=np.uint64)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = coded
    grid = padded.reshape(blocks, width)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(right[: n - width + 1], left[width - 1 : n])
    return (least & np.uint64((1 << bits) - 1)).astype(np.int64)


def anchors(parts: list[bytes], length: int, gram: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, hashes) of the anchors of each text; empty for texts shorter than ``length``."""
    none = (np.empty(0, np.int32), np.empty(0, np.int64))
    out = [none] * len(parts)
    at = 0
    while at < len(parts):
        group, size = [], 0
        while at < len(parts) and (not group or size + len(parts[at]) <= CHUNK_BYTES):
            if len(parts[at]) >= length:
                group.append(at)
                size += len(parts[at])
            at += 1
        if not group:
            continue
        data = np.frombuffer(b"".join(parts[i] for i in group), np.uint8)
        hashes = _gram_hashes(data, gram)
        least = _least_places(hashes, length - gram + 1)
        start = 0
        for i in group:
            n = len(parts[i])
            own = least[start : start + n - length + 1]
            places = own[np.flatnonzero(np.diff(own, prepend=-1))]
            out[i] = ((places - start).astype(np.int32), hashes[places].view(np.int64))
            start += n
    return out


def encode_run(keys: list[bytes]) -> tuple[bytes, bytes]:
    """Front coding of sorted keys: lengths shared and lengths of the rest (16 bits each), and the rests."""
    head, rest, before = [], [], b""
    for key in keys:
        same = common(before, key, 0)
        head.append(struct.pack("<HH", same, len(key) - same))
        rest.append(key[same:])
        before = key
    return b"".join(head), b"".join(rest)


def common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix; the first ``known`` bytes are known to be the same."""
    n, at = min(len(a), len(b)), known
    step = 16
    while at < n:
        if a[at : at + step] == b[at : at + step]:
            at += step
            step *= 2
        elif step > 1:
            step = max(1, step // 4)
        else:
            return min(at, n)
    return n


def decode_run(head: bytes, rest: bytes):
    """(shared with the key before, key) in order."""
    at, before = 0, b""
    for same, n in struct.iter_unpack("<HH", head):
        before = before[:same] + rest[at : at + n]
        at += n
        yield same, before


def merge_runs(runs: list):
    """Loser tree over runs of (shared, key): yields (shared with the key yielded before, key, run).

    Every waiting key carries the length it shares with the last winner it lost to or, in the end, with the key
    yielded last; the one that shares more is the smaller, and only equals are compared, from there on.
    """
    size = 1
    while size < len(runs):
        size *= 2
    streams = [iter(r) for r in runs]
    heads: list = [next(s, None) for s in streams] + [None] * (size - len(runs))
    keys = [h[1] if h else None for h in heads]
    shared = [0] * size

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser then carries what it shares with the winner."""
        ka, kb = keys[a], keys[b]
        if ka is None:
            return b, a
        if kb is None:
            return a, b
        if shared[a] != shared[b]:
            return (a, b) if shared[a] > shared[b] else (b, a)
        same = common(ka, kb, shared[a])
        if ka[same:same + 1] <= kb[same:same + 1] and (ka != kb or a < b):
            shared[b] = same
            return a, b
        shared[a] = same
        return b, a

    losers = [0] * size

    def build(node: int) -> int:
        if node >= size:
            return node - size
        win, lose = play(build(2 * node), build(2 * node + 1))
        losers[node] = lose
        return win

    win = build(1)
    while keys[win] is not None:
        yield shared[win], keys[win], win
        following = next(streams[win], None)
        if following is None:
            keys[win] = None
        else:
            shared[win], keys[win] = following
        node = (win + size) // 2
        while node:
            win, losers[node] = play(win, losers[node])
            node //= 2


_RANDOM = np.random.RandomState(99)
_SUMS = {side: _RANDOM.randint(0, 1 << 63, (LENGTH + 1, 256), dtype=np.int64).astype(np.uint64) for side in "lr"}


def _prefix_sums(parts: list[bytes], side: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each string the sums of its prefixes' random bits (column n: the first n bytes), and its length."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    grid = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in parts), np.uint8).reshape(len(parts), width)
    sums = np.zeros((len(parts), width + 1), np.uint64)
    np.cumsum(_SUMS[side][np.arange(width), grid], axis=1, out=sums[:, 1:])
    return sums, sizes


def repeated_offsets(group: np.ndarray, sums: tuple, low: np.ndarray, high: np.ndarray, reach: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each key the smallest and largest offset of its anchor in a string of ``length`` that another key of its group has
    too (-1: none). Offsets from ``low`` to ``high`` count; ``sums`` are the prefix sums of both sides, and ``reach`` is what
    its right side shares with a neighbour."""
    (hl, nl), (hr, nr) = sums
    first = np.maximum(low, length - np.minimum(nr, reach))
    last = np.minimum(high, nl)
    count = np.maximum(0, last - first + 1)
    row = np.repeat(np.arange(len(group)), count)
    offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + first[row]
    code = mix(hl[row, offset] + np.uint64(3) * hr[row, length - offset] + mix(offset.astype(np.uint64) + (group[row].astype(np.uint64) << np.uint64(16))))
    order = np.argsort(code)
    ordered = code[order]
    same = ordered[1:] == ordered[:-1]
    twice = np.zeros(len(code), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    row, offset = row[twice], offset[twice]
    least, most = np.full(len(group), length + 1), np.full(len(group), -1)
    np.minimum.at(least, row, offset)
    np.maximum.at(most, row, offset)
    least[most < 0] = -1
    return least, most


#: doc_id, uid, place, whether the key occurs twice in its run
_INSTANCE = "<qqi?"
#: First byte of a key that is one whole string of one length around its anchor; 0 is that of a key with all offsets,
#: others are the number of a span of offsets from 1.
_WHOLE = 255
_RUNS = "part long, run string, head binary, rest binary, instances binary, doc_id long, uid long, kind int, lo int, hi int"
_SPANS = "doc_id long, uid long, kind int, lo int, hi int"


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal unions of overlapping spans, in order."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _make_runs(parts: int, lengths: tuple[int, ...], gram: int):
    """Per task: sorted runs of the suffixes at the repeated anchors, a front-coded segment for each part, and the spans
    of keys that a run holds twice. ``head`` is empty in rows of spans."""
    short, long = min(lengths), max(lengths)
    reach = short - gram

    def run(batches):
        keys: dict[int, dict[bytes, list]] = {}
        spans: dict[tuple, list] = {}
        held = many = 0

        def flush():
            nonlocal held, many
            name = uuid.uuid4().hex
            out: dict = {k: [] for k in ("part", "run", "head", "rest", "instances", "doc_id", "uid", "kind", "lo", "hi")}
            for part, found in keys.items():
                ordered = sorted(found)
                instances = [struct.pack(_INSTANCE, *found[key][:3], found[key][3] > 1) for key in ordered]
                head, rest = encode_run(ordered)
                for k, v in zip(out, (part, name, head, zlib.compress(rest, 1), b"".join(instances), 0, 0, -1, 0, 0)):
                    out[k].append(v)
            for (doc_id, uid, kind), found in spans.items():
                for lo, hi in _joined(found):
                    for k, v in zip(out, ((uid ^ lo) % parts, name, b"", b"", b"", doc_id, uid, kind, lo, hi)):
                        out[k].append(v)
            keys.clear()
            spans.clear()
            held = many = 0
            return out

        def keep(part: int, key: bytes, doc_id: int, uid: int, place: int, nl: int, nr: int, kinds) -> int:
            nonlocal many
            found = keys.setdefault(part, {})
            known = found.get(key)
            if known is None:
                found[key] = [doc_id, uid, place, 1]
                return len(key)
            for d, u, p in [tuple(known[:3])] * (known[3] == 1) + [(doc_id, uid, place)]:
                for kind in kinds:
                    if nl + nr >= lengths[kind]:
                        spans.setdefault((d, u, kind), []).append((p - nl, p + nr))
                        many += 1
            known[3] += 1
            return 0

        every = range(len(lengths))
        for batch in batches:
            rows = pa.RecordBatch.from_arrays(batch.columns, schema=batch.schema)
            for doc_id, uid, text, places, grams, hot in zip(*(rows.column(k).to_pylist() for k in ("doc_id", "uid", "text", "places", "grams", "hot"))):
                data = text.encode("utf-8")
                for place, code, much in zip(places, grams, hot):
                    right, left = data[place : place + long], data[max(0, place - reach) : place][::-1]
                    if much == 0:
                        held += keep(code % parts, b"\0" + right + _END + left, doc_id, uid, place, len(left), len(right), every)
                    elif much == 1:
                        for span in range(SPANS):
                            lo, hi = span * (reach + 1) // SPANS, (span + 1) * (reach + 1) // SPANS - 1
                            if len(left) >= lo and len(right) >= short - hi:
                                r, l_ = right[: long - lo], left[:hi]
                                part = xxhash.xxh3_64_intdigest(r[: short - hi] + _END + l_[:lo]) % parts
                                held += keep(part, bytes((span + 1,)) + r + _END + l_, doc_id, uid, place, len(l_), len(r), every)
                    else:
                        for kind in every:
                            for n in range(max(0, lengths[kind] - len(right)), min(reach, len(left)) + 1):
                                key = bytes((_WHOLE, kind)) + right[: lengths[kind] - n] + _END + left[:n]
                                held += keep(xxhash.xxh3_64_intdigest(key) % parts, key, doc_id, uid, place, n, lengths[kind] - n, (kind,))
                    if held > 60_000_000 or many > 400_000:
                        yield flush()
        yield flush()

    def to_batches(batches):
        release()
        kinds = {"part": pa.int64(), "run": pa.string(), "head": pa.binary(), "rest": pa.binary(), "instances": pa.binary(), "doc_id": pa.int64(), "uid": pa.int64(), "kind": pa.int32(), "lo": pa.int32(), "hi": pa.int32()}
        for out in run(batches):
            yield pa.RecordBatch.from_pydict({k: pa.array(out[k], t) for k, t in kinds.items()})
        trim()

    return to_batches


def _merge_part(lengths: tuple[int, ...], gram: int):
    short, long = min(lengths), max(lengths)
    reach = short - gram

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        is_run = pdf["kind"] < 0
        ready, pdf = pdf.loc[~is_run, ["doc_id", "uid", "kind", "lo", "hi"]], pdf[is_run]
        out: list[tuple] = []
        runs = [decode_run(h, zlib.decompress(r)) for h, r in zip(pdf["head"], pdf["rest"])]
        where = [struct.iter_unpack(_INSTANCE, x) for x in pdf["instances"]]
        group: list[list] = []  # key, what it shares with the one before, instances, whether it occurs twice
        waiting: list[list[list]] = []

        def split(key: bytes) -> tuple[bytes, bytes]:
            right, _, left = key[2 if key[0] == _WHOLE else 1 :].partition(_END)
            return right, left

        def settle():
            if not waiting:
                return
            flat = [x for g in waiting for x in g]
            ids = np.repeat(np.arange(len(waiting)), [len(g) for g in waiting])
            parts = [split(x[0]) for x in flat]
            near = np.array([max(x[1], y) for g in waiting for x, y in zip(g, [z[1] for z in g[1:]] + [0])]) - 1
            spans = np.array([x[0][0] for x in flat])
            low = np.where(spans == 0, 0, (spans - 1) * (reach + 1) // SPANS)
            high = np.where(spans == 0, reach, spans * (reach + 1) // SPANS - 1)
            sums = _prefix_sums([p[1] for p in parts], "l", max(1, int(high.max()))), _prefix_sums([p[0] for p in parts], "r", long)
            for kind, length in enumerate(lengths):
                least, most = repeated_offsets(ids, sums, low, high, near, length)
                for x, a, b in zip(flat, least.tolist(), most.tolist()):
                    if b >= 0:
                        out.extend((d, u, kind, p - b, p + length - a) for d, u, p, _ in x[2])
            waiting.clear()

        def close():
            if len(group) > 1 and not all(x[3] for x in group):
                waiting.append(list(group))
                if sum(map(len, waiting)) > 512:
                    settle()
            for x in group:
                if x[3]:
                    right, left = split(x[0])
                    for kind, length in enumerate(lengths):
                        if len(left) + len(right) >= length and (x[0][0] != _WHOLE or x[0][1] == kind):
                            out.extend((d, u, kind, p - len(left), p + len(right)) for d, u, p, _ in x[2])
            group.clear()

        for same, key, run in merge_runs(runs):
            instance = next(where[run])
            if group and same == len(key) == len(group[-1][0]):
                group[-1][2].append(instance)
                group[-1][3] = True
                continue
            least = len(key) if key[0] == _WHOLE else 1 + (gram if key[0] == 0 else short - key[0] * (reach + 1) // SPANS + 1)
            if group and (same < least or key[0] == _WHOLE):
                close()
            group.append([key, same if group else 0, [instance], instance[3]])
        close()
        settle()
        return pd.concat([ready, pd.DataFrame(out, columns=["doc_id", "uid", "kind", "lo", "hi"]).astype(ready.dtypes)], ignore_index=True)

    return merge


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    return rows.select(F.coalesce("id", F.lit(-(1 << 63))).alias("doc_id"), F.xxhash64("id", "text").alias("uid"), "text", F.col("id").isNull().alias("no_id"))


def repeated_spans(docs: DataFrame, lengths: tuple[int, ...] = (LENGTH,), gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """All rows as (doc_id, uid, no_id, n_bytes, sha), and, for texts with repeats, (doc_id, uid, text, spans); the spans
    have the number of their length in ``lengths``.

    uid is a hash of id and text; rows that are repeated share it, and are each other's repeats.
    """
    if not 0 < gram < min(lengths) or max(lengths) > LENGTH:
        raise ValueError(f"gram < lengths <= {LENGTH}")
    rows = _keyed(docs, id_col, text_col)

    def find(batch, made):
        parts = byte_texts(batch)
        found = anchors(parts, min(lengths), gram)
        return {k: batch.column(k) for k in ("doc_id", "uid", "no_id")} | {
            "n_bytes": list(map(len, parts)), "sha": [hashlib.sha256(p).hexdigest() for p in parts],
            "places": [x.tolist() for x, _ in found], "grams": [x.tolist() for _, x in found],
        }

    every = staged(map_texts(rows, find, "doc_id long, uid long, no_id boolean, n_bytes long, sha string, places array<int>, grams array<long>"), "anchors")
    repeated = staged(every.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("n")).where("n > 1"), "grams")
    flat = every.select("doc_id", "uid", F.explode(F.arrays_zip("places", "grams")).alias("x")).select("doc_id", "uid", F.col("x.places").alias("place"), F.col("x.grams").alias("gram"))
    much = F.when(F.col("n") > HOTTER, 2).when(F.col("n") > HOT, 1).otherwise(0)
    hits = flat.join(repeated, "gram").select("doc_id", "uid", F.struct("place", "gram", much.alias("hot")).alias("x"))
    hits = staged(hits.groupBy("doc_id", "uid").agg(F.array_sort(F.collect_list("x")).alias("x")), "hits")
    total = hits.agg(F.sum(F.size("x"))).first()[0] or 0
    unstaged(repeated)
    parts = max(8, -(-total // SUFFIXES))
    texts_ = rows.select("doc_id", "uid", "text").join(hits, ["doc_id", "uid"])
    texts_ = staged(texts_.select("doc_id", "uid", "text", F.col("x.place").alias("places"), F.col("x.gram").alias("grams"), F.col("x.hot").alias("hot")), "suffix-texts")
    unstaged(hits)
    small_batches(docs.sparkSession)
    runs = texts_.mapInArrow(_make_runs(parts, lengths, gram), _RUNS)
    found = staged(runs.groupBy("part").applyInPandas(_merge_part(lengths, gram), _SPANS), "spans")
    spans = found.groupBy("doc_id", "uid").agg(F.array_sort(F.collect_set(F.struct("kind", "lo", "hi"))).alias("spans"))
    return every.select("doc_id", "uid", "no_id", "n_bytes", "sha"), texts_.select("doc_id", "uid", "text").dropDuplicates(["doc_id", "uid"]).join(spans, ["doc_id", "uid"])


def cut(data: bytes, spans: list) -> tuple[bytes, int]:
    """What is left of ``data`` without ``spans`` (sorted lo, hi), and the number of maximal runs removed."""
    kept, at, runs, end = [], 0, 0, -1
    for lo, hi in spans:
        if lo > end:
            runs += 1
            kept.append(data[at:lo])
        end = max(end, hi)
        at = max(at, hi)
    kept.append(data[at:])
    return b"".join(kept), runs


def passages(data: bytes, spans: list[tuple[int, int]], words: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """The maximal runs of ``spans`` that hold ``words`` words, or ``length`` bytes where a script has no spaces."""
    return [(lo, hi) for lo, hi in _joined(spans) if hi - lo >= length or len(data[lo:hi].split()) >= words]


def _of_kind(spans: list[dict], kind: int) -> list[tuple[int, int]]:
    return [(s["lo"], s["hi"]) for s in spans if s["kind"] == kind]


def removed(docs: DataFrame, length: int = LENGTH, passage: int = PASSAGE, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and n_passage, the bytes of the passages that also occur elsewhere:
    runs of repeated strings of ``passage`` bytes that hold ``words`` words. Null text: no bytes. A null id stays null."""
    every, found = repeated_spans(docs, (length, passage), id_col=id_col, text_col=text_col)

    def kernel(batch, made):
        out: dict = {"n_removed": [], "n_spans": [], "kept_sha256": [], "n_passage": []}
        for data, spans in zip(byte_texts(batch), batch.column("spans").to_pylist()):
            rest, n = cut(data, _of_kind(spans, 0))
            shared = sum(hi - lo for lo, hi in passages(data, _of_kind(spans, 1), words, length))
            for k, v in zip(out, (len(data) - len(rest), n, hashlib.sha256(rest).hexdigest(), shared)):
                out[k].append(v)
        return {"doc_id": batch.column("doc_id"), "uid": batch.column("uid")} | out

    done = map_texts(found, kernel, "doc_id long, uid long, n_removed long, n_spans long, kept_sha256 string, n_passage long")
    zero = F.lit(0).cast("long")
    return every.join(done, ["doc_id", "uid"], "left").select(
        F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"), F.coalesce("n_passage", zero).alias("n_passage"),
    )


def without_repeats(docs: DataFrame, length: int = LENGTH, words: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeats taken out of its texts; characters cut in half go too. Nothing else changes: null texts without
    repeats stay null, columns may have any names. With ``words``, only runs of so many words, or of LENGTH bytes, go."""
    _, found = repeated_spans(docs, (length,), id_col=id_col, text_col=text_col)

    def kernel(batch, made):
        rest = [cut(data, passages(data, _of_kind(spans, 0), words))[0].decode("utf-8", "ignore") for data, spans in zip(byte_texts(batch), batch.column("spans").to_pylist())]
        return {"doc_id": batch.column("doc_id"), "uid": batch.column("uid"), "rest": rest}

    done = map_texts(found, kernel, "doc_id long, uid long, rest string")
    text, whole = F.coalesce(F.col(text_col), F.lit("")), F.struct(*(F.col(c) for c in docs.columns))
    # the document itself travels as one column, so that its columns cannot clash with these
    keyed = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("doc_id"), F.xxhash64(F.col(id_col).cast("long"), text).alias("uid"), whole.alias("row"))
    out = keyed.join(done, ["doc_id", "uid"], "left")
    return out.select(*((F.coalesce("rest", F.col(f"row.`{c}`")) if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
