"""Byte-level BPE by a lazily determinised transducer, and streaming decoding by a UTF-8 state machine.

The merges are compiled into pairwise validity: a token sequence is the encoding of its bytes exactly if each
adjacent pair of its tokens is the encoding of the pair's bytes. So the last token of every prefix is the one
token that ends there and is valid after the last token of the prefix before it. A state of the transducer
holds, for each place where a token could still begin, the bytes since that place and the last token before
it; states and transitions are made when first met. A transition gives the last token of the prefix read so
far; tokens are settled, and leave, where the prefixes of all open places agree, at most one longest token back.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, map_texts, resident, texts

#: States that one worker keeps; beyond it the table is built afresh.
STATE_LIMIT = 160_000

#: Bytes at the beginning of a piece whose way through the states is remembered as a whole.
HEAD = 5

_BYTE = [bytes((b,)) for b in range(256)]
_NEVER = 1 << 60


class _State:
    __slots__ = ("live", "next")

    def __init__(self, live: tuple):
        self.live, self.next = live, {}


class MergeTransducer:
    def __init__(self, ranks: dict[bytes, int], state_limit: int = STATE_LIMIT, hold: int = 1024):
        self.ranks, self.state_limit, self.hold = ranks, state_limit, hold
        self.table = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.table[rank] = token
        self.packed = [struct.pack("<I", rank) for rank in range(len(self.table))]
        self.open = {token[:n] for token in ranks for n in range(1, len(token))}
        self.valid = Memo(self._is_valid, 300_000)
        self.states: dict = {}
        self._reset()

    def _reset(self) -> None:
        for state in self.states.values():  # states refer to each other in circles
            state.next.clear()
        self.states, self.starts, self.heads = {}, {}, {}  # equal starts are one object
        self.root = self._state(((b"", -1),))

    def _state(self, live: tuple) -> _State:
        found = self.states.get(live)
        if found is None:
            found = self.states[live] = _State(live)
        return found

    def _apart(self, piece: bytes, at: int) -> bool:
        """Whether the merges of ``piece`` end in two tokens that part at ``at``; 0 asks for one token instead."""
        ranks = self.ranks
        parts = [piece[i : i + 1] for i in range(len(piece))]
        costs = [ranks.get(piece[i : i + 2], _NEVER) for i in range(len(piece) - 1)]
        left = at  # parts before the border
        while costs:
            least = min(costs)
            if least == _NEVER:
                break
            i = costs.index(least)
            if i == left - 1:
                return False
            if i < left:
                left -= 1
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del costs[i]
            if i:
                costs[i - 1] = ranks.get(parts[i - 1] + parts[i], _NEVER)
            if i < len(costs):
                costs[i] = ranks.get(parts[i] + parts[i + 1], _NEVER)
        return len(parts) == (2 if at else 1)

    def _is_valid(self, pair: int) -> bool:
        """Of the token before (one more than its rank, 0 for none) in the high bits and the token in the low 20."""
        left, right = pair >> 20, self.table[pair & 0xFFFFF]
        if not left:
            return self._apart(right, 0)
        return self._apart(self.table[left - 1] + right, len(self.table[left - 1]))

    def _grow(self, state: _State, byte: int) -> tuple[_State, int, int]:
        """The next state, the last token of the prefix that ends here, and its length."""
        live, end, n = [], -1, 0
        ranks, open_, starts, valid, last_byte = self.ranks, self.open, self.starts, self.valid, _BYTE[byte]
        for seen, last in state.live:
            now = seen + last_byte
            if end < 0 and now in ranks:
                rank = ranks[now]
                if valid[(last + 1) << 20 | rank]:
                    end, n = rank, len(now)
            if now in open_:
                start = (now, last)
                live.append(starts.setdefault(start, start))
        if end < 0:
            raise ValueError("the vocabulary lacks a single byte")
        start = (b"", end)
        live.append(starts.setdefault(start, start))
        found = state.next[byte] = (self._state(tuple(live)), end, n)
        return found

    def _settled(self, state: _State, steps: list) -> int:
        """The last place on which the prefixes of all open starts agree."""
        common: set | None = None
        for seen, _ in state.live:
            at, chain = len(steps) - len(seen), set()
            while at > 0:
                chain.add(at)
                at -= steps[at - 1][2]
            common = chain if common is None else common & chain
        return max(common or {0})

    @staticmethod
    def _trace(steps: list, at: int) -> list[int]:
        ids = []
        while at > 0:
            _, rank, n = steps[at - 1]
            ids.append(rank)
            at -= n
        return ids[::-1]

    def stream(self, piece: bytes):
        """Lists of ids, each out as soon as no later byte can change it and ``hold`` bytes are waiting."""
        if len(self.states) > self.state_limit:
            self._reset()
        state, steps = self.root, []
        for byte in piece:
            step = state.next.get(byte) or self._grow(state, byte)
            state = step[0]
            steps.append(step)
            if len(steps) % self.hold == 0 and (at := self._settled(state, steps)):
                yield self._trace(steps, at)
                del steps[:at]
        yield self._trace(steps, len(steps))

    def encode_piece(self, piece: bytes) -> bytes:
        """Ids of one piece as little-endian unsigned 32-bit integers."""
        if len(piece) <= self.hold:
            if len(self.states) > self.state_limit:
                self._reset()
            state, steps, grow = self.root, [], self._grow
            if len(piece) > HEAD:  # many pieces begin alike
                head = piece[:HEAD]
                known = self.heads.get(head)
                if known is None:
                    for byte in head:
                        step = state.next.get(byte) or grow(state, byte)
                        state = step[0]
                        steps.append(step)
                    self.heads[head] = (state, steps.copy())
                else:
                    state, steps = known[0], known[1].copy()
                rest = piece[HEAD:]
            else:
                rest = piece
            for byte in rest:
                step = state.next.get(byte) or grow(state, byte)
                state = step[0]
                steps.append(step)
            at, packed = len(steps), b""
            while at > 0:
                _, rank, n = steps[at - 1]
                packed = self.packed[rank] + packed
                at -= n
            return packed
        return b"".join(struct.pack(f"<{len(ids)}I", *ids) for ids in self.stream(piece))


class Utf8Machine:
    """How many bytes at the end of what was fed belong to a character that is not complete yet."""

    #: For a lead byte's range, how many continuation bytes follow.
    FOLLOW = ((0x00, 0x7F, 0), (0xC2, 0xDF, 1), (0xE0, 0xEF, 2), (0xF0, 0xF4, 3))

    def __init__(self):
        self.need = np.full(256, -1, np.int8)
        for low, high, n in self.FOLLOW:
            self.need[low : high + 1] = n

    def open_tail(self, data: bytes) -> int:
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte & 0xC0 != 0x80:
                return back if self.need[byte] >= back else 0
        return 0


class StreamDecoder:
    """Ids in, text out: whole characters at once, the rest waits; bad bytes become U+FFFD."""

    def __init__(self, table: list[bytes]):
        self.table, self.machine, self.tail = table, Utf8Machine(), b""

    def feed(self, ids) -> str:
        data = self.tail + b"".join(map(self.table.__getitem__, ids))
        n = len(data) - self.machine.open_tail(data)
        self.tail = data[n:]
        return data[:n].decode("utf-8", "replace")

    def finish(self) -> str:
        rest, self.tail = self.tail.decode("utf-8", "replace"), b""
        return rest


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Codec:
    def __init__(self, path: str, pattern: str):
        import regex

        self.split = regex.compile(pattern).findall
        self.transducer = MergeTransducer(load_ranks(path))
        self.pieces = Memo(lambda piece: self.transducer.encode_piece(piece.encode("utf-8")), 300_000)

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.split(text)))

    def decode(self, packed: bytes, step: int = 1 << 16) -> list[str]:
        decoder = StreamDecoder(self.transducer.table)
        ids = np.frombuffer(packed, "<u4")
        parts = [decoder.feed(ids[at : at + step].tolist()) for at in range(0, len(ids), step)]
        return [*parts, decoder.finish()]


def codec(path: str, pattern: str) -> Codec:
    """One for each worker process: what was compiled serves its later tasks too."""

    def make() -> Codec:
        gc.set_threshold(1_000_000, 100, 100)  # the tables are many small objects that live long
        return Codec(path, pattern)

    return resident(codec_key(path, pattern), make)


def codec_key(path: str, pattern: str) -> tuple:
    return "codec", path, pattern


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit, packed), n_tokens. A null or empty text has no ids; rows that
    repeat stay repeated."""

    def kernel(batch, made):
        packed = [made.encode(t) for t in batch.column("text").to_pylist()]
        return {"doc_id": batch.column("doc_id"), "ids": packed, "n_tokens": [len(p) // 4 for p in packed]}

    return map_texts(texts(docs, id_col, text_col), kernel, "doc_id long, ids binary, n_tokens long", lambda: codec(path, pattern), codec_key(path, pattern))


def encode_with_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, ids (packed), n_tokens, ids_sha256, decoded_sha256, and the columns ``keep``, in the order of the rows; nulls as in ``round_trip``."""

    def kernel(batch, made):
        out: dict = {"doc_id": batch.column("doc_id"), "source": batch.column("source"), "ids": [], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for text in batch.column("text").to_pylist():
            packed = made.encode(text)
            digest = hashlib.sha256()
            for part in made.decode(packed):
                digest.update(part.encode("utf-8"))
            for k, v in zip(("ids", "n_tokens", "ids_sha256", "decoded_sha256"), (packed, len(packed) // 4, hashlib.sha256(packed).hexdigest(), digest.hexdigest())):
                out[k].append(v)
        return out | {c: batch.column(c) for c in keep}

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(source_col).cast("string").alias("source"), *keep)
    kept = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    return map_texts(rows, kernel, "doc_id long, source string, ids binary, n_tokens long, ids_sha256 string, decoded_sha256 string" + kept, lambda: codec(path, pattern), codec_key(path, pattern))


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the text that the packed ``ids`` stand for."""

    def kernel(batch, made):
        return {"doc_id": batch.column("doc_id"), "text": ["".join(made.decode(p or b"")) for p in batch.column("ids").to_pylist()]}

    return map_texts(encoded.select("doc_id", "ids"), kernel, "doc_id long, text string", lambda: codec(path, pattern), codec_key(path, pattern))


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: each text encoded, its ids decoded, both as digests.

    One pass without a shuffle. Null text: as the empty text; repeated rows give repeated results.
    """

    def kernel(batch, made):
        out: dict = {"doc_id": batch.column("doc_id"), "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for text in batch.column("text").to_pylist():
            packed = made.encode(text)
            digest = hashlib.sha256()
            for part in made.decode(packed):
                digest.update(part.encode("utf-8"))
            out["n_tokens"].append(len(packed) // 4)
            out["ids_sha256"].append(hashlib.sha256(packed).hexdigest())
            out["decoded_sha256"].append(digest.hexdigest())
        return out

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_texts(texts(docs, id_col, text_col), kernel, schema, lambda: codec(path, pattern), codec_key(path, pattern))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
