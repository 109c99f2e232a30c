"""Which bytes of a haystack's blocks may be needles: hashes of all windows at once, held against a bit map."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute

#: Bytes of blocks that are searched together, and tests of a hash. Random 64-bit numbers: one for each byte, the base.
TOGETHER, TESTS = 1 << 19, 3
_BYTES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def chunks(parts: pa.Array):
    """(first row, rows) of at most TOGETHER bytes together, one row at least."""
    ends = np.cumsum(lengths(parts))
    at = 0
    while at < len(parts):
        before = ends[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(ends, before + TOGETHER, "right")))
        yield at, upto - at
        at = upto


def lengths(parts: pa.Array) -> np.ndarray:
    return np.asarray(pa.compute.fill_null(pa.compute.binary_length(parts), 0).to_numpy(zero_copy_only=False), np.int64)


class Sieve:
    """A bit map of hashes: of needles' first bytes, as many as the least level, and of as many as the longest level that each
    has. What a needle begins with always passes."""

    def __init__(self, bits: int, levels: list[int], packed: bytes | None = None):
        self.bits, self.levels = bits, levels
        self.table = np.zeros(1 << (bits - 3), np.uint8) if packed is None else np.frombuffer(zlib.decompress(packed), np.uint8)
        self._up = self._down = np.empty(0, np.uint64)

    def packed(self) -> bytes:
        return zlib.compress(self.table.tobytes(), 1)

    def merge(self, packed: bytes) -> None:
        self.table |= np.frombuffer(zlib.decompress(packed), np.uint8)

    def _sums(self, data: np.ndarray) -> np.ndarray:
        """Sums of bytes times powers before each place: a window's is its hash times the power of its place."""
        if len(self._up) < len(data):
            self._up, self._down = _powers(_BASE, len(data)), _powers(_INVERSE, len(data))
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[data] * self._up[: len(data)], out=out[1:])
        return out

    def _places(self, hashes: np.ndarray, salt, kind: int):
        """The bit of each hash, for each test in turn."""
        mixed = (hashes + salt) ^ np.uint64(kind * 0x2545F4914F6CDD1D % (1 << 64))
        for m in _MIX[:TESTS]:
            mixed = mixed * m
            mixed = mixed ^ (mixed >> np.uint64(32))
            yield (mixed * _MIX[0]) >> np.uint64(64 - self.bits)

    def _passes(self, hashes: np.ndarray, salt, kind: int) -> np.ndarray:
        """Of hashes, the numbers of those that may be needles'."""
        left = None
        mixed = (hashes + salt) ^ np.uint64(kind * 0x2545F4914F6CDD1D % (1 << 64))
        for m in _MIX[:TESTS]:
            mixed = mixed * m
            mixed = mixed ^ (mixed >> np.uint64(32))
            bit = (mixed * _MIX[0]) >> np.uint64(64 - self.bits)
            ok = np.flatnonzero((self.table[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1)
            mixed = mixed[ok]
            left = ok if left is None else left[ok]
        return left

    def add(self, needles: pa.Array, salts: pa.Array) -> None:
        salts = np.asarray(salts).astype(np.int64).view(np.uint64)
        for at, rows in chunks(needles):
            some = needles.slice(at, rows)
            size = lengths(some)
            data = np.frombuffer(b"".join(some.to_pylist()), np.uint8)
            sums, start = self._sums(data), np.cumsum(size) - size
            level = np.array(self.levels)[np.searchsorted(self.levels, size, "right") - 1]
            for n, kind in ((np.full(rows, self.levels[0]), 0), (level, level)):
                hashes = (sums[start + n] - sums[start]) * self._down[start]
                for k in np.unique(kind):
                    own = np.full(rows, True) if np.isscalar(kind) else kind == k
                    for bit in self._places(hashes[own], salts[at : at + rows][own], int(k)):
                        np.bitwise_or.at(self.table, bit >> np.uint64(3), np.uint8(1) << (bit & np.uint64(7)).astype(np.uint8))

    def search(self, parts: pa.Array, salts: pa.Array, sizes: pa.Array, longest: list[int], block: int, longer: bool):
        """(rows, seeds, rests): what passes, once for each row; needles of a level are as long as ``longest`` says, and begin in
        the first ``block`` bytes of a row. ``sizes`` are whole haystacks', which ``longer`` leaves out as needles."""
        size = lengths(parts)
        raw = b"".join(x or b"" for x in parts.to_pylist())
        data = np.frombuffer(raw, np.uint8)
        row = np.repeat(np.arange(len(size)), size)
        end = np.cumsum(size)
        left = end[row] - np.arange(len(data))
        left[left <= (size - block)[row]] = 0  # these begin in the next block
        salts = np.asarray(salts).astype(np.int64).view(np.uint64)
        salted = salts[row] if salts.any() else None
        sums = self._sums(data)
        least = self.levels[0]
        at = np.flatnonzero(left >= least)
        add = lambda x: np.uint64(0) if salted is None else salted[x]
        at = at[self._passes((sums[at + least] - sums[at]) * self._down[at], add(at), 0)]
        whole = np.asarray(sizes).astype(np.int64)
        origin, seeds, rests = [], [], []
        for n, most in zip(self.levels, longest):
            at = at[left[at] >= n]
            some = at[self._passes((sums[at + n] - sums[at]) * self._down[at], add(at), n)]
            if longer:
                some = some[whole[row[some]] > n]
            of, upto = row[some], np.minimum(some + most, end[row[some]])
            if longer:
                upto = np.minimum(upto, some + whole[of] - 1)
            if n == most:
                seen = {(r, raw[i : i + n]) for r, i in zip(of.tolist(), some.tolist())}
                origin += [x[0] for x in seen]
                seeds += [x[1] for x in seen]
                rests += [None] * len(seen)
            else:
                seen = {(r, raw[i:j]) for r, i, j in zip(of.tolist(), some.tolist(), upto.tolist())}
                origin += [x[0] for x in seen]
                seeds += [x[1][:n] for x in seen]
                rests += [x[1] for x in seen]
        return np.array(origin, np.int64), seeds, rests
