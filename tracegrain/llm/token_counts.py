"""Token counts without token ids.

1. Each task splits its texts into pre-tokens. For every chunk of texts it makes BUCKETS rows, by a hash of the pre-token:
   the distinct pre-tokens, and for each the documents that hold it and how often.
2. A bucket of all chunks is one task: a pre-token's pieces are counted there once, for all documents that hold it, joined to
   their frequencies, and summed by document. Buckets are those of PARTITIONS input partitions, so that a pre-token of every
   text is no single group; it is counted again only after that many gigabytes.
3. The buckets' sums are added by chunk. No id is ever made of a document's text.
"""

from __future__ import annotations

import os
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ARROW_ROWS, release, resident, small_batches, texts, trim

#: Fixed value: how word_bpe_49k.json splits a normalised text into pre-tokens.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters of a chunk's texts that are aimed at, and its documents at most.
CHUNK, CHUNK_ROWS = 8 << 20, 60_000
#: Buckets of pre-tokens, and input partitions whose buckets are one task.
BUCKETS, PARTITIONS = 128, 64
#: Times that one entry of a frequency list can count; a more frequent one has several.
_MOST = 255


class PieceCounter:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            added = [x["content"] for x in json.load(file)["added_tokens"]]
        self.normalize = self.tokenizer.normalizer.normalize_str
        self.pieces = regex.compile(WORD_PATTERN).findall
        self.special = regex.compile("|".join(map(regex.escape, added)))

    def pre_tokens(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens, and how many special strings stand in the text (a token each, split off first)."""
        parts = self.special.split(text)
        found = self.pieces(self.normalize(parts[0]))
        for part in parts[1:]:
            found += self.pieces(self.normalize(part))
        return found, len(parts) - 1

    def count(self, pieces: list[str]) -> list[int]:
        return [len(x) for x in self.tokenizer.encode_batch(pieces, add_special_tokens=False)]


def counter(path: str) -> PieceCounter:
    return resident(("counter", path), lambda: PieceCounter(path))


class Chunk:
    """Pre-token frequencies of some documents."""

    def __init__(self):
        self.index: defaultdict = defaultdict()
        self.index.default_factory = self.index.__len__
        self.found, self.ids, self.sizes, self.special, self.chars = [], [], [], [], 0

    def add(self, doc_id: int | None, text: str, made: PieceCounter) -> None:
        pieces, special = made.pre_tokens(text)
        ids = np.fromiter(map(self.index.__getitem__, pieces), np.int64, len(pieces))
        self.found.append((ids << 16) | len(self.ids))
        self.ids.append(0 if doc_id is None else doc_id)  # pandas would make floats of ids beside a null
        self.sizes.append(len(text.encode("utf-8")))
        self.special.append(-1 - special if doc_id is None else special)
        self.chars += len(text)

    def rows(self, name: int, group: int) -> dict:
        """A row for each bucket with a pre-token, and one, of a bucket under 0, for the documents."""
        pieces = sorted(self.index)
        bucket = np.fromiter((zlib.crc32(p.encode("utf-8")) % BUCKETS for p in pieces), np.int64, len(pieces))
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(pieces), np.int64)
        place[np.fromiter(map(self.index.__getitem__, pieces), np.int64, len(pieces))[order]] = np.arange(len(pieces))
        found = np.concatenate(self.found)
        code, times = np.unique((place[found >> 16] << 16) | (found & 0xFFFF), return_counts=True)
        more = -(-times // _MOST)
        if len(more) and more.max() > 1:
            code, rest = np.repeat(code, more), np.repeat(times, more)
            rest -= _MOST * (np.arange(len(code)) - np.repeat(np.cumsum(more) - more, more))
            times = np.minimum(rest, _MOST)
        piece, at = code >> 16, code & 0xFFFF
        entries = np.bincount(piece, minlength=len(pieces))
        step = np.diff(at, prepend=0)  # documents of a pre-token by their distances
        begin = (np.cumsum(entries) - entries)[entries > 0]
        step[begin] = at[begin]
        edges = np.searchsorted(bucket[order], np.arange(BUCKETS + 1))
        starts = np.searchsorted(piece, edges)
        out: dict = {"grp": [group], "bucket": [-1 - name % 64], "chunk": [name], "docs": [len(self.ids)], "pieces": [b""], "entries": [b""], "at": [b""], "times": [b""]}
        names = [pieces[i] for i in order]
        for k in np.flatnonzero(np.diff(edges)):
            lo, hi, a, b = edges[k], edges[k + 1], starts[k], starts[k + 1]
            parts = ("\n".join(names[lo:hi]).encode("utf-8"), entries[lo:hi].astype("<u4").tobytes(), step[a:b].astype("<u2").tobytes(), times[a:b].astype(np.uint8).tobytes())
            for key, value in zip(out, (group, int(k), name, len(self.ids), *(zlib.compress(x, 1) for x in parts))):
                out[key].append(value)
        none = [None] * (len(out["chunk"]) - 1)
        return out | {"ids": [self.ids, *none], "sizes": [self.sizes, *none], "special": [self.special, *none]}


_ROWS = "grp long, bucket int, chunk long, docs int, pieces binary, entries binary, at binary, times binary, ids array<long>, sizes array<long>, special array<long>"
_SUMS = "chunk long, sums binary, ids array<long>, sizes array<long>, special array<long>"


def frequencies(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of chunks: a bucket's pre-tokens (``pieces``) with their entries, or the documents (buckets under 0); ``special`` is
    minus one and less where the id is null."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(_ROWS))

    def run(batches):
        from pyspark import TaskContext

        release(("counter", path))
        made, chunk, part, n = counter(path), Chunk(), TaskContext.get().partitionId(), 0

        def done():
            rows = chunk.rows(part << 32 | n, part // PARTITIONS)
            return pa.RecordBatch.from_arrays([pa.array(rows[f.name], type=f.type) for f in arrow], schema=arrow)

        for batch in batches:
            for at in range(0, batch.num_rows, ARROW_ROWS):
                some = batch.slice(at, ARROW_ROWS)
                for doc_id, text in zip(some.column("doc_id").to_pylist(), some.column("text").to_pylist()):
                    chunk.add(doc_id, text, made)
                    if chunk.chars >= CHUNK or len(chunk.ids) >= CHUNK_ROWS:
                        yield done()
                        chunk, n = Chunk(), n + 1
        if chunk.ids:
            yield done()
        del chunk
        trim()

    small_batches(docs.sparkSession)
    return texts(docs, id_col, text_col).mapInArrow(run, _ROWS)


def _joined(path: str):
    """The rows of one bucket: each distinct pre-token is counted once, and its count meets its entries in all chunks."""

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        if int(pdf["bucket"].iloc[0]) < 0:
            return pd.DataFrame({"chunk": pdf["chunk"], "sums": b"", "ids": pdf["ids"], "sizes": pdf["sizes"], "special": pdf["special"]})
        release(("counter", path))
        index: defaultdict = defaultdict()
        index.default_factory = index.__len__
        ids = [np.array([index[p] for p in zlib.decompress(x).decode("utf-8").split("\n")], np.int64) for x in pdf["pieces"]]
        distinct, made = list(index), counter(path)
        counts = np.array([n for at in range(0, len(distinct), 10_000) for n in made.count(distinct[at : at + 10_000])], np.int64)
        sums = []
        for own, docs, *parts in zip(ids, pdf["docs"], pdf["entries"], pdf["at"], pdf["times"]):
            entries, step, times = (np.frombuffer(zlib.decompress(x), t).astype(np.int64) for x, t in zip(parts, ("<u4", "<u2", np.uint8)))
            total = np.cumsum(step)
            begin = np.cumsum(entries) - entries
            at = total - np.repeat(total[begin] - step[begin], entries)
            sums.append(zlib.compress(np.bincount(at, times * np.repeat(counts[own], entries), docs).astype("<u4").tobytes(), 1))
        return pd.DataFrame({"chunk": pdf["chunk"], "sums": sums, "ids": None, "sizes": None, "special": None})

    return join


def _added(pdf: pd.DataFrame) -> pd.DataFrame:
    """The documents of one chunk with their tokens."""
    head = pdf[pdf["ids"].notna()].iloc[0]
    special = np.array(head["special"], np.int64)
    total = np.where(special < 0, -1 - special, special)
    for x in pdf.loc[pdf["ids"].isna(), "sums"]:
        total += np.frombuffer(zlib.decompress(x), "<u4")
    return pd.DataFrame({"doc_id": pd.Series(np.array(head["ids"], np.int64), dtype="Int64").mask(special < 0), "n_bytes": np.array(head["sizes"], np.int64), "n_tokens": total})


def count_tokens(docs: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit); a row for each row, a null id stays null. Null text: zero
    bytes and tokens. A text's pre-tokens may add up to 2 ** 32 tokens a bucket."""
    rows = frequencies(docs, path, id_col, text_col)
    sums = rows.groupBy("grp", "bucket").applyInPandas(_joined(path), _SUMS)
    out = sums.groupBy("chunk").applyInPandas(_added, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), 2048)
