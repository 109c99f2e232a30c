"""Quality rules: text statistics, and cross-document line frequency.

Lines are normalised and hashed; how many distinct documents of a host hold each is counted over all documents;
lines above the host's limit are removed, and documents that lose too many of their words are rejected.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_texts, map_texts, staged

#: A line is boilerplate in more distinct documents of a host than this, whatever the host's size.
LIMIT = 8
#: A document is depleted if fewer than this share of its words is left.
LEFT = 0.5
#: Parts that a line's documents are dealt to, so that a line in a third of all documents is no single group.
SALTS = 64

_SYMBOLS = b"#*$%&|<>"
_DIGITS = re.compile(rb"[0-9]+")
_NOT_SYMBOL = bytes(c for c in range(256) if c not in _SYMBOLS)
_CONTINUED = bytes(range(0x80, 0xC0))


def line_hash(line: bytes) -> int:
    """Hash of a normalised line: ASCII lower case, digit runs as one 0, white space as single spaces."""
    return xxhash.xxh3_64_intdigest(_DIGITS.sub(b"0", b" ".join(line.lower().split()))) - (1 << 63)


def statistics(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    found = text.split()
    n = len(found)
    joined = b"".join(found)
    chars = len(joined.translate(None, _CONTINUED))  # continuation bytes begin no code point
    symbols = len(text.translate(None, _NOT_SYMBOL))
    seen: set[bytes] = set()
    dup = 0
    for line in text.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.strip():
            seen.add(line)
    repeat = 0
    if n > 3:
        index: dict[bytes, int] = {}
        ids = np.fromiter((index.setdefault(w, len(index)) for w in found), np.int64, n)
        k = len(index)
        code = ids[:-1] * k + ids[1:]
        if k > 2_000_000:  # a product of three would not fit
            code = np.unique(code, return_inverse=True)[1].reshape(-1)
        code = code[:-1] * k + ids[2:]
        order = np.sort(code)
        twice = order[1:][order[1:] == order[:-1]]
        if len(twice):
            hit = np.isin(code, twice)
            cover = np.zeros(n, bool)
            for shift in range(3):
                cover[shift : shift + len(hit)] |= hit
            repeat = int(cover.sum())
    return n, chars, symbols, dup, repeat


def _rows(docs: DataFrame, host_col: str) -> DataFrame:
    """host, doc_id, doc, row, text: ``doc`` tells documents apart (rows without an id by their texts), ``row`` rows."""
    id_, text, host = F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")), F.coalesce(F.col(host_col).cast("string"), F.lit(""))
    row = F.xxhash64(id_, text, host)
    doc = F.when(id_.isNull(), F.xxhash64(text, F.lit("no id"))).otherwise(F.xxhash64(id_))
    return docs.select(host.alias("host"), id_.alias("doc_id"), doc.alias("doc"), row.alias("row"), text.alias("text"))


def line_rows(docs: DataFrame, host_col: str = "source") -> DataFrame:
    """(host, doc, row, key, words): a row for each distinct normalised line with a word of each row of ``docs``."""

    def kernel(batch, made):
        out: dict = {"host": [], "doc": [], "row": [], "key": [], "words": []}
        for text, host, doc, row in zip(byte_texts(batch), *(batch.column(c).to_pylist() for c in ("host", "doc", "row"))):
            found: dict[int, int] = {}
            for line in text.split(b"\n"):
                if n := len(line.split()):
                    key = line_hash(line)
                    found[key] = found.get(key, 0) + n
            out["host"] += [host] * len(found)
            out["doc"] += [doc] * len(found)
            out["row"] += [row] * len(found)
            out["key"] += found.keys()
            out["words"] += found.values()
        return out

    return map_texts(_rows(docs, host_col), kernel, "host string, doc long, row long, key long, words long")


def frequent_lines(lines: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(host, key) of the lines in more than ``limit`` distinct documents of the host.

    Rows of one document are made one first, by line and document, so that a line of a third of all documents is spread; the
    counts that follow are added up before they are shuffled.
    """
    once = lines.groupBy("host", "key", "doc").agg(F.lit(1).alias("n"))
    return once.groupBy("host", "key").agg(F.count("*").alias("n")).where(F.col("n") > limit).select("host", "key")


def _in_frequent(lines: DataFrame, frequent: DataFrame) -> DataFrame:
    """The (row, key, words) of frequent lines, once for rows that are repeated. Hot lines are salted by the row."""
    salted = lines.withColumn("salt", F.pmod(F.col("row"), F.lit(SALTS)).cast("int"))
    every = frequent.select("host", "key", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return salted.join(every, ["host", "key", "salt"]).groupBy("row", "key").agg(F.max("words").alias("words"))


def removed_words(lines: DataFrame, frequent: DataFrame) -> DataFrame:
    """(row, removed): words in removed lines."""
    return _in_frequent(lines, frequent).groupBy("row").agg(F.sum("words").alias("removed"))


def assess(docs: DataFrame, host_col: str = "source", limit: int = LIMIT, left: float = LEFT) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_removed_words.

    Null text: no words, so it fails; a null host is a host of its own, rows with a null doc_id are documents told apart
    by their texts. Rows that repeat one are one document in the counts, and each gets the same verdict; rows of one
    doc_id with different texts are one document in the counts, with a verdict each. Lines, not texts, are shuffled.
    """
    lines = staged(line_rows(docs, host_col), "lines")
    removed = removed_words(lines, staged(frequent_lines(lines, limit), "frequent"))

    def kernel(batch, made):
        got = list(map(statistics, byte_texts(batch)))
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        return {"doc_id": batch.column("doc_id"), "row": batch.column("row")} | {k: [x[i] for x in got] for i, k in enumerate(names)}

    stats = map_texts(_rows(docs, host_col), kernel, "doc_id long, row long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    gone = F.coalesce("removed", F.lit(0))
    return stats.join(removed, "row", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (F.col("n_words") - gone >= left * F.col("n_words"))).alias("kept"), gone.alias("n_removed_words"),
    )


def clean_lines(docs: DataFrame, frequent: DataFrame, host_col: str = "source") -> DataFrame:
    """doc_id and text without its frequent lines; each row gets the keys of its own lines only. Rows that repeat stay."""
    drop = _in_frequent(line_rows(docs, host_col), frequent).groupBy("row").agg(F.collect_set("key").alias("keys"))
    rows = _rows(docs, host_col).select("doc_id", "row", "text").join(drop, "row", "left")

    def kernel(batch, made):
        out = []
        for text, keys in zip(byte_texts(batch), batch.column("keys").to_pylist()):
            gone = set(keys or ())
            out.append(b"\n".join(x for x in text.split(b"\n") if not (gone and x.split() and line_hash(x) in gone)).decode("utf-8") if gone else text.decode("utf-8"))
        return {"doc_id": batch.column("doc_id"), "text": out}

    return map_texts(rows, kernel, "doc_id long, text string")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess(spark.read.parquet(f"{sf_dir}/documents.parquet"))
