"""Language identification as mixture inference.

Each language is a smoothed distribution of byte trigrams within words. Expectation-maximisation estimates what
share of a document's words each language gave; languages join the set while the penalised likelihood rises.
"""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_texts, held_out, map_texts, texts

#: Hashed trigrams; a model is this many floats for each language.
BUCKETS = 1 << 15
#: Documents of each language that are expected in the sample the trigrams are counted on.
SAMPLE = 3000
UNKNOWN = "und"

_TABLE = bytearray(range(256))
for _c in range(0x80):
    if chr(_c).isupper():
        _TABLE[_c] = _c + 32
    elif not chr(_c).isalpha():
        _TABLE[_c] = 32
_TABLE = bytes(_TABLE)
_LETTER = re.compile(r"[^\W\d_]")


def words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def trigrams(found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all trigrams of ` word `, and where each word's begin."""
    data = np.frombuffer(b" " + b"  ".join(found) + b" ", np.uint8).astype(np.uint32)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    begin = np.cumsum(sizes + 2) - (sizes + 2)
    code = (data[:-2] * np.uint32(65536) + data[1:-1] * np.uint32(256) + data[2:]) * np.uint32(2654435761) >> np.uint32(17)
    keep = np.ones(len(code), bool)
    ends = (begin + sizes)[:-1]
    keep[ends] = keep[ends + 1] = False  # these cross from one word to the next
    return code[keep].astype(np.int64), np.cumsum(sizes) - sizes


class Model:
    def __init__(self, counts: dict[str, np.ndarray], smooth: float = 0.5):
        self.langs = sorted(counts)
        table = np.array([counts[x] for x in self.langs], np.float64).reshape(len(self.langs), BUCKETS) + smooth
        self.table = np.ascontiguousarray(np.log(table / table.sum(1, keepdims=True)).T.astype(np.float32)) if self.langs else None

    def word_likelihoods(self, found: list[bytes]) -> np.ndarray:
        code, begin = trigrams(found)
        return np.add.reduceat(self.table[code], begin, axis=0).astype(np.float64)


def expectation_maximisation(like: np.ndarray, count: np.ndarray, rounds: int = 15, near: float = 1e-4) -> tuple[np.ndarray, float]:
    """Mixture weights of the columns of ``like`` (log-likelihoods by row, ``count`` times each), and the log-likelihood."""
    top = like.max(1)
    rel = np.exp(like - top[:, None])
    share, total = np.full(like.shape[1], 1.0 / like.shape[1]), count.sum()
    for _ in range(rounds):
        joint = rel @ share
        new = share * (rel.T @ (count / joint)) / total
        moved = np.abs(new - share).max()
        share = new
        if moved < near:
            break
    return share, float((count * (np.log(rel @ share) + top)).sum())


def infer(like: np.ndarray, count: np.ndarray) -> tuple[list[int], np.ndarray, float]:
    """The language set, its proportions and the penalised likelihood: forward selection under BIC."""
    alone = count @ like
    chosen = [int(alone.argmax())]
    best, share = float(alone.max()), np.ones(1)
    price = 0.5 * math.log(max(2.0, count.sum()))
    while len(chosen) < like.shape[1]:
        tried = []
        for other in range(like.shape[1]):
            if other not in chosen:
                weights, total = expectation_maximisation(like[:, [*chosen, other]], count)
                tried.append((total - price * len(chosen), other, weights))
        top = max(tried, key=lambda x: (x[0], -x[1]))
        if top[0] <= best:
            break
        best, share = top[0], top[2]
        chosen.append(top[1])
    return chosen, share, best


def learn(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Trigram counts by language, from a sample of ``sample`` documents a language (in expectation; chosen by a
    hash of the id) outside the held-out fold. The driver gets at most languages x BUCKETS sums."""
    train = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out())
    sizes = {r.lang: r["count"] for r in train.groupBy("lang").count().collect()}
    if not sizes:
        return Model({})
    part = F.create_map(*(x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(int(1_000_000 * min(1.0, sample / n))))))
    chosen = train.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000)) < part[F.col("lang")])

    def kernel(batch, sums):
        out: dict = {"lang": [], "bucket": [], "n": []}
        by: dict[str, list[bytes]] = {}
        for text, lang in zip(byte_texts(batch), batch.column("lang").to_pylist()):
            by.setdefault(lang, []).extend(words(text))
        for lang, found in by.items():
            if found:
                sums_ = np.bincount(trigrams(found)[0], minlength=BUCKETS)
                hit = np.flatnonzero(sums_)
                out["lang"] += [lang] * len(hit)
                out["bucket"] += hit.tolist()
                out["n"] += sums_[hit].tolist()
        return out

    sums = map_texts(chosen.select("text", "lang"), kernel, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts = {lang: np.zeros(BUCKETS, np.int64) for lang in sizes}
    for r in sums.toLocalIterator():
        counts[r.lang][r.bucket] = r.n
    return Model(counts)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (its proportion), languages (the set, most first). A null text or one without letters,
    or a model without languages, gives `und` and zero."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # languages x BUCKETS floats

    def kernel(batch, made):
        langs = made.langs
        raw = batch.column("text").to_pylist()
        split = [words(t.encode("utf-8")) if langs and _LETTER.search(t) else [] for t in raw]
        index = {w: i for i, w in enumerate({w for s in split for w in s})}
        like = made.word_likelihoods(list(index)) if index else None
        out: dict = {"doc_id": batch.column("doc_id"), "lang_pred": [], "score": [], "languages": []}
        for s in split:
            if not s:
                pred, score, among = UNKNOWN, 0.0, ""
            else:
                rows, count = np.unique(np.fromiter(map(index.__getitem__, s), np.int64, len(s)), return_counts=True)
                chosen, share, _ = infer(like[rows], count.astype(np.float64))
                order = sorted(range(len(chosen)), key=lambda i: (-share[i], chosen[i]))
                pred, score, among = langs[chosen[order[0]]], float(min(1.0, share[order[0]])), ",".join(langs[chosen[i]] for i in order)
            out["lang_pred"].append(pred)
            out["score"].append(score)
            out["languages"].append(among)
        return out

    return map_texts(texts(docs, id_col, text_col), kernel, "doc_id long, lang_pred string, score double, languages string", lambda: sent.value)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, learn(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "languages")
