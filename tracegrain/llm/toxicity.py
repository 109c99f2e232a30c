"""Toxicity by multiple-instance learning: a document is a bag of sentences, and only documents have labels.

A sentence's probability is a logistic function of its words' features (the word and its prefixes, hashed);
the document's is their noisy-or, 1 - prod(1 - p). Gradients of the document's likelihood reach the sentences
through the noisy-or, so the offending ones are found although none was ever labelled.

A document is the set of its sentences that hold a word: what is repeated is no further evidence. In scoring, only
sentences of FLOOR and more enter the noisy-or, else sheer length would make a clean text toxic; without any, the
score is the largest sentence's.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, byte_texts, held_out, map_texts, release, small_batches, texts, trim

#: Hashed feature space; the model is this many floats, whatever the input.
DIMS = 1 << 18
#: Logit of a sentence without evidence, the probability from which a sentence counts in a document's score, and how
#: much more a toxic document weighs in training than another.
BIAS, FLOOR, WEIGHT = -8.0, 0.1, 3.0
#: Documents of each label that the model is fitted on at most (the smallest hashes of doc_id).
SAMPLE = {1: 2000, 0: 3000}

_TABLE = bytearray(range(256))
for _c in range(0x80):
    if chr(_c).isupper():
        _TABLE[_c] = _c + 32
    elif chr(_c) in ".!?\n":
        _TABLE[_c] = 10
    elif not chr(_c).isalnum():
        _TABLE[_c] = 32
_TABLE = bytes(_TABLE)


def sentences(text: bytes) -> list[bytes]:
    """Sentences in lower case without punctuation; `.`, `!`, `?` and line breaks end one."""
    return text.translate(_TABLE).split(b"\n")


def features(word: bytes) -> list[int]:
    """Hashed features: the word, and its prefixes of 3 to 8 bytes."""
    keys = [b"w" + word, *(b"p" + word[:n] for n in range(3, 9) if len(word) >= n)]
    return [xxhash.xxh3_64_intdigest(k) % DIMS for k in keys]


@dataclass
class Model:
    weights: np.ndarray
    bias: float = BIAS

    def word_scores(self) -> Memo:
        weights = self.weights

        def score(word: bytes) -> float:
            return float(weights[features(word)].sum())

        return Memo(score, 300_000)


def bag_probability(z: np.ndarray) -> float:
    """Noisy-or of sentences with logits ``z``: 1 - exp(-sum log(1 + e^z))."""
    return float(-np.expm1(-np.logaddexp(0.0, z).sum()))


def instances(text: bytes) -> list[set[bytes]]:
    """The words of each distinct sentence that has any."""
    return [p for s in dict.fromkeys(sentences(text)) if (p := set(s.split()))]


def document_score(text: bytes, memo: Memo) -> float:
    """Noisy-or of the sentences that are FLOOR likely and more, or the largest of the others; without a word as low as
    a sentence without evidence. It does not grow with the number of clean sentences."""
    get = memo.__getitem__
    z = np.array([sum(map(get, words)) for words in instances(text)] or [0.0]) + BIAS
    strong = z[z >= np.log(FLOOR / (1.0 - FLOOR))]
    return min(1.0, bag_probability(strong if len(strong) else z.max(keepdims=True)))


def fit(bags: list[tuple[bytes, int]], epochs: int = 12, rate: float = 0.5, least: int = 3, decay: float = 1e-4) -> Model:
    """Adagrad on the documents' log-likelihood under noisy-or. Features in fewer than ``least`` documents are left out.

    Without documents of both labels, every weight is zero and every score next to zero.
    """
    weights = np.zeros(DIMS, np.float64)
    if len({y for _, y in bags}) < 2:
        return Model(weights.astype(np.float32))
    memo = Memo(lambda w: np.array(features(w), np.int32), 100_000)
    seen = np.zeros(DIMS, np.int32)
    docs = []
    for text, y in bags:
        if parts := [np.concatenate([memo[w] for w in p]) for p in instances(text)]:
            ids = np.concatenate(parts)
            seen[np.unique(ids)] += 1
            docs.append((ids, np.repeat(np.arange(len(parts), dtype=np.int32), list(map(len, parts))), len(parts), y))
    del memo
    used = np.flatnonzero(seen >= least)  # training knows these features only, by their places here
    place = np.full(DIMS, -1, np.int32)
    place[used] = np.arange(len(used), dtype=np.int32)
    docs = [(place[ids][keep], at[keep], n, y) for ids, at, n, y in docs for keep in [place[ids] >= 0]]
    own, square = np.zeros(len(used)), np.full(len(used), 1e-2)
    order = np.random.RandomState(7)
    for _ in range(epochs):
        turn = order.permutation(len(docs))
        for start in range(0, len(turn), 32):
            batch = [docs[k] for k in turn[start : start + 32]]
            sizes = np.array([n for _, _, n, _ in batch])
            begin = np.cumsum(sizes) - sizes
            ids = np.concatenate([x for x, _, _, _ in batch])
            at = np.concatenate([x + k for (_, x, _, _), k in zip(batch, begin)])
            z = BIAS + np.bincount(at, own[ids], sizes.sum())
            whole = -np.expm1(-np.add.reduceat(np.logaddexp(0.0, z), begin))
            slope = np.where([y for _, _, _, y in batch], -WEIGHT * (1.0 - whole) / np.maximum(whole, 1e-9), 1.0)
            p = np.repeat(slope, sizes) / (1.0 + np.exp(-np.clip(z, -50, 50)))
            hit = np.bincount(ids, minlength=len(used)) > 0
            grad = np.bincount(ids, p[at], len(used))[hit] + decay * own[hit]
            square[hit] += grad * grad
            own[hit] -= rate * grad / np.sqrt(square[hit])
    weights[used] = own
    return Model(weights.astype(np.float32))


def training_sample(docs: DataFrame, labels: DataFrame, sample: dict[int, int] | None = None) -> DataFrame:
    """(doc_id, text, y): at most ``sample[y]`` documents of each label, those with the smallest hashes of the id; none of
    the held-out fold."""
    known = labels.where(F.col("toxic").isNotNull() & ~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("y"))
    ids = None
    for y, most in (sample or SAMPLE).items():
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("doc_id", "y")
        ids = part if ids is None else ids.union(part)
    return texts(docs).join(F.broadcast(ids), "doc_id").dropDuplicates(["doc_id"])  # as many ids as the samples have


def train(docs: DataFrame, labels: DataFrame, sample: dict[int, int] | None = None) -> Model:
    """Fit on the bounded sample in one task; the driver gets the weights only."""

    def run(batches):
        import pyarrow as pa

        release()
        rows = [x for b in batches for x in zip(b.column("doc_id").to_pylist(), byte_texts(b), b.column("y").to_pylist())]
        model = fit([(text, int(y)) for _, text, y in sorted(rows)])
        del rows
        trim()
        yield pa.RecordBatch.from_pydict({"weights": pa.array([model.weights.tobytes()], pa.binary())})

    (row,) = training_sample(docs, labels, sample).repartition(1).mapInArrow(run, "weights binary").collect() or [None]
    return Model(np.frombuffer(row.weights, np.float32) if row else np.zeros(DIMS, np.float32))


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1). An empty or null text scores next to zero; one pass, no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # DIMS floats, whatever the input

    def kernel(batch, memo):
        return {"doc_id": batch.column("doc_id"), "score": [document_score(text, memo) for text in byte_texts(batch)]}

    return map_texts(texts(docs, id_col, text_col), kernel, "doc_id long, score double", lambda: sent.value.word_scores())


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text scores under ``threshold``."""
    import pyarrow as pa

    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        release()
        memo = sent.value.word_scores()
        for batch in batches:
            keep = [document_score(text or b"", memo) < threshold for text in byte_texts(batch, text_col)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def locate(docs: DataFrame, model: Model, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The offending sentences: doc_id, sentence (number from 0), start and length in bytes, probability >= ``least``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def kernel(batch, memo):
        out: dict = {k: [] for k in ("doc_id", "sentence", "start", "length", "probability")}
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), byte_texts(batch)):
            start = 0
            for n, s in enumerate(sentences(text)):
                p = 1.0 / (1.0 + np.exp(-(BIAS + sum(map(memo.__getitem__, set(s.split()))))))
                if p >= least:
                    for k, v in zip(out, (doc_id, n, start, len(s), float(p))):
                        out[k].append(v)
                start += len(s) + 1
        return out

    return map_texts(texts(docs, id_col, text_col), kernel, "doc_id long, sentence int, start int, length int, probability double", lambda: sent.value.word_scores())


def learned(spark: SparkSession, sf_dir: str) -> Model:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_toxicity(spark: SparkSession, sf_dir: str, threshold: float = 0.7) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = score_documents(docs, learned(spark, sf_dir))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
