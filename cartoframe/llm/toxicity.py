"""Toxicity by averaged subword embeddings under a linear softmax.

Every word is a bag of character n-grams (with word bounds), hashed into a fixed
table of embeddings.  A document is the average of its words'
bags; a linear softmax gives the class.  Embeddings and softmax are trained
jointly in numpy on a bounded sample of labelled rows, so an unseen misspelling
shares the vectors of its n-grams.

A trained model is linear in the averages, so each n-gram has one number: the
difference of the two classes' logits.  Scoring a document is one lookup per
n-gram, over arrays of code points, without a Python object per word.

Defined cases: null and empty texts, or texts without words, score the bias
alone (how often label 1 occurs).  Rows with several labels count as toxic if any
label says so; rows that share an id count once in the sample.  Without labelled
texts of both classes every score is the share of toxic labels (0 if there are
none).  Long texts are read whole, in fits and scores, PIECE words at a time.
Rows are scored one by one, repeated ones too; an empty table gives an empty
result.  Extra columns stay; columns named like a result are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartoframe.llm.sampling import Sample

#: Labelled rows that are fitted at most, of label 1 and (twice as many) of label 0.
SAMPLE_ROWS = 1000
BUCKETS, DIM, MIN_N, MAX_N = 1 << 17, 8, 3, 5
#: Words whose n-grams are in memory at once.
PIECE = 20_000

_WORDS = re.compile(r"[^\W_]+").findall


def words_of(text: str | None) -> list[str]:
    return _WORDS(text.lower()) if text else []


def ngrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word number) of every n-gram of some words."""
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    points = np.frombuffer(f"<{'><'.join(words)}>".encode("utf-32-le"), np.uint32)
    owner = np.cumsum(points == ord("<"), dtype=np.int32) - 1
    hashed, buckets, owners = points, [], []
    with np.errstate(over="ignore"):
        for n in range(2, MAX_N + 1):
            hashed = hashed[:-1] * np.uint32(0x9E3779B1) + points[n - 1 :]
            if n >= MIN_N:
                inside = owner[: len(hashed)] == owner[n - 1 :]
                h = hashed[inside] + np.uint32(n)
                h ^= h >> np.uint32(15)
                h *= np.uint32(0x85EBCA6B)
                buckets.append(((h ^ (h >> np.uint32(13))) & np.uint32(BUCKETS - 1)).astype(np.int32))
                owners.append(owner[: len(hashed)][inside])
    return np.concatenate(buckets), np.concatenate(owners)


def pieces(words: list[str]) -> Iterator[list[str]]:
    for i in range(0, len(words), PIECE):
        yield words[i : i + PIECE]


@dataclass
class Model:
    """weight: a number for each bucket; bias: the logit of a text without words."""

    weight: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        words, z = words_of(text), self.bias
        for own in pieces(words):
            bucket, owner = ngrams(own)
            z += float((np.bincount(owner, self.weight[bucket], len(own)) / np.bincount(owner, minlength=len(own))).sum()) / len(words)
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def _bags(texts: list[str], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, weights, bounds, document counts) of the texts' averaged bags; buckets in fewer than `least` texts are left out."""
    cols, weights = [], []
    for text in texts:
        words, parts = words_of(text), []
        for own in pieces(words):
            bucket, owner = ngrams(own)
            share = (1 / np.bincount(owner, minlength=len(own)) / len(words))[owner]
            index, at = np.unique(bucket, return_inverse=True)
            parts.append((index, np.bincount(at, share, len(index))))
        if len(parts) > 1:
            index, at = np.unique(np.concatenate([i for i, _ in parts]), return_inverse=True)
            parts = [(index, np.bincount(at, np.concatenate([w for _, w in parts]), len(index)))]
        index, share = parts[0] if parts else (np.zeros(0, np.int32), np.zeros(0))
        cols.append(index.astype(np.int32))
        weights.append(share.astype(np.float32))
    frequency = np.zeros(BUCKETS, np.int64)
    for c in cols:
        frequency[c] += 1
    bounds = np.cumsum([0, *(int((frequency[c] >= least).sum()) for c in cols)])
    all_cols, all_weights = np.empty(bounds[-1], np.int32), np.empty(bounds[-1], np.float32)
    for k in range(len(cols)):
        keep = frequency[cols[k]] >= least
        all_cols[bounds[k] : bounds[k + 1]], all_weights[bounds[k] : bounds[k + 1]] = cols[k][keep], weights[k][keep]
        cols[k] = weights[k] = None
    return all_cols, all_weights, bounds, frequency


def train(texts: list[str], labels: list[int], steps: int = 280, rate: float = 0.3, decay: float = 3e-4, dropout: float = 0.3, scale: float = 60.0, seed: int = 1, prior: float | None = None) -> Model:
    """Joint gradient descent (Adagrad, weight decay, dropout of n-grams) over embeddings and softmax.

    An n-gram's share of a text is weighted with the logarithm of its inverse
    document frequency; n-grams in very few texts are left out.  `prior` is the
    share of label 1 where it differs from the sample's.
    """
    y = np.array(labels, np.int64)
    share = float(y.mean()) if len(y) else 0.0
    if share in (0.0, 1.0):
        p = min(max(share if prior is None else prior, 1e-9), 1 - 1e-9)
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(p / (1 - p))))
    least = max(2, round(len(y) / 180))
    cols, weights, bounds, frequency = _bags(texts, least)
    rng = np.random.default_rng(seed)
    used = np.flatnonzero(frequency >= least)
    place = np.zeros(BUCKETS, np.int32)
    place[used] = np.arange(len(used))
    cols = place[cols]
    idf = (np.log(len(y) / np.maximum(1, frequency[used])) + 1).astype(np.float32) * np.float32(scale)
    weights *= idf[cols]
    emb = rng.uniform(-1 / DIM, 1 / DIM, (len(used), DIM)).astype(np.float32)
    soft, bias = np.zeros((DIM, 2)), np.zeros(2)
    g_emb, g_soft, g_bias = np.full(len(used), 1e-6), np.full((DIM, 2), 1e-6), np.full(2, 1e-6)
    epochs = max(2, round(steps * 64 / len(y)))
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        step = rate * (1 - epoch / epochs)
        for s in range(0, len(order), 64):
            rows = order[s : s + 64]
            at = np.concatenate([np.arange(bounds[r], bounds[r + 1]) for r in rows])
            row = np.repeat(np.arange(len(rows)), bounds[rows + 1] - bounds[rows])
            stay = rng.random(len(at)) >= dropout
            at, row = at[stay], row[stay]
            c, w = cols[at], weights[at] / (1 - dropout)
            vec = w[:, None] * emb[c]
            hidden = np.stack([np.bincount(row, vec[:, d], len(rows)) for d in range(DIM)], 1)
            z = hidden @ soft + bias
            z -= z.max(1, keepdims=True)
            prob = np.exp(z)
            prob /= prob.sum(1, keepdims=True)
            prob[np.arange(len(rows)), y[rows]] -= 1
            prob /= len(rows)
            d_hidden = prob @ soft.T
            d_soft = hidden.T @ prob + 1e-5 * soft
            index, inv = np.unique(c, return_inverse=True)
            push = w[:, None] * d_hidden[row]
            d_emb = np.stack([np.bincount(inv, push[:, d], len(index)) for d in range(DIM)], 1) + decay * emb[index]
            g_emb[index] += (d_emb**2).mean(1)
            emb[index] -= step * d_emb / np.sqrt(g_emb[index])[:, None]
            g_soft += d_soft**2
            soft -= step * d_soft / np.sqrt(g_soft)
            d_bias = prob.sum(0)
            g_bias += d_bias**2
            bias -= step * d_bias / np.sqrt(g_bias)
    weight = np.zeros(BUCKETS, np.float32)
    weight[used] = (emb @ (soft[:, 1] - soft[:, 0])) * idf
    base = float(bias[1] - bias[0])
    if prior is not None:
        base += float(np.log(prior / (1 - prior)) - np.log(share / (1 - share)))
    return Model(weight, base)


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fits at most `rows` documents of label 1 and twice as many of label 0, whole texts, those of least hash of the id."""
    marked = labels.where(f"{id_col} is not null and {label_col} in (0, 1)").groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    total = {r.label: r.n for r in marked.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not total:
        return Model(np.zeros(BUCKETS, np.float32), -40.0)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    sample = Sample(marked.join(texts.select("id"), "id", "left_semi"), lambda y: rows * (2 - y))
    found = sample.texts(texts.join(F.broadcast(sample.near), "id"))  # a few thousand ids
    prior = total.get(1, 0) / sum(total.values())
    return train([t for _, _, t in found], [y for y, _, _ in found], prior=prior if 0 < prior < 1 else None)


def score_toxicity(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """`docs` with score and predicted (1 from the threshold on); columns of these names are replaced."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers
    keep = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    schema = docs.select(*keep).schema.add("score", "double")
    at, names = keep.index(text_col), [*keep, "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = sent.value.score
        for batch in batches:
            scores = [score(t.as_py()) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names)

    return docs.select(*keep).mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def is_held_out(id_col: str = "doc_id"):
    """Rows of the fold that is not learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned outside the held-out fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~is_held_out())
    return score_toxicity(docs, fit(docs, labels), 0.3).select("doc_id", is_held_out().alias("held_out"), "score", "predicted")
