"""Toxicity: averaged vectors of words and their parts under a linear softmax, both trained together in numpy."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm.common import map_texts, stored

BUCKETS = 1 << 17
DIM = 8
PARTS = (3, 4, 5)
#: Labelled documents that the model learns from, of each class, about and at most.
SAMPLE_DOCS = 3_000
EPOCHS = 150
RATE = 0.05
#: The average is scaled up by this much before the softmax: a text may be toxic by one word in a thousand.
GAIN = 100.0
#: A bucket gets a vector if its share of documents differs between the classes by this many standard errors. Some 130,000
#: buckets are looked at, so that about one is kept by chance; the others would only learn single documents by heart.
MIN_Z = 4.5
DECAY = 1e-6
CACHE_WORDS = 300_000

_WORDS = re.compile(r"\w+").findall


def buckets_of(word: str) -> list[int]:
    """Buckets of a word: its own and one for each run of 3 to 5 characters, with its ends marked."""
    mask, crc, marked = BUCKETS - 1, zlib.crc32, f"<{word}>"
    out = [crc(b"=" + word.encode()) & mask]
    for n in PARTS:
        out += [crc(marked[i : i + n].encode()) & mask for i in range(len(marked) - n + 1)]
    return out


class _Parts(dict):
    def __missing__(self, word: str) -> list[int]:
        found = self[word] = buckets_of(word)
        return found


def bag(text: str, parts: dict) -> tuple[np.ndarray, np.ndarray]:
    """The text as (bucket, weight): each word weighs the same, and so do the parts within a word."""
    counts: dict[str, int] = {}
    for word in _WORDS(text.lower()):
        counts[word] = counts.get(word, 0) + 1
    if not counts:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    lists = [parts[w] for w in counts]
    sizes = np.array([len(x) for x in lists])
    index = np.fromiter((b for x in lists for b in x), np.int32, int(sizes.sum()))
    each = np.array(list(counts.values()), np.float64) / sum(counts.values()) / sizes
    found, inverse = np.unique(index, return_inverse=True)
    return found.astype(np.int32), np.bincount(inverse, np.repeat(each, sizes)).astype(np.float32)


@dataclass
class ToxicityModel:
    """What each bucket adds to the log odds (a product of its vector and the softmax weights), and their start."""

    adds: np.ndarray
    bias: float


def constant(share: float) -> ToxicityModel:
    """What is left without examples of both classes: everyone gets the share of toxic ones."""
    return ToxicityModel(np.zeros(BUCKETS, np.float32), float(np.log((share + 0.01) / (1.01 - share))))


def train(index: np.ndarray, weight: np.ndarray, ends: np.ndarray, toxic: np.ndarray, share: float, seed: int = 7) -> ToxicityModel:
    """Vectors and softmax weights by Adam on the whole sample at each step.

    Both classes must occur. ``ends`` closes each document's part of ``index`` and ``weight``. Both classes weigh the same while learning; ``share``
    is the real share of toxic documents, and moves the start of the log odds afterwards.
    """
    rng = np.random.default_rng(seed)
    doc = np.repeat(np.arange(len(ends)), np.diff(np.concatenate([[0], ends])))
    n_toxic, n_clean = toxic.sum(), (1 - toxic).sum()
    used, local = np.unique(index, return_inverse=True)
    vectors = rng.normal(0, 0.01, (len(used), DIM)).astype(np.float32)
    softmax = rng.normal(0, 0.3, (DIM, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    truth = np.stack([1 - toxic, toxic], axis=1).astype(np.float32)
    by_class = np.where(toxic == 1, 0.5 / n_toxic, 0.5 / n_clean).astype(np.float32)
    params = [vectors, softmax, bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, EPOCHS + 1):
        mean = GAIN * np.stack([np.bincount(doc, weight * vectors[local, k], minlength=len(ends)) for k in range(DIM)], axis=1)
        logits = mean @ softmax + bias
        logits -= logits.max(axis=1, keepdims=True)
        chance = np.exp(logits)
        chance /= chance.sum(axis=1, keepdims=True)
        error = (chance - truth) * by_class[:, None]
        back = GAIN * (error @ softmax.T)
        grads = [
            np.stack([np.bincount(local, weight * back[doc, k], minlength=len(used)) for k in range(DIM)], axis=1) + DECAY * vectors,
            mean.T @ error + DECAY * softmax,
            error.sum(axis=0),
        ]
        for p, g, m, v in zip(params, grads, first, second):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= (RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    adds = np.zeros(BUCKETS, np.float32)
    adds[used] = GAIN * (vectors @ (softmax[:, 1] - softmax[:, 0]))
    share = min(max(share, 1e-4), 1 - 1e-4)
    return ToxicityModel(adds, float(bias[1] - bias[0] + np.log(share / (1 - share))))


def _telling(bags: DataFrame, n_toxic: int, n_clean: int) -> list[int]:
    """Buckets whose share of documents differs between the classes by at least ``MIN_Z`` standard errors, some of ``BUCKETS``."""
    counts = bags.select("toxic", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"), F.sum("toxic").alias("t"))
    rate = F.col("n") / F.lit(n_toxic + n_clean)
    gap = F.abs(F.col("t") / F.lit(n_toxic) - (F.col("n") - F.col("t")) / F.lit(n_clean))
    error = F.sqrt(rate * (F.lit(1.0) - rate) * F.lit(1 / n_toxic + 1 / n_clean))
    return sorted(r["bucket"] for r in counts.where((rate < 1) & (gap >= F.lit(MIN_Z) * error)).select("bucket").collect())


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Learn from labelled documents (label 0 or 1; others and missing texts are left out), a bounded sample of each class.

    The sample is drawn from the labels, so texts are not shuffled. Bags are made and the telling buckets are found in Spark; the driver
    gets only those buckets of each sampled document, and trains on them. An id that is labelled more than once counts as toxic if one label says so.
    """
    marks = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    marks = marks.groupBy(F.col(id_col).cast("bigint").alias("id")).agg(F.max(label_col).cast("bigint").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if set(sizes) != {0, 1}:
        return constant(float(set(sizes) == {1}))
    share = F.when(F.col("toxic") == 1, min(1.0, SAMPLE_DOCS / sizes[1])).otherwise(min(1.0, SAMPLE_DOCS / sizes[0]))
    chosen = marks.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share * 1_000_000)
    # About 2 * SAMPLE_DOCS ids at most, by the shares above.
    sample = docs.where(F.col(text_col).isNotNull()).join(F.broadcast(chosen), F.col(id_col) == F.col("id")).select("toxic", F.col(text_col).alias("text"))

    def make():
        def run(texts: list) -> list:
            known = _Parts()
            bags = [bag(t, known) for t in texts]
            return [[i for i, _ in bags], [w for _, w in bags]]

        return run

    fields = [("buckets", "array<int>", pa.list_(pa.int32())), ("weights", "array<float>", pa.list_(pa.float32()))]
    bags = stored(map_texts(sample, "toxic", "text", make, fields).withColumnRenamed("doc_id", "toxic"), "bags")
    seen = {r["toxic"]: r["n"] for r in bags.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if set(seen) != {0, 1}:
        return constant(sizes[1] / (sizes[0] + sizes[1]))
    telling = np.array(_telling(bags, seen[1], seen[0]), np.int32)

    def pick(batches):
        for batch in batches:
            rows = []
            for index, weight in zip(batch.column(1), batch.column(2)):
                index, weight = index.values.to_numpy(zero_copy_only=False), weight.values.to_numpy(zero_copy_only=False)
                keep = np.isin(index, telling)
                rows.append((index[keep].tobytes(), weight[keep].tobytes()))
            columns = [pa.array(c, pa.binary()) for c in (zip(*rows) if rows else ((), ()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["toxic", "buckets", "weights"])

    got = bags.select("toxic", "buckets", "weights").mapInArrow(pick, "toxic bigint, buckets binary, weights binary").collect()
    # A fixed order, so that sums and with them the model do not depend on which task came first.
    got.sort(key=lambda r: (r["toxic"], bytes(r["buckets"]), bytes(r["weights"])))
    index = [np.frombuffer(r["buckets"], np.int32) for r in got]
    weight = [np.frombuffer(r["weights"], np.float32) for r in got]
    ends, toxic = np.cumsum([len(x) for x in index]), np.array([r["toxic"] for r in got])
    return train(np.concatenate(index), np.concatenate(weight), ends, toxic, sizes[1] / (sizes[0] + sizes[1]))


class _Adds(dict):
    """What each word adds: the mean over its parts."""

    def __init__(self, model: ToxicityModel):
        self.table = model.adds.tolist()

    def __missing__(self, word: str) -> float:
        table, found = self.table, buckets_of(word)
        self[word] = value = sum([table[b] for b in found]) / len(found)
        return value


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 from 0.5) of every whole text.

    A missing text, or one without words, gets the score that the model starts from. Other columns are not read; repeated
    rows give equal results; an empty table gives no rows. The model is a table of ``BUCKETS`` numbers (0.5 MB), sent to each executor once. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        bias = shared.value.bias
        adds = _Adds(shared.value)

        def run(texts: list) -> list:
            scores = []
            for text in texts:
                words = _WORDS(text.lower()) if text else []
                odds = bias + (sum(map(adds.__getitem__, words)) / len(words) if words else 0.0)
                scores.append(1.0 / (1.0 + np.exp(-max(-60.0, min(60.0, odds)))))
                if len(adds) > CACHE_WORDS:
                    adds.clear()
            return [scores, [int(s >= 0.5) for s in scores]]

        return run

    return map_texts(docs, id_col, text_col, make, [("score", "double", pa.float64()), ("predicted", "int", pa.int32())])
