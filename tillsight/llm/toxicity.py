"""Toxic texts by a small convolutional network over hashed word embeddings, trained in numpy.

A word is the sum of three embeddings: of itself and of its first four and five
bytes, hashed into one table, so that unseen forms of a stem are known by the
stem. Filters of widths one to three slide over the words of the whole text; the
largest response of each filter goes to a logistic output. The first components of
the embeddings start as the log odds of a toxic text, given the word, over the
training rows; all weights are then trained together by Adagrad.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillsight.llm import words as W

#: Labelled rows that the network is trained on at most, those with the smallest key hashes.
SAMPLE = 8_000
SLOTS = 1 << 16
SIZE = 6
FILTERS = 6
WIDTHS = (1, 2, 3)
EPOCHS = 3
THRESHOLD = 0.3
_PREFIXES = (4, 5)


def word_slots(words: W.Words) -> np.ndarray:
    """Table slots of every word: itself and its prefixes."""
    return np.stack([(h >> np.uint64(20)).astype(np.int64) % SLOTS for h in words.hashes(*_PREFIXES)], axis=1)


@dataclass
class Network:
    embed: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: float

    @classmethod
    def start(cls, odds: np.ndarray, seed: int = 0) -> Network:
        rng = np.random.default_rng(seed)
        embed = rng.normal(0, 0.01, (SLOTS, SIZE)).astype(np.float32)
        embed[:, 0] += odds
        filters = [rng.normal(0, 0.1, (w * SIZE, FILTERS)).astype(np.float32) for w in WIDTHS]
        for f in filters:
            f[::SIZE, 0] += 1 / np.sqrt(len(f) / SIZE)
        total = FILTERS * len(WIDTHS)
        return cls(embed, filters, np.zeros(total, np.float32), np.full(total, 0.1, np.float32), -2.0)

    def responses(self, slots: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The filters at every word (rows), and the word windows they have seen."""
        vectors = self.embed[slots].sum(axis=1)
        padded = np.vstack([vectors, np.zeros((max(WIDTHS) - 1, SIZE), np.float32)])
        seen = [
            vectors if w == 1 else np.hstack([padded[i : i + len(vectors)] for i in range(w)]) for w in WIDTHS
        ]
        return np.hstack([s @ f for s, f in zip(seen, self.filters)]) + self.bias, seen

    def logits(self, words: W.Words) -> np.ndarray:
        """One number per text of a block; filters do not see across texts."""
        slots, bounds = word_slots(words), words.bounds
        n = len(bounds) - 1
        total = len(self.out)
        pooled = np.zeros((n, total), np.float32)
        if len(slots):
            vectors = self.embed[slots].sum(axis=1)
            left = words.bounds[1:][words.owner()] - np.arange(len(slots))  # words to the end of the text
            filled = np.flatnonzero(np.diff(bounds))
            for k, (w, f) in enumerate(zip(WIDTHS, self.filters)):
                response = vectors @ f[:SIZE]
                for i in range(1, w):
                    shifted = np.zeros_like(vectors)
                    shifted[:-i] = vectors[i:]
                    shifted[left <= i] = 0
                    response += shifted @ f[i * SIZE : (i + 1) * SIZE]
                part = slice(k * FILTERS, (k + 1) * FILTERS)
                pooled[filled, part] = np.maximum.reduceat(response, bounds[filled]) + self.bias[part]
        return np.maximum(pooled, 0) @ self.out + self.out_bias


def presence_odds(docs: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Shrunk log odds of label 1 for a text that holds a slot."""
    counts = np.zeros((2, SLOTS))
    for slots, label in zip(docs, y):
        counts[int(label), np.unique(slots)] += 1
    rate = (y.sum() + 1) / (len(y) + 2)
    odds = np.log((counts[1] + 3 * rate) / (counts[0] * rate / (1 - rate) + 3 * rate))
    return np.clip(odds, -1, 3).astype(np.float32)


def train(texts: list[str], y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.03, seed: int = 0) -> Network:
    """Adagrad, text by text in a fixed random order. One class only, or no rows: the smoothed rate for every text."""
    docs: list[np.ndarray] = []
    for _, _, data, offsets in W.text_blocks(pa.array(texts, pa.string())):
        words = W.split(data, offsets, W.ALPHANUMERIC)
        slots = word_slots(words)
        docs += [slots[a:z].astype(np.int32) for a, z in zip(words.bounds, words.bounds[1:])]
    share = (y.sum() + 1) / (len(y) + 2)
    if not 0 < y.sum() < len(y):
        net = Network.start(np.zeros(SLOTS, np.float32), seed)
        net.out[:], net.out_bias = 0, float(np.log(share / (1 - share)))
        return net
    net = Network.start(presence_odds(docs, y), seed)
    sums = [np.full_like(p, 1e-2) for p in (net.embed, *net.filters, net.bias, net.out)]
    bias_sum, rng = 1e-2, np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            slots = docs[i]
            if not len(slots):
                logit, pooled = net.out_bias, np.zeros(len(net.out), np.float32)
            else:
                response, seen = net.responses(slots)
                at = response.argmax(axis=0)
                pooled = np.maximum(response[at, np.arange(len(at))], 0)
                logit = pooled @ net.out + net.out_bias
            error = 1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[i]
            bias_sum += error**2
            back = np.where(pooled > 0, error * net.out, 0).astype(np.float32)
            step = error * pooled
            sums[-1] += step**2
            net.out -= rate * step / np.sqrt(sums[-1])
            net.out_bias -= rate * error / np.sqrt(bias_sum)
            if not len(slots):
                continue
            sums[-2] += back**2
            net.bias -= rate * back / np.sqrt(sums[-2])
            touched, grads = [], []
            for k, w in enumerate(WIDTHS):
                part = slice(k * FILTERS, (k + 1) * FILTERS)
                places, g = at[part], back[part]
                filters = net.filters[k]
                grad = seen[k][places].T * g[None, :]
                down = filters * g[None, :]
                for j in range(w):
                    inside = places + j < len(slots)
                    touched.append(slots[places[inside] + j])
                    grads.append(down[j * SIZE : (j + 1) * SIZE, inside].T)
                sums[1 + k] += grad**2
                filters -= rate * grad / np.sqrt(sums[1 + k])
            rows, grad = np.concatenate(touched), np.concatenate(grads)
            rows, grad = rows.ravel(), np.repeat(grad, rows.shape[1], axis=0)
            np.add.at(sums[0], rows, grad**2)
            np.add.at(net.embed, rows, -rate * grad / np.sqrt(sums[0][rows]))
    return net


def held_out(key: Column, text_mod: int = 4, rest: int = 2) -> Column:
    """Whether the checksum of the key, as text, leaves the rest that is kept from training. A null key is not held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % text_mod == rest, F.lit(False))


def train_on(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE
) -> Network:
    """Train on ``sample`` labelled rows at most that are not held out; rows without key or label are left out."""
    truth = labels.select(F.col(key).alias("__key"), F.col(label).cast("int").alias("__label")).dropna()
    chosen = (
        truth.where(~held_out(F.col("__key")))
        .groupBy("__key")
        .agg(F.max("__label").alias("__label"))
        .orderBy(F.xxhash64("__key"), "__key")
        .limit(sample)
    )
    # ids and labels of a bounded sample: a few hundred kilobytes
    rows = docs.select(F.col(key).alias("__key"), F.col(text).cast("string").alias("__text")).join(
        F.broadcast(chosen), "__key"
    )
    table = rows.orderBy(F.xxhash64("__key"), "__key", "__text").limit(sample).toArrow()
    return train(table.column("__text").to_pylist(), np.asarray(table.column("__label"), float))


def score_texts(docs: DataFrame, network: Network, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``carry`` (default: all but the text) and ``score``, from 0 to 1; null, empty and wordless texts get the score of no words."""
    names = carry or [c for c in docs.columns if c not in (text, "score")]
    kept = docs.select(*dict.fromkeys([*names, text]))
    schema = T.StructType([*docs.select(*names).schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, stop, data, offsets in W.text_blocks(batch.column(text)):
                logits = network.logits(W.split(data, offsets, W.ALPHANUMERIC)).astype(float)
                score = 1 / (1 + np.exp(-np.clip(logits, -30, 30)))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(first, stop - first) for c in names), pa.array(score)], [*names, "score"]
                )

    return kept.mapInArrow(run, schema)


def language_thresholds(
    scored: DataFrame, labels: DataFrame, key: str = "doc_id", lang: str = "lang", label: str = "toxic", least: int = 20
) -> DataFrame:
    """``(lang, threshold)``: the hundredth of the score with the best F1 over the labelled rows that are not held out.

    Languages with fewer than ``least`` toxic rows get ``THRESHOLD``. Null is a language.
    """
    truth = labels.select(F.col(key).alias("__key"), F.col(label).cast("int").alias("__label")).dropna()
    known = scored.join(truth.where(~held_out(F.col("__key"))), scored[key] == truth["__key"])
    steps = known.groupBy(F.col(lang).alias("lang"), F.floor(F.col("score") * 100).alias("step")).agg(
        F.sum("__label").alias("pos"), F.count(F.lit(1)).alias("n")
    )
    # at most 101 steps a language
    above = Window.partitionBy("lang").orderBy(F.desc("step"))
    best = steps.select(
        "lang",
        (F.col("step") / 100).alias("threshold"),
        F.sum("pos").over(Window.partitionBy("lang")).alias("all_pos"),
        (2 * F.sum("pos").over(above) / (F.sum("n").over(above) + F.sum("pos").over(Window.partitionBy("lang")))).alias("f1"),
    )
    return best.groupBy("lang").agg(
        F.when(F.max("all_pos") >= least, F.max_by("threshold", "f1")).otherwise(F.lit(THRESHOLD)).alias("threshold")
    )
