"""Document quality by hierarchical empirical Bayes.

A logistic classifier over surface features gives each document's own evidence.
The scores are summed by host and by path within the host; the variance between
sites, against that within them, says how much a site's mean is worth. Sparse sites
are shrunk towards the level above: paths towards their host, hosts towards the
whole corpus. A document's score joins its own evidence with the odds of its site,
to which it does not contribute itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillsight.llm import words as W
from tillsight.plans.materialize import materialize

#: Labelled documents that the classifier is fitted on at most, those with the smallest key hashes.
SAMPLE = 20_000
THRESHOLD = 0.5

#: Bytes whose shares of a text are features.
CLASSES = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "!?", "%$&#*", "|<>{}[]=_~^\\/", ".,;:'\"-()", "\n"]


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of numbers per text; a text without words has zeros."""
    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1)
    lookup = np.full(256, len(CLASSES), np.int64)
    for k, chars in enumerate(CLASSES):
        lookup[list(chars.encode())] = k
    width = len(CLASSES) + 1
    owner = np.repeat(np.arange(n), np.diff(offsets))
    shares = np.bincount(owner * width + lookup[data], minlength=n * width).reshape(n, width)[:, :-1] / size[:, None]
    words = W.split(data, offsets, W.NON_SPACE)
    counts = words.counts
    hashes, of = words.hashes()[0], words.owner()
    some = np.maximum(counts, 1)
    length = np.bincount(of, words.ends - words.starts, n) / some
    echo = np.zeros(len(hashes), bool)
    echo[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    different = np.bincount(W.distinct(of, hashes)[0], minlength=n)
    short = np.bincount(of[words.ends - words.starts <= 2], minlength=n) / some
    out = np.column_stack(
        [
            np.sqrt(shares),
            np.log1p(counts),
            np.minimum(length, 50),
            np.sqrt(np.bincount(of[echo], minlength=n) / some),
            1 - different / some,
            short,
        ]
    )
    out[counts == 0] = 0
    return out


N_FEATURES = len(CLASSES) + 5


def document_features(docs: DataFrame, carry: list[str], text: str = "text") -> DataFrame:
    """The columns ``carry`` of ``docs`` and an array ``__features``."""
    read = list(dict.fromkeys([*carry, text]))
    schema = T.StructType([*docs.select(*carry).schema.fields, T.StructField("__features", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, stop, data, offsets in W.text_blocks(batch.column(text)):
                n = stop - first
                values = pa.array(features(data, offsets).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * N_FEATURES), values)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(first, n) for c in carry), lists], [*carry, "__features"]
                )

    return docs.select(*read).mapInArrow(run, schema)


@dataclass
class Logistic:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def logit(self, values: Column) -> Column:
        total = F.lit(float(self.bias))
        for i, (m, s, w) in enumerate(zip(self.mean, self.scale, self.weights)):
            total = total + (values[i] - F.lit(float(m))) * F.lit(float(w / s))
        return F.greatest(F.lit(-12.0), F.least(F.lit(12.0), total))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> Logistic:
    """Ridge logistic regression by Newton's method; with one class or no rows, the smoothed rate of that class."""
    width = x.shape[1]
    mean, scale = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(x) else (np.zeros(width), np.ones(width))
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    rate = (y.sum() + 1) / (len(y) + 2)
    beta = np.zeros(width + 1)
    beta[-1] = np.log(rate / (1 - rate))
    penalty = np.diag([*[ridge] * width, 1e-6])
    for _ in range(steps if 0 < y.sum() < len(y) else 0):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        gradient = z.T @ (y - p) - penalty @ beta
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, gradient)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return Logistic(mean, scale, beta[:-1], float(beta[-1]))


def fit_classifier(
    featured: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", sample: int = SAMPLE
) -> Logistic:
    """Fit on ``sample`` labelled documents at most. Rows without a label or key are left out; repeated labels count once each."""
    truth = labels.select(F.col(key).alias("__key"), F.col(label).cast("double").alias("__label")).dropna()
    rows = (
        featured.join(truth, featured[key] == truth["__key"])
        .select("__key", "__features", "__label")
        .orderBy(F.xxhash64("__key"), "__key", "__label")
        .limit(sample)
        .select("__features", "__label")
        .toArrow()
    )
    x = np.asarray(rows.column("__features").combine_chunks().flatten()).reshape(-1, N_FEATURES)
    return fit_logistic(x, np.asarray(rows.column("__label")))


def _sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def _logit(p: Column) -> Column:
    held = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(held / (F.lit(1.0) - held))


@dataclass
class Shrinkage:
    """Global mean, and the number of documents whose evidence the level above is worth."""

    mean: float
    host: float
    path: float


def site_sums(scored: DataFrame, host: str, path: str) -> DataFrame:
    """``(host, path, n, s, ss)``: documents, sum of scores and of their squares; nulls are a site.

    Stored, so that Spark knows its size when documents are joined with it.
    """
    sums = scored.groupBy(F.col(host).alias("__host"), F.col(path).alias("__path")).agg(
        F.count(F.lit(1)).alias("__n"), F.sum("evidence").alias("__s"), F.sum(F.col("evidence") ** 2).alias("__ss")
    )
    hosts = sums.groupBy(F.col("__host").alias("__h")).agg(F.sum("__n").alias("__hn"), F.sum("__s").alias("__hs"))
    return materialize(sums.join(hosts, F.col("__host").eqNullSafe(F.col("__h"))).drop("__h"))


def shrinkage(sites: DataFrame) -> Shrinkage:
    """Variance components of a two-level random-effects model, by moments, from one aggregate over the sites."""
    hosts = sites.groupBy("__host").agg(
        F.sum("__n").alias("n"),
        F.sum("__s").alias("s"),
        F.sum("__ss").alias("ss"),
        F.sum(F.col("__s") ** 2 / F.col("__n")).alias("paths_ss"),
        F.count(F.lit(1)).alias("paths"),
        F.sum(F.col("__n").cast("double") ** 2).alias("n2"),
    )
    t = hosts.agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.sum("paths_ss").alias("paths_ss"),
        F.sum(F.col("s") ** 2 / F.col("n")).alias("hosts_ss"), F.sum("paths").alias("paths"),
        F.count(F.lit(1)).alias("hosts"), F.sum(F.col("n2") / F.col("n")).alias("n2_in"),
        F.sum(F.col("n").cast("double") ** 2).alias("n2"),
    ).first()
    if not t["n"]:
        return Shrinkage(0.5, 1e12, 1e12)
    n, mean = t["n"], t["s"] / t["n"]
    within = max(t["ss"] - t["paths_ss"], 0.0) / max(n - t["paths"], 1) + 1e-9

    def worth(between: float, groups: float, spread: float) -> float:
        variance = (between - groups * within) / spread if spread > 0 else 0.0
        return within / variance if variance > 1e-9 else 1e12

    return Shrinkage(
        mean,
        worth(t["hosts_ss"] - n * mean * mean, t["hosts"] - 1, n - t["n2"] / n),
        worth(t["paths_ss"] - t["hosts_ss"], t["paths"] - t["hosts"], n - t["n2_in"]),
    )


def combine(scored: DataFrame, sites: DataFrame, prior: Shrinkage, host: str, path: str) -> DataFrame:
    """``scored`` (with ``evidence``) with ``host_rate``, ``path_rate`` and ``quality_score``."""
    sums = sites.drop("__ss")
    own, mean = F.col("evidence"), F.lit(float(prior.mean))
    # without the document itself
    host_rate = (F.col("__hs") - own + F.lit(float(prior.host)) * mean) / (F.col("__hn") - 1 + F.lit(float(prior.host)))
    path_rate = (F.col("__s") - own + F.lit(float(prior.path)) * F.col("host_rate")) / (
        F.col("__n") - 1 + F.lit(float(prior.path))
    )
    return (
        scored.join(
            sums, F.col(host).eqNullSafe(F.col("__host")) & F.col(path).eqNullSafe(F.col("__path")), "left"
        )
        .withColumn("host_rate", host_rate)
        .withColumn("path_rate", path_rate)
        .withColumn("quality_score", _sigmoid(_logit(own) + _logit(F.col("path_rate")) - _logit(mean)))
        .drop("__host", "__path", "__n", "__s", "__hn", "__hs")
    )


@dataclass
class QualityModel:
    """What is learnt from a corpus and its labels; ``score`` applies it to whole documents."""

    classifier: Logistic
    prior: Shrinkage
    sites: DataFrame
    host: str
    path: str

    def score(self, featured: DataFrame) -> DataFrame:
        evidence = _sigmoid(self.classifier.logit(F.col("__features")))
        scored = featured.withColumn("evidence", evidence).drop("__features")
        return combine(scored, self.sites, self.prior, self.host, self.path)


def learn(
    featured: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    host: str = "source",
    path: str = "lang",
    sample: int = SAMPLE,
) -> QualityModel:
    """Fit classifier and site rates on ``featured``, the features of the whole corpus.

    Scores are probabilities of label 1. Null, empty and wordless texts have
    zeros as features and are scored like any other. A null host or path is a site
    of its own. Without usable labels the evidence is one half everywhere. Columns
    named ``evidence``, ``host_rate``, ``path_rate`` or ``quality_score`` are replaced.
    """
    classifier = fit_classifier(featured, labels, key, sample=sample)
    scored = featured.withColumn("evidence", _sigmoid(classifier.logit(F.col("__features"))))
    sites = site_sums(scored, host, path)
    return QualityModel(classifier, shrinkage(sites), sites, host, path)
