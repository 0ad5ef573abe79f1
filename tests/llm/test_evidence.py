"""Held-out labels, twins in plain Python and what each method contributes."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillsight.llm import quality, queries, tokens
from tillsight.llm import shingle_join as sj


def test_token_counts_of_the_whole_table_are_the_librarys(spark, sf_dir):
    library = tokens.load("byte_bpe_50k.json")
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    want = {(i, len(t.encode()), n := len(library.encode(t, add_special_tokens=False)), n > 1024) for i, t in texts.items()}
    assert {tuple(r) for r in queries.op8_token_counts(spark, sf_dir).collect()} == want


@pytest.fixture(scope="module")
def judged(spark):
    """Scores learnt without a quarter of the labels."""
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 1
    featured = quality.document_features(docs, ["doc_id", "source", "lang"])
    model = quality.learn(featured, labels.where(~held))
    return model, model.score(featured).collect(), {r["doc_id"]: r["quality"] for r in labels.collect()}


def test_quality_of_labels_that_were_held_out(judged):
    _, rows, labels = judged
    held = [r for r in rows if r["doc_id"] in labels and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 1]
    right = [(r["quality_score"] >= quality.THRESHOLD) == bool(labels[r["doc_id"]]) for r in held]
    assert len(held) >= 30 and np.mean(right) > 0.95


def test_rates_and_scores_are_those_of_the_definition(judged):
    """Host and path rates and scores from the evidence, each site summed up in plain Python."""
    model, rows, _ = judged
    prior = model.prior
    for r in rows[::7]:
        host = [x["evidence"] for x in rows if x["source"] == r["source"]]
        path = [x["evidence"] for x in rows if (x["source"], x["lang"]) == (r["source"], r["lang"])]
        own = r["evidence"]
        host_rate = (sum(host) - own + prior.host * prior.mean) / (len(host) - 1 + prior.host)
        path_rate = (sum(path) - own + prior.path * host_rate) / (len(path) - 1 + prior.path)
        assert abs(r["host_rate"] - host_rate) < 1e-9 and abs(r["path_rate"] - path_rate) < 1e-9
        logit = [np.log(p / (1 - p)) for p in np.clip([own, path_rate, prior.mean], 1e-6, 1 - 1e-6)]
        assert abs(r["quality_score"] - 1 / (1 + np.exp(-(logit[0] + logit[1] - logit[2])))) < 1e-9


def test_boxes_leave_out_pairs():
    """Of all pairs of leaves of unlike texts the tree visits few, and no linked pair is lost."""
    rng = np.random.default_rng(1)
    base = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in rng.integers(20, 2000, 600)]
    sets = base + [np.sort(np.concatenate([s[: int(0.97 * len(s))], rng.integers(0, 2**63, 1).astype(np.uint64)])) for s in base[:100]]
    sizes = np.array([len(s) for s in sets])
    points = np.stack([np.bincount((s >> np.uint64(40)).astype(np.int64) % sj.GROUPS, minlength=sj.GROUPS) for s in sets])
    tree = sj.CountTree(points, sizes)
    leaves = len(tree.levels[0][0])
    visited = len(list(sj.candidate_leaves(tree, tree, 90)))
    assert visited < 0.6 * leaves * (leaves + 1) / 2
    linked = sj.linked_forest(sets, np.zeros(len(sets), int), 90)
    assert {frozenset(e) for e in linked} >= {frozenset((i, 600 + i)) for i in range(100) if sizes[i] > 60}
