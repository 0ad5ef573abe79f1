"""Hard negatives against all scores."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks.compare import connect, difference
from tillsight.llm import hard_negatives as hn
from tillsight.llm import queries

SCHEMA = "vec_id long, embedding array<float>, label int, norm int, row string"


def brute(rows, is_anchor, scale=256, positives=5, negatives=10, share=(30, 90), width=None):
    kept = []
    for i, v, c, *_ in rows:
        if c is None or not v or any(x is None or not np.isfinite(x) or abs(np.float32(x) * scale) >= hn.LIMIT for x in v):
            continue
        ints = [int(np.floor(scale * float(np.float32(x)))) for x in v]
        if width is None or len(ints) == width:
            kept.append((i, c, ints))
    order = lambda t: (-t[0], t[1] is None, t[1] or 0)
    out = []
    for n, (i, c, a) in enumerate(kept):
        if i is None or not is_anchor(i):
            continue
        scored = [(sum(x * y for x, y in zip(a, b)), j, d == c) for m, (j, d, b) in enumerate(kept) if m != n]
        for ps, p, _ in sorted((t for t in scored if t[2]), key=order)[:positives]:
            fit = [t for t in scored if not t[2] and share[0] * ps <= 100 * t[0] <= share[1] * ps]
            for rank, (ns, j, _) in enumerate(sorted(fit, key=order)[:negatives], 1):
                out.append((i, p, rank, j, ps, ns))
    return sorted(out, key=str)


def mined(spark, rows, is_anchor, **options):
    frame = spark.createDataFrame(rows, SCHEMA)
    return sorted((tuple(r) for r in hn.mine(frame, is_anchor, **options).collect()), key=str)


def clustered(rng, n, width=12, spread=0.15):
    middles = rng.standard_normal((6, width))
    home = rng.integers(0, 6, n)
    vectors = middles[home] + spread * rng.standard_normal((n, width))
    return [(int(i), [float(x) for x in v], int(c), 1, "r") for i, (v, c) in enumerate(zip(vectors, rng.integers(0, 3, n)))]


@pytest.mark.parametrize("spread", [0.15, 2.0])
def test_mined_rows_are_those_of_all_scores(spark, spread):
    rows = clustered(np.random.default_rng(1), 400, spread=spread)
    want = brute(rows, lambda i: i % 10 == 0)
    assert len(want) > 200
    assert mined(spark, rows, lambda c: c % 10 == 0) == want
    # several lots, cells and blocks
    assert mined(spark, rows, lambda c: c % 10 == 0, block=60, lot=9) == want


def test_bounds_hold_and_spare_scores():
    rng = np.random.default_rng(2)
    rows = clustered(rng, 3000, width=24, spread=0.05)
    ints = np.array([np.floor(256 * np.array(r[1])) for r in rows]).astype(np.int64)
    ints[:3] = 0
    norms = np.linalg.norm(ints, axis=1)
    refs = hn.choose_references(ints[::3].astype(float), 8)
    angles = hn.angles_to(ints.astype(float), norms, refs).astype(np.float32).astype(float)
    extent = hn.Extent.of(angles, norms)
    low, high = hn.score_bounds(extent[slice(0, 200)], extent)
    true = ints[:200] @ ints.T
    assert (low <= true).all() and (true <= high).all()
    low, high = hn.score_bounds(extent.runs(50)[slice(0, 9)], extent.runs(64))
    for i in range(9):
        for j in range(len(low[0])):
            part = ints[i * 50 : (i + 1) * 50] @ ints[j * 64 : (j + 1) * 64].T
            assert low[i, j] <= part.min() and part.max() <= high[i, j]
    every = hn.Rows(np.arange(3000), np.arange(3000), np.zeros(3000, bool), np.array([r[2] for r in rows]), ints, extent)
    every = every[np.lexsort((angles.min(axis=1), angles.argmin(axis=1)))]
    some = every[np.arange(0, 3000, 30)]
    top = (np.array([np.sort(np.delete(every.ints @ a, np.flatnonzero(every.row == r)))[-1] for a, r in zip(some.ints, some.row)]))[:, None]
    *_, scored = hn.search(some, every, -(-30 * top // 100), 90 * top // 100, 10, same=False)
    assert 0 < scored < 0.6 * 100 * 3000  # the rest was left out by bounds


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = clustered(rng, 150)
    inf, nan = float("inf"), float("nan")
    rows += [(200, None, 1, 1, "r"), (210, [], 1, 1, "r"), (220, [1.0] * 11 + [None], 1, 1, "r"), (230, [nan] * 12, 1, 1, "r")]
    rows += [(240, [inf] * 12, 1, 1, "r"), (250, [0.0] * 12, 1, 1, "r"), (260, [0.5] * 12, None, 1, "r"), (270, [1.0] * 5, 1, 1, "r")]
    rows += [(280, [1e30] * 12, 1, 1, "r"), (None, rows[3][1], 2, 1, "r"), (None, rows[3][1], 1, 1, "r"), (10, rows[4][1], 1, 1, "r")]
    rows += [rows[10]] * 3 + [(300 + i, rows[7][1], 1 + i % 2, 1, "r") for i in range(30)]
    want = brute(rows, lambda i: i % 10 == 0, width=12)
    assert mined(spark, rows, lambda c: c % 10 == 0) == want
    assert mined(spark, rows, lambda c: c % 10 == 0, block=20, lot=3) == want
    frame = spark.createDataFrame(rows, SCHEMA)
    for none in (frame.limit(0), frame.where("embedding is null"), frame.withColumn("label", F.lit(None).cast("int"))):
        assert hn.mine(none, lambda c: c % 10 == 0).collect() == []
    assert hn.mine(frame, lambda c: c < 0).collect() == []
    assert hn.mine(frame.where("label = 1"), lambda c: c % 10 == 0).collect() == []


def test_large_components_are_scored_exactly(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.integers(-16000, 16000, 8) / 1.7], i % 3, 1, "r") for i in range(60)]
    rows += [(100 + i, [60000.0 + (i == j) / 256 for j in range(8)], i % 2, 1, "r") for i in range(8)]
    assert mined(spark, rows, lambda c: c % 4 == 0) == brute(rows, lambda i: i % 4 == 0)


def test_hard_negatives_query(spark, sf_dir):
    sql = queries.ORACLE_SQL["op12_hard_negatives"]
    assert difference(spark, connect(sf_dir), queries.op12_hard_negatives, sql, sf_dir) is None
