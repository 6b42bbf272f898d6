"""Hard negatives against a plain version over all pairs."""

import numpy as np
import pytest

from tidemark.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, is_anchor, positives, negatives, low=50, high=95, scale=256):
    held = {}
    for i, v, c in rows:
        if i is None or c is None or not v or any(x is None or not np.isfinite(x) for x in v):
            continue
        held.setdefault(i, (c, np.floor(scale * np.array(v, np.float32).astype(float)).astype(int)))
    out = set()
    for a, (label, v) in held.items():
        if not is_anchor(a):
            continue
        scored = sorted(((int(v @ w), -i, c) for i, (c, w) in held.items() if i != a and len(w) == len(v)), reverse=True)
        for p, pi, _ in [x for x in scored if x[2] == label][:positives]:
            fits = [x for x in scored if x[2] != label and low * p <= 100 * x[0] <= high * p][:negatives]
            out |= {(a, -pi, n, -i, p, s) for n, (s, i, _) in enumerate(fits, 1)}
    return out


def found(df, **kw):
    return {tuple(r) for r in hard_negatives.hard_negatives(df, lambda i: i % 5 == 0, **kw).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()}


BAD = [(900, None, 1), (905, [], 1), (910, [None, 1.0, 0.0, 0.0], 1), (915, [float("nan")] * 4, 1), (920, [float("inf")] * 4, 1), (925, [1.0] * 4, None), (None, [1.0] * 4, 1), (930, [0.5, 0.25], 77)]


@pytest.mark.parametrize("kind", ["ties", "spread", "hot"])
def test_equals_all_pairs(spark, monkeypatch, kind):
    rng = np.random.default_rng(9)
    n = 160
    if kind == "ties":
        vectors = rng.integers(-2, 3, (n, 4)) / 4
    else:
        vectors = rng.normal(size=(n, 4)) + np.array([2.0, 0, 0, 0])
    labels = np.where(rng.random(n) < 0.5, 3, rng.integers(0, 4, n)) if kind == "hot" else rng.integers(0, 4, n)
    if kind == "hot":
        vectors[rng.random(n) < 0.4] = [1.0, 0.5, 0.0, -0.25]
    rows = [(i, [float(np.float32(x)) for x in v], int(c)) for i, (v, c) in enumerate(zip(vectors, labels, strict=True))] + BAD
    df = spark.createDataFrame([*rows, rows[3]], SCHEMA).selectExpr("*", "1 as id", "2 as v", "3 as dims", "4 as slot")
    want = plain(rows, lambda i: i % 5 == 0, 4, 3)
    assert want and found(df, positives=4) == want
    # Many small cells, and other parameters.
    monkeypatch.setattr(hard_negatives, "ROWS", 16)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 4)
    monkeypatch.setattr(hard_negatives, "AT_ONCE", 32)
    assert found(df, positives=4) == want
    assert found(df, positives=2, negatives=5, low=0, high=100) == plain(rows, lambda i: i % 5 == 0, 2, 5, 0, 100)


def test_edges(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert found(none) == set()
    alone = spark.createDataFrame([(0, [1.0], 1), (5, [0.5], 2), (6, [0.75], 3)], SCHEMA)  # no positives at all
    assert found(alone) == set()
    # A negative positive has an empty window, one of zero takes zeros; large components are exact.
    few = [(0, [1.0, 0.0], 1), (1, [-1.0, 0.0], 1), (2, [-0.75, 0.0], 2), (5, [0.0, 1.0], 3), (6, [1.0, 0.0], 3), (7, [2.0, 0.0], 4), (10, [4000.0, 9000.5], 5), (11, [8000.0, 1.0], 5), (12, [7000.0, 9.0], 6)]
    df = spark.createDataFrame(few, SCHEMA)
    assert found(df) == plain(few, lambda i: i % 5 == 0, 5, 3)


def test_slots_and_packing():
    limits = np.array([[90, 50, 50, 10, -(2**62)]] * 5)
    assert hard_negatives.slot_of(np.array([91, 90, 51, 50, 10]), limits).tolist() == [-1, 0, 0, 2, 3]
    v = np.array([[1, -127], [128, 0], [40000, -40000], [-128, 0]])
    assert [len(x) for x in hard_negatives.packed(v)] == [3, 5, 9, 5]
