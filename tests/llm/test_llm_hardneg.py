"""Hard negatives against a plain version that compares all pairs."""

import math
import random

import numpy as np
import pytest

from gradeloom.llm import hardneg

SCHEMA = "vec_id long, embedding array<float>, label int, number int, whole string"


def _plain(rows, every=100, n_positives=5, k=10):
    good = {}
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        good.setdefault(vec_id, []).append((label, vector))
    known = {}
    for vec_id, found in good.items():
        label, vector = min(found)
        known[vec_id] = ((label + 1) % 10 if vec_id % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in vector])
    out = set()
    for a, (label, own) in known.items():
        if a % every:
            continue
        scored = [(-sum(x * y for x, y in zip(own, v)), i, other == label) for i, (other, v) in known.items() if i != a]
        scored.sort()
        for score, positive, _ in [s for s in scored if s[2]][:n_positives]:
            fits = [(s, i) for s, i, same in scored if not same and 30 * -score <= 100 * -s <= 90 * -score]
            out |= {(a, positive, r, i, -score, -s) for r, (s, i) in enumerate(fits[:k], 1)}
    return out


def _same(spark, rows, **options):
    df = spark.createDataFrame([(*r, 3, "own") for r in rows], SCHEMA).repartition(6)
    found = hardneg.mine(df, **options)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == _plain(rows, **options)
    return got


def _cloud(rng, n, width=16, spread=1.0, centres=4):
    middles = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(centres)]
    rows = []
    for i in range(n):
        m = rng.choice(middles)
        rows.append((i, [x + rng.gauss(0, spread) for x in m], rng.randrange(4)))
    return rows


@pytest.mark.parametrize("spread", [1.0, 0.05])
def test_mine(spark, monkeypatch, spread):
    """Blocks, parts and windows so small that everything is cut; a sample that misses most rows."""
    for name, value in (("BLOCK", 100), ("WINDOW", 16), ("PART", 3), ("SAMPLE_ROWS", 20), ("PENDING", 50), ("REFERENCES", 6)):
        monkeypatch.setattr(hardneg, name, value)
    rng = random.Random(1)
    rows = _cloud(rng, 600, spread=spread)
    rows += [(1000 + i, [0.5] * 16, i % 4) for i in range(200)]  # copies of one vector
    assert len(_same(spark, rows)) > 100


def test_odd_rows(spark):
    rng = random.Random(2)
    rows = _cloud(rng, 250, width=4)
    nan, inf = float("nan"), float("inf")
    rows += [(None, [1.0] * 4, 1), (300, None, 1), (301, [1.0] * 4, None), (302, [1.0, None, 0.0, 0.0], 1), (303, [nan] * 4, 1)]
    rows += [(304, [inf, 0.0, 0.0, 0.0], 2), (400, [0.0] * 4, 1), (401, [0.0] * 4, 2), (500, [], 1), (502, [1.0, 2.0], 3)]
    rows += [(600, [1.0] * 4, 2), (600, [0.5] * 4, 2), (600, [0.5] * 4, 1), (-700, [2.0] * 4, 3), (701, [1e-9] * 4, 3), (800, [-1e-9] * 4, 3)]
    _same(spark, rows, every=50)


def test_few_rows(spark):
    assert hardneg.mine(spark.createDataFrame([], SCHEMA)).collect() == []
    _same(spark, [(0, [1.0, 0.0], 1)])
    _same(spark, [(0, [1.0, 0.0], 2), (1, [1.0, 0.0], 3), (2, [0.5, 0.1], 2)])
    huge = [(100 * i, [3e38 * (-1) ** i, 1.0], i % 2) for i in range(1, 6)]
    assert hardneg.mine(spark.createDataFrame([(*r, 0, "") for r in huge], SCHEMA)).collect() is not None


def test_bounds_hold_and_leave_windows_out():
    """Scores of random windows lie within their bounds; far windows are not scored at all."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(8, 12)) * 200
    rows = np.floor(centres[rng.integers(0, 8, 4000)] + rng.normal(size=(4000, 12)) * 8)
    references = hardneg.reference_directions(rows[:500], 8)
    order = np.argsort(hardneg.angles(rows, references).argmin(axis=1), kind="stable")
    rows = rows[order]
    stored = hardneg.angles(rows, references).astype(np.float32)
    norms, anchors = np.linalg.norm(rows, axis=1), rows[::50]
    own, own_norm = hardneg.angles(anchors, references).astype(np.float32), np.linalg.norm(anchors, axis=1)
    left_out = 0
    for start in range(0, 4000, 64):
        window = slice(start, start + 64)
        low, high = hardneg.bounds(own, own_norm, stored[window].min(axis=0), stored[window].max(axis=0), (norms[window].min(), norms[window].max()))
        found = hardneg.scores(anchors, rows[window])
        assert (found.min(axis=1) >= low).all() and (found.max(axis=1) <= high).all()
        left_out += int((high < 0.5 * own_norm**2).sum())
    assert left_out > 0.5 * len(anchors) * 63


def test_scores_are_exact_beyond_double_precision():
    a, b = np.array([[2.0**28, 1.0]]), np.array([[2.0**28, 1.0]])
    assert hardneg.scores(a, b)[0, 0] == 2**56 + 1
