"""Distances against plain dynamic programming."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gradeloom.functions import distance, distance as D
from gradeloom.operators.memorize import meld_summary, with_distance

# Fixed test data: two texts of a record with a known distance.
SALIVA = "(d) La salive.\n(e) Les sécrétions intestinales."
SALIVA_TEXT = (
    "(d) Le sang.\n(e) L'urine.\n\nParmi ces propositions, la réponse exacte est (c) Le suc pancréatique."
)


def subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def kept(a, b):
    row = [(j, 0) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        new = [(i, 0)]
        for j, y in enumerate(b, 1):
            (dc, dk), (uc, uk), (lc, lk) = row[j - 1], row[j], new[j - 1]
            new.append(min((dc, dk - 1) if x == y else (dc + 1, dk), (uc + 1, uk), (lc + 1, lk)))
        row = new
    return -row[-1][1]


def random_pairs(count, longest, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcé \n") for _ in range(rng.randint(0, longest)))
    return [(word(), word()) for _ in range(count)]


def test_subsequence():
    for a, b in random_pairs(300, 90, 1):
        assert D.common_subsequence(a, b) == subsequence(a, b)


def test_kept_characters():
    pairs = random_pairs(300, 30, 2)
    got = D.kept_characters([a for a, _ in pairs], [b for _, b in pairs])
    assert got.tolist() == [kept(a, b) for a, b in pairs]


def test_blocks_cover_all_pairs_in_order(monkeypatch):
    monkeypatch.setattr(D, "CELLS_PER_BLOCK", 50)
    pairs = random_pairs(200, 40, 3)
    reference, generated = pd.Series([a for a, _ in pairs]), pd.Series([b for _, b in pairs])
    got = D._edit_distances(reference, generated)
    for (a, b), value in zip(pairs, got):
        assert value is None if not a else abs(value - (1 - round(kept(a, b) / len(a) * 100) / 100)) < 1e-12


@pytest.mark.parametrize(
    "reference,generated,wanted",
    [
        ("(d) Bb.\n(e) C5a.", "(d) C5a.\n(e) C4b.", 0.2727272727272727),
        (SALIVA, SALIVA_TEXT, 0.5277777777777778),
        ("", "", 0.0),
        ("same", "same", 0.0),
        ("ab", "", 1.0),
    ],
)
def test_ratio(spark, reference, generated, wanted):
    df = spark.createDataFrame([(reference, generated)], "reference string, generated string")
    assert with_distance(df, "ratio").first()["distance"] == pytest.approx(wanted, abs=1e-9)


def test_edit_rounds_half_even_and_skips_empty(spark):
    rows = [("abcdefgh", "a"), ("", "x"), (None, "x"), ("x", None), ("same", "same")]
    df = spark.createDataFrame(rows, "reference string, generated string")
    assert [r["distance"] for r in with_distance(df).collect()] == [0.88, None, None, None, 0.0]


def test_long_whole_texts(spark):
    rng = random.Random(5)
    a = "".join(rng.choice("abcd ") for _ in range(3000))
    b = "".join(c for c in a if rng.random() < 0.9)
    df = spark.createDataFrame([(a, b)], "reference string, generated string")
    assert with_distance(df).first()["distance"] == pytest.approx(1 - round(kept(a, b) / len(a) * 100) / 100)
    assert with_distance(df, "ratio").first()["distance"] == pytest.approx(1 - 2 * len(b) / (len(a) + len(b)))


def test_summary_counts_the_threshold_in(spark):
    df = spark.createDataFrame([(0.05,), (0.06,), (0.0,), (None,)], "distance double")
    row = meld_summary(df).first()
    assert (row["n"], row["meld_rate"], row["avg_distance"]) == (3, pytest.approx(2 / 3), pytest.approx(0.11 / 3))


def _edited(rng, text, changes):
    out = list(text)
    for _ in range(changes):
        at, way = rng.randrange(len(out) + 1), rng.random()
        if way < 0.4 or at == len(out):
            out.insert(at, rng.choice("abcx😀"))
        elif way < 0.7:
            del out[at]
        else:
            out[at] = rng.choice("abcxé")
    return "".join(out)


def _pairs(rng, n):
    pairs = []
    for _ in range(n):
        a = "".join(rng.choice("abcé😀") for _ in range(rng.randrange(70)))
        pairs.append((a, _edited(rng, a, rng.choice([0, 1, 3, 9, 40]))))
    return pairs


def test_band_equals_the_full_table():
    rng = random.Random(12)
    pairs = _pairs(rng, 400)
    found = distance.kept_of_all(pairs)
    for (a, b), n in zip(pairs, found):
        assert n == kept(a, b)
        if a and b:
            cost = distance.edit_cost(a, b)
            assert distance.kept_in_band([a], [b], max(1, cost))[0] == n
    assert [distance.edit_cost(a, b) for a, b in (("", "abc"), ("abc", ""), ("", ""), ("kitten", "sitting"))] == [3, 3, 0, 3]


def test_long_texts_in_a_band():
    """30,000 characters with 40 changes: the full table would have 900 million cells."""
    rng = random.Random(13)
    text = "".join(rng.choice("abcdefgh ") for _ in range(30_000))
    changed = text[:10_000] + "zzzz" + text[10_020:20_000] + text[20_010:] + "q"
    assert distance.edit_cost(text, changed) <= 45
    assert distance.kept_of_all([(text, changed)]) == [30_000 - 30]


def test_bound_decides_as_the_distance_does(spark):
    rng = random.Random(14)
    pairs = _pairs(rng, 200) + [("a" * n, "a" * k + "b" * (n - k)) for n in (100, 200) for k in range(n - 14, n + 1)]
    pairs += [("ab" * 100, "ab" * 100 + "c" * k) for k in (1, 9, 30, 90)] + [(None, "a"), ("a", None), ("", "a"), ("a", ""), ("", "")]
    df = spark.createDataFrame(pairs, "a string, b string")
    a, b = F.col("a"), F.col("b")
    for at in (0.05, 0.2, 0.0):
        rows = df.select(distance.within_distance(a, b, at).alias("fast"), (distance.edit_distance(a, b) <= at).alias("slow")).collect()
        assert [r["fast"] for r in rows] == [r["slow"] for r in rows]
        assert {r["fast"] for r in rows} == {True, False, None}
