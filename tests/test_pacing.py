"""Rate of a whole job, and groups of similar length."""

import collections
import hashlib
import random
import time

import pytest

from gradeloom.operators.generate import dealt_slots, generate_at_rate
from gradeloom.operators.training import length_grouped


def test_slots_are_dealt_to_those_with_rows():
    assert [dealt_slots([3, 0, 1], t, 8) for t in range(3)] == [([0, 2, 3], 4), ([], 4), ([1], 4)]
    assert [dealt_slots([9, 9], t, 5) for t in range(2)] == [([0, 2, 4], 5), ([1, 3], 5)]
    assert dealt_slots([0, 0], 0, 5) == ([], 0)


@pytest.fixture
def clock():
    """Defined in here, so that tasks get it by value."""

    def make():
        return lambda prompts, params: [f"{time.time()} {params[0].get('k')}" for _ in prompts]

    return make


def test_rate_holds_over_uneven_tasks(spark, clock):
    """120 rows at 60 a second in three tasks, one of which has nearly all: two seconds, evenly spaced."""
    df = spark.createDataFrame([(i, f"p{i}") for i in range(120)], "i int, prompt string").repartition(2)
    rows = generate_at_rate(df, clock, per_second=60, tasks=3, slots=16).collect()
    assert sorted(r["slot"] for r in rows) == list(range(120)) and sorted(r["i"] for r in rows) == list(range(120))
    rows.sort(key=lambda r: r["slot"])
    moments = [float(r["generated"].split()[0]) for r in rows]
    assert moments[-1] - moments[0] > 1.9
    for first, last in zip(moments, moments[30:]):
        assert last - first > 30 / 60 - 0.12
    assert {r["generated"].split()[1] for r in rows} == {"None"}


def test_high_rate_is_reached(spark, clock):
    """30,000 calls at 20,000 a second are one round, not over a hundred that each wait a second for the driver."""
    df = spark.range(30_000).selectExpr("id", "cast(id as string) prompt")
    rows = generate_at_rate(df, clock, per_second=20_000, tasks=2).collect()
    assert sorted(r["slot"] for r in rows) == list(range(30_000))
    moments = [float(r["generated"].split()[0]) for r in rows]
    assert 1.4 < max(moments) - min(moments) < 5


def test_rate_of_no_rows(spark, clock):
    empty = spark.createDataFrame([], "prompt string")
    assert generate_at_rate(empty, clock, per_second=5, tasks=2).collect() == []


def _plain(lengths, batch, seed, most):
    order = sorted(lengths, key=lambda k: (hashlib.md5(f"{k}:{seed}".encode()).hexdigest(), k))
    size = batch * (min(len(order) // (4 * batch), most) or 1)
    megas = [sorted(order[i : i + size], key=lambda k: -lengths[k]) for i in range(0, len(order), size)]
    firsts = [lengths[m[0]] for m in megas]
    at = firsts.index(max(firsts))
    megas[0][0], megas[at][0] = megas[at][0], megas[0][0]
    return {k: i for i, k in enumerate(k for m in megas for k in m)}


@pytest.mark.parametrize("n,batch,most", [(1000, 4, 50), (1000, 4, 3), (37, 24, 50), (1, 2, 50)])
def test_groups_are_those_of_the_trainer(spark, tmp_path, n, batch, most):
    rng = random.Random(n)
    lengths = {i: rng.choice([7, 7, 7, rng.randrange(300)]) for i in range(n)}
    df = spark.createDataFrame([(k, x if x else None, "own") for k, x in lengths.items()], "k long, n int, place string")
    df.repartition(3).write.parquet(str(tmp_path / "rows"))
    found = length_grouped(spark.read.parquet(str(tmp_path / "rows")), "k", "n", batch_size=batch, seed=3, most_batches=most)
    rows = {r["k"]: r for r in found.collect()}
    assert {k: r["place"] for k, r in rows.items()} == _plain(lengths, batch, 3, most)
    assert all(r["batch"] == r["place"] // batch for r in rows.values())
    full = collections.Counter(r["batch"] for r in rows.values())
    assert max(full.values()) <= batch


def test_no_groups_of_no_rows(spark, tmp_path):
    spark.createDataFrame([], "k long, n int").write.parquet(str(tmp_path / "rows"))
    assert length_grouped(spark.read.parquet(str(tmp_path / "rows")), "k", "n", batch_size=2, seed=1).collect() == []
