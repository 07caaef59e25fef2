"""Numbers of rows against plain sorting."""

import random

import pytest
from pyspark.sql import functions as F

from gradeloom.operators import order
from gradeloom.operators.order import numbered
from gradeloom.session import materialize


@pytest.fixture
def rows(spark, tmp_path):
    rng = random.Random(3)
    data = [(rng.choice(["a", "b", None, ""]), rng.choice([None, *range(40)]), i) for i in range(3000)]
    data += [("hot", 7, 0)] * 2000
    spark.createDataFrame(data, "g string, k long, number long").repartition(5).write.parquet(str(tmp_path / "rows"))
    return spark.read.parquet(str(tmp_path / "rows"))


def _key(value):
    return (value is not None, value if value is not None else 0)


def test_numbers_over_all_rows(rows):
    found = numbered(rows, [F.asc_nulls_first("k"), "number"], number="place", size="n").collect()
    assert sorted(r["place"] for r in found) == list(range(5000)) and {r["n"] for r in found} == {5000}
    found.sort(key=lambda r: r["place"])
    keys = [(_key(r["k"]), r["number"]) for r in found]
    assert keys == sorted(keys)


def test_numbers_inside_groups(rows):
    found = numbered(rows, [F.desc_nulls_last("k"), "number"], by=["g"], number="place", size="n")
    assert found.columns == ["g", "k", "number", "place", "n"]
    groups = {}
    for r in found.collect():
        groups.setdefault(r["g"], []).append(r)
    assert set(groups) == {"a", "b", None, "", "hot"}
    for members in groups.values():
        members.sort(key=lambda r: r["place"])
        assert [r["place"] for r in members] == list(range(len(members)))
        assert {r["n"] for r in members} == {len(members)}
        keys = [(r["k"] is None, -(r["k"] or 0), r["number"]) for r in members]
        assert keys == sorted(keys)


def test_copies_of_a_row_do_not_meet_in_one_task(spark, rows, monkeypatch):
    written = []
    monkeypatch.setattr(order, "materialize", lambda *a: written.append(materialize(*a)) or written[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = numbered(rows.where("g = 'hot'"), ["k"], number="place")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = written[0].groupBy("_metadata.file_name").count()
    assert parts.count() > 4 and parts.agg(F.max("count")).first()[0] < 1000
    assert found.agg(F.count_distinct("place")).first()[0] == 2000


def test_no_rows(rows):
    assert numbered(rows.where("false"), ["k"], by=["g"], size="n").collect() == []
