"""Packing: ids against the library, pieces, solutions, places, and whole results on odd documents."""

import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gradeloom.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCRAPS = [
    "a", "Word", "'s", "'ll", "it's", " ", "  ", "\n", "\t", "\r\n", "é", "日本", "1", "42", ",", ".", "!!", "\xa0", "\x1c", "\0",
    "<|endoftext|>", "😀", "_", " \n ", "x" * 70, "\x85", "İ", "ß", "́", "²", "　",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def _ids(library, text):
    return np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_ids_are_those_of_the_library(library, monkeypatch):
    rng = random.Random(4)
    texts = ["".join(rng.choice(SCRAPS) for _ in range(rng.randrange(30))) for _ in range(4000)]
    texts += [" ".join(rng.choice(SCRAPS) for _ in range(rng.randrange(30))) for _ in range(2000)]
    for name in ("KEPT", "FRESH", "KEPT_PARTS"):
        monkeypatch.setattr(packing, name, 100)
    encoder = packing.Encoder(PATH)
    for start in range(0, len(texts), 500):
        some = texts[start : start + 500]
        for text, raw in zip(some, encoder.encode(some)):
            assert raw == _ids(library, text), text


@pytest.mark.parametrize("n,wanted", [
    (0, []), (1, [(0, 1)]), (8, [(0, 8)]), (9, [(0, 1), (1, 9)]), (16, [(0, 8), (8, 16)]), (20, [(0, 4), (4, 12), (12, 20)]),
])
def test_only_the_first_piece_is_shorter(n, wanted):
    assert packing.cut(n, 8) == wanted


def _best_fit(lengths, capacity):
    """One document after the other, into the fullest bin with room."""
    bins = []
    for x in lengths:
        room = [(capacity - sum(b), i) for i, b in enumerate(bins) if capacity - sum(b) >= x]
        if room:
            bins[min(room)[1]].append(x)
        else:
            bins.append([x])
    return bins


def test_best_fit_in_bulk_is_best_fit_one_by_one():
    rng = random.Random(9)
    for _ in range(60):
        lengths = [rng.randint(1, 40) for _ in range(rng.randint(1, 120))]
        lengths += [rng.randint(1, 40)] * rng.randint(0, 80)
        demand = collections.Counter(lengths)
        order = sorted(demand, reverse=True)
        rng.shuffle(order)
        solution = packing.best_fit({}, demand, order, 40)
        one_by_one = _best_fit([x for x in order for _ in range(demand[x])], 40)
        assert sorted(map(packing.used, (p for p, m in solution.items() for _ in range(m)))) == sorted(map(sum, one_by_one))
        assert packing.demand_of(solution) == demand


def test_bound_is_below_the_best_packing():
    rng = random.Random(10)

    def fewest(lengths, bins):
        if not lengths:
            return len(bins)
        x, *rest = lengths
        options = [len(lengths) + len(bins)]
        for room in {10, *[10 - b for b in bins]}:
            if room >= x:
                more = sorted([*bins, x] if room == 10 else [*[b for b in bins if b != 10 - room], *[10 - room] * (bins.count(10 - room) - 1), 10 - room + x])
                options.append(fewest(rest, more))
        return min(options)

    for _ in range(40):
        lengths = sorted((rng.randint(1, 10) for _ in range(7)), reverse=True)
        assert packing.least_bins(collections.Counter(lengths), 10) <= fewest(lengths, [])
    assert packing.least_bins({6: 5}, 10) == 5 and packing.least_bins({10: 3, 1: 11}, 10) == 5


def test_children_keep_every_document_and_islands_improve():
    """Triplets that fill bins exactly: best fit wastes some, crossover and mutation win back bins."""
    rng = random.Random(2)
    demand = collections.Counter()
    for _ in range(60):
        a, b = rng.randint(26, 49), rng.randint(26, 37)
        demand.update([a, b, 100 - a - b])
    first = packing.best_fit({}, demand, sorted(demand, reverse=True), 100)
    population = []
    for epoch in range(12):
        population = packing.evolve(population, demand, 100, 60, random.Random(epoch))
        for s in population:
            assert packing.demand_of(s) == demand and all(packing.used(p) <= 100 for p in s)
    assert 60 <= packing.n_bins(population[0]) < packing.n_bins(first)
    one, other = population[:2]
    child = packing.crossed(one, other, demand, 100, rng)
    assert packing.demand_of(child) == demand and all(packing.used(p) <= 100 for p in child)
    assert packing._read(packing._written(one)) == one


def test_places_are_gapless():
    demand = {1: 50, 2: 7, 3: 9, 8: 2, 5: 5}
    places = packing.Places(packing.best_fit({}, demand, sorted(demand, reverse=True), 8))
    lengths = np.repeat(list(demand), list(demand.values()))
    numbers = np.concatenate([np.arange(n) for n in demand.values()])
    filled = collections.defaultdict(list)
    for s, o, x in zip(*places.of(lengths, numbers), lengths):
        filled[s].append((o, x))
    for row in filled.values():
        ends = 0
        for o, x in sorted(row):
            assert o == ends
            ends += x
        assert ends <= 8


def test_islands_in_tasks_hand_their_elite_on(spark, monkeypatch):
    monkeypatch.setattr(packing, "EPOCHS", 2)
    monkeypatch.setattr(packing, "ISLANDS", 3)
    rng = random.Random(6)
    demand = collections.Counter()
    for _ in range(30):
        a, b = rng.randint(26, 49), rng.randint(26, 37)
        demand.update([a, b, 100 - a - b])
    best = packing.best_solution(spark, demand, 100)
    assert packing.demand_of(best) == demand and best == packing.best_solution(spark, demand, 100)


@pytest.mark.parametrize("capacity", [2048, 16])
def test_pack(spark, library, capacity):
    rng = random.Random(3)
    texts = [None, "", " ", "one", "Same text"] + ["Copy of a text"] * 300 + ["word, " * 9000]
    texts += [" ".join(rng.choice(SCRAPS) for _ in range(rng.randrange(400))) for _ in range(150)]
    docs = [(None if i == 3 else i - i % 2, t, "x", 5) for i, t in enumerate(texts)]
    df = spark.createDataFrame(docs, "doc_id long, text string, length string, number int").repartition(5)
    found = packing.pack(df, PATH, capacity=capacity)
    assert found.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    rows = found.collect()
    wanted = collections.Counter()
    for doc_id, text, *_ in docs:
        raw = _ids(library, text or "") + bytes(4)
        n = len(raw) // 4
        cuts = [0, *range(n % capacity or min(n, capacity), n, capacity), n]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            wanted[doc_id, k, a, b - a, zlib.crc32(raw[4 * a : 4 * b])] += 1
    assert collections.Counter(tuple(r)[:5] for r in rows) == wanted
    filled = collections.defaultdict(list)
    for r in rows:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for row in filled.values():
        row.sort()
        assert [o for o, _ in row] == [sum(x for _, x in row[:i]) for i in range(len(row))]
        assert sum(x for _, x in row) <= capacity
    total = sum(r["length"] for r in rows)
    assert len(filled) <= -(-total // capacity) * 1.02 + 1
    assert sorted(map(tuple, packing.pack(df, PATH, capacity=capacity).collect()), key=str) == sorted(map(tuple, rows), key=str)


def test_pack_nothing(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
