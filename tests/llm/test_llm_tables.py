"""Operators on whole tables, against plain Python, with hot groups and odd rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import compare
import corpus_pipeline
import plain
from gradeloom.llm import mixing, neardup, neighbours, oracles, pieces, queries
from gradeloom.llm.common import maybe_in, stored


@pytest.mark.parametrize("name", list(oracles.ORACLES))
def test_query_matches_sql(spark, sf_dir, name):
    con = compare.connect(sf_dir)
    assert compare.difference(queries.REGISTRY[name](spark, sf_dir), con, oracles.ORACLES[name]) is None


def test_sieve_lets_all_partners_through(spark):
    df = spark.range(20_000).withColumnRenamed("id", "k")
    keys = df.where("k % 77 = 0")
    kept = maybe_in(df, "k", keys)
    assert kept.join(keys, "k").count() == keys.count() and kept.count() < 400
    assert maybe_in(df, "k", keys.where("false")).count() == 0


# Near duplicates


def _edited(rng, words, share):
    out = list(words)
    for i in range(len(out)):
        if rng.random() < share:
            out[i] = f"e{rng.randrange(10**6)}"
    return out


def _crowd():
    """Groups of copies at all distances around the threshold, a chain, a shared passage, and odd texts."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(5000)}"
    texts = []
    base = [word() for _ in range(150)]
    texts += [" ".join(_edited(rng, base, rng.uniform(0, 0.05))) for _ in range(90)]
    step = [word() for _ in range(120)]
    for _ in range(25):
        texts.append(" ".join(step))
        step = _edited(rng, step, 0.02)
    passage = [word() for _ in range(60)]
    texts += [" ".join(passage + [word() for _ in range(rng.randint(5, 60))]) for _ in range(60)]
    for _ in range(20):
        words = [word() for _ in range(rng.randint(3, 80))]
        texts += [" ".join(_edited(rng, words, 0.03)) for _ in range(3)]
    texts += ["Same Text here", "same  text\there", "one", "ONE", "one two", "", " ", None, "a a a a", "a a a a a a", "é é é"]
    return texts


@pytest.mark.parametrize("region", [512, 8])
def test_near_duplicates(spark, monkeypatch, region):
    """The same with regions that fit, and with ones that must go deeper and be compared in blocks."""
    monkeypatch.setattr(neardup, "REGION", region)
    texts = _crowd()
    order = list(range(len(texts)))
    random.Random(1).shuffle(order)
    docs = [(10 + place, texts[i]) for place, i in enumerate(order)]
    wanted = plain.near(docs)
    extra = [(None, "same text here", 1), (None, None, 1), (docs[0][0], docs[0][1], 1)]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs] + extra, "doc_id long, text string, rep int").repartition(6)
    rows = neardup.near_duplicates(df).collect()
    assert len(rows) == len(docs) + 3
    for r in rows:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            size, component = wanted[r["doc_id"]]
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (size, component, r["doc_id"] == component)
    kept = neardup.one_of_each(df)
    assert kept.columns == df.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(i for i, (_, c) in wanted.items() if i == c)
    assert ids.count(None) == 2


def _near(docs, words, percent):
    """``(number, component)`` of ``(id, text)`` pairs by comparing all of them, pair by pair."""

    def shingles(text):
        found = plain.WORD.findall(plain.lowered(text))
        size = min(words, len(found))
        return {tuple(found[i : i + size]) for i in range(len(found) - size + 1)} if found else set()

    sets, leader = [shingles(t) for _, t in docs], list(range(len(docs)))
    for a in range(len(docs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                old, new = max(leader[a], leader[b]), min(leader[a], leader[b])
                leader = [new if x == old else x for x in leader]
    return leader


@pytest.mark.parametrize("words,percent", [(5, 80)])
def test_near_duplicates_of_any_likeness(spark, words, percent):
    """A text of 100 words and the same with 20 more are near by five words and 80, not by three and 85."""
    base = [f"b{i}" for i in range(120)]
    docs = list(enumerate([" ".join(base[:100]), " ".join(base), *_crowd()]))
    like = neardup.Likeness(words, percent)
    wanted = [docs[k][0] for k in _near(docs, words, percent)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(df, like).collect()}
    assert [rows[i] for i, _ in docs] == wanted
    assert rows[1] == 0 and _near(docs[:2], 3, 85) == [0, 1]
    kept = {r["doc_id"] for r in neardup.one_of_each(df, like).collect()}
    assert kept == set(wanted)


@pytest.mark.parametrize("words,percent", [(3, 85), (5, 80), (2, 95), (3, 50)])
def test_few_pairs_at_the_threshold_are_missed(words, percent):
    like, s = neardup.Likeness(words, percent), percent / 100
    unworthy = sum(math.comb(96, i) * s**i * (1 - s) ** (96 - i) for i in range(round(like.worth * 96)))
    assert unworthy <= 1e-6 and (like.depth == 1 or (1 - s**like.depth) ** 16 <= 2e-5)


def test_one_of_each_of_texts_that_share_an_id(spark):
    words = lambda name, n=40: " ".join(f"{name}{i}" for i in range(n))
    rows = [(5, words("a"), 1), (5, words("b"), 2), (3, words("a"), 3), (7, words("c"), 4), (7, words("d"), 5),
            (8, words("e"), 6), (8, words("e") + " more", 7), (9, words("F"), 8), (9, words("f"), 9), (9, "", 10),
            (2, words("g"), 11), (1, words("g"), 12), (None, words("a"), 13)]
    df = spark.createDataFrame(rows, "doc_id long, text string, print int").repartition(5)
    kept = neardup.one_of_each(df)
    assert kept.columns == df.columns
    got = sorted(r["print"] for r in kept.collect())
    assert [k for k in got if k not in (6, 7)] == [2, 3, 4, 5, 8, 10, 12, 13] and len(got) == 9


def test_many_exact_copies(spark):
    """Thousands of copies are one class; a third of all rows are one text."""
    text = F.when(F.col("id") % 3 == 0, "the one text of a third of all rows").otherwise(
        F.concat(F.lit("own words of number "), (F.col("id") * 7919).cast("string"), F.lit(" and no other "), F.col("id").cast("string"))
    )
    df = spark.range(6000).select(F.col("id").alias("doc_id"), text.alias("text"))
    kept = neardup.near_duplicates(df).where("kept")
    assert kept.count() == 4001


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(1000, 1200)] + [(7, 7), (1199, 3)]
    found = {r["node"]: r["component"] for r in neardup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {found[i] for i in range(100, 161)} == {100} and {found[i] for i in range(1000, 1200)} == {3}
    assert found[5] == found[3] == 3 and len(found) == 61 + 200 + 2


def test_near_duplicates_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.near_duplicates(none).count() == 0 and neardup.one_of_each(none).count() == 0


# Mixing


def _sizes(spark, rows):
    return stored(spark.createDataFrame(rows, "doc_id long, source string, size long"), "sizes")


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = {(f"s{i}" if i else None): rng.choice([0, 1, 10, 1000, 10**6]) * rng.randint(1, 9) for i in range(rng.randint(1, 9))}
    rows = [(i, s, n) for i, (s, n) in enumerate(sizes.items())]
    found = {r["source"]: r for r in mixing.source_targets(_sizes(spark, rows)).collect()}
    wanted = plain.targets(sizes)
    for source, target in wanted.items():
        assert found[source]["target"] == pytest.approx(target) and found[source]["source_size"] == sizes[source]
    assert sum(r["target"] for r in found.values()) == pytest.approx(sum(sizes.values()))


def test_mix_comes_near_its_targets(spark):
    """One source holds a third of all rows, one a single document, one nothing but empty texts."""
    rng = random.Random(3)
    rows = [(i, rng.choice(["hot", "b", "c", None]) if i % 3 else "hot", rng.randint(0, 200)) for i in range(3000)]
    rows += [(9000, "alone", 5000), (9001, "empty", 0), (9002, "empty", 0), (None, "b", 7), (None, "b", 7), (5, "b", 9)]
    df = _sizes(spark, rows)
    found = mixing.mix(df).collect()
    assert len(found) == len(rows)
    for source in {r["source"] for r in found}:
        mine = [r for r in found if r["source"] == source]
        largest = max(r["size"] for r in mine)
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= largest / 2 + 1
        assert sum(r["size"] for r in mine) == mine[0]["source_size"]
    assert all(r["taken"] == r["copies"] * r["size"] <= 3 * r["size"] and len(r["positions"]) == r["copies"] for r in found)
    assert all(0 <= p <= 1 for r in found for p in r["positions"])
    key = lambda r: (str(r["doc_id"]), str(r["source"]), r["size"], r["copies"])
    assert sorted(map(key, mixing.mix(df.repartition(11)).collect())) == sorted(map(key, found))


@pytest.mark.parametrize("points", mixing.SCHEDULES)
def test_moments_invert_the_schedule(spark, points):
    """A schedule's integral up to the moment of a share is that share."""
    df = spark.range(101).select((F.col("id") / 100).alias("share"))
    rows = df.select("share", mixing.moment(F.col("share"), mixing.segments(points)).alias("t")).collect()
    grid = np.linspace(0, 1, 200_001)
    weight = np.interp(grid, *zip(*points))
    integral = np.concatenate([[0], np.cumsum((weight[1:] + weight[:-1]) / 2 * np.diff(grid))])
    for r in rows:
        assert np.interp(r["t"], grid, integral / integral[-1]) == pytest.approx(r["share"], abs=1e-6)
    assert [r["t"] for r in rows] == sorted(r["t"] for r in rows)


def test_training_order(spark):
    rows = [(i, f"{'w ' * (i % 7 + 1)}", "ab"[i % 2], 1) for i in range(300)] + [(None, None, None, 2), (5, "w w", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_at int")
    ordered = mixing.training_order(docs)
    assert ordered.columns == docs.columns
    plan = {(r["doc_id"], r["source"], r["size"]): r["positions"] for r in mixing.mix(mixing.document_sizes(docs)).collect()}
    got = ordered.collect()
    assert len(got) == sum(len(plan[i, s, len((t or "").split())]) for i, t, s, _ in rows)
    assert mixing.training_order(docs.where("false")).count() == 0


# Nearest neighbours


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_small_tables_are_searched_whole(spark):
    rng = np.random.default_rng(1)
    rows = [(i * 50, [float(x) for x in rng.normal(size=4).astype(np.float32)]) for i in range(9)]
    odd = [(None, [1.0] * 4), (700, None), (800, [0.0] * 4), (900, [1.0, float("nan"), 0.0, 0.0]), (1000, [1.0, None, 0.0, 0.0]),
           (1100, [float("inf"), 0.0, 0.0, 0.0]), (1200, [1.0, 2.0]), (1300, []), rows[2]]
    found = neighbours.search(_vectors(spark, rows + odd)).collect()
    assert {r["query_id"] for r in found} == {0, 100, 200, 300, 400}
    for query in (0, 100, 200, 300, 400):
        got = sorted((r["rank"], r["vec_id"], r["score"]) for r in found if r["query_id"] == query)
        wanted = plain.nearest(rows, query)
        assert [v for _, v, _ in got] == [v for _, v in wanted] and [r for r, _, _ in got] == list(range(1, 9))
        assert [s for _, _, s in got] == pytest.approx([s for s, _ in wanted], rel=1e-12)
    assert neighbours.search(_vectors(spark, odd[:7])).count() == 0


def test_recall_with_a_vector_that_a_third_of_all_rows_repeat(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 200)
    monkeypatch.setattr(neighbours, "QUERIES", 10)
    rng = np.random.default_rng(2)
    found = rng.normal(size=(4000, 24)).astype(np.float32)
    found[::3] = found[0]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(found)]
    got = neighbours.search(_vectors(spark, rows)).collect()
    ids = np.arange(len(found))
    wide = found.astype(np.float64)
    hits = total = 0
    for query in range(0, 4000, 100):
        distance = np.sqrt(((wide - wide[query]) ** 2).sum(axis=1))
        best = [int(i) for i in np.lexsort((ids, distance)) if i != query][:10]
        mine = [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == query), key=lambda r: r["rank"])]
        if query % 3 == 0:
            assert mine == best
        assert len(mine) == 10
        hits, total = hits + len(set(mine) & set(best)), total + 10
    assert hits >= 0.9 * total


def test_recall_does_not_fall_as_the_table_grows(spark, monkeypatch):
    """With a pivot for each vector, the table is to the index what one of a million is; queries see the same share."""
    monkeypatch.setattr(neighbours, "PER_PIVOT", 1)
    found = np.random.default_rng(4).normal(size=(6000, 24)).astype(np.float32)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(found)]
    df = _vectors(spark, rows)
    assert neighbours.PROBED >= 0.15 * len(neighbours.choose_pivots(df))
    got = neighbours.search(df).collect()
    wide, hits = found.astype(np.float64), 0
    for query in range(0, 6000, 100):
        distance = ((wide - wide[query]) ** 2).sum(axis=1)
        distance[query] = np.inf
        hits += len({r["vec_id"] for r in got if r["query_id"] == query} & set(np.argsort(distance)[:10].tolist()))
    assert hits >= 0.95 * 600


def test_footrule():
    rng = np.random.default_rng(3)
    for _ in range(50):
        orders = np.array([rng.permutation(12)[:5] for _ in range(8)])
        rank = lambda order, p: list(order).index(p) if p in order else 5
        wanted = [sum(abs(rank(orders[0], p) - rank(o, p)) for p in range(12)) for o in orders]
        assert neighbours.footrule(orders[0], orders, 12).tolist() == wanted


@pytest.mark.parametrize("together", [neardup.ONE_TASK, 0])
def test_components(spark, monkeypatch, together):
    """Chains, stars, cycles and repeated links, in one task and over many."""
    monkeypatch.setattr(neardup, "ONE_TASK", together)
    rng = random.Random(31)
    links = [(i, i + 1) for i in range(100, 140)] + [(500, 500 + i) for i in range(1, 60)] + [(7, 8), (8, 9), (9, 7), (7, 8)]
    links += [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(150)]
    rng.shuffle(links)
    leader = {x: x for link in links for x in link}

    def find(x):
        while leader[x] != x:
            x = leader[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        leader[b] = a
    found = neardup.components(spark.createDataFrame(links, "a long, b long").repartition(4)).collect()
    alone = {a for a, b in links if a == b}
    got = {r["node"]: r["component"] for r in found}
    assert len(found) == len(got) and all(got.get(x, x) == find(x) for x in leader) and set(leader) - set(got) <= alone


# Pipeline


def test_pipeline_stage_by_stage(spark, sf_dir):
    docs = stored(spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("rank", F.lit(1)), "docs")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        after = stored(stage(spark, before, sf_dir), name)
        if name == "pieces":
            break
        assert after.columns == columns, name
        ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
        assert 0 < len(ids(after)) <= len(ids(before)) and ids(after) <= ids(before)
        if name == "near_duplicates":
            found = sorted((r["doc_id"], r["text"]) for r in before.collect())
            assert ids(after) == {found[k][0] for k in _near(found, 5, 80)}
        if name == "personal_data":
            texts = {r["doc_id"]: r["text"] for r in before.collect()}
            for r in after.collect():
                counts, joined, _ = plain.personal(texts[r["doc_id"]])
                assert r["n_chars"] == len(r["text"]) and (r["text"] == texts[r["doc_id"]] or "<" in r["text"])
                if joined:
                    assert plain.personal(r["text"])[0] == [0, 0, 0, 0]
        before = after
    assert after.columns == ["doc_id", "n_pieces", "ids"] and after.count() == before.count()
    back = pieces.decode(after, queries.public_tokenizers.path(queries.PIECE_VOCABULARY))
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    assert all(r["text"] == texts[r["doc_id"]] and r["n_pieces"] == len(r["ids"]) for r in back.collect())


def test_every_dealt_query_is_registered():
    names = list(queries.REGISTRY)
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 14))
    assert len(corpus_pipeline.STAGES) == 5
