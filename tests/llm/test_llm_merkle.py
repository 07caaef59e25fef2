"""The Merkle manifest against a plain version that holds whole trees."""

import hashlib
import random
import zlib

import pytest

from gradeloom.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, digest string, place int"


def _hash(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _leaf(values):
    return _hash("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def _climb(nodes):
    """The top of some nodes and each node's siblings before and behind, level by level."""
    siblings, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 16] for i in range(0, len(nodes), 16)]
        for k, i in enumerate(at):
            run = runs[i // 16]
            siblings[k].append(("".join(run[: i % 16]), "".join(run[i % 16 + 1 :])))
        at = [i // 16 for i in at]
        nodes = [_hash("".join(run)) for run in runs]
    return nodes[0], siblings


def _plain(rows):
    order = lambda v: (v is not None, v.encode() if isinstance(v, str) else v or 0)
    trees = {}
    for row in rows:
        trees.setdefault(row[1], []).append(row)
    tops, out = [], []
    for source in sorted(trees, key=order):
        leaves = sorted(trees[source], key=lambda r: (order(r[0]), _leaf(r[:5])))
        top, siblings = _climb([_leaf(r[:5]) for r in leaves])
        tops.append((top, leaves, siblings))
    root, above = _climb([t for t, _, _ in tops]) if tops else (None, [])
    for (top, leaves, siblings), rest in zip(tops, above):
        for row, own in zip(leaves, siblings):
            changed = row[:5]
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[4] is not None:
                changed = (*row[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4]))
            folded = _leaf(changed)
            for before, behind in own + rest:
                folded = _hash(before + folded + behind)
            proof = _hash("".join(a + b for a, b in own + rest))
            out.append((row[0], _leaf(row[:5]), top, root, proof, folded, folded == root))
    return out


def _same(spark, rows):
    df = spark.createDataFrame([(*r, "own digest", 3) for r in rows], SCHEMA).repartition(5)
    found = merkle.manifest(df, merkle.lowered_fifth(df))
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    got = sorted(map(tuple, found.collect()), key=key)
    assert got == sorted(_plain(rows), key=key)
    return got


@pytest.mark.parametrize("levels", [3, 1])
def test_manifest(spark, monkeypatch, levels):
    """A hot source over several blocks and sweeps, lone leaves, nulls everywhere, repeated ids and rows."""
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "BLOCK", 16**levels)
    rng = random.Random(5)
    rows = [(i, "hot", "en", 3, f"Text {i}") for i in range(4500 if levels == 3 else 700)]
    rows += [(rng.randrange(-40, 40), rng.choice([None, "", "é", "z", "src"]), None, rng.randrange(9), "Aé\n" * 2) for _ in range(150)]
    rows += [(None, "z", "fr", None, None), (None, None, None, None, ""), (7, "lone", "en", 1, "X" * 300_000)]
    rows += [(12, "twice", "en", 4, "Same")] * 40
    got = _same(spark, rows)
    assert {r[6] for r in got} == {True, False}


@pytest.mark.parametrize("n", [0, 1, 2, 16, 17, 257])
def test_sizes_around_a_run(spark, n):
    _same(spark, [(i, None, "en", i, "Text") for i in range(n)])


def test_many_sources(spark):
    _same(spark, [(i, f"s{i % 300}", "en", i, None if i % 7 else "T") for i in range(900)])


def test_without_tampering_all_leaves_fold_to_the_root(spark):
    df = spark.createDataFrame([(i, f"s{i % 3}", "en", i, f"Text {i}") for i in range(100)], SCHEMA.rsplit(", ", 2)[0])
    assert merkle.manifest(df).where("NOT verified").count() == 0
