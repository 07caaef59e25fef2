"""Agreement of many pairs of runs by bitmaps over blocks of ids."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gradeloom.functions.letters import agreement_key

IDS_PER_BLOCK = 1 << 15
PAIRS_AT_ONCE = 1 << 10


def bits(places: np.ndarray, size: int) -> np.ndarray:
    """A bitmap of ``size`` places as 64-bit words."""
    marks = np.zeros(-(-size // 64) * 64, bool)
    marks[places] = True
    return np.packbits(marks, bitorder="little").view(np.uint64)


def counted(run: np.ndarray, ids: list[str | None], keys: list[str | None], pairs: np.ndarray) -> np.ndarray:
    """``(in both, only in the first, only in the second, same)`` for each pair of runs, over the rows of a block.

    An id is a place in bitmaps: one for each run, of the ids it has, and one for each answer of a run. Ids in both and
    equal answers are bits that two bitmaps share. An answer that only one run gives needs no bitmap.
    """
    number = {x: i for i, x in enumerate(dict.fromkeys(ids))}
    place, size = np.fromiter(map(number.__getitem__, ids), np.int64, len(ids)), len(number)
    runs = int(pairs.max()) + 1
    best: dict[tuple[int, int], str | None] = {}
    for r, p, key in zip(run.tolist(), place.tolist(), keys):
        known = best.get((r, p))
        if known is None or key is not None and key > known:
            best[r, p] = key
    of_run: dict[int, list[int]] = {}
    of_key: dict[str, dict[int, list[int]]] = {}
    for (r, p), key in best.items():
        of_run.setdefault(r, []).append(p)
        if key is not None:
            of_key.setdefault(key, {}).setdefault(r, []).append(p)
    words = -(-size // 64)
    out = np.zeros((len(pairs), 4), np.int64)

    def shared(members: dict[int, list[int]]) -> np.ndarray:
        maps = np.zeros((runs, words), np.uint64)
        for r, places in members.items():
            maps[r] = bits(np.array(places), size)
        has = np.zeros(runs, bool)
        has[list(members)] = True
        asked = np.flatnonzero(has[pairs].all(axis=1))
        found = np.zeros(len(pairs), np.int64)
        for some in (asked[i : i + PAIRS_AT_ONCE] for i in range(0, len(asked), PAIRS_AT_ONCE)):
            found[some] = np.bitwise_count(maps[pairs[some, 0]] & maps[pairs[some, 1]]).sum(axis=1)
        return found

    n = np.zeros(runs, np.int64)
    for r, places in of_run.items():
        n[r] = len(places)
    out[:, 0] = shared(of_run)
    out[:, 1], out[:, 2] = n[pairs[:, 0]] - out[:, 0], n[pairs[:, 1]] - out[:, 0]
    alone = bool((pairs[:, 0] == pairs[:, 1]).any())
    for members in of_key.values():
        if alone or len(members) > 1:
            out[:, 3] += shared(members)
    return out


def agreement(predictions: DataFrame, pairs: list[tuple[str, str]], on: str = "id") -> DataFrame:
    """Share of equal answers per pair of runs, with the ids only one of them has counted beside it.

    Rows are shuffled once to make answers distinct and once to their block of about ``IDS_PER_BLOCK`` ids, however many
    pairs are asked. A task then counts all pairs of a block by bitmaps and returns a row for each pair. Of several answers of a
    run to an id the largest counts; a null answer is one that equals nothing. Pairs without any id have no row.
    """
    runs = sorted({run for pair in pairs for run in pair})
    number = {run: i for i, run in enumerate(runs)}
    asked = np.array([[number[a], number[b]] for a, b in dict.fromkeys(pairs)]).reshape(-1, 2)
    which = F.create_map(*[F.lit(x) for run in runs for x in (run, number[run])]) if runs else F.create_map()
    rows = predictions.where(F.col("run").isin(runs)).select(
        F.try_element_at(which.cast("map<string,int>"), F.col("run")).alias("run"),
        F.col(on).cast("string").alias("id"),
        agreement_key(F.col("answer")).alias("key"),
    )
    rows = rows.distinct()
    known = predictions.where(F.col("run").isin(runs)).agg(F.approx_count_distinct(on)).first()[0]
    block = F.pmod(F.xxhash64(F.lit(29), "id"), F.lit(-(-known // IDS_PER_BLOCK) or 1))
    rows = rows.withColumn("block", block).repartition("block").sortWithinPartitions("block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(asked), 4), np.int64)
        current, held = None, ([], [], [])

        def close():
            if held[0]:
                total[:] += counted(np.array(held[0]), held[1], held[2], asked)
                for column in held:
                    column.clear()

        for batch in batches:
            blocks = batch["block"].to_numpy()
            cuts = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), len(blocks)]
            for a, b in zip(cuts, cuts[1:]):
                if a < b:
                    if blocks[a] != current:
                        close()
                        current = blocks[a]
                    for column, name in zip(held, ("run", "id", "key")):
                        column.extend(batch[name].slice(a, b - a).to_pylist())
        close()
        some = total[:, :3].any(axis=1)
        columns = [asked[some, 0], asked[some, 1], *total[some].T]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["a", "b", "n", "only_a", "only_b", "same"])

    found = rows.mapInArrow(run, "a long, b long, n long, only_a long, only_b long, same long")
    sums = found.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "only_a", "only_b", "same")])
    names = F.array(*[F.lit(x) for x in runs]).cast("array<string>")
    return sums.select(
        F.get(names, F.col("a").cast("int")).alias("run_a"), F.get(names, F.col("b").cast("int")).alias("run_b"),
        "n", "only_a", "only_b", F.try_divide("same", "n").alias("agreement"),
    )
