"""Approximate nearest neighbours by a permutation index.

A vector is known by its nearest pivots in order. It is posted in the inverted files of its first few pivots; a query
looks into the files of its own first few, ranks what it finds there by the footrule distance of the two orders, and
compares the best of them by true distance.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from gradeloom.llm.common import groups, stored

#: Pivots are a sample of the vectors, by a hash of the id: one for ``PER_PIVOT`` vectors, within these bounds. The most
#: is such that the files a query looks into stay a sixth of all, however large the table; blocks carry the growth.
PER_PIVOT, LEAST_PIVOTS, MOST_PIVOTS = 256, 128, 200
ORDER = 64
POSTED, PROBED = 8, 32
RERANKED = 512
BLOCK, QUERIES = 4096, 1024


def usable(vectors: DataFrame) -> DataFrame:
    """``(vec_id, embedding)`` of the rows that take part, each id once.

    Left out: null ids, and vectors that are null, empty, zero or hold null or non-finite components, or whose length is
    not the most frequent one (the smaller, if two are). Of rows that repeat an id, the vector least in order counts.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id IS NOT NULL")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    good = F.forall("embedding", finite) & F.exists("embedding", lambda x: x != 0)
    rows = rows.where(F.coalesce(good, F.lit(False)))
    rows = stored(rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "vectors")
    lengths = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("embedding") == (lengths["n"] if lengths else 0))


def choose_pivots(rows: DataFrame) -> np.ndarray:
    """A bounded sample of distinct vectors; copies of a vector give one pivot."""
    wanted = max(LEAST_PIVOTS, min(MOST_PIVOTS, rows.count() // PER_PIVOT))
    sample = rows.orderBy(F.xxhash64(F.lit(17), "vec_id"), "vec_id").limit(2 * wanted).collect()
    if not sample:
        return np.zeros((0, 0))
    found = np.array([r["embedding"] for r in sample], np.float64)
    _, first = np.unique(found, axis=0, return_index=True)
    return found[np.sort(first)[:wanted]]


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of a column of equally long lists."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy().astype(np.float64).reshape(len(flat), -1)


def orders(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``rows`` with ``nearest``: the numbers of each vector's nearest pivots, nearest first, ties by number."""
    sent = rows.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        squares = (known * known).sum(axis=1)
        for batch in batches:
            if batch.num_rows:
                found = _matrix(batch.column("embedding"))
                near = np.argsort(squares - 2 * (found @ known.T), axis=1, kind="stable")[:, :ORDER].astype(np.int32)
                nearest = pa.array(list(near), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.columns, nearest], [*batch.schema.names, "nearest"])

    kind = rows.schema["embedding"].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id long, embedding {kind}, nearest array<int>")


def footrule(query: np.ndarray, found: np.ndarray, pivots: int) -> np.ndarray:
    """Sum of differences of rank over all pivots, a pivot outside an order ranking right after its end."""
    length = found.shape[1]
    rank = np.full(pivots, length)
    rank[query] = np.arange(len(query))
    there = rank[found]
    missing = length * (length + 1) // 2 - (length - there).sum(axis=1)
    return np.abs(there - np.arange(length)).sum(axis=1) + missing


def nearest_in(queries, vectors, pivots: int, k: int):
    """``(query, vector, distance)`` by number: the ``k`` nearest of those ranked first by footrule.

    Vectors are in the order of their ids, so equal footrules and equal distances favour smaller ids.
    """
    (q_order, q_vectors, q_ids), (v_order, v_vectors, v_ids) = queries, vectors
    out = []
    for i in range(len(q_ids)):
        rule = footrule(q_order[i], v_order, pivots)
        rule[v_ids == q_ids[i]] = np.iinfo(np.int64).max
        most = min(RERANKED, len(rule))
        edge = np.partition(rule, most - 1)[most - 1]
        below, at = np.flatnonzero(rule < edge), np.flatnonzero(rule == edge)
        best = np.sort(np.concatenate([below, at[: most - len(below)]]))
        best = best[v_ids[best] != q_ids[i]]
        distance = np.sqrt(((v_vectors[best] - q_vectors[i]) ** 2).sum(axis=1))
        for j in np.argsort(distance, kind="stable")[:k]:
            out.append((int(q_ids[i]), int(v_ids[best[j]]), float(distance[j])))
    return out


def search(vectors: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest found of each row whose id ``every`` divides.

    A pivot's file is cut into blocks of about ``BLOCK`` vectors and its queries into blocks of about ``QUERIES``, so a
    vector that a third of all rows repeat makes more tasks, not a longer one. A task returns at most ``k`` rows for each
    of its queries. Distances are Euclidean, in double precision, on the vectors as given.
    """
    rows = usable(vectors)
    pivots = choose_pivots(rows)
    kinds = "query_id long, rank int, vec_id long, score double"
    if not len(pivots):
        return rows.sparkSession.createDataFrame([], kinds)
    indexed = stored(orders(rows, pivots), "orders")
    posted = indexed.select(F.explode(F.slice("nearest", 1, POSTED)).alias("pivot"), "*")
    asked = indexed.where(F.col("vec_id") % every == 0)
    asked = asked.select(F.explode(F.slice("nearest", 1, PROBED)).alias("pivot"), "*")
    sizes = _counts(indexed, POSTED, "vectors").join(
        _counts(indexed.where(F.col("vec_id") % every == 0), PROBED, "queries"), "pivot"
    )
    sizes = stored(sizes.select("pivot", F.ceil(F.col("vectors") / BLOCK).cast("int").alias("blocks"),
                                F.ceil(F.col("queries") / QUERIES).cast("int").alias("parts")), "sizes")
    own = lambda n: F.pmod(F.xxhash64(F.lit(19), "vec_id"), F.col(n)).cast("int")
    every_one = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    posted = posted.join(sizes, "pivot").withColumn("block", own("blocks")).withColumn("part", every_one("parts"))
    asked = asked.join(sizes, "pivot").withColumn("part", own("parts")).withColumn("block", every_one("blocks"))
    names = [F.xxhash64("pivot", "block", "part").alias("place"), "asks", "vec_id", "embedding", "nearest"]
    both = posted.withColumn("asks", F.lit(False)).select(*names).unionByName(asked.withColumn("asks", F.lit(True)).select(*names))
    both = both.repartition("place").sortWithinPartitions("place", "vec_id")
    n_pivots = len(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches):
            asks = table["asks"].to_numpy()
            order, found, ids = _matrix(table["nearest"]).astype(np.int64), _matrix(table["embedding"]), table["vec_id"].to_numpy()
            parts = [(order[m], found[m], ids[m]) for m in (asks, ~asks)]
            out = nearest_in(*parts, n_pivots, k) if asks.any() and not asks.all() else []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["query_id", "vec_id", "score"])

    found = both.mapInArrow(run, "query_id long, vec_id long, score double").distinct()
    by_query = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(by_query).cast("int")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _counts(indexed: DataFrame, first: int, name: str) -> DataFrame:
    return indexed.select(F.explode(F.slice("nearest", 1, first)).alias("pivot")).groupBy("pivot").agg(F.count("*").alias(name))
