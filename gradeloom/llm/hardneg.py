"""Hard negatives by angular triangle filtering.

Every vector keeps its angles to a few reference directions. The angle between two vectors lies between the difference
and the sum of their angles to any reference, which bounds their cosine, and with their norms their inner product. Vectors
are numbered by label, nearest reference and angle to it, and cut into windows of neighbours; a window as a whole
has an interval of angles to each reference, and only windows whose bounds meet the scores an anchor looks for are
scored, in whole numbers.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from gradeloom.llm.common import groups, stored
from gradeloom.operators.order import numbered

REFERENCES = 32
#: Rows of the sample from which reference directions and first score limits come. Results do not depend on it.
SAMPLE_ROWS = 4096
WINDOW, BLOCK, PART = 256, 8192, 16384
PENDING, TOGETHER = 1 << 20, 2048
SCALE = 256
#: Above the rounding of a stored angle (single precision) and of its arc cosine, and of a bound in double precision.
ANGLE_SLACK, SCORE_SLACK = 4e-6, 1e-9
_LOW = np.iinfo(np.int64).min


def prepared(vectors: DataFrame, every_label: int = 7, labels: int = 10) -> DataFrame:
    """``(vec_id, label, whole)`` of the rows that take part, each id once, components as whole numbers.

    Left out: null ids, labels and vectors, and vectors with null or non-finite components. Where ``every_label`` divides
    the id, the label is the next one of ``labels``. Of rows that repeat an id the least in order counts. Vectors of
    different lengths are compared as if filled up with zeros. Whole numbers are held within what keeps a hundred times a score
    in 64 bits (2²⁵ for 64 components, 131,072 before scaling).
    """
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    rows = rows.where("vec_id IS NOT NULL AND label IS NOT NULL").where(F.coalesce(F.forall("embedding", finite), F.lit(False)))
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("one")).select("vec_id", "one.*")
    room = F.shiftright(F.lit(56) - F.ceil(F.log2(F.greatest(F.size("embedding"), F.lit(1)))).cast("int"), 1)
    most = F.least(F.pow(F.lit(2.0), room), F.lit(float(1 << 30)))
    scaled = lambda x: F.floor(F.greatest(F.least(SCALE * x.cast("double"), most), -most)).cast("int")
    moved = F.when(F.col("vec_id") % every_label == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    return rows.select("vec_id", moved.alias("label"), F.transform("embedding", scaled).alias("whole"))


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Rows of a column of lists, filled up with zeros."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(flat.offsets.to_numpy())
    values = flat.flatten().to_numpy()
    if len(sizes) and (sizes == width).all():
        return values.astype(np.float64).reshape(-1, width)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def scores(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact: in double precision where all sums fit into it."""
    largest = np.abs(left).max(initial=0) * np.abs(right).max(initial=0) * left.shape[1]
    if largest < 2**53:
        return (left @ right.T).astype(np.int64)
    return left.astype(np.int64) @ right.astype(np.int64).T


def reference_directions(sample: np.ndarray, wanted: int = REFERENCES) -> np.ndarray:
    """Unit vectors of the sample, each the one farthest from those before it."""
    norms = np.linalg.norm(sample, axis=1)
    units = sample[norms > 0] / norms[norms > 0, None]
    if not len(units):
        return np.zeros((0, sample.shape[1]))
    chosen, nearest = [0], units @ units[0]
    while len(chosen) < min(wanted, len(units)):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, units @ units[chosen[-1]])
    return units[chosen]


def angles(rows: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Angles to each reference; zero vectors, whose scores are all zero, have a right angle to all."""
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    cosines = np.divide(rows @ references.T, norms, out=np.zeros((len(rows), len(references))), where=norms > 0)
    return np.arccos(np.clip(cosines, -1, 1))


def bounds(own: np.ndarray, own_norm: np.ndarray, low: np.ndarray, high: np.ndarray, norm: tuple[float, float]):
    """Least and largest score of each anchor with any vector of a window, never too narrow.

    ``low`` and ``high`` are the window's angles to each reference, ``norm`` its least and largest norm.
    """
    apart = np.maximum(np.maximum(low - own, own - high), 0).max(axis=1, initial=0) - ANGLE_SLACK
    together = np.minimum(own + high, 2 * np.pi - own - low).min(axis=1, initial=np.pi) + ANGLE_SLACK
    cos_high, cos_low = np.cos(np.clip(apart, 0, np.pi)), np.cos(np.clip(together, 0, np.pi))
    pair = lambda c: (own_norm * c * norm[0], own_norm * c * norm[1])
    slack = SCORE_SLACK * own_norm * norm[1] + 1
    return np.minimum(*pair(cos_low)) - slack, np.maximum(*pair(cos_high)) + slack


class Wanted:
    """The best ``k`` vectors so far of each asked range of scores, ties to smaller ids.

    ``least`` rises as better ones are found: what scores below cannot be among the best any more.
    """

    def __init__(self, least: np.ndarray, most: np.ndarray, k: int):
        self.least, self.most, self.k = least.copy(), most, k
        self.held, self.size = [], 0

    def add(self, asked: np.ndarray, ids: np.ndarray, found: np.ndarray) -> None:
        if len(asked):
            self.held.append((asked, ids, found))
            self.size += len(asked)
            if self.size > PENDING:
                self.best()

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(asked, id, score)``, at most ``k`` for each range."""
        if not self.held:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        asked, ids, found = (np.concatenate(c) for c in zip(*self.held))
        order = np.lexsort((ids, -found, asked))
        asked, ids, found = asked[order], ids[order], found[order]
        start = np.flatnonzero(np.r_[True, asked[1:] != asked[:-1]])
        rank = np.arange(len(asked)) - np.repeat(start, np.diff(np.r_[start, len(asked)]))
        last = rank == self.k - 1
        self.least[asked[last]] = np.maximum(self.least[asked[last]], found[last])
        kept = rank < self.k
        self.held = [(asked[kept], ids[kept], found[kept])]
        self.size = int(kept.sum())
        return self.held[0]


def _look(anchors: dict, rows: dict, wanted: Wanted, same_label: bool, counter: list[int]) -> None:
    """The rows of a window that an anchor looks for. Ranges of anchor ``i`` are ``i * n`` to ``i * n + n - 1``."""
    n = len(wanted.least) // len(anchors["id"])
    least, most = wanted.least.reshape(-1, n), wanted.most.reshape(-1, n)
    labels = np.unique(rows["label"])
    alike = np.isin(anchors["label"], labels) if same_label else (anchors["label"] != labels[0]) | (len(labels) > 1)
    low, high = bounds(anchors["angles"], anchors["norm"], rows["angles"].min(axis=0), rows["angles"].max(axis=0),
                       (rows["norm"].min(), rows["norm"].max()))
    meets = ((high[:, None] >= least) & (low[:, None] <= most) & (least <= most)).any(axis=1) & alike
    some = np.flatnonzero(meets)
    counter[0] += len(alike) * len(rows["id"])
    counter[1] += len(some) * len(rows["id"])
    for some in (some[i : i + TOGETHER] for i in range(0, len(some), TOGETHER)):
        found = scores(anchors["whole"][some], rows["whole"])
        fits = (anchors["label"][some, None] == rows["label"]) == same_label
        fits &= anchors["id"][some, None] != rows["id"]
        fits &= (found >= least[some].min(axis=1)[:, None]) & (found <= most[some].max(axis=1)[:, None])
        a, r = np.nonzero(fits)
        value, asks = found[a, r], some[a]
        for j in range(n):
            hit = (value >= least[asks, j]) & (value <= most[asks, j])
            wanted.add(asks[hit] * n + j, rows["id"][r[hit]], value[hit])


def _columns(table: pa.Table, width: int, references: int) -> dict:
    whole = _matrix(table["whole"], width)
    return {"id": table["vec_id"].to_numpy(), "label": table["label"].to_numpy(), "whole": whole,
            "angles": _matrix(table["angles"], references), "norm": np.linalg.norm(whole, axis=1)}


def _ranges(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least and largest score of each asked range, anchor by anchor, and how many an anchor has (equal for all)."""
    return tuple(table[c].combine_chunks().flatten().to_numpy() for c in ("least", "most"))


def _limited(anchors: DataFrame, sample: dict, width: int, k: int, same_label: bool) -> DataFrame:
    """Anchors with ``least`` raised to the score that ``k`` rows of the sample reach; rows below cannot be among the best."""
    sent = anchors.sparkSession.sparkContext.broadcast(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sent.value
        for batch in (b.slice(i, 1024) for b in batches for i in range(0, b.num_rows, 1024)):
            table = pa.Table.from_batches([batch])
            own = _columns(table, width, rows["angles"].shape[1])
            wanted = Wanted(*_ranges(table), k)
            for start in range(0, len(rows["id"]), WINDOW):
                part = {c: v[start : start + WINDOW] for c, v in rows.items()}
                _look(own, part, wanted, same_label, [0, 0])
            wanted.best()
            n = len(wanted.least) // len(table)
            least = pa.ListArray.from_arrays(pa.array(np.arange(len(table) + 1) * n, pa.int32()), pa.array(wanted.least))
            yield pa.RecordBatch.from_arrays([least if c == "least" else batch[c] for c in batch.schema.names], batch.schema.names)

    return anchors.mapInArrow(run, anchors.schema)


def _found(rows: DataFrame, anchors: DataFrame, blocks: int, parts: int, width: int, references: int, k: int, same_label: bool) -> DataFrame:
    """``(anchor_id, range, vec_id, score)``: the best ``k`` rows of each asked range of each anchor.

    A task meets one block of rows and one part of the anchors; neither grows with the table.
    """
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block, none = F.floor(F.col("number") / BLOCK).cast("int"), F.lit(None).cast("array<long>")
    names = ["vec_id", "label", "whole", "angles"]
    left = rows.select(block.alias("block"), every(parts).alias("part"), "number", *names, none.alias("least"), none.alias("most"))
    part = F.pmod(F.xxhash64(F.lit(23), "vec_id"), F.lit(parts)).cast("int")
    right = anchors.select(every(blocks).alias("block"), part.alias("part"), F.lit(None).cast("long").alias("number"), *names, "least", "most")
    both = left.unionByName(right).withColumn("place", (F.col("block") * F.lit(parts) + F.col("part")).cast("long")).drop("block", "part")
    both = both.repartition("place").sortWithinPartitions("place", "number", "vec_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches):
            asks = table["number"].is_null()
            asking = table.filter(asks)
            own, there = _columns(asking, width, references), _columns(table.filter(table["number"].is_valid()), width, references)
            if not len(own["id"]) or not len(there["id"]):
                continue
            wanted, counter = Wanted(*_ranges(asking), k), [0, 0]
            n = len(wanted.least) // len(own["id"])
            for start in range(0, len(there["id"]), WINDOW):
                _look(own, {c: v[start : start + WINDOW] for c, v in there.items()}, wanted, same_label, counter)
            asked, ids, found = wanted.best()
            columns = [own["id"][asked // n], (asked % n).astype(np.int32), ids, found]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor_id", "range", "vec_id", "score"])

    found = both.mapInArrow(run, "anchor_id long, range int, vec_id long, score long")
    best = Window.partitionBy("anchor_id", "range").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k)


def mine(
    vectors: DataFrame, every: int = 100, n_positives: int = 5, k: int = 10, band: tuple[int, int] = (30, 90)
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    Anchors are the rows whose id ``every`` divides; their positives the ``n_positives`` other rows of their label with the
    largest inner products; and the negatives of a positive the ``k`` rows of other labels with the largest of the products
    between the ``band`` percentages of the positive's, bounds included. Ties go to smaller ids. Anchors without positive or
    negative have no row, nor has an empty table. Columns besides ``vec_id``, ``label`` and ``embedding`` are not looked at.

    All rows are compared; the sample of ``SAMPLE_ROWS`` rows only raises the score that the best must reach. To the
    driver goes that sample alone.
    """
    spark = vectors.sparkSession
    kind = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = stored(prepared(vectors), "whole-vectors")
    size, width = rows.agg(F.count(F.lit(1)), F.max(F.size("whole"))).first()
    if not size or not width:
        return spark.createDataFrame([], kind)
    picked = rows.orderBy(F.xxhash64(F.lit(17), "vec_id"), "vec_id").limit(SAMPLE_ROWS).toArrow()
    whole = _matrix(picked["whole"], width)
    references = reference_directions(whole)
    sample = {"id": picked["vec_id"].to_numpy(), "label": picked["label"].to_numpy(), "whole": whole,
              "angles": angles(whole, references), "norm": np.linalg.norm(whole, axis=1)}
    known = spark.sparkContext.broadcast(references)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = angles(_matrix(batch["whole"], width), known.value).astype(np.float32)
            n, refs = found.shape
            near = found.argmin(axis=1) if refs else np.zeros(n, np.int64)
            nearest = found[np.arange(n), near] if refs else np.zeros(n, np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * refs, pa.int32()), pa.array(found.ravel(), pa.float32()))
            columns = [*batch.columns, lists, pa.array(near, pa.int32()), pa.array(nearest, pa.float32())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "angles", "near", "angle"])

    schema = "vec_id long, label long, whole array<int>, angles array<float>, near int, angle float"
    indexed = numbered(stored(rows.mapInArrow(placed, schema), "angles"), ["label", "near", "angle", "vec_id"])
    indexed = stored(indexed.select("number", "vec_id", "label", "whole", "angles"), "windows")
    anchors = indexed.where(F.col("vec_id") % every == 0).drop("number")
    blocks, parts = -(-size // BLOCK), max(1, -(-anchors.count() // PART))
    shape = (blocks, parts, width, len(references))
    anything = [F.array(F.lit(x).cast("long")).alias(c) for x, c in ((_LOW, "least"), (np.iinfo(np.int64).max, "most"))]
    asked = _limited(anchors.select("*", *anything), sample, width, n_positives, True)
    positives = stored(_found(indexed, asked, *shape, n_positives, True), "positives").where(F.col("score") >= 0)
    least = F.expr(f"({band[0]} * score + 99) div 100").alias("least")
    most = F.expr(f"({band[1]} * score) div 100").alias("most")
    found = positives.select("anchor_id", "rank", least, most).groupBy("anchor_id")
    found = found.agg(F.sort_array(F.collect_list(F.struct("rank", "least", "most"))).alias("found"))
    filled = lambda c, empty: F.concat(
        F.col(f"found.{c}"), F.array_repeat(F.lit(empty).cast("long"), F.lit(n_positives) - F.size("found"))
    ).alias(c)
    ranges = found.select("anchor_id", filled("least", np.iinfo(np.int64).max), filled("most", _LOW))
    asked = anchors.join(ranges, F.col("vec_id") == F.col("anchor_id")).drop("anchor_id")
    asked = stored(_limited(asked, sample, width, k, False), "ranges")
    negatives = _found(indexed, asked, *shape, k, False)
    positives = positives.select("anchor_id", (F.col("rank") - 1).alias("range"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return negatives.join(positives, ["anchor_id", "range"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
