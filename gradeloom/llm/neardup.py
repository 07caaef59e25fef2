"""Near-duplicate documents by a MinHash LSH forest.

A document's signature is read from ``TREES`` starting points, which gives as many sorted orders of all documents.
Documents next to each other in an order share a long prefix there, so regions of a common prefix hold the candidates.
A region starts at as many values as the threshold allows. One with more than ``REGION`` documents goes deeper, each region by its own
need, until the parts are small. What a deeper cut may part is made up for: pairs of a large region that are still in
different components are compared block by block. Every candidate is confirmed on the full sets of shingles.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from gradeloom.llm.common import apart, groups, maybe_in, mixed, per_text, sequence_hashes, stored, texts, word_hashes

TREES = 16
STEP = 6
SIZE = TREES * STEP
DEEPER = (8, 16, 32, SIZE)
REGION = 512
ONE_TASK = 200_000
#: Most probability that a pair at the threshold meets in no tree, and that its estimate is too low to be confirmed.
UNMET, UNWORTHY = 2e-5, 1e-6
_U = np.uint64
_RANDOM = np.random.default_rng(20240229)
_FACTORS = _RANDOM.integers(1, 1 << 63, SIZE, dtype=np.uint64) * _U(2) + _U(1)
_OFFSETS = _RANDOM.integers(0, 1 << 63, SIZE, dtype=np.uint64)


class Likeness:
    """When two documents are linked: ``percent`` of their shingles of ``words`` words in common, or more.

    ``depth`` is the longest prefix, and ``worth`` the highest estimate, that miss a pair at the threshold no more often
    than ``UNMET`` and ``UNWORTHY``.
    """

    def __init__(self, words: int, percent: int):
        self.words, self.percent = words, percent
        s, below = percent / 100, 0.0
        self.depth = max([d for d in range(1, STEP + 1) if (1 - s**d) ** TREES <= UNMET], default=1)
        for same in range(SIZE + 1):
            below += math.comb(SIZE, same) * s**same * (1 - s) ** (SIZE - same)
            if below > UNWORTHY:
                break
        self.worth = same / SIZE


#: What ``op2_near_duplicates`` is to link.
NEAR = Likeness(3, 85)


def shingles(text: bytes, words: int = NEAR.words) -> np.ndarray:
    """Sorted hashes of a text's distinct runs of ``words`` words, lower case in A-Z; of all words if they are fewer."""
    h = word_hashes(text.lower().split(), "neardup")
    if not len(h):
        return h
    size = min(words, len(h))
    return np.unique(mixed(sequence_hashes(h, size) + _U(size)))


def signature(found: np.ndarray) -> bytes:
    """Least value of each hash function over the set, its highest 16 bits."""
    least = np.full(SIZE, np.iinfo(np.uint64).max, _U)
    for i in range(0, len(found), 4096):
        part = found[i : i + 4096]
        np.minimum(least, (part[None, :] * _FACTORS[:, None] + _OFFSETS[:, None]).min(axis=1), out=least)
    return (least >> _U(48)).astype(np.uint16).tobytes()


def _same_prefix(a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """For each tree, whether signatures share their prefix; (..., SIZE) to (..., TREES)."""
    same = a == b
    return same.reshape(*same.shape[:-1], TREES, STEP)[..., :depth].all(axis=-1)


def _prefix(depth: int):
    """Column: a key of the tree ``t`` and the first ``depth`` values of its order of the signature."""
    twice = F.concat("signature", "signature")
    return F.xxhash64("tree", twice.substr(F.col("tree") * (2 * STEP) + 1, F.lit(2 * depth)))


def sign(docs: DataFrame, words: int = NEAR.words, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``n_shingles, print, signature`` of every row beside ``keep``; without words, print and signature are null."""

    def measure(found: list[bytes]):
        sizes, prints, signatures = [], [], []
        for text in found:
            s = shingles(text, words)
            sizes.append(len(s))
            prints.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            signatures.append(signature(s) if len(s) else None)
        return sizes, prints, signatures

    return per_text(docs, measure, "n_shingles long, print binary, signature binary", list(keep))


def regions(classes: DataFrame, start: int) -> tuple[DataFrame, DataFrame]:
    """Regions to compare: ``(region, tree, depth, print, members)`` of those small enough, and of those that are not.

    The second has the large regions at the starting depth. Regions of one document are left out.
    """
    trees = classes.select("print", "signature", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    small, large = [], None
    for depth in (start, *DEEPER):
        keyed = trees.select("print", "signature", "tree", _prefix(depth).alias("region"))
        sizes = keyed.groupBy("region").agg(F.count("*").alias("members")).where("members > 1")
        found = keyed.select("print", "tree", "region").join(sizes, "region").withColumn("depth", F.lit(depth))
        found = stored(found, f"regions-{depth}")
        if depth == DEEPER[-1]:
            small.append(found)
            break
        small.append(found.where(F.col("members") <= REGION))
        deeper = found.where(F.col("members") > REGION)
        if large is None:
            large = deeper
        if deeper.isEmpty():
            break
        signatures = classes.select("print", "signature")
        trees = stored(deeper.select("print", "tree").join(signatures, "print"), f"deeper-{depth}")
    every = small[0]
    for part in small[1:]:
        every = every.unionByName(part)
    return every, large


def blocks(members: DataFrame) -> DataFrame:
    """A row for each pair of blocks that a region's document takes part in, with ``first`` and ``second`` block.

    Regions of up to ``REGION`` documents are one block. Nobody holds more than two blocks at a time.
    """
    count = F.ceil(F.col("members") / REGION).cast("int")
    own = F.pmod(F.xxhash64("print"), F.col("count")).cast("int")
    placed = members.withColumn("count", count).withColumn("own", own)
    other = F.explode(F.sequence(F.lit(0), F.col("count") - 1)).alias("other")
    placed = placed.select("*", other)
    return placed.select(
        "region", "tree", "depth", "print", "own",
        F.least("own", "other").alias("first"), F.greatest("own", "other").alias("second"),
    )


class _Group:
    """The documents of a pair of blocks, and which of their pairs this place has to compare."""

    def __init__(self, table: pa.Table, like: Likeness):
        self.like = like
        self.signatures = np.frombuffer(b"".join(table["signature"].to_pylist()), np.uint16).reshape(-1, SIZE)
        column = lambda n: table[n].to_numpy()
        self.rep, self.n, self.own = column("rep"), column("n_shingles"), column("own")
        self.component, self.hot = column("component"), column("hot")
        self.tree, self.depth, self.crossing = (table[n][0].as_py() for n in ("tree", "depth", "crossing"))
        self.one_block = table["first"][0].as_py() == table["second"][0].as_py()

    def pairs(self) -> np.ndarray:
        """Pairs worth confirming, two columns of row numbers, most alike first.

        A pair shares several trees and is left to the first of those that are compared at the same depth. Pairs of
        large regions are only of interest if no small region held them and their components differ.
        """
        found, scores = [np.zeros((0, 2), np.int32)], [np.zeros(0)]
        bits = np.int64(1) << np.arange(TREES, dtype=np.int64)
        small, large = self.n * 100, self.n * self.like.percent
        for i in range(len(self.rep) - 1):
            rest = np.arange(i + 1, len(self.rep), dtype=np.int32)
            fits = (small[rest] >= large[i]) & (small[i] >= large[rest]) & (self.rep[rest] != self.rep[i])
            if not self.one_block:
                fits &= self.own[rest] != self.own[i]
            if self.crossing:
                fits &= self.component[rest] != self.component[i]
            rest = rest[fits]
            alike = (self.signatures[rest] == self.signatures[i]).mean(axis=1) if len(rest) else np.zeros(0)
            rest, alike = rest[alike >= self.like.worth], alike[alike >= self.like.worth]
            if len(rest) and self.depth == self.like.depth:
                shared = _same_prefix(self.signatures[rest], self.signatures[i], self.depth)
                is_hot = (self.hot[i] & bits) != 0
                if self.crossing:
                    mine = ~(shared & ~is_hot).any(axis=1) & ~(shared & is_hot)[:, : self.tree].any(axis=1)
                else:
                    mine = ~(shared & ~is_hot)[:, : self.tree].any(axis=1)
                rest, alike = rest[mine], alike[mine]
            found.append(np.stack([np.full(len(rest), i, np.int32), rest], axis=1))
            scores.append(alike)
        found, scores = np.concatenate(found), np.concatenate(scores)
        return found[np.argsort(-scores, kind="stable")]


def candidates(
    members: DataFrame, classes: DataFrame, hot: DataFrame, known: DataFrame | None, like: Likeness
) -> DataFrame:
    """Documents with a pair worth confirming, for each pair of blocks they have one in.

    With ``known`` components, only pairs across them count. What a place gets is bounded by two blocks.
    """
    place = F.xxhash64("region", "depth", "first", "second")
    rows = blocks(members).withColumn("place", place)
    met = maybe_in(classes, "print", members.select("print"))
    rows = rows.join(met, "print").join(hot, "print", "left").withColumn("hot", F.coalesce("hot", F.lit(0).cast("long")))
    rows = rows.withColumn("crossing", F.lit(known is not None))
    if known is None:
        rows = rows.withColumn("component", F.col("rep"))
    else:
        known = known.select(F.col("node").alias("rep"), F.col("component").alias("known"))
        rows = rows.join(known, "rep", "left").withColumn("component", F.coalesce("known", "rep")).drop("known")
    rows = rows.repartition("place").sortWithinPartitions("place", "print")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches):
            wanted = np.unique(_Group(table, like).pairs())
            if len(wanted):
                yield from table.take(wanted).combine_chunks().to_batches()

    return rows.mapInArrow(run, rows.schema)


def full_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """``(print, shingles)`` of the wanted ``(holder, print)``, read again from their texts."""
    named = wanted.select(F.col("holder").alias("doc_id"), F.col("print").alias("wanted"))
    rows = maybe_in(docs.select("doc_id", "text"), "doc_id", named.select("doc_id")).join(named, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, sets = [], []
            for text, wanted in zip(texts(batch), batch["wanted"].to_pylist()):
                s = shingles(text, words)
                if xxhash.xxh3_128_digest(s.tobytes()) == wanted:
                    prints.append(wanted)
                    sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(prints, pa.binary()), pa.array(sets, pa.binary())], ["print", "shingles"])

    return rows.mapInArrow(run, "print binary, shingles binary")


def confirmed(docs: DataFrame, found: DataFrame, name: str, like: Likeness) -> DataFrame:
    """``(a, b)``: links among candidates, as many as hold their documents together.

    Pairs are confirmed from the most alike on; pairs that earlier links of the place connect need no more work.
    """
    found = stored(found, f"{name}-candidates")
    sets = stored(full_sets(docs, found.select("holder", "print").distinct(), like.words), f"{name}-sets").dropDuplicates(["print"])
    rows = found.join(sets, "print").repartition("place").sortWithinPartitions("place", "print")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches):
            group = _Group(table, like)
            sets = [np.frombuffer(s.as_buffer(), _U) for s in table["shingles"]]
            leader = list(range(len(sets)))

            def find(k):
                while leader[k] != k:
                    leader[k] = leader[leader[k]]
                    k = leader[k]
                return k

            a, b = [], []
            for i, j in group.pairs():
                if find(i) != find(j):
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * both >= like.percent * (len(sets[i]) + len(sets[j]) - both):
                        leader[find(i)] = find(j)
                        a.append(int(group.rep[i]))
                        b.append(int(group.rep[j]))
            if a:
                yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return stored(rows.mapInArrow(run, "a long, b long").distinct(), f"{name}-links")


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` of every linked node: the smallest node reachable.

    Stars in turn (each node's larger, then its smaller neighbours move to its smallest one) until nothing changes, which
    takes a number of rounds that grows with the logarithm of the longest chain. Each round is written, so a lost
    executor costs one round at most. Up to ``ONE_TASK`` edges a round is one task without any shuffle.
    """
    edges = stored(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "edges"
    )
    state = _state(edges)
    while True:
        few = state[0] <= ONE_TASK
        together = (lambda df: df.coalesce(1)) if few else (lambda df: df)
        both = together(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(together(moved.unionByName(least.select("u", F.col("m").alias("v")))).distinct(), "edges")
        before, state = state, _state(edges)
        if before == state:
            break
    tops = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops)


def _state(edges: DataFrame) -> tuple:
    """Number of edges and a sum over them, which tell whether a round changed any."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _by_class(docs: DataFrame, like: Likeness, each: bool) -> DataFrame:
    """``doc_id, n_shingles, print`` of every row, ``holder, rep`` of its class, and ``component`` of linked nodes.

    The holder is the smallest id of a class, and its node. Where classes share that id they are one node, or if ``each``, all but the
    one of least print get a number beyond all ids, so each is linked, and kept or not, on its own.
    """
    signed = stored(sign(docs, like.words), "signed")
    classes = signed.where("doc_id IS NOT NULL AND print IS NOT NULL").groupBy("print")
    classes = stored(classes.agg(F.min("doc_id").alias("holder"), F.first("n_shingles").alias("n_shingles"),
                                 F.first("signature").alias("signature")), "classes")
    shared = classes.groupBy(F.col("holder").alias("shared")).agg(F.count("*").alias("n"), F.min("print").alias("least"))
    shared = stored(shared.where("n > 1").select("shared", "least"), "shared") if each else None
    if shared is None or shared.isEmpty():
        classes = classes.withColumn("rep", F.col("holder"))
    else:
        beyond = F.lit(1 << 62).bitwiseOR(F.shiftrightunsigned(F.xxhash64("print"), 2))
        node = F.when(F.col("least") != F.col("print"), beyond).otherwise(F.col("holder"))
        classes = classes.join(shared, F.col("holder") == F.col("shared"), "left").withColumn("rep", node)
        classes = stored(classes.drop("shared", "least"), "nodes")
    small, large = regions(classes, like.depth)
    hot = stored(large.groupBy("print").agg(F.bit_or(F.expr("shiftleft(1L, tree)")).alias("hot")), "hot")
    links = confirmed(docs, candidates(small, classes, hot, None, like), "near", like)
    found = stored(components(links), "components")
    if not large.isEmpty():
        more = confirmed(docs, candidates(large, classes, hot, found, like), "far", like)
        found = stored(components(links.unionByName(more)), "components")
    rows = signed.select("doc_id", "n_shingles", "print").join(
        classes.select(F.col("print").alias("k_print"), "holder", "rep"), F.col("print") == F.col("k_print"), "left"
    )
    rows = rows.join(found, F.col("rep") == F.col("node"), "left")
    return rows.select("doc_id", "n_shingles", "print", "holder", "rep", "component")


def _typed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def near_duplicates(docs: DataFrame, like: Likeness = NEAR) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``, a row for each row of ``docs``.

    Documents are linked if the common shingles are at least ``like.percent`` of a hundred of all shingles of both. Rows
    with equal sets are one class with its smallest id for a node; only classes are compared. Without words a document
    is linked with nothing. A row without an id is linked with nothing, has no component and is kept. Classes whose
    smallest id is the same count as one document. What is sent to one place is bounded by two blocks of ``REGION``
    documents.
    """
    rows = _by_class(_typed(docs), like, each=False)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
    rows = rows.select("doc_id", "n_shingles", component.alias("component_id"))
    return rows.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, like: Likeness = NEAR) -> DataFrame:
    """The rows of ``docs`` that are kept, one for each component, with all their columns.

    Rows without an id stay, and rows that stay whatever their class is do not move. Texts that share an id are documents of their own: each stays unless it is a copy. Of rows
    that repeat an id and a set of shingles, the one least in the order of text stays.
    """
    found = _by_class(_typed(docs), like, each=True).where("doc_id IS NOT NULL")
    leads = F.coalesce("component", "rep").eqNullSafe(F.col("rep")) & F.coalesce(F.col("doc_id") == F.col("holder"), F.lit(True))
    found = stored(found.select("doc_id", F.coalesce("print", F.lit(b"")).alias("print"), leads.alias("leads")), "leads")
    ids = found.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("leads").alias("leads"))
    ids = stored(ids.where("NOT leads OR n > 1"), "not-kept-whole")
    gone = ids.select(F.col("doc_id").alias("gone"))
    some, out = apart(docs, F.col("doc_id").cast("long"), gone, "gone")
    out = out.unionByName(some.join(gone, some["doc_id"].cast("long") == F.col("gone"), "left_anti"))
    several = ids.where("leads").select("doc_id")
    if not several.isEmpty():
        kept = found.where("leads").join(several, "doc_id", "left_semi").select("doc_id", "print").distinct()
        rows = docs.join(several, "doc_id", "left_semi")
        rows = rows.select(F.struct(*docs.columns).alias("row"), "doc_id", F.col("text").cast("string").alias("text"))
        rows = sign(rows, like.words, ("row", "doc_id", "text")).withColumn("print", F.coalesce("print", F.lit(b"")))
        rows = rows.join(kept, ["doc_id", "print"], "left_semi").groupBy("doc_id", "print")
        least = F.min_by("row", F.struct("text", F.to_json("row"))).alias("row")
        out = out.unionByName(rows.agg(least).select("row.*"))
    return out
