"""A Merkle manifest of a table by time-forward processing.

Digests travel up the trees as messages to nodes that come later. A node's label is its level and place; the exchange
that sorts messages by their receiver is the external priority queue, and inside a task a heap holds messages to labels
that the task itself will reach. A sweep up takes ``LEVELS`` levels at a time: the nodes below one ancestor (a block of
``FAN ** LEVELS``) meet in one task, which hands a single digest on to the next sweep. Sweeps in the reverse order then
bring each node the siblings of all its ancestors, and so each leaf its proof.
"""

import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gradeloom.llm.common import stored
from gradeloom.operators.order import numbered

FAN, LEVELS = 16, 3
BLOCK = FAN**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPERED_EVERY = 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Siblings of one level: their digests before and behind a node's own, in hex.
_SUFFIX = "array<struct<before:string,behind:string>>"


def digest(parts: list[str]) -> str:
    """Of digests in hex, taken as text."""
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(columns: list[Column]) -> Column:
    """Digest of a row: each value as byte count, colon and value; null as ``-``."""
    texts = [c.cast("string") for c in columns]
    sized = [F.concat(F.octet_length(t).cast("string"), F.lit(":"), t) for t in texts]
    return F.sha2(F.concat(*[F.coalesce(s, F.lit("-")) for s in sized]).cast("binary"), 256)


def levels(nodes: int) -> int:
    """Levels between the nodes of a tree and its top."""
    n = 0
    while nodes > 1:
        nodes, n = -(-nodes // FAN), n + 1
    return n


def forward(digests: list[str], height: int) -> tuple[str, dict]:
    """The top digest of the nodes of a block and the children of each node, by label ``(level, place)``.

    Nodes are taken from the queue in the order of their labels; a node's digest is a message to its parent, whose label
    is larger than those of all nodes still waiting below it.
    """
    queue = [(1, i // FAN, i, d) for i, d in enumerate(digests)] if height else []
    heapify(queue)
    children: dict[tuple[int, int], list[str]] = {}
    top = digests[0]
    while queue:
        level, place = queue[0][:2]
        met = []
        while queue and queue[0][:2] == (level, place):
            met.append(heappop(queue)[3])
        children[level, place] = met
        top = digest(met)
        if level < height:
            heappush(queue, (level + 1, place // FAN, place, top))
    return top, children


def backward(children: dict, height: int, n: int, suffix: list) -> list[list]:
    """For each of a block's ``n`` nodes, the siblings level by level from itself to the root.

    Labels are taken in the reverse order: a node has its suffix before its children ask for theirs.
    """
    if not height:
        return [suffix]
    known = {(height, 0): suffix}
    out: list = [None] * n
    for level, place in sorted(children, reverse=True):
        run, above = children[level, place], known.pop((level, place))
        for i in range(len(run)):
            own = [("".join(run[:i]), "".join(run[i + 1 :])), *above]
            if level > 1:
                known[level - 1, place * FAN + i] = own
            else:
                out[place * FAN + i] = own
    return out


def fold(own: str, suffix: list) -> str:
    """The root that follows from a leaf and its siblings."""
    for before, behind in suffix:
        own = digest([before, own, behind])
    return own


def proof(suffix: list) -> str:
    return digest([part for pair in suffix for part in pair])


def _gathered(rows: Iterator[pa.RecordBatch], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Rows in batches of some size."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += row.nbytes
        if size >= most:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _blocks(nodes: DataFrame, extra: list[str]) -> DataFrame:
    """``(tree, block, nodes, digests, digest, *extra)``, a row for each block, with the digest of its top.

    ``nodes`` is ``(tree, nodes, place, digest, *extra)``, ``nodes`` being how many its tree has on that level.
    """
    kinds = {f.name: f.dataType.simpleString() for f in nodes.schema}
    block = F.floor(F.col("place") / BLOCK).alias("block")
    rows = nodes.select("tree", block, "nodes", "place", "digest", *extra)
    rows = rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "place")
    keys, names = ("tree", "block", "nodes"), ["tree", "block", "nodes", "digests", "digest", *extra]

    def closed(key, held) -> pa.RecordBatch:
        digests = [d for part in held["digest"] for d in part.to_pylist()]
        top, _ = forward(digests, min(LEVELS, levels(key[2])))
        lists = [pa.concat_arrays(held[c]) for c in extra]
        columns = [pa.array([key[0]], pa.string()), *[pa.array([k], pa.int64()) for k in key[1:]]]
        columns += [pa.array([digests], pa.list_(pa.string())), pa.array([top], pa.string())]
        columns += [pa.ListArray.from_arrays(pa.array([0, len(digests)], pa.int32()), x) for x in lists]
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            key, held = None, {}
            for batch in batches:
                found = list(zip(*[batch.column(c).to_pylist() for c in keys]))
                start = 0
                for end in range(1, len(found) + 1):
                    if end < len(found) and found[end] == found[start]:
                        continue
                    if held and found[start] != key:
                        yield closed(key, held)
                        held = {}
                    key, held = found[start], held or {c: [] for c in ("digest", *extra)}
                    for c in held:
                        held[c].append(batch.column(c).slice(start, end - start))
                    start = end
            if held:
                yield closed(key, held)

        yield from _gathered(rows())

    lists = "".join(f", {c} array<{kinds[c]}>" for c in extra)
    kind = f"tree string, block long, nodes long, digests array<string>, digest string{lists}"
    return stored(rows.mapInArrow(run, kind), "merkle-blocks")


def _up(nodes: DataFrame, extra: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of each sweep from ``nodes`` to the tops, and ``(tree, digest)`` of the tops."""
    sweeps: list[DataFrame] = []
    while True:
        blocks = _blocks(nodes, extra)
        sweeps.append(blocks)
        if not (blocks.agg(F.max("nodes")).first()[0] or 0) > BLOCK:
            return sweeps, blocks.select("tree", "digest")
        above = F.ceil(F.col("nodes") / BLOCK).alias("nodes")
        nodes, extra = blocks.select("tree", above, F.col("block").alias("place"), "digest"), []


def _with_suffix(blocks: DataFrame, known: DataFrame) -> DataFrame:
    """Blocks beside the ``subroot`` and ``suffix`` of their top nodes, ``known`` as ``(tree, place, subroot, suffix)``."""
    known = known.select(F.col("tree").alias("_tree"), F.col("place").alias("_place"), "subroot", "suffix")
    same = F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("block") == F.col("_place"))
    return blocks.join(known, same).drop("_tree", "_place")


def _suffixes(row: dict) -> list[list]:
    """Of a block's nodes, from the suffix of its top."""
    height = min(LEVELS, levels(row["nodes"]))
    _, children = forward(row["digests"], height)
    suffix = [(s["before"], s["behind"]) for s in row["suffix"]]
    return backward(children, height, len(row["digests"]), suffix)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _down(blocks: DataFrame, known: DataFrame) -> DataFrame:
    """``(tree, place, subroot, suffix)`` of the nodes of ``blocks`` from that of their tops."""
    pair = pa.list_(pa.struct([("before", pa.string()), ("behind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            found = [[{"before": a, "behind": b} for a, b in s] for s in _suffixes(row)]
            n, first = len(found), row["block"] * BLOCK
            columns = [pa.array([row["tree"]] * n, pa.string()), pa.array(range(first, first + n), pa.int64())]
            columns += [pa.array([row["subroot"]] * n, pa.string()), pa.array(found, pair)]
            yield pa.RecordBatch.from_arrays(columns, ["tree", "place", "subroot", "suffix"])

    lean = _with_suffix(blocks.select("tree", "block", "nodes", "digests"), known)
    return stored(lean.mapInArrow(run, f"tree string, place long, subroot string, suffix {_SUFFIX}"), "merkle-suffixes")


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """``(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)``, a row for each row of ``docs``.

    The rows of a source are the leaves of a tree in the order of ``doc_id`` (null first, equal ids by leaf), whose
    consecutive ``FAN`` nodes have a parent while there are several; the tops of the sources, null first, then by
    UTF-8 bytes, are the leaves of the tree with the root. ``folded_root`` is computed from a row's proof, and from its
    leaf over ``text`` as it is, or as the column ``tampered`` has it where that is not null. Only ``FIELDS`` count; other
    columns may be there. Null fields are digested as such, repeated rows have a leaf each, and an empty table gives no row.

    Texts are read once, by a projection that leaves digests; what is shuffled is about 150 bytes a row, three times. No
    task holds more than a block of ``BLOCK`` nodes, and blocks of a hot source are dealt out like all others.
    """
    fields = [F.col(c) for c in FIELDS]
    changed = F.lit(None).cast("string") if tampered is None else F.when(tampered.isNotNull(), leaf([*fields[:-1], tampered]))
    found = docs.select(
        F.col("source").cast("string").alias("tree"), F.col("doc_id").cast("long").alias("doc_id"),
        leaf(fields).alias("digest"), changed.alias("changed"),
    )
    found = stored(found, "merkle-leaves")
    places = numbered(found, [F.asc_nulls_first("doc_id"), "digest"], by=["tree"], number="place", size="nodes")
    sweeps, subroots = _up(places, ["doc_id", "changed"])
    sources = numbered(subroots, [F.asc_nulls_first("tree")], number="place", size="nodes")
    sources = stored(sources.withColumnRenamed("tree", "source"), "merkle-sources").withColumn("tree", F.lit("root"))
    top_sweeps, roots = _up(sources, [])
    top = roots.first()
    root = top["digest"] if top else None
    known = roots.select("tree", F.lit(0).cast("long").alias("place"), F.lit(None).cast("string").alias("subroot"),
                         F.array().cast(_SUFFIX).alias("suffix"))
    for blocks in reversed(top_sweeps):
        known = _down(blocks, known)
    named = sources.select("source", F.col("place").alias("_at"), F.col("digest").alias("_subroot"))
    known = known.join(named, F.col("place") == F.col("_at")).select(
        F.col("source").alias("tree"), F.lit(0).cast("long").alias("place"), F.col("_subroot").alias("subroot"), "suffix"
    )
    for blocks in reversed(sweeps[1:]):
        known = _down(blocks, known)
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            suffixes, n = _suffixes(row), len(row["digests"])
            folded = [fold(c or d, s) for c, d, s in zip(row["changed"], row["digests"], suffixes)]
            columns = [row["doc_id"], row["digests"], [row["subroot"]] * n, [root] * n, list(map(proof, suffixes))]
            kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
            columns += [folded, [f == root for f in folded]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    kind = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return _with_suffix(sweeps[0], known).mapInArrow(run, kind)


def lowered_fifth(docs: DataFrame) -> Column:
    """The tampering that a check of the proofs must find: A-Z in lower case in about a fifth of the texts, by id."""
    chosen = F.crc32(F.col("doc_id").cast("long").cast("string")) % TAMPERED_EVERY == 0
    return F.when(chosen, F.translate(F.col("text").cast("string"), _UPPER, _LOWER))
