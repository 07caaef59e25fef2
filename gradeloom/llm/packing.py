"""Documents packed into sequences by a grouping genetic algorithm over the counts of their lengths.

How well documents fill sequences depends on their lengths alone, and there are no more lengths than a sequence has
tokens. So the algorithm works on counts: a bin is a pattern of lengths, a solution says how often each pattern is used,
and its size does not grow with the corpus. Islands evolve solutions in tasks of their own and hand their elite on; the
documents are then dealt out to the places of the best solution by their number among those of the same length.
"""

import json
import random
import re
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from gradeloom.llm.common import LONGEST_KEPT, TOGETHER, once, stored, tokenizer, uncollected
from gradeloom.operators.order import numbered

CAPACITY = 2048
ISLANDS, POPULATION, EPOCHS, CHILDREN = 8, 5, 4, 16
#: Patterns of a solution, for each token of a sequence. Best fit alone needs fewer; a child with more is given up.
MOST_PATTERNS = 16
#: Stretches that a worker keeps: those met twice, those met once, and parts. About 200 bytes each.
KEPT, FRESH, KEPT_PARTS = 250_000, 500_000, 100_000
#: Signs that the vocabulary never joins to a Latin letter before them.
SIGNS, BEYOND_LATIN = frozenset(".,;:!?"), "\u0250"
_CUT, _HARD = re.compile(r" (?=\S)"), re.compile(r" (?:\s|\Z)")
#: How the vocabulary cuts ASCII text before merging. Fixed: it must cut as the library does.
_PARTS = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[A-Za-z]+| ?[0-9]+| ?[^ \t-\rA-Za-z0-9]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+")
_LETTERS = re.compile("[A-Za-z]+")

Pattern = tuple[tuple[int, int], ...]
Solution = dict[Pattern, int]


class Encoder:
    """Ids of texts by a byte-level vocabulary, as little-endian unsigned 32-bit numbers.

    Nothing is merged across a space that something else than white space follows, so a text's ids are those of its
    stretches between such spaces, and a stretch met before is not encoded again. New ones are encoded together and cut
    where a token begins with the space.
    """

    def __init__(self, path: str):
        self.library = tokenizer(path)
        vocabulary = self.library.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
        self.opens[[i for token, i in vocabulary.items() if token.startswith("Ġ")]] = True
        self.newline = vocabulary["Ċ"]
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.kept: dict[str, bytes] = {}
        self.fresh: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.signs = {c: self._encoded([f"a{c}"])[0][1:].tobytes() for c in SIGNS}

    def _encoded(self, texts: list[str]) -> list[np.ndarray]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4") for e in found]

    def words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words without white space, each as if it stood alone behind a space."""
        out: dict[str, bytes] = {}
        for start in range(0, len(words), TOGETHER):
            some = words[start : start + TOGETHER]
            ids = self._encoded([" " + " ".join(some)])[0]
            starts = np.flatnonzero(self.opens[ids])
            if len(starts) == len(some) and starts[0] == 0:
                raw, cuts = ids.tobytes(), [*(4 * starts).tolist(), 4 * len(ids)]
                out.update(zip(some, map(raw.__getitem__, map(slice, cuts, cuts[1:]))))
            else:
                out.update(zip(some, [i.tobytes() for i in self._encoded([f" {w}" for w in some])]))
        return out

    def _letters(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words of ASCII letters, each as if it stood alone, at the start of a text or behind other signs."""
        out: dict[str, bytes] = {}
        for start in range(0, len(words), TOGETHER):
            some = words[start : start + TOGETHER]
            ids = self._encoded(["\n".join(some)])[0]
            stops = [*(4 * np.flatnonzero(ids == self.newline)).tolist(), 4 * len(ids)]
            raw, starts = ids.tobytes(), [0, *[s + 4 for s in stops]]
            out.update(zip(some, map(raw.__getitem__, map(slice, starts, stops))))
        return out

    def _new(self, stretches: list[str]) -> dict[str, bytes]:
        """Ids of stretches. Words go to the library together; a word with a sign behind it is made of two parts.

        Other stretches of ASCII are cut into parts, which repeat more often than they do.
        """
        words, signed, split, wanted = {}, [], {}, {}
        kept, earlier, parts = self.kept, self.fresh, self.parts
        for s in stretches:
            if s.isalpha():
                words[s] = None
            elif s[-1:] in SIGNS and (base := s[:-1]).isalpha() and base[-1] < BEYOND_LATIN:
                signed.append((s, base))
                if base not in kept and base not in earlier:
                    words[base] = None
            else:
                full = s[1:] if s[:1] == "\0" else f" {s}"
                split[s] = _PARTS.findall(full) if full.isascii() else [full] if full else []
                for p in split[s]:
                    if p[0] == " " and (word := p[1:]).isalpha():
                        if word not in kept and word not in earlier:
                            words[word] = None
                    elif p not in parts:
                        wanted[p] = None
        out = self.words(list(words))
        known = lambda w: out.get(w) or kept.get(w) or earlier[w]
        fresh = self._letters([p for p in wanted if _LETTERS.fullmatch(p)])
        rest = [p for p in wanted if p not in fresh]
        fresh.update(zip(rest, [ids.tobytes() for ids in self._encoded(rest)]))
        of = lambda p: known(p[1:]) if p[0] == " " and p[1:].isalpha() else fresh[p] if p in fresh else parts[p]
        more = {s: b"".join(map(of, found)) for s, found in split.items()}
        more.update((s, known(base) + self.signs[s[-1]]) for s, base in signed)
        if len(parts) > KEPT_PARTS:
            parts.clear()
        parts.update((p, v) for p, v in fresh.items() if len(p) <= LONGEST_KEPT)
        return out | more

    def _ids(self, split: list[list[str]]) -> list[bytes]:
        """The ids of each list of stretches. Those met twice are kept longest, so the many met once do not push them out."""
        found = [list(map(self.kept.get, stretches)) for stretches in split]
        holes, missing, earlier = [], {}, self.fresh.get
        for stretches, values in zip(split, found):
            still = []
            for at in [i for i, value in enumerate(values) if value is None]:
                stretch = stretches[at]
                value = earlier(stretch)
                if value is None:
                    missing[stretch] = None
                    still.append(at)
                else:
                    self.kept[stretch] = values[at] = value
            holes.append((stretches, values, still))
        new = self._new(list(missing))
        for stretches, values, still in holes:
            for at in still:
                values[at] = new[stretches[at]]
        if len(self.kept) > KEPT:
            self.kept.clear()
        if len(self.fresh) + len(new) > FRESH:
            self.fresh.clear()
        self.fresh.update([(s, v) for s, v in new.items() if len(s) <= LONGEST_KEPT])
        return [b"".join(values) for values in found]

    def encode(self, texts: list[str]) -> list[bytes]:
        whole = {i for i, t in enumerate(texts) if "\0" in t or any(s in t for s in self.special)}
        split = []
        for i, text in enumerate(texts):
            found = [] if i in whole or not text else _CUT.split(text) if _HARD.search(text) else text.split(" ")
            if found:
                found[0] = "\0" + found[0]
            split.append(found)
        with uncollected():
            out = self._ids(split)
        for i in whole:
            out[i] = self._encoded([texts[i]])[0].tobytes()
        return out


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and end of the pieces of ``n`` tokens; only the first may be shorter than ``capacity`` if there are several."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *[(a, a + capacity) for a in range(first, n, capacity)]] if n else []


def pieces(docs: DataFrame, vocabulary: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)`` of every document, its ids followed by ``end_id``.

    A null text is empty and has the end id alone; rows that repeat an id are documents of their own.
    """
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    last = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = once("packing", ("ids", vocabulary), lambda: Encoder(vocabulary))
        for batch in (b.slice(i, TOGETHER) for b in batches for i in range(0, b.num_rows, TOGETHER)):
            rows = []
            for doc_id, raw in zip(batch["doc_id"].to_pylist(), encoder.encode(batch["text"].to_pylist())):
                raw = memoryview(raw + last)
                for k, (a, b) in enumerate(cut(len(raw) // 4, capacity)):
                    rows.append((doc_id, k, a, b - a, zlib.crc32(raw[4 * a : 4 * b])))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return stored(kept.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long"), "packing-pieces")


# Solutions


def used(pattern: Pattern) -> int:
    return sum(length * n for length, n in pattern)


def n_bins(solution: Solution) -> int:
    return sum(solution.values())


def fitness(solution: Solution, capacity: int) -> tuple[int, float]:
    """Fewer bins are better; among equally many, unevenly filled ones, whose gaps are large enough to be of use."""
    squares = sum(m * (used(p) / capacity) ** 2 for p, m in solution.items())
    return -n_bins(solution), squares


def least_bins(demand: dict[int, int], capacity: int) -> int:
    """A number of bins that no packing can stay below."""
    counts, lengths = np.zeros(capacity + 1, np.int64), np.arange(capacity + 1)
    for length, n in demand.items():
        counts[length] += n
    n_upto, size_upto = np.cumsum(counts), np.cumsum(counts * lengths)
    half, best = capacity // 2, -(-int(size_upto[-1]) // capacity)
    for small in range(half + 1):  # those of at most ``small`` are left out, those that leave less room are alone
        alone = int(n_upto[capacity] - n_upto[capacity - small - 1]) if small < capacity else 0
        over = int(n_upto[capacity - small - 1] - n_upto[half])
        room = over * capacity - int(size_upto[capacity - small - 1] - size_upto[half])
        middle = int(size_upto[half] - size_upto[small])
        best = max(best, alone + over + max(0, -(-(middle - room) // capacity)))
    return best


def best_fit(solution: Solution, demand: dict[int, int], order: list[int], capacity: int) -> Solution:
    """Documents of the lengths in ``order`` put one by one into the fullest bin with room, or into a new one.

    All documents of a length are placed in steps over equal bins, so the work does not grow with their number.
    """
    pools: dict[int, Solution] = {}
    for pattern, m in solution.items():
        pools.setdefault(capacity - used(pattern), {})[pattern] = m
    rooms = sorted(r for r in pools if r)

    def put(pattern: Pattern, m: int, room: int) -> None:
        if m:
            if room not in pools:
                pools[room] = {}
                if room:
                    insort(rooms, room)
            pools[room][pattern] = pools[room].get(pattern, 0) + m

    def with_more(pattern: Pattern, length: int, n: int) -> Pattern:
        return tuple(sorted((*pattern, (length, n)), reverse=True)) if n else pattern

    for length in order:
        left = demand[length]
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                pattern, m = pools[room].popitem()
                if not pools[room]:
                    del pools[room], rooms[at]
            else:
                room, pattern = capacity, ()
                m = -(-left // (capacity // length))
            each = room // length
            full, rest = min(m, left // each), 0
            if full < m:
                rest = left - full * each
            put(with_more(pattern, length, each), full, room - each * length)
            if full < m:
                put(with_more(pattern, length, rest), 1, room - rest * length)
                if pattern:
                    put(pattern, m - full - 1, room)
            left -= full * each + rest
    return {p: m for pool in pools.values() for p, m in pool.items() if p}


def demand_of(solution: Solution) -> Counter:
    out: Counter = Counter()
    for pattern, m in solution.items():
        for length, n in pattern:
            out[length] += n * m
    return out


def _order(lengths, rng: random.Random, shake: float) -> list[int]:
    """Lengths from large to small, each shaken by up to a share of itself."""
    return sorted(lengths, key=lambda x: -x * (1 + shake * rng.uniform(-1, 1)))


def crossed(one: Solution, other: Solution, demand: dict[int, int], capacity: int, rng: random.Random) -> Solution:
    """Well-filled bins of ``other`` injected into ``one``, whose bins with documents already placed are taken apart."""
    room = rng.choice([0, 1, capacity // 256, capacity // 64])
    left, child = Counter(demand), {}
    for pattern, m in other.items():
        if capacity - used(pattern) <= room and rng.random() < 0.5:
            child[pattern] = m
            for length, n in pattern:
                left[length] -= n * m
    for pattern, m in sorted(one.items(), key=lambda e: (-used(e[0]), e[0])):
        kept = min(m, *[left[length] // n for length, n in pattern])
        if kept > 0:
            child[pattern] = child.get(pattern, 0) + kept
            for length, n in pattern:
                left[length] -= n * kept
    displaced = {x: n for x, n in left.items() if n}
    return best_fit(child, displaced, _order(displaced, rng, 0), capacity)


def mutated(solution: Solution, capacity: int, rng: random.Random) -> Solution:
    """The emptiest bins and some others taken apart and put back in a shaken order."""
    by_use = sorted(solution.items(), key=lambda e: (used(e[0]), e[0]))
    emptiest = by_use[: rng.randint(1, 8)]
    gone = dict(emptiest + rng.sample(by_use, min(len(by_use), rng.randint(2, 40))))
    kept = {p: m for p, m in solution.items() if p not in gone}
    displaced = demand_of(gone)
    return best_fit(kept, displaced, _order(displaced, rng, rng.choice([0, 0.02, 0.2])), capacity)


def evolve(population: list[Solution], demand: dict[int, int], capacity: int, least: int, rng: random.Random) -> list[Solution]:
    """An epoch of one island: fitter children take the place of the least fit, until nothing can be better."""
    scored = [(fitness(s, capacity), k, s) for k, s in enumerate(population)]
    order = sorted(demand, reverse=True)
    k = len(scored)
    while len(scored) < POPULATION:
        shake = 0 if not scored else rng.choice([0.01, 0.05, 0.2])
        new = best_fit({}, demand, _order(order, rng, shake), capacity)
        scored.append((fitness(new, capacity), k := k + 1, new))
    for _ in range(CHILDREN):
        scored.sort(key=lambda e: (e[0], -e[1]), reverse=True)
        if -scored[0][0][0] <= least:
            break
        del scored[POPULATION:]
        one, other = [min(rng.sample(range(len(scored)), 2)) for _ in range(2)]
        if one == other:
            new = mutated(scored[one][2], capacity, rng)
        else:
            new = crossed(scored[one][2], scored[other][2], demand, capacity, rng)
            if rng.random() < 0.5:
                new = mutated(new, capacity, rng)
        if len(new) <= MOST_PATTERNS * capacity and all(new != s for _, _, s in scored):
            scored.append((fitness(new, capacity), k := k + 1, new))
    scored.sort(key=lambda e: (e[0], -e[1]), reverse=True)
    return [s for _, _, s in scored[:POPULATION]]


def _written(solution: Solution) -> str:
    return json.dumps([[p, m] for p, m in sorted(solution.items(), reverse=True)])


def _read(text: str) -> Solution:
    return {tuple(tuple(x) for x in p): m for p, m in json.loads(text)}


def best_solution(spark: SparkSession, demand: dict[int, int], capacity: int = CAPACITY, seed: int = 11) -> Solution:
    """The best solution of islands that evolve in tasks of their own; after each epoch an island's elite moves on to the next.

    Ends early when a solution reaches the bound below which there is none.
    """
    least = least_bins(demand, capacity)
    state = spark.range(ISLANDS, numPartitions=ISLANDS).select(F.col("id").alias("island"), F.lit(None).cast("string").alias("solution"))

    def grower(epoch: int):
        def run(key, table):
            island = key[0].as_py()
            known = sorted({s for s in table["solution"].to_pylist() if s is not None})
            rng = random.Random(f"{seed}:{epoch}:{island}")
            found = evolve([_read(s) for s in known], demand, capacity, least, rng)
            return pa.table({
                "island": pa.array([island] * len(found), pa.int64()), "rank": pa.array(range(len(found)), pa.int32()),
                "bins": pa.array([n_bins(s) for s in found], pa.int64()), "solution": pa.array(map(_written, found), pa.string()),
            })

        return run

    for epoch in range(EPOCHS):
        grown = state.repartition(ISLANDS, "island").groupBy("island").applyInArrow(grower(epoch), "island long, rank int, bins long, solution string")
        grown = stored(grown, "islands")
        best = grown.orderBy("bins", "island", "rank").select("bins", "solution").first()
        if best["bins"] <= least:
            break
        elite = grown.where("rank = 0").select(((F.col("island") + 1) % ISLANDS).alias("island"), "solution")
        state = grown.select("island", "solution").unionByName(elite)
    return _read(best["solution"])


class Places:
    """Where the documents of a length go, by their number among them.

    Bins of one pattern have numbers in a row; equal documents of a pattern fill the first place of all its bins, then
    the second.
    """

    def __init__(self, solution: Solution):
        rows: dict[int, list] = {}
        met: Counter = Counter()
        first = 0
        for pattern, m in sorted(solution.items(), reverse=True):
            offset = 0
            for length, n in pattern:
                rows.setdefault(length, []).append((met[length], m, first, offset))
                met[length] += n * m
                offset += n * length
            first += m
        self.rows = {length: np.array(found, np.int64).T for length, found in rows.items()}

    def of(self, lengths: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset."""
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for length in np.unique(lengths):
            mine = lengths == length
            starts, m, first, base = self.rows[int(length)]
            row = np.searchsorted(starts, numbers[mine], side="right") - 1
            place = numbers[mine] - starts[row]
            sequence[mine] = first[row] + place % m[row]
            offset[mine] = base[row] + place // m[row] * length
        return sequence, offset


def pack(docs: DataFrame, vocabulary: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)``: a place for every piece of every document.

    Only documents of more than ``capacity`` tokens are cut. An empty table gives no row; equal documents are packed one by
    one. To the driver go the counts of at most ``capacity`` lengths and a solution of at most ``MOST_PATTERNS * capacity``
    patterns, which is also what tasks are sent. Pieces of a favourite length are numbered over all partitions that hold
    them, so they do not meet in one task.
    """
    found = pieces(docs, vocabulary, end_id, capacity)
    demand = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    kind = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    spark = docs.sparkSession
    if not demand:
        return spark.createDataFrame([], kind)
    places = spark.sparkContext.broadcast(Places(best_solution(spark, demand, capacity)))
    rows = numbered(found, [F.asc_nulls_first("doc_id"), "piece", "ids_crc32"], by=["length"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = places.value.of(batch["length"].to_numpy(), batch["number"].to_numpy())
            columns = [*batch.columns[:-1], pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "sequence_id", "offset"])

    return rows.mapInArrow(run, kind)
