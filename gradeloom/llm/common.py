"""Words, hashes, tables and worker-side caches that the operators of this package share."""

import ctypes
import gc
import os
import sys
import types
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tokenizers import Tokenizer

from gradeloom.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
KEPT_WORDS, FRESH_WORDS = 220_000, 150_000
TOGETHER = 256
AT_ONCE = 4 * TOGETHER
LONGEST_KEPT = 64
_U = np.uint64
_ODD = [_U(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder; what follows reads the written rows, so lost executors cost a re-read."""
    return materialize(df, name)


def word_count(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def once(owner: str, name, build: Callable):
    """What ``build`` returns, kept by the Python worker for the next tasks of the same operator.

    A worker holds the tables of one operator at a time, so those of a pipeline's stages do not add up. Tables that refer to
    themselves would stay until a search for cycles, and freed memory with the process, so both are seen to.
    """
    store = sys.modules.setdefault("gradeloom_worker_cache", types.ModuleType("gradeloom_worker_cache")).__dict__
    if store.get("owner") != owner:
        kept, store["owner"], store["kept"] = store.get("kept"), owner, {}
        if kept:
            del kept
            _give_back()
    if name not in store["kept"]:
        store["kept"][name] = build()
    return store["kept"][name]


def _give_back() -> None:
    """Free what nothing refers to, and return freed memory to the system where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if os.name == "posix" else None
    if trim:
        trim(0)


def tokenizer(path: str) -> Tokenizer:
    """A vocabulary of the tokenizers library, without the threads by which it would take the cores of other tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer.from_file(path)


@contextmanager
def uncollected():
    """No search for cycles: with large tables at hand it takes a third of the time, and what works on them makes none."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


class WordCache(dict):
    """``make(word)`` of the words met lately. It holds a fixed number of short words, whatever the corpus."""

    def __init__(self, make: Callable):
        self.make = make

    def __missing__(self, word):
        value = self.make(word)
        if len(word) <= LONGEST_KEPT:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = value
        return value


class WordTable:
    """Values of words for a group of texts at a time: ``make`` gets all words not known and returns their values.

    Words met in two groups stay longest, so the many that are met once do not push them out. A fixed number of short
    words is held, whatever the corpus; ``fresh`` bounds those met in one group.
    """

    def __init__(self, make: Callable[[list], dict], fresh: int = FRESH_WORDS):
        self.make = make
        self.most_fresh = fresh
        self.kept: dict = {}
        self.fresh: dict = {}

    def known(self, word):
        """The value of a word if it is held, else None."""
        found = self.kept.get(word)
        return self.fresh.get(word) if found is None else found

    def reduced(self, split: list[list], reduce: Callable) -> list:
        """``reduce`` of the values of each list of words. Each word is looked up once; only those not kept are compared."""
        found = [list(map(self.kept.get, words)) for words in split]
        holes = [[i for i, value in enumerate(values) if value is None] for values in found]
        met = {words[i] for words, gaps in zip(split, holes) for i in gaps}
        again = {w: self.fresh.pop(w) for w in met & self.fresh.keys()}
        self.kept.update(again)
        new = self.make(sorted(met.difference(again)))
        if len(self.kept) > KEPT_WORDS:
            known = {w: self.kept[w] for w in set().union(*split) & self.kept.keys()}
            self.kept.clear()
            self.kept.update(known)
        for words, values, gaps in zip(split, found, holes):
            for i in gaps:
                value = new.get(words[i])
                values[i] = again[words[i]] if value is None else value
        out = [reduce(values) for values in found]
        if len(self.fresh) + len(new) > self.most_fresh:
            self.fresh.clear()
        self.fresh.update((w, v) for w, v in new.items() if len(w) <= LONGEST_KEPT)
        return out


def word_hashes(words: list[bytes], owner: str) -> np.ndarray:
    """64-bit hashes of words, for an operator."""
    cache = once(owner, "word hashes", lambda: WordCache(xxhash.xxh3_64_intdigest))
    return np.fromiter(map(cache.__getitem__, words), _U, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _ODD[3]
    return h ^ (h >> _U(29))


def sequence_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of ``size`` neighbours."""
    total = np.zeros(max(0, len(h) - size + 1), _U)
    for i in range(size):
        total = mixed(total + _ODD[0]) + h[i : i + len(total)] * _ODD[i % 3]
    return mixed(total)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a text column; null reads as an empty text."""
    return [t or b"" for t in batch.column(name).cast(pa.binary()).to_pylist()]


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of ``AT_ONCE`` rows, so that what is made of texts is held for so many at a time."""
    for i in range(0, batch.num_rows, AT_ONCE):
        yield batch.slice(i, AT_ONCE)


def per_text(df: DataFrame, measure: Callable, schema: str, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns beside what ``measure(list of texts)`` returns: one list for each column of ``schema``.

    Works on Arrow batches, which Spark bounds in rows and bytes; no row meets another, so nothing is shuffled.
    """
    kept = df.select(*keep, F.col(text).cast("string").alias("text")) if text not in keep else df.select(*keep)
    out = [f.strip() for f in schema.split(",")]
    wanted = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name in keep), *out])
    arrow = [_arrow(f.split()[1]) for f in out]
    names = [f.split()[0] for f in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (some for whole in batches for some in slices(whole)):
            columns = measure(texts(batch))
            yield pa.RecordBatch.from_arrays(
                [batch.column(k) for k in keep] + [pa.array(c, t) for c, t in zip(columns, arrow)], keep + names
            )

    return kept.mapInArrow(run, wanted)


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of each ``place``, which stand together, one group at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column("place").to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(keys)]
        for a, b in zip(cuts, cuts[1:]):
            if held and held[0].column("place")[0].as_py() != keys[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


MARKS = 1 << 24
_PAGE = 1 << 15


def _with_marks(df: DataFrame, column: Column, keys: Column, of: DataFrame, flag: str) -> DataFrame:
    """``df`` with a boolean ``flag``: whether ``column`` may be among the ``keys`` of the other table."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(MARKS)).cast("int")
    page = lambda c: (place(c) / _PAGE).cast("int")
    marks = of.select(page(keys).alias("_page"), F.bitmap_bit_position(place(keys) % _PAGE + 1).alias("_bit"))
    marks = stored(marks.groupBy("_page").agg(F.bitmap_construct_agg("_bit").alias("_marks")), "marks")
    found = df.join(F.broadcast(marks), page(column) == F.col("_page"), "left")
    byte = F.shiftright(place(column) % _PAGE, 3)
    marked = F.conv(F.hex(F.col("_marks").substr(byte + 1, F.lit(1))), 16, 10).cast("int")
    marked = F.coalesce(F.getbit(marked, place(column) % 8) == 1, F.lit(False))
    return found.select(*[df[c] for c in df.columns], marked.alias(flag))


def maybe_in(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``column`` may be among the ``keys`` (of the same name); a join decides afterwards.

    Keys mark places of a bitmap of ``MARKS`` places, which goes to all tasks: 2 MB, whatever the number of keys. It
    spares a join the shuffle of rows without a partner; the more keys there are, the more rows it lets through.
    """
    return _with_marks(df, F.col(column), F.col(column), keys, "_maybe").where("_maybe").drop("_maybe")


def apart(df: DataFrame, column: Column, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The rows of ``df`` whose ``column`` may be among the values of ``key``, and those where it surely is not.

    Only the first need a join to change or drop some of them; the others stay where they are. See :func:`maybe_in`.
    """
    flag = "_maybe"
    while flag in df.columns:
        flag += "_"
    marked = _with_marks(df, column, F.col(key), keys, flag)
    return marked.where(F.col(flag)).drop(flag), marked.where(~F.col(flag)).drop(flag)


def _arrow(kind: str) -> pa.DataType:
    plain = {
        "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(),
        "boolean": pa.bool_(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()),
    }
    return plain[kind]
