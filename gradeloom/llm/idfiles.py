"""Files of token ids: fixed-size blocks of ids turned into planes, each plane compressed, with an index of blocks.

A file holds the ids of consecutive documents. Layout, integers little-endian:

    b"GLIDS001"
    blocks: the planes of up to ``BLOCK`` ids, each plane a zstandard frame
    index: a zstandard frame of four arrays
        block ends (uint64, places in the file), plane sizes (uint32, blocks x planes),
        document ids (int64, with a byte each that marks null), document ends (uint64, counted in ids)
    trailer: index place, index size, index raw size, blocks, documents, ids, planes, kind of plane (uint64 each)

Byte planes put the first bytes of all ids of a block together, then the second bytes and so on; bit planes do that for
each bit. High planes are almost constant and shrink to nothing, low planes shrink by what ids repeat.
"""

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, Window, functions as F

from gradeloom.llm.common import TOGETHER, WordTable, once, stored, texts, tokenizer
from gradeloom.session import scratch_path

MAGIC = b"GLIDS001"
BLOCK = 1 << 16
#: Pieces met once that a worker keeps, about 150 bytes each.
FRESH = 500_000
#: Signs that are words of their own after Latin letters.
_SIGNS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "'<")
_TRAILER = "<8Q"
KINDS = {"byte": 4, "bit": 32}


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The planes of unsigned 32-bit ids, lowest byte or bit first."""
    grid = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if kind == "bit":
        grid = np.unpackbits(grid, axis=1, bitorder="little")
        return [np.packbits(column).tobytes() for column in grid.T]
    return [column.tobytes() for column in grid.T]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    columns = [np.frombuffer(p, np.uint8) for p in planes]
    if kind == "bit":
        columns = [np.unpackbits(c, count=n) for c in columns]
        grid = np.packbits(np.stack(columns, axis=1), axis=1, bitorder="little")
    else:
        grid = np.stack(columns, axis=1)
    return np.ascontiguousarray(grid).view("<u4").ravel()


class Writer:
    """One file, written block by block under a name of its own and moved into place when complete."""

    def __init__(self, uri: str, kind: str = "byte", level: int = 3):
        self.files, self.path = fs.FileSystem.from_uri(uri)
        self.kind, self.zstd = kind, zstandard.ZstdCompressor(level=level)
        self.part = f"{self.path}.{uuid.uuid4().hex}"
        self.files.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.files.open_output_stream(self.part)
        self.out.write(MAGIC)
        self.place, self.ids = len(MAGIC), 0
        self.pending = bytearray()
        self.block_ends, self.sizes, self.doc_ids, self.nulls, self.doc_ends = [], [], [], bytearray(), []

    def _block(self, raw: bytes) -> None:
        planes = [self.zstd.compress(p) for p in to_planes(np.frombuffer(raw, "<u4"), self.kind)]
        for plane in planes:
            self.out.write(plane)
            self.place += len(plane)
        self.block_ends.append(self.place)
        self.sizes.extend(map(len, planes))

    def add(self, doc_id: int | None, raw: bytes) -> None:
        """A document's ids, as little-endian unsigned 32-bit numbers."""
        self.pending += raw
        self.ids += len(raw) // 4
        self.doc_ids.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.doc_ends.append(self.ids)
        while len(self.pending) >= 4 * BLOCK:
            self._block(bytes(self.pending[: 4 * BLOCK]))
            del self.pending[: 4 * BLOCK]

    def close(self) -> tuple[int, int]:
        """Documents and ids written."""
        if self.pending:
            self._block(bytes(self.pending))
        arrays = [(self.block_ends, "<u8"), (self.sizes, "<u4"), (self.doc_ids, "<i8")]
        raw = b"".join(np.array(a, t).tobytes() for a, t in arrays)
        raw += bytes(self.nulls) + np.array(self.doc_ends, "<u8").tobytes()
        index = self.zstd.compress(raw)
        self.out.write(index)
        self.out.write(struct.pack(
            _TRAILER,
            self.place, len(index), len(raw), len(self.block_ends), len(self.doc_ids), self.ids, KINDS[self.kind],
            int(self.kind == "bit"),
        ))
        self.out.close()
        self.files.move(self.part, self.path)
        return len(self.doc_ids), self.ids


class Reader:
    """Random access to a file by document or block, and its documents in order."""

    def __init__(self, uri: str):
        files, path = fs.FileSystem.from_uri(uri)
        self.file = files.open_input_file(path)
        self.zstd = zstandard.ZstdDecompressor()
        if self.file.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"{uri} is no file of token ids")
        tail = self.file.read_at(struct.calcsize(_TRAILER), self.file.size() - struct.calcsize(_TRAILER))
        place, size, raw_size, blocks, docs, self.ids, planes, bits = struct.unpack(_TRAILER, tail)
        self.kind = "bit" if bits else "byte"
        raw = self.zstd.decompress(self.file.read_at(size, place), max_output_size=raw_size) if raw_size else b""
        cuts = np.cumsum([0, 8 * blocks, 4 * blocks * planes, 8 * docs, docs, 8 * docs])
        part = lambda i, kind: np.frombuffer(raw[cuts[i] : cuts[i + 1]], kind)
        self.block_ends, self.sizes = part(0, "<u8"), part(1, "<u4").reshape(blocks, planes)
        self.nulls, self.doc_ends = part(3, np.uint8), part(4, "<u8")
        self.doc_ids = [None if gone else int(i) for i, gone in zip(part(2, "<i8"), self.nulls)]

    def block(self, number: int) -> np.ndarray:
        start = int(self.block_ends[number - 1]) if number else len(MAGIC)
        raw = self.file.read_at(int(self.block_ends[number]) - start, start)
        n = min(BLOCK, self.ids - number * BLOCK)
        plane_size = (n + 7) // 8 if self.kind == "bit" else n
        cuts = np.concatenate([[0], np.cumsum(self.sizes[number], dtype=np.int64)])
        planes = [
            self.zstd.decompress(raw[a:b], max_output_size=plane_size) for a, b in zip(cuts, cuts[1:])
        ]
        return from_planes(planes, n, self.kind)

    def span(self, start: int, end: int) -> np.ndarray:
        """Ids ``start`` to ``end`` of the file; reads only the blocks that hold them."""
        if end <= start:
            return np.zeros(0, "<u4")
        first = start // BLOCK
        ids = np.concatenate([self.block(b) for b in range(first, (end - 1) // BLOCK + 1)])
        return ids[start - first * BLOCK : end - first * BLOCK]

    def documents(self) -> Iterator[tuple[int | None, int, int, int]]:
        """``(doc_id, start, n, crc32)`` in file order, holding one block at a time."""
        number, block = -1, b""
        start = 0
        for doc_id, end in zip(self.doc_ids, map(int, self.doc_ends)):
            crc, at = 0, start
            while at < end:
                if at // BLOCK != number:
                    number = at // BLOCK
                    block = self.block(number).tobytes()
                stop = min(end, (number + 1) * BLOCK)
                crc = zlib.crc32(block[4 * (at - number * BLOCK) : 4 * (stop - number * BLOCK)], crc)
                at = stop
            yield doc_id, start, end - start, crc
            start = end


class Encoder:
    """Ids of texts, as little-endian unsigned 32-bit numbers.

    This vocabulary drops white space and joins nothing across it, so a text's ids are those of its pieces in a row, and
    a piece met before is not encoded again. New pieces of letters alone are encoded together: each ends in exactly one
    id that closes a word, which tells them apart again.
    """

    def __init__(self, path: str):
        loaded = tokenizer(path)
        self.library = loaded
        end = loaded.model.end_of_word_suffix
        self.closes = np.zeros(loaded.get_vocab_size(), bool)
        self.closes[[i for piece, i in loaded.get_vocab().items() if end and piece.endswith(end)]] = True
        self.table = WordTable(self._new, FRESH)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text. One call for all: a call for each costs as much as its ids."""
        return [np.array(e.ids, "<u4") for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    @staticmethod
    def pieces(text: bytes) -> list[bytes]:
        """A text's pieces between white space, case dropped as by the vocabulary unless it may name a special token."""
        return (text if b"<|" in text else text.lower()).split()

    def _new(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of pieces. Signs after Latin letters are words of their own, so a piece of both is made of two."""
        known = self.table.known
        ends: dict[bytes, bytes] = {}
        todo: dict[bytes, None] = {}
        held: dict[bytes, bytes] = {}
        for word in words:
            body = word.rstrip(_SIGNS)
            if len(body) < len(word) and body.isalpha():
                ends[word] = body
                for part in (body, word[len(body) :]):
                    if part not in held and part not in todo:
                        if (ids := known(part)) is None:
                            todo[part] = None
                        else:
                            held[part] = ids
            else:
                todo[word] = None
        texts = {w: w.decode("utf-8", "replace") for w in todo}
        plain = [w for w, t in texts.items() if t.isalpha()]
        found: dict[bytes, bytes] = {}
        for start in range(0, len(plain), 128):
            some = plain[start : start + 128]
            ids = self.ids([" ".join([texts[w] for w in some])])[0]
            stops = np.flatnonzero(self.closes[ids]) + 1
            if len(stops) == len(some) and stops[-1] == len(ids):
                raw, cuts = ids.tobytes(), [0, *(4 * stops).tolist()]
                found.update(zip(some, map(raw.__getitem__, map(slice, cuts, cuts[1:]))))
        rest = [w for w in texts if w not in found]
        for start in range(0, len(rest), TOGETHER):
            some = rest[start : start + TOGETHER]
            found.update((w, ids.tobytes()) for w, ids in zip(some, self.ids([texts[w] for w in some])))
        held |= found
        found.update((word, held[body] + held[word[len(body) :]]) for word, body in ends.items())
        return found

    def encode(self, found: list[bytes]) -> list[bytes]:
        return self.table.reduced([self.pieces(text) for text in found], b"".join)


def write(docs: DataFrame, vocabulary: str, end_id: int, folder: str | None = None, kind: str = "byte") -> DataFrame:
    """Write every document's ids in ascending ``doc_id`` order; ``(part, path, n_docs, n_ids)``, a row for each file.

    Range-sorting by id is the one shuffle; encoding, planes and compression follow in the task that writes the file, as
    a stream. A file appears under its name only when it is complete, and a task that runs again writes the same file.
    ``folder`` must be reachable by all executors (default: the shared folder). Null ids come last, equal ids follow one
    another by text, a null text is empty and has the end id alone.
    """
    folder = folder or scratch_path(docs.sparkSession, "ids")
    placed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    placed = placed.repartitionByRange(F.col("doc_id").asc_nulls_last())
    placed = placed.sortWithinPartitions(F.col("doc_id").asc_nulls_last(), "text")
    placed = placed.select(F.spark_partition_id().cast("long").alias("part"), "doc_id", "text")
    last = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, out = once("idfiles", ("ids", vocabulary), lambda: Encoder(vocabulary)), None
        for batch in (b.slice(i, TOGETHER) for b in batches for i in range(0, b.num_rows, TOGETHER)):
            if out is None:
                number = batch["part"][0].as_py()
                path = f"{folder}/ids-{number:06d}.bin"
                out = Writer(path, kind)
            for doc_id, raw in zip(batch["doc_id"].to_pylist(), encoder.encode(texts(batch))):
                out.add(doc_id, raw + last)
        if out is not None:
            n_docs, n_ids = out.close()
            yield pa.RecordBatch.from_pydict({"part": [number], "path": [path], "n_docs": [n_docs], "n_ids": [n_ids]})

    return stored(placed.mapInArrow(run, "part long, path string, n_docs long, n_ids long"), "id-files")


def read(files: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, from the files; ``start`` counts all earlier ids.

    One task for each file. The running sum has one row for each file.
    """
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    based = files.select("part", "path", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
        for batch in batches:
            for path, base in zip(batch["path"].to_pylist(), batch["base"].to_pylist()):
                rows = [(i, base + start, n, crc) for i, start, n, crc in Reader(path).documents()]
                columns = [pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 4
                yield pa.RecordBatch.from_arrays(columns, names)

    spread = based.repartitionByRange(max(1, files.count()), "part")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
