"""SentencePiece encoding and decoding by a streaming Viterbi search.

The best split of a text into pieces maximises the sum of piece scores. The search keeps, for each place, the best score
up to it and where its last piece began. Only places within the longest piece of the front can still be built upon; as
soon as the best paths of all of those run through one earlier place, the pieces before it are settled, are given out
and forgotten. So a text without any space needs no more memory than the stretch on which paths still differ.
"""

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from gradeloom.llm.common import TOGETHER, WordTable, once, per_text

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
_UNITS = re.compile(f"[ {SPACE}]+[^ {SPACE}]*")
_SIGNS_LAST = re.compile(r"(.*\w)([^\w ]+)", re.DOTALL)


class Pieces:
    """A model's pieces with scores.

    Models that merge by rank store ranks for scores; Zipf's law gives their log frequency, -ln(rank + 2), up to a
    constant. Scores of unigram models are used as they are. A character that no piece covers falls back to its bytes at
    the lowest score less a penalty, or to the unknown piece where the model has no bytes.
    """

    def __init__(self, model: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        texts = [sp.id_to_piece(i) for i in range(len(sp))]
        self.bytes = {int(texts[i][1:-1], 16): i for i in range(len(sp)) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        special = [i for i in range(len(sp)) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i)]
        self.special = set(special)
        normal = [i for i in range(len(sp)) if i not in self.special]
        stored = [sp.get_score(i) for i in normal]
        ranked = all(s == int(s) for s in stored)
        self.scores = {
            texts[i]: (i, -math.log(rank + 2) if ranked else score)
            for rank, (i, score) in enumerate(zip(normal, stored))
        }
        self.longest = max(map(len, self.scores), default=1)
        self.unknown = sp.unk_id()
        self.unknown_score = min((s for _, s in self.scores.values()), default=0.0) - UNKNOWN_PENALTY
        self.texts = texts
        #: Neighbours within some piece. Any other two characters have a boundary between them in every split.
        self.pairs = {piece[i : i + 2] for piece in self.scores for i in range(len(piece) - 1)}
        #: Character to (score, id, following characters); minus infinity where no piece ends.
        self.trie: dict = {}
        for piece, (number, score) in self.scores.items():
            node = self.trie
            for c in piece[:-1]:
                node = node.setdefault(c, [-math.inf, -1, {}])[2]
            node.setdefault(piece[-1], [-math.inf, -1, {}])[:2] = score, number

    def fallback(self, character: str) -> list[int]:
        if not self.bytes:
            return [self.unknown]
        return [self.bytes[b] for b in character.encode("utf-8", "replace")]

    def split(self, text: str) -> Iterator[int]:
        """Ids of the best split of ``text``, given out as soon as they are settled.

        Where nothing reaches beyond a place, all paths run through it and the search starts anew there: between words, and
        often inside them. Where paths stay apart for long, they are followed back to the last place they share. Of equally
        good splits, the one whose last piece began earliest wins, place by place.
        """
        trie, scores, longest, missing = self.trie, self.scores, self.longest, self.unknown_score
        base, front, check = 0, 0, 4 * longest
        best, back, last = [0.0], [0], [-1]
        for i in range(len(text)):
            if i == front and i > base:
                yield from self._path(text, back, last, base, i)
                base, check = i, 4 * longest
                best, back, last = [0.0], [i], [-1]
            here, node, j = best[i - base], trie, i - base
            for c in text[i : i + longest]:
                entry = node.get(c)
                if entry is None:
                    break
                j += 1
                score, piece, node = entry
                if j == len(best):
                    best.append(-math.inf)
                    back.append(i)
                    last.append(-1)
                if here + score > best[j]:
                    best[j], back[j], last[j] = here + score, i, piece
                    if j + base > front:
                        front = j + base
            j = i + 1 - base
            if text[i] not in scores:
                if j == len(best):
                    best.append(-math.inf)
                    back.append(i)
                    last.append(-1)
                if here + missing > best[j]:
                    best[j], back[j], last[j] = here + missing, i, -1
                    front = max(front, i + 1)
            if j >= check:
                live = {p for p in range(i + 1, front + 1) if best[p - base] > -math.inf}
                while len(live) > 1:
                    furthest = max(live)
                    live.remove(furthest)
                    live.add(back[furthest - base])
                settled = live.pop()
                if settled > base:
                    yield from self._path(text, back, last, base, settled)
                    for kept in (best, back, last):
                        del kept[: settled - base]
                    base, check = settled, 4 * longest
                else:
                    check *= 2
        yield from self._path(text, back, last, base, len(text))

    def _path(self, text: str, back, last, base: int, end: int) -> list[int]:
        out: list[list[int]] = []
        while end > base:
            start, piece = back[end - base], last[end - base]
            out.append([piece] if piece >= 0 else self.fallback(text[start:end]))
            end = start
        return [i for ids in reversed(out) for i in ids]

    def spelled(self, ids) -> str:
        """The text of ids: pieces joined, byte pieces read as UTF-8, spaces for marks."""
        if self.special.isdisjoint(ids):
            return "".join([self.texts[i] for i in ids]).replace(SPACE, " ")
        out = bytearray()
        for i in ids:
            if i in self.byte_of:
                out.append(self.byte_of[i])
            elif i not in self.special:
                out += self.texts[i].encode("utf-8", "replace")
        return out.decode("utf-8", "replace").replace(SPACE, " ")

    def decode(self, ids) -> str:
        """The text of ids, without the space that encoding puts in front."""
        return self.spelled(ids).removeprefix(" ")


def units(text: str) -> list[str]:
    """Stretches of a text between places that every split must keep: before each run of spaces or space marks.

    No piece has a space mark after another character, so all paths meet there.
    """
    return _UNITS.findall(" " + text) if text else []


def encode(docs: DataFrame, model: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``ids`` of every whole text, beside the ``keep`` columns; null and empty texts have none.

    ``model`` is a SentencePiece model at a path every worker can read. Nothing is shuffled. A worker keeps the ids of a
    fixed number of short units.
    """

    def measure(texts: list[bytes]):
        table, found = _unit_table(model), []
        for i in range(0, len(texts), TOGETHER):
            split = [units(t.decode("utf-8", "replace")) for t in texts[i : i + TOGETHER]]
            found += [np.frombuffer(ids, np.int32) for ids in table.reduced(split, b"".join)]
        return (found,)

    return per_text(docs, measure, "ids array<int>", list(keep))


def decode(rows: DataFrame, model: str, ids: str = "ids") -> DataFrame:
    """``rows`` with ``text`` decoded from an ``ids`` column, in its place; null ids give null."""

    @F.pandas_udf("string")
    def text(column):
        pieces = once("pieces", ("scored pieces", model), lambda: Pieces(model))
        return column.map(lambda found: None if found is None else pieces.decode(found))

    return rows.withColumn("text", text(rows[ids]))


def _unit_table(model: str) -> WordTable:
    """Ids of units. A unit begins where all paths meet, so one met before is not searched again."""

    def build():
        pieces = once("pieces", ("scored pieces", model), lambda: Pieces(model))

        def ids_of(unit: str) -> bytes:
            return np.fromiter(pieces.split(unit.replace(" ", SPACE)), np.int32).tobytes()

        def make(found: list[str]) -> dict[str, bytes]:
            out, ends = {}, {}
            for unit in found:
                cut = _SIGNS_LAST.fullmatch(unit)
                if cut and cut[1][-1] + cut[2][0] not in pieces.pairs:
                    ends[unit] = cut.groups()
                else:
                    out[unit] = ids_of(unit)
            for unit, parts in ends.items():
                ids = b""
                for part in parts:
                    held = out.get(part) or table.known(part)
                    if held is None:
                        held = out[part] = ids_of(part)
                    ids += held
                out[unit] = ids
            return out

        table = WordTable(make)
        return table

    return once("pieces", ("unit ids", model), build)


def round_trip(docs: DataFrame, model: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Piece counts, a checksum of the ids, and whether the ids of a text decode to it again, for every whole text."""

    def measure(texts: list[bytes]):
        pieces, table, rows = once("pieces", ("scored pieces", model), lambda: Pieces(model)), _unit_table(model), []
        for i in range(0, len(texts), TOGETHER):
            raw = texts[i : i + TOGETHER]
            split = [units(t.decode("utf-8", "replace")) for t in raw]
            for text, ids in zip(raw, table.reduced(split, b"".join)):
                back = pieces.decode(np.frombuffer(ids, np.int32).tolist()).encode("utf-8", "replace") == text
                rows.append((len(ids) // 4, zlib.crc32(ids), back))
        return list(zip(*rows)) if rows else [[], [], []]

    return per_text(docs, measure, "n_pieces long, ids_crc32 long, round_trip boolean", list(keep))
