"""Token counts by a linear longest-match automaton.

Word pieces are taken from the left, always the longest that the vocabulary has. The vocabulary is a trie; a node that
cannot go on says where matching resumes (its failure link) and how many pieces were completed on the way there. So a
word of n bytes takes O(n) steps, and no piece is ever built.
"""

import json
import re
import unicodedata
from collections import deque

from pyspark.sql import DataFrame

from gradeloom.llm.common import WordCache, once, per_text

END = 256
_SYMBOLS = 512
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|[^\w\s]+|_+")


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies write for bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def vocabulary(path: str) -> list[tuple[int, ...]]:
    """A word vocabulary's pieces as symbols: bytes, and ``END`` where a piece closes its word."""
    with open(path, encoding="utf-8") as file:
        tokenizer = json.load(file)
    end, special = tokenizer["model"]["end_of_word_suffix"], {t["content"] for t in tokenizer["added_tokens"]}
    of = byte_symbols()
    pieces = []
    for piece in tokenizer["model"]["vocab"]:
        if piece not in special:
            closed = piece.endswith(end)
            body = piece.removesuffix(end) if closed else piece
            pieces.append((*(of[c] for c in body), *([END] if closed else [])))
    return pieces


class Automaton:
    """Counts the pieces of a word. A lone word end counts nothing, and a byte the vocabulary lacks counts as a piece."""

    def __init__(self, pieces: list[tuple[int, ...]]):
        step: dict[int, int] = {}
        worth, nodes = {0: None}, 1
        for piece in [*pieces, *((s,) for s in range(END + 1))]:
            node = 0
            for symbol in piece:
                key = node * _SYMBOLS + symbol
                if key not in step:
                    step[key], worth[nodes] = nodes, None
                    nodes += 1
                node = step[key]
            worth[node] = 0 if piece == (END,) else 1
        children: dict[int, list[tuple[int, int]]] = {}
        for key, node in step.items():
            children.setdefault(key // _SYMBOLS, []).append((key % _SYMBOLS, node))
        resume, popped = [0] * nodes, [0] * nodes
        waiting = deque([0])
        while waiting:
            above = waiting.popleft()
            for symbol, node in children.get(above, ()):
                waiting.append(node)
                if worth[node] is not None:
                    popped[node] = worth[node]
                    continue
                at, done = resume[above], popped[above]
                while at * _SYMBOLS + symbol not in step:
                    done += popped[at]
                    at = resume[at]
                resume[node], popped[node] = step[at * _SYMBOLS + symbol], done
        self.step, self.resume, self.popped = step, resume, popped

    def count(self, word: bytes) -> int:
        step, resume, popped = self.step, self.resume, self.popped
        node = count = 0
        for symbol in (*word, END):
            following = step.get(node * _SYMBOLS + symbol)
            while following is None:
                count += popped[node]
                node = resume[node]
                following = step.get(node * _SYMBOLS + symbol)
            node = following
        while node:
            count += popped[node]
            node = resume[node]
        return count


def parts(chunk: str) -> list[str]:
    """The words of a text without white space: letter runs, single digits, runs of other signs, English endings."""
    return _PARTS.findall(unicodedata.normalize("NFC", chunk).lower())


def token_counts(docs: DataFrame, vocab: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``n_words`` and ``n_tokens`` of every whole text, beside the ``keep`` columns.

    ``vocab`` is a byte-level word vocabulary with word ends, at a path every worker can read. A null or empty text has
    none of either; repeated rows are counted each. Nothing is shuffled. A worker keeps the counts of a fixed number of
    short chunks between white space; longer ones are counted anew in linear time.
    """

    def measure(texts: list[bytes]):
        automaton = once("tokens", ("automaton", vocab), lambda: Automaton(vocabulary(vocab)))

        def make(chunk: str):
            found = parts(chunk)
            return len(found), sum(automaton.count(w.encode()) for w in found)

        cache = once("tokens", ("chunk counts", vocab), lambda: WordCache(make))
        words, tokens = [], []
        for text in texts:
            counts = [cache[c] for c in text.decode("utf-8", "replace").split()]
            words.append(sum(c[0] for c in counts))
            tokens.append(sum(c[1] for c in counts))
        return words, tokens

    return per_text(docs, measure, "n_words long, n_tokens long", list(keep))
