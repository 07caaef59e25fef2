"""Quality rules: word and line counts, and the fertility of public vocabularies."""

from collections.abc import Sequence
from itertools import accumulate, chain

import sentencepiece
import numpy as np
import xxhash
from pyspark.sql import DataFrame

from gradeloom.llm.common import TOGETHER, WordTable, once, per_text, sequence_hashes, uncollected, word_hashes
from gradeloom.llm.packing import Encoder

WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
FIRST_BYTE_ID, BYTES = 3, 256
SETTLED = 200
_BYTE_IDS, _TRUE = np.array([FIRST_BYTE_ID, FIRST_BYTE_ID + BYTES], np.uint16), np.ones(1, bool)

#: Rejection bands by script: least characters per token by the piece vocabulary and by the byte vocabulary, most
#: byte-fallback share, least entropy of the tokens, by either, as a share of the highest possible. Set below the
#: lowest hundredth of prose, and above random letters and digits in groups: Latin prose has at least 1.32 and 1.46
#: characters a token, base64 1.23 and 1.30, hexadecimal digits 1.1 and 1.6, Cyrillic read in a wrong encoding 0.9 and 0.5.
BANDS = {
    "latin": (1.25, 1.35, 0.10, 0.50),
    "cyrillic": (1.25, 0.45, 0.10, 0.45),
    "greek": (0.60, 0.45, 0.30, 0.45),
    "cjk": (0.45, 0.25, 0.50, 0.45),
    "other": (0.50, 0.25, 0.50, 0.35),
    "none": (1.35, 1.00, 0.10, 0.50),
}
#: Characters of which fewer than one in ``LETTERS`` is a letter are a text in no script.
LETTERS = 4

_LATIN, _UP_TO_SPACE = bytes([*range(0x41, 0x5B), *range(0x61, 0x7B)]), bytes(range(33))
_RANGES = (
    ("latin", ((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F))),
    ("greek", ((0x370, 0x3FF),)),
    ("cyrillic", ((0x400, 0x52F),)),
    ("cjk", ((0x3040, 0x30FF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3))),
)
#: Between them lie the letters and marks of most other scripts.
_OTHERS = (0x530, 0x1FFF)


def script(points: np.ndarray) -> str:
    """The script that most letters of a text belong to; "other" for those not told apart, "none" with few letters."""
    counts = [sum(int(((points >= a) & (points <= b)).sum()) for a, b in ranges) for _, ranges in _RANGES]
    others = int(((points >= _OTHERS[0]) & (points <= _OTHERS[1])).sum())
    if LETTERS * (sum(counts) + others) < len(points):
        return "none"
    best = int(np.argmax(counts))
    return _RANGES[best][0] if counts[best] >= max(1, others) else "other"


def characters_and_script(text: bytes) -> tuple[int, str]:
    """Code points of a text, and the script of those behind the space; of ASCII, counted without an array of them."""
    if text.isascii():
        seen = text.translate(None, _UP_TO_SPACE)
        letters = len(seen) - len(seen.translate(None, _LATIN))
        return len(text), "none" if LETTERS * letters < len(seen) else "latin" if letters else "other"
    points = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    return len(points), script(points[points > 32])


def repeated_words(words: list[bytes], size: int = WINDOW, hashes: np.ndarray | None = None) -> int:
    """Words that stand in a window of ``size`` words found twice or more in the text; ``hashes`` of the words, if known."""
    windows = sequence_hashes(word_hashes(words, "quality") if hashes is None else hashes, size)
    if not len(windows):
        return 0
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(windows), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.zeros(len(words) + 1, np.int64)
    edges[:-1][: len(windows)] += twice
    edges[size : size + len(windows)] -= twice
    return int((np.cumsum(edges) > 0).sum())


def repeated_lines(text: bytes) -> int:
    lines = [line for line in text.split(b"\n") if line.strip(SPACES)]
    return len(lines) - len(set(lines))


def fertility(ids: np.ndarray, characters: int) -> tuple[float, float, float]:
    """Characters per token, share of byte-fallback tokens, and entropy of the tokens over the highest possible."""
    n = len(ids)
    if not n:
        return 0.0, 0.0, 0.0
    ranked = np.sort(ids)
    edges = np.flatnonzero(np.concatenate((_TRUE, ranked[1:] != ranked[:-1], _TRUE)))
    counts = edges[1:] - edges[:-1]
    first, end = ranked.searchsorted(_BYTE_IDS)
    fallback = int(end - first)
    shares = counts / n
    highest = np.log2(min(n, SETTLED))
    entropy = float(-(shares * np.log2(shares)).sum())
    return characters / n, fallback / n, min(1.0, entropy / highest) if highest else 1.0


def within(name: str, per_piece: float, fallback: float, entropy: float, per_token: float = np.inf, token_entropy: float = 1.0) -> bool:
    """Whether both vocabularies measure what a text in the script may have."""
    least, least_by_token, bytes_share, least_entropy = BANDS[name]
    return (
        per_piece >= least and per_token >= least_by_token and fallback <= bytes_share
        and min(entropy, token_entropy) >= least_entropy
    )


def _narrowed(flat: np.ndarray, sizes: Sequence[int]) -> list[bytes]:
    """Runs of ``sizes`` ids as 16-bit numbers."""
    raw, cuts = flat.astype(np.uint16).tobytes(), [2 * n for n in accumulate(sizes, initial=0)]
    return list(map(raw.__getitem__, map(slice, cuts, cuts[1:])))


def _word_ids(model: str, byte_model: str | None) -> WordTable:
    """Ids of words by the piece vocabulary and, if there is one, by the byte vocabulary, which sees a space before each.

    Their hash comes third. Ids of all words are narrowed at once: an array for each costs as much as its ids.
    """
    library = sentencepiece.SentencePieceProcessor(model_file=model)
    tokens = Encoder(byte_model) if byte_model else None

    def make(words: list[bytes]) -> dict[bytes, tuple[bytes, bytes, bytes]]:
        if not words:
            return {}
        texts = [w.decode("utf-8", "replace") for w in words]
        found = library.encode(texts, num_threads=1)
        first = _narrowed(np.fromiter(chain.from_iterable(found), np.uint16), list(map(len, found)))
        second = [b""] * len(words)
        if tokens:
            of = tokens.words(texts)
            wide = list(map(of.__getitem__, texts))
            second = _narrowed(np.frombuffer(b"".join(wide), "<u4"), [len(raw) // 4 for raw in wide])
        return dict(zip(words, zip(first, second, map(xxhash.xxh3_64_digest, words))))

    return WordTable(make)


def _joined(values) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids by both vocabularies and hashes of a text's words."""
    first, second, hashes = (b"".join([v[k] for v in values]) for k in range(3))
    return np.frombuffer(first, np.uint16), np.frombuffer(second, np.uint16), np.frombuffer(hashes, ">u8").astype(np.uint64)


def quality(docs: DataFrame, model: str, byte_model: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Counts, fertility and verdict of every whole text, beside the ``keep`` columns.

    ``model`` is a piece vocabulary with byte fallback, ``byte_model`` a byte-level one, both at paths every worker can
    read; without the second only the first decides. Tokens are those of each word on its own, so a worker keeps the ids of a
    fixed number of short words. ``kept`` is false for texts that fail the counts (fewer than 20 words, or more than 30% of
    them repeated) and for those outside the bands of their script; every text has a script, be it "other" or "none". Null
    reads as an empty text, which fails. Nothing is shuffled.
    """

    def measure(texts: list[bytes]):
        table, rows = once("quality", ("word ids", model, byte_model), lambda: _word_ids(model, byte_model)), []
        for start in range(0, len(texts), TOGETHER):
            some = texts[start : start + TOGETHER]
            split = [text.split() for text in some]
            with uncollected():
                found = table.reduced(split, _joined)
            for text, words, (ids, second, hashes) in zip(some, split, found):
                points, name = characters_and_script(text)
                spaces = len(text) - len(text.translate(None, SPACES))
                characters, n = points - spaces, len(words)
                repeats = repeated_words(words, hashes=hashes)
                failed = n < LEAST_WORDS or 100 * repeats > MOST_REPEATED * n
                measures = fertility(ids, characters)
                more = fertility(second, characters)[::2] if byte_model else (None, None)
                judged = (*measures, *more) if byte_model else measures
                rows.append((
                    n, characters, len(text) - len(text.translate(None, SYMBOLS)), repeated_lines(text), repeats, failed,
                    not failed and within(name, *judged), name, *measures, *more,
                ))
        return list(zip(*rows)) if rows else [[]] * 13

    schema = (
        "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
        "kept boolean, script string, chars_per_token double, byte_share double, token_entropy double, "
        "chars_per_byte_token double, byte_token_entropy double"
    )
    return per_text(docs, measure, schema, list(keep))
