"""Text distances of the memorization check, in Arrow batches.

Spark's ``levenshtein`` gives only the edit cost; both distances need the characters an alignment keeps.
"""

from os.path import commonprefix

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

CELLS_PER_BLOCK = 1 << 16  # a block's arrays stay in a core's cache
LEAST_BAND = 8


def common_subsequence(left: str, right: str) -> int:
    """Length of the longest common subsequence, one machine-word operation per character of ``right``."""
    seen: dict[str, int] = {}
    for position, char in enumerate(left):
        seen[char] = seen.get(char, 0) | (1 << position)
    full = (1 << len(left)) - 1
    row = full
    for char in right:
        hit = row & seen.get(char, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(left) - row.bit_count()


def shared_ends(left: str, right: str) -> tuple[int, int]:
    """How many leading and, after them, trailing characters two texts share.

    Some cheapest script that keeps most characters keeps all of these, so only the middle needs work.
    """
    head = len(commonprefix([left, right]))
    return head, len(commonprefix([left[head:][::-1], right[head:][::-1]]))


def kept_characters(references: list[str], generated: list[str]) -> np.ndarray:
    """Characters kept by a cheapest edit script; among cheapest scripts, one that keeps most.

    All pairs advance together, one reference character per step. A cell holds ``scale * cost - kept``,
    so one minimum decides both; the running minimum covers insertions.
    """
    count = len(references)
    ref_len = np.array([len(x) for x in references])
    gen_len = np.array([len(x) for x in generated])
    width, depth = int(gen_len.max()), int(ref_len.max())
    scale = depth + width + 1
    ref_codes = np.full((count, depth), -1, dtype=np.int32)
    gen_codes = np.full((count, width), -2, dtype=np.int32)
    for i in range(count):
        ref_codes[i, : ref_len[i]] = np.frombuffer(references[i].encode("utf-32-le"), dtype=np.int32)
        gen_codes[i, : gen_len[i]] = np.frombuffer(generated[i].encode("utf-32-le"), dtype=np.int32)
    inserts = scale * np.arange(width + 1, dtype=np.int64)
    row = np.tile(inserts, (count, 1))
    final = row[np.arange(count), gen_len]
    for step in range(depth):
        best = row + scale
        diagonal = row[:, :-1] + np.where(gen_codes == ref_codes[:, step : step + 1], -1, scale)
        np.minimum(best[:, 1:], diagonal, out=best[:, 1:])
        row = np.minimum.accumulate(best - inserts, axis=1) + inserts
        done = np.flatnonzero(ref_len == step + 1)
        final[done] = row[done, gen_len[done]]
    return -final % scale


def edit_cost(left: str, right: str) -> int:
    """Cost of a cheapest edit script: a column of the table as the bits of two numbers, a step for each character."""
    if not left:
        return len(right)
    seen: dict[str, int] = {}
    for position, char in enumerate(left):
        seen[char] = seen.get(char, 0) | (1 << position)
    full, top = (1 << len(left)) - 1, 1 << (len(left) - 1)
    rises, falls, cost = full, 0, len(left)
    for char in right:
        equal = seen.get(char, 0)
        across = (((equal & rises) + rises) ^ rises) | equal
        down = equal | falls
        up, low = falls | (full & ~(across | rises)), rises & across
        cost += 1 if up & top else -1 if low & top else 0
        up, low = ((up << 1) | 1) & full, (low << 1) & full
        rises, falls = low | (full & ~(down | up)), up & down
    return cost


def kept_in_band(references: list[str], generated: list[str], band: int) -> np.ndarray:
    """Like :func:`kept_characters` for pairs whose edit cost is at most ``band``.

    No script of such a cost leaves the ``band`` diagonals on either side of the main one, so only these are kept: a step
    for each reference character over ``2 * band + 1`` cells.
    """
    count = len(references)
    ref_len = np.array([len(x) for x in references])
    gen_len = np.array([len(x) for x in generated])
    depth, cells = int(ref_len.max()), 2 * band + 1
    scale = depth + int(gen_len.max()) + 1
    ref_codes = np.full((count, depth), -1, dtype=np.int32)
    gen_codes = np.full((count, max(depth, int(gen_len.max())) + cells), -2, dtype=np.int32)
    for i in range(count):
        ref_codes[i, : ref_len[i]] = np.frombuffer(references[i].encode("utf-32-le"), dtype=np.int32)
        gen_codes[i, band : band + gen_len[i]] = np.frombuffer(generated[i].encode("utf-32-le"), dtype=np.int32)
    inserts = scale * np.arange(cells, dtype=np.int64)
    never = scale * scale
    start = np.concatenate([np.full(band, never), inserts[: band + 1]])
    row = np.tile(start, (count, 1))
    ends = gen_len - ref_len + band
    final = row[np.arange(count), ends]
    for step in range(depth):
        best = row + np.where(gen_codes[:, step : step + cells] == ref_codes[:, step : step + 1], -1, scale)
        np.minimum(best[:, :-1], row[:, 1:] + scale, out=best[:, :-1])
        row = np.minimum.accumulate(best - inserts, axis=1) + inserts
        done = np.flatnonzero(ref_len == step + 1)
        final[done] = row[done, ends[done]]
    return -final % scale


def blocks(widths: np.ndarray):
    """Slices of consecutive pairs whose longest text times their number stays within a block."""
    start, widest = 0, 0
    for position, width in enumerate(widths.tolist()):
        widest = max(widest, width)
        if position > start and widest * (position - start + 1) > CELLS_PER_BLOCK:
            yield slice(start, position)
            start, widest = position, width
    if start < len(widths):
        yield slice(start, len(widths))


def kept_of_all(pairs: list[tuple[str, str]]) -> list[int]:
    """Characters kept by each pair's cheapest script: in a band as wide as the cost where that is the smaller table."""
    kept = [0] * len(pairs)
    bands: dict[int, list[int]] = {}
    for k, (left, right) in enumerate(pairs):
        cost = edit_cost(left, right) if left and right else 0
        if cost:
            band = max(LEAST_BAND, 1 << (cost - 1).bit_length())
            bands.setdefault(band if 2 * band < len(right) else 0, []).append(k)
        else:
            kept[k] = len(left) if right else 0
    for band, members in bands.items():
        members.sort(key=lambda k: (len(pairs[k][0]), len(pairs[k][1])))
        widths = [2 * band + 1 if band else max(map(len, pairs[k])) + 1 for k in members]
        for block in blocks(np.array(widths)):
            chosen = members[block]
            texts = [pairs[k][0] for k in chosen], [pairs[k][1] for k in chosen]
            found = kept_in_band(*texts, band) if band else kept_characters(*texts)
            for k, n in zip(chosen, found.tolist()):
                kept[k] = n
    return kept


def _edit_distances(reference: pd.Series, generated: pd.Series) -> pd.Series:
    result = np.full(len(reference), None, dtype=object)
    pairs = [
        (i, left, right, *shared_ends(left, right))
        for i, (left, right) in enumerate(zip(reference, generated))
        if left and right is not None
    ]
    middles = [(a[head : len(a) - tail], b[head : len(b) - tail]) for _, a, b, head, tail in pairs]
    for (i, left, _, head, tail), inner in zip(pairs, kept_of_all(middles)):
        result[i] = 1 - round((head + inner + tail) / len(left) * 100) / 100
    return pd.Series(result, index=reference.index)


def _ratio_distances(reference: pd.Series, generated: pd.Series) -> pd.Series:
    def one(left, right):
        if left is None or right is None:
            return None
        total = len(left) + len(right)
        return 1.0 - (2.0 * common_subsequence(left, right) / total if total else 1.0)

    return pd.Series([one(a, b) for a, b in zip(reference, generated)], dtype="object")


def edit_distance(reference: Column, generated: Column) -> Column:
    """1 minus the kept share of the reference, rounded half-even to hundredths; null if it is empty."""
    return F.pandas_udf(_edit_distances, T.DoubleType())(reference, generated)


def ratio_distance(reference: Column, generated: Column) -> Column:
    """1 minus twice the common subsequence over both lengths; 0 for two empty texts."""
    return F.pandas_udf(_ratio_distances, T.DoubleType())(reference, generated)


def within_distance(reference: Column, generated: Column, at: float) -> Column:
    """Whether :func:`edit_distance` is at most ``at``; null where that is.

    A script of cost ``d`` keeps at most ``n - (d + n - m) / 2`` of ``n`` characters with ``m`` generated ones. Spark's own
    bounded edit cost gives up a pair as soon as ``d`` is beyond what that allows; only pairs it lets through are aligned.
    """
    n, m = F.char_length(reference), F.char_length(generated)
    least_kept = F.floor(n * (1 - at - 0.005)).cast("int") - 1
    most = n + m - 2 * least_kept
    bounded = F.call_function("levenshtein", reference, generated, F.greatest(most, F.lit(0)))
    possible = (F.abs(n - m) <= most) & (bounded >= 0)
    exact = edit_distance(F.when(possible, reference), generated) <= at
    return F.when((n > 0) & generated.isNotNull(), F.coalesce(exact, F.lit(False)))
