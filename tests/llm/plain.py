"""The contracts of the queries in plain Python, one text at a time."""

import collections
import hashlib
import math
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
KINDS = ("email", "ip", "card", "phone")
PERSONAL = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def personal(text):
    """Spans ``(start, kind, end)`` of the base kinds, and their number by kind."""
    spans = []
    for rank, kind in enumerate(KINDS):
        for m in PERSONAL[kind].finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            right = {
                "email": lambda: True,
                "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda: 14 <= len(digits) <= 19 and luhn(digits),
                "phone": lambda: 10 <= len(digits) <= 15,
            }[kind]()
            if right:
                spans.append((m.start(), rank, m.end()))
    spans.sort()
    counts = [sum(r == k for _, r, _ in spans) for k in range(4)]
    joined = ",".join(f"{KINDS[r]}:{a}:{b}" for a, r, b in spans)
    return counts, joined, hashlib.sha256(joined.encode()).hexdigest()


def quality(text):
    words = WORD.findall(text or "")
    windows = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            covered.update(range(i, i + 8))
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    n = len(words)
    return n, sum(map(len, words)), symbols, again, len(covered), n < 20 or 100 * len(covered) > 30 * n


def licenses(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    hits = []
    for phrase, label in phrases.items():
        p = phrase.split()
        hits += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    starts = [i for i, _ in hits]
    return len(words), len(hits), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in hits}))


def shingles(text):
    words = WORD.findall(lowered(text))
    if not words:
        return set()
    if len(words) < 3:
        return {tuple(words)}
    return {tuple(words[i : i + 3]) for i in range(len(words) - 2)}


def near(docs):
    """``doc_id -> (size, component)`` of ``(doc_id, text)`` pairs by comparing all of them."""
    sets = {i: shingles(t) for i, t in docs}
    leader = {i: i for i in sets}

    def find(i):
        while leader[i] != i:
            i = leader[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                leader[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def targets(sizes):
    """Target of each source by resharing until none is above three times its size."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, out, free = sum(sizes.values()), {}, set(names)
    while free:
        level = (total - sum(out.values())) / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 3 * sizes[s]}
        if not over:
            out |= {s: weight[s] * level for s in free}
            break
        out |= {s: 3.0 * sizes[s] for s in over}
        free -= over
    return out


def crc(ids):
    return zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in ids))


def nearest(rows, query_id, k=10):
    """The nearest ``(score, vec_id)`` to a query among all other rows."""
    query = dict(rows)[query_id]
    found = [(math.dist(query, v), i) for i, v in rows if i != query_id]
    return sorted(found)[:k]


def zipf_split(scores, missing, longest, text):
    """Best sum of scores over all splits of ``text``, by the plain search over all places."""
    best = [0.0] + [-math.inf] * len(text)
    for i in range(len(text)):
        single = False
        for j in range(i + 1, min(len(text), i + longest) + 1):
            found = scores.get(text[i:j])
            if found is not None:
                single |= j == i + 1
                best[j] = max(best[j], best[i] + found[1])
        if not single:
            best[i + 1] = max(best[i + 1], best[i] + missing)
    return best[-1]
