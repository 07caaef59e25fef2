"""What the operators on words do beside their work."""

import gc
import weakref

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gradeloom.llm import common, idfiles, packing, quality, toxicity


def test_signs_and_numbers_are_encoded_together():
    """A call of the library for each new piece costs as much as its ids."""
    encoder = idfiles.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    library, calls = encoder.library, []

    class Counted:
        def encode_batch_fast(self, texts, **options):
            calls.append(len(texts))
            return library.encode_batch_fast(texts, **options)

    encoder.library = Counted()
    pieces = [f"{i}/{i * i}" for i in range(600)]
    (found,) = encoder.encode([" ".join(pieces).encode()])
    assert sum(calls) == 600 and len(calls) == 3
    wanted = library.encode(" ".join(pieces), add_special_tokens=False).ids
    assert np.frombuffer(found, "<u4").tolist() == wanted


def test_no_search_for_cycles_while_texts_are_encoded():
    encoder = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [" ".join(f"w{i}x{k}, ({k})" for k in range(300)) for i in range(100)]
    seen = []
    note = lambda phase, info: seen.append(phase)
    gc.collect()
    gc.callbacks.append(note)
    try:
        encoder.encode(texts)
    finally:
        gc.callbacks.remove(note)
    assert seen.count("start") <= 3 and gc.isenabled()


@pytest.mark.parametrize("text", ["", " \t", "abc DEF 12", "1234567 89 0 !?", "a" + "1" * 3, "a" + "1" * 4, "\x7f\x7f\x7f\x00", "é 12", "Привет мир", "\x01\x02", "??? abc"])
def test_script_of_ascii_is_that_of_its_code_points(text):
    points = np.array([ord(c) for c in text], np.uint32)
    assert quality.characters_and_script(text.encode()) == (len(text), quality.script(points[points > 32]))


def test_entropy_needs_no_count_of_the_whole_vocabulary():
    ids = np.random.default_rng(3).integers(0, 60_000, 900).astype(np.uint16)
    counts = np.bincount(ids)
    shares = counts[counts > 0] / len(ids)
    entropy = float(-(shares * np.log2(shares)).sum()) / np.log2(quality.SETTLED)
    assert quality.fertility(ids, 1800)[::2] == (2.0, min(1.0, entropy))
    assert quality.fertility(np.zeros(1, np.uint16), 3) == (3.0, 0.0, 1.0)


def test_kept_words_are_looked_up_once():
    """Gathering the words of a group in a set costs as much as their values."""
    hashed = []

    class Word(str):
        def __hash__(self):
            hashed.append(str(self))
            return super().__hash__()

    made = []
    table = common.WordTable(lambda words: made.append(len(words)) or {w: w.upper() for w in words}, fresh=6)
    for _ in range(2):
        assert table.reduced([["a", "b"], ["b"], []], list) == [["A", "B"], ["B"], []]
    assert made == [2, 0]
    hashed.clear()
    assert table.reduced([[Word("a"), Word("b")], [Word("a")]], list) == [["A", "B"], ["A"]]
    assert sorted(hashed) == ["a", "a", "b"]
    assert table.reduced([["c", "a", "c"], ["d"]], "".join) == ["CAC", "D"] and made[-1] == 2
    assert table.known("c") == "C" and table.known("x") is None


def test_pieces_of_letters_and_signs_are_parted_as_before():
    encoder = idfiles.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    text = "abc. abc abc... don't. x< (x) y); é. a1. --- ,; q'. R{}~ z[]^_` \"w\" v=+*/ s@#$%& t<|u"
    for _ in range(3):
        (found,) = encoder.encode([text.encode()])
        assert np.frombuffer(found, "<u4").tolist() == encoder.library.encode(text, add_special_tokens=False).ids


def test_words_are_hashed_with_their_ids(monkeypatch):
    """A second table of words for their hashes takes a look-up each."""
    texts = [" ".join(f"w{i % 11} é{i}" for i in range(40)).encode(), b"", b"one two"] + [b"a b c d e f g h i " * 6]
    wanted = [quality.repeated_words(t.split()) for t in texts]
    assert wanted[0] == 0 and wanted[3] == 54
    monkeypatch.setattr(quality, "per_text", lambda docs, measure, schema, keep: measure)
    monkeypatch.delattr(quality, "word_hashes")
    model = public_tokenizers.path("piece_bpe_32k.model")
    measured = quality.quality(None, model, public_tokenizers.path("byte_bpe_50k.json"))(texts)
    assert list(measured[4]) == wanted and list(quality.quality(None, model)(texts)[4]) == wanted


def test_tables_of_the_last_operator_go_at_once():
    """Also those that refer to themselves, without waiting for a search for cycles."""
    class Table:
        pass

    def build():
        table = Table()
        table.make = lambda: table
        return table

    with common.uncollected():
        gone = weakref.ref(common.once("first of two", "table", build))
        assert common.once("first of two", "table", build) is gone()
        common.once("second of two", "table", dict)
        assert gone() is None


def test_texts_are_worked_on_a_part_of_a_batch_at_a_time(spark):
    """What is made of texts is held for some rows, not for all that Spark sends at once."""
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text")).coalesce(1)
    met = common.per_text(docs, lambda found: ([len(found)] * len(found), found), "n long, same string", ["doc_id"])
    rows = met.collect()
    assert [r["doc_id"] for r in rows] == list(range(5000)) and all(r["same"] == f"text {r['doc_id']}" for r in rows)
    assert max(r["n"] for r in rows) <= common.AT_ONCE


def test_a_fit_holds_no_more_texts_than_a_part(monkeypatch):
    """Texts of a sample are read as its rows are asked for."""
    read = []
    monkeypatch.setattr(toxicity, "texts", lambda some: read.append(some.num_rows) or common.texts(some))
    n = 3 * common.AT_ONCE
    batch = pa.RecordBatch.from_pydict({"part": [1] * n, "text": [f"word{i} of many" for i in range(n)], "label": [i % 2 for i in range(n)]})
    rows = toxicity._labelled(iter([batch]))
    part, buckets, label = next(rows)
    assert (part, label) == (1, 0) and (buckets == toxicity.features(b"word0 of many")).all() and read == [common.AT_ONCE]
    assert len(list(rows)) == n - 1 and sum(read) == n
