"""Reading of answers, against a character-by-character reading of the same rules."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from gradeloom import fixed
from gradeloom.functions import letters, text as X
from gradeloom.operators.answers import extract_answers

ECHO = "Ceci est une question de QCM"


def is_word(char):
    return char == "_" or unicodedata.category(char)[0] in "LN"


def read_slowly(raw, size, stop):
    kept = []
    for line in raw.split("\n"):
        kept.append(line[: line.index(ECHO)] if ECHO in line else line)
    clean = "\n".join(kept).strip().lower()
    if stop:
        lines = clean.split("\n")
        for i in range(1, len(lines) - 1):
            if lines[i].strip(" \t") == "":
                clean = "\n".join(lines[:i])
                break
    allowed = fixed.LETTERS[: size or 26]
    found = [clean[0]] if len(clean) > 1 and clean[0] in allowed and clean[1] == ")" else []
    for i in range(len(clean) - 2):
        if clean[i] == "(" and clean[i + 1] in allowed and clean[i + 2] == ")":
            found.append(clean[i + 1])
    if not found:
        for i, char in enumerate(clean):
            before = clean[i - 1] if i else " "
            after = clean[i + 1] if i + 1 < len(clean) else " "
            if char in allowed and not is_word(before) and not is_word(after):
                found.append(char)
    return sorted(set(found)) or ["a"]


PIECES = [
    "a", "b", "c", "E", "f", "z", "(a)", "(B)", "(c)", "(g)", "a)", "D)", "(", ")", " ", "  ", "\n", "\n\n", "\n \t\n",
    "\t", "été", "d'un", "l'à", "_a", "a_", "1", "²", "é", "́", "\xa0", " ", "\x1c", "\r", " ", "İ", "ß",
    ECHO, ECHO + " (e) ", ECHO.lower(), ".", ",", "-a-", "日本a語", "𝒜", "ａ",
]


@pytest.fixture(scope="module")
def random_rows():
    rng = random.Random(7)
    return [
        ("".join(rng.choice(PIECES) for _ in range(rng.randint(0, 12))), rng.randint(0, 8), bool(rng.getrandbits(1)))
        for _ in range(4000)
    ]


def test_random_texts(spark, random_rows):
    df = spark.createDataFrame(random_rows, "generated string, size int, stop boolean")
    read = extract_answers(df, num_answers="size", paragraph_stop=F.col("stop")).collect()
    assert len(read) == len(random_rows)
    for r in read:
        assert r["labels"] == read_slowly(r["generated"], r["size"], r["stop"]), repr(r)


@pytest.mark.parametrize(
    "raw,size,stop,wanted",
    [
        ("A) oui (c) (f)", 5, False, ["a", "c"]),
        ("l'à b et été a", 5, False, ["a", "b"]),
        ("d'un c'est", 5, False, ["c", "d"]),
        ("", 5, False, ["a"]),
        ("x\n \t\ny (b)", 5, True, ["a"]),
        ("x\n \t\ny (b)", 5, False, ["b"]),
        ("(B) (b) (E)", 5, False, ["b", "e"]),
        ("(g)", 7, False, ["g"]),
        (ECHO + " (e)\n(b)", 5, False, ["b"]),
        ("(z)", 0, False, ["z"]),
    ],
)
def test_known_texts(spark, raw, size, stop, wanted):
    df = spark.createDataFrame([(raw, size)], "generated string, size int")
    row = extract_answers(df, num_answers="size", paragraph_stop=stop).first()
    assert row["labels"] == wanted


def test_defaulted_marks_silence(spark):
    df = spark.createDataFrame([("rien",), ("(a)",)], "generated string")
    assert [r["defaulted"] for r in extract_answers(df).collect()] == [True, False]


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text,wanted",
    [("a[/INST]b[/INST]c", "b"), ("no mark", None), ("[/INST]", ""), ("[/INST] (a)\n", " (a)\n")],
)
def test_after_marker(spark, text, wanted):
    assert one(spark, X.after_marker(F.col("t")), t=text) == wanted


@pytest.mark.parametrize(
    "text,wanted",
    [
        ("x<|assistant|>\n(a)\nb", "(a)"),
        ("<|assistant|>\n1\n<|assistant|>\n2\n3", "2"),
        ("one line", None),
        ("a\nb\nc", "b"),
        ("x<|assistant|>tail", None),
    ],
)
def test_chat_second_line(spark, text, wanted):
    assert one(spark, X.chat_second_line(F.col("t")), t=text) == wanted


def test_strip_echo_goes_by_length(spark):
    cut = X.strip_echo(F.col("g"), F.col("p"))
    assert one(spark, cut, g="éàü suite", p="xxx") == " suite"
    assert one(spark, cut, g="ab", p="longer") == ""


def test_before_marker_and_first_line(spark):
    assert one(spark, X.before_marker(F.col("t")), t="(a) # b # c") == "(a) "
    assert one(spark, X.before_marker(F.col("t")), t="plain") == "plain"
    assert one(spark, X.first_line(F.col("t")), t="x\ny") == "x"


@pytest.mark.parametrize("answer,wanted", [("a|b", 2), ("a|a", 2), ("", 1), ("a", 1)])
def test_label_count(spark, answer, wanted):
    assert one(spark, letters.label_count(F.col("t")), t=answer) == wanted
