"""Reading of answer letters from free text, and letter-set helpers."""

from pyspark.sql import Column, functions as F

from gradeloom import fixed
from gradeloom.functions.text import strip


def clean(text: Column) -> Column:
    """Delete echoed instruction lines, trim and lower-case. ``(?d)``: a dot stops at ``\\n`` only."""
    return F.lower(strip(F.regexp_replace(text, f"(?d){fixed.ECHOED_INSTRUCTION}", "")))


def first_paragraph(cleaned: Column) -> Column:
    """Everything before the first blank line."""
    return F.get(F.split(cleaned, fixed.PARAGRAPH_BREAK, 2), 0)


def last_letter(num_answers: Column) -> Column:
    """The last letter a question with that many options has; no options means the whole alphabet.

    Null for an unknown number, or one beyond the alphabet: nothing is read from such a row.
    """
    size = F.when(num_answers == 0, F.lit(len(fixed.LETTERS))).otherwise(num_answers)
    return F.when(size.between(1, len(fixed.LETTERS)), F.substr(F.lit(fixed.LETTERS), size, F.lit(1)))


def parenthesized(cleaned: Column, last: Column) -> Column:
    """Letters up to ``last`` written ``(x)``, or ``x)`` at the very start, in text order.

    One constant pattern for all rows: a match holds a single letter and two matches never overlap,
    so dropping letters past ``last`` afterwards equals a pattern that ends at ``last``.
    """
    found = F.regexp_extract_all(cleaned, F.lit(fixed.PARENTHESIZED), F.lit(0))
    return F.filter(F.transform(found, lambda m: F.btrim(m, F.lit("()"))), lambda x: x <= last)


def standalone(cleaned: Column, last: Column) -> Column:
    """Letters up to ``last`` that stand alone as a word, in text order.

    This also reads the French words "a", "d'" and "c'" as letters, as the published scores do. Words
    are told apart first, by code point: looking behind a letter would see half of a rare character.
    Only the letters found become an array, never all words of a long text.
    """
    words = F.regexp_replace(cleaned, fixed.BETWEEN_WORDS, " ")
    found = F.regexp_extract_all(words, F.lit("(?<![^ ])[a-z](?![^ ])"), F.lit(0))
    return F.filter(found, lambda x: x <= last)


def letter_set(letters: Column) -> Column:
    """Distinct letters in order."""
    return F.sort_array(F.array_distinct(letters))


def parse_labels(answer: Column) -> Column:
    """``a|c`` to an array; empty text gives one empty label."""
    return F.split(answer, r"\|")


def label_count(answer: Column) -> Column:
    """Number of labels in ``a|c``, repeated ones included."""
    return F.size(parse_labels(answer))


def join_labels(labels: Column) -> Column:
    """Sorted labels as ``a|c``."""
    return F.array_join(F.sort_array(labels), "|")


def same_set(left: Column, right: Column) -> Column:
    """Equality as sets; a missing answer equals nothing."""
    return F.coalesce(letter_set(left) == letter_set(right), F.lit(False))


def same_list(left: Column, right: Column) -> Column:
    """Equality as sorted lists: repeated labels count, a missing answer equals nothing."""
    return F.coalesce(F.sort_array(left) == F.sort_array(right), F.lit(False))


def overlap(first: Column, second: Column) -> Column:
    """Elements of ``first`` found in ``second``, over the size of the union; null if both are empty.

    Symmetric (a Jaccard index) only while labels do not repeat. A missing answer has no overlap.
    """
    hits = F.size(F.filter(first, lambda x: F.array_contains(second, x)))
    share = F.try_divide(hits.cast("double"), F.size(F.array_union(first, second)))
    return F.when(first.isNull() | second.isNull(), F.lit(0.0)).otherwise(share)


def agreement_key(answer: Column) -> Column:
    """Labels sorted, concatenated and lower-cased, for comparing two prediction sets."""
    return F.lower(F.array_join(F.sort_array(parse_labels(answer)), ""))
