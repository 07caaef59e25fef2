"""Rendering of questions, prompts and chat messages as column expressions."""

from pyspark.sql import Column, functions as F

from gradeloom import fixed


def _entries(answers: Column, keys: str | None = None) -> Column:
    entries = F.map_entries(answers)
    if keys is None:
        return entries
    return F.filter(entries, lambda e: e["key"].isin(list(keys)))


def option_lines(answers: Column, keys: str | None = None) -> Column:
    """One ``(k) text.`` line per option in map order; ``keys`` limits the options shown."""
    return F.array_join(
        F.transform(
            _entries(answers, keys),
            lambda e: F.concat(F.lit("("), e["key"], F.lit(") "), e["value"], F.lit(".")),
        ),
        "\n",
    )


def question_body(question: Column, answers: Column, keys: str | None = None) -> Column:
    """The question and its option lines, with nothing appended."""
    return F.concat(question, F.lit("\n"), option_lines(answers, keys))


def gold_letters(correct: Column) -> Column:
    """``(a) (c)`` in list order."""
    return F.array_join(F.transform(correct, lambda a: F.concat(F.lit("("), a, F.lit(")"))), " ")


def gold_options(correct: Column, answers: Column) -> Column:
    """``(a) text; (c) text``; null when a letter has no option, so that the row stays visible."""
    known = F.forall(correct, lambda a: F.array_contains(F.map_keys(answers), a))
    text = F.array_join(
        F.transform(correct, lambda a: F.concat(F.lit("("), a, F.lit(") "), F.element_at(answers, a))),
        "; ",
    )
    return F.when(known, text)


def linearize(
    question: Column,
    answers: Column,
    correct: Column | None = None,
    *,
    style: str = "open",
    left_parenthesis: bool | Column = False,
) -> Column:
    """Render one question.

    ``style`` is ``bare`` (question and options), ``open`` (ends in the answer cue, with an opened
    parenthesis on demand), ``gold`` (correct letters) or ``gold_full`` (correct letters with text).
    """
    body = question_body(question, answers)
    cue = F.lit(fixed.ANSWER_CUE)
    if style == "bare":
        return body
    if style == "open":
        opened = left_parenthesis if isinstance(left_parenthesis, Column) else F.lit(left_parenthesis)
        return F.concat(body, cue, F.when(opened, F.lit(" (")).otherwise(F.lit("")))
    if correct is None:
        raise ValueError(f"style {style!r} needs the correct answers")
    if style == "gold":
        return F.concat(body, cue, F.lit(" "), gold_letters(correct))
    if style == "gold_full":
        return F.concat(body, cue, F.lit(" "), gold_options(correct, answers), F.lit(".\n"))
    raise ValueError(f"unknown style {style!r}")


def apply_template(template: Column, body: Column) -> Column:
    """Put ``body`` at the template's ``%s``."""
    return F.replace(template, F.lit("%s"), body)


def memorization_body(question: Column, answers: Column) -> Column:
    """The question with only the shown options."""
    return question_body(question, answers, fixed.SHOWN_KEYS)


def memorization_prompt(question: Column, answers: Column) -> Column:
    """The instruction to complete all options, followed by the question with the shown ones."""
    return F.concat(F.lit(fixed.MEMORIZATION_CUE), memorization_body(question, answers))


def held_out_options(answers: Column) -> Column:
    """The option lines kept back as reference."""
    return option_lines(answers, fixed.HELD_OUT_KEYS)


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def user_messages(prompt: Column) -> Column:
    """A message list with the prompt as its only user turn."""
    return F.array(message("user", prompt))


def system_user_messages(prompt: Column, system: str = fixed.SYSTEM_TEXT) -> Column:
    """A message list with a system turn before the prompt."""
    return F.array(message("system", F.lit(system)), message("user", prompt))


def prompter_text(prompt: Column) -> Column:
    """The prompt between the literal turn markers of the prompter/assistant format."""
    before, after = fixed.PROMPTER_WRAP
    return F.concat(F.lit(before), prompt, F.lit(after))
