"""Cutting of generated text. Plain built-ins; null marks text the cut does not apply to."""

from pyspark.sql import Column, functions as F

from gradeloom import fixed


def strip_echo(generated: Column, prompt: Column) -> Column:
    """Drop as many characters as the prompt has, whatever they are."""
    return F.substr(generated, F.length(prompt) + F.lit(1))


def after_marker(text: Column, marker: str = fixed.INSTRUCTION_END) -> Column:
    """Text from the first marker to the next one; null without a marker."""
    return F.when(F.contains(text, F.lit(marker)), F.split_part(text, F.lit(marker), F.lit(2)))


def chat_second_line(text: Column, marker: str = fixed.ASSISTANT_MARK) -> Column:
    """Second line of what follows the last marker; null if there is only one line."""
    last_turn = F.substring_index(text, marker, -1)
    return F.when(F.contains(last_turn, F.lit("\n")), F.split_part(last_turn, F.lit("\n"), F.lit(2)))


def before_marker(text: Column, marker: str = fixed.COMMENT_MARK) -> Column:
    """Text before the first marker, or all of it."""
    return F.substring_index(text, marker, 1)


def first_line(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def strip(text: Column) -> Column:
    """Trim white space in the Unicode sense on both sides."""
    return F.btrim(text, F.lit(fixed.WHITE_SPACE))


def cut_text(mode: Column, generated: Column, prompt: Column) -> Column:
    """Apply the cut a runner profile names in its text mode."""
    unechoed = strip_echo(generated, prompt)
    return (
        F.when(mode == "none", generated)
        .when(mode == "echo", unechoed)
        .when(mode == "echo_first_line", first_line(unechoed))
        .when(mode == "echo_instruction", after_marker(unechoed))
        .when(mode == "echo_comment", before_marker(unechoed))
        .when(mode == "assistant_line", chat_second_line(generated))
    )
