"""From generated text to answer letters."""

from pyspark.sql import Column, DataFrame, functions as F

from gradeloom import fixed
from gradeloom.functions import letters
from gradeloom.functions.prompts import prompter_text, system_user_messages, user_messages
from gradeloom.functions.text import cut_text


def extract_answers(
    df: DataFrame,
    text: str = "generated",
    *,
    num_answers: str | None = None,
    paragraph_stop: bool | Column = False,
    output: str = "labels",
) -> DataFrame:
    """Add the sorted distinct answer letters and ``defaulted``, set when none was found.

    Both are null where the number of options is null or beyond the alphabet. ``num_answers`` names the
    column with the number of options; without it five are assumed. The steps are separate columns so
    that each pattern runs once per row.
    """
    size = F.col(num_answers) if num_answers else F.lit(fixed.DEFAULT_OPTIONS)
    stop = paragraph_stop if isinstance(paragraph_stop, Column) else F.lit(paragraph_stop)
    read = (
        df.withColumn("_clean", letters.clean(F.col(text)))
        .withColumn("_clean", F.when(stop, letters.first_paragraph(F.col("_clean"))).otherwise(F.col("_clean")))
        .withColumn("_last", letters.last_letter(size))
        .withColumn("_found", letters.parenthesized(F.col("_clean"), F.col("_last")))
        .withColumn(
            "_found",
            F.when(F.size("_found") > 0, F.col("_found")).otherwise(
                letters.standalone(F.col("_clean"), F.col("_last"))
            ),
        )
    )
    empty = F.when(F.col("_last").isNotNull(), F.size("_found") == 0)
    return (
        read.withColumn(
            output,
            F.when(empty, F.array(F.lit(fixed.DEFAULT_LABEL))).when(~empty, letters.letter_set(F.col("_found"))),
        )
        .withColumn("defaulted", empty)
        .drop("_clean", "_last", "_found")
    )


PROFILE_FIELDS = (
    "wrapper",
    "text_mode",
    "left_parenthesis",
    "paragraph_stop",
    "assumed_options",
    "max_tokens",
)


def with_profiles(df: DataFrame, profile: str = "profile", kind: str | None = None) -> DataFrame:
    """Attach each row's profile settings, null for an unknown profile.

    ``kind`` names a column with the kind of call of a hosted model: chat models get a message list,
    completion models the plain prompt, whatever the profile's own wrapper. Without it, or where it is
    null, the profile decides. Fifteen fixed profiles are a literal in the expression: no join, and for a
    profile that is itself a literal, constants.
    """
    entries = []
    for name, *values in fixed.RUNNER_PROFILES:
        settings = [
            (F.lit(value).cast("int") if value is None else F.lit(value)).alias(field)
            for field, value in zip(PROFILE_FIELDS, values)
        ]
        entries += [F.lit(name), F.struct(*settings)]
    rows = df.withColumn("_settings", F.try_element_at(F.create_map(*entries), F.col(profile))).select(
        *df.columns, "_settings.*"
    )
    if kind is None:
        return rows
    by_kind = F.when(F.col(kind) == "chat", F.lit("user")).when(F.col(kind) == "completion", F.lit("plain"))
    return rows.withColumn("wrapper", F.coalesce(by_kind, "wrapper"))


def wrapped_prompt(wrapper: Column, prompt: Column) -> tuple[Column, Column]:
    """What a profile sends: a message list for chat wrappers (else null), and a literal text (else null)."""
    messages = F.when(wrapper == "user", user_messages(prompt)).when(
        wrapper == "system_user", system_user_messages(prompt)
    )
    text = F.when(wrapper == "plain", prompt).when(wrapper == "prompter", prompter_text(prompt))
    return messages, text


def read_profiled_answers(
    df: DataFrame, *, num_answers: str, prompt: str = "prompt", generated: str = "generated"
) -> DataFrame:
    """Cut and read each row's text the way its profile columns ask for."""
    cut = df.withColumn("answer_text", cut_text(F.col("text_mode"), F.col(generated), F.col(prompt)))
    counted = cut.withColumn("_options", F.coalesce("assumed_options", num_answers))
    return extract_answers(
        counted, "answer_text", num_answers="_options", paragraph_stop=F.col("paragraph_stop")
    ).drop("_options")
