"""The memorization check: complete the held-out options and measure the distance."""

from pyspark.sql import DataFrame, functions as F

from gradeloom import fixed
from gradeloom.functions.distance import edit_distance, ratio_distance, within_distance
from gradeloom.functions.prompts import held_out_options, memorization_body, memorization_prompt

DISTANCES = {"edit": edit_distance, "ratio": ratio_distance}


def memorization_prompts(corpus: DataFrame) -> DataFrame:
    """Add ``shown`` (question and shown options), ``prompt`` and ``reference``."""
    question, answers = F.col("question"), F.col("answers")
    return corpus.withColumns(
        {
            "shown": memorization_body(question, answers),
            "prompt": memorization_prompt(question, answers),
            "reference": held_out_options(answers),
        }
    )


def with_distance(df: DataFrame, distance: str = "edit", *, tasks: int | None = None) -> DataFrame:
    """Add ``distance`` between ``reference`` and ``generated``.

    The edit form takes time by text length times edit cost, and is exact at any length. For long texts in few
    partitions ``tasks`` deals the rows out evenly first.
    """
    source = df.repartition(tasks) if tasks else df
    return source.withColumn("distance", DISTANCES[distance](F.col("reference"), F.col("generated")))


def meld_results(prompted: DataFrame, distance: str = "edit") -> DataFrame:
    """Corpus rows with a copy of their options and the result struct attached."""
    scored = with_distance(prompted, distance)
    return scored.select(
        "id",
        "question",
        "answers",
        "correct_answers",
        F.col("answers").alias("saved_answers"),
        F.struct(F.col("shown").alias("prompt"), "reference", "generated", "distance").alias("meld"),
    )


def recompute(results: DataFrame, distance: str = "edit") -> DataFrame:
    """Distances again from stored results, without generating."""
    return with_distance(results.select("id", "meld.prompt", "meld.reference", "meld.generated"), distance)


def meld_summary(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Share of rows at or below the threshold, and the average distance, over rows that have one."""
    return df.groupBy(*(by or [])).agg(
        F.count("distance").alias("n"),
        F.avg((F.col("distance") <= fixed.MEMORIZED_AT).cast("double")).alias("meld_rate"),
        F.avg("distance").alias("avg_distance"),
    )


def meld_rate(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The ``n`` and ``meld_rate`` of :func:`meld_summary` under the edit distance, without the distances.

    Pairs that cannot reach the threshold are given up by a bound, so a check of texts that are mostly new is far cheaper
    than their average distance.
    """
    memorized = within_distance(F.col("reference"), F.col("generated"), fixed.MEMORIZED_AT)
    return (
        df.withColumn("_memorized", memorized.cast("double"))
        .groupBy(*(by or []))
        .agg(F.count("_memorized").alias("n"), F.avg("_memorized").alias("meld_rate"))
    )
