"""Rewriting every text field of a corpus, for example by translation."""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from gradeloom import fixed

QUESTION = "question"
OPTION_PREFIX = "answers/"


def explode_fields(corpus: DataFrame, key: str = "id") -> DataFrame:
    """One ``(key, path, text)`` row per text field; ``pos`` keeps the field order."""
    options = F.transform(
        F.map_entries("answers"),
        lambda e: F.struct(F.concat(F.lit(OPTION_PREFIX), e["key"]).alias("path"), e["value"].alias("text")),
    )
    question = F.array(F.struct(F.lit(QUESTION).alias("path"), F.col("question").alias("text")))
    return corpus.select(key, F.posexplode(F.concat(question, options)).alias("pos", "cell")).select(
        key, "pos", "cell.path", "cell.text"
    )


def gather_fields(cells: DataFrame, carried: DataFrame, key: str = "id") -> DataFrame:
    """Put cells back into rows and bring the other columns along.

    Cells are shuffled once; equal ones are dropped before that, however often they repeat. Where a path has several
    cells, the one largest by place and text counts. ``rewrite_fields`` does without any shuffle and is the form to take
    unless the cells really are rows of a table.
    """
    cell = F.struct("path", "pos", "text")
    rows = cells.groupBy(key).agg(F.collect_set(cell).alias("_cells"))

    def last(path):
        return F.array_max(
            F.transform(F.filter("_cells", lambda c: c["path"] == path), lambda c: F.struct(c["pos"], c["text"]))
        )

    paths = F.array_distinct(F.transform("_cells", lambda c: c["path"]))
    options = F.filter(paths, lambda p: p != QUESTION)
    placed = F.array_sort(
        F.transform(
            options,
            lambda p: F.struct(
                last(p)["pos"].alias("pos"), F.substr(p, F.lit(len(OPTION_PREFIX) + 1)).alias("key"), last(p)["text"].alias("value")
            ),
        )
    )
    entries = F.transform(placed, lambda o: F.struct(o["key"], o["value"]))
    rest = carried.drop("question", "answers")
    return rows.select(
        key, last(F.lit(QUESTION))["text"].alias("question"), F.map_from_entries(entries).alias("answers")
    ).join(rest, key)


def rewrite_fields(
    corpus: DataFrame,
    make_rewriter: Callable[[], Callable[[list[str]], list[str]]],
    batch_size: int = fixed.REWRITE_BATCH,
) -> DataFrame:
    """Replace question and option texts by what the user's function gives for them.

    The fields of a row travel to Python as one array and come back as one, so nothing is exploded,
    grouped or shuffled. Rows are added to a batch until it has at least ``batch_size`` cells.
    """

    def rewrite(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        rewriter = make_rewriter()

        def texts_for(rows):
            texts = list(rewriter([cell for row in rows for cell in row]))
            if len(texts) != sum(map(len, rows)):
                raise ValueError("the rewriter must return one text per cell")
            rest = iter(texts)
            return [[next(rest) for _ in row] for row in rows]

        rows, cells = [], 0
        for batch in batches:
            done = []
            for row in batch:
                rows.append(row)
                cells += len(row)
                if cells >= batch_size:
                    done += texts_for(rows)
                    rows, cells = [], 0
            yield pd.Series(done, dtype="object")
        if rows:
            yield pd.Series(texts_for(rows), dtype="object")

    call = F.pandas_udf(rewrite, T.ArrayType(T.StringType())).asNondeterministic()
    cells = F.concat(F.array("question"), F.map_values("answers"))
    keys = F.map_keys("answers")
    return (
        corpus.withColumn("_cells", call(cells))
        .withColumn("question", F.get("_cells", 0))
        .withColumn("answers", F.map_from_arrays(keys, F.slice("_cells", F.lit(2), F.size(keys))))
        .drop("_cells")
    )
