"""Prediction and reference files: one ``id;answer`` line per question."""

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from gradeloom.functions.letters import join_labels, label_count
from gradeloom.functions.text import strip
from gradeloom.operators.order import numbered
from gradeloom.session import materialize

_AT, _SPAN, _KEY, _FILE, _OFFSET, _FIRST, _SIZE, _BEFORE, _WHOLE = (
    f"_order_{n}" for n in ("at", "span", "key", "file", "offset", "first", "size", "before", "whole")
)

#: A name begins behind a slash: tried at every place of it, the pattern would take the square of the path's length.
#: It reaches back over two names at most, so only those are searched, and only where the sign of a run stands at all.
RUN_IN_PATH = r"(?<![^/])([^/]+)_prompt\d+\.txt(?:\.task2)?(?:/[^/]*)?$"


def read_lines(spark: SparkSession, path) -> DataFrame:
    """Text lines with ``run`` and ``seq``.

    ``run`` comes from a ``run=...`` folder or from ``<run>_prompt<k>.txt`` in the path. ``seq`` orders
    the lines of one file: a split's offset, then the row number Spark counts up inside the split. That
    needs no shuffle and no pass over the data.
    """
    lines = spark.read.text(path)
    names = F.substring_index(F.col("_metadata.file_path"), "/", -2)
    found = F.when(F.contains(names, F.lit("_prompt")), F.regexp_extract(names, RUN_IN_PATH, 1)).otherwise("")
    run = F.col("run").cast("string") if "run" in lines.columns else found
    return lines.select(
        run.alias("run"),
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("offset"),
            F.monotonically_increasing_id().alias("row"),
        ).alias("seq"),
        "value",
    )


def parse_lenient(lines: DataFrame, line: str = "value") -> DataFrame:
    """Skip empty lines and take the first two ``;`` fields untrimmed; a missing answer is null."""
    fields = F.split(F.col(line), ";")
    return (
        lines.where(F.length(line) > 0)
        .withColumns({"id": F.get(fields, 0), "answer": F.get(fields, 1)})
        .drop(line)
    )


def parse_strict(lines: DataFrame, line: str = "value") -> tuple[DataFrame, DataFrame]:
    """Trim lines and ask for exactly two ``;`` fields; returns parsed rows and offending lines."""
    fields = lines.withColumn("_fields", F.split(strip(F.col(line)), ";"))
    valid = F.size("_fields") == 2
    good = fields.where(valid).withColumns(
        {"id": F.get("_fields", 0), "answer": F.get("_fields", 1)}
    )
    return good.drop("_fields", line), fields.where(~valid).drop("_fields")


def last_wins(rows: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """Keep the last row of each key.

    An aggregate rather than a window: a key that repeats in a third of all lines shrinks to one row
    per task before anything is shuffled.
    """
    others = [c for c in rows.columns if c not in (*keys, seq)]
    return (
        rows.groupBy(*keys)
        .agg(F.max(F.struct(seq, *others)).alias("_last"))
        .select(*keys, *[F.col(f"_last.{c}").alias(c) for c in others])
    )


def unique_or_fail(rows: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """Like :func:`last_wins`, but a repeated key fails the job."""
    others = [c for c in rows.columns if c not in (*keys, seq)]
    message = F.concat(F.lit("repeated key: "), F.concat_ws(", ", *[F.col(k).cast("string") for k in keys]))
    return (
        rows.groupBy(*keys)
        .agg(F.max(F.struct(seq, *others)).alias("_last"), F.count(F.lit(1)).alias("_n"))
        .withColumn("_last", F.when(F.col("_n") > 1, F.raise_error(message)).otherwise(F.col("_last")))
        .select(*keys, *[F.col(f"_last.{c}").alias(c) for c in others])
    )


def in_file_order(rows: DataFrame, by: list[str], *, position: str = "position", seq: str = "seq") -> DataFrame:
    """Add each row's place among those of ``by``, from 0, in the order of files, splits and rows.

    Splits of a file come in the order of their offset. ``rows`` should be a read of files, with ``seq`` as
    :func:`read_lines` gives it. They are stored as they are read; a place follows from the row in the split and the counts
    of earlier splits, so nothing is sorted or shuffled; a row finds its split by one number, not by its path. Where the rows of a split are not all there, once each and in one
    group, all are numbered after a range exchange instead; no sort meets in one task.
    """
    at = {_FILE: F.col(seq)["file"], _OFFSET: F.col(seq)["offset"]}
    placed = rows.withColumns({_AT: F.monotonically_increasing_id(), _SPAN: F.xxhash64(*by, *at.values())})
    stored = materialize(placed, "file-order")
    row = F.col(seq)["row"]
    shift = F.col(_AT) - row
    spans = stored.groupBy(*by, _SPAN, *[c.alias(n) for n, c in at.items()]).agg(
        F.min(_AT).alias(_FIRST),
        F.count(F.lit(1)).alias(_SIZE),
        # _AT is unique, so rows a fixed step before it are too, and as many as their span if none is missing
        F.coalesce(
            (F.min(shift) == F.max(shift)) & (F.count(shift) == F.count(F.lit(1)))
            & (F.max(row) - F.min(row) + 1 == F.count(F.lit(1))),
            F.lit(False),
        ).alias(_WHOLE),
    )
    spans = materialize(spans, "file-order-spans")
    if not spans.where(~F.col(_WHOLE)).isEmpty():
        parts = [F.length(F.col(seq)["file"]), *[F.col(seq)[c] for c in ("file", "offset", "row")]]
        return numbered(stored.drop(_AT, _SPAN), parts, by=by, number=position)
    earlier = Window.partitionBy(*by).orderBy(F.length(_FILE), _FILE, _OFFSET).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(_SIZE).over(earlier), F.lit(0)) - F.col(_FIRST)
    spans = spans.select(F.col(_SPAN).alias(_KEY), _FIRST, _SIZE, before.alias(_BEFORE))
    # a whole span is an unbroken run of _AT, which tells spans of the same hash apart
    same = (F.col(_SPAN) == F.col(_KEY)) & (F.col(_AT) >= F.col(_FIRST)) & (F.col(_AT) < F.col(_FIRST) + F.col(_SIZE))
    return stored.join(spans, same).select(*[F.col(c) for c in rows.columns], (F.col(_AT) + F.col(_BEFORE)).alias(position))


def write_in_order(lines: DataFrame, path: str, order: list[Column | str], line: str = "value") -> None:
    """Write a text column so that the files, in the order of their names, hold the lines in the given order."""
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select(line).write.text(path)


def write_runs_in_order(lines: DataFrame, path: str, order: str = "position", line: str = "value") -> None:
    """Write ``(run, position, value)`` as a folder for each run, whose files in the order of their names hold its lines in order.

    Ranges of (run, position) are written by a task each, so a large run is split and small ones share a task. Files appear
    when all are written; a failed job leaves none, and the same rows give the same lines again.
    """
    ranged = lines.repartitionByRange("run", order).sortWithinPartitions("run", order)
    ranged.select("run", line).write.partitionBy("run").text(path)


def read_predictions(
    spark: SparkSession, path, *, parsing: str = "lenient", duplicates: str = "fail"
) -> DataFrame:
    """``(run, id, answer)`` for all files under ``path`` at once.

    ``duplicates`` is ``fail``, ``last`` (the last line of a file wins) or ``keep``, which leaves
    ``seq`` on the rows. Strict parsing fails on malformed lines; use :func:`parse_strict` to collect
    them instead.
    """
    lines = read_lines(spark, path)
    if parsing == "strict":
        checked = F.when(F.size(F.split(strip(F.col("value")), ";")) == 2, F.col("value")).otherwise(
            F.raise_error(F.concat(F.lit("not an id;answer line: "), F.col("value")))
        )
        rows = parse_lenient(lines.withColumn("value", strip(checked)))
    else:
        rows = parse_lenient(lines)
    if duplicates == "keep":
        return rows
    return (last_wins if duplicates == "last" else unique_or_fail)(rows, ["run", "id"])


def prediction_line(key: Column, labels: Column, *, lower: bool = False) -> Column:
    """``id;a|c`` with sorted labels."""
    joined = join_labels(labels)
    return F.concat(key, F.lit(";"), F.lower(joined) if lower else joined)


def count_line(key: Column, answer: Column) -> Column:
    """``id;n``: a stored answer as its number of labels."""
    return F.concat(key, F.lit(";"), label_count(strip(answer)).cast("string"))


def write_predictions(df: DataFrame, path: str, *, lower: bool = False, files_per_run: int | None = None) -> None:
    """Write ``(run, id, labels)`` as prediction lines, one folder per run.

    Without ``files_per_run`` nothing is shuffled and each task adds a file to each run it has rows of.
    With it, the hash of the id deals a run's rows out to that many files, large runs included.
    """
    lines = df.select(
        "run", "id", prediction_line(F.col("id"), F.col("labels"), lower=lower).alias("value")
    )
    if files_per_run:
        lines = lines.repartition("run", F.pmod(F.xxhash64("id"), F.lit(files_per_run)))
    lines.select("run", "value").write.partitionBy("run").text(path)
