"""Predictions that are corrected while they arrive: the last line of each question, and scores that follow it."""

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from gradeloom.functions import letters
from gradeloom.sources.predictions import RUN_IN_PATH, last_wins, parse_lenient

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Questions share a state by their hash: calls for a state cost far more than a question does. Well above the number of
#: tasks, and the same for the whole life of a checkpoint.
GROUPS = 1024
#: So many parts are kept before they are written as one.
PARTS = 8
_CHANGE = "run string, id string, file string, row long, answer string, replaced boolean, earlier string"
_CHANGE_NAMES = [field.split()[0] for field in _CHANGE.split(", ")]


class LastLines(StatefulProcessor):
    """Keeps the last line of each question of a group, by file name and place in the file; older lines change nothing.

    The state of a group is a list of parts: a batch adds the lines that it changed, and a question's line is in the last
    part that has it. A batch reads the groups that it has lines of, and writes only what it changed.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.parts = handle.getListState("parts", "lines binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known, parts = {}, 0
        for (part,) in self.parts.get():
            known.update(pickle.loads(part))
            parts += 1
        changed, names = {}, {}
        for lines in rows:
            for run, question, file, row, answer in zip(*[lines[c] for c in ("run", "id", "file", "row", "answer")]):
                last = changed.get((run, question)) or known.get((run, question))
                if last is None or (len(file), file, row) > (len(last[0]), last[0], last[1]):
                    # one object for each name, which is pickled once
                    changed[run, question] = (names.setdefault(file, file), row, answer)
        if changed:
            if parts < PARTS:
                self.parts.appendValue((pickle.dumps(changed),))
            else:
                self.parts.put([(pickle.dumps(known | changed),)])
            none = (None, None, None)
            found = [(*k, *line, k in known, known.get(k, none)[2]) for k, line in changed.items()]
            yield pd.DataFrame(found, columns=_CHANGE_NAMES)

    def close(self) -> None:
        pass


def read_line_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """``(run, id, file, row, answer)`` of prediction files as they appear; a file is read whole, by one task."""
    files = spark.readStream.option("maxFilesPerTrigger", files_per_batch)
    files = files.option("recursiveFileLookup", True).text(path, wholetext=True)
    file = F.col("_metadata.file_path")
    in_folder, in_name = F.regexp_extract(file, r"/run=([^/]+)/", 1), F.regexp_extract(file, RUN_IN_PATH, 1)
    run = F.url_decode(F.coalesce(F.nullif(in_folder, F.lit("")), in_name))
    files = files.select(run.alias("run"), file.alias("file"), "value")  # before the lines part: once a file
    lines = files.select("run", "file", F.posexplode(F.split("value", "\r?\n")).alias("row", "value"))
    return parse_lenient(lines.withColumn("row", F.col("row").cast("long"))).where("id IS NOT NULL")


def changes(lines: DataFrame) -> DataFrame:
    """A stream of the lines that replace what was known of their question, with the ``earlier`` answer.

    ``replaced`` tells whether there was one. Lines that arrive late and stand before the known one, in the order of
    file names (shorter first) and lines, are passed over. Needs the state store ``STATE_STORE``.
    """
    grouped = lines.withColumn("questions", F.pmod(F.xxhash64("run", "id"), F.lit(GROUPS)).cast("int")).groupBy("questions")
    return grouped.transformWithStateInPandas(LastLines(), _CHANGE, "Append", "None")


def _keeps_state(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def stream_last_lines(spark: SparkSession, path: str, output_path: str, checkpoint_path: str, **options) -> StreamingQuery:
    """Append every change to ``output_path`` and stop when all files are read; a later call goes on from there."""
    _keeps_state(spark)
    found = changes(read_line_stream(spark, path, **options)).writeStream.format("parquet")
    return found.option("checkpointLocation", checkpoint_path).trigger(availableNow=True).start(output_path)


def last_lines(spark: SparkSession, output_path: str) -> DataFrame:
    """``(run, id, answer)`` after all changes so far."""
    found = spark.read.schema(_CHANGE).parquet(output_path)
    order = F.struct(F.length("file").alias("length"), "file", "row").alias("seq")
    return last_wins(found.select("run", "id", order, "answer"), ["run", "id"])


def _shares(answer: str) -> list:
    labels = letters.parse_labels(F.col(answer))
    return [letters.same_set(labels, F.col("gold")).cast("double"), letters.overlap(F.col("gold"), labels)]


def stream_leaderboard(
    spark: SparkSession, path: str, references: DataFrame, output_path: str, checkpoint_path: str, **options
) -> StreamingQuery:
    """Keep sums per run up to date with the lines that arrive: a replaced answer takes back what it had added.

    Each micro-batch writes the sums of its changes, a row for each run, under its own number; a batch that is run again
    after a failure writes the same file again. ``references`` are ``(id, gold)``, one row an id; other ids do not count.
    """
    _keeps_state(spark)

    def add(batch: DataFrame, number: int) -> None:
        rows = batch.join(references, "id")
        new, old = _shares("answer"), _shares("earlier")
        taken_back = [F.when(F.col("replaced"), x).otherwise(F.lit(0.0)) for x in old]
        sums = rows.select(
            "run",
            F.when(F.col("replaced"), 0).otherwise(1).cast("long").alias("n"),
            *[(a - b).alias(name) for a, b, name in zip(new, taken_back, ("exact", "overlap"))],
        ).groupBy("run").agg(*[F.sum(c).alias(c) for c in ("n", "exact", "overlap")])
        sums.write.mode("overwrite").parquet(f"{output_path}/batch={number}")

    found = changes(read_line_stream(spark, path, **options)).writeStream.foreachBatch(add)
    return found.option("checkpointLocation", checkpoint_path).trigger(availableNow=True).start()


def leaderboard(spark: SparkSession, output_path: str) -> DataFrame:
    """``(run, n, exact_match, hamming_score)`` from the sums of all batches so far."""
    sums = spark.read.schema("run string, n long, exact double, overlap double").parquet(output_path)
    total = sums.groupBy("run").agg(*[F.sum(c).alias(c) for c in ("n", "exact", "overlap")])
    share = lambda c: F.try_divide(F.round(F.col(c), 9), F.col("n"))
    return total.select("run", "n", share("exact").alias("exact_match"), share("overlap").alias("hamming_score"))
