"""JSON arrays of any size, read and written by many tasks.

Spark's text reader cuts a file at every closing brace, over as many tasks as the file has splits. Whether a brace closes
an object depends on all text before it, but of that only two facts matter: whether a string is open, and how many
brackets are. A first pass finds for each split how it changes both, for either answer to the first; composed in file
order that gives the state at the start of every split. The second pass then finds the objects of a split by itself.
"""

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from gradeloom.operators.order import numbered
from gradeloom.session import materialize

#: Splits whose states are sent to all tasks (about 100 bytes each); beyond, the text is dealt out by split instead.
MOST_SPLITS = 1 << 17
_MARK = 3  # bytes of the byte order mark, which readers skip
WHOLE, OPENED, GOES_ON, CLOSED = range(4)
_UP_TO_OBJECT = re.compile(r'(?:[^"{]|"(?:\\.|[^"\\])*")*', re.DOTALL)
_SUMMARY = "file string, start long, size long, flips int, outside long, inside long, bytes long, array boolean"
_PARTS = "file string, start long, row long, kind int, text string"


def _brackets(segment: str) -> tuple[int, int, int]:
    """Of a text before a closing brace: 1 if it ends the other way round (in a string, or not) than it began, and
    the brackets it leaves open if it began outside a string, or inside one."""
    if "\\" in segment:
        segment = segment.replace("\\\\", "").replace('\\"', "")
    between = segment.split('"')
    net = [0, 0]
    for i, part in enumerate(between):
        if part:
            net[i & 1] += part.count("{") + part.count("[") - part.count("]")
    return (len(between) - 1) & 1, *net


def _segments(spark: SparkSession, path) -> DataFrame:
    lines = spark.read.option("lineSep", "}").text(path)
    at = F.col("_metadata")
    return lines.select(
        at["file_path"].alias("file"),
        at["file_block_start"].alias("start"),
        at["file_size"].alias("size"),
        F.monotonically_increasing_id().alias("row"),
        "value",
    )


def _by_split(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    """``(is first, is last, values of names, segment)``; segments of a split stand together and in order."""
    first, held = True, None
    for batch in batches:
        keys = zip(*[batch.column(n).to_pylist() for n in names])
        for key, value in zip(keys, batch.column("value").to_pylist()):
            if held:
                last = held[0][:2] != key[:2]
                yield first, last, *held
                first = last
            held = key, value
    if held:
        yield first, True, *held


def _summaries(segments: DataFrame) -> DataFrame:
    """How each split changes the state, a row for each split that has segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list] = []
        for first, _, key, segment in _by_split(batches, ["file", "start", "size"]):
            if first:
                rows.append([*key, 0, 0, 0, 0, segment.lstrip("\ufeff \t\r\n").startswith("[")])
            row = rows[-1]
            flips, *net = _brackets(segment)
            other = row[3]
            row[3] ^= flips
            row[4] += net[other] - (row[3] == 0)
            row[5] += net[1 - other] - (row[3] == 1)
            row[6] += len(segment.encode()) + 1
        types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
        names = [c.split()[0] for c in _SUMMARY.split(", ")]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return segments.select("file", "start", "size", "value").mapInArrow(run, _SUMMARY)


def _states(segments: DataFrame, across: bool) -> DataFrame:
    """``(file, start, in_string, depth, base, unended)`` at the start of each split.

    ``base`` is the depth at which objects are rows. ``unended`` marks the split whose last segment ends the file and not an
    object: there the bytes of the file are one less than those of segments and braces together.
    """
    found = materialize(_summaries(segments), "array-splits")
    of_file = Window.partitionBy("file")
    last = F.max("start").over(of_file) == F.col("start")
    beyond = F.sum("bytes").over(of_file) - F.col("size")
    found = found.withColumn("unended", last & ((beyond > 0) | (beyond == 1 - _MARK)))
    chain = [] if across else ["file"]
    order = Window.partitionBy(*chain).orderBy(F.length("file"), "file", "start")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("in_string", F.coalesce(F.sum("flips").over(before), F.lit(0)) % 2 == 1)
    ends_in = F.col("in_string") != (F.col("flips") == 1)
    net = F.when(F.col("in_string"), F.col("inside")).otherwise(F.col("outside"))
    found = found.withColumn("net", net + (F.col("unended") & ~ends_in).cast("long"))
    depth = F.coalesce(F.sum("net").over(before), F.lit(0))
    opens = F.first("array").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return found.select("file", "start", "in_string", depth.alias("depth"), opens.cast("int").alias("base"), "unended")


def _parts(segments: DataFrame, states: DataFrame) -> DataFrame:
    """Objects of each split, and the parts of those that begin or end in another one."""
    if states.count() <= MOST_SPLITS:
        known = segments.join(F.broadcast(states), ["file", "start"])
    else:
        known = segments.join(states, ["file", "start"]).repartition("file", "start")
        known = known.sortWithinPartitions("file", "start", "row")
    names = ["file", "start", "in_string", "depth", "base", "unended"]

    def objects(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held: list[str] = []
        inside = earlier = False
        row = 0
        for first, last, key, segment in _by_split(batches, names):
            if first:
                file, start, in_string, depth, base, unended = key
                inside = earlier = depth > base
                held, row = [], 0
            flips, *net = _brackets(segment)
            depth += net[in_string]
            in_string ^= bool(flips)
            closes = not in_string and not (unended and last)
            depth -= closes
            if not inside:
                begin = _UP_TO_OBJECT.match(segment).end()
                if begin == len(segment):
                    continue
                inside, earlier, segment = True, False, segment[begin:]
            held.append(segment)
            if closes and depth <= base:
                yield file, start, -1 if earlier else row, CLOSED if earlier else WHOLE, "}".join(held) + "}"
                row += not earlier
                held, inside = [], False
            if last and inside:
                text = "}".join(held) + ("" if unended else "}")
                yield file, start, -1 if earlier else row, GOES_ON if earlier else OPENED, text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
        fields = [c.split()[0] for c in _PARTS.split(", ")]
        rows, size = [], 0
        for found in objects(batches):
            rows.append(found)
            size += len(found[-1])
            if size > 1 << 22:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], fields)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], fields)

    return known.select(*names, "value").mapInArrow(run, _PARTS)


def read_objects(spark: SparkSession, path, *, across: bool = False) -> DataFrame:
    """``(seq, value)``: the text of each object of the JSON arrays under ``path``, and its place.

    A file holds one array, or objects one after the other. With ``across`` the files are parts of one array, in the order
    of their names, shorter names first. Elements that are no objects are passed over. ``seq`` orders objects by file, split and row. The text
    is read three times (states, parts of objects, objects) and not shuffled; what meets elsewhere is a row for each split
    and the parts of the objects that lie across its ends. An object that does not end fails the job.
    """
    segments = _segments(spark, path)
    states = materialize(_states(segments, across), "array-states")
    parts = _parts(segments, states)
    seq = F.struct("file", F.col("start").alias("offset"), "row").alias("seq")
    whole = parts.where(F.col("kind") == WHOLE).select(seq, F.col("text").alias("value"))
    broken = materialize(parts.where(F.col("kind") != WHOLE), "array-parts")
    order = Window.partitionBy(*([] if across else ["file"])).orderBy(F.length("file"), "file", "start", "row")
    place = F.when(F.col("kind") == OPENED, F.struct("file", F.col("start").alias("offset"), "row"))
    owners = broken.select("file", "start", "row", "kind").withColumn(
        "owner", F.last(place, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )
    pieces = broken.join(owners, ["file", "start", "row", "kind"]).groupBy(F.col("owner").alias("seq")).agg(
        F.sort_array(F.collect_list(F.struct(F.length("file"), "file", "start", "row", "text"))).alias("pieces"),
        F.max("kind").alias("kind"),
    )
    joined = F.array_join(F.transform("pieces", lambda p: p["text"]), "")
    open_end = F.raise_error(F.concat(F.lit("an object does not end: "), F.substring(joined, 1, 100)))
    ended = F.when(F.col("kind") == CLOSED, joined).otherwise(open_end)
    return whole.unionByName(pieces.select("seq", ended.alias("value")))


def read_array(spark: SparkSession, path, schema: T.StructType | str, *, across: bool = False) -> DataFrame:
    """Rows of :func:`read_objects`, as the ``multiLine`` JSON reader would give them for objects."""
    parsed = F.from_json("value", schema, {"mode": "PERMISSIVE"})
    return read_objects(spark, path, across=across).select(parsed.alias("_row")).select("_row.*")


def write_array(df: DataFrame, path: str, order: list[Column | str]) -> None:
    """Write rows as one JSON array in the given order, a row a line, over as many files as there are tasks.

    The files, in the order of their names, are one valid array: the first begins with ``[``, the last ends with ``]``.
    They appear when all are written; a job that fails leaves none behind. ``df`` should be a read of stored rows.
    """
    value = F.to_json(F.struct(*[F.col(c) for c in df.columns]))
    lines = numbered(df, order, number="_number", size="_size")
    first, last = F.col("_number") == 0, F.col("_number") == F.col("_size") - 1
    line = F.concat(F.when(first, "[").otherwise(","), value, F.when(last, "\n]").otherwise(""))
    lines = lines.select("_number", line.alias("value"))
    if lines.isEmpty():
        lines = df.sparkSession.createDataFrame([(0, "[]")], "_number long, value string")
    lines.repartitionByRange("_number").sortWithinPartitions("_number").select("value").write.text(path)
