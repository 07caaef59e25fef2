"""Supervised training text from a corpus."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from gradeloom import fixed
from gradeloom.operators.order import numbered
from gradeloom.operators.prompts import render_prompts
from gradeloom.session import materialize

COPIES_AT_ONCE = 65536  # copies of one row that one task numbers in one go


def training_text(corpus: DataFrame, template_id: str = "0", *, full_answers: bool = True) -> DataFrame:
    """Add ``text``: the template over the question with its correct answers, with or without their text."""
    style = "gold_full" if full_answers else "gold"
    return render_prompts(corpus, template_id, style=style).withColumnRenamed("prompt", "text")


def white_space_tokens(text: Column, limit: int = -1) -> Column:
    """Words between white space; with a limit the last entry holds all the rest, unsplit."""
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"\s+", limit))


def truncate_tokens(
    df: DataFrame, text: str = "text", *, max_tokens: int = fixed.MAX_TOKENS, pad: str = "<pad>", tokenize=None
) -> DataFrame:
    """Add ``tokens``: the first ``max_tokens`` tokens, padded to that length, and ``n_tokens`` kept.

    ``tokenize`` maps a text column to an array column: an expression, or a pandas UDF around any
    tokenizer. Without it words are split, and only as many as are kept.
    """
    source = F.col(text)
    words = tokenize(source) if tokenize else white_space_tokens(source, max_tokens + 1)
    return (
        df.withColumn("_all", words)
        .withColumn("_kept", F.slice("_all", 1, max_tokens))
        .withColumns(
            {
                "n_tokens": F.size("_kept"),
                "truncated": F.size("_all") > max_tokens,
                "tokens": F.concat("_kept", F.array_repeat(F.lit(pad), F.lit(max_tokens) - F.size("_kept"))),
            }
        )
        .drop("_all", "_kept")
    )


def completion_span(df: DataFrame, text: str = "text", marker: str = fixed.COMPLETION_MARKER) -> DataFrame:
    """Split training text after its last marker: loss counts on the completion only.

    All three columns are null when the marker was cut off.
    """
    completion = F.substring_index(F.col(text), marker, -1)
    start = F.length(text) - F.length(completion)
    found = F.contains(F.col(text), F.lit(marker))
    return df.withColumns(
        {
            "prompt_part": F.when(found, F.substr(text, F.lit(1), start)),
            "completion_part": F.when(found, completion),
            "completion_start": F.when(found, start),
        }
    )


def shuffle_by_key(df: DataFrame, key: str, seed: int, *, bucket_digits: int = 4) -> DataFrame:
    """``(key, position)``: a random order of rows told apart by a unique key, the same for the same seed.

    Only the key is shuffled, never the row: join the positions, or sort by them, when the rows are needed. Rows that
    share a key follow one another.
    """
    hashed = df.select(key, F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))).alias("_hash"))
    return _positions(hashed, [key], bucket_digits)


def _positions(hashed: DataFrame, columns: list[str], bucket_digits: int) -> DataFrame:
    """Positions by ``_hash`` as the size of the hash buckets before a row's own plus its rank in its own."""
    if not 1 <= bucket_digits <= 4:
        raise ValueError("bucket_digits must be 1 to 4: the bucket sizes are sent to all tasks")
    hashed = hashed.withColumn("_bucket", F.substr("_hash", F.lit(1), F.lit(bucket_digits)))
    sizes = hashed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    rank = F.row_number().over(Window.partitionBy("_bucket").orderBy("_hash", *columns))
    return (
        hashed.withColumn("_rank", rank)
        .join(F.broadcast(offsets), "_bucket")
        .select(*columns, (F.col("_offset") + F.col("_rank")).alias("position"))
    )


def shuffle_rows(df: DataFrame, columns: list[str], seed: int, *, bucket_digits: int = 4) -> DataFrame:
    """Add ``position``: a random order of all rows that the same seed gives again, for rows without a key.

    With a key, :func:`shuffle_by_key` moves far less. ``columns`` (text) tell rows apart. Equal rows are
    counted first and numbered, many copies by several tasks, so that copies get different hashes and
    spread over all buckets. A row's position is the size of the hash buckets before its own, at most
    16 ** ``bucket_digits`` numbers, plus its rank in its own bucket, so no task ever sorts the whole table.
    """
    chunk = COPIES_AT_ONCE
    zero = F.lit(0).cast("long")
    counted = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
    once = counted.where(F.col("_n") <= chunk).withColumn("_first", zero)
    often = (
        counted.where(F.col("_n") > chunk)
        .withColumn("_first", F.explode(F.sequence(zero, F.col("_n") - 1, F.lit(chunk).cast("long"))))
        .repartition(*columns, "_first")
    )
    last = F.least(F.col("_n"), F.col("_first") + chunk) - 1
    copies = (
        once.unionByName(often)
        .withColumn("_copy", F.explode(F.sequence(F.col("_first"), last)))
        .withColumn("_hash", F.md5(F.concat_ws(":", *columns, F.lit(str(seed)), F.col("_copy").cast("string"))))
        .select(*columns, "_hash")
    )
    return _positions(copies, columns, bucket_digits)


def length_batches(df: DataFrame, key: str, length: str, *, batch_size: int, width: int = 16) -> DataFrame:
    """Add ``length_bucket`` and ``batch``: batches of rows of similar length, in random order within a bucket.

    Rows of a bucket are numbered by the hash of their unique key and cut into batches, so a bucket has one short batch
    at most. Numbers are the sizes of 256 ranges of the hash before a row's own plus its rank in that range, so that a
    favourite length is numbered by many tasks. Lengths are read twice and should be a stored column.
    """
    bucketed = df.withColumn("length_bucket", F.floor(F.col(length) / width))
    hashed = bucketed.withColumn("_hash", F.md5(F.col(key).cast("string"))).withColumn("_range", F.substr("_hash", F.lit(1), F.lit(2)))
    sizes = hashed.groupBy("length_bucket", "_range").agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.partitionBy("length_bucket").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("length_bucket", "_range", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset"))
    rank = F.row_number().over(Window.partitionBy("length_bucket", "_range").orderBy("_hash", key))
    return (
        hashed.withColumn("_rank", rank)
        .join(offsets, ["length_bucket", "_range"])
        .withColumn("batch", F.floor((F.col("_offset") + F.col("_rank") - 1) / batch_size))
        .select(*bucketed.columns, "batch")
    )


def length_grouped(df: DataFrame, key: str, length: str, *, batch_size: int, seed: int, most_batches: int = 50) -> DataFrame:
    """``(key, length, place, batch)``: the order in which a trainer that groups by length takes rows.

    Rows in random order are cut into mega-batches of up to ``most_batches`` batches (a quarter of all batches, if that is
    fewer), and each is sorted by length, longest first, equal ones in their random order. The longest row of
    all changes places with the very first, so that memory is asked for at once. Rows are numbered by a hash of their
    unique key over range partitions, and a mega-batch is sorted on its own, so neither the table nor a favourite length
    meets in one task. A null length counts as 0. ``df`` should be a read of stored rows.
    """
    rows = df.select(key, F.coalesce(F.col(length), F.lit(0)).alias(length))
    order = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))
    size = batch_size * max(1, min(most_batches, rows.count() // (4 * batch_size)))
    mega = F.floor(F.col("_at") / size)
    inside = Window.partitionBy("_mega").orderBy(F.desc(length), "_at")
    placed = numbered(rows, [order, key], number="_at").withColumn("_mega", mega)
    placed = placed.withColumn("place", F.col("_mega") * size + F.row_number().over(inside) - 1)
    placed = materialize(placed.select(key, length, "place"), "length-groups")
    longest = placed.where(F.col("place") % size == 0).orderBy(F.desc(length), "place").select("place").first()
    head = F.lit(longest["place"] if longest else 0)
    place = F.when(F.col("place") == 0, head).when(F.col("place") == head, F.lit(0)).otherwise(F.col("place")).cast("long")
    return placed.withColumn("place", place).withColumn("batch", F.floor(F.col("place") / batch_size))
