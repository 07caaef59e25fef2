"""Question sets, run settings and enriched rows as JSON."""

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from gradeloom.schema import MCQ, MELD_RESULT
from gradeloom.sources.arrays import read_array


def read_corpus(spark: SparkSession, path, *, layout: str = "lines", more: str | None = None) -> DataFrame:
    """Read questions with their given schema, and with ``more`` fields of the file as DDL text.

    ``lines`` is one object per line. ``array`` reads files that hold one JSON array each, ``parts`` files that make up
    one array in the order of their names, as :func:`~gradeloom.sources.arrays.write_array` leaves them. All are split
    over tasks at any size; arrays cost two more reads of the text.
    """
    if layout not in ("lines", "array", "parts"):
        raise ValueError(f"unknown layout {layout!r}")
    schema = T.StructType(MCQ.fields + (T.StructType.fromDDL(more).fields if more else []))
    if layout == "lines":
        return spark.read.schema(schema).json(path)
    return read_array(spark, path, schema, across=layout == "parts")


def write_rows(df: DataFrame, path: str) -> None:
    """Write enriched rows as JSON lines."""
    df.write.json(path)


def read_meld_results(spark: SparkSession, path, *, layout: str = "lines") -> DataFrame:
    """Stored memorization results, for scoring again without a model call."""
    if layout == "lines":
        return spark.read.schema(MELD_RESULT).json(path)
    return read_array(spark, path, MELD_RESULT, across=layout == "parts")


def read_run_settings(spark: SparkSession, path) -> DataFrame:
    """One row per settings file: its settings as text values, and as ``run`` its folder."""
    files = spark.read.text(path, wholetext=True)
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)
    run = F.col("run").cast("string") if "run" in files.columns else folder
    return files.select(run.alias("run"), F.from_json("value", "map<string,string>").alias("params"))


def with_splits(splits: dict[str, DataFrame]) -> DataFrame:
    """Stack the named parts of a corpus, with the name in ``split``."""
    parts = [df.withColumn("split", F.lit(name)) for name, df in splits.items()]
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part)
    return stacked
