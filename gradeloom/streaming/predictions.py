"""Answer a growing question folder and write prediction lines as they are ready."""

from pyspark.sql import SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from gradeloom.functions.prompts import apply_template
from gradeloom.operators.answers import extract_answers
from gradeloom.operators.generate import MakeGenerator, generate
from gradeloom.operators.prompts import linearized, template_text
from gradeloom.functions.text import first_line
from gradeloom.schema import MCQ
from gradeloom.sources.predictions import prediction_line


def stream_predictions(
    spark: SparkSession,
    corpus_path: str,
    output_path: str,
    checkpoint_path: str,
    make_generator: MakeGenerator,
    *,
    template_id: str = "0",
    batch_size: int | None = None,
    files_per_batch: int = 100,
) -> StreamingQuery:
    """Generate for every question file not answered yet, then stop.

    Each micro-batch commits its lines before the next one starts, and the checkpoint remembers the
    files done: a stopped run keeps what it wrote and goes on from there. The text is cut to its first
    line, five options are assumed and the letters are lower-cased.
    """
    corpus = (
        spark.readStream.schema(MCQ).option("maxFilesPerTrigger", files_per_batch).json(corpus_path)
    )
    body = linearized("open", left_parenthesis=True)
    prompted = corpus.select("id", apply_template(template_text(F.lit(template_id)), body).alias("prompt"))
    answered = generate(prompted, make_generator, batch_size=batch_size)
    read = extract_answers(answered.withColumn("generated", first_line(F.col("generated"))))
    return (
        read.select(prediction_line(F.col("id"), F.col("labels"), lower=True).alias("value"))
        .writeStream.format("text")
        .option("checkpointLocation", checkpoint_path)
        .trigger(availableNow=True)
        .start(output_path)
    )
