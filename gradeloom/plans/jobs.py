"""Whole jobs put together from the operators: what one would run from a script."""

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gradeloom import fixed
from gradeloom.functions.letters import parse_labels
from gradeloom.operators import answers, generate, memorize, prompts, rewrite, scoring
from gradeloom.operators.generate import MakeGenerator
from gradeloom.session import scratch_path
from gradeloom.sources import corpus as questions, predictions as files

STORED = "id string, profile string, prompt string, generated string, run string"


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows written so far; none if nothing was."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _answered(
    rows: DataFrame,
    make_generator: MakeGenerator,
    *,
    prompt: str,
    params: Column | None,
    batch_size: int | None,
    tasks: int | None,
    retry_on: tuple[type[Exception], ...],
    retry: dict,
) -> DataFrame:
    """``rows`` with ``generated``; with errors to retry on, only those that got an answer."""
    if not retry_on:
        return generate.generate(
            rows, make_generator, prompt=prompt, params=params, batch_size=batch_size, tasks=tasks
        )
    tried = generate.generate_with_retry(
        rows, make_generator, prompt=prompt, params=params, retry_on=retry_on, **{"parallel_calls": tasks, **retry}
    )
    return tried.where(F.col("error").isNull()).drop("error", "attempts")


def answer_corpus(
    corpus: DataFrame,
    make_generator: MakeGenerator,
    path: str,
    *,
    run: str,
    profile: str,
    template_id: str = "0",
    template: str | None = None,
    model: str | None = None,
    pool: DataFrame | None = None,
    shots: int | None = None,
    settings: dict[str, str] | None = None,
    batch_size: int | None = None,
    tasks: int | None = None,
    parts: int = 1,
    retry_on: tuple[type[Exception], ...] = (),
    **retry,
) -> DataFrame:
    """Prompt, generate and store under ``path``; returns all that run has stored.

    ``template`` is a run's own prompt with ``%s`` for the question; without it the catalogue's ``template_id`` counts.
    ``model`` (``provider/model``) decides between message list and plain prompt for hosted models. ``pool`` (and
    ``shots``) shows answered examples first. ``settings`` (temperature and so on) reach the function beside the
    profile's ``max_tokens`` and overrule it.

    Prompts of ids not stored yet are written once, by the hash of the id in ``parts`` parts, and worked off part by
    part. Each part adds its rows when it is done: a run that was stopped goes on where it was, and no prompt that has
    its text is sent again. ``retry_on`` names errors after which a call is made again; ``max_attempts``, ``first_wait``,
    ``longest_wait``, ``pause`` and ``parallel_calls`` are those of ``generate_with_retry``. A row that used up its
    attempts is not stored, so the next call tries it again. Chat profiles send their message list as JSON text.
    """
    spark = corpus.sparkSession
    done = _stored(spark, path, STORED).where(F.col("run") == run)
    rows = generate.pending(corpus, done, ["id"]).withColumn("profile", F.lit(profile))
    if model is not None:
        rows = generate.route_models(rows.withColumn("_model", F.lit(model)), "_model")
    rows = answers.with_profiles(rows, kind=None if model is None else "kind")
    templates = None if template is None else {template_id: template}
    shown = {"left_parenthesis": F.col("left_parenthesis")}
    if pool is None:
        prompted = prompts.render_prompts(rows, template_id, templates=templates, **shown)
    else:
        prompted = prompts.few_shot_prompts(rows, pool, shots, template_id, templates=templates)
    messages, text = answers.wrapped_prompt(F.col("wrapper"), F.col("prompt"))
    given = [F.lit(x) for item in (settings or {}).items() for x in (item[0], str(item[1]))]
    asked = F.create_map(F.lit("max_tokens"), F.col("max_tokens").cast("string"))
    own = F.map_filter(asked, lambda k, v: ~F.coalesce(k.isin(list(settings or {})), F.lit(False)))
    ready = prompted.select(
        "id",
        "profile",
        "prompt",
        F.coalesce(text, F.to_json(messages)).alias("sent"),
        (F.map_concat(own, F.create_map(*given)) if given else asked).alias("params"),
        F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"),
    )
    prepared = scratch_path(spark, "prompts")
    ready.write.partitionBy("part").parquet(prepared)
    for part in range(parts):
        todo = spark.read.schema(ready.schema).parquet(prepared).where(F.col("part") == part)
        answered = _answered(
            todo,
            make_generator,
            prompt="sent",
            params=F.col("params"),
            batch_size=batch_size,
            tasks=tasks,
            retry_on=retry_on,
            retry=retry,
        )
        answered.select("id", "profile", "prompt", "generated", F.lit(run).alias("run")).write.mode(
            "append"
        ).partitionBy("run").parquet(path)
    return _stored(spark, path, STORED).where(F.col("run") == run)


def read_answers(stored: DataFrame, corpus: DataFrame) -> DataFrame:
    """Stored texts with their labels, gold labels and number of options."""
    gold = corpus.select("id", F.size("answers").alias("n_options"), F.col("correct_answers").alias("gold"))
    return answers.read_profiled_answers(
        scoring.join_predictions(answers.with_profiles(stored), gold), num_answers="n_options"
    )


def score_answers(stored: DataFrame, corpus: DataFrame) -> DataFrame:
    """Scores of every stored run."""
    return scoring.score_runs(read_answers(stored, corpus))


def _gold(spark: SparkSession, path, duplicates: str) -> DataFrame:
    return files.read_predictions(spark, path, duplicates=duplicates).select("id", F.col("answer").alias("reference"))


def score_files(
    spark: SparkSession, predictions_path, references_path, *, duplicates: str = "last"
) -> tuple[DataFrame, DataFrame]:
    """Id checks, and exact match and overlap, of all prediction files against a reference file."""
    predicted = files.read_predictions(spark, predictions_path, duplicates=duplicates)
    gold = _gold(spark, references_path, duplicates)
    rows = scoring.join_predictions(predicted, gold).select(
        "run", "id", parse_labels(F.col("answer")).alias("labels"), parse_labels(F.col("reference")).alias("gold")
    )
    return scoring.check_ids(predicted, gold), scoring.score_runs(rows)


def classify_files(
    spark: SparkSession,
    predictions_path,
    references_path,
    *,
    duplicates: str = "last",
    labels: list[str] | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Id checks, classification report, and accuracy with macro F1, of files of label counts."""
    predicted = files.read_predictions(spark, predictions_path, duplicates=duplicates)
    gold = _gold(spark, references_path, duplicates)
    rows = scoring.join_predictions(predicted, gold)
    report = scoring.classification_report(rows, "answer", "reference", labels=labels)
    return scoring.check_ids(predicted, gold), report, scoring.accuracy_macro_f1(rows, "answer", "reference")


def compare_files(spark: SparkSession, left, right) -> DataFrame:
    """Agreement of two prediction files, with the ids only one of them has."""
    rows = files.read_predictions(spark, left, parsing="strict", duplicates="last").withColumn("run", F.lit("left"))
    other = files.read_predictions(spark, right, parsing="strict", duplicates="last")
    both = rows.unionByName(other.withColumn("run", F.lit("right")))
    return scoring.agreement(both, [("left", "right")])


def count_file(spark: SparkSession, source, target: str) -> None:
    """Rewrite prediction lines as label-count lines, one folder per run."""
    rows = files.read_predictions(spark, source, parsing="strict", duplicates="keep")
    line = files.count_line(F.col("id"), F.col("answer"))
    rows.select("run", line.alias("value")).write.partitionBy("run").text(target)


def check_memorization(
    corpus: DataFrame,
    make_generator: MakeGenerator,
    path: str,
    *,
    distance: str = "edit",
    settings: dict[str, str] | None = None,
    batch_size: int | None = None,
    tasks: int | None = None,
    retry_on: tuple[type[Exception], ...] = (),
    **retry,
) -> DataFrame:
    """Have held-out options completed, store the enriched rows, and summarize what was stored.

    ``settings`` default to the check's own: 64 tokens at temperature 0. Calls are repeated as in
    :func:`answer_corpus`; rows without an answer are left out.
    """
    pairs = [F.lit(x) for item in (fixed.MEMORIZATION_SETTINGS | (settings or {})).items() for x in (item[0], str(item[1]))]
    generated = _answered(
        memorize.memorization_prompts(corpus),
        make_generator,
        prompt="prompt",
        params=F.create_map(*pairs),
        batch_size=batch_size,
        tasks=tasks,
        retry_on=retry_on,
        retry=retry,
    )
    questions.write_rows(memorize.meld_results(generated, distance), path)
    return memorize.meld_summary(questions.read_meld_results(corpus.sparkSession, path).select("meld.distance"))


def rewrite_corpus(corpus: DataFrame, make_rewriter, path: str) -> None:
    """Rewrite all question and option texts and store the corpus as JSON lines."""
    questions.write_rows(rewrite.rewrite_fields(corpus, make_rewriter), path)
