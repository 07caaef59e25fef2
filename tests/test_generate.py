"""Generation with user functions."""

import time

import pytest
from pyspark.sql import functions as F

from gradeloom import fixed
from gradeloom.functions import prompts as P
from gradeloom.operators import answers as A, generate as G, rewrite as W
from gradeloom.plans import fixtures as D
from gradeloom.schema import MCQ
from gradeloom.session import materialize, scratch_path, shared_dir


@pytest.mark.parametrize("arrow_rows", [7, 10000])
@pytest.mark.parametrize("size", [1, 4, 50])
def test_batches_have_the_asked_size_in_order(spark, size, arrow_rows):
    def factory():
        return lambda prompts, params: [f"{p}:{len(prompts)}" for p in prompts]

    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(arrow_rows))
    try:
        df = spark.range(0, 103, 1, 1).select(F.col("id").cast("string").alias("prompt"))
        got = [r["generated"] for r in G.generate(df, factory, batch_size=size).collect()]
    finally:
        spark.conf.set(setting, before)
    full = 103 - 103 % size
    assert got == [f"{i}:{size if i < full else 103 % size}" for i in range(103)]


def test_params_reach_the_function_and_columns_stay(spark):
    def factory():
        return lambda prompts, params: [f"{p}/{s.get('max_tokens')}" for p, s in zip(prompts, params)]

    df = spark.createDataFrame([("q1", "x", 7), ("q2", "y", 8)], "id string, prompt string, other int")
    params = F.create_map(F.lit("max_tokens"), F.col("other").cast("string"))
    got = {r["id"]: (r["generated"], r["other"]) for r in G.generate(df, factory, params=params).collect()}
    assert got == {"q1": ("x/7", 7), "q2": ("y/8", 8)}
    assert G.generate(df, G.one_by_one(D.stub_generator)).count() == 2


def test_rows_are_dealt_out_to_the_asked_tasks(spark):
    df = spark.range(0, 80, 1, 1).select(F.col("id").cast("string").alias("prompt"))
    spread = G.generate(df, G.one_by_one(D.stub_generator), tasks=4).withColumn("task", F.spark_partition_id())
    assert sorted(r["count"] for r in spread.groupBy("task").count().collect()) == [20, 20, 20, 20]


def test_wrong_number_of_texts_fails(spark):
    df = spark.createDataFrame([("x",), ("y",)], "prompt string")
    with pytest.raises(Exception, match="texts for"):
        G.generate(df, lambda: lambda prompts, params: ["one", "two", "three"]).collect()


def test_generator_is_made_once_per_task_and_called_once_per_row(spark, tmp_path):
    folder = str(tmp_path)

    def factory():
        import os
        import uuid

        open(os.path.join(folder, f"made-{uuid.uuid4().hex}"), "w").close()

        def answer(prompts, params):
            for p in prompts:
                open(os.path.join(folder, f"call-{p}-{uuid.uuid4().hex}"), "w").close()
            return [p for p in prompts]

        return answer

    df = spark.range(0, 40, 1, 4).select(F.col("id").cast("string").alias("prompt"), F.lit("r").alias("run"))
    stored = materialize(G.generate(df, factory, batch_size=3), "once")
    assert stored.where("generated = '7'").count() == 1
    assert stored.groupBy("run").count().first()["count"] == 40
    names = [p.name for p in tmp_path.iterdir()]
    assert sum(n.startswith("made-") for n in names) == 4
    assert sum(n.startswith("call-") for n in names) == 40


def test_retry_and_dead_letters(spark):
    df = spark.range(200).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("prompt"))
    tried = materialize(
        G.generate_with_retry(df, D.flaky_generator, retry_on=(D.Throttled,), max_attempts=2, first_wait=0.0), "tried"
    )
    for r in tried.collect():
        needed = int(D.digest(r["prompt"])[0], 16) // 4 + 1
        assert r["attempts"] == min(needed, 2)
        assert (r["generated"] is None, r["error"]) == (
            (True, "Throttled: try again") if needed > 2 else (False, None)
        )
    dead = G.failed(tried).count()
    assert 0 < dead < 200
    again = G.generate_with_retry(df, D.flaky_generator, retry_on=(D.Throttled,), max_attempts=None, first_wait=0.0)
    assert G.failed(again).count() == 0


def test_no_column_is_sent_for_settings_that_there_are_none_of(spark):
    """A map column of nulls took longer to reach Python than the prompts."""
    df = spark.createDataFrame([("chat", "x"), ("none", "y")], "kind string, prompt string")

    def make():
        return lambda prompts, params: [f"{p}{x}" for p, x in zip(prompts, params, strict=True)]

    found = [
        G.generate(df, make),
        G.generate_with_retry(df, make, retry_on=(ValueError,)).drop("attempts", "error"),
        G.generate_by_kind(df, {"chat": make}),
    ]
    for rows in found:
        assert "null" not in rows._jdf.queryExecution().optimizedPlan().toString()
    texts = [{r["prompt"]: r["generated"] for r in rows.collect()} for rows in found]
    assert texts == [{"x": "x{}", "y": "y{}"}, {"x": "x{}", "y": "y{}"}, {"x": "x{}", "y": None}]


def test_no_wait_is_no_sleep(monkeypatch):
    """A sleep of zero seconds costs more than the call it comes before."""
    slept = []
    monkeypatch.setattr(G.time, "sleep", slept.append)
    for tries in range(1, 5):
        G.wait_to_retry(tries, 0.0, 60.0)
    assert slept == []
    G.wait_to_retry(9, 1.0, 0.5)
    assert len(slept) == 1 and 0 < slept[0] <= 0.5


def test_other_errors_are_not_retried(spark):
    def factory():
        def answer(prompts, params):
            raise KeyError("broken")

        return answer

    df = spark.createDataFrame([("x",)], "prompt string")
    with pytest.raises(Exception, match="broken"):
        G.generate_with_retry(df, factory, retry_on=(D.Throttled,)).collect()


def test_pause_and_parallel_calls(spark):
    df = spark.range(0, 6, 1, 3).select(F.col("id").cast("string").alias("prompt"))
    start = time.time()
    paced = G.generate_with_retry(
        df, G.one_by_one(D.stub_generator), retry_on=(), pause=0.2, parallel_calls=2
    ).withColumn("task", F.spark_partition_id())
    assert len({r["task"] for r in paced.collect()}) <= 2
    assert time.time() - start >= 0.6


def test_pending_resumes(spark):
    corpus = spark.range(10).select(F.col("id").cast("string").alias("id"))
    done = corpus.where("id < 4")
    assert {r["id"] for r in G.pending(corpus, done, ["id"]).collect()} == {str(i) for i in range(4, 10)}


@pytest.mark.parametrize(
    "model,wanted",
    [
        ("openai/gpt-4", ("openai", "gpt-4", "chat")),
        ("openai/davinci", ("openai", "davinci", "completion")),
        ("cohere/gpt-4", ("cohere", "gpt-4", "completion")),
        ("ai21/a/b", ("ai21", "a/b", "completion")),
        ("other/gpt-4", ("other", "gpt-4", None)),
        ("noslash", ("noslash", None, None)),
    ],
)
def test_routes(spark, model, wanted):
    row = G.route_models(spark.createDataFrame([(model,)], "model string")).first()
    assert (row["provider"], row["name"], row["kind"]) == wanted


CORPUS = [(f"q{i}", f"question {i}", {k: f"{k}{i}" for k in "abcde"[: 1 + i % 5]}, ["a"]) for i in range(57)]


def test_rewriting_in_batches_of_cells(spark):
    def factory():
        def rewrite(cells):
            assert len(cells) >= 20 or cells[-1].endswith("56")
            return [f"{c}!" for c in cells]

        return rewrite

    corpus = spark.createDataFrame(CORPUS, MCQ).coalesce(1)
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "4")
    try:
        got = {r["id"]: r for r in W.rewrite_fields(corpus, factory).collect()}
    finally:
        spark.conf.set(setting, before)
    for key, question, answers, correct in CORPUS:
        assert got[key]["question"] == question + "!"
        assert got[key]["answers"] == {k: v + "!" for k, v in answers.items()}
        assert got[key]["correct_answers"] == correct


def test_explode_and_gather_are_inverse(spark):
    corpus = spark.createDataFrame(CORPUS, MCQ).withColumn("extra", F.length("question"))
    cells = W.explode_fields(corpus)
    assert cells.count() == sum(1 + len(a) for _, _, a, _ in CORPUS)
    repeated = cells.unionByName(cells.where("id = 'q3'")).unionByName(cells.where("id = 'q3'"))
    back = W.gather_fields(repeated, corpus)
    shown = lambda df: sorted(
        map(tuple, df.select("id", "question", P.option_lines(F.col("answers")), "extra").collect())
    )
    assert shown(back) == shown(corpus)


def test_gather_keeps_option_order(spark):
    corpus = spark.createDataFrame([("q", "?", ["c", "a", "b"])], "id string, question string, ks array<string>")
    corpus = corpus.withColumn("answers", F.map_from_arrays("ks", "ks"))
    back = W.gather_fields(W.explode_fields(corpus), corpus).select(F.map_keys("answers")).first()[0]
    assert back == ["c", "a", "b"]


def test_profiles(spark):
    prompt, raw = "P#?", "P#? (a) # (b)\nx [/INST] (c) [/INST] (d)<|assistant|>\n(e)"
    rows = [(p[0], prompt, raw, 5) for p in fixed.RUNNER_PROFILES]
    df = A.with_profiles(spark.createDataFrame(rows, "profile string, prompt string, generated string, n int"))
    got = {r["profile"]: r for r in A.read_profiled_answers(df, num_answers="n").collect()}
    assert len(got) == 15
    assert got["api"]["answer_text"] == raw
    assert got["bloomz"]["answer_text"] == raw[3:]
    assert got["llama"]["answer_text"] == " (a) # (b)"
    assert got["mistral"]["answer_text"] == " (c) "
    assert got["mpt"]["answer_text"] == " (a) "
    assert got["zephyr"]["labels"] == ["e"]


def test_llama_assumes_five_options(spark):
    df = spark.createDataFrame([("llama", "", "(e)", 3), ("bloomz", "", "(e)", 3)], "profile string, prompt string, generated string, n int")
    got = {r["profile"]: r["labels"] for r in A.read_profiled_answers(A.with_profiles(df), num_answers="n").collect()}
    assert got == {"llama": ["e"], "bloomz": ["a"]}


def test_shared_folder_is_the_named_one(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_flaky_stand_in_counts_only_the_prompt_at_hand():
    """Copies of a prompt fail alike wherever they stand, and nothing is kept for prompts that are done."""
    generator = D.flaky_generator()
    tries = {}
    for prompt in ["p0", "p1", "p2", "p3", "p4", "p0", "p3"]:
        n = 1
        while True:
            try:
                generator([prompt], [{}])
                break
            except D.Throttled:
                n += 1
        assert tries.setdefault(prompt, n) == n == int(D.digest(prompt)[0], 16) // 4 + 1
    assert max(tries.values()) > 1
