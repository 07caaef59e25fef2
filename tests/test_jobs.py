"""Whole jobs."""

import pytest
from pyspark.sql import functions as F

from gradeloom.operators.generate import one_by_one
from gradeloom.plans import jobs as J
from gradeloom.schema import MCQ
from gradeloom.sources import corpus as C

ROWS = [(f"q{i}", f"Question {i} ?", {k: f"{k}{i}" for k in "abcde"}, ["a", "c"] if i % 2 else ["b"]) for i in range(40)]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(ROWS, MCQ)


def test_a_stopped_run_goes_on(spark, corpus, tmp_path):
    calls, path = tmp_path / "calls", str(tmp_path / "stored")
    calls.mkdir()
    folder = str(calls)

    def model(broken):
        def make():
            import os
            import uuid

            def answer(prompt):
                if broken and "Question 7 " in prompt:
                    raise RuntimeError("model down")
                open(os.path.join(folder, uuid.uuid4().hex), "w").close()
                return prompt + " (a) (c)"

            return answer

        return one_by_one(make)

    with pytest.raises(Exception, match="model down"):
        J.answer_corpus(corpus, model(True), path, run="m", profile="bloomz", parts=4)
    kept = J._stored(spark, path, J.STORED).count()
    stored = J.answer_corpus(corpus, model(False), path, run="m", profile="bloomz", parts=4)
    assert stored.count() == 40 and stored.select("id").distinct().count() == 40
    spent = len(list(calls.iterdir()))
    J.answer_corpus(corpus, model(False), path, run="m", profile="bloomz", parts=4)
    assert len(list(calls.iterdir())) == spent
    other = J.answer_corpus(corpus, model(False), path, run="other", profile="bloomz")
    assert other.count() == 40 and kept < 40
    scores = {r["run"]: r for r in J.score_answers(spark.read.parquet(path), corpus).collect()}
    assert {k: (r["n"], r["exact_match"], r["n_defaulted"]) for k, r in scores.items()} == {
        "m": (40, 0.5, 0),
        "other": (40, 0.5, 0),
    }


def test_a_throttled_run_leaves_failed_rows_pending(spark, corpus, tmp_path):
    """Rows that used up their attempts are tried again by the next call; settings and own prompt reach the function."""

    class Busy(Exception):
        pass

    def model(stubborn):
        def make():
            def answer(prompts, params):
                assert params[0] == {"max_tokens": "9", "temperature": "0"}
                assert prompts[0].startswith("Mine: Question ")
                if stubborn and "Question 7 " in prompts[0]:
                    raise Busy("later")
                return ["(b)"]

            return answer

        return make

    path = str(tmp_path / "s")
    options = {
        "run": "m", "profile": "api", "model": "cohere/any", "template": "Mine: %s", "retry_on": (Busy,), "first_wait": 0.0,
        "settings": {"max_tokens": 9, "temperature": 0},
    }
    assert J.answer_corpus(corpus, model(True), path, max_attempts=2, **options).count() == 39
    stored = J.answer_corpus(corpus, model(False), path, **options)
    assert stored.count() == 40 and J.score_answers(stored, corpus).first()["exact_match"] == 0.5


def test_the_corpus_is_read_once(spark, corpus, tmp_path):
    """However many parts there are, the corpus is rendered by one job."""
    seen = spark.sparkContext.accumulator(0)

    def count(x):
        seen.add(1)
        return x

    counted = corpus.withColumn("question", F.udf(count)("question"))
    J.answer_corpus(counted, one_by_one(lambda: lambda p: "(a)"), str(tmp_path / "s"), run="m", profile="mpt", parts=5)
    assert seen.value == 40


def test_shots_of_a_pool(spark, corpus, tmp_path):
    pool = spark.createDataFrame([("z", "Shown ?", {"a": "x"}, ["a"])], MCQ)
    make = one_by_one(lambda: lambda p: "(c)" if "Shown ?\n(a) x.\nRéponse(s) : (a)\n\nQuestion" in p else "")
    stored = J.answer_corpus(corpus, make, str(tmp_path / "s"), run="m", profile="flan-t5", pool=pool)
    assert {r["generated"] for r in stored.collect()} == {"(c)"}


def test_chat_profile_sends_messages(corpus, tmp_path):
    def make():
        import json

        def answer(prompts, params):
            turns = [json.loads(p) for p in prompts]
            assert all([m["role"] for m in t] == ["system", "user"] for t in turns)
            assert all(p["max_tokens"] == "32" for p in params)
            return ["<|assistant|>\n(b)" for _ in prompts]

        return answer

    stored = J.answer_corpus(corpus, make, str(tmp_path / "s"), run="z", profile="zephyr")
    assert {tuple(r["labels"]) for r in J.read_answers(stored, corpus).collect()} == {("b",)}


def write(folder, name, lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(lines) + "\n")
    return str(folder)


def test_files(spark, tmp_path):
    refs = write(tmp_path / "ref", "dev_prompt0.txt", ["1;a|b", "2;c", "3;a"])
    runs = write(tmp_path / "out", "x_prompt0.txt", ["1;a", "1;a|b", "2;c|d", "3;b"])
    write(tmp_path / "out", "y_prompt0.txt", ["1;a|b", "2;c"])
    checks, scores = J.score_files(spark, runs, refs)
    assert {r["run"]: (r["complete"], r["missing"]) for r in checks.collect()} == {"x": (True, 0), "y": (False, 1)}
    got = {r["run"]: (r["exact_match"], r["hamming_score"]) for r in scores.collect()}
    assert got["x"] == (pytest.approx(1 / 3), pytest.approx(0.5)) and got["y"] == (1.0, 1.0)

    both = J.compare_files(spark, f"{runs}/x_prompt0.txt", f"{runs}/y_prompt0.txt").first()
    assert (both["n"], both["only_a"], both["only_b"], both["agreement"]) == (2, 1, 0, 0.5)

    J.count_file(spark, f"{refs}/dev_prompt0.txt", str(tmp_path / "refcounts"))
    J.count_file(spark, f"{runs}/y_prompt0.txt", str(tmp_path / "counts"))
    checks, report, line = J.classify_files(spark, str(tmp_path / "counts"), str(tmp_path / "refcounts"))
    assert {(r["label"], r["f1"], r["support"]) for r in report.collect()} == {("1", 1.0, 1), ("2", 1.0, 1)}
    assert line.first()["accuracy_pct"] == 100.0 and not checks.first()["complete"]


def test_memorization_and_rewriting(spark, corpus, tmp_path):
    def recall(prompt):
        number = prompt.split("Question ")[1].split(" ")[0]
        return f"(d) d{number}.\n(e) e{number}." if int(number) % 2 else "?"

    path = str(tmp_path / "meld")
    summary = J.check_memorization(corpus, one_by_one(lambda: recall), path).first()
    assert (summary["n"], summary["meld_rate"], summary["avg_distance"]) == (40, 0.5, 0.5)
    stored = C.read_meld_results(spark, path)
    assert stored.where(F.to_json("saved_answers") == F.to_json("answers")).count() == 40

    J.rewrite_corpus(corpus, lambda: lambda cells: [c[::-1] for c in cells], str(tmp_path / "rewritten"))
    rows = {r["id"]: r for r in C.read_corpus(spark, str(tmp_path / "rewritten")).collect()}
    assert rows["q3"]["answers"]["d"] == "3d" and rows["q3"]["correct_answers"] == ["a", "c"]
