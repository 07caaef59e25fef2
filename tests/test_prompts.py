"""Rendering of questions and prompts."""

import pytest
from pyspark.sql import functions as F

from gradeloom import fixed
from gradeloom.functions import prompts as P
from gradeloom.operators import prompts as R
from gradeloom.schema import MCQ

ROWS = [
    ("q1", "Où ?", {"a": "ici", "b": "là", "c": "50 %s"}, ["a", "c"]),
    ("q2", "Qui ?", {"a": "x", "d": "moi", "e": "toi"}, ["e"]),
    ("q3", "Quoi ?", {"a": "x"}, ["z"]),
]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(ROWS, MCQ)


def texts(df, column):
    return {r["id"]: r["x"] for r in df.select("id", column.alias("x")).collect()}


def test_styles(corpus):
    body = "Où ?\n(a) ici.\n(b) là.\n(c) 50 %s."
    assert texts(corpus, R.linearized("bare"))["q1"] == body
    assert texts(corpus, R.linearized("open"))["q1"] == body + "\nRéponse(s) :"
    assert texts(corpus, R.linearized("open", left_parenthesis=True))["q1"] == body + "\nRéponse(s) : ("
    assert texts(corpus, R.linearized("gold"))["q1"] == body + "\nRéponse(s) : (a) (c)"
    assert texts(corpus, R.linearized("gold_full"))["q1"] == body + "\nRéponse(s) : (a) ici; (c) 50 %s.\n"


def test_unknown_gold_letter_is_null_not_dropped(corpus):
    full = texts(corpus, R.linearized("gold_full"))
    assert full["q3"] is None and full["q2"].endswith("(e) toi.\n")


def test_template_takes_the_body_once(corpus):
    prompt = {r["id"]: r["prompt"] for r in R.render_prompts(corpus).collect()}
    assert prompt["q1"] == fixed.TEMPLATES["0"][:-2] + "Où ?\n(a) ici.\n(b) là.\n(c) 50 %s.\nRéponse(s) :"
    english = R.render_prompts(corpus, "en/0").where("id = 'q2'").first()["prompt"]
    assert english.startswith("This is a multiple") and english.endswith("Réponse(s) :\n\nAnswer : (")


def test_template_by_row_and_from_a_table(spark, corpus):
    keyed = corpus.withColumn("template_id", F.when(F.col("id") == "q1", "0").otherwise("none"))
    prompt = {r["id"]: r["prompt"] for r in R.render_prompts(keyed, F.col("template_id")).collect()}
    assert prompt["q1"] and prompt["q2"] is None
    table = spark.createDataFrame([("0", "T: %s")], "template_id string, template string")
    assert R.with_templates(keyed, table).first()["template"] == "T: %s"


def test_few_shots(corpus):
    pool = corpus.where("id <> 'q3'")
    got = {r["id"]: r["prompt"] for r in R.few_shot_prompts(corpus, pool, 2).collect()}
    shots = [texts(corpus, R.linearized("gold"))[k] for k in ("q1", "q2")]
    asked = texts(corpus, R.linearized("open"))["q3"]
    assert got["q3"] == fixed.TEMPLATES["0"].replace("%s", "\n\n".join([*shots, asked]))


def test_no_shots_equal_the_plain_prompt(corpus):
    got = {r["id"]: r["prompt"] for r in R.few_shot_prompts(corpus, corpus.where("false"), 3).collect()}
    assert got == {r["id"]: r["prompt"] for r in R.render_prompts(corpus).collect()}


def test_chat(corpus):
    row = corpus.where("id = 'q3'").select(
        P.user_messages(F.lit("p")).alias("u"),
        P.system_user_messages(F.lit("p")).alias("s"),
        P.prompter_text(F.lit("p")).alias("t"),
    ).first()
    assert [tuple(m) for m in row["u"]] == [("user", "p")]
    assert [m["role"] for m in row["s"]] == ["system", "user"]
    assert row["t"] == "<|prompter|>p<|endoftext|><|assistant|>"


def test_memorization_parts(corpus):
    prompt = P.memorization_prompt(F.col("question"), F.col("answers"))
    assert texts(corpus, prompt)["q2"] == "Complete from (a) to (e).\n\nQui ?\n(a) x."
    held = texts(corpus, P.held_out_options(F.col("answers")))
    assert held["q2"] == "(d) moi.\n(e) toi." and held["q1"] == ""
