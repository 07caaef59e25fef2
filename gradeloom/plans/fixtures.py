"""Question sets, predictions and generated text derived from the given tables.

Orders are questions, their line numbers the options, returned lines the gold answers. Every table is
used whole.
"""

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gradeloom import fixed
from gradeloom.functions.prompts import gold_letters

RUNS = ("strict", "broad", "status")
PAIRS = [("broad", "strict"), ("broad", "status"), ("status", "strict")]


class Tables:
    """The given parquet tables of one scale."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def question_id(order_key: Column) -> Column:
    """Known not to be null, so that a join on it does not hash every line again just to check that."""
    return F.coalesce(F.sha2(order_key.cast("string"), 256), F.lit(""))


def _letter_at(position: Column) -> Column:
    return F.char(position + ord("a"))


MARKS = {
    "gold": lambda line: line["returned"] == "R",
    "strict": lambda line: (line["returned"] == "R") & (line["filled"] == "F"),
    "broad": lambda line: line["returned"] != "N",
    "status": lambda line: line["filled"] == "F",
}
_MARK_BITS = len(MARKS)
_NO_LINE = -(1 << 40)  # below every int


def _line_numbers(lines) -> Column:
    return F.array_sort(F.array_distinct(F.transform(lines, lambda x: x["line"])))


def _labels(bit: int) -> Column:
    """Letters of the lines of an order that have the mark of ``bit``, ``a`` if none has it."""
    marked = F.filter("placed", lambda x: x.bitwiseAND(F.lit(bit)) != 0)
    letter = lambda x: F.when(x >= 0, _letter_at(F.shiftright(x, _MARK_BITS).cast("int")))
    found = F.array_distinct(F.transform(marked, letter))
    return F.when(F.size(found) == 0, F.array(F.lit(fixed.DEFAULT_LABEL))).otherwise(found)


def answer_sheet(t: Tables) -> DataFrame:
    """One row per order: number of options, gold letters and the letters of each run.

    Distinct lines are gathered in one aggregation, combined before the shuffle; whichever columns are asked for, the
    aggregation is the same, so a plan that uses the sheet twice shuffles it once. A line is one number: its line number (an
    int; null is below all) before a bit for each mark. An order's lines are sorted and lettered once for all label sets; a
    line without a number takes a place, but has no letter. Orders may have any number of lines.
    """
    values = {"returned": F.col("l_returnflag"), "filled": F.col("l_linestatus")}
    line = F.coalesce(F.shiftleft(F.col("l_linenumber").cast("long"), _MARK_BITS), F.lit(_NO_LINE << _MARK_BITS))
    for i, mark in enumerate(MARKS.values()):
        line += F.when(mark(values), F.lit(1 << i)).otherwise(F.lit(0)).cast("long")
    orders = t("lineitem").groupBy(F.col("l_orderkey").alias("okey")).agg(F.sort_array(F.collect_set(line)).alias("lines"))
    orders = orders.withColumn("numbers", F.array_distinct(F.transform("lines", lambda x: F.shiftright(x, _MARK_BITS))))

    def placed(x):
        """Place among the numbers, -1 for the one that stands for null, before the bits."""
        number = F.shiftright(x, _MARK_BITS)
        place = F.when(number == _NO_LINE, F.lit(-1).cast("long")).otherwise(F.array_position("numbers", number) - 1)
        return F.shiftleft(place, _MARK_BITS) + x.bitwiseAND(F.lit((1 << _MARK_BITS) - 1))

    return orders.withColumn("placed", F.transform("lines", placed)).select(
        "okey",
        question_id(F.col("okey")).alias("id"),
        F.size("numbers").cast("long").alias("n_options"),
        *[_labels(1 << i).alias(name) for i, name in enumerate(MARKS)],
    )


def references(t: Tables) -> DataFrame:
    return answer_sheet(t).select("id", "gold", "n_options")


def _by_run(sheet: DataFrame, *others: str) -> DataFrame:
    runs = F.array(*[F.struct(F.lit(r).alias("run"), F.col(r).alias("labels")) for r in RUNS])
    return sheet.select(*others, F.inline(runs))


def predictions(t: Tables) -> DataFrame:
    """``(run, id, labels)`` of three runs."""
    return _by_run(answer_sheet(t), "id")


def repeated_predictions(t: Tables) -> DataFrame:
    """Predictions that name a letter twice where two runs agree."""
    return answer_sheet(t).select(
        F.lit("strict+status").alias("run"), "id", F.concat("strict", "status").alias("labels")
    )


def stored_answers(t: Tables) -> DataFrame:
    """``(run, id, answer)`` with answers as stored text."""
    return predictions(t).select("run", "id", F.array_join("labels", "|").alias("answer"))


def _option(number: Column, i: Column) -> Column:
    """The option of a line number: its letter, text, and the text a model would recall."""
    same = F.filter("lines", lambda x: x["line"] == number)
    part = F.array_max(F.transform(same, lambda x: x["part"]))
    known = F.exists(same, lambda x: x["filled"] == "F")
    return F.struct(
        _letter_at(i).alias("letter"),
        part["p_name"].alias("text"),
        F.when(known, part["p_name"])
        .otherwise(F.concat(F.lower(part["p_type"]), F.lit(" "), part["p_name"]))
        .alias("recalled"),
        F.exists(same, lambda x: x["returned"] == "R").alias("gold"),
    )


def questions(t: Tables) -> DataFrame:
    """Questions with order columns beside them; lines that repeat a number count once, with their largest part.

    Lines are shuffled once, by order, after their part is joined to them; orders are joined where they are then.
    """
    part = F.struct("p_partkey", "p_name", "p_type").alias("part")
    line = F.struct(
        F.col("l_linenumber").alias("line"), part, F.col("l_returnflag").alias("returned"), F.col("l_linestatus").alias("filled")
    )
    sheets = (
        t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(F.collect_set(line).alias("lines"))
        .withColumn("options", F.transform(_line_numbers("lines"), _option))
    )
    orders = t("orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    right = F.transform(F.filter("options", lambda o: o["gold"]), lambda o: o["letter"])
    return (
        sheets.join(orders, "o_orderkey")
        .select(
            question_id(F.col("o_orderkey")).alias("id"),
            F.concat(
                F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit(" "), "o_orderpriority", F.lit("?")
            ).alias("question"),
            F.map_from_entries(F.transform("options", lambda o: F.struct(o["letter"], o["text"]))).alias("answers"),
            F.when(F.size(right) == 0, F.array(F.lit(fixed.DEFAULT_LABEL))).otherwise(right).alias("correct_answers"),
            F.map_from_entries(F.transform("options", lambda o: F.struct(o["letter"], o["recalled"]))).alias("recalled"),
            "o_orderpriority",
            "o_orderstatus",
        )
    )


def mcq(t: Tables) -> DataFrame:
    """``(id, question, answers, correct_answers)``."""
    return questions(t).select("id", "question", "answers", "correct_answers")


def generations(t: Tables) -> DataFrame:
    """Text of three runs in the ways models write: the order's priority and status pick the way.

    Orders are joined before the runs part, so a row for each order is sorted and not one for each run.
    """
    orders = t("orders").select(F.col("o_orderkey").alias("okey"), "o_orderpriority", "o_orderstatus")
    sheet = answer_sheet(t).join(orders, "okey")
    rows = _by_run(sheet, "okey", "id", "n_options", "gold", "o_orderpriority", "o_orderstatus")
    labels, priority, status = F.col("labels"), F.col("o_orderpriority"), F.col("o_orderstatus")
    marked = gold_letters(labels)
    text = (
        F.when(priority == "1-URGENT", marked)
        .when(priority == "2-HIGH", F.substr(marked, F.lit(2)))
        .when(priority == "3-MEDIUM", F.concat(F.lit("Les réponses sont "), F.array_join(labels, ", "), F.lit(".")))
        .when(priority == "4-NOT SPECIFIED", F.upper(marked))
        .when(status == "F", F.lit(""))
        .when(status == "O", F.concat(F.lit("Ceci est une question de QCM (e)\n"), marked))
        .otherwise(F.concat(F.lit(" "), marked, F.lit("\n \t\n(a) (b)")))
    )
    return rows.select("run", "id", "n_options", "gold", text.alias("generated"))


def part_answers(t: Tables) -> DataFrame:
    """``(run, id, answer)`` of many runs over parts: not every run has every part, and some answers are missing."""
    lines = t("lineitem")
    run = F.concat("l_returnflag", "l_linestatus", F.lit("/"), (F.col("l_linenumber") % 3).cast("string"))
    most = F.max("l_linenumber")
    return lines.groupBy(run.alias("run"), F.col("l_partkey").cast("string").alias("id")).agg(
        F.when(most <= 6, _letter_at(most)).alias("answer")
    )


def turn_pairs(t: Tables) -> DataFrame:
    """Each turn of a conversation with the turn after it."""
    turns = t("conversations")
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    return turns.withColumnRenamed("text", "prompt").join(after, ["conv_id", "turn"])


class Throttled(Exception):
    """What the stand-in generator raises to be called again."""


def digest(prompt: str) -> str:
    return hashlib.md5(prompt.encode()).hexdigest()


def stub_text(prompt: str) -> str:
    """Stand-in for a model: letters picked by the prompt's hash."""
    chosen = [letter for letter, digit in zip("abcde", digest(prompt)) if digit >= "8"]
    return " ".join(f"({letter})" for letter in chosen)


def stub_generator():
    return stub_text


def digest_generator():
    return digest


def limited_generator():
    """A stand-in that keeps to the number of tokens its settings allow, and gives all without any."""
    return lambda prompts, params: [digest(p)[: int(x.get("max_new_tokens", 32))] for p, x in zip(prompts, params)]


def flaky_generator():
    """A stand-in that fails zero to three times per prompt before it answers.

    Calls are repeated until they answer or are given up, so only those of the prompt at hand are counted.
    """
    asked, calls = None, 0

    def answer(prompts, params):
        nonlocal asked, calls
        texts = []
        for prompt in prompts:
            asked, calls = prompt, calls + 1 if prompt == asked else 1
            if calls <= int(digest(prompt)[0], 16) // 4:
                raise Throttled("try again")
            texts.append(stub_text(prompt))
        return texts

    return answer


def upper_rewriter():
    return lambda cells: [cell.upper() for cell in cells]
