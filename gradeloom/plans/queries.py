"""One query per operator, over the given tables."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gradeloom import fixed
from gradeloom.functions import letters, prompts as P, text as X
from gradeloom.operators import answers as A, generate as G, memorize as M, prompts as R
from gradeloom.operators import rewrite as W, scoring as S, training as T
from gradeloom.plans import fixtures as D, jobs as J
from gradeloom.plans.fixtures import Tables
from gradeloom.session import materialize, scratch_path, ship_package
from gradeloom.sources import corpus as C, predictions as I
from gradeloom.sources.arrays import write_array
from gradeloom.streaming import leaderboard as Board, predictions as Stream

REGISTRY = {}


def query(plan):
    """Register ``plan(tables)`` under its name as ``(spark, sf_dir) -> DataFrame``."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package()
        return plan(Tables(spark, sf_dir))

    REGISTRY[plan.__name__] = run
    return plan


def joined(labels) -> Column:
    return F.array_join(labels, "|")


def long(column) -> Column:
    return column.cast("long")


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def shown(df: DataFrame) -> DataFrame:
    """Questions with options and gold letters as text."""
    return df.select(
        "id", "question", P.option_lines(F.col("answers")).alias("options"), joined("correct_answers").alias("gold")
    )


def scored(t: Tables) -> DataFrame:
    return S.join_predictions(D.predictions(t), D.references(t))


def scored_with_repeats(t: Tables) -> DataFrame:
    both = D.predictions(t).unionByName(D.repeated_predictions(t))
    return S.join_predictions(both, D.references(t))


def counted(t: Tables) -> DataFrame:
    """Label counts of predictions and references as classes, and the two document labels."""
    pairs = scored(t).select(
        "run",
        F.size("labels").cast("string").alias("predicted"),
        F.size("gold").cast("string").alias("reference"),
    )
    documents = t("labels").select(
        F.lit("labels").alias("run"),
        F.col("toxic").cast("string").alias("predicted"),
        F.col("quality").cast("string").alias("reference"),
    )
    return pairs.unionByName(documents)


def stored_lines(t: Tables) -> DataFrame:
    """Prediction files as found in the wild: blanks, extra fields, missing answers, empty lines."""
    answer = joined("labels")
    line = (
        F.when(F.col("run") == "strict", F.concat("id", F.lit(";"), answer))
        .when(F.col("run") == "broad", F.concat(F.lit(" "), "id", F.lit("; "), answer, F.lit(" ")))
        .when(F.size("labels") == F.col("n_options"), F.col("id"))
        .when(answer == fixed.DEFAULT_LABEL, F.lit(""))
        .otherwise(F.concat("id", F.lit(";"), answer, F.lit(";"), F.col("n_options").cast("string")))
    )
    rows = S.join_predictions(D.predictions(t), D.references(t)).select("run", line.alias("value"))
    path = scratch_path(t.spark, "lines")
    rows.write.partitionBy("run").text(path)
    return I.read_lines(t.spark, path)


def recalled(t: Tables) -> DataFrame:
    """Memorization prompts with a stand-in completion of the held-out options."""
    prompted = M.memorization_prompts(D.questions(t))
    return prompted.withColumn("generated", P.held_out_options(F.col("recalled")))


# Readers and writers


@query
def scan_mcq(t):
    path = scratch_path(t.spark, "corpus")
    C.write_rows(D.mcq(t), path)
    return shown(C.read_corpus(t.spark, path))


@query
def scan_mcq_array(t):
    """One JSON array over all files of a folder, written in the order of ids and read by many tasks."""
    path = scratch_path(t.spark, "array")
    write_array(materialize(D.mcq(t), "questions"), path, ["id"])
    return shown(C.read_corpus(t.spark, path, layout="parts"))


@query
def scan_predictions(t):
    return I.parse_lenient(stored_lines(t)).select("run", "id", "answer")


@query
def scan_predictions_strict(t):
    good, bad = I.parse_strict(stored_lines(t))
    nothing = F.lit(None).cast("string")
    return good.select("run", "id", "answer", nothing.alias("bad_line")).unionByName(
        bad.select("run", nothing.alias("id"), nothing.alias("answer"), F.col("value").alias("bad_line"))
    )


def _stored_runs(t):
    path = scratch_path(t.spark, "runs")
    I.write_predictions(D.predictions(t), path)
    return I.read_predictions(t.spark, path)


@query
def scan_runs(t):
    return _stored_runs(t)


@query
def run_settings(t):
    customers = t("customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("epochs"))
    nations = t("nation").join(customers, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    settings = F.struct(
        F.concat(F.lit("model é "), "n_name").alias("backbone"),
        F.coalesce("epochs", F.lit(0)).alias("epochs"),
        (F.col("n_regionkey") > 2).alias("is_int8"),
        F.lit("Q: %s").alias("prompt"),
    )
    path = scratch_path(t.spark, "settings")
    nations.select(F.col("n_name").alias("run"), F.to_json(settings).alias("value")).write.partitionBy("run").text(path)
    read = C.read_run_settings(t.spark, path)
    return read.select("run", *[F.col("params")[k].alias(k) for k in ("backbone", "epochs", "is_int8", "prompt")])


@query
def format_predictions(t):
    upper = F.transform("labels", lambda x: F.upper(x))
    return D.predictions(t).select(
        "run",
        I.prediction_line(F.col("id"), F.col("labels")).alias("line"),
        I.prediction_line(F.col("id"), upper, lower=True).alias("lower_line"),
    )


@query
def label_count(t):
    key, answer = F.col("id"), F.col("answer")
    return D.stored_answers(t).select(
        "run", "id", long(letters.label_count(answer)).alias("n_labels"), I.count_line(key, answer).alias("line")
    )


# Prompts


@query
def linearize_bare(t):
    return D.mcq(t).select("id", R.linearized("bare").alias("text"))


@query
def linearize_open(t):
    return D.mcq(t).select(
        "id",
        R.linearized("open").alias("text"),
        R.linearized("open", left_parenthesis=True).alias("text_parenthesis"),
    )


@query
def linearize_gold(t):
    return D.mcq(t).select("id", R.linearized("gold").alias("text"))


@query
def linearize_gold_full(t):
    return D.mcq(t).select("id", R.linearized("gold_full").alias("text"))


@query
def render_prompt(t):
    french = R.render_prompts(D.mcq(t)).withColumnRenamed("prompt", "prompt_fr")
    return R.render_prompts(french, "en/0").select("id", "prompt_fr", F.col("prompt").alias("prompt_en"))


@query
def render_from_table(t):
    status = F.col("o_orderstatus")
    templates = t("orders").where(status != "P").select(
        status.alias("template_id"), F.concat(status, F.lit(": %s\n"), status).alias("template")
    ).distinct()
    rows = R.with_templates(D.questions(t).withColumnRenamed("o_orderstatus", "template_id"), templates)
    return rows.select("id", P.apply_template(F.col("template"), R.linearized("open")).alias("prompt"))


@query
def few_shot_prompt(t):
    """Open and filled orders are asked, three of the others are shown with their answers."""
    rows = D.questions(t)
    asked, pool = rows.where(F.col("o_orderstatus") != "P"), rows.where(F.col("o_orderstatus") == "P")
    return R.few_shot_prompts(asked, pool, shots=3, style="gold_full", left_parenthesis=True).select("id", "prompt")


@query
def few_shot_whole_pool(t):
    """A pool of five questions, the first by id, is shown whole to all others."""
    rows = materialize(D.mcq(t), "questions")
    chosen = rows.orderBy("id").limit(5)
    asked = G.pending(rows, chosen, ["id"])
    return R.few_shot_prompts(asked, chosen, template_id="en/0").select("id", "prompt")


def _as_text(messages) -> Column:
    return F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")


@query
def chat_messages(t):
    prompt = F.col("prompt")
    return R.render_prompts(D.mcq(t)).select(
        "id",
        _as_text(P.user_messages(prompt)).alias("user_chat"),
        _as_text(P.system_user_messages(prompt)).alias("system_chat"),
        P.prompter_text(prompt).alias("prompter_text"),
    )


@query
def meld_prompt(t):
    return M.memorization_prompts(D.mcq(t)).select("id", "prompt", "reference")


@query
def explode_fields(t):
    return W.explode_fields(D.mcq(t)).withColumn("pos", long(F.col("pos")))


@query
def gather_fields(t):
    corpus = D.mcq(t)
    cells = W.explode_fields(corpus).withColumn("text", F.upper("text"))
    return shown(W.gather_fields(cells, corpus))


@query
def sft_text(t):
    full = T.training_text(D.mcq(t)).withColumnRenamed("text", "text_full")
    return T.training_text(full, full_answers=False).select(
        "id", F.col("text_full").alias("text"), F.col("text").alias("text_letters")
    )


# Generated text


@query
def strip_echo(t):
    echoed = D.turn_pairs(t).withColumn("generated", F.concat("prompt", "reply"))
    return echoed.select("conv_id", "turn", X.strip_echo(F.col("generated"), F.col("prompt")).alias("text"))


@query
def after_marker(t):
    marked = F.concat(F.lit("[INST] "), "prompt", F.lit(" [/INST] "), "reply")
    echoed = D.turn_pairs(t).withColumn(
        "generated", F.when(F.col("role") == "system", F.concat("prompt", "reply")).otherwise(marked)
    )
    unechoed = X.strip_echo(F.col("generated"), F.col("prompt"))
    return echoed.select("conv_id", "turn", X.after_marker(unechoed).alias("text"))


@query
def chat_second_line(t):
    chat = F.concat(F.lit("<|user|>\n"), "prompt", F.lit("\n<|assistant|>\n"), "reply")
    rendered = F.when(F.col("role") == "system", F.concat(F.lit("<|assistant|>"), "reply")).otherwise(chat)
    return D.turn_pairs(t).select("conv_id", "turn", X.chat_second_line(rendered).alias("text"))


@query
def before_marker(t):
    return t("documents").select("doc_id", X.before_marker(F.col("text")).alias("text"))


@query
def first_line(t):
    return t("documents").select("doc_id", X.first_line(F.col("text")).alias("text"))


@query
def extract_first_paragraph(t):
    paragraph = letters.first_paragraph(letters.clean(F.col("generated")))
    return D.generations(t).select("run", "id", paragraph.alias("text"))


@query
def extract_parenthesized(t):
    last = letters.last_letter(F.col("n_options"))
    found = letters.parenthesized(letters.clean(F.col("generated")), last)
    return D.generations(t).select("run", "id", joined(found).alias("found"))


@query
def extract_fallback(t):
    last = letters.last_letter(F.lit(fixed.DEFAULT_OPTIONS))
    read = t("documents").withColumn("found", letters.standalone(letters.clean(F.col("text")), last))
    return read.select(
        "doc_id", joined(letters.letter_set(F.col("found"))).alias("letters"), long(F.size("found")).alias("n_found")
    )


@query
def extract_answer(t):
    first = A.extract_answers(D.generations(t), num_answers="n_options")
    both = A.extract_answers(first.drop("defaulted"), num_answers="n_options", paragraph_stop=True, output="stopped")
    return both.select("run", "id", joined("labels").alias("labels"), joined("stopped").alias("stopped"), "defaulted")


@query
def extract_answer_documents(t):
    read = A.extract_answers(t("documents"), "text")
    return read.select("doc_id", joined("labels").alias("labels"), "defaulted")


# Generation


@query
def generate_rows(t):
    prompted = R.render_prompts(D.mcq(t)).select("id", "prompt")
    return G.generate(prompted, G.one_by_one(D.stub_generator)).select("id", "generated")


@query
def generate_batches(t):
    prompted = R.render_prompts(D.mcq(t), left_parenthesis=True).select("id", "prompt")
    answered = G.generate(prompted, G.one_by_one(D.stub_generator), batch_size=24)
    return A.extract_answers(answered).select("id", joined("labels").alias("labels"), "defaulted")


@query
def rewrite_fields(t):
    return shown(W.rewrite_fields(D.mcq(t), D.upper_rewriter))


@query
def generate_with_retry(t):
    prompted = R.render_prompts(D.mcq(t)).select("id", "prompt")
    tried = G.generate_with_retry(
        prompted, D.flaky_generator, retry_on=(D.Throttled,), max_attempts=3, first_wait=0.0
    )
    return tried.select("id", "generated", long(F.col("attempts")).alias("attempts"), "error")


@query
def generate_with_settings(t):
    """Each row's settings reach the generator: those of an order's priority bound the length of the answer."""
    prompted = R.render_prompts(D.questions(t)).select("id", "prompt", "o_orderpriority")
    limit = F.create_map(F.lit("max_new_tokens"), F.substr("o_orderpriority", F.lit(1), F.lit(1)))
    params = F.when(F.col("o_orderpriority") != "5-LOW", limit)
    return G.generate(prompted, D.limited_generator, params=params).select("id", "generated")


@query
def generate_at_rate(t):
    """Answers of a job held to a rate; ``n_slots`` is how many moments of it were dealt out."""
    prompted = R.render_prompts(D.mcq(t)).select("id", "prompt")
    paced = G.generate_at_rate(prompted, G.one_by_one(D.digest_generator), per_second=20_000, tasks=2)
    rows = materialize(paced.select("id", "generated", "slot"), "paced")
    last = rows.agg((F.max("slot") + 1).alias("n_slots"), F.count_distinct("slot").alias("n_calls"))
    last = last.select(F.struct("n_slots", "n_calls").alias("slots")).scalar()
    return rows.select("id", "generated", last["n_slots"].alias("n_slots"), last["n_calls"].alias("n_calls"))


@query
def pending_questions(t):
    done = t("orders").where(F.col("o_orderstatus") == "F").select(D.question_id(F.col("o_orderkey")).alias("id"))
    return G.pending(D.references(t).select("id", joined("gold").alias("gold")), done, ["id"])


@query
def stream_predictions(t):
    path, out, state = [scratch_path(t.spark, name) for name in ("questions", "answers", "state")]
    C.write_rows(D.mcq(t), path)
    stream = Stream.stream_predictions(t.spark, path, out, state, G.one_by_one(D.stub_generator), batch_size=24)
    stream.awaitTermination()
    return I.parse_lenient(t.spark.read.text(out))


def _corrected_lines(t: Tables) -> str:
    """A folder of prediction files in three generations: each corrects lines of those before it."""
    path = scratch_path(t.spark, "corrected")
    rows = materialize(D.answer_sheet(t).select("id", *D.RUNS), "sheet")
    for number, run in enumerate(("broad", "status", "strict")):
        some = rows.where(F.substr("id", F.lit(1), F.lit(1)) >= F.lit("048"[number]))
        some.select(I.prediction_line(F.col("id"), F.col(run)).alias("value")).write.text(f"{path}/run=mine/{number}")
    return path


@query
def stream_last_lines(t):
    path, (out, state) = _corrected_lines(t), [scratch_path(t.spark, name) for name in ("changes", "state")]
    for _ in range(2):
        Board.stream_last_lines(t.spark, path, out, state, files_per_batch=4).awaitTermination()
    return Board.last_lines(t.spark, out)


@query
def stream_leaderboard(t):
    path, (out, state) = _corrected_lines(t), [scratch_path(t.spark, name) for name in ("sums", "state")]
    refs = materialize(D.references(t).select("id", "gold"), "references")
    Board.stream_leaderboard(t.spark, path, refs, out, state, files_per_batch=4).awaitTermination()
    return rounded(Board.leaderboard(t.spark, out), "exact_match", "hamming_score")


def routed(t: Tables) -> DataFrame:
    segment = F.col("c_mktsegment")
    model = (
        F.when(segment == "AUTOMOBILE", F.lit("openai/gpt-4"))
        .when(segment == "BUILDING", F.lit("openai/text-davinci-003"))
        .when(segment == "FURNITURE", F.lit("cohere/command-xlarge-beta"))
        .when(segment == "HOUSEHOLD", F.concat(F.lit("ai21/"), "c_name", F.lit("/large")))
        .otherwise(F.concat(F.lit("local/"), "c_name"))
    )
    return G.route_models(t("customer").select("c_custkey", "c_name", model.alias("model")))


@query
def route_models(t):
    return routed(t).select("c_custkey", "model", "provider", "name", "kind")


@query
def generate_routed(t):
    makers = {"chat": G.one_by_one(D.stub_generator), "completion": G.one_by_one(D.digest_generator)}
    return G.generate_by_kind(routed(t), makers, prompt="c_name").select("c_custkey", "kind", "generated")


@query
def runner_profiles(t):
    names = F.array(*[F.lit(p[0]) for p in fixed.RUNNER_PROFILES])
    place = (F.substr("o_orderpriority", F.lit(1), F.lit(1)).cast("int") - 1) * 3 + F.instr(
        F.lit("FOP"), F.col("o_orderstatus")
    )
    hosted = F.when(F.substr("id", F.lit(1), F.lit(1)) < "8", F.lit("chat")).otherwise(F.lit("completion"))
    asked = D.questions(t).withColumn("profile", F.element_at(names, place))
    asked = asked.withColumn("kind", F.when(F.col("profile") == "api", hosted))
    rows = A.with_profiles(asked, kind="kind")
    prompted = R.render_prompts(rows, left_parenthesis=F.col("left_parenthesis"))
    messages, text = A.wrapped_prompt(F.col("wrapper"), F.col("prompt"))
    echoed = F.concat(
        "prompt",
        F.lit(" (a)\n(b) [/INST] (c)\n\n(d) # (e)\n<|assistant|>\n"),
        P.gold_letters(F.col("correct_answers")),
        F.lit("\nfin"),
    )
    answered = prompted.withColumns({"generated": echoed, "n_options": F.size("answers")})
    read = A.read_profiled_answers(answered, num_answers="n_options")
    return read.select(
        "id",
        "profile",
        F.coalesce(text, _as_text(messages)).alias("sent"),
        "answer_text",
        joined("labels").alias("labels"),
    )


# Joins and checks


@query
def join_predictions(t):
    return scored(t).select("run", "id", joined("labels").alias("labels"), joined("gold").alias("gold"))


@query
def pairwise_runs(t):
    return S.pairwise_runs(D.stored_answers(t), D.PAIRS)


@query
def check_ids(t):
    sheet = D.answer_sheet(t).select(F.lit("lines").alias("run"), "id")
    orders = t("orders").select(F.lit("orders").alias("run"), D.question_id(F.col("o_orderkey")).alias("id"))
    filled = t("lineitem").where(F.col("l_linestatus") == "F").select(
        F.lit("filled").alias("run"), D.question_id(F.col("l_orderkey")).alias("id")
    )
    return S.check_ids(sheet.unionByName(orders).unionByName(filled), D.references(t))


@query
def dedup_last(t):
    lines = t("lineitem").select(
        F.col("l_returnflag").alias("run"),
        D.question_id(F.col("l_orderkey")).alias("id"),
        F.char(F.col("l_linenumber") + (ord("a") - 1)).alias("answer"),
        F.struct("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("seq"),
    )
    return I.last_wins(lines, ["run", "id"]).select("run", "id", "answer")


# Scores


@query
def scores_in_file_order(t):
    """Scores of a run in the order of its reference file, written so and numbered again as read."""
    sheet = materialize(D.answer_sheet(t).select("id", "gold", "strict"), "sheet")
    paths = [scratch_path(t.spark, name) for name in ("references", "scores")]
    I.write_in_order(sheet.select("id", I.prediction_line(F.col("id"), F.col("gold")).alias("value")), paths[0], ["id"])
    lines = I.in_file_order(I.read_lines(t.spark, paths[0]), ["run"])
    refs = I.parse_lenient(lines).select("position", "id", letters.parse_labels(F.col("answer")).alias("gold"))
    joined = S.join_predictions(refs, sheet.select("id", F.col("strict").alias("labels")))
    rows = rounded(S.score_rows(joined), "overlap")
    line = F.concat_ws(";", "id", F.col("exact").cast("string"), F.format_string("%.6f", "overlap"))
    scores = materialize(rows.select("position", line.alias("value")), "score-lines")  # else joined again for the ranges
    I.write_in_order(scores, paths[1], ["position"])
    fields = F.split("value", ";")
    return I.in_file_order(I.read_lines(t.spark, paths[1]), ["run"]).select(
        "position", fields[0].alias("id"), fields[1].cast("boolean").alias("exact"), fields[2].cast("double").alias("overlap")
    )


@query
def exact_match(t):
    return rounded(S.exact_match(scored_with_repeats(t)), "exact_match")


@query
def exact_match_list(t):
    return rounded(S.exact_match(scored_with_repeats(t), as_lists=True), "exact_match")


@query
def hamming_row(t):
    rows = S.score_rows(scored_with_repeats(t)).select("run", "id", "exact", "overlap", "overlap_refs_first")
    return rounded(rows, "overlap", "overlap_refs_first")


@query
def hamming_score(t):
    return rounded(S.hamming_score(scored_with_repeats(t)), "hamming_score")


@query
def hamming_per_option(t):
    return rounded(S.hamming_per_option(scored_with_repeats(t)), "hamming_per_option")


@query
def score_generations(t):
    read = A.extract_answers(D.generations(t), num_answers="n_options")
    return rounded(S.score_runs(read), "exact_match", "hamming_score", "hamming_per_option")


@query
def score_answered_run(t):
    """A whole run: prompt, generate, write, read back, extract, score."""
    corpus = materialize(D.mcq(t), "questions")
    path = scratch_path(t.spark, "generations")
    stored = J.answer_corpus(corpus, G.one_by_one(D.stub_generator), path, run="stub", profile="flan-t5")
    return rounded(J.score_answers(stored, corpus), "exact_match", "hamming_score", "hamming_per_option")


@query
def score_throttled_run(t):
    """A hosted run that is throttled, stops, goes on where it was and is scored."""
    corpus = materialize(D.mcq(t), "questions")
    path = scratch_path(t.spark, "throttled")
    options = {"run": "hosted", "profile": "api", "model": "openai/text-davinci-003", "template": "Q: %s"}
    throttled = {"retry_on": (D.Throttled,), "first_wait": 0.0, "parallel_calls": 4}
    J.answer_corpus(corpus, D.flaky_generator, path, parts=2, max_attempts=2, **options, **throttled)
    stored = J.answer_corpus(corpus, D.flaky_generator, path, settings={"temperature": "0"}, **options, **throttled)
    return rounded(J.score_answers(stored, corpus), "exact_match", "hamming_score", "hamming_per_option")


@query
def agreement(t):
    return rounded(S.agreement(D.stored_answers(t), D.PAIRS), "agreement")


@query
def agreement_many(t):
    """All pairs of a dozen runs, with ids and answers missing on either side."""
    runs = [f"{flags}/{i}" for flags in ("AF", "NF", "NO", "RF") for i in range(3)]
    pairs = [(a, b) for i, a in enumerate(runs) for b in runs[i + 1 :]]
    return rounded(S.agreement(D.part_answers(t), pairs), "agreement")


@query
def classification_report(t):
    return rounded(S.classification_report(counted(t), "predicted", "reference"), "precision", "recall", "f1")


@query
def classification_report_named(t):
    """Five classes by name, whether seen or not."""
    report = S.classification_report(counted(t), "predicted", "reference", labels=["1", "2", "3", "4", "5"])
    return rounded(report, "precision", "recall", "f1")


@query
def report_averages(t):
    report = S.classification_report(counted(t), "predicted", "reference")
    return rounded(S.report_averages(report), "precision", "recall", "f1")


@query
def accuracy_macro_f1(t):
    return rounded(
        S.accuracy_macro_f1(counted(t), "predicted", "reference"),
        "accuracy",
        "macro_f1",
        "accuracy_pct",
        "macro_f1_pct",
    )


@query
def label_histogram(t):
    sizes = D.predictions(t).select("run", long(F.size("labels")).alias("n_labels"))
    return S.label_histogram(sizes)


@query
def leaderboard(t):
    stored = _stored_runs(t).withColumn("labels", letters.parse_labels(F.col("answer")))
    table = S.score_runs(S.join_predictions(stored, D.references(t).select("id", "gold")))
    return rounded(table, "exact_match", "hamming_score")


# Memorization


@query
def meld_distance_edit(t):
    return rounded(M.with_distance(recalled(t).select("id", "reference", "generated")), "distance")


@query
def meld_distance_ratio(t):
    return rounded(M.with_distance(recalled(t).select("id", "reference", "generated"), "ratio"), "distance")


@query
def meld_summary(t):
    rows = recalled(t).select("o_orderpriority", "reference", "generated")
    return rounded(M.meld_summary(M.with_distance(rows), ["o_orderpriority"]), "meld_rate", "avg_distance")


@query
def meld_rate(t):
    rows = recalled(t).select("o_orderpriority", "reference", "generated")
    return rounded(M.meld_rate(rows, ["o_orderpriority"]), "meld_rate")


@query
def meld_results(t):
    return rounded(
        M.meld_results(recalled(t)).select(
            "id", P.option_lines(F.col("saved_answers")).alias("saved_options"), "meld.*"
        ),
        "distance",
    )


@query
def meld_recompute(t):
    path = scratch_path(t.spark, "meld")
    C.write_rows(M.meld_results(recalled(t)), path)
    return rounded(M.recompute(C.read_meld_results(t.spark, path), "ratio").select("id", "distance"), "distance")


@query
def meld_distance_turns(t):
    """Both distances between whole turns of conversations."""
    pairs = D.turn_pairs(t).select(
        "conv_id", "turn", F.col("prompt").alias("reference"), F.col("reply").alias("generated")
    )
    tasks = int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    edit = M.with_distance(pairs, tasks=tasks).withColumnRenamed("distance", "edit_distance")
    both = M.with_distance(edit, "ratio").withColumnRenamed("distance", "ratio_distance")
    return rounded(both.drop("reference", "generated"), "edit_distance", "ratio_distance")


# Training text


@query
def shuffle_rows(t):
    return T.shuffle_rows(t("documents").select("text"), ["text"], seed=42)


@query
def shuffle_by_key(t):
    return T.shuffle_by_key(t("documents"), "doc_id", seed=42)


@query
def with_splits(t):
    orders = t("orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    parts = {"train": "F", "validation": "O", "test": "P"}
    return C.with_splits(
        {name: orders.where(F.col("o_orderstatus") == status).drop("o_orderstatus") for name, status in parts.items()}
    )


@query
def truncate_tokens(t):
    cut = T.truncate_tokens(t("documents"))
    return cut.select(
        "doc_id", F.array_join("tokens", " ").alias("tokens"), long(F.col("n_tokens")).alias("n_tokens"), "truncated"
    )


@query
def completion_span(t):
    spans = T.completion_span(T.training_text(D.mcq(t)))
    return spans.select(
        "id", "prompt_part", "completion_part", long(F.col("completion_start")).alias("completion_start")
    )


@query
def length_batches(t):
    sized = t("documents").select("doc_id", F.size(T.white_space_tokens(F.col("text"))).alias("length"))
    batches = T.length_batches(sized, "doc_id", "length", batch_size=24)
    return batches.select("doc_id", *[long(F.col(c)).alias(c) for c in ("length_bucket", "batch")])


@query
def length_grouped(t):
    sized = t("documents").select("doc_id", F.size(T.white_space_tokens(F.col("text"))).alias("length"))
    return T.length_grouped(materialize(sized, "lengths"), "doc_id", "length", batch_size=24, seed=42).select(
        "doc_id", *[long(F.col(c)).alias(c) for c in ("place", "batch")]
    )
