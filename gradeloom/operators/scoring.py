"""Joining predictions to references, and the scores over them."""

import json

from pyspark.sql import DataFrame, functions as F

from gradeloom.functions import letters
from gradeloom.operators.agreement import agreement  # noqa: F401
from gradeloom.session import materialize


def join_predictions(predictions: DataFrame, references: DataFrame, on: str = "id") -> DataFrame:
    """Predictions with their reference; both sides hold one row per key (see ``last_wins``).

    No broadcast is forced: the reference side grows with the question set, so the planner decides by
    its measured size.
    """
    return predictions.join(references, on)


def id_fingerprints(rows: DataFrame, by: list[str], on: str = "id") -> DataFrame:
    """Per group the number of distinct ids, whether null is one, and two sums of independent 64-bit hashes over them.

    The sums depend on no order and hold 128 bits beside the number, so two sets are equal if all three are; that a
    different set has the same has a probability of about 10⁻³⁸.
    """
    return _prints(rows.select(*by, on).distinct(), by, on)


def _prints(distinct: DataFrame, by: list[str], on: str) -> DataFrame:
    hashed = lambda seed: F.sum(F.xxhash64(F.lit(seed), on).cast("decimal(20,0)"))
    return distinct.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(on).isNull()).alias("n_null"),
        hashed(3).alias("print_a"),
        hashed(5).alias("print_b"),
    )


def check_ids(predictions: DataFrame, references: DataFrame, on: str = "id") -> DataFrame:
    """Per run: how many reference ids are missing and how many predicted ids are not in the reference.

    Runs whose fingerprint is that of the references are done with it; only the ids of runs that differ are joined, and no
    run is paired with every reference id. ``same_ids`` is the check that both id sets are equal; ``complete`` the one that
    counts match and nothing is missing. A null id counts, and equals none.
    """
    seen = materialize(predictions.select("run", on).distinct(), "ids-seen")
    prints = materialize(_prints(seen, ["run"], on), "id-prints")
    total = materialize(id_fingerprints(references, [], on), "id-print").select(
        F.col("n").alias("n_references"), F.col("print_a").alias("ref_a"), F.col("print_b").alias("ref_b")
    )
    total = total.first()
    n_references = F.lit(total["n_references"]).cast("long")
    alike = (F.col("n") == n_references) & (F.col("n_null") == 0)
    for name in ("a", "b"):
        alike &= F.col(f"print_{name}").eqNullSafe(F.lit(total[f"ref_{name}"]).cast("decimal(30,0)"))
    prints = prints.select("run", F.col("n").alias("n_predicted"), alike.alias("_alike"))
    found = prints.where("_alike").select("run", "n_predicted", F.col("n_predicted").alias("_matched"))
    if not prints.where("NOT _alike").isEmpty():
        other = prints.where("NOT _alike").select("run", "n_predicted")
        known = references.select(on).distinct().withColumn("_known", F.lit(1))
        matched = seen.join(other.select("run"), "run", "left_semi").join(known, on, "left").groupBy("run").agg(F.count("_known").alias("_matched"))
        found = found.unionByName(other.join(matched, "run"))
    return found.withColumn("n_references", n_references).select(
        "run",
        "n_predicted",
        "n_references",
        (F.col("n_references") - F.col("_matched")).alias("missing"),
        (F.col("n_predicted") - F.col("_matched")).alias("unexpected"),
        ((F.col("n_predicted") == F.col("n_references")) & (F.col("n_references") == F.col("_matched"))).alias("complete"),
        ((F.col("n_references") == F.col("_matched")) & (F.col("n_predicted") == F.col("_matched"))).alias("same_ids"),
    )


def score_rows(joined: DataFrame, predicted: str = "labels", gold: str = "gold") -> DataFrame:
    """Add per-row scores: set equality, list equality, and overlap in both argument orders."""
    p, r = F.col(predicted), F.col(gold)
    return joined.withColumns(
        {
            "exact": letters.same_set(p, r),
            "exact_list": letters.same_list(p, r),
            "overlap": letters.overlap(p, r),
            "overlap_refs_first": letters.overlap(r, p),
        }
    )


def _share(condition):
    return F.avg(condition.cast("double"))


def exact_match(joined: DataFrame, *, as_lists: bool = False, by: str = "run") -> DataFrame:
    """Exact match ratio per run, over sets or over sorted lists."""
    same = letters.same_list if as_lists else letters.same_set
    hit = same(F.col("labels"), F.col("gold"))
    return joined.groupBy(by).agg(F.count(F.lit(1)).alias("n"), _share(hit).alias("exact_match"))


def hamming_score(joined: DataFrame, by: str = "run") -> DataFrame:
    """Mean overlap per row, with the references as first argument."""
    overlap = letters.overlap(F.col("gold"), F.col("labels")).alias("overlap")
    return joined.select(by, overlap).groupBy(by).agg(F.avg("overlap").alias("hamming_score"))


def hamming_per_option(joined: DataFrame, options: str = "n_options", by: str = "run") -> DataFrame:
    """Sum of overlaps over the number of options of all questions."""
    overlap = letters.overlap(F.col("labels"), F.col("gold")).alias("overlap")
    return (
        joined.select(by, options, overlap)
        .groupBy(by)
        .agg(F.try_divide(F.sum("overlap"), F.sum(options)).alias("hamming_per_option"))
    )


def score_runs(joined: DataFrame, by: str = "run") -> DataFrame:
    """All run-level scores in one aggregation; ``n_options`` and ``defaulted`` are used if present."""
    p, r = F.col("labels"), F.col("gold")
    optional = [c for c in ("n_options", "defaulted") if c in joined.columns]
    rows = joined.select(
        by,
        *optional,
        letters.same_set(p, r).cast("double").alias("exact"),
        letters.overlap(r, p).alias("overlap_refs_first"),
        letters.overlap(p, r).alias("overlap"),
    )
    scores = [
        F.count(F.lit(1)).alias("n"),
        F.avg("exact").alias("exact_match"),
        F.avg("overlap_refs_first").alias("hamming_score"),
    ]
    if "n_options" in optional:
        scores.append(F.try_divide(F.sum("overlap"), F.sum("n_options")).alias("hamming_per_option"))
    if "defaulted" in optional:
        scores.append(F.count_if("defaulted").alias("n_defaulted"))
    return rows.groupBy(by).agg(*scores)


def label_histogram(predictions: DataFrame, label: str = "n_labels", by: str = "run") -> DataFrame:
    """Rows per run and label."""
    return predictions.groupBy(by, label).agg(F.count(F.lit(1)).alias("n"))


def _compared(predictions: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """``(id, run_a, run_b, in_a, in_b, same)``: each id once for each asked pair.

    An id's answers meet in one row, and the pairs are one constant exploded there, so the plan is the same for any
    number of pairs and no pair of rows is ever joined. Of several answers of a run to an id the largest counts. A null
    answer is an answer that equals nothing.
    """
    runs = sorted({run for pair in pairs for run in pair})
    asked = json.dumps([{"run_a": a, "run_b": b} for a, b in pairs])
    answered = F.struct(F.col("run").alias("run"), letters.agreement_key(F.col("answer")).alias("key"))
    found = predictions.where(F.col("run").isin(runs)).groupBy("id").agg(F.collect_set(answered).alias("_found"))

    def of(run):
        return F.transform(F.filter("_found", lambda e: e["run"] == run), lambda e: e["key"])

    names = F.array_distinct(F.transform("_found", lambda e: e["run"]))
    keys = F.map_from_entries(F.transform(names, lambda r: F.struct(r, F.array_max(of(r)))))
    pair = F.explode(F.from_json(F.lit(asked), "array<struct<run_a:string,run_b:string>>")).alias("pair")
    rows = found.select("id", keys.alias("_keys")).select("id", "_keys", pair).select("id", "_keys", "pair.*")
    equal = F.try_element_at("_keys", F.col("run_a")) == F.try_element_at("_keys", F.col("run_b"))
    return rows.select(
        "id",
        "run_a",
        "run_b",
        F.map_contains_key("_keys", F.col("run_a")).alias("in_a"),
        F.map_contains_key("_keys", F.col("run_b")).alias("in_b"),
        F.coalesce(equal, F.lit(False)).alias("same"),
    )


def pairwise_runs(predictions: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """``(run_a, run_b, id, same)`` for the asked pairs of runs, on ids both runs have."""
    return _compared(predictions, pairs).where("in_a AND in_b").select("run_a", "run_b", "id", "same")


def confusion(joined: DataFrame, predicted: str, reference: str, by: str = "run") -> DataFrame:
    """Rows per run, reference class and predicted class."""
    return joined.groupBy(by, F.col(reference).alias("ref"), F.col(predicted).alias("pred")).agg(
        F.count(F.lit(1)).alias("n")
    )


def class_counts(
    joined: DataFrame, predicted: str, reference: str, *, by: str = "run", labels: list[str] | None = None
) -> DataFrame:
    """Hits, predictions and support per run and class.

    Classes are those seen on either side, or exactly ``labels`` if given. A missing class is none: a row without a
    predicted one counts for its reference class as not found. All rows collapse to the confusion counts first, so what
    follows works on classes squared.
    """
    zero = F.lit(0).cast("long")
    hit = F.when(F.col("ref") == F.col("pred"), F.col("n")).otherwise(zero)

    def side(label, hits, predictions, support):
        return F.struct(
            label.alias("label"), hits.alias("hits"), predictions.alias("predicted"), support.alias("support")
        )

    sides = [side(F.col("ref"), hit, zero, F.col("n")), side(F.col("pred"), zero, F.col("n"), zero)]
    sides += [side(F.lit(x), zero, zero, zero) for x in labels or []]
    counts = (
        confusion(joined, predicted, reference, by)
        .select(by, F.inline(F.array(*sides)))
        .where(F.col("label").isNotNull())
        .groupBy(by, "label")
        .agg(*[F.sum(c).alias(c) for c in ("hits", "predicted", "support")])
    )
    return counts if labels is None else counts.where(F.col("label").isin(labels))


def classification_report(
    joined: DataFrame, predicted: str, reference: str, *, by: str = "run", labels: list[str] | None = None
) -> DataFrame:
    """Precision, recall, F1 and support per run and class, with zero where undefined."""

    def ratio(top, bottom):
        return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))

    return class_counts(joined, predicted, reference, by=by, labels=labels).select(
        by,
        "label",
        ratio(F.col("hits"), F.col("predicted")).alias("precision"),
        ratio(F.col("hits"), F.col("support")).alias("recall"),
        ratio(2 * F.col("hits"), F.col("predicted") + F.col("support")).alias("f1"),
        "support",
    )


def report_averages(report: DataFrame, by: str = "run") -> DataFrame:
    """The macro and support-weighted averages of a classification report."""
    support = F.sum("support")
    rows = []
    for name, average in (
        ("macro avg", lambda m: F.avg(m)),
        ("weighted avg", lambda m: F.coalesce(F.try_divide(F.sum(F.col(m) * F.col("support")), support), F.lit(0.0))),
    ):
        rows.append(
            F.struct(
                F.lit(name).alias("average"),
                average("precision").alias("precision"),
                average("recall").alias("recall"),
                average("f1").alias("f1"),
                support.alias("support"),
            )
        )
    return report.groupBy(by).agg(F.array(*rows).alias("rows")).select(by, F.inline("rows"))


def accuracy_macro_f1(joined: DataFrame, predicted: str, reference: str, by: str = "run") -> DataFrame:
    """Accuracy and macro F1 per run, as shares and in percent, off the same class counts."""
    f1 = 2 * F.col("hits") / (F.col("predicted") + F.col("support"))
    return (
        class_counts(joined, predicted, reference, by=by)
        .groupBy(by)
        .agg(F.try_divide(F.sum("hits"), F.sum("support")).alias("accuracy"), F.avg(f1).alias("macro_f1"))
        .withColumn("accuracy_pct", F.col("accuracy") * 100)
        .withColumn("macro_f1_pct", F.col("macro_f1") * 100)
    )
