"""Readers and writers."""

import json
import re
import time

import pytest
from pyspark.sql import functions as F

from gradeloom.operators.order import numbered
from gradeloom.operators.scoring import check_ids
from gradeloom.sources import corpus as C, predictions as I
from gradeloom.sources.predictions import RUN_IN_PATH

QUESTIONS = [
    {"id": "q1", "question": "Où ?", "answers": {"b": "B", "a": "A"}, "correct_answers": ["a", "b"], "type": 1},
    {"id": "q2", "question": "Qui ?", "answers": {"a": "x"}, "correct_answers": ["a"], "type": 2},
]


@pytest.mark.parametrize("layout", ["lines", "array"])
def test_corpus_layouts(spark, tmp_path, layout):
    path = tmp_path / "corpus.json"
    text = json.dumps(QUESTIONS, indent=4) if layout == "array" else "\n".join(map(json.dumps, QUESTIONS))
    path.write_text(text)
    rows = C.read_corpus(spark, str(path), layout=layout).withColumn("keys", F.map_keys("answers")).orderBy("id").collect()
    assert [r["id"] for r in rows] == ["q1", "q2"]
    assert rows[0]["keys"] == ["b", "a"]
    assert rows[0]["correct_answers"] == ["a", "b"]
    more = C.read_corpus(spark, str(path), layout=layout, more="type int").orderBy("id").collect()
    assert [r["type"] for r in more] == [1, 2]


def test_run_settings(spark, tmp_path):
    for name, settings in (("r1", {"batch_size": 24, "is_int8": True, "prompt": "é %s"}), ("r2", {"epochs": 1})):
        (tmp_path / name).mkdir()
        (tmp_path / name / "training_config.json").write_text(json.dumps(settings, indent=4))
    rows = {r["run"]: r["params"] for r in C.read_run_settings(spark, f"{tmp_path}/*/*.json").collect()}
    assert rows == {"r1": {"batch_size": "24", "is_int8": "true", "prompt": "é %s"}, "r2": {"epochs": "1"}}


def write(tmp_path, name, text):
    path = tmp_path / name
    path.write_bytes(text.encode())
    return str(path)


def test_lenient_lines(spark, tmp_path):
    path = write(tmp_path, "m_prompt0.txt", "q1;a|b\n\n q2; c ;extra;more\nq3\nq4;\n")
    rows = I.read_predictions(spark, path).collect()
    assert {(r["run"], r["id"], r["answer"]) for r in rows} == {
        ("m", "q1", "a|b"),
        ("m", " q2", " c "),
        ("m", "q3", None),
        ("m", "q4", ""),
    }


def test_strict_lines(spark, tmp_path):
    path = write(tmp_path, "m_prompt1.txt", "  q1;a|b \nq2;a;b\n\nq3\n")
    good, bad = I.parse_strict(I.read_lines(spark, path))
    assert [(r["id"], r["answer"]) for r in good.collect()] == [("q1", "a|b")]
    assert sorted(r["value"] for r in bad.collect()) == ["", "q2;a;b", "q3"]
    with pytest.raises(Exception, match="not an id;answer line"):
        I.read_predictions(spark, path, parsing="strict").collect()


def test_run_names(spark, tmp_path):
    for name in ("en_x-3b_prompt0.txt", "llama2-7b_prompt12.txt", "test_y_prompt0.txt.task2"):
        write(tmp_path, name, "q1;a\n")
    runs = {r["run"] for r in I.read_predictions(spark, str(tmp_path)).collect()}
    assert runs == {"en_x-3b", "llama2-7b", "test_y"}


def test_last_line_wins_across_splits_of_a_file(spark, tmp_path):
    """A repeated id that holds a third of a file read in many pieces."""
    lines = [f"hot;{i}" if i % 3 == 0 else f"q{i % 50};{i}" for i in range(30000)]
    path = write(tmp_path, "m_prompt0.txt", "\n".join(lines) + "\n")
    limit, before = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set(limit, "16384")
    try:
        assert I.read_lines(spark, path).rdd.getNumPartitions() > 5
        got = {r["id"]: r["answer"] for r in I.read_predictions(spark, path, duplicates="last").collect()}
    finally:
        spark.conf.set(limit, before)
    assert got == dict(line.split(";") for line in lines)


def test_repeated_ids_fail_by_default(spark, tmp_path):
    path = write(tmp_path, "m_prompt0.txt", "q1;a\nq1;b\n")
    with pytest.raises(Exception, match="repeated key"):
        I.read_predictions(spark, path).collect()
    assert I.read_predictions(spark, path, duplicates="keep").count() == 2


def test_written_lines(spark, tmp_path):
    df = spark.createDataFrame([("r", "q1", ["C", "A"]), ("r", "q2", ["b"])], "run string, id string, labels array<string>")
    out = str(tmp_path / "out")
    I.write_predictions(df, out, lower=True)
    text = "".join(p.read_text() for p in sorted((tmp_path / "out" / "run=r").glob("part-*")))
    assert sorted(text.splitlines()) == ["q1;a|c", "q2;b"] and text.endswith("\n")
    assert {(r["run"], r["id"], r["answer"]) for r in I.read_predictions(spark, out).collect()} == {
        ("r", "q1", "a|c"),
        ("r", "q2", "b"),
    }


def test_files_per_run_bounds_the_files_of_a_hot_run(spark, tmp_path):
    df = spark.range(0, 3000, 1, 16).select(
        F.when(F.col("id") % 3 == 0, "x").otherwise("hot").alias("run"),
        F.col("id").cast("string").alias("id"),
        F.array(F.lit("a")).alias("labels"),
    )
    out = str(tmp_path / "out")
    I.write_predictions(df, out, files_per_run=2)
    files = [len(list((tmp_path / "out" / f"run={r}").glob("part-*"))) for r in ("x", "hot")]
    assert max(files) <= 2
    assert spark.read.text(out).groupBy("run").count().count() == 2 and spark.read.text(out).count() == 3000


def test_check_ids(spark):
    refs = spark.createDataFrame([(f"q{i}",) for i in range(4)], "id string")
    rows = [("all", f"q{i}") for i in range(4)] + [("short", "q0")] + [("other", x) for x in ("q0", "q1", "q2", "zz")]
    got = {r["run"]: r for r in check_ids(spark.createDataFrame(rows, "run string, id string"), refs).collect()}
    assert (got["all"]["complete"], got["all"]["same_ids"]) == (True, True)
    assert (got["short"]["missing"], got["short"]["unexpected"], got["short"]["complete"]) == (3, 0, False)
    assert (got["other"]["missing"], got["other"]["unexpected"], got["other"]["complete"]) == (1, 1, False)


def test_check_ids_joins_only_runs_that_differ(spark, monkeypatch):
    """Equal runs, with repeated lines; forged ones of the same size; null ids; more and fewer ids; no references."""
    ids = [f"q{i}" for i in range(50)]
    runs = {
        "same": ids, "again": ids + ids[:20], "forged": [*ids[:-1], "zz"], "swapped": [f"p{i}" for i in range(50)],
        "null": [*ids[:-1], None], "more": [*ids, "zz"], "fewer": ids[:10],
    }
    rows = [(run, i) for run, found in runs.items() for i in found]
    df, refs = spark.createDataFrame(rows, "run string, id string"), spark.createDataFrame([(i,) for i in ids + ids], "id string")
    got = {r["run"]: r.asDict() for r in check_ids(df, refs).collect()}
    for run, found in runs.items():
        missing, extra = len(set(ids) - set(found)), len(set(found) - set(ids))
        assert got.pop(run) == {
            "run": run, "n_predicted": len(set(found)), "n_references": 50, "missing": missing, "unexpected": extra,
            "complete": missing == 0 and len(set(found)) == 50, "same_ids": missing == extra == 0,
        }
    assert got == {}
    equal = check_ids(df.where("run IN ('same', 'again')"), refs)
    assert "Join" not in equal._jdf.queryExecution().optimizedPlan().toString()
    assert equal.count() == 2
    nothing = {r["run"]: r["unexpected"] for r in check_ids(df, refs.where("false")).collect()}
    assert nothing["fewer"] == 10 and check_ids(df.where("false"), refs).collect() == []


def test_runs_written_in_order(spark, tmp_path):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("r"), (F.col("id") % 7).cast("string"))).alias("run"),
        F.col("id").alias("position"), F.concat(F.lit("line "), F.col("id").cast("string")).alias("value"),
    ).repartition(5)
    wanted = {}
    for r in sorted(df.collect(), key=lambda r: r["position"]):
        wanted.setdefault(r["run"], []).append(r["value"])
    for name in ("one", "again"):
        I.write_runs_in_order(df, str(tmp_path / name))
        for run, lines in wanted.items():
            files = sorted((tmp_path / name / f"run={run}").glob("part-*"))
            assert "".join(f.read_text() for f in files).split() == " ".join(lines).split()
    bad = df.withColumn("value", F.when(F.col("position") == 77, F.raise_error(F.lit("stop"))).otherwise(F.col("value")))
    with pytest.raises(Exception, match="stop"):
        I.write_runs_in_order(bad, str(tmp_path / "bad"))
    assert not list((tmp_path / "bad").rglob("part-*")) or not list((tmp_path / "bad").glob("run=*"))


def test_places_in_file_order(spark, tmp_path):
    """Several files a run, cut into many splits, lines that repeat."""
    for run, n in (("one", 900), ("two", 3)):
        for part in range(2):
            lines = "".join(f"{part}-{i};a\n" for i in range(n)) + "same;a\n" * 5
            folder = tmp_path / f"run={run}"
            folder.mkdir(exist_ok=True)
            (folder / f"part-{part}").write_text(lines)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900b")
    try:
        rows = I.in_file_order(I.read_lines(spark, str(tmp_path)), ["run"]).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for run, n in (("one", 900), ("two", 3)):
        found = [r["value"] for r in sorted((r for r in rows if r["run"] == run), key=lambda r: r["position"])]
        assert found == [x for part in range(2) for x in [f"{part}-{i};a" for i in range(n)] + ["same;a"] * 5]


def test_places_of_whole_splits_need_no_sort(spark, tmp_path, monkeypatch):
    """Rows left out, repeated or in other groups than their split still get places by their order."""
    asked = []
    monkeypatch.setattr(I, "numbered", lambda *given, **named: asked.append(1) or numbered(*given, **named))
    for part in range(3):
        (tmp_path / f"part-{part}").write_text("".join(f"{part}-{i};{'ab'[i % 2]}\n" for i in range(200)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    try:
        lines = I.read_lines(spark, str(tmp_path))
        wanted = [f"{part}-{i}" for part in range(3) for i in range(200)]
        for rows, by, sort, left in [
            (lines, ["run"], False, wanted),
            (lines, [], False, wanted),
            (lines.where("NOT value LIKE '%-7%'"), ["run"], True, [x for x in wanted if "-7" not in x]),
            (lines.union(lines), ["run"], True, [x for x in wanted for _ in range(2)]),
            (lines.withColumn("n", F.explode(F.array(F.lit(0), F.lit(0)))), ["run"], True, [x for x in wanted for _ in range(2)]),
        ]:
            asked.clear()
            found = I.in_file_order(rows, by).collect()
            assert [r["value"][:-2] for r in sorted(found, key=lambda r: r["position"])] == left
            assert sorted(r["position"] for r in found) == list(range(len(left))) and bool(asked) == sort
        groups = I.in_file_order(lines.withColumn("g", F.substr("value", F.lit(-1))), ["g"]).collect()
        for g in "ab":
            some = sorted((r for r in groups if r["g"] == g), key=lambda r: r["position"])
            assert [r["position"] for r in some] == list(range(300))
            assert [r["value"][:-2] for r in some] == [x for i, x in enumerate(wanted) if "ab"[i % 2] == g]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_places_are_found_without_paths(spark, tmp_path, monkeypatch):
    """A row meets the counts of its split by a number (F6); splits whose numbers are equal are told apart."""
    for part in range(5):
        (tmp_path / f"part-{part}").write_text("".join(f"{part}-{i}\n" for i in range(100)))
    wanted = [f"{part}-{i}" for part in range(5) for i in range(100)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    spark.conf.set("spark.sql.files.openCostInBytes", "300b")
    try:
        for equal in (False, True):
            if equal:
                monkeypatch.setattr(I.F, "xxhash64", lambda *c: F.lit(7).cast("long"))
            rows = I.in_file_order(I.read_lines(spark, str(tmp_path)), ["run"]).select("position", "value")
            assert "seq:struct" not in rows._jdf.queryExecution().executedPlan().toString()
            found = sorted(rows.collect())
            assert [tuple(r) for r in found] == list(enumerate(wanted))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_splits(spark):
    a, b = spark.range(2), spark.range(3)
    rows = C.with_splits({"train": a, "validation": b}).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in rows} == {"train": 2, "validation": 3}


def test_meld_results_round_trip(spark, tmp_path):
    row = {
        **QUESTIONS[0],
        "saved_answers": QUESTIONS[0]["answers"],
        "meld": {"prompt": "p", "reference": "r", "generated": "g", "distance": 0.5},
    }
    path = write(tmp_path, "meld.json", json.dumps([row]))
    read = C.read_meld_results(spark, path, layout="array")
    assert read.select("meld.*").first().asDict() == row["meld"]
    C.write_rows(read, str(tmp_path / "again"))
    assert C.read_meld_results(spark, str(tmp_path / "again")).select(F.to_json("saved_answers")).first()[0] == '{"b":"B","a":"A"}'


def test_run_of_a_path_takes_its_length():
    """The name of a run begins behind a slash, so the pattern is not tried at every place of a long name."""
    earlier = RUN_IN_PATH.replace("(?<![^/])", "")
    assert earlier != RUN_IN_PATH
    for path in ("a_prompt0.txt", "file:/x/b c_prompt1.txt.task2", "/x/d_prompt_prompt12.txt/part-0.txt", "/x/_prompt1.txt", "/y/e.txt"):
        found, before = re.search(RUN_IN_PATH, path), re.search(earlier, path)
        assert (found and found.group(1)) == (before and before.group(1))
    start = time.monotonic()
    assert re.search(RUN_IN_PATH, "file:/" + "x" * 100_000 + "/part-0.txt") is None
    assert time.monotonic() - start < 2
