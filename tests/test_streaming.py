"""A run that writes predictions as question files arrive."""

import json
import random

import pytest
from pyspark.sql import functions as F

from gradeloom.functions.letters import parse_labels
from gradeloom.operators.generate import one_by_one
from gradeloom.operators.scoring import join_predictions, score_runs
from gradeloom.plans.fixtures import stub_generator
from gradeloom.sources.predictions import parse_lenient, read_lines
from gradeloom.streaming import leaderboard as Board
from gradeloom.streaming.predictions import stream_predictions


def put(folder, name, keys):
    lines = [
        json.dumps({"id": k, "question": f"{k} ?", "answers": {"a": "x", "b": "y"}, "correct_answers": ["a"]})
        for k in keys
    ]
    (folder / name).write_text("\n".join(lines) + "\n")


def test_stream_resumes_with_new_files(spark, tmp_path):
    source, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    source.mkdir()

    def go():
        stream_predictions(
            spark, str(source), out, state, one_by_one(stub_generator), batch_size=2, files_per_batch=1
        ).awaitTermination()
        return {r["id"]: r["answer"] for r in parse_lenient(read_lines(spark, out)).collect()}

    put(source, "1.json", ["q1", "q2", "q3"])
    put(source, "2.json", ["q4"])
    first = go()
    assert set(first) == {"q1", "q2", "q3", "q4"}
    put(source, "3.json", ["q5"])
    second = go()
    assert set(second) == {"q1", "q2", "q3", "q4", "q5"}
    assert {k: second[k] for k in first} == first
    assert spark.read.text(out).count() == 5


def _lines(rng, n):
    keys, answers = [f"q{i}" for i in range(20)], ["a", "b", "a|c", ""]
    return "".join(f"{rng.choice(keys)};{rng.choice(answers)}\n" for _ in range(n)) + rng.choice(["", "\n", "alone\n"])


def test_last_lines_and_leaderboard_of_a_growing_folder(spark, tmp_path):
    """Three steps, each a new query on the same state; the second adds a file that sorts before all others."""
    rng = random.Random(6)
    source, out, board = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "board")
    refs = spark.createDataFrame([(f"q{i}", [rng.choice("abc")]) for i in range(18)], "id string, gold array<string>")
    for names in (["x_prompt0.txt/5", "y_prompt0.txt/3"], ["x_prompt0.txt/1"], ["x_prompt0.txt/10", "y_prompt0.txt/4"]):
        for name in names:
            path = source / name
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(_lines(rng, 40))
        Board.stream_last_lines(spark, str(source), out, str(tmp_path / "s1"), files_per_batch=1).awaitTermination()
        Board.stream_leaderboard(spark, str(source), refs, board, str(tmp_path / "s2"), files_per_batch=1).awaitTermination()
        wanted = {}
        for path in sorted(source.glob("*/*"), key=lambda p: (len(str(p)), str(p))):
            for line in path.read_text().split("\n"):
                if line:
                    key, *answer = line.split(";")
                    wanted[path.parent.name[0], key] = answer[0] if answer else None
        got = {(r["run"], r["id"]): r["answer"] for r in Board.last_lines(spark, out).collect()}
        assert got == wanted
        rows = [(run, i, a) for (run, i), a in wanted.items()]
        whole = spark.createDataFrame(rows, "run string, id string, answer string")
        whole = join_predictions(whole.withColumn("labels", parse_labels(F.col("answer"))), refs)
        recount = {r["run"]: r for r in score_runs(whole).collect()}
        table = {r["run"]: r for r in Board.leaderboard(spark, board).collect()}
        assert set(table) == set(recount)
        for run, r in recount.items():
            assert table[run]["n"] == r["n"]
            assert table[run]["exact_match"] == pytest.approx(r["exact_match"])
            assert table[run]["hamming_score"] == pytest.approx(r["hamming_score"])
    before = sorted(map(str, Board.leaderboard(spark, board).collect()))
    last = sorted((tmp_path / "s2" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))[-1]
    (tmp_path / "s2" / "commits" / f".{last.name}.crc").unlink(missing_ok=True)
    last.unlink()
    Board.stream_leaderboard(spark, str(source), refs, board, str(tmp_path / "s2"), files_per_batch=1).awaitTermination()
    assert sorted(map(str, Board.leaderboard(spark, board).collect())) == before


def test_questions_share_a_state(spark, tmp_path, monkeypatch):
    """3,000 questions in at most 1,024 states, some merged; each change names the answer that the one before it gave."""
    monkeypatch.setattr(Board, "PARTS", 2)
    rng = random.Random(8)
    source, out = tmp_path / "in" / "run=x", str(tmp_path / "out")
    source.mkdir(parents=True)
    keys, wanted, steps = [f"q{i}" for i in range(3000)], {}, {}
    for number in range(5):
        lines = [(k, rng.choice(["a", "b", "a|c", "", None])) for k in rng.sample(keys, 3000 if number == 0 else 1500)]
        lines += [(k, "d") for k in rng.sample(keys, 20)]
        (source / str(number)).write_text("".join(k + (";" + a if a is not None else "") + "\n" for k, a in lines))
        for k in dict(lines):
            steps[k] = steps.get(k, 0) + 1
        wanted |= dict(lines)
        query = Board.stream_last_lines(spark, str(tmp_path / "in"), out, str(tmp_path / "s"), files_per_batch=1)
        query.awaitTermination()
        states = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
        assert states and max(states) <= 1024
    assert {r["id"]: r["answer"] for r in Board.last_lines(spark, out).collect()} == wanted
    found = {}
    for r in spark.read.parquet(out).collect():
        found.setdefault(r["id"], []).append(r)
    assert {k: len(rows) for k, rows in found.items()} == steps
    for rows in found.values():
        rows.sort(key=lambda r: (len(r["file"]), r["file"], r["row"]))
        assert [r["replaced"] for r in rows] == [False, *[True] * (len(rows) - 1)]
        assert [r["earlier"] for r in rows] == [None, *[r["answer"] for r in rows[:-1]]]


def test_leaderboard_asks_for_the_state_of_groups(spark, tmp_path):
    """2,000 questions share at most 1,024 states; sums are those of the last lines, with half of all answers replaced."""
    source, board = tmp_path / "in" / "run=x", str(tmp_path / "board")
    source.mkdir(parents=True)
    (source / "1").write_text("".join(f"q{i};{'ab'[i % 2]}\n" for i in range(2000)))
    (source / "2").write_text("".join(f"q{i};a\n" for i in range(1000)))
    refs = spark.range(2000).selectExpr("concat('q', id) id", "array('a') gold")
    query = Board.stream_leaderboard(spark, str(tmp_path / "in"), refs, board, str(tmp_path / "s"), files_per_batch=1)
    query.awaitTermination()
    states = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert states and max(states) <= 1024
    assert [r.asDict() for r in Board.leaderboard(spark, board).collect()] == [
        {"run": "x", "n": 2000, "exact_match": 0.75, "hamming_score": 0.75}
    ]
