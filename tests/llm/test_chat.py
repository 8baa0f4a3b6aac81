import random

from pyspark.sql import functions as F

from tidelog.llm import chat
from tidelog.llm.queries import ORACLE_SQL, QUERIES

KIND = "conv_id long, turn long, role string, text string"


def collapsed(spark, rows):
    return {r["conv_id"]: (r["n_turns"], r["rendered"]) for r in chat.collapse(spark.createDataFrame(rows, KIND)).collect()}


def test_snapshots_go(spark):
    rows = [(1, 0, "user", "a"), (2, 0, "user", "a"), (2, 1, "bot", "b"), (3, 0, "user", "a"), (3, 1, "bot", "b"), (4, 0, "user", "b"), (5, 0, "bot", "a")]
    assert collapsed(spark, rows) == {
        2: (2, "<|im_start|>user\na<|im_end|>\n<|im_start|>bot\nb<|im_end|>\n"),
        4: (1, "<|im_start|>user\nb<|im_end|>\n"),
        5: (1, "<|im_start|>bot\na<|im_end|>\n"),
    }


def test_against_brute_force(spark):
    rnd = random.Random(1)
    convs = {i: [(rnd.choice("ub"), rnd.choice(["x", "y", None])) for _ in range(rnd.randrange(1, 5))] for i in range(80)}
    rows = [(i, 10 * t + i, role, text) for i, c in convs.items() for t, (role, text) in enumerate(c)]
    rnd.shuffle(rows)
    want = {i for i, c in convs.items() if not any(len(d) > len(c) and d[: len(c)] == c or d == c and j < i for j, d in convs.items())}
    assert set(collapsed(spark, rows)) == want


def test_nulls_ties_and_repeats(spark):
    assert collapsed(spark, []) == {}
    rows = [(None, 0, "u", "a"), (1, None, None, None), (1, 0, "u", None), (2, 0, "u", "b"), (2, 0, "u", "b"), (3, 0, "u", "a")]
    got = collapsed(spark, rows)
    assert got[None] == (1, "<|im_start|>u\na<|im_end|>\n") and 3 not in got
    assert got[1] == (2, "<|im_start|>u\n<|im_end|>\n<|im_start|>unknown\n<|im_end|>\n")
    assert got[2][0] == 2
    # A null role or text isn't an empty one, and what stands in two columns isn't what stands in one.
    assert len(collapsed(spark, [(1, 0, None, "a"), (2, 0, "a", None), (3, 0, "", "a")])) == 3


def test_long_texts_and_clashing_columns(spark):
    rows = spark.createDataFrame([(1, 0, "u", "x" * 300_000), (2, 0, "u", "x" * 300_000), (2, 1, "b", "y")], KIND)
    rows = rows.withColumns({c: F.lit(1) for c in ("place", "h1", "h2", "n", "n_turns", "rendered", "end", "turns")})
    assert [r["conv_id"] for r in chat.collapse(rows).collect()] == [2]


def test_no_python_in_the_plan(spark):
    plan = chat.collapse(spark.createDataFrame([], KIND))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_sql(against_sql):
    against_sql(QUERIES["op7_snapshot_collapse"], ORACLE_SQL["op7_snapshot_collapse"])


def test_most_conversations_are_copies(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(300) for t in range(3 if c % 3 else 4 if c == 0 else 2)]
    got = chat.collapse(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()
    assert [(r["conv_id"], r["n_turns"]) for r in got] == [(0, 4)]
    got = chat.collapse(spark.createDataFrame(rows[4:], "conv_id long, turn int, role string, text string")).collect()
    assert [(r["conv_id"], r["n_turns"]) for r in got] == [(1, 3)]
