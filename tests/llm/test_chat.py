import random
import re

from pyspark.sql import functions as F

from landstrata.llm import chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string, turns string, blocks int"


def run(spark, rows):
    out = chat.format_conversations(spark.createDataFrame([(*r, None, 1) for r in rows], SCHEMA))
    return {r["conv_id"]: r for r in out.select(
        "conv_id", "formatted", "loss_spans", chat.read_turns(F.col("formatted")).alias("turns"),
        chat.read_loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}


def expected(rows):
    convs = {}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    return {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in convs.items()}


def test_round_trip_with_hostile_texts(spark):
    rng = random.Random(3)
    bits = [*chat.CONTROLS, "\\", "\\\\", "<", "[", "/", "s>", "ok", " ", "\n", "é😀", "$1", ""]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "<s>", None, "a[/ROLE]b"]),
             rng.choice([None, "".join(rng.choices(bits, k=rng.randint(0, 12)))])) for c in range(40) for t in range(rng.randint(1, 9))]
    rows += [(None, 0, "user", "no id"), (None, None, "assistant", "no turn"), (100, 1, "user", "b"), (100, 1, "user", "a"), (100, 1, "user", "a"),
             (101, 0, "assistant", "y" * 200_000)]
    got, want = run(spark, rows), expected(rows)
    assert got.keys() == want.keys()
    for c, turns in want.items():
        assert [tuple(t) for t in got[c]["turns"]] == turns
        assert got[c]["loss"] == "".join(x for r, x in turns if r == "assistant")
        assert len(got[c]["loss_spans"]) == sum(r == "assistant" for r, _ in turns)
        for mark in chat.CONTROLS[5:]:
            assert mark not in got[c]["formatted"]


def test_adjacent_turns_of_a_role_share_a_block(spark):
    got = run(spark, [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c"), (1, 3, "user", "d")])[1]
    assert got["formatted"] == "<s>[ROLE]user[/ROLE]a[TURN]b</s><s>[ROLE]assistant[/ROLE]c</s><s>[ROLE]user[/ROLE]d</s>"


def test_long_conversation(spark):
    rows = [(1, i, "user" if i % 3 else "assistant", str(i)) for i in range(1500)]
    assert [tuple(t) for t in run(spark, rows)[1]["turns"]] == [(r, x) for _, _, r, x in rows]


def test_empty_table_and_plan(spark):
    assert run(spark, []) == {}
    out = chat.format_conversations(spark.createDataFrame([(1, 0, "user", "x", None, 1)], SCHEMA))
    assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().executedPlan().toString())
