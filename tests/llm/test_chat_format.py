from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tamarisk.llm.chat_format import chat_digest, format_chat, loss_text, read_back

PIECES = st.lists(st.sampled_from(["\\", "<", "#", "###", "</turn>\n", "</part>", ": ", "\\b", "é", "a", "\n", ""]), max_size=6).map("".join)
TURN = st.tuples(st.sampled_from(["user", "assistant", "a: b", "", "</turn>"]), PIECES)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(TURN, min_size=1, max_size=5), min_size=1, max_size=8))
def test_round_trip(spark, talks):
    rows = [(c, k, role, text) for c, turns in enumerate(talks) for k, (role, text) in enumerate(turns)]
    made = format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    back = made.select("conv_id", read_back(F.col("formatted")).alias("t"), loss_text(F.col("formatted"), F.col("loss_mask")).alias("loss"), F.length("formatted").alias("n"), "loss_mask")
    for r in back.collect():
        assert [(x.role, x.text) for x in r.t] == talks[r.conv_id]
        assert r.loss == "".join(t for role, t in talks[r.conv_id] if role == "assistant")
        assert sum(m.chars for m in r.loss_mask) == r.n


def test_merging_and_edges(spark):
    rows = [(1, 2, "user", "b", 0), (1, 1, "user", "a", 0), (1, None, "assistant", None, 0), (1, 1, "user", "a", 0), (None, 1, None, "x", 0)]
    made = format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, runs int"))
    got = {r.conv_id: r.formatted for r in made.collect()}
    assert got == {1: "### user: a</part>a</part>b</turn>\n### assistant: </turn>\n", None: "### : x</turn>\n"}
    assert {r.conv_id: r.n_turns for r in chat_digest(made).collect()} == {1: 4, None: 1}
    assert format_chat(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_no_python_in_the_plan(spark, sf):
    from tamarisk.llm.queries import op9_chat_format

    plan = op9_chat_format(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_runs_across_blocks_and_groups(spark):
    """Texts longer than a block, of characters outside the basic plane too, and more runs than a group has."""
    long = [("user", "ü𝒳" * 3000), ("assistant", "𝒳é#" * 5000), ("assistant", ""), ("user", "x"), ("assistant", "a" * 4096), ("assistant", "<b")]
    many = [("assistant" if k % 2 else "user", f"turn {k} says #{k}") for k in range(3000)]
    rows = [(c, k, role, text) for c, turns in enumerate((long, many)) for k, (role, text) in enumerate(turns)]
    made = format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r.loss for r in made.select("conv_id", loss_text(F.col("formatted"), F.col("loss_mask")).alias("loss")).collect()}
    for c, turns in enumerate((long, many)):
        assert got[c] == "".join(t for role, t in turns if role == "assistant")


def test_long_conversation(spark):
    """Sixteen thousand turns take about as long, each, as a thousand."""
    import time

    def seconds(n):
        turns = spark.range(n).selectExpr("1 AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "repeat('abcdefgh', 20) AS text")
        began = time.perf_counter()
        assert chat_digest(format_chat(turns)).first().loss_chars == n // 2 * 160
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(16_000) < 16 * seconds(1000) + 5
