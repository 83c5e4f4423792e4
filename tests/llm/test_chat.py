from pyspark.sql import functions as F

from inkgraph.llm.chat import format_preferences, swapped_answers


def test_prefix_completions_and_spans(spark):
    turns = [
        (2, 0, "user", "hi", "x"), (2, 1, "assistant", "one", "x"), (2, 2, "user", "more", "x"), (2, 3, "assistant", "two", "x"),
        (3, 1, "assistant", "other", "x"), (3, 0, "user", "yo", "x"),
        (4, 0, "user", "alone", "x"), (6, 0, "assistant", "same", "x"), (7, 0, "assistant", "same", "x"),
        (8, None, None, None, "x"), (9, 0, "assistant", None, "x"), (8, 1, "assistant", "é" * 10, "x"), (None, 0, "assistant", "n", "x"),
        (2, 3, "assistant", "two", "x"),
    ]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, chosen string")
    got = {r.conv_id: r for r in format_preferences(swapped_answers(df), ["conv_id"]).collect()}
    assert sorted(got) == [2, 3, 6, 7, 8, 9]
    two = got[2]  # the repeated turn is a turn of its own; the last answer is swapped
    assert two.n_prompt_turns == 4 and two.prompt.count("<|end|>") == 4
    assert two.chosen == "<|assistant|>\ntwo<|end|>\n" and two.rejected == "<|assistant|>\nother<|end|>\n"
    assert [two.rejected[s.start : s.end] for s in two.rejected_spans] == ["other<|end|>\n"]
    assert got[6].chosen == "" == got[6].rejected and got[6].n_prompt_turns == 1 and got[6].chosen_spans == []
    assert got[9].rejected == "<|assistant|>\n" + "é" * 10 + "<|end|>\n"
    assert got[8].n_prompt_turns == 1


def test_general_pairs(spark):
    one = F.array(F.struct(F.lit("user").alias("role"), F.lit("q").alias("text")))
    df = spark.range(2).select("id", one.alias("a"), F.when(F.col("id") == 0, one).alias("b"), F.lit(1).alias("prompt"))
    got = {r.id: r for r in format_preferences(df, ["id"], "a", "b").collect()}
    assert got[0].n_prompt_turns == 1 and got[0].chosen == got[0].rejected == ""
    assert got[1].n_prompt_turns == 0 and got[1].prompt == "" and got[1].rejected == ""
    assert format_preferences(df.limit(0), ["id"], "a", "b").count() == 0


def test_pairs_need_one_shuffle_and_keep_long_conversations(spark):
    turns = [(k, j, "assistant" if j % 2 else "user", f"{k} {j} " + "w" * 200) for k in (-2, -1, 4) for j in range(3000)]
    pairs = swapped_answers(spark.createDataFrame(turns, "conv_id int, turn int, role string, text string"))
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    got = {r.conv_id: r for r in format_preferences(pairs, ["conv_id"]).collect()}
    assert sorted(got) == [-2, -1] and got[-1].n_prompt_turns == 2999
    assert got[-1].rejected == "<|assistant|>\n-2 2999 " + "w" * 200 + "<|end|>\n"
