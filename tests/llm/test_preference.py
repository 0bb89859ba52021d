from helpers import read, same_as_sql
from pyspark.sql import functions as F
from signals.llm import preference

TURNS = "conv_id long, turn long, role string, text string"


def frame(spark, convs):
    return spark.createDataFrame([(c, k, role, text) for c, turns in convs for k, (role, text) in enumerate(turns)], TURNS)


def test_equals_sql(spark):
    assert same_as_sql(spark, "op9_preference_format")


def test_prefix_completions_and_masks(spark):
    same = [("system", "be kind"), ("user", "héllo 🙂")]
    rows = frame(spark, [(0, same + [("assistant", "good"), ("user", "thanks")]), (1, same + [("assistant", "bad")]),
                         (2, same), (3, same), (4, [("user", "alone")]), (7, [("assistant", None)])])
    out = {r["pair_id"]: r for r in preference.query(spark, rows).collect()}
    a = out[0]
    assert a["prefix_turns"] == 2 and a["complete"]
    assert a["prompt"] == "<|system|>\nbe kind<|end|>\n<|user|>\nhéllo 🙂<|end|>\n"
    assert a["chosen"] == "<|assistant|>\ngood<|end|>\n<|user|>\nthanks<|end|>\n"
    assert a["rejected"] == "<|assistant|>\nbad<|end|>\n"
    start, stop = map(int, a["chosen_mask"].split("-"))
    assert a["chosen"][start:stop] == "good<|end|>\n"
    assert out[1]["prefix_turns"] == 2 and out[1]["chosen"] == out[1]["rejected"] == out[1]["chosen_mask"] == ""
    assert not out[2]["complete"] and out[2]["prompt"] == "" and out[2]["rejected"] is None
    assert out[2]["chosen"] == "<|user|>\nalone<|end|>\n"
    assert out[3]["chosen"] is None and out[3]["rejected"] == "<|assistant|>\n<|end|>\n" and out[3]["rejected_mask"] == "14-22"


def test_awkward_rows(spark):
    rows = spark.createDataFrame([(None, 0, "user", "x"), (0, None, None, None), (0, 1, "user", "b"), (0, 1, "user", "a"),
                                  (0, 1, "user", "a"), (1, None, None, None), (1, 1, "user", "a")], TURNS)
    out = {r["pair_id"]: r for r in preference.query(spark, rows.withColumn("prompt", F.lit("clash"))).collect()}
    assert out[0]["prefix_turns"] == 2  # the null turn equals the null turn, then "a" equals "a"
    assert out[0]["chosen"].count("<|user|>") == 2 and out[0]["rejected"] == ""
    assert not out[None]["complete"]
    assert preference.query(spark, rows.where("turn > 5")).count() == 0
    long = frame(spark, [(0, [("user", "y" * 100_000)] * 300), (1, [("user", "y" * 100_000)] * 299)])
    r = preference.query(spark, long).first()
    assert r["prefix_turns"] == 299 and r["rejected"] == "" and len(r["chosen"]) > 100_000


def test_no_python_in_the_plan(spark):
    plan = preference.query(spark, read(spark, "conversations"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_replaced_turns_leave_a_prefix(spark):
    assert same_as_sql(spark, "op9_preference_replaced")
    turns = read(spark, "conversations")
    rows = preference.query_replaced(spark, turns).collect()
    assert len(rows) == turns.select("conv_id").distinct().count()
    first = {r["conv_id"]: r["role"] for r in turns.where("turn = 0").collect()}
    pairs = [r for r in rows if r["complete"] and first.get(r["pair_id"]) != "assistant"]
    assert len(pairs) > 0.5 * len(rows) and all(r["prefix_turns"] > 0 and r["prompt"] for r in pairs)
    small = frame(spark, [(0, [("user", "q"), ("assistant", "a"), ("user", "x")]), (1, [("assistant", "b")]), (2, [("assistant", "c")]),
                          (3, [("user", "d")])])
    out = {r["pair_id"]: r for r in preference.query_replaced(spark, small).collect()}
    assert out[0]["prompt"] == "<|user|>\nq<|end|>\n" and out[0]["rejected_id"] == 1
    assert out[0]["rejected"] == "<|assistant|>\nb<|end|>\n<|user|>\nx<|end|>\n"
    assert not out[2]["complete"] and not out[3]["complete"] and out[3]["rejected"] is None
