"""The worked example from turns to answers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from keepsake.operators import answering, consolidation, evaluation, extraction, memory, reading
from keepsake.sources import conversations

T0 = dt.datetime(2023, 2, 4, 10)


def test_moves_are_answered_in_time(spark):
    said = [(0, "I moved to Boston last week for the new job."), (10, "I have been reading a novel about the sea."), (30, "My garden needs water in the summer months."), (45, "We cooked pasta with my friends on Sunday."), (104, "I moved to Seattle this month and I like it.")]
    turns = spark.createDataFrame([("m", f"s{d}", T0 + dt.timedelta(days=d), 0, "user", t) for d, t in said], "memory string, session_id string, ts timestamp_ntz, turn int, role string, text string")
    kept = memory.keep(memory.entries(turns), 10_000).cache()
    now = T0 + dt.timedelta(days=120)
    asked = [("now", "Which location do I live in now?"), ("march", "Which location did I live in in March?"), ("all", "How many times did my location change?"), ("before", "Which location did I live in previously?")]
    questions = spark.createDataFrame([(i, "m", q, now) for i, q in asked], "question_id string, memory string, question string, now timestamp_ntz")
    packed = memory.ask(kept, questions).cache()
    got = {i: {r.value for r in packed.where((F.col("question_id") == i) & (F.col("attribute") == "location")).collect()} for i, _ in asked}
    assert got == {"now": {"Seattle"}, "march": {"Boston"}, "all": {"Boston", "Seattle"}, "before": {"Boston", "Seattle"}}
    for r in packed.groupBy("question_id").agg(F.sum("cost").alias("n")).collect():
        assert r.n <= 2000
    around = memory.verbatim(packed, turns, 60).collect()
    assert around and all(sum(len(r.text) / 4 for r in around if r.question_id == i) <= 60 for i, _ in asked)
    assert {r.answer for r in memory.answers(packed.where("false"), questions, 0.5).collect()} == {answering.ABSTAIN}
    answers = memory.answers(packed, questions)
    assert {r.question_id for r in answers.collect()} == {i for i, _ in asked}
    checked = answering.cited(answers, packed)
    assert checked.where(F.size("invalid") > 0).count() == 0
    lines = packed.select("question_id", "ts", "session_id", "turn", answering.format_entry().alias("line"))
    assert "valid from 2023-02-04 to 2023-05-19; fact/stated; by user) user location: Boston" in {r.question_id: r.context for r in answering.contexts(lines).collect()}["march"]


def test_models_and_judges(spark):
    rows = spark.createDataFrame([("multi", False, "q", "g", "a"), ("multi", True, "q", "g", "a"), ("temporal-reasoning", False, "q", "g", "a")], "question_type string, is_abstention boolean, question string, gold string, answer string")
    prompts = rows.select(answering.judge_prompt().alias("prompt"))
    assert len({r.prompt for r in prompts.collect()}) == 3
    replies = answering.by_model(prompts, lambda texts: ["Yes." if "off by one" in texts[0] else "no"])
    assert sorted(r.reply for r in replies.collect()) == ["Yes.", "no", "no"]


def test_extraction_asks_again_and_clamps(spark):
    good = '{"episodes": [{"turn_idx": 99, "speaker": "user", "text": "t"}], "facts": [{"turn_idx": -3, "entity": "user", "attribute": "name", "value": "x"}]}'
    rows = spark.createDataFrame([("a", "good", 3), ("b", "loops", 3), ("c", "hopeless", 3)], "session_id string, text string, n_turns int")
    loop = '{"episodes": [], "facts": [' + ", ".join(['{"value": "x"}'] * 6) + "]}"
    got = {r.session_id: r for r in extraction.extracted(rows, lambda ts: [{"good": good, "loops": loop, "hopeless": "no"}[t] for t in ts], lambda ts: [{"loops": good, "hopeless": "still no"}[t] for t in ts]).collect()}
    assert got["a"].out.episodes[0].turn_idx == 2 and got["a"].out.facts[0].turn_idx == 0 and got["a"].ok
    assert got["b"].raw == good and got["c"].out is None and not got["c"].ok


def test_snapshots_splits_and_settings(spark, tmp_path):
    path = str(tmp_path / "s")
    conversations.save(spark.range(3).toDF("id"), path)
    conversations.save(conversations.restore(spark, path).withColumn("more", F.lit(1)), path)  # from itself
    assert conversations.restore(spark, path).columns == ["id", "more"] and conversations.restore(spark, path).count() == 3
    items = spark.range(10).select("id", (F.col("id") < 4).alias("dev"))
    conversations.save_split(items, str(tmp_path / "split"))
    assert {tuple(r) for r in conversations.load_split(items.drop("dev"), str(tmp_path / "split")).collect()} == {(i, i < 4) for i in range(10)}
    (tmp_path / "a.json").write_text('{"extends": "b.json", "x": {"y": 1}}')
    (tmp_path / "b.json").write_text('{"x": {"y": 2, "z": 3}}')
    assert evaluation.inherited(str(tmp_path / "a.json")) == {"x": {"y": 1, "z": 3}}
    (tmp_path / "b.json").write_text('{"extends": "a.json"}')
    with pytest.raises(ValueError):
        evaluation.inherited(str(tmp_path / "a.json"))
    assert evaluation.override("write.policy = sieve") == {"write": {"policy": "sieve"}} and evaluation.override("a=3") == {"a": 3}


def test_summaries_and_baselines(spark):
    rows = [(0, i, f"We went to Lake Garda number {i}", "user", T0 + dt.timedelta(days=i), [1.0, 0.1 * i]) for i in range(3)] + [(0, 9, "Else", "assistant", T0, [0.0, 1.0])]
    members = spark.createDataFrame(rows, "grp int, id int, text string, speaker string, ts timestamp_ntz, vec array<double>")
    labels = members.select("grp", "id", F.when(F.col("id") < 3, 0).otherwise(9).alias("cluster"))
    got = consolidation.summaries(members, members.select("grp", "id", "vec"), labels).collect()
    assert [(r.entity, r.attribute, r.value, r.sources, r.valid_from) for r in got] == [("user", "recurring_lake_garda", "We went to Lake Garda number 2", [0, 1, 2], T0)]
    turns = spark.createDataFrame([("s", T0, i, "user", f"I planted {w} in the garden") for i, w in enumerate(("roses", "beans", "mint"))], "session_id string, ts timestamp_ntz, turn int, role string, text string")
    asked = spark.createDataFrame([(1, "where are the beans"), (2, "mint or roses")], "query_id int, text string")
    lines = {(r.query_id, r.position): r.line for r in reading.baseline("naive_rag")(turns, asked, 30).collect()}
    assert lines[1, 0].startswith("[s#1] (2023-02-04; user) I planted beans") or any("beans" in v for k, v in lines.items() if k[0] == 1)
    with pytest.raises(ValueError):
        reading.baseline("none")
