"""Text, temporal and extraction rules on small fixtures, sources and caches."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from keepsake.functions import temporal
from keepsake.functions import text as X
from keepsake.operators import chains, evaluation, extraction
from keepsake.sources import caches, conversations

NOW = dt.datetime(2023, 6, 10, 12)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize("question,mode,start,end", [
    ("Where do I live now?", "now", NOW, NOW),
    ("Where did I live in March?", "interval", dt.datetime(2023, 3, 1), dt.datetime(2023, 3, 31, 23, 59, 59)),
    ("What happened in September?", "interval", dt.datetime(2022, 9, 1), dt.datetime(2022, 9, 30, 23, 59, 59)),
    ("how many times did I move?", "whole_chain", None, None),
    ("last month", "interval", dt.datetime(2023, 5, 1), dt.datetime(2023, 5, 31, 23, 59, 59)),
    ("Where did I live previously?", "before_latest", None, None),
    ("Where is it?", "none", None, None),
    ("we met in may", "none", None, None),
])
def test_temporal_cues(spark, question, mode, start, end):
    got = one(spark, temporal.parse_temporal(F.lit(question), F.lit(NOW).cast("timestamp_ntz")))
    assert (got["mode"], got["start"], got["end"]) == (mode, start, end)


def test_dates(spark):
    assert one(spark, temporal.parse_session_date(F.lit("2023/05/20 (Sat) 02:21"))) == dt.datetime(2023, 5, 20, 2, 21)
    at = F.lit(NOW).cast("timestamp_ntz")
    assert one(spark, temporal.relative_date(F.lit("two weeks ago"), at)) == dt.date(2023, 5, 27)
    assert one(spark, temporal.relative_date(F.lit("last Wednesday"), at)) == dt.date(2023, 6, 7)
    assert one(spark, temporal.relative_date(F.lit("next friday"), at)) == dt.date(2023, 6, 16)
    assert one(spark, temporal.relative_date(F.lit("whenever"), at)) is None


def test_names_and_verdicts(spark):
    assert one(spark, X.canonical_entity(F.lit("My  Sister's dog!"))) == "sister_s_dog"
    assert one(spark, X.canonical_entity(F.lit("the"))) == "the"
    assert one(spark, X.canonical_entity(F.lit("?!"))) == "user"
    assert one(spark, X.verdict(F.lit("no, it is not yes"))) is False
    assert one(spark, X.verdict(F.lit(""))) is None
    assert one(spark, X.count_tokens(F.lit(""))) == 0
    assert one(spark, X.truncated(F.lit("word " * 200), 20)).startswith("word")
    assert one(spark, X.count_tokens(X.truncated(F.lit("word " * 200), 20))) <= 20


def turns(spark):
    return spark.createDataFrame([("s", 0, "user", "I moved to Boston last week. My name is Rachel Green. Nice day."), ("s", 1, "assistant", "You could visit the old harbour first. Then rest."), ("s", 2, "user", "I moved to boston. My favorite tea is green tea."), ("s", 3, "user", "  ")], "session_id string, turn int, role string, text string")


def test_extraction(spark):
    facts = {(r.attribute, r.value) for r in extraction.facts(turns(spark)).collect()}
    assert {("location", "Boston"), ("name", "Rachel"), ("favorite_tea", "green tea")} <= facts
    said = {r.text for r in extraction.episodes(turns(spark)).collect()}
    assert "assistant suggested: You could visit the old harbour first." in said
    assert extraction.raw_turns(turns(spark)).count() == 3


def test_replies(spark):
    whole = '{"episodes": [], "facts": [{"turn_idx": 1, "entity": "user", "attribute": "location", "value": "Oslo"}]}'
    cut = whole[:-2] + ', {"turn_idx": 2, "enti'
    df = spark.createDataFrame([(whole,), (cut,), ("nothing",)], "raw string").select(extraction.parse(F.col("raw")).alias("p"))
    assert [r.p["facts"][0]["value"] if r.p else None for r in df.collect()] == ["Oslo", "Oslo", None]
    assert json.loads(extraction.salvage(cut))["facts"][0]["value"] == "Oslo"
    many = '{"facts": [' + ",".join(['{"value": "x"}'] * 5) + "]}"
    rows = spark.createDataFrame([("a", whole), ("b", cut), ("c", many)], "session_id string, raw string")
    assert {r.session_id: r.degenerate for r in extraction.degenerate(rows).collect()} == {"a": False, "b": True, "c": True}


def test_worked_example(spark):
    t0 = dt.datetime(2023, 2, 4, 10)
    facts = spark.createDataFrame([("user", "location", "Boston", t0, 1, "user", "stated"), ("user", "location", "boston", t0 + dt.timedelta(days=3), 2, "user", "stated"), ("user", "location", "Seattle", t0 + dt.timedelta(days=104), 3, "user", "stated")], "entity string, attribute string, value string, valid_from timestamp_ntz, seq long, speaker string, kind string")
    versions = chains.build(facts)
    assert versions.count() == 2
    march = (dt.datetime(2023, 3, 1), dt.datetime(2023, 3, 31, 23, 59, 59))
    asked = spark.createDataFrame([(q, "user", "location", m, *march) for q, m in (("a", "now"), ("b", "interval"), ("c", "whole_chain"), ("d", "before_latest"))], "question_id string, entity string, attribute string, mode string, start timestamp_ntz, end timestamp_ntz")
    got = {}
    for r in chains.select_nodes(versions, asked).collect():
        got.setdefault(r.question_id, set()).add(r.value)
    assert got == {"a": {"Seattle"}, "b": {"Boston"}, "c": {"Boston", "Seattle"}, "d": {"Boston", "Seattle"}}


def test_sources_and_caches(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([{"session_id": "s1", "date": "2023/05/20 (Sat) 02:21", "turns": [{"role": "system", "content": "hi"}]}]))
    t = conversations.turns(conversations.sessions(spark, str(tmp_path / "c.json"))).first()
    assert (t.role, t.text, t.has_answer) == ("assistant", "hi", False)
    (tmp_path / "b.json").write_text(json.dumps([{"question_id": "q_abs", "question_type": "multi", "haystack_dates": ["2023/05/20"], "haystack_session_ids": ["s"], "haystack_sessions": [[{"role": "user", "content": "x", "has_answer": True}]]}]))
    items = conversations.benchmark(spark, str(tmp_path / "b.json"))
    assert items.first().stratum == "multi_abs"
    assert conversations.evidence_turns(conversations.haystack(items)).first().turns == [0]
    wanted = spark.createDataFrame([("a",), ("b",), ("a",)], "key string")
    calls = []
    compute = lambda d: (calls.append(d.count()), d.withColumn("v", F.upper("key")))[1]
    for _ in range(2):
        assert sorted(r.v for r in caches.through(wanted, str(tmp_path / "cache"), compute).collect()) == ["A", "A", "B"]
    assert calls == [2, 0]
    base = spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string")
    assert {tuple(r) for r in caches.upsert(base, spark.createDataFrame([(2, "z")], "id int, v string")).collect()} == {(1, "x"), (2, "z")}
    conversations.save(base, str(tmp_path / "snap"))
    assert conversations.restore(spark, str(tmp_path / "snap")).exceptAll(base).count() == 0


def test_identity():
    a = {"write": {"policy": "sieve"}, "read": {"k": 1}, "device": "cpu"}
    assert evaluation.identity(a) == evaluation.identity(a | {"device": "gpu"})
    assert evaluation.identity(a) != evaluation.identity(a | {"read": {"k": 2}})
    assert evaluation.identity(a, True) == evaluation.identity(a | {"read": {"k": 2}}, True)
    assert evaluation.overlay(a, {"write": {"x": 1}})["write"] == {"policy": "sieve", "x": 1}


def test_truncation_splits_a_text_once(spark):
    d = spark.createDataFrame([("ab " * 500,), (" " * 300,), (None,)], "text string")
    out = d.select(X.truncated(F.col("text"), 60).alias("t"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert [r.t for r in out.collect()] == [" ".join(["ab"] * 66), "", None]
