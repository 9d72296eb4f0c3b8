import pytest
from pyspark.sql import functions as F

from sembra.backend import Completion, Limits, RateLimiter, RuleBackend, Usage, UsageLimitError, positive_prob
from sembra.functions import answers, context
from sembra.functions.langex import columns_of, rendered, sides
from sembra.functions.prompts import Strategy, example_turns
from sembra.functions.serialize import fields_of, row_text


def test_langex():
    assert columns_of("{b c} of {a} and {b c}") == ["b c", "a"]
    assert columns_of("{{x}} {y}") == ["y"]
    assert rendered("{Course Name:left} needs {skill}") == "Course name needs Skill"
    with pytest.raises(ValueError):
        columns_of("no columns")


def test_sides():
    assert sides("{a} {b}", ["a"], ["b"]) == ([("a", "a")], [("b", "b")])
    assert sides("{a:left} {a:right}", ["a"], ["a"]) == ([("a:left", "a")], [("a:right", "a")])
    for bad in ("{a} {b}", "{a:left}"):
        with pytest.raises(ValueError):
            sides(bad, ["a", "b"], ["a"])


def test_serializers(spark):
    df = spark.createDataFrame([("Ann <x>", 3, 1.0, True, None, 1e7)], "name string, age int, w double, ok boolean, n string, big double")
    got = df.select(row_text(df, ["name", "age", "w", "ok", "n", "big", "missing"]).alias("d"), row_text(df, ["name", "n"], "json").alias("j"), row_text(df, ["name"], "xml").alias("x"), row_text(df, []).alias("e")).first()
    assert got.d == "[Name]: «Ann <x>»\n[Age]: «3»\n[W]: «1.0»\n[Ok]: «True»\n[N]: «None»\n[Big]: «10000000.0»\n"
    assert got.j == '{"Name":"Ann <x>","N":null}'
    assert got.x == "<row><Name>Ann &lt;x&gt;</Name></row>"
    assert got.e == ""
    assert fields_of(got.d)["Age"] == "3"


def test_answers(spark):
    raw = ["True", "it is false.", "Reasoning: because\nAnswer: true", "<think>false</think> TRUE", None, "maybe", "untrue"]
    df = spark.createDataFrame([(r,) for r in raw], "r string")
    got = [tuple(x) for x in df.select(answers.verdict(F.col("r"), False), answers.explanation(F.col("r")), answers.verdict(F.col("r"), True, ("A", "B"))).collect()]
    assert [g[0] for g in got] == [True, False, True, True, False, False, True]
    assert got[2][1] == "because" and got[3][1] == "false" and got[0][1] is None
    assert all(g[2] for g in got)  # one-letter tokens only count as words
    j = spark.createDataFrame([('x {"a": "1"} y',), ("[1]",), ("{bad",)], "r string").select(answers.json_fields(F.col("r")).alias("m")).collect()
    assert [x.m for x in j] == [{"a": "1"}, {}, {}]


def test_context(spark):
    df = spark.createDataFrame([(1, "a b c d e", "x y"), (2, "a", "b"), (3, None, "q")], "id int, t string, u string")
    got = context.chunk(df, ["t", "u"], 4).orderBy("id", "chunk").collect()
    assert [(r.id, r.t, r.u) for r in got] == [(1, "a b", "x y"), (1, "c d", "x y"), (1, "e", "x y"), (2, "a", "b"), (3, None, "q")]
    assert [r[0] for r in df.select(context.truncate(F.col("t"), 2)).collect()] == ["a b...", "a", None]
    with pytest.raises(Exception, match="can't be fitted"):
        context.chunk(spark.createDataFrame([("a b c", "a b c")], "t string, u string"), ["t", "u"], 3).collect()


def test_examples_and_strategies():
    turns = example_turns([{"t": "x", "Answer": True, "Reasoning": "y"}], ["t"], "Claim: z", Strategy.COT, ("yes", "no"))
    assert turns[1]["content"] == "Reasoning: y\nAnswer: yes"
    assert Strategy.of("ZS_COT").reasons
    with pytest.raises(ValueError):
        Strategy.of("other")
    with pytest.raises(ValueError):
        example_turns([{"t": "x", "Answer": "maybe"}], ["t"], "z", Strategy.DEFAULT, ("yes", "no"))


def test_backend_parts():
    assert positive_prob([{"a": 0.0}, {"True": -0.1, "False": -2.0}], "x", "True", "False") > 0.8
    assert positive_prob([], "False", "True", "False") == 0.0
    b = RuleBackend(rules={"q": lambda f, m: Completion("ok", 0.5)})
    assert b.get_completion("s", "Context:\n\n\nq").startswith("ok")
    with pytest.raises(UsageLimitError):
        Limits(calls=1).check(Usage(calls=2))
    now, slept = [0.0], []
    limiter = RateLimiter(requests=2, clock=lambda: now[0], sleep=lambda s: (slept.append(s), now.__setitem__(0, now[0] + s)))
    for _ in range(3):
        limiter.wait(1)
    assert slept == [60.0]
    with pytest.raises(ValueError):
        RateLimiter(tokens=10).wait(50)
