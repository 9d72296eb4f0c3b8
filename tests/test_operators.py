import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sembra import catalogue, rules
from sembra.agentic.corpus import Corpus, derive_plan, normalize_ops
from sembra.agentic.loop import LocalSandbox, python_tool, run_agent, tool
from sembra.backend import Completion, Limits, RuleBackend, UsageLimitError
from sembra.cascade import CascadeArgs, draw, learn
from sembra.engine import Engine
from sembra.operators.aggregation import sem_agg
from sembra.operators.joins import sem_join
from sembra.operators.ranking import sem_topk
from sembra.operators.rowwise import llm_as_judge, pairwise_judge, sem_extract, sem_filter, sem_map
from sembra.operators.vectors import load_sem_index, sem_cluster_by, sem_dedup, sem_index, sem_search, sem_sim_join
from sembra.plans.lazy import CascadeOptimizer, LazyFrame, PromptOptimizer, push_filters
from sembra.sources.connect import DirectoryReader, load_files
from sembra.sources.web import html_text, web_backend, web_extract, web_search


def test_call_counts(engine, spark, sf):
    part = spark.read.parquet(f"{sf}/part.parquet")
    n = part.select("p_name").distinct().count()
    out = sem_filter(engine, part, "{p_name} names a ring").select("p_partkey")
    assert engine.usage.calls == n and engine.usage.rows == part.count()
    out.count()
    sem_filter(engine, part, "{p_name} names a ring").count()
    assert engine.usage.calls == n  # the log answered
    assert engine.usage.cache_hits == 2 * part.count() - n


def test_limits(spark, sf):
    e = Engine(spark, rules.backend(), limits=Limits(calls=3))
    with pytest.raises(UsageLimitError):
        sem_filter(e, spark.read.parquet(f"{sf}/part.parquet"), "{p_name} names a ring")


def test_filter_columns(engine, spark):
    df = spark.createDataFrame([("gold ring", 1), (None, 2)], "p_name string, _filter int")
    out = sem_filter(engine, df, "{p_name} names a ring", return_all=True, return_raw_outputs=True)
    assert out.columns == ["p_name", "_filter", "_filter_1", "raw_output_filter"]
    assert {r[1]: r[2] for r in out.collect()} == {1: True, 2: False}
    assert sem_filter(engine, df.limit(0), "{p_name} names a ring").count() == 0
    with pytest.raises(ValueError):
        sem_filter(engine, df, "{other} names a ring")


def test_map_extract_judge(spark):
    b = RuleBackend(rules={"shout": lambda f, m: "Reasoning: loud\nAnswer: " + f["T"].upper(), "Fields:": lambda f, m: '{"a": "1", "a_quote": "q", "z": "9"}', "good": lambda f, m: '{"score": 3}'})
    e = Engine(spark, b)
    df = spark.createDataFrame([("x",)], "T string")
    r = sem_map(e, df, "shout {T}", return_explanations=True).first()
    assert (r["_map"], r["explanation_map"]) == ("X", "loud")
    r = sem_extract(e, df, ["T"], {"a": None, "b": "other"}, extract_quotes=True, extra_col="_extra").first()
    assert (r.a, r.b, r.a_quote, r.b_quote, r._extra) == ("1", None, "q", None, {"z": "9"})
    r = llm_as_judge(e, df, "is {T} good", n_trials=2, response_schema="score int").first()
    assert r["_judge_0"].score == 3 and r["_judge_1"].score == 3
    with pytest.raises(ValueError):
        llm_as_judge(e, df, "is {T} good", response_schema="score int", strategy="cot")
    with pytest.raises(ValueError):
        pairwise_judge(e, df, "T", "T", "x", n_trials=3, permute_cols=True)


def test_cascade_math():
    scores = np.linspace(0, 1, 101)[::-1]
    args = CascadeArgs(seed=1)
    drawn = draw(list(enumerate(scores)), 101, np.sqrt(scores).sum(), args)
    assert sum(d.times for d in drawn.values()) == 10 and all(d.correction > 0 for d in drawn.values())
    assert sum(d.times for d in draw([(0, 0.0), (1, 0.0), (2, 0.0)], 3, 0.0, args).values()) == 1
    assert sum(d.times for d in draw(list(enumerate(scores)), 10**9, 5e8, args).values()) == 10**8  # no cap on the draws
    assert draw([], 0, 0.0, args) == {}
    perfect = [(s, s > 0.5, 1.0) for s in np.linspace(0.01, 0.99, 400)]
    pos, neg = learn(perfect, CascadeArgs(recall_target=0.9, precision_target=0.9))
    assert neg <= pos <= 1 and neg < 0.6
    assert learn([], args) == (1.0, 0.0)
    assert CascadeArgs(fixed=(0.8, 0.3)).swapped().fixed == pytest.approx((0.7, 0.2))
    with pytest.raises(ValueError):
        CascadeArgs(fixed=(0.1, 0.2))


def test_cascade_that_routes_all_is_the_filter(engine, spark, sf):
    part = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_name", "p_size")
    ask = "{p_name} of size {p_size} is big or a ring"
    full = {r[0] for r in sem_filter(engine, part, ask).select("p_partkey").collect()}
    routed, stats = sem_filter(engine, part, ask, cascade=CascadeArgs(fixed=(1.5, -0.5)), return_stats=True)
    assert {r[0] for r in routed.select("p_partkey").collect()} == full and stats.resolved_by_helper == 0


def test_join(engine, spark):
    left = spark.createDataFrame([("ASIA", 1), ("X", 2), (None, 3)], "p_type string, id int")
    right = spark.createDataFrame([("AFRICA", 1), ("EUROPE", 2)], "r_name string, id int")
    out = sem_join(engine, left, right, "{p_type} has a letter of {r_name}")
    assert set(out.columns) == {"p_type", "id:left", "r_name", "id:right"}
    assert [(r["id:left"], r["id:right"]) for r in out.collect()] == [(1, 1)]
    with pytest.raises(NotImplementedError):
        sem_join(engine, left, right, "{p_type} has a letter of {r_name}", how="left")


def test_topk_methods_agree(engine, spark, sf):
    nation = spark.read.parquet(f"{sf}/nation.parquet").where("n_nationkey < 8")
    want = [7, 6, 5]
    for method in ("naive", "quick", "quick-sem"):
        got = sem_topk(engine, nation, "{n_nationkey}: the nation key is larger", 3, method, "n_nationkey")
        assert [r.n_nationkey for r in got.collect()] == want, method
    assert sem_topk(engine, nation.limit(0), "{n_nationkey}: the nation key is larger", 3).count() == 0
    with pytest.raises(ValueError):
        sem_topk(engine, nation, "{n_nationkey}", 3, "bogus")


def test_agg(engine, spark):
    df = spark.createDataFrame([(i, f"w{i}") for i in range(20)], "i int, n_name string")
    got = sem_agg(engine, df, "List the values of {n_name}", order_by=["i"], budget=14).collect()
    assert got[0][0] == ",".join(f"w{i}" for i in range(20))
    assert sem_agg(engine, df.limit(0), "List the values of {n_name}").count() == 0
    stuck = Engine(spark, RuleBackend(rules={"List": lambda f, m: "a b c d e f g h"}))
    with pytest.raises(RuntimeError):
        sem_agg(stuck, df, "List the values of {n_name}", order_by=["i"], budget=12)


def test_rerank_without_k(spark):
    """The reranker sees every row: here its best are the farthest by vector, beyond one batch."""

    class Longest:
        def score(self, query, texts):
            return [float(len(t)) for t in texts]

    class Same:
        def embed(self, texts):
            return np.array([[1.0, 0.0] for _ in texts])

    e = Engine(spark, RuleBackend(rules={}), embedder=Same(), reranker=Longest())
    df = spark.range(25000).selectExpr("id", "repeat('x', cast(id % 12500 AS int) DIV 100) AS t", "array(1d - id / 25000d, 0d) AS _vec")
    assert [r.id for r in sem_search(e, df, "q", n_rerank=3, text_col="t").collect()] == [12400, 12401, 12402]
    assert [r.id for r in sem_search(e, df, "q", 200, n_rerank=3, text_col="t").collect()] == [100, 101, 102]


def test_cluster_rounds(spark, sf):
    """The registered clustering of 20 rounds against a brute-force k-means."""
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").orderBy("vec_id").collect()
    v = np.array([[float(x) for x in r.embedding] for r in rows])
    near = lambda c: np.array([min(range(len(c)), key=lambda i: (((x - c[i]) ** 2).sum(), i)) for x in v])
    c = v[:10].copy()
    first = None
    for _ in range(20):
        at = near(c)
        c = np.array([v[at == i].mean(0) if (at == i).any() else c[i] for i in range(10)])
        first = near(c) if first is None else first
    want = {r.vec_id: int(i) for r, i in zip(rows, near(c))}
    assert {r.vec_id: r.cluster_id for r in catalogue.QUERIES["q_cluster_rounds"](spark, sf).collect()} == want
    assert list(want.values()) != first.tolist()


def test_vectors(engine, spark, tmp_path):
    df = spark.createDataFrame([(1, "red apple pie"), (2, "apple pie red"), (3, "blue sea"), (4, "blue sea")], "id long, t string")
    path = str(tmp_path / "index")
    sem_index(engine, df, "t", path, "id")
    v = load_sem_index(engine, df, path, "id")
    assert [r.id for r in sem_search(engine, v, "apple pie red", 2).collect()] == [1, 2]
    assert sem_search(engine, v, "sea", 4, n_rerank=2, text_col="t").count() == 2
    got = sem_dedup(engine, df, "t", 0.9, "id").orderBy("id").collect()
    assert [r.id for r in got] == [1, 3, 4]  # equal values are one value
    pairs = sem_sim_join(v, v, "id", "id", 2, keep_index=True).collect()
    assert len(pairs) == 8 and {"t_l", "t_r"} <= set(pairs[0].asDict())
    c = sem_cluster_by(v, 2, niter=5).collect()
    assert len({r.cluster_id for r in c}) == 2
    assert sem_cluster_by(v.limit(0), 2).count() == 0


def test_agents(spark):
    @tool()
    def add(a: int, b: int) -> int:
        """Adds."""
        return a + b

    said = iter([{"tool": "add", "arguments": {"a": 1, "b": 2}}, {"tool": "nope"}, {"text": "3"}])
    got = run_agent(lambda chat, tools: next(said), [add], "s", "u")
    assert got.text == "3" and [t["result"] for t in got.trace] == ["3", "error: no tool nope"]
    assert run_agent(lambda c, t: {"text": "end"} if not t else {"tool": "add", "arguments": {}}, [add], "s", "u", 2).completions == 3
    assert python_tool(LocalSandbox(10)).run(code="print(6 * 7)").strip() == "42"
    assert LocalSandbox(0.5).run_code("while True: pass").code == 124
    assert normalize_ops([" Filter", "reduce"]) == ["filter", "reduce"]
    for bad in (["reduce", "map"], ["x"], ["map", "map"]):
        with pytest.raises(ValueError):
            normalize_ops(bad)
    corpus = Corpus.from_documents(spark, ["Alpha", "beta", "GammA"], ["A", "B", "C"])
    done = corpus.agent("t", rules.agent, ["map", "reduce"])
    assert done.output == "alpha|beta|gamma"
    assert [r.shard for r in corpus.shards(2).orderBy("ord").collect()] == [0, 0, 1]
    assert Corpus.from_text(spark, "abcde", 2).units.count() == 3

    def batch(chat, tools):
        return {"text": '[{"id": "A", "result": "one"}]'}

    got = corpus.agent("t", batch, ["map"], plan=derive_plan("t", ["map"], overrides={"strategies": {"map": "batched"}, "shard_size": 2}))
    assert [r.content for r in got.findings.orderBy("ord").collect()] == ["one", "beta", "GammA"]


def test_plan_rules(engine, spark):
    plan = LazyFrame().sem_filter(instruction="{p_name} names a ring").filter("p_size > 1")
    assert push_filters(plan.step).op == "sem_filter"
    kept = LazyFrame().sem_filter(instruction="{p_name} names a ring", return_all=True).filter("_filter AND p_size > 1")
    assert push_filters(kept.step).op == "filter"
    assert LazyFrame.from_json(plan.to_json()).step == plan.step
    df = spark.createDataFrame([("a ring", 2), ("a ring", 0), ("x", 5)], "p_name string, p_size int")
    assert plan.run(engine, df).collect() == plan.optimize().run(engine, df).collect() != []
    path = next(iter(plan.parameters()))
    better = PromptOptimizer(lambda p: [{path: "{p_name} names a ring!"}], lambda q: len(q.to_json())).optimize(plan)
    assert better.parameters()[path].endswith("!")
    with pytest.raises(AttributeError):
        plan.nothing  # noqa: B018


def test_joins_pull_filters_up():
    plan = LazyFrame(name="a").sem_filter(instruction="{x} is y").join(LazyFrame(name="b"), ["k"])
    assert plan.optimize().step.op == "sem_filter"


def test_cascade_optimizer(engine, spark, sf):
    part = spark.read.parquet(f"{sf}/part.parquet").select("p_name", "p_size")
    plan = LazyFrame().sem_filter(instruction="{p_name} of size {p_size} is big or a ring", cascade=CascadeArgs(sampling_percentage=0.3))
    assert CascadeOptimizer(engine, {"input": part}).optimize(plan).step.args["cascade"].fixed is not None


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text(" ".join(str(i) for i in range(25)))
    (tmp_path / "b.html").write_text("<p>Hi</p><script>x</script>")
    (tmp_path / "c.zzz").write_text("?")
    df = DirectoryReader(spark).add_dir(str(tmp_path)).to_df(chunk_tokens=10, overlap=2)
    rows = {(os.path.basename(r.path), r.chunk): r for r in df.collect()}
    assert rows[("a.txt", 0)].content.split() == [str(i) for i in range(10)]
    assert rows[("a.txt", 2)].content.split()[-1] == "24" and ("a.txt", 3) not in rows
    assert rows[("b.html", 0)].content == "Hi" and rows[("c.zzz", 0)].error
    with pytest.raises(ValueError):
        load_files(spark, "x.bin")
    assert html_text("<style>a</style>b &amp; c<noscript>d</noscript>") == "b & c"
    assert html_text(None) == ""

    @web_backend("stub")
    def stub(query, K, *_):
        return [{"id": str(i), "url": query, "title": "t"} for i in range(5)]

    assert web_search(spark, "stub", ["a", "b"], 3).count() == 6
    got = web_extract(spark.createDataFrame([("u",)], "url string"), "url", lambda u: "<b>x</b>").first()
    assert got.full_text == "x"
    with pytest.raises(ValueError):
        web_search(spark, "none", "q", 1)


def test_random_topk(engine, spark):
    random.seed(3)
    values = random.sample(range(1000), 12)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i long, s_acctbal double")
    got = [r.s_acctbal for r in sem_topk(engine, df, "{s_acctbal}: the balance is larger", 5, "quick", "i").collect()]
    assert got == sorted(map(float, values), reverse=True)[:5]


def test_structured_agg(spark):
    e = Engine(spark, RuleBackend(rules={"Sum": lambda f, m: Completion('{"n": 2, "s": "x"}')}))
    out = sem_agg(e, spark.createDataFrame([("a",)], "t string"), "Sum {t}", response_schema="n int, s string")
    assert out.columns == ["n", "s"] and tuple(out.first()) == (2, "x")


def test_null_ids_in_index(engine, spark, tmp_path):
    df = spark.createDataFrame([(None, "x"), (1, None)], "id long, t string")
    sem_index(engine, df, "t", str(tmp_path / "i"), "id")
    assert spark.read.parquet(str(tmp_path / "i")).count() == 1
    assert df.select(F.count("*")).first()[0] == 2
