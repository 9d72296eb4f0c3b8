"""What the second round's findings showed at larger sizes, on frames that are small."""

import numpy as np
from pyspark.sql import functions as F

from sembra.backend import ScriptedBackend
from sembra.cascade import calibrate
from sembra.engine import Engine
from sembra.functions.prompts import REASON_FIRST
from sembra.operators import ranking, vectors
from sembra.operators.ranking import sem_topk
from sembra.operators.rowwise import sem_map
from sembra.operators.vectors import approximate_pairs, linked_values, similar_pairs
from sembra.plans.lazy import LazyFrame


def test_full_join_keeps_no_key_in_memory(engine, spark):
    """as Spark's full join, nulls in keys included, without its operator, which holds all pairs of a key."""
    l = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "k int, x string")
    r = spark.createDataFrame([(1, 10), (1, 11), (3, 12), (None, 13)], "k long, y int")
    got = LazyFrame(name="l").join(LazyFrame(name="r"), ["k"], "full").run(engine, {"l": l, "r": r})
    want = l.join(r, ["k"], "full")
    assert got.schema.simpleString() == want.schema.simpleString()
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert "FullOuter" not in got._jdf.queryExecution().optimizedPlan().toString()
    drawn = l.withColumn("z", F.rand())
    both = LazyFrame(name="l").join(LazyFrame(name="r"), ["k"], "outer").run(engine, {"l": drawn, "r": r})
    assert both.count() == want.count() == 8


def test_calibration_is_exact(spark):
    """edges are those of the sorted rows however many there are; an approximation is off by some of 400,000."""
    n = 400_000
    df = spark.range(n).select(F.pmod(F.xxhash64("id"), F.lit(1_000_003)).cast("double").alias("__sembra_score"))
    scores = sorted(r[0] for r in df.collect())
    edges = [scores[max(1, -(-q * n // 10)) - 1] for q in range(11)]
    got = calibrate(df.withColumn("was", F.col("__sembra_score")), 10)
    want = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.size(F.filter(F.lit(edges), lambda e: e <= F.col("was"))) - 1) / F.lit(10.0)))
    assert got.where(F.abs(F.col("__sembra_score") - want) > 1e-9).count() == 0


def test_topk_rounds_pass_nothing_through_the_driver(engine, spark, monkeypatch):
    """groups over COMPARED_ROWS are cut in Spark, so no list of pairs is longer, and rounds broadcast no table."""
    monkeypatch.setattr(ranking, "COMPARED_ROWS", 30)
    monkeypatch.setattr(ranking, "PIVOT_ROWS", 8)
    lists, plans = [], []
    call, ask = ranking._Comparer.__call__, ranking._Comparer.ask

    def called(self, pairs):
        lists.append(len(pairs))
        return call(self, pairs)

    def asked(self, *args, **more):
        out = ask(self, *args, **more)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(ranking._Comparer, "__call__", called)
    monkeypatch.setattr(ranking._Comparer, "ask", asked)
    df = spark.range(200).select(F.col("id").alias("i"), ((F.col("id") * 37) % 211).cast("double").alias("s_acctbal"))
    got = [r.s_acctbal for r in sem_topk(engine, df, "{s_acctbal}: the balance is larger", 5, "quick", "i", rank_col="r").orderBy("r").collect()]
    assert got == sorted((float(i * 37 % 211) for i in range(200)), reverse=True)[:5]
    assert max(lists) <= 30 and not any("Broadcast" in p for p in plans)


def _vectors(spark, n):
    v = np.random.default_rng(9).normal(size=(n // 2, 7))
    v = np.concatenate([v, v])  # each twice
    return v, spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, _vec array<double>")


def _copied(df):
    """Whether rows are copied for pairs of blocks before they meet."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return "Generate explode" in plan or "CoGroup" in plan


def test_joins_of_blocks_copy_nothing(spark, monkeypatch):
    """each task gives K rows per left row, equal vectors tie by id, and no row is copied for pairs of blocks."""
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 16)
    v, df = _vectors(spark, 120)
    got = similar_pairs(df, df, "id", "id", K=3)
    assert not _copied(got)
    s = [[sum(x * y for x, y in zip(a, b)) for b in v] for a in v.tolist()]
    want = {(i, j) for i in range(120) for j in sorted(range(120), key=lambda j: (-s[i][j], j))[:3]}
    assert {(r.lid, r.rid) for r in got.collect()} == want


def test_links_follow_the_rows(spark, monkeypatch):
    """the links of a dense graph are no more than its rows and parts; the pairs would be their square."""
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 16)
    v, df = _vectors(spark, 120)
    links = [(r.a, r.b) for r in linked_values(df, "id", "_vec", 0.5).collect()]
    assert len(links) <= 120 * vectors.TILE_PARTS and all(a > b for a, b in links)

    def least(pairs):
        at = list(range(120))
        for _ in range(120):
            for a, b in pairs:
                at[a] = at[b] = min(at[a], at[b])
        return at

    assert least(links) == least([(a, b) for a in range(120) for b in range(a) if v[a] @ v[b] > 0.5])


def test_search_by_cells_copies_nothing(spark, monkeypatch):
    """a task holds a block of each side and LEFT_ROWS x BLOCK_ROWS scores; no cell or product of blocks as a whole."""
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 16)
    monkeypatch.setattr(vectors, "LEFT_ROWS", 4)
    v, df = _vectors(spark, 120)
    got = approximate_pairs(df.where("id % 5 = 0"), df, "id", "id", 4, 3, 3)
    assert not _copied(got)
    s = [[sum(x * y for x, y in zip(a, b)) for b in v] for a in v.tolist()]
    want = {(i, j) for i in range(0, 120, 5) for j in sorted(range(120), key=lambda j: (-s[i][j], j))[:4]}
    assert {(r.lid, r.rid) for r in got.collect()} == want


def test_equal_prompts_are_found_by_contexts(spark, monkeypatch):
    """no rows are sorted to find equal prompts, and the head that all prompts share is added to distinct contexts."""
    plans = []
    frame = type(spark.range(1))
    run = frame.mapInPandas
    monkeypatch.setattr(frame, "mapInPandas", lambda self, *a, **k: plans.append(self._jdf.queryExecution()) or run(self, *a, **k))
    engine = Engine(spark, ScriptedBackend(script=lambda c: c[-1]["content"].partition("«")[2].partition("»")[0]), safe_mode=True)
    df = spark.range(300).select("id", (F.col("id") % 7).alias("x"))
    got = sem_map(engine, df, "Repeat {x}", suffix="y", strategy="zs_cot").collect()
    assert len(got) == 300 and all(r.y == str(r.x) for r in got) and engine.usage.calls == 7 and engine.estimates[0]["calls"] == 7
    top, _, below = plans[0].optimizedPlan().toString().partition("\n+- ")
    assert top.startswith("Aggregate") and REASON_FIRST in top and REASON_FIRST not in below
    assert "Sort" not in plans[0].sparkPlan().toString()


def test_contexts_compare_as_their_prompts(spark):
    """a collation makes no two prompts one; bytes that aren't UTF-8 show alike and are asked once."""
    engine = Engine(spark, ScriptedBackend(script=lambda c: c[-1]["content"].partition("«")[2].partition("»")[0]))
    df = spark.createDataFrame([(1, b"a"), (2, b"A"), (3, b"a"), (4, b"x\xff"), (5, b"x\xfe"), (6, None)], "id int, b binary")
    text = F.col("b").cast("string")
    for column in (text, F.collate(text, "UTF8_LCASE")):
        at = engine.usage.calls
        said = sem_map(engine.with_(log_path=None), df.select("id", column.alias("t")), "Repeat {t}", suffix="y")
        assert [r.y for r in said.orderBy("id").collect()] == ["a", "A", "a", "x\ufffd", "x\ufffd", "None"]
        assert engine.usage.calls - at == 4
