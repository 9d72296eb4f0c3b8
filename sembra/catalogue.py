"""Registered queries of the semantic and relational operators, and their SQL twins."""

from __future__ import annotations

import os
import sqlite3

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import rules
from .agentic.corpus import Corpus, derive_plan
from .cascade import CascadeArgs
from .engine import Engine
from .functions import context
from .functions.prompts import Strategy, row_prompt
from .functions.serialize import row_text
from .operators.aggregation import sem_agg, sem_partition_by
from .operators.joins import sem_join
from .operators.ranking import sem_topk
from .operators.rowwise import llm_as_judge, pairwise_judge, sem_extract, sem_filter, sem_map
from .operators.vectors import TableStore, embed_column, load_sem_index, sem_cluster_by, sem_dedup, sem_index, sem_search, sem_sim_join
from .plans.lazy import LazyFrame, function, register_udaf, register_udtf
from .sources.connect import load_files, load_from_db
from .sources.web import extract_html
from .streaming.windows import read_stream, run_available, sem_stream, sessions, tumbling

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def wrap(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return wrap


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _engine(spark: SparkSession) -> Engine:
    return Engine(spark, rules.backend(), rules.helper())


RING = "regexp_matches(p_name, '\\bring\\b')"


@query(f"SELECT p_brand, count(*) AS n FROM part WHERE p_size >= 10 AND {RING} GROUP BY p_brand")
def q_filter(spark, d):
    part = _t(spark, d, "part").where("p_size >= 10").select("p_brand", "p_name")
    return sem_filter(_engine(spark), part, "{p_name} names a ring").groupBy("p_brand").agg(F.count("*").alias("n"))


@query(f"SELECT p_partkey, {RING} AS verdict FROM part")
def q_filter_return_all(spark, d):
    return sem_filter(_engine(spark), _t(spark, d, "part").select("p_partkey", "p_name"), "{p_name} names a ring", return_all=True).select("p_partkey", F.col("_filter").alias("verdict"))


@query("SELECT p_partkey, lower(substr(p_type, 1, 1)) AS letter FROM part")
def q_map(spark, d):
    return sem_map(_engine(spark), _t(spark, d, "part").select("p_partkey", "p_type"), "Give the first letter of {p_type}", suffix="letter").select("p_partkey", "letter")


@query("SELECT event_id, props->>'$.k' AS k FROM events")
def q_extract(spark, d):
    return sem_extract(_engine(spark), _t(spark, d, "events").select("event_id", "props"), ["props"], {"k": None}).select("event_id", "k")


@query("SELECT doc_id, CASE WHEN n_chars >= 1500 THEN 'long' ELSE 'short' END AS judge_0, CASE WHEN n_chars >= 1500 THEN 'long' ELSE 'short' END AS judge_1 FROM documents")
def q_judge(spark, d):
    return llm_as_judge(_engine(spark), _t(spark, d, "documents").select("doc_id", "n_chars"), "Is a text of {n_chars} characters long or short?", n_trials=2, suffix="judge").select("doc_id", "judge_0", "judge_1")


PAIR = "CASE WHEN length(p_name) >= length(p_type) THEN 'A' ELSE 'B' END"


@query(f"SELECT p_partkey, {PAIR} AS v_0 FROM part")
def q_pairwise(spark, d):
    return pairwise_judge(_engine(spark), _t(spark, d, "part").select("p_partkey", "p_name", "p_type"), "p_name", "p_type", "Prefer the longer text.", suffix="v").select("p_partkey", "v_0")


@query(f"SELECT p_partkey, {PAIR} AS v_0, {PAIR} AS v_1 FROM part")
def q_pairwise_swapped(spark, d):
    return pairwise_judge(_engine(spark), _t(spark, d, "part").select("p_partkey", "p_name", "p_type"), "p_name", "p_type", "Prefer the longer text.", n_trials=2, permute_cols=True, suffix="v").select("p_partkey", "v_0", "v_1")


JOINED = "SELECT r_name, p_type, count(*) AS n FROM part, region WHERE contains(r_name, substr(p_type, 1, 1)) GROUP BY ALL"


@query(JOINED)
def q_join_full(spark, d):
    out = sem_join(_engine(spark), _t(spark, d, "part").select("p_partkey", "p_type"), _t(spark, d, "region"), "{p_type} has a letter of {r_name}")
    return out.groupBy("r_name", "p_type").agg(F.count("*").alias("n"))


@query(JOINED)
def q_join_cascade(spark, d):
    args = CascadeArgs(proxy="embedding", fixed=(2.0, -1.0), plan="search_filter", min_join_size=1)
    out = sem_join(_engine(spark), _t(spark, d, "part").select("p_partkey", "p_type"), _t(spark, d, "region"), "{p_type} has a letter of {r_name}", cascade=args)
    return out.groupBy("r_name", "p_type").agg(F.count("*").alias("n"))


@query(f"SELECT p_partkey FROM part WHERE CASE WHEN p_size / 50 >= 0.8 THEN true WHEN p_size / 50 <= 0.2 THEN false ELSE {RING} END")
def q_filter_cascade_fixed(spark, d):
    args = CascadeArgs(fixed=(0.8, 0.2), calibrated=False)
    return sem_filter(_engine(spark), _t(spark, d, "part").select("p_partkey", "p_name", "p_size"), "{p_name} of size {p_size} is big or a ring", cascade=args).select("p_partkey")


@query()
def q_filter_cascade_learned(spark, d):
    args = CascadeArgs(recall_target=0.9, precision_target=0.9, sampling_percentage=0.5, seed=7, calibrated=False)
    return sem_filter(_engine(spark), _t(spark, d, "part").select("p_partkey", "p_name", "p_size"), "{p_name} of size {p_size} is big or a ring", cascade=args).select("p_partkey")


def _first_vector(spark, d) -> list[float]:
    return [float(x) for x in _t(spark, d, "embeddings").where("vec_id = 0").first()["embedding"]]


DOT = "list_inner_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0))"


@query(f"SELECT vec_id, round({DOT}, 9) AS score FROM embeddings ORDER BY {DOT} DESC, vec_id LIMIT 10")
def q_search(spark, d):
    out = sem_search(_engine(spark), _t(spark, d, "embeddings"), _first_vector(spark, d), 10, "embedding", "vec_id", return_scores=True)
    return out.select("vec_id", F.round("vec_scores_sim_score", 9).alias("score"))


@query(f"SELECT vec_id, round({DOT}, 9) AS score FROM embeddings WHERE label = 3 ORDER BY {DOT} DESC, vec_id LIMIT 10")
def q_search_filtered(spark, d):
    out = sem_search(_engine(spark), _t(spark, d, "embeddings").where("label = 3"), _first_vector(spark, d), 10, "embedding", "vec_id", return_scores=True)
    return out.select("vec_id", F.round("vec_scores_sim_score", 9).alias("score"))


PAIRS = "SELECT a.vec_id AS l, b.vec_id AS r, list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a, embeddings b"


@query(f"SELECT l, r, round(s, 6) AS score FROM ({PAIRS}) QUALIFY row_number() OVER (PARTITION BY l ORDER BY s DESC, r) <= 3")
def q_sim_join(spark, d):
    e = _t(spark, d, "embeddings").select("vec_id", "embedding")
    out = sem_sim_join(e, e, "vec_id", "vec_id", 3, "embedding", "embedding", keep_index=True)
    return out.select(F.col("_left_id").alias("l"), F.col("_right_id").alias("r"), F.round("_scores", 6).alias("score"))


@query(f"WITH RECURSIVE e AS (SELECT l, r FROM ({PAIRS}) WHERE s > 0.3 AND l <> r), reach(id, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT e.r, reach.root FROM reach JOIN e ON e.l = reach.id WHERE reach.root < e.r) SELECT id AS vec_id FROM reach GROUP BY id HAVING min(root) = id")
def q_dedup(spark, d):
    return sem_dedup(_engine(spark), _t(spark, d, "embeddings").select("vec_id", "embedding"), "vec_id", 0.3, "vec_id", "embedding").select("vec_id")


def _nearest(centers: str) -> str:
    return f"(SELECT arg_min(c.i, (list_inner_product(c.v, c.v) - 2 * list_inner_product(e.embedding::DOUBLE[], c.v), c.i)) FROM {centers} c)"


@query(f"""WITH c0 AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS i, embedding::DOUBLE[] AS v FROM embeddings ORDER BY vec_id LIMIT 10),
a0 AS (SELECT e.embedding, {_nearest('c0')} AS i FROM embeddings e),
m AS (SELECT i, j, avg(embedding[j]::DOUBLE) AS x FROM a0, range(1, 65) t(j) GROUP BY i, j),
c1 AS (SELECT i, list(x ORDER BY j) AS v FROM m GROUP BY i UNION ALL SELECT i, v FROM c0 WHERE i NOT IN (SELECT i FROM m))
SELECT vec_id, CAST({_nearest('c1')} AS INTEGER) AS cluster_id FROM embeddings e""")
def q_cluster(spark, d):
    return sem_cluster_by(_t(spark, d, "embeddings"), 10, "embedding", "vec_id", niter=1).select("vec_id", "cluster_id")


@query()
def q_cluster_rounds(spark, d):
    """The whole k-means, of the operator's 20 rounds; q_cluster is one round of it, which SQL can follow."""
    return sem_cluster_by(_t(spark, d, "embeddings"), 10, "embedding", "vec_id").select("vec_id", "cluster_id")


@query("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_nationkey) AS names FROM nation GROUP BY n_regionkey")
def q_agg_group(spark, d):
    return sem_agg(_engine(spark), _t(spark, d, "nation"), "List the values of {n_name}", suffix="names", group_by=["n_regionkey"], order_by=["n_nationkey"], budget=12)


@query("SELECT string_agg(n_name, ',' ORDER BY n_nationkey % 3, n_nationkey) AS names FROM nation")
def q_partition_agg(spark, d):
    parts = sem_partition_by(_t(spark, d, "nation"), F.col("n_nationkey") % 3)
    return sem_agg(_engine(spark), parts, "List the values of {n_name}", suffix="names", order_by=["n_nationkey"], budget=16)


TOP = "SELECT {key}, CAST(row_number() OVER (ORDER BY {by} DESC) AS INTEGER) AS rank FROM {table} ORDER BY {by} DESC LIMIT {k}"


@query(TOP.format(key="n_nationkey", by="n_nationkey", table="nation", k=5))
def q_topk_naive(spark, d):
    return sem_topk(_engine(spark), _t(spark, d, "nation"), "{n_nationkey}: the nation key is larger", 5, "naive", "n_nationkey", rank_col="rank").select("n_nationkey", "rank")


@query(TOP.format(key="s_suppkey", by="s_acctbal", table="supplier", k=5))
def q_topk_quick(spark, d):
    return sem_topk(_engine(spark), _t(spark, d, "supplier"), "{s_acctbal}: the balance is larger", 5, "quick", "s_suppkey", rank_col="rank").select("s_suppkey", "rank")


@query(TOP.format(key="r_regionkey", by="r_regionkey", table="region", k=2))
def q_topk_heap(spark, d):
    return sem_topk(_engine(spark), _t(spark, d, "region"), "{r_regionkey}: the region key is larger", 2, "heap", "r_regionkey", rank_col="rank").select("r_regionkey", "rank")


@query("SELECT n_nationkey, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey DESC) AS INTEGER) AS rank FROM nation QUALIFY rank <= 2")
def q_topk_grouped(spark, d):
    return sem_topk(_engine(spark), _t(spark, d, "nation"), "{n_nationkey}: the nation key is larger", 2, "naive", "n_nationkey", ["n_regionkey"], rank_col="rank").select("n_nationkey", "rank")


@query(TOP.format(key="n_nationkey", by="n_nationkey", table="nation", k=3))
def q_topk_cascade(spark, d):
    return sem_topk(_engine(spark), _t(spark, d, "nation"), "{n_nationkey}: the nation key is larger", 3, "naive", "n_nationkey", cascade_threshold=0.9, rank_col="rank").select("n_nationkey", "rank")


TOK = "string_split_regex(trim(text), '\\s+')"


@query(f"SELECT doc_id, CAST(c AS INTEGER) AS chunk, md5(array_to_string(list_slice({TOK}, c * 200 + 1, c * 200 + 200), ' ')) AS digest FROM documents, unnest(range(0, CAST(ceil(len({TOK}) / 200) AS BIGINT))) u(c) WHERE len({TOK}) > 200 UNION ALL SELECT doc_id, 0, md5(text) FROM documents WHERE len({TOK}) <= 200")
def q_chunk(spark, d):
    return context.chunk(_t(spark, d, "documents").select("doc_id", "text"), ["text"], 200).select("doc_id", "chunk", F.md5("text").alias("digest"))


@query(f"SELECT doc_id, md5(CASE WHEN len({TOK}) > 100 THEN array_to_string(list_slice({TOK}, 1, 100), ' ') || '...' ELSE text END) AS digest FROM documents")
def q_truncate(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.md5(context.truncate(F.col("text"), 100)).alias("digest"))


@query("SELECT n_nationkey, '[N_name]: «' || n_name || '»' || chr(10) || '[N_regionkey]: «' || n_regionkey || '»' || chr(10) AS doc FROM nation")
def q_serialize(spark, d):
    n = _t(spark, d, "nation")
    return n.select("n_nationkey", row_text(n, ["n_name", "n_regionkey"]).alias("doc"))


@query("SELECT conv_id, turn, lower('text: ' || text) AS finding FROM conversations")
def q_agentic_map(spark, d):
    c = _t(spark, d, "conversations")
    c = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("key"), "text")
    out = Corpus.from_dataframe(c, "key", ["text"]).agent("Lower-case it.", rules.agent, ["map"]).findings
    return out.select(F.floor(F.col("ord") / 1000).alias("conv_id"), (F.col("ord") % 1000).alias("turn"), F.col("content").alias("finding"))


@query("SELECT n_nationkey FROM nation WHERE contains(n_name, 'A')")
def q_agentic_filter(spark, d):
    got = Corpus.from_dataframe(_t(spark, d, "nation"), "n_nationkey", ["n_name"]).agent("Names with an A.", rules.agent, ["filter"])
    return got.corpus.units.select(F.col("ord").cast("int").alias("n_nationkey"))


@query("SELECT string_agg(lower('n_name: ' || n_name), '|' ORDER BY n_nationkey) AS answer FROM nation")
def q_agentic_reduce(spark, d):
    got = Corpus.from_dataframe(_t(spark, d, "nation"), "n_nationkey", ["n_name"]).agent("List them.", rules.agent, ["map", "reduce"])
    return spark.createDataFrame([(got.output,)], "answer string")


@query()
def q_html(spark, d):
    return extract_html(_t(spark, d, "pages"), "html").select("page_id", "full_text")


@query(f"SELECT p_brand, count(*) AS n FROM part WHERE p_size >= 10 AND p_retailprice < 950 AND {RING} GROUP BY p_brand")
def q_lazy_pushdown(spark, d):
    plan = LazyFrame(name="part").sem_filter(instruction="{p_name} names a ring").filter("p_size >= 10").filter("p_retailprice < 950").group_by("p_brand", n="count(*)")
    return plan.optimize().run(_engine(spark), {"part": _t(spark, d, "part").select("p_brand", "p_name", "p_size", "p_retailprice")})


def _rel(sql: str, *tables: str):
    """A relational query through a lazy plan: fn maps plans by table to a plan."""

    def wrap(fn):
        def run(spark, d):
            plans = [LazyFrame(name=t) for t in tables]
            return fn(*plans).run(Engine(spark), {t: _t(spark, d, t) for t in tables})

        run.__name__ = fn.__name__
        return query(sql)(run)

    return wrap


@_rel("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, count(*) AS n, round(avg(l_discount), 9) AS avg_disc FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL", "lineitem")
def q_rel_aggregate(li):
    return li.filter("l_shipdate <= timestamp'1998-09-02'").group_by("l_returnflag", "l_linestatus", sum_qty="sum(l_quantity)", n="count(*)", avg_disc="round(avg(l_discount), 9)")


@_rel("SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name", "orders", "customer", "nation")
def q_rel_join(orders, customer, nation):
    c = customer.rename(c_custkey="o_custkey").join(nation.rename(n_nationkey="c_nationkey"), ["c_nationkey"])
    return orders.join(c, ["o_custkey"]).group_by("n_name", n="count(*)", total="round(sum(o_totalprice), 2)")


@_rel("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)", "customer", "orders")
def q_rel_semi(customer, orders):
    return customer.join(orders.rename(o_custkey="c_custkey"), ["c_custkey"], "left_semi").select("c_custkey")


@_rel("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)", "customer", "orders")
def q_rel_anti(customer, orders):
    return customer.join(orders.rename(o_custkey="c_custkey"), ["c_custkey"], "left_anti").select("c_custkey")


@_rel("SELECT s_suppkey, c_custkey FROM (SELECT s_suppkey, s_nationkey AS k FROM supplier WHERE s_nationkey < 3) FULL JOIN (SELECT c_custkey, c_nationkey AS k FROM customer WHERE c_nationkey BETWEEN 2 AND 4) USING (k)", "supplier", "customer")
def q_rel_outer(supplier, customer):
    return supplier.filter("s_nationkey < 3").rename(s_nationkey="k").join(customer.filter("c_nationkey BETWEEN 2 AND 4").rename(c_nationkey="k"), ["k"], "full").select("s_suppkey", "c_custkey")


@_rel("SELECT r_name, n_name FROM region CROSS JOIN nation", "region", "nation")
def q_rel_cross(region, nation):
    return region.join(nation, [], "cross").select("r_name", "n_name")


@_rel("SELECT o_custkey, o_orderkey, row_number() OVER w AS rn, lag(o_totalprice) OVER w AS before, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS rk FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)", "orders")
def q_rel_window(orders):
    return orders.sql("SELECT o_custkey, o_orderkey, CAST(row_number() OVER w AS BIGINT) AS rn, lag(o_totalprice) OVER w AS before, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT) AS rk FROM {this} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")


@_rel("SELECT n_regionkey, n_nationkey % 2 AS odd, count(*) AS n FROM nation GROUP BY ROLLUP (n_regionkey, odd)", "nation")
def q_rel_rollup(nation):
    return nation.with_columns(odd="n_nationkey % 2").group_by("n_regionkey", "odd", sets="rollup", n="count(*)")


@_rel("SELECT n_regionkey, n_nationkey % 2 AS odd, count(*) AS n FROM nation GROUP BY CUBE (n_regionkey, odd)", "nation")
def q_rel_cube(nation):
    return nation.with_columns(odd="n_nationkey % 2").group_by("n_regionkey", "odd", sets="cube", n="count(*)")


@_rel("SELECT DISTINCT c_nationkey FROM customer INTERSECT SELECT DISTINCT s_nationkey FROM supplier", "customer", "supplier")
def q_rel_intersect(customer, supplier):
    return customer.select("c_nationkey").concat(supplier.select("s_nationkey AS c_nationkey"), "intersect")


@_rel("SELECT c_nationkey FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier", "customer", "supplier")
def q_rel_except_all(customer, supplier):
    return customer.select("c_nationkey").concat(supplier.select("s_nationkey AS c_nationkey"), "except_all")


@_rel("SELECT r_name AS name, NULL::INTEGER AS n_regionkey FROM region UNION ALL SELECT n_name, n_regionkey FROM nation", "region", "nation")
def q_rel_concat(region, nation):
    return region.select("r_name AS name").concat(nation.select("n_name AS name", "n_regionkey"))


@_rel("SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part", "part")
def q_rel_explode(part):
    return part.explode("split(p_name, ' ')", "word").select("p_partkey", "word")


@_rel("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5", "orders")
def q_rel_topn(orders):
    return orders.sort("o_totalprice desc", "o_orderkey").limit(10, 5).select("o_orderkey", "o_totalprice")


@_rel("SELECT DISTINCT p_brand, p_type FROM part", "part")
def q_rel_distinct(part):
    return part.select("p_brand", "p_type").distinct()


@_rel("SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events", "events")
def q_rel_json(events):
    return events.select("event_id", "from_json(props, 'k bigint').k AS k")


@query("SELECT e.event_id, p.event_id AS last_purchase FROM events e ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts) p ON e.user_id = p.user_id AND e.ts >= p.ts")
def q_rel_asof(spark, d):
    """The last purchase at or before each event of its user: one window, no join."""
    e = _t(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    w = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, 0)
    last = F.max(F.when(F.col("event_type") == "purchase", F.struct("ts", "event_id"))).over(w)
    return e.select("event_id", last["event_id"].alias("last_purchase"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def q_stream_window(spark, d):
    """The same plan that runs on a stream, over the whole table."""
    out = tumbling(_t(spark, d, "events"), "ts", "1 hour", ["event_type"], n="count(*)", total="round(sum(value), 4)")
    return out.select("window_start", "event_type", "n", "total")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def q_stream_counts(spark, d):
    """A real stream over the file, drained and read from its memory table."""
    schema = _t(spark, d, "events").schema
    s = read_stream(spark, f"{d}/", schema, pathGlobFilter="events.parquet").groupBy("event_type").agg(F.count("*").alias("n"))
    return run_available(s, "sembra_counts", "complete")


@query("WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, k")
def q_sessions(spark, d):
    return sessions(_t(spark, d, "events"), "ts", "30 minutes", ["user_id"], n="count(*)").select("user_id", "session_start", "n")


def _database(spark: SparkSession) -> str:
    """A path for a new SQLite file in the shared folder, which must be one that processes open as files."""
    path = Engine(spark).shared_path("source-db")
    if "://" in path and not path.startswith("file://"):
        raise ValueError(f"a database file can't be in {path}")
    path = path.removeprefix("file://")
    os.makedirs(path)
    return os.path.join(path, "t.db")


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
def q_source_db(spark, d):
    path = _database(spark)
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE nation (n_nationkey INTEGER, n_name TEXT, n_regionkey INTEGER)")
    con.executemany("INSERT INTO nation VALUES (?, ?, ?)", [tuple(r) for r in _t(spark, d, "nation").collect()])
    con.commit()
    con.close()
    return load_from_db(spark, f"sqlite:///{path}", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")


def _round_trip(kind: str):
    def run(spark, d):
        path = Engine(spark).shared_path(f"source-{kind}")
        df = _t(spark, d, "supplier")
        writer = df.write.options(header=True, sep="\t" if kind == "txt" else ",")
        getattr(writer, "csv" if kind == "txt" else kind)(path)
        return load_files(spark, path, kind).selectExpr("CAST(s_suppkey AS BIGINT) AS s_suppkey", "s_name", "CAST(s_nationkey AS INT) AS s_nationkey", "s_acctbal")

    run.__name__ = f"q_source_{kind}"
    return query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")(run)


for _kind in ("csv", "json", "parquet", "txt"):
    _round_trip(_kind)


# cascades that split three ways

LETTERS = "list_distinct(list_filter(string_split(lower({}), ''), lambda c: c >= 'a' AND c <= 'z'))"


def _shared(a: str, b: str) -> str:
    return f"len(list_intersect({LETTERS.format(a)}, {LETTERS.format(b)})) / 16.0"


def _letters(spark: SparkSession) -> Engine:
    return _engine(spark).with_(embedder=rules.LetterEmbedder())


PLACE = "(SELECT count(*) FROM (SELECT unnest([v[greatest(1, CAST(ceil(i / 10 * len(v)) AS BIGINT))] FOR i IN range(0, 11)]) AS e FROM (SELECT list_sort(list(p_size / 50)) AS v FROM part)) WHERE e <= p_size / 50)"


@query(f"WITH c AS (SELECT p_partkey, p_name, least(1, greatest(0, ({PLACE} - 1) / 10)) AS score FROM part) SELECT p_partkey FROM c WHERE CASE WHEN score >= 0.8 THEN true WHEN score <= 0.2 THEN false ELSE {RING} END")
def q_filter_cascade_calibrated(spark, d):
    """The helper's scores by their place among quantiles of all rows; thresholds are in that scale."""
    args = CascadeArgs(fixed=(0.8, 0.2), quantiles=10)
    return sem_filter(_engine(spark), _t(spark, d, "part").select("p_partkey", "p_name", "p_size"), "{p_name} of size {p_size} is big or a ring", cascade=args).select("p_partkey")


@query(f"WITH c AS (SELECT p_partkey, p_name, {_shared('p_name', repr('p_name names a ring'))} AS score FROM part) SELECT p_partkey FROM c WHERE CASE WHEN score >= 0.5 THEN true WHEN score <= 0.25 THEN false ELSE {RING} END")
def q_filter_cascade_embedding(spark, d):
    args = CascadeArgs(proxy="embedding", fixed=(0.5, 0.25))
    return sem_filter(_letters(spark), _t(spark, d, "part").select("p_partkey", "p_name"), "{p_name} names a ring", cascade=args).select("p_partkey")


PAIR_SCORE = _shared("'[P_type]: ' || p_type", "'[R_name]: ' || r_name")


@query(f"WITH c AS (SELECT p_type, r_name, {PAIR_SCORE} AS score FROM part, region) SELECT r_name, p_type, count(*) AS n FROM c WHERE CASE WHEN score >= 0.4375 THEN true WHEN score <= 0.25 THEN false ELSE contains(r_name, substr(p_type, 1, 1)) END GROUP BY ALL")
def q_join_cascade_three_ways(spark, d):
    """Close pairs are joined by the proxy, far ones never leave their block, the model is asked about the others."""
    args = CascadeArgs(proxy="embedding", fixed=(0.4375, 0.25), plan="search_filter", min_join_size=1)
    out = sem_join(_letters(spark), _t(spark, d, "part").select("p_partkey", "p_type"), _t(spark, d, "region"), "{p_type} has a letter of {r_name}", cascade=args)
    return out.groupBy("r_name", "p_type").agg(F.count("*").alias("n"))


@query(f"WITH c AS (SELECT p_type, r_name, {_shared('p_type', repr('[R_name]: ') + ' || r_name')} AS score FROM part, region) SELECT r_name, p_type, count(*) AS n FROM c WHERE CASE WHEN score >= 0.3125 THEN true WHEN score <= 0.0625 THEN false ELSE contains(r_name, substr(p_type, 1, 1)) END GROUP BY ALL")
def q_join_cascade_mapped(spark, d):
    """The left side is mapped to what would match (here its own type), then searched."""
    args = CascadeArgs(proxy="embedding", fixed=(0.3125, 0.0625), plan="map_search_filter", min_join_size=1)
    out = sem_join(_letters(spark), _t(spark, d, "part").select("p_partkey", "p_type"), _t(spark, d, "region"), "{p_type} has a letter of {r_name}", cascade=args)
    return out.groupBy("r_name", "p_type").agg(F.count("*").alias("n"))


@query(TOP.format(key="n_nationkey", by="n_nationkey", table="nation", k=6))
def q_topk_cascade_unsure(spark, d):
    """The helper is wrong about close keys and says that it is unsure, so only the large model gives this order."""
    return sem_topk(_engine(spark), _t(spark, d, "nation"), "{n_nationkey}: the nation key is bigger", 6, "quick", "n_nationkey", cascade_threshold=0.9, rank_col="rank").select("n_nationkey", "rank")


@query(TOP.format(key="n_nationkey", by="n_nationkey", table="nation", k=4))
def q_topk_heap_nations(spark, d):
    return sem_topk(_engine(spark), _t(spark, d, "nation"), "{n_nationkey}: the nation key is larger", 4, "heap", "n_nationkey", rank_col="rank").select("n_nationkey", "rank")


@query(TOP.format(key="n_nationkey", by="n_nationkey", table="nation", k=5))
def q_topk_quick_sem(spark, d):
    """From a first order that is given (here of the name's length), pivots by that order."""
    nation = _t(spark, d, "nation")
    order = nation.select("n_nationkey", F.length("n_name").cast("double"))
    return sem_topk(_engine(spark), nation, "{n_nationkey}: the nation key is larger", 5, "quick-sem", "n_nationkey", sem_order=order, rank_col="rank").select("n_nationkey", "rank")


# indexes, search, reranking

SOUGHT = "Algeria and Brazil"


@query(f"SELECT n_nationkey, {_shared('n_name', repr(SOUGHT))} AS score FROM nation ORDER BY score DESC, n_nationkey LIMIT 5")
def q_index_search(spark, d):
    """An index that is written, loaded by id and searched by text."""
    engine, nation = _letters(spark), _t(spark, d, "nation")
    path = engine.shared_path("index")
    sem_index(engine, nation, "n_name", path, "n_nationkey")
    found = sem_search(engine, load_sem_index(engine, nation, path, "n_nationkey"), SOUGHT, 5, id_col="n_nationkey", return_scores=True)
    return found.select("n_nationkey", F.col("vec_scores_sim_score").alias("score"))


@query("SELECT p_partkey FROM part ORDER BY CAST(regexp_matches(p_name, '\\bring\\b') AS INT) + CAST(regexp_matches(p_name, '\\bgold\\b') AS INT) DESC, " + _shared("p_name", "'gold ring'") + " DESC, p_partkey LIMIT 15")
def q_rerank(spark, d):
    """Every row is reranked; equal scores by similarity, then id."""
    engine = _letters(spark)
    part = embed_column(engine, _t(spark, d, "part").select("p_partkey", "p_name"), "p_name")
    return sem_search(engine, part, "gold ring", id_col="p_partkey", n_rerank=15, text_col="p_name").select("p_partkey")


@query(f"SELECT l, r, round(s, 6) AS score FROM ({PAIRS}) WHERE l % 50 = 0 QUALIFY row_number() OVER (PARTITION BY l ORDER BY s DESC, r) <= 4")
def q_store_search(spark, d):
    """A vector store by cells; with all cells probed the result is exact."""
    store = TableStore(spark, cells=6, probes=6)
    vectors = _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))
    store.index(vectors, _engine(spark).shared_path("store"))
    return store.search(vectors.where("id % 50 = 0"), 4).select(F.col("lid").alias("l"), F.col("rid").alias("r"), F.round("score", 6).alias("score"))


@query(f"SELECT l, r, round(s, 6) AS score FROM ({PAIRS}) WHERE l < 20 AND r % 7 = 0 QUALIFY row_number() OVER (PARTITION BY l ORDER BY s DESC, r) <= 2")
def q_store_search_ids(spark, d):
    """Search among given ids only."""
    store = TableStore(spark)
    vectors = _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))
    store.index(vectors, _engine(spark).shared_path("store"))
    return store.search(vectors.where("id < 20"), 2, vectors.where("id % 7 = 0")).select(F.col("lid").alias("l"), F.col("rid").alias("r"), F.round("score", 6).alias("score"))


# reasoning, quotes, estimates, caches


@query(f"SELECT p_partkey, {RING} AS verdict, 'read ' || p_name AS why FROM part")
def q_filter_explained(spark, d):
    out = sem_filter(_engine(spark), _t(spark, d, "part").select("p_partkey", "p_name"), "{p_name} names jewellery", return_all=True, strategy="zs_cot", return_explanations=True)
    return out.select("p_partkey", F.col("_filter").alias("verdict"), F.col("explanation_filter").alias("why"))


@query("SELECT p_partkey, lower(substr(p_type, 1, 1)) AS letter, 'It is ' || p_type || '.' AS thought FROM part")
def q_map_thought(spark, d):
    out = sem_map(_engine(spark), _t(spark, d, "part").select("p_partkey", "p_type"), "Give the first letter, after a thought, of {p_type}", suffix="letter", return_explanations=True)
    return out.select("p_partkey", "letter", F.col("explanationletter").alias("thought"))


@query("SELECT event_id, props->>'$.k' AS k, props AS quote, 'x' AS more FROM events")
def q_extract_quotes(spark, d):
    out = sem_extract(_engine(spark), _t(spark, d, "events").select("event_id", "props"), ["props"], {"k": None}, extract_quotes=True, extra_col="rest")
    return out.select("event_id", "k", F.col("k_quote").alias("quote"), F.col("rest")["more"].alias("more"))


@query(f"SELECT p_partkey, {PAIR} AS v_0, length(p_name) || ' to ' || length(p_type) AS why FROM part")
def q_pairwise_explained(spark, d):
    out = pairwise_judge(_engine(spark), _t(spark, d, "part").select("p_partkey", "p_name", "p_type"), "p_name", "p_type", "Prefer the longer text and say why.", suffix="v", strategy="zs_cot", return_explanations=True)
    return out.select("p_partkey", "v_0", F.col("explanationv_0").alias("why"))


@query("SELECT count(DISTINCT p_name) AS calls FROM part WHERE p_size >= 10")
def q_estimate(spark, d):
    """What a filter would ask, without asking."""
    engine, part = _engine(spark), _t(spark, d, "part").where("p_size >= 10")
    got = engine.estimate(part, row_prompt(part, "filter", "{p_name} names a ring", "default", Strategy.DEFAULT))
    return spark.createDataFrame([(got["calls"],)], "calls long")


@query("SELECT 1 AS hits, count(DISTINCT p_type) AS calls, count(*) AS n FROM part")
def q_operator_cache(spark, d):
    """The second run of an operator on a frame of equal content is a hit and asks nothing."""
    engine = _engine(spark).with_(use_operator_cache=True)
    ask = "Give the first letter of {p_type}"
    sem_map(engine, _t(spark, d, "part").select("p_partkey", "p_type"), ask)
    again = sem_map(engine, _t(spark, d, "part").select("p_partkey", "p_type").repartition(3), ask)
    return again.agg(F.lit(engine.usage.operator_cache_hits).alias("hits"), F.lit(engine.usage.calls).cast("long").alias("calls"), F.count("*").alias("n"))


# serialisation, corpora


@query("SELECT n_nationkey, '{\"N_name\":\"' || n_name || '\",\"N_regionkey\":' || n_regionkey || '}' AS doc FROM nation")
def q_serialize_json(spark, d):
    n = _t(spark, d, "nation")
    return n.select("n_nationkey", row_text(n, ["n_name", "n_regionkey"], "json").alias("doc"))


@query("SELECT n_nationkey, '<row><N_name>' || n_name || '</N_name><N_regionkey>' || n_regionkey || '</N_regionkey></row>' AS doc FROM nation")
def q_serialize_xml(spark, d):
    n = _t(spark, d, "nation")
    return n.select("n_nationkey", row_text(n, ["n_name", "n_regionkey"], "xml").alias("doc"))


@query("SELECT n_nationkey, (row_number() OVER (ORDER BY n_nationkey) - 1) // 4 AS shard FROM nation")
def q_corpus_shards(spark, d):
    got = Corpus.from_dataframe(_t(spark, d, "nation"), "n_nationkey", ["n_name"]).shards(4)
    return got.select(F.col("ord").cast("int").alias("n_nationkey"), "shard")


@query("SELECT n_nationkey, lower('n_name: ' || n_name) || ' of 25' AS finding FROM nation")
def q_agentic_shared(spark, d):
    """Agents that each see one unit and a digest of the corpus."""
    plan = derive_plan("Lower-case it.", ["map"], overrides={"strategies": {"map": "shared_context"}})
    got = Corpus.from_dataframe(_t(spark, d, "nation"), "n_nationkey", ["n_name"]).agent("Lower-case it.", rules.agent_with_background, plan=plan)
    return got.findings.select(F.col("ord").cast("int").alias("n_nationkey"), F.col("content").alias("finding"))


@query("SELECT n_nationkey, lower('n_name: ' || n_name) AS finding FROM nation")
def q_agentic_batched(spark, d):
    plan = derive_plan("Lower-case them.", ["map"], overrides={"strategies": {"map": "batched"}, "shard_size": 6})
    got = Corpus.from_dataframe(_t(spark, d, "nation"), "n_nationkey", ["n_name"]).agent("Lower-case them.", rules.agent_of_batches, plan=plan)
    return got.findings.select(F.col("ord").cast("int").alias("n_nationkey"), F.col("content").alias("finding"))


@query("SELECT string_agg(lower('n_name: ' || n_name), '|' ORDER BY n_nationkey) AS answer FROM nation")
def q_agentic_reduce_levels(spark, d):
    """As q_agentic_reduce, with a budget that takes several levels."""
    got = Corpus.from_dataframe(_t(spark, d, "nation"), "n_nationkey", ["n_name"]).agent("List them.", rules.agent, ["map", "reduce"], reduce_budget=600)
    return spark.createDataFrame([(got.output,)], "answer string")


# plans

FIXED = f"SELECT p_partkey FROM part WHERE CASE WHEN p_size / 50 >= 0.8 THEN true WHEN p_size / 50 <= 0.2 THEN false ELSE {RING} END"


@query(FIXED)
def q_plan_document(spark, d):
    """A plan with a cascade, through its JSON document and with a step's instruction patched."""
    args = CascadeArgs(fixed=(0.8, 0.2), calibrated=False, helper_instruction="{p_name} is big")
    plan = LazyFrame(name="part").sem_filter(instruction="{p_name} of size {p_size} is big or a ring", cascade=args).select("p_partkey")
    loaded = LazyFrame.from_json(plan.to_json()).patched({"/0.cascade.helper_instruction": "{p_name} of size {p_size} is big or a ring"})
    return loaded.run(_engine(spark), {"part": _t(spark, d, "part").select("p_partkey", "p_name", "p_size")})


@_rel("SELECT n_regionkey, n_nationkey % 2 AS odd, count(*) AS n FROM nation GROUP BY GROUPING SETS ((n_regionkey), (odd), ())", "nation")
def q_rel_grouping_sets(nation):
    return nation.with_columns(odd="n_nationkey % 2").group_by("n_regionkey", "odd", sets=[["n_regionkey"], ["odd"], []], n="count(*)")


@_rel("WITH a AS (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) AS i FROM nation), b AS (SELECT s_name, row_number() OVER (ORDER BY s_suppkey) AS i FROM supplier) SELECT n_name, s_name FROM a FULL JOIN b USING (i)", "nation", "supplier")
def q_rel_beside(nation, supplier):
    return nation.concat_columns(supplier, ["n_nationkey"], ["s_suppkey"]).select("n_name", "s_name")


@_rel("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')", "customer", "orders")
def q_rel_anti_urgent(customer, orders):
    return customer.join(orders.filter("o_orderpriority = '1-URGENT'").rename(o_custkey="c_custkey"), ["c_custkey"], "left_anti").select("c_custkey")


def _spread(x) -> float:
    return float(x.max() - x.min())


@query("SELECT c_nationkey, round(max(c_acctbal) - min(c_acctbal), 6) AS spread FROM customer GROUP BY c_nationkey")
def q_udaf(spark, d):
    """A registered aggregate of pandas series."""
    engine = _engine(spark)
    register_udaf(engine, "spread", _spread)
    return LazyFrame(name="customer").group_by("c_nationkey", spread="round(spread(c_acctbal), 6)").run(engine, {"customer": _t(spark, d, "customer")})


class Words:
    """A table function: the words of a text and their places."""

    def eval(self, text: str):
        for i, w in enumerate(text.split(" ")):
            yield i, w


@query("SELECT p_partkey, CAST(i AS INTEGER) AS place, w[i + 1] AS word FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part), unnest(range(0, len(w))) u(i)")
def q_udtf(spark, d):
    engine = _engine(spark)
    register_udtf(engine, "words_of", Words, "place int, word string")
    return LazyFrame(name="part").select("p_partkey", "p_name").table_function("words_of", "p_name").select("p_partkey", "place", "word").run(engine, {"part": _t(spark, d, "part")})


@function("doubled")
def _doubled(engine, *frames):
    """Rows of all frames, twice."""
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out.union(out)


@query("SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT n_name FROM nation UNION ALL SELECT r_name FROM region")
def q_from_fn(spark, d):
    plan = LazyFrame.from_fn("doubled", LazyFrame(name="nation").select("n_name AS name"), LazyFrame(name="region").select("r_name AS name"))
    return plan.run(_engine(spark), {"nation": _t(spark, d, "nation"), "region": _t(spark, d, "region")})


# sources and streams


@query("SELECT s_suppkey, s_name, s_nationkey::BIGINT AS s_nationkey, s_acctbal FROM supplier")
def q_source_db_ranges(spark, d):
    """A table by ranges of its rowid; whole balances are integers in the file, so types must come from all rows."""
    path = _database(spark)
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE supplier (s_suppkey, s_name, s_nationkey, s_acctbal)")
    for part in _t(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal").toLocalIterator():
        con.execute("INSERT INTO supplier VALUES (?, ?, ?, ?)", (*part[:3], int(part[3]) if part[3] == int(part[3]) else part[3]))
    con.commit()
    con.close()
    return load_from_db(spark, f"sqlite:///{path}", table="supplier", partitions=4)


@query(f"SELECT p_partkey FROM part WHERE {RING}")
def q_sem_stream(spark, d):
    """A model filter on a stream, batch by batch."""
    engine = _engine(spark)
    sink = engine.shared_path("sem-stream")
    stream = read_stream(spark, f"{d}/", _t(spark, d, "part").schema, pathGlobFilter="part.parquet")
    step = lambda e, rows: sem_filter(e, rows.select("p_partkey", "p_name"), "{p_name} names a ring")
    sem_stream(engine, stream, step, sink, engine.shared_path("sem-stream-checkpoint")).awaitTermination()
    return spark.read.parquet(sink).select("p_partkey")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
