"""Vectors: embedding, index tables, search, similarity joins, deduplication, clustering.

Similarity is exact.  The right side of a join lies in the shared folder and is read from there block by
block by every task of the left side, so nothing is copied for pairs of blocks: what is shuffled and written
follows the rows.  A task keeps the K best of its own left rows, or hands on what lies over a threshold.
Scores that decide (at the edge of the K best, near a threshold) are summed again in the order of the
elements, so that equal vectors tie whatever block they are in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..engine import Engine
from ..storage import shared_path

BLOCK_ROWS = 4096
#: Left rows that meet a block at once, which bounds a task's matrix of scores; and parts of a side for links.
LEFT_ROWS, TILE_PARTS = 512, 12


def similarity(vec: Column, query: list[float]) -> Column:
    """Inner product with a constant vector, in the order of the elements, in doubles."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return F.aggregate(F.zip_with(vec.cast("array<double>"), q, lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)


def embed_column(engine: Engine, df: DataFrame, col: str, out: str = "_vec") -> DataFrame:
    """df with the vector of a text column; equal texts are embedded once per batch."""
    model = engine.embedder

    @F.pandas_udf("array<double>")
    def embed(s: pd.Series) -> pd.Series:
        distinct = s.fillna("").unique().tolist()
        at = dict(zip(distinct, model.embed(distinct)))
        return s.fillna("").map(lambda t: at[t].tolist())

    return df.withColumn(out, embed.asNondeterministic()(F.col(col)))


def sem_index(engine: Engine, df: DataFrame, col: str, path: str, id_col: str) -> None:
    """Write the index of a column: (id, vec), one row per row of df with an id."""
    embed_column(engine, df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(col).alias("_text")), "_text", "vec").select("id", "vec").write.parquet(path)


def load_sem_index(engine: Engine, df: DataFrame, path: str, id_col: str, out: str = "_vec") -> DataFrame:
    """df with the vectors of an index, by id."""
    index = engine.spark.read.parquet(path).select(F.col("id").alias(id_col), F.col("vec").alias(out))
    return df.join(index, id_col)


def sem_search(engine: Engine, df: DataFrame, query: str | list[float], K: int | None = None, vec_col: str = "_vec", id_col: str = "id", n_rerank: int | None = None, text_col: str | None = None, return_scores: bool = False, suffix: str = "_sim_score") -> DataFrame:
    """The K rows nearest to the query (ties by id); filter df first, as only its rows are scored.

    n_rerank: of these, or without K of all rows, the n best by the reranker over text_col.
    """
    if K is None and n_rerank is None:
        raise ValueError("K or n_rerank is needed")
    vector = engine.embedder.embed([query])[0].tolist() if isinstance(query, str) else list(query)
    name = "vec_scores" + suffix
    out = df.withColumn(name, similarity(F.col(vec_col), vector))
    if K is not None:
        out = out.orderBy(F.desc(name), id_col).limit(K)
    if n_rerank is not None:
        if not isinstance(query, str) or text_col is None:
            raise ValueError("reranking needs a text query and text_col")
        ranker = engine.reranker

        @F.pandas_udf("double")
        def score(s: pd.Series) -> pd.Series:
            return pd.Series(ranker.score(query, s.tolist()), dtype=float)

        out = out.withColumn("_rerank", score(F.col(text_col))).orderBy(F.desc("_rerank"), F.desc(name), id_col).limit(n_rerank).drop("_rerank")
    return out if return_scores else out.drop(name)


def _written(df: DataFrame, id_col: str, vec_col: str, by: Column, tasks: int | None = None, *more: Column) -> str:
    """The folder of (id, vec, more) of rows with a vector, one folder ``part=`` per value of ``by``."""
    path = shared_path(df.sparkSession, "vectors")
    rows = df.where(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"), by.alias("part"), *more)
    (rows.repartition(tasks, "part") if tasks else rows).write.partitionBy("part").parquet(path)
    return path


def _read(folder: str, more: tuple[str, ...] = ()) -> Iterator[tuple]:
    """(ids, vectors as a matrix, more columns) of a folder by blocks, in a worker; none where it isn't there."""
    from pyarrow import fs as kinds
    from pyarrow import parquet

    fs, path = kinds.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (kinds.LocalFileSystem(), folder)
    for f in sorted(fs.get_file_info(kinds.FileSelector(path, allow_not_found=True)), key=lambda f: f.path):
        if not f.path.endswith(".parquet"):
            continue
        with fs.open_input_file(f.path) as source:
            for batch in parquet.ParquetFile(source).iter_batches(BLOCK_ROWS, columns=["id", "vec", *more]):
                if len(batch):
                    ids, vecs = batch.column("id").to_numpy(zero_copy_only=False), batch.column("vec").flatten().to_numpy(zero_copy_only=False)
                    yield (ids, vecs.reshape(len(ids), -1), *[batch.column(c).to_pylist() for c in more])


def _parts(rows: int, spark) -> int:
    """Tasks of a left side: somewhat less than a block each, so that few take two; for few rows as many as there are cores."""
    return max(1, -(-rows // max(1, BLOCK_ROWS * 7 // 8)), min(spark.sparkContext.defaultParallelism, rows // 256))


def _exact(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Scores of pairs, summed in the order of the elements."""
    out = np.zeros(len(i))
    for d in range(a.shape[1]):
        out += a[i, d] * b[j, d]
    return out


def _slack(s: np.ndarray) -> float:
    return 1e-12 * (1 + float(np.abs(s).max(initial=0.0)))


def _over(a: np.ndarray, b: np.ndarray, above: float) -> np.ndarray:
    """Which pairs score over ``above``."""
    s = a @ b.T
    mask = s > above
    i, j = np.nonzero(np.abs(s - above) <= _slack(s))
    mask[i, j] = _exact(a, b, i, j) > above
    return mask


class _Nearest:
    """The K best of some left rows among the right blocks shown so far (ties by rid)."""

    def __init__(self, n: int, K: int):
        self.K = K
        self.row, self.rid, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.edge = np.full(n, -np.inf)

    def show(self, rows: np.ndarray, a: np.ndarray, rid: np.ndarray, b: np.ndarray) -> None:
        s = a @ b.T
        k = min(self.K, s.shape[1])
        edge = self.edge[rows]
        new = np.flatnonzero(s.max(axis=1) >= edge - _slack(s))  # rows for which this block has anything
        if not len(new):
            return
        t = s[new]
        edge = np.maximum(edge[new], np.partition(t, t.shape[1] - k, axis=1)[:, t.shape[1] - k])
        i, j = np.nonzero(t >= (edge - _slack(s))[:, None])
        i = new[i]
        row, r, score = np.concatenate([self.row, rows[i]]), np.concatenate([self.rid, rid[j]]), np.concatenate([self.score, _exact(a, b, i, j)])
        order = np.lexsort((r, -score, row))
        row, r, score = row[order], r[order], score[order]
        start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        place = np.arange(len(row)) - np.repeat(start, np.diff(np.r_[start, len(row)]))
        last = place == self.K - 1
        self.edge[row[last]] = score[last]
        keep = place < self.K
        self.row, self.rid, self.score = row[keep], r[keep], score[keep]


PAIRS = "lid long, rid long, score double"


def _tasks(spark, n: int) -> DataFrame:
    return spark.range(0, n, 1, max(1, n))


def _nearest(left: str, right: str, n: int, K: int, cells: int | None, spark) -> DataFrame:
    """For n parts of written left rows their K best among written right rows, of the cells that each left row names."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part in frame["id"]:
                for lid, a, *named in _read(f"{left}/part={part}", ("cells",) if cells else ()):
                    best = _Nearest(len(lid), K)
                    for cell in range(cells or 1):
                        own = np.flatnonzero([cell in x for x in named[0]]) if cells else np.arange(len(lid))
                        for rid, b in _read(f"{right}/part={cell}") if len(own) else ():
                            for at in range(0, len(own), LEFT_ROWS):
                                rows = own[at : at + LEFT_ROWS]
                                best.show(rows, a[rows], rid, b)
                    yield pd.DataFrame({"lid": lid[best.row], "rid": best.rid, "score": best.score})

    return _tasks(spark, n).mapInPandas(run, PAIRS)


def _bucket(col: str, n: int) -> Column:
    return F.pmod(F.xxhash64(F.col(col).cast("long")), F.lit(n)).cast("int")


def similar_pairs(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_vec: str = "_vec", right_vec: str = "_vec", K: int | None = None, above: float | None = None) -> DataFrame:
    """(lid, rid, score): per left row its K best (ties by rid), or all pairs with a score over ``above``.

    Ids are longs; rows without a vector have no pairs.  Both sides are written once; a task holds a block of
    either, whatever the sizes.  Exact search compares all rows by nature (``approximate_pairs`` doesn't).
    """
    spark = left.sparkSession
    n = _parts(left.count(), spark)
    l, r = _written(left, left_id, left_vec, _bucket(left_id, n), n), _written(right, right_id, right_vec, F.lit(0))
    if K is not None:
        return _nearest(l, r, n, K, None, spark)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part in frame["id"]:
                for lid, a in _read(f"{l}/part={part}"):
                    for rid, b in _read(f"{r}/part=0"):
                        for at in range(0, len(lid), LEFT_ROWS):
                            own = a[at : at + LEFT_ROWS]
                            i, j = np.nonzero(_over(own, b, above))
                            for p in range(0, len(i), 1_000_000):
                                u, w = i[p : p + 1_000_000], j[p : p + 1_000_000]
                                yield pd.DataFrame({"lid": lid[at + u], "rid": rid[w], "score": _exact(own, b, u, w)})

    return _tasks(spark, n).mapInPandas(run, PAIRS)


def top_pairs(left: DataFrame, right: DataFrame, left_id: str, right_id: str, n: int, left_vec: str = "_vec", right_vec: str = "_vec") -> tuple[list, int, float]:
    """The n pairs of highest score (clipped to [0, 1]; ties by ids), the number of pairs, and the sum of the roots of all scores.

    A task gives its own n best and one row of sums, so the pairs are never written out.
    """
    spark = left.sparkSession
    parts = _parts(left.count(), spark)
    l, r = _written(left, left_id, left_vec, _bucket(left_id, parts), parts), _written(right, right_id, right_vec, F.lit(0))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part in frame["id"]:
                count, total = 0, 0.0
                best = tuple(np.zeros(0, t) for t in (np.int64, np.int64, float))
                for lid, a in _read(f"{l}/part={part}"):
                    for rid, b in _read(f"{r}/part=0"):
                        for at in range(0, len(lid), LEFT_ROWS):
                            s = np.clip(a[at : at + LEFT_ROWS] @ b.T, 0, 1)
                            count, total = count + s.size, total + np.sqrt(s).sum()
                            k = min(n, s.size)
                            i, j = np.nonzero(s >= np.partition(s.ravel(), s.size - k)[s.size - k])
                            x, y, z = (np.concatenate(v) for v in zip(best, (lid[at + i], rid[j], s[i, j])))
                            order = np.lexsort((y, x, -z))[:n]
                            best = x[order], y[order], z[order]
                yield pd.DataFrame({"lid": [*best[0], count], "rid": [*best[1], 0], "score": [*best[2], total], "kind": [0] * len(best[0]) + [1]})

    got = _tasks(spark, parts).mapInPandas(run, PAIRS + ", kind long").persist()
    sums = got.where("kind = 1").agg(F.sum("lid"), F.sum("score")).first()
    top = got.where("kind = 0").orderBy(F.desc("score"), "lid", "rid").limit(n).collect()
    got.unpersist()
    return top, sums[0] or 0, sums[1] or 0.0


def linked_values(df: DataFrame, id_col: str, vec_col: str, above: float) -> DataFrame:
    """(a, b): links that join the same rows as all pairs over ``above``, of which a tile of parts gives a forest.

    A tile of two of TILE_PARTS parts has fewer links than rows, and each row is in TILE_PARTS tiles, so the
    links follow the rows however many pairs there are.
    """
    spark = df.sparkSession
    g = min(TILE_PARTS, _parts(df.count(), spark))
    path = _written(df, id_col, vec_col, _bucket(id_col, g), g)
    tiles = [(x, y) for x in range(g) for y in range(x, g)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for tile in frame["id"]:
                x, y = tiles[tile]
                known = _Forest()
                for lid, a in _read(f"{path}/part={x}"):
                    for rid, b in _read(f"{path}/part={y}"):
                        for at in range(0, len(lid), LEFT_ROWS):
                            own = a[at : at + LEFT_ROWS]
                            known.link(lid[at : at + LEFT_ROWS], rid, _over(own, b, above))
                a, b = known.stars()
                yield pd.DataFrame({"a": a, "b": b})

    return _tasks(spark, len(tiles)).mapInPandas(run, "a long, b long")


class _Forest:
    """Rows and what joins them, each component as links to its lowest id."""

    def __init__(self):
        self.place: dict[int, int] = {}
        self.root = np.zeros(0, np.int64)

    def _places(self, ids: np.ndarray) -> np.ndarray:
        out = np.array([self.place.setdefault(i, len(self.place)) for i in ids.tolist()], dtype=np.int64)
        if len(self.place) > len(self.root):
            self.root = np.concatenate([self.root, np.arange(len(self.root), max(len(self.place), 2 * len(self.root)))])
        return out

    def _roots(self, at: np.ndarray) -> np.ndarray:
        r = self.root[at]
        while not np.array_equal(up := self.root[r], r):
            r = up
        self.root[at] = r
        return r

    def link(self, lid: np.ndarray, rid: np.ndarray, mask: np.ndarray) -> None:
        l, r = self._places(lid), self._places(rid)
        while True:
            left, right = self._roots(l), self._roots(r)
            mask &= left[:, None] != right[None, :]
            j = mask.argmax(axis=1)
            rows = np.flatnonzero(mask[np.arange(len(l)), j])
            if not len(rows):
                return
            for i in rows.tolist():
                u, w = int(left[i]), int(right[j[i]])
                while self.root[u] != u:
                    u = int(self.root[u])
                while self.root[w] != w:
                    w = int(self.root[w])
                if u != w:
                    self.root[max(u, w)] = min(u, w)

    def stars(self) -> tuple[np.ndarray, np.ndarray]:
        ids = np.fromiter(self.place, np.int64, len(self.place))
        root = self._roots(np.arange(len(ids)))
        lowest = ids.copy()
        np.minimum.at(lowest, root, ids)
        far = lowest[root] != ids
        return ids[far], lowest[root][far]


def approximate_pairs(left: DataFrame, right: DataFrame, left_id: str, right_id: str, K: int, cells: int, probes: int, left_vec: str = "_vec", right_vec: str = "_vec", sample: int = 50_000) -> DataFrame:
    """As similar_pairs with K, but a left row meets only the right rows of its ``probes`` nearest of ``cells`` cells.

    Cells are k-means of a sample of about ``sample`` right rows.  A cell is read by blocks of BLOCK_ROWS,
    so no task holds a whole cell.  With probes = cells the result is exact.
    """
    right = right.where(F.col(right_vec).isNotNull())
    left = left.where(F.col(left_vec).isNotNull())
    share = sample / max(1, right.count())
    some = right.where(F.pmod(F.xxhash64(right_id), F.lit(1_000_000)) < F.lit(int(1_000_000 * share))) if share < 1 else right
    _, centers = sem_cluster_by(some, cells, right_vec, right_id, niter=10, return_centroids=True)
    if not centers:
        return left.sparkSession.createDataFrame([], PAIRS)
    c = np.array(centers)

    def cells_of(vec: str, n: int) -> Column:
        @F.pandas_udf("array<int>")
        def cells_(s: pd.Series) -> pd.Series:
            d = (c**2).sum(1) - 2 * np.stack(s.to_numpy()) @ c.T if len(s) else np.zeros((0, len(c)))
            return pd.Series(list(np.argsort(d, axis=1, kind="stable")[:, :n]))

        return cells_(F.col(vec).cast("array<double>"))

    spark = left.sparkSession
    n = _parts(left.count(), spark)
    l = _written(left, left_id, left_vec, _bucket(left_id, n), n, cells_of(left_vec, probes).alias("cells"))
    r = _written(right, right_id, right_vec, cells_of(right_vec, 1)[0])
    return _nearest(l, r, n, K, len(c), spark)


class VectorStore:
    """Where vectors are kept and searched; ``TableStore`` is the one at hand, others can be plugged in."""

    def index(self, vectors: DataFrame, path: str) -> None:
        """Store (id long, vec array<double>)."""
        raise NotImplementedError

    def load_index(self, path: str) -> None:
        """Use an index that is stored."""
        raise NotImplementedError

    def search(self, queries: DataFrame, K: int, ids: DataFrame | None = None) -> DataFrame:
        """(lid, rid, score): for each query (id, vec) its K nearest, among ``ids`` (id) if given."""
        raise NotImplementedError

    def get_vectors(self, path: str, ids: list[int]) -> DataFrame:
        """(id, vec) of some ids."""
        raise NotImplementedError


class TableStore(VectorStore):
    """Vectors in a parquet table: exact search, or by ``cells`` and ``probes`` (see approximate_pairs)."""

    def __init__(self, spark, cells: int | None = None, probes: int = 1):
        self.spark, self.cells, self.probes, self.path = spark, cells, probes, None

    def index(self, vectors: DataFrame, path: str) -> None:
        vectors.where("id IS NOT NULL").select("id", "vec").write.parquet(path)
        self.path = path

    def load_index(self, path: str) -> None:
        self.path = path

    def search(self, queries: DataFrame, K: int, ids: DataFrame | None = None) -> DataFrame:
        if self.path is None:
            raise ValueError("no index is loaded")
        rows = self.spark.read.parquet(self.path)
        rows = rows if ids is None else rows.join(ids.select("id").distinct(), "id", "left_semi")
        if self.cells:
            return approximate_pairs(queries, rows, "id", "id", K, self.cells, self.probes, "vec", "vec")
        return similar_pairs(queries, rows, "id", "id", "vec", "vec", K)

    def get_vectors(self, path: str, ids: list[int]) -> DataFrame:
        return self.spark.read.parquet(path).where(F.col("id").isin(list(ids)))


def sem_sim_join(left: DataFrame, right: DataFrame, left_id: str, right_id: str, K: int, left_vec: str = "_vec", right_vec: str = "_vec", lsuffix: str = "_l", rsuffix: str = "_r", score_suffix: str = "", keep_index: bool = False) -> DataFrame:
    """For every left row its K nearest right rows, with ``_scores``; clashing names get the suffixes."""
    pairs = similar_pairs(left, right, left_id, right_id, left_vec, right_vec, K)
    shared = set(left.columns) & set(right.columns)
    l = left.select(F.col(left_id).alias("_left_id"), *[F.col(c).alias(c + lsuffix if c in shared else c) for c in left.columns if c != left_vec])
    r = right.select(F.col(right_id).alias("_right_id"), *[F.col(c).alias(c + rsuffix if c in shared else c) for c in right.columns if c != right_vec])
    out = pairs.select(F.col("lid").alias("_left_id"), F.col("rid").alias("_right_id"), F.col("score").alias("_scores" + score_suffix)).join(l, "_left_id").join(r, "_right_id")
    return out if keep_index else out.drop("_left_id", "_right_id")


def components(engine: Engine, edges: DataFrame) -> DataFrame:
    """(id, root) of undirected edges (a, b): labels take the least neighbour's, then the label's own label."""
    both = engine.materialise(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct(), "edges")
    at = engine.materialise(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("root")), "labels")
    while True:
        near = both.join(at, F.col("b") == F.col("id")).groupBy("a").agg(F.min("root").alias("m"))
        step = at.join(near, F.col("id") == F.col("a")).select("id", F.least("root", "m").alias("root"))
        jump = step.select(F.col("id").alias("root"), F.col("root").alias("far"))
        new = engine.materialise(step.join(jump, "root", "left").select("id", F.least("root", F.coalesce("far", "root")).alias("root")), "labels")
        if not new.join(at.withColumnRenamed("root", "old"), "id").where("root <> old").limit(1).count():
            return new
        at = new


def sem_dedup(engine: Engine, df: DataFrame, col: str, threshold: float, id_col: str, vec_col: str | None = None) -> DataFrame:
    """Rows but those whose component (values linked at a score over the threshold) has a row of lower id.

    Equal values are one value and stay or go together with it: the survivor is the value whose
    lowest id is lowest.  Rows without a value or a vector stay.
    """
    source = df if vec_col else embed_column(engine, df, col)
    values = engine.materialise(source.groupBy(col).agg(F.min(id_col).alias("_vid"), F.first(vec_col or "_vec").alias("_v")), "values")
    lost = components(engine, linked_values(values, "_vid", "_v", threshold)).where("root < id").select(F.col("id").alias("_vid"))
    gone = values.join(lost, "_vid", "left_semi").select(F.col(col).alias("_gone"))
    return df.join(gone, df[col] == gone["_gone"], "left_anti")


def sem_cluster_by(df: DataFrame, ncentroids: int, vec_col: str = "_vec", id_col: str = "id", niter: int = 20, return_scores: bool = False, return_centroids: bool = False):
    """k-means from the vectors of the lowest ids: cluster_id (from 0; null without a vector), the score to the centroid if wanted.

    Centroids (k rows) are on the driver; a round sums per task and cluster, then over tasks.
    """
    if ncentroids < 1:
        raise ValueError("one centroid at least")
    start = df.where(F.col(vec_col).isNotNull()).select(vec_col).orderBy(id_col).limit(ncentroids).collect()
    if not start:
        out = df.withColumn("cluster_id", F.lit(None).cast("int"))
        return (out, []) if return_centroids else out
    centers = np.array([[float(x) for x in r[0]] for r in start])
    vectors = df.select(F.col(vec_col).cast("array<double>").alias("v")).where("v IS NOT NULL")
    for _ in range(niter):
        c = centers

        def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total, n = np.zeros_like(c), np.zeros(len(c), dtype=np.int64)
            for frame in frames:
                if len(frame):
                    v = np.stack(frame["v"].to_numpy())
                    near = _closest(v, c)
                    np.add.at(total, near, v)
                    n += np.bincount(near, minlength=len(c))
            yield pd.DataFrame({"c": np.flatnonzero(n), "s": pd.Series(list(total[n > 0]), dtype=object), "n": n[n > 0]})

        parts = vectors.mapInPandas(sums, "c long, s array<double>, n long")
        count = parts.groupBy("c").agg(F.sum("n").alias("n"))
        flat = parts.select("c", F.posexplode("s").alias("j", "x")).groupBy("c", "j").agg(F.sum("x").alias("x")).join(count, "c")
        new = centers.copy()
        for r in flat.collect():  # clusters x dimensions
            new[r.c, r.j] = r.x / r.n
        if np.array_equal(new, centers):
            break
        centers = new
    last = centers

    @F.pandas_udf("int")
    def nearest(s: pd.Series) -> pd.Series:
        there = s.notna().to_numpy()
        out = pd.array([None] * len(s), dtype="Int32")
        if there.any():
            out[there] = _closest(np.stack(s[there].to_numpy()), last)
        return pd.Series(out)

    own = F.col(vec_col).cast("array<double>")
    out = df.withColumn("cluster_id", nearest(own))
    if return_scores:

        @F.pandas_udf("double")
        def score(s: pd.Series, k: pd.Series) -> pd.Series:
            return pd.Series([np.nan if v is None else float(np.dot(v, last[int(i)])) for v, i in zip(s, k)], dtype=float)

        out = out.withColumn("cluster_score", F.when(F.col(vec_col).isNotNull(), score(own, F.col("cluster_id"))))
    return (out, centers.tolist()) if return_centroids else out


def _closest(v: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """The nearest centroid of each row, the first of equals."""
    return ((centers**2).sum(1) - 2 * v @ centers.T).argmin(1)
