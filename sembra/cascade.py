"""Proxy and oracle cascades: sampling, calibration, thresholds (on the driver, over a bounded sample)."""

from __future__ import annotations

import bisect
import math
from dataclasses import asdict, dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialise


@dataclass(frozen=True)
class CascadeArgs:
    """Targets and sampling of a cascade; ``fixed`` = (pos, neg) skips learning.

    ``calibrated``: a helper's probabilities are replaced by their place among ``quantiles`` quantiles
    of all rows (thresholds are in that scale then).  ``helper_instruction`` is what a helper is asked
    instead, ``map_instruction`` what map_search_filter maps with.
    """

    recall_target: float = 0.8
    precision_target: float = 0.8
    sampling_percentage: float = 0.1
    failure_probability: float = 0.2
    is_weight: float = 0.9
    quantiles: int = 50
    max_sample_range: int = 200
    seed: int | None = 0
    min_join_size: int = 100
    proxy: str = "helper"
    fixed: tuple[float, float] | None = None
    plan: str | None = None
    calibrated: bool = True
    helper_instruction: str | None = None
    map_instruction: str | None = None

    def __post_init__(self):
        for name in ("recall_target", "precision_target", "sampling_percentage", "failure_probability", "is_weight"):
            if not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} lies between 0 and 1")
        if self.fixed is not None and self.fixed[0] < self.fixed[1]:
            raise ValueError("the positive threshold is below the negative one")
        if self.proxy not in ("helper", "embedding"):
            raise ValueError("the proxy is helper or embedding")

    def document(self) -> dict:
        """As plain values, for plan documents."""
        return {"__cascade__": asdict(self)}

    @classmethod
    def of(cls, doc: dict) -> CascadeArgs:
        args = dict(doc["__cascade__"])
        return cls(**args | {"fixed": tuple(args["fixed"]) if args.get("fixed") else None})

    def swapped(self) -> CascadeArgs:
        """For the opposite claim: thresholds mirror and change places."""
        return self if self.fixed is None else replace(self, fixed=(1 - self.fixed[1], 1 - self.fixed[0]))


@dataclass
class Drawn:
    score: float
    correction: float
    times: int


def quantile_edges(scores: DataFrame, col: str, quantiles: int) -> list[float]:
    """The exact values at the ranks ceil(i / quantiles x rows), i from 0, the first rank at least.

    Equal values are counted, and the counts summed within ranges of values; a row per range and the
    edges themselves come to the driver.
    """
    counts = scores.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("v")).agg(F.count("*").alias("n"))
    ranges = materialise(counts.repartitionByRange("v").withColumn("p", F.spark_partition_id()), "counts")
    before, at = [], 0
    for r in ranges.groupBy("p").agg(F.sum("n").alias("n")).orderBy("p").collect():
        before.append((r.p, at))
        at += r.n
    if not at:
        return []
    ranks = [max(1, math.ceil(i / quantiles * at)) for i in range(quantiles + 1)]
    starts = F.broadcast(ranges.sparkSession.createDataFrame(before, "p int, start long"))
    upto = ranges.join(starts, "p").withColumn("last", F.col("start") + F.sum("n").over(Window.partitionBy("p").orderBy("v")))
    hit = upto.where(F.exists(F.lit(ranks), lambda k: (k <= F.col("last")) & (k > F.col("last") - F.col("n"))))
    found = sorted(tuple(r) for r in hit.select("last", "v").collect())
    return [float(found[bisect.bisect_left(found, (k,))][1]) for k in ranks]


def calibrate(scored: DataFrame, quantiles: int = 50) -> DataFrame:
    """Scores to the share of quantile edges that they reach; the edges are exact, and a bounded list."""
    edges = quantile_edges(scored, "__sembra_score", quantiles)
    if not edges:
        return scored
    reached = F.size(F.filter(F.lit(edges), lambda e: e <= F.col("__sembra_score")))
    return scored.withColumn("__sembra_score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), (reached - 1) / F.lit(float(quantiles)))))


def draw(top: list[tuple], n: int, total: float, args: CascadeArgs) -> dict:
    """Drawn by id: of ``top``, the ids and scores of the highest, drawn with replacement by importance.

    n rows are there, and ``total`` is the sum of the roots of all scores.  As many rows are drawn as
    ``sampling_percentage`` of n says, all at once (one multinomial), so that no number is too large.
    """
    if not top:
        return {}
    s = np.array([r[1] for r in top])
    w = args.is_weight * (np.sqrt(s) / total if total else np.full(len(s), 1 / n)) + (1 - args.is_weight) / n
    times = np.random.default_rng(args.seed).multinomial(max(1, int(args.sampling_percentage * n)), w / w.sum())
    return {top[i][0]: Drawn(float(s[i]), float(1 / n / w[i]), int(times[i])) for i in np.flatnonzero(times)}


def sample_ids(scored: DataFrame, args: CascadeArgs) -> dict[int, Drawn]:
    """Ids drawn among the ``max_sample_range`` highest scores; the sums over all rows are one aggregate."""
    n, total = scored.agg(F.count("*"), F.sum(F.sqrt("__sembra_score"))).first()
    top = scored.select("__sembra_id", "__sembra_score").orderBy(F.desc("__sembra_score"), "__sembra_id").limit(args.max_sample_range).collect()
    return draw([tuple(r) for r in top], n, total, args)


def learn(sample: list[tuple], args: CascadeArgs) -> tuple[float, float]:
    """(pos, neg) thresholds from (score, truth, correction, times drawn: once if left out), by one-sided bounds.

    The term of recall for rows that the proxy accepts is not corrected, as in the method followed.
    """
    if not sample:
        return 1.0, 0.0
    x, y, c, t = (np.array(v, dtype=float) for v in zip(*sorted(((*r, 1)[:4] for r in sample), key=lambda r: -r[0])))
    s = t.sum()
    slack = lambda std, n, delta: std / np.sqrt(n) * np.sqrt(2 * np.log(1 / delta))

    def moments(z: np.ndarray, w: np.ndarray) -> tuple[float, float]:
        mean = (z * w).sum() / w.sum() if len(z) else 0.0
        return mean, np.sqrt(((z - mean) ** 2 * w).sum() / w.sum()) if len(z) else 0.0

    truth = (y * c * t).sum()

    def neg_for(target: float) -> float:
        if truth <= 0:
            return max((v for v in x if target <= 0), default=0.0)
        reach = [v for v in x if ((y * t)[x >= 1.0].sum() + (y * c * t)[(x < 1.0) & (x > v)].sum()) / truth >= target]
        return float(max(reach, default=0.0))

    neg = neg_for(args.recall_target)
    (m1, s1), (m2, s2) = moments((y * c)[x >= neg], t[x >= neg]), moments((y * c)[x < neg], t[x < neg])
    upper, lower = m1 + slack(s1, s, args.failure_probability / 2), m2 - slack(s2, s, args.failure_probability / 2)
    target = 1.0 if upper + lower == 0 else min(1.0, upper / (upper + lower))
    neg = neg_for(target)
    able = [1.0]
    for v in x:
        m, std = moments(y[x >= v], t[x >= v])
        if m - slack(std, t[x >= v].sum(), args.failure_probability / s) > args.precision_target:
            able.append(float(v))
    return max(neg, min(able)), neg
