"""Quality rules with risk-controlled cutoffs (DataFrame functions only).

Base rules are fixed.  On top, each rule of RULES compares a ratio of a document with a cutoff.  The
cutoffs of a stratum (language) are chosen from labelled holdouts, so that at most a share alpha of
its good documents (quality 1, base rules passed) is rejected by the rules together, with probability
1 - delta over all strata.  Candidates are vectors of cutoffs, in fixed chains from mild to strict: one
chain a rule, which tightens that rule to its strictest cutoff and then the others in turn.  Along a
chain each vector is tested: its exact upper binomial (Clopper-Pearson) bound at level
delta / (strata x chains) is at most alpha.  The first vector that fails ends its chain, so within a
chain no correction is needed (a fixed sequence of tests); over strata and chains it is Bonferroni's.
Of the vectors that hold, the one that rejects most labelled bad documents is taken.

A stratum needs about ln(strata x chains / delta) / alpha good labels (286 for four strata) before any
cutoff can hold; one without them keeps everything that passes the base rules.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, materialise, table, words

ALPHA, DELTA = 0.02, 0.05
SYMBOLS = "#*$%&|<>"
#: Rule: numerator, denominator, cutoffs in per mille from mild to strict; a document whose
#: 1000 * numerator > cutoff * denominator is rejected.
RULES = {
    "symbols": ("n_symbols", "word_chars", (400, 300, 200, 150, 100, 70, 50, 30)),
    "dup_lines": ("n_dup_lines", "n_lines", (800, 600, 500, 400, 300, 200)),
    "repeats": ("n_repeat_words", "n_words", (450, 400, 350, 300, 250, 200)),
    "long_words": ("word_chars", "n_words", (30000, 20000, 15000, 12000, 10000)),
}


def _repeat_words(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words, from column w; all work is within a row, and rows without a repeat stop early."""
    n = F.size("w")
    part = lambda k: F.slice("w", k + 1, F.greatest(n - 2, F.lit(0)))
    zipped = F.arrays_zip(part(0).alias("a"), part(1).alias("b"), part(2).alias("c"))
    df = df.withColumn("h", F.transform(zipped, lambda x: F.xxhash64(x["a"], x["b"], x["c"])))
    df = df.withColumn("again", F.size(F.array_distinct("h")) < F.size("h"))
    sorted_ = F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    df = df.withColumn("s", F.when(F.col("again"), sorted_))
    same = lambda x, i, d: F.coalesce(F.get(F.col("s"), i + d)["h"] == x["h"], F.lit(False))
    hit = F.transform("s", lambda x, i: F.when(same(x, i, -1) | same(x, i, 1), x["p"]))
    df = df.withColumn("at", F.sort_array(F.filter(hit, lambda p: p.isNotNull())))
    start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
    covered = F.aggregate("at", start, lambda acc, p: F.struct((acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"), p.alias("last")), lambda acc: acc["n"])
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("h", "again", "s", "at")


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[Column] = ()) -> DataFrame:
    """Per row: doc_id, keep, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed.

    A null text counts as empty.  Lines count if they have a word; a line is a duplicate if an
    earlier line of its text is equal.  n_repeat_words: words within 3-word windows that occur twice
    or more in the text (told apart by 64-bit hashes), the first included.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(F.col(id_col).alias("doc_id"), *keep, text.alias("_text"), words(F.col(text_col)).alias("w"))
    df = df.withColumn("_lines", F.filter(F.split("_text", "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != ""))
    df = _repeat_words(df)
    count = lambda c: c.cast("long")
    df = df.withColumns({
        "n_words": count(F.size("w")),
        "word_chars": count(F.length(F.translate("_text", SPACES, ""))),
        "n_symbols": count(F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))),
        "n_lines": count(F.size("_lines")),
        "n_dup_lines": count(F.size("_lines") - F.size(F.array_distinct("_lines"))),
    })
    df = df.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return df.drop("w", "_text", "_lines")


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 100_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + num * d, 1 + num / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) of n trials, exact up to rounding, in time that doesn't grow with k."""
    if k >= n:
        return 1.0
    a, b, x = n - k, k + 1, 1 - p
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(p))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, p) / b


def _chains() -> list[list[tuple[int, ...]]]:
    """By chain, vectors of the number of cutoffs in use per rule (0: the rule is off), each stricter than the one before."""
    most = [len(c) for _, _, c in RULES.values()]
    out = []
    for first in range(len(most)):
        at = [0] * len(most)
        chain = []
        while at != most:
            if at[first] < most[first]:
                turn = first
            else:  # the rule that is least far, the first of equals
                turn = min((r for r in range(len(most)) if at[r] < most[r]), key=lambda r: at[r])
            at[turn] += 1
            chain.append(tuple(at))
        out.append(chain)
    return out


CHAINS = _chains()


def step_of(rule: str) -> Column:
    """The place of the first cutoff that rejects a row of features; the number of cutoffs if none does."""
    a, b, cuts = RULES[rule]
    out = F.lit(len(cuts))
    for i in range(len(cuts) - 1, -1, -1):
        out = F.when(1000 * F.col(a) > cuts[i] * F.col(b), i).otherwise(out)
    return out


def certified(histogram: list[tuple], alpha: float = ALPHA, delta: float = DELTA) -> dict[str, dict[str, int]]:
    """By rule and stratum the cutoff in use.

    ``histogram`` has (stratum, quality, step_of each rule, number of labelled rows).
    """
    strata = sorted({h[0] for h in histogram})
    level = delta / (max(1, len(strata)) * len(CHAINS))
    out: dict[str, dict[str, int]] = {r: {} for r in RULES}
    for stratum in strata:
        good, bad = ([h[2:] for h in histogram if h[:2] == (stratum, q)] for q in (1, 0))
        n = sum(h[-1] for h in good)
        best = None
        for c, chain in enumerate(CHAINS):
            for i, vector in enumerate(chain):
                lost, caught = (sum(h[-1] for h in rows if any(s < v for s, v in zip(h, vector))) for rows in (good, bad))
                if not n or binomial_cdf(lost, n, alpha) > level:
                    break
                best = min(best or (1,), (-caught, lost, c, -i, vector))
        for (rule, (_, _, cuts)), used in zip(RULES.items(), best[-1] if best else ()):
            if used:
                out[rule][stratum] = cuts[used - 1]
    return out


def calibrate(found: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> dict[str, dict[str, int]]:
    """Cutoffs from all labelled rows; a histogram over strata and cutoffs comes to the driver."""
    held = labels.where("quality IN (0, 1)").select(F.col("doc_id").alias("_labelled"), F.col("quality").cast("int").alias("_quality"))
    held = found.where(~F.col("base_failed")).join(held, F.col("doc_id") == F.col("_labelled"))
    rows = held.groupBy("stratum", "_quality", *[step_of(r).alias(f"_{r}") for r in RULES]).count().collect()
    return certified([tuple(r) for r in rows], alpha, delta)


def verdict(cutoffs: dict[str, dict[str, int]]) -> Column:
    """kept, for rows of features with a stratum."""
    ok = ~F.col("base_failed")
    for rule, (a, b, _) in RULES.items():
        for stratum, cut in sorted(cutoffs[rule].items()):
            ok = ok & ~((F.col("stratum") == stratum) & (1000 * F.col(a) > cut * F.col(b)))
    return ok


def _stratum(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit("")).alias("stratum")


def quality(docs: DataFrame, labels: DataFrame, stratum_col: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row per document: counts, base_failed and kept; see features for nulls and ties.

    A null stratum is a stratum of its own, and the empty one's.  Labels may repeat (each counts), be
    null or name documents that aren't there (both ignored); without labels, kept is not base_failed.
    """
    found = materialise(features(docs, keep=[_stratum(stratum_col)]), "quality")
    cutoffs = calibrate(found, labels, alpha, delta)
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", verdict(cutoffs).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, stratum_col: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The rows of docs that are kept, with their columns; no shuffle of texts.

    Rows are written with their features: a filter on features that aren't stored would be pushed
    into them and evaluate them many times over.
    """
    found = materialise(features(docs, keep=[_stratum(stratum_col), F.struct(*docs.columns).alias("_row")]), "quality")
    return found.where(verdict(calibrate(found, labels, alpha, delta))).select("_row.*")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document, whole texts, by cutoffs from all labels."""
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _oracle() -> str:
    names = list(RULES)
    values = ", ".join(f"({c}, {i}, {', '.join(map(str, v))})" for c, chain in enumerate(CHAINS) for i, v in enumerate(chain))
    used = ", ".join(f"u_{r}" for r in names)
    step = lambda r: "CASE " + " ".join(f"WHEN 1000 * {RULES[r][0]} > {cut} * {RULES[r][1]} THEN {i}" for i, cut in enumerate(RULES[r][2])) + f" ELSE {len(RULES[r][2])} END"
    steps = ", ".join(f"{step(r)} AS s_{r}" for r in names)
    hit = lambda t: "(" + " OR ".join(f"{t}.s_{r} < v.u_{r}" for r in names) + ")"
    return f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t,
                  regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3),
g3 AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM g),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g3 WHERE c > 1) GROUP BY doc_id),
l AS (SELECT d.*, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
f0 AS (SELECT l.doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words,
       CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
       CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
       CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
       CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words FROM l LEFT JOIN rep ON l.doc_id = rep.doc_id),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f0),
s AS (SELECT doc_id, stratum, {steps} FROM f WHERE NOT base_failed),
held AS (SELECT s.*, quality FROM s JOIN labels ON labels.doc_id = s.doc_id AND quality IN (0, 1)),
v(chain, step, {used}) AS (VALUES {values}),
counts AS (SELECT stratum, chain, step, count(*) FILTER (quality = 1) AS n, count(*) FILTER (quality = 1 AND {hit('held')}) AS lost, count(*) FILTER (quality = 0 AND {hit('held')}) AS caught
  FROM held CROSS JOIN v GROUP BY ALL),
looks AS (SELECT {DELTA} / (greatest(1, count(DISTINCT stratum)) * {len(CHAINS)}) AS level FROM held),
tested AS (SELECT counts.*, n > 0 AND
  (CASE WHEN lost >= n THEN 1 ELSE list_sum(list_transform(range(0, lost + 1), lambda i: exp(lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) + i * ln({ALPHA}) + (n - i) * ln(1 - {ALPHA})))) END) <= level AS holds
  FROM counts CROSS JOIN looks),
chained AS (SELECT *, bool_and(holds) OVER (PARTITION BY stratum, chain ORDER BY step) AS so_far FROM tested),
best AS (SELECT stratum, chain, step FROM chained WHERE so_far QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY caught DESC, lost, chain, step DESC) = 1),
bad AS (SELECT DISTINCT s.doc_id FROM s JOIN best ON s.stratum = best.stratum JOIN v ON v.chain = best.chain AND v.step = best.step WHERE {hit('s')})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept FROM f"""


QUERIES = {"op9_quality": op9_quality}
ORACLES = {"op9_quality": _oracle()}
