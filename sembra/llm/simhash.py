"""SimHash near-duplicate groups by anchor-point covering (DataFrame functions only).

A 64-bit fingerprint is cut into two halves.  Fingerprints at 3 or fewer differing bits differ in at
most one bit of at least one half, so each half only has to be searched to distance 1.  The anchors
of a half are the codewords of the perfect [31,26] Hamming code over its low 31 bits (covering
radius 1).  Every fingerprint has one home anchor, at distance 0 or 1, and is replicated to each
anchor within covering radius plus threshold, 1 + 1 = 2: one or sixteen of them.  A home and a
replica meet at an anchor; the whole 64 bits are compared there.  The pair is found for certain: the
home of x is within 1 of x, hence within 2 of every y at distance 1.

Only distinct fingerprints are replicated, so a group of copies of any size is one entry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, free_name, materialise, or_all, spread_join, table, words
from .components import components

LOW31 = (1 << 31) - 1
LANES = (1 << 32) | 1
MASKS = [sum(1 << (p - 1) for p in range(1, 32) if p >> j & 1) for j in range(5)]


def _flip(s: int) -> list[int]:
    """By syndrome: bit masks that lead from a 31-bit word to its home and to all codewords at distance 2."""
    if s == 0:
        return [0]
    return [1 << (s - 1)] + [1 << (i - 1) | 1 << ((i ^ s) - 1) for i in range(1, 32) if i < i ^ s]


def _literal(rows: list[list[int]]) -> Column:
    return F.expr("array(" + ", ".join("array(" + ", ".join(f"{x}L" for x in r) + ")" for r in rows) + ")")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, keep: list[Column] = ()) -> DataFrame:
    """(doc_id, fp long, keep): one row per input row.

    Words of the text with A-Z lowered, shingles of 3 words with repeats (fewer words: the whole
    sequence; none, or a null text: fingerprint 0), XXH64 seed 42 of each; a bit is 1 if set in more
    than half the hashes.  64 counts are kept in 32 sums of two 32-bit lanes each, which no text that
    fits a string can overflow.  Other columns are ignored.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), words(ascii_lower(F.col(text_col))).alias("w"), F.struct(F.lit(0).alias("_"), *keep).alias("keep"))
    n = F.size("w")
    whole = F.concat_ws(" ", "w")
    pieces = [F.slice("w", F.lit(k + 1), F.greatest(n - (shingle - 1), F.lit(0))) for k in range(shingle)]
    zipped = F.arrays_zip(*[p.alias(f"s{k}") for k, p in enumerate(pieces)])
    one = F.array(F.struct(*[(whole if k == 0 else F.lit(None).cast("string")).alias(f"s{k}") for k in range(shingle)]))
    zipped = F.when(n >= shingle, zipped).when(n > 0, one)
    flat = rows.select("rid", "doc_id", "keep", F.inline_outer(zipped).alias(*[f"s{k}" for k in range(shingle)]))
    text = F.when(F.col(f"s{shingle - 1}").isNotNull(), F.concat_ws(" ", *[f"s{k}" for k in range(shingle)])).otherwise(F.col("s0")) if shingle > 1 else F.col("s0")
    hashed = flat.select("rid", "doc_id", "keep", F.when(F.col("s0").isNotNull(), F.xxhash64(text)).alias("h"))
    lanes = [F.sum(F.shiftrightunsigned("h", i).bitwiseAND(F.lit(LANES))).alias(f"c{i}") for i in range(32)]
    sums = hashed.groupBy("rid", "doc_id", "keep").agg(F.count("h").alias("n"), *lanes)
    bits = []
    for i in range(32):
        low, high = F.col(f"c{i}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(f"c{i}", 32)
        bits += [F.when(2 * low > F.col("n"), F.lit(1 << i)).otherwise(F.lit(0).cast("long"))]
        bits += [F.when(2 * high > F.col("n"), F.expr(f"shiftleft(1L, {32 + i})")).otherwise(F.lit(0).cast("long"))]
    return sums.select("doc_id", or_all(bits).alias("fp"), "keep.*").drop("_")


def _anchored(fps: DataFrame, homes: bool) -> DataFrame:
    """(anchor, half, fp): the home anchor, or every anchor within distance 2, of both halves."""
    halves = F.array(F.col("fp").bitwiseAND(F.lit(LOW31)), F.shiftrightunsigned("fp", 32).bitwiseAND(F.lit(LOW31)))
    each = fps.select("fp", F.posexplode(halves).alias("half", "x"))
    parity = [F.shiftleft(F.bit_count(F.col("x").bitwiseAND(F.lit(m))).bitwiseAND(F.lit(1)), j) for j, m in enumerate(MASKS)]
    each = each.select("fp", "half", "x", or_all(parity).alias("s"))
    masks = _literal([_flip(s)[:1] if homes else _flip(s) for s in range(32)])
    each = each.select("fp", "half", "x", F.explode(F.get(masks, F.col("s"))).alias("m"))
    return each.select(F.col("x").bitwiseXOR(F.col("m")).bitwiseOR(F.shiftleft(F.col("half").cast("long"), 31)).alias("anchor"), "half", "fp")


def links(fps: DataFrame, max_distance: int = 3) -> DataFrame:
    """(a, b) for every ordered pair of different fingerprints at max_distance or fewer bits, once each.

    ``fps`` has distinct values in column fp.  Distances of 0 to 3 are covered.
    """
    if not 0 <= max_distance <= 3:
        raise ValueError("the two halves cover distances from 0 to 3")
    home, far = _anchored(fps, True).withColumnRenamed("fp", "a"), _anchored(fps, False).select("anchor", F.col("fp").alias("b"))
    differ = F.col("a").bitwiseXOR(F.col("b"))
    low = F.bit_count(differ.bitwiseAND(F.lit(0xFFFFFFFF)))
    near = (differ != 0) & (F.bit_count(differ) <= max_distance) & F.when(F.col("half") == 0, low <= 1).otherwise(low > 1)
    # by its size on disk Spark would broadcast a small side here, which is 34 rows a fingerprint in memory
    return home.join(far.hint("merge"), "anchor").where(near).select("a", "b")


def _rooted(prints: DataFrame, max_distance: int) -> tuple[DataFrame, DataFrame]:
    """(fp, n, least, root) of the distinct fingerprints, where root is the least of the component; and the links."""
    each = materialise(prints.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")), "simhash-distinct")
    pairs = materialise(links(each.select("fp"), max_distance), "simhash-links")
    roots = components(pairs.where("a < b"))
    return each.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "n", "least", F.coalesce("root", "fp").alias("root")), pairs


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_distance: int = 3) -> DataFrame:
    """One row per input row: doc_id, fingerprint, n_near, component_id.

    n_near counts the other rows linked directly, equal fingerprints included; component_id is the
    smallest doc_id that can be reached.  A null doc_id keeps its row, is counted, and never is a
    component_id unless no other is there (then null).  Repeated rows count as rows of their own.
    An empty table gives no rows.
    """
    prints = materialise(fingerprints(docs, id_col, text_col), "simhash")
    rooted, pairs = _rooted(prints, max_distance)
    near = pairs.join(rooted.select(F.col("fp").alias("b"), "n"), "b").groupBy("a").agg(F.sum("n").alias("beside"))
    firsts = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    about = rooted.join(firsts, "root").join(near, F.col("fp") == F.col("a"), "left").select("fp", "n", (F.col("n") - 1 + F.coalesce("beside", F.lit(0))).alias("n_near"), "component_id")
    met = spread_join(prints, materialise(about, "simhash-about"), "fp", "n")
    return met.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "n_near", "component_id")


def first_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_distance: int = 3) -> DataFrame:
    """One row of docs of each component, with its columns: that of the least doc_id (nulls last), then of the least text digest.

    Rows are told apart by doc_id and 128 bits of the text, not by doc_id alone: unrelated texts under
    one doc_id, or under none, are components of their own and stay.  Rows equal in doc_id and text
    are copies: one stays, whatever their other columns.  An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    names = [free_name(docs, "row_key"), free_name(docs, "row_check")]
    key = [F.xxhash64(F.lit(i), F.col(id_col), text).alias(n) for i, n in enumerate(names)]
    prints = materialise(fingerprints(docs, id_col, text_col, keep=key), "simhash-rows")
    rooted, _ = _rooted(prints, max_distance)
    order = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", *names)
    best = prints.groupBy("fp").agg(F.min(order).alias("best"))
    keep = rooted.select("fp", "root").join(best, "fp").groupBy("root").agg(F.min("best").alias("best")).select(*[f"best.{n}" for n in names])
    return docs.select("*", *key).join(keep, names, "left_semi").dropDuplicates(names).select(*docs.columns)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint, links and component of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op4_simhash": op4_simhash}
ORACLES: dict[str, str] = {}
