"""Secret scans through a trigram inverted index (DataFrame functions only).

Each rule's regex gives a Boolean trigram query (trigrams.py).  ``build_index`` inverts the texts for
the trigrams that any rule asks for: postings (trigram, row key), written to the shared folder sorted
by trigram, so that other scans can use them again.  A clause's postings are intersected by row key,
a clause is met where all of its trigrams are; a query is met where one of its clauses is.  Each
candidate is then verified with the rule's regex.  Rules whose regex requires no trigram (runs of hex
digits) scan every text.

Texts never move: the candidates' row keys are few, are counted, and are broadcast up to
BROADCAST_ROWS of them; beyond that each row meets the same clauses with its own trigrams.

Java's matcher gives the matches of a rule (leftmost, non-overlapping); ``split`` by the same regex
gives what lies between.  Lengths add up to offsets by doubling (log n passes over an array), and
redaction cuts bytes, not code points, so a text of n bytes and m matches takes O(n + m log m).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table
from .trigrams import trigram_query

#: kind -> (regex, group that is measured, least length of it); in the order in which kinds are listed.
BASE = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),
}
#: Kinds of the method itself; public token formats.
EXTRA = {
    "private": (r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----", 0, 1),
    "github": (r"gh[pousr]_[A-Za-z0-9]{36,255}", 0, 40),
    "slack": (r"xox[abprs]-[0-9A-Za-z-]{10,}", 0, 15),
    "jwt": (r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 30),
    "google": (r"AIza[0-9A-Za-z_-]{35}", 0, 39),
}
RULES = BASE | EXTRA
#: Candidates up to this number are broadcast (a long and a few short names each).
BROADCAST_ROWS = 100_000


def rule_queries(rules: dict = RULES) -> dict[str, set[frozenset[str]] | None]:
    return {kind: trigram_query(rx) for kind, (rx, _, _) in rules.items()}


def build_index(rows: DataFrame, grams: list[str]) -> DataFrame:
    """The inverted index of the texts (columns rk, _low) for these trigrams: (gram, rk), written sorted by gram."""
    found = F.array_compact(F.array(*[F.when(F.contains("_low", F.lit(g)), F.lit(g)) for g in grams]))
    return materialise(rows.select("rk", F.explode(found).alias("gram")).sortWithinPartitions("gram", "rk"), "secrets-index")


def _asked(queries: dict[str, set[frozenset[str]] | None]) -> list[tuple[str, list[str]]]:
    return [(kind, sorted(clause)) for kind, q in queries.items() if q for clause in sorted(q, key=sorted)]


def _met(asked: list[tuple[str, list[str]]], clause_met: Callable[[list[str]], Column]) -> Column:
    """The rules one of whose clauses is met."""
    rules = [F.when(reduce(lambda a, b: a | b, [clause_met(cl) for k, cl in asked if k == kind]), F.lit(kind)) for kind in dict.fromkeys(k for k, _ in asked)]
    return F.array_compact(F.array(*rules))


def candidates(index: DataFrame, queries: dict[str, set[frozenset[str]] | None]) -> DataFrame:
    """(rk, rules array): row keys in the intersection of the postings of a clause of a rule's query."""
    asked = _asked(queries)
    grams = sorted({g for _, clause in asked for g in clause})
    bit = {g: i for i, g in enumerate(grams)}
    words_ = range((len(grams) + 62) // 63)
    index_of = F.array_position(F.array(*[F.lit(g) for g in grams]), F.col("gram")) - 1
    place = lambda w: F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("i") - 63 * w).cast("int"))
    lanes = [F.bit_or(F.when((F.col("i") >= 63 * w) & (F.col("i") < 63 * (w + 1)), place(w)).otherwise(F.lit(0).cast("long"))).alias(f"lane{w}") for w in words_]
    met = index.where(F.col("gram").isin(grams)).select("rk", index_of.alias("i")).groupBy("rk").agg(*lanes)

    def clause_met(clause: list[str]) -> Column:
        need = [sum(1 << (bit[g] - 63 * w) for g in clause if bit[g] // 63 == w) for w in words_]
        return reduce(lambda a, b: a & b, [F.col(f"lane{w}").bitwiseAND(F.lit(n)) == F.lit(n) for w, n in zip(words_, need) if n])

    return met.select("rk", _met(asked, clause_met).alias("rules")).where(F.size("rules") > 0)


def with_candidates(rows: DataFrame, queries: dict[str, set[frozenset[str]] | None]) -> DataFrame:
    """rows (rk, _text and others) with the array ``rules`` of the rules that they are candidates of (null: none)."""
    asked = _asked(queries)
    if not asked:
        return rows.withColumn("rules", F.array().cast("array<string>"))
    lean = rows.select("rk", F.lower("_text").alias("_low"))
    found = materialise(candidates(build_index(lean, sorted({g for _, clause in asked for g in clause})), queries), "secrets-candidates")
    if found.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(found), "rk", "left")
    low = rows.withColumn("_low", F.lower("_text"))
    return low.withColumn("rules", _met(asked, lambda clause: reduce(lambda a, b: a & b, [F.contains("_low", F.lit(g)) for g in clause]))).drop("_low")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def running(x: Column, join: Callable[[Column, Column], Column]) -> Column:
    """x[0] join … join x[i] for each i, of an array of longs, in log n passes; ``join`` is associative."""
    passes = F.when(F.size(x) > 1, F.sequence(F.lit(0), F.ceil(F.log2(F.size(x).cast("double"))).cast("int") - 1)).otherwise(F.array().cast("array<int>"))

    def double(acc: Column, j: Column) -> Column:
        before = lambda i: F.get(acc, i - F.call_function("shiftleft", F.lit(1), j))
        return F.transform(acc, lambda v, i: F.coalesce(join(v, before(i)), v))

    return F.aggregate(passes, x, double)



def _found(rank: int, kind: str, rx: str, group: int, least: int, gate: Column) -> Column:
    """What a rule's regex finds in _text: matches m, the parts t of them that are measured, and gaps g; null if nothing."""
    text = F.col("_text")
    matches = F.regexp_extract_all(text, F.lit(rx), F.lit(0))
    tested = F.regexp_extract_all(text, F.lit(rx), F.lit(group)) if group else F.lit(None).cast("array<string>")
    parts = F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), F.lit(least).alias("least"), matches.alias("m"), tested.alias("t"), F.split(text, rx, -1).alias("g"))
    return F.when(gate & F.rlike(text, F.lit(rx)), parts)


def _spans(v: Column) -> Column:
    """The spans of what a rule has found, of matches that are long enough: in code points, and from and to in bytes."""
    plus = lambda a, b: a + b

    def ends(size: Callable[[Column], Column]) -> Column:
        return running(F.transform(v["m"], lambda m, i: (size(m) + size(F.get(v["g"], i))).cast("long")), plus)

    def cut(e: Column) -> Column:
        span = lambda m, i: F.struct(
            (F.get(e["c"], i) - F.length(m)).alias("start"), v["rank"].alias("rank"), F.get(e["c"], i).alias("end"), v["kind"].alias("kind"), (F.get(e["b"], i) - F.octet_length(m)).alias("from"), F.get(e["b"], i).alias("to")
        )
        return F.filter(F.transform(v["m"], span), lambda s, i: F.length(F.coalesce(F.get(v["t"], i), F.get(v["m"], i))) >= v["least"])

    return let(F.struct(ends(F.length).alias("c"), ends(F.octet_length).alias("b")), cut)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[Column] = (), rules: dict = RULES) -> DataFrame:
    """One row per input row: doc_id, keep, _text and spans, an array of (start, rank, end, kind, from, to).

    start and end are code points, from and to bytes, ends exclusive; sorted by start, then by the
    kinds' order in rules.  A null text counts as empty.  Repeated rows and null ids keep rows of
    their own; the row key is a hash of id and text, and a collision only adds candidates, which are
    verified.  A very long text takes time in proportion to its length.  An empty table gives no rows.
    """
    queries = rule_queries(rules)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), *keep, text.alias("_text"), F.xxhash64(F.col(id_col), text).alias("rk"))
    rows = with_candidates(rows, queries)
    gate = lambda kind: F.lit(True) if queries[kind] is None else F.coalesce(F.array_contains("rules", kind), F.lit(False))
    found = F.array_compact(F.array(*[_found(n, kind, *rule, gate(kind)) for n, (kind, rule) in enumerate(rules.items())]))
    spans = F.sort_array(F.flatten(F.transform(found, _spans)))
    return rows.withColumn("spans", spans).drop("rk", "rules")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (text) of every row; see scan."""
    found = scan(docs, id_col, text_col)
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *[n(k) for k in BASE], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[REDACTED]") -> DataFrame:
    """docs with each secret (overlapping spans merged) replaced by mark; rows without one are unchanged.

    A column n_chars, where there is one, is set to the new length.  See scan for the rest.
    """
    row = F.struct(*docs.columns).alias("_row")
    found = scan(docs, id_col, text_col, keep=[row])

    def pieces(v: Column, reach: Column) -> Column:
        at = lambda i: F.coalesce(F.get(reach, i - 1), F.lit(0).cast("long"))
        slice_ = lambda a, n: F.substring(v["raw"], (a + 1).cast("int"), n.cast("int")).cast("string")
        cut = F.transform(v["s"], lambda s, i: F.when(s["from"] >= at(i), F.concat(slice_(at(i), s["from"] - at(i)), F.lit(mark))))
        return F.concat(F.array_join(cut, ""), slice_(at(F.size(v["s"])), F.octet_length(v["raw"])))

    whole = F.struct(F.encode(F.col("_text"), "UTF-8").alias("raw"), F.col("spans").alias("s"))
    clean = let(whole, lambda v: let(running(F.transform(v["s"], lambda s: s["to"]), F.greatest), lambda reach: pieces(v, reach)))
    found = found.withColumn("_clean", F.when(F.size("spans") > 0, clean))
    cols = []
    for col in docs.columns:
        value = F.col("_row").getField(col)
        if col == text_col:
            value = F.coalesce("_clean", value)
        elif col == "n_chars":
            value = F.when(F.col("_clean").isNotNull(), F.length("_clean").cast(docs.schema[col].dataType)).otherwise(value)
        cols.append(value.alias(col))
    return found.select(*cols)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, whole texts; one row per document."""
    return report(table(spark, sf_dir, "documents"))


QUERIES = {"op6_secrets": op6_secrets}
ORACLES: dict[str, str] = {}
