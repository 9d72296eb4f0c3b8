"""Language identification: scripts narrow the candidates, Viterbi labels spans of mixed text.

A model has log scores of words per language, from counts over labelled documents, and of letter
trigrams for words that it doesn't know.  A word's script (by code point ranges) leaves only the
languages that were seen in it.  Over the words of a document, Viterbi finds the labelling of
greatest score where each change of language costs a penalty.

Most texts are in one language.  If for no language the words of any stretch gain more than half the
penalty against the best single language, no labelling with changes can be better: a path of m
stretches gains at most m/2 penalties and pays m - 1.  Such texts are settled by sums; only the others
run through Viterbi, in lockstep.

The model is fitted on at most ``max_docs`` labelled documents (expected; a hash of the id decides),
and has all their words that occur ``min_count`` times or more in a language, and the trigrams of all
their words; that sample is the only bound.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import materialise, table, words
from .tokens import slices

MAX_DOCS = 20_000
MIN_COUNT = 2
SWITCH = 12.0
CLIP = 6.0
WORD_CACHE = 300_000
SLICE_CHARS = 2_000_000
EDGES = ".,;:!?\"'()[]{}<>*#$%&|-_=+/\\~`^@«»“”‘’¿¡…"
#: (script, first code point, last code point), sorted; letters elsewhere are of script "other".
SCRIPTS = [
    ("latin", 0x41, 0x24F), ("ipa", 0x250, 0x2AF), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("armenian", 0x530, 0x58F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x77F),
    ("devanagari", 0x900, 0x97F), ("bengali", 0x980, 0x9FF), ("tamil", 0xB80, 0xBFF), ("telugu", 0xC00, 0xC7F), ("thai", 0xE00, 0xE7F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF),
    ("latin", 0x1E00, 0x1EFF), ("greek", 0x1F00, 0x1FFF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF), ("han", 0x20000, 0x2FFFF),
]
_STARTS = np.array([a for _, a, _ in SCRIPTS])


def script_of(word: str) -> str | None:
    """Script of the first letter; None without a letter."""
    for c in word:
        if c.isalpha():
            i = int(np.searchsorted(_STARTS, ord(c), side="right")) - 1
            return SCRIPTS[i][0] if i >= 0 and ord(c) <= SCRIPTS[i][2] else "other"
    return None


def trimmed(chunk: str) -> str:
    """A chunk in lower case, without what stands around its letters and digits."""
    a, b = 0, len(chunk)
    while a < b and not chunk[a].isalnum():
        a += 1
    while b > a and not chunk[b - 1].isalnum():
        b -= 1
    return chunk[a:b].lower()


@dataclass
class Model:
    """Log scores relative to the mean of the languages, clipped; langs are sorted.

    words and grams are the rows of their score matrices, in order.
    """

    langs: list[str]
    words: list[str] = field(default_factory=list)
    word_scores: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))
    grams: list[str] = field(default_factory=list)
    gram_scores: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))
    scripts: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fit(cls, words: Iterable[tuple[str, str, int]], grams: Iterable[tuple[str, str, int]]) -> Model:
        """From (lang, word, count) and (lang, trigram, count)."""
        words, grams = list(words), list(grams)
        langs = sorted({c[0] for c in words} | {c[0] for c in grams})
        k = len(langs)
        at = {x: i for i, x in enumerate(langs)}

        def scores(counts: list[tuple[str, str, int]]) -> tuple[list[str], np.ndarray]:
            place = {x: i for i, x in enumerate(sorted({c[1] for c in counts}))}
            raw = np.zeros((len(place), k))
            for lang, x, n in counts:
                raw[place[x], at[lang]] += n
            p = np.log((raw + 0.5) / (raw.sum(0) + 0.5 * len(raw))) if len(raw) else raw
            p = np.clip(p - p.mean(1, keepdims=True), -CLIP, CLIP) if len(raw) else raw
            return list(place), p.astype(np.float32)

        by_script: dict[str, np.ndarray] = {}
        for lang, word, n in words:
            by_script.setdefault(script_of(word) or "other", np.zeros(k))[at[lang]] += n
        total = sum(by_script.values()) if by_script else np.zeros(k)
        return cls(langs, *scores(words), *scores(grams), {s: v >= 0.01 * np.maximum(total, 1) for s, v in by_script.items()})

    def narrowed(self, script: str, scores: np.ndarray) -> np.ndarray:
        """Scores of words of a script, with the languages not seen in it far below."""
        may = self.scripts.get(script)
        return scores if may is None or may.all() or not may.any() else np.where(may, scores, np.float32(-2 * CLIP))


class Scorer:
    """Word -> row of a score matrix; row 0 is for what has no letter.

    Rows of the model's words come first; those of other words, from their trigrams, follow and are
    dropped when there are too many.
    """

    def __init__(self, model: Model):
        self.model = model
        k = len(model.langs)
        zero = np.zeros((1, k), np.float32)
        self.gram_at = {g: i + 1 for i, g in enumerate(model.grams)}
        self.gram_rows = np.concatenate([zero, model.gram_scores]) if len(model.grams) else zero
        self.word_at = {w: i + 1 for i, w in enumerate(model.words)}
        self.own = np.concatenate([zero, model.word_scores]) if len(model.words) else zero
        kinds = [script_of(w) or "other" for w in model.words]
        for script in set(kinds):
            rows = np.array([i + 1 for i, x in enumerate(kinds) if x == script])
            self.own[rows] = model.narrowed(script, self.own[rows])
        self.clear()

    def clear(self) -> None:
        self.rows, self.at, self.extra = self.own, {}, {}

    def _row(self, chunk: bytes, new: dict[str, int], n: int) -> int:
        w = chunk.decode("utf-8", "replace").strip(EDGES).lower()
        if w and not (w[0].isalnum() and w[-1].isalnum()):
            w = trimmed(w)
        row = self.word_at.get(w) or self.extra.get(w) or new.get(w)
        if row is None:
            if not w.isalpha() and script_of(w) is None:
                return 0
            row = new[w] = n + len(new)
        return row

    def _unknown(self, new: list[str]) -> np.ndarray:
        lists = [[self.gram_at.get(w[i : i + 3], 0) for i in range(len(w) - 2)] for w in (f" {x} " for x in new)]
        sizes = np.array([len(x) for x in lists])
        flat = np.fromiter((i for x in lists for i in x), np.int64, int(sizes.sum()))
        rows = np.clip(np.add.reduceat(self.gram_rows[flat], np.cumsum(sizes) - sizes) / 2, -CLIP, CLIP)
        for i, w in enumerate(new):
            if not w[0] < "\u0250" or not w[0].isalpha():
                rows[i] = self.model.narrowed(script_of(w), rows[i])
        latin = np.array([w[0] < "\u0250" and w[0].isalpha() for w in new])
        rows[latin] = self.model.narrowed("latin", rows[latin])
        return rows

    def matrix(self, split: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """(row of each word, score matrix)."""
        if len(self.at) > WORD_CACHE:
            self.clear()
        at, new, n = self.at, {}, len(self.rows)
        for c in set().union(*split) - at.keys():
            at[c] = self._row(c, new, n)
        if new:
            self.rows = np.concatenate([self.rows, self._unknown(list(new))])
            self.extra.update(new)
        ids = np.fromiter((at[c] for w in split for c in w), np.int64, sum(map(len, split)))
        return ids, self.rows


def viterbi(scores: list[np.ndarray], switch: float) -> list[np.ndarray]:
    """Best labels of each sequence of score rows; of equal ones the one that stays, then the first language."""
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    k = scores[0].shape[1]
    lengths = np.array([len(scores[i]) for i in order])
    steps = int(lengths[0])
    back = [None] * steps
    v = np.array([scores[i][0] for i in order], dtype=np.float64)
    final = [None] * len(order)
    active = len(order)
    stay = np.arange(k)
    for t in range(1, steps + 1):
        while active and lengths[active - 1] == t:
            active -= 1
            final[active] = int(v[active].argmax())
        if not active:
            break
        v = v[:active]
        best = v.argmax(1)
        top = v[np.arange(active), best] - switch
        move = top[:, None] > v
        back[t] = np.where(move, best[:, None], stay).astype(np.int16)
        v = np.where(move, top[:, None], v) + np.array([scores[order[x]][t] for x in range(active)])
    out: list = [None] * len(order)
    for x, i in enumerate(order):
        labels = np.empty(lengths[x], dtype=np.int64)
        at = final[x]
        for t in range(int(lengths[x]) - 1, -1, -1):
            labels[t] = at
            if t:
                at = int(back[t][x, at])
        out[i] = labels
    return out


def label(scorer: Scorer, texts: list[str | None], switch: float = SWITCH) -> list[tuple[list[tuple[int, int, int]], list[int]]]:
    """Per text: spans (first word, past the last, language) over its words, and letter words by language."""
    split = [t.encode("utf-8", "surrogatepass").split() if t else [] for t in texts]
    k = len(scorer.model.langs)
    if not k or not any(split):
        return [([], [0] * k) for _ in texts]
    ids, rows = scorer.matrix(split)
    letter = ids > 0
    lengths = np.array([len(w) for w in split])
    of = np.repeat(np.arange(len(split)), lengths)
    ids, of = ids[letter], of[letter]
    place = (np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths))[letter]
    n = np.bincount(of, minlength=len(split))
    s = rows[ids].astype(np.float64)
    total = np.stack([np.bincount(of, weights=s[:, j], minlength=len(split)) for j in range(k)], axis=1)
    best = total.argmax(1)
    gain = np.zeros(len(split))
    far = 4 * CLIP * (len(ids) + 1)
    base = s[np.arange(len(s)), best[of]]
    first = np.append(True, of[1:] != of[:-1])
    down = far * np.cumsum(first)  # each text lies lower than all before, so running minima start afresh
    for j in range(k):
        run = np.cumsum(s[:, j] - base)
        before = np.append(0.0, run[:-1]) - down  # the sum up to a word, without it
        np.maximum.at(gain, of, run - down - np.minimum.accumulate(before))
    mixed = np.flatnonzero((gain > switch / 2) & (n > 1))
    edge = np.searchsorted(of, np.arange(len(split) + 1))
    labels = dict(zip(mixed.tolist(), viterbi([s[edge[d] : edge[d + 1]] for d in mixed], switch))) if len(mixed) else {}
    out = []
    for d in range(len(split)):
        if not n[d]:
            out.append(([], [0] * k))
        elif d not in labels:
            counts = [0] * k
            counts[best[d]] = int(n[d])
            out.append(([(0, int(lengths[d]), int(best[d]))], counts))
        else:
            lab = labels[d]
            turns = np.flatnonzero(np.diff(lab)) + 1
            at = [0, *place[edge[d] + turns].tolist(), int(lengths[d])]
            kinds = lab[np.append(0, turns)].tolist()
            out.append((list(zip(at, at[1:], kinds)), np.bincount(lab, minlength=k).tolist()))
    return out


def fit(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", max_docs: int = MAX_DOCS, min_count: int = MIN_COUNT) -> Model:
    """A model of the rows with a lang and a text: about ``max_docs`` of them.

    What comes to the driver is bounded by them: words that occur ``min_count`` times or more in a
    language, and the trigrams of all words.  Repeated rows count as often as they are there; no
    rows, or none with a word, give a model without languages.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    n = rows.select(lang_col).count()
    if n > max_docs:
        rows = rows.where(F.pmod(F.xxhash64(id_col), F.lit(1_000_000)) < F.lit(int(1_000_000 * max_docs / n)))
    rows = rows.select(F.col(lang_col).alias("lang"), F.explode(words(F.col(text_col))).alias("chunk"))
    word = F.regexp_replace(F.lower("chunk"), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    counts = rows.select("lang", word.alias("word")).where(F.rlike("word", F.lit(r"\p{L}"))).groupBy("lang", "word").count()
    counts = materialise(counts, "language-words")
    padded = F.concat(F.lit(" "), "word", F.lit(" "))
    grams = F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.substring(padded, i, F.lit(3)))
    grams = counts.select("lang", F.explode(grams).alias("gram"), "count").groupBy("lang", "gram").agg(F.sum("count").alias("count"))
    words_ = counts.where(F.col("count") >= min_count).select("lang", "word", "count")
    return Model.fit(map(tuple, words_.collect()), map(tuple, grams.collect()))


def identify(docs: DataFrame, model: Model, keep: list[Column] = (), text_col: str = "text", switch: float = SWITCH, with_spans: bool = False) -> DataFrame:
    """Adds lang_pred, score (and spans: first word, past the last, lang) to the columns keep.

    lang_pred is the language of most words with a letter (ties: the first by name); score their
    share.  A text that is null or has no letter, or an empty model: ``und`` and 0.  Repeated rows and
    null ids stay; a very long text is labelled as a whole; an empty table gives no rows.
    """
    base = docs.select(*keep, F.col(text_col).alias("_text"))
    schema = StructType(base.schema.fields[:-1]).add("lang_pred", "string").add("score", "double")
    if with_spans:
        schema = schema.add(StructType.fromDDL("spans array<struct<first:int,past:int,lang:string>>").fields[0])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        scorer = Scorer(m)
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            done = [x for a, b in slices(texts, SLICE_CHARS) for x in label(scorer, texts[a:b], switch)]
            sums = [sum(c) for _, c in done]
            pred = [max(range(len(c)), key=lambda j: (c[j], -j)) if n else None for (_, c), n in zip(done, sums)]
            cols = [batch.column(i) for i in range(batch.num_columns - 1)]
            cols.append(pa.array(["und" if p is None else m.langs[p] for p in pred], pa.string()))
            cols.append(pa.array([0.0 if p is None else c[p] / n for p, (_, c), n in zip(pred, done, sums)], pa.float64()))
            if with_spans:
                kind = pa.list_(pa.struct([("first", pa.int32()), ("past", pa.int32()), ("lang", pa.string())]))
                cols.append(pa.array([[{"first": a, "past": b, "lang": m.langs[j]} for a, b, j in s] for s, _ in done], kind))
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return base.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, mod 4, is 2; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, whole texts, by a model of the rows that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out() & F.col("doc_id").isNotNull()))
    return identify(docs, model, [F.col("doc_id"), held_out().alias("held_out")])


QUERIES = {"op7_language": op7_language}
ORACLES: dict[str, str] = {}
