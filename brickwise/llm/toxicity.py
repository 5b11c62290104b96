"""Toxicity scores by gradient-boosted trees over dense features (operator 9)."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from brickwise.llm.boosting import Trees, isotonic
from brickwise.llm.common import text_or_empty
from brickwise.llm.labels import fold, training_rows

FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.7
#: Labelled documents from which lexicon and trees are learned, at most.
TRAINING_ROWS = 12_000
#: An entry needs so many toxic documents, and such a log ratio of its shares in either class.
LEAST_DOCS, LEAST_RATIO = 4, 1.2
#: Beginnings of words that may become entries, in letters.
PREFIXES = (4, 5, 6, 7, 8)
NEAR = 5
#: A small hand-made list of insults.
INSULTS = frozenset("bastard bitch clown coward crap creep cretin damn dimwit disgusting dumb dumbass fool freak garbage hate idiot idiotic imbecile jerk kill lame liar loser maggot moron moronic pathetic pig psycho retard scum shit shut slut stupid sucker trash ugly useless vermin whore worthless".split())
SECOND_PERSON = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine deiner ihr euch euer sie ustedes usted tú ti tus vosotros vuestro".split())
WORD = re.compile(r"[^\W_]+")
UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
MARKS = re.compile(r"[^\w\s]")
MIXED = re.compile(r"[^\W\d_]+[0-9@$*!#]+[^\W\d_]+\w*")
PLAIN = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": "", "#": ""})
FEATURES = 16


class Weights(dict):
    """The learned weight of a word: the largest of its own entry and those of its beginnings, else 0."""

    def __init__(self, lexicon: dict[str, float], room: int = 300_000):
        super().__init__()
        self.lexicon, self.room = lexicon, room

    def __missing__(self, word: str) -> float:
        if len(self) >= self.room:
            self.clear()
        get = self.lexicon.get
        found = self[word] = max(get(word, 0.0), *(get(word[:k] + "*", 0.0) for k in PREFIXES if len(word) > k), 0.0)
        return found


def features(text: str, weights: Weights) -> list[float]:
    """The dense features of a text; an empty one has zeros."""
    words = WORD.findall(text.lower())
    n = len(words)
    if not n:
        return [0.0] * FEATURES
    insults = [i for i, w in enumerate(words) if w in INSULTS]
    weight = list(map(weights.__getitem__, words))
    hits = [i for i, w in enumerate(weight) if w]
    strong = sorted({words[i]: weight[i] for i in hits}.values(), reverse=True)
    spoken = [i for i, w in enumerate(words) if w in SECOND_PERSON]
    near = 0
    for i in sorted({*insults, *hits}) if spoken else ():
        at = bisect_left(spoken, i)
        near += any(abs(spoken[k] - i) <= NEAR for k in (at - 1, at) if 0 <= k < len(spoken))
    mixed = MIXED.findall(text)
    hidden = sum((p := m.lower().translate(PLAIN)) in INSULTS or weights[p] > 0 for m in mixed)
    chars = len(text)
    marks = len(MARKS.findall(text))
    upper = len(UPPER.findall(text))
    return [
        math.log(n), math.log1p(len(insults)), 100 * len(insults) / n,
        math.log1p(len(hits)), 100 * len(hits) / n, float(len(strong)), strong[0] if strong else 0.0, sum(strong[:3]), 100 * sum(weight) / n,
        math.log1p(near), upper / chars, sum(map(str.isupper, text.split())) / n,
        (text.count("!") + text.count("?")) / n, marks / n, len(mixed) / n, float(hidden),
    ]


def _grams(text: str):
    """The distinct words and beginnings of words in a text column."""
    words = F.array_distinct(F.filter(F.split(F.lower(text), r"[\s\p{Punct}]+"), lambda w: w != ""))
    starts = [F.transform(F.filter(words, lambda w, k=k: F.length(w) > k), lambda w, k=k: F.concat(F.substring(w, 1, k), F.lit("*"))) for k in PREFIXES]
    return F.array_distinct(F.concat(words, *starts))


def learn_lexicons(rows: DataFrame) -> tuple[dict[str, float], list[dict[str, float]]]:
    """The lexicon of all training rows, and those of either half for the other half's features, so that trees
    aren't fitted on words that were picked by the same labels. Counted in one aggregation; what comes
    to the driver are the entries with enough toxic documents in the bounded sample."""
    half = F.pmod(F.xxhash64("pick", F.lit("half")), F.lit(2))
    rows = rows.withColumn("half", half)
    totals = [[0, 0], [0, 0]]
    for r in rows.groupBy("half", "y").agg(F.count("*").alias("n")).collect():
        totals[r["half"]][int(r["y"] > 0)] += r["n"]
    grams = rows.select("half", "y", F.explode(_grams("text")).alias("gram"))
    count = lambda h, y: F.sum(((F.col("half") == h) & ((F.col("y") > 0) == F.lit(bool(y)))).cast("long")).alias(f"c{h}{y}")
    counts = grams.groupBy("gram").agg(*[count(h, y) for h in (0, 1) for y in (0, 1)]).where(F.col("c01") + F.col("c11") >= LEAST_DOCS)

    def ratio(neg, pos, n):
        return F.log((pos + 0.5) / (n[1] + 1) / ((neg + 0.5) / (n[0] + 1)))

    whole = [totals[0][y] + totals[1][y] for y in (0, 1)]
    neg, pos = F.col("c00") + F.col("c10"), F.col("c01") + F.col("c11")
    ratios = counts.select("gram", pos.alias("pos"), ratio(neg, pos, whole).alias("all"), *[F.when(F.col(f"c{h}1") * 2 >= LEAST_DOCS, ratio(F.col(f"c{h}0"), F.col(f"c{h}1"), totals[h])).otherwise(0.0).alias(f"h{h}") for h in (0, 1)])
    best = ratios.where(F.greatest("all", "h0", "h1") >= LEAST_RATIO).collect()
    pick = lambda name: {r["gram"]: r[name] for r in best if r[name] >= LEAST_RATIO}
    return pick("all"), [pick("h1"), pick("h0")]


class Model:
    """Lexicon, trees and calibration; constant if the training rows lack a class."""

    def __init__(self, lexicon, trees, knots, constant=0.0):
        self.lexicon, self.trees, self.knots, self.constant = lexicon, trees, knots, constant

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.constant)
        return np.clip(np.interp(self.trees.raw(x), *self.knots), 0.0, 1.0)


def train(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, held: tuple[int, ...] = (HELD_OUT,), most: int = TRAINING_ROWS) -> Model:
    """Learn from at most `most` labelled rows outside the held folds. Their features (16 numbers each) are
    computed on the executors and fitted on the driver; calibration takes out-of-fold scores."""
    rows = training_rows(docs, labels, "toxic", folds, held, most)
    lexicon, halves = learn_lexicons(rows)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = [Weights(x) for x in halves]
        for batch in batches:
            ys, hs, texts = (batch.column(k).to_pylist() for k in range(3))
            found = [features(t, weights[h]) for h, t in zip(hs, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ys, pa.int32()), pa.array(found, pa.list_(pa.float64()))], names=["y", "x"])

    half = F.pmod(F.xxhash64("pick", F.lit("half")), F.lit(2)).cast("int")
    got = rows.select("y", half.alias("half"), "text").mapInArrow(measure, "y int, x array<double>").toArrow()
    y = (np.array(got.column("y").to_pylist(), dtype=np.float64) > 0).astype(np.float64)
    if not len(y) or y.min() == y.max():
        return Model(lexicon, None, None, float(y.mean()) if len(y) else 0.0)
    x = np.array(got.column("x").to_pylist())
    order = np.lexsort((*x.T, y))  # the rows come in any order
    x, y = x[order], y[order]
    part = np.arange(len(y)) % 5
    out = np.zeros(len(y))
    for k in range(5):
        if len(set(y[part != k])) == 2:
            out[part == k] = Trees().fit(x[part != k], y[part != k]).raw(x[part == k])
    return Model(lexicon, Trees().fit(x, y), isotonic(out, y))


def score(docs: DataFrame, model: Model, name: str = "score", with_text: bool = False) -> DataFrame:
    """All columns of docs, text only if asked for, with a score column of the given name, in one pass without a
    shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    # Names go by place, as those of docs may be any.
    at_text = docs.columns.index("text")
    rows = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    kept = [k for k in range(len(docs.columns)) if with_text or k != at_text]
    schema = StructType([rows.schema[k] for k in kept]).add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = Weights(sent.value.lexicon)
        for batch in batches:
            found = [np.zeros(0)]
            for at in range(0, batch.num_rows, 512):
                x = np.array([features(t or "", weights) for t in batch.column(at_text).slice(at, 512).to_pylist()])
                found.append(sent.value.score(x))
            columns = [batch.column(k) for k in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate(found), pa.float64())], names=schema.names)

    return rows.mapInArrow(run, schema).toDF(*[docs.columns[k] for k in kept], name)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs(doc_id, text).

    Only text is an input of a score. A null text counts as empty and has the score of zero features;
    repeated rows keep a row each; a null id keeps its row. Without labels of both classes the score
    is the share of toxic rows (0 without any). Other columns are ignored; an empty table gives an
    empty result."""
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), train(docs, labels))
    return scored.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
