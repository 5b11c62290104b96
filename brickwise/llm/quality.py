"""Quality scores by votes of the nearest labelled vectors in a latent-semantic space (operator 6)."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brickwise.llm.common import text_or_empty
from brickwise.llm.labels import fold, training_rows

FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
#: Labelled documents that are broadcast as vectors, at most.
TRAINING_ROWS = 4_000
#: A term of the latent space stands in so many of the labelled documents at least; the space has so many dimensions.
LEAST_DOCS, DIMENSIONS = 3, 48
NEIGHBOURS = 15
#: Documents whose products with all labelled vectors are computed together.
BLOCK = 512
LETTERS = re.compile(r"[^\W\d_]+")
DIGITS = re.compile(r"\d+")


class Shapes(dict):
    """The terms of a token: its word, and its outline if it is more than a word with a comma or full stop."""

    def __init__(self, room: int = 300_000):
        super().__init__()
        self.room = room

    def __missing__(self, token: str) -> tuple[str, ...]:
        if len(self) >= self.room:
            self.clear()
        word = token.strip(".,;:!?\"'()").lower()
        out = [word] if word.isalpha() else []
        outline = DIGITS.sub("0", LETTERS.sub(lambda m: "A" if len(m[0]) > 1 and m[0].isupper() else "a", token.rstrip(".,")))
        if outline != "a":
            out.append("\x02" + outline)
        found = self[token] = tuple(out)
        return found


def terms(text: str, shapes: Shapes) -> Counter:
    """Terms with their counts: words, outlines of odd tokens, and marks for what a bag of words can't tell:
    repetition of neighbours, share of distinct words, and length."""
    tokens = text.split()
    out = Counter()
    for token, n in Counter(tokens).items():
        for t in shapes[token]:
            out[t] += n
    total = len(tokens)
    if total:
        again = sum(map(str.__eq__, tokens, tokens[1:]))
        lines = text.split("\n")
        out[f"\x01again{round(8 * again / total)}"] = total
        out[f"\x01distinct{round(8 * len(set(tokens)) / total)}"] = total
        out[f"\x01lines{round(4 * len(set(lines)) / len(lines))}"] = total
    out[f"\x01length{min(total, 1 << 15).bit_length()}"] = max(1, total // 4)
    return out


class Space:
    """Vocabulary, weights and projection of the latent space, and the labelled vectors in it."""

    def __init__(self, vocabulary: dict[str, int], idf: np.ndarray, basis: np.ndarray, vectors: np.ndarray, labels: np.ndarray):
        self.vocabulary, self.idf, self.basis, self.vectors, self.labels = vocabulary, idf, basis, vectors, labels

    def project(self, counts: list[Counter]) -> np.ndarray:
        """Unit vectors of documents; one without a known term is zero."""
        out = np.zeros((len(counts), self.basis.shape[1]), dtype=np.float32)
        get = self.vocabulary.get
        for row, found in enumerate(counts):
            pairs = [(k, n) for t, n in found.items() if (k := get(t)) is not None]
            if pairs:
                at, n = np.array(pairs, dtype=np.float64).T
                at = at.astype(np.int64)
                w = (1 + np.log(n)) * self.idf[at]
                out[row] = (w / np.linalg.norm(w)) @ self.basis[at]
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    def vote(self, vectors: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
        """The exact nearest labelled vectors by cosine, their labels weighted by similarity; the overall share
        of label 1 counts as one weak neighbour, so that a vector near nothing has that score."""
        if not len(self.labels):
            return np.zeros(len(vectors))
        near = vectors @ self.vectors.T
        k = min(neighbours, near.shape[1])
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(near, top, axis=1).astype(np.float64), 0.0) ** 4
        return ((weight * self.labels[top]).sum(axis=1) + 0.01 * self.labels.mean()) / (weight.sum(axis=1) + 0.01)


class Sparse:
    """A sparse matrix by rows, and its products with narrow dense ones from either side."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], width: int):
        self.shape = (len(rows), width)
        self.row = np.repeat(np.arange(len(rows)), [len(at) for at, _ in rows])
        self.at = np.concatenate([np.zeros(0, np.int64), *[at for at, _ in rows]])
        self.value = np.concatenate([np.zeros(0), *[w for _, w in rows]]).astype(np.float32)

    @staticmethod
    def _summed(keys: np.ndarray, from_: np.ndarray, value: np.ndarray, dense: np.ndarray, count: int) -> np.ndarray:
        out = np.zeros((count, dense.shape[1]), dtype=np.float32)
        by = np.argsort(keys, kind="stable")
        for lo in range(0, len(by), 1 << 18):
            some = by[lo : lo + (1 << 18)]
            k = keys[some]
            heads = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            out[k[heads]] += np.add.reduceat(value[some, None] * dense[from_[some]], heads, axis=0)
        return out

    def times(self, dense: np.ndarray) -> np.ndarray:
        return self._summed(self.row, self.at, self.value, dense, self.shape[0])

    def turned_times(self, dense: np.ndarray) -> np.ndarray:
        return self._summed(self.at, self.row, self.value, dense, self.shape[1])


def _latent(rows: list[tuple[np.ndarray, np.ndarray]], width: int, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """idf and the leading right singular vectors of the weighted term matrix, by subspace iteration."""
    df = np.zeros(width)
    for at, _ in rows:
        df[at] += 1
    idf = np.log((1 + len(rows)) / (1 + df)) + 1
    weighted = []
    for at, n in rows:
        w = (1 + np.log(n)) * idf[at]
        weighted.append((at, w / np.linalg.norm(w) if len(w) else w))
    matrix = Sparse(weighted, width)
    rng = np.random.default_rng(0)
    basis = np.linalg.qr(rng.normal(size=(width, min(dimensions + 16, width))))[0].astype(np.float32)
    for _ in range(6):
        basis = np.linalg.qr(matrix.turned_times(matrix.times(basis)))[0]
    _, _, turn = np.linalg.svd(matrix.times(basis), full_matrices=False)
    return idf, (basis @ turn.T)[:, :dimensions].astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, held: tuple[int, ...] = (HELD_OUT,), most: int = TRAINING_ROWS) -> Space:
    """The space of at most `most` labelled rows outside the held folds. Executors count terms; the driver
    gets those that LEAST_DOCS rows of the bounded sample have, then a few hundred numbers for each row."""
    rows = training_rows(docs, labels, "quality", folds, held, most)

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = Shapes()
        for batch in batches:
            found = Counter(t for text in batch.column(0).to_pylist() for t in terms(text, shapes))
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["term", "n"])

    common = rows.select("text").mapInArrow(seen, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    words = sorted(r["term"] for r in common.where(F.col("n") >= LEAST_DOCS).select("term").toLocalIterator())
    vocabulary = {t: k for k, t in enumerate(words)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = Shapes()
        for batch in batches:
            at, n = [], []
            for text in batch.column(2).to_pylist():
                pairs = [(vocabulary[t], c) for t, c in terms(text, shapes).items() if t in vocabulary]
                at.append([k for k, _ in pairs])
                n.append([c for _, c in pairs])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at, pa.list_(pa.int32())), pa.array(n, pa.list_(pa.int32()))], names=["pick", "y", "at", "n"])

    got = sorted(rows.mapInArrow(count, "pick long, y int, at array<int>, n array<int>").collect(), key=lambda r: (r["pick"], r["at"], r["n"]))
    pairs = [(np.array(r["at"], dtype=np.int64), np.array(r["n"], dtype=np.float64)) for r in got]
    if not pairs or not vocabulary:
        return Space({}, np.zeros(0), np.zeros((0, 1), dtype=np.float32), np.zeros((0, 1), dtype=np.float32), np.zeros(0))
    idf, basis = _latent(pairs, len(vocabulary), DIMENSIONS)
    space = Space(vocabulary, idf, basis, basis, np.zeros(0))
    space.vectors = space.project([Counter({words[k]: c for k, c in zip(r["at"], r["n"], strict=True)}) for r in got])
    space.labels = np.array([float(r["y"] > 0) for r in got])
    return space


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs(doc_id, text), in one pass without a shuffle.

    Only text is an input of a score. A null text counts as empty, whose terms say so; repeated rows
    keep a row each; a null id keeps its row. Without labels the score is 0. Other columns are
    ignored; an empty table gives an empty result. The labelled vectors are TRAINING_ROWS times
    DIMENSIONS numbers at most, whatever the corpus."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, shapes = sent.value, Shapes()
        for batch in batches:
            found = [np.zeros(0)]
            for at in range(0, batch.num_rows, BLOCK):
                texts = batch.column(1).slice(at, BLOCK).to_pylist()
                found.append(space.vote(space.project([terms(t, shapes) for t in texts])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.clip(np.concatenate(found), 0, 1), pa.float64())], names=["doc_id", "score"])

    scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
