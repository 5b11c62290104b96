"""SentencePiece encoding and decoding; giant documents by a max-plus parallel scan (operator 2)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brickwise.llm.common import stage, text_or_empty

#: Documents of more characters are cut into chunks of so many, which are encoded independently.
CHUNK = 1 << 16
#: Bytes of short texts that are encoded at once.
PORTION = 1 << 20
#: Pairs of neighbours that a task remembers; workers outlive tasks, so it forgets them at its end.
PAIRS = 1 << 16
#: Chunk matrices that one task combines; their products are combined likewise.
FAN = 256
SPACE = "▁"
#: A boundary state is edge * s + e: the token over the last character before the boundary starts s characters
#: before it and ends e characters behind it, and no piece has edge characters. Before the first chunk there is no token.
START = 0
STATES = "array<struct<i:int,o:int,w:double>>"


def is_scannable(model: bytes) -> bool:
    """Whether the scan knows what the model does: BPE without user-defined pieces, of texts that are left as they are but
    for a blank before them and U+2581 in place of blanks."""
    from sentencepiece import sentencepiece_model_pb2

    spec = sentencepiece_model_pb2.ModelProto()
    spec.ParseFromString(model)
    norm, kinds = spec.normalizer_spec, spec.trainer_spec
    same = not norm.precompiled_charsmap and norm.add_dummy_prefix and not norm.remove_extra_whitespaces and norm.escape_whitespaces
    plain = not any(p.type == spec.SentencePiece.USER_DEFINED for p in spec.pieces)
    return bool(same and plain and kinds.model_type == kinds.BPE and kinds.byte_fallback and not kinds.treat_whitespace_as_suffix)


class Pieces:
    """The model's pieces, and which neighbours an encoding can have.

    Merging always joins the best pair of neighbours whose joint piece exists, so a sequence of pieces
    is the encoding of its text exactly if every two neighbours are the encoding of theirs. That makes
    the encoding the one path of a lattice that joins only such neighbours: a max-plus problem with
    weight minus infinity for any other pair."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_proto=model)
        m = self.model
        plain = [i for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        self.score = {m.id_to_piece(i): m.get_score(i) for i in plain}
        self.ids = {m.id_to_piece(i): i for i in plain}
        self.longest = max(map(len, self.score), default=1)
        self.edge = self.longest + 1
        self.bytes = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.fits = lru_cache(PAIRS)(self._fits)

    def merged(self, text: str) -> list[str]:
        """The encoding of a short text, by definition."""
        parts = list(text)
        while True:
            best = max(((self.score[a + b], -k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.score), default=None)
            if best is None:
                return parts
            k = -best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def _fits(self, left: str, right: str) -> bool:
        return self.merged(left + right) == ([left, right] if left else [right])

    def to_ids(self, piece: str) -> list[int]:
        found = self.ids.get(piece)
        return [found] if found is not None else [self.bytes[b] for b in piece.encode()]


def _cuts(text: str, lo: int, hi: int) -> list[int]:
    """The first and the last place in lo..hi where a word begins behind something else: no piece goes over."""
    first = next((k for k in range(lo, hi) if text[k] == SPACE and text[k - 1] != SPACE), None)
    if first is None:
        return []
    last = next(k for k in range(hi - 1, first - 1, -1) if text[k] == SPACE and text[k - 1] != SPACE)
    return [first, last]


def _lattice(p: Pieces, text: str, begin: dict[int, list[tuple[str, int]]], stop: int) -> list[dict]:
    """From start tokens (their end, with their text and label) all compatible paths until they pass stop:
    by place, token (its start, its text) -> {label: (weight, start of the token before, text before)}."""
    reach: list[dict] = [{} for _ in range(len(text) + 1)]
    for at, tokens in begin.items():
        for token, label in tokens:
            reach[at].setdefault((at - len(token), token), {})[label] = (0.0, None)
    for at in range(stop):
        if not reach[at]:
            continue
        for size in range(1, min(p.longest, len(text) - at) + 1):
            piece = text[at : at + size]
            if size > 1 and piece not in p.score:
                continue
            gain = p.score.get(piece, 0.0)
            for before, labels in reach[at].items():
                if p.fits(before[1], piece):
                    into = reach[at + size].setdefault((at, piece), {})
                    for label, (weight, _) in labels.items():
                        if label not in into or into[label][0] < weight + gain:
                            into[label] = (weight + gain, before)
    return reach


def _states(p: Pieces, text: str, at: int) -> list[tuple[int, int, str]]:
    """The tokens (s, e, piece) that may lie over the character before a place of a text."""
    out = []
    for s in range(1, min(p.longest, at) + 1):
        for e in range(0, min(p.longest - s, len(text) - at) + 1):
            piece = text[at - s : at + e]
            if s + e == 1 or (piece in p.score and p.fits("", piece)):
                out.append((s, e, piece))
    return out


def _begins(p: Pieces, text: str, left: int, first: bool) -> dict[int, list[tuple[str, int]]]:
    if first:
        return {0: [("", START)]}
    begin: dict[int, list[tuple[str, int]]] = {}
    for s, e, piece in _states(p, text, left):
        begin.setdefault(left + e, []).append((piece, p.edge * s + e))
    return begin


def _ends(p: Pieces, reach: list[dict], right: int) -> Iterator[tuple[int, tuple, int]]:
    """(out state, token, end) of all tokens over the character before a place."""
    for end in range(right, min(len(reach), right + p.edge)):
        for start, piece in reach[end]:
            if start < right:
                yield p.edge * (right - start) + end - right, (start, piece), end


def transfer(p: Pieces, text: str, left: int, right: int, first: bool) -> list[tuple[int, int, float]]:
    """The sparse max-plus matrix of the chunk left..right of a text with context: (in, out, weight)."""
    begin = _begins(p, text, left, first)
    cuts = _cuts(text, left + p.longest, right - p.longest) if right - left > 2 * p.longest else []
    if not cuts:
        reach = _lattice(p, text, begin, right)
        return [(i, o, w[0]) for o, token, end in _ends(p, reach, right) for i, w in reach[end][token].items()]
    # Words between two cuts are the library's; the matrix is the product of its outer parts.
    head = _lattice(p, text[: cuts[0]], begin, cuts[0])
    heads: dict[int, float] = {}
    for labels in head[cuts[0]].values():
        for i, (w, _) in labels.items():
            heads[i] = max(heads.get(i, w), w)
    tail = _lattice(p, text[cuts[1] :], {0: [("", START)]}, right - cuts[1])
    tails = {o: tail[end][token][START][0] for o, token, end in _ends(p, tail, right - cuts[1])}
    return [(i, o, a + b) for i, a in heads.items() for o, b in tails.items()]


def product(a: list, b: list) -> list[tuple[int, int, float]]:
    """The max-plus product of two sparse matrices."""
    rows: dict[int, list[tuple[int, float]]] = {}
    for i, o, w in b:
        rows.setdefault(i, []).append((o, w))
    best: dict[tuple[int, int], float] = {}
    for i, k, w in a:
        for o, v in rows.get(k, ()):
            if best.get((i, o), float("-inf")) < w + v:
                best[i, o] = w + v
    return [(i, o, w) for (i, o), w in best.items()]


def best_states(matrices: list[list], start: int, end: int | None) -> list[int]:
    """The states at all boundaries of a chain of matrices on its best path from start to end (None: any)."""
    ahead: list[dict[int, tuple[float, int]]] = [{start: (0.0, -1)}]
    for m in matrices:
        row: dict[int, tuple[float, int]] = {}
        for i, o, w in m:
            if i in ahead[-1] and (o not in row or row[o][0] < ahead[-1][i][0] + w):
                row[o] = (ahead[-1][i][0] + w, i)
        ahead.append(row)
    state = end if end is not None else max(ahead[-1], key=lambda o: ahead[-1][o][0])
    out = [state]
    for row in reversed(ahead[1:]):
        state = row[state][1]
        out.append(state)
    return out[::-1]


def backtrace(p: Pieces, text: str, left: int, right: int, first: bool, enter: int, leave: int) -> list[int]:
    """The ids of the tokens of a chunk, those that start in it, between two known boundary states."""
    at = 0 if first else left + enter % p.edge
    before = "" if first else text[left - enter // p.edge : at]
    end, start = right + leave % p.edge, right - leave // p.edge
    cuts = _cuts(text, left + p.longest, right - p.longest) if right - left > 2 * p.longest else []

    def path(reach: list[dict], end: int, token: tuple, label: int) -> list[int]:
        out = []
        while True:
            prior = reach[end][token][label][1]
            if prior is None:
                break
            out.append(token[1])
            end, token = token[0], prior
        return [k for piece in reversed(out) for k in p.to_ids(piece)]

    if end <= at:  # the token that comes in covers the chunk
        return []
    if not cuts:
        reach = _lattice(p, text, {at: [(before, 1)]}, right)
        return path(reach, end, (start, text[start:end]), 1)
    head = _lattice(p, text[: cuts[0]], {at: [(before, 1)]}, cuts[0])
    token = next(t for t, labels in head[cuts[0]].items() if 1 in labels)
    out = path(head, cuts[0], token, 1)
    out += p.model.encode(text[cuts[0] + 1 : cuts[1]]) if cuts[1] > cuts[0] else []
    tail = _lattice(p, text[cuts[1] :], {0: [("", 1)]}, right - cuts[1])
    return out + path(tail, end - cuts[1], (start - cuts[1], text[start:end]), 1)


_made: list = []


def _pieces(model: bytes) -> Pieces:
    """One for each worker process and model."""
    if not _made or _made[0] != model:
        _made[:] = [model, Pieces(model)]
    return _made[1]


def _portions(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch of (doc_id, text) in slices of about PORTION bytes of text, one row at least: ids are Python numbers of many bytes each
    before they are Arrow's."""
    ends = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PORTION, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def encode_documents(docs: DataFrame, model_path: str, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_tokens, ids, lossless) for every row of docs(doc_id, text): the library's ids, and whether
    they decode to the text again.

    A null or empty text has no tokens and is lossless. The model writes a blank as U+2581, so a text
    that holds that character decodes to blanks in its place and isn't lossless. Texts of up to `chunk`
    characters are one call of the library. Longer ones are cut; each chunk yields the matrix of the
    weights between the tokens over its two boundaries, products of neighbouring matrices are combined
    in groups of FAN, and with the best states known each chunk is encoded and decoded on its own.
    Repeated rows and null ids keep a row each; other columns are ignored; an empty table gives an
    empty result. The model file is read on the driver and broadcast. With a model of another kind than is_scannable
    tells, long texts are one call of the library too."""
    with open(model_path, "rb") as f:
        model = f.read()
    sent = docs.sparkSession.sparkContext.broadcast(model)
    scannable, edge = is_scannable(model), Pieces(model).edge
    chunk = max(chunk, 2 * edge)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    out = "doc_id long, n_tokens int, ids array<int>, lossless boolean"

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _pieces(sent.value).model
        for batch in batches:
            for part in _portions(batch):
                texts = part.column(1).to_pylist()
                ids = model.encode(texts, num_threads=1)
                same = pa.array([a == b for a, b in zip(model.decode(ids, num_threads=1), texts, strict=True)])
                del texts
                counts = pa.array(list(map(len, ids)), pa.int32())
                listed = pa.array(ids, pa.list_(pa.int32()))
                del ids
                yield pa.RecordBatch.from_arrays([part.column(0), counts, listed, same], names=["doc_id", "n_tokens", "ids", "lossless"])

    if not scannable:
        return rows.select("doc_id", "text").mapInArrow(whole, out)
    small = rows.where(F.length("text") <= chunk).select("doc_id", "text").mapInArrow(whole, out)

    # Chunks carry so much of their neighbours as a piece can reach.
    text = F.concat(F.lit(SPACE), F.replace("text", F.lit(" "), F.lit(SPACE)))
    giant = rows.where(F.length("text") > chunk).select("row", "doc_id", F.col("text").contains(SPACE).alias("marked"), text.alias("text"))
    n = F.ceil(F.length("text") / chunk).cast("int")
    lo = lambda k: F.greatest(k * chunk - edge, F.lit(0))
    each = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(k.alias("k"), (k * chunk - lo(k)).alias("left"), F.least(F.lit(chunk), F.length("text") - k * chunk).alias("size"), F.substring(F.col("text"), lo(k) + 1, F.lit(chunk) + 2 * edge).alias("part")))
    chunks = giant.select("row", "doc_id", "marked", F.explode(each).alias("c")).select("row", "doc_id", "marked", "c.*")
    chunks = stage(chunks.repartition("row", "k"), "chunks")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = _pieces(sent.value)
        for batch in batches:
            r = batch.to_pydict()
            found = [[dict(zip("iow", x, strict=True)) for x in transfer(p, t, a, a + s, k == 0)] for k, a, s, t in zip(r["k"], r["left"], r["size"], r["part"], strict=True)]
            kind = pa.list_(pa.struct([("i", pa.int32()), ("o", pa.int32()), ("w", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("k"), pa.array(found, kind)], names=["row", "k", "m"])
        p.fits.cache_clear()

    matrices = stage(chunks.select("row", "k", "left", "size", "part").mapInArrow(measure, f"row long, k int, m {STATES}"), "matrices")
    matrices = matrices.withColumn("g", F.floor(F.col("k") / FAN).cast("int"))
    entries = lambda m: [(x["i"], x["o"], x["w"]) for x in m]

    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        out = entries(pdf["m"].iloc[0])
        for m in pdf["m"].iloc[1:]:
            out = product(out, entries(m))
        return pd.DataFrame({"row": [pdf["row"].iloc[0]], "g": [pdf["g"].iloc[0]], "m": [[{"i": i, "o": o, "w": w} for i, o, w in out]]})

    def along(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("g")
        states = best_states([entries(m) for m in pdf["m"]], START, None)
        return pd.DataFrame({"row": pdf["row"], "g": pdf["g"], "enter": states[:-1], "leave": states[1:]})

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        states = best_states([entries(m) for m in pdf["m"]], int(pdf["enter"].iloc[0]), int(pdf["leave"].iloc[0]))
        return pd.DataFrame({"row": pdf["row"], "k": pdf["k"], "enter": states[:-1], "leave": states[1:]})

    groups = matrices.groupBy("row", "g").applyInPandas(combine, f"row long, g int, m {STATES}")
    ends = groups.groupBy("row").applyInPandas(along, "row long, g int, enter int, leave int")
    states = matrices.join(ends, ["row", "g"]).groupBy("row", "g").applyInPandas(within, "row long, k int, enter int, leave int")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = _pieces(sent.value)
        for batch in batches:
            r = batch.to_pydict()
            ids, same = [], []
            for k, a, s, t, i, o in zip(r["k"], r["left"], r["size"], r["part"], r["enter"], r["leave"], strict=True):
                found = backtrace(p, t, a, a + s, k == 0, i, o)
                body = t[(0 if k == 0 else a + i % p.edge) : a + s + o % p.edge]
                ids.append(found)
                # Decoding drops the blank that was put before the text; here it is put before every chunk.
                same.append(p.model.decode([p.ids[SPACE], *found]) == body.replace(SPACE, " "))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(ids, pa.list_(pa.int32())), pa.array(same)], names=["row", "doc_id", "marked", "k", "ids", "same"])
        p.fits.cache_clear()

    encoded = chunks.join(states, ["row", "k"]).select("row", "doc_id", "marked", "k", "left", "size", "part", "enter", "leave")
    parts = encoded.mapInArrow(write, "row long, doc_id long, marked boolean, k int, ids array<int>, same boolean")
    joined = parts.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("p"), F.min(F.col("same") & ~F.col("marked")).alias("lossless"))
    ids = F.flatten(F.transform("p", lambda x: x["ids"]))
    return small.union(joined.select("doc_id", ids.alias("ids"), "lossless").select("doc_id", F.size("ids").alias("n_tokens"), "ids", "lossless"))


def decode_documents(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, text) of encoded(doc_id, ids); null ids count as none, unknown ids raise the library's error."""
    with open(model_path, "rb") as f:
        sent = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _pieces(sent.value).model
        for batch in batches:
            texts = model.decode([x or [] for x in batch.column(1).to_pylist()], num_threads=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")
