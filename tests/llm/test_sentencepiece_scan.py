import random

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor

from brickwise.llm import sentencepiece_scan as scan

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pieces():
    with open(PATH, "rb") as f:
        return scan.Pieces(f.read())


def texts():
    rnd = random.Random(8)
    words = ["the", "token", "encoding", "été", "Straße", "niño", "日本語", "🙂", "a", "antidisestablishmentarianism", "=====", "12345", "\n", "", "ing"]
    out = [None, "", " ", "a", " lead", "trail ", "x" * 700, "ab" * 900, "-" * 640, " " * 777, "日本🙂" * 300, "▁ mark ▁▁ " * 60]
    for _ in range(25):
        out.append(rnd.choice([" ", "", "  "]).join(rnd.choices(words, k=rnd.randint(50, 400))))
    out.append("".join(rnd.choices("abcdefghijklmnopqrstuvwxyz ", k=3000)))
    out.append("".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=3000)))
    return out


def test_merging_by_definition_is_the_library(pieces):
    for t in texts():
        t = (t or "")[:120]
        if t:
            got = [k for p in pieces.merged(scan.SPACE + t.replace(" ", scan.SPACE)) for k in pieces.to_ids(p)]
            assert got == pieces.model.encode(t)


def test_products_are_associative(pieces):
    text = scan.SPACE + "internationalization" * 30
    cut = [0, 130, 300, 470, len(text)]
    parts = [scan.transfer(pieces, text[max(0, a - 64) : b + 64], a - max(0, a - 64), b - max(0, a - 64), a == 0) for a, b in zip(cut, cut[1:], strict=False)]
    left = scan.product(scan.product(scan.product(*parts[:2]), parts[2]), parts[3])
    right = scan.product(parts[0], scan.product(parts[1], scan.product(*parts[2:])))
    assert sorted((i, o) for i, o, _ in left) == sorted((i, o) for i, o, _ in right)
    assert max(w for *_, w in left) == pytest.approx(max(w for *_, w in right))


@pytest.mark.parametrize(("chunk", "fan"), [(1 << 16, 256), (128, 256), (131, 3)])
def test_ids_equal_the_library(spark, monkeypatch, chunk, fan):
    monkeypatch.setattr(scan, "FAN", fan)
    model = SentencePieceProcessor(model_file=PATH)
    rows = [(i, t, "x") for i, t in enumerate(texts())] + [(3, "a", "y"), (None, "token " * 100, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(4)
    got = sorted(((r.doc_id, r.n_tokens, r.ids, r.lossless) for r in scan.encode_documents(df, PATH, chunk).collect()), key=str)
    want = sorted(((i, len(e := model.encode(t or "")), e, model.decode(e) == (t or "")) for i, t, _ in rows), key=str)
    assert got == want
    assert sum(not x[3] for x in got) == 1


def test_decode_is_the_inverse(spark):
    rows = [(i, t) for i, t in enumerate(texts()) if t is not None and "▁" not in t]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    back = scan.decode_documents(scan.encode_documents(df, PATH, 256), PATH)
    assert sorted(map(tuple, back.collect())) == sorted(rows)


def test_empty_table(spark):
    assert scan.encode_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_long_pieces_and_other_models(spark, tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    with open(PATH, "rb") as f:
        raw = f.read()
    assert scan.is_scannable(raw)
    spec = sentencepiece_model_pb2.ModelProto()
    spec.ParseFromString(raw)
    # "a" joined up to 96 characters, pieces that are longer than those of the file.
    known = {p.piece for p in spec.pieces}
    for size in (2, 3, 6, 12, 24, 48, 96):
        if "q" * size not in known:
            spec.pieces.add(piece="q" * size, score=-40000.0 - size)
    path = f"{tmp_path}/long.model"
    with open(path, "wb") as f:
        f.write(spec.SerializeToString())
    model = SentencePieceProcessor(model_file=path)
    rows = [(1, "q" * 1000), (2, "the " + "q" * 700 + " end " * 200), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.ids for r in scan.encode_documents(df, path, 256).collect()} == {i: model.encode(t) for i, t in rows}
    spec.normalizer_spec.remove_extra_whitespaces = True
    with open(path, "wb") as f:
        f.write(spec.SerializeToString())
    model = SentencePieceProcessor(model_file=path)
    rows = [(1, "a   b " * 300)]
    assert [r.ids for r in scan.encode_documents(spark.createDataFrame(rows, "doc_id long, text string"), path, 256).collect()] == [model.encode(rows[0][1])]
