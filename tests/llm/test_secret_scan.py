from pyspark.sql import functions as F

from brickwise.llm.secret_scan import redact, secret_scan, secret_sql
from tests.llm.sql import same_as_sql

HEX = "0123456789abcdef" * 2
TEXTS = [
    None,
    "",
    'é token = "abc" Token="abcdef" api_key:x secret=token = abcdefg',
    f"AKIA{'A' * 16} xAKIA{'B' * 15} AKIAAKIA{'C' * 14}",
    f"{HEX} {HEX[:23]} g{HEX[:24]}",
    f"PASSWORD='{HEX}'; passwd : {HEX}\napi-key=no API_KEY=yes/+=._-",
    "ghp_" + "a1" * 20 + " xoxb-1234567890-abcdefghij -----BEGIN RSA PRIVATE KEY-----",
    "ſecret=abcdefg paſſword=abcdefg toKen=abcdefg",
    "日本 𝒳 secret: " + "z" * 5000 + " filler" * 20000 + f" token={HEX[:24]}",
]


def test_against_sql(spark):
    rows = [(i, t, f"s{i % 2}", 1) for i, t in enumerate(TEXTS)] + [(20 + i, f"copied token={HEX} ok", f"s{i}", 2) for i in range(6)] + [(None, "token=aaaaaaa", "s0", None), (1, "", "s1", 3)]
    rows += [(40, "token=bbbbbbb", "s0", 1), (40, "token=bbbbbbb", "s1", 1), (41, "token=bbbbbbb", None, 1)]
    key = "-----BEGIN RSA PRIVATE KEY-----\nMIIE+/==\n-----END RSA PRIVATE KEY----- and after"
    rows += [(50 + i, f"{i} {key}", f"s{i}", 1) for i in range(3)] + [(60, key.replace("MIIE", "MIIF"), "s1", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, start int").repartition(3)
    got = secret_scan(docs).drop("found")
    same_as_sql(got, secret_sql(), documents=docs)
    assert {r.n_live for r in got.where("doc_id >= 20 and doc_id < 40").collect()} == {0}
    assert {r.n_live for r in got.where("doc_id = 3").collect()} == {2}
    (pair,) = {tuple(r.found[0])[4:6] for r in secret_scan(docs).where("doc_id = 40").collect()}
    assert pair == (2, 2) and {r.n_live for r in got.where("doc_id >= 50 and doc_id < 60").collect()} == {0}
    assert {r.n_live for r in got.where("doc_id = 60").collect()} == {1}


def test_redact(spark):
    df = spark.createDataFrame([("é0123456789é",)], "t string")
    spans = F.from_json(F.lit('[{"start":1,"stop":3},{"start":2,"stop":5},{"start":7,"stop":9}]'), "array<struct<start:int,stop:int>>")
    assert df.select(redact(F.col("t"), spans)).first()[0] == "é[secret]45[secret]89é"
    assert df.select(redact(F.col("t"), F.array().cast("array<struct<start:int,stop:int>>"))).first()[0] == "é0123456789é"


def test_empty_table(spark):
    assert secret_scan(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []


def test_private_keys_are_told_apart_and_go_whole(spark):
    head, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    body = lambda i: "\n".join([f"MIIE{i:02d}" + "aB3+" * 14, "Zz9/" * 15, "Qk==" ])
    rows = [(i, f"see {head}\n{body(i)}\n{end} done {i}", f"s{i}") for i in range(25)]
    rows += [(30, f"{head}\n{body(30)}", "s30"), (31, f"a {head} is a header, {head}\n{body(31)}\n{end}.", "s31"), (32, f"{head}\r\n" + body(0).replace("\n", "\r\n") + f"\r\n{end}", "s0")]
    rows += [(40, head + "\n" + "-x" * 200000, "s40")]
    got = {r.doc_id: r for r in secret_scan(spark.createDataFrame(rows, "doc_id long, text string, source string"), keep=("text",)).select("*", redact(F.col("text"), F.filter("found", lambda s: s["live"])).alias("safe")).collect()}
    assert all(got[i].n_live == 1 and got[i].safe == f"see [secret] done {i}" for i in range(25))
    assert got[30].safe == "[secret]" and got[31].safe.endswith(" is a header, [secret].") and got[32].safe == "[secret]"
    assert {s["n_repositories"] for s in got[0].found} == {2} and got[40].spans == f"pem:0:{len(head)}"


def test_one_owners_credential_is_live_in_any_number_of_documents(spark):
    rows = [(i, "token=onlyowner1", "s0") for i in range(60)] + [(100 + i, "token=twoowners2", f"s{i % 2}") for i in range(20)] + [(200 + i, "token=threeown3", f"s{i}") for i in range(3)]
    rows += [(300, "token=twosource", f"s{i % 2}") for i in range(30)]
    got = secret_scan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r.doc_id for r in got if r.n_live} == {*range(60), 300}
