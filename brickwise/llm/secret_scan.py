"""Secret scans with corpus-wide ownership of candidate values (operator 5). Native: columns only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brickwise.llm.common import stage, text_or_empty

#: Kinds in the order in which they are listed, their patterns, the group that holds the
#: secret and its least length. The first three are the base; the others are the method's own.
KINDS = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
    ("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 27),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
)
BASE = ("assign", "access", "hex")
#: What says quickly that a text has no match of the kind that could be long enough.
LIKELY = {"assign": KINDS[0][1], "access": r"AKIA[A-Z0-9]{16}", "hex": r"[0-9a-f]{24}"}
#: The pattern of a private key: the header and what is behind it up to its end, or, where the end is
#: missing, the lines of base64.
PEM_HEAD = KINDS[5][1]
PEM = (
    PEM_HEAD
    + r"(?:(?:(?!-----)[\s\S])*+-----END [A-Z ]*PRIVATE KEY-----"
    + r"|(?:\s*(?:Proc-Type|DEK-Info):[^\n]*)*(?:(?:\s|\\[nr])*+[A-Za-z0-9+/]{40,}+={0,2})++(?:\s*[\r\n]+[A-Za-z0-9+/]++={0,2}(?=\s*(?:[\r\n]|$)))?)?"
)
#: The same for SQL, whose pattern engine can't look ahead: it takes a key up to its end, or its header alone.
PEM_SQL = PEM_HEAD + r"(?:(?:[^-]|-{1,4}[^-])*-----END [A-Z ]*PRIVATE KEY-----)?"
#: What isn't the body of a key; keys are told apart by their bodies.
PEM_FRAME = r"-----[A-Z ]*-----|\s+|\\[nr]"
#: A value found with this many owners, or with more than one in this many repositories, is taken for a widely copied
#: example.
EXAMPLE_OWNERS = 3
EXAMPLE_REPOSITORIES = 20
SPAN = "struct<start:int,kind:int,stop:int,value:string>"


def _spans(text: Column, kind: int) -> Column:
    """The matches of a kind, leftmost and not overlapping, in code points; those that are too short are
    dropped after matching. Places follow from the lengths of the pieces between the matches."""
    name, pattern, group, least = KINDS[kind]
    likely = LIKELY.get(name, pattern)
    pattern = PEM if name == "pem" else pattern
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    if name == "pem":
        body = lambda v: F.regexp_replace(v, PEM_FRAME, "")
        value = F.transform(found, lambda v: F.when(body(v) == "", v).otherwise(body(v)))
    between = F.split(text, pattern, -1)
    rows = F.arrays_zip(F.transform(found, F.length).alias("m"), value.alias("v"), F.transform(F.slice(between, 1, F.size(found)), F.length).alias("b"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["b"]
        stop = begin + x["m"]
        span = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), stop.alias("stop"), x["v"].alias("value"))
        return F.struct(stop.alias("at"), F.when((x["m"] if name == "pem" else F.length(x["v"])) >= least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    spans = F.aggregate(rows, start, step)["out"]
    return F.when(text.rlike(likely), spans).otherwise(F.array().cast(f"array<{SPAN}>"))


def secret_spans(docs: DataFrame, repository: str = "doc_id", owner: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns of the repository, the owner and of keep, doc_id, and the sorted spans of every row."""
    text = text_or_empty()
    spans = F.array_sort(F.concat(*[_spans(text, k) for k in range(len(KINDS))]))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(repository).cast("string").alias("repository"), F.col(owner).cast("string").alias("owner"), *keep, spans.alias("spans"))


def value_owners(found: DataFrame) -> DataFrame:
    """(digest, n_repositories, n_owners) of every candidate value over the whole corpus: how many repositories and how
    many owners hold it, each counted once. Spark counts distinct ones by partial sums, so a value that a third of all
    rows hold is no burden."""
    each = found.select("repository", "owner", F.explode(F.array_distinct(F.transform("spans", lambda s: F.sha2(s["value"], 256)))).alias("digest"))
    return each.groupBy("digest").agg(F.count_distinct("repository").alias("n_repositories"), F.count_distinct("owner").alias("n_owners"))


def secret_scan(docs: DataFrame, repository: str = "doc_id", owner: str = "source", example_owners: int = EXAMPLE_OWNERS, example_repositories: int = EXAMPLE_REPOSITORIES, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each row of docs(doc_id, text, owner): doc_id, n_assign, n_access, n_hex, base_sha256, spans,
    n_spans, n_live, live_spans and found (the spans with their value's digest, owners, repositories
    and whether it looks live).

    A value is a widely copied example if example_owners owners have it, or more than one owner in
    example_repositories repositories, else it looks live. Columns in keep are carried (their names must differ from
    the others). A null text counts as empty: counts 0, no spans, the digest of the
    empty string. A null owner or repository is none and isn't counted. Repeated rows keep a row each and
    count as one repository, under however many owners they stand. Other columns are ignored; an empty table gives an
    empty result."""
    found = stage(secret_spans(docs, repository, owner, keep).withColumn("row", F.monotonically_increasing_id()), "secrets")
    some = found.where(F.size("spans") > 0)
    owners = value_owners(some)
    each = some.select("row", F.explode("spans").alias("s")).select("row", "s", F.sha2("s.value", 256).alias("digest"))
    live = (F.col("n_owners") < example_owners) & ((F.col("n_owners") <= 1) | (F.col("n_repositories") < example_repositories))
    judged = each.join(owners, "digest").groupBy("row").agg(
        F.array_sort(
            F.collect_list(F.struct("s.start", "s.kind", "s.stop", "digest", "n_owners", "n_repositories", live.alias("live")))
        ).alias("found")
    )
    none = F.array().cast("array<struct<start:int,kind:int,stop:int,digest:string,n_owners:bigint,n_repositories:bigint,live:boolean>>")
    # Rows without a span have nothing to be joined with.
    clear = found.where(F.size("spans") == 0).withColumn("found", none)
    rows = some.join(judged, "row").select(*found.columns, "found").unionByName(clear)
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    write = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    return rows.select(
        "doc_id",
        *keep,
        *[count(k).alias(f"n_{name}") for k, name in enumerate(BASE)],
        F.sha2(write(base), 256).alias("base_sha256"),
        write(F.col("spans")).alias("spans"),
        F.size("spans").cast("long").alias("n_spans"),
        F.size(F.filter("found", lambda s: s["live"])).cast("long").alias("n_live"),
        write(F.filter("found", lambda s: s["live"])).alias("live_spans"),
        "found",
    )


def redact(text: Column, spans: Column) -> Column:
    """The text with each span, struct(start, stop) in code points, sorted by start, replaced by a mark. Spans
    that overlap one before them only take what that one left."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        kept = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        fresh = s["stop"] > acc["at"]
        piece = F.when(s["start"] >= acc["at"], F.concat(kept, F.lit("[secret]"))).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.when(fresh, F.concat(acc["out"], F.array(piece))).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(spans, start, step)
    return F.concat(F.array_join(done["out"], ""), F.substring(text, done["at"] + 1, F.length(text)))


def secret_sql(example_owners: int = EXAMPLE_OWNERS, example_repositories: int = EXAMPLE_REPOSITORIES) -> str:
    """The same in DuckDB SQL, for the columns that identify a row's spans and their standing."""
    text = "coalesce(text, '')"
    parts = []
    for k, (name, pattern, group, least) in enumerate(KINDS):
        pattern = pattern.replace("(?i:password|passwd|secret|token|api_?key)", "(?:" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")) + ")")
        pattern = PEM_SQL if name == "pem" else pattern
        p = "'" + pattern.replace("'", "''") + "'"
        parts.append(f"""SELECT r, {k} AS kind, '{name}' AS name, {least} AS least, regexp_extract_all({text}, {p}) AS m, regexp_extract_all({text}, {p}, {group}) AS v, string_split_regex({text}, {p}) AS b FROM d""")
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, * FROM documents),
raw AS ({' UNION ALL '.join(parts)}),
places AS (SELECT r, kind, name, least, m, v, b, unnest(range(1, len(m) + 1)) AS i FROM raw),
spans AS (
  SELECT r, kind, name, CASE WHEN name = 'pem' THEN coalesce(nullif(regexp_replace(m[i], '{PEM_FRAME}', '', 'g'), ''), m[i]) ELSE v[i] END AS value, coalesce(list_sum(list_transform(b[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS start, length(m[i]) AS n
  FROM places WHERE length(v[i]) >= least),
owners AS (SELECT value, count(DISTINCT doc_id) AS repos, count(DISTINCT source) AS owners FROM spans JOIN d USING (r) GROUP BY value),
judged AS (SELECT spans.*, name || ':' || start::BIGINT || ':' || (start + n)::BIGINT AS s, owners < {example_owners} AND (owners <= 1 OR repos < {example_repositories}) AS live FROM spans JOIN owners USING (value)),
agg AS (
  SELECT r, count(*) FILTER (kind = 0) AS n0, count(*) FILTER (kind = 1) AS n1, count(*) FILTER (kind = 2) AS n2, count(*) AS n, count(*) FILTER (live) AS nl,
    string_agg(s, ',' ORDER BY start, kind) FILTER (kind < 3) AS base, string_agg(s, ',' ORDER BY start, kind) AS spans, string_agg(s, ',' ORDER BY start, kind) FILTER (live) AS live_spans
  FROM judged GROUP BY r)
SELECT doc_id, coalesce(n0, 0)::BIGINT AS n_assign, coalesce(n1, 0)::BIGINT AS n_access, coalesce(n2, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n, 0)::BIGINT AS n_spans, coalesce(nl, 0)::BIGINT AS n_live, coalesce(live_spans, '') AS live_spans
FROM d LEFT JOIN agg USING (r)"""
