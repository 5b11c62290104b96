"""Prefix trie of conversations by distributed MSD radix partitioning (operator 11)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brickwise.llm.common import stage

#: Distinct sequences that one task sorts by itself; a bucket of more is split by its next turn.
LOCAL = 128
#: The rule of rebuilding: conversations of one hundred share their first turns with the first of them, HEAD - 1 at most.
GROUP, HEAD = 100, 6
#: Decimal ids that are joined to one row before a node's ids are hashed, and nodes in a batch of what a task returns.
IDS, NODES = 4096, 20_000
EMPTY = hashlib.sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def encoded(turns: DataFrame) -> DataFrame:
    """(conv_id, ids, points) of every conversation of turns(conv_id, turn, role, text): its turns in their order as ids of a
    dictionary of (role, text), with the code points of each text.

    Only digests (SHA-256) of turns are shuffled, never texts; the dictionary is a table. Turns of one number stand in the
    order of their digests. Rows without a conv_id belong to no conversation. A conversation's ids are one row,
    so the longest has to fit in a task (12 bytes a turn)."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.char_length(text).alias("points"))
    rows = stage(rows, "turns")
    dictionary = stage(rows.select("digest").distinct().withColumn("id", F.monotonically_increasing_id()), "turn-dictionary")
    inside = F.sort_array(F.collect_list(F.struct("turn", "digest", "id", "points")))
    return rows.join(dictionary, "digest").groupBy("conv_id").agg(inside.alias("t")).select("conv_id", F.col("t.id").alias("ids"), F.col("t.points").alias("points"))


def rebuilt(sequences: DataFrame) -> DataFrame:
    """Every conversation c with the first h turns of conversation c - c % 100 in the place of its own first h,
    h = crc32(decimal c) % 6; where that conversation is absent or shorter there are fewer."""
    own = stage(sequences, "conversations")
    h = (F.crc32(F.col("conv_id").cast("string")) % HEAD).cast("int")
    first = F.col("conv_id") - F.col("conv_id") % GROUP
    heads = own.where(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("base"), *[F.slice(c, 1, HEAD - 1).alias(f"head_{c}") for c in ("ids", "points")])
    both = own.withColumn("h", h).withColumn("base", first).join(heads, "base", "left")

    def new(c: str, kind: str) -> Column:
        head = F.slice(F.coalesce(f"head_{c}", F.array().cast(f"array<{kind}>")), F.lit(1), F.col("h"))
        return F.concat(head, F.slice(c, F.col("h") + 1, F.size(c))).alias(c)

    return both.select("conv_id", new("ids", "long"), new("points", "int"))


def _runs(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple[tuple, tuple]]:
    """(key, rest) of sorted rows; the first columns named are the key."""
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in range(batch.num_columns)]
        keys = zip(*columns[: len(names)], strict=True)
        yield from zip(keys, zip(*columns[len(names) :], strict=True), strict=True)


def _join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, first, n, ids): ascending decimal ids of one sequence, up to IDS in a row."""
    rows: list[tuple] = []
    key, held = None, []

    def close() -> None:
        if held:
            rows.append((key, held[0], len(held), ",".join(map(str, held))))

    def out() -> pa.RecordBatch:
        found = list(zip(*rows, strict=True)) or [[], [], [], []]
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(found[0], pa.binary()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.int64()), pa.array(found[3], pa.string())], names=["key", "first", "n", "ids"])

    for (k,), (conv,) in _runs(batches, ("key",)):
        if k != key or len(held) == IDS:
            close()
            key, held = k, []
            if len(rows) >= NODES // 10:
                yield out()
        held.append(conv)
    close()
    yield out()


def _hash_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, m, n, ends): the smallest id of each sequence, how many there are, and the hash of all, fed row by row."""
    rows: list[tuple] = []
    key, least, total, sha = None, None, 0, hashlib.sha256()

    def out() -> pa.RecordBatch:
        found = list(zip(*rows, strict=True)) or [[], [], [], []]
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(found[0], pa.binary()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.int64()), pa.array(found[3], pa.string())], names=["key", "m", "n", "ends"])

    for (k,), (first, n, ids) in _runs(batches, ("key",)):
        if k != key:
            if key is not None:
                rows.append((key, least, total, sha.hexdigest()))
                if len(rows) >= NODES:
                    yield out()
            key, least, total, sha = k, first, 0, hashlib.sha256()
        else:
            sha.update(b",")
        sha.update(ids.encode())
        total += n
    if key is not None:
        rows.append((key, least, total, sha.hexdigest()))
    yield out()


def distinct_sequences(sequences: DataFrame) -> DataFrame:
    """(m, n, ends, ids, points): each distinct sequence once, with the smallest of its conversations, their number and
    the hash of their ids. The ids of a sequence are sorted over many tasks and joined there; one task hashes the
    joined rows of a sequence as a stream."""
    key = F.unhex(F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256))
    whole = stage(sequences.withColumn("key", key), "sequences")
    texts = whole.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(_join_ids, "key binary, first long, n long, ids string")
    ends = texts.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_hash_ids, "key binary, m long, n long, ends string")
    return whole.join(ends.withColumnRenamed("m", "conv_id"), ["key", "conv_id"]).select(F.col("conv_id").alias("m"), "n", "ends", "ids", "points")


def quicksorted(rows: list[tuple], at: int, depth: int) -> list[tuple]:
    """Nodes (as NODE, with top) of one bucket: rows (ids, points, m, n, ends) of distinct sequences behind the node (at,
    depth), whose first ids agree. Multikey quicksort by the ids; where a turn is equal, the recursion goes one turn
    deeper and a node is emitted. Its stack is a list, so depth has no limit."""
    parent, points = [], []
    held: dict[int, tuple] = {}

    def node(up: int, p: int) -> int:
        parent.append(up)
        points.append(p)
        return len(parent) - 1

    stack = [(list(range(len(rows))), 0, -1)]
    while stack:
        some, k, up = stack.pop()
        if len(some) == 1:
            ids, own = rows[some[0]][:2]
            for p in own[k : len(ids)]:
                up = node(up, p)
            held[up] = rows[some[0]][2:]
            continue
        turn = {r: rows[r][0][k] if k < len(rows[r][0]) else -1 for r in some}
        pivot = turn[some[len(some) // 2]]
        less, greater = [r for r in some if turn[r] < pivot], [r for r in some if turn[r] > pivot]
        equal = [r for r in some if turn[r] == pivot]
        stack += [(part, k, up) for part in (greater, less) if part]
        if pivot < 0:
            held[up] = rows[equal[0]][2:]
        else:
            stack.append((equal, k + 1, node(up, rows[equal[0]][1][k])))
    size = len(parent)
    least: list[int | None] = [None] * size
    n, children, leaves, saved, deep = ([0] * size for _ in range(5))
    ends = [EMPTY] * size
    for k, (m, own_n, own_ends) in held.items():
        least[k], n[k], ends[k] = m, own_n, own_ends
    for k in range(size):
        deep[k] = (deep[parent[k]] if parent[k] >= 0 else depth) + 1
    for k in range(size - 1, -1, -1):
        leaves[k] = leaves[k] or 1
        saved[k] += (n[k] - 1) * points[k]
        up = parent[k]
        if up >= 0:
            n[up] += n[k]
            least[up] = least[k] if least[up] is None else min(least[up], least[k])
            children[up] += 1
            leaves[up] += leaves[k]
            saved[up] += saved[k]
    return [(least[k], deep[k], least[parent[k]] if parent[k] >= 0 else at, n[k], children[k], leaves[k], saved[k], ends[k], parent[k] < 0) for k in range(size)]


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of all buckets of a task, whose rows come sorted by bucket."""
    names = [c.split()[0] for c in NODE.split(", ")] + ["top"]
    kinds = [pa.int64()] * 7 + [pa.string(), pa.bool_()]
    rows: list[tuple] = []
    key, held = None, []

    def out() -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[] for _ in names]
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    for k, rest in _runs(batches, ("at", "d", "next")):
        if k != key:
            if held:
                rows += quicksorted(held, *key[:2])
                if len(rows) >= NODES:
                    yield out()
            key, held = k, []
        held.append(rest)
    if held:
        rows += quicksorted(held, *key[:2])
    yield out()


def prefix_trie(sequences: DataFrame, local: int = LOCAL) -> DataFrame:
    """The nodes (NODE) of the trie of sequences(conv_id, ids, points), conv_id unique.

    A bucket is a node with all sequences that go on behind it. Buckets of more than local distinct sequences are split by
    their next turn, in rounds over such buckets only; turns that all of a bucket share are passed at once, so
    that a round always branches. What is smaller goes to tasks, many buckets in each, which sort and emit their nodes. Equal sequences
    are one row with a number throughout. What the buckets of the rounds lack of their subtrees comes from sums by ancestors.
    An empty input gives no nodes; a conversation without turns is a member of the root only."""
    spark = sequences.sparkSession
    whole = stage(distinct_sequences(sequences), "distinct-sequences")
    n_convs, root = whole.agg(F.sum("n"), F.min("m")).first()
    if root is None:
        return spark.createDataFrame([], NODE)
    # A bucket: the last node (at, d) of a stretch of nodes without branches from depth lo, their points, and the buckets above.
    bucket = "at long, d long, lo long, parent long, n_convs long, points array<int>, path array<struct<at: long, d: long>>"
    buckets = spark.createDataFrame([(root, 0, 0, None, n_convs, [0], [(root, 0)])], bucket)
    active = whole.withColumns({"at": F.lit(root), "d": F.lit(0).cast("long")})
    all_buckets, children, ends, small = [buckets], [], [], []
    while True:
        ended = F.size("ids") == F.col("d")
        ends.append(active.where(ended).select("at", "d", "ends"))
        going = active.where(~ended).withColumn("next", F.element_at("ids", (F.col("d") + 1).cast("int")))
        groups = stage(going.groupBy("at", "d", "next").agg(F.sum("n").alias("n_convs"), F.count("*").alias("sequences"), F.min("m").alias("child")), "trie-groups")
        children.append(groups.groupBy("at", "d").agg(F.count("*").alias("n_children")))
        large = groups.where(F.col("sequences") > local).drop("sequences")
        if large.isEmpty():
            small.append(going)
            break
        dealt = stage(going.join(large.drop("n_convs"), ["at", "d", "next"], "left"), "trie-round")
        small.append(dealt.where("child is null").drop("child"))
        more = dealt.where("child is not null")
        span = more.groupBy("child").agg(F.min(F.struct("ids", "points")).alias("low"), F.max("ids").alias("high"))
        agree = F.array_position(F.zip_with("low.ids", "high", lambda a, b: a.eqNullSafe(b)), False)
        span = span.select("child", F.when(agree > 0, agree - 1).otherwise(F.size("high")).cast("long").alias("hi"), F.col("low.points").alias("points"))
        above = buckets.select("at", "d", "path")
        lo = F.col("d") + 1
        buckets = stage(
            large.join(above, ["at", "d"]).join(span, "child")
            .select(F.col("child").alias("at"), F.col("hi").alias("d"), lo.alias("lo"), F.col("at").alias("parent"), "n_convs",
                    F.slice("points", lo.cast("int"), (F.col("hi") - F.col("d")).cast("int")).alias("points"),
                    F.concat("path", F.array(F.struct(F.col("child").alias("at"), F.col("hi").alias("d")))).alias("path")),
            "trie-buckets",
        )
        all_buckets.append(buckets)
        active = more.drop("at", "d", "next").join(buckets.select(F.col("at").alias("child"), "d"), "child").withColumnRenamed("child", "at")

    def union(frames: list[DataFrame]) -> DataFrame:
        found = frames[0]
        for f in frames[1:]:
            found = found.unionByName(f)
        return found

    rest = [F.slice(c, (F.col("d") + 1).cast("int"), F.size(c)).alias(c) for c in ("ids", "points")]
    dealt = union([s.select("at", "d", "next", *rest, "m", "n", "ends") for s in small]).repartition("at", "d", "next").sortWithinPartitions("at", "d", "next")
    low = stage(dealt.mapInArrow(_finish, NODE + ", top boolean"), "trie-nodes")
    upper = stage(union(all_buckets), "trie-upper")
    own = (F.col("n_convs") - 1) * F.aggregate("points", F.lit(0).cast("long"), lambda a, x: a + x)
    tops = low.where("top").groupBy(F.col("parent_conv_id").alias("at"), (F.col("depth") - 1).alias("d")).agg(F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    given = tops.join(upper.select("at", "d", "path"), ["at", "d"]).select("path", "leaves", "saved")
    given = given.unionByName(upper.select(F.slice("path", 1, F.size("path") - 1).alias("path"), F.lit(0).cast("long").alias("leaves"), own.alias("saved")))
    below = given.select(F.explode("path").alias("b"), "leaves", "saved").groupBy(F.col("b.at").alias("at"), F.col("b.d").alias("d")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    full = upper.join(below, ["at", "d"], "left").join(union(children), ["at", "d"], "left").join(union(ends), ["at", "d"], "left")
    shown = full.select("*", F.posexplode("points").alias("k", "own_points"))
    last = F.col("lo") + F.col("k") == F.col("d")
    n_children = F.when(last, F.coalesce("n_children", F.lit(0))).otherwise(1)
    further = F.aggregate(F.slice("points", F.col("k") + 1, F.size("points")), F.lit(0).cast("long"), lambda a, x: a + x)
    high = shown.select(
        F.col("at").alias("conv_id"), (F.col("lo") + F.col("k")).alias("depth"), F.when(F.col("k") == 0, F.col("parent")).otherwise(F.col("at")).alias("parent_conv_id"), "n_convs",
        n_children.cast("long").alias("n_children"), F.greatest(F.coalesce("leaves", F.lit(0)), F.lit(1)).cast("long").alias("n_leaves"),
        (F.coalesce("saved", F.lit(0)) + (F.col("n_convs") - 1) * further).cast("long").alias("saved_tokens"), F.when(last, F.coalesce("ends", F.lit(EMPTY))).otherwise(EMPTY).alias("ends_sha256"),
    )
    return low.drop("top").unionByName(high)


def conversation_trie(conversations: DataFrame, local: int = LOCAL) -> DataFrame:
    """The trie of the rebuilt conversations of conversations(conv_id, turn, role, text): (conv_id, depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256) by node.

    A null turn comes first, null role and text are empty, turns of one number stand in the order of their digests, repeated
    rows are turns of their own, rows without a conv_id are left out. Remainders of negative ids have their sign. Extra columns are
    ignored; an empty table gives no nodes."""
    return prefix_trie(rebuilt(encoded(conversations)), local)


def conversation_trie_sql() -> str:
    """The same in DuckDB SQL: all prefixes of all conversations, grouped."""
    return f"""
    with recursive bytes as (
        select list_transform(range(256), lambda b: list_reduce(range(8), lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, b)) as t),
    turns as (
        select conv_id as c, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as v, length(coalesce(text, '')) as points
        from conversations where conv_id is not null),
    placed as (select c, row_number() over (partition by c order by turn nulls first, v) - 1 as pos, v, points from turns),
    heads as (
        select c, xor(list_reduce([ascii(x) for x in string_split(c::varchar, '')], lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]), 4294967295), 4294967295) % {HEAD} as h
        from (select distinct c from turns), bytes),
    joined as (
        select h.c, p.pos, p.v, p.points from heads h join placed p on p.c = h.c - h.c % {GROUP} and p.pos < h.h
        union all select h.c, p.pos, p.v, p.points from heads h join placed p on p.c = h.c and p.pos >= h.h),
    seq as (select c, row_number() over (partition by c order by pos) as d, v, points from joined),
    prefixes as (
        select c, d, string_agg(v, ',') over (partition by c order by d) as prefix, points from seq
        union all select c, 0, '', 0 from heads),
    longest as (select c, max(d) as n from prefixes group by c),
    nodes as (
        select prefix, d, min(c) as m, count(*) as n, max(points) as points,
            sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (n = d), '')) as ends
        from prefixes join longest using (c) group by prefix, d),
    up as (select a.prefix, a.d, b.m as parent from nodes a left join prefixes p on p.c = a.m and p.d = a.d - 1 left join nodes b on b.prefix = p.prefix and b.d = p.d),
    kids as (select p.prefix, p.d, count(*) as n from nodes a join prefixes p on p.c = a.m and p.d = a.d - 1 group by p.prefix, p.d),
    below as (
        select p.prefix, p.d, sum((a.n - 1) * a.points) as saved, count(*) filter (k.n is null) as leaves
        from nodes a left join kids k using (prefix, d) join prefixes p on p.c = a.m and p.d <= a.d group by p.prefix, p.d)
    select m as conv_id, d::bigint as depth, parent as parent_conv_id, n_convs_::bigint as n_convs, coalesce(kids.n, 0)::bigint as n_children,
        leaves::bigint as n_leaves, saved::bigint as saved_tokens, ends as ends_sha256
    from (select prefix, d, m, n as n_convs_, ends from nodes) join up using (prefix, d) join below using (prefix, d) left join (select prefix, d, n from kids) kids using (prefix, d)"""
