"""Conversation prefix trie by truncation peeling.

Every prefix of a conversation gets a 128-bit key: the XOR of hashes of (position, role, text digest), so a running XOR
numbers all prefixes and no text is shuffled twice.  Conversations that end with the same key are merged first.  Then the
trie is peeled from its deepest level: nodes of a level are what survives from the level below, stripped of its last turn,
plus the conversations that end there; one grouping by key discovers the nodes and adds up all their figures.  A level is
written before the next one starts, and every conversation and node is touched once, so work is linear in conversations and
nodes.  Groupings sum partially before they shuffle, however many conversations share a prefix.

Keys travel in bands of ``BAND`` levels per conversation; a node that leaves a band takes up the next band of its smallest
member by a join, so that no row grows with a conversation.  Where a band holds subtrees with a single distinct ending
(one conversation and its copies), their chains of nodes are written at once, without peeling: a conversation that is much
longer than all others costs one step per band.  Conversations of very many rows are numbered and keyed in slices.

The sorted ids of the conversations that end at a node are hashed as a stream of packed pieces, in constant memory.

Edge rows: null role or text is empty; turns are ordered by turn (null first), then role, then the digest of the text, so
repeated rows and ties are defined; rows with a null conversation id belong to none and are left out; a conversation
without turns after rebuilding ends at the root; an empty table has no nodes; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.operators import frames
from riskweave.session import cut

WORD = r"[^ \t-\r]+"
BAND = 32  # levels in a band
PIECE = 1 << 16  # ids in a packed piece


def turns(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, digest, words): one row per turn, in the order of turn, role and digest."""
    said = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return rows.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.md5(said).alias("digest"),
        F.regexp_count(said, F.lit(WORD)).cast("long").alias("words"),
    )


def rebuilt(rows: DataFrame, group: int = 20, shared: int = 4, limit: int | None = None, slice_rows: int = frames.SLICE_ROWS) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with turns of the first conversation of their group of ids.

    (conv, depth, role, digest, words) of all rebuilt turns, and (conv) of all conversations.  Conversation ``c`` starts with
    the first ``h`` turns of ``c - c % group``, then follow its own after its first ``h``; h is crc32(c) modulo ``shared``.
    """
    order = ["turn", "role", "digest"]
    numbered = cut(frames.apply(rows, ["conv"], order, [frames.running(["conv"], order, {"at": (F.lit(1).cast("long"), "sum")})], limit, slice_rows))
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % shared
    counts = cut(numbered.groupBy("conv").agg(F.max("at").alias("n")).withColumns({"h": h, "root": F.col("conv") - F.col("conv") % group}))
    heads = counts.select(F.col("conv").alias("root"), F.least("n", F.lit(shared)).alias("has"))
    known = counts.join(heads, "root", "left").select("conv", "h", "root", F.least("h", F.coalesce("has", F.lit(0))).alias("taken"))
    # at most ``shared`` turns of a root for at most ``group`` conversations
    first = numbered.where(F.col("at") < shared).withColumnRenamed("conv", "root")
    lent = known.join(first, "root").where("at <= taken").select("conv", F.col("at").alias("depth"), "role", "digest", "words")
    own = numbered.join(known, "conv").where("at > h").select("conv", (F.col("at") - F.col("h") + F.col("taken")).alias("depth"), "role", "digest", "words")
    return lent.unionByName(own), counts.select("conv")


def keyed(steps: DataFrame, limit: int | None = None, slice_rows: int = frames.SLICE_ROWS) -> DataFrame:
    """(conv, depth, words, a, b): a and b are the key of the first ``depth`` turns."""
    mark = lambda seed: F.xxhash64(F.lit(seed), "depth", "role", "digest")
    lean = steps.select("conv", "depth", "words", mark(1).alias("x"), mark(2).alias("y"))
    op = frames.running(["conv"], ["depth"], {"a": (F.col("x"), "bit_xor"), "b": (F.col("y"), "bit_xor")})
    return frames.apply(lean, ["conv"], ["depth"], [op], limit, slice_rows).select("conv", "depth", "words", "a", "b")


def digests(ends: DataFrame) -> DataFrame:
    """(depth, a, b, ends_sha256): hash of the ascending ids in ``ends`` (conv, depth, a, b), per key, streamed."""
    key = ["depth", "a", "b"]
    packed = "depth bigint, a bigint, b bigint, low bigint, ids binary"
    wire = pa.schema([("depth", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("low", pa.int64()), ("ids", pa.binary())])
    found = pa.schema([("depth", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("ends_sha256", pa.string())])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids = None, []
        for batch in batches:
            out = []
            for d, a, b, conv in zip(*(batch.column(c).to_pylist() for c in (*key, "conv"))):
                if held != (d, a, b) or len(ids) >= PIECE:
                    if ids:
                        out.append((*held, ids[0], ",".join(map(str, ids)).encode()))
                    held, ids = (d, a, b), []
                ids.append(conv)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), wire)], schema=wire)
        if ids:
            yield pa.RecordBatch.from_pydict(dict(zip(wire.names, ([v] for v in (*held, ids[0], ",".join(map(str, ids)).encode())))), schema=wire)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state = None, None
        for batch in batches:
            out = []
            for d, a, b, ids in zip(*(batch.column(c).to_pylist() for c in (*key, "ids"))):
                if held != (d, a, b):
                    if held is not None:
                        out.append((*held, state.hexdigest()))
                    held, state = (d, a, b), hashlib.sha256(ids)
                else:
                    state.update(b"," + ids)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), found)], schema=found)
        if held is not None:
            yield pa.RecordBatch.from_pydict(dict(zip(found.names, ([v] for v in (*held, state.hexdigest())))), schema=found)

    dealt = ends.select(*key, "conv").repartitionByRange(*key, "conv").sortWithinPartitions(*key, "conv").mapInArrow(pieces, packed)
    return dealt.repartition(*key).sortWithinPartitions(*key, "low").mapInArrow(hashed, "depth bigint, a bigint, b bigint, ends_sha256 string")


FIGURES = ["depth", "conv", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
NO_ENDS = hashlib.sha256(b"").hexdigest()


def zero() -> Column:
    return F.lit(0).cast("long")


def finished(rows: DataFrame) -> DataFrame:
    """Rows with the sums of a node's children and endings: a childless node is a leaf, own savings are added."""
    return rows.withColumns({
        "n_leaves": F.when(F.col("n_children") == 0, 1).otherwise(F.col("n_leaves")).cast("long"),
        "saved_tokens": F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("words"),
        "ends_sha256": F.coalesce("ends_sha256", F.lit(NO_ENDS)),
    })


def handed(rows: DataFrame, *more: str) -> DataFrame:
    """What finished nodes pass to the level above: one child each and no endings."""
    return rows.select(
        (F.col("depth") - 1).alias("depth"), "conv", "n_convs", F.lit(1).cast("long").alias("n_children"), "n_leaves", "saved_tokens",
        F.lit(None).cast("string").alias("ends_sha256"), *more,
    )


def regrouped(rows: DataFrame, step: Column, *carried: str) -> DataFrame:
    """The finished nodes of one level: rows that share the key in ``step`` (a, b, words) become one."""
    total = lambda c: F.sum(c).alias(c)
    made = rows.select(*FIGURES, step["a"].alias("a"), step["b"].alias("b"), step["words"].alias("words"), *carried)
    sums = [F.min("conv").alias("conv"), *map(total, ("n_convs", "n_children", "n_leaves", "saved_tokens"))]
    # at most one row of a node has endings; all its rows agree on words and on the path up to its depth
    kept = [F.max("ends_sha256").alias("ends_sha256"), F.max("words").alias("words"), *[F.first(c).alias(c) for c in carried]]
    return finished(made.groupBy("depth", "a", "b").agg(*sums, *kept))


def peel(rows: DataFrame, low: int, high: int) -> tuple[list[DataFrame], DataFrame]:
    """Nodes of the levels ``high`` down to ``low`` + 1, one written table each, and what they hand to level ``low``."""
    found, below = [], None
    for depth in range(high, low, -1):
        here = rows.where(F.col("depth") == depth)
        made = cut(regrouped(here if below is None else here.unionByName(below), F.col("path")[depth - low], "path"))
        parent = F.col("path")[depth - low - 1]
        found.append(made.select(*FIGURES, "a", "b", parent["a"].alias("pa"), parent["b"].alias("pb")))
        below = handed(made, "path")
    return found, below.drop("path")


def chains(rows: DataFrame, low: int) -> tuple[DataFrame, DataFrame]:
    """The same for rows that share no node with another: node ``depth`` and all above it down to ``low`` + 1."""
    path = F.col("path")
    words = F.aggregate(F.slice("path", F.col("j") - low + 1, F.col("depth") - F.col("j") + 1), zero(), lambda s, x: s + x["words"])
    is_end = F.col("j") == F.col("depth")
    spread = rows.withColumn("j", F.explode(F.sequence(F.lit(low + 1).cast("long"), F.col("depth"))))
    at, up = path[(F.col("j") - low).cast("int")], path[(F.col("j") - low - 1).cast("int")]
    nodes = spread.select(
        F.col("j").alias("depth"), "conv", "n_convs", F.when(is_end, F.col("n_children")).otherwise(1).cast("long").alias("n_children"),
        F.when(F.col("n_children") == 0, 1).otherwise(F.col("n_leaves")).cast("long").alias("n_leaves"),
        (F.col("saved_tokens") + (F.col("n_convs") - 1) * words).alias("saved_tokens"),
        F.when(is_end, F.coalesce("ends_sha256", F.lit(NO_ENDS))).otherwise(NO_ENDS).alias("ends_sha256"),
        at["a"].alias("a"), at["b"].alias("b"), up["a"].alias("pa"), up["b"].alias("pb"),
    )
    nodes = cut(nodes)
    return nodes, handed(nodes.where(F.col("depth") == low + 1))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def nodes(steps: DataFrame, conversations: DataFrame, limit: int | None = None, slice_rows: int = frames.SLICE_ROWS, band: int = BAND) -> DataFrame:
    """One row per trie node over ``steps`` (conv, depth, role, digest, words) of all ``conversations`` (conv): conv_id, depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    keys = cut(keyed(steps, limit, slice_rows))
    step = F.struct("depth", "a", "b", "words")
    root = F.struct(zero().alias("depth"), zero().alias("a"), zero().alias("b"), zero().alias("words"))
    # path[i]: key and words at depth band * number + i; the first entry repeats the last of the band before
    number = F.floor((F.col("depth") - 1) / band).cast("long")
    edge = keys.where(F.col("depth") % band == 0).select("conv", (F.col("depth") / band).cast("long").alias("band"), step.alias("step"))
    paths = keys.select("conv", number.alias("band"), step.alias("step")).unionByName(edge)
    paths = paths.groupBy("conv", "band").agg(F.array_sort(F.collect_list("step")).alias("path"))
    paths = cut(paths.withColumn("path", F.when(F.col("band") == 0, F.concat(F.array(root), "path")).otherwise(F.col("path"))))

    last = keys.groupBy("conv").agg(F.max(F.struct("depth", "a", "b")).alias("k")).select("conv", "k.*")
    turnless = conversations.join(last, "conv", "left_anti").select("conv", *[zero().alias(c) for c in ("depth", "a", "b")])
    ended = cut(last.unionByName(turnless))
    merged = ended.groupBy("depth", "a", "b").agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"))
    merged = merged.join(digests(ended), ["depth", "a", "b"]).withColumns({c: zero() for c in ("n_children", "n_leaves", "saved_tokens")})
    merged = cut(merged.select(*FIGURES))
    deepest = merged.agg(F.max("depth")).first()[0] or 0

    found, above = [], None
    for low in range((deepest - 1) // band * band, -1, -band) if deepest else []:
        rows = merged.where((F.col("depth") > low) & (F.col("depth") <= low + band))
        rows = rows if above is None else rows.unionByName(above)
        rows = cut(rows.join(paths.where(F.col("band") == low // band).select("conv", "path"), "conv"))
        high, above = min(low + band, deepest), None
        if low:  # below the root alone nothing can be a chain
            rows = rows.withColumn("top", F.struct(F.col("path")[0]["a"], F.col("path")[0]["b"]))
            single = rows.groupBy("top").agg(F.count(F.lit(1)).alias("m")).where("m = 1").select("top")
            found_here, above = chains(rows.join(single, "top", "left_semi").drop("top"), low)
            found.append(found_here)
            rows = cut(rows.join(single, "top", "left_anti").drop("top"))
            high = rows.agg(F.max("depth")).first()[0] or low
        if high > low:
            done, handed_up = peel(rows, low, high)
            found += done
            above = handed_up if above is None else above.unionByName(handed_up)
        above = cut(above)
    top = merged.where("depth = 0")
    top = regrouped(top if above is None else top.unionByName(above), root)
    found.append(top.select(*FIGURES, "a", "b", F.lit(None).cast("long").alias("pa"), F.lit(None).cast("long").alias("pb")))
    whole = cut(union(found))
    # A parent of very many children is a hot key of this join, which the skew join splits.
    parents = whole.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv").alias("parent_conv_id"))
    out = whole.join(parents, ["depth", "pa", "pb"], "left")
    return out.select(F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def prefix_trie(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", group: int = 20, shared: int = 4, **cuts) -> DataFrame:
    """The trie of the rebuilt conversations of a table with one row per turn."""
    steps, whole = rebuilt(turns(conversations, conv_id, turn, role, text), group, shared, **cuts)
    return nodes(steps, whole, **cuts)
