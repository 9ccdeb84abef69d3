"""The trie against one built turn by turn, in several bands, slices and shapes."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from riskweave.llm import prefix_trie

WORD = re.compile("[^\x20\x09-\x0d]+")
SHAPE = "conv_id bigint, turn bigint, role string, text string"


def brute(rows):
    told = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            told[conv].append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    said = {c: [(t[2], t[4]) for t in sorted(v, key=lambda t: t[:4])] for c, v in told.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, own in said.items():
        h = zlib.crc32(str(c).encode()) % 4
        root = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        path = tuple(said.get(root, [])[:h] + own[h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    below = defaultdict(list)
    for path in members:
        if path:
            below[path[:-1]].append(path)
    figures = {}
    for path in sorted(members, key=len, reverse=True):
        words = len(WORD.findall(path[-1][1])) if path else 0
        leaves = sum(figures[k][0] for k in below[path]) or 1
        saved = sum(figures[k][1] for k in below[path]) + (len(members[path]) - 1) * words
        figures[path] = (leaves, saved)
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(below[p]), *figures[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
        for p, m in members.items()
    )


def built(df, **cuts):
    if "band" in cuts:
        band = cuts.pop("band")
        steps, whole = prefix_trie.rebuilt(prefix_trie.turns(df), **cuts)
        df = prefix_trie.nodes(steps, whole, band=band, **cuts)
    else:
        df = prefix_trie.prefix_trie(df, **cuts)
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[:2])


def talks(seed, convs=60, most=5):
    rng = random.Random(seed)
    out = []
    for c in range(convs):
        for t in range(rng.randrange(most + 1)):
            out.append((c * rng.choice([1, 1, 1, 3]) - 5, rng.choice([t, t, None]), rng.choice(["user", "assistant", None]), rng.choice(["a b", "c", "", None, "d  e\tf", "é 　x"])))
    return out + [(None, 0, "user", "x"), (7, 1, "user", "same"), (7, 1, "user", "same")]


def test_given_conversations(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in df.collect()]
    assert built(df.withColumns({c: F.lit("x") for c in ("conv", "depth", "path", "a", "words", "at", "band", "_slice")})) == brute(rows)


@pytest.mark.parametrize("cuts", [{}, {"band": 1}, {"band": 2}, {"band": 3, "limit": 2, "slice_rows": 3}])
def test_random_trees(spark, cuts):
    rows = talks(len(cuts) + 1)
    assert built(spark.createDataFrame(rows, SHAPE).repartition(5), **cuts) == brute(rows)


def test_a_long_conversation_its_copies_and_a_late_branch(spark):
    long = [(c, t, "user", f"w{t} x") for c in (20, 40, 41) for t in range(40)]
    fork = [(61, t, "user", f"w{t} x" if t < 27 else f"z{t}") for t in range(31)]
    rows = long + fork + [(62, 0, "user", "w0 x"), (63, 0, None, None)]
    assert built(spark.createDataFrame(rows, SHAPE), band=9, limit=35, slice_rows=30) == brute(rows)


def test_all_alike_and_empty(spark):
    rows = [(c, t, "user", "one two") for c in range(400) for t in range(2)]
    assert built(spark.createDataFrame(rows, SHAPE)) == brute(rows)
    assert built(spark.createDataFrame([], SHAPE)) == []
    assert built(spark.createDataFrame([(None, 1, "user", "x")], SHAPE)) == []
    # 23 borrows from 20, which is absent: it may end without turns
    short = [(c, 0, "user", "hi") for c in range(21, 40)]
    assert built(spark.createDataFrame(short, SHAPE)) == brute(short)


def test_long_lists_of_endings_are_hashed_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 7)
    rows = [(c, 0, "user", "x") for c in range(0, 2000, 20)]
    assert built(spark.createDataFrame(rows, SHAPE).repartition(9)) == brute(rows)


def test_very_long_text(spark):
    rows = [(0, 0, "user", "w " * 200_000), (20, 0, "user", "w " * 200_000), (1, 0, "user", "w")]
    assert built(spark.createDataFrame(rows, SHAPE)) == brute(rows)
