"""The prefix trie (operator 12) against brute force, with many small shards."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sedge.llm import prefix_trie
from sedge.llm.prefix_trie import Skeleton, choose_splitters, paths

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def brute(rows, rebuilt):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            x = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[c].append(((turn is not None, turn or 0), x, role, text))
    turns = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    if rebuilt:
        h = {c: zlib.crc32(str(c).encode()) % 6 for c in turns}
        base = {c: c - int(np.fmod(c, 100)) for c in turns}
        turns = {c: turns.get(base[c], [])[: h[c]] + v[h[c] :] for c, v in turns.items()}
    members = defaultdict(list)
    for c in sorted(turns):
        for d in range(len(turns[c]) + 1):
            members[tuple(turns[c][:d])].append(c)
    kids, leaves, saved = (defaultdict(int) for _ in range(3))
    for p in members:
        kids[p[:-1]] += bool(p)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    sha = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    return sorted(
        (m[0], len(p), members[p[:-1]][0] if p else -1, len(m), kids[p], leaves[p], saved[p], sha([c for c in m if len(turns[c]) == len(p)]))
        for p, m in members.items()
    )


def trie(spark, rows, rebuilt, shard_turns):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS path", "2 AS shard", "3 AS base")
    c = F.col("conv_id")
    given = paths(df, c - c % 100, F.crc32(c.cast("string").cast("binary")) % 6) if rebuilt else paths(df)
    found = prefix_trie.prefix_trie(given, shard_turns=shard_turns).collect()
    return sorted(tuple(-1 if x is None else x for x in r) for r in found)


def conversations(n):
    """Many that begin alike, many equal ones, long ones that part late, null and repeated turns."""
    rng, rows = np.random.default_rng(11), []
    for c in range(n):
        kind = rng.integers(5)
        if kind == 0:
            texts = ["same", "all", "over"]
        elif kind == 1:
            texts = ["hello"] * int(rng.integers(1, 40))
        else:
            texts = [f"t{rng.integers(3)}" for _ in range(rng.integers(1, 7))]
        rows += [(c, i, ["user", "assistant"][i % 2], t) for i, t in enumerate(texts)]
    rows += [(5, None, None, None), (5, None, None, None), (None, 1, "user", "x"), (-7, 0, "user", "é" * 5), (-107, 0, "user", None)]
    rows += [(10**15 + 1, 3, "u", "ser"), (10**15 + 2, 3, "us", "er")]
    return rows


@pytest.mark.parametrize("rebuilt", [False, True])
@pytest.mark.parametrize("shard_turns", [40, 10**6])
def test_against_brute_force(spark, rebuilt, shard_turns):
    rows = conversations(300)
    assert trie(spark, rows, rebuilt, shard_turns) == brute(rows, rebuilt)


def test_shards_of_equal_conversations(spark):
    rows = [(c, i, "user", f"x{i}") for c in range(2500) for i in range(2)]
    rows += [(9000 + c, 0, "user", "y") for c in range(40)]
    given = paths(spark.createDataFrame(rows, SCHEMA))
    places = Skeleton(choose_splitters(given, 500))
    dealt = [places.shard(bytes(r.path), r.conv_id) for r in given.collect()]
    assert np.bincount(dealt).max() < 800  # equal ones are split, too
    assert trie(spark, rows, False, 500) == brute(rows, False)


def test_one_long_conversation(spark):
    rows = [(1, i, "user", str(i % 7)) for i in range(20_000)] + [(2, i, "user", str(i % 7)) for i in range(50)]
    got = trie(spark, rows, False, 100)
    assert len(got) == 20_001
    assert sum(g[3] for g in got) == 20_001 + 51 and got == sorted(brute_chain(20_000, 50))


def brute_chain(n, m):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    saved = 0
    for d in range(n, -1, -1):
        saved += bool(0 < d <= m)
        ends = "1" if d == n else "2" if d == m else ""
        yield 1, d, 1 if d else -1, 2 if d <= m else 1, int(d < n), 1, saved, sha(ends)


@pytest.mark.parametrize("rows", [[], [(None, 1, "a", "b")], [(3, None, None, None)]])
def test_next_to_nothing(spark, rows):
    assert trie(spark, rows, True, 1) == (brute(rows, True) if any(r[0] is not None for r in rows) else [])
