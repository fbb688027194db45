"""The trie of conversations against a plain one, over few and many ranges."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from fleetspc.llm import prefix_trie

WORD = re.compile("[^\\x20\\x09-\\x0D]+")
SCHEMA = "conv_id long, turn long, role string, text string, key string, turns int"


def digest(role, text):
    return hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()


def plain(rows):
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(turns)] for c, turns in own.items()}
    members = defaultdict(list)
    ends = defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 4
        # As in Spark and C: the remainder has the sign of c.
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        turns = tuple(own.get(base, [])[:h] + own[c][h:])
        ends[turns].append(c)
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    below = {}
    for node in sorted(members, key=len, reverse=True):
        saved = (len(members[node]) - 1) * len(WORD.findall(node[-1][1])) if node else 0
        leaves = sum(below[c][0] for c in children[node]) or 1
        below[node] = (leaves, saved + sum(below[c][1] for c in children[node]))
    return sorted(
        (min(ids), len(node), min(members[node[:-1]]) if node else -1, len(ids), len(children[node]), *below[node],
         hashlib.sha256(",".join(map(str, ends[node])).encode()).hexdigest())
        for node, ids in members.items()
    )


def got(spark, rows):
    turns = spark.createDataFrame(rows, SCHEMA).repartition(4)
    rebuilt = prefix_trie.rebuild(
        prefix_trie.own_turns(turns), lambda c: c - c % 20, lambda c: F.crc32(c.cast("string").cast("binary")) % 4, 3
    )
    return sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in prefix_trie.trie(rebuilt).collect())


def conversations(n, seed):
    """Short ones with common openings, equal ones, long ones, and odd rows."""
    rnd, rows = random.Random(seed), []
    said = ["hi there", "", None, "two words", "a b\tc\nd", "ok", "ok ok"]
    for c in rnd.sample(range(3 * n), n):
        if rnd.random() < 0.3:
            turns = [("user", "same"), ("assistant", "same again"), ("user", "ok")] + [("user", "more")] * (c % 2)
        else:
            turns = [(rnd.choice(["user", "assistant", None]), rnd.choice(said)) for _ in range(rnd.randint(1, 6))]
        rows += [(c, rnd.choice([i, i, i, None]), role, text, "x", 1) for i, (role, text) in enumerate(turns)]
    rows += [(77_777, i, "user", f"turn {i // 40}", "x", 1) for i in range(300)]
    rows += [(77_778, i, "user", f"turn {i // 40}", "x", 1) for i in range(290)]
    rows += [(-25, 0, "user", "negative", "x", 1), (-40, 0, "user", "ok", "x", 1), (None, 0, "user", "nobody", "x", 1)]
    return rows + [(3, 0, "user", "repeated", "x", 1)] * 3


@pytest.mark.parametrize("ranges, fan, ids", [(1, 64, 4096), (4, 64, 3), (24, 2, 4096), (24, 3, 2)])
def test_like_plain(spark, monkeypatch, ranges, fan, ids):
    """Also when nodes reach over many ranges, and are merged in several rounds."""
    monkeypatch.setattr(prefix_trie, "FAN", fan)
    monkeypatch.setattr(prefix_trie, "IDS", ids)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = conversations(150, seed=ranges + fan)
        assert got(spark, rows) == plain(rows)
    finally:
        for name, value in kept.items():
            spark.conf.set(name, value)


def test_copies_and_lonely(spark):
    same = [(c, i, "user", f"t{i}", None, None) for c in range(1, 400) for i in range(4)]
    assert got(spark, same) == plain(same)
    one = [(5, None, None, None, None, None)]
    assert got(spark, one) == plain(one)
    assert got(spark, [(None, 1, "user", "x", None, None)]) == []


def test_shared_turns():
    a, b = bytes(16) + b"x" * 32, bytes(16) + b"x" * 16 + b"y" * 16
    assert [prefix_trie.shared_turns(*p) for p in ((a, b), (a, a), (b"", a), (a, a[:16]))] == [2, 3, 0, 1]
