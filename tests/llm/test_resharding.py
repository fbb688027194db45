"""Resharding: least flows against all ways to send them, and layouts that keep every document."""

import itertools
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from fleetspc.llm import resharding
from fleetspc.sources.workspace import exists, new_path

RND = random.Random(11)


def plain_least_cost(supply, demand, cost):
    """Each unit of supply to each unit of demand, all ways."""
    units = [i for i, n in enumerate(supply) for _ in range(n)]
    places = [j for j, n in enumerate(demand) for _ in range(n)]
    return min(sum(cost[i][j] for i, j in zip(units, order)) for order in set(itertools.permutations(places)))


def test_least_cost():
    for _ in range(150):
        supply = [RND.randint(0, 3) for _ in range(RND.randint(1, 3))]
        total = sum(supply)
        if total > 7:
            continue
        demand = [0] * RND.randint(1, 4)
        for _ in range(total):
            demand[RND.randrange(len(demand))] += 1
        cost = [[RND.randint(0, 9) for _ in demand] for _ in supply]
        flow = resharding.min_cost_transfers(supply, demand, cost)
        assert all(f > 0 for f in flow.values())
        for i, n in enumerate(supply):
            assert sum(f for (a, _), f in flow.items() if a == i) == n
        for j, n in enumerate(demand):
            assert sum(f for (_, b), f in flow.items() if b == j) == n
        assert sum(f * cost[i][j] for (i, j), f in flow.items()) == plain_least_cost(supply, demand, cost)


def test_bytes_that_need_not_move_stay():
    for _ in range(20):
        old = [RND.randint(0, 10**13) for _ in range(RND.randint(1, 12))]
        new = resharding.equal_capacities(sum(old), RND.randint(1, 12))
        flow = resharding.min_cost_transfers(old, new)
        moved = sum(f for (i, j), f in flow.items() if i != j)
        assert moved == sum(old) - sum(min(a, b) for a, b in zip(old, new))
    with pytest.raises(ValueError):
        resharding.min_cost_transfers([1], [2])


SCHEMA = "doc_id long, text string, shard string, size string, pos int"


def corpus(spark, n=250):
    texts = ["", None, "é" * 50, "copy"] + ["x" * RND.randint(1, 400) for _ in range(20)]
    rows = [(RND.choice([7, RND.randrange(n), None]), RND.choice(texts), "s", None, i % 3) for i in range(n)]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(6)


def placed(spark, folder, version, docs):
    rows = resharding.read_shards(spark, folder, version, docs.schema).collect()
    slots = defaultdict(list)
    for r in rows:
        assert r["size"] == len((r.doc.text or "").encode()) + 1
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return rows


def shard_bytes(rows):
    total = Counter()
    for r in rows:
        total[r.shard] += r["size"]
    return total


@pytest.mark.parametrize("block_bytes, block_rows", [(32 << 20, 100_000), (600, 10)])
def test_shards(spark, monkeypatch, block_bytes, block_rows):
    """To more and to fewer shards and to uneven ones, from a hot id, with large and small blocks."""
    monkeypatch.setattr(resharding, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(resharding, "BLOCK_ROWS", block_rows)
    rows, docs = corpus(spark)
    folder = new_path(spark, "shards")
    resharding.lay_out(docs, folder, 3)
    before = placed(spark, folder, 0, docs)
    largest = max(r["size"] for r in before)
    version, total = 0, sum(r["size"] for r in before)
    for shards, capacities in ((5, None), (2, None), (4, [total // 2, 0, total // 3, total - total // 2 - total // 3])):
        wanted = capacities or resharding.equal_capacities(total, shards)
        old, where = shard_bytes(before), Counter((r.shard, r.doc) for r in before)
        assert resharding.reshard(spark, folder, version, shards, docs.schema, capacities=capacities) == version + 1
        version += 1
        after = placed(spark, folder, version, docs)
        assert Counter(tuple(r.doc) for r in after) == Counter(rows)
        got = shard_bytes(after)
        assert all(abs(got[j] - wanted[j]) <= largest * 3 for j in range(shards))
        must = total - sum(min(old[j], wanted[j]) for j in range(shards))
        stayed = sum((where & Counter((r.shard, r.doc) for r in after)).values())
        moved = total - sum((len((d.text or "").encode()) + 1) * n for (_, d), n in (where & Counter((r.shard, r.doc) for r in after)).items())
        assert moved <= must + 3 * largest * shards and stayed
        before = after


def test_files_that_stay_are_not_rewritten(spark, monkeypatch):
    monkeypatch.setattr(resharding, "BLOCK_ROWS", 10)
    _, docs = corpus(spark)
    folder = new_path(spark, "shards")
    resharding.lay_out(docs, folder, 4)
    resharding.reshard(spark, folder, 0, 5, docs.schema)
    blocks = resharding.manifest(spark, folder, 1)
    rewritten = spark.read.parquet(f"{folder}/v1/data")
    assert blocks.where("version = 0").count() > 10
    assert rewritten.count() == blocks.where("version = 1").agg(F.sum("n_rows")).first()[0]
    assert blocks.where("version = 0 and shard <> home").count() == 0
    # Nothing to move: the next version has no files of its own.
    assert resharding.reshard(spark, folder, 1, 5, docs.schema, capacities=[resharding.shard_sizes(spark, folder, 1)[j] for j in range(5)]) == 2
    assert resharding.manifest(spark, folder, 2).where("version = 2").count() == 0
    assert exists(spark, f"{folder}/v0/manifest")


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    folder = new_path(spark, "shards")
    resharding.lay_out(docs, folder, 3)
    assert resharding.reshard(spark, folder, 0, 8, docs.schema) == 1
    assert resharding.read_shards(spark, folder, 1, docs.schema).count() == 0
