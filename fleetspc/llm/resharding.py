"""A sharded corpus that moves to new capacities with the fewest bytes moved.

A layout is a folder per version with block files and a manifest. A block is a run of documents of
one shard that are alike in size, at most about BLOCK_BYTES or BLOCK_ROWS; the manifest says which
shard a block belongs to, which folder holds it, and the slot of its first document. A document's
slot is that plus its position in the block, so a shard's slots are gapless without the files
being touched.

To reshard, the sizes of the old shards and the new capacities make a transportation network: an
arc from every old to every new shard costs 1 a byte, or what the caller says, and nothing where a
byte stays in its shard. Its minimum-cost flow, found by successive shortest paths on a network of
shards, says how many bytes go where. A shard gives away its smallest documents: its blocks, in
falling order of mean document size, are laid along the line of its bytes, and each takes the
target of the stretch it lies in. A block that a border crosses is divided at the document whose
middle is nearest beyond the border, so a shard misses its capacity by half a small document per
border. Blocks that stay are not read; those that move or are divided are rewritten to the folder of
the new version. The manifest is written last, so a version either exists whole or not at all.

Rows: a document's size is the UTF-8 bytes of its text and 1; NULL text has size 1 and stays NULL.
A NULL id is an id like others. Equal rows are placed one by one, nothing keeps them together, and
they are dealt to blocks by their place in the input, so many copies fill many blocks. All columns of
a document are kept in one struct, so their names clash with nothing. An empty table makes a layout
without blocks. One document larger than a capacity makes its shard exceed it.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetspc.sources.workspace import materialize

BLOCK_BYTES = 32 << 20
BLOCK_ROWS = 100_000

MANIFEST = "shard int, start long, n_rows long, bytes long, version int, home int, block long"
PLACE = ["version", "home", "block"]


def min_cost_transfers(
    supply: Sequence[int], demand: Sequence[int], cost: Sequence[Sequence[int]] | None = None
) -> dict[tuple[int, int], int]:
    """{(i, j): amount} of least total cost that empties `supply` into `demand`, whose sums are equal.

    Successive shortest paths with potentials; `cost[i][j]` is not negative and by default 1, 0 if
    i == j. Works on shards, of which there are some thousands at most.
    """
    if sum(supply) != sum(demand):
        raise ValueError(f"supply {sum(supply)} and demand {sum(demand)} differ")
    n, m = len(supply), len(demand)
    if cost is None:
        cost = [[int(i != j) for j in range(m)] for i in range(n)]
    left, room = list(supply), list(demand)
    flow: dict[tuple[int, int], int] = {}
    # Nodes: suppliers 0..n-1, receivers n..n+m-1.
    potential = [0] * (n + m)
    while any(left):
        dist: list[float] = [float("inf")] * (n + m)
        before = [-1] * (n + m)
        heap = []
        for i in range(n):
            if left[i]:
                dist[i] = -potential[i]
                heap.append((dist[i], i))
        heapq.heapify(heap)
        carried: dict[int, list[int]] = {}
        for i, j in flow:
            carried.setdefault(j, []).append(i)
        while heap:
            d, u = heapq.heappop(heap)
            if d > dist[u]:
                continue
            if u < n:
                steps = ((n + j, cost[u][j]) for j in range(m))
            else:
                steps = ((i, -cost[i][u - n]) for i in carried.get(u - n, ()))
            for v, c in steps:
                reached = d + c + potential[u] - potential[v]
                if reached < dist[v]:
                    dist[v], before[v] = reached, u
                    heapq.heappush(heap, (reached, v))
        length = [d + p for d, p in zip(dist, potential)]
        end = min((n + j for j in range(m) if room[j]), key=lambda v: length[v])
        path = [end]
        while before[path[-1]] >= 0:
            path.append(before[path[-1]])
        path.reverse()
        amount = min(left[path[0]], room[end - n])
        for u, v in zip(path, path[1:]):
            if u >= n:
                amount = min(amount, flow[(v, u - n)])
        for u, v in zip(path, path[1:]):
            arc, change = ((u, v - n), amount) if u < n else ((v, u - n), -amount)
            flow[arc] = flow.get(arc, 0) + change
            if not flow[arc]:
                del flow[arc]
        left[path[0]] -= amount
        room[end - n] -= amount
        potential = [p + min(d, dist[end]) for p, d in zip(potential, dist)]
    return flow


def equal_capacities(total: int, shards: int) -> list[int]:
    """Capacities that differ by one byte at most."""
    return [total // shards + (j < total % shards) for j in range(shards)]


def _data(spark: SparkSession, folder: str, version: int, doc: T.StructType) -> DataFrame:
    """Rows of a version's folder: doc, size, pos, and home and block of their file."""
    schema = T.StructType([
        T.StructField("doc", doc), T.StructField("size", T.LongType()), T.StructField("pos", T.LongType()),
        T.StructField("home", T.IntegerType()), T.StructField("block", T.LongType()),
    ])
    rows = spark.read.schema(schema).parquet(f"{folder}/v{version}/data")
    return rows.withColumn("version", F.lit(version))


def _write(rows: DataFrame, folder: str, version: int) -> None:
    rows.write.partitionBy("home", "block").option("compression", "zstd").parquet(f"{folder}/v{version}/data")


def _with_slots(blocks: DataFrame) -> DataFrame:
    """Blocks with the slot of their first document, in the columns of MANIFEST."""
    earlier = Window.partitionBy("shard").orderBy(*PLACE).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("n_rows").over(earlier), F.lit(0)).alias("start")
    return blocks.select(F.col("shard").cast("int").alias("shard"), start, "n_rows", "bytes", *PLACE)


def manifest(spark: SparkSession, folder: str, version: int) -> DataFrame:
    """(shard, start, n_rows, bytes, version, home, block): one row per block."""
    return spark.read.schema(MANIFEST).parquet(f"{folder}/v{version}/manifest")


def lay_out(docs: DataFrame, folder: str, shards: int, *, key: str = "doc_id", text: str = "text") -> None:
    """Write version 0: shards by a hash of the key, as blocks of documents of like size."""
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    rows = docs.select(
        F.struct(*docs.columns).alias("doc"), size.alias("size"),
        F.pmod(F.xxhash64(key), F.lit(shards)).cast("int").alias("home"),
        # Blocks of large documents come first.
        (F.lit(64) - F.length(F.bin(size))).cast("long").alias("_class"),
    )
    held = rows.groupBy("home", "_class").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    buckets = F.ceil(F.greatest(F.col("bytes") / BLOCK_BYTES, F.col("n") / BLOCK_ROWS)).cast("long")
    held = materialize(held.select("home", "_class", buckets.alias("_buckets")), "shard-classes")
    placed = (
        rows.withColumn("_row", F.monotonically_increasing_id())
        .join(held, ["home", "_class"])
        .withColumn("block", F.col("_class") * F.lit(1 << 40) + F.pmod(F.xxhash64("_row"), F.col("_buckets")))
        .repartition("home", "block")
    )
    in_block = Window.partitionBy("home", "block").orderBy(F.col("size").desc(), f"doc.{key}", "_row")
    placed = placed.withColumn("pos", F.row_number().over(in_block).cast("long") - 1)
    _write(placed.select("doc", "size", "pos", "home", "block"), folder, 0)
    written = _data(docs.sparkSession, folder, 0, docs.schema)
    blocks = written.groupBy(*PLACE).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("size").alias("bytes"))
    _with_slots(blocks.withColumn("shard", F.col("home"))).write.parquet(f"{folder}/v0/manifest")


def shard_sizes(spark: SparkSession, folder: str, version: int) -> dict[int, int]:
    """Bytes of each shard that holds any: one row per shard."""
    sums = manifest(spark, folder, version).groupBy("shard").agg(F.sum("bytes").alias("bytes"))
    return {r["shard"]: r["bytes"] for r in sums.collect()}


def reshard(
    spark: SparkSession,
    folder: str,
    version: int,
    shards: int,
    doc: T.StructType,
    *,
    capacities: Sequence[int] | None = None,
    cost: Sequence[Sequence[int]] | None = None,
) -> int:
    """Write version + 1 with `shards` shards and return its number.

    `capacities` sum to all bytes, by default they are equal; `cost[i][j]` is the cost of a byte
    from old shard i to new shard j.
    """
    sizes = shard_sizes(spark, folder, version)
    old = [sizes.get(i, 0) for i in range(max([*sizes, -1]) + 1)]
    flow = min_cost_transfers(old, capacities or equal_capacities(sum(old), shards), cost)

    # Each old shard's line of bytes: first what stays, then what goes to the others in turn.
    stretches = []
    for i in range(len(old)):
        at = 0
        for _, j in sorted((k != i, k) for h, k in flow if h == i):
            stretches.append((i, j, at, at + flow[(i, j)]))
            at += flow[(i, j)]
    lines = spark.createDataFrame(stretches, "shard int, target int, low long, high long")

    blocks = manifest(spark, folder, version)
    in_line = Window.partitionBy("shard").orderBy((F.col("bytes") / F.col("n_rows")).desc(), *PLACE)
    end = F.sum("bytes").over(in_line.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    along = blocks.withColumn("end", end).withColumn("begin", F.col("end") - F.col("bytes"))
    meets = (F.col("low") < F.col("end")) & (F.col("high") > F.col("begin"))
    targets = F.array_sort(F.collect_list(F.struct("low", "high", "target")))
    # At most as many stretches as shards; a block is one row of the manifest.
    along = along.join(lines, "shard").where(meets).groupBy(*PLACE, "shard", "n_rows", "bytes", "begin").agg(targets.alias("targets"))
    along = along.withColumn("action", F.when(F.size("targets") > 1, "divide").when(F.col("targets")[0]["target"] == F.col("shard"), "keep").otherwise("move"))
    along = materialize(along, "block-actions")
    folders = [r["version"] for r in blocks.select("version").distinct().collect()]

    def rows_of(actions: DataFrame, *columns: str) -> DataFrame:
        """Stored rows of blocks; the join is on partition columns of the files."""
        parts = [
            _data(spark, folder, v, doc).join(actions.where(F.col("version") == v), PLACE).select(*PLACE, *columns) for v in folders
        ]
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.unionByName(part)
        return whole

    if not folders:
        _with_slots(blocks).write.parquet(f"{folder}/v{version + 1}/manifest")
        return version + 1

    # Where the rows of a divided block go: by the middle of the row on the shard's line.
    divided = rows_of(along.where(F.col("action") == "divide"), "pos", "size", "begin", "targets")
    in_block = Window.partitionBy(*PLACE).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    middle = F.col("begin") + F.sum("size").over(in_block) - F.col("size") / 2
    beyond = F.greatest(F.size(F.filter("targets", lambda t: t["low"] <= F.col("_middle"))), F.lit(1))
    pieces = (
        divided.withColumn("_middle", middle)
        .withColumn("target", F.col("targets")[beyond - 1]["target"])
        .groupBy(*PLACE, "target")
        .agg(F.min("pos").alias("low_pos"), F.count(F.lit(1)).alias("n_rows"), F.sum("size").alias("bytes"))
    )
    moved = along.where(F.col("action") == "move").select(
        *PLACE, F.col("targets")[0]["target"].alias("target"), F.lit(0).cast("long").alias("low_pos"), "n_rows", "bytes"
    )
    new_block = F.row_number().over(Window.partitionBy("target").orderBy(*PLACE, "low_pos")).cast("long")
    rewritten = materialize(moved.unionByName(pieces).withColumn("new_block", new_block), "block-pieces")

    inside = (F.col("pos") >= F.col("low_pos")) & (F.col("pos") < F.col("low_pos") + F.col("n_rows"))
    kept = along.where(F.col("action") == "keep").select("shard", "n_rows", "bytes", *PLACE)
    here = F.lit(version + 1)
    made = rewritten.select(
        F.col("target").alias("shard"), "n_rows", "bytes", here.alias("version"), F.col("target").alias("home"), F.col("new_block").alias("block")
    )
    moving = rows_of(rewritten.where(F.col("n_rows") > 0), "doc", "size", "pos", "low_pos", "n_rows", "target", "new_block").where(inside)
    moving = moving.select("doc", "size", (F.col("pos") - F.col("low_pos")).alias("pos"), F.col("target").alias("home"), F.col("new_block").alias("block"))
    _write(moving, folder, version + 1)
    _with_slots(kept.unionByName(made)).write.parquet(f"{folder}/v{version + 1}/manifest")
    return version + 1


def read_shards(spark: SparkSession, folder: str, version: int, doc: T.StructType) -> DataFrame:
    """(doc, size, shard, slot) of every document of a version; slots count from 0 in a shard."""
    blocks = manifest(spark, folder, version)
    out = None
    for v in sorted(r["version"] for r in blocks.select("version").distinct().collect()):
        placed = _data(spark, folder, v, doc).join(blocks.where(F.col("version") == v).drop("version"), ["home", "block"])
        rows = placed.select("doc", "size", "shard", (F.col("start") + F.col("pos")).alias("slot"))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        schema = T.StructType([T.StructField("doc", doc), T.StructField("size", T.LongType()), T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
        return spark.createDataFrame([], schema)
    return out
