"""Packing documents into sequences by cutting-stock column generation.

A document's ids are cut into pieces of the sequence length and a rest. Rests have lengths below
the sequence length, so however many documents there are, their lengths make a histogram of bounded
size. On that histogram the cutting-stock linear program is solved: columns are patterns of lengths
that fit one sequence, priced by a knapsack dynamic program, until no pattern improves it. The
patterns are rounded down, what is left is filled greedily, and the pieces of each length class,
numbered without gaps, are dealt to the patterns' places.

Lengths are rounded up to multiples of GRAIN in the histogram only. Texts are tokenised once; only
ids' checksums and lengths are stored and shuffled.

NULL text is empty; every document ends with the end id, so an empty one has one token. Repeated
rows are packed each. NULL doc_id is an id like any other. Further columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetspc.llm.frames import text_or_empty
from fleetspc.llm.tokens import TextTokenizer
from fleetspc.sources.workspace import materialize

SEQUENCE = 2048
END_ID = 1
GRAIN = 8
ROWS_PER_BUCKET = 20_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut_pieces(docs: DataFrame, tokenizer_path: str, sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """Pieces of at most `sequence` ids, each with the CRC-32 of its ids as unsigned 32-bit numbers."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = TextTokenizer(tokenizer_path)
        end, step = end_id.to_bytes(4, "little"), 4 * sequence
        for batch in batches:
            out = []
            for doc, ids in zip(batch["doc_id"], tokenizer.encode(batch["text"])):
                ids += end
                for at in range(0, len(ids), step):
                    piece = ids[at : at + step]
                    out.append((doc, at // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4))
            frame = pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
            yield frame.astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("string"), text_or_empty().alias("text")).mapInPandas(cut, PIECES)


def _best_pattern(value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: value[k] is that of an item of size k + 1."""
    best = np.zeros(capacity + 1)
    taken = np.zeros(capacity + 1, dtype=int)
    items = len(value)
    for room in range(1, capacity + 1):
        fits = min(items, room)
        # Sizes 1 to fits leave rooms room - 1 down to room - fits.
        totals = value[:fits] + best[room - fits : room][::-1]
        k = int(totals.argmax())
        if totals[k] > best[room - 1]:
            best[room], taken[room] = totals[k], k + 1
        else:
            best[room] = best[room - 1]
    pattern, room = np.zeros(items, dtype=int), capacity
    while room:
        if taken[room]:
            pattern[taken[room] - 1] += 1
            room -= taken[room]
        else:
            room -= 1
    return float(best[capacity]), pattern


def solve_patterns(demand: np.ndarray, capacity: int, *, rounds: int = 4_000) -> list[tuple[np.ndarray, int]]:
    """Patterns and how often each is used, so that every item of the demand has a place.

    demand[k] is the number of items of size k + 1. The linear program is solved by the simplex
    method with an explicit inverse; its size is the number of different sizes, not of items.
    After `rounds` columns it stops with the patterns it has, which only costs padding.
    """
    sizes = np.flatnonzero(demand)
    if not len(sizes):
        return []
    want = demand[sizes].astype(float)
    fit = capacity // (sizes + 1)
    columns = np.diag(fit).astype(float)
    inverse = np.diag(1.0 / fit)
    used = inverse @ want
    for _ in range(rounds):
        price = inverse.sum(axis=0)
        value = np.zeros(len(demand))
        value[sizes] = np.maximum(price, 0.0)
        best, pattern = _best_pattern(value, capacity)
        if best <= 1 + 1e-9:
            break
        entering = pattern[sizes].astype(float)
        direction = inverse @ entering
        positive = direction > 1e-9
        if not positive.any():
            break
        ratio = np.full(len(sizes), np.inf)
        ratio[positive] = used[positive] / direction[positive]
        out = int(ratio.argmin())
        columns[:, out] = entering
        pivot = inverse[out] / direction[out]
        inverse -= np.outer(direction, pivot)
        inverse[out] = pivot
        used -= direction * ratio[out]
        used[out] = ratio[out]
        used = np.maximum(used, 0.0)

    left = demand[sizes].astype(np.int64)
    plan: list[tuple[np.ndarray, int]] = []

    def place(pattern: np.ndarray, times: int) -> None:
        nonlocal left
        inside = pattern > 0
        times = min(times, int((left[inside] // pattern[inside]).min()))
        if times > 0:
            left = left - times * pattern
            whole = np.zeros(len(demand), dtype=np.int64)
            whole[sizes] = pattern
            plan.append((whole, times))

    for k in np.argsort(-used):
        place(np.rint(columns[:, k]).astype(np.int64), int(used[k] + 1e-6))
    while left.any():
        pattern, room = np.zeros(len(sizes), dtype=np.int64), capacity
        for k in reversed(range(len(sizes))):
            pattern[k] = min(left[k], room // (sizes[k] + 1))
            room -= pattern[k] * (sizes[k] + 1)
        place(pattern, int(left.max()))
    return plan


def deal(plan: list[tuple[np.ndarray, int]]) -> list[tuple[int, int, int, int, int]]:
    """(size class, first number, items a sequence, first sequence, numbers) of each pattern's places."""
    rows, sequence = [], 0
    numbered: dict[int, int] = {}
    for pattern, times in plan:
        for k in np.flatnonzero(pattern):
            first, each = numbered.get(int(k), 0), int(pattern[k])
            rows.append((int(k), first, each, sequence, each * times))
            numbered[int(k)] = first + each * times
        sequence += times
    return rows


def number_pieces(pieces: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Add `number`, from 0 without gaps within each size class, in no particular but a fixed order.

    Pieces are numbered within hashed buckets, and the buckets of a class are laid end to end, so
    no class is sorted in one task.
    """
    counts = pieces.groupBy("size_class").agg(F.count(F.lit(1)).alias("_n"))
    buckets = counts.select(F.col("size_class"), F.ceil(F.col("_n") / rows_per_bucket).alias("_buckets"))
    placed = pieces.join(F.broadcast(buckets), "size_class").withColumn(
        "_bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.col("_buckets"))
    )
    order = ["doc_id", "start", "ids_crc32", "doc_tokens", "length"]
    inside = Window.partitionBy("size_class", "_bucket").orderBy(*order)
    along = Window.partitionBy("size_class").orderBy("_bucket")
    sums = placed.groupBy("size_class", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    sums = sums.withColumn("_before", F.sum("_n").over(along) - F.col("_n")).drop("_n")
    numbered = placed.withColumn("_inside", F.row_number().over(inside) - 1)
    joined = numbered.join(sums, ["size_class", "_bucket"])
    return joined.withColumn("number", F.col("_inside") + F.col("_before")).drop("_buckets", "_bucket", "_inside", "_before")


def pack(
    docs: DataFrame, tokenizer_path: str, *, sequence: int = SEQUENCE, end_id: int = END_ID, grain: int = GRAIN
) -> DataFrame:
    """Pieces with `sequence_id` and `offset`, the ids before it in its sequence."""
    spark = docs.sparkSession
    pieces = materialize(cut_pieces(docs, tokenizer_path, sequence, end_id), "pieces", compression="zstd")
    capacity = sequence // grain
    size_class = (F.ceil(F.col("length") / grain) - 1).cast("int")
    pieces = pieces.withColumn("size_class", size_class)
    # At most sequence / grain rows.
    histogram = pieces.groupBy("size_class").agg(F.count(F.lit(1)).alias("n")).collect()
    demand = np.zeros(capacity, dtype=np.int64)
    for row in histogram:
        demand[row["size_class"]] = row["n"]
    places = spark.createDataFrame(
        deal(solve_patterns(demand, capacity)),
        "size_class int, first long, each long, first_sequence long, numbers long",
    )
    by_class = places.groupBy("size_class").agg(
        F.array_sort(F.collect_list(F.struct("first", "each", "first_sequence", "numbers"))).alias("_places")
    )
    numbered = number_pieces(pieces).join(F.broadcast(by_class), "size_class")
    at = F.element_at(
        F.filter("_places", lambda p: (p["first"] <= F.col("number")) & (F.col("number") < p["first"] + p["numbers"])), 1
    )
    numbered = numbered.withColumn("_at", at)
    step = F.col("number") - F.col("_at")["first"]
    each = F.col("_at")["each"]
    placed = numbered.withColumn("sequence_id", F.col("_at")["first_sequence"] + F.floor(step / each)).withColumn("_slot", step % each)
    within = Window.partitionBy("sequence_id").orderBy(F.col("size_class").desc(), "_slot")
    placed = placed.withColumn("offset", F.sum("length").over(within) - F.col("length"))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
