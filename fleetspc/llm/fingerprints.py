"""Document fingerprints: quartile bucket digests of hashed byte triplets.

Triplets of bytes from a window that slides over the text are hashed to buckets and counted. The
counts' quartiles turn every bucket into two bits, so the digest says which triplets are frequent
in this text, whatever its length. A byte for the logarithm of the length and a checksum byte
stand in front. Texts that share much have digests with few and small differences.

NULL text is empty. Texts with fewer bytes than a triplet count nothing. Equal texts have equal
digests. Further columns pass through.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetspc.llm.frames import text_or_empty
from fleetspc.sources.workspace import materialize

BUCKETS = 256
# Places of a triplet's second and third byte after its first.
TRIPLETS = ((1, 2), (2, 3))
# A full turn of the length byte: texts this many times longer count as equally long at the latest.
LENGTH_BASE = 1.1

_MULTIPLIERS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)


def _codes(text: bytes) -> np.ndarray:
    """Bucket counts of a text's triplets."""
    data = np.frombuffer(text, np.uint8).astype(np.uint32)
    counts = np.zeros(BUCKETS, np.int64)
    shift = 32 - int(math.log2(BUCKETS))
    for k, (second, third) in enumerate(TRIPLETS):
        n = len(data) - third
        if n <= 0:
            continue
        mixed = (data[:n] + np.uint32(k + 1)) * np.uint32(_MULTIPLIERS[0])
        mixed = (mixed ^ data[second : second + n]) * np.uint32(_MULTIPLIERS[1])
        mixed = (mixed ^ (mixed >> np.uint32(15)) ^ data[third : third + n]) * np.uint32(_MULTIPLIERS[2])
        mixed ^= mixed >> np.uint32(13)
        mixed *= np.uint32(_MULTIPLIERS[0])
        counts += np.bincount(mixed >> np.uint32(shift), minlength=BUCKETS)
    return counts


def fingerprint(text: str) -> bytes:
    data = text.encode()
    counts = _codes(data)
    # Counts at a quarter, half and three quarters of the ordered buckets.
    ordered = np.partition(counts, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1])
    quartiles = ordered[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    two_bits = (counts[:, None] > quartiles[None, :]).sum(axis=1).astype(np.uint8).reshape(-1, 4)
    packed = two_bits @ np.array([64, 16, 4, 1], np.uint8)
    length = min(255, int(math.log(len(data) + 1) / math.log(LENGTH_BASE)))
    return bytes([length, hashlib.sha256(data).digest()[0]]) + packed.astype(np.uint8).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """1 for equal digests, 0 for a difference of the bound or more.

    Two bucket codes differ by 0 to 3, a step of 3 counting as 6; lengths differ by up to 12 steps
    of the length byte. The bound is what two texts without anything in common have on average.
    """
    if a == b:
        return 1.0
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    shifts = np.array([6, 4, 2, 0], np.uint8)
    codes = [((v[2:, None] >> shifts) & 3).ravel().astype(np.int64) for v in (x, y)]
    apart = np.abs(codes[0] - codes[1])
    difference = int(np.where(apart == 3, 6, apart).sum())
    difference += min(12, abs(int(x[0]) - int(y[0]))) + int(x[1] != y[1])
    return max(0.0, 1.0 - difference / (BUCKETS * 1.625))


def with_fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with `fingerprint`, in hexadecimal."""

    def digests(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: fingerprint(t).hex())

    return docs.withColumn("fingerprint", F.pandas_udf(digests, "string")(text_or_empty(text)))


NEXT = (
    "part long, edge string, doc_id long, text string, n_chars long, edited_sha256 string, "
    "fingerprint string, edited_fingerprint string, near_edited double, near_next double"
)


def _compared(text: str, own: bytes, following: str, other: bytes) -> tuple:
    half = len(text) // 2
    edited = text[: len(text) - half] + following[:half]
    print_of_edited = fingerprint(edited)
    return (
        len(text), hashlib.sha256(edited.encode()).hexdigest(), own.hex(), print_of_edited.hex(),
        likeness(own, print_of_edited), likeness(own, other),
    )


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Each document against its text with the second half taken from the next document.

    The next document is the one with the next smaller doc_id, after the last the first; NULL ids
    come last, and equal ids are in the order of a hash of their texts. Documents are dealt out in
    ranges of that order, one shuffle; the last of each range meets the first of the next one
    afterwards, from one row for either end of each range.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text").asc()]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, before = TaskContext.get().partitionId(), None
        for batch in batches:
            out = []
            for doc, text in zip(batch["doc_id"], batch["text"]):
                own = fingerprint(text)
                if before is None:
                    out.append((part, "first", doc, text, None, None, own.hex(), None, None, None))
                else:
                    out.append((part, None, before[0], None, *_compared(before[1], before[2], text, own)))
                before = (doc, text, own)
            yield framed(out)
        if before is not None:
            yield framed([(part, "last", before[0], before[1], None, None, before[2].hex(), None, None, None)])

    def framed(rows: list) -> pd.DataFrame:
        names = ["part", "edge", "doc_id", "text", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        return pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64", "n_chars": "Int64", "near_edited": float, "near_next": float})

    as_text = ranged.select(F.col("doc_id").cast("string"), "text")
    walked = materialize(as_text.mapInPandas(walk, NEXT), "neighbours", compression="zstd")
    result = walked.where(F.col("edge").isNull()).drop("part", "edge", "text")
    edges = walked.where(F.col("edge").isNotNull()).select("part", "edge", "doc_id", "text", "fingerprint")
    # Two rows for each range.
    along = Window.orderBy("part", F.col("edge") == "last")
    around = Window.partitionBy()
    first = F.min(F.when(F.col("edge") == "first", F.struct("part", "text", "fingerprint"))).over(around)
    met = edges.withColumns(
        {
            "next_text": F.coalesce(F.lead("text").over(along), first["text"]),
            "next_print": F.coalesce(F.lead("fingerprint").over(along), first["fingerprint"]),
        }
    ).where(F.col("edge") == "last")

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield framed(
                [
                    (0, None, doc, None, *_compared(text, bytes.fromhex(own), following, bytes.fromhex(other)))
                    for doc, text, own, following, other in zip(
                        batch["doc_id"], batch["text"], batch["fingerprint"], batch["next_text"], batch["next_print"]
                    )
                ]
            )

    ends = met.select(F.col("doc_id").cast("string"), "text", "fingerprint", "next_text", "next_print")
    return result.unionByName(ends.mapInPandas(finish, NEXT).drop("part", "edge", "text"))
