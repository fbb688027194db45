"""Token ids in training order, in binary shards of fixed-stride records.

Every sequence is numbered and sent to a slot by a keyed Feistel permutation of the numbers. A
Feistel network permutes a power of four; a result beyond the last number is permuted again until
it falls inside (cycle walking), so the slots are again all numbers, each once. A shard holds a
range of slots in order. Records have one length, so slot s stands in shard s // rows_per_shard at
byte (s % rows_per_shard) * stride, and reading can start or go on anywhere.

A record, little-endian: doc_id (signed 64 bit, the least number for NULL), start and length
(unsigned 32 bit), `sequence` ids (unsigned 16 or 32 bit, zeros after the length), and a line
feed, which Spark's text writer puts after each. So the shards are files of that writer: they go
to any storage Spark can write, and only committed tasks leave files.

Sequences are the documents' ids with the end id, cut at the sequence length. They are numbered as
they were stored, task by task; the order follows from the key and that numbering. Shards are
written in waves, each a range of them, and the shuffle files of a wave are gone before the next,
so that a shuffle never holds all sequences beside those stored and those written. NULL text is
empty; an empty document is one sequence of one id. Repeated rows have sequences of their own.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetspc.llm.frames import text_or_empty
from fleetspc.llm.tokens import TextTokenizer
from fleetspc.sources.workspace import drop, materialize, tidy_session

SEQUENCE = 512
END_ID = 1
KEY = 20_240_601
ROWS_PER_SHARD = 16_384
ROUNDS = 6
NO_DOC = -(2**63)
HEAD = "<qII"
HEAD_SIZE = struct.calcsize(HEAD)
# Records that a task holds in one frame.
RECORDS = 2_048
# Parts that the shards are written in, where each has a shard for every core.
WAVES = 4


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit finalizer: xor-shifts and odd multipliers."""
    x = x + np.uint64((salt * 0x9E3779B97F4A7C15) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(numbers: np.ndarray, total: int, key: int = KEY) -> np.ndarray:
    """Slots of numbers below total: a permutation of all numbers below total."""
    half = max(1, ((total - 1).bit_length() + 1) // 2)
    mask, bits = np.uint64((1 << half) - 1), np.uint64(half)

    def network(x: np.ndarray) -> np.ndarray:
        left, right = x >> bits, x & mask
        for i in range(ROUNDS):
            left, right = right, left ^ (_mixed(right, key * ROUNDS + i) & mask)
        return (left << bits) | right

    slots = network(numbers.astype(np.uint64))
    while (outside := slots >= np.uint64(total)).any():
        slots[outside] = network(slots[outside])
    return slots.astype(np.int64)


def id_type(tokenizer_path: str) -> str:
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(tokenizer_path).get_vocab_size() <= 1 << 16 else "<u4"


def stride(sequence: int, kind: str) -> int:
    return HEAD_SIZE + sequence * int(kind[-1]) + 1


def make_sequences(docs: DataFrame, tokenizer_path: str, kind: str, sequence: int, end_id: int) -> DataFrame:
    """(task, number, record): numbers run from 0 within each task; records end with their ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, task, number = TextTokenizer(tokenizer_path), TaskContext.get().partitionId(), 0
        width, records = int(kind[-1]), []
        end = np.uint32(end_id).tobytes()

        def framed() -> pa.RecordBatch:
            numbers = pa.array(np.arange(number - len(records), number))
            tasks = pa.array(np.full(len(records), task, "int32"))
            return pa.record_batch([tasks, numbers, pa.array(records, pa.binary())], ["task", "number", "record"])

        batch = texts = None
        for batch in batches:
            # One text at a time becomes a Python string.
            texts = (text.as_py() for text in batch["text"])
            for doc, ids in zip(batch["doc_id"], tokenizer.encode(texts)):
                whole = np.frombuffer(ids + end, "<u4").astype(kind).tobytes()
                doc_id = int(doc.as_py()) if doc.is_valid else NO_DOC
                for at in range(0, len(whole), sequence * width):
                    piece = whole[at : at + sequence * width]
                    records.append(struct.pack(HEAD, doc_id, at // width, len(piece) // width) + piece)
                    number += 1
                    if len(records) == RECORDS:
                        yield framed()
                        records = []
        if records:
            yield framed()
        # What is left of the texts goes back to the system, since the process waits for another task.
        del batch, texts, records, tokenizer
        pa.default_memory_pool().release_unused()

    rows = docs.select(F.col("doc_id").cast("string"), text_or_empty().alias("text"))
    return rows.mapInArrow(cut, "task int, number long, record binary")


def shard_ranges(shards: int, cores: int) -> list[tuple[int, int]]:
    """First and last (exclusive) shard of each wave: one wave per `cores` shards, but WAVES at most and one at least."""
    waves = max(1, min(WAVES, shards // max(1, cores)))
    return [(shards * w // waves, shards * (w + 1) // waves) for w in range(waves)]


def write_shards(
    docs: DataFrame,
    folder: str,
    tokenizer_path: str,
    *,
    sequence: int = SEQUENCE,
    end_id: int = END_ID,
    key: int = KEY,
    rows_per_shard: int = ROWS_PER_SHARD,
) -> None:
    """Write the shards of all documents and a manifest of their layout to a new folder."""
    spark = docs.sparkSession
    kind = id_type(tokenizer_path)
    sequences = make_sequences(docs, tokenizer_path, kind, sequence, end_id)
    stored = materialize(sequences, "sequences", compression="zstd", session=tidy_session(spark))
    # One row for each task that wrote sequences.
    tasks = stored.groupBy("task").agg(F.count(F.lit(1)).alias("n"))
    tasks = tasks.select("task", (F.sum("n").over(Window.orderBy("task")) - F.col("n")).alias("first"), "n")
    tasks = materialize(tasks, "sequence-tasks")
    total = tasks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def slots(numbers: pa.Array) -> pa.Array:
        return pa.array(permuted(numbers.to_numpy(zero_copy_only=False), total, key))

    slot = F.arrow_udf(slots, "long")
    placed = stored.join(F.broadcast(tasks.drop("n")), "task").withColumn("slot", slot(F.col("number") + F.col("first")))
    placed = placed.select("slot", F.floor(F.col("slot") / rows_per_shard).alias("shard"), "record")
    full = F.rpad("record", stride(sequence, kind) - 1, F.lit(b"\0"))
    for low, high in shard_ranges(-(-total // rows_per_shard), spark.sparkContext.defaultParallelism):
        wave = placed.where((F.col("shard") >= low) & (F.col("shard") < high))
        # A partition is the range of slots of one shard. Records get their full length as they are written.
        dealt = wave.repartitionById(max(1, high - low), (F.col("shard") - low).cast("int")).sortWithinPartitions("shard", "slot")
        dealt.select(full.cast("string").alias("value"), "shard").write.mode("append").partitionBy("shard").text(f"{folder}/shards")
    drop(stored)
    drop(tasks)
    manifest = dict(
        sequences=total, sequence=sequence, ids=kind, stride=stride(sequence, kind), rows_per_shard=rows_per_shard,
        end_id=end_id, key=key,
    )
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{folder}/manifest")


def read_slots(spark: SparkSession, folder: str, first: int = 0, last: int | None = None, *, checksum: bool = False) -> DataFrame:
    """(slot, shard, doc_id, start, length, ids) of the slots first <= slot < last, ids as bytes.

    Only the shards that hold such slots are opened. With `checksum` there is `ids_crc32` in place
    of `ids`, the CRC-32 of the ids as unsigned 32-bit numbers.
    """
    m = json.loads(spark.read.text(f"{folder}/manifest").first()["value"])
    last = m["sequences"] if last is None else min(last, m["sequences"])
    rows, size, kind = m["rows_per_shard"], m["stride"], m["ids"]
    schema = "path string, modificationTime timestamp, length long, content binary, shard long"
    if not m["sequences"]:
        files = spark.createDataFrame([], schema)
    else:
        files = spark.read.format("binaryFile").schema(schema).option("pathGlobFilter", "part-*").load(f"{folder}/shards")
    wanted = files.where((F.col("shard") >= first // rows) & (F.col("shard") * rows < last)).select("shard", "content")
    result = "ids_crc32 long" if checksum else "ids binary"

    layout = np.dtype([("doc", "<i8"), ("start", "<u4"), ("length", "<u4"), ("ids", kind, (m["sequence"],)), ("feed", "u1")])

    def read(content: pa.Buffer, shard: int, low: int, high: int) -> pa.RecordBatch:
        """Records low <= number < high of a shard."""
        block = np.frombuffer(content, layout, high - low, low * size)
        ids = block["ids"].astype("<u4") if checksum else block["ids"]
        cut = zip(ids, block["length"].tolist())
        told = [zlib.crc32(row[:n]) if checksum else row[:n].tobytes() for row, n in cut]
        columns = {
            "slot": pa.array(np.arange(low, high) + shard * rows),
            "shard": pa.array(np.full(high - low, shard)),
            "doc_id": pa.array(block["doc"].astype("int64"), mask=block["doc"] == NO_DOC),
            "start": pa.array(block["start"].astype("int64")),
            "length": pa.array(block["length"].astype("int64")),
            result.split()[0]: pa.array(told, pa.int64() if checksum else pa.binary()),
        }
        return pa.record_batch(columns)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, held in zip(batch["shard"].to_pylist(), batch["content"]):
                content = held.as_buffer()
                low, high = max(0, first - shard * rows), min(content.size // size, last - shard * rows)
                for at in range(low, high, RECORDS):
                    yield read(content, shard, at, min(at + RECORDS, high))

    return wanted.mapInArrow(records, f"slot long, shard long, doc_id long, start long, length long, {result}")
