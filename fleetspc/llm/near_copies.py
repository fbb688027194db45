"""Near copies by BagMinHash signatures of word shingles.

A document is the bag of its shingles, five successive words each: words are lower-cased runs
between ASCII white space, and a text of fewer words is one shingle. Two documents are near copies if
their bags' weighted Jaccard similarity, the sum of the lesser counts over the sum of the greater,
is at least 0.8; groups are connected by such links.

Signature. A shingle with count w owns the levels 0 to w of its weight axis. The axis is divided
into intervals 0-1, 1-2, 2-4, 4-8 and so on, and on each runs a Poisson process whose rate is the
interval's length: points come in order of time, each with a level and a register, all drawn from the
shingle, the interval and the point's number only. A register keeps the earliest of all points at
levels below the weights; points of an interval that the weight cuts are thinned by their level. So
two documents agree in a register with a probability equal to their similarity, and as times rise, a
process stops once it is later than all registers.

Search. Registers are grouped in bands. In every bucket of documents that agree in a band, all are
verified against one, the leader, from whole texts: that with the most company in all its buckets,
since the text that others are copies of is nearer to each than they are to one another. Buckets
that are not connected by these links are compared pair by pair, in pairs of bounded blocks that
give links only. So no pair at or above the threshold that shares a band is left out of the groups,
and a large group of copies costs one comparison per copy.

Texts that are equal are one node from the start, also those without words, which are near no other
text. NULL text is empty. Repeated rows and NULL doc_id are allowed;
the class is the least doc_id of the group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetspc.llm.components import connected_components
from fleetspc.llm.frames import small, text_or_empty
from fleetspc.sources.workspace import materialize

WORDS = 5
SIMILAR = 0.8
BANDS = 24
ROWS = 5
# Members that are verified against a leader in one go.
MEMBERS = 64
# Keys of a bucket whose pairs are compared in one go.
BLOCK = 400

_GOLDEN = 0x9E3779B97F4A7C15


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


_BASE = 0x2545F4914F6CDD1D
_CHUNK = 1 << 16


class Powers:
    """Powers of an odd base modulo 2**64, and of its inverse, as long as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        while len(self.up) < n:
            size = len(self.up)
            self.up = np.concatenate((self.up, self.up * np.uint64(pow(_BASE, size, 1 << 64))))
            self.down = np.concatenate((self.down, self.down * np.uint64(pow(_inverse(_BASE), size, 1 << 64))))


def word_hashes(data: bytes, powers: Powers) -> np.ndarray:
    """A hash per word of a text in bytes, from sums of its bytes' values times powers of a base."""
    codes = np.frombuffer(data, np.uint8)
    blank = (codes == 32) | ((codes >= 9) & (codes <= 13))
    edge = np.diff(np.concatenate(([1], blank.view(np.int8), [1])))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return np.zeros(0, np.uint64)
    powers.reach(len(codes) + 1)
    values = mixed(codes.astype(np.uint64) + np.uint64(_GOLDEN)) * powers.up[: len(codes)]
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))
    return mixed((sums[end] - sums[start]) * powers.down[start] + (end - start).astype(np.uint64))


def bag(text: str, powers: Powers, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Different shingles, in order, and their counts."""
    found = word_hashes(text.lower().encode(), powers)
    if not len(found):
        return found, np.zeros(0, np.int64)
    size = min(words, len(found))
    shingle = np.zeros(len(found) - size + 1, np.uint64)
    for k in range(size):
        shingle = mixed(shingle * np.uint64(_GOLDEN | 1) + found[k : len(found) - size + 1 + k] + np.uint64(k))
    return np.unique(shingle, return_counts=True)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two bags; 0 if one is empty."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    both = np.minimum(a[1], np.where(b[0][at] == a[0], b[1][at], 0)).sum()
    return float(both) / float(a[1].sum() + b[1].sum() - both)


def _uniform(x: np.ndarray) -> np.ndarray:
    """Between 0 and 1, both exclusive."""
    return ((x >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], registers: int) -> np.ndarray:
    """One row of register values per bag, hashes of the earliest points; bags must not be empty.

    All processes of all bags take their next point at once; those that are past their bag's last
    register stop.
    """
    time = np.full((len(bags), registers), np.inf)
    value = np.zeros((len(bags), registers), np.uint64)
    owner, seed, rate, low, weight = [], [], [], [], []
    for k, (shingles, counts) in enumerate(bags):
        lower, length = 0, 1
        while True:
            inside = counts > lower
            if not inside.any():
                break
            n = int(inside.sum())
            owner.append(np.full(n, k))
            seed.append(mixed(shingles[inside] + np.uint64(lower * 0x632BE59BD9B4E019 % 2**64)))
            rate.append(np.full(n, float(length)))
            low.append(np.full(n, float(lower)))
            weight.append(counts[inside].astype(float))
            lower, length = lower + length, max(1, lower + length)
    owner, seed, rate, low, weight = (np.concatenate(x) for x in (owner, seed, rate, low, weight))
    at, number = np.zeros(len(owner)), 0
    while len(owner):
        number += 1
        drawn = mixed(seed + np.uint64(number * _GOLDEN % 2**64))
        at = at - np.log(_uniform(drawn)) / rate
        place = mixed(drawn + np.uint64(0xD1B54A32D192ED03))
        register = (place % np.uint64(registers)).astype(np.int64)
        level = low + rate * _uniform(mixed(place))
        counted = np.flatnonzero((level < weight) & (at < time[owner, register]))
        # The earliest of the points that meet in a register: latest first, so the last write wins.
        counted = counted[np.argsort(-at[counted], kind="stable")]
        row, column = owner[counted], register[counted]
        time[row, column] = at[counted]
        value[row, column] = drawn[counted]
        going = at < time.max(axis=1)[owner]
        owner, seed, rate, low, weight, at = (x[going] for x in (owner, seed, rate, low, weight, at))
    return value


def text_key(column: str = "text") -> Column:
    return F.unhex(F.md5(text_or_empty(column)))


def signed(docs: DataFrame, *, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, key, bands), stored: key is a digest of the text, bands are NULL without words."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers = Powers()
        for batch in batches:
            out: list[list[int] | None] = [None] * len(batch)
            for first in range(0, len(batch), 256):
                bags = [(i, bag(text, powers)) for i, text in enumerate(batch["text"].iloc[first : first + 256], first)]
                bags = [(i, b) for i, b in bags if len(b[0])]
                if bags:
                    values = signatures([b for _, b in bags], bands * rows).reshape(len(bags), bands, rows)
                    folded = np.zeros((len(bags), bands), np.uint64)
                    for k in range(rows):
                        folded = mixed(folded * np.uint64(_GOLDEN) + values[:, :, k])
                    for (i, _), row in zip(bags, folded.view(np.int64)):
                        out[i] = row
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "key": batch["key"], "bands": out})

    rows_in = docs.select(F.col("doc_id").cast("string"), text_key().alias("key"), text_or_empty().alias("text"))
    return materialize(rows_in.mapInPandas(sign, "doc_id long, key binary, bands array<long>"), "signatures", compression="zstd")


def verify(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """(leader, member, similar) of stored pairs of keys, from whole texts, stored.

    One text is taken for each key. A leader goes with its members in groups of bounded size.
    """
    groups = pairs.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("groups"))
    group_of = F.pmod(F.xxhash64("member"), F.col("groups")).cast("int")
    dealt = pairs.join(groups, "leader").withColumn("group", group_of)
    leading = groups.select("leader", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"))
    leading = leading.select(F.col("leader").alias("key"), "leader", "group", F.lit(True).alias("leads"))
    places = leading.unionByName(dealt.select(F.col("member").alias("key"), "leader", "group", F.lit(False).alias("leads")))
    carried = _texts_at(docs, nodes, places)

    def compare(keys: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        powers, leader = Powers(), keys[0]
        texts = rows["text"].where(rows["leads"]).dropna()
        head = bag(texts.iloc[0], powers)
        members = rows[~rows["leads"]].drop_duplicates("key")
        similar = [overlap(head, bag(text, powers)) for text in members["text"]]
        return pd.DataFrame({"leader": [leader] * len(members), "member": members["key"], "similar": similar})

    compared = carried.groupBy("leader", "group").applyInPandas(compare, "leader binary, member binary, similar double")
    return materialize(compared.where(F.col("similar") >= least), "near-compared", compression="zstd")


def _weighted_buckets(nodes: DataFrame) -> DataFrame:
    """(bucket, key, weight), stored: buckets with two keys or more.

    The weight of a key is the number of keys in all its buckets: that of which others are copies
    has the greatest, since it is nearer to each of them than they are to one another.
    """
    entries = nodes.where("bands is not null").select("key", F.posexplode("bands").alias("band", "value"))
    entries = entries.select(F.xxhash64("band", "value").alias("bucket"), "key")
    shared = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = materialize(entries.join(shared, "bucket"), "near-buckets", compression="zstd")
    weights = met.groupBy("key").agg(F.sum("n").alias("weight"))
    weighted = met.join(weights, "key").select("bucket", "key", "weight")
    return materialize(weighted, "near-weighted", compression="zstd")


def _texts_at(docs: DataFrame, nodes: DataFrame, places: DataFrame) -> DataFrame:
    """`places`, rows of a key and where it goes, with the key's text.

    One text is taken for each key that goes somewhere, by id and key, which are few bytes each. Places
    are rows, so those of a key that goes to very many groups are split as any uneven join is.
    """
    places = materialize(places, "near-places", compression="zstd")
    one = nodes.select(F.col("key").alias("_key"), F.col("doc_id").alias("_doc_id"))
    asked = places.select(F.col("key").alias("_key")).distinct().join(one, "_key")
    asked = materialize(asked, "near-asked", compression="zstd")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    here = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.unhex(F.md5("text")) == F.col("_key"))
    # Repeated rows of one id and text are one.
    found = texts.join(small(asked), here).select(F.col("_key").alias("key"), "text").dropDuplicates(["key"])
    return places.join(found, "key")


def block_links(docs: DataFrame, nodes: DataFrame, rows: DataFrame, similar: float, block: int = BLOCK) -> DataFrame:
    """(a, b), stored: links that connect all near keys of each bucket of `rows` (bucket, key).

    Every pair of a bucket is compared. A bucket is cut into blocks, and each pair of blocks is a
    group that holds at most about two blocks of texts; the common shingles of all its pairs come
    from one matrix product. Of buckets with the same keys one is taken.
    """
    member = F.xxhash64("key")
    sets = rows.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.sum(member.cast("decimal(38,0)")).alias("total"), F.bit_xor(member).alias("parity")
    )
    sets = sets.groupBy("n", "total", "parity").agg(F.min("bucket").alias("bucket"))
    cut = rows.select("bucket", "key").join(sets.select("bucket", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "bucket")
    cut = cut.withColumn("block", F.pmod(F.xxhash64("key", F.lit(1)), F.col("blocks")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    places = cut.select("key", "bucket", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    carried = _texts_at(docs, nodes, places)

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("key").sort_values("key", ignore_index=True)
        powers = Powers()
        held, sizes, owners = [], [], []
        for i, text in enumerate(rows["text"]):
            shingles, counts = bag(text, powers)
            # A shingle that stands n times is n different things: its first, second, ... time.
            times = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            held.append(mixed(np.repeat(shingles, counts) + times.astype(np.uint64) * np.uint64(_GOLDEN)))
            sizes.append(len(held[-1]))
            owners.append(np.full(len(held[-1]), i))
        things, owner, size = np.concatenate(held), np.concatenate(owners), np.array(sizes)
        _, number, often = np.unique(things, return_inverse=True, return_counts=True)
        shared = often[number] > 1
        columns, number = np.unique(number[shared], return_inverse=True)
        owner = owner[shared]
        common = np.zeros((len(rows), len(rows)), np.float32)
        order = np.argsort(number, kind="stable")
        number, owner = number[order], owner[order]
        for first in range(0, len(columns), 4096):
            low, high = np.searchsorted(number, [first, first + 4096])
            part = np.zeros((len(rows), min(4096, len(columns) - first)), np.float32)
            part[owner[low:high], number[low:high] - first] = 1
            common += part @ part.T
        near = np.triu(common >= similar * (size[:, None] + size[None, :] - common) - 1e-6, 1) & (common > 0)
        root = np.arange(len(rows))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for i, j in zip(*np.nonzero(near)):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
        roots = [find(i) for i in range(len(rows))]
        linked = [(rows["key"][r], rows["key"][i]) for i, r in enumerate(roots) if i != r]
        return pd.DataFrame(linked, columns=["a", "b"])

    compared = carried.groupBy("bucket", "low", "high").applyInPandas(compare, "a binary, b binary")
    return materialize(compared.distinct(), "near-linked", compression="zstd")


def near_groups(docs: DataFrame, nodes: DataFrame, similar: float = SIMILAR) -> DataFrame | None:
    """(node, root) of the groups of near copies; None if no band is shared."""
    rows = _weighted_buckets(nodes)
    if rows.isEmpty():
        return None
    leaders = rows.groupBy("bucket").agg(F.max(F.struct("weight", "key")).alias("c")).select("bucket", F.col("c.key").alias("leader"))
    pairs = rows.join(leaders, "bucket").where(F.col("key") != F.col("leader")).select("leader", F.col("key").alias("member"))
    pairs = materialize(pairs.distinct(), "near-pairs", compression="zstd")
    near = verify(docs, nodes, pairs, similar).select(F.col("leader").alias("a"), F.col("member").alias("b"))
    roots = connected_components(near)
    # Buckets whose keys are all connected by now have nothing left to find.
    rooted = rows.select("bucket", "key").join(roots, rows["key"] == roots["node"], "left")
    rooted = materialize(rooted.select("bucket", "key", F.coalesce("root", "key").alias("root")), "near-rooted", compression="zstd")
    open_buckets = rooted.groupBy("bucket").agg(F.min("root").alias("_a"), F.max("root").alias("_b")).where("_a < _b").select("bucket")
    rest = materialize(rooted.join(open_buckets, "bucket").select("bucket", "key"), "near-rest", compression="zstd")
    if rest.isEmpty():
        return roots
    more = block_links(docs, nodes, rest, similar)
    return connected_components(more.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))


def near_copies(docs: DataFrame, *, similar: float = SIMILAR) -> DataFrame:
    """(doc_id, key, class_id, kept), one row per document, stored.

    class_id is the least doc_id of the group, and kept says that this is it.
    """
    signs = signed(docs)
    nodes = signs.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.any_value("bands").alias("bands"))
    nodes = materialize(nodes, "near-nodes", compression="zstd")
    roots = near_groups(docs, nodes, similar)
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    if roots is None:
        least = nodes.select("key", own.alias("least"))
    else:
        rooted = nodes.select("key", "doc_id").join(roots, nodes["key"] == roots["node"], "left")
        rooted = rooted.select("key", "doc_id", F.coalesce("root", "key").alias("root"))
        classes = rooted.groupBy("root").agg(F.min(own).alias("least"))
        least = rooted.join(classes, "root").select("key", "least")
    least = materialize(least, "near-classes", compression="zstd")
    kept = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("key") == F.col("least.key"))
    return signs.select("doc_id", "key").join(least, "key").select(
        "doc_id", "key", F.col("least.doc_id").alias("class_id"), kept.alias("kept")
    )


def drop_near_copies(docs: DataFrame, *, similar: float = SIMILAR) -> DataFrame:
    """`docs` with one document of each group, the one of the least doc_id; repeated rows count once."""
    kept = near_copies(docs, similar=similar).where("kept")
    kept = kept.groupBy(F.col("doc_id").alias("_doc_id"), F.col("key").alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
    kept = materialize(kept, "near-kept", compression="zstd")
    here = F.col("doc_id").cast("long").eqNullSafe(F.col("_doc_id")) & (text_key() == F.col("_key"))
    marked = docs.join(small(kept), here)
    if kept.where("_n > 1").isEmpty():
        return marked.select(*docs.columns)
    repeated = marked.where("_n > 1").dropDuplicates(["doc_id", "text"])
    return marked.where("_n = 1").unionByName(repeated).select(*docs.columns)
