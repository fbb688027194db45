"""How far sources of a language differ in the words they use, source by source and word by word.

Words are runs of letters A to Z in either case and of characters beyond ASCII; only A to Z are
lower-cased. A language keeps the terms that stand in at least `min_docs` of its documents. A
source gives a term the share p = 1 + floor(SCALE * (count + SMOOTH) / (N + SMOOTH * V)), N being
its occurrences of kept terms and V their number; the language as a whole gives q likewise. Two
sources are as far apart as the sum of |p - q| over all kept terms.

Rows of a sparse matrix times its transpose, in Gustavson's order. The counts are turned into an
index with one row per term that lists its sources. Terms are dealt to blocks, and in a block each
source walks through its own terms, follows every term's row, and adds to one dense accumulator
with a cell per peer; pairs of postings are never emitted, one number per peer is. A source
without the term still gives it the share of a count of 0, so the accumulator starts from those
baselines in closed form, and a posting that both sources have corrects what the baselines said.
Blocks hold POSTINGS_PER_BLOCK postings on average, however many terms or sources there are, and
their sums are added up by a partially aggregated sum. All numbers are integers.

NULL text, lang and source count as ''. A source without kept terms has its groups and pairs like
any other. Repeated rows are documents of their own. An empty table gives no rows. Other columns
are ignored.
"""

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetspc.llm.frames import text_or_empty
from fleetspc.sources.workspace import materialize

MIN_DOCS = 30
TOP_TERMS = 50
SMOOTH = 5
SCALE = 1_000_000_000

# Bounds of what a task holds: counted terms, bytes of text counted since they were sent, bytes
# of a text that are split at once, postings of a block, and steps of an accumulator at once.
TERMS_HELD = 400_000
BYTES_HELD = 128 << 20
SLICE = 1 << 20
POSTINGS_PER_BLOCK = 1_000_000
STEPS = 4_000_000

# Stands for "no term": a group that occurs.
NO_TERM = ""

_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def letter_bytes() -> bytes:
    """UTF-8 bytes of words in lower case; all other bytes become blanks."""
    table = bytearray(b" " * 65 + bytes(range(65, 91)).lower() + b" " * 6 + bytes(range(97, 123)) + b" " * 5)
    return bytes(table) + bytes(range(128, 256))


def slices(text: bytes, size: int = SLICE) -> Iterator[bytes]:
    """A text of words and blanks in pieces of about `size` bytes, none ending inside a word."""
    start = 0
    while len(text) - start > size:
        end = text.find(b" ", start + size)
        if end < 0:
            break
        yield text[start:end]
        start = end
    yield text[start:] if start else text


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents; term '' for every group that occurs.

    Each task adds up its own documents and sends its sums when they grow large.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = letter_bytes()
        groups: dict[tuple, tuple[Counter, Counter]] = {}
        held = taken = 0

        def sums() -> Iterator[pa.RecordBatch]:
            for (lang, source), (occurrences, documents) in groups.items():
                terms = pa.array(list(occurrences), pa.binary()).cast(pa.string())
                size = len(terms)
                columns = [
                    pa.repeat(pa.scalar(lang, pa.string()), size), pa.repeat(pa.scalar(source, pa.string()), size), terms,
                    pa.array(list(occurrences.values()), pa.int64()),
                    pa.array([documents[t] for t in occurrences], pa.int64()),
                ]
                yield from pa.table(columns, schema=_COUNTS).to_batches(max_chunksize=50_000)

        for batch in batches:
            langs, sources = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
            texts = batch.column("text").cast(pa.binary())
            for lang, source, text in zip(langs, sources, texts):
                group = groups.get((lang, source))
                if group is None:
                    group = groups[(lang, source)] = (Counter({b"": 0}), Counter())
                occurrences, documents = group
                before = len(occurrences)
                text = text.as_py().translate(table)
                if len(text) <= SLICE:
                    words = text.split()
                    occurrences.update(words)
                    documents.update(set(words))
                else:
                    seen: set[bytes] = set()
                    for piece in slices(text):
                        words = piece.split()
                        occurrences.update(words)
                        seen.update(words)
                    documents.update(seen)
                held += len(occurrences) - before
                taken += len(text)
                if held > TERMS_HELD or taken > BYTES_HELD:
                    yield from sums()
                    groups, held, taken = {}, 0, 0
        yield from sums()

    rows = docs.select(*[text_or_empty(c).alias(c) for c in ("lang", "source", "text")])
    counted = rows.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + SMOOTH) / (total + SMOOTH * terms)), exact for counts of 64 bits."""
    # By operators a product of decimals may lose digits; 30 digits hold SCALE times any count.
    wide = (count.cast("decimal(20,0)") + F.lit(SMOOTH).cast("decimal(1,0)")).cast("decimal(21,0)") * F.lit(SCALE).cast("decimal(10,0)")
    divisor = total.cast("decimal(20,0)") + terms.cast("decimal(18,0)") * F.lit(SMOOTH).cast("decimal(1,0)")
    remainder = wide % divisor
    return ((wide - remainder) / divisor).cast("long") + 1


def _group_key(lang: str, source: str) -> Column:
    return F.concat(F.length(lang).cast("string"), F.lit(":"), F.col(lang), F.col(source))


def shares(docs: DataFrame, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """Stored tables: postings (lang, source, term_id, term, p, base, q) and groups (lang, source, terms, base).

    `base` is the share of a term that the source lacks, NULL for a language without kept terms.
    """
    counts = materialize(term_counts(docs), "term-counts", compression="zstd")
    # One row per term with the sources that use it: no more of them than the language has.
    index = (
        counts.where(F.col("term") != NO_TERM)
        .groupBy("lang", "term")
        .agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"), F.collect_list(F.struct("source", "n")).alias("postings"))
        .where(F.col("docs") >= min_docs)
        .select(F.monotonically_increasing_id().alias("term_id"), "lang", "term", "lang_n", "postings")
    )
    index = materialize(index, "term-index", compression="zstd")
    kept = index.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total"))
    postings = index.select("term_id", "lang", "term", "lang_n", F.inline("postings"))
    totals = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = (
        counts.where(F.col("term") == NO_TERM).select("lang", "source")
        .join(totals, ["lang", "source"], "left")
        .join(kept, "lang", "left")
        .select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("terms", F.lit(0)).alias("terms"), "lang_total")
        .withColumn("base", F.when(F.col("terms") > 0, _share(F.lit(0), F.col("total"), F.col("terms"))))
    )
    groups = materialize(groups, "term-groups")
    scored = postings.join(groups, ["lang", "source"]).select(
        "lang", "source", "term_id", "term", "base",
        _share(F.col("n"), F.col("total"), F.col("terms")).alias("p"),
        _share(F.col("lang_n"), F.col("lang_total"), F.col("terms")).alias("q"),
    )
    return materialize(scored, "term-shares", compression="zstd"), groups


def block_distances(peers: list[str], bases: np.ndarray, source: np.ndarray, term: np.ndarray, p: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Per source its distances to all peers over one block of terms, as far as its own postings tell.

    The distance of two sources is the sum of both rows' cells for each other plus, once, the
    baselines' distance for every term of the block. A row's cell holds, for the row's own
    postings, |p - base of the peer| - |base - base of the peer|; the row that comes first in the
    list of peers also holds the corrections of the terms that both have.
    """
    by_term = np.argsort(term, kind="stable")
    ids, starts, lengths = np.unique(term[by_term], return_index=True, return_counts=True)
    index_source, index_p = source[by_term], p[by_term]
    by_source = np.argsort(source, kind="stable")
    bounds = np.searchsorted(source[by_source], np.arange(len(peers) + 1))
    for row in range(len(peers)):
        own = by_source[bounds[row] : bounds[row + 1]]
        base, cells = bases[row], np.zeros(len(peers), np.int64)
        if len(own):
            shares_up = np.sort(p[own])
            below = np.searchsorted(shares_up, bases)
            sums = np.concatenate(([0], np.cumsum(shares_up)))
            cells += bases * (2 * below - len(own)) + sums[-1] - 2 * sums[below]
            cells -= len(own) * np.abs(base - bases)
            at = np.searchsorted(ids, term[own])
            steps = np.concatenate(([0], np.cumsum(lengths[at])))
            first = 0
            while first < len(own):
                last = max(first + 1, int(np.searchsorted(steps, steps[first] + STEPS, "right")) - 1)
                counts = lengths[at[first:last]]
                place = np.repeat(starts[at[first:last]] - (steps[first:last] - steps[first]), counts) + np.arange(counts.sum())
                mine = np.repeat(p[own[first:last]], counts)
                other, theirs = index_source[place], index_p[place]
                after = other > row
                mine, other, theirs = mine[after], other[after], theirs[after]
                both = np.abs(mine - theirs) - np.abs(mine - bases[other]) - np.abs(theirs - base) + np.abs(base - bases[other])
                np.add.at(cells, other, both)
                first = last
        yield row, cells


def source_distances(postings: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, other, distance) for every ordered pair of sources of a language."""
    # The number of blocks follows from the number of postings alone.
    blocks = 1 + postings.count() // POSTINGS_PER_BLOCK
    numbered = postings.select(
        "lang", F.pmod(F.xxhash64("term_id"), F.lit(blocks)).alias("block"), "source", "term_id", "p", F.col("base"),
    )
    peers = groups.select(
        "lang", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1))).alias("block"), "source",
        F.lit(None).cast("long").alias("term_id"), F.lit(None).cast("long").alias("p"), F.coalesce("base", F.lit(0)).alias("base"),
    )

    def accumulate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        rows = pd.concat(parts, ignore_index=True)
        is_peer = rows["term_id"].isna().to_numpy()
        listed, held = rows[is_peer].sort_values("source"), rows[~is_peer]
        names = listed["source"].tolist()
        if len(names) < 2:
            return
        place = {name: i for i, name in enumerate(names)}
        bases = listed["base"].to_numpy(np.int64)
        lang = rows["lang"].iloc[0]
        source = held["source"].map(place).to_numpy(np.int64)
        for row, cells in block_distances(names, bases, source, held["term_id"].to_numpy(np.int64), held["p"].to_numpy(np.int64)):
            one = np.arange(len(names)) != row
            yield pd.DataFrame({
                "lang": lang,
                "source": [names[min(row, i)] for i in np.flatnonzero(one)],
                "other": [names[max(row, i)] for i in np.flatnonzero(one)],
                "cells": cells[one],
            })

    cells = (
        numbered.unionByName(peers)
        .groupBy("lang", "block")
        .applyInPandas(accumulate, "lang string, source string, other string, cells long")
        .groupBy("lang", "source", "other")
        .agg(F.sum("cells").alias("cells"))
    )
    side = groups.select("lang", "source", "base", "terms")
    apart = (
        cells.join(side, ["lang", "source"])
        .join(side.select("lang", F.col("source").alias("other"), F.col("base").alias("other_base")), ["lang", "other"])
        .withColumn("distance", F.when(F.col("terms") > 0, F.col("cells") + F.col("terms") * F.abs(F.col("base") - F.col("other_base"))).otherwise(F.lit(0)).cast("long"))
    )
    ways = F.array(
        F.struct(F.col("source").alias("source"), F.col("other").alias("other")),
        F.struct(F.col("other").alias("source"), F.col("source").alias("other")),
    )
    return apart.select("lang", F.inline(ways), "distance")


def audit(docs: DataFrame, *, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): all other sources, and the terms a source favours.

    Part `pair` ranks the other sources of the language by distance. Part `term` ranks the terms
    to which the source gives more than the language does, to rank `top`; the ranking keeps `top`
    rows per task and group before it moves any. Equal values go by the item's bytes.
    """
    postings, groups = shares(docs, min_docs)
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = source_distances(postings, groups).select(
        "lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), F.col("distance").alias("value")
    )
    terms = postings.where(F.col("p") > F.col("q")).select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value")
    )
    ranked = F.row_number().over(order).cast("int")
    return pairs.withColumn("rank", ranked).unionByName(terms.withColumn("rank", ranked).where(F.col("rank") <= top))
