"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

How often a document is expected in the mix depends on its length: its weight is the number of
binary digits of its size, so a document of 1,000 words weighs 10 and one of 50 words 6. Expected
copies are level * weight, at most `most`, with one level per source that makes the expected words
of the source its target. The whole part of that is certain; what is left over is the chance of one
copy more. For these unequal chances the documents of a source are ranked by
(u / (1 - u)) / (chance / (1 - chance)), u being a random number that depends on the document and
the seed only, and the first are taken until the source has its words: the sample's size is fixed in
words, up to half of the document at the cut.

The level needs the words per source and weight only, some sixty rows a source at most. The cut of
a source is found without sorting it: ranks are counted in fine ranges, and only the range in which
the cut falls is summed up by rank. What is left to know is one row per source and weight, so
documents are then told taken or not one by one, wherever they are.

A NULL source is a source. NULL text has size 0; documents of size 0 are never sampled, but get
their certain copies. Rows of one doc_id and text share their random number; where a source's
cut falls among such rows, as many of them are taken as bring it nearest to its target, and which
ones is open, as they are equal. NULL doc_id is as if empty. Columns with the names that are
added are replaced, all others pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetspc.llm.frames import small
from fleetspc.sources.workspace import materialize

SHARE = 1.5
MOST_COPIES = 2
WEIGHTS = (3, 1, 2)
SEED = "mix-1"
ROWS_PER_RANGE = 2_000

ADDED = ["size", "source_size", "target", "copies", "taken"]


def word_count(column: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(column), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def random_number(seed: str = SEED) -> Column:
    """Between 0 and 1 exclusive, from 52 bits of a digest of the document's id, its text and the seed."""
    named = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(seed), F.coalesce("text", F.lit("")))
    digits = F.substring(F.md5(named), 1, 13)
    return (F.conv(digits, 16, 10).cast("long").cast("double") + 0.5) / F.lit(float(2**52))


def length_weight(size: Column) -> Column:
    """Binary digits of a size, 1 for none."""
    return F.length(F.bin(size)).cast("long")


def source_targets(classes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """(source, n_docs, source_size, target) from (source, n_docs, words): one row per source, in order of code points.

    Targets are in proportion to the weights and add up to `share` of all sizes. A target stops at
    `most` times the size of its source; what is over goes to the others by weight, until none is
    above. In the order of size over weight the ones that stop come first, so one pass finds them.
    """
    sources = classes.groupBy("source").agg(F.sum("n_docs").alias("n_docs"), F.sum("words").alias("source_size"))
    sources = materialize(sources, "mix-sources")
    everything = Window.partitionBy()
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(place, F.lit(len(weights))) + 1)
    ranked = sources.withColumn("weight", weight).withColumn("limit", most * F.col("source_size").cast("double"))
    by_ratio = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    # Words and weights left for a source and all that come after it.
    words = F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    others = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    ranked = ranked.withColumns({"_words": words, "_weights": others})
    stops = F.col("limit") * F.col("_weights") <= F.col("weight") * F.col("_words")
    ranked = ranked.withColumn("_stops", stops)
    # The first source that does not stop sets the level for all that do not.
    first = F.min(F.when(~F.col("_stops"), F.struct(F.col("limit") / F.col("weight"), F.col("source").isNull(), "source", "_words", "_weights"))).over(everything)
    shared = F.col("weight") * first["_words"] / first["_weights"]
    target = F.when(F.col("_stops"), F.col("limit")).otherwise(shared)
    return ranked.select("source", "n_docs", "source_size", target.alias("target"))


def expected_copies(classes: DataFrame, targets: DataFrame, most: int = MOST_COPIES) -> DataFrame:
    """`classes` (source, weight, words) with their source's target, and the expected copies of their documents.

    In the order of falling weight the classes that stop at `most` come first. What they leave of the
    target is shared by the others in proportion to weight times words.
    """
    same_source = classes["source"].eqNullSafe(F.col("_source"))
    known = targets.withColumnRenamed("source", "_source").drop("n_docs")
    rows = classes.join(known, same_source).drop("_source")
    falling = Window.partitionBy("source").orderBy(F.desc("weight"))
    rest = falling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = F.coalesce(F.sum("words").over(falling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumns({"_left": F.col("target") - most * before, "_shares": F.sum(F.col("weight") * F.col("words")).over(rest)})
    level = F.col("_left") / F.nullif("_shares", F.lit(0))
    rows = rows.withColumn("_level", F.when(level * F.col("weight") < most, level))
    # The first class that does not stop sets the level for all after it; without words none is needed.
    first = F.first("_level", ignorenulls=True).over(falling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    copies = F.least(F.lit(float(most)), F.coalesce(first, F.lit(float(most))) * F.col("weight"))
    copies = F.when(F.col("source_size") > 0, copies).otherwise(F.lit(0.0))
    return rows.withColumn("expected", copies).drop("_left", "_shares", "_level")


def _rank(u: Column, chance: Column) -> Column:
    return (u / (1 - u)) / (chance / (1 - chance))


def _range(rank: Column, ranges: Column) -> Column:
    return F.floor(rank / (1 + rank) * ranges)


def source_cuts(docs: DataFrame, *, seed: str = SEED, rows_per_range: int = ROWS_PER_RANGE, most: int = MOST_COPIES, **options) -> DataFrame:
    """One row per source and weight, stored: target, certain copies, chance, and where the source is cut.

    The cut is the last group of rows of equal (rank, size) of which some are taken: how many the
    group has, `tied`, and how many of them are taken, `dealt`.
    """
    sizes = docs.select("source", word_count().alias("size"), random_number(seed).alias("u"))
    sizes = materialize(sizes, "mix-sizes", compression="zstd").withColumn("weight", length_weight(F.col("size")))
    classes = sizes.groupBy("source", "weight").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("words"))
    classes = materialize(classes, "mix-classes")
    targets = materialize(source_targets(classes, most=most, **options), "mix-targets")
    certain = F.floor("expected").cast("long")
    plan = expected_copies(classes, targets, most).withColumns({"certain": certain, "chance": F.col("expected") - certain})
    whole = Window.partitionBy("source")
    plan = plan.withColumns(
        {
            "wanted": F.col("target") - F.sum(F.col("certain") * F.col("words")).over(whole),
            "ranges": F.ceil(F.sum("n_docs").over(whole) / rows_per_range),
        }
    )
    plan = materialize(plan.select("source", "weight", "source_size", "target", "certain", "chance", "wanted", "ranges"), "mix-plan")
    known = small(plan.where("chance > 0").select(F.col("source").alias("_source"), F.col("weight").alias("_weight"), "chance", "wanted", "ranges"))
    here = sizes["source"].eqNullSafe(F.col("_source")) & (sizes["weight"] == F.col("_weight"))
    ranked = sizes.where("size > 0").join(known, here).withColumn("rank", _rank(F.col("u"), F.col("chance")))
    ranked = ranked.select("source", "size", "rank", "wanted", _range(F.col("rank"), F.col("ranges")).alias("range"))
    sums = ranked.groupBy("source", "range").agg(F.sum("size").alias("words"), F.any_value("wanted").alias("wanted"))
    along = Window.partitionBy("source").orderBy("range")
    sums = sums.withColumn("before", F.sum("words").over(along) - F.col("words"))
    cut = sums.where((F.col("before") <= F.col("wanted")) & (F.col("before") + F.col("words") > F.col("wanted")))
    cut = materialize(cut.select(F.col("source").alias("_source"), F.col("range").alias("_range"), "before"), "mix-ranges")
    here = ranked["source"].eqNullSafe(F.col("_source")) & (F.col("range") == F.col("_range"))
    # Equal rows are one group however many they are.
    groups = ranked.join(small(cut), here).groupBy("source", "range", "rank", "size").agg(
        F.count(F.lit(1)).alias("tied"), F.any_value("wanted").alias("wanted"), F.any_value("before").alias("before")
    )
    inside = Window.partitionBy("source").orderBy("rank", "size")
    words = F.col("tied") * F.col("size")
    room = F.col("wanted") - (F.col("before") + F.sum(words).over(inside) - words)
    dealt = F.least(F.col("tied"), F.floor(room / F.col("size") + 0.5))
    groups = groups.withColumn("dealt", dealt).where("dealt > 0")
    last = groups.groupBy(F.col("source").alias("_source"), F.col("range").alias("cut_range")).agg(
        F.max(F.struct("rank", "size", "tied", "dealt")).alias("last")
    )
    # A cut range of which nothing is taken is known by its number alone.
    cuts = cut.select(F.col("_source").alias("_in"), F.col("_range").alias("cut_range")).join(
        last.select("_source", "last"), F.col("_in").eqNullSafe(F.col("_source")), "left"
    )
    cuts = cuts.select(F.col("_in").alias("_source"), F.struct("cut_range", "last").alias("cut"))
    # Without a cut range the whole source is not enough: all documents with a chance are taken.
    plan = plan.join(cuts, plan["source"].eqNullSafe(F.col("_source")), "left").drop("_source", "wanted")
    return materialize(plan, "mix-cuts")


def _numbered(rows: DataFrame, by: str) -> DataFrame:
    """Rows with their number among those of equal `by`, `_number` from 1, in no stated order.

    Rows are stored and counted by the tasks that stored them, so no task sees all rows of a group.
    """
    stored = materialize(rows.withColumn("_id", F.monotonically_increasing_id()), "mix-equal-rows", compression="zstd")
    stored = stored.withColumn("_part", F.shiftrightunsigned("_id", 33))
    parts = stored.groupBy(by, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col(by).alias("_by"), F.col("_part").alias("_task"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    parts = materialize(parts, "mix-equal-counts")
    here = stored[by].eqNullSafe(F.col("_by")) & (F.col("_part") == F.col("_task"))
    number = F.row_number().over(Window.partitionBy(by, "_part").orderBy("_id")) + F.col("_before")
    return stored.join(small(parts), here).withColumn("_number", number).drop("_id", "_part", "_by", "_task", "_before")


def mix(docs: DataFrame, *, seed: str = SEED, rows_per_range: int = ROWS_PER_RANGE, **options) -> DataFrame:
    """`docs` with size, source_size, target, copies, and taken, the words that the mix takes of it.

    `options` are those of source_targets: weights, repeated over the sources, the share of all
    sizes, and the most copies.
    """
    cuts = source_cuts(docs, seed=seed, rows_per_range=rows_per_range, **options)
    kept = [c for c in docs.columns if c not in ADDED]
    plan = small(cuts.withColumnsRenamed({"source": "_source", "weight": "_weight"}))
    rows = docs.select(*kept, word_count().alias("size"), random_number(seed).alias("_u"))
    here = F.col("source").eqNullSafe(F.col("_source")) & (length_weight(F.col("size")) == F.col("_weight"))
    rows = rows.join(plan, here, "left").drop("_source", "_weight")
    rank = F.when((F.col("chance") > 0) & (F.col("size") > 0), _rank(F.col("_u"), F.col("chance")))
    rows = rows.withColumn("_rank", rank)
    range_of, cut_range, last = _range(F.col("_rank"), F.col("ranges")), F.col("cut.cut_range"), F.col("cut.last")
    at_cut = (range_of == cut_range) & (F.col("_rank") == last["rank"]) & (F.col("size") == last["size"])
    at_cut = F.coalesce(at_cut, F.lit(False))
    within = F.struct(F.col("_rank").alias("rank"), F.col("size").alias("size")) <= F.struct(last["rank"].alias("rank"), last["size"].alias("size"))
    drawn = cut_range.isNull() | (range_of < cut_range) | ((range_of == cut_range) & last.isNotNull() & within)
    drawn = F.coalesce(F.col("_rank").isNotNull() & drawn, F.lit(False))
    split = F.col("cut.last.dealt") < F.col("cut.last.tied")
    if cuts.where(split).isEmpty():
        rows = rows.withColumn("_drawn", drawn)
    else:
        # Some of a group of equal rows are taken: those rows are numbered.
        apart = at_cut & F.coalesce(last["dealt"] < last["tied"], F.lit(False))
        numbered = _numbered(rows.where(apart), "source").withColumn("_drawn", F.col("_number") <= F.col("cut.last.dealt"))
        rows = rows.where(~apart).withColumn("_drawn", drawn).unionByName(numbered.drop("_number"))
    rows = rows.withColumn("copies", F.col("certain") + F.col("_drawn").cast("int"))
    return rows.withColumn("taken", F.col("copies") * F.col("size")).select(*kept, *ADDED)
