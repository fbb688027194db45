"""Line deduplication by an edit join on segments, in DataFrame operations only.

A line is dropped when the same line stands earlier in the corpus, or a near one does. Lines are
near within `max_edits` insertions, deletions and substitutions of code points, and at most one for
every `chars_per_edit` characters of the shorter: "Step 1" and "Step 2" are different lines.
Earlier means smaller (doc_id, hash of the text, line number); NULL ids come first. Equal lines are
found at any length. Lines of white space only hold nothing to repeat and stay where they are.

Two lines within k edits share one of k + 1 segments of the shorter one, at a place that the
difference of their lengths bounds. So the k + 1 segments of every distinct line, k being what its
length allows, are indexed under (length, segment number, segment), each line looks up the few
substrings at those places, and what meets is verified by a banded bit-parallel edit distance.

NULL text is empty. Rows with the same doc_id and text count as one document and get the same
result. Columns other than doc_id and text are not looked at and pass through.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetspc.llm.frames import same, small, text_or_empty
from fleetspc.sources.workspace import materialize

MAX_EDITS = 2
CHARS_PER_EDIT = 16

# Letters whose numbers are compared before two lines are: one edit changes at most two of these
# numbers, by one each. Any letters are right; frequent ones tell more lines apart.
COUNTED = "etaoinsrhldcumfpg"

ORDER = "struct<doc_id:bigint,text_key:bigint,line_no:int>"

INKED = r"[^\x20\x09-\x0D]"


def document_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, line_no, line, line_key) of every line that is not white space."""
    text = text_or_empty()
    lines = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(text).alias("text_key"),
        F.posexplode(F.split(text, "\n")).alias("line_no", "line"),
    )
    return lines.where(F.col("line").rlike(INKED)).withColumn("line_key", F.unhex(F.md5("line")))


def distinct_lines(lines: DataFrame) -> DataFrame:
    """One row per different line: its text, first place, number of copies, and a 63-bit id.

    The id leads to lines; should two lines share one, both are looked at.
    """
    place = F.struct("doc_id", "text_key", "line_no").cast(ORDER)
    found = lines.groupBy("line_key").agg(
        F.min(place).alias("first"), F.count(F.lit(1)).alias("copies"), F.any_value("line").alias("line")
    )
    return found.withColumn("id", F.xxhash64("line_key").bitwiseAND(F.lit(-2)))


def allowed_edits(length: Column, max_edits: int, chars_per_edit: int) -> Column:
    """Edits within which a line of this length, the shorter of two, is near the other."""
    return F.least(F.lit(max_edits), F.floor(length / chars_per_edit)).cast("int")


def segment_keys(lines: DataFrame, max_edits: int, chars_per_edit: int) -> DataFrame:
    """(bucket, entry) rows: a line's own segments and the substrings it looks up.

    Segment number i of a line of length l starts at p. A line longer by d, in which it may stand
    unchanged, has it at p + s, where the edits to its left and right bound s: at most i and at
    most edits - i from either end. The lowest bit of an entry marks an own segment. A line looks
    for shorter ones under the edits that their lengths allow.
    """
    n = F.length("line")

    def keys(d: int, edits: int) -> list[Column]:
        length, parts, found = n - d, edits + 1, []
        base = F.floor(length / parts).cast("int")
        short = F.lit(parts) - F.pmod(length, F.lit(parts))
        for i in range(parts):
            start = base * i + F.greatest(F.lit(i) - short, F.lit(0))
            size = base + F.when(F.lit(i) >= short, 1).otherwise(0)
            for s in range(max(-i, d - (edits - i)), min(i, d + edits - i) + 1):
                piece = F.substring("line", start + s + 1, size)
                own = 1 if d == 0 and s == 0 else 0
                found.append(
                    F.struct(
                        F.xxhash64(length, F.lit(i), piece).alias("bucket"),
                        F.col("id").bitwiseOR(F.lit(own)).alias("entry"),
                    )
                )
        return found

    none = F.array().cast("array<struct<bucket:bigint,entry:bigint>>")

    def keys_by_length(d: int) -> Column:
        edits = allowed_edits(n - d, max_edits, chars_per_edit)
        chosen = none
        for e in range(max(d, 1), max_edits + 1):
            chosen = F.when(edits == e, F.array(*keys(d, e))).otherwise(chosen)
        return chosen

    # Most lines allow for all edits, whatever they are compared with, and need no choice.
    whole = F.array(*[key for d in range(max_edits + 1) for key in keys(d, max_edits)])
    chosen = F.concat(*[keys_by_length(d) for d in range(max_edits + 1)])
    return lines.select(F.inline(F.when(n >= max_edits * (chars_per_edit + 1), whole).otherwise(chosen)))


def _through(value: Column, *steps) -> Column:
    """Apply functions of a column one after the other, each to a value computed once."""
    for step in steps:
        value = F.element_at(F.transform(F.array(value), step), 1)
    return value


def _common_prefix(a: Column, b: Column, most: Column) -> Column:
    """Length of the common prefix, at most `most`: doubling steps from large to small."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(30))])

    def further(length: Column, step: Column) -> Column:
        fits = length <= most - step
        equal = F.substring(a, length + 1, step) == F.substring(b, length + 1, step)
        return F.when(fits & equal, length + step).otherwise(length)

    return F.aggregate(steps, F.lit(0), further)


def _banded_distance(a: Column, b: Column, max_edits: int) -> Column:
    """Edit distance of two arrays of characters if it is at most max_edits, else a larger number.

    Bit k of the vectors is row j - max_edits + k of column j of the distance table, so the band of
    2 * max_edits + 1 rows moves down with the columns. `vp` and `vn` hold where the distance grows
    and falls from a row to the next. The distance is followed along the diagonal that ends in the
    corner: it grows by one wherever a cell differs from the cell up left of it.
    """
    if not 0 <= max_edits <= 30:
        raise ValueError("max_edits must be between 0 and 30")
    width = 2 * max_edits + 1
    mask = F.lit((1 << width) - 1).cast("long")
    shift = F.size(a) - F.size(b)
    corner = reduce(
        lambda c, k: c.when(shift == k - max_edits, F.lit(1 << k).cast("long")),
        range(1, width),
        F.when(shift == -max_edits, F.lit(1).cast("long")),
    )

    def column(state: Column, j: Column) -> Column:
        letter = F.get(b, j - 1)
        hits = reduce(
            add,
            [
                F.when(F.get(a, j + (k - max_edits - 1)) == letter, F.lit(1 << k).cast("long")).otherwise(
                    F.lit(0).cast("long")
                )
                for k in range(width)
            ],
        )
        return F.struct(state["vp"].alias("vp"), state["vn"].alias("vn"), state["d"].alias("d"), hits.alias("hits"), j.alias("j"))

    def diagonal(s: Column) -> Column:
        vp, vn, hits = s["vp"], s["vn"], s["hits"]
        carried = (hits.bitwiseAND(vp) + vp).bitwiseXOR(vp)
        same_up_left = carried.bitwiseOR(hits).bitwiseOR(vn).bitwiseAND(mask)
        return F.struct(vp.alias("vp"), s["d"].alias("d"), s["j"].alias("j"), same_up_left.alias("d0"), vn.alias("vn"))

    def horizontal(s: Column) -> Column:
        d0, vp, vn = s["d0"], s["vp"], s["vn"]
        grows = vn.bitwiseOR(F.bitwise_not(d0.bitwiseOR(vp)).bitwiseAND(mask))
        steps = (d0.bitwiseAND(corner) == 0) & (s["j"] + shift >= 1)
        d = s["d"] + F.when(steps, 1).otherwise(0)
        return F.struct(d.alias("d"), F.shiftright(d0, 1).alias("next"), grows.alias("hp"), d0.bitwiseAND(vp).alias("hn"))

    def vertical(s: Column) -> Column:
        grows = s["hn"].bitwiseOR(F.bitwise_not(s["next"].bitwiseOR(s["hp"])).bitwiseAND(mask))
        return F.struct(grows.alias("vp"), s["next"].bitwiseAND(s["hp"]).alias("vn"), s["d"].alias("d"))

    below = F.lit(((1 << (max_edits + 1)) - 1) << max_edits).cast("long")
    start = F.struct(below.alias("vp"), F.lit(0).cast("long").alias("vn"), F.abs(shift).cast("int").alias("d"))
    columns = F.when(F.size(b) > 0, F.sequence(F.lit(1), F.size(b))).otherwise(F.array().cast("array<int>"))
    walked = F.aggregate(
        columns, start, lambda s, j: _through(column(s, j), diagonal, horizontal, vertical)
    )["d"]
    return F.when(F.abs(shift) > max_edits, F.lit(max_edits + 1)).otherwise(walked)


def edit_distance(a: str, b: str, max_edits: int) -> Column:
    """Edit distance of two text columns if it is at most max_edits, else a larger number.

    What the texts have in common at either end is cut off first, so the table is only as long as
    the part between their first and last difference.
    """

    def heads(s: Column) -> Column:
        most = F.least(F.length(s["a"]), F.length(s["b"]))
        return F.struct(s["a"].alias("a"), s["b"].alias("b"), most.alias("most"), _common_prefix(s["a"], s["b"], most).alias("head"))

    def tails(s: Column) -> Column:
        tail = _common_prefix(F.reverse(s["a"]), F.reverse(s["b"]), s["most"] - s["head"])
        return F.struct(s["a"].alias("a"), s["b"].alias("b"), s["head"].alias("head"), tail.alias("tail"))

    def middles(s: Column) -> Column:
        def letters(c: str) -> Column:
            inner = F.substring(s[c], s["head"] + 1, F.length(s[c]) - s["head"] - s["tail"])
            return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, "")).alias(c)

        return F.struct(letters("a"), letters("b"))

    pair = F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    return _through(pair, heads, tails, middles, lambda s: _banded_distance(s["a"], s["b"], max_edits))


def line_links(distinct: DataFrame, max_edits: int = MAX_EDITS, chars_per_edit: int = CHARS_PER_EDIT) -> DataFrame:
    """(line_key_a, first_a, line_key_b, first_b, distance), once for each pair of near lines, stored.

    Buckets with one line only go in the shuffle that forms them. Lines of one bucket meet only if
    their letter counts allow for it, so lines that share a long passage but differ in a word or
    two are told apart inside the join.
    """
    entries = segment_keys(distinct.select("id", "line"), max_edits, chars_per_edit)
    bucket = Window.partitionBy("bucket")
    own = F.col("entry").bitwiseAND(F.lit(1)) == 1
    shared = (
        entries.withColumns({"_n": F.count(F.lit(1)).over(bucket), "_own": F.max(own).over(bucket)})
        .where((F.col("_n") > 1) & F.col("_own"))
        .select("bucket", F.col("entry").bitwiseAND(F.lit(-2)).alias("id"), own.alias("own"))
    )
    shared = materialize(shared, "line-buckets", compression="zstd")
    involved = materialize(shared.select("id").distinct(), "line-ids")
    counts = {f"n{i}": (F.length("line") - F.length(F.replace("line", F.lit(c)))).cast("short") for i, c in enumerate(COUNTED)}
    lines = distinct.join(small(involved), "id").select("id", "line_key", "first", "line")
    lines = materialize(lines, "line-texts", compression="zstd")

    described = shared.join(lines.select("id", *[c.alias(n) for n, c in counts.items()]), "id")
    left = described.where("own").select("bucket", F.col("id").alias("id_a"), *[F.col(n).alias(f"a_{n}") for n in counts])
    right = described.select("bucket", F.col("id").alias("id_b"), "own", *[F.col(n).alias(f"b_{n}") for n in counts])
    apart = reduce(add, [F.abs(F.col(f"a_{n}") - F.col(f"b_{n}")).cast("int") for n in counts])
    once = (F.col("id_a") < F.col("id_b")) | (~F.col("own") & (F.col("id_a") != F.col("id_b")))
    met = left.join(right, (left["bucket"] == right["bucket"]) & once & (apart <= 2 * max_edits))
    pairs = met.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).distinct()

    def named(side: str, text: str) -> DataFrame:
        return lines.select(
            F.col("id").alias(f"id_{side}"), F.col("line_key").alias(f"line_key_{side}"),
            F.col("first").alias(f"first_{side}"), F.col("line").alias(text),
        )

    texts = pairs.join(named("a", "a"), "id_a").join(named("b", "b"), "id_b")
    measured = texts.select(
        "line_key_a", "first_a", "line_key_b", "first_b", edit_distance("a", "b", max_edits).alias("distance"),
        allowed_edits(F.least(F.length("a"), F.length("b")), max_edits, chars_per_edit).alias("allowed"),
    )
    # Stored before the filter, which would otherwise compute the distance again below the join.
    return materialize(measured, "line-links").where(F.col("distance") <= F.col("allowed")).drop("allowed")


def repeated_lines(docs: DataFrame, *, max_edits: int = MAX_EDITS, chars_per_edit: int = CHARS_PER_EDIT) -> DataFrame:
    """Documents that hold a repeated or a near line, one row per (doc_id, text_key).

    `lines` are structs (line_no, n_links, dropped), n_links being the different lines near it.
    """
    if chars_per_edit < 2:
        raise ValueError("chars_per_edit must be at least 2, so that no segment is empty")
    lines = document_lines(docs)
    distinct = materialize(distinct_lines(lines), "lines", compression="zstd")
    links = line_links(distinct, max_edits, chars_per_edit)
    ends = links.select(F.col("line_key_a").alias("line_key"), F.col("first_b").alias("other")).unionByName(
        links.select(F.col("line_key_b").alias("line_key"), F.col("first_a").alias("other"))
    )
    near = ends.groupBy("line_key").agg(F.count(F.lit(1)).alias("n_links"), F.min("other").alias("other"))
    marks = (
        distinct.select("line_key", "first", "copies")
        .join(near, "line_key", "left")
        .where((F.col("copies") > 1) | F.col("n_links").isNotNull())
        .select(
            "line_key", "first", F.coalesce("n_links", F.lit(0)).alias("n_links"),
            F.coalesce(F.col("other") < F.col("first"), F.lit(False)).alias("near_earlier"),
        )
    )
    marks = materialize(marks, "line-marks", compression="zstd")
    place = F.struct("doc_id", "text_key", "line_no").cast(ORDER)
    marked = lines.select("doc_id", "text_key", "line_no", "line_key").join(marks, "line_key")
    dropped = F.col("near_earlier") | (place != F.col("first"))
    return marked.groupBy("doc_id", "text_key").agg(
        F.array_sort(F.collect_set(F.struct("line_no", "n_links", dropped.alias("dropped")))).alias("lines")
    )


def with_repeated_lines(docs: DataFrame, *, max_edits: int = MAX_EDITS, chars_per_edit: int = CHARS_PER_EDIT) -> DataFrame:
    """`docs` with `line_marks`, the structs of repeated_lines; NULL where a document has none."""
    found = repeated_lines(docs, max_edits=max_edits, chars_per_edit=chars_per_edit)
    found = found.select(F.col("doc_id").alias("_doc_id"), F.col("text_key").alias("_text_key"), F.col("lines").alias("line_marks"))
    keyed = F.col("doc_id").cast("long").eqNullSafe(F.col("_doc_id")) & (F.xxhash64(text_or_empty()) == F.col("_text_key"))
    return docs.join(found, keyed, "left").drop("_doc_id", "_text_key")


def dedup_lines(docs: DataFrame, *, max_edits: int = MAX_EDITS, chars_per_edit: int = CHARS_PER_EDIT) -> DataFrame:
    """`docs` without the repeated lines in their texts; a document left with white space only goes.

    A document that loses no line stays as it is, empty or not.
    """
    marked = with_repeated_lines(docs, max_edits=max_edits, chars_per_edit=chars_per_edit)
    lines = F.split("text", "\n")
    dropped = F.transform(F.filter("line_marks", lambda m: m["dropped"]), lambda m: m["line_no"])
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), dropped)
    cleaned = F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")
    changed = F.size(dropped) > 0
    marked = marked.withColumn("_kept", F.when(changed, F.size(kept)))
    marked = marked.withColumn("text", F.when(changed, cleaned).otherwise(F.col("text")))
    return marked.where(F.col("_kept").isNull() | F.col("text").rlike(INKED)).select(*docs.columns)
