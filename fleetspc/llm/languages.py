"""Language identification by rank order of n-grams.

A profile lists the most frequent n-grams of a language, of one to three letters, in order of
frequency; words are lower-cased runs of letters with a blank around them. A document's own
profile is compared with each language's by the out-of-place measure: the sum over the document's
n-grams of how far their ranks are apart, an n-gram that the language lacks counting as far as can
be. The nearest language is predicted.

Profiles count all training documents. Each task counts its own documents, SLICE characters at a
time, and sends one row per language and n-gram, which are as many as the alphabets allow for.

A document whose text is NULL, empty or without letters is `und`, with score 0. Documents without
lang are not learned from. Ties go to the language that comes first in order of code points.
Columns with the names that are added are replaced, all others pass through.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetspc.llm.frames import text_or_empty
from fleetspc.sources.workspace import materialize

PROFILE = 400
ORDERS = 3
# More languages than this mean that the column holds something else.
MOST_LANGUAGES = 1_000
UNKNOWN = "und"

# Characters that a task turns into n-grams at once.
SLICE = 500_000

# Bits of a code point in an n-gram's number.
_POINT = 21
_BLANK = 32


def letter_table() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def letters_of(text: str, is_letter: np.ndarray) -> np.ndarray:
    """Lower-case letters with single blanks around words; empty if there are no letters."""
    points = np.concatenate([np.zeros(0, np.int64), *letter_slices(text, is_letter)])
    return points if len(points) > 1 else points[:0]


def letter_slices(text: str, is_letter: np.ndarray) -> Iterator[np.ndarray]:
    """Letters and blanks of a text, SLICE characters at a time; joined they are letters_of."""
    # In one go, since the lower case of a letter may depend on those around it.
    text, last = text.lower(), -1
    for start in range(0, max(len(text), 1), SLICE):
        raw = np.frombuffer(text[start : start + SLICE].encode("utf-32-le", "replace"), np.uint32)
        ends = ([_BLANK] if start == 0 else [], [_BLANK] if start + SLICE >= len(text) else [])
        points = np.concatenate((ends[0], np.where(is_letter[raw], raw, _BLANK), ends[1])).astype(np.int64)
        keep = points != _BLANK
        keep[1:] |= points[:-1] != _BLANK
        keep[:1] |= last != _BLANK
        points = points[keep]
        if len(points):
            last = points[-1]
        yield points


def grams_of(points: np.ndarray) -> np.ndarray:
    """Numbers of all n-grams but the blank alone."""
    found = [points[points != _BLANK]]
    number = points
    for n in range(1, ORDERS):
        number = number[:-1] | (points[n:] << (_POINT * n))
        found.append(number)
    return np.concatenate(found)


def count_points(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different n-grams of letters and blanks, in order, and their numbers of occurrences.

    Letters are numbered within the slice, so that counts of n-grams are counts of small integers.
    """
    if not len(points):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    letters, small = np.unique(points, return_inverse=True)
    if len(letters) ** ORDERS > 8_000_000:
        grams, counts = np.unique(grams_of(points), return_counts=True)
    else:
        grams, counts = [], []
        for n in range(min(ORDERS, len(points))):
            size, number = len(letters), small[: len(small) - n].copy()
            for k in range(1, n + 1):
                number = number * size + small[k : len(small) - n + k]
            tally = np.bincount(number)
            codes = np.flatnonzero(tally)
            gram, rest = np.zeros(len(codes), np.int64), codes
            for k in reversed(range(n + 1)):
                gram |= letters[rest % size] << (_POINT * k)
                rest = rest // size
            grams.append(gram)
            counts.append(tally[codes])
        grams, counts = np.concatenate(grams), np.concatenate(counts)
    blanks = grams == _BLANK
    # Between two texts stand two blanks; no n-gram of a letter crosses them.
    crossing = (grams & ((1 << 2 * _POINT) - 1)) == (_BLANK | _BLANK << _POINT)
    middle = (grams >> _POINT) == (_BLANK | _BLANK << _POINT)
    keep = ~(blanks | crossing | middle)
    return grams[keep], counts[keep]


class GramCounts:
    """Counts of the n-grams of any number of texts, in memory for SLICE characters and the counts."""

    def __init__(self, is_letter: np.ndarray):
        self.is_letter = is_letter
        self.grams, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.waiting: list[np.ndarray] = []
        self.size = 0

    def add(self, text: str) -> None:
        slices = letter_slices(text, self.is_letter)
        points, following = next(slices), next(slices, None)
        if following is None:
            self.waiting.append(points)
            self.size += len(points)
            if self.size >= SLICE:
                self._flush()
            return
        self._count(points, 1)
        while following is not None:
            # What is repeated carries n-grams over the cut; those within it are counted already.
            repeated = points[1 - ORDERS :]
            points = np.concatenate((repeated, following))
            self._count(points, 1)
            self._count(repeated, -1)
            following = next(slices, None)

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        self._flush()
        return self.grams, self.counts

    def _flush(self) -> None:
        if self.waiting:
            self._count(np.concatenate(self.waiting), 1)
        self.waiting, self.size = [], 0

    def _count(self, points: np.ndarray, times: int) -> None:
        grams, counts = count_points(points)
        grams, place = np.unique(np.concatenate((self.grams, grams)), return_inverse=True)
        # Sums of doubles are exact up to 2 ** 53 occurrences in a task.
        counts = np.bincount(place, np.concatenate((self.counts, counts * times)), len(grams)).astype(np.int64)
        self.grams, self.counts = grams[counts != 0], counts[counts != 0]


def grams_of_text(text: str, is_letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different n-grams of a text, in order, and their numbers of occurrences."""
    if len(text) <= SLICE:
        return np.unique(grams_of(letters_of(text, is_letter)), return_counts=True)
    counted = GramCounts(is_letter)
    counted.add(text)
    return counted.total()


def learn_profiles(labelled: DataFrame, *, size: int = PROFILE, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, gram, place): the `size` most frequent n-grams of each language, from place 0."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        is_letter = letter_table()
        totals: dict[str, GramCounts] = {}
        for batch in batches:
            for name, content in zip(batch["lang"], batch["text"]):
                if name not in totals:
                    totals[name] = GramCounts(is_letter)
                totals[name].add(content)
        for name, total in totals.items():
            grams, counts = total.total()
            yield pd.DataFrame({"lang": name, "gram": grams, "n": counts})

    rows = labelled.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), text_or_empty(text).alias("text"))
    counted = rows.mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    frequent = Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")
    placed = counted.withColumn("place", F.row_number().over(frequent) - 1).where(F.col("place") < size)
    return materialize(placed.select("lang", "gram", "place"), "language-profiles")


def profile_matrix(profiles: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, the n-grams of any profile in order, and their places per language (-1: none).

    At most MOST_LANGUAGES times the profile size rows.
    """
    names = [r["lang"] for r in profiles.select("lang").distinct().orderBy("lang").limit(MOST_LANGUAGES + 1).collect()]
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages: not a column of languages")
    rows = profiles.toPandas()
    grams = np.unique(rows["gram"].to_numpy(np.int64))
    places = np.full((len(grams), len(names)), -1, np.int64)
    column = rows["lang"].map({name: i for i, name in enumerate(sorted(names))}).to_numpy(np.int64)
    places[np.searchsorted(grams, rows["gram"].to_numpy(np.int64)), column] = rows["place"].to_numpy(np.int64)
    return sorted(names), grams, places


def predict_languages(docs: DataFrame, profiles: DataFrame, *, size: int = PROFILE, text: str = "text") -> DataFrame:
    """`docs` with lang_pred and score.

    The score is 1 for a document whose n-grams all stand at the language's own places, and 0 for
    one that has none of them.
    """
    names, known, places = profile_matrix(profiles)

    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        is_letter = letter_table()
        for texts in batches:
            yield pd.DataFrame(predicted_rows(texts, is_letter), columns=["lang_pred", "score"])

    def predicted_rows(texts: pd.Series, is_letter: np.ndarray) -> list:
        out = []
        for content in texts:
            grams, counts = grams_of_text(content or "", is_letter)
            if not len(grams) or not names:
                out.append((UNKNOWN, 0.0))
                continue
            # The most frequent ones; equal counts in order of the n-gram, as unique leaves them.
            mine = grams[np.argsort(-counts, kind="stable")[:size]]
            at = np.minimum(np.searchsorted(known, mine), len(known) - 1)
            theirs = np.where((known[at] == mine)[:, None], places[at], -1)
            apart = np.abs(theirs - np.arange(len(mine))[:, None])
            apart = np.where(theirs < 0, size, apart).sum(axis=0)
            best = int(apart.argmin())
            out.append((names[best], 1.0 - float(apart[best]) / (size * len(mine))))
        return out

    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    predicted = F.pandas_udf(predict, "lang_pred string, score double")(text_or_empty(text))
    return docs.select(*kept, predicted.alias("_p")).select(*kept, "_p.lang_pred", "_p.score")


def held_out() -> Column:
    """Whether a document is kept from training: by the CRC-32 of its id; no id, not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
