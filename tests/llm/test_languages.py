"""Rank-order profiles against plain counting, and texts that are counted in slices."""

import random
from collections import Counter

import pytest

from fleetspc.llm import languages

RND = random.Random(5)
LETTERS = "abcdeéßΣςσİ中ж "


def plain_grams(text):
    """N-grams of one to three letters; words are runs of letters with a blank around them."""
    letters = "".join(c if c.isalpha() else " " for c in text.lower())
    words = f" {' '.join(letters.split())} " if letters.strip() else ""
    found = Counter(words[i : i + n] for n in (1, 2, 3) for i in range(len(words) - n + 1))
    del found[" "]
    return found


def number(gram):
    return sum(ord(c) << (21 * i) for i, c in enumerate(gram))


def texts(n, longest):
    return ["".join(RND.choices(LETTERS + ".-\n3", k=RND.randint(0, longest))) for _ in range(n)] + ["", " ", "...", "x", "ΟΔΟΣ ΟΔΟΣ."]


@pytest.mark.parametrize("size", [1, 2, 3, 7, 500_000])
def test_counts_in_slices(monkeypatch, size):
    monkeypatch.setattr(languages, "SLICE", size)
    table, total, counted = languages.letter_table(), Counter(), languages.GramCounts(languages.letter_table())
    for text in texts(60, 40):
        plain = {number(g): n for g, n in plain_grams(text).items()}
        assert dict(zip(*(x.tolist() for x in languages.grams_of_text(text, table)))) == plain
        counted.add(text)
        total.update(plain)
    grams, counts = counted.total()
    assert dict(zip(grams.tolist(), counts.tolist())) == total


def plain_predictions(rows, size):
    totals = {}
    for _, text, lang in rows:
        if lang is not None:
            totals.setdefault(lang, Counter()).update({number(g): n for g, n in plain_grams(text or "").items()})
    ranked = lambda counts: {g: i for i, (g, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:size])}
    profiles = {lang: ranked(counts) for lang, counts in sorted(totals.items()) if counts}
    out = {}
    for doc_id, text, _ in rows:
        mine = ranked({number(g): n for g, n in plain_grams(text or "").items()})
        if not mine:
            out[doc_id] = ("und", 0.0)
            continue
        apart = {lang: sum(abs(p[g] - i) if g in p else size for g, i in mine.items()) for lang, p in profiles.items()}
        best = min(apart, key=lambda lang: (apart[lang], lang))
        out[doc_id] = (best, 1 - apart[best] / (size * len(mine)))
    return out


@pytest.mark.parametrize("slice_size", [11, 500_000])
def test_like_plain(spark, monkeypatch, slice_size):
    monkeypatch.setattr(languages, "SLICE", slice_size)
    rows = [(i, text, lang) for i, (text, lang) in enumerate(zip(texts(120, 60), RND.choices(["en", "de", "fr", None], k=125)))]
    rows += [(900, None, "en"), (901, "very long " * 5_000, "fr"), (902, "x" * 20_000, None), (903, "same", "de"), (904, "same", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    profiles = languages.learn_profiles(docs, size=50)
    got = {r.doc_id: (r.lang_pred, r.score) for r in languages.predict_languages(docs, profiles, size=50).collect()}
    expected = plain_predictions(rows, 50)
    assert got.keys() == expected.keys()
    for doc_id, (lang, score) in expected.items():
        assert got[doc_id][0] == lang and got[doc_id][1] == pytest.approx(score, abs=1e-12)
