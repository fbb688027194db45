"""Source divergence against a plain version, and odd rows."""

import random
import re
from collections import Counter

import pytest

from fleetspc.llm import divergence

WORD = re.compile("[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, min_docs, top):
    rows = [tuple(x or "" for x in r) for r in rows]
    found = [(lang, source, [w.translate(UPPER) for w in WORD.findall(text)]) for text, lang, source in rows]
    out = []
    for lang in {r[0] for r in found}:
        docs = Counter(w for r in found if r[0] == lang for w in set(r[2]))
        kept = [w for w, n in docs.items() if n >= min_docs]
        groups = {s: Counter(w for r in found if r[:2] == (lang, s) for w in r[2] if w in set(kept)) for s in {r[1] for r in found if r[0] == lang}}
        whole = sum(groups.values(), Counter())

        def share(counts, word):
            return 1 + 10**9 * (counts[word] + 5) // (sum(counts.values()) + 5 * len(kept))

        for source, counts in groups.items():
            pairs = [(sum(abs(share(counts, w) - share(c, w)) for w in kept), o) for o, c in groups.items() if o != source]
            terms = [(share(counts, w) - share(whole, w), w) for w in kept if counts[w] and share(counts, w) > share(whole, w)]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, source, part, item, value, i + 1) for i, (value, item) in enumerate(items[:most])]
    return sorted(out)


def got(docs, **options):
    return sorted(tuple(r) for r in divergence.audit(docs, **options).collect())


@pytest.mark.parametrize("per_block, steps", [(10**6, 10**6), (20, 3)])
def test_like_plain(spark, monkeypatch, per_block, steps):
    """Also with many blocks, and accumulators filled a few steps at a time."""
    monkeypatch.setattr(divergence, "POSTINGS_PER_BLOCK", per_block)
    monkeypatch.setattr(divergence, "STEPS", steps)
    rnd = random.Random(3)
    vocabulary = ["a", "B", "Straße", "ÉTÉ", "été", "中文", "x-y", "don't", "zz9zz", "KelvinK", "퟿", "😀q"]
    sources = ["s1", "s2", "S2", "é", "", None, "hot"]
    rows = []
    for _ in range(160):
        source = "hot" if rnd.random() < 0.35 else rnd.choice(sources)
        text = rnd.choice([" ", "\n", "1_"]).join(rnd.choices(vocabulary, k=rnd.randint(0, 9)))
        rows.append((rnd.choice([text, text, text, None]), rnd.choice(["en", "en", "de", None]), source))
    rows += [("only here", "xx", "one"), (None, "yy", None), ("", "yy", "two")] + [("same text", "en", "s1")] * 20
    docs = spark.createDataFrame([(*r, "extra", 1) for r in rows], "text string, lang string, source string, term string, n int").repartition(5)
    assert got(docs, min_docs=4, top=5) == plain(rows, 4, 5)


def test_odd(spark):
    schema = "text string, lang string, source string"
    assert got(spark.createDataFrame([], schema)) == []
    lonely = spark.createDataFrame([("a b", None, None), (None, None, None)], schema)
    assert got(lonely, min_docs=1) == []
    apart = spark.createDataFrame([("a", "x", "p"), (None, "x", "q")], schema)
    assert got(apart) == [("x", "p", "pair", "q", 0, 1), ("x", "q", "pair", "p", 0, 1)]


def test_long_texts(spark):
    """A long text is split between words, and counts as one document."""
    text = b"ab " * 1000 + b"c" * 5000 + b" d"
    pieces = list(divergence.slices(text, 700))
    assert len(pieces) > 3 and b"".join(pieces) == text
    assert Counter(w for p in pieces for w in p.split()) == Counter(text.split())
    long = "word " * 700_000 + "x" * 3_000_000 + " end"
    counts = divergence.term_counts(spark.createDataFrame([(long, "en", "s")] * 2, "text string, lang string, source string"))
    rows = {r.term[:5]: (r.n, r.docs) for r in counts.collect()}
    assert rows == {"": (0, 0), "word": (1_400_000, 2), "xxxxx": (2, 2), "end": (2, 2)}
