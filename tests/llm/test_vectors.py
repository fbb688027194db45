import numpy as np
import pytest
from fleetspc.llm import components, vectors

RND = np.random.default_rng(5)


def plain(rows, cosine=0.93):
    """Links and least reachable ids, all pairs."""
    ok = [r for r in rows if r[2] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    links = {r[0]: set() for r in rows}
    for a in ok:
        for b in ok:
            if a[0] != b[0] and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1]), np.array(b[1])
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= cosine:
                    links[a[0]].add(b[0])
    least = {}
    for k in sorted(links):
        todo = [k]
        while todo:
            n = todo.pop()
            if n not in least:
                least[n] = k
                todo += links[n]
    return {k: (len(v), least[k], least[k] == k) for k, v in links.items()}


@pytest.mark.parametrize("block", [1_000, 7])
def test_near_vectors_against_all_pairs(spark, block):
    rows = []
    for g in range(12):
        base = RND.normal(size=16)
        for _ in range(6):
            rows.append((len(rows), [float(x) for x in base + RND.normal(size=16) * 0.08], g % 3))
    rows += [(100, rows[0][1], 0), (101, None, 1), (102, [0.0] * 16, 1), (103, [float("nan")] * 16, 1), (104, rows[0][1], None), (105, [], 1), (106, [None] * 16, 1), (107, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(df, block=block).collect()}
    expected = plain(rows)
    found, there = sum(v[0] for v in got.values()), sum(v[0] for v in expected.values())
    assert set(got) == set(expected) and all(got[k][0] <= expected[k][0] for k in got)
    assert found >= 0.95 * there
    if found == there:
        assert got == expected
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 130)] + [(7, 7)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(1, 61), 0), **dict.fromkeys(range(101, 130), 100)}
