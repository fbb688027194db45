"""Near copies among embeddings by a pivot-permutation index.

Reference vectors, the pivots, are a bounded sample. Every vector is described by its nearest
pivots in order, and listed under each of the first of them. Two vectors are compared if they share
at least `shared` pivots; a pair of lists that share so many share one among the first
(listed) pivots of either, whatever order both keep, so it is met there and counted at the
least pivot that the two share. What is met is verified by the cosine in double precision.

Only vectors of one label are compared. A vector that is NULL or zero or has a NULL or non-finite
component links with nothing, and so does one without a label. Equal vectors of a label are one node
with a multiplicity. A long list is cut into blocks, and each pair of blocks is a group of its
own with a matrix product, so no group grows with the data; it gives the number of links of each
vector and as many links as connect what is linked, never all pairs.

Vectors of different length have nothing in common. Repeated rows are vectors of their own; those
of a NULL vec_id are too, and the least id of a component ignores them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetspc.llm.components import connected_components
from fleetspc.sources.workspace import materialize

COSINE = 0.93
# Bound of the sample of pivots.
PIVOTS = 256
NEAREST = 10
SHARED = 3
BLOCK = 1_000


def nodes_of(vectors: DataFrame) -> DataFrame:
    """(node, label, embedding, copies, vec_id), stored: the different valid vectors of each label."""
    values = F.transform("embedding", lambda x: x.cast("double"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    valid = F.col("label").isNotNull() & (F.size("embedding") > 0) & finite & F.exists("embedding", lambda x: x != 0)
    # Adding zero makes one of the two zeros.
    plain = vectors.where(F.coalesce(valid, F.lit(False))).select("label", F.transform(values, lambda x: x + 0.0).alias("embedding"), "vec_id")
    nodes = plain.groupBy("label", "embedding").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("vec_id"))
    node = F.sha2(F.concat_ws("|", F.col("label").cast("string"), F.to_json(F.struct("embedding"))), 256)
    return materialize(nodes.withColumn("node", F.unhex(node)), "vector-nodes", compression="zstd")


def _unit(embeddings: pd.Series) -> np.ndarray:
    rows = np.vstack(embeddings.to_numpy()).astype(np.float64)
    # Scaled first, so that squares of large or small components stay in range.
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def pivots_of(nodes: DataFrame, most: int = PIVOTS) -> dict[int, np.ndarray]:
    """Pivots per vector length: at most `most` vectors in all, those of the least node digests."""
    sample = nodes.orderBy("node").select("embedding").limit(most).toPandas()["embedding"]
    sizes = sample.map(len)
    return {int(n): _unit(sample[sizes == n]) for n in sizes.unique()}


def describe(nodes: DataFrame, pivots: dict[int, np.ndarray], nearest: int = NEAREST) -> DataFrame:
    """Nodes with `near`, the numbers of their nearest pivots, nearest first.

    Vectors of a length that no pivot has are all described by one pivot.
    """

    def places(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for embeddings in batches:
            out = pd.Series([[0]] * len(embeddings), index=embeddings.index, dtype=object)
            for n, some in embeddings.groupby(embeddings.map(len)):
                if n in pivots:
                    order = np.argsort(-(_unit(some) @ pivots[n].T), axis=1, kind="stable")
                    for i, row in zip(some.index, order[:, :nearest]):
                        out[i] = row.tolist()
            yield out

    return nodes.withColumn("near", F.pandas_udf(places, "array<int>")("embedding"))


def _verify(cosine: float, shared: int):
    def verify(keys: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        _, pivot, _, left_block, right_block = keys
        rows = rows.sort_values("node", ignore_index=True)
        units = _unit(rows["embedding"])
        width = int(rows["near"].map(max).max()) + 1
        lists = np.zeros((len(rows), width), np.float32)
        for i, near in enumerate(rows["near"]):
            lists[i, near] = 1
        earlier = lists[:, :pivot]
        need = np.minimum(shared, rows["near"].map(len).to_numpy())
        left = np.flatnonzero(rows["block"].to_numpy() == left_block)
        right = np.flatnonzero(rows["block"].to_numpy() == right_block)
        same = left_block == right_block
        copies = rows["copies"].to_numpy()
        linked = np.zeros(len(rows), np.int64)
        root = np.arange(len(rows))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for first in range(0, len(left), 500):
            part = left[first : first + 500]
            near = (units[part] @ units[right].T >= cosine) & (lists[part] @ lists[right].T >= np.minimum(need[part][:, None], need[right][None, :]))
            # Counted where the two lists share no pivot before this one.
            near &= earlier[part] @ earlier[right].T == 0
            near &= part[:, None] < right[None, :] if same else part[:, None] != right[None, :]
            linked[part] += near @ copies[right]
            linked[right] += near.T @ copies[part]
            for i, j in zip(*np.nonzero(near)):
                a, b = find(part[i]), find(right[j])
                if a != b:
                    root[max(a, b)] = min(a, b)
        roots = np.fromiter((find(i) for i in range(len(rows))), int, len(rows))
        found = np.flatnonzero(linked)
        return pd.DataFrame({"node": rows["node"].to_numpy()[found], "other": rows["node"].to_numpy()[roots[found]], "linked": linked[found]})

    return verify


def vector_links(nodes: DataFrame, *, cosine: float = COSINE, pivots: int = PIVOTS, nearest: int = NEAREST, shared: int = SHARED, block: int = BLOCK) -> DataFrame:
    """(node, other, linked), stored: links that connect what is linked, and parts of link counts."""
    described = describe(nodes, pivots_of(nodes, pivots), nearest)
    described = materialize(described, "vector-places", compression="zstd")
    # In the order of pivot numbers a pair that shares enough shares one of the first of these.
    listed = F.slice(F.array_sort("near"), 1, F.greatest(F.size("near") - (shared - 1), F.lit(1)))
    length = F.size("embedding").alias("length")
    postings = described.select("*", length, F.explode(listed).alias("pivot"))
    # At most labels times pivots rows.
    lists = postings.groupBy("label", "length", "pivot").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    cut = postings.join(lists, ["label", "length", "pivot"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("_other")
    met = cut.select("label", "pivot", "length", "node", "embedding", "copies", "near", "block", other)
    met = met.withColumns({"low": F.least("block", "_other"), "high": F.greatest("block", "_other")}).drop("_other")
    verified = met.groupBy("label", "pivot", "length", "low", "high").applyInPandas(
        _verify(cosine, shared), "node binary, other binary, linked long"
    )
    return materialize(verified, "vector-links", compression="zstd")


def near_vectors(vectors: DataFrame, *, cosine: float = COSINE, **options) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    `options` are those of vector_links. Equal vectors link with each other.
    """
    nodes = nodes_of(vectors)
    links = vector_links(nodes, cosine=cosine, **options)
    counts = links.groupBy("node").agg(F.sum("linked").alias("linked"))
    roots = connected_components(links.select(F.col("node").alias("a"), F.col("other").alias("b")))
    rooted = (
        nodes.select("node", "label", "embedding", "copies", "vec_id")
        .join(roots, "node", "left")
        .join(counts, "node", "left")
        .withColumn("root", F.coalesce("root", "node"))
    )
    least = rooted.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    placed = rooted.join(least, "root").select(
        F.col("label").alias("_label"), F.col("embedding").alias("_embedding"), "component_id",
        (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    plain = F.transform("embedding", lambda x: x.cast("double") + 0.0)
    here = (F.col("label") == F.col("_label")) & (plain == F.col("_embedding"))
    joined = vectors.select("vec_id", "label", "embedding").join(placed, here, "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
