"""The trie of conversations by their turns: what they share and where they part.

A node of depth d is a distinct sequence of first d turns (role and text); the root has none. Its
members are the conversations that start with it.

Conversations are sorted by the digests of their turns and cut into ranges. Neighbours have an edge
whose depth is the number of turns they share. A task takes its edges from the deepest to the
shallowest and unites the components at both ends (union-find): both are lifted to the depth of the
edge, leaving a node at every depth they pass, and become one node there, a branching one. A
component is an interval of the sorted rows, so a node is complete unless it reaches the first or the
last row of the range. Nodes that do lie on the paths of these two rows; they and what is known of
them are all that is left of a range, its contracted forest. Contracted forests of FAN neighbouring
ranges are merged in the same way, across the edges of their boundaries, until one is left; so
the rows of a task are a range's conversations at first and 2 * FAN paths after that.

Rebuilding: `rebuild` puts the first turns of another conversation in place of a conversation's own.

Turns of a conversation are ordered by turn, NULL first; equal turns by the digest of role and text.
NULL role and text are empty. Rows without conv_id belong to no conversation. Repeated rows are turns
like others. A conversation without turns ends at the root. An empty table has no nodes. A
conversation's digests and word counts are one row (its texts are not); the ids that end at a node are
digested in pieces, one after the other, since their digest is a single SHA-256.
"""

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetspc.llm.frames import text_or_empty
from fleetspc.sources.workspace import materialize

# Bytes of a turn's digest in a path.
TURN = 16
# Contracted forests that a task merges.
FAN = 64
# Ids in a piece that is digested, and rows of a batch that a task sends.
IDS = 4_096
BATCH = 20_000

WORD = r"[^\x20\x09-\x0D]+"

NODE, PATH, PIECE = 0, 1, 2
_LONGS = pa.list_(pa.int64())
# Rows that tasks send: nodes, paths of contracted forests, pieces of ids.
_SENT = pa.schema([
    ("kind", pa.int32()), ("part", pa.int64()), ("place", pa.int64()),
    ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("parent_key", pa.string()),
    ("key", pa.string()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()),
    ("saved_tokens", pa.int64()), ("ends", pa.string()),
    ("path", pa.binary()), ("first", pa.int64()), ("known", pa.list_(_LONGS)), ("words", _LONGS), ("keys", pa.list_(pa.string())),
])
_SENT_DDL = (
    "kind int, part long, place long, conv_id long, depth long, parent_conv_id long, parent_key string, key string, "
    "n_convs long, n_children long, n_leaves long, saved_tokens long, ends string, "
    "path binary, first long, known array<array<long>>, words array<long>, keys array<string>"
)

_EMPTY = hashlib.sha256(b"").hexdigest()


def own_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): array of (turn, key, words) in order, key being a digest of role and text."""
    role, text = text_or_empty("role"), text_or_empty("text")
    key = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    words = F.regexp_count(text, F.lit(WORD)).cast("long")
    each = F.struct("turn", key.alias("key"), words.alias("words"))
    listed = F.sort_array(F.collect_list(each)).alias("turns")
    return turns.where(F.col("conv_id").isNotNull()).groupBy("conv_id").agg(listed)


def rebuild(conversations: DataFrame, base: Callable[[Column], Column], heads: Callable[[Column], Column], most: int) -> DataFrame:
    """Each conversation with its first h turns taken from its base, h = heads(conv_id) <= most.

    All turns of a base that has fewer are taken, none of a base that is not there. base(base(c)) is
    base(c), so only such conversations serve as bases.
    """
    c = F.col("conv_id")
    first = conversations.where(base(c) == c).select(c.alias("base_id"), F.slice("turns", 1, most).alias("head"))
    joined = conversations.join(first, base(c) == F.col("base_id"), "left").withColumn("h", heads(c).cast("int"))
    taken = F.slice("head", F.lit(1), F.col("h"))
    own = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    return joined.select("conv_id", F.when(F.col("head").isNull(), own).otherwise(F.concat(taken, own)).alias("turns"))


def shared_turns(a: bytes, b: bytes) -> int:
    """Number of first turns that two paths have in common."""
    low, high = 0, min(len(a), len(b)) // TURN
    while low < high:
        middle = (low + high + 1) // 2
        if a[: middle * TURN] == b[: middle * TURN]:
            low = middle
        else:
            high = middle - 1
    return low


class Forest:
    """Sorted rows united along their edges, from the deepest to the shallowest.

    Row i has length[i] turns and shares[i] of them with the row before. From depth first[i] on it
    brings what is known of its path's nodes: known[i][k] for depth first[i] + k, as (members, least
    conv_id, children, leaves, saved tokens), children being complete ones and the rest theirs.
    words(i, k) are the words of turn k of a row that is the first to have it.

    After `unite` the nodes are the lists; `values` of a node that is open hold what `known` does.
    With `finish` no node is open.
    """

    def __init__(self, length: Sequence[int], shares: Sequence[int], first: Sequence[int], known: Sequence, words: Callable[[int, int], int], finish: bool):
        self.length, self.shares, self.first, self.known, self.words, self.finish = length, shares, first, known, words, finish
        rows = range(len(length))
        self.up, self.right = list(rows), list(rows)
        self.top = list(length)
        self.values = [list(known[i][-1]) for i in rows]
        # Members of the component's node, open children included.
        self.members = [v[0] for v in self.values]
        self.children: list[list[int]] = [[] for _ in rows]
        self.bring = [[i] if first[i] < length[i] else [] for i in rows]
        self.depth: list[int] = []
        self.row: list[int] = []
        self.node: list[tuple] = []
        self.open: list[bool] = []
        self.parent: list[int] = []

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def settle(self, c: int) -> None:
        """The component's node is complete as far as these rows tell: it gets a number.

        Components are named by their first row.
        """
        depth, number = self.top[c], len(self.depth)
        members, least, children, leaves, saved = self.values[c]
        is_open = not self.finish and (c == 0 or self.right[c] == len(self.up) - 1)
        if is_open:
            self.node.append((members, least, children, leaves, saved))
            self.values[c] = [0, least, 0, 0, 0]
        else:
            total = self.members[c]
            leaves = leaves if children else 1
            saved += (total - 1) * (self.words(c, depth) if depth else 0)
            self.node.append((total, least, children, leaves, saved))
            self.values[c] = [total, least, 1, leaves, saved]
        for child in self.children[c]:
            self.parent[child] = number
        self.children[c] = [number]
        self.depth.append(depth)
        self.row.append(c)
        self.open.append(is_open)
        self.parent.append(-1)

    def lift(self, c: int, depth: int) -> None:
        while self.top[c] > depth:
            self.settle(c)
            self.top[c] -= 1
            for i in self.bring[c]:
                if self.first[i] <= self.top[c]:
                    self.add(c, self.known[i][self.top[c] - self.first[i]])
                    self.members[c] += self.known[i][self.top[c] - self.first[i]][0]

    def add(self, c: int, other: Sequence[int]) -> None:
        mine = self.values[c]
        self.values[c] = [mine[0] + other[0], min(mine[1], other[1]), mine[2] + other[2], mine[3] + other[3], mine[4] + other[4]]

    def unite(self) -> None:
        edges = np.argsort(-np.asarray(self.shares[1:], np.int64), kind="stable") + 1
        for i in edges.tolist():
            a, b = self.find(i - 1), self.find(i)
            self.lift(a, self.shares[i])
            self.lift(b, self.shares[i])
            self.add(a, self.values[b])
            self.members[a] += self.members[b]
            for held in (self.children, self.bring):
                few, many = sorted((held[a], held[b]), key=len)
                many.extend(few)
                held[a], held[b] = many, []
            self.right[a], self.up[b] = self.right[b], a
        self.lift(0, 0)
        self.settle(0)


def path_keys(path: bytes) -> list[str]:
    """Digests that name the nodes of a path, from the root."""
    digest, keys = hashlib.md5(), []
    keys.append(digest.hexdigest())
    for at in range(0, len(path), TURN):
        digest.update(path[at : at + TURN])
        keys.append(digest.hexdigest())
    return keys


def _batches(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) == BATCH:
            yield pa.RecordBatch.from_pylist(held, schema=_SENT)
            held = []
    yield pa.RecordBatch.from_pylist(held, schema=_SENT)


def _sent(forest: Forest, part: int, paths: dict[int, bytes], words: dict[int, list[int]], own_keys: bool, ends: Callable[[int], list[int] | None]) -> Iterator[dict]:
    """Rows of a united forest. `paths` and `words` are those of the rows at both ends, or of all.

    `own_keys`: complete nodes get their key too, by which pieces of ids find them.
    """
    keys = {i: path_keys(p) for i, p in paths.items()}
    last = len(forest.up) - 1
    # An open node lies on the path of the first row, or else on that of the last.
    side = [0 if r == 0 else last for r in forest.row]
    spines: dict[int, list[int]] = {}
    for number, (depth, row, is_open, values) in enumerate(zip(forest.depth, forest.row, forest.open, forest.node)):
        up = forest.parent[number]
        ending = ends(row) if forest.length[row] == depth else None
        if is_open:
            spines.setdefault(side[number], []).append(number)
            for at in range(0, len(ending or []), IDS):
                yield {"kind": PIECE, "part": part, "place": at, "key": keys[side[number]][depth], "ends": ",".join(map(str, ending[at : at + IDS]))}
            continue
        sent = dict(zip(("n_convs", "conv_id", "n_children", "n_leaves", "saved_tokens"), values), kind=NODE, part=part, depth=depth)
        if up >= 0 and forest.open[up]:
            sent["parent_key"] = keys[side[up]][depth - 1]
        elif up >= 0:
            sent["parent_conv_id"] = forest.node[up][1]
        if own_keys:
            sent["key"] = keys[row][depth]
        else:
            sent["ends"] = hashlib.sha256(",".join(map(str, ending or [])).encode()).hexdigest()
        yield sent
    for row, numbers in spines.items():
        numbers.sort(key=lambda n: forest.depth[n])
        yield {
            "kind": PATH, "part": part, "place": row, "path": paths[row], "first": forest.depth[numbers[0]],
            "known": [list(forest.node[n]) for n in numbers], "words": words[row], "keys": keys[row][forest.depth[numbers[0]] :],
        }


def range_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The forest of one range of sorted conversations (conv_id, path, words)."""
    ids: list[int] = []
    length: list[int] = []
    shares: list[int] = []
    new_words: list[list[int]] = []
    paths: dict[int, bytes] = {}
    words: dict[int, list[int]] = {}
    before = None
    for batch in batches:
        for conv_id, path, counts in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "path", "words"))):
            alike = 0 if before is None else shared_turns(before, path)
            if before is None:
                paths[0], words[0] = path, counts
            ids.append(conv_id)
            length.append(len(path) // TURN)
            shares.append(alike)
            new_words.append(counts[alike:])
            before, counts_before = path, counts
    if not ids:
        return
    paths[len(ids) - 1], words[len(ids) - 1] = before, counts_before
    forest = Forest(length, shares, length, [[(1, c, 0, 0, 0)] for c in ids], lambda i, k: new_words[i][k - shares[i] - 1], finish=False)
    forest.unite()

    def ends(row: int) -> list[int]:
        """Conversations equal to that of the row, which follow it."""
        after = row + 1
        while after < len(ids) and shares[after] == length[after] == length[row]:
            after += 1
        return ids[row:after]

    yield from _batches(_sent(forest, TaskContext.get().partitionId(), paths, words, False, ends))


def merged_forest(table: pa.Table, finish: bool) -> pa.Table:
    """Contracted forests of neighbouring ranges as one."""
    rows = sorted(table.to_pylist(), key=lambda r: (r["part"], r["place"]))
    paths, words = {i: r["path"] for i, r in enumerate(rows)}, {i: r["words"] for i, r in enumerate(rows)}
    shares = [0] + [shared_turns(a["path"], b["path"]) for a, b in zip(rows, rows[1:])]
    length = [len(r["path"]) // TURN for r in rows]
    forest = Forest(length, shares, [r["first"] for r in rows], [r["known"] for r in rows], lambda i, k: words[i][k - 1], finish)
    forest.unite()
    made = list(_sent(forest, rows[0]["bundle"], paths, words, True, lambda row: None))
    return pa.Table.from_pylist(made, schema=_SENT)


def _merging(finish: bool) -> Callable[[pa.Table], pa.Table]:
    return lambda table: merged_forest(table, finish)


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's pieces, which come in order, as if joined by commas."""
    key = digest = None
    for batch in batches:
        done: list[tuple] = []
        for k, piece in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist()):
            if k != key:
                if key is not None:
                    done.append((key, digest.hexdigest()))
                key, digest = k, hashlib.sha256(piece.encode())
            else:
                digest.update(b"," + piece.encode())
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.string()) for i in (0, 1)], names=["key", "ends"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (key, digest.hexdigest())], names=["key", "ends"])


def trie(conversations: DataFrame) -> DataFrame:
    """Nodes of the trie of (conv_id, turns), conv_id being unique.

    conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and
    ends_sha256 (the members that end at the node, in order, comma-joined).
    """
    path = F.unhex(F.array_join(F.transform("turns", lambda t: t["key"]), "")).alias("path")
    rows = conversations.select("conv_id", path, F.transform("turns", lambda t: t["words"]).alias("words"))
    rows = materialize(rows, "conversations")
    ranged = rows.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    ranges = materialize(ranged.mapInArrow(range_forest, _SENT_DDL), "range-forests")

    paths = ranges.where(F.col("kind") == PATH)
    rounds: list[DataFrame] = []
    while True:
        # Merging ends once few enough are left for one task.
        finish = paths.select("part").distinct().limit(FAN + 1).count() <= FAN
        bundle = F.lit(0).cast("long") if finish else F.floor(F.col("part") / FAN)
        bundled = paths.select(bundle.alias("bundle"), "part", "place", "path", "first", "known", "words")

        made = materialize(bundled.groupBy("bundle").applyInArrow(_merging(finish), _SENT_DDL), "merged-forests")
        rounds.append(made.where(F.col("kind") == NODE))
        if finish:
            break
        paths = made.where(F.col("kind") == PATH)

    values = ["conv_id", "depth", "parent_conv_id", "parent_key", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    merged = rounds[0].select("key", *values)
    for more in rounds[1:]:
        merged = merged.unionByName(more.select("key", *values))
    named = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("found"))

    pieces = ranges.where(F.col("kind") == PIECE).select("key", "part", "place", "ends")
    ended = pieces.repartition("key").sortWithinPartitions("key", "part", "place").mapInArrow(_digested, "key string, ends string")

    def with_parent(nodes: DataFrame, names: DataFrame, on: list[str], *columns: str) -> DataFrame:
        """Nodes whose parent was still open get its conv_id; the others take no part in the join."""
        waiting = nodes.where(F.col("parent_key").isNotNull()).join(names, on, "left")
        waiting = waiting.withColumn("parent_conv_id", F.col("found")).select(*columns)
        return nodes.where(F.col("parent_key").isNull()).select(*columns).unionByName(waiting)

    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    # Per range, so that a node with many children in many ranges is many keys.
    range_names = ranges.where(F.col("kind") == PATH).select("part", F.explode("keys").alias("parent_key"))
    range_names = materialize(range_names.join(named, "parent_key"), "range-names")
    inside = with_parent(ranges.where(F.col("kind") == NODE), range_names, ["part", "parent_key"], *out)
    across = merged.join(ended, "key", "left").withColumn("ends", F.coalesce("ends", F.lit(_EMPTY)))
    across = with_parent(across, named, ["parent_key"], *out)
    return inside.unionByName(across).withColumnRenamed("ends", "ends_sha256")
