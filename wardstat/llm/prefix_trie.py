"""Operator 13: the prefix trie of conversations, by range minima over sorted LCPs.

Every conversation is rebuilt (the first ``h`` turns of its group's head, then its own turns
after its first ``h``), as one row of 128-bit turn fingerprints. The rows are put in
lexicographic order by a range-partitioned sort; conv_id breaks ties, so a group of equal
conversations spreads over many tasks. Tasks cut their rows into blocks of about
``block_turns`` turns, and in a block:

* the LCP of each row with the row before is found, and a sparse table (minima of 1, 2, 4, ...
  entries) is laid over the LCPs;
* every candidate prefix, one for each LCP (where two rows part) and one for each whole row,
  binary-searches the left and the right end of the rows that share it, independently of
  all others and without a stack. Equal intervals are one;
* an interval stands for the depths below its parent's, and its subtree is the run of
  intervals that follow it in (start, depth) order, so subtree sums are differences of
  running sums. The smallest conv_id comes from a second sparse table.

Nodes on the path of a block's first or last row may have members in other blocks: those are
given out in part, under a hash of their prefix, and Spark adds the parts up. Their own
subtrees run over the blocks' edge rows in order, so again running sums (two numbers for each
edge row) give the totals. All other nodes are complete in their block.

Defined cases: null role or text is empty; a null turn comes first; turns of equal number are
ordered by a hash of role and text; repeated rows are repeated turns; rows without conv_id belong
to no conversation; ``c % 20`` and ``c - c % 20`` keep the sign of c, as SQL does; an absent head
gives no turns; a conversation without turns ends at the root; an empty table has no node.
Other columns are ignored. Bounds: a conversation's fingerprints are one row (16 bytes a turn and
its words), whatever its texts hold; a block is ``block_turns`` turns, one conversation at least;
what is kept of edge rows is two conversations for each block. Equal 128-bit hashes count as
equal turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardstat.llm.mixing import n_words
from wardstat.llm.tables import pick, small_enough, written

GROUP = 20
HEADS = 4
BLOCK_TURNS = 1 << 17
#: conv_ids are joined in pieces of about so many bytes
PIECE = 1 << 14
MAX_BROADCAST = 200_000
_TURN = "struct<token:binary,words:bigint>"
_EMPTY = hashlib.sha256(b"").hexdigest()

CLOSED, OPEN, ENDS = 0, 1, 2
_OUT = (
    "kind int, conv_id long, depth long, parent_conv_id long, key binary, parent_key binary, edge long, n_convs long, "
    "n_children long, n_leaves long, saved_tokens long, words long, ends string"
)
_ARROW = pa.schema([
    ("kind", pa.int32()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("key", pa.binary()),
    ("parent_key", pa.binary()), ("edge", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()),
    ("saved_tokens", pa.int64()), ("words", pa.int64()), ("ends", pa.string()),
])


def rebuilt(conversations: DataFrame, group: int = GROUP, heads: int = HEADS) -> DataFrame:
    """``conv_id, turns`` (fingerprint and words of every turn) of every rebuilt conversation."""
    rows = pick(conversations, [("conv_id", "long"), ("turn", "long"), ("role", "string"), ("text", "string")]).where("conv_id is not null")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    token = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    rows = rows.select(
        (F.col("conv_id") - F.col("conv_id") % group).alias("head"), "conv_id",
        F.struct("turn", token.alias("token"), n_words(text).alias("words")).alias("t"),
    ).repartition("head")  # a conversation and its head meet in one exchange
    own = rows.groupBy("head", "conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    own = own.select("head", "conv_id", F.transform("t", lambda t: F.struct(t["token"].alias("token"), t["words"].alias("words"))).alias("own"))
    of_head = F.max(F.when(F.col("conv_id") == F.col("head"), F.col("own"))).over(Window.partitionBy("head"))  # at most `group` rows
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(heads)).cast("int")
    both = own.select("conv_id", "own", of_head.alias("first"), h.alias("h"))
    none = F.array().cast(f"array<{_TURN}>")
    first = F.coalesce(F.slice("first", F.lit(1), F.col("h")), none)
    return both.select("conv_id", F.concat(first, F.slice("own", F.col("h") + 1, F.greatest(F.size("own"), F.lit(1)))).alias("turns"))


# ---------------------------------------------------------------- in a block --


class _Minima:
    """Sparse table: minima of ``values`` over runs of 1, 2, 4, ... entries."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while (half := 1 << (len(self.levels) - 1)) * 2 <= len(values):
            low = self.levels[-1]
            self.levels.append(np.minimum(low[:-half], low[half:]))

    def between(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Minima of ``values[first..last]``, both included."""
        out = np.empty(len(first), self.levels[0].dtype)
        level = np.frexp((last - first + 1).astype(np.float64))[1] - 1
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.levels[k][first[at]], self.levels[k][last[at] - (1 << int(k)) + 1])
        return out

    def reach_right(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The largest r >= at with ``values[at + 1 .. r] >= least``."""
        r, n = at.copy(), len(self.levels[0])
        for k in range(len(self.levels) - 1, -1, -1):
            fits = r + (1 << k) < n
            fits[fits] = self.levels[k][r[fits] + 1] >= least[fits]
            r[fits] += 1 << k
        return r

    def reach_left(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The smallest l <= at with ``values[l + 1 .. at] >= least``."""
        left = at.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            fits = left - (1 << k) >= 0
            fits[fits] = self.levels[k][left[fits] - (1 << k) + 1] >= least[fits]
            left[fits] -= 1 << k
        return left


def lcps(tokens: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Common leading turns of each row and the row before (first row: -1)."""
    sizes = np.diff(offsets)
    out = np.full(len(sizes), -1, np.int64)
    shared = np.minimum(sizes[1:], sizes[:-1])
    begin = np.cumsum(shared) - shared
    step = np.arange(shared.sum()) - np.repeat(begin, shared)
    a, b = tokens[np.repeat(offsets[1:-1], shared) + step], tokens[np.repeat(offsets[:-2], shared) + step]
    parted = np.flatnonzero((a != b).any(axis=1))
    row = np.searchsorted(begin + shared, parted, "right")  # rows without shared turns are passed over
    out[1:] = shared
    np.minimum.at(out, row + 1, step[parted])
    return out


def intervals(lcp: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last row, depth, and parent's depth of all different sets of members, in (first row, depth) order."""
    m = len(sizes)
    minima = _Minima(lcp)
    at = np.concatenate([np.arange(m), np.arange(1, m)])
    depth = np.concatenate([sizes, lcp[1:]])
    left, right = minima.reach_left(at, depth), minima.reach_right(at, depth)
    order = np.lexsort((depth, left))
    left, right, depth = left[order], right[order], depth[order]
    fresh = np.append(True, (np.diff(left) != 0) | (np.diff(depth) != 0))
    left, right, depth = left[fresh], right[fresh], depth[fresh]
    above = np.maximum(lcp[left], np.append(lcp, -1)[right + 1])
    return left, right, depth, above


def _path_keys(tokens: np.ndarray) -> list[bytes]:
    """Hashes of a row's prefixes of 0, 1, 2, ... turns."""
    state, out = hashlib.blake2b(digest_size=16), []
    out.append(state.digest())
    for token in tokens:
        state.update(token.tobytes())
        out.append(state.digest())
    return out


def _block(ids: np.ndarray, tokens: np.ndarray, offsets: np.ndarray, words: np.ndarray, edge: int) -> dict:
    """All nodes of one sorted block: closed ones, parts of open ones, and pieces of the open ones' conv_ids."""
    sizes, m = np.diff(offsets), len(ids)
    lcp = lcps(tokens, offsets)
    left, right, depth, above = intervals(lcp, sizes)
    n = right - left + 1
    smallest = _Minima(ids).between(left, right)
    # parents, and rows that end at an interval's depth (they come first in it)
    at = {key: i for i, key in enumerate(zip(left.tolist(), depth.tolist()))}
    parent_left = _Minima(lcp).reach_left(left, np.maximum(above, 0))
    parent = np.array([at[key] if key[1] >= 0 else -1 for key in zip(parent_left.tolist(), above.tolist())], np.int64)
    children = np.bincount(parent[parent >= 0], minlength=len(n))
    # an interval's nodes have depths above+1 .. depth; the edge rows' paths are open
    low, high = above + 1, depth
    count = high - low + 1
    of = np.repeat(np.arange(len(n)), count)
    d = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + low[of]
    opened = (left[of] == 0) | (right[of] == m - 1)
    word = np.where(d > 0, words[np.maximum(offsets[left[of]] + d - 1, 0)] if len(words) else 0, 0)
    own = np.where(opened, 0, (n[of] - 1) * word)
    below = children[of] * (d == high[of]) + (d < high[of])
    leaf = np.where(opened, 0, below == 0).astype(np.int64)
    # nodes are in (first row, depth) order: a subtree is a run
    end = np.searchsorted(left[of], right[of], "right")
    sums = lambda x: np.append(0, np.cumsum(x))
    spent, leaves = sums(own), sums(leaf)
    here = np.arange(len(of))
    saved, n_leaves = spent[end] - spent[here], leaves[end] - leaves[here]
    # a parent's smallest member: of the interval itself, or of the one above
    up = np.where(d > low[of], of, parent[of])
    up_id, up_open = smallest[np.maximum(up, 0)], (left[up] == 0) | (right[up] == m - 1)
    ends = {}
    first_of_run = np.append(True, (lcp[1:] < sizes[1:]) | (sizes[1:] != sizes[:-1]))
    starts = np.flatnonzero(first_of_run)
    for a, b in zip(starts.tolist(), np.append(starts[1:], m).tolist()):
        ends[(a, int(sizes[a]))] = (a, b)
    # children that other blocks may know too aren't counted here
    open_child = np.bincount(parent[(parent >= 0) & ((left == 0) | (right == m - 1))], minlength=len(n))
    closed_below = np.where(d == high[of], children[of] - open_child[of], 0)

    rows: dict[str, list] = {name: [] for name in _ARROW.names}

    def put(**values):
        for name, column in rows.items():
            column.append(values.get(name))

    def joined(key):
        a, b = ends.get(key, (0, 0))
        return ",".join(map(str, ids[a:b].tolist()))

    paths = (_path_keys(tokens[offsets[0] : offsets[1]]), _path_keys(tokens[offsets[m - 1] : offsets[m]]))
    both = int(lcp[1:].min()) if m > 1 else int(sizes[0])  # depths that the first and the last row share
    for i in here.tolist():
        u, depth_i = int(of[i]), int(d[i])
        key = (int(left[u]), depth_i)
        if not opened[i]:
            text = joined(key) if depth_i == high[u] else ""
            keys = paths[0] if left[up[i]] == 0 else paths[1]
            put(
                kind=CLOSED, conv_id=int(smallest[u]), depth=depth_i, n_convs=int(n[u]), n_children=int(below[i]), n_leaves=int(n_leaves[i]), saved_tokens=int(saved[i]),
                ends=hashlib.sha256(text.encode()).hexdigest() if text else _EMPTY,
                parent_conv_id=None if up_open[i] else int(up_id[i]), parent_key=keys[depth_i - 1] if up_open[i] else None,
            )
            continue
        side = 0 if left[u] == 0 else 1
        keys = paths[side]
        part = dict(kind=OPEN, conv_id=int(smallest[u]), depth=depth_i, key=keys[depth_i], parent_key=keys[depth_i - 1] if depth_i else None, words=int(word[i]))
        put(**part, edge=edge + side, n_convs=int(n[u]), n_children=int(closed_below[i]), n_leaves=int(n_leaves[i]), saved_tokens=int(saved[i]))
        if side == 0 and depth_i <= both and m > 1:  # the last row is a member too
            put(**part, edge=edge + 1, n_convs=0, n_children=0, n_leaves=0, saved_tokens=0)
        if depth_i == high[u]:
            a, b = ends.get(key, (0, 0))
            step = max(1, PIECE // 20)
            for k in range(a, b, step):
                put(kind=ENDS, key=keys[depth_i], edge=edge, depth=k, ends=",".join(map(str, ids[k : min(k + step, b)].tolist())))
    return rows


def _cut(block_turns: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = 0

        def close(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal made
            table = pa.Table.from_batches(held).combine_chunks()
            turns = table.column("turns").chunk(0)
            flat = turns.flatten()
            offsets = np.asarray(turns.offsets).astype(np.int64)
            raw = flat.field("token")
            tokens = np.frombuffer(raw.buffers()[2] or b"", np.uint64)[2 * raw.offset : 2 * (raw.offset + len(raw))].reshape(-1, 2)
            words = flat.field("words").to_numpy(zero_copy_only=False).astype(np.int64)
            ids = table.column("conv_id").to_numpy().astype(np.int64)
            # edges are numbered in the order of rows: partition, block, side
            edge = (TaskContext.get().partitionId() << 32) + 2 * made
            made += 1
            yield from pa.table(_block(ids, tokens, offsets - offsets[0], words, edge), schema=_ARROW).to_batches(max_chunksize=50_000)

        held, turns = [], 0
        for batch in batches:
            while batch.num_rows:
                column = batch.column("turns")
                upto = np.asarray(column.offsets).astype(np.int64)
                upto = upto - upto[0]
                fits = int(np.searchsorted(upto, block_turns - turns, "right")) - 1
                take = min(batch.num_rows, max(fits, 0 if held else 1))
                if take:
                    held.append(batch.slice(0, take))
                    turns += int(upto[take])
                    batch = batch.slice(take)
                if batch.num_rows or turns >= block_turns:
                    yield from close(held)
                    held, turns = [], 0
        if held:
            yield from close(held)

    return task


# ---------------------------------------------------------------- over blocks --


def _digests(pieces: DataFrame) -> DataFrame:
    """``key, ends``: the hash of a node's joined pieces, streamed in their order."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            done: tuple[list, list] = ([], [])
            for k, text in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist()):
                if k != key:
                    if state is not None:
                        done[0].append(key), done[1].append(state.hexdigest())
                    key, state = k, hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
            yield pa.record_batch([pa.array(done[0], pa.binary()), pa.array(done[1], pa.string())], names=["key", "ends"])
        if state is not None:
            yield pa.record_batch([pa.array([key], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["key", "ends"])

    dealt = pieces.select("key", "edge", "depth", "ends").repartition("key").sortWithinPartitions("key", "edge", "depth").select("key", "ends")
    return dealt.mapInArrow(task, "key binary, ends string")


def _opened(parts: DataFrame) -> DataFrame:
    """Nodes on the blocks' edge rows, added up over the blocks."""
    part = parts.where(F.col("kind") == OPEN)
    total = lambda c: F.sum(c).alias(c)
    nodes = part.groupBy("key").agg(
        F.first("depth").alias("depth"), F.first("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.max("words").alias("words"),
        F.min("edge").alias("first"), F.max("edge").alias("last"), *[total(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
    )
    nodes = written(nodes, "trie-open")
    kids = nodes.where("depth > 0").groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("open_children"), F.max("depth").alias("_d"))
    nodes = nodes.join(kids.drop("_d"), "key", "left")
    nodes = nodes.withColumn("n_children", F.col("n_children") + F.coalesce("open_children", F.lit(0)))
    nodes = nodes.withColumns({"own": (F.col("n_convs") - 1) * F.col("words"), "leaf": (F.col("n_children") == 0).cast("long")})
    # running sums over the edge rows, in order: each brings in the nodes below what it shares with the one before
    deeper = Window.partitionBy("first").orderBy(F.desc("depth"))  # one conversation's path
    nodes = nodes.withColumns({"own_below": F.sum("own").over(deeper), "leaf_below": F.sum("leaf").over(deeper)})
    nodes = written(nodes, "trie-open")
    brought = nodes.groupBy(F.col("first").alias("edge")).agg(F.sum("own").alias("own"), F.sum("leaf").alias("leaf"))
    edges = part.select("edge").distinct().join(brought, "edge", "left")
    rows = Window.orderBy("edge")  # two rows for each block of `block_turns` turns
    so_far = edges.select("edge", *[F.sum(F.coalesce(c, F.lit(0))).over(rows).alias(c) for c in ("own", "leaf")])
    a, b = (so_far.select(*[F.col(c).alias(f"{c}_{side}") for c in so_far.columns]) for side in ("first", "last"))
    nodes = nodes.join(a, nodes["first"] == a["edge_first"]).join(b, nodes["last"] == b["edge_last"])
    return nodes.withColumns({
        "n_leaves": F.col("n_leaves") + F.col("leaf_below") + F.col("leaf_last") - F.col("leaf_first"),
        "saved_tokens": F.col("saved_tokens") + F.col("own_below") + F.col("own_last") - F.col("own_first"),
    })


def trie(conversations: DataFrame, group: int = GROUP, heads: int = HEADS, block_turns: int = BLOCK_TURNS, partitions: int | None = None) -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``."""
    convs = written(rebuilt(conversations, group, heads), "trie-convs")
    by: list[Column | str] = [F.transform("turns", lambda t: t["token"]), F.col("conv_id")]
    ordered = convs.repartitionByRange(partitions, *by) if partitions else convs.repartitionByRange(*by)
    parts = written(ordered.sortWithinPartitions(*by).select("conv_id", "turns").mapInArrow(_cut(block_turns), _OUT), "trie-parts")
    opened = written(_opened(parts), "trie-opened")
    ids = opened.select("key", F.col("conv_id").alias("above"))
    ids = F.broadcast(ids) if small_enough(ids, MAX_BROADCAST) else ids
    counts = ("n_convs", "n_children", "n_leaves", "saved_tokens")
    closed = parts.where(F.col("kind") == CLOSED)
    inner = closed.where("parent_key is null").select("conv_id", "depth", "parent_conv_id", *counts, F.col("ends").alias("ends_sha256"))
    under = closed.where("parent_key is not null").alias("c").join(ids.alias("i"), F.col("c.parent_key") == F.col("i.key"))
    under = under.select("c.conv_id", "c.depth", F.col("i.above").alias("parent_conv_id"), *[f"c.{c}" for c in counts], F.col("c.ends").alias("ends_sha256"))
    outer = opened.alias("c").join(ids.alias("i"), F.col("c.parent_key") == F.col("i.key"), "left")
    outer = outer.join(_digests(parts.where(F.col("kind") == ENDS)).alias("e"), F.col("c.key") == F.col("e.key"), "left")
    outer = outer.select(
        "c.conv_id", "c.depth", F.col("i.above").alias("parent_conv_id"), *[f"c.{c}" for c in counts], F.coalesce("e.ends", F.lit(_EMPTY)).alias("ends_sha256")
    )
    return inner.unionByName(under).unionByName(outer)
