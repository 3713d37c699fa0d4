"""Operator 9: embedding near-duplicates by a subspace pigeonhole join.

For unit vectors cos(x, y) >= t means |x - y|^2 <= 2 - 2t. The vectors are rotated
(principal axes of a bounded sample; any rotation keeps distances) and
split into blocks of ``WIDTH`` coordinates; the squared-distance budget is shared among the
blocks in proportion to their variance. The block distances add up to the whole, so a pair within
the budget is within the share of at least one block: the range join of each block finds it there.

A block's space is cut into boxes by medians of the sample (k-d tree, ``BOX_SAMPLE`` of the sample
for each box as far as ``SAMPLE_BYTES`` go), as many as leave about ``LEAF`` vectors a box. The vectors of each box
are counted, and a box of more than ``LEAF`` is dealt by a hash into pieces of about ``LEAF`` at most.
A vector goes to the tile of its own piece and, for each
other piece of a box that is within the block's share of it, to the tile of the two pieces.
A tile compares the rows of one piece with those of the other by matrix products,
and verifies what is within the share exactly, on the whole vectors in double
precision. A pair counts only in the first block whose share, and ``EDGE`` more, holds it, so
link counts add up. A tile returns a row per vector (weighted number of links and the
smallest vector that its links reach in the tile), not its pairs, which are added to counts and a
union-find as they are found.

Equal vectors are one class, compared once and weighted by their number.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite
components link with nothing (n_links 0, their own component); vectors of different length never link;
a null vec_id takes part but never names a component; repeated rows count as vectors of their own;
vectors of very small or large components are scaled by powers of two first, which changes no cosine;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardstat.llm import textbytes as tb
from wardstat.llm.components import components
from wardstat.llm.tables import written

THRESHOLD = 0.9
WIDTH = 16
LEAF = 16_384
SAMPLE = 4096  # in expectation, at least
BOX_SAMPLE = 16
SAMPLE_BYTES = 1 << 27
CHUNK = 1024
SLACK = 1e-4
#: what a block's share is exceeded by at most in a pair that it holds: over rounding in double, under SLACK
EDGE = 1e-6


class Plan:
    """Rotation, blocks, shares of the budget and boxes, fitted to a sample of unit vectors."""

    def __init__(self, sample: np.ndarray, n: int, threshold: float, width: int, leaf: int):
        self.dims = sample.shape[1]
        self.threshold = threshold
        centred = sample - sample.mean(axis=0)
        values, axes = np.linalg.eigh(centred.T @ centred / max(len(sample), 1))
        # strong axes are dealt out over the blocks in turn
        blocks = -(-self.dims // width)
        order = np.argsort(-values, kind="stable")
        dealt = np.concatenate([order[k::blocks] for k in range(blocks)])
        self.rotation = axes[:, dealt]
        sizes = [len(order[k::blocks]) for k in range(blocks)]
        self.edges = np.append(0, np.cumsum(sizes))
        energy = np.array([max(values[order[k::blocks]].sum(), 1e-12) for k in range(blocks)])
        self.shares = (2 - 2 * threshold) * energy / energy.sum()
        turned = sample @ self.rotation
        self.trees = [_boxes(turned[:, a:b], _depth(n, leaf)) for a, b in zip(self.edges, self.edges[1:])]
        self.split([], leaf)

    def split(self, counts: list[tuple[int, int, int]], leaf: int) -> None:
        """Number the boxes' pieces: one each, and more for those of ``counts`` (block, box, vectors)."""
        self.pieces = [np.ones(len(lo), np.int64) for lo, _ in self.trees]
        for block, box, n in counts:
            self.pieces[block][box] = -(-n // leaf)
        self.begins = [np.cumsum(p) - p for p in self.pieces]


def _depth(n: int, leaf: int) -> int:
    return max(0, int(np.ceil(np.log2(max(n, 1) / leaf))))


def _boxes(points: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper corners of 2^depth boxes that cover the space."""
    width = points.shape[1]
    boxes = [(np.full(width, -np.inf), np.full(width, np.inf), points)]
    for _ in range(depth):
        cut = []
        for lo, hi, inside in boxes:
            axis = int(np.argmax(inside.var(axis=0))) if len(inside) > 1 else 0
            at = float(np.median(inside[:, axis])) if len(inside) else 0.0
            left_hi, right_lo = hi.copy(), lo.copy()
            left_hi[axis] = right_lo[axis] = min(max(at, lo[axis]), hi[axis])
            cut += [(lo, left_hi, inside[inside[:, axis] < at]), (right_lo, hi, inside[inside[:, axis] >= at])]
        boxes = cut
    return np.array([b[0] for b in boxes]), np.array([b[1] for b in boxes])


def _gaps(points: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Squared distances of points to boxes."""
    out = np.empty((len(points), len(lo)))
    for k in range(len(lo)):
        d = np.maximum(np.maximum(lo[k] - points, points - hi[k]), 0)
        out[:, k] = (d * d).sum(axis=1)
    return out


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows scaled by powers of two (exactly) to a largest component of about 1, so that no square leaves the range of doubles."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0.0))[1][:, None])


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _parts(plan: Plan, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray]]:
    """Rows of a batch, as many as suit the number of boxes, and their squared distances to each block's boxes."""
    step = max(1, (1 << 21) // len(plan.trees[0][0]))
    for batch in batches:
        for i in range(0, batch.num_rows, step):
            some = batch.slice(i, step)
            turned = _unit(_vectors(some.column("vec"), plan.dims)) @ plan.rotation
            for block, (lo, hi) in enumerate(plan.trees):
                yield some, block, _gaps(turned[:, plan.edges[block] : plan.edges[block + 1]], lo, hi)


def _count(plan: Plan):
    """Vectors of each box."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(len(lo), np.int64) for lo, _ in plan.trees]
        for _, block, gaps in _parts(plan, batches):
            held[block] += np.bincount(gaps.argmin(axis=1), minlength=len(held[block]))
        for block, n in enumerate(held):
            box = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(box), block, np.int32)), pa.array(box.astype(np.int32)), pa.array(n[box])], ["block", "box", "n"])

    return run


def _deal(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, block, gaps in _parts(plan, batches):
            pieces, begins = plan.pieces[block], plan.begins[block]
            home = gaps.argmin(axis=1)
            mixed = tb.mix64(some.column("cls").to_numpy().view(np.uint64) + np.uint64(block))
            mine = begins[home] + (mixed % pieces[home].astype(np.uint64)).astype(np.int64)
            row, box = np.nonzero(gaps <= plan.shares[block] + SLACK)
            times = pieces[box]
            upto = np.cumsum(times)
            for k in range(0, int(upto[-1]) if len(upto) else 0, 1 << 14):
                nth = np.arange(k, min(k + (1 << 14), int(upto[-1])))
                hit = np.searchsorted(upto, nth, "right")
                at = row[hit]
                own, other = mine[at], begins[box[hit]] + nth - (upto[hit] - times[hit])
                out = some.take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(nth), block, np.int32)), *(pa.array(c.astype(np.int32)) for c in (np.minimum(own, other), np.maximum(own, other), own)), *out.columns],
                    ["block", "a", "b", "home", *some.schema.names],
                )

    return run


def _first_holder(plan: Plan, turned: np.ndarray, unit: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The first block that holds each pair, the same in every tile."""
    limit = plan.shares + EDGE
    parts = np.add.reduceat((turned[x] - turned[y]) ** 2, plan.edges[:-1], axis=1)
    # matrix products may round otherwise in another tile: what is that near is summed in a fixed order
    close = np.flatnonzero((np.abs(parts - limit) < 1e-9).any(axis=1))
    if len(close):
        d = unit[x[close]] - unit[y[close]]
        along = np.zeros_like(d)
        for k in range(plan.dims):
            along += d[:, k : k + 1] * plan.rotation[k]
        parts[close] = 0
        for block, (a, b) in enumerate(zip(plan.edges, plan.edges[1:])):
            for k in range(a, b):
                parts[close, block] += along[:, k] ** 2
    return (parts <= limit).argmax(axis=1)


def _tile(plan: Plan):
    def run(table: pa.Table) -> pa.Table:
        block, a, b = (table.column(c)[0].as_py() for c in ("block", "a", "b"))
        home = table.column("home").to_numpy()
        order = np.argsort(home, kind="stable")
        table = table.take(pa.array(order))
        home = home[order]
        node, weight = table.column("cls").to_numpy(), table.column("n").to_numpy()
        vec = _scaled(_vectors(table.column("vec").combine_chunks(), plan.dims))
        norm = np.sqrt(np.einsum("ij,ij->i", vec, vec))
        unit = vec / norm[:, None]
        turned = unit @ plan.rotation
        s = turned[:, plan.edges[block] : plan.edges[block + 1]].astype(np.float32)
        square = (s * s).sum(axis=1)
        first = int(np.searchsorted(home, a, "right")) if a != b else len(home)
        share = np.float32(plan.shares[block] + SLACK)
        links, parent = np.zeros(len(home), np.int64), np.arange(len(home))
        for i in range(0, first, CHUNK):
            top = min(i + CHUNK, first)
            begin = first if a != b else i
            for j in range(begin, len(home), CHUNK * 4):
                end = min(j + CHUNK * 4, len(home))
                near = square[i:top, None] + square[j:end] - 2 * (s[i:top] @ s[j:end].T) <= share
                p, q = np.nonzero(near)
                p, q = p + i, q + j
                if a == b:
                    p, q = p[p < q], q[p < q]
                for k in range(0, len(p), 1 << 16):
                    x, y = p[k : k + (1 << 16)], q[k : k + (1 << 16)]
                    ok = np.einsum("ij,ij->i", vec[x], vec[y]) / (norm[x] * norm[y]) >= plan.threshold
                    x, y = x[ok], y[ok]
                    if len(x):  # counted in the first block that holds the pair
                        ok = _first_holder(plan, turned, unit, x, y) == block
                        x, y = x[ok], y[ok]
                    np.add.at(links, x, weight[y])
                    np.add.at(links, y, weight[x])
                    parent = _united(parent, x, y)
        low = node.copy()
        np.minimum.at(low, parent, node)
        keep = links > 0
        return pa.table({"cls": pa.array(node[keep]), "links": pa.array(links[keep]), "root": pa.array(low[parent][keep])})

    return run


def _united(parent: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``parent`` (every row's root) once the rows x and y are linked."""
    while True:
        p, q = parent[x], parent[y]
        apart = p != q
        if not apart.any():
            return parent
        x, y, p, q = x[apart], y[apart], p[apart], q[apart]
        parent = parent.copy()
        np.minimum.at(parent, np.maximum(p, q), np.minimum(p, q))
        while not np.array_equal(up := parent[parent], parent):
            parent = up


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH, leaf: int = LEAF) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors`` (``vec_id, embedding``)."""
    e = F.col("embedding")
    whole = e.isNotNull() & (F.size(e) > 0) & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(e, lambda v: v != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("embedding")).withColumn("ok", F.coalesce(whole, F.lit(False)))
    key = [F.xxhash64("embedding").alias("k1"), F.xxhash64(F.lit(1), "embedding").alias("k2")]
    keyed = rows.where("ok").select("vec_id", "embedding", *key)
    # a class is named by its smallest vec_id; classes without one get a name below all ids
    classes = keyed.groupBy("k1", "k2").agg(F.min("vec_id").alias("low"), F.count("*").alias("n"), F.first("embedding").alias("vec"))
    name = F.coalesce("low", F.lit(-(1 << 62)) - F.shiftrightunsigned("k1", 2))
    classes = written(classes.select("k1", "k2", "low", name.alias("cls"), "n", "vec"), "vectors")
    sizes = classes.groupBy(F.size("vec").alias("dims")).count().collect()
    links = None
    for dims, n in sorted((r["dims"], r["count"]) for r in sizes):  # a length has a join of its own
        same = classes.where(F.size("vec") == dims)
        u = F.pmod(F.xxhash64("k1", "k2"), F.lit(1 << 30)) / float(1 << 30)
        most = max(SAMPLE, min(BOX_SAMPLE << _depth(n, leaf), SAMPLE_BYTES // (8 * dims)))
        sample = same.where(u < min(1.0, most / n)).limit(2 * most).select("vec").toArrow()
        sample = sample if sample.num_rows else same.limit(1).select("vec").toArrow()
        plan = Plan(_unit(_vectors(sample.column("vec").combine_chunks(), dims)), n, threshold, width, leaf)
        kind = dict(same.dtypes)["vec"]
        counts = same.select("vec").mapInArrow(_count(plan), "block int, box int, n long").groupBy("block", "box").agg(F.sum("n").alias("n"))
        plan.split([tuple(r) for r in counts.where(F.col("n") > leaf).collect()], leaf)
        dealt = same.select("cls", "n", "vec").mapInArrow(_deal(plan), f"block int, a int, b int, home int, cls long, n long, vec {kind}")
        found = dealt.groupBy("block", "a", "b").applyInArrow(_tile(plan), "cls long, links long, root long")
        links = found if links is None else links.unionByName(found)
    if links is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    links = written(links, "vector-links")
    joined = components(links.select(F.col("cls").alias("a"), F.col("root").alias("b")))
    # the smallest id of a component: a class without an id is never its name
    member = written(classes.select("k1", "k2", "cls", "low", "n").join(joined.select(F.col("node").alias("cls"), "component"), "cls", "left").withColumn("component", F.coalesce("component", "cls")), "vector-members")
    names = member.groupBy("component").agg(F.min("low").alias("component_id"))
    per = links.groupBy("cls").agg(F.sum("links").alias("links"))
    full = (
        member.join(names, "component").join(per, "cls", "left")
        .select("k1", "k2", "component_id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    )
    good = keyed.select("vec_id", "k1", "k2").join(full, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    bad = rows.where(~F.col("ok")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(bad).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
