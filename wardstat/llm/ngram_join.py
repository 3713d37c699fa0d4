"""Operator 1: n-gram Jaccard join by grouped prefixes.

A document's set holds its distinct shingles of ``SHINGLE`` words (64-bit
fingerprints). Documents with equal sets are one set. In an order of all
shingles, two sets of Jaccard similarity t or more share one of their first
n - ceil(t n) + 1 shingles (their prefixes). The order puts frequent shingles last:
each task counts the shingles of its documents, counts above one are added up by Spark,
and at most ``LISTED`` of the most frequent are broadcast with the power of two of their
count; the rest follow by fingerprint. Any such order is exact; a better one only
makes fewer candidates.

Sets with the same size and prefix are collapsed into one group; the
prefix join works on groups:

* lists: the groups of a shingle, sorted end to end with all other lists into ranges of about equal
  size, so that a shingle of very many groups is no task's alone.
* neighbours: in each shingle's list of groups (by size, then in one of ``ORDERS`` random
  orders) a group is paired with the one before it and with the list's centre (the group of which most
  of the prefix is in lists, as it is with the text that others are copies of), and in each group a set
  with the group's first; pairs that pass the length, positional and bitmap bounds are verified on the
  whole sets. This is linear in the lists, and its links already join most copies.
* the rest: lists whose groups all lie in one component hold no link between
  components and are done. In the others, all pairs of groups with different components
  that pass the bounds (sizes meet by bands, within the join's key) are expanded to their sets and verified.

Pairs inside a component are not needed for the result, so a group of many
near copies costs as many pairs as it has copies, and no link between
components is lost.

Defined cases: null, empty and wordless texts have an empty set and link with
nothing (their component is their own id); repeated rows and rows of one id with
different texts are documents of their own, named by doc_id; a null doc_id takes part
through equal sets only and never names a component; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardstat.llm import textbytes as tb
from wardstat.llm.components import components
from wardstat.llm.tables import documents, small_enough, written

SHINGLE = 5
PERCENT = 80
LISTED = 1 << 20
BROADCAST_IDS = 1 << 20
ORDERS = 4

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PLACE = tb.mix64(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle fingerprints of each row, one row after the other, and their numbers."""
    n_rows = len(offsets) - 1
    folded = _FOLD[data]
    word = ~_SPACE[data]
    begins, ends = word.copy(), word.copy()
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    begins[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    begins[inner] = word[inner]
    ends[inner - 1] = word[inner - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    if not len(start):
        return np.empty(0, np.uint64), np.zeros(n_rows, np.int64)
    row = np.searchsorted(offsets, start, "right") - 1
    words = tb.fingerprints(tb.running(folded), start, end)
    per_row = np.bincount(row, minlength=n_rows)
    n = len(words)
    full = np.flatnonzero(row[: n - size + 1] == row[size - 1 :]) if n >= size else np.empty(0, np.int64)
    sums = np.zeros(len(full), np.uint64)
    for k in range(size):
        sums += words[full + k] * _PLACE[k]
    few = np.flatnonzero((per_row > 0) & (per_row < size))
    first = np.searchsorted(row, few)
    short = np.zeros(len(few), np.uint64)
    for k in range(size - 1):
        has = per_row[few] > k
        short[has] += words[first[has] + k] * _PLACE[k]
    short += per_row[few].astype(np.uint64) * _PLACE[size]
    prints = tb.mix64(np.concatenate([sums, short]))
    owner = np.concatenate([row[full], few])
    order = np.argsort(owner, kind="stable")
    prints, owner = prints[order], owner[order]
    edge = np.searchsorted(owner, np.arange(n_rows + 1))
    out, counts = [], np.zeros(n_rows, np.int64)
    for k in np.flatnonzero(np.diff(edge)):
        own = np.sort(prints[edge[k] : edge[k + 1]])
        own = own[np.append(True, own[1:] != own[:-1])]
        out.append(own)
        counts[k] = len(own)
    return np.concatenate(out), counts


def _signatures(prints: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two order-free 64-bit sums for each row's set."""
    ends = np.cumsum(counts)
    two = []
    for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
        sums = np.append(np.uint64(0), np.cumsum(tb.mix64(prints ^ np.uint64(salt))))
        two.append((sums[ends] - sums[ends - counts]).view(np.int64))
    return two[0], two[1]


def _ids(batch: pa.RecordBatch) -> pa.Array:
    return batch.column("doc_id")


def _blocks(batches: Iterator[pa.RecordBatch]):
    """``doc ids, fingerprints, numbers`` of blocks of rows."""
    for batch in batches:
        data, offsets = tb.texts(batch.column("text"))
        for i, j in tb.blocks(offsets):
            prints, counts = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            yield batch.slice(i, j - i), prints, counts
    pa.default_memory_pool().release_unused()  # the worker lives on


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document (kind 0), and the shingles that the task met more than once (kind 1)."""
    often = {"at": np.empty(0, np.uint64), "n": np.empty(0, np.int64)}

    def out(kind, ids, n, k1, k2, row):
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(n), kind, np.int32)), ids, pa.array(n), pa.array(k1), pa.array(k2), row], ["kind", "id", "n", "k1", "k2", "row"]
        )

    for batch, prints, counts in _blocks(batches):
        yield out(0, _ids(batch), counts, *_signatures(prints, counts), batch.column("row"))
        ordered = np.sort(prints)
        edge = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.empty(0, np.int64)
        times = np.diff(np.append(edge, len(ordered)))
        some = times > 1
        at = np.concatenate([often["at"], ordered[edge[some]]])
        n = np.concatenate([often["n"], times[some]])
        often["at"], back = np.unique(at, return_inverse=True)
        often["n"] = np.bincount(back, n, len(often["at"])).astype(np.int64)
    if len(often["at"]):
        zero = np.zeros(len(often["at"]), np.int64)
        yield out(1, pa.array(often["at"].view(np.int64)), often["n"], zero, zero, pa.array(zero))


class Order:
    """The order of shingles: by level of frequency, then by fingerprint."""

    def __init__(self, prints: np.ndarray, levels: np.ndarray):
        rank = np.argsort(prints)
        self.prints, self.levels = prints[rank], levels[rank]
        self.seen = np.zeros(1 << 24, bool)  # spares most look-ups
        self.seen[self.prints >> np.uint64(40)] = True

    def level(self, prints: np.ndarray) -> np.ndarray:
        out = np.zeros(len(prints), np.int8)
        maybe = np.flatnonzero(self.seen[prints >> np.uint64(40)])
        if len(maybe) and len(self.prints):
            slot = np.minimum(np.searchsorted(self.prints, prints[maybe]), len(self.prints) - 1)
            hit = self.prints[slot] == prints[maybe]
            out[maybe[hit]] = self.levels[slot[hit]]
        return out


_ORDERS: dict[int, Order] = {}


def _order(shared) -> Order:
    if shared.id not in _ORDERS:
        _ORDERS.clear()
        _ORDERS[shared.id] = Order(*shared.value)
    return _ORDERS[shared.id]


class _Shared:
    """A broadcast and a key by which workers keep what they make of it."""

    def __init__(self, spark, value):
        self.held = spark.sparkContext.broadcast(value)
        self.id = self.held._jbroadcast.id() if hasattr(self.held, "_jbroadcast") else id(value)

    def __getstate__(self):
        return {"held": self.held, "id": self.id}

    @property
    def value(self):
        return self.held.value


def prefix_length(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    return n - (n * percent + 99) // 100 + 1


def _prefixes(shared, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = _order(shared)
        for batch, prints, counts in _blocks(batches):
            level = order.level(prints)
            ends = np.cumsum(counts)
            keep = np.minimum(prefix_length(counts, percent), counts)
            keep[counts == 0] = 0
            parts = []
            for k in np.flatnonzero(counts):
                a, e = ends[k] - counts[k], ends[k]
                own, lv = prints[a:e], level[a:e]
                parts.append(own[: keep[k]] if not lv.any() else own[np.argsort(lv, kind="stable")[: keep[k]]])
            flat = np.concatenate(parts) if parts else np.empty(0, np.uint64)
            g1, g2 = _signatures(flat, keep)
            k1, k2 = _signatures(prints, counts)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(keep)).astype(np.int32)), pa.array(flat.view(np.int64)))
            bits = pa.array([parity(prints[e - c : e]) for c, e in zip(counts, ends)], pa.binary())
            some = pa.array(counts > 0)
            yield pa.RecordBatch.from_arrays(
                [_ids(batch), pa.array(counts), pa.array(k1), pa.array(k2), pa.array(g1), pa.array(g2), lists, bits], ["doc_id", "n", "k1", "k2", "g1", "g2", "prefix", "bits"]
            ).filter(some)

    return run


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole sets."""
    for batch, prints, counts in _blocks(batches):
        ends = np.cumsum(counts)
        k1, k2 = _signatures(prints, counts)
        sets = pa.array([prints[e - c : e].tobytes() for c, e in zip(counts, ends)], pa.binary())
        yield pa.RecordBatch.from_arrays([_ids(batch), pa.array(k1), pa.array(k2), sets], ["doc_id", "k1", "k2", "prints"])


def parity(prints: np.ndarray) -> bytes:
    """A bitmap of about two bits a shingle; bit h holds the parity of the shingles that hash to h."""
    size = max(64, 1 << int(2 * max(len(prints), 1) - 1).bit_length())
    odd = (np.bincount((prints % np.uint64(size)).astype(np.int64), minlength=size) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").tobytes()


def differ_at_least(a: bytes, b: bytes) -> int:
    """A lower bound of the symmetric difference of two sets by their bitmaps."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _may_link(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for na, nb, a, b in zip(batch.column("na").to_pylist(), batch.column("nb").to_pylist(), batch.column("bits_a").to_pylist(), batch.column("bits_b").to_pylist()):
                # similar sets differ in at most (na + nb) (100 - t) / (100 + t) shingles
                keep.append(differ_at_least(a, b) * (100 + percent) <= (na + nb) * (100 - percent))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b")):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([p, q]))
                same = int((both[1:] == both[:-1]).sum())
                keep.append(100 * same >= percent * (len(p) + len(q) - same))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))
        pa.default_memory_pool().release_unused()  # the worker lives on, without the whole sets

    return run


def _checked(pairs: DataFrame, sets: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` (set names) that link: by their bitmaps first, then by the
    whole sets of those that are left, made anew from the texts."""
    small = sets.select("rep", "n", "bits")
    one = small.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("bits").alias("bits_a"))
    two = small.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bits_b"))
    near = pairs.join(one, "a").join(two, "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    maybe = written(near.select("a", "b", "na", "nb", "bits_a", "bits_b").mapInArrow(_may_link(percent), "a long, b long").distinct(), "ngram-maybe")
    if not maybe.limit(1).count():
        return maybe
    names = maybe.select(F.col("a").alias("rep")).unionByName(maybe.select(F.col("b").alias("rep"))).distinct()
    wanted = written(sets.join(names, "rep", "left_semi").select("rep", "k1", "k2"), "ngram-wanted")
    ids = wanted.select(F.col("rep").alias("doc_id")).distinct()
    ids = F.broadcast(ids) if small_enough(ids, BROADCAST_IDS) else ids
    contents = docs.join(ids, "doc_id", "left_semi").mapInArrow(_contents, "doc_id long, k1 long, k2 long, prints binary")
    whole = contents.withColumnRenamed("doc_id", "rep").join(wanted, ["rep", "k1", "k2"], "left_semi").dropDuplicates(["rep", "k1", "k2"])
    whole = written(whole.select("rep", "prints"), "ngram-contents")
    both = maybe.join(whole.select(F.col("rep").alias("a"), F.col("prints").alias("set_a")), "a").join(
        whole.select(F.col("rep").alias("b"), F.col("prints").alias("set_b")), "b"
    )
    return written(both.select("a", "b", "set_a", "set_b").mapInArrow(_verify(percent), "a long, b long").distinct(), "ngram-links")


def frequent(counts: DataFrame, most: int = LISTED) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints and levels (powers of two of the count) of at most ``most`` frequent shingles."""
    level = F.floor(F.log2(F.col("n").cast("double"))).cast("int")
    totals = written(counts.groupBy("id").agg(F.sum("n").alias("n")).select("id", level.alias("level")), "ngram-counts")
    room, cut = most, None
    for row in sorted(totals.groupBy("level").count().collect(), key=lambda r: -r["level"]):
        room -= row["count"]
        if room < 0:
            break
        cut = row["level"]
    if cut is None:
        return np.empty(0, np.uint64), np.empty(0, np.int8)
    got = totals.where(F.col("level") >= cut).toArrow()
    return got.column("id").to_numpy().view(np.uint64), np.minimum(got.column("level").to_numpy(), 120).astype(np.int8)


_PLACE_COLUMNS = ("token", "gid", "n", "pos")
_LISTED = "token long, gid long, n int, pos int, p_gid long, p_n int, p_pos int, more boolean, edge int, part int"


def _before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each place with the one before it in its token's list, as far as this task's rows tell; ``more``: the list
    goes on. ``edge`` is 1 for the task's first row, 2 for its last, 3 for an only one; these stay in any case."""
    names = [f.split()[0] for f in _LISTED.split(", ")]
    part = TaskContext.get().partitionId()
    held: list[np.ndarray] | None = None  # the last row so far, after the one before it (if any)
    first = True

    def told(rows: list[np.ndarray], at: slice, edge: np.ndarray, more: np.ndarray) -> pa.RecordBatch:
        same = np.append(False, rows[0][1:] == rows[0][:-1])
        same_here, place = same[at], np.arange(len(same))[at]
        keep = same_here | more | (edge > 0)
        own = [pa.array(x[at][keep]) for x in rows]
        prior = [pa.array(x[place - 1][keep], mask=~same_here[keep]) for x in rows[1:]]
        flags = [pa.array(more[keep]), pa.array(edge[keep].astype(np.int32)), pa.array(np.full(int(keep.sum()), part, np.int32))]
        return pa.record_batch([*own, *prior, *flags], names=names)

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [batch.column(c).to_numpy(zero_copy_only=False) for c in _PLACE_COLUMNS]
        skip = 0
        if held is not None:
            skip = len(held[0]) - 1  # the held row's place
            rows = [np.concatenate([h, x]) for h, x in zip(held, rows)]
        size = len(rows[0])
        if size - 1 > skip:
            edge = np.zeros(size - 1 - skip, np.int32)
            edge[0] = 1 if first else 0
            more = rows[0][skip + 1 :] == rows[0][skip:-1]
            yield told(rows, slice(skip, size - 1), edge, more)
            first = False
        held = [x[-2:] if size > 1 else x for x in rows]
    if held is not None:
        size = len(held[0])
        yield told(held, slice(size - 1, size), np.array([3 if first else 2], np.int32), np.zeros(1, bool))


def listed_places(places: DataFrame) -> DataFrame:
    """``token, gid, n, pos`` of the lists of two groups or more, with the group before it in its list (``p_gid, p_n, p_pos``).

    Lists are in order of size, then in one of a few random orders (so that lists with the same groups give
    the same neighbours). They lie end to end in ranges, so one token's list may run over many tasks; what
    meets at the ends of ranges is joined up from two rows for each."""
    order = [F.col("token"), F.col("n"), F.xxhash64("gid", F.pmod("token", F.lit(ORDERS))), F.col("gid")]
    ranged = places.select("token", "gid", "n", "pos").repartitionByRange(*order).sortWithinPartitions(*order)
    seen = written(ranged.mapInArrow(_before, _LISTED), "ngram-listed")
    out = ["token", "gid", "n", "pos", "p_gid", "p_n", "p_pos"]
    ends = Window.orderBy("part", "edge")  # two rows for each task
    begins, closes = F.col("edge") != 2, F.col("edge") != 1
    met = begins & (F.lag("token").over(ends) == F.col("token"))
    goes_on = F.when(closes, F.lead("token").over(ends) == F.col("token")).otherwise(F.col("more"))
    edges = seen.where("edge > 0").select(
        "token", "gid", "n", "pos",
        *[F.when(met, F.lag(c).over(ends)).otherwise(F.col(f"p_{c}")).alias(f"p_{c}") for c in ("gid", "n", "pos")],
        goes_on.alias("more"),
    )
    edges = written(edges.where("p_gid is not null or more").select(out), "ngram-ends")
    return seen.where("edge = 0").select(out).unionByName(edges)


def join(docs: DataFrame, percent: int = PERCENT, listed: int = LISTED) -> DataFrame:
    """``doc_id, row, n_shingles, component_id`` for every row of ``docs``; ``row`` is a hash of the text."""
    spark = docs.sparkSession
    docs = documents(docs)
    measured = docs.select("doc_id", "text", F.xxhash64("text").alias("row")).mapInArrow(_measure, "kind int, id long, n long, k1 long, k2 long, row long")
    measured = written(measured, "ngram-measured")
    every = measured.where("kind = 0").select(F.col("id").alias("doc_id"), "row", F.col("n").alias("n_shingles"), "k1", "k2")
    shared = _Shared(spark, frequent(measured.where("kind = 1").select("id", "n"), listed))
    prefixes = written(
        docs.where("doc_id is not null").mapInArrow(_prefixes(shared, percent), "doc_id long, n long, k1 long, k2 long, g1 long, g2 long, prefix array<long>, bits binary"),
        "ngram-prefixes",
    )
    # sets (documents with equal sets) and groups (sets with equal size and prefix), each named by its smallest doc_id
    groups = prefixes.groupBy("g1", "g2", "n").agg(F.min("doc_id").alias("gid"), F.first("prefix").alias("prefix"))
    groups = written(groups, "ngram-groups")
    sets = prefixes.groupBy("k1", "k2", "n", "g1", "g2").agg(F.min("doc_id").alias("rep"), F.first("bits").alias("bits"))
    sets = written(sets.join(groups.select("g1", "g2", "n", "gid"), ["g1", "g2", "n"]).select("k1", "k2", "n", "gid", "rep", "bits"), "ngram-sets")

    places = groups.select("gid", F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("pos", "token"))
    postings = listed_places(places)  # files already

    # neighbours, and the centre of each list: the group with the largest share of its prefix in lists
    shares = postings.groupBy("gid").agg((F.count("*") / F.first("n")).alias("shared"))
    centred = postings.join(shares, "gid")
    centre = centred.groupBy("token").agg(F.max_by(F.struct("gid", "n", "pos"), F.struct("shared", "n", "gid")).alias("c")).select(
        "token", F.col("c.gid").alias("p_gid"), F.col("c.n").alias("p_n"), F.col("c.pos").alias("p_pos")
    )
    to_centre = postings.select("token", "gid", "n", "pos").join(centre, "token")
    near = postings.where("p_gid is not null").select(to_centre.columns).unionByName(to_centre).where("p_gid <> gid")
    beside = near.where(_bounds("n", "pos", "p_n", "p_pos", percent))
    first = beside.select(F.least("gid", "p_gid").alias("a"), F.greatest("gid", "p_gid").alias("b")).distinct()
    inside = sets.where("rep <> gid").select(F.col("gid").alias("a"), F.col("rep").alias("b"))
    tried = written(first.unionByName(inside).distinct(), "ngram-neighbours")
    links = _checked(tried, sets, docs, percent)

    # the rest: what lies in different components so far
    part = components(links)
    placed = written(
        sets.join(part.withColumnRenamed("node", "rep"), "rep", "left").select("k1", "k2", "gid", "rep", F.coalesce("component", "rep").alias("component")), "ngram-placed"
    )
    span = placed.groupBy("gid").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    lists = postings.select("token", "gid", "n", "pos").join(span, "gid")
    undone = lists.groupBy("token").agg(F.min("low").alias("l"), F.max("high").alias("h")).where("l < h").select("token")
    lists = written(lists.join(undone, "token", "left_semi"), "ngram-open")
    # sets whose sizes allow a link lie in the same band of sizes or in adjacent ones
    band = F.floor(F.log(F.col("n").cast("double")) / max(math.log(100 / percent) * (1 + 1e-9), 1e-9))
    a = lists.withColumn("band", band).alias("a")
    b = lists.withColumn("band", F.explode(F.array(band - 1, band, band + 1))).alias("b")
    across = a.join(
        b,
        (F.col("a.token") == F.col("b.token")) & (F.col("a.band") == F.col("b.band")) & (F.col("a.gid") < F.col("b.gid"))
        & (F.least("a.low", "b.low") < F.greatest("a.high", "b.high"))
        & _bounds("a.n", "a.pos", "b.n", "b.pos", percent),
    ).select(F.col("a.gid").alias("ga"), F.col("b.gid").alias("gb")).distinct()
    within = span.where("low < high").select(F.col("gid").alias("ga"), F.col("gid").alias("gb"))
    member = placed.select("gid", "rep", "component")
    more = (
        across.unionByName(within)
        .join(member.select(F.col("gid").alias("ga"), F.col("rep").alias("ra"), F.col("component").alias("ca")), "ga")
        .join(member.select(F.col("gid").alias("gb"), F.col("rep").alias("rb"), F.col("component").alias("cb")), "gb")
        .where("ca <> cb and ra <> rb")
        .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
        .distinct()
        .join(tried, ["a", "b"], "left_anti")
    )
    rest = _checked(written(more, "ngram-more"), sets, docs, percent)
    # the components so far are stars: their links to the smallest member are enough
    final = components(part.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(rest.select("a", "b")))
    # an id whose rows have different texts names several sets; each has its own row here
    names = sets.join(final.withColumnRenamed("node", "rep"), "rep", "left").select(
        F.col("k1").alias("s1"), F.col("k2").alias("s2"), F.coalesce("component", "rep").alias("component_id")
    )
    out = every.join(names, (F.col("k1") == F.col("s1")) & (F.col("k2") == F.col("s2")) & (F.col("n_shingles") > 0), "left")
    return out.select("doc_id", "row", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _bounds(na: str, pa_: str, nb: str, pb: str, percent: int):
    """Length bound, and positional bound of a shared shingle at these places of the prefixes."""
    na, pa_, nb, pb = (F.col(c).cast("long") for c in (na, pa_, nb, pb))
    length = 100 * F.least(na, nb) >= percent * F.greatest(na, nb)
    # overlap >= t / (100 + t) (na + nb); at the first shared shingle it is at most 1 + what follows
    place = (100 + percent) * (1 + F.least(na - pa_ - 1, nb - pb - 1)) >= percent * (na + nb)
    return length & place
