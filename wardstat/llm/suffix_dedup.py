"""Operator 8: repeated byte strings, by a hash join of strings around anchors in place of the longest-previous-factor array.

A string of ``LENGTH`` bytes that begins in two places is found in three steps.

1. Anchors. Of the ``GRAM``-byte pieces in a string, the one of smallest fingerprint (the
   leftmost, if several) is its anchor; equal strings have equal anchors at the same
   offset. Neighbouring strings mostly share an anchor, so a text is
   cut into runs of start positions, one for each anchor, with the bytes that their strings span
   (the run's context). Only an anchor that has two places can have repeated strings.
2. Whole contexts. Of contexts with one fingerprint, every string recurs.
3. Names. One context of each kind, of the anchors that have several kinds, is read, and the
   strings at its start positions are named by 64-bit fingerprints and sorted by name and, among equals, by place
   in the corpus. A string whose neighbour before has the same name has an earlier copy (its longest
   previous factor has ``LENGTH`` bytes or more), one whose neighbour behind has it a later one. This takes the
   place of a suffix order of the bytes, which the README measures.

``keep_first`` removes what has an earlier copy; without it, every copy is removed.
The bytes covered by removed strings are joined into spans, and cut from the text.
Texts are compared as UTF-8 bytes, and matches never cross documents.

Equal texts are one text with a count. An anchor with more than ``HOT_KINDS`` kinds of context (a
passage in very many surroundings) is not put in order in one task: its strings are counted by name
by a Spark aggregate, with the same result. Anchors are spread by fingerprint, never by document, so
a long document or a large group of copies does not meet in one task.

``shared_passages`` does the same on words in place of bytes, each word one symbol.

Defined cases: null counts as empty; texts under ``LENGTH`` bytes stay whole; repeated rows are
copies of each other; a null doc_id comes first in corpus order; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardstat.llm import textbytes as tb
from wardstat.llm.mixing import n_words
from wardstat.llm.tables import documents, small_enough, written
from wardstat.session import drop_scratch, scratch_folder, scratch_mark, write_table

LENGTH = 400
GRAM = 96
#: passages of over 50 words, and the words of their anchors
PASSAGE, PASSAGE_GRAM = 51, 16
BATCH_BYTES = 2 << 20
BROADCAST_KEYS = 1 << 19
#: contexts of one anchor that meet in one task (about 1 MB); beyond, strings are counted by name
HOT_KINDS = 1 << 11
_PLACE_BITS = np.uint64(23)
SEGMENT = 1 << 20
_KEYS = ["fp", "kind", "t1", "t2", "start", "n"]


def runs(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Runs of start positions that share an anchor: ``row, start, n, anchor fingerprint, context fingerprint``
    (``start`` within the block)."""
    empty = np.empty(0, np.int64)
    last = len(data) - length
    if last < 0:
        return empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    sums = tb.running(data)
    at = np.arange(len(data) - gram + 1)
    pieces = tb.fingerprints(sums, at, at + gram)
    anchor = leftmost_smallest(pieces, length - gram + 1)
    begin = np.arange(last + 1)
    row = np.searchsorted(offsets, begin, "right") - 1
    whole = begin + length <= offsets[row + 1]
    begin, row, anchor = begin[whole], row[whole], anchor[whole]
    if not len(begin):
        return empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    edge = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])))
    n = np.diff(np.append(edge, len(begin)))
    start = begin[edge]
    return row[edge], start, n, pieces[anchor[edge]], tb.fingerprints(sums, start, start + n + length - 1)


def leftmost_smallest(pieces: np.ndarray, window: int) -> np.ndarray:
    """Place of the smallest fingerprint of each window (by its upper bits; the leftmost of equals).

    The place is packed below the fingerprint's upper 41 bits, segment by segment, so that a text of any
    length gets the same choice and a minimum of pairs of minima (doubling) gives both."""
    low = (np.uint64(1) << _PLACE_BITS) - np.uint64(1)
    n = len(pieces) - window + 1
    out = np.empty(n, np.int64)
    for s in range(0, n, SEGMENT):
        part = pieces[s : s + SEGMENT + window - 1]
        least, have = (part & ~low) | np.arange(len(part), dtype=np.uint64), 1
        while have * 2 <= window:
            least = np.minimum(least[:-have], least[have:])
            have *= 2
        rest = window - have
        out[s : s + SEGMENT] = (np.minimum(least[: len(least) - rest], least[rest:]) & low).astype(np.int64) + s
    return out


def _anchors(length: int, gram: int, words: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tb.texts(batch.column("text"))
            keys = [batch.column(c) for c in ("doc_id", "t1", "t2")]
            for i, j in tb.blocks(offsets):
                part, upto = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                if words:
                    part, upto = tb.words(part, upto)
                row, start, n, fp, kind = runs(part, upto, length, gram)
                inside = start - upto[row] if len(row) else start
                take = pa.array(row + i)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(fp.view(np.int64)), pa.array(kind.view(np.int64)), *(k.take(take) for k in keys), pa.array(inside.astype(np.int32)), pa.array(n.astype(np.int32))],
                    ["fp", "kind", "doc_id", "t1", "t2", "start", "n"],
                )

    return run


def _contexts(length: int, words: bool):
    """Bytes (or codes of words) of the wanted runs of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                raw = batch.column("text")[k].as_buffer().to_pybytes()
                if words:
                    raw = tb.words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]
                want = batch.column("want")[k].values
                start, n = want.field("start").to_numpy(), want.field("n").to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [want.field("fp"), want.field("place"), pa.repeat(batch.column("t1")[k], len(start)), pa.repeat(batch.column("t2")[k], len(start)),
                     want.field("start"), want.field("n"), want.field("emit"), pa.array([bytes(raw[s : s + m + length - 1]) for s, m in zip(start.tolist(), n.tolist())], pa.binary())],
                    ["fp", "place", "t1", "t2", "start", "n", "emit", "bytes"],
                )

    return run


def _symbols(column: pa.Array, words: bool) -> tuple[np.ndarray, np.ndarray]:
    """Contexts as bytes, or as codes of words, and their offsets."""
    data, offsets = tb.texts(column)
    return (data.view(np.uint64), offsets // 8) if words else (data, offsets)


def _names(length: int, words: bool):
    """A row for each start position of a context, with the name of its string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _symbols(batch.column("bytes"), words)
            n = batch.column("n").to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(n)), n)
            step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            at = offsets[row] + step
            names = tb.fingerprints(tb.running(data), at, at + length) if len(at) else np.empty(0, np.uint64)
            held = batch.select(["fp", "place", "t1", "t2", "emit"]).take(pa.array(row))
            yield pa.RecordBatch.from_arrays(
                [*held.columns, pa.array(names.view(np.int64)), pa.array((batch.column("start").to_numpy()[row] + step).astype(np.int32))],
                ["fp", "place", "t1", "t2", "emit", "name", "at"],
            )

    return run


def previous_factors(data: np.ndarray, at: np.ndarray, length: int, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For strings of ``length`` symbols at ``at`` (in corpus order): is there an earlier, a later one of the same name?"""
    names = tb.mix64(tb.fingerprints(tb.running(data), at, at + length) ^ salt)
    order = np.argsort(names, kind="stable")  # neighbours that are equal stay in corpus order
    same = names[order[1:]] == names[order[:-1]]
    earlier, later = np.zeros(len(at), bool), np.zeros(len(at), bool)
    earlier[order[1:]] = same
    later[order[:-1]] = same
    return earlier, later


def _factors(length: int, keep_first: bool, words: bool):
    """Spans of repeated strings in contexts that arrive by anchor and corpus order."""

    def solve(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        data, offsets = _symbols(table.column("bytes"), words)
        n = table.column("n").to_numpy().astype(np.int64)
        row = np.repeat(np.arange(len(n)), n)
        step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        fp = table.column("fp").to_numpy().view(np.uint64)
        earlier, later = previous_factors(data, offsets[row] + step, length, fp[row])
        emit = table.column("emit").to_numpy(zero_copy_only=False)[row]
        hit = np.flatnonzero((earlier if keep_first else earlier | later) & emit)
        if not len(hit):
            first = last = hit
        else:
            new = np.append(True, (np.diff(hit) > 1) | (row[hit[1:]] != row[hit[:-1]]))
            first, last = hit[new], hit[np.append(np.flatnonzero(new)[1:] - 1, len(hit) - 1)]
        start = table.column("start").to_numpy()
        take = pa.array(row[first])
        return pa.RecordBatch.from_arrays(
            [*(table.column(c).combine_chunks().take(take) for c in ("t1", "t2")), pa.array((start[row[first]] + step[first]).astype(np.int32)), pa.array((start[row[last]] + step[last] + length).astype(np.int32))],
            ["t1", "t2", "first", "last"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            fp = batch.column("fp").to_numpy()
            # an anchor's contexts stay together: cut where the last anchor of the batch begins
            cut = int(np.flatnonzero(np.append(True, fp[1:] != fp[:-1]))[-1]) if len(fp) else 0
            known = held and len(fp) and held[-1].column("fp")[-1].as_py() == fp[0]
            if size + batch.nbytes > BATCH_BYTES and (cut or (held and not known)):
                if cut:
                    held.append(batch.slice(0, cut))
                yield solve(held)
                held, size = [], 0
                batch = batch.slice(cut)
            held.append(batch)
            size += batch.nbytes
        if held:
            yield solve(held)

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What remains of each text."""
    for batch in batches:
        out = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
        for raw, spans in zip(batch.column("text"), batch.column("spans")):
            raw = raw.as_buffer().to_pybytes() if raw.is_valid else b""
            merged: list[list[int]] = []
            if spans.is_valid:
                a, b = spans.values.field("first").to_numpy(), spans.values.field("last").to_numpy()
                for k in np.argsort(a, kind="stable").tolist():
                    if merged and a[k] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], int(b[k]))
                    else:
                        merged.append([int(a[k]), int(b[k])])
            at, parts = 0, []
            for first, last in merged:
                parts.append(raw[at:first])
                at = last
            kept = b"".join([*parts, raw[at:]])
            for name, value in zip(out, (len(raw), len(raw) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), kept)):
                out[name].append(value)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(out[c], pa.int64()) for c in ("n_bytes", "n_removed", "n_spans")), pa.array(out["kept_sha256"], pa.string()), pa.array(out["kept"], pa.binary()), batch.column("n_shared")],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "n_shared"],
        )


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return documents(docs).select("doc_id", text.alias("text"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"))


def repeated(rows: DataFrame, length: int, keep_first: bool, gram: int, hot_kinds: int = HOT_KINDS, words: bool = False) -> DataFrame:
    """``t1, t2, first, last``: repeated strings of ``length`` bytes (or words) and more in different texts' places."""
    gram = min(gram, length)
    least = 2 * length - 1 if words else length
    found = rows.where(F.octet_length("text") >= least).mapInArrow(_anchors(length, gram, words), "fp long, kind long, doc_id long, t1 long, t2 long, start int, n int")
    places = written(found.groupBy(*_KEYS).agg(F.min("doc_id").alias("doc_id")), "repeats-places")
    place = F.struct("doc_id", "t1", "t2", "start", "n")
    kinds = written(places.groupBy("fp", "kind").agg(F.count("*").alias("places"), F.min(place).alias("place")), "repeats-kinds")

    # whole contexts with several places
    several = kinds.where("places > 1")
    whole = places.join(several.select("fp", "kind", F.col("place").alias("earliest")), ["fp", "kind"])
    if keep_first:
        whole = whole.where(~place.eqNullSafe(F.col("earliest")))
    whole = whole.select("t1", "t2", F.col("start").alias("first"), (F.col("start") + F.col("n") + length - 1).alias("last"))

    # one context of each kind of the anchors that have several kinds
    mixed = kinds.groupBy("fp").count().where("count > 1").select("fp", (F.col("count") > hot_kinds).alias("hot"))
    wanted = kinds.join(mixed, "fp").select(
        "fp", "hot", "place", "place.t1", "place.t2", "place.start", "place.n", (F.lit(keep_first) | (F.col("places") == 1)).alias("emit")
    )
    wanted = written(wanted, "repeats-chosen")
    any_hot = wanted.where("hot").limit(1).count() > 0
    partial = _in_order(rows, wanted.where("not hot"), length, keep_first, words)
    if any_hot:
        partial = partial.unionByName(_by_name(rows, wanted.where("hot"), length, keep_first, words))
    return whole.unionByName(partial)


def _copies(rows: DataFrame) -> DataFrame:
    copies = rows.groupBy("t1", "t2").agg(F.count("*").alias("copies"), F.min("doc_id").alias("low"))
    return written(copies.where("copies > 1"), "repeats-copies")


def shared_passages(docs: DataFrame, words: int = PASSAGE, gram: int = PASSAGE_GRAM, hot_kinds: int = HOT_KINDS) -> DataFrame:
    """``t1, t2, n_shared`` of the texts that hold some: words in passages of ``words`` words and more
    that are also somewhere else (in another row, or again in the same text). White space doesn't count.
    Written to the shared folder; what led to it is deleted."""
    spark, rows = docs.sparkSession, _rows(docs)
    mark, path = scratch_mark(spark), scratch_folder(spark, "llm-repeats-passages")
    spans = repeated(rows, words, False, gram, hot_kinds, words=True)
    # spans of a text in order: each adds what lies beyond the ones before
    after = F.max("last").over(Window.partitionBy("t1", "t2").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.col("last") - F.greatest(F.col("first"), F.coalesce(after, F.lit(0))), F.lit(0))
    told = spans.distinct().select("t1", "t2", fresh.alias("n")).groupBy("t1", "t2").agg(F.sum("n").alias("n_shared"))
    copied = _copies(rows).select("t1", "t2").join(rows, ["t1", "t2"]).dropDuplicates(["t1", "t2"]).select("t1", "t2", n_words(F.col("text")).alias("n_shared"))
    out = told.unionByName(copied.where(F.col("n_shared") >= words)).groupBy("t1", "t2").agg(F.max("n_shared").alias("n_shared"))
    out = write_table(out, "", path)
    drop_scratch(spark, mark, keep=(path,))
    return out


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, keep_first: bool = True, gram: int = GRAM, hot_kinds: int = HOT_KINDS, passages: DataFrame | None = None
) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept, n_shared`` of every row; ``kept`` are the bytes left.
    ``passages`` (of ``shared_passages``) gives ``n_shared``; without them it is null."""
    rows = _rows(docs)
    spans = repeated(rows, length, keep_first, gram, hot_kinds)
    spans = written(spans.groupBy("t1", "t2").agg(F.collect_list(F.struct("first", "last")).alias("spans")), "repeats-spans")
    copies = _copies(rows)
    changed = spans.select("t1", "t2").unionByName(copies.select("t1", "t2"))
    if passages is not None:
        changed = changed.unionByName(passages.select("t1", "t2"))
    changed = written(changed.distinct(), "repeats-changed")
    same = rows.join(_keys(changed), ["t1", "t2"], "left_anti")
    other = rows.join(_keys(changed), ["t1", "t2"], "left_semi")
    joined = other.join(spans, ["t1", "t2"], "left").join(copies, ["t1", "t2"], "left")
    none_shared = F.lit(None if passages is None else 0).cast("long")
    joined = joined.withColumn("n_shared", none_shared) if passages is None else joined.join(passages, ["t1", "t2"], "left").fillna(0, ["n_shared"])
    long_enough = F.octet_length("text") >= length
    copied = F.col("copies").isNotNull() & long_enough
    if keep_first:
        copied = copied & ~F.col("doc_id").eqNullSafe(F.col("low"))
    all_of_it = F.array(F.struct(F.lit(0).alias("first"), F.octet_length("text").alias("last")))
    cut = joined.select("doc_id", "text", F.when(copied, all_of_it).otherwise(F.col("spans")).alias("spans"), "n_shared")
    none = F.lit(None).cast("array<struct<first:int,last:int>>")
    cut = cut.unionByName(same.select("doc_id", "text", none.alias("spans"), none_shared.alias("n_shared")))
    return cut.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, n_shared long")


def _chosen_contexts(rows: DataFrame, wanted: DataFrame, length: int, words: bool) -> DataFrame:
    """The wanted contexts with their bytes: texts that have some, each once with its wanted runs."""
    wanted = written(wanted.groupBy("t1", "t2").agg(F.collect_list(F.struct("fp", "place", "start", "n", "emit")).alias("want")), "repeats-wanted")
    chosen = rows.join(_keys(wanted), ["t1", "t2"], "left_semi").dropDuplicates(["t1", "t2"])
    distinct = chosen.join(wanted, ["t1", "t2"]).select("t1", "t2", "text", "want")
    kind = "struct<doc_id:bigint,t1:bigint,t2:bigint,start:int,n:int>"
    return distinct.mapInArrow(_contexts(length, words), f"fp long, place {kind}, t1 long, t2 long, start int, n int, emit boolean, bytes binary")


def _in_order(rows: DataFrame, wanted: DataFrame, length: int, keep_first: bool, words: bool) -> DataFrame:
    """Spans by order of names: an anchor's contexts (``HOT_KINDS`` at most) meet in one task."""
    ordered = _chosen_contexts(rows, wanted, length, words).repartition("fp").sortWithinPartitions("fp", "place").drop("place")
    return ordered.mapInArrow(_factors(length, keep_first, words), "t1 long, t2 long, first int, last int")


def _by_name(rows: DataFrame, wanted: DataFrame, length: int, keep_first: bool, words: bool) -> DataFrame:
    """The same for anchors with more contexts than one task should hold: Spark counts the strings
    by name (partial counts first) and joins the names that recur."""
    kind = "struct<doc_id:bigint,t1:bigint,t2:bigint,start:int,n:int>"
    named = _chosen_contexts(rows, wanted, length, words).mapInArrow(_names(length, words), f"fp long, place {kind}, t1 long, t2 long, emit boolean, name long, at int")
    named = written(named, "repeats-named")
    here = F.struct("place", "at")
    same = named.groupBy("fp", "name").agg(F.count("*").alias("c"), F.min(here).alias("earliest")).where("c > 1")
    hits = named.join(same, ["fp", "name"]).where("emit")
    if keep_first:
        hits = hits.where(~here.eqNullSafe(F.col("earliest")))
    return hits.select("t1", "t2", F.col("at").alias("first"), (F.col("at") + length).alias("last"))


def _keys(texts: DataFrame) -> DataFrame:
    """The texts' two-number keys; broadcast when there are at most ``BROADCAST_KEYS``."""
    keys = texts.select("t1", "t2")
    return F.broadcast(keys) if small_enough(keys, BROADCAST_KEYS) else keys
