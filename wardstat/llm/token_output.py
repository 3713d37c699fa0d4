"""Operator 5: token ids as grammar-compressed binary shards.

Documents are range-partitioned by doc_id (and, within an id, by a hash of the text) and sorted; each task encodes its
texts, appends the end id and cuts the stream into shards of whole documents.
A shard is compressed by Re-Pair: round by round, the id pairs that
occur most often are each replaced by a new symbol (a rule), never across a
document's end, until no pair is frequent or the rules are used up. A shard file holds

    magic  n_rules  n_docs  n_symbols  width        (4 bytes, then 4 little-endian uint32)
    rules        n_rules x 2 uint32      the pair each rule stands for
    lengths      n_rules uint32          ids that each rule expands to
    doc symbols  n_docs uint32           symbols of each document
    symbols      n_symbols uint16 or uint32

so that a document can be decoded alone: skip to its symbols, take its ids'
number from the lengths, expand its rules. The shards are rows of a Parquet table (order, ids of
the documents, payload), which any executor reads without a local file.

Encoding. A white space byte that follows another kind of byte always begins
a pre-token, as does an ASCII mark or digit that follows an ASCII letter, so a text is cut there and each distinct piece is encoded by the tokenizers library
once per worker; pieces' ids are gathered by fingerprint. Texts with white space
outside ASCII, and those that hold the string of a token added to the tokenizer's vocabulary
(which becomes that token's id), are encoded whole.

Defined cases: null and empty text give the end id alone; rows of one id are ordered by
a hash of the text; a null id sorts first; an empty table gives no shards.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardstat.llm import textbytes as tb
from wardstat.llm.tables import documents

MAGIC = b"RPR1"
TERMINALS = 50_257
END = 0
SHARD_IDS = 2 << 20
MIN_COUNT = 16
#: symbols that 16 bits can hold beside the ids
MAX_RULES = (1 << 16) - TERMINALS
CACHE_PIECES = 1_500_000
#: pieces that are encoded as one string
JOINED = 1_000
SHARD_SCHEMA = "part int, shard int, n_ids long, doc_ids array<long>, payload binary"
ROW_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<int>"

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK = np.zeros(256, bool)
_MARK[33:127] = True
_MARK &= ~_LETTER


class Encoder:
    """Ids of texts, with the pieces met so far kept by fingerprint."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core, and each thread its own memory
        self.tok = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        vocab = self.tok.get_vocab(with_added_tokens=False)
        self.n_bytes = np.zeros(max(vocab.values()) + 2, np.int64)
        for piece, i in vocab.items():
            self.n_bytes[i] = len(piece)  # byte-level: one character a byte
        self.clear()

    def clear(self) -> None:
        self.keys = np.empty(0, np.uint64)
        self.at = np.empty(0, np.int64)
        self.n = np.empty(0, np.int64)
        self.ids = np.empty(0, np.uint16)

    def whole(self, text: str) -> np.ndarray:
        # without offsets, which nobody reads
        return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint16)

    def learn(self, data: np.ndarray, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Encode pieces that are new; ``keys`` are in order."""
        joins = _SPACE[data[starts]] & ~_SPACE[data[ends - 1]]
        if any(len(t.split()) != 1 or t.strip() != t for t in self.added):
            joins[:] = False  # pieces put together could make such a token
        parts, counts = [], np.empty(len(keys), np.int64)
        order = np.concatenate([np.flatnonzero(joins), np.flatnonzero(~joins)])
        joined = int(joins.sum())
        for i in range(0, joined, JOINED):
            pick = order[i : min(i + JOINED, joined)]
            sizes = ends[pick] - starts[pick]
            raw = data[np.repeat(starts[pick] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())]
            ids = self.whole(raw.tobytes().decode())
            upto = np.searchsorted(np.cumsum(self.n_bytes[ids]), np.cumsum(sizes)) + 1
            counts[pick] = np.diff(upto, prepend=0)
            parts.append(ids)
        alone = order[joined:]
        for i in range(0, len(alone), 5_000):
            pick = alone[i : i + 5_000]
            strings = [data[s:e].tobytes().decode() for s, e in zip(starts[pick], ends[pick])]
            for k, e in zip(pick, self.tok.encode_batch_fast(strings, add_special_tokens=False)):
                parts.append(np.array(e.ids, np.uint16))
                counts[k] = len(parts[-1])
        at = np.empty(len(keys), np.int64)
        at[order] = len(self.ids) + np.concatenate(([0], np.cumsum(counts[order])[:-1]))
        self.ids = np.concatenate([self.ids, *parts])
        place = np.searchsorted(self.keys, keys)  # both are in order
        self.keys, self.at, self.n = (np.insert(x, place, y) for x, y in ((self.keys, keys), (self.at, at), (self.n, counts)))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the rows of one block, one after the other with the end id, and each row's number."""
        n_docs = len(offsets) - 1
        odd = odd_space(data, offsets) | holding(self.added, data, offsets)
        space = _SPACE[data]
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        begins[1:] |= _MARK[data[1:]] & _LETTER[data[:-1]]
        begins[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(data))
        doc = np.searchsorted(offsets, starts, "right") - 1
        if odd.any():
            keep = ~odd[doc]
            starts, ends, doc = starts[keep], ends[keep], doc[keep]
        prints = tb.fingerprints(tb.running(data), starts, ends)
        rank = np.argsort(prints)
        fresh = np.append(True, np.diff(prints[rank]) != 0) if len(rank) else np.zeros(0, bool)
        first = rank[fresh]
        keys, back = prints[first], np.empty(len(rank), np.int64)
        back[rank] = np.cumsum(fresh) - 1
        if len(self.keys) > CACHE_PIECES:
            self.clear()
        slot = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool)
        inside = slot < len(self.keys)
        new[inside] = self.keys[slot[inside]] != keys[inside]
        if new.any():
            self.learn(data, keys[new], starts[first[new]], ends[first[new]])
            slot = np.searchsorted(self.keys, keys)
        n, at = self.n[slot][back], self.at[slot][back]
        counts = np.bincount(doc, weights=n, minlength=n_docs).astype(np.int64)
        alone = {i: self.whole(data[offsets[i] : offsets[i + 1]].tobytes().decode()) for i in np.flatnonzero(odd)}
        for i, ids in alone.items():
            counts[i] = len(ids)
        counts += 1
        out = np.full(counts.sum(), END, np.uint16)
        begin = np.concatenate(([0], np.cumsum(counts)[:-1]))
        before = np.cumsum(n) - n  # ids of the pieces before, of documents cut into pieces
        first_of = np.searchsorted(doc, doc)  # the row's first piece
        to = begin[doc] + before - before[first_of] if len(doc) else before
        steps = np.arange(n.sum()) - np.repeat(before, n)
        out[np.repeat(to, n) + steps] = self.ids[np.repeat(at, n) + steps]
        for i, ids in alone.items():
            out[begin[i] : begin[i] + len(ids)] = ids
        return out, counts


def odd_space(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows with white space outside ASCII, or that may have it (by its first bytes in UTF-8)."""
    a, b = data[:-1], data[1:]
    at = np.flatnonzero(((a == 0xC2) & ((b == 0x85) | (b == 0xA0))) | ((a == 0xE1) & (b == 0x9A)) | ((a == 0xE2) & ((b == 0x80) | (b == 0x81))) | ((a == 0xE3) & (b == 0x80)))
    out = np.zeros(len(offsets) - 1, bool)
    out[np.searchsorted(offsets, at, "right") - 1] = True
    return out


def holding(strings: list[bytes], data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows that hold one of the strings (or end in one that goes on in the next row)."""
    out = np.zeros(len(offsets) - 1, bool)
    raw = data.tobytes()
    for string in filter(None, strings):
        at = raw.find(string)
        while at >= 0:
            out[np.searchsorted(offsets, at, "right") - 1] = True
            at = raw.find(string, at + 1)
    return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def repair(ids: np.ndarray, counts: np.ndarray, min_count: int = MIN_COUNT, max_rules: int = MAX_RULES):
    """Rules (n x 2), symbols, and symbols of each document."""
    seq = ids.astype(np.uint32)
    last = np.zeros(len(seq), bool)
    last[np.cumsum(counts) - 1] = True
    rules: list[np.ndarray] = []
    n_rules = 0
    while len(seq) > 1 and n_rules < max_rules:
        pairs = (seq[:-1] << np.uint32(16)) | seq[1:]
        free = ~last[:-1]
        ordered = np.sort(pairs[free])
        edge = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.empty(0, np.int64)
        times = np.diff(np.append(edge, len(ordered)))
        often = np.flatnonzero(times >= min_count)
        # a round takes up to half of the rules that are left, the most frequent pairs first
        room = max(1, (max_rules - n_rules + 1) // 2)
        if len(often) > room:
            often = often[np.argsort(-times[often], kind="stable")[:room]]
        if not len(often):
            break
        chosen = np.sort(ordered[edge[often]])
        table, nth_at = np.full(1 << 20, chosen[0], np.uint32), np.zeros(1 << 20, np.int16)
        table[_spot(chosen)] = chosen  # of pairs at one spot, the last is replaced now, others in a later round
        nth_at[_spot(chosen)] = np.arange(len(chosen))
        put = np.flatnonzero((table.take(_spot(pairs), mode="clip") == pairs) & free)
        # of a run of neighbouring hits, every second one can be replaced
        begins = np.append(True, np.diff(put) > 1) if len(put) else np.empty(0, bool)
        run = np.maximum.accumulate(np.where(begins, put, 0))
        put = put[(put - run) % 2 == 0]
        slot = nth_at[_spot(pairs[put])]
        used = np.zeros(len(chosen), bool)
        used[slot] = True
        nth = np.cumsum(used) - 1  # a pair that no place is left for is no rule
        chosen = chosen[used]
        seq[put] = TERMINALS + n_rules + nth[slot].astype(np.uint32)
        last[put] = last[put + 1]
        keep = np.ones(len(seq), bool)
        keep[put + 1] = False
        seq, last = seq[keep], last[keep]
        rules.append(np.stack([chosen >> np.uint32(16), chosen & np.uint32(0xFFFF)], 1))
        n_rules += len(chosen)
    pairs = np.concatenate(rules) if rules else np.empty((0, 2), np.uint32)
    return pairs, seq, np.diff(np.append(-1, np.flatnonzero(last)))


def _spot(pairs: np.ndarray) -> np.ndarray:
    return (pairs * np.uint32(0x9E3779B1)) >> np.uint32(12)


def expansion_lengths(rules: np.ndarray) -> np.ndarray:
    lengths = np.ones(TERMINALS + len(rules), np.int64)
    for k, (a, b) in enumerate(rules.tolist()):  # a rule stands for earlier symbols
        lengths[TERMINALS + k] = lengths[a] + lengths[b]
    return lengths[TERMINALS:]


def pack(ids: np.ndarray, counts: np.ndarray) -> bytes:
    """A shard file of whole documents."""
    rules, seq, per_doc = repair(ids, counts)
    wide = len(rules) + TERMINALS > 1 << 16
    head = MAGIC + struct.pack("<4I", len(rules), len(counts), len(seq), 4 if wide else 2)
    parts = (rules.astype("<u4"), expansion_lengths(rules).astype("<u4"), per_doc.astype("<u4"), seq.astype("<u4" if wide else "<u2"))
    return head + b"".join(x.tobytes() for x in parts)


class Shard:
    """Read access to a shard file."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a shard file")
        n_rules, n_docs, n_symbols, width = struct.unpack_from("<4I", payload, 4)
        at = 20
        self.rules = np.frombuffer(payload, "<u4", 2 * n_rules, at).reshape(-1, 2)
        at += 8 * n_rules
        self.lengths = np.concatenate([np.ones(TERMINALS, np.int64), np.frombuffer(payload, "<u4", n_rules, at)])
        at += 4 * n_rules
        self.per_doc = np.frombuffer(payload, "<u4", n_docs, at).astype(np.int64)
        at += 4 * n_docs
        self.symbols = np.frombuffer(payload, "<u2" if width == 2 else "<u4", n_symbols, at)
        self.begin = np.concatenate(([0], np.cumsum(self.per_doc)))
        # what each symbol stands for, one after the other
        self.at = np.concatenate((np.arange(TERMINALS), TERMINALS + np.cumsum(self.lengths[TERMINALS:]) - self.lengths[TERMINALS:]))
        self.flat = np.zeros(TERMINALS + int(self.lengths[TERMINALS:].sum()), np.uint32)
        self.flat[:TERMINALS] = np.arange(TERMINALS)
        for k, (a, b) in enumerate(self.rules.tolist()):
            s, n, m = self.at[TERMINALS + k], self.lengths[a], self.lengths[b]
            self.flat[s : s + n] = self.flat[self.at[a] : self.at[a] + n]
            self.flat[s + n : s + n + m] = self.flat[self.at[b] : self.at[b] + m]

    def decode(self, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of documents ``first`` to ``last`` (not included), and the number of each."""
        symbols = self.symbols[self.begin[first] : self.begin[last]].astype(np.int64)
        n = self.lengths[symbols]
        upto = np.cumsum(n)
        out = self.flat[np.repeat(self.at[symbols] - upto + n, n) + np.arange(upto[-1] if len(upto) else 0)]
        ends = upto[self.begin[first + 1 : last + 1] - self.begin[first] - 1]
        return out, np.diff(ends, prepend=0)


def _shards(path: str, shard_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard, enc = TaskContext.get().partitionId(), 0, encoder(path)
        held: list = []
        n_held = 0

        def emit():
            ids, counts = (np.concatenate([x[k] for x in held]) for k in (0, 1))
            docs = pa.concat_arrays([x[2] for x in held])
            lists = pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs)
            return pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "shard": pa.array([shard], pa.int32()), "n_ids": pa.array([len(ids)], pa.int64()),
                 "doc_ids": lists, "payload": pa.array([pack(ids, counts)], pa.binary())}
            )

        for batch in batches:
            data, offsets = tb.texts(batch.column("text"))
            doc_ids = batch.column("doc_id")
            for i, j in tb.blocks(offsets):
                ids, counts = enc.encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                ends = np.cumsum(counts)
                a = 0
                while a < len(counts):  # whole documents up to a full shard
                    done = ends[a - 1] if a else 0
                    b = max(int(np.searchsorted(ends, done + shard_ids - n_held)) + 1, a + 1)
                    b = min(b, len(counts))
                    held.append((ids[done : ends[b - 1]], counts[a:b], doc_ids.slice(i + a, b - a)))
                    n_held += int(ends[b - 1] - done)
                    a = b
                    if n_held >= shard_ids:
                        yield emit()
                        held, n_held, shard = [], 0, shard + 1
        if held:
            yield emit()

    return run


def write_shards(docs: DataFrame, path: str, tokenizer: str, shard_ids: int = SHARD_IDS) -> None:
    """Encode ``docs`` in ascending doc_id order and write the shard table to ``path``."""
    # rows of one id may be many: they are spread by a hash of the text, and ordered by it
    tied = documents(docs).withColumn("tie", F.xxhash64("text"))
    rows = tied.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").drop("tie")
    rows.mapInArrow(_shards(tokenizer, shard_ids), SHARD_SCHEMA).write.option("compression", "none").parquet(path)


def read_shards(spark, path: str, with_ids: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` (and ``ids``, if asked for) of each document, from the shard files."""
    table = spark.read.schema(SHARD_SCHEMA).parquet(path)
    within = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    per_part = table.groupBy("part").agg(F.sum("n_ids").alias("_n"))
    before = per_part.select("part", F.coalesce(F.sum("_n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    starts = table.select("part", "shard", "n_ids").select("part", "shard", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("_in"))
    placed = starts.join(before, "part").select("part", "shard", (F.col("_base") + F.col("_in")).alias("start"))
    out = table.select("part", "shard", "doc_ids", "payload").join(F.broadcast(placed) if placed.limit(100_001).count() <= 100_000 else placed, ["part", "shard"])
    rows = out.select("doc_ids", "payload", "start").mapInArrow(_decode(with_ids), ROW_SCHEMA)
    return rows if with_ids else rows.drop("ids")


def _decode(with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                doc_ids = batch.column("doc_ids")[row].values
                shard, start = Shard(batch.column("payload")[row].as_buffer().to_pybytes()), batch.column("start")[row].as_py()
                ids, counts = shard.decode(0, len(doc_ids))
                ends = np.cumsum(counts)
                raw = memoryview(ids.astype("<u4").tobytes())
                crcs = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), counts.tolist())]
                offsets = np.append(0, ends).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32))) if with_ids else pa.nulls(len(counts), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": doc_ids, "start": pa.array(start + ends - counts), "n_tokens": pa.array(counts), "ids_crc32": pa.array(crcs, pa.int64()), "ids": lists}
                )

    return run
